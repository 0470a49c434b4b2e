"""Open lots and closed trades continued from a snapshot (P1, P2): only groups with new trades are swept again.

What FIFO knows of the past is the lots that are left, in their order; sells beyond the holdings are lost and leave nothing.
So the lots of a snapshot stand for all trades up to its mark (time and id of the last one per portfolio and ISIN). A group
whose new trades all come after its mark starts from its lots; one with a late trade is swept from its whole history; the rest
keep what they have.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import QUANTITY
from . import fifo
from .fifo import KEYS

WHOLE = "whole_quantity"
_TRADE = [*KEYS, "ts", "id", "side", "quantity", "price", "commission", "currency", "source", "paper_name"]


@dataclass(frozen=True)
class Snapshot:
    lots: DataFrame   # fifo.open_lots with whole_quantity (the quantity bought)
    marks: DataFrame  # portfolio_id, isin, mark (ts, id)


def _same_group() -> Column:
    same = [F.col(k).eqNullSafe(F.col(f"g_{k}")) for k in KEYS]
    return same[0] & same[1]


def _keyed(groups: DataFrame) -> DataFrame:
    return groups.withColumnsRenamed({k: f"g_{k}" for k in KEYS})


def _marks(tx: DataFrame) -> DataFrame:
    return tx.groupBy(*KEYS).agg(F.max(F.struct("ts", "id")).alias("mark"))


def _whole(tx: DataFrame) -> DataFrame:
    return tx.select(*_TRADE, F.col("quantity").cast(QUANTITY).alias(WHOLE))


def snapshot(tx: DataFrame) -> Snapshot:
    """The state after all of `tx`."""
    return Snapshot(fifo.open_lots(_whole(tx), [WHOLE]), _marks(tx))


def _groups(old: Snapshot, new: DataFrame) -> DataFrame:
    """Groups with new trades: g_portfolio_id, g_isin, late."""
    first = new.groupBy(*KEYS).agg(F.min(F.struct("ts", "id")).alias("first"))
    return _keyed(first.join(_keyed(old.marks), _same_group(), "left").select(
        *KEYS, F.coalesce(F.col("first") <= F.col("mark"), F.lit(False)).alias("late")))


def _swept(old: Snapshot, new: DataFrame, history: DataFrame, groups: DataFrame) -> DataFrame:
    """The trades to sweep: lots and new trades of groups in order, the history of groups with a late trade."""
    late, on_time = groups.filter("late"), groups.filter("NOT late")
    none = F.lit(None).cast("string")
    lots = old.lots.join(on_time, _same_group(), "left_semi").select(
        *KEYS, "ts", "id", F.lit("K").alias("side"), "quantity", "price", "commission", "currency", none.alias("source"), none.alias("paper_name"), WHOLE)
    new, history = _whole(new), _whole(history)
    return (
        lots.unionByName(new.join(on_time, _same_group(), "left_semi"))
        .unionByName(history.join(late, _same_group(), "left_semi"))
    )


def continued(old: Snapshot, new: DataFrame, history: DataFrame) -> Snapshot:
    """The snapshot after `new` trades too. `history`: all trades, the new ones among them."""
    groups = _groups(old, new)
    kept = old.lots.join(groups, _same_group(), "left_anti")
    lots = kept.unionByName(fifo.open_lots(_swept(old, new, history, groups), [WHOLE]))
    marks = old.marks.unionByName(_marks(new)).groupBy(*KEYS).agg(F.max("mark").alias("mark"))
    return Snapshot(lots, marks)


def continued_trades(closed: DataFrame, old: Snapshot, new: DataFrame, history: DataFrame, instruments: DataFrame, commission: str = "compat") -> DataFrame:
    """Closed trades up to the snapshot (`closed`, with the same `commission`) and those that `new` closes; groups with a late trade are said anew."""
    groups = _groups(old, new)
    late = groups.filter("late")
    kept = closed.join(late, _same_group(), "left_anti")
    return kept.unionByName(fifo.closed_trades(_swept(old, new, history, groups), instruments, commission, newest_first=False))
