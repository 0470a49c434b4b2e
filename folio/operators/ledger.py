"""Ledger maintenance and scans.

A ledger is a set of Parquet tables; changes are DataFrames that are merged into
a table's next version.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import exact_sum, num_or, text_or

# ---- writing (K1-K4, K6) ----------------------------------------------------


def append(rows: DataFrame, path: str, import_batch: str) -> None:
    """K1: append one import batch. Rows are not de-duplicated.

    Range partitioning keeps a portfolio's rows together and still splits a large
    portfolio over many tasks and files.
    """
    (
        rows.withColumn("import_batch", F.lit(import_batch)).withColumn("created_at", F.current_timestamp())
        .repartitionByRange("portfolio_id", "ts").sortWithinPartitions("portfolio_id", "ts")
        .write.mode("append").parquet(path)
    )


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """K2, K3: one row per key, the change with the highest `seq` wins over earlier ones and over the base."""
    values = [c for c in base.columns if c not in keys]
    row = F.struct(*values).alias("row")
    old = base.select(*keys, row, F.lit(0).alias("new"), F.lit(None).cast(changes.schema[seq].dataType).alias("seq"))
    new = changes.select(*keys, row, F.lit(1).alias("new"), F.col(seq).alias("seq"))
    latest = old.unionByName(new).groupBy(*keys).agg(F.max_by("row", F.struct("new", "seq")).alias("row"))
    return latest.select(*[F.col(c) if c in keys else F.col(f"row.{c}").alias(c) for c in base.columns])


def apply_updates(base: DataFrame, changes: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """K4: fields present in the change replace those of the row with the same key; of several changes the last by `seq` counts, field by field."""
    fields = [c for c in changes.columns if c not in keys and c != seq]
    at = F.struct(F.col(seq)) if seq else F.struct(*fields)
    changes = changes.groupBy(*keys).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields])
    c = changes.select(*keys, *[F.col(f).alias(f"_new_{f}") for f in fields])
    return base.join(c, keys, "left").select(
        *[F.coalesce(F.col(f"_new_{n}"), F.col(n)).alias(n) if n in fields else F.col(n) for n in base.columns]
    )


def apply_deletes(base: DataFrame, deleted: DataFrame, keys: list[str]) -> DataFrame:
    """K6: rows whose key is not in `deleted`; with the portfolio as key, clears whole portfolios."""
    return base.join(deleted.select(*keys), keys, "left_anti")


# ---- manual entries (K5, K7-K9) ----------------------------------------------


def trade_totals(df: DataFrame) -> DataFrame:
    """K5: value = quantity * price; total = value + commission for buys, - commission for sells."""
    value = F.col("quantity").cast("double") * F.col("price")
    fee = num_or(F.col("commission"), 0.0)
    return df.withColumns({
        "value": value,
        "commission": fee,
        "total": F.when(F.col("side") == "K", value + fee).otherwise(value - fee),
    })


def _blank(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name).cast("string") == "")


def _no_number(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name) == 0)


def validate_entries(entries: DataFrame) -> DataFrame:
    """K7: `reason` why a manual entry is refused, NULL if it is accepted.

    kind: dividend, deposit (withdrawals too) or transaction; for updates `target_type`
    is the type of the operation the entry replaces (NULL = no such operation).
    """
    k = F.col("kind")
    update = F.col("is_update")
    wrong = (
        F.when(k == "dividend", ~F.coalesce(F.col("target_type") == "dividend", F.lit(False)))
        .when(k == "deposit", ~F.coalesce(F.col("target_type").isin("deposit", "withdrawal"), F.lit(False)))
        .otherwise(F.col("target_type").isNull())
    )
    missing = (
        F.when(k == "dividend", _blank("date") | _blank("ticker") | _no_number("amount") | _blank("currency"))
        .when(k == "deposit", _blank("date") | _no_number("amount") | (F.col("amount") <= 0))
        .otherwise(_blank("date") | _blank("ticker") | _blank("side") | _no_number("quantity") | _no_number("price"))
    )
    reason = (
        F.when(update & wrong, "not_found")
        .when(update, F.lit(None).cast("string"))
        .when(missing, "missing_field")
        .when((k == "transaction") & ~F.col("side").isin("K", "S"), "invalid_side")
    )
    return entries.withColumn("reason", reason)


def manual_operations(entries: DataFrame) -> DataFrame:
    """K8: cash rows of accepted dividend, deposit and withdrawal entries."""
    k = F.col("kind")
    symbol = F.upper("ticker")
    return entries.select(
        "portfolio_id", F.col("date").alias("ts"), k.alias("operation_type"),
        F.when(k == "dividend", F.concat(F.lit("Wypłata dywidendy "), symbol))
        .when(k == "withdrawal", "Wypłata").otherwise("Wpłata").alias("description"),
        F.when(k == "withdrawal", -F.col("amount")).otherwise(F.col("amount")).alias("amount"),
        F.when(k == "dividend", F.col("currency")).otherwise("PLN").alias("currency"),
        F.when(k == "dividend", symbol).alias("ticker"),
        F.lit("manual").alias("source"),
    )


def auto_instruments(symbols: DataFrame, instruments: DataFrame, quotes: DataFrame) -> DataFrame:
    """K9: placeholder instruments for symbols that are quoted but not mapped; per portfolio, if symbols and instruments have one."""
    own = [c for c in ("portfolio_id",) if c in symbols.columns and c in instruments.columns]
    symbol = F.upper("symbol")
    warsaw = F.endswith(symbol, F.lit(".WA"))
    unknown = symbols.select(*own, "symbol").distinct().join(
        instruments.select(*own, F.col("ticker").alias("symbol")), [*own, "symbol"], "left_anti")
    found = unknown.join(quotes.select(F.col("ticker").alias("symbol"), "currency"), "symbol")
    return found.select(
        *own, F.concat(F.lit("AUTO_"), symbol).alias("isin"), symbol.alias("ticker"), symbol.alias("name"),
        F.when(warsaw, "GPW").otherwise("OTHER").alias("exchange"),
        F.when(warsaw, "PLN").otherwise(text_or(F.col("currency"), "USD")).alias("currency"),
        F.when(warsaw, "stooq").otherwise("yahoo").alias("price_source"),
    ).dropDuplicates([*own, "isin"])


# ---- portfolios (K10) ---------------------------------------------------------

_SETTINGS = "struct<is_ike:boolean,is_ikze:boolean,ikze_is_dg:boolean>"


def portfolios(base: DataFrame, created: DataFrame, updated: DataFrame, deleted: DataFrame) -> DataFrame:
    """Registry after creations, partial updates (name, settings) and deletions (never 'default')."""
    off = F.struct(*[F.lit(False).alias(n) for n in ("is_ike", "is_ikze", "ikze_is_dg")]).cast(_SETTINGS)
    name = F.trim("name")
    fresh = created.filter(F.coalesce(name, F.lit("")) != "").select(
        "portfolio_id", name.alias("name"), "created_at", off.alias("settings"))
    known = base.select("portfolio_id", "name", "created_at", F.coalesce("settings", off).alias("settings"))
    changes = updated.select("portfolio_id", F.nullif("name", F.lit("")).alias("name"), "settings")
    merged = apply_updates(known.unionByName(fresh), changes, ["portfolio_id"])
    return apply_deletes(merged, deleted.filter(F.col("portfolio_id") != "default"), ["portfolio_id"])


# ---- scans (F1-F6, F11) --------------------------------------------------------


def all_transactions(tx: DataFrame) -> DataFrame:
    """newest first."""
    return tx.orderBy(F.desc("ts"))


def transactions_of(tx: DataFrame, isin: str) -> DataFrame:
    """one ISIN, oldest first."""
    return tx.filter(F.col("isin") == isin).orderBy("ts")


def operations_of(ops: DataFrame, types: list[str] | None = None) -> DataFrame:
    """all operations or those of some types, newest first."""
    return (ops if types is None else ops.filter(F.col("operation_type").isin(*types))).orderBy(F.desc("ts"))


def by_id(rows: DataFrame, portfolio_id: str, row_id: int) -> DataFrame:
    """one row by its id."""
    return rows.filter((F.col("portfolio_id") == portfolio_id) & (F.col("id") == row_id))


def ledger_status(tx: DataFrame, ops: DataFrame) -> DataFrame:
    """number of rows per portfolio and time of the last import."""
    imported = F.max(F.when(F.col("import_batch").isNotNull(), F.col("created_at")))
    t = tx.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("transactions"), imported.alias("last_import"))
    o = ops.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("operations"))
    zero = F.lit(0).cast("long")
    return t.join(o, "portfolio_id", "full").select(
        "portfolio_id", F.coalesce("transactions", zero).alias("transactions"),
        F.coalesce("operations", zero).alias("operations"), "last_import",
    )


def price_range(prices: DataFrame, ticker: str, start: date | None = None) -> DataFrame:
    """closes of one ticker from a day on."""
    rows = prices.filter(F.col("ticker") == ticker)
    return (rows if start is None else rows.filter(F.col("date") >= F.lit(start))).orderBy("date")


def price_coverage(prices: DataFrame, start: date, today: date) -> DataFrame:
    """is a ticker's stored series long and recent (same month) enough, and from which day to fetch."""
    g = prices.groupBy("ticker").agg(
        F.max("date").alias("last_date"), F.count_if(F.col("date") >= F.lit(start)).alias("points"))
    sufficient = F.col("points") > 10
    return g.select(
        "*", sufficient.alias("sufficient"),
        (sufficient & (F.col("last_date") >= F.trunc(F.lit(today), "month"))).alias("fresh"),
        F.greatest("last_date", F.lit(start)).alias("fetch_from"),
    )


def deposit_list(ops: DataFrame) -> DataFrame:
    """deposits and withdrawals, newest first."""
    return operations_of(ops, ["deposit", "withdrawal"]).select(
        "portfolio_id", "id", "ts", "amount", "currency", "description", "source", F.col("operation_type").alias("type"))


def deposit_totals(ops: DataFrame) -> DataFrame:
    """signed total per portfolio, currencies added as they are."""
    return deposit_list(ops).groupBy("portfolio_id").agg(
        exact_sum(F.col("amount")).alias("total"), F.count(F.lit(1)).alias("entries"))
