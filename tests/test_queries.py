"""Registered queries against their check SQL in DuckDB on the smallest test tables.

A few by default; all of them with FOLIO_ALL_QUERIES=1.
"""

import os

import pytest

import __spark_entry__ as e
from folio.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FEW = ["closed_trades", "open_positions", "cash_balances", "contribution_limits", "name_to_isin", "resolve_instruments", "rejects",
       "xtb_fees", "portfolio_history", "returns_twr", "xirr", "search_merge", "open_positions_by_source", "history_prices", "import_trades",
       "import_rejects", "import_named_broker", "portfolio_totals", "auto_instrument", "apply_updates",
       "price_changes", "lots_continued", "closed_trades_continued"]
NAMES = list(QUERIES) if os.environ.get("FOLIO_ALL_QUERIES") else FEW

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not there")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(df):
    cols = sorted(df.columns)
    rows = df[cols].astype(object).where(df[cols].notna(), None).values.tolist()
    return cols, sorted([tuple(None if v is None else float(v) + 0.0 if isinstance(v, float) else v for v in r) for r in rows], key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_check_sql(spark, duck, name):
    assert canonical(e.queries()[name](spark, SF).toPandas()) == canonical(duck.execute(e.oracle_sql()[name]).df())


def test_every_query_has_check_sql():
    assert set(QUERIES) <= set(e.queries()) and set(QUERIES) <= set(e.oracle_sql())


def test_entry(spark):
    assert e.entry(spark).count() > 0


def test_scan_reads_only_what_it_needs(spark):
    from folio.plans.ledger import Ledger
    from folio.operators import ledger

    t = Ledger(spark, SF)
    plan = ledger.price_range(t.prices, "TK5")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ticker), EqualTo(ticker,TK5)]" in plan
    from folio.operators import cash

    plan = cash.cash_balances(t.transactions, t.cash_operations)._jdf.queryExecution().executedPlan().toString()
    assert "paper_name" not in plan and "partial_sum" in plan
