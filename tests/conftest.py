import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("folio-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_chunks(spark):
    """Every key counts as too large for one window partition."""
    spark.conf.set("spark.folio.hotRows", "2")
    spark.conf.set("spark.folio.blockRows", "3")
    yield
    spark.conf.unset("spark.folio.hotRows")
    spark.conf.unset("spark.folio.blockRows")


TX = ("portfolio_id string, id long, ts timestamp, paper_name string, isin string, quantity decimal(28,8), side string, "
      "price double, value double, commission double, total double, currency string, source string")
OPS = ("portfolio_id string, id long, ts timestamp, operation_type string, description string, amount double, currency string, "
       "ticker string, fx_rate double, fx_pair string, source string")
INST = "isin string, ticker string, name string, exchange string, currency string, price_source string, sector string"
