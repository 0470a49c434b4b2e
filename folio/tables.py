"""Where derived tables are written: the shared folder of spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_tables: dict[tuple[str, str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; without one, a temporary folder where all tasks run on this machine, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="folio-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/folio/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def small_methods(spark: SparkSession) -> None:
    """Generated methods that HotSpot would never compile, those of over 8,000 bytes, are left out: such stages run in smaller methods."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


@contextmanager
def _tidy(spark: SparkSession):
    """While a table is written, shuffle files go as soon as they have been read; the table stands in for them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write(df: DataFrame, path: str, by: tuple[str, ...] = (), rows: int = 0) -> None:
    with _tidy(df.sparkSession):
        (df.write.partitionBy(*by) if by else df.write).option("maxRecordsPerFile", rows).parquet(path)


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """The table written by the first call for (application, input, name), as Parquet."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _tables:
        path = new_path(spark, name)
        write(build(), path)
        _tables[key] = path
    return spark.read.parquet(_tables[key])


def pinned(df: DataFrame, name: str, by: tuple[str, ...] = (), rows: int = 0) -> DataFrame:
    """Write `df` once and read it back: cuts lineage and survives lost executors.

    `by`: columns whose values have folders of their own; `rows`: the most that a file holds, 0 for no limit.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    write(df, path, by, rows)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of `pinned` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        own = f"{shared_dir(spark).rstrip('/')}/folio/{spark.sparkContext.applicationId}/".split(":", 1)[-1].lstrip("/")
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if own in folder:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
