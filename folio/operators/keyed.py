"""Keyed tables in hash buckets (K2, K3, K4, K6, F4, F5): a change set reads and writes the buckets of its keys only.

A table is a folder with `rows` (Parquet, partitioned by a hash of the key columns, sorted by them within a bucket) and
`about` (key columns, number of buckets, schema). A change writes the new content of its buckets to `next` first and then
puts it in place by dynamic partition overwrite. A run that is lost before `next` is complete has changed nothing; one that
is lost later is finished by whoever opens the table next. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from . import ledger

BUCKET = "_bucket"


@dataclass(frozen=True)
class KeyedTable:
    spark: SparkSession
    path: str
    keys: list[str]
    buckets: int
    schema: StructType

    # ---- reading ----------------------------------------------------------
    def _from(self, name: str) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, StructField(BUCKET, IntegerType())])).parquet(f"{self.path}/{name}")

    def _stored(self) -> DataFrame:
        return self._from("rows")

    def read(self) -> DataFrame:
        """All rows."""
        return self._stored().drop(BUCKET)

    def lookup(self, **key) -> DataFrame:
        """The rows of one whole key: one bucket is listed and read, and of it the row groups that may hold the key."""
        if set(key) != set(self.keys):
            raise ValueError(f"a lookup takes all of {self.keys}")
        where = self._hash({k: F.lit(v).cast(self.schema[k].dataType) for k, v in key.items()})
        number = self.spark.range(1).select(where).first()[0]
        rows = self._stored().filter(F.col(BUCKET) == number)
        for k, v in key.items():
            rows = rows.filter(F.col(k).isNull() if v is None else F.col(k) == F.lit(v).cast(self.schema[k].dataType))
        return rows.drop(BUCKET)

    # ---- changing -----------------------------------------------------------
    def upsert(self, changes: DataFrame, seq: str = "seq") -> list[int]:
        """K2, K3: as `ledger.upsert`; gives the buckets written."""
        changes = self._typed(changes)
        return self._change(self._buckets_of(changes), lambda rows: ledger.upsert(rows, changes, self.keys, seq))

    def update(self, changes: DataFrame, seq: str | None = None) -> list[int]:
        """K4: as `ledger.apply_updates`."""
        changes = self._typed(changes)
        return self._change(self._buckets_of(changes), lambda rows: ledger.apply_updates(rows, changes, self.keys, seq))

    def delete(self, deleted: DataFrame, keys: list[str] | None = None) -> list[int]:
        """K6: as `ledger.apply_deletes`. With fewer key columns (whole portfolios), a scan of these columns finds the buckets."""
        keys = keys or self.keys
        deleted = self._typed(deleted.select(*keys)).distinct()
        if set(keys) == set(self.keys):
            touched = self._buckets_of(deleted)
        else:
            touched = self._numbers(self._stored().select(BUCKET, *keys).join(deleted, keys, "left_semi"))
        return self._change(touched, lambda rows: ledger.apply_deletes(rows, deleted, keys))

    def _hash(self, columns: dict | None = None):
        columns = columns or {k: F.col(k) for k in self.keys}
        # nulls are skipped by the hash, so a null says where it stands
        parts = [p for k in self.keys for p in (columns[k].isNull(), columns[k])]
        return F.pmod(F.xxhash64(*parts), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def _typed(self, rows: DataFrame) -> DataFrame:
        """Key columns in the table's types: equal keys of other types would hash to other buckets."""
        return rows.withColumns({k: F.col(k).cast(self.schema[k].dataType) for k in self.keys if k in rows.columns})

    def _buckets_of(self, rows: DataFrame) -> list[int]:
        return self._numbers(rows.select(self._hash()))

    def _numbers(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(BUCKET).distinct().collect())  # at most `buckets`

    def _change(self, touched: list[int], change: Callable[[DataFrame], DataFrame]) -> list[int]:
        if touched:
            part = self._stored().filter(F.col(BUCKET).isin(touched)).drop(BUCKET)
            rows = change(part).select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
            rows.select("*", self._hash()).write.mode("overwrite").parquet(f"{self.path}/next/rows")
            # written last: from here on the change counts
            self.spark.createDataFrame([(b,) for b in touched], f"{BUCKET} int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/next/touched")
            self.recover()
        return touched

    def recover(self) -> None:
        """Put a change in place that is written out whole; safe to repeat."""
        if not self._exists("next/touched/_SUCCESS"):
            return
        touched = self._numbers(self.spark.read.schema(f"{BUCKET} int").parquet(f"{self.path}/next/touched"))
        rows = self._from("next/rows")
        self._put(rows, len(touched))
        for empty in set(touched) - set(self._numbers(rows)):
            self._remove(f"rows/{BUCKET}={empty}")
        self._remove("next/touched")
        self._remove("next")

    def _put(self, rows: DataFrame, tasks: int) -> None:
        (
            rows.repartition(tasks, BUCKET).sortWithinPartitions(BUCKET, *self.keys)
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{self.path}/rows")
        )

    # ---- files ----------------------------------------------------------------
    def _file(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _exists(self, name: str) -> bool:
        files, path = self._file(name)
        return files.exists(path)

    def _remove(self, name: str) -> None:
        files, path = self._file(name)
        files.delete(path, True)


def create(rows: DataFrame, path: str, keys: list[str], buckets: int = 64) -> KeyedTable:
    """A new table of `rows`, one per key. Keys are told apart with nulls; choose `buckets` for some 100 MB each."""
    table = KeyedTable(rows.sparkSession, path, list(keys), buckets, rows.schema)
    table._put(rows.select("*", table._hash()), buckets)
    rows.sparkSession.createDataFrame([(list(keys), buckets, rows.schema.json())], "keys array<string>, buckets int, schema string").coalesce(
        1).write.parquet(f"{path}/about")
    return table


def opened(spark: SparkSession, path: str) -> KeyedTable:
    """The table at `path`; a change that was cut short is finished."""
    import json

    about = spark.read.parquet(f"{path}/about").first()
    table = KeyedTable(spark, path, list(about["keys"]), about["buckets"], StructType.fromJson(json.loads(about["schema"])))
    table.recover()
    return table


def clustered(rows: DataFrame, path: str, by: list[str], lookups: list[str] = (), files: int | None = None, rows_per_group: int = 1 << 20) -> None:
    """rows in ranges of `by`, so that column statistics skip files and row groups, and Bloom filters on `lookups`.

    A range that is hot is cut by the later columns of `by`. `rows_per_group` bounds a row group by rows.
    """
    ranged = rows.repartitionByRange(*([files] if files else []), *by).sortWithinPartitions(*by)
    out = ranged.write.option("parquet.block.row.count.limit", rows_per_group)
    for c in lookups:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
    out.parquet(path)
