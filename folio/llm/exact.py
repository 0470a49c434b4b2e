"""Exact deduplication as a stateful stream.

Documents pass a streaming aggregation keyed by the digest of their normalised text. Its state lies in RocksDB, on disk and in the
checkpoint of the shared folder, never expires, and keeps for each digest the stable identifier of the document that stays, how
many there are and where its content lies. Rows are combined before the shuffle, so a text that a third of all rows share
moves once a task. Wherever a digest is hit more than once, the full bytes of every document are compared with those of the one
that stays; should they differ, that digest is grouped anew by its texts.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import new_path, pinned
from . import blocks

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # no open store, with the files it holds, between batches
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
FILES = 1_000       # staged files in a micro-batch, at most


def normalised(text: Column) -> Column:
    """Without spaces and control white space of ASCII."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def groups(stream: DataFrame) -> DataFrame:
    """Streaming or not: per `key`, the row that stays (longest, then smallest doc_id) and the number of rows.

    Input: key, doc_id, n_chars, locator. There is no watermark, so state never expires.
    """
    best = F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("inverse"), "locator"))
    return stream.groupBy("key").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))


def run_stream(keys: DataFrame, name: str = "exact") -> DataFrame:
    """Writes `keys` to the shared folder, streams the files through groups() and gives the last state of every key."""
    spark = keys.sparkSession
    staged, out, checkpoint = (new_path(spark, f"{name}-{x}") for x in ("keys", "states", "checkpoint"))
    keys.write.parquet(staged)
    with _settings(spark, STATE):
        stream = groups(spark.readStream.schema(keys.schema).option("maxFilesPerTrigger", FILES).parquet(staged))
        # a batch that is run again writes the same folder again
        write = lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/{batch}")
        query = (stream.writeStream.outputMode("update").foreachBatch(write)
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
    schema = stream.withColumn("batch", F.lit(0).cast("long")).schema
    last = query.lastProgress
    if last is None:
        found = spark.createDataFrame([], schema)
    else:
        found = spark.read.schema(schema).parquet(*[f"{out}/{b}" for b in range(last["batchId"] + 1)])
    if last is not None and last["batchId"]:
        found = found.groupBy("key").agg(F.max_by(F.struct("best", "group_size"), "batch").alias("s")).select("key", "s.*")
    return found.select("key", F.bitwise_not(F.col("best.inverse")).alias("keep_id"), F.col("best.n_chars").alias("keep_chars"), F.col("best.locator").alias("locator"), "group_size")


def _keyed(texts: DataFrame, digest) -> DataFrame:
    bare = normalised(F.col("text"))
    sha = F.sha2(bare.cast("binary"), 256)
    return texts.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), sha.alias("text_sha256"),
                        (sha if digest is None else digest(bare)).alias("key"), bare.alias("bare"), "text")


def _differing(keyed: DataFrame, state: DataFrame) -> DataFrame:
    """Keys under which some document's bytes differ from those of the document that stays."""
    hits = state.filter("group_size > 1").select("key", "keep_id")
    stays = keyed.select("doc_id", F.col("key").alias("own"), F.col("bare").alias("kept")).join(
        hits, F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("own") == F.col("key"))).select("key", "kept").dropDuplicates(["key"])
    stays = pinned(stays, "exact-stays")
    # written before it is grouped by the same key, so that Spark may split the rows of a hot key in the join
    return pinned(keyed.select("key", "bare").join(stays, "key").filter(F.col("bare") != F.col("kept")).select("key"), "exact-unlike").distinct()


def dedup(docs: DataFrame, digest=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, locator.

    Null texts count as empty and are each other's copies. Of rows alike in text and doc_id one is kept. A null doc_id comes after
    all others. `digest` maps the normalised text to the key of the state (by default its SHA-256).
    """
    texts = blocks.keyed(docs, id_col, text_col)
    keyed = _keyed(texts, digest)
    rows = pinned(keyed.select("doc_id", "n_chars", "text_sha256", "key", F.input_file_name().alias("locator")), "exact-rows")
    state = pinned(run_stream(rows.select("key", "doc_id", "n_chars", "locator")), "exact-state")
    differing = pinned(_differing(keyed, state), "exact-differing")
    if not differing.isEmpty():
        again = keyed.join(differing, "key").withColumn("key", F.concat_ws(":", "key", F.sha2(F.col("bare").cast("binary"), 512), "bare"))
        redone = groups(again.select("key", "doc_id", "n_chars", F.lit("").alias("locator"))).select(
            "key", F.bitwise_not(F.col("best.inverse")).alias("keep_id"), F.col("best.n_chars").alias("keep_chars"), F.col("best.locator").alias("locator"), "group_size")
        state = pinned(state.join(differing, "key", "left_anti").unionByName(redone), "exact-state")
        rows = pinned(rows.join(differing, "key", "left_anti").unionByName(
            again.select("doc_id", "n_chars", "text_sha256", "key", F.lit("").alias("locator"))), "exact-rows")
    alike = Window.partitionBy("key", "doc_id", "n_chars").orderBy(F.lit(1))
    return (
        rows.drop("locator").withColumn("_copy", F.row_number().over(alike)).join(state, "key")
        .select("doc_id", "keep_id", "group_size",
                (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars")) & (F.col("_copy") == 1)).alias("kept"),
                "text_sha256", "locator")
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns, whatever their names. Nulls and repeated rows as in `dedup`."""
    kept = dedup(docs, id_col=id_col, text_col=text_col).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(
        blocks.whole_row(docs), F.col(id_col).cast("long").alias("id"), F.sha2(normalised(text).cast("binary"), 256).alias("sha"), F.char_length(text).alias("n"))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha"))
    first = Window.partitionBy("id", "sha").orderBy(F.desc("n"))  # one row, but for repeated ids
    return own.join(kept, same, "left_semi").withColumn("first", F.row_number().over(first)).filter("first = 1").select("row.*")
