"""Exact deduplication on Structured Streaming state.

Rows stream through a keyed aggregation whose state lives in RocksDB (disk-backed, checkpointed in the shared
folder, no watermark and so no expiry). A key is the digest of the normalised text; its state holds the
smallest stable identifier, the locator of that row's content (file and row in it) and the number of rows.
Text is never held in state: on a hit the representative's content is fetched by its locator and compared
whole.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.llm.common import HOT_SHARE, SPACE, cut, filled, scratch

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # small stores don't reserve space
    "spark.sql.streaming.minBatchesToRetain": "2",
}


def normalise(c: Column) -> Column:
    return F.regexp_replace(filled(c), SPACE, " ")


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def _keyed(rows: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """id, norm, digest and the locator (file, at) of each row of a file-backed table."""
    norm = normalise(F.col(f"`{text_col}`"))
    return rows.select(
        F.col(f"`{id_col}`").alias("id"), norm.alias("norm"), digest(norm).alias("digest"),
        F.coalesce("_metadata.file_path", F.lit("")).alias("file"), F.coalesce("_metadata.row_index", F.lit(-1)).alias("at"),
    )


@contextmanager
def _settings(spark: SparkSession, conf: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ingest(spark: SparkSession, path: str, state: str, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, files_per_batch: int = 1000) -> None:
    """Stream the files of ``path`` not seen before into the keyed state kept at ``state``, then stop.

    Calling it again after files were added continues from the same state. A lost executor costs the
    current batch; the checkpoint in the shared folder holds the rest.
    """
    schema = spark.read.parquet(path).schema
    # A stream source takes a folder or a pattern; a table that is one file becomes a pattern for itself.
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    one_file = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile()
    source = f"{path[:-1]}[{path[-1]}]" if one_file else path
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    keyed = _keyed(stream, id_col, text_col, digest).drop("norm")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "file", "at")).alias("first")
    groups = keyed.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n"))
    with _settings(spark, STATE_CONF):
        query = groups.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()


def read_state(spark: SparkSession, state: str) -> DataFrame:
    """digest, keep_id, keep_file, keep_at, n of every key retained at ``state``."""
    kept = spark.read.format("statestore").load(state)
    first, n = (F.col(f"value.`{f.name}`") for f in kept.schema["value"].dataType.fields)
    return kept.select(F.col("key.digest").alias("digest"), first["id"].alias("keep_id"), first["file"].alias("keep_file"), first["at"].alias("keep_at"), n.alias("n"))


def deduplicate(spark: SparkSession, path: str, state: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Per row of the Parquet table at ``path``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their normalised texts (null: empty; runs of white space: one space) are equal byte
    for byte. Of equal rows the one with the smallest id stays; a null id is larger than any other; among
    repeated rows with the same id the first by path of its file and row stays alone. An empty table gives no rows.
    Other columns are not read.
    """
    state = state or scratch(spark, "dedup-state")
    ingest(spark, path, state, id_col, text_col, digest)
    found = cut(read_state(spark, state), "dedup-keys")
    docs = _keyed(spark.read.parquet(path), id_col, text_col, digest)
    # BETWEEN keeps the digest the only join key, and the same columns are used: both joins then read one
    # exchange of the texts.
    same = lambda a, b: F.coalesce(a, F.lit(0)).between(F.coalesce(b, F.lit(0)), F.coalesce(b, F.lit(0)))
    at_first = same("at", "keep_at") & F.col("file").between(F.col("keep_file"), F.col("keep_file")) & same("id", "keep_id")
    # Keys with over a thousandth of all rows are fewer than a thousand, and their texts fewer bytes than a thousand texts
    # of mean length: their representatives are broadcast, so that their rows stay where they are read.
    many = (found.agg(F.sum("n")).first()[0] or 0) / HOT_SHARE
    hot = F.broadcast(found.where((F.col("n") > 1) & (F.col("n") > many)))
    hot_reps = F.broadcast(cut(docs.join(hot, "digest").where(at_first).select("digest", F.col("norm").alias("rep_norm")), "dedup-hot"))
    cold = docs.join(hot.select("digest"), "digest", "left_anti")
    reps = cold.join(found.where("n > 1"), "digest").where(at_first).select("digest", F.col("norm").alias("rep_norm"))
    told = lambda rows: rows.select("id", "digest", "file", "at", (F.col("rep_norm").isNull() | (F.col("norm") == F.col("rep_norm"))).alias("same"), F.sha2("norm", 256).alias("text_sha256"), "keep_id", "keep_file", "keep_at", "n")
    checked = cut(told(cold.join(reps, "digest", "left").join(found, "digest")).unionByName(told(docs.join(hot_reps, "digest").join(hot, "digest"))), "dedup-checked")
    whole = checked
    clash = checked.where("not same").select("digest").distinct()
    if not clash.isEmpty():  # different texts under one digest: their keys are split by the texts themselves
        clash = cut(clash, "dedup-clash")
        odd = docs.join(clash, "digest", "left_semi")
        exact = odd.groupBy("norm").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "file", "at")).alias("f"), F.count(F.lit(1)).alias("n"))
        fixed = odd.join(exact, "norm").select("id", "digest", "file", "at", F.lit(True).alias("same"), F.sha2("norm", 256).alias("text_sha256"), F.col("f.id").alias("keep_id"), F.col("f.file").alias("keep_file"), F.col("f.at").alias("keep_at"), "n")
        whole = checked.join(clash, "digest", "left_anti").unionByName(fixed)
    return whole.select(
        F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"),
        ((F.col("file") == F.col("keep_file")) & (F.col("at") == F.col("keep_at"))).alias("kept"), "text_sha256",
    )
