"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.llm import linedup, packing, quality, simhash, substring
from calibrant.llm.common import cut, join_hot, read, scratch

ORACLE_SQL = None


def _with_text(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from (row, text), n_chars brought up to date."""
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return changed.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and their host's verdict keep; others go.

    A null or empty text has no words and goes; a null source is a host like any other; null and repeated ids don't matter, rows that
    repeat stay or go together.
    """
    names = {c: "text" if c == "text" else f"_{i}" for i, c in enumerate(docs.columns)}  # clear of the counts' names
    host = F.col(names["source"])
    counts = quality.counted(docs.toDF(*names.values()), *names.values()).withColumn("base_failed", quality.base_failed())
    verdicts = quality.host_verdicts(cut(counts.select(host.alias("host"), "base_failed"), "stage-quality"))
    bad = verdicts.where("host_failed").select(F.col("host").alias("bad_host"))
    kept = counts.where(~F.col("base_failed")).join(bad, host.eqNullSafe(F.col("bad_host")), "left_anti")
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows are cut out of the texts. Null texts stay null; a text may become empty; a null id comes
    before others; rows alike in id and text are one document, listed again, and are cut alike."""
    return _with_text(linedup.dedup_lines(docs), docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group (SimHash fingerprints within two bits, as in op9, or a similarity of 0.8 on five-word shingles) stays: the one with the smallest doc_id (null first; of equal ids the one
    whose text has the smallest hash). Of rows alike in id and text one stays, the first by its columns as JSON. Null and empty texts are one group."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *linedup.document_key())
    placed = cut(simhash.near_groups(docs.select("text", *linedup.document_key())), "stage-simhash")
    first = placed.groupBy("root").agg(F.min(F.struct("k1", "k2")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", "f")
    counts = placed.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    others = join_hot(placed, first, "root", counts).where("f is not null")
    lost = others.where(F.struct("k1", "k2") != F.col("f")).select("k1", "k2").distinct()
    again = others.where(F.struct("k1", "k2") == F.col("f")).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    fate = cut(lost.withColumn("fate", F.lit("lost")).unionByName(again.withColumn("fate", F.lit("again"))), "stage-fate")
    told = keyed.join(fate, ["k1", "k2"], "left")
    stays = told.where("fate is null").select("row.*")
    again = told.where("fate = 'again'").groupBy("k1", "k2").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return stays.unionByName(again.select("row.*"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document (by id, null first, then text) holds are cut out of the texts. Null texts stay null;
    a text may become empty; rows alike in id and text are one document, listed again, and are cut alike."""
    return _with_text(substring.dedup_passages(docs), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 4096 tokens: doc_id and the columns of op4. A null or empty text is its end id alone; null and repeated ids are packed like
    others, and no row gives none."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("simhash near-dedup", simhash_dedup), ("substring dedup", substring_dedup), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
