"""Line deduplication over overlapping windows of three lines."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.llm.arrow import slices
from calibrant.llm.common import LOWEST, cut, need

WIDTH = 3
SPACES = " \t\n\v\f\r"


def document_key() -> list[Column]:
    """What tells documents apart: rows alike in id and text are one document, listed again."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("k1"), F.xxhash64(F.col("text"), F.col("doc_id").isNull()).alias("k2")]


def windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """k1, k2, at, digest of each run of ``width`` consecutive lines that hold a word.

    Lines are compared exactly but for white space at their ends' right; lines without a word don't count.
    ``at`` is the number of the first line among those that count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            k1, k2, ats, digests = [], [], [], []
            for a, c, text in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), b.column("text").to_pylist()):
                lines = [x.encode() for line in (text or "").split("\n") if (x := line.rstrip(SPACES))]
                n = max(0, len(lines) - width + 1)
                k1 += [a] * n
                k2 += [c] * n
                ats += range(n)
                digests += [hashlib.blake2b(b"\n".join(lines[i : i + width]), digest_size=16).digest() for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(ats, pa.int32()), pa.array(digests, pa.binary())], ["k1", "k2", "at", "digest"])

    return docs.select(*document_key(), "text").mapInArrow(run, "k1 long, k2 long, at int, digest binary")


def repeated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """k1, k2, ats: the sorted places of the windows to remove from each document.

    Of equal windows the first by document and place stays. A hot window is counted before its rows are
    shuffled; its rows then meet one row, in a join that Spark splits when the key is skewed.
    """
    wins = cut(windows(docs, width), "line-windows")
    first = wins.groupBy("digest").agg(F.min(F.struct("k1", "k2", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = wins.join(first.select("digest", "first"), "digest").where(F.struct("k1", "k2", "at") > F.col("first"))
    return later.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("at")).alias("ats"))


def without(text: str, ats: list[int], width: int = WIDTH) -> tuple[str, int]:
    """``text`` without the lines that the windows starting at ``ats`` cover, and how many those are.

    Covered places that touch or overlap merge; a line without a word goes with the line before it.
    """
    covered = {a + i for a in ats for i in range(width)}
    left, number, lines = [], -1, text.split("\n")
    for line in lines:
        number += bool(line.strip(SPACES))
        if number not in covered:
            left.append(line)
    return "\n".join(left), len(lines) - len(left)


def dedup_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` (columns row, a struct of all of them) with n_removed and the new text.

    Null text stays null; text of fewer than ``width`` lines never changes; the first occurrence (smallest
    doc_id, a null one before all, then place) stays, but for lines that a later occurrence overlaps; rows
    alike in id and text lose the same lines, as one document. No rows give no rows.
    """

    @F.pandas_udf("text string, n_removed int")
    def cut_out(text: pd.Series, ats: pd.Series) -> pd.DataFrame:
        got = [(t, 0) if a is None or t is None else without(t, a, width) for t, a in zip(text, ats)]
        return pd.DataFrame(got, columns=["text", "n_removed"])

    gone = repeated(need(docs, "doc_id", "text"), width)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *document_key()).join(gone, ["k1", "k2"], "left")
    # Only texts that change travel to Python.
    new = rows.withColumn("new", cut_out(F.when(F.col("ats").isNotNull(), F.col("row.text")), "ats"))
    return new.select("row", F.when(F.col("ats").isNull(), F.col("row.text")).otherwise(F.col("new.text")).alias("text"), "new.n_removed")


def op8_line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_removed (lines cut out), kept_chars and the text that is left, one row per document."""
    return dedup_lines(need(docs, "doc_id", "text")).select(F.col("row.doc_id").alias("doc_id"), F.col("n_removed").cast("long").alias("n_removed"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("kept_chars"), "text")
