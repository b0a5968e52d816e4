"""Quality rules per document and per host.

Counts of each text are made in one pass without a shuffle. The failures of the rules are summed by host, the
hosts' rates are shrunk with a beta prior fitted to all hosts, and a host whose shrunk rate is too high takes
all of its documents with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.llm.arrow import mixed, rolled, slices, words
from calibrant.llm.common import cut, need

#: Fixed values of the base rules.
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
SYMBOLS = "#*$%&|<>"
WORD = re.compile(r"[^\x20\x09-\x0D]")
SPACES = " \t\n\v\f\r"


def _repeats(codes: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """Words of each text inside a window of ``width`` words that the same text holds twice or more."""
    n = len(offsets) - 1
    if len(codes) < width:
        return np.zeros(n, np.int64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    h = rolled(mixed(codes + 1), width)
    whole = owner[: len(h)] == owner[width - 1 :]  # the window lies in one text
    at = np.flatnonzero(whole)
    h = mixed(h[at] ^ mixed(owner[at] + 1))
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(n, np.int64)
    found = at[np.isin(h, twice)]
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, found, 1)
    np.add.at(change, found + width, -1)
    covered = np.cumsum(change[:-1]) > 0
    return np.bincount(owner[covered], minlength=n)


def _text_counts(text: str) -> tuple[int, int, int]:
    """word_chars, n_symbols, n_dup_lines."""
    lines = text.split("\n")
    if len(lines) > 1:
        lines = [x for x in lines if x.strip(SPACES)]
        dup = len(lines) - len(set(lines))
    else:
        dup = 0
    return len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def counted(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` and the counts of each whole text (null: all zero), one row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            texts = b.column(text)
            codes, _, offsets = words(texts)
            own = np.array([_text_counts(t or "") for t in texts.to_pylist()], np.int64).reshape(-1, 3)
            columns = [np.diff(offsets), *own.T, _repeats(codes, offsets, WINDOW)]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], *[pa.array(c, pa.int64()) for c in columns]], [*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

    kinds = dict(docs.dtypes)
    return need(docs, *dict.fromkeys([*keep, text])).mapInArrow(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keep], COUNTS]))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def host_verdicts(rows: DataFrame, failed: str = "base_failed", host: str = "host", max_rate: float = 0.5) -> DataFrame:
    """host, n_docs, n_failed, alpha, beta, rate (shrunk), host_failed.

    The prior is fitted by moments to the hosts' rates: with mean m and variance v between hosts,
    ``alpha + beta = m (1 - m) / v - 1``, kept within 1 and the documents per host. A host fails when its
    shrunk rate is over ``max_rate``. A null host is a host of its own; no rows give no verdicts.
    """
    by = rows.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(failed).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    fit = by.agg((F.sum("n_failed") / F.sum("n_docs")).alias("m"), F.var_pop(rate).alias("v"), F.avg("n_docs").alias("size"))
    m = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("m")))
    strength = F.when(F.col("v") > 0, F.greatest(F.lit(1.0), F.least(F.col("size"), m * (1 - m) / F.col("v") - 1))).otherwise(F.col("size"))
    prior = fit.select((m * strength).alias("alpha"), ((1 - m) * strength).alias("beta"))  # one row
    shrunk = (F.col("n_failed") + F.col("alpha")) / (F.col("n_docs") + F.col("alpha") + F.col("beta"))
    return by.crossJoin(F.broadcast(prior)).withColumn("rate", shrunk).withColumn("host_failed", shrunk > max_rate)


def judge(docs: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """doc_id, host, the counts, base_failed, host_failed, kept: one row for each row of ``docs``.

    Null text counts as empty and fails; a null host is a host; a null doc_id stays null; repeated rows count
    as often as they occur; other columns are not read. The counts are written once as a table and joined
    with the verdicts, of which there are as many as hosts (a hot host's rows are split by Spark's skew
    join).
    """
    counts = cut(counted(docs, "doc_id", host).withColumnRenamed(host, "host").withColumn("base_failed", base_failed()), "quality")
    verdicts = host_verdicts(counts, max_rate=max_rate).select(F.col("host").alias("of"), "host_failed")
    return counts.join(verdicts, F.col("host").eqNullSafe(F.col("of")), "left").drop("of").withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False)))


def op5_quality(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
