"""Fill-in-middle: texts cut into lines and put in prefix-suffix-middle or suffix-prefix-middle order.

Every batch runs through Arrow's own kernels: lines as list arrays, flattened beside the index of their text, ordinals
against the two cuts give each line its role, and the lines of a role are filtered, put back into lists and joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.llm.arrow import slices
from calibrant.llm.common import filled, need

MARKS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def lines(texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Units ``[^\\n]*\\n|[^\\n]+`` of texts without nulls: the flat units, the index of each one's text, units per text."""
    pieces = pc.split_pattern(texts, "\n")
    flat, parent = pc.list_flatten(pieces), pc.list_parent_indices(pieces)
    ends = np.zeros(len(flat), bool)
    ends[np.cumsum(np.asarray(pc.list_value_length(pieces)), dtype=np.int64) - 1] = True  # no line end follows a text's last piece
    last = pa.array(ends)
    whole = pc.binary_join_element_wise(flat, pc.if_else(last, pa.scalar("", flat.type), pa.scalar("\n", flat.type)), pa.scalar("", flat.type))
    real = pc.invert(pc.and_(last, pc.equal(pc.binary_length(flat), 0)))  # an empty last piece is no unit
    whole, parent = whole.filter(real), parent.filter(real)
    return whole, parent, np.bincount(np.asarray(parent), minlength=len(texts))


def joined(units: pa.Array, parent: pa.Array, role: pa.Array, of: int, n: int) -> pa.Array:
    """The units of role ``of`` of each of ``n`` texts, joined in order."""
    mine = pc.equal(role, of)
    counts = np.bincount(np.asarray(parent.filter(mine)), minlength=n)
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, units.filter(mine)), "")


def transformed(texts: pa.Array, h: list[np.ndarray], rate: int, spm: int, marks: tuple[str, str, str]) -> tuple[pa.Array, ...]:
    """n, form, prefix_chars, middle_chars, output of texts without nulls and their four hashes."""
    units, parent, n = lines(texts)
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    of = np.asarray(parent)
    ordinal = np.arange(len(of)) - (np.cumsum(n) - n)[of]
    role = pa.array((ordinal >= low[of]).astype(np.int8) + (ordinal >= high[of]))  # 0 prefix, 1 middle, 2 suffix
    prefix, middle, suffix = (joined(units, parent, role, r, len(texts)) for r in range(3))
    plain = pc.or_(pa.array((n == 0) | (h[2] % 100 >= rate)), pc.match_substring(texts, marks[0]))
    plain = pc.or_(plain, pc.or_(pc.match_substring(texts, marks[1]), pc.match_substring(texts, marks[2])))
    form = pc.if_else(plain, "plain", pc.if_else(pa.array(h[3] % 100 < spm), "spm", "psm"))
    p, s, m = marks
    psm, spm_out = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, ""), pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, "")
    output = pc.if_else(plain, texts, pc.if_else(pc.equal(form, "psm"), psm, spm_out))
    none = pa.scalar(None, pa.int64())
    chars = [pc.if_else(plain, none, pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
    return pa.array(n, pa.int64()), form, *chars, output


def fill_in_middle(docs: DataFrame, seed: int | str = 7, rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars and output of each whole text of ``docs``.

    The cuts and the form hang on sha256 of ``seed``, a colon and the doc_id alone, so a rerun gives the same rows: prefix
    and middle end at the smaller and the larger of two hashed places among the lines, ``rate`` of a hundred texts are
    transformed and ``spm`` of a hundred of those put the suffix first. A text that is null (counts as empty), empty or
    holds a mark stays plain, with null lengths. A null doc_id is hashed as nothing after the colon; rows that repeat give
    rows that repeat; no rows give none; other columns are not read. No shuffle; one text is held whole.
    """
    if len(set(marks)) < 3 or not all(marks) or any(a != b and a in b or any(a.endswith(b[:k]) for k in range(1, len(b))) for a in marks for b in marks):
        raise ValueError("the marks are three strings, none within another and none starting as one ends")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), filled(F.col("doc_id").cast("string"))), 256)
    parts = [F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]
    rows = need(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), filled("text").alias("text"), digest.alias("digest")).select("doc_id", "text", *parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h = [np.asarray(b.column(f"h{i}")) for i in range(4)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *transformed(b.column("text"), h, rate, spm, marks)], [c.split()[0] for c in OUT.split(", ")])

    return rows.mapInArrow(run, OUT)


def restored(output: Column | str, form: Column | str, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of: what stands between its marks, prefix, middle and suffix in order."""
    out, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    p, s, m = map(F.lit, marks)
    after = lambda x, mark: F.split_part(x, mark, F.lit(2))
    before = lambda x, mark: F.split_part(x, mark, F.lit(1))
    middle = after(out, m)
    psm = F.concat(before(after(out, p), s), middle, before(after(out, s), m))
    spm = F.concat(before(after(out, p), m), middle, before(after(out, s), p))
    return F.when(form == "plain", out).when(form == "psm", psm).otherwise(spm)


def op12_fill_in_middle(docs: DataFrame) -> DataFrame:
    made = fill_in_middle(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256"))
