"""Substring dedup: windows as bytes, dealt by ranges known beforehand; rows inside found passages lead others and go no further."""

import random

import numpy as np
import pyarrow as pa
from calibrant.llm import substring


def test_packed_windows_sort_as_their_places():
    rng = np.random.default_rng(2)
    pick = lambda n, *odd: np.concatenate([rng.integers(-(1 << 62), 1 << 62, n), odd]).astype(np.int64)
    ends = (-(1 << 63), (1 << 63) - 1, 0, -1)
    key, k1, k2 = rng.permutation(pick(40, *ends))[rng.integers(0, 44, 400)], pick(396, *ends) >> 61, pick(396, *ends)
    lo, at, hi = rng.integers(0, 9, 400), rng.integers(-1, 3, 400), rng.integers(0, 1 << 31, 400)
    inside = rng.random(400) < 0.5
    rows = substring.packed(key, k1, k2, lo, at, hi, inside)
    got = substring.unpacked(pa.concat_arrays([rows, rows]).slice(400))
    for name, x in (("key", key), ("k1", k1), ("k2", k2), ("lo", lo), ("at", at), ("hi", hi), ("inside", inside)):
        assert got[name].tolist() == x.tolist()
    places = list(zip(key.tolist(), k1.tolist(), k2.tolist(), at.tolist(), lo.tolist(), hi.tolist(), inside.tolist()))
    assert [places[i] for i in sorted(range(400), key=lambda i: rows[i].as_py())] == sorted(places)
    assert len(substring.unpacked(rows.slice(0, 0))["key"]) == 0


def test_range_numbers_count_the_ends_below():
    rng = np.random.default_rng(3)
    for n in (0, 1, 30):
        ends = np.unique(rng.integers(0, 4, (n, 4)), axis=0).astype(np.int64)
        rows = [rng.integers(-1, 5, 300).astype(np.int64) for _ in range(4)]
        want = [sum(tuple(e) < row for e in ends.tolist()) for row in zip(*(x.tolist() for x in rows))]
        assert substring.range_numbers(rows, ends).tolist() == want


def test_windows_within_found_passages():
    rng = np.random.default_rng(4)
    texts = [[(int(a), int(a + n), bool(n % 2)) for a, n in zip(rng.integers(0, 300, k), rng.integers(1, 90, k))] for k in (0, 3, 1, 0, 6)]
    spans = pa.array([[dict(zip(("start", "end", "same"), s)) for s in t] or None for t in texts], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("same", pa.bool_())])))
    doc, at = rng.integers(0, 5, 500), rng.integers(0, 320, 500)
    one = rng.random(500) < 0.5
    lo, hi = np.where(one, at, np.maximum(at - 20, 0)), np.where(one, at + 45, at + 60)
    end = np.where((at == lo) & (hi - lo == 45), hi + 5, at + 1)
    want = [any(a <= x and z <= b for a, b, _ in texts[d]) for d, x, z in zip(doc.tolist(), at.tolist(), end.tolist())]
    assert substring.within_spans(spans, doc, lo, at, hi, 46).tolist() == want and any(want)
    assert not substring.within_spans(spans.slice(0, 1), np.zeros(3, np.int64), at[:3], at[:3], hi[:3], 46).any()


def texts_of(seed):
    """A passage that all documents hold, with a changed word in most, between words of their own."""
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(120)]
    for d in range(40):
        own = common.copy()
        if d % 4:
            own[rng.randrange(120)] = f"x{d}"
        yield d, " ".join([*(f"a{d}.{i}" for i in range(30)), *own, *(f"z{d}.{i}" for i in range(30))])


def test_a_hot_key_spans_ranges_and_windows_are_not_written(spark, monkeypatch):
    docs = spark.createDataFrame(list(texts_of(1)), "doc_id long, text string").repartition(3)
    written, cut = {}, substring.cut
    monkeypatch.setattr(substring, "cut", lambda t, label="cut", **k: written.setdefault(label, []).append(cut(t, label, **k)) or written[label][-1])
    monkeypatch.setattr(substring, "SAMPLE", 1.0)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            wins = substring.windows(docs)
            ends = substring.range_ends(wins, int(n))
            parts = {r[0]: r[1] for r in substring.windows(docs, ends=ends).groupBy("part").count().collect()}
            assert sum(parts.values()) == wins.count() and len(parts) == int(n) and max(parts.values()) < 3 * wins.count() / int(n) + 1
            seen.append(sorted(tuple(r) for r in substring.op10_substring(docs).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] and {r[0] for r in seen[0]} == set(range(1, 40))
    assert "passage-windows" not in written and len(written["passage-sample"]) == 4


def test_rows_inside_found_passages_do_not_come_out_again(spark, monkeypatch):
    docs = spark.createDataFrame(list(texts_of(2)), "doc_id long, text string").repartition(3)
    met, missed = substring.met_in_order, []
    monkeypatch.setattr(substring, "met_in_order", lambda wins: missed.append((wins.count(), met(wins))) or missed[-1][1])
    seen = []
    regions = substring.regions
    monkeypatch.setattr(substring, "regions", lambda t, *a: seen.append(t.count()) or regions(t, *a))
    assert {r.doc_id for r in substring.op10_substring(docs).collect()} == set(range(1, 40))
    (_, _), (asked, out) = missed
    assert asked > 1000 and "inside" not in out.columns and seen[1] < asked / 20
    assert "spans" not in out._jdf.queryExecution().optimizedPlan().toString()  # told by a flag of the row, without a join


def test_votes_of_frequent_shingles(monkeypatch):
    """As differences, as correlations and all together: the same votes as counting every pair of places."""
    rng = np.random.default_rng(6)
    for t in range(60):
        kinds = int(rng.choice([1, 3, 40, 500]))
        a, b = rng.integers(0, kinds, int(rng.integers(1, 400))), rng.integers(0, kinds, int(rng.integers(1, 400)))
        order, ordered, ends, _ = substring.sorted_places(b)
        first = np.minimum(np.searchsorted(ordered, a), len(b) - 1)
        at = np.flatnonzero(ordered[first] == a)
        want = np.zeros(len(a) + len(b) + 1, np.int64)
        np.add.at(want, [y - x + len(a) for x in range(len(a)) for y in np.flatnonzero(b == a[x])], 1)
        for often, correlate, places in ((1 << 11, 8, 1 << 20), (1, 1e9, 50), (1, 0, 1 << 20)):
            for name, x in (("OFTEN", often), ("CORRELATE", correlate), ("PLACES", places)):
                monkeypatch.setattr(substring, name, x)
            if len(at):
                assert (substring.shift_votes(at, first[at], (ends[first] - first)[at], order, len(a)) == want).all()


def test_words_are_compared_alike_in_any_batches(spark):
    """Regions whose first document came in an earlier batch, upper case, words of many bytes."""
    docs = [(d, text.replace("c", "É") if d % 2 else text.replace("c", "É").upper()) for d, text in texts_of(3)]
    frame, before, seen = spark.createDataFrame(docs, "doc_id long, text string"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), []
    try:
        for size in ("1", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            seen.append(sorted(tuple(r) for r in substring.op10_substring(frame).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert seen[0] == seen[1] and {r[0] for r in seen[0]} == set(range(1, 40))


def test_regions_larger_than_a_slice_of_text(spark):
    """Four texts of 1.5 MB, alike but for a word in 40,000: a task compares more than it holds at a time."""
    words = [f"W{i}é" for i in range(180_000)]
    docs = [(d, " ".join(w if not d or (i + d * 7) % 40_000 else f"x{d}" for i, w in enumerate(words))) for d in range(4)]
    held = {}
    for r in substring.op10_substring(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        held.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    assert set(held) == {1, 2, 3} and all(sum(b - a for a, b in spans) >= 179_000 for spans in held.values())
