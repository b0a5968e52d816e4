"""Substring dedup: what is computed once, and passes over batches that part documents anywhere."""

import random

import numpy as np
from calibrant.llm import substring
from pyspark.sql import functions as F


def met_of(spark, rng, n):
    rows = []
    for _ in range(n):
        at, f_at, pair = rng.randrange(200), rng.randrange(200), (rng.randrange(6), rng.randrange(3), -1 - rng.randrange(4), 7)
        rows.append((rng.randrange(1 << 40), *pair[:2], max(0, at - rng.randrange(60)), at, at + rng.randrange(60), rng.randrange(3), *pair[2:], max(0, f_at - rng.randrange(60)), f_at, f_at + rng.randrange(60)))
    return rows, spark.createDataFrame(rows, "key long, k1 long, k2 long, lo int, at int, hi int, block int, f_k1 long, f_k2 long, f_lo int, f_at int, f_hi int")


def test_regions_are_intervals_joined_along_a_shift_whatever_the_batches(spark):
    rows, met = met_of(spark, random.Random(4), 500)
    by = {}
    for key, k1, k2, lo, at, hi, block, o1, o2, f_lo, f_at, f_hi in rows:
        reach = lambda x: int(x * 1.25 + 8)
        place = (max(lo, at - reach(f_at - f_lo)), min(hi, at + reach(f_hi - f_at)), max(f_lo, f_at - reach(at - lo)), min(f_hi, f_at + reach(hi - at)), block)
        by.setdefault((k1, k2, o1, o2), []).append((key & 3, (f_at - at) // 32, place))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for agree in (1, 4):
            want = set()
            for pair, windows in by.items():
                if len({f for f, _, _ in windows}) < agree:
                    continue
                for shift in {s for _, s, _ in windows}:
                    out = []
                    for p in sorted(p for _, s, p in windows if s == shift):
                        if out and p[0] <= out[-1][1]:
                            q = out[-1]
                            out[-1] = (q[0], max(q[1], p[1]), min(q[2], p[2]), max(q[3], p[3]), min(q[4], p[4]))
                        else:
                            out.append(p)
                    want |= {(*pair[:2], *p[:2], *pair[2:], p[2] // 32 * 32, -(-(p[3] + 1) // 32) * 32 - 1, p[4]) for p in out}
            for size in ("3", "10000"):
                spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
                got = [tuple(r) for r in substring.regions(met, agree).collect()]
                assert len(got) == len(set(got)) and set(got) == want and want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert substring.regions(met.limit(0)).count() == 0


def test_regions_are_found_once_for_both_sides(spark):
    """Both documents of a pair ask for words: neither finds the regions anew, and texts are cut up once, not per request."""
    _, met = met_of(spark, random.Random(5), 50)
    docs = spark.createDataFrame([(i, "w " * 300) for i in range(6)], "doc_id long, text string")
    plan = substring.verified(substring.regions(met), docs)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("passage-regions") >= 2 and "split(" not in plan


def test_words_asked_for_part_at_ascii_white_space_alone(spark):
    """A no-break space, a file separator and U+2003 are parts of words; slices of a text may be larger than what a task holds at a time."""
    words = [f"w{i} {i % 7}\x1c é" for i in range(120)]
    texts = ["\t ".join(words) + "\x0b", " \f".join(["x", *words]).upper().replace("É", "é")]
    got = substring.op10_substring(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [(r.doc_id, r.start_word, r.end_word, r.of_doc_id, r.of_start, r.of_end, r.similarity) for r in got] == [(1, 1, 121, 0, 0, 120, 1.0)]


def test_compact_windows_of_odd_values():
    """Against the stack of a Cartesian tree: ties, long rises and falls, zeros beside each other."""
    rng = np.random.default_rng(1)
    for t in range(120):
        v = rng.integers(1, int(rng.choice([2, 3, 10, 2**40])), int(rng.integers(0, 300))).astype(np.uint64)
        v[rng.random(len(v)) < rng.choice([0, 0.01, 0.2])] = 0
        v = np.concatenate([[0], np.sort(v) if t % 7 == 0 else np.sort(v)[::-1] if t % 7 == 1 else v, [0]]).astype(np.uint64)
        for span in (1, 5, 46):
            want, stack = [], []
            for i, x in enumerate(v.tolist()):
                while stack and v[stack[-1]] > x:
                    top = stack.pop()
                    if i - 1 - stack[-1] >= span:
                        want.append((stack[-1] + 1, top, i - 1))
                stack.append(i)
            assert sorted(zip(*(x.tolist() for x in substring.compact_windows(v, span)))) == sorted(want)
