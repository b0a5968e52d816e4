"""Token counts, fill-in-middle and hard negatives against the tokenizers library and plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from calibrant.llm import fim, negatives, simhash, tokencount
from pyspark.sql import functions as F
from tokenizers import Tokenizer

DOC = "doc_id long, text string, lang string, n long, n_tokens string"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", 7, "clash") for i, t in enumerate(texts)] + [(None, None, None, None, None), (0, texts[0], "en", 7, None)], DOC)


def odd_texts():
    rng = random.Random(31)
    chars = "aZ é́  ß中🙂\n\t\r  '0٣_-<|>"
    texts = [None, "", " ", "\n", "a", "  a  b ", "it's we'll 'd", "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>", "<|endof", "a" * 3000, "ab" * 2000, "word " * 20000, "\n" * 500, "A\n\nB \n c", "é" * 700]
    return texts + ["".join(rng.choices(chars, k=rng.randrange(1, 60))) for _ in range(400)]


def test_token_counts_equal_the_library(spark):
    texts = odd_texts()
    model = Tokenizer.from_file(PATH)
    model.no_truncation()
    model.no_padding()
    want = Counter((i, len((t or "").encode()), len(model.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts))
    want.update([(None, 0, 0), (0, len((texts[0] or "").encode()), 0)])
    rows = tokencount.op11_token_counts(docs_of(spark, texts), PATH, limit=100).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in rows)
    kept = tokencount.token_counts(docs_of(spark, texts).toDF("doc_id", "body", "lang", "n", "c"), PATH, "lang", "doc_id", text="body")
    assert kept.columns == ["lang", "doc_id", "n_bytes", "n_tokens"] and kept.count() == len(texts) + 2
    assert tokencount.op11_token_counts(docs_of(spark, texts).limit(0), PATH).count() == 0
    with pytest.raises(ValueError, match="named like"):
        tokencount.token_counts(docs_of(spark, texts), PATH, "n_tokens")
    with pytest.raises(ValueError, match="missing"):
        tokencount.token_counts(spark.range(1), PATH)


def test_piece_counts_forget_in_generations():
    counts = tokencount.PieceCounts(PATH, remember=3)
    model = Tokenizer.from_file(PATH)
    for text in ("one two three four five six", "six five four three two one", "one one one"):
        assert counts.count(text) == len(model.encode(text, add_special_tokens=False).ids)
    assert len(counts) <= 3 and len(counts.older) <= 3


def brute_fim(doc_id, text, seed="7", rate=100, spm=50, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, z = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:z], units[z:]))
    if not text or any(k in text for k in marks) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    form = "spm" if h[3] % 100 < spm else "psm"
    out = marks[0] + p + marks[1] + s + marks[2] + m if form == "psm" else marks[1] + s + marks[0] + p + marks[2] + m
    return n, form, len(p), len(m), out


def test_fill_in_middle(spark):
    rng = random.Random(32)
    texts = [None, "", "\n", "a", "a\n", "\n\n\n", "x<P>y\nz", "<M>", "a<\nS>\n", "<\nP>", "é\n🙂\r\nz", "line\n" * 5000, "w " * 30000]
    texts += ["".join(rng.choices("ab<PSM>é\n\n\r ", k=rng.randrange(1, 50))) for _ in range(300)]
    docs = docs_of(spark, texts)
    for kw in ({}, {"seed": "x", "rate": 60, "spm": 20, "marks": ("[pre]", "[suf]", "[mid]")}):
        want = Counter((i, *brute_fim(i, t, **kw)) for i, t in [*enumerate(texts), (None, None), (0, texts[0])])
        made = fim.fill_in_middle(docs, **kw)
        assert Counter(map(tuple, made.collect())) == want
        back = made.select("doc_id", fim.restored("output", "form", kw.get("marks", fim.MARKS)).alias("text")).collect()
        assert Counter(map(tuple, back)) == Counter([(i, t or "") for i, t in enumerate(texts)] + [(None, ""), (0, "")])
    got = {r.doc_id: r for r in fim.op12_fill_in_middle(docs).where("doc_id > 0").collect()}
    for i, t in enumerate(texts[1:], 1):
        assert got[i].output_sha256 == hashlib.sha256(brute_fim(i, t)[4].encode()).hexdigest() and got[i].restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert fim.op12_fill_in_middle(docs.limit(0)).count() == 0
    for marks in (("<P>", "<P>", "<M>"), ("", "b", "c"), ("ab", "bc", "d"), ("aa", "b", "c"), ("b", "abc", "d")):
        with pytest.raises(ValueError, match="marks"):
            fim.fill_in_middle(docs, marks=marks)


def brute_negatives(rows, anchor, positives=5, negatives=3, low=50, high=95, scale=256):
    fine = [(i, l, [math.floor(scale * float(x)) for x in v]) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for k, (i, l, q) in enumerate(fine):
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j, m) for n, (j, m, v) in enumerate(fine) if n != k)
        for ps, pid, _ in [s for s in scored if s[2] == l][:positives]:
            picked = [s for s in scored if s[2] != l and -ps * low <= -s[0] * 100 <= -ps * high][:negatives]
            out.update((i, pid, r, s[1], -ps, -s[0]) for r, s in enumerate(picked, 1))
    return out


VECTORS = "id long, label int, vector array<float>, q string, aid string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "clash", None) for r in rows], VECTORS)


def test_hard_negatives(spark):
    rng = np.random.default_rng(33)
    centres = rng.normal(size=(6, 19)) * 0.2
    rows = []
    for i in range(700):
        label = int(rng.integers(0, 6)) if i % 3 else 0
        rows.append((i, label, (centres[label] + rng.normal(size=19) * 0.25).astype(np.float32).tolist()))
    rows += [(700 + i, 1, rows[10][2]) for i in range(150)]  # copies: ties by id
    rows += [rows[20], rows[50], rows[50], rows[100][:2] + (rows[7][2],)]  # repeated rows and ids
    rows += [(None, 1, rows[1][2]), (900, None, rows[2][2]), (950, 2, None), (1000, 2, [0.1, None]), (1001, 2, [0.1, float("nan")]), (1050, 2, [float("inf")])]
    rows += [(1100, 3, []), (1150, 99, rows[3][2]), (1200, 3, [0.5] * 3), (1201, 4, [0.25] * 30), (1250, 5, [0.0] * 19)]
    got = negatives.hard_negatives(vectors(spark, rows), F.col("id") % 50 == 0)
    want = brute_negatives(rows, lambda i: i % 50 == 0)
    assert Counter(map(tuple, got.collect())) == want and len(want) > 100
    few = negatives.hard_negatives(vectors(spark, rows[:300]), F.col("id") % 50 == 0, positives=1, negatives=2, low=0, high=100, scale=1000)
    assert Counter(map(tuple, few.collect())) == brute_negatives(rows[:300], lambda i: i % 50 == 0, 1, 2, 0, 100, 1000)
    assert negatives.hard_negatives(vectors(spark, rows).limit(0), F.lit(True)).count() == 0
    assert negatives.hard_negatives(vectors(spark, rows), F.lit(False)).count() == 0


def test_hard_negatives_in_many_blocks(spark, monkeypatch):
    """Several blocks, tiles, packs and stripes give the rows that one of each gives; every partition count as well."""
    rng = np.random.default_rng(34)
    rows = [(i, int(rng.integers(0, 4)), rng.normal(size=9).astype(np.float32).tolist()) for i in range(400)]
    want = brute_negatives(rows, lambda i: i % 5 == 0)
    for pack, table, tile, stripe in ((7, 60_000, 20_000, 500), (1024, 1 << 25, 1 << 21, 1 << 27)):
        for name, value in (("PACK", pack), ("TABLE_BYTES", table), ("TILE_BYTES", tile), ("STRIPE_BYTES", stripe)):
            monkeypatch.setattr(negatives, name, value)
        got = negatives.hard_negatives(vectors(spark, rows).repartition(3), F.col("id") % 5 == 0)
        assert Counter(map(tuple, got.collect())) == want


def test_looked_up_scores_are_inner_products():
    rng = np.random.default_rng(35)
    for large in (1, 3, 300, 1 << 20):
        a, c = rng.integers(-large, large, (5, 21)), rng.integers(-large, large, (40, 21))
        bits, planes = negatives.planes_of(c)
        assert (negatives.Tables(a).scores(bits) == c @ a.T).all() and bits.shape == (40, planes, 3)
    huge = np.full((1, 64), 1 << 30)
    with pytest.raises(ValueError, match="long"):
        negatives.Tables(huge).scores(negatives.planes_of(huge)[0])


def test_word_ids_where_lower_case_composes(spark):
    """Capitals that compose with a mark, or change its order, only when lowered."""
    from calibrant.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    texts = ["W̊ x", "J̌", "H̱a", "T̈ T̈", "İ́ Ị̇̇", "é É", "plain Text", "Ậ", "Σ̊"]
    got = packing.load(path, 2).texts(texts)
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == [*model.encode(text, add_special_tokens=False).ids, 2], text


def test_every_place_votes_on_a_shift(monkeypatch):
    from calibrant.llm import substring

    rng = np.random.default_rng(36)
    for places, kinds in ((1 << 20, 5), (50, 5), (50, 400), (3, 2)):
        monkeypatch.setattr(substring, "PLACES", places)
        a, b = rng.integers(0, kinds, 90), rng.integers(0, kinds, 140)
        order, ordered, ends, _ = substring.sorted_places(b)
        first = np.minimum(np.searchsorted(ordered, a), len(b) - 1)
        at = np.flatnonzero(ordered[first] == a)
        votes = substring.shift_votes(at, first[at], ends[first[at]] - first[at], order, len(a))
        want = Counter(int(k - i) for i in at for k in np.flatnonzero(b == a[i]))
        assert {k - len(a): v for k, v in enumerate(votes.tolist()) if v} == dict(want)


def test_passages_do_not_depend_on_partitions(spark):
    from calibrant.llm import substring

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in ("1", "8", "37"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(map(tuple, substring.op10_substring(docs.repartition(int(n))).collect()), key=str))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] and seen[0] == seen[1] == seen[2]


def test_near_copies_beside_earlier_documents_of_a_template(spark):
    """60 earlier documents are edits of one template, like neither of the 60 pairs that are near copies of each other; the groups are
    compared with those of all pairs. One document holds a whole pair and more."""
    rng, fresh = random.Random(5), iter(range(10**6))
    template = [f"t{i}" for i in range(300)]

    def edited(words, n):
        words = list(words)
        for p in rng.sample(range(5, len(words) - 5), n):
            words[p] = f"u{next(fresh)}"
        return words

    docs = [edited(template, 6) for _ in range(60)]
    long = [f"l{i}" for i in range(200)]
    docs += [long + [f"m{i}" for i in range(90)], edited(long, 1), edited(long, 1)]
    for _ in range(60):
        middle = edited(template, 4)
        docs += [edited(middle, 2), edited(middle, 2)]
    sets = [{tuple(d[i : i + 5]) for i in range(len(d) - 4)} for d in docs]
    links = [(a, b) for b in range(len(docs)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = list(range(len(docs)))
    for a, b in links:
        old, new = root[b], root[a]
        root = [new if r == old else r for r in root]
    rows = spark.createDataFrame([(i, 0, " ".join(d)) for i, d in enumerate(docs)] + [(0, 0, " ".join(docs[0]))], "k1 long, k2 long, text string")
    got = {r.k1: r.root.k1 for r in simhash.near_groups(rows).collect()}
    assert got[61] == got[62] != got[60]
    for a, b in {(got[a], a) for a in got}:
        assert root[a] == root[b]  # no group holds what isn't linked
    assert sum(got[a] == got[b] for a, b in links) >= 0.97 * len(links) > 55
