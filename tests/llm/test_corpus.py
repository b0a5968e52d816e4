"""Operators of the corpus subpackage against brute force, with nulls, empties, ties and repeated rows."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from calibrant.llm import bpe, chat, common, exactdedup, linedup, packing, quality, simhash, substring, urlrank, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, vocabulary=400):
    return " ".join(rng.choice([f"w{rng.randrange(vocabulary)}", "alpha,", "Beta.", "it's"]) if rng.random() < 0.3 else f"t{rng.randrange(vocabulary * 20)}" for _ in range(n))


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or {}).get(i, "s"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, null ids, repeated rows, a long text, and columns named like the operators' own."""
    rng = random.Random(1)
    long = "\n".join(prose(rng, 40) for _ in range(60))
    rows = [(1, None), (2, ""), (3, "  \n\t "), (None, "a null id"), (None, None), (4, "x"), (4, "x"), (4, "x y"), (5, long), (6, long), (7, "naïve é 漢字 😀 <|endoftext|> x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit("z").alias(c) for c in ("k1", "k2", "fp", "ats", "spans", "kept", "host", "row", "n", "key", "n_words", "base_failed")], F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(0).cast("long").alias("n_chars"))


def test_bpe_matches_the_library(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ["", "  a  b\n\n c\t", "x<|endoftext|>y <|endoftext|>", "it's 'S we'll  '' don''t\u3000a\x85b\x1cz", "naïve é́ 漢字 😀😀   ", "a" * 200, "    ", " 's", "\xa0\xa0x", prose(random.Random(2), 500)]
    pairs = bpe.load(path)
    for x in texts:
        want = t.encode(x, add_special_tokens=False).ids
        ids = pairs.encode(x)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want
        assert pairs.decode(ids) == t.decode(want, skip_special_tokens=False)
    got = bpe.digests(odd, path)
    assert got.count() == odd.count() and got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r.n_tokens for r in got.where("doc_id in (1, 2)").collect()} == {0}
    assert bpe.digests(odd.limit(0), path).count() == 0
    assert bpe.encode(odd.where("doc_id = 7"), path).first().decoded == odd.where("doc_id = 7").first().text


def test_bpe_cache_generations(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    small, large = bpe.BytePairs(path, remember=3), bpe.load(path)
    text = prose(random.Random(3), 300)
    assert small.encode(text) == large.encode(text) and len(small) <= 4


def test_packing(spark, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = ["a" + prose(random.Random(i), 30 * i) for i in range(40)] + [None, "", "\x1c x\x1dy", "<|ENDOFTEXT|> <|endoftext|>", "ΣΑΣ İx e\u0301", "x. " * 9000]
    rows = packing.pack(docs_of(spark, texts), path, block=5000).collect()
    of, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(of[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.SIZE
    assert packing.pack(odd, path).select(F.sum("length")).first()[0] > 0
    assert packing.pack(odd.limit(0), path).count() == 0


def test_cuts_are_optimal():
    rng = random.Random(4)
    for _ in range(60):
        total = rng.randrange(1, 120)
        sentences = np.array(sorted(rng.sample(range(1, total + 1), min(total, rng.randrange(1, 12)))))
        documents = np.array(sorted(set(rng.sample(list(sentences), rng.randrange(0, len(sentences) + 1))) | {total}))
        got = packing.cuts(total, documents, sentences, size=16)
        price = {p: 64.0 for p in range(total + 1)} | {int(p): 8.0 for p in sentences} | {int(p): 0.0 for p in documents}

        def cost(ends):
            out, a = 0.0, 0
            for b in ends:
                n = b - a
                assert 0 < n <= 16
                out += (0 if n & (n - 1) == 0 else 16 - n) + price[b]
                a = b
            return out

        places = packing.candidates(total, documents, sentences, 16).tolist()
        best = {0: 0.0}
        for j in places[1:]:
            best[j] = min(best[i] + (0 if (n := j - i) & (n - 1) == 0 else 16 - n) + price[j] for i in places if 0 < j - i <= 16)
        assert got[-1] == total and set(got) <= set(places) and cost(got) == best[total]
    assert packing.cuts(0, np.array([]), np.array([])) == []


def brute_quality(text):
    w = WORD.findall(text or "")
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, odd):
    texts = [None, "", prose(random.Random(5), 100), "a b c d e f g h i " * 12, "x\nx\n\ny\nx $%|", " #" * 5, "é\x85ü\xa0q"]
    sources = {i: "bad" if i in (0, 1, 3) else None if i == 4 else "good" for i in range(len(texts))}
    got = {r.doc_id: r for r in quality.judge(docs_of(spark, texts, sources), max_rate=0.8).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(t), i
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert quality.judge(odd).count() == odd.count() and quality.judge(odd.limit(0)).count() == 0


def test_a_bad_host_takes_its_documents(spark):
    good = prose(random.Random(6), 60)
    rows = [(i, "short", "en", "bad", 5) for i in range(95)] + [(95 + i, good + str(i), "en", "bad", 9) for i in range(5)] + [(100 + i, good + str(i), "en", f"h{i % 7}", 9) for i in range(200)]
    got = quality.judge(spark.createDataFrame(rows, DOC))
    assert got.where("host = 'bad' and kept").count() == 0 and got.where("host <> 'bad' and not kept").count() == 0


def test_exact_dedup(spark, odd, tmp_path):
    path = f"file://{tmp_path}/t"
    odd.drop("row").write.parquet(path)
    rows = odd.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
    weak = lambda c: F.substring(F.sha2(c, 256), 1, 1)  # noqa: E731  one hex digit: different texts collide
    for digest in (exactdedup.sha256, weak):
        got = exactdedup.deduplicate(spark, path, digest=digest).collect()
        assert len(got) == len(rows)
        want = Counter()
        for text, ids in groups.items():
            keep = min((i for i in ids if i is not None), default=None)
            for i in ids:
                want[(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest())] += 1
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_of_partitions_with_equal_file_names(spark, tmp_path):
    for k, ids in enumerate(((1, 2, 3), (1, 1, 2))):
        for folder, i in zip("abc", ids):
            (tmp_path / f"{k}/source={folder}").mkdir(parents=True)
            pq.write_table(pa.table({"doc_id": [i], "text": ["a b"]}), tmp_path / f"{k}/source={folder}/part-00000.parquet")
        got = exactdedup.deduplicate(spark, f"file://{tmp_path}/{k}").collect()
        assert sorted(r.doc_id for r in got) == sorted(ids) and [r.doc_id for r in got if r.kept] == [1]
        assert {(r.keep_id, r.group_size) for r in got} == {(1, 3)}


def test_hot_keys_join_like_others(spark):
    rows = spark.createDataFrame([("h" if i % 3 else f"k{i}", i) for i in range(3000)] + [(None, -1), ("z", -2)], "key string, i long")
    table = spark.createDataFrame([("h", 1), *[(f"k{i}", i) for i in range(0, 3000, 6)]], "key string, v long")
    got = common.join_hot(rows, table, "key", rows.where("key is not null").groupBy("key").count().withColumnRenamed("count", "n"))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, rows.join(table, "key", "left").collect()))


def test_exact_dedup_state_goes_on(spark, tmp_path):
    path, state = f"file://{tmp_path}/t", f"file://{tmp_path}/state"
    spark.createDataFrame([(5, "a b"), (7, "c")], "doc_id long, text string").write.parquet(path)
    exactdedup.ingest(spark, path, state)
    spark.createDataFrame([(3, "a\n b"), (9, "d")], "doc_id long, text string").write.mode("append").parquet(path)
    exactdedup.ingest(spark, path, state)
    assert {(r.keep_id, r.n) for r in exactdedup.read_state(spark, state).collect()} == {(3, 2), (7, 1), (9, 1)}


def test_line_dedup(spark, odd):
    texts = ["a\nb\nc\nd", "x\na\nb\nc\ny", "a\n\nb\nc \nd\ne", "a\nb", None, "", "q\nq\nq\nq\nq"]
    got = {r.doc_id: r for r in linedup.op8_line_dedup(docs_of(spark, texts)).collect()}
    assert got[0].text == texts[0] and got[3].text == texts[3] and got[4].text is None
    assert (got[1].text, got[1].n_removed) == ("x\ny", 3)
    assert got[2].text == "e"
    assert got[6].text == "q"  # the second and third windows cover the first one's later lines
    assert linedup.op8_line_dedup(odd).count() == odd.count() and linedup.op8_line_dedup(odd.limit(0)).count() == 0


def brute_fp(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, odd):
    rng = random.Random(7)
    base = [prose(rng, 200).split(" ") for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for _ in range(60):
        w = list(rng.choice(base))
        w[rng.randrange(len(w))] = "CHANGED"
        texts.append(" ".join(w))
    texts += [None, "", "one", "one two", "\u0130x A"]
    fps = [brute_fp(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: r for r in simhash.op9_simhash(docs_of(spark, texts)).collect()}
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    assert simhash.op9_simhash(odd).count() == odd.count() and simhash.op9_simhash(odd.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    e = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(900, 901), (7, 7)], "a long, b long"))
    got = simhash.components(e).collect()
    assert {r.node for r in got if r.root == 0} == set(range(1, 201)) and {(r.node, r.root) for r in got if r.root != 0} == {(901, 900)}


def test_compact_windows_cover_every_run():
    rng = np.random.default_rng(8)
    for _ in range(30):
        n, span = int(rng.integers(1, 60)), int(rng.integers(2, 9))
        v = np.concatenate([[0], rng.integers(1, 12, n), [0]]).astype(np.uint64)
        left, centre, right = substring.compact_windows(v, span)
        for i in range(1, n - span + 2):
            for j in range(i + span - 1, n + 1):
                c = i + int(np.argmin(v[i : j + 1]))
                assert [c] == [m for a, m, b in zip(left, centre, right) if a <= i <= m <= j <= b]


def test_substring(spark, odd):
    rng = random.Random(9)
    passage = prose(rng, 70).split(" ")
    near = list(passage)
    near[35] = "changed"
    short = passage[:45]
    texts = [" ".join([prose(rng, 60), *p, prose(rng, 80)]) for p in (passage, near, passage, short)] + [prose(rng, 300), None, "", "x"]
    texts.append(texts[4])
    got = substring.op10_substring(docs_of(spark, texts)).collect()
    pairs = {(r.doc_id, r.of_doc_id) for r in got}
    assert pairs == {(1, 0), (2, 0), (8, 4)}
    shingles = lambda t, a, b: {tuple(t[i : i + 5]) for i in range(a, b - 4)}
    for r in got:
        a = shingles(WORD.findall(texts[r.doc_id].lower()), r.start_word, r.end_word)
        b = shingles(WORD.findall(texts[r.of_doc_id].lower()), r.of_start, r.of_end)
        assert r.similarity >= 0.8 and abs(len(a & b) / len(a | b) - r.similarity) < 1e-5 and r.end_word - r.start_word >= 50
    r = next(r for r in got if (r.doc_id, r.of_doc_id) == (2, 0))
    assert 57 <= r.start_word <= 62 and 128 <= r.end_word <= 133
    assert substring.op10_substring(odd).where("doc_id = 6 and of_doc_id = 5").count() >= 1
    assert substring.op10_substring(odd.limit(0)).count() == 0


def test_a_large_group_is_a_star(spark):
    rng = random.Random(10)
    passage = prose(rng, 80)
    n = 300
    docs = docs_of(spark, [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(n)])
    got = substring.op10_substring(docs)
    assert got.select("doc_id").distinct().count() == n - 1 and got.count() < 4 * n


def test_substring_changes_anywhere(spark):
    """Passages of 50 words with one changed word (similarity 0.80) are found wherever the change is."""
    rng = random.Random(12)
    words = lambda n: [f"t{rng.randrange(200000)}" for _ in range(n)]
    texts, places = [], [5, 12, 23, 24, 25, 26, 30, 33, 40, 44] * 6
    for p in places:
        passage = words(50)
        near = [*passage[:p], "changed", *passage[p + 1 :]]
        texts += [" ".join([*words(20), *x, *words(20)]) for x in (passage, near)]
    got = {(r.doc_id, r.of_doc_id) for r in substring.op10_substring(docs_of(spark, texts)).collect()}
    pairs = {(2 * i + 1, 2 * i) for i in range(len(places))}
    assert got <= pairs and len(got) >= 0.95 * len(pairs)


def test_substring_first_holder_holds_less(spark):
    """Passages of 50 words are found among documents 2..n when the first holds only 45 of them, or an edited form."""
    rng = random.Random(13)
    words = lambda n: [f"t{rng.randrange(200000)}" for _ in range(n)]
    texts, pairs = [], set()
    for k in range(20):
        passage = words(50)
        edited = [w if i % 9 else "other" for i, w in enumerate(passage)]
        for i, x in enumerate((edited if k % 2 else passage[:45], passage, passage, passage)):
            texts.append(" ".join([*words(20), *x, *words(20)]))
            pairs |= {len(texts) - 1} if i > 1 else set()
    got = substring.op10_substring(docs_of(spark, texts)).collect()
    assert {r.doc_id for r in got} == pairs and all(r.of_doc_id == r.doc_id // 4 * 4 + 1 for r in got)


def test_substring_against_brute_force(spark):
    """Every run of 50 words that an earlier document holds unchanged is in a passage, and nine of ten of those that one
    holds with a similarity of 0.8; documents share pieces of passages of any length, edited and not, in any order."""
    rng = random.Random(21)
    source = [[f"p{k}_{i}" for i in range(90)] for k in range(8)]
    texts = []
    for _ in range(90):
        words = []
        for _ in range(3):
            w, n = rng.choice(source), rng.choice((30, 45, 52, 70, 90))
            at = rng.randrange(len(w) - n + 1)
            piece = w[at : at + n]
            if rng.random() < 0.4:
                piece = [x if rng.random() > 0.02 else "edited" for x in piece]
            words += [*piece, *[f"t{rng.randrange(100000)}" for _ in range(rng.randrange(40))]]
        texts.append(words)
    got = defaultdict(list)
    for r in substring.op10_substring(docs_of(spark, [" ".join(t) for t in texts])).collect():
        assert r.of_doc_id < r.doc_id
        got[r.doc_id].append((r.start_word, r.end_word))
    first, exact, near, found = {}, 0, 0, 0
    sets = [[frozenset(map(tuple, (t[j : j + 5] for j in range(i, i + 46)))) for i in range(len(t) - 49)] for t in texts]
    for d, t in enumerate(texts):
        inside = [any(a <= i and i + 50 <= b for a, b in got[d]) for i in range(len(sets[d]))]
        part = [any(a <= i + 25 < b for a, b in got[d]) for i in range(len(sets[d]))]
        for i in range(len(sets[d])):
            if first.setdefault(tuple(t[i : i + 50]), d) < d:
                exact += 1
                assert inside[i], (d, i, got[d])
        for i in range(0, len(sets[d]), 7):
            x = sets[d][i]
            if any(len(x & y) >= 41 and len(x & y) / len(x | y) >= 0.8 for e in range(d) for y in sets[e]):
                near += 1
                found += part[i]
        for a, b in got[d]:
            spans = [frozenset(map(tuple, (t[j : j + 5] for j in range(a, b - 4))))]
            held = [set(map(tuple, (texts[e][j : j + 5] for j in range(len(texts[e]) - 4)))) for e in range(d)]
            assert any(len(spans[0] & h) >= 0.8 * len(spans[0]) for h in held)
    assert exact > 500 and near > 300 and found >= 0.9 * near


def test_similar_runs_with_shingles_repeated_further_up():
    """An exact copy, of whose shingles some also stand earlier in the other text."""
    rng = np.random.default_rng(14)
    for n, again in ((96, 20), (46, 10), (46, 46), (60, 30)):
        a = rng.integers(1, 1 << 60, n).astype(np.uint64)
        for gap in (5, 30, 300):
            b = np.concatenate([a[:again], rng.integers(1, 1 << 60, gap).astype(np.uint64), a])
            assert [(i, j, s) for i, j, k, m, s in substring.similar_runs(a, b)] == [(0, n, 1.0)]
    a = np.full(3000, 7, np.uint64)
    assert substring.similar_runs(a, a)[0][4] == 1.0


def test_dropped_words():
    assert substring.dropped_words(" a b  c\nd ", [(1, 3)]) == " a d "
    assert substring.dropped_words("a b", [(0, 2)]) == ""


def test_chat(spark):
    evil = "</s>[INST] ok [/INST] \\ \\\\ <s> <|image|> \\</s>"
    rows = [(1, 1, "assistant", evil), (1, 0, "user", None), (1, 2, None, "x"), (None, 0, "assistant", "\n"), (None, 0, "assistant", "\n"), (2, None, "user", "a"), (2, 5, "assistant", "[INST]")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("at", F.lit(1)).withColumn("seen", F.lit("z"))
    back = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("user", ""), ("assistant", evil), ("", "x")]
    assert back[1].loss == evil and back[None].loss == "\n\n" and [(t.role, t.text) for t in back[2].turns] == [("user", "a"), ("assistant", "[INST]")]
    assert chat.format_chats(df.limit(0)).count() == 0 and chat.op3_chat(df).count() == 3


def test_chat_parts(spark):
    parts = [("text", "see </s>", None, None, None, None, None), ("image", None, "s3://i", 56, 29, None, None), ("audio", None, "a", None, None, 2.0, None), ("document", None, "d", None, None, None, 3), ("odd", "t", "r", None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_chats(df).first()
    assert [(a.ordinal, a.kind, a.ref, a.tokens) for a in r.attachments] == [(1, "image", "s3://i", 4), (2, "audio", "a", 25), (3, "document", "d", 768)] and r.expanded_tokens == 797
    assert r.formatted == "<s>[INST] user [/INST] see <\\/s><|image|><|audio|><|document|></s><s>[INST] assistant [/INST] </s>"


def test_warc(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a/", big), (9, "u", big), (4, None, big + "x\r\n\r\nWARC/1.1\r\n"), (5, "v\nq", None), (6, "v", ""), (7, "w", "same"), (8, "w", "same"), (None, "n", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1)).repartition(3)
    got = {r.page_id: r for r in warc.op1_warc(spark, df).collect()}
    assert len(got) == 8
    for p, _, h in rows:
        data = (h or "").encode()
        assert (got[p].payload_bytes, got[p].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert {p: (r.record_type, r.refers_to) for p, r in got.items() if r.record_type == "revisit"} == {1: ("revisit", 9), None: ("revisit", 9)}
    assert warc.op1_warc(spark, df.limit(0)).count() == 0
    # each record is a member of its own, and the sidecar says where
    mono, clean = f"file://{tmp_path}/mono", f"file://{tmp_path}/clean"
    warc.write_monolithic(df, mono)
    index = warc.normalise(spark, mono, clean).collect()
    for e in index:
        data = open(e.archive.removeprefix("file://"), "rb").read()
        one = zlib.decompressobj(31)
        text = one.decompress(data[e.offset : e.offset + e.length])
        assert one.eof and not one.unused_data and e.record_id.encode() in text
    assert sum(len(open(p, "rb").read().splitlines()) for p in (tmp_path / "clean").glob("*.idx")) == len(index) == 8


def test_warc_ends_within_a_record():
    with pytest.raises(ValueError):
        list(warc.parsed(iter([b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"])))
    assert list(warc.parsed(iter([]))) == []


def test_url_rules_and_ranks(spark):
    link = lambda *u: "".join(f"<a class=x href='{x}'>y</a>" for x in u)
    rows = [
        (1, "http://Good.com/en/1", link("http://mid.com/", "/own")), (2, "http://mid.com/x?y", link("//leaf.com/")), (3, "http://leaf.com/", None), (4, "https://bad.org/es/1", None),
        (5, "http://liar.net/z", link("http://bad.org/a", "http://bad.org/b")), (6, None, None), (7, "no scheme", ""), (8, "http://bad.org/other", ""), (9, "http://sub.good.com/en/7#f", ""), (None, "http://xgood.com/en/", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit("z"))
    rules = spark.createDataFrame([("good.com/en/", "allow"), ("good.com/en/7", "block"), ("org/es/", "block"), (None, "block")], urlrank.RULES)
    got = {r.page_id: r for r in urlrank.judge(pages, rules).collect()}
    assert {p: (r.host, r.path, r.rule, r.verdict) for p, r in got.items() if p in (1, 6, 7, 9, None)} == {
        1: ("good.com", "/en/1", "good.com/en/", "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 9: ("sub.good.com", "/en/7", "good.com/en/7", "block"), None: ("xgood.com", "/en/", None, "allow")}
    assert got[4].verdict == "block" and got[5].distrust > got[5].trust
    # against a dense solution; what hosts without links hold goes back to the seeds
    hosts = sorted({r.host for r in got.values() if r.host} | {"leaf.com"})
    at = {h: i for i, h in enumerate(hosts)}
    a = np.zeros((len(hosts), len(hosts)))
    for s, d in (("good.com", "mid.com"), ("good.com", "good.com"), ("mid.com", "leaf.com"), ("liar.net", "bad.org")):
        a[at[s], at[d]] += 1
    s, b = np.zeros(len(hosts)), np.zeros(len(hosts))
    s[at["good.com"]], b[at["bad.org"]], b[at["sub.good.com"]] = 1, 0.5, 1

    def solved(m, seeds):
        rows = m.sum(1, keepdims=True)
        p = np.where(rows > 0, m / np.maximum(rows, 1), seeds / seeds.sum())
        return np.linalg.solve(np.eye(len(m)) - 0.85 * p.T, 0.15 * seeds)

    trust, distrust = solved(a, s), solved(a.T, b)
    assert abs(distrust.sum() - b.sum()) < 1e-9
    for r in got.values():
        if r.host:
            assert abs(r.trust - trust[at[r.host]]) < 1e-4 and abs(r.distrust - distrust[at[r.host]]) < 1e-4
    assert urlrank.judge(pages.limit(0), rules).count() == 0


def test_pipeline(spark, odd):
    rng = random.Random(11)
    texts = [prose(rng, 120) + "\n" + prose(rng, 20) for _ in range(20)]
    texts += [texts[0], "too short", texts[1].replace("alpha,", "ALPHA,"), None]
    docs = docs_of(spark, texts)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id for r in docs.collect()}
    assert set(range(20)) <= kept["quality rules"] and not {21, 23} & kept["quality rules"]
    assert kept["simhash near-dedup"] == set(range(20)) and kept["substring dedup"] == set(range(20))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd.limit(0), "").count() == 0
        stage(spark, odd, "").count()


def test_pipeline_against_brute_force(spark):
    """Each stage of the pipeline on what its predecessor kept, against plain Python."""
    rng = random.Random(31)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    lined = lambda w: "\n".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9))
    shared, boiler = [fresh(60) for _ in range(4)], [" ".join(fresh(7)) for _ in range(5)]
    texts = []
    for i in range(60):
        body = lined(fresh(rng.randrange(40, 120)))
        if i % 4 == 0:
            body += "\n" + " ".join(shared[i // 4 % 4])  # a passage in one line
        if i % 5 == 0:
            body = "\n".join(boiler[: 3 + i % 3]) + "\n" + body
        texts.append(body)
    for i in (3, 7, 11):  # copies, near and exact, and texts that the rules reject
        w = texts[i].split(" ")
        w[len(w) // 2] = "changed"
        texts += [" ".join(w), texts[i], "too short", " ".join(fresh(10) * 6)]
    docs, want = docs_of(spark, texts), dict(enumerate(texts))

    def quality(held):
        out = {}
        for i, t in held.items():
            n, _, _, _, repeated = brute_quality(t)
            if n >= 20 and 100 * repeated <= 30 * n:
                out[i] = t
        return out

    def lines(held):
        seen, out = set(), {}
        for i, t in sorted(held.items()):
            rows = [r for r in t.split("\n") if r.strip()]
            gone = set()
            for k in range(len(rows) - 2):
                window = tuple(r.rstrip() for r in rows[k : k + 3])
                gone |= {k, k + 1, k + 2} if window in seen else set()
                seen.add(window)
            out[i] = "\n".join(r for k, r in enumerate(rows) if k not in gone)
        return out

    def shingles(t):
        w = WORD.findall(t.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}

    def near(held):
        sets, out = {i: shingles(t) for i, t in held.items()}, {}
        group = {i: i for i in held}
        for i in sorted(held):
            for k in sorted(held):
                if k < i and len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k]):
                    a, b = group[i], group[k]
                    group = {x: min(a, b) if g in (a, b) else g for x, g in group.items()}
        for i, t in held.items():
            if group[i] == i:
                out[i] = t
        return out

    def passages(held):
        seen, out = set(), {}
        for i, t in sorted(held.items()):
            w = WORD.findall(t.lower())
            runs = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
            gone = {k + x for k, r in enumerate(runs) if r in seen for x in range(50)}
            seen.update(runs)
            out[i] = [x for k, x in enumerate(WORD.findall(t)) if k not in gone]
        return out

    stages = dict(corpus_pipeline.STAGES)
    for name, brute in (("quality rules", quality), ("line dedup", lines), ("simhash near-dedup", near)):
        docs = common.cut(stages[name](spark, docs, ""), "test-stage")
        before, want = want, brute(want)
        assert {r.doc_id: r.text for r in docs.collect()} == want, name
        assert want != before
    docs = common.cut(stages["substring dedup"](spark, docs, ""), "test-stage")
    left = {r.doc_id: r.text for r in docs.collect()}
    assert {i: WORD.findall(t) for i, t in left.items()} == passages(want) and any(len(left[i]) < len(want[i]) for i in left)
    t, of = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), defaultdict(list)
    for r in stages["packing"](spark, docs, "").collect():
        of[r.doc_id].append(r)
    assert set(of) == set(left)
    for i, pieces in of.items():
        ids, at = t.encode(left[i], add_special_tokens=False).ids + [2], 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length])))
            at += r.length
        assert at == len(ids)


def test_pipeline_drops_near_copies(spark):
    """Copies of similarity 0.81 on five-word shingles go, those of 0.55 stay."""
    rng, texts = random.Random(15), []
    for _ in range(20):
        w = [f"t{rng.randrange(200000)}" for _ in range(100)]
        texts += [" ".join("changed" if i in at else x for i, x in enumerate(w)) for at in ((), (33, 66), (10, 25, 40, 55, 70, 85))]
    kept = {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs_of(spark, texts), "").collect()}
    assert kept == {i for i in range(60) if i % 3 != 1}
