"""SimHash fingerprints linked by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all words within half of the radius (65 words for a radius of 2). Two
fingerprints within the radius share one of them, and a word holds 65 distinct fingerprints at most, however
many documents repeat them, so a bucket is bounded by construction. Its pairs are deduplicated and verified.
Components of the links come from large-star and small-star rounds over tables of distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.llm.arrow import mixed, rolled, slices, words
from calibrant.llm.common import cut, drop_table, join_hot, need
from calibrant.operators.neighbours import star_rounds

SEED, SHINGLE, RADIUS = 42, 3, 2
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PLAIN = str.maketrans("\t\n\v\f\r", "     ")


def _fingerprints(texts: list[str], width: int) -> np.ndarray:
    hashes, counts = [], []
    digest = lambda s: xxhash.xxh64_intdigest(s, SEED)
    for t in texts:
        t = t.lower() if t.isascii() else t.translate(LOWER)
        w = [x for x in t.translate(PLAIN).split(" ") if x]
        shingles = map(" ".join, zip(*[w[i:] for i in range(width)])) if len(w) >= width else [" ".join(w)] if w else []
        n = max(len(w) - width + 1, min(1, len(w)))
        hashes.append(np.fromiter(map(digest, shingles), np.uint64, n))
        counts.append(n)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), counts)
    set_bits = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
    out = np.zeros(len(texts), np.uint64)
    half = np.asarray(counts, np.int64)[:, None]
    for byte in range(8):
        value = ((h >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)
        ones = np.bincount(owner * 256 + value, minlength=256 * len(texts)).reshape(-1, 256) @ set_bits
        bits = (2 * ones > half).astype(np.uint64)
        out |= (bits << (np.arange(8, dtype=np.uint64) + np.uint64(8 * byte))).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, *keep: str, width: int = SHINGLE) -> DataFrame:
    """The columns ``keep`` and fp, the 64 bits as a signed long, of each whole text (null: none, zero)."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, size=1 << 20):
            fp = _fingerprints([t or "" for t in b.column("text").to_pylist()], width)
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array(fp.view(np.int64))], [*keep, "fp"])

    return need(docs, *dict.fromkeys([*keep, "text"])).mapInArrow(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keep], "fp long"]))


def ball(fp: Column, radius: int) -> Column:
    """All words within ``radius`` bits of ``fp``."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in signed]), lambda m: fp.bitwiseXOR(m))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b (a < b): pairs of the distinct fingerprints in ``distinct`` (fp) within ``radius`` bits.

    Each word of the balls is shuffled with the fingerprints around it. Members of one bucket lie within
    twice the half radius of each other: for an even radius all are links, and a star around the smallest
    carries the same components as all pairs; each is verified.
    """
    if radius % 2:
        raise ValueError("the radius is even: two halves meet in the middle")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a ball is 65 times its fingerprint: more tasks than its table has parts
    variants = distinct.repartition(n, "fp").select("fp", F.explode(ball(F.col("fp"), radius // 2)).alias("word"))
    buckets = variants.groupBy("word").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    star = buckets.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b").distinct()
    return star.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


components = star_rounds  # node, root of nodes that aren't roots, over edges a, b


def groups(docs: DataFrame, *keep: str, radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """doc_id, the columns ``keep``, fp, root and component_id per row of ``docs``: the smallest fingerprint and
    the smallest doc_id reachable over links.

    Null and word-less text have fingerprint zero, linked like any other; equal fingerprints are linked; a
    null doc_id gets a component but never names one unless all in it are null; repeated rows repeat; no rows
    give no rows; other columns are not read.
    """
    rows = cut(fingerprints(docs, "doc_id", *keep, width=width), "simhash")
    own = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    root = components(links(own.select("fp"), radius), "simhash-links").withColumnRenamed("node", "fp")
    placed = own.join(root, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = placed.join(named, "root").select("fp", "root", "component_id")
    return rows.join(of, "fp").select("doc_id", *keep, "fp", "root", "component_id")


BANDS, ROWS = 20, 5  # a pair of similarity 0.8 shares a band with probability 0.9996
NEAR_WIDTH, NEAR = 5, 0.8


def _shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Hashes of the five-word shingles of each text, of all its words where it has fewer; 0 for none."""
    codes, dictionary, offsets = words(pc.ascii_lower(texts))
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, dictionary.to_pylist()), np.uint64, len(dictionary))[codes]
    each = [hashed[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    return [rolled(h, min(len(h), NEAR_WIDTH)) if len(h) else np.zeros(1, np.uint64) for h in each]


LACKING, SURPLUS = 32, 8  # keys of what a document holds and its dissimilar first doesn't, and the other way round
BLOCK = 512  # partners of a document that meet one copy of its text


def _factors(n: int, seed: int) -> list[np.uint64]:
    return [np.uint64(x | 1) for x in np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64).tolist()]


def _narrower(first: np.ndarray, x: np.ndarray, name: np.uint64) -> list[int]:
    """Keys under which a document (shingles ``x``) goes on when its first (``first``, hashed to ``name``) is not similar.

    Documents alike share most of what they differ in from a third that is like neither: of two of similarity 0.8 the
    differences to it (both ways together) have over a fifth in common, and what is rare lies in them and not in the template around it.
    """
    out: list[int] = []
    for part, factors in ((np.setdiff1d(x, first, True), _factors(LACKING, SEED + 1)), (np.setdiff1d(first, x, True), _factors(SURPLUS, SEED + 2))):
        if len(part):
            least = np.array([(part * f).min() for f in factors], np.uint64)
            out += mixed(least ^ mixed(np.array(factors, np.uint64) ^ name)).view(np.int64).tolist()
    return out


def _compared(pairs: DataFrame, one: DataFrame) -> DataFrame:
    """The pairs of documents (o1, o2 the first, k1, k2) with near (similarity NEAR or more on whole shingle sets) and, where it
    isn't, the narrower keys. A first meets its partners in blocks of BLOCK, each with a copy of its text."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            mine, theirs = ([np.unique(x) for x in _shingle_sets(b.column(c))] for c in ("text", "o_text"))
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(mine, theirs)])
            near = both >= NEAR * (np.array([len(x) + len(y) for x, y in zip(mine, theirs)]) - both)
            ends = [np.asarray(b.column(c)).view(np.uint64) for c in ("o1", "o2")]
            names = mixed(mixed(ends[0]) ^ ends[1])
            keys = [None if n else _narrower(y, x, name) for n, x, y, name in zip(near, mine, theirs, names)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("o1", "o2", "k1", "k2")], pa.array(near), pa.array(keys, pa.list_(pa.int64()))], ["o1", "o2", "k1", "k2", "near", "keys"])

    blocks = pairs.groupBy("o1", "o2").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = pairs.join(blocks, ["o1", "o2"]).withColumn("block", F.pmod(F.xxhash64("k1", "k2"), "blocks")).drop("blocks")
    firsts = blocks.join(one.select(F.col("k1").alias("o1"), F.col("k2").alias("o2"), F.col("text").alias("o_text")), ["o1", "o2"])
    copies = firsts.select("o1", "o2", "o_text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    met = dealt.join(one, ["k1", "k2"]).join(copies, ["o1", "o2", "block"])
    return met.select("o1", "o2", "k1", "k2", "text", "o_text").mapInArrow(checked, "o1 long, o2 long, k1 long, k2 long, near boolean, keys array<long>")


def _with_first(rows: DataFrame) -> DataFrame:
    """Distinct pairs of the first document of a key (o1, o2) and each other one (k1, k2), over rows (key, k1, k2)."""
    first = rows.groupBy("key").agg(F.min(F.struct("k1", "k2")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.join(first, "key").where(F.struct("k1", "k2") != F.col("f")).select("f.k1", "f.k2", "k1", "k2").toDF("o1", "o2", "k1", "k2").distinct()


def simhash_edges(docs: DataFrame) -> DataFrame:
    """a, b: the documents (k1, k2) of a component of SimHash links (see :func:`links`) as a star around the first of them."""
    node = F.struct("k1", "k2")
    rows = cut(fingerprints(docs, "k1", "k2").distinct(), "near-simhash")
    own = cut(rows.groupBy("fp").agg(F.min(node).alias("first"), F.count(F.lit(1)).alias("n")), "near-fingerprints")
    root = cut(components(links(own.select("fp")), "near-balls"), "near-roots").withColumnRenamed("node", "fp")
    placed = own.join(root, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first", "n")
    named = placed.groupBy("root").agg(F.min("first").alias("a"), F.sum("n").alias("n")).where("n > 1").drop("n")
    of = placed.join(named, "root").select("fp", "a")
    out = cut(join_hot(rows, of, "fp", own.select("fp", "n")).where("a is not null").select("a", node.alias("b")).where("a <> b"), "near-stars")
    for table in (rows, own, root):
        drop_table(table)
    return out


def near_groups(docs: DataFrame) -> DataFrame:
    """k1, k2, root per row of ``docs`` (k1, k2, text): components of SimHash links (fingerprints of three-word shingles within two bits, the links of
    :func:`groups`) and of links with a Jaccard similarity of NEAR or more on whole sets of five-word shingles.

    The SimHash links come from balls around the fingerprints. Documents that are alike but lie further apart in fingerprints are linked besides: a document is compared with the first of each of its min-hash bands. Where the two are not similar, it goes on under keys of what
    they differ in, so that documents alike meet beside one that is like neither; it is compared with the first of each of those.
    """
    factors = _factors(BANDS * ROWS, SEED)

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = _shingle_sets(b.column("text"))
            x, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
            for band in range(BANDS):
                key = np.full(len(sets), band, np.uint64)
                for f in factors[band * ROWS : (band + 1) * ROWS]:
                    key = mixed(key ^ np.minimum.reduceat(x * f, starts))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column("k1"), b.column("k2")], ["key", "k1", "k2"])

    texts = docs.select("k1", "k2", F.coalesce("text", F.lit("")).alias("text"))
    one = texts.dropDuplicates(["k1", "k2"])
    rows = cut(texts.mapInArrow(bands, "key long, k1 long, k2 long").distinct(), "near-bands")
    pairs = cut(_with_first(rows), "near-pairs")
    met = cut(_compared(pairs, one), "near-met")
    further = cut(met.where("not near").select(F.explode("keys").alias("key"), "k1", "k2").distinct(), "near-further")
    again = cut(_with_first(further).join(pairs, ["o1", "o2", "k1", "k2"], "left_anti"), "near-again")
    met_again = cut(_compared(again, one).drop("keys"), "near-met-again")
    node = lambda x, y: F.struct(F.col(x).alias("k1"), F.col(y).alias("k2"))  # noqa: E731  whole keys: hashes of them could meet
    edges = met.drop("keys").unionByName(met_again).where("near").select(node("o1", "o2").alias("a"), node("k1", "k2").alias("b"))
    stars = simhash_edges(texts)
    root = components(edges.unionByName(stars), "near-links")
    for table in (rows, pairs, met, further, again, met_again, stars):
        drop_table(table)
    return docs.select("k1", "k2", node("k1", "k2").alias("node")).join(root, "node", "left").select("k1", "k2", F.coalesce("root", "node").alias("root"))


def op9_simhash(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
