"""Hard negatives by exact integer scores, looked up instead of multiplied.

For each group of eight dimensions a block of anchors has a table of all 256 subset sums of its components. Candidates are
packed once, bit plane by bit plane: the byte of a plane and a group is an index into that group's table, so a plane's inner
product is a sum of looked-up rows, and planes add up by shifts (the highest one, the sign, counts negative).

Anchors come in blocks of bounded table size, packed candidates in rows of :data:`PACK`, and a pair of an anchor block and a
stripe of candidates is one stream through one task: the anchors first, then the candidates, of which only the best few an
anchor are kept. Two passes: positives first, then the negatives within the windows that their scores set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calibrant.llm.common import cut, drop_table, need

PACK = 1024  # candidates or anchors in a packed row
TABLE_BYTES = 32 << 20  # subset sums of the anchors of a block
TILE_BYTES = 2 << 20  # those of the anchors that are scored at a time
STRIPE_BYTES = 128 << 20  # packed candidates that one task holds against a block, about
CAN = "dims int, planes int, ids binary, labels binary, bits binary"
LONG = np.iinfo(np.int64)


def rows_of(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(scale * x) of the components, zeros behind shorter vectors, ids and labels of the rows of a batch (id, label,
    vector) that take part."""
    vectors = batch.column("vector")
    size = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0), np.int64)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null component is nan
    owner = np.repeat(np.arange(len(size)), size)
    x = np.zeros((len(size), int(size.max(initial=0))))
    x[owner, np.arange(len(flat)) - (np.cumsum(size) - size)[owner]] = flat
    fine = np.isfinite(x).all(axis=1)
    for c in ("id", "label", "vector"):
        fine &= np.asarray(batch.column(c).is_valid())
    x = np.floor(scale * x[fine])
    if x.size and np.abs(x).max() >= 1 << 31:
        raise ValueError("a component times the scale has over 31 bits: scores would not fit a long")
    ids, labels = (np.asarray(batch.column(c).fill_null(0)) for c in ("id", "label"))
    return x.astype(np.int64), ids[fine], labels[fine]


def planes_of(q: np.ndarray) -> tuple[np.ndarray, int]:
    """The bit planes of ``q`` (rows, planes, groups of eight, one byte each), lowest plane first, in two's complement."""
    n, dims = q.shape
    planes = int(np.abs(q * 2 + 1).max()).bit_length() if q.size else 1
    wide = np.zeros((n, -(-dims // 8) * 8), np.int64)
    wide[:, :dims] = q
    each = [np.packbits((wide >> k & 1).astype(np.uint8), axis=1, bitorder="little") for k in range(planes)]
    return np.stack(each, axis=1), planes


def packed(vectors: DataFrame, scale: int) -> DataFrame:
    """``vectors`` (id, label, vector) as rows of up to PACK candidates, ordered by label within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, ids, labels = rows_of(b, scale)
            order = np.argsort(labels, kind="stable")
            out = []
            for at in range(0, len(order), PACK):
                some = order[at : at + PACK]
                bits, planes = planes_of(q[some])
                out.append((q.shape[1], planes, ids[some].astype("<i8").tobytes(), labels[some].astype("<i8").tobytes(), bits.tobytes()))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], [c.split()[0] for c in CAN.split(", ")])

    return vectors.mapInArrow(run, CAN)


class Tables:
    """Subset sums of some anchors, one table of 256 rows for each group of eight dimensions."""

    def __init__(self, q: np.ndarray):
        n, dims = q.shape
        self.groups, self.largest, self.dims = -(-dims // 8), int(np.abs(q).max(initial=0)), dims
        kind = np.int32 if self.largest * 8 < 1 << 31 else np.int64
        wide = np.zeros((n, self.groups * 8), kind)
        wide[:, :dims] = q
        self.tables = np.zeros((self.groups, 256, n), kind)
        for i in range(8):  # each bit doubles the subsets that are known
            self.tables[:, 1 << i : 2 << i] = self.tables[:, : 1 << i] + wide.reshape(n, self.groups, 8)[:, :, i].T[:, None, :]

    def scores(self, bits: np.ndarray) -> np.ndarray:
        """Inner products (candidates, anchors) with candidates given by their planes."""
        planes, groups = bits.shape[1], min(bits.shape[2], self.groups)
        bound = (self.largest << planes) * max(self.dims, 1)
        if bound >= 1 << 62:
            raise ValueError("scores would not fit a long")
        if bound >= 1 << 31:
            self.tables = self.tables.astype(np.int64, copy=False)
        total = np.zeros((len(bits), self.tables.shape[2]), self.tables.dtype)
        for k in reversed(range(planes)):
            np.left_shift(total, 1, out=total)
            add = np.subtract if k == planes - 1 else np.add  # the highest plane is the sign
            for g in range(groups):
                add(total, self.tables[g].take(bits[:, k, g], axis=0), out=total)
        return total


class Best:
    """The ``keep`` best (score, then smaller id) of each of ``n`` keys over any number of blocks; only scores above
    ``floor`` count."""

    def __init__(self, n: int, keep: int, floor: np.ndarray | None = None):
        self.keep = keep
        self.least = np.full(n, LONG.min) if floor is None else floor
        self.last = np.full(n, LONG.min)  # at the least score smaller ids count
        self.key, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, keys: slice) -> None:
        """``scores`` (candidates, keys); ``allowed`` likewise: which pairs count."""
        bounds = np.iinfo(scores.dtype)
        least = np.clip(self.least[keys], bounds.min, bounds.max).astype(scores.dtype)
        fits = scores >= least
        fits &= allowed
        c, k = np.nonzero(fits)
        score, own, cand = scores[c, k].astype(np.int64), np.arange(len(self.least))[keys][k], ids[c]
        better = (score > self.least[own]) | ((score == self.least[own]) & (cand < self.last[own]))
        if not better.any():
            return
        self.key, self.score, self.id = (np.concatenate([a, b[better]]) for a, b in ((self.key, own), (self.score, score), (self.id, cand)))
        order = np.lexsort((self.id, -self.score, self.key))
        key = self.key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        place = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        order, place = order[place < self.keep], place[place < self.keep]
        self.key, self.score, self.id = self.key[order], self.score[order], self.id[order]
        full = place == self.keep - 1
        self.least[self.key[full]], self.last[self.key[full]] = self.score[full], self.id[full]


def packed_anchors(anchors: DataFrame, blocks: int) -> DataFrame:
    """``anchors`` dealt to ``blocks``: rows of block and of up to PACK anchors as one Arrow message."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.take(pc.sort_indices(b.column("block")))
            block = np.asarray(b.column("block"))
            starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, int)
            out = []
            for start, stop in zip(starts, [*starts[1:], len(block)]):
                for at in range(start, stop, PACK):
                    part = b.slice(at, min(PACK, stop - at))
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema) as w:
                        w.write_batch(part)
                    out.append((int(block[at]), sink.getvalue().to_pybytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], ["block", "bits"])

    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("aid"), F.lit(blocks)).cast("int"))
    return dealt.repartition(blocks, "block").mapInArrow(run, "block int, bits binary")


def paired(candidates: DataFrame, anchors: DataFrame, blocks: int, stripes: int) -> DataFrame:
    """Packed rows of both sides under each pair of an anchor block and a stripe, one pair a task, its anchors (kind 0) first."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in CAN.split(", ")[:-1]]
    left = anchors.withColumn("_s", every(stripes)).select((F.col("block") * stripes + F.col("_s")).alias("pair"), F.lit(0).alias("kind"), *none, "bits")
    right = candidates.withColumn("_b", every(blocks)).select((F.col("_b") * stripes + F.pmod(F.xxhash64("ids"), F.lit(stripes)).cast("int")).alias("pair"), F.lit(1).alias("kind"), *candidates.columns)
    return left.unionByName(right).repartitionById(blocks * stripes, F.col("pair")).sortWithinPartitions("pair", "kind")


class Block:
    """The anchors of a pair, ordered by label, with the tables of each tile."""

    def __init__(self, messages: list[bytes]):
        table = pa.concat_tables([pa.ipc.open_stream(m).read_all() for m in messages]).combine_chunks().sort_by("label")
        self.rows = table
        self.aid, self.id, self.label = (table.column(c).to_numpy() for c in ("aid", "id", "label"))
        q = [np.asarray(x.values, np.int64) for x in table.column("q")]
        dims = max(map(len, q))
        self.q = np.array([np.pad(x, (0, dims - len(x))) for x in q], np.int64).reshape(len(q), dims)
        size = max(1, TILE_BYTES // (max(1, -(-dims // 8)) * 256 * 4))
        self.tiles = [(slice(a, min(a + size, len(q))), Tables(self.q[a : a + size])) for a in range(0, len(q), size)]


def streams(batches: Iterator[pa.RecordBatch], start, take, end) -> Iterator[pa.RecordBatch]:
    """Each pair of :func:`paired` in turn: ``start`` with its anchors, ``take`` with each pack of candidates, ``end`` to yield."""
    pair, messages, state = None, [], None
    for b in batches:
        for i in range(b.num_rows):
            own, kind, dims, planes, ids, labels, bits = (b.column(c)[i].as_py() for c in ("pair", "kind", "dims", "planes", "ids", "labels", "bits"))
            if own != pair:
                if state is not None:
                    yield end(state)
                pair, messages, state = own, [], None
            if kind == 0:
                messages.append(bits)
                continue
            if messages:
                state, messages = start(Block(messages)), []
            if state is not None:  # a block that no anchor fell to has nothing to score
                ids, labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
                take(state, ids, labels, np.frombuffer(bits, np.uint8).reshape(len(ids), planes, -(-dims // 8)))
    if state is not None:
        yield end(state)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``vectors`` (id, label, vector).

    A score is the exact inner product of floor(``scale`` * x) of both vectors; higher ones come first, ties by smaller id.
    ``anchors`` (a condition on id and label) picks the anchors; an anchor's positives are its first ``positives`` other
    rows of the same label, and each gets the first ``negatives`` rows of another label with ``low`` * positive_score <=
    100 * negative_score <= ``high`` * positive_score, ranked from 1. Fewer come where there are fewer; a positive without
    negatives has no row.

    Labels are whole numbers. Rows with a null id, label, vector or component, or with one that isn't finite, take no part.
    A shorter vector counts as followed by zeros. Rows that repeat are rows of their own: each may be anchor, positive and
    negative. No rows give none; other columns are not read. ValueError where scores would not fit a long. Every anchor is
    scored against all rows: the work is their product, and packed rows are shuffled once for each block of anchors.
    """
    spark = vectors.sparkSession
    rows = need(vectors, "id", "label", "vector").select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector")
    candidates = cut(packed(rows, scale), "packed-vectors")

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, ids, labels = rows_of(b, scale)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(list(q), pa.list_(pa.int64())), pa.array((q * q).sum(axis=1), pa.int64())], ["id", "label", "q", "self"])

    chosen = rows.where(anchors).mapInArrow(quantise, "id long, label long, q array<long>, self long")
    chosen = cut(chosen.withColumn("aid", F.monotonically_increasing_id()), "anchors")
    n, dims = chosen.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    held = candidates.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0))).first()[0]
    blocks = -(-n * max(1, -(-dims // 8)) * 1024 // TABLE_BYTES) or 1
    stripes = max(-(-int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks), held // STRIPE_BYTES + 1)
    more = positives + 1  # the anchor itself may be among them

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def take(state, ids, labels, bits):
            block, best = state
            starts = np.flatnonzero(np.concatenate([[True], labels[1:] != labels[:-1]]))
            for a, z in zip(starts, [*starts[1:], len(labels)]):  # a pack is ordered by label, and so are the anchors
                low, high = np.searchsorted(block.label, labels[a]), np.searchsorted(block.label, labels[a], "right")
                for tile, tables in block.tiles:
                    if low < tile.stop and tile.start < high:
                        same = np.broadcast_to(block.label[tile] == labels[a], (z - a, tile.stop - tile.start))
                        best.add(tables.scores(bits[a:z]), ids[a:z], same, tile)

        def end(state):
            block, best = state
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (block.aid[best.key], best.id, best.score)], ["aid", "id", "score"])

        return streams(batches, lambda block: (block, Best(len(block.id), more)), take, end)

    first = Window.partitionBy("aid").orderBy(F.col("score").desc(), "id")
    met = paired(candidates, packed_anchors(chosen, blocks), blocks, stripes).mapInArrow(near, "aid long, id long, score long")
    top = met.withColumn("r", F.row_number().over(first)).where(F.col("r") <= more).groupBy("aid").agg(F.sort_array(F.collect_list(F.struct("r", F.struct("id", "score").alias("s")))).alias("p"))
    found = F.transform("p", lambda x: x["s"])
    at = F.array_position(found, F.struct("id", F.col("self").alias("score")))  # one row of this id and score is the anchor itself
    others = F.filter(found, lambda x, i: i + 1 != at)
    asked = cut(chosen.join(top, "aid").select("aid", "id", "label", "q", F.slice(others, 1, positives).alias("p")).where(F.size("p") > 0), "anchors-asked")
    drop_table(chosen)

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def start(block):
            p = block.rows.column("p").to_pylist()
            best, top = [], []
            for j in range(positives):
                score = np.array([x[j]["score"] if j < len(x) else 0 for x in p], np.int64)
                none = np.array([j >= len(x) for x in p])
                best.append(Best(len(p), negatives, np.where(none, LONG.max, -(-score * low // 100) - 1)))
                top.append(np.where(none, LONG.min, score * high // 100))
            return block, p, best, top

        def take(state, ids, labels, bits):
            block, _, best, top = state
            for tile, tables in block.tiles:
                scores = tables.scores(bits)
                bounds = np.iinfo(scores.dtype)
                other = labels[:, None] != block.label[tile]
                for b, most in zip(best, top):
                    b.add(scores, ids, other & (scores <= np.clip(most[tile], bounds.min, bounds.max).astype(scores.dtype)), tile)

        def end(state):
            block, p, best, _ = state
            j = np.concatenate([np.full(len(b.key), i) for i, b in enumerate(best)])
            key, negative, score = (np.concatenate([getattr(b, c) for b in best]) for c in ("key", "id", "score"))
            of = [p[k][i] for k, i in zip(key.tolist(), j.tolist())]
            cols = [block.aid[key], block.id[key], j, [x["id"] for x in of], [x["score"] for x in of], negative, score]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["aid", "anchor_id", "j", "positive_id", "positive_score", "negative_id", "negative_score"])

        return streams(batches, start, take, end)

    told = paired(candidates, packed_anchors(asked, blocks), blocks, stripes)
    told = told.mapInArrow(far, "aid long, anchor_id long, j long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("aid", "j").orderBy(F.col("negative_score").desc(), "negative_id"))
    return told.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(embeddings: DataFrame) -> DataFrame:
    """The contract's table: labels of ids divisible by 7 go one on, modulo ten; anchors are the ids divisible by 50."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = need(embeddings, "vec_id", "label", "embedding").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives(rows, F.col("id") % 50 == 0)
