"""Near-duplicate passages by compact windows.

A text is the sequence of its five-word shingles. For each hash function every shingle that is the smallest
of some run of at least ``SPAN`` shingles has one compact window: the widest run in which it stays the
smallest. The windows are the nodes of the Cartesian tree over the hashes, cut off below the span, and every
run of that length shares its min-hash with exactly one of them; so two passages whose min-hashes agree meet
in the join on (hash function, smallest hash). Windows that meet are joined as intervals around their common
shingle, the intervals of a pair of documents are merged, and the words inside are compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.llm.arrow import SLICE_BYTES, mixed, rolled, slices, words
from calibrant.llm.common import LOWEST, SPACE, cut, drop_table, filled, need

SHINGLE, SIMILARITY = 5, 0.8
MIN_WORDS = 50
SPAN = MIN_WORDS - SHINGLE + 1
HASHES = 4
FUNCTIONS = 3  # the bits of a key that tell its hash function
PLACES = 1 << 20  # places of shingles that vote on a shift at a time
OFTEN = 1 << 11  # votes of a shingle that are worth a pass of their own
CORRELATE = 8  # votes for each place of a correlation that cost as much as it does
MISS = 8  # 8 of 9 matching shingles on both sides are a Jaccard similarity of 0.8


def document_key() -> list[Column]:
    """What tells documents apart: rows alike in id and text are one document, listed again."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("k1"), F.xxhash64(F.col("text"), F.col("doc_id").isNull()).alias("k2")]


def _slide(x: np.ndarray, width: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) of each run of ``width`` values."""
    have = 1
    while have * 2 <= width:
        x = least(x[: len(x) - have], x[have:])
        have *= 2
    return least(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def _nearest(value: np.ndarray, step: int, beyond) -> np.ndarray:
    """For each value that isn't 0 the place of the first one in the direction ``step`` that isn't ``beyond`` it; a 0 never is.

    A place that is beyond is left for the one that it points to itself: what lies between is beyond it, and so beyond
    the value too. All values step at once, and those that arrived rest."""
    to = np.clip(np.arange(len(value)) + step, 0, len(value) - 1)
    go = np.flatnonzero(value)
    while len(go := go[beyond(value[to[go]], value[go])]):
        to[go] = to[to[go]]
    return to


def compact_windows(values: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """left, centre, right (all inclusive) of the compact windows of at least ``span`` values.

    ``values`` starts and ends with 0, which also parts texts and stays out of windows; of equal values the
    first is the smallest. Only values that are the smallest of some full run can be such centres, and the
    nearest smaller values around one are themselves of that kind, so these are sought among them alone.
    """
    if len(values) < span + 2:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    low = _slide(values, span, np.minimum)
    edge = np.zeros(span - 1, values.dtype)
    opened = _slide(np.concatenate([edge, low, edge]), span, np.maximum)
    at = np.flatnonzero((opened == values) | (values == 0))
    value = values[at]
    left, right = at[_nearest(value, -1, np.greater)] + 1, at[_nearest(value, 1, np.greater_equal)] - 1
    wide = (value != 0) & (right - left + 1 >= span)
    return left[wide], at[wide], right[wide]


def _values(shingles: np.ndarray, f: int) -> np.ndarray:
    """The shingles under hash function ``f``; never 0."""
    return np.maximum(mixed(shingles + np.uint64(0x9E3779B97F4A7C15 * (f + 1) & (1 << 64) - 1)), 1)


def _counted(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each length, one after the other."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _word_hashes(dictionary: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)), np.uint64, len(dictionary))


WINDOWS = "key long, k1 long, k2 long, lo int, at int, hi int"
WHOLE = -1  # ``at`` of the row that stands for a whole text
POINTS = 100  # windows of each range that tell where ranges end
SAMPLE = 1 / 64  # the documents whose windows are asked for them


PLACE = ("key", "k1", "k2", "at")  # the order in which windows meet
#: A window as bytes that sort in that order (the highest bit of each number but the last is turned): one value a row for shuffles, sorts and Arrow.
PACKED = np.dtype([("key", ">u8"), ("k1", ">u8"), ("k2", ">u8"), ("at", ">u4"), ("lo", ">u4"), ("hi", ">u4"), ("inside", "u1")])


def packed(key: np.ndarray, k1: np.ndarray, k2: np.ndarray, lo: np.ndarray, at: np.ndarray, hi: np.ndarray, inside: np.ndarray | bool = False) -> pa.Array:
    """Windows as PACKED bytes."""
    out = np.empty(len(key), PACKED)
    for c, x in (("key", key), ("k1", k1), ("k2", k2)):
        out[c] = x.view(np.uint64) ^ np.uint64(1 << 63)
    for c, x in (("lo", lo), ("at", at), ("hi", hi)):
        out[c] = x.astype(np.int32).view(np.uint32) ^ np.uint32(1 << 31)
    out["inside"] = inside
    ends = np.arange(len(key) + 1, dtype=np.int32) * PACKED.itemsize
    return pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(ends), pa.py_buffer(out)])


def unpacked(places: pa.Array) -> dict[str, np.ndarray]:
    """The columns of :func:`packed` windows."""
    fixed = places.cast(pa.binary(PACKED.itemsize))
    rows = np.frombuffer(fixed.buffers()[1], PACKED, len(fixed), fixed.offset * PACKED.itemsize)
    long = {c: (rows[c].astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64) for c in ("key", "k1", "k2")}
    return long | {c: (rows[c].astype(np.uint32) ^ np.uint32(1 << 31)).view(np.int32) for c in ("lo", "at", "hi")} | {"inside": rows["inside"].astype(bool)}


def range_ends(wins: DataFrame, n: int) -> np.ndarray:
    """The places (PLACE by column) at which the ranges of ``wins`` but the last end, for ``n`` ranges of about equal size, from some POINTS of each."""
    wins = cut(wins.select(*PLACE), "passage-sample")
    seen = wins.sample(min(1.0, n * POINTS / max(wins.count(), 1)), seed=1).toPandas().sort_values(list(PLACE)).to_numpy(np.int64).reshape(-1, len(PLACE))
    drop_table(wins)
    return np.unique(seen[len(seen) * np.arange(1, n) // n], axis=0) if len(seen) else seen


def range_numbers(places: list[np.ndarray], ends: np.ndarray) -> np.ndarray:
    """How many of ``ends`` are below each row, whose ``places`` are arrays by column of PLACE: the number of its range."""
    number, upto = (np.searchsorted(ends[:, 0], places[0], side) for side in ("left", "right"))
    tied = np.flatnonzero(number < upto)  # ranges end within these keys
    first, last = number[tied], upto[tied]
    for i in np.unique(np.concatenate([np.arange(x, y) for x, y in set(zip(first.tolist(), last.tolist()))])) if len(tied) else ():
        rows = tied[(first <= i) & (i < last)]
        above = np.zeros(len(rows), bool)
        for x, end in zip(places[:0:-1], ends[i, :0:-1]):
            above = (x[rows] > end) | (x[rows] == end) & above
        number[rows] += above
    return number


def windows(docs: DataFrame, hashes: int = HASHES, span: int = SPAN, ends: np.ndarray | None = None) -> DataFrame:
    """key (the smallest hash, the number of its function in the lowest bits), document key, and lo, at, hi (shingle
    numbers) of each compact window; with ``ends`` as place (:func:`packed`) and part, the number of its range.

    Each text with a word also has one row for itself: at WHOLE, key and hi a hash of all of its words in order (95
    bits), lo their number.
    """

    kinds = WINDOWS if ends is None else "place binary, part int"
    names = [c.split(" ")[0] for c in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            codes, dictionary, offsets = words(pc.ascii_lower(b.column("text")))
            hashed = _word_hashes(dictionary)[codes]
            starts, n = offsets[:-1], np.maximum(np.diff(offsets) - SHINGLE + 1, 0)

            k1, k2 = (b.column(c).to_numpy() for c in ("k1", "k2"))

            def out(key: np.ndarray, doc: np.ndarray, *places: np.ndarray) -> pa.RecordBatch:
                columns = [key.view(np.int64), k1[doc], k2[doc], *[x.astype(np.int32) for x in places]]
                if ends is not None:
                    columns = [packed(*columns), range_numbers([*columns[:3], columns[4]], ends).astype(np.int32)]
                return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names)

            some = np.flatnonzero(np.diff(offsets))
            if not len(some):
                continue
            number = mixed(np.arange(len(hashed)) - np.repeat(starts, np.diff(offsets)) + 1)
            one, two = (mixed(np.add.reduceat(mixed(hashed * np.uint64(m) + number), starts[some])) for m in (3, 5))
            yield out(one, some, np.diff(offsets)[some], np.full(len(some), WHOLE), (two >> np.uint64(33)).astype(np.int64))
            shingles = rolled(hashed, SHINGLE)
            # texts one after the other, a 0 before each and one at the end
            n_all = int(n.sum()) + len(n) + 1
            begin = np.concatenate([[0], np.cumsum(n + 1)])
            owner = np.repeat(np.arange(len(n)), n)
            within = _counted(n)
            source = shingles[starts[owner] + within] if len(owner) else np.zeros(0, np.uint64)
            target = begin[owner] + 1 + within
            for f in range(hashes):
                values = np.zeros(n_all, np.uint64)
                values[target] = _values(source, f)
                left, centre, right = compact_windows(values, span)
                if not len(centre):
                    continue
                doc = np.searchsorted(begin, centre, side="right") - 1
                first = begin[doc] + 1
                yield out(values[centre] & ~np.uint64(FUNCTIONS) | np.uint64(f), doc, *[x - first for x in (left, centre, right)])

    return docs.select(*document_key(), filled("text").alias("text")).mapInArrow(run, kinds)


LEADER = ("k1", "k2", "lo", "at", "hi")
MET = WINDOWS + ", inside boolean, edge boolean, block int, " + ", ".join(f"f_{c} {'long' if c[0] == 'k' else 'int'}" for c in LEADER) + ", whole boolean"
BLOCK = 512  # windows of a key that share a copy of its first one's text


def met_in_order(wins: DataFrame) -> DataFrame:
    """Each of the :func:`packed` windows (place) that meets the first of its key (f_...) from another document; whole texts alike (``whole``, by
    which the table is parted).

    The windows are dealt out by ranges of key and document (those of ``part``, where they have one) and sorted, so that a hot key spans several tasks
    and each streams its rows. Rows that are ``inside`` lead others, and don't come out themselves. Where a key crosses from one task to the next, each task takes its own first,
    which then gives way to the first of the key: two keys a task at most are broadcast for that. ``block`` parts the windows of a key into bounded lots.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, key_now, number, opening = None, None, 0, True
        for b in batches:
            if not b.num_rows:
                continue
            col = unpacked(b.column("place"))
            key, inside = col["key"], col["inside"]
            rows = np.arange(len(key))
            start = np.concatenate([[leader is None or key[0] != key_now], key[1:] != key[:-1]])
            index = np.maximum.accumulate(np.where(start, rows, -1))  # -1: the group of the last batch
            first = {c: np.where(index < 0, leader[c] if leader else 0, col[c][np.maximum(index, 0)]) for c in LEADER}
            show = (col["k1"] != first["k1"]) | (col["k2"] != first["k2"])  # a text that repeats itself isn't its own copy
            place = np.where(index < 0, rows + number, rows - index)
            group = np.cumsum(start)
            group -= group[0]
            whole = col["at"] == WHOLE  # the rest of the hash and the number of words tell too
            show &= np.where(whole, (first["at"] == WHOLE) & (col["hi"] == first["hi"]) & (col["lo"] == first["lo"]), first["at"] != WHOLE)
            show &= ~inside
            edge = np.zeros(len(key), bool)
            if opening:  # the first of the task's first key, with all its windows
                edge = (group == 0) & (col["k1"] == col["k1"][0]) & (col["k2"] == col["k2"][0])
                show |= edge
                opening = False
            columns = [*[pa.array(col[c][show]) for c in ("key", *LEADER)], pa.array(inside[show]), pa.array(edge[show]), pa.array((place[show] // BLOCK).astype(np.int32)), *[pa.array(first[c][show]) for c in LEADER], pa.array(whole[show])]
            yield pa.RecordBatch.from_arrays(columns, names)
            leader, key_now, number = {c: first[c][-1] for c in LEADER}, key[-1], int(place[-1]) + 1
        if leader is not None:  # the first of the task's last key, to lead alone
            own = [pa.array([leader[c]], kinds[c]) for c in LEADER]
            yield pa.RecordBatch.from_arrays([pa.array([key_now], pa.int64()), *own, pa.array([True]), pa.array([True]), pa.array([0], pa.int32()), *own, pa.array([bool(leader["at"] == WHOLE)])], names)

    names = ["key", *LEADER, "inside", "edge", "block", *[f"f_{c}" for c in LEADER], "whole"]
    kinds = {c: pa.int64() if c[0] == "k" else pa.int32() for c in LEADER}
    n = int(wins.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = wins.repartitionById(n, "part").drop("part") if "part" in wins.columns else wins.repartitionByRange(n, "place")
    met = cut(dealt.sortWithinPartitions("place").mapInArrow(run, MET), "passage-met", by=("whole",))
    edges = met.where("edge").select("key", *LEADER, "inside").distinct()
    first = edges.groupBy("key").agg(F.min(F.struct("k1", "k2", "at", "lo", "hi")).alias("f"))  # two keys a task at most
    crossed = edges.where("not inside").select("key", *LEADER, "inside", F.lit(0).alias("block"), *[F.col(c).alias(f"f_{c}") for c in LEADER], (F.col("at") == WHOLE).alias("whole"))
    rows = met.where("not edge").drop("edge").unionByName(crossed).join(F.broadcast(first), "key", "left")
    told = rows.select("whole", "key", *LEADER, "block", *[F.coalesce(F.col(f"f.{c}"), F.col(f"f_{c}")).alias(f"f_{c}") for c in LEADER]).where(F.struct("k1", "k2") != F.struct("f_k1", "f_k2"))
    both, same = (F.col("at") == WHOLE).cast("int") + (F.col("f_at") == WHOLE).cast("int"), F.struct("lo", "hi") == F.struct("f_lo", "f_hi")
    return told.where((both == 0) | (both == 2) & same)


def _segments(hit: np.ndarray, span: int) -> list[tuple[int, int]]:
    """The longest runs [a, b) of at least ``span`` in which 8 of 9 shingles match, ends trimmed.

    With 1 for a hit and -MISS for a miss these are the longest runs whose sum isn't negative; what is left on both
    sides is searched again. Ends are trimmed to the part with the largest surplus of hits over misses,
    or to the outermost hits where less than ``span`` would be left.
    """
    out, todo = [], [(0, len(hit))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < span or np.count_nonzero(hit[lo:hi]) < span * MISS // (MISS + 1):
            continue
        total = np.concatenate([[0], np.cumsum(np.where(hit[lo:hi], 1, -MISS))])
        start = np.searchsorted(-np.minimum.accumulate(total), -total)  # first place that isn't above each place
        length = np.arange(len(total)) - start
        end = int(np.argmax(length))
        if length[end] < span:
            continue
        a, b = lo + int(start[end]), lo + end
        todo += [(lo, a), (b, hi)]
        surplus = np.concatenate([[0], np.cumsum(np.where(hit[a:b], 1, -1))])
        low = np.minimum.accumulate(surplus)
        z = int(np.argmax(surplus - low))
        p, q = a + int(np.argmin(surplus[: z + 1])), a + z
        if q - p < span:  # a change near an end: out to the last hits
            hits = np.flatnonzero(hit[a:b])
            p, q = a + int(hits[0]), a + int(hits[-1]) + 1
        out.append((p, q))
    return out


def sorted_places(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The places of the shingles ``b`` ordered by (shingle, place), the shingles so ordered, where each one's equals end,
    and a number of each that grows with both, so that the place nearest to a given one is a search."""
    order = np.argsort(b, kind="stable")
    ordered = b[order]
    kind = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]))
    return order, ordered, np.concatenate([np.flatnonzero(np.diff(kind)) + 1, [len(b)]])[kind], kind * (2 * len(b)) + order


def shift_votes(at: np.ndarray, first: np.ndarray, count: np.ndarray, order: np.ndarray, zero: int) -> np.ndarray:
    """How many of the places order[first : first + count] of each shingle lie each shift from its own place ``at``; shift 0 is
    entry ``zero``. Places vote a bounded number at a time: those of a shingle with more votes than shifts as differences of its places on both
    sides, or by their correlation where that costs less; the others all together."""
    size = zero + len(order) + 1
    votes = np.zeros(size, np.int64)
    n = 1 << int(2 * size).bit_length()
    if int(count.sum()) <= max(OFTEN, size):
        own = np.arange(len(at))
    else:
        by = np.argsort(first, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], np.diff(first[by]) != 0]))
        each = np.add.reduceat(count[by], begin)  # votes of each shingle
        often = each > max(OFTEN, size)
        own = by[np.repeat(~often, np.diff(begin, append=len(by)))]
        for i in np.flatnonzero(often).tolist():
            mine = by[begin[i] : begin[i + 1] if i + 1 < len(begin) else len(by)]
            places, mine = order[first[mine[0]] : first[mine[0]] + count[mine[0]]], at[mine]
            if each[i] > CORRELATE * n:
                x, y = np.zeros(n), np.zeros(n)
                x[mine] = 1
                y[places] = 1
                both = np.rint(np.fft.irfft(np.fft.rfft(y) * np.conj(np.fft.rfft(x)), n)).astype(np.int64)
                votes[zero:] += both[: size - zero]
                votes[:zero] += both[n - zero :] if zero else 0
            else:
                rows = max(PLACES // len(places), 1)
                for k in range(0, len(mine), rows):
                    votes += np.bincount(np.subtract.outer(places + zero, mine[k : k + rows]).ravel(), minlength=size)
    for i, j in _slices_of(count[own], PLACES):
        some = own[i:j]
        m = count[some]
        votes += np.bincount(order[np.repeat(first[some], m) + _counted(m)] - np.repeat(at[some], m) + zero, minlength=size)
    return votes


def similar_runs(a: np.ndarray, b: np.ndarray, span: int = SPAN, similarity: float = SIMILARITY, places: tuple | None = None) -> list[tuple[int, int, int, int, float]]:
    """Runs of shingles of ``a`` and ``b`` of at least ``span`` whose sets have that Jaccard similarity."""
    order, ordered, ends, line = places or sorted_places(b)
    first = np.minimum(np.searchsorted(ordered, a), len(b) - 1)
    hits = ordered[first] == a
    if np.count_nonzero(hits) < span * MISS // (MISS + 1):
        return []
    last = np.where(hits, ends[first], first)
    out = []

    def nearest(at: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Of the places in b of each shingle a[at], the one nearest to ``to``."""
        out = order[first[at]]
        many = np.flatnonzero(last[at] - first[at] > 1)
        if len(many):
            f, n, near = first[at[many]], last[at[many]], to[many]
            spot = np.searchsorted(line, line[f] - order[f] + np.clip(near, 0, len(b)))
            low, high = order[np.maximum(spot - 1, f)], order[np.minimum(spot, n - 1)]
            out[many] = np.where(np.abs(low - near) <= np.abs(high - near), low, high)
        return out

    def beside(at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the shingles a[at] lie along the shift where most of them agree, and their places in b.

        All places of all of them vote on the shift, with room for words put in or left out.
        """
        count, room = last[at] - first[at], int(0.25 * length + SHINGLE)
        single = count == 1
        if 2 * np.count_nonzero(single) >= len(at):  # those with one place agree: no other places need be tried
            own = (order[first[at]] - at)[single]
            low = own.min()
            if own.max() - low <= room:
                other = nearest(at, at + low + np.argmax(np.bincount(own - low)))
                return (other - at >= low) & (other - at <= low + room), other
        votes = shift_votes(at, first[at], count, order, len(a))
        upto = np.concatenate([[0], np.cumsum(votes)])
        ends = np.minimum(np.arange(len(votes)) + room + 1, len(votes))
        best = int(np.argmax(np.where(votes > 0, upto[ends] - upto[:-1], -1)))
        peak = best + int(np.argmax(votes[best : best + room + 1]))
        low = best - len(a)
        other = nearest(at, at + peak - len(a))
        return (other - at >= low) & (other - at <= low + room), other

    todo = [(0, hits)]
    while todo:
        zero, hit = todo.pop()
        for p, q in _segments(hit, span):
            i, j, part = zero + p, zero + q, hit[p:q]
            if j - i < span:
                continue
            at = i + np.flatnonzero(part)
            near, other = beside(at, j - i)
            k, m = int(other[near].min()), int(other[near].max()) + 1
            x, y = np.unique(a[i:j]), np.unique(b[k:m])
            both = len(np.intersect1d(x, y, assume_unique=True))
            s = both / (len(x) + len(y) - both)
            if s >= similarity and m - k >= span * similarity:
                out.append((i, j, k, m, s))
            elif near.all():  # unbroken runs within
                runs = np.flatnonzero(np.diff(np.concatenate([[0], part.astype(np.int8), [0]]))).reshape(-1, 2).tolist()
                todo += [(i + u, np.ones(v - u, bool)) for u, v in runs if span <= v - u < j - i]
            else:  # what lies along this shift, and what doesn't
                along = np.zeros(j - i, bool)
                along[at[near] - i] = True
                todo += [(i, along), (i, part & ~along)]
    return out


ASKED = "k1 long, k2 long, a_lo int, a_hi int, o1 long, o2 long, b_lo int, b_hi int, block int, text binary"
FOUND = "k1 long, k2 long, start int, end int, o1 long, o2 long, o_start int, o_end int, similarity double"
STEP = 32  # places of an earlier document's regions are multiples, so that it has few different ones
PAIR = ("o1", "o2", "b_lo", "b_hi", "block")


REGIONS = "k1 long, k2 long, a_lo int, a_hi int, o1 long, o2 long, b_lo int, b_hi int, block int"


def regions(met: DataFrame, agree: int = 1) -> DataFrame:
    """Regions (shingles a_lo..a_hi of k1, k2 and b_lo..b_hi of o1, o2) around windows that met, as intervals along one
    shift joined where they overlap, for pairs of documents that met under at least ``agree`` hash functions. One exchange,
    by document, whose windows are bounded by its length."""
    reach = lambda n: (n * 1.25 + 8).cast("int")  # noqa: E731  room for words put in or left out
    each = met.select(
        "k1", "k2", F.col("f_k1").alias("o1"), F.col("f_k2").alias("o2"), "block", F.expr(f"shiftleft(1, cast(key & {FUNCTIONS} as int))").alias("functions"), F.floor((F.col("f_at") - F.col("at")) / STEP).alias("shift"),
        F.greatest(F.col("lo"), F.col("at") - reach(F.col("f_at") - F.col("f_lo"))).alias("a_lo"), F.least(F.col("hi"), F.col("at") + reach(F.col("f_hi") - F.col("f_at"))).alias("a_hi"),
        F.greatest(F.col("f_lo"), F.col("f_at") - reach(F.col("at") - F.col("lo"))).alias("b_lo"), F.least(F.col("f_hi"), F.col("f_at") + reach(F.col("hi") - F.col("at"))).alias("b_hi"),
    )
    order = ("k1", "k2", "o1", "o2", "shift", "a_lo", "a_hi")
    given = each.columns
    dealt = each.repartition("k1", "k2").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the last document so far
        for b in batches:
            if not b.num_rows:
                continue
            k1, k2 = b.column("k1").to_numpy(), b.column("k2").to_numpy()
            whole = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))
            if held and (held[-1].column("k1")[-1], held[-1].column("k2")[-1]) != (b.column("k1")[0], b.column("k2")[0]):
                yield joined(held)
                held = []
            if len(whole):
                yield joined([*held, b.slice(0, int(whole[-1]) + 1)])
                held = []
            held.append(b.slice(int(whole[-1]) + 1 if len(whole) else 0))
        if held:
            yield joined(held)

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        col = {c: np.concatenate([b.column(c).to_numpy() for b in parts]) for c in given}
        parted = lambda names: np.concatenate([[True], np.any([col[c][1:] != col[c][:-1] for c in names], axis=0)])
        pair = np.flatnonzero(parted(order[:4]))
        agreed = np.bitwise_count(np.bitwise_or.reduceat(col["functions"], pair)) >= agree
        col = {c: x[np.repeat(agreed, np.diff(pair, append=len(x)))] for c, x in col.items()}
        if not len(col["k1"]):
            return pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], names)
        along = parted(order[:5])
        reached = np.maximum.accumulate(col["a_hi"] + (np.cumsum(along) << 32))  # a group's places are above those of the one before
        along[1:] |= col["a_lo"][1:] + (np.cumsum(along)[1:] << 32) > reached[:-1]
        island = np.flatnonzero(along)
        least, most = ({c: np.minimum.reduceat(col[c], island) for c in ("a_lo", "b_lo", "block")}, {c: np.maximum.reduceat(col[c], island) for c in ("a_hi", "b_hi")})
        places = least | most | {c: col[c][island] for c in order[:4]}
        places |= {"b_lo": places["b_lo"] // STEP * STEP, "b_hi": -(-(places["b_hi"] + 1) // STEP) * STEP - 1}
        return pa.RecordBatch.from_arrays([pa.array(places[c], k) for c, k in zip(names, kinds)], names)

    names = [c.split(" ")[0] for c in REGIONS.split(", ")]
    kinds = [pa.int64() if c.endswith("long") else pa.int32() for c in REGIONS.split(", ")]
    return dealt.mapInArrow(run, REGIONS).distinct()


def verified(pairs: DataFrame, docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Compare the words of the :func:`regions` in ``pairs``.

    The regions are written, as both sides ask for their words at once: the texts are shuffled a single time and cut down to
    the regions asked for where they meet the requests. The slices then meet on the earlier document's region and its block, so that a region
    with any number of partners is spread over tasks of BLOCK windows' partners each.
    """
    pairs = cut(pairs, "passage-regions")
    none = F.lit(None).cast("int")
    asks = F.struct("a_lo", "a_hi", *PAIR)
    mine = pairs.select("k1", "k2", asks.alias("ask"))
    theirs = pairs.select(*PAIR).distinct().select(F.col("o1").alias("k1"), F.col("o2").alias("k2"), F.struct(none.alias("a_lo"), none.alias("a_hi"), *PAIR).alias("ask"))
    asked = mine.unionByName(theirs).groupBy("k1", "k2").agg(F.collect_list("ask").alias("asks"))
    texts = docs.select(*document_key(), filled("text").alias("text"))
    told = texts.hint("merge").join(asked, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("k1", "k2", "text", "asks")
    names = [c.split(" ")[0] for c in ASKED.split(", ")]

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            asks = dict(zip(names[2:-1], b.column("asks").flatten().flatten()))
            doc = np.repeat(np.arange(b.num_rows), np.asarray(pc.list_value_length(b.column("asks"))))
            of = b.column("text").cast(pa.large_binary())
            lo, hi = (pc.coalesce(asks[f"a_{c}"], asks[f"b_{c}"]).to_numpy().tolist() for c in ("lo", "hi"))

            def out(texts: list[bytes], upto: int) -> pa.RecordBatch:
                some = slice(upto - len(texts), upto)
                rows = pa.array(doc[some])
                return pa.RecordBatch.from_arrays([b.column("k1").take(rows), b.column("k2").take(rows), *[asks[c][some] for c in names[2:-1]], pa.array(texts, pa.binary())], names)

            now, split, texts, held = -1, [], [], 0
            for i, d in enumerate(doc.tolist()):
                if d != now:
                    now, split = d, of[d].as_py().split()  # bytes part at ASCII white space alone, as SPACE does
                texts.append(b" ".join(split[lo[i] : hi[i] + SHINGLE]))
                held += len(texts[-1])
                if held > SLICE_BYTES:
                    yield out(texts, i + 1)
                    texts, held = [], 0
            if texts:
                yield out(texts, len(doc))

    slices_ = told.mapInArrow(sliced, ASKED)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # comparing costs more than its bytes tell
    ordered = slices_.repartition(n, *PAIR).sortWithinPartitions(*PAIR, F.col("a_lo").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theirs, places = np.zeros(0, np.uint64), None
        for batch in slices(batches):
            codes, dictionary, offsets = words(pc.ascii_lower(batch.column("text").cast(pa.string())))
            shingles = rolled(_word_hashes(dictionary)[codes], SHINGLE)
            ends = np.maximum(offsets[1:] - SHINGLE + 1, offsets[:-1]).tolist()
            rows = []
            for k1, k2, at, _, o1, o2, b_lo, _, _, start, end in zip(*(batch.column(c).to_pylist() for c in names[:-1]), offsets.tolist(), ends):
                a = shingles[start:end]
                if at is None:  # the earlier document's region leads its partners
                    theirs = a
                    places = sorted_places(theirs) if len(theirs) else None
                    continue
                if len(a) and len(theirs):
                    rows += [(k1, k2, at + i, at + j + SHINGLE - 1, o1, o2, b_lo + k, b_lo + m + SHINGLE - 1, s) for i, j, k, m, s in similar_runs(a, theirs, span, places=places)]
            if rows:
                columns = zip(*rows)
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split(" ")[0] for f in FOUND.split(", ")])

    return ordered.mapInArrow(run, FOUND).distinct()


def _slices_of(counts: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``size`` items, one row at least."""
    start, held = 0, 0
    for i, n in enumerate(counts.tolist()):
        if held + n > size and i > start:
            yield start, i
            start, held = i, 0
        held += n
    if len(counts):
        yield start, len(counts)


WINDOWS_AT_ONCE = 1 << 14


def _found_spans(found: DataFrame) -> DataFrame:
    """k1, k2 and spans: the passages found in each document, and which of them are equal to an earlier document's."""
    return found.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end", (F.col("similarity") == 1).alias("same"))).alias("spans"))


def within_spans(spans: pa.Array, doc: np.ndarray, lo: np.ndarray, at: np.ndarray, hi: np.ndarray, span: int) -> np.ndarray:
    """Which windows (of the texts numbered ``doc``) lie in one of the ``spans`` of their text: a whole run of words with all of its words, others
    with the place of their shingle."""
    end = np.where((at == lo) & (hi - lo == span - 1), hi + SHINGLE, at + 1)
    of = np.repeat(np.arange(len(spans)), np.asarray(pc.fill_null(pc.list_value_length(spans), 0)))
    if not len(of):
        return np.zeros(len(doc), bool)
    begin, stop = (x.to_numpy(zero_copy_only=False).astype(np.int64) + (of << 32) for x in spans.flatten().flatten()[:2])
    order = np.argsort(begin, kind="stable")
    reached = np.maximum.accumulate(stop[order])  # a text's places are above those of the one before
    before = np.searchsorted(begin[order], at + (doc << 32), "right") - 1
    return (before >= 0) & (reached[np.maximum(before, 0)] >= end + (doc << 32))


JOINED = "place binary, k1 long, k2 long, lo int, hi int"


def agreeing(met: DataFrame, found: DataFrame, hashes: int = HASHES, span: int = SPAN) -> DataFrame:
    """Interval joins of the windows of ``met`` within each document, as windows under pair keys: runs whose windows of
    two functions both have other holders (place, :func:`packed`). And rows without a place: the runs lo..hi of k1, k2 for
    which that is so of all functions, as it is of every run that another document holds unchanged. What lies in a passage that was found is ``inside``.

    Runs in a passage equal to an earlier document's are left out: that document's own runs stand for them.
    """
    window = lambda f: F.struct("key", *[F.col(f + c).alias(c) for c in ("lo", "at", "hi")]).alias("w")
    members = met.select("k1", "k2", window(""))
    held = members.unionByName(met.select(F.col("f_k1").alias("k1"), F.col("f_k2").alias("k2"), window("f_"))).groupBy("k1", "k2").agg(F.collect_set("w").alias("ws"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.asarray(pc.list_value_length(batch.column("ws")))
            for i, j in _slices_of(counts, WINDOWS_AT_ONCE):
                yield from joined(batch.slice(i, j - i))

    def joined(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        parts = dict(zip(("key", "lo", "at", "hi"), b.column("ws").flatten().flatten()))
        key = parts["key"].to_numpy()
        lo, at, hi = (parts[c].to_numpy().astype(np.int64) for c in ("lo", "at", "hi"))
        doc = np.repeat(np.arange(b.num_rows), np.asarray(pc.list_value_length(b.column("ws"))))
        first, last = np.maximum(lo, at - (span - 1)), np.minimum(at, hi - (span - 1))
        size = np.zeros(b.num_rows, np.int64)
        np.maximum.at(size, doc, last + 2)  # one place beyond the runs parts documents
        zero = np.cumsum(size) - size
        total = int(size.sum())
        spans = b.column("spans")
        of = np.repeat(np.arange(b.num_rows), np.asarray(pc.fill_null(pc.list_value_length(spans), 0)))
        equal = np.zeros(total + 1, np.int64)
        begin, end, same = (x.to_numpy(zero_copy_only=False) for x in spans.flatten().flatten())
        of, begin, end = of[same], begin[same].astype(np.int64), end[same].astype(np.int64)
        stop = np.minimum(np.maximum(end - (span + SHINGLE - 1) + 1, begin), size[of])
        begin = np.minimum(begin, size[of])
        np.add.at(equal, zero[of] + begin, 1)
        np.add.at(equal, zero[of] + np.maximum(stop, begin), -1)
        free = np.cumsum(equal[:-1]) == 0
        which = np.full((hashes, total), -1, np.int32)
        for f in range(hashes):
            own = np.flatnonzero((key & FUNCTIONS) == f)
            n = last[own] - first[own] + 1
            which[f, np.repeat((zero[doc] + first)[own], n) + _counted(n)] = np.repeat(own, n)

        def starts(ok: np.ndarray, *same: np.ndarray) -> np.ndarray:
            new = ok.copy()
            still = ok[1:] & ok[:-1]
            for x in same:
                still &= x[1:] == x[:-1]
            new[1:] &= ~still
            return np.flatnonzero(new)

        k1, k2 = (b.column(c).to_numpy() for c in ("k1", "k2"))
        for f in range(hashes):
            for g in range(f + 1, hashes):
                x, y = which[f], which[g]
                at_runs = starts((x >= 0) & (y >= 0) & free, x, y)
                x, y = x[at_runs], y[at_runs]
                keys = mixed(mixed(key[x].view(np.uint64)) + key[y].view(np.uint64) * np.uint64(3)).view(np.int64)
                rows, places = doc[x], (np.maximum(lo[x], lo[y]), at[x], np.minimum(hi[x], hi[y]))
                place = packed(keys, k1[rows], k2[rows], *places, within_spans(spans, rows, *places, span))
                yield pa.RecordBatch.from_arrays([place, *[pa.nulls(len(rows), k) for k in kinds]], names)
        full = (which >= 0).all(axis=0) & free
        a = starts(full)
        z = np.flatnonzero(full & ~np.concatenate([full[1:], [False]]))
        rows = doc[which[0][a]]
        columns = [k1[rows], k2[rows], a - zero[rows], z - zero[rows]]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.binary()), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names)

    names, kinds = [c.split(" ")[0] for c in JOINED.split(", ")], [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return held.hint("merge").join(_found_spans(found), ["k1", "k2"], "left").select("k1", "k2", "ws", "spans").mapInArrow(run, JOINED)


def whole_runs(ranges: DataFrame, found: DataFrame, docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Windows (place, :func:`packed`) of exactly ``span`` shingles for the runs lo..hi of each document, keyed by the hash of all their words; those
    in a passage that was found are ``inside``."""
    at = ranges.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")).hint("merge").join(_found_spans(found), ["k1", "k2"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            codes, dictionary, offsets = words(pc.ascii_lower(b.column("text")))
            runs = rolled(_word_hashes(dictionary)[codes], span + SHINGLE - 1)
            lo, hi = (x.to_numpy().astype(np.int64) for x in b.column("ranges").flatten().flatten())
            doc = np.repeat(np.arange(b.num_rows), np.asarray(pc.list_value_length(b.column("ranges"))))
            n = hi - lo + 1
            place, doc = np.repeat(lo, n) + _counted(n), np.repeat(doc, n)
            places = (place, place, place + span - 1)
            inside = within_spans(b.column("spans"), doc, *places, span)
            k1, k2 = (b.column(c).to_numpy()[doc] for c in ("k1", "k2"))
            yield pa.RecordBatch.from_arrays([packed(runs[offsets[doc] + place], k1, k2, *places, inside)], ["place"])

    texts = docs.select(*document_key(), filled("text").alias("text"))
    return texts.hint("merge").join(at, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("k1", "k2", "text", "ranges", "spans").mapInArrow(run, "place binary")


AGREE = 2  # of HASHES functions: 0.973 of the runs of similarity 0.8


def passages(docs: DataFrame, hashes: int = HASHES, span: int = SPAN) -> DataFrame:
    """k1, k2, start, end, o1, o2, o_start, o_end, similarity: passages (word numbers, end excluded) that an
    earlier document holds too: one row per passage, with its earliest holder found.

    Each window meets the first of its key (by document and place): a group of any size costs a row per
    member, never all pairs. A run of SPAN shingles has one key a hash function, so that two runs share each with
    the probability of their similarity; where the windows of AGREE functions that met join as intervals, the words are
    compared. What the first of a key kept from meeting goes on under narrower keys: pairs of smallest hashes
    (:func:`agreeing`), and whole runs of words (:func:`whole_runs`), which no order or company of documents can hide.
    Copies of whole documents are found by digest, and only their first takes part.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = met_in_order(windows(docs, hashes, span, range_ends(windows(docs.sample(SAMPLE, seed=1), hashes, span), n)))
    twins = cut(every.where("whole").select("k1", "k2", F.col("f_k1").alias("o1"), F.col("f_k2").alias("o2"), F.col("lo").alias("n_words")).distinct(), "passage-copies")
    met = cut(every.where("not whole").drop("whole").hint("merge").join(twins.select("k1", "k2"), ["k1", "k2"], "left_anti"), "passage-own")
    drop_table(every)
    found = cut(verified(regions(met, AGREE), docs, span), "passages")
    joined = cut(agreeing(met, found, hashes, span), "passage-agreeing")
    drop_table(met)
    runs = cut(whole_runs(joined.where("place is null"), found, docs, span), "passage-runs")
    missed = met_in_order(joined.where("place is not null").select("place").unionByName(runs))
    drop_table(joined)
    drop_table(runs)
    found = found.unionByName(cut(verified(regions(missed), docs, span), "passages"))
    drop_table(missed)
    whole = twins.where(F.col("n_words") >= MIN_WORDS).select("k1", "k2", F.lit(0).alias("start"), F.col("n_words").alias("end"), "o1", "o2", F.lit(0).alias("o_start"), F.col("n_words").alias("o_end"), F.lit(1.0).alias("similarity"))
    earliest = found.groupBy("k1", "k2", "start", "end").agg(F.min(F.struct("o1", "o2", "o_start", "o_end", "similarity")).alias("o")).select("k1", "k2", "start", "end", "o.*")
    return earliest.unionByName(whole)


def op10_substring(docs: DataFrame) -> DataFrame:
    """One row per passage of at least 50 words that occurs in an earlier document with similarity 0.8 or
    more: doc_id, start_word, end_word (excluded), of_doc_id, of_start, of_end, similarity.

    A document without such a passage has no row. "Earlier" is by doc_id (null first), then text; rows alike in id and
    text are one document. Null and short texts have no passages; other columns are not read.
    """
    docs = need(docs, "doc_id", "text")
    real = lambda c: F.when(F.col(c) != LOWEST, F.col(c))
    return passages(docs).select(
        real("k1").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"),
        real("o1").alias("of_doc_id"), F.col("o_start").alias("of_start"), F.col("o_end").alias("of_end"), F.round("similarity", 6).alias("similarity"),
    )


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def dropped_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words numbered in ``spans`` and the white space after each."""
    gone = set()
    for a, b in spans:
        gone.update(range(a, b))
    out, at = [], 0
    found = list(WORD.finditer(text))
    for i, m in enumerate(found):
        if i in gone:
            out.append(text[at : m.start()])
            at = found[i + 1].start() if i + 1 < len(found) else len(text)
    return "".join([*out, text[at:]])


def dedup_passages(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (row, a struct of all columns) and text without the passages that an earlier
    document holds; see :func:`op10_substring`. Null text stays null."""

    @F.pandas_udf("string")
    def cut_out(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or s is None else dropped_words(t, [(x["a"], x["b"]) for x in s]) for t, s in zip(text, spans)], dtype=object)

    gone = passages(need(docs, "doc_id", "text")).groupBy("k1", "k2").agg(F.collect_set(F.struct(F.col("start").alias("a"), F.col("end").alias("b"))).alias("spans"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *document_key()).join(gone, ["k1", "k2"], "left")
    new = rows.withColumn("new", cut_out(F.when(F.col("spans").isNotNull(), F.col("row.text")), "spans"))
    return new.select("row", F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(F.col("new")).alias("text"))
