"""Order-preserving packing of token streams into windows of at most ``size`` ids.

Documents keep the order of the scan. Within a block of consecutive documents a dynamic programme chooses the
cuts: each window runs between two candidate cuts, costs its padding, and a cut costs nothing at a document's
end, a little at a sentence's end and more elsewhere. The best start of a window is the minimum of
``cost[i] + place[i]`` over the starts still in reach, which a monotone queue gives in constant time.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from calibrant.llm.arrow import slices
from calibrant.llm.common import need

SIZE = 4096
SENTENCE_CUT, HARD_CUT = 8, 64  # costs of a cut inside a document, in padded places
BLOCK = 1 << 20  # ids that a dynamic programme spans, one longer document aside
MARKS = ".,;:!?"
PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]
CONTROL = ("\x1c", "\x1d", "\x1e", "\x1f")  # white space to Python only


class WordIds(dict):
    """Ids of white-space separated chunks under a vocabulary file that ignores white space."""

    def __init__(self, path: str, end_id: int, remember: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.end, self.remember, self.older = struct.pack("<I", end_id), remember, {}
        self.ends = np.zeros(max(self.model.get_vocab_size(), end_id + 1), bool)
        for token, i in self.model.get_vocab().items():
            mark = token.removesuffix("</w>")
            self.ends[i] = any(c in ".!?" for c in mark) and not any(c.isalnum() for c in mark)

    def learn(self, chunks: set[str]) -> None:
        """Encode what is not known yet, in one call of the tokenizer."""
        plain, marked, older = list(MARKS), [], self.older
        for c in chunks.difference(self.keys()):
            if c in older:
                self[c] = older[c]
            elif c[-1] in MARKS and c[:-1].isalpha():  # a word and one mark
                marked.append(c)
                if (bare := c[:-1]) not in self:
                    plain.append(bare)
            else:
                plain.append(c)
        ask = list(dict.fromkeys(plain))
        for c, e in zip(ask, self.model.encode_batch_fast(ask, add_special_tokens=False)):
            ids = e.ids
            self[c] = PACK[len(ids)](*ids) if len(ids) < len(PACK) else struct.pack(f"<{len(ids)}I", *ids)
        for c in marked:
            self[c] = self[c[:-1]] + self[c[-1]]

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with the end id, little-endian unsigned 32-bit."""
        split: list[list[str] | None] = []
        for t in texts:
            if any(c in t for c in CONTROL):
                split.append(None)  # the tokenizer itself, for the whole text
                continue
            if "<|" not in t:
                low = t.lower()
                # lower case may compose with the marks behind it, which the tokenizer does before it lowers
                if t.isascii() or ("Σ" not in t and unicodedata.is_normalized("NFC", t) and unicodedata.is_normalized("NFC", low)):
                    t = low
            split.append(t.split())
        if len(self) > self.remember:
            self.older = dict(self)
            self.clear()
        self.learn(set().union(*[s for s in split if s]))
        out = []
        for t, s in zip(texts, split):
            if s is None:
                ids = self.model.encode(t, add_special_tokens=False).ids
                out.append(struct.pack(f"<{len(ids)}I", *ids) + self.end)
            else:
                out.append(b"".join(map(self.__getitem__, s)) + self.end)
        return out


@lru_cache(2)
def load(path: str, end_id: int) -> WordIds:
    return WordIds(path, end_id)


def _merged(*parts) -> np.ndarray:
    """Sorted, each value once."""
    x = np.sort(np.concatenate([np.asarray(p, np.int64) for p in parts]))
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def candidates(total: int, documents: np.ndarray, sentences: np.ndarray, size: int) -> np.ndarray:
    """Places where a window may end: document and sentence ends, and hard cuts where those are too far apart and near
    the stream's end."""
    step = max(1, size // 16)
    natural = _merged(documents, sentences, [0, total])
    natural = natural[(natural >= 0) & (natural <= total)]
    gaps = np.flatnonzero(np.diff(natural) > size // 4)
    hard = [np.arange(natural[g] + step, natural[g + 1], step) for g in gaps] + [np.arange(total - step, max(0, total - size) - 1, -step)]
    places = _merged(natural, *hard)
    return places[(places >= 0) & (places <= total)]


def cuts(total: int, documents: np.ndarray, sentences: np.ndarray, size: int = SIZE, sentence_cut: float = SENTENCE_CUT, hard_cut: float = HARD_CUT) -> list[int]:
    """Ends of the windows of a stream of ``total`` ids.

    documents, sentences: places (ids before them) where one ends. A window holds ``size`` ids at most and
    is padded to ``size`` unless it holds a power of two of at least a sixteenth of that. It ends at one of :func:`candidates`.
    """
    if not total:
        return []
    places = candidates(total, documents, sentences, size)
    price = np.full(len(places), float(hard_cut))
    price[np.searchsorted(places, sentences)] = sentence_cut
    price[np.searchsorted(places, documents)] = 0
    price[-1] = 0
    exact: dict[int, list[int]] = {}  # windows of a power of two
    power = size // 2
    while power >= max(1, size // 16):
        at = np.searchsorted(places, places - power)
        for j in np.flatnonzero((places >= power) & (places[at] == places - power)).tolist():
            exact.setdefault(j, []).append(int(at[j]))
        power //= 2
    p, pen, n = places.tolist(), price.tolist(), len(places)
    cost, came = [0.0] * n, [0] * n
    queue: deque[int] = deque([0])
    keys = [0.0] * n  # cost + place
    for j in range(1, n):
        here = p[j]
        while here - p[queue[0]] > size:
            queue.popleft()
        i = queue[0]
        best = keys[i] + size - here + pen[j]
        if j in exact:
            for k in exact[j]:
                if (c := cost[k] + pen[j]) < best:
                    best, i = c, k
        cost[j], came[j] = best, i
        key = keys[j] = best + here
        while queue and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    ends, j = [], n - 1
    while j:
        ends.append(p[j])
        j = came[j]
    return ends[::-1]


OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _pack_block(doc_ids: list, ids: list[bytes], ends: np.ndarray, first: int, size: int) -> tuple[pa.RecordBatch, int]:
    stream = b"".join(ids)
    flat = np.frombuffer(stream, "<u4")
    doc_ends = np.cumsum([len(i) // 4 for i in ids])
    doc_starts = np.concatenate([[0], doc_ends[:-1]])
    sentence_ends = np.flatnonzero(ends[flat]) + 1
    window_ends = np.asarray(cuts(len(flat), doc_ends, sentence_ends, size))
    window_starts = np.concatenate([[0], window_ends[:-1]])
    stops = _merged(doc_ends, window_ends)
    starts = np.concatenate([[0], stops[:-1]])
    doc = np.searchsorted(doc_ends, starts, side="right")
    window = np.searchsorted(window_ends, starts, side="right")
    view = memoryview(stream)
    crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist())]
    owner = pa.array(doc_ids, pa.int64()).take(pa.array(doc))
    columns = [owner, starts - doc_starts[doc], stops - starts, crc, (doc_ends - doc_starts)[doc], first + window, starts - window_starts[window]]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) if not isinstance(c, pa.Array) else c for c in columns], schema=OUT), len(window_ends)


def pack(docs: DataFrame, path: str, end_id: int = 2, size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is its ids and ``end_id`` (null or empty text: ``end_id`` alone), in the order of the scan;
    no row is moved, so a hot key or a long document costs no shuffle. A window never spans two input
    partitions: its sequence_id is the partition's number and a counter, which a retried task repeats. A
    null doc_id stays null; repeated rows are packed as often as they occur; no rows give no rows; other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, ended = load(path, end_id), TaskContext.get().partitionId() << 40
        names: list = []
        ids: list[bytes] = []
        held = 0
        for b in slices(batches):
            names += b.column("doc_id").to_pylist()
            got = model.texts([t or "" for t in b.column("text").to_pylist()])
            ids += got
            held += sum(map(len, got)) // 4
            if held >= block:
                out, n = _pack_block(names, ids, model.ends, ended, size)
                ended, names, ids, held = ended + n, [], [], 0
                yield out
        if names:
            yield _pack_block(names, ids, model.ends, ended, size)[0]
        model.older = {}  # the worker outlives its task; the newer generation is enough for the next one

    return need(docs, "doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
