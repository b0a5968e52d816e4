"""Token counts of a byte-level vocabulary without ever making ids.

A piece starts as its bytes, a doubly linked list of symbols. A heap holds the adjacent pairs that can merge, lowest rank
first, then leftmost; each live pair that is popped becomes one symbol, and entries whose pair has changed since are
skipped. The count of a piece is its bytes minus its merges. Pieces repeat, so a worker keeps the counts of recent ones in
two bounded generations.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrant.llm import bpe
from calibrant.llm.arrow import slices
from calibrant.llm.common import need

LIMIT = 512


class PieceCounts(dict):
    """Text that follows a lone space -> the number of its tokens with that space, counted when first asked for."""

    def __init__(self, path: str, remember: int = 500_000):
        table = bpe.load(path)
        self.of_byte, self.merges, self.specials = table.of_byte, table.merges, table.specials
        self.remember, self.older = remember, {}

    def of_piece(self, piece: str) -> int:
        """Bytes minus merges of one piece."""
        of_byte, ranked = self.of_byte, self.merges.get
        symbols = [of_byte[b] for b in piece.encode("utf-8")]
        n = merges = len(symbols)
        if n < 2:
            return n
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [m << 32 | i for i in range(n - 1) if (m := ranked(symbols[i] << 20 | symbols[i + 1])) is not None]
        heapify(heap)
        merges = 0
        while heap:
            entry = heappop(heap)
            i, m = entry & 0xFFFFFFFF, entry >> 32
            j = right[i]
            if symbols[i] < 0 or j >= n or ranked(symbols[i] << 20 | symbols[j]) != m:
                continue  # stale: one of the two has merged with another neighbour
            merges += 1
            symbols[i], symbols[j] = m & 0xFFFFF, -1
            right[i] = j = right[j]
            if j < n:
                left[j] = i
                if (m := ranked(symbols[i] << 20 | symbols[j])) is not None:
                    heappush(heap, m << 32 | i)
            if (h := left[i]) >= 0 and (m := ranked(symbols[h] << 20 | symbols[i])) is not None:
                heappush(heap, m << 32 | h)
        return n - merges

    def __missing__(self, chunk: str) -> int:
        n = self.older.get(chunk)
        if n is None:
            n = self.of_piece(" " + chunk) if chunk.isalpha() else sum(map(self.of_piece, bpe.SPLIT.findall(" " + chunk)))
        if len(chunk) <= bpe.KEPT_CHARS:
            if len(self) >= self.remember:
                self.older = dict(self)
                self.clear()
            self[chunk] = n
        return n

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not text:
            return 0
        first, *rest = bpe.chunks_of(text)
        return sum(map(self.of_piece, bpe.SPLIT.findall(first))) + sum(map(self.__getitem__, rest))

    def count(self, text: str) -> int:
        if self.specials is None:
            return self.plain(text)
        parts = self.specials.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


@lru_cache(2)
def load(path: str) -> PieceCounts:
    return PieceCounts(path)


def token_counts(docs: DataFrame, path: str, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep``, n_bytes (UTF-8) and n_tokens of each whole ``text``.

    One row out for each row in, in whatever order, without a shuffle; rows that repeat give rows that repeat; a null text
    counts as empty and has no tokens; kept columns may be null; other columns are not read, whatever their names. A special string of the vocabulary file
    found in a text is one token. A text is held whole: its pieces are counted one after the other. ``path``: the
    vocabulary file, there on every worker. Raises ValueError when a column is missing or ``keep`` names a result.
    """
    if taken := {"n_bytes", "n_tokens"} & set(keep):
        raise ValueError(f"kept columns are named like results: {sorted(taken)}")
    rows = need(docs, *dict.fromkeys([*keep, text]))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = load(path)
        for b in slices(batches, text):
            texts = b.column(text)
            n = np.fromiter((counts.count(t.as_py() or "") for t in texts), np.int64, len(texts))
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], size, pa.array(n)], [*keep, "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keep], "n_bytes long", "n_tokens long"]))


def op11_token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each row of ``docs``."""
    return token_counts(docs, path, "doc_id").withColumn("over_limit", F.col("n_tokens") > limit)
