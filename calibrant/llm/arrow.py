"""Arrow helpers of the operators that work on batches: bounded slices and word codes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that an operator holds as Python objects or arrays at a time (one longer text stands alone).
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``size`` bytes of text, one row at least. Free memory is given back at the end: a worker
    outlives its task."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0))
        start, held = 0, 0
        for i, k in enumerate(n.tolist()):
            if held + k > size and i > start:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += k
        yield batch.slice(start)
    give_back()


def give_back() -> None:
    """Return what Arrow's pool and the C library hold free to the system, where they can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text (null: none): codes into a dictionary of distinct words,
    the dictionary, and where each text's words start (one more offset than texts)."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat = split.flatten()
    offsets = np.asarray(split.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    full = np.asarray(pc.not_equal(pc.binary_length(flat), 0))
    if not full.all():  # text that starts or ends with white space
        flat = flat.filter(pa.array(full))
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
    coded = flat.dictionary_encode()
    return np.asarray(coded.indices, dtype=np.int64), coded.dictionary, offsets


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
    return x ^ (x >> np.uint64(31))


def rolled(codes: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash, mod 2^64, of each run of ``width`` consecutive 64-bit codes."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += codes[i : i + n]
    return mixed(out)
