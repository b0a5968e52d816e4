"""Byte-pair encoding and decoding with a byte-level vocabulary file.

Merging keeps the symbols of a piece in a doubly linked list and the candidate pairs in a heap ordered by
merge rank, then place; an entry whose pair has changed since is stale and skipped when popped. Pieces repeat,
so each worker keeps the ids of recent ones, in two bounded generations.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from calibrant.llm.arrow import slices
from calibrant.llm.common import need

#: The split pattern of this kind of vocabulary and the white space it knows.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: A single space between two other characters always starts a piece; texts with other white space than
#: lone spaces and line ends take the general expression.
RARE = re.compile(r"[\t\r\v\f\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
RARE_ASCII = ("\t", "\r", "\v", "\f", "\x1c", "\x1d", "\x1e", "\x1f")
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def chunks_of(text: str) -> list[str]:
    """Cut at lone spaces (left out)."""
    odd = "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " "
    if odd or (any(c in text for c in RARE_ASCII) if text.isascii() else RARE.search(text)):
        return LONE_SPACE.split(text)
    return text.split(" ")


KEPT_CHARS = 64


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in such vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    at = {b: chr(b) for b in plain}
    for b in range(256):
        at.setdefault(b, chr(256 + len(at) - len(plain)))
    return [at[b] for b in range(256)]


class BytePairs(dict):
    """Text that follows a lone space, to its ids with that space (little-endian unsigned 32-bit), made when
    first asked for."""

    def __init__(self, path: str, remember: int = 500_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.remember, self.older = remember, {}
        chars = byte_chars()
        self.of_byte = [vocab[c] for c in chars]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        #: pair of ids -> rank and id of the merged symbol, in one integer that sorts by rank
        self.merges = {vocab[a] << 20 | vocab[b]: rank << 20 | vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        back = {c: bytes([b]) for b, c in enumerate(chars)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: b"".join(back[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.specials = re.compile("|".join(sorted(map(re.escape, self.special), key=len, reverse=True))) if self.special else None

    def merged(self, piece: str) -> bytes:
        of_byte, merges = self.of_byte, self.merges.get
        symbols = [of_byte[b] for b in piece.encode("utf-8")]
        n = len(symbols)
        if n > 1:
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            heap = [m << 32 | i for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (m := merges(a << 20 | b)) is not None]
            heapq.heapify(heap)
            while heap:
                top = heappop(heap)
                i, m = top & 0xFFFFFFFF, top >> 32
                j, a = after[i], symbols[i]
                if a < 0 or j >= n or merges(a << 20 | symbols[j]) != m:
                    continue  # stale
                symbols[i] = a = m & 0xFFFFF
                symbols[j] = -1
                j = after[i] = after[j]
                if j < n:
                    before[j] = i
                    if (m := merges(a << 20 | symbols[j])) is not None:
                        heappush(heap, m << 32 | i)
                if (h := before[i]) >= 0 and (m := merges(symbols[h] << 20 | a)) is not None:
                    heappush(heap, m << 32 | h)
            symbols = [s for s in symbols if s >= 0]
        return struct.pack(f"<{len(symbols)}I", *symbols)

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            if chunk.isalpha():
                ids = self.merged(" " + chunk)
            elif chunk[:-1].isalpha():  # a word and one mark
                ids = self[chunk[:-1]] + self.merged(chunk[-1])
            else:
                ids = self.split(" " + chunk)
        if len(chunk) <= KEPT_CHARS:
            if len(self) >= self.remember:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def split(self, text: str) -> bytes:
        return b"".join([self[p[1:]] if p[0] == " " and p[1:].isalpha() else self.merged(p) for p in SPLIT.findall(text)])

    def plain(self, text: str) -> bytes:
        if not text:
            return b""
        chunks = chunks_of(text)
        return self.split(chunks[0]) + b"".join(map(self.__getitem__, chunks[1:]))

    def encode(self, text: str) -> bytes:
        if self.specials is None or not self.specials.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self.plain(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def load(path: str) -> BytePairs:
    return BytePairs(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of long) and decoded text of each row; see :func:`digests` for the rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = load(path)
        for b in slices(batches):
            ids = [pairs.encode(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([np.frombuffer(i, "<u4").astype(np.int64) for i in ids], pa.list_(pa.int64())), pa.array([pairs.decode(i) for i in ids])], ["doc_id", "ids", "decoded"])

    return need(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<long>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode each whole text; return digests: doc_id, n_tokens, ids_sha256, decoded_sha256.

    One row out for each row in, in whatever order; null text counts as empty and has no ids; a null doc_id
    stays null; rows that repeat give rows that repeat; other columns are not read. Special strings of the
    vocabulary file found in a text become their own id. ``path``: the vocabulary file, there on every worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = load(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for b in slices(batches):
            n, enc, dec = [], [], []
            for text in b.column("text"):
                ids = pairs.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                enc.append(sha(ids))
                dec.append(sha(pairs.decode(ids).encode()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(enc, pa.string()), pa.array(dec, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return need(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
