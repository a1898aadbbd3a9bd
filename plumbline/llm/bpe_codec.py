"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a doubly linked list. Every pair that the vocabulary can merge stands in the bucket of its merge
rank; a three-level bitmap over the ranks gives the lowest non-empty bucket by find-first-set, so each merge costs a
constant number of word operations (plus the order within a bucket) however long the pre-token is. Entries that later
merges have overtaken are skipped when they are met. Short pre-tokens repeat, so their ids are kept in a bounded cache.

Defined cases: null or empty text: no ids and the digest of no bytes. Lone surrogates cannot occur in Spark strings.
Repeated rows each get their row; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import column, slices

#: Pre-tokens up to so many characters are cached, up to so many of them.
CACHED_CHARS, CACHED = 32, 600_000
NONE = -1
#: A space that is neither the first nor the last of its run of white space.
WITHIN = regex.compile(r"\s \s")


class Codec:
    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        most = max(self.ranks.values()) + 1
        self.bytes_of = [b""] * most
        for t, i in self.ranks.items():
            self.bytes_of[i] = t
        self.pattern = regex.compile(pattern)
        # the rank queue; every encode_piece leaves it empty for the next
        self.buckets: list[list[int] | None] = [None] * most
        self.low = [0] * ((most >> 6) + 1)
        self.mid = [0] * ((most >> 12) + 1)
        self.pieces: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        end = list(range(1, n + 2))  # where the part that starts here ends
        before = list(range(-1, n))
        due = [NONE] * (n + 1)  # the rank at which the part that starts here merges with the next
        buckets, low, mid, top = self.buckets, self.low, self.mid, 0
        fresh = [(i, r) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        while True:
            for i, r in fresh:
                due[i] = r
                if bucket := buckets[r]:
                    heappush(bucket, i)
                    continue
                buckets[r] = [i]
                a = r >> 6
                if not low[a]:
                    b = a >> 6
                    if not mid[b]:
                        top |= 1 << b
                    mid[b] |= 1 << (a & 63)
                low[a] |= 1 << (r & 63)
            while top:  # find first set: the lowest rank, then its leftmost position
                b = (top & -top).bit_length() - 1
                m = mid[b]
                a = b << 6 | (m & -m).bit_length() - 1
                x = low[a]
                r = a << 6 | (x & -x).bit_length() - 1
                bucket = buckets[r]
                i = heappop(bucket)
                if not bucket:
                    low[a] = x = x & (x - 1)
                    if not x:
                        mid[b] = m = m & (m - 1)
                        if not m:
                            top &= top - 1
                if due[i] == r:  # else stale: the part is gone or has another right neighbour now
                    break
            else:
                break
            j = end[i]
            end[i] = k = end[j]
            due[i] = due[j] = NONE
            before[k] = i
            fresh = []
            if k < n and (r := ranks.get(piece[i : end[k]])) is not None:
                fresh.append((i, r))
            if (p := before[i]) >= 0:
                due[p] = NONE
                if (r := ranks.get(piece[p:k])) is not None:
                    fresh.append((p, r))
        out, i = [], 0
        while i < n:
            j = end[i]
            out.append(ranks[piece[i:j]])
            i = j
        return out

    def _pieces(self, text: str) -> bytes:
        cache, out = self.pieces, []
        for piece in self.pattern.findall(text):
            if (got := cache.get(piece)) is None:
                got = np.array(self.encode_piece(piece.encode()), "<u4").tobytes()
                if len(piece) <= CACHED_CHARS:
                    if len(cache) >= CACHED:
                        cache.clear()
                    cache[piece] = got
            out.append(got)
        return b"".join(out)

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers.

        A space that starts a run of white space, or ends it, starts a pre-token; so unless a space stands within a run,
        the text can be split before each space and what follows one is looked up as a whole."""
        if WITHIN.search(text):
            return self._pieces(text)
        cache, first, out = self.spaced, True, []
        for chunk in text.split(" "):
            if first:
                first = False
                out.append(self._pieces(chunk))
                continue
            if (got := cache.get(chunk)) is None:
                got = self._pieces(f" {chunk}")
                if len(chunk) <= CACHED_CHARS:
                    if len(cache) >= CACHED:
                        cache.clear()
                    cache[chunk] = got
            out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One for each Python worker."""
    return Codec(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """Per document: number of ids, digests of the ids and of the bytes they decode to, and on request the ids."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                rows = []
                for text in column(part, "text").to_pylist():
                    packed = coder.packed(text or "")
                    got = np.frombuffer(packed, "<u4").tolist()
                    rows.append((len(got), hashlib.sha256(packed).hexdigest(), hashlib.sha256(coder.decode(got)).hexdigest(), got if ids else None))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]
                made = [pa.array([r[k] for r in rows], kinds[k]) for k in range(3 + ids)]
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), *made], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * ids)
