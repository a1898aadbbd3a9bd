"""LM scoring with an Elias-Fano n-gram trie.

The model is an interpolated trigram model with Dirichlet-smoothed probabilities: p(w | u v) = A(u v w) + B(u v) p(w | v) with
A = c(u v w) / (c(u v) + MU[1]) and B = MU[1] / (c(u v) + MU[1]); p(w | v) is made likewise, with MU[0], of p(w), the add-one
unigram probability. Over the known words and one class for all unknown ones each sums to one before A is quantised, and to
no more after, as A is rounded down and context counts are exact. The trie keeps A, the smoothed probability that is an
n-gram's own, as a quantised logarithm. Its levels are Elias-Fano sequences, low bits packed, high bits
in unary with sampled counts: the ids of a level, which grow within a context and are made monotone over all contexts by adding
what came before, and pointers from each context into the next level. A query finds its first word, and then, level by level,
the successor of (the context's base + word id) in the context's own range. A shard's levels are written to a file that is
mapped into memory and vanishes with its task; queries select on the mapped bits.

Neither the vocabulary nor the trie is ever in one place. Texts are encoded once into blocks (a dictionary of word hashes,
and the tokens as dictionary places) that are kept in the shared folder. Three times a block sends its distinct words, word
pairs and word triples, each with its training count, to shards, which add the counts up, build their part of the trie and
answer each message in its order; the block puts the answers together per document. A word or pair that is the context of very
many tokens has its successors dealt over as many shards as it would fill. An n-gram, however common, is in a message once.
A word's id is its rank by count within its shard and then the shard, so frequent words have small ids everywhere. Words are
told apart by 64-bit hashes.

Defined cases: null or empty text: the end token alone. A null doc_id counts as an empty one, is trained on, and comes back
null. Repeated rows each get their row and count each. Without training tokens every probability is one. Very long texts make a
block of their own. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import checkpoint, column, mix, shuffle_parts, slices, text_buffers, word_hashes

#: The weight of the lower order in p(w | v) and in p(w | u v).
MU = (200.0, 10.0)
#: Steps of the quantised logarithms (base 10) for each unit.
STEPS = 256
#: Tokens of a block, and of the training data for each shard.
BLOCK, SHARD = 1_600_000, 2_000_000
#: A context with more than this part of a shard's tokens has its successors dealt over several shards.
HOT = 1 / 8

_U = np.uint64
END = _U(0x5E1F0A11D0C5E4D5)  # stands for the end token among hashed words


# ---- messages --------------------------------------------------------------------------------------------------


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays, each with its bytes regrouped by significance, compressed."""
    out = {}
    for k, a in arrays.items():
        a = np.ascontiguousarray(a)
        if a.dtype == np.int64 and len(a) and 0 <= a.min() and a.max() < 1 << 32:
            a = a.astype(np.uint32)
        out[k] = (a.dtype.str, len(a), a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(out, protocol=5))


def unpack(data: bytes) -> dict[str, np.ndarray]:
    raw = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
    return {k: (np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(-1, n).T).view(d).ravel() if n else np.zeros(0, d)) for k, (d, n, b) in raw.items()}


def _steps(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Sorted rows as steps from the row before; a column starts anew where one before it changes."""
    out, new = [], np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        d = np.where(new, c, np.diff(c, prepend=0))
        out.append(d)
        new = new | (d != 0)
    return out


def _from_steps(steps: list[np.ndarray]) -> list[np.ndarray]:
    out, new = [], np.zeros(len(steps[0]), bool)
    new[:1] = True
    for d in steps:
        d = d.astype(np.int64)
        total = np.cumsum(d)
        first = np.flatnonzero(new)
        out.append(total - np.repeat((total - d)[first], np.diff(np.append(first, len(d)))))
        new = new | (d != 0)
    return out


ROW = "shard long, block long, n long, v long, top long, payload binary"


def _rows(rows: list[tuple[int, int, bytes]], n: int = 0, v: int = 0, top: int = 0) -> pa.RecordBatch:
    same = lambda x: pa.array([x] * len(rows), pa.int64())
    return pa.RecordBatch.from_pydict({"shard": pa.array([r[0] for r in rows], pa.int64()), "block": pa.array([r[1] for r in rows], pa.int64()), "n": same(n), "v": same(v), "top": same(top), "payload": pa.array([r[2] for r in rows], pa.binary())})


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(block, payload) of the rows that share a shard, of a part sorted by it."""
    at, held = None, []
    for batch in batches:
        for shard, block, payload in zip(*(column(batch, c).to_pylist() for c in ("shard", "block", "payload")), strict=True):
            if held and shard != at:
                yield at, held
                held = []
            at = shard
            held.append((block, payload))
    if held:
        yield at, held


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a place of each, and each row's number among them. Keys small enough are sorted together with
    their places, in one array."""
    n = len(key)
    bits = max(1, n).bit_length()
    if n and key.dtype == np.int64 and int(key.max()) < 1 << (63 - bits):
        both = np.sort(key << bits | np.arange(n))
        k, at = both >> bits, both & ((1 << bits) - 1)
    else:
        at = np.argsort(key)
        k = key[at]
    new = np.ones(n, bool)
    new[1:] = k[1:] != k[:-1]
    number = np.empty(n, np.int64)
    number[at] = np.cumsum(new) - 1
    return k[new], at[new], number


# ---- blocks ----------------------------------------------------------------------------------------------------


def _encode(block_tokens: int):
    """Rows (doc_id, held, text) to blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n_blocks = TaskContext.get().partitionId(), 0
        tokens: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        ids: list[list] = []
        held: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            nonlocal n_blocks
            words, _, place = distinct(np.concatenate(tokens))
            count = np.bincount(place, minlength=len(words))
            order = np.argsort(-count, kind="stable")  # frequent words get small places
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            flat = [x for some in ids for x in some]
            data = pack(words=words[order], tokens=rank[place], size=np.concatenate(sizes).astype(np.uint32), doc_id=np.array([0 if x is None else x for x in flat], np.int64), null=np.array([x is None for x in flat], np.uint8), held=np.concatenate(held).astype(np.uint8))
            number = task << 32 | n_blocks
            n_blocks += 1
            n = sum(map(len, tokens))
            for some in (tokens, sizes, ids, held):
                some.clear()
            return _rows([(-1, number, data)], n)

        total = 0
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_buffers(column(part, "text"))
                h, doc = word_hashes(data, offsets, lower=True)
                size = np.bincount(doc, minlength=part.num_rows) + 1
                out = np.full(int(size.sum()), END)
                inner = np.ones(len(out), bool)
                inner[np.cumsum(size) - 1] = False
                out[inner] = h
                tokens.append(out)
                sizes.append(size)
                ids.append(column(part, "doc_id").to_pylist())
                held.append(column(part, "held").to_numpy(zero_copy_only=False))
                total += len(out)
                if total >= block_tokens:
                    yield block()
                    total = 0
        if total:
            yield block()

    return run


def _word_shard(words: np.ndarray, n: int) -> np.ndarray:
    return ((words >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)


def _cuts(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each shard that occurs, in order; none if there are no places."""
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    s = shard[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(s)], strict=True):
        yield int(s[a]), order[a:b]


def _send_words(n_shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(column(batch, "block").to_pylist(), column(batch, "payload").to_pylist(), strict=True):
                x = unpack(payload)
                train = np.repeat(x["held"] == 0, x["size"])
                count = np.bincount(x["tokens"][train], minlength=len(x["words"])).astype(np.uint32)
                yield _rows([(s, block, pack(words=x["words"][at], count=count[at])) for s, at in _cuts(_word_shard(x["words"], n_shards))])

    return run


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's words: answers to the blocks (counts, and ranks by count among the shard's known words), and on a row of no
    block the shard's totals."""
    for shard, rows in _by_shard(batches):
        got = [unpack(payload) for _, payload in rows]
        words, _, place = distinct(np.concatenate([x["words"] for x in got]))
        count = np.bincount(place, np.concatenate([x["count"] for x in got]), minlength=len(words)).astype(np.int64)
        known = int((count > 0).sum())
        number = np.full(len(words), known, np.int64)  # unknown ones: one beyond the last
        number[np.argsort(-count, kind="stable")[:known]] = np.arange(known)
        out, at = [], 0
        for (block, _), x in zip(rows, got, strict=True):
            p = place[at : at + len(x["words"])]
            at += len(p)
            out.append((shard, block, pack(count=count[p], number=number[p])))
        yield _rows(out)
        yield _rows([(shard, -1, b"")], int(count.sum()), known, known)


class View:
    """A block with its words' counts: tokens by words in order of id, distinct pairs and triples of known words."""

    def __init__(self, payload: bytes, words: list[dict], n_shards: int) -> None:
        x = unpack(payload)
        count, ids = np.zeros(len(x["words"]), np.int64), np.zeros(len(x["words"]), np.int64)
        answers = {r["shard"]: r["payload"] for r in words}
        for s, at in _cuts(_word_shard(x["words"], n_shards)):
            a = unpack(answers[s])
            count[at] = a["count"]
            ids[at] = a["number"].astype(np.int64) * n_shards + s
        order = np.lexsort((ids, count == 0))  # unknown words last
        label = np.empty(len(order), np.int32)
        label[order] = np.arange(len(order), dtype=np.int32)
        self.x, self.size, self.t = x, x["size"].astype(np.int64), label[x["tokens"]]
        self.count, self.id, self.known, self.words = count[order], ids[order], int((count > 0).sum()), len(order)
        self.doc = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        self.train = (x["held"] == 0)[self.doc]

    def pairs(self) -> None:
        """pair_of: for each token, the number of the distinct known pair that it and the next token make; -1: none."""
        t, known = self.t, self.t < self.known
        ok = np.flatnonzero((self.doc[:-1] == self.doc[1:]) & known[:-1] & known[1:])
        self.pair, _, place = distinct(t[ok].astype(np.int64) * self.words + t[ok + 1])
        self.pair_of = np.full(max(0, len(t) - 1), -1, np.int32)
        self.pair_of[ok] = place

    def triples(self, codes: np.ndarray, more: np.ndarray) -> None:
        """Likewise for triples whose two pairs are both in the training data (no other can be)."""
        self.share = from_codes(codes)  # A of every distinct pair
        u = self.pair // max(1, self.words)
        self.pair_count = about(codes, self.count[u] + self.mu[0]) + more  # exact
        some = self.pair_of >= 0
        some[some] = codes[self.pair_of[some]] > 0
        ok = np.flatnonzero(some[:-1] & some[1:])
        self.triple, _, place = distinct(self.pair_of[ok].astype(np.int64) * self.words + self.t[ok + 2])
        self.triple_of = np.full(max(0, len(self.t) - 2), -1, np.int32)
        self.triple_of[ok] = place

    mu = MU

    def counted(self, of: np.ndarray, n: int) -> np.ndarray:
        """Training occurrences of n distinct pairs or triples."""
        return np.bincount(of[(of >= 0) & self.train[: len(of)]], minlength=n)

    def shards(self, context: np.ndarray, total: np.ndarray, word: np.ndarray, n_shards: int, hot: float) -> np.ndarray:
        """By context; successors of a context with over `hot` tokens are dealt over as many shards as it would fill."""
        pieces = np.maximum(1, np.ceil(total / hot)).astype(np.uint64)
        return (mix(context + mix(mix(word.astype(np.uint64)) % pieces)) % _U(n_shards)).astype(np.int64)

    def pair_messages(self, n_shards: int, hot: float) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], np.ndarray]]:
        """(shard, places among the distinct pairs, their ids, the context's count)."""
        a, b = np.divmod(self.pair, max(1, self.words))
        u, w, total = self.id[a], self.id[b], self.count[a]
        for s, at in _cuts(self.shards(mix(u.astype(np.uint64)), total, w, n_shards, hot)):
            yield s, at, [u[at], w[at]], total[at]

    def triple_messages(self, n_shards: int, hot: float) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], np.ndarray]]:
        p, c = np.divmod(self.triple, max(1, self.words))
        a, b = np.divmod(self.pair[p], max(1, self.words))
        u, v, w, total = self.id[a], self.id[b], self.id[c], self.pair_count[p]
        for s, at in _cuts(self.shards(mix(u.astype(np.uint64)) ^ v.astype(np.uint64), total, w, n_shards, hot)):
            yield s, at, [u[at], v[at], w[at]], total[at]


def _ask(block: int, messages, trained: np.ndarray, hot: float) -> pa.RecordBatch:
    out = []
    for s, at, columns, total in messages:
        steps = _steps(columns)
        # a context that is dealt over several shards brings its whole count along
        first = np.flatnonzero((np.stack(steps[:-1]) != 0).any(axis=0) | (np.arange(len(at)) == 0))
        wide = first[total[first] > hot]
        out.append((s, block, pack(**{f"c{i}": c for i, c in enumerate(steps)}, trained=trained[at].astype(np.uint32), wide=wide, total=total[wide].astype(np.int64))))
    return _rows(out)


def _answers(rows: list[dict], messages, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of n distinct pairs or triples (0: not in the training data), and how many more a pair occurs than its code says."""
    got, codes, more = {r["shard"]: r["payload"] for r in rows or ()}, np.zeros(n, np.int64), np.zeros(n, np.int64)
    for s, at, *_ in messages:
        x = unpack(got[s])
        codes[at], more[at] = x["code"], x.get("more", 0)
    return codes, more


# ---- the trie --------------------------------------------------------------------------------------------------


def select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the set bit number k of each 64-bit word."""
    at = np.zeros(len(words), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count(words & _U((1 << width) - 1))
        up = k >= below
        k = k - below * up
        words = np.where(up, words >> _U(width), words)
        at += width * up
    return at


class EliasFano:
    """A monotone sequence of n integers: each one's low bits packed, the high bits in unary, and the number of ones up to
    each 64-bit word of these, from which a bit is selected."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> None:
        self.n, self.bits, self.low, self.high, self.ones = n, bits, low, high, ones
        self.zeros = (np.arange(1, len(ones) + 1) << 6) - ones

    @staticmethod
    def encode(values: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, ((top + 1) // max(1, n)).bit_length() - 1)
        each = 1 << 16  # values whose bits are laid out together
        low = [np.packbits((values[i : i + each, None] >> np.arange(bits) & 1).astype(np.uint8), bitorder="little") for i in range(0, n, each)] if bits else []
        flags = np.zeros((top >> bits) + n + 1, np.uint8)
        flags[(values >> bits) + np.arange(n)] = 1
        high = _words(np.packbits(flags, bitorder="little"))
        return n, bits, _words(np.concatenate(low) if low else np.zeros(0, np.uint8)), high, np.cumsum(np.bitwise_count(high), dtype=np.int64)

    def low_bits(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.int64)
        place = i * self.bits
        at, shift = place >> 6, (place & 63).astype(np.uint64)
        got = (self.low[at] >> shift) | (self.low[at + 1] << _U(1) << (_U(63) - shift))
        return (got & _U((1 << self.bits) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.ones, i, "right")
        place = (at << 6) + select(self.high[at], i - np.where(at > 0, self.ones[at - 1], 0))
        return ((place - i) << self.bits) | self.low_bits(i)

    def below(self, part: np.ndarray) -> np.ndarray:
        """How many elements have a smaller high part."""
        k = part - 1
        at = np.minimum(np.searchsorted(self.zeros, k, "right"), len(self.zeros) - 1)
        place = (at << 6) + select(~self.high[at], np.maximum(k, 0) - np.where(at > 0, self.zeros[at - 1], 0))
        return np.where(part > 0, np.minimum(place - k, self.n), 0)

    def successor(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first place in [lo, hi) whose element is x at least (hi if there is none), and whether it is x."""
        if not self.n:
            return hi, np.zeros(len(x), bool)
        top = int(self.get(np.array([self.n - 1]))[0]) >> self.bits
        part, rest = np.minimum(x >> self.bits, top + 1), x & ((1 << self.bits) - 1)
        lo, hi = np.maximum(lo, np.minimum(self.below(part), hi)), np.minimum(hi, self.below(part + 1))
        hi = np.maximum(lo, hi)
        end = hi.copy()
        while True:  # among those that share the high part, by the low bits
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            less = self.low_bits(mid) < rest[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        there = lo < end
        there[there] = self.low_bits(lo[there]) == rest[there]
        return lo, there & (part <= top)


def _words(data: np.ndarray) -> np.ndarray:
    """Bytes as 64-bit words, with one more at the end."""
    out = np.zeros(len(data) // 8 + 2, "<u8")
    out.view(np.uint8)[: len(data)] = data
    return out


def _heads(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Where the prefixes of each length begin among sorted rows."""
    out, new = [], np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new = new | np.concatenate([new[:1], c[1:] != c[:-1]])
        out.append(np.flatnonzero(new))
    return out


class Trie:
    """Ids and pointers of each level and the quantised probabilities of a shard, mapped from a file."""

    def __init__(self, columns: list[np.ndarray], code: np.ndarray) -> None:
        """columns: the ids of sorted distinct n-grams; code: quantised -log10 of their own probability."""
        heads, parts = _heads(columns), []
        for d, at in enumerate(heads):
            ids = columns[d][at]
            if d:
                begin = np.searchsorted(at, heads[d - 1])
                size = np.diff(np.append(begin, len(at)))
                last = ids[begin + size - 1] + 1 if len(at) else begin
                ids = ids + np.repeat(np.cumsum(last) - last, size)  # every range starts where the one before can end at most
                parts.append(EliasFano.encode(np.append(begin, len(at))))
            parts.append(EliasFano.encode(ids))
        arrays = [a for p in parts for a in p[2:]] + [code.astype("<u2")]
        with tempfile.TemporaryFile() as f:
            places = []
            for a in arrays:
                places.append((f.tell(), a.dtype, len(a)))
                f.write(a.tobytes() or b"\0" * 8)
                f.write(b"\0" * (-f.tell() % 8))
            f.flush()
            whole = np.memmap(f, np.uint8, "r")
        read = [whole[p : p + d.itemsize * n].view(d) for p, d, n in places]
        levels = [EliasFano(p[0], p[1], *read[3 * i : 3 * i + 3]) for i, p in enumerate(parts)]
        self.ids, self.pointers, self.code = levels[::2], levels[1::2], read[-1]

    def find(self, columns: list[np.ndarray]) -> np.ndarray:
        """The code of each of some sorted rows of ids; -1 where the trie has none."""
        n = len(columns[0])
        if not self.ids[0].n or not n:
            return np.full(n, -1, np.int64)
        heads = _heads(columns)
        x = columns[0][heads[0]]
        node, there = self.ids[0].successor(x, np.zeros(len(x), np.int64), np.full(len(x), self.ids[0].n))
        for d in range(1, len(columns)):
            node = np.minimum(node, self.ids[d - 1].n - 1)
            lo, hi = self.pointers[d - 1].get(node), self.pointers[d - 1].get(node + 1)
            # the range's base: one past the last element before it
            base = np.where(lo > 0, self.ids[d].get(np.maximum(lo - 1, 0)) + 1, 0)
            of = np.searchsorted(heads[d - 1], heads[d], "right") - 1
            node, found = self.ids[d].successor(base[of] + columns[d][heads[d]], lo[of], hi[of])
            there = there[of] & found
        return np.where(there, self.code[np.minimum(node, len(self.code) - 1)].astype(np.int64), -1)


def quantised(p: np.ndarray) -> np.ndarray:
    """-log10 p in whole steps, rounded so that p never grows; at most what 16 bits hold beside the mark of none."""
    return np.minimum(np.ceil(-np.log10(p) * STEPS), 65534).astype(np.int64)


def from_codes(code: np.ndarray) -> np.ndarray:
    """Probabilities of codes as they are answered: 0 for none, else one more than the steps."""
    return np.where(code > 0, 10.0 ** ((1 - code) / STEPS), 0.0)


def about(code: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The count that an answered code and its context's smoothed count stand for, nearly."""
    return np.rint(from_codes(code) * total)


def _answer(order: int, top: int, mu: float):
    """A shard's n-grams: builds its part of the trie from the training counts and answers each message."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            asked = [unpack(payload) for _, payload in rows]
            sizes = [len(x["trained"]) for x in asked]
            got = [_from_steps([x[f"c{i}"] for i in range(order)]) for x in asked]
            columns = [np.concatenate([g[i] for g in got]) for i in range(order)]
            del got
            context = columns[0]
            if order == 3:
                context = context * top + columns[1]
            names, _, context = distinct(context)
            trained = np.concatenate([x["trained"] for x in asked])
            total = np.bincount(context, trained, minlength=len(names))
            at = 0
            for x, n in zip(asked, sizes, strict=True):
                total[context[at + x["wide"].astype(np.int64)]] = x["total"]
                at += n
            # columns, context and so on of the distinct n-grams, in order
            _, first, place = distinct(context * top + columns[-1])
            columns, total = [c[first] for c in columns], total[context[first]]
            count = np.bincount(place, trained, minlength=len(first))
            del context, trained, first, names
            some = count > 0
            trie = Trie([c[some] for c in columns], quantised(count[some] / (total[some] + mu)))
            code = trie.find(columns) + 1
            answer = {"code": code.astype(np.uint16)[place]}
            if order == 2:  # contexts of triples, whose counts have to be exact for probabilities to add up to one
                answer["more"] = np.where(some, count - about(code, total + mu), 0).astype(np.int32)[place]
            del total, count, code
            at = 0
            for (block, _), n in zip(rows, sizes, strict=True):
                yield _rows([(shard, block, pack(**{k: v[at : at + n] for k, v in answer.items()}))])
                at += n

    return run


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(view: View, triple_codes: np.ndarray, n_all: int, n_words: int) -> pa.RecordBatch:
    t, doc, docs, mu = view.t, view.doc, len(view.size), view.mu
    plain = (view.count + 1.0) / (n_all + n_words + 1)  # p(w)
    base = np.bincount(doc, np.log10(plain)[t], minlength=docs)
    p = plain[t]
    pair = view.pair_of
    inside = np.flatnonzero(doc[:-1] == doc[1:])
    share = np.append(view.share, 0.0)[pair[inside]]  # -1: the last, nothing
    c = view.count[t[inside]]
    p[inside + 1] = share + np.where(c > 0, mu[0] / (c + mu[0]), 1.0) * p[inside + 1]
    inside = inside[inside < len(t) - 2]
    inside = inside[doc[inside] == doc[inside + 2]]
    share = np.append(from_codes(triple_codes), 0.0)[view.triple_of[inside]]
    c = np.append(view.pair_count, 0.0)[pair[inside]]
    p[inside + 2] = share + np.where(c > 0, mu[1] / (c + mu[1]), 1.0) * p[inside + 2]
    score = np.bincount(doc, np.log10(p), minlength=docs)
    known = np.bincount(doc, t < view.known, minlength=docs).astype(np.int64)
    x = view.x
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(x["doc_id"].astype(np.int64), mask=x["null"] == 1), "held_out": pa.array(x["held"] == 1), "n_tokens": pa.array(view.size), "n_known": pa.array(known),
        "train_tokens": pa.array(np.full(docs, n_all, np.int64)), "base_score": pa.array(base), "score": pa.array(score),
    })


def scored(docs: DataFrame, mu: tuple[float, float] = MU, folds: int = 7, held: int = 2, shard_tokens: int = SHARD, block_tokens: int = BLOCK) -> DataFrame:
    """Scores of every document by a model of those whose crc32(doc_id as text) mod `folds` isn't `held`."""
    spark = docs.sparkSession
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == held).alias("held"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = checkpoint(rows.mapInArrow(_encode(block_tokens), ROW))
    tokens, n_blocks = blocks.agg(F.sum("n"), F.count("n")).first()
    n_shards = max(shuffle_parts(spark), int((tokens or 0) // shard_tokens) + 1)
    n_blocks = max(shuffle_parts(spark), n_blocks)  # parts that blocks are dealt over
    hot = HOT * shard_tokens
    sent = lambda df: df.repartition(n_shards, "shard").sortWithinPartitions("shard", "block")
    words = checkpoint(sent(blocks.mapInArrow(_send_words(n_shards), ROW)).mapInArrow(_count_words, ROW))
    n_all, n_words, top = (int(x or 0) for x in words.agg(F.sum("n"), F.sum("v"), F.max("top")).first())
    top = (top + 1) * n_shards  # ids are below
    grouped = lambda df, name: df.where("block >= 0").repartition(n_blocks, "block").groupBy("block").agg(F.collect_list(F.struct("shard", "payload")).alias(name))
    known = blocks.select("block", "payload").repartition(n_blocks, "block").join(grouped(words, "words"), "block")

    def view(row: dict) -> View:
        out = View(row["payload"], row["words"], n_shards)
        out.mu = mu
        out.pairs()
        if "pairs" in row:
            out.triples(*_answers(row["pairs"], out.pair_messages(n_shards, hot), len(out.pair)))
        return out

    def each(f):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield f(batch.slice(i, 1).to_pylist()[0])

        return run

    def ask_pairs(row: dict) -> pa.RecordBatch:
        v = view(row)
        return _ask(row["block"], v.pair_messages(n_shards, hot), v.counted(v.pair_of, len(v.pair)), hot)

    def ask_triples(row: dict) -> pa.RecordBatch:
        v = view(row)
        return _ask(row["block"], v.triple_messages(n_shards, hot), v.counted(v.triple_of, len(v.triple)), hot)

    def finish(row: dict) -> pa.RecordBatch:
        v = view(row)
        return _scores(v, _answers(row["triples"], v.triple_messages(n_shards, hot), len(v.triple))[0], n_all, n_words)

    pairs = sent(known.mapInArrow(each(ask_pairs), ROW)).mapInArrow(_answer(2, top, mu[0]), ROW)
    known = known.join(grouped(pairs, "pairs"), "block", "left")
    triples = sent(known.mapInArrow(each(ask_triples), ROW)).mapInArrow(_answer(3, top, mu[1]), ROW)
    return known.join(grouped(triples, "triples"), "block", "left").mapInArrow(each(finish), OUT)
