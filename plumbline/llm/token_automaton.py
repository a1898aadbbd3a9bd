"""Token counts by a finite-state tokenizer.

The tokenizer (byte-level BPE within words, an end-of-word mark, lower case, white space dropped) is compiled into a
deterministic transducer over characters whose transitions carry the number of tokens they emit. While it is inside a word,
a state knows the last token of the encoding of each prefix that a later token can still start from, and those encodings'
relative lengths; by the property that an encoding is the BPE encoding exactly if every two neighbouring tokens encode
together to themselves, the next prefix's last token follows from these alone. The part before words (contractions, letters,
single numbers, other characters) is the same automaton's outer layer. States are made when a text first reaches them and
kept in a hashed table, so each is computed once; tables are emptied when they are full.

Texts are cut into chunks that run in lockstep, one table lookup for all chunks at each step. A chunk's map gives, for each
state that it may start in, the state it ends in and the tokens it emits. Where a chunk starts at a text's beginning or after
white space that is the resting state; else those that the map of the chunk before can end in, which are added together
for all chunks until every map is whole (as many rounds as there are different states, however many chunks). The maps are
then composed by a parallel prefix scan, in steps of doubling width.

Defined cases: null or empty text: no tokens. Special tokens' strings inside a text are one token each, and cut the text, as
the library does by default. Repeated rows each get their row; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import column, slices

LIMIT = 2048
#: Characters of a chunk, table columns kept for frequent characters, and states before the tables are emptied.
CHUNK, COLUMNS, STATES = 2048, 256, 400_000
#: Tokens that a place in a word may still begin, up to which they are told one by one.
FEW = 4

LETTER, NUMBER, SPACE, OTHER = range(4)
#: White space as the tokenizer's pattern sees it. Fixed values.
_SPACES = frozenset([*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
#: After an apostrophe that starts a pre-token: letters that complete a contraction, and those that need a second one.
_SHORT, _LONG = "stmd", {"r": "e", "v": "e", "l": "l"}
NOTHING = ((None, 0),)  # the place before a word's first byte
#: Slots of the transition table, of which half may fill.
SLOTS = 1 << 22
MOST = 16  # no transition emits as many tokens, or takes as many back


#: Letters and decimal digits of Unicode 16, and pairs of cases of Unicode 16 and 17, which the tokenizer's
#: tables have and Python's (15.1) lack: first and last code point, or upper and lower case of a range's first and its last.
_NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
_NEW_DIGITS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
_NEW_CASES = (
    (0x1C89, 0x1C8A, 0x1C89), (0xA7CB, 0x0264, 0xA7CB), (0xA7CC, 0xA7CD, 0xA7CC), (0xA7CE, 0xA7CF, 0xA7CE), (0xA7D2, 0xA7D3, 0xA7D2), (0xA7D4, 0xA7D5, 0xA7D4), (0xA7DA, 0xA7DB, 0xA7DA), (0xA7DC, 0x019B, 0xA7DC),
    (0x10D50, 0x10D70, 0x10D65), (0x16EA0, 0x16EBB, 0x16EB8),
)
_LOWER = {a + i: b + i for a, b, last in _NEW_CASES for i in range(last - a + 1)}


@lru_cache(maxsize=1 << 16)
def kind(char: str) -> int:
    if ord(char) in _SPACES:
        return SPACE
    c = unicodedata.category(char)[0]
    if c == "C":  # unassigned, perhaps, for Python alone
        c = "L" if any(a <= ord(char) <= b for a, b in _NEW_LETTERS) else "N" if any(a <= ord(char) <= b for a, b in _NEW_DIGITS) else c
    return LETTER if c == "L" else NUMBER if c == "N" else OTHER


def _byte_chars() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Bpe:
    """Merges over strings of symbols; a symbol is the character of a byte's number, plus 256 at a word's end."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end = model["end_of_word_suffix"]
        byte_of = {c: b for b, c in _byte_chars().items()}

        def symbols(token: str) -> str:
            last = token.endswith(end)
            out = "".join(chr(byte_of[c]) for c in (token[: -len(end)] if last else token))
            return out[:-1] + chr(ord(out[-1]) + 256) if last else out

        self.specials = [t["content"] for t in spec["added_tokens"]]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(symbols(a), symbols(b)): i for i, (a, b) in enumerate(merges)}
        self.tokens = {symbols(t) for t in model["vocab"] if t not in self.specials}
        self.tokens = {t: t for t in self.tokens if all(ord(s) < 256 for s in t[:-1])}  # one object for each token
        self.starts = {t[:k] for t in self.tokens for k in range(len(t))}  # strict beginnings
        self.longest = max(map(len, self.tokens))
        self.few: dict[str, list] = {}  # the tokens with a strict beginning, where they are few
        for t in self.tokens:
            for k in range(1, len(t)):
                self.few.setdefault(t[:k], []).append(t)
        self.few = {k: v for k, v in self.few.items() if len(v) <= FEW}
        self._joined: dict[tuple, bool] = {}
        self._one: dict[tuple, tuple] = {}

    def encode(self, symbols: str) -> list[str]:
        parts = list(symbols)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            i, out = 0, []
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def follows(self, a: str | None, b: str) -> bool:
        """Whether b can come right after a (None: the word's beginning) in an encoding."""
        got = self._joined.get((a, b))
        if got is None:
            got = self.encode(b) == [b] if a is None else self.follows(None, b) and self.encode(a + b) == [a, b]
            if len(self._joined) > 1 << 19:
                self._joined.clear()
            self._joined[a, b] = got
        return got

    def one(self, end: tuple) -> tuple:
        """Equal places share one object."""
        if len(self._one) > 1 << 18:
            self._one.clear()
        return self._one.setdefault(end, end)


def scan(maps: list[dict[int, tuple[int, int]]], fresh: np.ndarray) -> list[dict[int, tuple[int, int]]]:
    """Prefix compositions of state maps (start: (end, count)), begun anew where `fresh`."""
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(maps)), 0))
    width = 1
    while len(more := np.flatnonzero(np.arange(len(maps)) - width >= begin)):
        before = list(maps)
        for j in more.tolist():
            maps[j] = {s: (before[j][e][0], n + before[j][e][1]) for s, (e, n) in before[j - width].items() if e in before[j]}
        width *= 2
    return maps


class Transducer:
    """States are (mode, window, ends, waiting): the outer mode, the symbols of the word that a token can still start in,
    for each place in the window the last token before it and the count relative to the newest place, and the byte that is
    read but not yet known to be the word's last."""

    REST = ("rest", "", (), "")

    def __init__(self, bpe: Bpe) -> None:
        self.bpe = bpe
        self.columns: dict[str, int] = {}
        self.empty()

    def empty(self) -> None:
        self.states: list[tuple] = [self.REST]
        self.number: dict[tuple, int] = {self.REST: 0}
        self.slots = np.full(SLOTS, -1, np.int64)  # hashed (state, column)
        self.moves = np.zeros(SLOTS, np.int32)  # next state and tokens emitted
        self.filled = 0
        self.rare: dict[tuple[int, str], tuple[int, int]] = {}
        self.closing: dict[int, int] = {}

    def intern(self, state: tuple) -> int:
        n = self.number.get(state)
        if n is None:
            n = self.number[state] = len(self.states)
            self.states.append(state)
        return n

    # -- within a word

    def last_token(self, window: str, ends: tuple, symbol: str) -> tuple[str, int]:
        """The last token, and the relative count, of the encoding of what is read with one more symbol."""
        whole = window + symbol
        for size in range(1, len(whole) + 1):
            if (end := ends[len(whole) - size]) is not None and (token := self.bpe.tokens.get(whole[-size:])) is not None:
                before = end[0]
                if token in before if type(before) is frozenset else self.bpe.follows(before, token):
                    return token, end[1] + 1
        raise ValueError(f"no token ends with {whole!r}")

    def read_byte(self, window: str, ends: tuple, symbol: str) -> tuple[str, tuple, int]:
        token, delta = self.last_token(window, ends, symbol)
        whole = window + symbol
        size = min(len(whole), self.bpe.longest)
        while whole[len(whole) - size :] not in self.bpe.starts:
            size -= 1
        whole, ends = whole[len(whole) - size :], (*ends, (token, delta))[len(ends) - size :]
        # Places where no token can have begun are of no further use, and where few can, which of them may follow is all
        # that counts: so fewer states differ.
        out = [self.place(whole[i:], e, delta) for i, e in enumerate(ends)]
        idle = next(i for i, e in enumerate(out) if e is not None)
        whole, ends = whole[idle:], tuple(out[idle:])
        return whole, ends, delta

    def place(self, since: str, end: tuple | None, delta: int) -> tuple | None:
        if end is None or since not in self.bpe.starts:
            return None
        before, count = end
        if (few := self.bpe.few.get(since)) is not None:
            before = frozenset(t for t in few if (t in before if type(before) is frozenset else self.bpe.follows(before, t)))
            if not before:
                return None
        return self.bpe.one((before, count - delta))

    def read(self, window: str, ends: tuple, waiting: str, char: str) -> tuple[str, tuple, str, int]:
        emitted = 0
        for byte in char.encode().decode("latin-1"):
            if waiting:
                window, ends, delta = self.read_byte(window, ends, waiting)
                emitted += delta
            waiting = byte
        return window, ends, waiting, emitted

    def close(self, window: str, ends: tuple, waiting: str) -> int:
        return self.last_token(window, ends, chr(ord(waiting) + 256))[1]

    def word(self, text: str) -> int:
        window, ends, waiting, emitted = "", NOTHING, "", 0
        for char in text:
            window, ends, waiting, more = self.read(window, ends, waiting, char)
            emitted += more
        return emitted + self.close(window, ends, waiting)

    # -- between words

    def step(self, state: tuple, char: str) -> tuple[tuple, int]:
        """The next state and the tokens emitted."""
        mode, window, ends, waiting = state
        k = kind(char)
        if mode in ("letters", "others"):
            if k == (LETTER if mode == "letters" else OTHER):
                window, ends, waiting, emitted = self.read(window, ends, waiting, char)
                return (mode, window, ends, waiting), emitted
            emitted = self.close(window, ends, waiting)
            after, more = self.step(self.REST, char)
            return after, emitted + more
        if mode == "'":
            if char in _SHORT:
                return self.REST, self.word(f"'{char}")
            if char in _LONG:
                return (f"'{char}", "", (), ""), 0
            if k == OTHER:
                begun, emitted = self.step(("others", "", NOTHING, ""), "'")
                after, more = self.step(begun, char)
                return after, emitted + more
            after, more = self.step(self.REST, char)
            return after, self.word("'") + more
        if mode[0] == "'":
            if char == _LONG[mode[1]]:
                return self.REST, self.word(mode + char)
            begun, emitted = self.step(self.REST, mode[1])
            after, more = self.step(begun, char)
            return after, self.word("'") + emitted + more
        if k == SPACE:
            return self.REST, 0
        if k == NUMBER:
            return self.REST, self.word(char)
        if char == "'":
            return ("'", "", (), ""), 0
        window, ends, waiting, emitted = self.read("", NOTHING, "", char)
        return ("letters" if k == LETTER else "others", window, ends, waiting), emitted

    def end(self, state: int) -> int:
        """Tokens that the text's end emits."""
        if (got := self.closing.get(state)) is None:
            got = self.closing[state] = self.step(self.states[state], " ")[1]
        return got

    # -- many chunks in lockstep

    def lookup(self, state: int, char: str) -> tuple[int, int]:
        c = self.columns.get(char)
        if c is None and len(self.columns) < COLUMNS:
            c = self.columns[char] = len(self.columns)
        if c is None and (got := self.rare.get((state, char))) is not None:
            return got
        slot = self.slot(state * COLUMNS + c) if c is not None else 0
        if c is not None and self.slots[slot] >= 0:
            move = int(self.moves[slot])
            return move >> 5, (move & 31) - MOST
        after, emitted = self.step(self.states[state], char)
        n = self.intern(after)
        if c is None or not -MOST <= emitted < MOST:
            self.rare[state, char] = n, emitted
        else:
            self.slots[slot], self.moves[slot] = state * COLUMNS + c, n << 5 | emitted + MOST
            self.filled += 1
        return n, emitted

    @staticmethod
    def home(key: np.ndarray | int) -> np.ndarray | int:
        return (key ^ (key >> 13)) * 0x9E3779B1 >> 7 & (SLOTS - 1)

    def slot(self, key: int) -> int:
        """Where a key is, or would be put."""
        at = self.home(key)
        while self.slots[at] >= 0 and self.slots[at] != key:
            at = (at + 1) & (SLOTS - 1)
        return at

    def find(self, key: np.ndarray) -> np.ndarray:
        """The moves of keys; -1 where there is none."""
        at = self.home(key)
        got = self.slots[at]
        off = np.flatnonzero((got != key) & (got >= 0))
        while len(off):
            at[off] = (at[off] + 1) & (SLOTS - 1)
            got[off] = self.slots[at[off]]
            off = off[(got[off] != key[off]) & (got[off] >= 0)]
        return np.where(got == key, self.moves[at], -1)

    def lockstep(self, codes: np.ndarray, first: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends and counts of chunks codes[first : first + size] from `state`."""
        order = np.argsort(-size, kind="stable")
        first, size, now = first[order], size[order], state[order].astype(np.int64)
        total = np.zeros(len(first), np.int64)
        active = np.searchsorted(-size, -np.arange(int(size.max()) if len(size) else 0), "left")  # chunks longer than each step
        column_of = np.full(int(codes.max()) + 1 if len(codes) else 1, -1, np.int32)
        for char, c in self.columns.items():
            if ord(char) < len(column_of):
                column_of[ord(char)] = c
        cols = column_of[codes]
        for i, n in enumerate(active.tolist()):
            at = first[:n] + i
            c = cols[at]
            s = now[:n]
            move = self.find(np.where(c >= 0, s * COLUMNS + c, -2))
            after, emitted = (move >> 5).astype(np.int64), (move & 31).astype(np.int64) - MOST
            for j in np.flatnonzero(move < 0).tolist():
                char = chr(codes[at[j]])
                after[j], emitted[j] = self.lookup(int(s[j]), char)
                if c[j] < 0 and (k := self.columns.get(char)) is not None:
                    column_of[ord(char)] = k
                    cols[codes == ord(char)] = k
            now[:n] = after
            total[:n] += emitted
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return now[back], total[back]

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text (already normalised, without special strings)."""
        if len(self.states) > STATES or self.filled > SLOTS // 2 or len(self.rare) > STATES:
            self.empty()
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        begin = np.concatenate([[0], np.cumsum(lens)])
        out = np.zeros(len(texts), np.int64)
        first, owner, known = [], [], []
        for i in np.flatnonzero(lens).tolist():
            a, b = int(begin[i]), int(begin[i + 1])
            first.append(a)
            owner.append(i)
            known.append(True)
            while b - a > CHUNK:
                a += CHUNK
                gap = np.flatnonzero(codes[a : min(a + 64, b)] == 32)
                a += int(gap[0]) + 1 if len(gap) else 0
                if a >= b:
                    break
                first.append(a)
                owner.append(i)
                known.append(bool(len(gap)))
        if not first:
            return out
        first, owner, known = np.array(first), np.array(owner), np.array(known)
        size = np.diff(np.append(first, len(codes)))
        # a text ends where the next begins
        size = np.minimum(size, begin[owner + 1] - first)
        end, total = self.lockstep(codes, first, size, np.zeros(len(first), np.int64))
        maps = [{0: x} for x in zip(end.tolist(), total.tolist(), strict=True)]
        ask = {j: {maps[j - 1][0][0]} for j in np.flatnonzero(~known).tolist()}
        while ask := {j: some for j, states in ask.items() if (some := states - maps[j].keys())}:
            at, state = (np.array(x) for x in zip(*((j, s) for j, some in ask.items() for s in some), strict=True))
            end, total = self.lockstep(codes, first[at], size[at], state)
            new: dict[int, set] = {}
            for j, s, e, n in zip(at.tolist(), state.tolist(), end.tolist(), total.tolist(), strict=True):
                maps[j][s] = e, n
                if j + 1 < len(maps) and not known[j + 1]:
                    new.setdefault(j + 1, set()).add(e)
            ask = new
        maps = scan(maps, known)
        # a known chunk's first state is the resting one; a text's count is the sum of those of its runs of chunks
        last = np.flatnonzero(np.append(known[1:], True))
        np.add.at(out, owner[last], np.array([maps[j][0][1] for j in last.tolist()]))
        # a chunk that ends in white space has closed its words; else the text's end closes them
        last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
        out[owner[last]] += np.array([self.end(maps[j][0][0]) for j in last.tolist()])
        return out


class Counter:
    def __init__(self, path: str) -> None:
        self.bpe = Bpe(path)
        self.transducer = Transducer(self.bpe)
        self.special = re.compile("|".join(map(re.escape, self.bpe.specials))) if self.bpe.specials else None

    @staticmethod
    def normalised(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").translate(_LOWER)  # no final sigma
        return text.lower()

    def counts(self, texts: list[str | None]) -> np.ndarray:
        pieces, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            parts = self.special.split(text) if self.special and "<|" in text else [text]
            extra[i] = len(parts) - 1
            pieces += map(self.normalised, parts)
            owner += [i] * len(parts)
        if pieces:
            np.add.at(extra, np.array(owner), self.transducer.counts(pieces))
        return extra


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    """One for each Python worker."""
    return Counter(path)


def counted(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = counter(path)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                texts = column(part, "text").to_pylist()
                n = tokenizer.counts(texts)
                size = [len((t or "").encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
