"""Spelling variants: words that differ by one edit, found by Levenshtein automata over broadcast trie shards.

Words are counted within batches and then by key. The vocabulary, in order, is cut into shards of at most SHARD words, each
a compact trie (sorted edges, a first-child index, counts at its ends) made by the task that holds the range. Shards are
broadcast in groups of at most GROUP_BYTES, one pass over the words for each group, so that neither driver nor executor
ever holds more of the vocabulary at once, however large it is. In a pass, every word's distance-one automaton is
intersected with every shard, depth first: down the path that the word itself spells, leaving it at each node by one
deletion, replacement or insertion, after which only the rest of the word is accepted. Many words go down together, and
a word leaves a shard's top as soon as no state is left. Accepting ends are neighbours; a task reduces them to their number
and the best of them, and these are reduced by word. So no pair of words is ever written.

A form is the neighbour with the most occurrences (ties: the smallest in code-point order), if it has DOMINANT times as many
as the word; forms are followed to their roots by doubling. As counts grow fivefold at least with each form, a chain is
short and has no circle.

Defined cases: null or empty text: no words. A null doc_id counts as the empty text where runs are damaged. Repeated rows
count again. A text is one row's work, read as a whole. Ties as above. An empty table gives an empty result. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import checkpoint, column, shuffle_parts, slices
from plumbline.llm.sharding import CRC_TABLE, crc_sql

MIN_LENGTH, MIN_COUNT, DOMINANT = 6, 5, 5
#: One in so many runs of letters is damaged by the query, as its contract says.
DAMAGED = 199
#: Words of a trie, bytes of tries that are broadcast at once, words that go down together, distinct words held while counting.
SHARD, GROUP_BYTES, TOGETHER, HELD = 65_536, 64 << 20, 2048, 200_000

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def damaged(word: str, prefix_crc: int) -> str:
    """The word without one code point if the checksum of prefix and word says so. `prefix_crc`: of `<doc_id>:`."""
    h = zlib.crc32(word.encode(), prefix_crc)
    if h % DAMAGED:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def counted(docs: DataFrame, change: Callable[[str, int], str] | None = None, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, n) of every word of the texts of docs (doc_id, text). `change` may alter a word, given the CRC of `<doc_id>:`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        flush = lambda: pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, text in zip(column(part, "doc_id").to_pylist(), column(part, "text").to_pylist(), strict=True):
                    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word, n in Counter(RUN.findall((text or "").translate(_LOWER))).items():
                        if change is not None:
                            word = change(word, prefix)
                        if len(word) >= min_length:
                            held[word] += n
                if len(held) > HELD:
                    yield flush()
                    held.clear()
        yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


class Trie:
    """A sorted list of words as a trie: node 0 is the root, nodes are numbered level by level in order of their words, so
    that a node's children are a range and all edges, as (node, letter), are sorted."""

    def __init__(self, words: list[str], counts: np.ndarray) -> None:
        """words: sorted by code points, distinct, none empty."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(length) - length
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        shared = np.zeros(len(words), np.int64)  # letters shared with the word before
        live = np.arange(1, len(words))
        depth = 0
        while len(live):
            live = live[(length[live] > depth) & (length[live - 1] > depth)]
            live = live[letters[start[live] + depth] == letters[start[live - 1] + depth]]
            depth += 1
            shared[live] = depth
        node = np.zeros(len(words), np.int64)
        n_nodes = 1
        end = np.zeros(len(words), np.int64)  # each word's node
        edges = []
        for d in range(int(length.max()) if len(words) else 0):
            long = np.flatnonzero(length > d)
            # a word opens a node at this depth unless it shares more than d letters with the word before
            new = shared[long] <= d
            child = n_nodes + np.cumsum(new) - 1
            opens = np.flatnonzero(new)
            edges.append(node[long[opens]] << 32 | letters[start[long[opens]] + d].astype(np.int64))
            node[long] = child
            n_nodes += len(opens)
            done = long[length[long] == d + 1]
            end[done] = node[done]
        edges = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        self.first = np.searchsorted(edges >> 32, np.arange(n_nodes + 1)).astype(np.int32)
        self.letter = (edges & 0xFFFFFFFF).astype(np.int32)
        self.word_at = np.full(n_nodes, -1, np.int32)
        self.word_at[end] = np.arange(len(words))
        self.words, self.counts = words, counts
        self._link()

    def _link(self) -> None:
        """Edge i leads to node i + 1; its key is its node and letter."""
        node = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        self.edges = node << 32 | self.letter

    def pack(self) -> bytes:
        words = "\n".join(self.words).encode()
        arrays = (self.first, self.letter, self.word_at, self.counts)
        return b"".join([np.array([len(words), *(a.nbytes for a in arrays)], np.int64).tobytes(), words, *(a.tobytes() for a in arrays)])

    @classmethod
    def unpack(cls, blob: bytes) -> Trie:
        self = cls.__new__(cls)
        at = np.cumsum([40, *np.frombuffer(blob, np.int64, 5).tolist()])
        self.words = blob[at[0] : at[1]].decode().split("\n")
        kinds = (np.int32, np.int32, np.int32, np.int64)
        self.first, self.letter, self.word_at, self.counts = (np.frombuffer(blob[at[i + 1] : at[i + 2]], k) for i, k in enumerate(kinds))
        self._link()
        return self

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The child of each node by a letter, -1 where there is none."""
        if not len(self.edges):
            return np.full(len(node), -1, np.int64)
        key = node << 32 | letter
        at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        return np.where(self.edges[at] == key, at + 1, -1)

    def children(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into `node`, child) of every child."""
        n = self.first[node + 1] - self.first[node]
        of = np.repeat(np.arange(len(node)), n)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        return of, self.first[node][of].astype(np.int64) + inner + 1

    def near(self, text: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word of the trie) of all that are exactly one edit apart. text: a row of letters for each query."""
        found_q, found_w = [], []

        def rest(q: np.ndarray, i: np.ndarray, node: np.ndarray) -> None:
            """After the edit: accept where the rest of the word leads to an end."""
            while len(q):
                over = i == length[q]
                if over.any():
                    word = self.word_at[node[over]]
                    found_q.append(q[over][word >= 0])
                    found_w.append(word[word >= 0].astype(np.int64))
                    q, i, node = q[~over], i[~over], node[~over]
                node = self.step(node, text[q, i])
                ok = node >= 0
                q, i, node = q[ok], i[ok] + 1, node[ok]

        q, node = np.arange(len(length)), np.zeros(len(length), np.int64)
        for i in range(int(length.max(initial=0)) + 1):
            more = i < length[q]
            of, child = self.children(node)
            other = more[of]
            other[other] = self.letter[child[other] - 1] != text[q[of[other]], i]
            # the word's letter is too many; the trie's letter is too many; one stands for the other
            at = np.repeat([i + 1, i, i + 1], [more.sum(), len(of), other.sum()])
            rest(np.concatenate([q[more], q[of], q[of[other]]]), at, np.concatenate([node[more], child, child[other]]))
            q, node = q[more], node[more]
            node = self.step(node, text[q, i])
            q, node = q[node >= 0], node[node >= 0]
            if not len(q):
                break
        if not found_q:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # one neighbour may be reached by several edits
        both = np.unique(np.concatenate(found_q) << 32 | np.concatenate(found_w))
        return both >> 32, both & 0xFFFFFFFF


def tries(vocabulary: DataFrame, shard: int = SHARD) -> DataFrame:
    """(blob): the vocabulary (word, n) in order, as tries of at most `shard` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[str] = []
        counts: list[np.ndarray] = []

        def take() -> Iterator[pa.RecordBatch]:
            nonlocal words, counts
            n = np.concatenate(counts)
            while len(words) >= shard or done and words:
                blob = Trie(words[:shard], n[:shard]).pack()
                words, n = words[shard:], n[shard:]
                yield pa.RecordBatch.from_pydict({"blob": pa.array([blob], pa.binary())})
            counts = [n]

        done = False
        for batch in batches:
            words += column(batch, "word").to_pylist()
            counts.append(column(batch, "n").to_numpy())
            if len(words) >= shard:
                yield from take()
        done = True
        if words:
            yield from take()

    ranges = vocabulary.repartitionByRange(max(1, -(-vocabulary.count() // shard)), "word").sortWithinPartitions("word")
    return ranges.mapInArrow(run, "blob binary")


def groups(shards: DataFrame, most: int) -> Iterator[list[bytes]]:
    """The shards in groups of at most `most` bytes (one shard at least)."""
    held: list[bytes] = []
    size = 0
    for row in shards.select("blob").toLocalIterator():  # a part at a time
        if held and size + len(row.blob) > most:
            yield held
            held, size = [], 0
        held.append(bytes(row.blob))
        size += len(row.blob)
    if held:
        yield held


def neighbours(vocabulary: DataFrame, shard: int = SHARD, most: int = GROUP_BYTES) -> DataFrame:
    """(word, n_near, form_n, form): each word's number of near words, and the best of them, for words that have one."""
    spark = vocabulary.sparkSession
    words = checkpoint(vocabulary.select("word").repartition(shuffle_parts(spark), "word"))
    out = []
    for group in groups(checkpoint(tries(vocabulary, shard)), most):
        sent = spark.sparkContext.broadcast(group)
        found = checkpoint(words.mapInArrow(_intersected(sent), "word string, n_near long, form_n long, form string"))
        sent.unpersist()
        out.append(found)
    if not out:
        return spark.createDataFrame([], "word string, n_near long, form_n long, form string")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    # of a word's best in each group the one with the most occurrences; ties: the smallest
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("form_n"), "b.form")


def _intersected(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = [Trie.unpack(b) for b in sent.value]
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                words = column(batch, "word").slice(at, TOGETHER).to_pylist()
                words.sort(key=len)  # alike words, so that a block of letters has little room to spare
                length = np.fromiter(map(len, words), np.int64, len(words))
                text = np.zeros((len(words), int(length.max()) + 1), np.int64)
                text[np.arange(text.shape[1]) < length[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
                n_near = np.zeros(len(words), np.int64)
                best: list[tuple[int, str] | None] = [None] * len(words)
                for trie in shards:
                    q, w = trie.near(text, length)
                    n_near += np.bincount(q, minlength=len(words))
                    order = np.lexsort((w, -trie.counts[w], q))  # a trie's words are in order
                    q, w = q[order], w[order]
                    for i in np.flatnonzero(np.diff(q, prepend=-1)):
                        mine = (-int(trie.counts[w[i]]), trie.words[w[i]])
                        if best[q[i]] is None or mine < best[q[i]]:
                            best[q[i]] = mine
                has = np.flatnonzero(n_near)
                yield pa.RecordBatch.from_pydict({
                    "word": pa.array([words[i] for i in has], pa.string()), "n_near": pa.array(n_near[has]),
                    "form_n": pa.array([-best[i][0] for i in has], pa.int64()), "form": pa.array([best[i][1] for i in has], pa.string()),
                })

    return run


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of forms (word, form), following forms to the last, twice as far with each step."""
    now = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = checkpoint(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return now


def variants(vocabulary: DataFrame, dominant: int = DOMINANT, shard: int = SHARD, most: int = GROUP_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of vocabulary (word, n)."""
    vocabulary = checkpoint(vocabulary)
    rows = vocabulary.join(neighbours(vocabulary, shard, most), "word", "left")
    fits = F.col("form_n") >= dominant * F.col("n")
    rows = checkpoint(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")))
    far = roots(rows.where("form is not null"))
    return rows.join(far, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def grouped(docs: DataFrame, change: Callable[[str, int], str] | None = damaged, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """The variants among all frequent words of docs (doc_id, text)."""
    return variants(counted(docs, change, min_length).where(F.col("n") >= min_count))


#: Near words share the text around one place: a letter each (replaced), or one letter and none.
ORACLE = f"""
WITH RECURSIVE t AS (SELECT {CRC_TABLE} AS crc),
r AS (SELECT doc_id, row, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM (SELECT doc_id, text, row_number() OVER () AS row FROM documents)),
d AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY doc_id, run),
h AS (SELECT run, n, {crc_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM d, t),
c AS (SELECT CASE WHEN h % {DAMAGED} = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM c WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
p AS (SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
g AS (SELECT p.word, q.word AS other, q.n AS other_n FROM p JOIN p q ON p.i = q.i AND p.a = q.a AND p.b = q.b WHERE p.word <> q.word
    UNION SELECT p.word, v.word, v.n FROM p JOIN v ON v.word = p.a || p.b UNION SELECT v.word, p.word, p.n FROM p JOIN v ON v.word = p.a || p.b),
f AS (SELECT word, count(*) AS n_near, arg_min(other, struct_pack(n := -other_n, w := other)) AS form, max(other_n) AS form_n FROM g GROUP BY word),
x AS (SELECT v.word, v.n, coalesce(f.n_near, 0) AS n_near, CASE WHEN f.form_n >= {DOMINANT} * v.n THEN f.form END AS form, CASE WHEN f.form_n >= {DOMINANT} * v.n THEN f.form_n END AS form_n
    FROM v LEFT JOIN f USING (word)),
w AS (SELECT word, word AS root FROM x UNION ALL SELECT w.word, x.form FROM w JOIN x ON x.word = w.root WHERE x.form IS NOT NULL),
k AS (SELECT w.word, w.root FROM w JOIN x ON x.word = w.root WHERE x.form IS NULL)
SELECT x.word, x.form, k.root, x.n, x.n_near, x.form_n FROM x JOIN k USING (word)
"""
