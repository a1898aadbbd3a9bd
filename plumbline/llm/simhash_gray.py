"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints of 64 bits that differ in at most four agree in one of five blocks of bits, so each distinct fingerprint is
sent to five groups, one for each block's value. A group too large for a task is split again in the same way by the bits
that are still free; as fingerprints are distinct, that ends. Within a group the fingerprints are sorted by Gray rank, so
neighbours share many bits; runs of neighbours form nodes, runs of nodes their parents. A node holds only the shared bits
that its parent has not (a mask and a pattern); a search adds up the differences on its way down and prunes a whole node
once they pass the limit, or takes a whole node when its members cannot be too far any more. A group returns a spanning
forest of its links, not its pairs.

Defined cases: null or empty text, or one without words: fingerprint zero, linked like any other. Fewer than four words:
one shingle. Repeated rows each get their row. A null doc_id never names a component unless no other is in it. Other
columns are ignored by `components` and kept by `one_of_each`; clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import graph
from plumbline.llm.common import checkpoint, column, filter_pages, marked, shuffle_parts, slices

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Fingerprints that one group may hold; larger groups are split.
GROUP = 4096
FANOUT = 8
#: Rows of groups that are searched together, and candidates that are held at once.
TOGETHER, FRONTIER = 16_384, 1 << 20

_U = np.uint64


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles, unsigned."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    whole, k = b" ".join(words), min(size, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(whole[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        ones += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and `fp` (the fingerprint's bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                got = np.array([fingerprint(t) for t in column(part, "text").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(column(part, k) for k in keep), pa.array(got)], names=[*keep, "fp"])

    rows = docs.select(*keep, "text") if "text" not in keep else docs.select(*keep)
    return rows.mapInArrow(run, rows.select(*keep).schema.add("fp", "long"))


def gray_rank(code: np.ndarray) -> np.ndarray:
    """The place of a bit pattern in the reflected Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code ^ (code >> _U(shift))
    return code


@lru_cache(maxsize=4096)
def blocks(mask: int, n: int = DISTANCE + 1) -> tuple[int, ...]:
    """The bits outside `mask` in n runs of nearly equal length, each together with `mask`."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * i // n for i in range(n + 1)]
    return tuple(mask | sum(1 << b for b in free[cuts[i] : cuts[i + 1]]) for i in range(n))


def forest(group: np.ndarray, code: np.ndarray, limit: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of codes, a spanning forest of the links (at most `limit` differing bits) within each group."""
    order = np.lexsort((gray_rank(code), group))
    g, c = group[order], code[order]
    n = len(c)
    # from the leaves up: (shared bits, their pattern, first child, number of children)
    levels = [(np.full(n, ~_U(0)), c, np.arange(n), np.ones(n, np.int64))]
    ors, ands, owner = c, c, g
    while True:
        new = np.concatenate([[True], owner[1:] != owner[:-1]])
        if new.all():
            break
        first = np.flatnonzero(new)
        place = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
        head = np.flatnonzero(place % FANOUT == 0)
        ors, ands, owner = np.bitwise_or.reduceat(ors, head), np.bitwise_and.reduceat(ands, head), owner[head]
        levels.append((~(ors ^ ands), ands, head, np.diff(np.append(head, len(place)))))
    root_of = np.cumsum(np.concatenate([[True], g[1:] != g[:-1]])) - 1
    label = np.arange(n)
    first_leaf = [np.arange(n)]
    for _, _, head, _ in levels[1:]:
        first_leaf.append(first_leaf[-1][head])
    found_a, found_b = [], []

    def down(q: np.ndarray, node: np.ndarray, acc: np.ndarray, level: int, above: np.ndarray) -> None:
        """above: the shared bits that the way down has counted already, for each candidate."""
        shared, pattern, head, count = levels[level]
        acc = acc + np.bitwise_count((c[q] ^ pattern[node]) & shared[node] & ~above)
        near = acc <= limit
        if level == 0:
            near &= node < q
            found_a.append(q[near])
            found_b.append(node[near])
            return
        q, node, acc = q[near], node[near], acc[near]
        sure = acc + (64 - np.bitwise_count(shared[node])) <= limit
        if sure.any():
            found_a.append(q[sure])
            found_b.append(first_leaf[level][node[sure]])
            q, node, acc = q[~sure], node[~sure], acc[~sure]
        k = count[node]
        upto = np.cumsum(k)
        at = 0
        while at < len(k):  # a bounded number of candidates at once
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + FRONTIER, "right")))
            kk = k[at:end]
            inner = np.arange(kk.sum()) - np.repeat(np.cumsum(kk) - kk, kk)
            down(np.repeat(q[at:end], kk), np.repeat(head[node[at:end]], kk) + inner, np.repeat(acc[at:end], kk), level - 1, np.repeat(shared[node[at:end]], kk))
            at = end

    def settle() -> None:
        """Joins what was found into `label`."""
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        found_a.clear()
        found_b.clear()
        while len(a):
            la, lb = label[a], label[b]
            open_ = la != lb
            a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                again = label[label]
                if (again == label).all():
                    break
                label[:] = again

    step = max(256, FRONTIER // 256)
    for at in range(0, n, step):
        q = np.arange(at, min(n, at + step))
        down(q, root_of[q], np.zeros(len(q), np.uint8), len(levels) - 1, np.zeros(len(q), np.uint64))
        settle()
    joined = np.flatnonzero(label != np.arange(n))
    return c[joined], c[label[joined]]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups (mask, value) in order, as many together as TOGETHER rows; none is larger than GROUP."""
    held: list[np.ndarray] = []
    rows = 0

    def take(parts: list[np.ndarray]) -> pa.RecordBatch:
        m = np.concatenate(parts)
        key = np.concatenate([[True], (m[1:, :2] != m[:-1, :2]).any(axis=1)]).cumsum()
        a, b = forest(key, m[:, 2].copy().view(np.uint64))
        return pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    for batch in batches:
        m = np.stack([column(batch, k).to_numpy() for k in ("mask", "value", "fp")], axis=1)
        if not len(m):
            continue
        held.append(m)
        rows += len(m)
        if rows >= TOGETHER:
            m = np.concatenate(held)
            last = np.flatnonzero((m[:, :2] == m[-1, :2]).all(axis=1))[0]
            if last:
                yield take([m[:last]])
            held, rows = [m[last:]], len(m) - last
    if rows:
        yield take(held)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each (mask, fp) once for each block of the bits outside the mask."""
    for batch in batches:
        mask, fp = column(batch, "mask").to_numpy(), column(batch, "fp").to_numpy()
        for m in np.unique(mask):
            some = fp[mask == m]
            for wide in blocks(int(np.int64(m).view(np.uint64))):
                w = np.uint64(wide).view(np.int64)
                yield pa.RecordBatch.from_pydict({"mask": pa.array(np.full(len(some), w)), "value": pa.array(some & w), "fp": pa.array(some)})


def links(prints: DataFrame, group: int = GROUP) -> DataFrame:
    """(a, b): pairs of distinct fingerprints that connect all those within DISTANCE of each other."""
    spark = prints.sparkSession
    todo = prints.select("fp").distinct().select(F.lit(0).cast("long").alias("mask"), "fp")
    out = None
    while True:
        rows = todo.mapInArrow(_spread, "mask long, value long, fp long")
        crowded = checkpoint(rows.groupBy("mask", "value").count().where(F.col("count") > group).select("mask", "value"))
        last = crowded.isEmpty()
        small = rows if last else rows.join(crowded, ["mask", "value"], "left_anti").select("mask", "value", "fp")
        found = small.repartition(shuffle_parts(spark), "mask", "value").sortWithinPartitions("mask", "value").mapInArrow(_search, "a long, b long")
        out = found if out is None else out.unionByName(found)
        if last:
            return out
        todo = checkpoint(rows.join(crowded, ["mask", "value"], "left_semi").select("mask", "fp"))


def _component_of(prints: DataFrame, group: int) -> DataFrame:
    """(fp, label) of every distinct fingerprint of prints (doc_id, fp). A fingerprint's node is its smallest doc_id (a null
    one after all others) and itself; the label is the component's smallest node, which the graph's steps bring to each of
    its members, so that no component is ever gathered under one key."""
    node = F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"), "fp")
    classes = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).select("fp", node.alias("node")))
    named = lambda k: classes.select(F.col("fp").alias(k), F.col("node").alias(f"node_{k}"))
    pairs = links(classes, group).join(named("a"), "a").join(named("b"), "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    joined = graph.components(pairs).select(F.col("node.fp").alias("fp"), "label")
    return checkpoint(classes.join(joined, "fp", "left").select("fp", F.coalesce("label", "node").alias("label")))


def components(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, fingerprint as 16 hexadecimal digits, component_id of every row."""
    prints = checkpoint(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"]))
    named = _component_of(prints, group)
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("label.id").alias("component_id"))


def one_of_each(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """docs, all columns, without the documents of a component but its smallest doc_id; among rows with that doc_id the
    smallest digest of the text stays, and one of rows equal in both. Only texts that may have to go are exchanged."""
    digest = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    doc_id = F.col("doc_id").cast("long")
    slim = docs.select(doc_id.alias("doc_id"), "text", digest.alias("digest"))
    prints = checkpoint(fingerprints(slim, ["doc_id", "digest"]))
    rows = prints.groupBy("doc_id", "digest").agg(F.first("fp").alias("fp"), F.count(F.lit(1)).alias("n"))
    rows = checkpoint(rows.join(_component_of(prints, group), "fp").select("doc_id", "digest", "n", "label"))
    mine = F.col("doc_id").eqNullSafe(F.col("label.id"))
    stays = rows.where(mine).groupBy("label").agg(F.min("digest").alias("s_digest")).select(F.col("label.id").alias("s_id"), "s_digest")
    first = F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("digest") == F.col("s_digest"))
    go = rows.join(stays, first, "left_anti").select("doc_id", "digest", F.lit(False).alias("__plumbline_one"))
    # of rows equal in both, one stays
    go = go.unionByName(rows.where("n > 1").join(stays, first, "left_semi").select("doc_id", "digest", F.lit(True).alias("__plumbline_one")))
    go = checkpoint(go.withColumnsRenamed({"doc_id": "__plumbline_id", "digest": "__plumbline_digest"}))
    spot = marked(docs, F.xxhash64(doc_id, digest), filter_pages(go, F.xxhash64("__plumbline_id", "__plumbline_digest")), "__plumbline_near")
    same = doc_id.eqNullSafe(F.col("__plumbline_id")) & (digest == F.col("__plumbline_digest"))
    left = spot.where("not __plumbline_near").select(*docs.columns)
    near = spot.where("__plumbline_near").join(go, same, "left")
    left = left.unionByName(near.where("__plumbline_one is null").select(*docs.columns))
    whole = F.first(F.struct(*docs.columns)).alias("row")  # combined before the exchange
    one = near.where("__plumbline_one").groupBy("__plumbline_id", "__plumbline_digest").agg(whole).select("row.*")
    return left.unionByName(one)
