"""LambdaMART: trees that are grown on listwise gradients, over distributed histograms.

Rows are candidates of queries, a bounded list each (the reranked places), with a grade and features. Features become bins
once. A query's candidates lie together in a part, so that a pass over the rows makes each query's gradients (for every pair of
unequal grades, how far the scores are from the right order, times what swapping the two would change of the query's NDCG)
and adds them up by node, feature and bin; nothing but these sums, whose number has nothing to do with the rows, goes to the
driver, which chooses the splits of a level. Gradients are added as integers on a fine grid, so the trees do not depend on how
rows are dealt. A model is a table of nodes, stored under the digest of what it was fitted on; its score is one SQL expression.

Defined cases: a query whose grades are all alike has no gradients. A null feature goes left, one that is no number right.
Equal scores are ordered by document. Without rows, or without unequal grades, the model has no nodes and scores 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.sources.tables import cached, index_path, materialised

#: Units of the grid on which gradients are added, and rows whose pairs are made together.
GRID, TOGETHER = 1 << 30, 1 << 18
#: Keeps a leaf of little evidence near zero, and is the least number of rows of a leaf.
DAMPING, LEAST = 1.0, 5
VERSION = "listwise-1"
NODES = "tree int, node int, feature string, threshold double, value double"


@dataclass
class Tree:
    """A complete binary tree: node i has the children 2i + 1 and 2i + 2; feature -1: a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (2 << depth) - 1
        return cls(np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n))

    def node(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row ends in."""
        at = np.zeros(len(bins), np.int64)
        while True:
            open_ = np.flatnonzero(self.feature[at] >= 0)
            if not len(open_):
                return at
            now = at[open_]
            at[open_] = 2 * now + 1 + (bins[open_, self.feature[now]] > self.bin[now])


def gradients(query: np.ndarray, grade: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each row's score should grow by, and how firmly, for rows in order of query (and of document within it)."""
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(query)))
    out, weight = np.zeros(len(query)), np.zeros(len(query))
    for n in np.unique(size):  # queries of one length together
        which = first[size == n]
        step = max(1, TOGETHER // int(n * n))
        for k in range(0, len(which), step):
            at = which[k : k + step, None] + np.arange(n)
            s, g = score[at], np.exp2(grade[at]) - 1
            place = np.empty_like(at)
            np.put_along_axis(place, np.argsort(-s, axis=1, kind="stable"), np.broadcast_to(np.arange(n), at.shape), axis=1)
            discount = 1 / np.log2(place + 2.0)
            ideal = (np.sort(g, axis=1)[:, ::-1] / np.log2(np.arange(n) + 2.0)).sum(axis=1)
            better = g[:, :, None] > g[:, None, :]
            swap = np.abs((g[:, :, None] - g[:, None, :]) * (discount[:, :, None] - discount[:, None, :])) / np.maximum(ideal, 1e-12)[:, None, None]
            wrong = 1 / (1 + np.exp(np.clip(s[:, :, None] - s[:, None, :], -50, 50)))
            pull, firm = np.where(better, swap * wrong, 0.0), np.where(better, swap * wrong * (1 - wrong), 0.0)
            out[at] = pull.sum(axis=2) - pull.sum(axis=1)
            weight[at] = firm.sum(axis=2) + firm.sum(axis=1)
    return out, weight


def cuts(rows: DataFrame, names: Sequence[str], bins: int) -> list[list[float]]:
    """Each feature's bounds between bins, ascending and distinct."""
    got = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), [i / bins for i in range(1, bins)], 10_000).alias(c) for c in names]).first()
    return [sorted({x for x in got[c] or () if x is not None and x == x}) for c in names]


def binned(rows: DataFrame, names: Sequence[str], bounds: list[list[float]]) -> DataFrame:
    """(query, doc, grade, bins), a query's rows together."""
    bin_ = lambda c, b: F.size(F.filter(F.array(*map(F.lit, b)).cast("array<double>"), lambda x: x < F.col(c).cast("double"))).cast("int")
    slim = rows.select(F.xxhash64("query").alias("part"), "query", "doc", F.col("label").cast("double").alias("grade"), F.array(*[bin_(c, b) for c, b in zip(names, bounds, strict=True)]).alias("bins"))
    return materialised(slim.repartition("part").sortWithinPartitions("part", "query", "doc").select("query", "grade", "bins"))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query's number, grade, bins) of whole queries."""
    held: list[pa.RecordBatch] = []

    def take(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(parts).combine_chunks()
        q = t.column("query").chunk(0).dictionary_encode().indices.to_numpy()
        bins = t.column("bins").chunk(0).flatten().to_numpy()
        return q, t.column("grade").to_numpy(), bins.reshape(len(q), -1)

    for batch in batches:
        if not batch.num_rows:
            continue
        query = batch.column(batch.schema.get_field_index("query"))
        last = query[batch.num_rows - 1]
        cut = batch.num_rows
        while cut and query[cut - 1].equals(last):
            cut -= 1
        if cut:
            yield take([*held, batch.slice(0, cut)])
            held = []
        elif held and not held[-1].column(held[-1].schema.get_field_index("query"))[0].equals(last):
            yield take(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield take(held)


def _histograms(rows: DataFrame, trees: list[Tree], growing: Tree, n_features: int, n_bins: int, rate: float) -> dict[int, np.ndarray]:
    """For each node that rows end in: (feature, bin, [gradient, weight, rows])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for query, grade, bins in _whole(batches):
            score = sum((t.value[t.node(bins)] for t in trees), np.zeros(len(query))) * rate
            g, h = gradients(query, grade, score)
            g, h = np.rint(g * GRID).astype(np.int64), np.rint(h * GRID).astype(np.int64)
            node = growing.node(bins)
            for at in np.unique(node):
                mine = node == at
                total = sums.setdefault(int(at), np.zeros((n_features, n_bins, 3), np.int64))
                for f in range(n_features):
                    for i, v in enumerate((g[mine], h[mine], np.ones(mine.sum(), np.int64))):
                        np.add.at(total[f, :, i], bins[mine, f], v)
        for at, total in sums.items():
            yield pa.RecordBatch.from_pydict({"node": pa.array([at] * total[..., 0].size, pa.int32()), "slot": pa.array(np.arange(total[..., 0].size, dtype=np.int32)), **{c: pa.array(total[..., i].ravel()) for i, c in enumerate(("g", "h", "n"))}})

    added = rows.mapInArrow(run, "node int, slot int, g long, h long, n long").groupBy("node", "slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    out: dict[int, np.ndarray] = {}
    for r in added.collect():  # nodes of a level x features x bins
        out.setdefault(r.node, np.zeros((n_features * n_bins, 3)))[r.slot] = r.g / GRID, r.h / GRID, r.n
    return {k: v.reshape(n_features, n_bins, 3) for k, v in out.items()}


def _split(total: np.ndarray) -> tuple[float, int, int, np.ndarray, np.ndarray]:
    """The best (gain, feature, last bin of the left) of a node, and both sides' sums."""
    left = np.cumsum(total, axis=1)
    whole = left[:, -1:, :]
    right = whole - left
    worth = lambda x: x[..., 0] ** 2 / (x[..., 1] + DAMPING)
    gain = np.where((left[..., 2] >= LEAST) & (right[..., 2] >= LEAST), worth(left) + worth(right) - worth(whole), -np.inf)
    f, b = np.unravel_index(np.argmax(gain), gain.shape)  # the first of equal ones
    return float(gain[f, b]), int(f), int(b), left[f, b], right[f, b]


def fitted(rows: DataFrame, names: Sequence[str], trees: int = 20, depth: int = 3, rate: float = 0.3, bins: int = 32) -> DataFrame:
    """The nodes of a model fitted on rows (query, doc, label, and the features)."""
    bounds = cuts(rows, names, bins)
    data = binned(rows, names, bounds)
    grown: list[Tree] = []
    for _ in range(trees):
        tree = Tree.empty(depth)
        for level in range(depth):
            sums = _histograms(data, grown, tree, len(names), bins, rate)
            ready = {k: v for k, v in sums.items() if k >= (1 << level) - 1}  # earlier leaves stay leaves
            split = False
            for node, total in ready.items():
                gain, f, b, left, right = _split(total)
                if gain > 1e-9 and b < len(bounds[f]):
                    tree.feature[node], tree.bin[node], split = f, b, True
                    for child, s in ((2 * node + 1, left), (2 * node + 2, right)):
                        tree.value[child] = s[0] / (s[1] + DAMPING)
            if not split:
                break
        if tree.feature[0] < 0:
            break
        grown.append(tree)
    table = [
        (t, n, names[x.feature[n]] if x.feature[n] >= 0 else None, bounds[x.feature[n]][x.bin[n]] if x.feature[n] >= 0 else None, float(rate * x.value[n]))
        for t, x in enumerate(grown) for n in range(len(x.feature)) if n == 0 or x.feature[(n - 1) // 2] >= 0
    ]
    return rows.sparkSession.createDataFrame(table, NODES)


def score(nodes: DataFrame) -> Column:
    """The model's score as an expression of the feature columns. Nodes are as many as trees have, whatever was fitted on."""
    model = {(r.tree, r.node): r for r in nodes.collect()}

    def value(tree: int, node: int) -> Column:
        r = model[tree, node]
        if r.feature is None:
            return F.lit(r.value)
        return F.when(F.col(r.feature).cast("double") > r.threshold, value(tree, 2 * node + 2)).otherwise(value(tree, 2 * node + 1))

    return sum((value(t, 0) for t in sorted({t for t, _ in model})), F.lit(0.0))


def stored(spark: SparkSession, root: str, rows: DataFrame, names: Sequence[str], **how) -> DataFrame:
    """The nodes of a model of just these rows and settings: read if they were fitted before and are whole, else fitted."""
    version = "-".join([VERSION, *(f"{k}{v}" for k, v in sorted(how.items()))])
    return cached(spark, index_path(root, version, rows.select("query", "doc", "label", *names)), lambda: fitted(rows, names, **how))


def ndcg(ranked: DataFrame, k: int = 10) -> DataFrame:
    """(queries, ndcg): the mean over queries with a grade above 0 of ranked (query, doc, label, score), the first k counted."""
    gain = F.pow(F.lit(2.0), F.col("label").cast("double")) - 1
    by = lambda *order: F.row_number().over(Window.partitionBy("query").orderBy(*order))
    rows = ranked.select("query", gain.alias("gain"), by(F.desc("score"), F.asc("doc")).alias("at"), by(F.desc("label"), F.asc("doc")).alias("best"))
    dcg = lambda at: F.sum(F.when(F.col(at) <= k, F.col("gain") / F.log2(F.col(at) + 1.0)).otherwise(0.0))
    each = rows.groupBy("query").agg(dcg("at").alias("got"), dcg("best").alias("ideal")).where("ideal > 0")
    return each.agg(F.count(F.lit(1)).alias("queries"), F.avg(F.col("got") / F.col("ideal")).alias("ndcg"))
