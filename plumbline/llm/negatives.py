"""Hard negatives by bit-sliced integer products.

A row's integer components are sliced into bit planes (two's complement). The score of a row and an anchor is the sum over
planes of the plane's weight times the plane's product with the anchor, taken most significant plane first: after each plane
the score lies between what is known and what the lower planes can still add or take away (the anchor's positive and negative
components times all lower bits). A pair goes as soon as its interval can't meet any band that the anchor asks for, or can't
reach the last of the best found so far. The first planes are products of whole blocks; once few pairs are left, only those
go on, plane by plane, and what is left after the last plane has its exact score.

Anchors are searched twice: for their best rows of the same label (the positives), then for the best rows of other labels
within each positive's band of scores. For each search rows are dealt into cells and every cell meets the anchors in batches;
a cell returns its best of each anchor and band only, which are then reduced by anchor. An anchor never gathers more rows than
cells x its places, and no cell holds more than CELL components of rows, however many anchors pass by. Anchors are split over
cells too where they are many.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part; nor do rows whose
squared length exceeds 2^55, since scores are longs. Unequal lengths: missing components are zero; an empty vector scores 0
with all. A null id is no anchor and comes after all others among ties. Repeated rows take part each, also as each other's
positives; an anchor that is repeated is searched for each. Ties: smaller id, then the place in the input. An empty table
gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import checkpoint, column, shuffle_parts

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
#: Components of rows that a cell holds, anchors of a cell, rows and anchors of one block of products.
CELL, ANCHORS, ROWS, TOGETHER = 1 << 25, 1 << 19, 2048, 256
#: Pairs go on one by one once fewer than one in so many are left.
SPARSE = 8
LONGEST = 1 << 55
WIDEST = np.int64(1 << 62)


def quantised(rows: DataFrame, vec_id: Column, label: Column, vector: Column, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, label, q) of the rows that take part: row is the place in the input, q the components floor(scale * x)."""
    x = F.transform(vector, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("double"))
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    some = rows.select(vec_id.cast("long").alias("vec_id"), label.cast("long").alias("label"), vector.alias("v"), F.monotonically_increasing_id().alias("row"), x.alias("x"), fine.alias("fine"))
    size = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    return some.where("label is not null and v is not null and fine").where(size <= LONGEST).select("row", "vec_id", "label", F.transform("x", lambda v: v.cast("long")).alias("q"))


@dataclass
class Rows:
    """Rows of a cell; none: whether the id is null; q: the components."""

    row: np.ndarray
    vec_id: np.ndarray
    none: np.ndarray
    label: np.ndarray
    q: np.ndarray


def _matrix(lists: pa.Array) -> np.ndarray:
    """A list column as a matrix, padded with zeros."""
    n = lists.value_lengths().fill_null(0).to_numpy()
    out = np.zeros((len(n), int(n.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = lists.flatten().to_numpy()
    return out


def _rows(batch: pa.RecordBatch) -> Rows:
    ids, q = column(batch, "vec_id"), _matrix(column(batch, "q"))
    least = np.result_type(np.min_scalar_type(int(q.min(initial=0))), np.min_scalar_type(int(q.max(initial=0))), np.int16)
    return Rows(column(batch, "row").to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), column(batch, "label").to_numpy(), q.astype(least))


def _blocks(held: list[Rows]) -> list[Rows]:
    """The rows of a cell in blocks of ROWS."""
    wide = max(r.q.shape[1] for r in held)
    q = np.concatenate([np.pad(r.q, ((0, 0), (0, wide - r.q.shape[1]))) for r in held])
    rest = [np.concatenate([getattr(r, x) for r in held]) for x in ("row", "vec_id", "none", "label")]
    return [Rows(*[x[at : at + ROWS] for x in rest], q[at : at + ROWS]) for at in range(0, len(q), ROWS)]


class Best:
    """For each of some anchors and bands the best `k` (score, id) so far, and the score that a row has to reach."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int) -> None:
        """low, high: a row for each anchor, a column for each band; scores are integers, both ends belong to a band."""
        self.low, self.high, self.k = low, high, k
        self.least = low.copy()
        self.held: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 5 for _ in range(low.shape[1])]

    def add(self, anchor: np.ndarray, score: np.ndarray, rows: Rows, at: np.ndarray) -> None:
        for b, held in enumerate(self.held):
            fits = (score >= self.least[anchor, b]) & (score <= self.high[anchor, b])
            if not fits.any():
                continue
            i = at[fits]
            new = [np.concatenate(x) for x in zip(held, (anchor[fits], score[fits], rows.none[i].astype(np.int64), rows.vec_id[i], rows.row[i]), strict=True)]
            a, s, none, ids, row = new
            order = np.lexsort((row, ids, none, -s, a))
            a = a[order]
            first = np.searchsorted(a, a)
            keep = np.arange(len(a)) - first < self.k
            self.held[b] = held = [x[order][keep] for x in new]
            last = np.flatnonzero(np.arange(len(a))[keep] - first[keep] == self.k - 1)
            self.least[held[0][last], b] = np.maximum(self.low[held[0][last], b], held[1][last])


def search(rows: Rows, q: np.ndarray, label: np.ndarray, own: np.ndarray, best: Best, same: bool, sparse: int = SPARSE) -> list[int]:
    """Adds to `best` what `rows` hold for anchors (components q, a row each; label; own: their row). Returns how many pairs
    were left after each plane."""
    d = max(q.shape[1], rows.q.shape[1])
    a = np.zeros((len(q), d), np.int64)
    a[:, : q.shape[1]] = q
    c = rows.q
    if c.shape[1] < d:
        c = np.pad(c, ((0, 0), (0, d - c.shape[1])))
    top = int(max(int(c.max(initial=0)), -int(c.min(initial=0)) - 1, 0)).bit_length()  # the sign's plane
    up, down = np.maximum(a, 0).sum(axis=1), np.minimum(a, 0).sum(axis=1)
    alive = (rows.label[:, None] == label[None, :]) == same
    if same:
        alive &= rows.row[:, None] != own[None, :]
    # sums below 2^53 are exact as doubles, and below 2^24 as floats
    kind = np.float32 if np.abs(a).sum(axis=1).max(initial=0) < 1 << 24 else np.float64
    exact = kind is np.float32 or np.abs(a).sum(axis=1).max(initial=0) < 1 << 53
    at = kind(a).T if exact else a.T
    known = np.zeros(alive.shape, np.int64)
    left = []
    plane = top
    while plane >= 0:
        bits = (c >> plane) & 1
        part = (bits.astype(kind) @ at).astype(np.int64) if exact else bits @ at
        known += part * (-1 << plane if plane == top else 1 << plane)
        rest = (1 << plane) - 1
        most, least = known + rest * up, known + rest * down
        can = np.zeros(alive.shape, bool)
        for b in range(best.low.shape[1]):
            can |= (most >= best.least[:, b]) & (least <= best.high[:, b])
        alive &= can
        plane -= 1
        left.append(n := int(alive.sum()))
        if n * sparse < alive.size:
            break
    i, j = np.nonzero(alive)
    known = known[i, j]
    while plane >= 0 and len(i):
        part = np.empty(len(i), np.int64)
        for s in range(0, len(i), 65_536):  # bounded memory
            e = s + 65_536
            part[s:e] = (((c[i[s:e]] >> plane) & 1) * a[j[s:e]]).sum(axis=1)
        known = known + part * (-1 << plane if plane == top else 1 << plane)
        rest = (1 << plane) - 1
        most, least = known + rest * up[j], known + rest * down[j]
        can = ((most[:, None] >= best.least[j]) & (least[:, None] <= best.high[j])).any(axis=1)
        i, j, known = i[can], j[can], known[can]
        plane -= 1
        left.append(len(i))
    best.add(j, known, rows, i)
    return left


def _bands(scores: pa.Array | None, n: int, places: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The lowest and highest scores that n anchors ask for, a column for each place; without scores one band of all."""
    if scores is None:
        return np.full((n, 1), -WIDEST), np.full((n, 1), WIDEST)
    s = _matrix(scores)
    s = np.pad(s, ((0, 0), (0, places - s.shape[1])))
    there = np.arange(places) < scores.value_lengths().to_numpy()[:, None]  # a place without a positive asks for nothing
    return np.where(there, -(-s * low // 100), WIDEST), np.where(there, s * high // 100, -WIDEST)


def _best(rows: DataFrame, anchors: DataFrame, k: int, places: int = 0, low: int = 0, high: int = 0) -> DataFrame:
    """(anchor, place, score, vec_id, row, nth): the best k rows for each anchor (row, label, q, scores), of its label; or,
    if there are places, for each of its scores the best k of other labels from `low` to `high` percent of it."""
    spark = rows.sparkSession
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("d")).first()
    # as many as memory asks for, and for more cores as long as a cell has a whole block of rows
    cells = max(1, min(shuffle_parts(spark), size.n // ROWS), -(-size.n * max(size.d or 0, 1) // CELL))
    slabs = max(1, -(-anchors.count() // ANCHORS))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    here = rows.select(dealt(cells).alias("cell"), every(slabs).alias("slab"), F.lit(False).alias("passes"), "row", "vec_id", "label", "q", F.lit(None).cast("array<bigint>").alias("scores"))
    there = anchors.select(every(cells).alias("cell"), dealt(slabs).alias("slab"), F.lit(True).alias("passes"), "row", "vec_id", "label", "q", "scores")
    both = here.unionByName(there).withColumn("part", F.col("cell") * slabs + F.col("slab"))
    both = both.repartitionById(cells * slabs, "part").sortWithinPartitions("passes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a cell come first, then the anchors that pass by."""
        held: list[Rows] = []
        blocks: list[Rows] = []
        for batch in batches:
            n = batch.num_rows - pc.sum(column(batch, "passes")).as_py()
            if n:
                held.append(_rows(batch.slice(0, n)))
            if n < batch.num_rows and held:
                blocks, held = _blocks(held), []
            for at in range(n, batch.num_rows, TOGETHER):
                some = batch.slice(at, TOGETHER)
                q, own, label = _matrix(column(some, "q")), column(some, "row").to_numpy(), column(some, "label").to_numpy()
                best = Best(*_bands(column(some, "scores") if places else None, len(own), places, low, high), k)
                for block in blocks:
                    search(block, q, label, own, best, same=not places)
                for place, (anchor, score, none, ids, row) in enumerate(best.held):
                    found = {"anchor": own[anchor], "place": np.full(len(anchor), place, np.int32), "score": score, "vec_id": pa.array(ids, mask=none.astype(bool)), "row": row}
                    yield pa.RecordBatch.from_pydict({name: pa.array(x) for name, x in found.items()})

    found = both.mapInArrow(run, "anchor long, place int, score long, vec_id long, row long")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def mined(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows (row, vec_id, label, q) that
    are anchors: for each of an anchor's first `positives` rows of its label, the first `negatives` of other labels whose
    score is between `low` and `high` percent of the positive's."""
    rows = checkpoint(rows)
    anchors = rows.where(is_anchor)
    near = checkpoint(_best(rows, anchors.withColumn("scores", F.lit(None).cast("array<bigint>")), positives))
    scores = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("nth", "score"))).alias("s"))  # `positives` at most
    far = _best(rows, anchors.join(scores.select(F.col("anchor").alias("row"), F.col("s.score").alias("scores")), "row"), negatives, positives, low, high)
    pairs = near.select("anchor", (F.col("nth") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    got = far.select("anchor", "place", F.col("nth").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return got.join(pairs, ["anchor", "place"]).join(named, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def digest_rows(embeddings: DataFrame) -> DataFrame:
    """The rows of the query's contract: labels of ids that 7 divides are moved by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return quantised(embeddings, F.col("vec_id"), label, F.col("embedding"))


ORACLE = f"""
WITH e AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL),
v AS (SELECT row, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS q FROM e
    WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.row AS anchor, a.vec_id AS anchor_id, c.row, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.q, c.q) AS BIGINT) AS score
    FROM v a JOIN v c ON a.row <> c.row WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor, row, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (SELECT s.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor, p.row ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
    FROM p JOIN s USING (anchor) WHERE NOT s.same AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
