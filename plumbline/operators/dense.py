"""Exact cosine neighbours with partitions around pivots.

Unit vectors are dealt to the nearest of some pivots and sorted by pivot and angle to it, in parts of nearly equal size; a part
knows, for each pivot that it has vectors of, from which angle to which they lie. By the triangle inequality of angles a
query can't be closer to any of them than the difference between its own angle to the pivot and theirs. A query first goes to
the parts where its bound is highest, until they hold k vectors; the k-th score that it finds is a threshold, and it goes on only to
parts whose bound reaches that. Within a part the same holds for blocks, so a block is multiplied only with the queries that it can
serve. Nothing is estimated: what is skipped can't be among the best k.

Pivots are at most PIVOTS vectors, those with the smallest hash of their ids; they bound only how much is skipped, never what is
found. A part holds the vectors of one task, whatever their number; queries pass by in batches.

Defined cases: null vectors, and those with a component that is null or no finite number, take no part; a vector of zeros has
cosine 0 with all; vectors of unequal length are an error. Scores are rounded to six places before they are ranked, ties go to the
smaller id. Without documents there are no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.tables import materialised

PIVOTS = 256
#: Vectors of a part and of a block of it, queries that meet a part together.
PART, BLOCK, TOGETHER = 1 << 17, 256, 256
DIGITS, MARGIN = 6, 5e-6


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def matrix(lists: pa.Array, dim: int | None = None) -> np.ndarray:
    """Unit vectors of a list column, a row each."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    dim = (len(flat) // len(lists) if len(lists) else 0) if dim is None else dim
    if len(lists) and not (lists.value_lengths().to_numpy() == dim).all():
        raise ValueError(f"vectors of {dim} components are expected")
    m = flat.reshape(len(lists), dim)
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def bound(angle: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The highest cosine with a vector whose angle to a pivot lies between low and high, for one at `angle` to it."""
    return np.cos(np.maximum(0.0, np.maximum(angle - high, low - angle)))


def _sound(rows: DataFrame, id_: str) -> DataFrame:
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return rows.select(F.col(id_).cast("long").alias(id_), F.col("vector").cast("array<double>").alias("vector")).where(F.col("vector").isNotNull() & whole)


def placed(docs: DataFrame, pivots: np.ndarray, parts: int) -> DataFrame:
    """(part, cell, angle, doc, vector) in the shared folder, each part sorted by cell and angle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosine = matrix(_column(batch, "vector"), pivots.shape[1]) @ pivots.T
                cell = cosine.argmax(axis=1)
                angle = _angle(cosine[np.arange(len(cell)), cell])
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(angle), _column(batch, "doc"), _column(batch, "vector")], names=["cell", "angle", "doc", "vector"])

    rows = docs.mapInArrow(run, "cell int, angle double, doc long, vector array<double>")
    order = ["cell", "angle", "doc"]  # an id, so that copies of a vector may lie in several parts
    return materialised(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))


def _multiplied(part: list[pa.RecordBatch], pivots: np.ndarray):
    """A part's blocks: (cell, lowest and highest angle, ids, unit vectors)."""
    t = pa.Table.from_batches(part).sort_by([("cell", "ascending"), ("angle", "ascending"), ("doc", "ascending")]).combine_chunks()
    cell, angle, doc = (t.column(c).chunk(0).to_numpy() for c in ("cell", "angle", "doc"))
    vectors = matrix(t.column("vector").chunk(0), pivots.shape[1])
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    cuts = [b for a, z in zip(starts, [*starts[1:], len(cell)], strict=True) for b in range(a, z, BLOCK)]
    return [(int(cell[a]), angle[a], angle[z - 1], doc[a:z], vectors[a:z]) for a, z in zip(cuts, [*cuts[1:], len(cell)], strict=True)]


def _met(rows: DataFrame, docs: DataFrame, pivots: np.ndarray, k: int, parts: int) -> DataFrame:
    """(query, doc, score, multiplied): the best k of a part for each query (part, query, vector, threshold) that goes there, and
    a row without a document with the number of vectors that the query was multiplied with."""
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    here = docs.select("part", F.lit(False).alias("asks"), "cell", "angle", "doc", "vector", none(rows, "query"), none(rows, "threshold"))
    there = rows.select("part", F.lit(True).alias("asks"), none(docs, "cell"), none(docs, "angle"), none(docs, "doc"), "vector", "query", "threshold")
    both = here.unionByName(there).repartitionById(parts, "part").sortWithinPartitions("asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        blocks = None

        def passed(some: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            query, v = _column(some, "query").to_numpy(), matrix(_column(some, "vector"), pivots.shape[1])
            least = _column(some, "threshold").to_numpy(zero_copy_only=False).astype(np.float64).copy()
            angles = _angle(v @ pivots.T)
            bounds = np.stack([bound(angles[:, c], low, high) for c, low, high, _, _ in blocks], axis=1)
            score, doc = np.full((len(query), k), -np.inf), np.full((len(query), k), np.iinfo(np.int64).max)
            done = np.zeros(len(query), np.int64)
            for b in np.argsort(-bounds.max(axis=0)):
                who = np.flatnonzero(bounds[:, b] >= least - MARGIN)
                if not len(who):
                    continue
                _, _, _, ids, m = blocks[b]
                done[who] += len(ids)
                s = np.concatenate([score[who], np.round(v[who] @ m.T, DIGITS)], axis=1)
                d = np.concatenate([doc[who], np.broadcast_to(ids, (len(who), len(ids)))], axis=1)
                order = np.lexsort((d, -s), axis=1)[:, :k]
                score[who], doc[who] = np.take_along_axis(s, order, axis=1), np.take_along_axis(d, order, axis=1)
                least[who] = np.maximum(least[who], score[who, -1])
            there = score > -np.inf
            yield pa.RecordBatch.from_pydict({"query": pa.array(np.repeat(query, there.sum(axis=1))), "doc": pa.array(doc[there]), "score": pa.array(score[there]), "multiplied": pa.nulls(int(there.sum()), pa.int64())})
            yield pa.RecordBatch.from_pydict({"query": pa.array(query), "doc": pa.nulls(len(query), pa.int64()), "score": pa.nulls(len(query), pa.float64()), "multiplied": pa.array(done)})

        for batch in batches:
            n = batch.num_rows - (pc.sum(_column(batch, "asks")).as_py() or 0)
            if n:
                held.append(batch.slice(0, n))
            if n < batch.num_rows and held:
                blocks, held = _multiplied(held, pivots), []
            for at in range(n, batch.num_rows, TOGETHER):
                if blocks:
                    yield from passed(batch.slice(at, min(TOGETHER, batch.num_rows - at)))

    return both.mapInArrow(run, "query long, doc long, score double, multiplied long")


def searched(queries: DataFrame, docs: DataFrame, k: int, pivots: int = PIVOTS, parts: int | None = None) -> DataFrame:
    """(query, doc, score, multiplied) from all parts that a query went to, as `_met` gives them: the best k of queries (query,
    vector) among docs (doc, vector) are among them."""
    spark = docs.sparkSession
    queries, docs = _sound(queries, "query"), _sound(docs, "doc")
    first = docs.select("doc", "vector").orderBy(F.xxhash64("doc"), "doc").limit(pivots).collect()
    if not first:
        return spark.createDataFrame([], "query long, doc long, score double, multiplied long")
    centres = matrix(pa.array([r.vector for r in first], pa.list_(pa.float64())))
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // PART))
    docs = placed(docs, centres, parts)
    # a row for each part and pivot: as many as both together at most
    lies = np.array([tuple(r) for r in docs.groupBy("part", "cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("n")).orderBy("part", "cell").collect()], np.float64)
    part, cell, low, high, n = lies[:, 0].astype(np.int64), lies[:, 1].astype(np.int64), lies[:, 2], lies[:, 3], lies[:, 4]

    def sent(more: bool):
        """The parts that a query goes to first, or those that it still has to go to."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, TOGETHER):
                    some = batch.slice(at, TOGETHER)
                    bounds = bound(_angle(matrix(_column(some, "vector"), centres.shape[1]) @ centres.T)[:, cell], low, high)
                    order = np.argsort(-bounds, axis=1, kind="stable")
                    upto = np.cumsum(n[order], axis=1)
                    near = np.zeros((some.num_rows, parts), bool)
                    # until they hold k vectors
                    row, place = np.nonzero(np.concatenate([np.ones((some.num_rows, 1), bool), upto[:, :-1] < k], axis=1))
                    near[row, part[order[row, place]]] = True
                    if more:
                        least = _column(some, "threshold").to_numpy(zero_copy_only=False).astype(np.float64)
                        reach = np.zeros_like(near)
                        row, place = np.nonzero(bounds >= least[:, None] - MARGIN)
                        reach[row, part[place]] = True
                        near = reach & ~near
                    row, to = np.nonzero(near)
                    yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), *(_column(some, c).take(pa.array(row)) for c in ("query", "vector", "threshold"))], names=["part", "query", "vector", "threshold"])

        return run

    kinds = "part int, query long, vector array<double>, threshold double"
    asks = materialised(queries.withColumn("threshold", F.lit(float("-inf"))))
    one = materialised(_met(asks.mapInArrow(sent(False), kinds), docs, centres, k, parts))
    kth = one.where("doc is not null").groupBy("query").agg(F.sort_array(F.collect_list("score"), False).alias("s"))  # k of a few parts
    kth = kth.select("query", F.coalesce(F.get("s", F.lit(k - 1)), F.lit(float("-inf"))).alias("threshold"))
    rest = asks.drop("threshold").join(kth, "query").select("query", "vector", "threshold").mapInArrow(sent(True), kinds)
    return one.unionByName(_met(rest, docs, centres, k, parts))
