"""A stored lexical index, and BM25 over it.

Documents are indexed where they are read: each batch of documents becomes a cell, a row for every term with its documents,
frequencies and lengths in order of document, and for each block of BLOCK postings the highest frequency and the least length,
which bound what a posting of the block can score whatever the parameters. A last row, of no term, counts the cell's
documents and their lengths. Nothing is exchanged; more documents are more cells, so an index is extended by appending,
and counts of documents, lengths and frequencies are summed when it is read.

A query reads the rows of its terms alone. In a cell its terms are taken from the highest bound down; a block whose bound,
with all that the later terms can add, stays below the k-th best score so far gives no new documents, and is opened only if a
document that is still in the running lies in it (MaxScore with block bounds). A cell returns k rows for each query; blocks
and opened blocks are counted.

Defined cases: null texts are documents without terms; ids are distinct integers. A term of a query counts once for each time
it is given. Ties go to the smaller id; scores are rounded to DIGITS before they are compared. An empty index gives no hits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.config import DEFAULT
from plumbline.operators.hits import best
from plumbline.sources.tables import cached, dealt, materialised

#: Postings of a block; documents and tokens of a cell at most (one document at least); queries that meet a cell together.
BLOCK, CELL_DOCS, CELL_TOKENS, TOGETHER = 128, 1 << 14, 1 << 20, 1 << 10
#: Terms of queries that are broadcast at most.
SENT = 1 << 17
DIGITS = 6
MARGIN = 2e-6
#: Bytes of text that are split into words together.
SPLIT = 1 << 23
INDEX = "cell string, term string, n long, length double, block int, docs array<long>, tf array<double>, dl array<double>, most array<double>, least array<double>"


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values))


def _cell(name: str, parts: list[pa.RecordBatch], block: int) -> pa.RecordBatch:
    """The rows of a cell, terms in order; the last row has no term."""
    table = pa.Table.from_batches(parts).sort_by("doc").combine_chunks()
    one = lambda c: table.column(c).chunk(0)
    terms, doc = one("terms"), one("doc").to_numpy()
    n = terms.value_lengths().fill_null(0).to_numpy()
    row, flat = np.repeat(np.arange(len(n)), n), terms.flatten()
    weight = np.ones(len(flat)) if one("weights").null_count == len(n) else one("weights").flatten().to_numpy().astype(np.float64)
    coded = flat.dictionary_encode()
    words = coded.dictionary
    order = pc.sort_indices(words).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    key = rank[coded.indices.to_numpy()] * len(n) + row
    at = np.argsort(key, kind="stable")
    key = key[at]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    tf = np.add.reduceat(weight[at], new) if len(key) else np.zeros(0)
    term, local = np.divmod(key[new], max(1, len(n)))
    dl = n[local].astype(np.float64)
    ends = np.searchsorted(term, np.arange(len(words)), "right")
    sizes = np.diff(ends, prepend=0)
    # a block begins with every `block`-th posting of a term
    heads = np.flatnonzero((np.arange(len(term)) - np.repeat(ends - sizes, sizes)) % block == 0)
    most, least = (f.reduceat(x, heads) if len(heads) else np.zeros(0) for f, x in ((np.maximum, tf), (np.minimum, dl)))
    block_ends = np.cumsum(-(-sizes // block))
    twice = lambda e: np.append(e, e[-1] if len(e) else 0)  # noqa: E731  nothing for the row of no term
    return pa.RecordBatch.from_arrays(
        [pa.repeat(pa.scalar(name), len(words) + 1), pa.concat_arrays([words.take(pa.array(order)).cast(pa.string()), pa.nulls(1, pa.string())]), pa.array(np.append(sizes, len(n))), pa.array(np.append(np.zeros(len(sizes)), float(n.sum()))), pa.repeat(pa.scalar(block, pa.int32()), len(words) + 1),
         _lists(doc[local], twice(ends)), _lists(tf, twice(ends)), _lists(dl, twice(ends)), _lists(most, twice(block_ends)), _lists(least, twice(block_ends))],
        names=[c.split()[0] for c in INDEX.split(", ")],
    )


_WORD = np.zeros(256, bool)
_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True


def words(texts: pa.StringArray) -> pa.ListArray:
    """The runs [a-z0-9]+ of each text; none of null."""
    n = len(texts)
    texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32, n + 1, texts.offset * 4).astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8, int(ends[-1] - ends[0]), int(ends[0])) if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    inside = np.append(_WORD[bytes_], False)  # bytes beyond ASCII belong to no word
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[ends[:-1]] = inside[ends[:-1]]  # a word ends with its text
    starts = np.flatnonzero(first)
    kept = np.flatnonzero(inside)
    at = np.append(np.searchsorted(kept, starts), len(kept)).astype(np.int32)
    flat = pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(bytes_[kept]))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, ends).astype(np.int32)), flat)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with a column of texts, with their words instead, a few at a time."""
    for batch in batches:
        if "text" not in batch.schema.names:
            yield batch
            continue
        upto = np.cumsum(pc.binary_length(_column(batch, "text")).fill_null(0).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SPLIT, "right")))
            some = batch.slice(at, end - at)
            yield pa.RecordBatch.from_arrays([_column(some, "doc"), words(_column(some, "text").cast(pa.string())), _column(some, "weights")], names=["doc", "terms", "weights"])
            at = end


def split(texts: DataFrame) -> DataFrame:
    """(id, terms) of texts (id, text): the runs [a-z0-9]+ of the lower case; none of null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _split(b.append_column("weights", pa.nulls(b.num_rows)).rename_columns(["doc", "text", "weights"]) for b in batches):
            yield some.drop_columns("weights").rename_columns(["id", "terms"])

    return texts.select("id", F.lower("text").alias("text")).mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, terms array<string>")


def indexed(docs: DataFrame, block: int = BLOCK, cell_docs: int = CELL_DOCS, cell_tokens: int = CELL_TOKENS) -> DataFrame:
    """The index of docs (doc, terms, and optionally weights: what each occurrence counts; or doc and text, whose terms are the
    runs [a-z0-9]+ of its lower case). Rows of a cell are in order of term,
    so that the files' own statistics tell where a term is."""
    stamp = uuid.uuid4().hex  # cells that are added later are others

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = tokens = cells = 0
        task = TaskContext.get().partitionId()
        for batch in _split(batches):
            upto = np.cumsum(_column(batch, "terms").value_lengths().fill_null(0).to_numpy())
            at = 0
            while at < batch.num_rows:
                # as many more as the cell has room for
                end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + cell_tokens - tokens, "right"))
                end = min(max(end, at + (not held)), batch.num_rows, at + cell_docs - n)
                if end > at:
                    held.append(batch.slice(at, end - at))
                    n, tokens = n + end - at, tokens + int(upto[end - 1] - (upto[at - 1] if at else 0))
                at = end
                if at < batch.num_rows or n >= cell_docs or tokens >= cell_tokens:
                    yield _cell(f"{stamp}-{task}-{cells}", held, block)
                    held, n, tokens, cells = [], 0, 0, cells + 1
        if held:
            yield _cell(f"{stamp}-{task}-{cells}", held, block)

    weights = F.col("weights").cast("array<double>") if "weights" in docs.columns else F.lit(None).cast("array<double>")
    # texts are split by the tasks that index them: words are many more values than texts to hand over
    terms = F.lower("text").alias("text") if "text" in docs.columns else F.coalesce("terms", F.array().cast("array<string>")).alias("terms")
    rows = docs.select(F.col("doc").cast("long").alias("doc"), terms, weights.alias("weights"))
    return rows.mapInArrow(run, INDEX)


def stored(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """The index at `path`, written once."""
    return cached(spark, path, lambda: indexed(docs))


def extended(path: str, docs: DataFrame) -> None:
    """Adds documents to the index at `path`: cells of their own, nothing that is there is read or written."""
    indexed(docs).write.mode("append").parquet(path)


# ---- search ----------------------------------------------------------------------------------------------------


@dataclass
class Postings:
    """A term's postings in a cell: documents (as numbers within the group), frequencies, lengths, blocks' bounds and size, and
    what each posting scores, if it is known."""

    at: np.ndarray
    tf: np.ndarray
    dl: np.ndarray
    bounds: np.ndarray
    block: int = BLOCK
    impacts: np.ndarray | None = None
    least: float = field(init=False)
    most: float = field(init=False)

    def __post_init__(self) -> None:
        self.least, self.most = self.bounds.min(), self.bounds.max()


def impact(tf: np.ndarray, dl: np.ndarray, k1: float, b: float, average: float) -> np.ndarray:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / average))


def found(lists: list[Postings], weights: list[float], n: int, k: int, scores) -> tuple[np.ndarray, np.ndarray, int]:
    """The best k of n documents, their scores, and how many blocks were opened. `scores`: impacts of places of a list."""
    total, running = np.zeros(n), np.zeros(n, bool)
    tops = [w * x.most for w, x in zip(weights, lists, strict=True)]
    order = sorted(range(len(lists)), key=lambda i: -tops[i])
    later = np.append(np.cumsum([tops[i] for i in reversed(order)])[::-1][1:], 0.0)  # what the terms after each can add
    threshold, opened = -np.inf, 0
    for i, rest in zip(order, later, strict=True):
        x = lists[i]
        if weights[i] * x.least + rest >= threshold - MARGIN:  # all blocks
            opened += len(x.bounds)
            total[x.at] += weights[i] * (scores(x, slice(None)) if x.impacts is None else x.impacts)
            running[x.at] = True
        else:
            open_ = weights[i] * x.bounds + rest >= threshold - MARGIN
            at = np.flatnonzero(np.repeat(open_, x.block)[: len(x.at)])
            opened += int(open_.sum())
            some = np.flatnonzero(running)  # of the other blocks, documents that are in the running
            place = np.minimum(np.searchsorted(x.at, some), len(x.at) - 1)
            place = place[x.at[place] == some]
            place = place[~open_[place // x.block]]
            opened += len(np.unique(place // x.block))
            at = np.concatenate([at, place])
            total[x.at[at]] += weights[i] * (scores(x, at) if x.impacts is None else x.impacts[at])
            running[x.at[at]] = True
        # the k-th best is no higher than the best: while all that is left could still bring that, nothing can be passed over
        if total.max() > rest and np.count_nonzero(running) >= k:
            s = total[running]
            threshold = max(threshold, np.partition(s, len(s) - k)[len(s) - k])
            running &= total + rest >= threshold - MARGIN
    some = np.flatnonzero(running)
    score = np.round(total[some], DIGITS)
    some, score = some[score > 0], score[score > 0]
    best_ = np.lexsort((some, -score))[:k]
    return some[best_], score[best_], opened


def search(index: DataFrame, queries: DataFrame, k: int, k1: float = 0.0, b: float = 0.0, average: float = 1.0) -> DataFrame:
    """(query, doc, score, blocks, opened): each cell's best k documents of each query (query, term, weight), weights 0 at least,
    and a row without a document for each query and cell, with the blocks of the query's terms and how many were opened.
    k1 = 0: a term counts its weight, whatever its frequency."""
    kind = queries.schema["query"].dataType.simpleString()
    sizes_ = queries.agg(F.count_distinct("query").alias("queries"), F.count_distinct("term").alias("terms")).first()
    parts = -(-sizes_.queries // TOGETHER)
    asks = F.collect_list(F.struct("query", "weight")).alias("asks")  # TOGETHER at most
    asked = queries.groupBy(F.pmod(F.xxhash64("query"), F.lit(max(1, parts))).alias("part"), "term").agg(asks)
    if sizes_.terms <= SENT:  # all that is not asked for stays where it is read; what is asked with it may be too much to send
        index = index.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    # a cell's rows of a part's terms meet in one task
    rows = index.where("term is not null").join(asked, "term").withColumn("key", F.xxhash64("cell", "part"))
    rows = rows.select("key", "cell", "part", "block", "docs", "tf", "dl", "most", "least", "asks")
    rows = dealt(rows, "key").sortWithinPartitions("key", "cell", "part")  # few bytes, but much work

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group(terms: list[tuple]) -> pa.RecordBatch:
            docs = np.unique(np.concatenate([t[0] for t in terms]))
            # a posting's score is made once for all queries
            lists = [Postings(np.searchsorted(docs, d), tf, dl, impact(most, least, k1, b, average), size, impact(tf, dl, k1, b, average)) for d, tf, dl, most, least, _, size in terms]
            mine: dict = {}
            for x, t in zip(lists, terms, strict=True):
                for q, w in zip(t[5].field("query").to_pylist(), t[5].field("weight").to_pylist(), strict=True):
                    mine.setdefault(q, []).append((x, w))
            out: list[tuple] = []
            for q, own in mine.items():
                blocks = sum(len(x.bounds) for x, _ in own)
                own = [(x, w) for x, w in own if w > 0]
                if own:
                    some, score, opened = found([x for x, _ in own], [w for _, w in own], len(docs), k, lambda x, at: impact(x.tf[at], x.dl[at], k1, b, average))
                    out += [(q, d, s, None, None) for d, s in zip(docs[some].tolist(), score.tolist(), strict=True)]
                    out.append((q, None, None, blocks, opened))
            names = ("query", "doc", "score", "blocks", "opened")
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((query_type, pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=names)

        query_type, now, held = to_arrow_type(kind_), None, []
        for batch in batches:
            keys = list(zip(_column(batch, "cell").to_pylist(), _column(batch, "part").to_pylist(), strict=True))
            asks, sizes = _column(batch, "asks"), _column(batch, "block").to_pylist()
            values = {}
            for c in ("docs", "tf", "dl", "most", "least"):
                lists = _column(batch, c)
                ends = np.asarray(lists.offsets)
                flat = lists.values.to_numpy(zero_copy_only=False)
                values[c] = [flat[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)]
            for i, key in enumerate(keys):
                if held and key != now:
                    yield group(held)
                    held = []
                now = key
                held.append((*(values[c][i].copy() for c in ("docs", "tf", "dl", "most", "least")), asks[i].values, sizes[i]))  # asks as they came, in Python objects only for a cell at a time
        if held:
            yield group(held)

    kind_ = queries.schema["query"].dataType
    return rows.mapInArrow(run, f"query {kind}, doc long, score double, blocks long, opened long")


def totals(index: DataFrame) -> DataFrame:
    """One row: documents and their mean length."""
    return index.where("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum("length") / F.sum("n")).alias("average"))


def frequencies(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(term, df) of the queries' terms that the index has. No postings are read."""
    return index.select("term", "n").join(queries.select("term").distinct(), "term").groupBy("term").agg(F.sum("n").alias("df"))


def bm25_cells(index: DataFrame, queries: DataFrame, k: int, k1: float = DEFAULT.bm25_k1, b: float = DEFAULT.bm25_b) -> DataFrame:
    """What `search` gives, for queries (query, term) by BM25."""
    all_ = totals(index).first()
    idf = F.log(1 + (F.lit(float(all_.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = materialised(queries.join(frequencies(index, queries), "term").select("query", "term", idf.alias("weight")))  # read twice
    return search(index, weighted, k, k1, b, all_.average or 1.0)


def bm25(index: DataFrame, queries: DataFrame, k: int = DEFAULT.k_lexical, k1: float = DEFAULT.bm25_k1, b: float = DEFAULT.bm25_b) -> DataFrame:
    """(query, doc, score, rank): the best k documents of each query (query, term)."""
    return best(bm25_cells(index, queries, k, k1, b).where("doc is not null").select("query", "doc", "score"), k, ["query"])


def matched(index: DataFrame, queries: DataFrame, k: int = DEFAULT.k_exact) -> DataFrame:
    """(query, doc, score, rank): by the sum of confidence times smoothed inverse frequency over a query's (query, term,
    confidence) matched terms, however often a document has them."""
    n = float(totals(index).first().n)
    idf = F.log(F.lit(n + 1.0) / (F.col("df") + 1.0)) + 1
    weighted = materialised(queries.join(frequencies(index, queries), "term").select("query", "term", (F.greatest("confidence", F.lit(0.0)) * idf).alias("weight")))
    return best(search(index, weighted, k).where("doc is not null").select("query", "doc", "score"), k, ["query"])
