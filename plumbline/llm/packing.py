"""Best-fit packing into bins of several permitted capacities.

Capacities are numbers of tokens. A document's length is its count of tokens by the tokenizer that is given, and one end
token; without a tokenizer, for texts whose tokens are split by white space already, words are counted. Starts are offsets
in tokens. Documents are cut into pieces of at most the largest capacity, and pieces of one length are alike; so the plan needs only
how many pieces there are of each length, a table bounded by the largest capacity. Over those counts best-fit decreasing
runs exactly: bins with the same room left form a group, and a length fills the groups of least sufficient room first. When
no open bin fits, the size is opened whose cost per packed token is least, judged by filling one bin of each size with the
best-fitting lengths still to come. At the end each bin shrinks to the smallest capacity that holds its contents. The plan
says, for runs of ranks of a length, in which bins they lie; ranks are counted in two steps (rows of a salt, then salts), so
no length, however common, is numbered by one task.

Defined cases: null or empty text: no tokens but the end, length 1. Ties in a length are broken by salt, doc_id and piece.
A null doc_id is packed like any other; repeated rows are packed each. A text longer than the largest capacity is cut, however
long it is. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.bpe_codec import encoded
from plumbline.llm.common import checkpoint, column, spread, words
from plumbline.llm.token_automaton import counted

CAPACITIES = (512, 1024, 2048, 4096)
SALTS = 64


def cost(capacity: int) -> float:
    """What training on one sequence costs: linear layers and attention, up to a factor."""
    return capacity * (1 + capacity / 8192)


@dataclass
class Run:
    """Ranks [first, first + bins * each) of one length lie `each` in a bin, in bins [bin0, bin0 + bins), from `at` on."""

    length: int
    first: int
    bins: int
    each: int
    bin0: int
    at: int


@dataclass
class Open:
    """Bins [bin0, bin0 + bins) of one capacity, filled up to `used` alike."""

    bin0: int
    bins: int
    capacity: int
    used: int


def plan(counts: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, price: Callable[[int], float] = cost) -> tuple[list[Run], list[Open]]:
    """Best-fit decreasing over counts of lengths."""
    todo = dict(counts)
    lengths = sorted(todo)
    runs: list[Run] = []
    rooms: list[int] = []  # sorted distinct free room
    groups: dict[int, list[Open]] = {}
    n_bins = 0

    def put(g: Open) -> None:
        room = g.capacity - g.used
        if room not in groups:
            insort(rooms, room)
            groups[room] = []
        groups[room].append(g)

    def trial(capacity: int, length: int) -> float:
        """Cost per token of a new bin that takes `length` and then the longest that still fit."""
        room, left = capacity - length, {length: todo[length] - 1}
        at = bisect_right(lengths, length) - 1
        while room > 0 and at >= 0:
            at = min(at, bisect_right(lengths, room) - 1)
            if at < 0:
                break
            x = lengths[at]
            k = min(room // x, left.get(x, todo[x]))
            room -= k * x
            at -= 1
        used = capacity - room
        return price(min(c for c in capacities if c >= used)) / used

    for length in reversed(lengths):
        first = 0
        while first < counts[length]:
            left = counts[length] - first
            todo[length] = left
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                g = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
                each = min(room // length, left)
                bins = min(g.bins, left // each)
                if bins < g.bins:
                    put(Open(g.bin0 + bins, g.bins - bins, g.capacity, g.used))
            else:
                capacity = min((c for c in capacities if c >= length), key=lambda c: (trial(c, length), -c))
                each = min(capacity // length, left)
                bins = left // each
                # the choice holds for as many bins as the other lengths can fill alike; then it is made anew
                bins = min(bins, max(1, min((todo[x] for x in lengths[: bisect_left(lengths, length)][-1:]), default=bins)))
                g = Open(n_bins, bins, capacity, 0)
                n_bins += bins
            runs.append(Run(length, first, bins, each, g.bin0, g.used))
            first += bins * each
            put(Open(g.bin0, bins, g.capacity, g.used + each * length))
        todo[length] = 0
    shut = [Open(g.bin0, g.bins, min(c for c in capacities if c >= g.used), g.used) for gs in groups.values() for g in gs]
    return runs, sorted(shut, key=lambda g: g.bin0)


def pieces(docs: DataFrame, largest: int, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length): each document's tokens and one end in pieces of at most `largest`."""
    if tokenizer is None:
        n = F.size(words(F.col("text"))).cast("long") + 1
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n"))
    else:
        rows = counted(spread(docs.select("doc_id", "text")), tokenizer).select("doc_id", (F.col("n_tokens") + 1).alias("n"))
    rows = rows.select("doc_id", "n", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(largest).cast("long"))).alias("piece", "start"))
    return rows.select("doc_id", "piece", "start", F.least(F.lit(largest).cast("long"), F.col("n") - F.col("start")).alias("length"))


def packed(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, price: Callable[[int], float] = cost, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, bin_id, position, capacity): where each piece lies. `tokenizer`: the file of one."""
    return _placed(pieces(docs, max(capacities), tokenizer), capacities, price)


def sequences(docs: DataFrame, ranks: str, pattern: str, end: int, capacities: tuple[int, ...] = CAPACITIES, price: Callable[[int], float] = cost) -> DataFrame:
    """The packed sequences themselves, by the byte-level codec of `ranks`: bin_id, capacity, ids (the tokens, each document's
    followed by `end`), segment (for each token, the number of its piece in the bin: attention stays within equal ones),
    starts (of the pieces), doc_ids and pieces. A bin holds no more than its capacity, so no row grows with the data."""
    rows = encoded(spread(docs.select("doc_id", "text")), ranks, pattern, ids=True).select("doc_id", F.concat("ids", F.array(F.lit(end).cast("long"))).alias("ids"))
    largest = F.lit(max(capacities))
    rows = rows.select("doc_id", "ids", F.posexplode(F.sequence(F.lit(0), F.size("ids") - 1, largest)).alias("piece", "start"))
    rows = rows.select("doc_id", "piece", F.col("start").cast("long").alias("start"), F.slice("ids", F.col("start") + 1, largest).alias("ids"))
    placed = _placed(rows.withColumn("length", F.size("ids").cast("long")), capacities, price)
    bins = placed.groupBy("bin_id", "capacity").agg(F.sort_array(F.collect_list(F.struct("position", "doc_id", "piece", "ids"))).alias("x"))
    segment = F.flatten(F.transform("x", lambda y, i: F.transform(y["ids"], lambda _: i)))
    return bins.select("bin_id", "capacity", F.flatten("x.ids").alias("ids"), segment.alias("segment"), F.col("x.position").alias("starts"), F.col("x.doc_id").alias("doc_ids"), F.col("x.piece").alias("pieces"))


def _placed(rows: DataFrame, capacities: tuple[int, ...], price: Callable[[int], float]) -> DataFrame:
    """Pieces (doc_id, piece, start, length, and whatever they carry) with the bin of each."""
    kept = rows.columns
    rows = checkpoint(rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int")))
    salted = rows.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    salted = checkpoint(salted.withColumn("rank0", F.coalesce(F.sum("n").over(before), F.lit(0))))
    # at most one row for each length up to the largest capacity
    counts = {r["length"]: r["n"] for r in salted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, shut = plan(counts, capacities, price)
    by_length: dict[int, np.ndarray] = {}
    for r in runs:
        by_length.setdefault(r.length, []).append((r.first, r.each, r.bin0, r.at))
    by_length = {k: np.array(v, np.int64) for k, v in by_length.items()}
    bins = np.array([(g.bin0, g.capacity) for g in shut] or [(0, 0)], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = column(batch, "length").to_numpy(), column(batch, "rank").to_numpy()
            bin_id, position = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                table = by_length[int(x)]
                row = table[np.searchsorted(table[:, 0], rank[at], "right") - 1]
                k = rank[at] - row[:, 0]
                bin_id[at], position[at] = row[:, 2] + k // row[:, 1], row[:, 3] + k % row[:, 1] * x
            capacity = bins[np.searchsorted(bins[:, 0], bin_id, "right") - 1, 1]
            yield pa.RecordBatch.from_arrays([*(column(batch, k) for k in kept), pa.array(bin_id), pa.array(position), pa.array(capacity)], names=[*kept, "bin_id", "position", "capacity"])

    within = Window.partitionBy("length", "salt").orderBy(F.asc_nulls_first("doc_id"), "piece")
    ranked = rows.withColumn("nth", F.row_number().over(within) - 1).join(salted.select("length", "salt", "rank0"), ["length", "salt"])
    ranked = ranked.select(*kept, (F.col("rank0") + F.col("nth")).cast("long").alias("rank"))
    return ranked.mapInArrow(place, rows.select(*kept, *[F.lit(0).cast("long").alias(k) for k in ("bin_id", "position", "capacity")]).schema)
