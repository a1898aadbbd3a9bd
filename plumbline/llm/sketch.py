"""Document fingerprints: threshold-scaled sketches of word shingles.

Every five-word shingle is hashed to 64 bits; the sketch keeps each distinct hash below a fixed fraction of the hash
space. A sketch's size follows the text's, sketches of parts merge into the sketch of the whole, and the share of one
sketch's hashes found in another estimates containment even between very unequal documents. A text whose shingles all
hash above the threshold keeps all of them, which marks it: no other sketch is without a hash below the threshold. Two such
short texts are compared by all their shingles; one beside a longer text shares nothing with it that either sketch tells of.

Defined cases: null or empty text, or one without words: the empty sketch, whose likeness is 1 to another empty sketch
and 0 to any other. Fewer than five words: one shingle, the whole sequence. Equal doc_ids are ordered by text; a null
doc_id comes last. Repeated rows each get their row. Very long texts are sketched one by one. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import column, mix, shuffle_parts, slices, text_buffers, word_hashes

SHINGLE = 5
#: The share of the hash space that is kept.
FRACTION = 1 / 8

_U = np.uint64
_STEP = _U(0xD6E8FEB86659FD93)


def sketches(data: np.ndarray, offsets: np.ndarray, fraction: float = FRACTION, size: int = SHINGLE) -> list[np.ndarray]:
    """The sketch (sorted distinct hashes) of every text of a batch."""
    n = len(offsets) - 1
    words, doc = word_hashes(data, offsets)
    counts = np.bincount(doc, minlength=n)
    h = np.zeros(0, np.uint64)
    owner = np.zeros(0, np.int64)
    if len(words) >= size:
        m = len(words) - size + 1
        h = words[:m].copy()
        for k in range(1, size):
            h = h * _STEP + words[k : k + m]
        ok = doc[:m] == doc[size - 1 :]
        h, owner = mix(h[ok]), doc[:m][ok]
    first = np.concatenate([[0], np.cumsum(counts)])
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i, d in enumerate(short):
            x = _U(counts[d])
            for w in words[first[d] : first[d + 1]]:
                x = _U((int(x) * int(_STEP) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            extra[i] = x
        h, owner = np.concatenate([h, mix(extra)]), np.concatenate([owner, short])
    keep = h <= _U(int(fraction * 2**64) - 1)
    got = np.bincount(owner[keep], minlength=n)
    lone = np.flatnonzero((counts > 0) & (got == 0))
    keep |= np.isin(owner, lone)  # all hashes of a text that has none below the threshold
    h, owner = h[keep], owner[keep]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])
        h, owner = h[new], owner[new]
    return np.split(h, np.searchsorted(owner, np.arange(1, n))) if n else []


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    both = np.union1d(a, b)
    low = both[both <= _U(int(fraction * 2**64) - 1)]
    return low if len(low) else both


def shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the smaller text's shingles that the other text has too."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return shared(a, b) / min(len(a), len(b))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    s = shared(a, b)
    return s / (len(a) + len(b) - s)


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def fingerprints(df: DataFrame, text: str = "text", fraction: float = FRACTION) -> DataFrame:
    """df with a column `fingerprint`: the sketch as hexadecimal digits, sixteen for each hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                got = [as_text(s) for s in sketches(*text_buffers(column(part, text)), fraction)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.string())], names=[*part.schema.names, "fingerprint"])

    return df.mapInArrow(run, df.schema.add("fingerprint", "string"))


def in_next_order(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (part, guest, doc_id, text), sorted within each part so that a row's next document, by descending doc_id and
    from the last to the first, is the row after it. Texts are shuffled once: by ranges of doc_id whose bounds come from
    a sketch of quantiles; a range's first row is also sent, as a guest, to the range that ends before it."""
    ids = docs.select("doc_id")
    cuts = np.array(sorted({c for c in ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or ()}), np.int64)

    @F.pandas_udf("int")
    def part_of(doc_id: pd.Series) -> pd.Series:
        return pd.Series(np.where(doc_id.isna(), -1, np.searchsorted(cuts, doc_id.fillna(0).astype("int64"))).astype("int32"))

    # one number for each part, of which there are a fixed number
    top = {r["part"]: r["top"] for r in ids.select(part_of("doc_id").alias("part"), "doc_id").groupBy("part").agg(F.max("doc_id").alias("top")).collect()}
    above = sorted(top)
    goes = dict(zip(above, [*above[1:], above[0]] if above else [], strict=True))
    nowhere = -2

    @F.pandas_udf("int")
    def guest_of(doc_id: pd.Series, part: pd.Series) -> pd.Series:
        same = [top[p] == d or (top[p] is None and pd.isna(d)) for d, p in zip(doc_id, part, strict=True)]
        return pd.Series([goes[p] if s else nowhere for s, p in zip(same, part, strict=True)], dtype="int32")

    rows = docs.select("doc_id", "text", part_of("doc_id").alias("part")).withColumn("to", F.nullif(guest_of("doc_id", "part"), F.lit(nowhere)))
    rows = rows.select("doc_id", "text", F.explode(F.array_compact(F.array(F.struct("part", F.lit(False).alias("guest")), F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("part"), F.lit(True).alias("guest")))))).alias("x"))
    rows = rows.select("x.part", "x.guest", "doc_id", "text")
    return rows.repartition(parts, "part").sortWithinPartitions("part", "guest", F.desc_nulls_last("doc_id"), F.desc_nulls_last("text"))


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, jaccard_edited double, jaccard_next double"


def edited_likeness(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """For every document, its sketch, that of its text with the last third replaced by the next document's beginning, and
    the likeness (containment of the smaller) to the edited text and to the next document."""
    spark = docs.sparkSession
    rows = in_next_order(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), 2 * shuffle_parts(spark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row, and whether a later one has still to complete it
        for batch in batches:
            for piece in slices(batch, "text"):
                got = list(zip(column(piece, "part").to_pylist(), column(piece, "guest").to_pylist(), column(piece, "doc_id").to_pylist(), column(piece, "text").to_pylist(), strict=True))
                got = [held, *got] if held else got
                held = got[-1]
                if len(got) < 2:
                    continue
                own = [r[3] for r in got]
                pair = [i for i in range(len(got) - 1) if not got[i][1] and got[i][0] == got[i + 1][0]]
                edited = [own[i][: len(own[i]) - len(own[i]) // 3] + own[i + 1][: len(own[i]) // 3] for i in pair]
                mine = sketches(*text_buffers(pa.array(own, pa.large_string())), fraction)
                theirs = sketches(*text_buffers(pa.array(edited, pa.large_string())), fraction)
                likeness = [(containment(mine[i], t), jaccard(mine[i], t)) for i, t in zip(pair, theirs, strict=True)]
                nexts = [(containment(mine[i], mine[i + 1]), jaccard(mine[i], mine[i + 1])) for i in pair]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([got[i][2] for i in pair], pa.int64()), "n_chars": pa.array([len(own[i]) for i in pair], pa.int64()),
                    "edited_sha256": pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                    "fingerprint": pa.array([as_text(mine[i]) for i in pair], pa.string()), "edited_fingerprint": pa.array([as_text(t) for t in theirs], pa.string()),
                    "near_edited": pa.array([x for x, _ in likeness], pa.float64()), "near_next": pa.array([x for x, _ in nexts], pa.float64()),
                    "jaccard_edited": pa.array([x for _, x in likeness], pa.float64()), "jaccard_next": pa.array([x for _, x in nexts], pa.float64()),
                })

    return rows.mapInArrow(run, OUT)
