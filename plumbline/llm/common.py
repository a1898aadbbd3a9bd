"""Helpers that several training-data operators share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import prepare

#: The white space that ends a word, as a regular expression class body and as characters.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"

_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: rows are dealt out anew if the files give fewer parts than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only in local mode, where none may be configured (tests)."""
    sc = spark.sparkContext
    if (at := sc.getCheckpointDir()) is None:
        if not (at := spark.conf.get("spark.checkpoint.dir", None)):
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            at = tempfile.mkdtemp(prefix="plumbline-")
        sc.setCheckpointDir(at)
        at = sc.getCheckpointDir()
    return at


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with files in the shared folder, so lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as an array; null: none."""
    plain = F.translate(F.coalesce(text, F.lit("")), SPACE_CHARS[1:], " " * (len(SPACE_CHARS) - 1))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Bits of a filter of keys (16 MB at most, however many keys there are), and of one of its pages.
FILTER, PAGE = 1 << 27, 1 << 15


def filter_pages(keys: DataFrame, of: Column) -> DataFrame:
    """A filter of keys: rows (page, bits), set on the executors; it goes to all tasks, and its size has a bound."""
    spot = F.pmod(of, F.lit(FILTER))
    pages = keys.select(F.floor(spot / PAGE).cast("int").alias("__plumbline_page"), F.pmod(spot, F.lit(PAGE)).alias("bit"))
    return checkpoint(pages.groupBy("__plumbline_page").agg(F.bitmap_construct_agg("bit").alias("__plumbline_bits")))


def marked(rows: DataFrame, of: Column, pages: DataFrame, name: str) -> DataFrame:
    """rows with a boolean `name`: true for every key of the filter, and for some others, the more the fuller the filter is.
    It spares rows an exchange before an exact join."""
    spot = F.pmod(of, F.lit(FILTER))
    byte = F.conv(F.hex(F.substring("__plumbline_bits", (F.floor(F.pmod(spot, F.lit(PAGE)) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, F.pmod(spot, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1
    joined = rows.join(F.broadcast(pages), F.floor(spot / PAGE).cast("int") == F.col("__plumbline_page"), "left")
    return joined.withColumn(name, F.coalesce(bit, F.lit(False))).drop("__plumbline_page", "__plumbline_bits")


# ---- numpy over the bytes of a batch -------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (splitmix64's, public domain)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


BYTE = _table(1)
BASE = 0x9FB21C651E98DF25  # odd, so it has an inverse modulo 2^64
_WORD_BYTE = BYTE.copy()
_WORD_BYTE[[9, 10, 11, 12, 13, 32]] = 0
_LOWER_BYTE = _WORD_BYTE.copy()
_LOWER_BYTE[65:91] = _WORD_BYTE[97:123]


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = powers(BASE, 64)


def _pow(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        _POW = powers(BASE, 1 << (n - 1).bit_length())
    return _POW


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, width, n + 1, column.offset * np.dtype(width).itemsize).astype(np.int64)
    size = int(offsets[-1] - offsets[0])
    return (np.frombuffer(data, np.uint8, size, int(offsets[0])) if size else np.zeros(0, np.uint8)), offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all words of all texts, and the text that each belongs to."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    isword = _WORD_BYTE[data] != 0
    start = isword.copy()
    start[1:] &= ~isword[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    start[at] |= isword[at]
    s = np.flatnonzero(start)
    return s, np.searchsorted(offsets, s, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of every text (a polynomial of its bytes modulo 2^64, mixed), and the word's text."""
    s, doc = word_spans(data, offsets)
    if not len(s):
        return np.zeros(0, np.uint64), doc
    value = (_LOWER_BYTE if lower else _WORD_BYTE)[data]
    place = np.zeros(len(data), np.int64)
    place[s] = s
    np.maximum.accumulate(place, out=place)
    np.subtract(np.arange(len(data)), place, out=place)
    place[value == 0] = 0
    value *= _pow(int(place.max()) + 1)[place]
    return mix(np.add.reduceat(value, s)), doc


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about `limit` bytes of text, so memory follows the longest text and not the batch."""
    n = batch.num_rows
    if not n:
        return
    _, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)))
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield batch.slice(first, last - first)
        first = last


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
