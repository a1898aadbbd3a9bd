"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every shard draws a number for a record's key, from the first 52 bits of the MD5 digest of `key:shard`; the draw u in (0, 1)
and the shard's weight w give the time -ln(u) / w, and the earliest shard takes the record. So key and shards alone decide,
a shard's share follows its weight, and a shard that is added takes records only into itself (one that goes gives away only
its own). Ties go to the smaller number. Digests are the same in every language and version.

Slots number a shard's records from 0 without a gap, in order of doc_id (nulls last), size and digest. Rows are sorted in
ranges of (shard, doc_id, size, digest, place in the input), so that a shard, or one key that holds a third of all rows, is
many tasks' work; a row's slot is its place in the range, and the ranges' counts before it. Only doc_id and three numbers
of each row are exchanged, never its text. DataFrame functions only.

Defined cases: null text: no bytes, digest 0. A null doc_id has the key "", which is no number's; equal keys lie in one shard.
Repeated rows each get a slot. An empty table gives an empty result. Shards of weight 0 take nothing. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import checkpoint, shuffle_parts

SHARDS, OVERHEAD = 40, 16


def draw(key: Column, shard: Column) -> Column:
    """A number in (0, 1) from a key and a shard's number."""
    digits = F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def times(key: Column, weights: Sequence[float]) -> Column:
    """An array of (time, shard) of the shards that have a weight."""
    if not any(w > 0 for w in weights):
        raise ValueError("at least one shard needs a weight above 0")
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights) if w > 0])
    return F.transform(shards, lambda s: F.struct((-F.ln(draw(key, s["shard"])) / s["weight"]).alias("time"), s["shard"].alias("shard")))


def sharded(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, added: float = 1.0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row: its place among `weights`, and the shard it
    has once another one of weight `added` stands beside them."""
    doc_id = F.col("doc_id").cast("long")
    key = F.coalesce(doc_id.cast("string"), F.lit(""))
    row = docs.select(
        doc_id.alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        times(key, [*weights, added]).alias("t"), F.monotonically_increasing_id().alias("place"),
    )
    first = lambda t: F.array_min(t)["shard"]
    old = first(F.filter("t", lambda x: x["shard"] < len(weights)))
    rows = checkpoint(row.select("doc_id", "size", "text_crc32", "place", old.cast("int").alias("shard"), first(F.col("t")).cast("int").alias("grown_shard")))
    order = ["shard", F.asc_nulls_last("doc_id"), "size", "text_crc32", "place"]
    ranges = rows.repartitionByRange(shuffle_parts(docs.sparkSession), *order).sortWithinPartitions(*order)
    # written: a range's number and a row's place in it hold for both uses below
    ranges = checkpoint(ranges.drop("place").withColumns({"part": F.spark_partition_id(), "nth": F.monotonically_increasing_id()}))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("nth0"))
    starts = counts.select("shard", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("nth0")).alias("shift"))
    slot = (F.col("nth") + F.col("shift")).cast("long")
    return ranges.join(starts, ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.alias("slot"), "grown_shard")


#: DuckDB has no CRC; its table is made from the polynomial, and the digest byte by byte. Equal weights need no logarithm.
CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END))"


def crc_sql(text: str) -> str:
    """The CRC-32 of a text's UTF-8 bytes in DuckDB, given a column `crc` that holds CRC_TABLE."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda a, b: xor(a // 256, crc[(xor(a, b) % 256) + 1])), 4294967295)"


ORACLE = f"""
WITH t AS (SELECT {CRC_TABLE} AS crc),
d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + {OVERHEAD} AS BIGINT) AS size, CAST({crc_sql("coalesce(text, '')")} AS BIGINT) AS text_crc32,
    row_number() OVER () AS row FROM documents, t),
u AS (SELECT row, shard, CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || shard), 13) AS BIGINT) AS draw FROM d, range({SHARDS + 1}) AS s(shard)),
o AS (SELECT row, arg_max(shard, struct_pack(d := draw, s := -shard)) FILTER (shard < {SHARDS}) AS shard, arg_max(shard, struct_pack(d := draw, s := -shard)) AS grown FROM u GROUP BY row)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
    CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST, size, text_crc32) - 1 AS BIGINT) AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM d JOIN o USING (row)
"""
