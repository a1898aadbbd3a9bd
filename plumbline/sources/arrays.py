"""Files that are one JSON array each, read by many tasks.

A file is read in byte ranges as text that ends at every `}`, so pieces of any one line can lie in any number of tasks. Whether a
piece starts inside a string, and how deep, follows from what comes before it: within a range by running sums, from range to range by
one small row each, which says what a range does to either state. A `}` outside strings that brings the depth to zero ends a
record. Records within one range are put together there; only those that cross its ends are exchanged.

Defined cases: elements that are no objects, and an object without an end, are left out; an empty array, an empty file and blank
space give no records. What ends without its `]` loses an object that ends with the file. A compressed file is one range.
Escapes are taken to be inside strings, as in all valid JSON; a file with an unclosed string loses what follows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What comes before an object: anything but braces and quotes, and whole strings.
LEAD = r'^(?:[^{"]|"(?:[^"\\]|\\.)*+")*+'


def _opened(text: Column) -> Column:
    """Opening braces of a text without strings."""
    return F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit("")))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, pos, piece, odd, rise0, rise1): each piece with whether it changes sides of a quote, and by how much the depth
    rises with it and the `}` behind it if it starts outside (0) or inside (1) a string."""
    rows = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("piece"))
    plain = F.regexp_replace("piece", r"(?s)\\.", "")  # without escapes
    strings = '"[^"]*(?:"|$)'
    odd = (F.length("plain") - F.length(F.replace(F.col("plain"), F.lit('"'), F.lit("")))) % 2
    outside, inside = F.regexp_replace("plain", strings, ""), F.regexp_replace(F.regexp_replace("plain", '^[^"]*(?:"|$)', ""), strings, "")
    rows = rows.withColumn("plain", plain).withColumn("odd", odd)
    return rows.select("file", "start", "pos", "piece", "odd", (_opened(outside) - (1 - F.col("odd"))).alias("rise0"), (_opened(inside) - F.col("odd")).alias("rise1"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record): the objects of each file's array, as text."""
    within = Window.partitionBy("file", "start").orderBy("pos")
    upto, before = within.rowsBetween(Window.unboundedPreceding, 0), within.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = pieces(spark, path).withColumn("side", zero(F.sum("odd").over(before)) % 2)  # if the range starts outside a string
    rise = lambda flip: F.when((F.col("side") + flip) % 2 == 0, F.col("rise0")).otherwise(F.col("rise1"))
    rows = rows.withColumn("up0", F.sum(rise(0)).over(upto)).withColumn("up1", F.sum(rise(1)).over(upto))
    # what each range does to a state, and from that the state that it starts in: a row for a range
    ranges = rows.groupBy("file", "start").agg((F.sum("odd") % 2).alias("odd"), F.max_by("up0", "pos").alias("up0"), F.max_by("up1", "pos").alias("up1"), F.max("pos").alias("final"))
    file = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("from_side", zero(F.sum("odd").over(file)) % 2)
    starts = starts.withColumn("from_depth", zero(F.sum(F.when(F.col("from_side") == 0, F.col("up0")).otherwise(F.col("up1"))).over(file)))
    final = F.when(F.lead("start").over(Window.partitionBy("file").orderBy("start")).isNull(), F.col("final")).alias("final")  # no brace follows a file's last piece
    starts = starts.select("file", "start", "from_side", "from_depth", final)
    rows = rows.join(starts, ["file", "start"])
    inside = (F.col("side") + F.col("from_side") + F.col("odd")) % 2 == 1  # at the piece's end
    depth = F.col("from_depth") + F.when(F.col("from_side") == 0, F.col("up0")).otherwise(F.col("up1"))
    rows = rows.withColumn("ends", (~inside & (depth == 0) & ~F.col("pos").eqNullSafe(F.col("final"))).cast("int")).withColumn("nth", zero(F.sum("ends").over(before)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "}")
    parts = rows.groupBy("file", "start", "nth").agg(text.alias("text"), F.max("ends").alias("ended"), F.first("from_depth").alias("from_depth"), F.first("from_side").alias("from_side"))
    # the first part of a range may go on with a record that began before it, the last one may go on behind it
    goes_on = (F.col("nth") == 0) & (F.col("start") > 0)
    whole = parts.where(~goes_on & (F.col("ended") == 1)).select("file", "text")
    torn = parts.where(goes_on | (F.col("ended") == 0))
    parted = torn.withColumn("record", zero(F.sum("ended").over(Window.partitionBy("file").orderBy("start", "nth").rowsBetween(Window.unboundedPreceding, -1))))
    joined = parted.groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "nth", "text"))), lambda x: x["text"]), "}").alias("text"), F.max("ended").alias("ended"))
    found = whole.unionByName(joined.where("ended = 1").select("file", "text"))
    record = F.regexp_replace("text", LEAD, "")
    return found.select("file", F.concat(record, F.lit("}")).alias("record")).where("record <> '}'")
