"""Streaming queries, run to the end of what is there and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.dialogue import FOLD_SQL, template_turns
from plumbline.plans.more import event_changes
from plumbline.plans.registry import ORACLE, query
from plumbline.sources.tables import materialised, table
from plumbline.streaming import sessions as streams
from plumbline.streaming import slots


def _drained(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """All rows that a stream appends until its sources have no more, through a sink in the shared folder."""
    materialised(spark.range(1))  # makes sure that there is a shared folder
    at = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    done = stream.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


@query("""WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM conversations), f AS (SELECT conv_id, token, min(turn) AS turn FROM t GROUP BY ALL), n AS (SELECT conv_id, turn, count(*) AS fresh FROM f GROUP BY ALL), u AS (SELECT DISTINCT conv_id, turn FROM conversations)
SELECT conv_id AS session, turn, CAST(sum(coalesce(fresh, 0)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS n FROM u LEFT JOIN n USING (conv_id, turn)""")
def stream_running_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = spark.readStream.schema(table(spark, sf_dir, "conversations").schema).option("pathGlobFilter", "*.parquet").parquet(_folder(spark, sf_dir, "conversations"))
    words = source.select(F.col("conv_id").alias("session"), F.col("turn").cast("long").alias("turn"), F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("words"))
    return _drained(streams.running_distinct(words), spark)


@query(FOLD_SQL.format(more=", false AS late"))
def stream_session_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of `session_fold`, from a stream of the same messages."""
    parts = spark.readStream.schema(table(spark, sf_dir, "part").schema).option("pathGlobFilter", "*.parquet").parquet(_folder(spark, sf_dir, "part"))
    turns = template_turns(parts)
    flat = turns.select("session", "turn", "words", F.col("event.kind").alias("kind"), F.col("event.category").alias("category"), F.col("event.constraints").alias("told"), F.col("event.scenario_hint").alias("hint"))
    rows = _drained(streams.folded(flat), spark)
    return rows.select("session", "turn", "bucket", F.array_join("constraints", " | ").alias("constraints"), F.array_join("opening", " | ").alias("opening"), "n_vocab", F.col("asked").cast("bigint").alias("asked"), "late")


@query(ORACLE["hybrid_slots"])
def stream_hybrid_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slots of `hybrid_slots`, from a stream of the same events; a closing row beyond the last one moves the watermark."""
    events = table(spark, sf_dir, "events")
    materialised(spark.range(1))
    closing = f"{spark.sparkContext.getCheckpointDir()}/source-{uuid.uuid4().hex}"
    null = lambda name: F.lit(None).cast(events.schema[name].dataType).alias(name)
    end = events.agg(F.max("ts").alias("ts")).select(*[(F.col("ts") + F.expr("interval 2 days")).cast(events.schema["ts"].dataType).alias("ts") if c == "ts" else null(c) for c in events.columns])
    end.write.parquet(closing)
    read = lambda at: spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(at)
    rows = read(_folder(spark, sf_dir, "events")).unionByName(read(closing))
    with slots.rocks(spark):
        log = _drained(slots.logged(event_changes(rows, "ts").withColumn("ts", F.col("ts").cast("timestamp")), "1 day"), spark)
    return slots.current(log).withColumn("superseded", F.array_join("superseded", ","))


def _folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A folder with the table's rows; a table that is one file is copied to the shared folder, as file streams read folders."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return f"{sf_dir}/{name}.parquet"
    materialised(spark.range(1))
    at = f"{spark.sparkContext.getCheckpointDir()}/source-{uuid.uuid4().hex}"
    table(spark, sf_dir, name).write.parquet(at)
    return at


@query("""SELECT date_trunc('hour', ts) AS started, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL""")
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows in batch; beyond the reference, the plan that the stream runs too."""
    rows = streams.windowed_counts(table(spark, sf_dir, "events"))
    return rows.select(F.col("window.start").alias("started"), "event_type", "n", "total")
