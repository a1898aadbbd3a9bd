"""The slot stream against the batch fold and a plain loop."""

import datetime as dt
import random

from plumbline.operators import sessions
from plumbline.streaming import slots

CHANGE = "session long, at long, ts timestamp, attribute string, value string, confidence double"
START = dt.datetime(2024, 1, 1)


def change(session, at, attribute, value, confidence=0.5):
    return (session, at, START + dt.timedelta(minutes=at), attribute, value, confidence)


def made(seed, n=120, sessions_=4):
    r = random.Random(seed)
    return [change(r.randrange(sessions_), at, *r.choice([("category", r.choice("xy")), ("color", r.choice("abc")), ("size", r.choice("sml"))]), round(r.random(), 3)) for at in range(n)]


def feed(spark, folder, rows):
    spark.createDataFrame(rows, CHANGE).coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, at, delay="1 hour", idle=None):
    stream = slots.logged(spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(str(at / "in")), delay, idle)
    with slots.rocks(spark):
        q = stream.writeStream.outputMode("append").format("parquet").option("path", str(at / "out")).option("checkpointLocation", str(at / "log")).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(slots.LOG).parquet(str(at / "out"))


def listed(df):
    return sorted((r.session, r.category, r.attribute, r.value, r.confidence, r.set_at, tuple(r.superseded)) for r in df.collect())


END = (None, None, START + dt.timedelta(days=30), None, None, None)


def test_equals_batch_under_permuted_batches(spark, tmp_path):
    seed = 1
    rows = made(seed)
    mixed = [c for i in range(0, len(rows), 40) for c in random.Random(seed).sample(rows[i : i + 40], 40)]  # disorder below the delay
    for i in range(0, len(mixed), 40):
        feed(spark, tmp_path / "in", mixed[i : i + 40] + mixed[i : i + 3])  # with repeats
    first = run(spark, tmp_path)
    before = first.count()
    assert 0 < before < len(rows)  # the last changes wait for the watermark
    feed(spark, tmp_path / "in", [END])
    log = run(spark, tmp_path)  # restarts from its checkpoint
    assert log.count() == len(rows) and log.select("session", "seq").distinct().count() == len(rows)
    batch = sessions.category_slots(spark.createDataFrame(rows, CHANGE).drop("ts"))
    assert listed(slots.current(log)) == listed(batch)


def test_nulls_and_late_rows(spark, tmp_path):
    feed(spark, tmp_path / "in", [change(1, 100, "color", "red", None), change(1, 101, "color", "red", 0.25), change(1, 102, "color", None), change(None, 103, "color", "red"), change(1, 104, None, "x")])
    feed(spark, tmp_path / "in", [END])
    run(spark, tmp_path)
    feed(spark, tmp_path / "in", [change(1, 99, "color", "blue")])  # too late
    assert listed(slots.current(run(spark, tmp_path))) == [(1, None, "color", "red", 0.25, 101, ())]


def test_idle_sessions_are_forgotten(spark, tmp_path):
    feed(spark, tmp_path / "in", [change(1, 0, "category", "x"), change(1, 1, "color", "red"), change(1, 200, "size", "s"), change(2, 190, "color", "blue")])
    feed(spark, tmp_path / "in", [(None, None, START + dt.timedelta(minutes=270), None, None, None)])
    log = run(spark, tmp_path, idle="90 minutes")
    assert listed(slots.current(log)) == [(1, None, "size", "s", 0.5, 200, ()), (2, None, "color", "blue", 0.5, 190, ())]
    feed(spark, tmp_path / "in", [END])
    log = run(spark, tmp_path, idle="90 minutes")
    assert listed(slots.current(log)) == [] and log.where("change = 'expired'").count() == 3
