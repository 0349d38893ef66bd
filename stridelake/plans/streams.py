"""Queries over streams: each drains the events table as a stream and returns what the sink holds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stridelake.plans.registry import query
from stridelake.sources.tables import shared_folder
from stridelake.streaming import jobs as J


def folder(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def events(spark, d):
    e = J.stream_of(spark, f"{d}/events.parquet")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


@query("st3_daily_load", "SELECT user_id, CAST(ts AS DATE) AS date, round(sum(value), 4) AS load, count(*) AS n FROM events GROUP BY 1, 2")
def st3(spark, d):
    out = J.drained(J.daily_load(events(spark, d)), folder(spark), "complete")
    return out.select("user_id", "date", F.round("load", 4).alias("load"), "n")


@query("st6_sliding_load", "SELECT user_id, CAST(ts AS DATE) + CAST(k AS INTEGER) AS until, round(sum(value), 4) AS load FROM events, range(1, 8) r(k) GROUP BY 1, 2")
def st6(spark, d):
    out = J.drained(J.acute_load(events(spark, d)), folder(spark), "complete")
    return out.select("user_id", "until", F.round("load", 4).alias("load"))


@query("st5_inactivity_sessions", "SELECT user_id, min(ts) AS start_ts, max(ts) + INTERVAL 15 MINUTE AS end_ts, count(*) AS n FROM (SELECT *, sum(CASE WHEN ts - p >= INTERVAL 15 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)) GROUP BY user_id, s")
def st5(spark, d):
    out = J.drained(J.inactivity_sessions(events(spark, d)), folder(spark), "complete")
    return out.select("user_id", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), F.col("end_ts").cast("timestamp_ntz").alias("end_ts"), "n")


@query("st1_unseen_events", "SELECT event_id, user_id, event_type FROM events")
def st1(spark, d):
    """Every event arrives twice."""
    e = events(spark, d).select("event_id", "user_id", "event_type", "ts")
    twice = e.unionByName(events(spark, d).select("event_id", "user_id", "event_type", "ts"))
    return J.drained(J.unseen(twice, "event_id").select("event_id", "user_id", "event_type"), folder(spark))


#: Of each day the sums in order, carried on over the days between; the state of a day is that of the day before, idle days and its own load.
FITNESS_SQL = """WITH RECURSIVE days AS (SELECT user_id, CAST(ts AS DATE) AS date, sum(value) AS load, row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) AS n FROM events GROUP BY 1, 2),
state AS (SELECT user_id, date, n, load AS ctl, load AS atl, NULL::DOUBLE AS tsb FROM days WHERE n = 1
  UNION ALL SELECT user_id, date, n, c + (load - c) / 42, a + (load - a) / 7, c - (a + (load - a) / 7) FROM
    (SELECT d.*, s.ctl * pow(1 - 1 / 42.0::DOUBLE, greatest(0, date_diff('day', s.date, d.date) - 1)) AS c, s.atl * pow(1 - 1 / 7.0::DOUBLE, greatest(0, date_diff('day', s.date, d.date) - 1)) AS a FROM state s JOIN days d ON d.user_id = s.user_id AND d.n = s.n + 1))
SELECT user_id, date, round(ctl, 6) AS ctl, round(atl, 6) AS atl, round(tsb, 6) AS tsb FROM state"""


@query("st4_fitness_state", FITNESS_SQL)
def st4(spark, d):
    days = events(spark, d).select("user_id", F.to_date("ts").alias("date"), F.col("value").alias("load"))
    out = J.drained(J.fitness(days), folder(spark))
    return out.select("user_id", "date", *(F.round(c, 6).alias(c) for c in ("ctl", "atl", "tsb")))


@query("st2_overlap_upsert", "SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN value * 2 WHEN event_id % 5 = 0 THEN value + 1 ELSE value END AS value FROM events")
def st2(spark, d):
    """Three batches that overlap: all events, a fifth of them again with other values, and a third with others still."""
    path, k = folder(spark), F.col("event_id")
    stream = events(spark, d).select("event_id", "user_id", "value")
    batches = [stream, stream.filter(k % 5 == 0).withColumn("value", F.col("value") + 1), stream.filter(k % 3 == 0).withColumn("value", F.col("value") * 2)]
    for i, batch in enumerate(batches):
        sink = J.upsert_sink(f"{path}/table", ["event_id"], first=1000 * i)
        batch.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/checkpoint{i}").trigger(availableNow=True).start().awaitTermination()
    return J.latest(spark, f"{path}/table", ["event_id"])


# --- several runs on one checkpoint -------------------------------------------------------------------------------------------

#: Noon of a day in the middle of the table, so that a day is split over two runs.
CUT = "SELECT date_trunc('DAY', timestamp_seconds((unix_seconds(min(ts)) + unix_seconds(max(ts))) div 2)) + INTERVAL 12 HOURS FROM {e}"


def run_twice(spark, d, job, overlap: str = "0 HOURS"):
    """What a job's sink holds after two runs on one checkpoint: events until the cut land before the first; those from `overlap`
    before it on, and a row from the first day of all, which is late by then, before the second."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    base = folder(spark)
    early = spark.sql(f"SELECT * FROM {{e}} WHERE ts < ({CUT})", e=e)
    late = spark.sql("SELECT -1L AS event_id, min(user_id) AS user_id, 'late' AS event_type, 1e6D AS value, min(ts) AS ts FROM {e}", e=e)
    then = spark.sql(f"SELECT * FROM {{e}} WHERE ts >= ({CUT}) - INTERVAL {overlap}", e=e).unionByName(late)
    out = None
    for rows in (early, then):
        rows.write.mode("append").parquet(f"{base}/landed")
        stream = spark.readStream.schema(e.schema).parquet(f"{base}/landed")
        out = J.drained(job(stream), base)
    return out


#: Days whose end the watermark, three days behind the greatest time, has passed.
CLOSED = "CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 4 DAY <= (SELECT max(ts) FROM events)"


@query("st1_unseen_over_runs", "SELECT event_id, user_id, event_type FROM events")
def st1_runs(spark, d):
    """The second run's files hold a day of the first's again."""
    return run_twice(spark, d, lambda e: J.unseen(e, "event_id").select("event_id", "user_id", "event_type"), "24 HOURS")


@query("st3_daily_load_over_runs", f"SELECT user_id, CAST(ts AS DATE) AS date, round(sum(value), 4) AS load, count(*) AS n FROM events WHERE {CLOSED} GROUP BY 1, 2")
def st3_runs(spark, d):
    out = run_twice(spark, d, J.daily_load)
    return out.select("user_id", "date", F.round("load", 4).alias("load"), "n")


@query("st4_fitness_over_runs", FITNESS_SQL.replace("FROM events GROUP BY 1, 2", f"FROM events WHERE {CLOSED} GROUP BY 1, 2"))
def st4_runs(spark, d):
    """Single rows: a day split over the runs is closed once, with both parts."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    J.rocks(spark)
    try:
        out = run_twice(spark, d, lambda e: J.closed_fitness(e.withColumnRenamed("value", "load")))
    finally:
        spark.conf.set(name, before)
    return out.select("user_id", "date", *(F.round(c, 6).alias(c) for c in ("ctl", "atl", "tsb")))


@query("st2_upsert_over_runs", "SELECT event_id, user_id, value FROM events UNION ALL SELECT -1, min(user_id), 1000000 FROM events")
def st2_runs(spark, d):
    """Each run's rows are a batch; rows of both runs are one row, late ones too, since an upsert has no watermark. Compacted at the end."""
    base = folder(spark)

    def job(e):
        e.select("event_id", "user_id", "value").writeStream.foreachBatch(J.upsert_sink(f"{base}/table", ["event_id"])).option("checkpointLocation", f"{base}/upserts").trigger(availableNow=True).start().awaitTermination()
        return e

    run_twice(spark, d, job, "24 HOURS")
    J.compacted(spark, f"{base}/table", f"{base}/compact", ["event_id"])
    return J.latest(spark, f"{base}/compact", ["event_id"])
