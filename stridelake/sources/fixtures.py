"""Sensor-shaped views of the given tables, in SQL that Spark and DuckDB both run; every row of the tables is used.

Integers make each value, so that both engines agree to the bit. `t` is seconds since an activity's start."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stridelake.sources.tables import TASK_ROWS, dealt, table

ACTIVITIES = """
SELECT o_orderkey AS activity_id, o_custkey % 25 AS athlete_id, CAST(o_orderdate AS DATE) AS date,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'cycling' WHEN '2-HIGH' THEN 'running' WHEN '3-MEDIUM' THEN 'hiking'
    WHEN '4-NOT SPECIFIED' THEN 'road_biking' ELSE 'lap_swimming' END AS sport,
  CAST(10 + (o_orderkey * 7) % 170 AS DOUBLE) AS duration_minutes,
  o_totalprice / 4999 AS total_trimp,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(110 + (o_orderkey * 13) % 75 AS DOUBLE) END AS avg_hr,
  CAST((o_orderkey * 3) % 40 AS DOUBLE) AS z1, CAST((o_orderkey * 5) % 35 AS DOUBLE) AS z2, CAST((o_orderkey * 7) % 25 AS DOUBLE) AS z3,
  CAST((o_orderkey * 11) % 15 AS DOUBLE) AS z4, CAST((o_orderkey * 13) % 8 AS DOUBLE) AS z5,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST((o_orderkey * 17) % 900 AS DOUBLE) / 10 END AS distance_km,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST((o_orderkey * 29) % 1500 AS DOUBLE) END AS ascent_m,
  CAST((o_orderkey * 19) % 45 AS DOUBLE) AS uphill_minutes,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST((o_orderkey * 19) % 38 - 2 AS DOUBLE) END AS avg_temp,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(15 + (o_orderkey * 23) % 50 AS DOUBLE) END AS max_hrr,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST((o_orderkey * 31) % 200 AS DOUBLE) / 10 - 5 END AS drift
FROM {orders}"""

BIO = """
SELECT athlete_id, date,
  CASE WHEN k % 9 = 0 THEN NULL ELSE CAST(35 + (k * 7) % 50 AS DOUBLE) END AS hrv,
  CASE WHEN k % 10 = 0 THEN NULL ELSE CAST(38 + (k * 11) % 14 AS DOUBLE) END AS rhr,
  CASE WHEN k % 8 = 0 THEN NULL ELSE CAST(40 + (k * 13) % 60 AS DOUBLE) END AS sleep_score,
  CASE WHEN k % 8 = 0 THEN NULL ELSE CAST(280 + (k * 17) % 260 AS DOUBLE) END AS sleep_minutes
FROM (SELECT o_custkey % 25 AS athlete_id, CAST(o_orderdate AS DATE) AS date, max(o_orderkey) AS k FROM {orders} GROUP BY 1, 2) AS days"""

_STEPS = """
SELECT l_suppkey AS activity_id, l_orderkey AS ok, CAST(l_linenumber AS BIGINT) AS ln,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS idx,
  sum(1 + (l_orderkey * 7 + l_linenumber * 13) % 29 + CASE WHEN (l_orderkey * 31 + l_linenumber) % 97 = 0 THEN 700 ELSE 0 END)
    OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS t
FROM {lineitem}"""

RECORDS = f"""
SELECT activity_id, CASE activity_id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'cycling' ELSE 'hiking' END AS sport, idx, CAST(t AS BIGINT) AS t,
  CASE WHEN (ok + ln * 7) % 41 = 0 THEN NULL ELSE CAST(95 + abs(CAST(t AS BIGINT) % 240 - 120) * 3 / 4 + ok % 5 AS DOUBLE) END AS hr,
  CASE WHEN (ok + ln) % 53 = 0 THEN NULL WHEN CAST(floor(t / 1000) AS BIGINT) % 5 = 3 THEN 0.0 ELSE CAST(20 + (ok * 3 + ln) % 30 AS DOUBLE) / 10 END AS speed,
  CAST(idx * 15 + CAST(floor(t / 1000) AS BIGINT) AS DOUBLE) AS distance,
  CASE WHEN (ok + ln * 3) % 29 = 0 THEN NULL ELSE CAST(200 + abs(CAST(floor(t / 8) AS BIGINT) % 400 - 200) AS DOUBLE) / 4 END AS altitude,
  CASE WHEN (ok + ln) % 17 = 0 THEN NULL ELSE CAST(60 + (ok * 5 + ln) % 40 AS DOUBLE) END AS cadence,
  CAST(120 + (ok * 7 + ln * 3) % 180 AS DOUBLE) AS power,
  CASE WHEN ok % 3 = 0 THEN NULL ELSE CAST(12 + (ok * 3 + ln) % 25 AS DOUBLE) END AS respiration,
  CAST(30 + (ok * 11 + ln) % 60 AS DOUBLE) AS hrv,
  CASE WHEN (ok + ln) % 19 = 0 THEN NULL ELSE 50 + CAST(activity_id % 12 AS DOUBLE) / 100 + CAST(floor(t / 1000) AS DOUBLE) / 2000 END AS lat,
  CASE WHEN (ok + ln) % 19 = 0 THEN NULL ELSE 14 + CAST(activity_id % 7 AS DOUBLE) / 100 + CAST(floor(t / 1500) AS DOUBLE) / 2000 END AS lon
FROM ({_STEPS}) AS steps"""

ALL = {"activities": (ACTIVITIES, "orders"), "bio": (BIO, "orders"), "records": (RECORDS, "lineitem")}


def view(spark: SparkSession, sf_dir: str, name: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """The view over the tables in a folder; records lie in partitions of about task_rows."""
    text, source = ALL[name]
    rows = table(spark, sf_dir, source)
    # Records meet by activity in all that follows, so this is the shuffle that the view's windows need anyway.
    return spark.sql(text, **{source: dealt(rows, "l_suppkey", rows=task_rows) if name == "records" else rows})


def sql(body: str) -> str:
    """A DuckDB query over the views and the given tables: body is a SELECT, or starts with more common tables 'name AS (...), ... SELECT'."""
    views = ", ".join(f"{name} AS ({text.format(**{source: source})})" for name, (text, source) in ALL.items())
    body = body.strip()
    return f"WITH {views} {body}" if body.upper().startswith("SELECT") else f"WITH {views}, {body}"
