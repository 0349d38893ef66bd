"""Queries over landing: sources and sinks, exports, JSON, joins, set operations, duplicates."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from stridelake.functions.scalars import activity_id_of, export_name, is_cycling
from stridelake.operators import ingest as G
from stridelake.plans.registry import query
from stridelake.sources import tables as T
from stridelake.sources.fixtures import sql, view
from stridelake.sources.tables import table


def acts(spark, d):
    return view(spark, d, "activities")


def events(spark, d):
    return table(spark, d, "events")


EXPORT = """ex AS (SELECT user_id % 25 AS athlete_id, CAST(ts AS DATE) AS date, event_type = 'view' AS workout, value AS v, event_id AS k FROM events)"""


def export_rows(spark, d):
    eu = lambda x: F.regexp_replace(x.cast("string"), r"\.", ",")
    v, k = F.col("value"), F.col("event_id")
    return events(spark, d).select(
        (F.col("user_id") % 25).alias("athlete_id"), F.date_format("ts", "dd.MM.yyyy HH:mm").alias("day"), F.when(F.col("event_type") == "view", "Run").alias("workout"),
        F.when(k % 5 == 0, "-").otherwise(eu(v)).alias("vo2"), (40 + k % 20).cast("string").alias("rhr"), F.concat(eu(v), F.lit("-"), eu(v + 4)).alias("hrv"),
        F.lit("97-98").alias("spo2"), F.concat((k % 9).cast("string"), F.lit("h "), (k % 60).cast("string"), F.lit("m")).alias("sleep"), F.concat(F.lit("1 "), F.lpad((k % 1000).cast("string"), 3, "0")).alias("active"), F.lit(None).cast("string").alias("resting"),
    )


@query("d28_health_export_days", sql(f"""{EXPORT}, dd AS (SELECT athlete_id, date, avg(CASE WHEN k % 5 <> 0 THEN v END) AS vo2, avg(40 + k % 20) AS rhr, avg(v + 2) AS hrv, avg(CASE WHEN NOT workout THEN 97.5::DOUBLE END) AS spo2,
  nullif(sum(CASE WHEN NOT workout THEN nullif((k % 9) * 60 + k % 60, 0) END), 0) AS sleep_min, nullif(sum(CASE WHEN NOT workout THEN 1000 + k % 1000 END), 0) AS active FROM ex GROUP BY 1, 2)
SELECT athlete_id, date, round(vo2, 8) AS vo2, round(rhr, 8) AS rhr, round(hrv, 8) AS hrv, spo2, sleep_min::DOUBLE AS sleep_min, active::DOUBLE AS active,
  round(CASE WHEN count(hrv) OVER w >= 3 THEN avg(hrv) OVER w END, 8) AS hrv_weekly FROM dd WINDOW w AS (PARTITION BY athlete_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""))
def d28(spark, d):
    out = G.export_days(G.clean_export(export_rows(spark, d)))
    return out.select("athlete_id", "date", *(F.round(c, 8).alias(c) for c in ("vo2", "rhr", "hrv", "hrv_weekly")), "spo2", "sleep_min", "active")


def landing(spark, d):
    """A response for each event: objects nested one to four deep, some as lists."""
    v, k = F.col("value"), F.col("event_id")
    n = lambda **kv: F.struct(*(x.alias(name) for name, x in kv.items()))
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    latest = n(trainingStatus=F.when(k % 2 == 0, "PEAKING"), acuteLoad=F.lit(0).cast("long"), recoveryTime=F.when(k % 3 == 0, k % 24), vo2Max=F.when(k % 4 > 0, 45 + k % 15), loadFocus=F.when(k % 3 > 0, "BALANCED"), anaerobicLoad=F.when(k % 5 > 0, k % 70), highAerobicLoad=k % 13)
    scores = n(overall=n(value=F.when(k % 3 > 0, 50 + k % 50)), remPercentage=n(value=k % 30), lightPercentage=n(value=40 + k % 20), deepPercentage=n(value=k % 25))
    body = n(
        hrvSummary=n(weeklyAvg=F.floor(v), lastNightAvg=F.when(k % 7 > 0, k % 90), lastNight5MinHigh=k % 120, status=F.col("event_type"), feedbackPhrase=F.when(k % 5 > 0, F.concat(F.lit("HRV_"), k % 3))),
        hrvReadings=F.slice(F.array(F.lit(1), F.lit(2)), F.lit(1), (k % 3).cast("int")),
        dailySleepDTO=n(sleepScores=scores, sleepTimeSeconds=k % 30000, sleepStartTimestampGMT=1700000000000 + k, sleepEndTimestampGMT=1700000000001 + k, awakeCount=k % 6, averageSpO2Value=90 + k % 10, averageRespirationValue=12 + k % 6),
        bodyBatteryHighestValue=k % 100, bodyBatteryLowestValue=k % 40, averageStressLevel=F.when(k % 4 > 0, k % 60), maxStressLevel=k % 95, restingHeartRate=F.lit(0).cast("long"),
        score=k % 80, recoveryTime=k % 24, sleepScore=k % 40, hrvFactorPercent=k % 10,
        mostRecentTrainingStatus=n(latestTrainingStatusData=latest, trainingStatus=F.when(k % 9 > 0, "BASE"), acuteLoad=F.when(k % 3 > 0, k % 200)),
        trainingStatus=F.lit("MAINTAINING"), acuteLoad=k % 500, vo2Max=k % 50, anaerobicLoad=k % 11, lowAerobicLoad=k % 17,
        generic=n(vo2MaxPreciseValue=F.when(k % 6 > 0, 40 + k % 20)), vo2MaxValue=k % 3, lactateThresholdHeartRate=150 + k % 30, lactateThresholdSpeed=k % 5,
        totalSteps=k % 20000, stepsGoal=F.lit(8000), floorsAscended=k % 9, moderateIntensityMinutes=k % 45, vigorousIntensityMinutes=k % 20,
        activityId=k, activityName=F.concat(F.lit("act_"), k % 7), activityType=n(typeId=k % 12), duration=k % 7200, distance=k % 40000, calories=k % 900, averageHR=F.when(k % 11 > 0, 110 + k % 75), maxHR=150 + k % 50, startTimeGMT=F.when(k % 5 > 0, stamp), startTimeLocal=F.when(k % 7 > 0, stamp), trainingLoad=k % 300, aerobicTrainingEffect=k % 6, anaerobicTrainingEffect=k % 4,
        maxHeartRate=k % 7 * 30, minHeartRate=40 + k % 9, heartRateValues=F.array(F.array(k, 60 + k % 80), F.array(k + 1, F.when(k % 3 > 0, 70 + k % 50)), F.array(k + 2, F.lit(0).cast("long"))),
    )
    one = F.to_json(body)
    return events(spark, d).select((F.col("user_id") % 25).alias("athlete_id"), F.to_date("ts").alias("date"), F.when(k % 10 == 0, F.concat(F.lit("["), one, F.lit("]"))).otherwise(one).alias("payload"), k.alias("event_id"))


def _d(**columns: str) -> str:
    """SQL of double columns: 0 counts as missing."""
    return ", ".join(f"nullif({x}, 0)::DOUBLE AS {c}" for c, x in columns.items())


#: For each table, its columns in SQL over event_id k and value.
JSON_SQL = {
    "hrv": _d(weekly_avg="floor(value)", last_night_avg="CASE WHEN k % 7 > 0 THEN k % 90 END", last_night_5min_high="k % 120") + ", event_type AS status, CASE WHEN k % 5 > 0 THEN 'HRV_' || (k % 3) END AS feedback_text, k % 3 AS sample_count",
    "sleep": _d(sleep_score="CASE WHEN k % 3 > 0 THEN 50 + k % 50 END", rem_sleep_percentage="k % 30", light_sleep_percentage="40 + k % 20", deep_sleep_percentage="k % 25", awake_count="k % 6", avg_spo2="90 + k % 10", avg_respiration="12 + k % 6") + ", (1700000000000 + k)::VARCHAR AS sleep_start_time, (1700000000001 + k)::VARCHAR AS sleep_end_time, k % 30000 // 60 AS duration_minutes",
    "daily_health": _d(body_battery_highest="k % 100", body_battery_lowest="k % 40", stress_average="CASE WHEN k % 4 > 0 THEN k % 60 END", stress_max="k % 95", resting_heart_rate="0"),
    "training_readiness": _d(score="k % 80", recovery_time="k % 24", sleep_score="k % 40", hrv_factor_percent="k % 10"),
    "training_status": "CASE WHEN k % 2 = 0 THEN 'PEAKING' WHEN k % 9 > 0 THEN 'BASE' END AS training_status, CASE WHEN k % 3 > 0 THEN 'BALANCED' END AS load_focus, " + _d(acute_load="CASE WHEN k % 3 > 0 THEN k % 200 END", recovery_time="CASE WHEN k % 3 = 0 THEN k % 24 END"),
    "load_focus": _d(anaerobic_load="coalesce(CASE WHEN k % 5 > 0 THEN nullif(k % 70, 0) END, k % 11)", high_aerobic_load="k % 13", low_aerobic_load="k % 17", vo2_max="CASE WHEN k % 4 > 0 THEN 45 + k % 15 ELSE k % 50 END", recovery_time="CASE WHEN k % 3 = 0 THEN k % 24 END"),
    "vo2_max": _d(vo2_max="CASE WHEN k % 6 > 0 THEN 40 + k % 20 WHEN k % 4 > 0 THEN 45 + k % 15 ELSE k % 50 END"),
    "lactate_threshold": _d(lt_heart_rate="150 + k % 30", lt_speed="k % 5"),
    "movement": _d(steps="k % 20000", steps_goal="8000", floors_ascended="k % 9"),
    "intensity": _d(moderate_min="k % 45", vigorous_min="k % 20") + ", (k % 45 + k % 20)::DOUBLE AS total_intensity_min",
    "activities": "nullif(k, 0)::VARCHAR AS activity_id, 'act_' || (k % 7) AS activity_name, nullif(k % 12, 0)::VARCHAR AS activity_type_id, " + _d(duration_seconds="k % 7200", distance_meters="k % 40000", calories="k % 900", avg_heart_rate="CASE WHEN k % 11 > 0 THEN 110 + k % 75 END", max_heart_rate="150 + k % 50", epoc_load="k % 300", aerobic_te="k % 6", anaerobic_te="k % 4") + ", CASE WHEN k % 7 > 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS start_time, CASE WHEN k % 5 > 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS start_time_utc",
    "training_status_history": "CASE WHEN k % 2 = 0 THEN 'PEAKING' WHEN k % 9 > 0 THEN 'BASE' ELSE 'MAINTAINING' END AS training_status, " + _d(acute_load="coalesce(CASE WHEN k % 3 > 0 THEN nullif(k % 200, 0) END, k % 500)", recovery_time="k % 24", vo2_max="CASE WHEN k % 4 > 0 THEN 45 + k % 15 ELSE k % 50 END"),
}
#: Which rows a table keeps, in SQL.
JSON_KEPT = {
    "activities": "date IS NOT NULL",
    "hrv": "sample_count > 0 OR last_night_avg IS NOT NULL",
    "sleep": "sleep_score > 0 OR duration_minutes > 0",
    "daily_health": "coalesce(body_battery_highest, body_battery_lowest, stress_average, stress_max, resting_heart_rate) IS NOT NULL",
    "training_readiness": "coalesce(score, recovery_time, sleep_score, hrv_factor_percent) IS NOT NULL",
    "training_status": "training_status IS NOT NULL OR acute_load IS NOT NULL OR recovery_time IS NOT NULL",
    "training_status_history": "training_status IS NOT NULL OR acute_load IS NOT NULL OR recovery_time IS NOT NULL",
    "load_focus": "coalesce(anaerobic_load, high_aerobic_load, low_aerobic_load, recovery_time, vo2_max) IS NOT NULL",
    "vo2_max": "vo2_max IS NOT NULL",
    "lactate_threshold": "coalesce(lt_heart_rate, lt_speed) IS NOT NULL",
}
for _label, _name in [*((f"e{i:02d}_json_{t}", t) for i, t in enumerate(["activities", "hrv", "vo2_max", "sleep", "daily_health", "training_readiness", "training_status", "load_focus", "lactate_threshold", "movement", "intensity"], 1)), ("e08_json_training_status_history", "training_status_history")]:

    def _extract(spark, d, name=_name):
        return G.extracted(landing(spark, d), name)

    _date = "CASE WHEN k % 35 > 0 THEN CAST(ts AS DATE) END" if _name == "activities" else "CAST(ts AS DATE)"
    query(_label, sql(f"SELECT * FROM (SELECT user_id % 25 AS athlete_id, {_date} AS date, {JSON_SQL[_name]} FROM (SELECT *, event_id AS k FROM events)) WHERE {JSON_KEPT.get(_name, "TRUE")}"))(_extract)


HR = """h AS (SELECT user_id % 25 AS athlete_id, CAST(ts AS DATE) AS date, event_id AS k, [60 + event_id % 80, CASE WHEN event_id % 3 > 0 THEN 70 + event_id % 50 END, 0] AS hr FROM events)"""


@query("e13_heart_rate_summary", sql(f"""{HR} SELECT athlete_id, date, round_even(round(list_avg(list_filter(hr, lambda x: x > 0)), 9), 1) AS avg_hr, (k % 7 * 30)::DOUBLE AS max_hr, (40 + k % 9)::DOUBLE AS min_hr, 0::DOUBLE AS resting_hr FROM h"""))
def e13(spark, d):
    return G.heart_rate_summary(landing(spark, d)).select("athlete_id", "date", "avg_hr", "max_hr", "min_hr", "resting_hr")


@query("e13_heart_rate_details", sql(f"""{HR} SELECT athlete_id, date, k + i - 1 AS ts_ms, hr[i]::DOUBLE AS heart_rate FROM h, range(1, 4) r(i) WHERE k % 10 <> 0 AND hr[i] > 0"""))
def e13_details(spark, d):
    """Of responses that are objects."""
    return G.heart_rate_details(landing(spark, d))


@query("f_json1_recursive_search", sql("SELECT event_id, CAST(CASE WHEN event_id % 6 > 0 THEN 40 + event_id % 20 ELSE event_id % 3 END AS VARCHAR) AS vo2, event_type AS status_any, CASE WHEN event_id % 4 > 0 THEN 'deep' || event_id % 5 END AS deep, NULL::VARCHAR AS missing FROM events"))
def f_json1(spark, d):
    """Keys four levels deep, in lists, ten and eleven levels deep, and before others of their kind."""
    k = F.col("event_id")
    deep = F.when(k % 4 > 0, F.concat(F.lit("deep"), k % 5))
    for level in range(10):  # the key lies in the tenth object below the outermost
        deep = F.struct(deep.alias("far_off" if level == 0 else f"n{level}"))
    vo2 = F.when(k % 6 > 0, 40 + k % 20).otherwise(k % 3)
    generic = F.struct(vo2.alias("vo2MaxPrecise"))
    items = F.array(F.struct(F.lit(1).alias("x"), F.when(F.lit(False), generic).alias("generic")), F.struct(F.lit(None).cast("int").alias("x"), generic.alias("generic")))
    body = F.struct(items.alias("list"), F.lit(99).alias("vo2max"))
    j = F.to_json(F.struct(body.alias("body"), F.struct(F.col("event_type").alias("theStatus"), F.lit("later").alias("status")).alias("meta"), deep.alias("chain"), F.struct(F.struct(deep.alias("n")).alias("n")).alias("too")))
    # The rows are few for their cost, a small file one task: they are dealt over all cores.
    told = events(spark, d).select("event_id", "event_type").repartition(8 * spark.sparkContext.defaultParallelism).select("event_id", j.alias("j"))
    names = {"vo2": "vo2max", "status_any": "STATUS", "deep": "far_off", "missing": "nowhere"}
    return told.select("event_id", *(G.found_anywhere(F.col("j"), key).alias(n) for n, key in names.items()))


VO2 = "v AS (SELECT user_id % 25 AS athlete_id, CAST(ts AS DATE) AS date, CASE k % 5 WHEN 0 THEN 40 + k % 7 WHEN 1 THEN 50 + k % 7 WHEN 2 THEN 60 WHEN 3 THEN 33 END::DOUBLE AS vo2_max FROM (SELECT *, event_id AS k FROM events))"


def uptakes(spark, d):
    """Oxygen uptakes at the usual path, under the precise name elsewhere, under another name deep in a list, in the second item of a list, and nowhere."""
    k = F.col("event_id")
    text = (
        F.when(k % 5 == 0, F.concat(F.lit('{"generic": {"vo2MaxPreciseValue": '), 40 + k % 7, F.lit('}, "vo2Max": 1}')))
        .when(k % 5 == 1, F.concat(F.lit('{"generic": {"x": 0}, "b": [{"vo2MaxPreciseValue": '), 50 + k % 7, F.lit("}]}")))
        .when(k % 5 == 2, F.lit('{"a": {"b": [[{"theVO2MaxValue": 60}]]}, "vo2Max": 5}'))
        .when(k % 5 == 3, F.lit('[{"x": 1}, {"vo2Max": 33}]'))
        .otherwise(F.lit('{"x": {"y": 0}}'))
    )
    return events(spark, d).select((F.col("user_id") % 25).alias("athlete_id"), F.to_date("ts").alias("date"), text.alias("payload"))


@query("e03_vo2_search", sql(f"{VO2} SELECT * FROM v WHERE vo2_max IS NOT NULL"))
def e03_search(spark, d):
    return G.extracted(uptakes(spark, d), "vo2_max")


@query("e03_vo2_range_fallback", sql(f"""{VO2}, m AS (SELECT max(date) AS e FROM v), w AS (SELECT v.*, e FROM v, m WHERE vo2_max IS NOT NULL AND (athlete_id % 3 > 0 OR date < e - 2))
SELECT athlete_id, date, vo2_max FROM (SELECT *, date >= e - 2 AS i, max(date >= e - 2) OVER (PARTITION BY athlete_id) AS a FROM w WHERE date >= e - 30) WHERE i OR NOT a"""))
def e03_range(spark, d):
    rows = G.extracted(uptakes(spark, d), "vo2_max")
    end = events(spark, d).agg(F.max(F.to_date("ts")).alias("e")).first()["e"]
    start = end - datetime.timedelta(days=2)
    return G.in_range_or_before(rows.filter((F.col("athlete_id") % 3 > 0) | (F.col("date") < F.lit(start))), str(start), str(end))


@query("e10_lactate_fallback", sql("""e AS (SELECT *, user_id % 25 AS athlete_id, CAST(ts AS DATE) AS day, event_id AS k FROM events),
r AS (SELECT athlete_id, CASE WHEN k % 4 = 0 THEN day ELSE DATE '2024-06-01' END AS date, (k % 5 * 30)::DOUBLE AS lt_heart_rate, (k % 3)::DOUBLE AS lt_speed FROM e WHERE athlete_id % 2 = 0 AND (k % 2 = 0 OR k % 15 > 0)
  UNION ALL SELECT athlete_id, DATE '2024-06-01', 0, 0 FROM e WHERE athlete_id % 2 = 0 AND k % 2 = 0),
s AS (SELECT athlete_id, day AS date, (k % 6 * 25)::DOUBLE AS lt_heart_rate, 0::DOUBLE AS lt_speed, row_number() OVER (PARTITION BY athlete_id ORDER BY day, k % 6 * 25) AS n FROM e WHERE athlete_id % 2 = 1 AND k % 6 > 0 AND day BETWEEN DATE '2024-01-05' AND DATE '2024-12-31')
SELECT * FROM r UNION ALL SELECT athlete_id, date, lt_heart_rate, lt_speed FROM s WHERE n <= 8"""))
def e10_fallback(spark, d):
    k, e = F.col("event_id"), events(spark, d).withColumns({"athlete_id": F.col("user_id") % 25, "date": F.to_date("ts")})
    dated = F.when(k % 4 == 0, F.concat(F.lit(', "date": "'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm"), F.lit('"'))).otherwise("")
    one = F.concat(F.lit('{"lactateThresholdHeartRate": '), k % 5 * 30, F.lit(', "lactateThresholdSpeed": '), k % 3, dated, F.lit("}"))
    reports = e.filter("athlete_id % 2 = 0").select("athlete_id", F.when(k % 2 == 0, F.concat(F.lit("["), one, F.lit(", {}]"))).otherwise(one).alias("payload"))
    daily = e.select("athlete_id", "date", F.concat(F.lit('{"lactateThresholdHeartRate": '), k % 6 * 25, F.lit("}")).alias("payload"))
    return G.lactate_threshold(reports, daily, "2024-01-05", "2024-12-31", "2024-06-01")


@query("s08_props_landing", sql("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"))
def s08(spark, d):
    return events(spark, d).select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "long").alias("k"))


@query("s01_j01_records_of_newest", sql("SELECT r.activity_id, count(*) AS n, max(t) AS last_t FROM records r WHERE activity_id IN (SELECT DISTINCT o_custkey FROM orders) GROUP BY 1"))
def s01(spark, d):
    ids = table(spark, d, "orders").select(F.col("o_custkey").alias("activity_id")).distinct()
    return view(spark, d, "records").join(ids, "activity_id", "left_semi").groupBy("activity_id").agg(F.count("*").alias("n"), F.max("t").alias("last_t"))


@query("s02_s03_typed_summary", sql("SELECT o_orderkey::VARCHAR AS activity_id, CAST(o_orderdate AS DATE) AS date, o_totalprice AS price FROM orders"))
def s02(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("activity_id"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("price"))


@query("s05_a17_union_distinct", sql("SELECT DISTINCT athlete_id, date, sport, NULL::DOUBLE AS hrv FROM activities UNION SELECT DISTINCT athlete_id, date, NULL, hrv FROM bio"))
def s05(spark, d):
    return T.union_all(acts(spark, d).select("athlete_id", "date", "sport"), view(spark, d, "bio").select("athlete_id", "date", "hrv")).distinct()


@query("s06b_landed_file", sql("SELECT activity_id, arg_min(path, p) AS path FROM (SELECT event_id AS activity_id, '/secondary/' || event_id || '.fit' AS path, 2 AS p FROM events UNION ALL SELECT event_id, '/primary/activity_' || event_id || '.fit', 1 FROM events WHERE user_id % 2 = 0) GROUP BY 1"))
def s06b(spark, d):
    e = events(spark, d)
    k = F.col("event_id").cast("string")
    files = e.select(F.concat(F.lit("/secondary/"), k, F.lit(".fit")).alias("path"), F.lit(2).alias("p")).unionByName(e.filter("user_id % 2 = 0").select(F.concat(F.lit("/primary/activity_"), k, F.lit(".fit")).alias("path"), F.lit(1).alias("p")))
    named = files.withColumn("activity_id", activity_id_of(F.col("path")).cast("long"))
    return T.latest(named, ["activity_id"], ["p", "path"]).select("activity_id", "path")


@query("s10_upsert", sql("o AS (SELECT activity_id, total_trimp AS v FROM activities), n AS (SELECT o_orderkey AS activity_id, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F') SELECT * FROM n UNION ALL SELECT * FROM o WHERE activity_id NOT IN (SELECT activity_id FROM n)"))
def s10(spark, d):
    new = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("activity_id"), F.col("o_totalprice").alias("v"))
    return T.upserted(acts(spark, d).select("activity_id", F.col("total_trimp").alias("v")), new, ["activity_id"])


@query("s11_j14_unseen", sql("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"))
def s11(spark, d):
    known = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return T.unseen(events(spark, d).select("event_id", "user_id"), known, ["user_id"])


@query("s12_changed_files", sql("SELECT path, mtime FROM (SELECT event_id, 'f/' || event_id AS path, epoch_us(ts) // 1000000 AS mtime FROM events) WHERE event_id % 5 = 0 OR event_id % 3 = 2 OR event_id % 7 = 0"))
def s12(spark, d):
    k = F.col("event_id")
    files = events(spark, d).select("event_id", F.concat(F.lit("f/"), k).alias("path"), F.unix_timestamp("ts").alias("mtime"))
    cache = files.filter(k % 5 > 0).select("path", (F.col("mtime") + k % 3).alias("mtime"), F.when(k % 7 == 0, 1).otherwise(2).alias("version"))
    return T.changed_files(files, cache, 2).select("path", "mtime")


@query("s13_incremental_window", sql("SELECT activity_id, date FROM activities WHERE date >= (SELECT max(date) FROM activities) - 3"))
def s13(spark, d):
    a = acts(spark, d)
    since = a.agg(F.date_sub(F.max("date"), 3).alias("since"))
    return a.join(F.broadcast(since), F.col("date") >= F.col("since")).select("activity_id", "date")  # one row


@query("s14_changed_ids", sql("SELECT DISTINCT athlete_id FROM activities WHERE activity_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')"))
def s14(spark, d):
    ids = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("activity_id"))
    return acts(spark, d).join(ids, "activity_id", "left_semi").select("athlete_id").distinct()


@query("s15_cycling_export", sql("SELECT activity_id, athlete_id, date, sport FROM activities WHERE regexp_matches(sport, 'cycl|biking|ride')"))
def s15(spark, d):
    return acts(spark, d).filter(is_cycling(F.col("sport"))).select("activity_id", "athlete_id", "date", "sport")


@query("p10_enforced_schema", sql("SELECT activity_id::VARCHAR AS activity_id, NULL::DOUBLE AS vo2_max, sport FROM activities"))
def p10(spark, d):
    from pyspark.sql import types as ST

    schema = ST.StructType([ST.StructField("activity_id", ST.StringType()), ST.StructField("vo2_max", ST.DoubleType()), ST.StructField("sport", ST.StringType())])
    return T.enforced(acts(spark, d), schema)


@query("j02_j03_enriched_activities", sql("SELECT activity_id, date, hrv, sleep_score FROM activities LEFT JOIN bio USING (athlete_id, date)"))
def j02(spark, d):
    daily = view(spark, d, "bio").dropDuplicates(["athlete_id", "date"])
    return acts(spark, d).join(daily, ["athlete_id", "date"], "left").select("activity_id", "date", "hrv", "sleep_score")


@query("j04_daily_frame", sql("SELECT athlete_id, date, trimp, hrv, rhr, coalesce(trimp, 0) * coalesce(rhr, 0) AS mixed FROM (SELECT athlete_id, date, round(sum(z1 + z2), 4) AS trimp FROM activities GROUP BY 1, 2) LEFT JOIN (SELECT athlete_id, date, hrv FROM bio) USING (athlete_id, date) LEFT JOIN (SELECT athlete_id, date, rhr FROM bio WHERE rhr > 40) USING (athlete_id, date)"))
def j04(spark, d):
    on, bio = ["athlete_id", "date"], view(spark, d, "bio")
    days = acts(spark, d).groupBy(*on).agg(F.round(F.sum(F.col("z1") + F.col("z2")), 4).alias("trimp"))
    out = days.join(bio.select(*on, "hrv"), on, "left").join(bio.filter("rhr > 40").select(*on, "rhr"), on, "left")
    return out.withColumn("mixed", F.coalesce("trimp", F.lit(0.0)) * F.coalesce("rhr", F.lit(0.0)))


@query("j07_pause_intervals", sql("pz AS (SELECT user_id, ts AS a, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b, event_type FROM events), pp AS (SELECT user_id, a, b FROM pz WHERE event_type = 'error' AND b IS NOT NULL) SELECT user_id, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM pp WHERE pp.user_id = e.user_id AND e.ts BETWEEN a AND b)) AS paused FROM events e GROUP BY 1"))
def j07(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts")
    e = events(spark, d).withColumns({"open": F.col("event_type") == "error", "next": F.lead("ts").over(w)})
    # A pause runs from an error to the user's next event, so a row is paused if it or the row before opened one.
    opened = F.col("open") & F.col("next").isNotNull()
    e = e.withColumn("paused", opened | F.coalesce(F.lag("open").over(w), F.lit(False)))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("paused").alias("paused"))


@query("j15_address_lookup", sql("SELECT activity_id, idx, 'place ' || (CAST(floor(lat * 100) AS BIGINT) % 7) AS address FROM records WHERE lat IS NOT NULL AND CAST(floor(lat * 100) AS BIGINT) % 7 <> 3"))
def j15(spark, d):
    cell = F.floor(F.col("lat") * 100).cast("long")
    r = view(spark, d, "records").filter("lat IS NOT NULL").withColumn("key", cell.cast("string"))
    book = r.select("key", F.concat(F.lit("place "), (F.col("key").cast("long") % 7).cast("string")).alias("address")).distinct().filter("address <> 'place 3'")
    return r.join(book, "key").select("activity_id", "idx", "address")


@query("j16_activities_with_records", sql("SELECT s_suppkey AS activity_id, count(l_suppkey) AS n FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1"))
def j16(spark, d):
    n = view(spark, d, "records").groupBy("activity_id").agg(F.count("*").alias("n"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("activity_id"))
    return s.join(n, "activity_id", "left").select("activity_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("j17_combine_first", sql("SELECT athlete_id, date, coalesce(b.hrv, a.avg_hr / 3) AS hrv FROM (SELECT athlete_id, date, max(avg_hr) AS avg_hr FROM activities GROUP BY 1, 2) a LEFT JOIN bio b USING (athlete_id, date)"))
def j17(spark, d):
    on = ["athlete_id", "date"]
    a = acts(spark, d).groupBy(*on).agg(F.max("avg_hr").alias("avg_hr"))
    return a.join(view(spark, d, "bio").select(*on, "hrv"), on, "left").select(*on, F.coalesce("hrv", F.col("avg_hr") / 3).alias("hrv"))


@query("a18_keep_last", sql("SELECT athlete_id, sport, activity_id, date FROM (SELECT *, row_number() OVER (PARTITION BY athlete_id, sport ORDER BY date DESC, activity_id DESC) AS n FROM activities) WHERE n = 1"))
def a18(spark, d):
    return T.latest(acts(spark, d), ["athlete_id", "sport"], [F.desc("date"), F.desc("activity_id")]).select("athlete_id", "sport", "activity_id", "date")


@query("a21_distinct_counts", sql("SELECT sport, count(DISTINCT athlete_id) AS athletes, count(DISTINCT date) AS days FROM activities GROUP BY 1"))
def a21(spark, d):
    return acts(spark, d).groupBy("sport").agg(F.countDistinct("athlete_id").alias("athletes"), F.countDistinct("date").alias("days"))


@query("u02_source_tag_union", sql("SELECT source, count(*) AS n, min(id) AS lo, max(id) AS hi FROM (SELECT 'primary' AS source, o_orderkey AS id FROM orders UNION ALL SELECT 'secondary', l_orderkey FROM lineitem) GROUP BY 1"))
def u02(spark, d):
    a = table(spark, d, "orders").select(F.lit("primary").alias("source"), F.col("o_orderkey").alias("id"))
    b = table(spark, d, "lineitem").select(F.lit("secondary").alias("source"), F.col("l_orderkey").alias("id"))
    return T.union_all(a, b).groupBy("source").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))


@query("u05_wide_to_long", sql("SELECT activity_id, zone, minutes FROM (UNPIVOT (SELECT activity_id, z1, z2, z3, z4, z5 FROM activities) ON z1, z2, z3, z4, z5 INTO NAME zone VALUE minutes)"))
def u05(spark, d):
    zones = ["z1", "z2", "z3", "z4", "z5"]
    return acts(spark, d).select("activity_id", *zones).unpivot("activity_id", zones, "zone", "minutes")


@query("d29_file_profile", sql("""r AS (SELECT activity_id AS file_id, count(*) AS n_records, count(*) FILTER (hr > 0) AS n_hr, min(t) AS start_t FROM records GROUP BY 1),
dv AS (SELECT s_suppkey AS file_id, s_nationkey % 3 <> 0 AS hr, s_nationkey % 3 = 1 AS strap FROM supplier)
SELECT file_id, n_records, n_hr, round(n_hr / n_records, 8) AS density, start_t, CASE WHEN strap THEN 'strap' WHEN hr THEN 'optical' ELSE 'unknown' END AS sensor FROM r LEFT JOIN dv USING (file_id)"""))
def d29(spark, d):
    kind = F.col("s_nationkey") % 3
    devices = table(spark, d, "supplier").select(F.col("s_suppkey").alias("file_id"), F.when(kind != 0, "heart_rate").otherwise("gps").alias("device_type"), F.when(kind == 1, "antplus").otherwise("local").alias("source_type"))
    out = G.file_profile(view(spark, d, "records").withColumnRenamed("activity_id", "file_id"), devices)
    return out.withColumn("density", F.round("density", 8))


SESSIONS = """se AS (SELECT user_id AS athlete_id, epoch_us(ts) // 1000000 AS start_t, event_id AS file_id, CASE WHEN event_id % 2 = 0 THEN 'primary' ELSE 'secondary' END AS source, 1000 + event_id % 700 AS n_records, event_id % 60 AS n_rr,
  (50 + event_id % 51) / 100.0::DOUBLE AS density, CASE event_id % 3 WHEN 0 THEN 'strap' WHEN 1 THEN 'optical' ELSE 'unknown' END AS sensor, event_id % 97 AS size FROM events)"""


def sessions(spark, d):
    k = F.col("event_id")
    return events(spark, d).select(
        F.col("user_id").alias("athlete_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long").alias("start_t"), k.alias("file_id"),
        F.when(k % 2 == 0, "primary").otherwise("secondary").alias("source"), (1000 + k % 700).alias("n_records"), (k % 60).alias("n_rr"), ((50 + k % 51) / F.lit(100.0)).alias("density"),
        F.when(k % 3 == 0, "strap").when(k % 3 == 1, "optical").otherwise("unknown").alias("sensor"), (k % 97).alias("size"),
    )


WINNER = """CASE WHEN abs(a.n_records - b.n_records) / greatest(a.n_records, b.n_records, 1) > 0.25 THEN b.n_records > a.n_records
 WHEN a.source <> b.source THEN CASE WHEN (a.source = 'primary' AND a.sensor = 'strap') OR (b.source = 'primary' AND b.sensor = 'strap') THEN b.source = 'primary'
   WHEN a.sensor = 'strap' OR b.sensor = 'strap' THEN a.source = 'primary' WHEN (a.n_rr >= 30) <> (b.n_rr >= 30) THEN b.n_rr >= 30
   WHEN CASE WHEN a.source = 'primary' THEN a.density ELSE b.density END >= 0.9 THEN b.source = 'primary' ELSE a.source = 'primary' END
 WHEN (a.sensor = 'strap' AND b.sensor = 'unknown') OR (b.sensor = 'strap' AND a.sensor = 'unknown') THEN b.sensor = 'strap'
 WHEN a.sensor <> 'unknown' AND b.sensor <> 'unknown' AND a.sensor <> b.sensor THEN b.sensor = 'strap'
 WHEN a.sensor = 'unknown' AND b.sensor = 'unknown' AND (a.n_rr >= 30) <> (b.n_rr >= 30) THEN b.n_rr >= 30
 WHEN a.density <> b.density THEN b.density > a.density ELSE b.size > a.size END"""


@query("d30_pair_winner", sql(f"{SESSIONS}, p AS (SELECT *, lead(file_id) OVER (PARTITION BY athlete_id ORDER BY start_t, file_id) AS other FROM se) SELECT a.file_id, b.file_id AS other, CASE WHEN {WINNER} THEN b.file_id ELSE a.file_id END AS winner FROM p a JOIN se b ON b.file_id = a.other"))
def d30(spark, d):
    from pyspark.sql import Window

    s = sessions(spark, d)
    pair = s.select(F.struct(*s.columns).alias("a"), F.lead(F.struct(*s.columns)).over(Window.partitionBy("athlete_id").orderBy("start_t", "file_id")).alias("b")).filter("b IS NOT NULL")
    return pair.select(F.col("a.file_id"), F.col("b.file_id").alias("other"), F.when(G.second_wins(F.col("a"), F.col("b")), F.col("b.file_id")).otherwise(F.col("a.file_id")).alias("winner"))


#: The walk in SQL: from each kept session to the next one; `w` is the winner of the two, which is told once the next lies outside its window.
WALK = f"""{SESSIONS}, o AS (SELECT *, row_number() OVER (PARTITION BY athlete_id ORDER BY start_t, file_id) AS n FROM se),
walk AS (SELECT athlete_id, n, file_id AS held FROM o WHERE n = 1 UNION ALL
  SELECT b.athlete_id, b.n, CASE WHEN b.start_t - a.start_t > 1800 OR ({WINNER}) THEN b.file_id ELSE a.file_id END
  FROM walk JOIN o a ON a.file_id = walk.held JOIN o b ON b.athlete_id = walk.athlete_id AND b.n = walk.n + 1),
last AS (SELECT walk.*, h.start_t AS held_t, nx.start_t AS next_t FROM walk JOIN o h ON h.file_id = walk.held LEFT JOIN o nx ON nx.athlete_id = walk.athlete_id AND nx.n = walk.n + 1)"""


@query("d31_j12_deduplicated_sessions", "WITH RECURSIVE " + f"{WALK} SELECT athlete_id, start_t, file_id, source, n_records, n_rr, density, sensor, size FROM se WHERE file_id IN (SELECT held FROM last WHERE next_t IS NULL OR next_t - held_t > 1800)")
def d31(spark, d):
    return G.deduplicated(sessions(spark, d))


# --- the four tables of an export, marts, and tables that come and go ---------------------------------------------------------

DD = f"""{EXPORT}, dd AS (SELECT athlete_id, date, avg(CASE WHEN k % 5 <> 0 THEN v END) AS vo2, avg(40 + k % 20) AS rhr, avg(v + 2) AS hrv, avg(CASE WHEN NOT workout THEN 97.5::DOUBLE END) AS spo2,
  nullif(sum(CASE WHEN NOT workout THEN nullif((k % 9) * 60 + k % 60, 0) END), 0) AS sleep_min, nullif(sum(CASE WHEN NOT workout THEN 1000 + k % 1000 END), 0) AS active FROM ex GROUP BY 1, 2),
hv AS (SELECT athlete_id, date, round(hrv, 1) AS last_night_avg FROM dd WHERE hrv IS NOT NULL)"""
_EXPORT_SQL = {
    "hrv": "SELECT athlete_id, date, round_even(round(hrv, 9), 1) AS last_night_avg FROM dd WHERE hrv IS NOT NULL",
    "sleep": "SELECT athlete_id, date, CAST(sleep_min AS BIGINT) AS duration_minutes, round(spo2, 1) AS avg_spo2 FROM dd WHERE sleep_min IS NOT NULL",
    "daily_health": "SELECT athlete_id, date, round_even(round(rhr, 9), 1) AS resting_heart_rate, active::DOUBLE AS active_calories FROM dd WHERE rhr IS NOT NULL OR active IS NOT NULL",
    "vo2_max": "SELECT athlete_id, date, (q + CASE WHEN r > 5000000 OR r = 5000000 AND q % 2 = 1 THEN 1 ELSE 0 END) / 100 AS vo2_max FROM (SELECT *, m // 10000000 AS q, m % 10000000 AS r FROM (SELECT *, CAST(round(vo2 * 1000000000) AS BIGINT) AS m FROM dd WHERE vo2 IS NOT NULL))",
}
_EXPORT_NULLS = {
    "hrv": "NULL::DOUBLE AS last_night_5min_high, NULL::VARCHAR AS status, NULL::VARCHAR AS feedback_text, NULL::BIGINT AS sample_count",
    "sleep": "NULL::DOUBLE AS sleep_score, NULL::VARCHAR AS sleep_start_time, NULL::VARCHAR AS sleep_end_time, NULL::DOUBLE AS rem_sleep_percentage, NULL::DOUBLE AS light_sleep_percentage, NULL::DOUBLE AS deep_sleep_percentage, NULL::DOUBLE AS awake_count, NULL::DOUBLE AS avg_respiration",
    "daily_health": "NULL::DOUBLE AS body_battery_highest, NULL::DOUBLE AS body_battery_lowest, NULL::DOUBLE AS stress_average, NULL::DOUBLE AS stress_max, NULL::DOUBLE AS resting_calories",
}
_WEEKLY = "round_even(round(CASE WHEN count(*) OVER w >= 3 THEN avg(last_night_avg) OVER w END, 9), 1) AS weekly_avg"
for _table, _select in _EXPORT_SQL.items():

    def _export(spark, d, name=_table):
        return G.export_tables(G.clean_export(export_rows(spark, d)))[name]

    _more = ", ".join(x for x in (_EXPORT_NULLS.get(_table), _WEEKLY if _table == "hrv" else None) if x)
    _window = " WINDOW w AS (PARTITION BY athlete_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)" if _table == "hrv" else ""
    query(f"d28_export_{_table}", sql(f"{DD} SELECT *{', ' + _more if _more else ''} FROM ({_select}){_window}"))(_export)


def place(spark) -> str:
    return f"{T.shared_folder(spark)}/table-{uuid.uuid4().hex}"


@query("s04_optional_table", sql("SELECT activity_id, date FROM activities"))
def s04(spark, d):
    """A table that is not there counts as an empty one."""
    a = acts(spark, d).select("activity_id", "date")
    return T.union_all(a, T.optional(spark, f"{place(spark)}/nowhere", a.schema))


@query("s09_append", sql("SELECT activity_id, sport FROM activities"))
def s09(spark, d):
    path, a = place(spark), acts(spark, d).select("activity_id", "sport")
    for part in (a.filter("activity_id % 3 = 0"), a.filter("activity_id % 3 > 0")):
        T.append(part, path, "sport")
    return spark.read.parquet(path).select("activity_id", "sport")


@query("s16_export_by_name", sql("SELECT sport || '_' || date_part('year', date) AS export_name, activity_id FROM activities WHERE regexp_matches(sport, 'cycl|biking|ride')"))
def s16(spark, d):
    """A folder for each name (of sport and year here, for there would be one for each activity with the names of F-str9)."""
    path, a = place(spark), acts(spark, d).filter(is_cycling(F.col("sport")))
    T.export_by(a.select("activity_id", F.concat_ws("_", "sport", F.year("date")).alias("export_name")), path, "export_name")
    return spark.read.parquet(path).select("export_name", "activity_id")


@query("s17_mart_write_back", sql("SELECT activity_id, round_even(round(total_trimp, 9), 1) AS total_trimp, round_even(round(avg_hr / 7, 9), 2) AS pace FROM activities"))
def s17(spark, d):
    mart = acts(spark, d).select("activity_id", "total_trimp", (F.col("avg_hr") / 7).alias("pace"))
    return T.write_mart(mart, place(spark), {"total_trimp": 1, "pace": 2})


@query("s13_missing_files", sql("SELECT activity_id, date FROM activities WHERE date >= (SELECT max(date) FROM activities) - 3 AND activity_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"))
def s13_missing(spark, d):
    a = acts(spark, d)
    landed = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("activity_id"))
    since = a.agg(F.max("date").alias("m")).first()["m"] - datetime.timedelta(days=3)
    return T.missing_files(a.select("activity_id", "date"), landed, "activity_id", since)


@query("p11_found_columns", sql("SELECT activity_id, total_trimp AS load, sport AS kind FROM activities"))
def p11(spark, d):
    a = acts(spark, d)
    return a.select("activity_id", F.col(T.find_column(a, "TRIMP")).alias("load"), F.col(T.first_existing(a, ["type", "sport", "activity_id"])).alias("kind"))


@query("p23_rearranged", sql("SELECT activity_id, sport, total_trimp AS load, date FROM activities"))
def p23(spark, d):
    a = acts(spark, d).select("activity_id", "date", "total_trimp", "sport", "z1")
    out = T.rearranged(a, drop=["z1", "nothing"], rename={"total_trimp": "load"}, after={"sport": "activity_id", "date": "load", "none": "date"})
    assert out.columns == ["activity_id", "sport", "load", "date"]
    return out


@query("j03_d46_enriched", sql("SELECT activity_id, date, avg_hr, hrv, sleep_score, CASE WHEN hrv > 50 THEN sleep_score + hrv END AS readiness FROM activities LEFT JOIN bio USING (athlete_id, date)"))
def j03(spark, d):
    """The activity table with the daily measures; a column of theirs that it has already is not taken."""
    daily = view(spark, d, "bio").withColumns({"readiness": F.when(F.col("hrv") > 50, F.col("sleep_score") + F.col("hrv")), "avg_hr": F.lit(0.0)})
    return T.enriched(acts(spark, d), daily, ["athlete_id", "date"]).select("activity_id", "date", "avg_hr", "hrv", "sleep_score", "readiness")


@query("j05_sport_and_date", sql("SELECT r.activity_id, a.sport, a.date, count(*) AS n FROM records r LEFT JOIN activities a USING (activity_id) GROUP BY ALL"))
def j05(spark, d):
    known = acts(spark, d).select("activity_id", "sport", "date")
    return view(spark, d, "records").groupBy("activity_id").agg(F.count("*").alias("n")).join(known, "activity_id", "left")


@query("t07_recent_fuel", sql("f AS (SELECT athlete_id, date, z1*6*0.8::DOUBLE + z2*8*0.6::DOUBLE + z3*10*0.4::DOUBLE + z4*12*0.1::DOUBLE AS fat FROM activities), m AS (SELECT max(date) AS d FROM activities) SELECT athlete_id, round(sum(fat) / 9, 5) AS fat_g, count(*) AS n FROM f, m WHERE date >= d - 7 GROUP BY 1"))
def t07(spark, d):
    """The fat burnt in the last seven days."""
    from stridelake.operators.activity import fueling

    a = acts(spark, d)
    as_of = a.agg(F.max("date").alias("m")).first()["m"]
    recent = a.filter(F.col("date") >= F.date_sub(F.lit(as_of), 7)).withColumn("fat_g", fueling()["fat_g"])
    return recent.groupBy("athlete_id").agg(F.round(F.sum("fat_g"), 5).alias("fat_g"), F.count("*").alias("n"))


@query("f_dt6_backfill_days", sql("SELECT athlete_id, CAST(unnest(generate_series(first - INTERVAL 2 DAY, first + INTERVAL 3 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT athlete_id, min(date) AS first FROM activities GROUP BY 1)"))
def f_dt6(spark, d):
    first = acts(spark, d).groupBy("athlete_id").agg(F.min("date").alias("first"))
    return first.select("athlete_id", F.explode(F.sequence(F.date_sub("first", 2), F.date_add("first", 3))).alias("day"))


@query("w17_pause_islands", sql("SELECT activity_id, island, count(*) AS n FROM (SELECT *, sum(CASE WHEN t - p > 900 THEN 1 ELSE 0 END) OVER (PARTITION BY activity_id ORDER BY idx) AS island FROM (SELECT *, lag(t) OVER (PARTITION BY activity_id ORDER BY idx) AS p FROM records WHERE coalesce(speed, 0) < 2.2)) GROUP BY 1, 2"))
def w17_pauses(spark, d):
    """Islands of slow rows, apart by over 900 s."""
    from pyspark.sql import Window

    from stridelake.functions import rolling as R

    w = Window.partitionBy("activity_id").orderBy("idx")
    r = view(spark, d, "records").filter("coalesce(speed, 0) < 2.2").withColumn("gap", F.col("t") - F.lag("t").over(w))
    return r.withColumn("island", R.islands(F.col("gap"), 900, ["activity_id"], ["idx"])).groupBy("activity_id", "island").agg(F.count("*").alias("n"))


DAILY = {
    "activities": ("activities", "athlete_id long, date date, sport string, total_trimp double, missing double"),
    "hrv": ("bio", "athlete_id long, date date, hrv double"),
    "health": ("bio", "athlete_id long, date date, rhr double"),
    "sleep": ("bio", "athlete_id long, date date, sleep_score double, sleep_minutes double"),
}


@query("s03_daily_tables", sql("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{name}' AS tab, athlete_id, count(*) AS n, min(date) AS first, max(date) AS last, count({value}) AS known FROM {source} WHERE athlete_id % 9 > 0 GROUP BY 2" for name, source, value in (("activities", "activities", "total_trimp"), ("hrv", "bio", "hrv"), ("health", "bio", "rhr"), ("sleep", "bio", "sleep_minutes"))) + ")"))
def s03(spark, d):
    """The four daily tables from texts, with times behind the dates, blanks around values, words for missing ones and unreadable dates."""
    from pyspark.sql import types as ST

    out = []
    for name, (source, ddl) in DAILY.items():
        schema = ST._parse_datatype_string(ddl)
        have = [f.name for f in schema.fields if f.name not in ("date", "missing")]
        date = F.when(F.col("athlete_id") % 9 > 0, F.concat(F.col("date").cast("string"), F.lit("T06:00:00"))).otherwise("unknown")
        texts = view(spark, d, source).select(date.alias("date"), *(F.coalesce(F.concat(F.lit(" "), F.col(c).cast("string")), F.lit("n/a")).alias(c) for c in have), F.lit("x").alias("other"))
        value = have[-1]
        table_ = T.read_daily(texts, schema)
        out.append(table_.groupBy("athlete_id").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.count(value).alias("known")).withColumn("tab", F.lit(name)))
    return T.union_all(*out)


@query("s19_lookup_table", sql("SELECT c_custkey, 'Town of ' || n_name AS address FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 5 > 0"))
def s19(spark, d):
    """A cache of addresses as one JSON object, read back and looked up; a fifth of the keys is not in it."""
    path = place(spark)
    pair = F.struct(F.col("n_nationkey").cast("string").alias("key"), F.concat(F.lit("Town of "), "n_name").alias("value"))
    book = table(spark, d, "nation").filter("n_nationkey % 5 > 0").agg(F.map_from_entries(F.collect_list(pair)).alias("m"))  # 25 nations
    book.select(F.to_json("m").alias("value")).write.text(path)
    held = T.read_lookup(spark, path).withColumnRenamed("value", "address")
    c = table(spark, d, "customer").withColumn("key", F.col("c_nationkey").cast("string"))
    return c.join(held, "key", "left").select("c_custkey", "address")


# --- real files -------------------------------------------------------------------------------------------------------------


def scratch(spark, name: str) -> str:
    return f"{T.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("s05_csv_landing", sql("SELECT event_id, user_id, CASE WHEN event_id % 3 > 0 THEN value END AS value, NULL::VARCHAR AS corrupt FROM events UNION ALL SELECT NULL, NULL, NULL, 'only ' || event_type FROM (SELECT DISTINCT event_type FROM events)"))
def s05_csv(spark, d):
    """Files in two folders: one with quoted and padded headers, one with other columns in another order; and one with broken lines."""
    e, base = events(spark, d), scratch(spark, "csv")
    first = e.filter("event_id % 3 > 0").select(F.col("event_id").alias(" event_id "), F.col("value").alias("value"), F.col("user_id").alias("user_id "), "event_type")
    first.write.option("header", "true").option("quoteAll", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(f"{base}/a")
    e.filter("event_id % 3 = 0").select("user_id", "event_type", "event_id").write.option("header", "true").csv(f"{base}/b/deeper")
    broken = e.select(F.concat(F.lit("only "), "event_type").alias("value")).distinct()
    # A header for each of these files: a partition's first line.
    headed = broken.coalesce(1).select(F.explode(F.when(F.monotonically_increasing_id() == 0, F.array(F.lit("event_id,user_id"), "value")).otherwise(F.array("value"))).alias("value"))
    headed.write.text(f"{base}/c")
    kinds = T.T.StructType([T.T.StructField("event_id", T.T.LongType()), T.T.StructField("user_id", T.T.LongType()), T.T.StructField("value", T.T.DoubleType())])
    return T.read_csvs(spark, base, kinds, pattern="*.{csv,txt}")


@query("s12_rewritten_files", sql("SELECT event_type, count(*) AS n FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1"))
def s12_files(spark, d):
    """Files of a table whose cached state no longer holds after one of its partitions was written again; and what they hold."""
    path = scratch(spark, "states")
    T.export_by(events(spark, d).select("event_id", "value", "event_type"), path, "event_type")
    cache = T.stored(T.file_states(spark, path).select("path", "mtime").withColumn("version", F.lit(2)))
    first = events(spark, d).agg(F.min("event_type").alias("event_type"))
    again = events(spark, d).select("event_id", "value", "event_type").join(F.broadcast(first), "event_type", "left_semi")
    again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_type").parquet(path)
    changed = T.changed_files(T.file_states(spark, path), cache, 2)
    rows = spark.read.parquet(path).select("event_type", F.col("_metadata.file_path").alias("path"))
    return rows.join(changed.select("path"), "path", "left_semi").groupBy("event_type").agg(F.count("*").alias("n"))


@query("s10_s14_partition_upsert", sql("SELECT o_orderkey AS activity_id, CASE WHEN o_orderstatus = 'P' THEN -o_totalprice ELSE o_totalprice END AS v, o_orderpriority AS part FROM orders WHERE o_orderpriority < '3' UNION ALL SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderpriority >= '3' UNION ALL SELECT -1, 0, '1-URGENT'"))
def s10_partitions(spark, d):
    """Two of five partitions get changed rows and a new one; the key is the first of the known names that the rows have."""
    path = scratch(spark, "upsert")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("activity_id"), F.col("o_totalprice").alias("v"), F.col("o_orderpriority").alias("part"), "o_orderstatus")
    T.export_by(o.drop("o_orderstatus"), path, "part")
    new = o.filter("o_orderstatus = 'P' AND part < '3'").select("activity_id", (-F.col("v")).alias("v"), "part")
    more = spark.range(1).selectExpr("-1L AS activity_id", "0D AS v", "'1-URGENT' AS part")
    return T.upsert_partitions(new.unionByName(more), path, "part")


@query("s01c_records_of_newest_cardio", sql("n AS (SELECT activity_id FROM activities WHERE regexp_matches(sport, 'cycl|bik|run|walk|hik|ski') ORDER BY date DESC, activity_id LIMIT 10000) SELECT activity_id, count(*) AS n, max(t) AS last_t FROM records JOIN n USING (activity_id) GROUP BY 1"))
def s01c(spark, d):
    """The newest 10,000 cardio activities (a top-k report) say which records are read."""
    return G.records_of_newest(acts(spark, d), view(spark, d, "records"), 10_000).groupBy("activity_id").agg(F.count("*").alias("n"), F.max("t").alias("last_t"))


@query("s16_records_by_export_name", sql("SELECT printf('%s_%skm_%dmin_%dm_%d', date::VARCHAR, CASE WHEN distance_km IS NULL THEN '0.0' ELSE printf('%.1f', distance_km) END, CAST(duration_minutes AS BIGINT), CAST(coalesce(ascent_m, 0) AS BIGINT), activity_id) AS export_name, count(*) AS n, max(t) AS last_t FROM records r JOIN activities a USING (activity_id) WHERE regexp_matches(r.sport, 'cycl|biking|ride') GROUP BY 1, activity_id"))
def s16_records(spark, d):
    """The records of each cycling activity in a folder of its export name (F-str9); read back from the folders."""
    path = scratch(spark, "export")
    rides = view(spark, d, "records").filter(is_cycling(F.col("sport"))).select("activity_id", "idx", "t", "hr", "speed")
    names = acts(spark, d).select("activity_id", export_name(*map(F.col, ("date", "distance_km", "duration_minutes", "ascent_m", "activity_id"))).alias("export_name"))
    T.export_by(rides.join(names, "activity_id"), path, "export_name")
    return spark.read.parquet(path).groupBy("export_name").agg(F.count("*").alias("n"), F.max("t").alias("last_t"))
