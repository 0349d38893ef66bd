"""Queries over activity summaries and record streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stridelake.functions import rolling as R
from stridelake.operators import activity as A
from stridelake.operators import rr as RR
from stridelake.plans.registry import query
from stridelake.profile import DEFAULT
from stridelake.sources.fixtures import sql, view

I = "PARTITION BY activity_id ORDER BY idx"


def acts(spark, d):
    return view(spark, d, "activities")


def recs(spark, d):
    return view(spark, d, "records")


@query("d09_vam", sql("SELECT activity_id, round(CASE WHEN regexp_matches(sport, 'hiking|walking|running|cycling|biking') AND ascent_m > 50 AND duration_minutes > 15 AND ascent_m / (coalesce(distance_km, 0) * 1000 + 1e-5) > 0.04 THEN ascent_m / (CASE WHEN uphill_minutes > 0 THEN uphill_minutes ELSE duration_minutes / 2 END / 60) END, 7) AS vam FROM activities"))
def d09(spark, d):
    c = F.col
    return acts(spark, d).select("activity_id", F.round(A.vam(c("duration_minutes"), c("ascent_m"), c("distance_km"), c("uphill_minutes"), c("sport")), 7).alias("vam"))


@query("d15_fueling", sql("SELECT activity_id, round(z1*6*0.8::DOUBLE + z2*8*0.6::DOUBLE + z3*10*0.4::DOUBLE + z4*12*0.1::DOUBLE, 6) AS fat_kcal, round(z1*6*0.2::DOUBLE + z2*8*0.4::DOUBLE + z3*10*0.6::DOUBLE + z4*12*0.9::DOUBLE + z5*14, 6) AS carb_kcal, round((z1*6*0.8::DOUBLE + z2*8*0.6::DOUBLE + z3*10*0.4::DOUBLE + z4*12*0.1::DOUBLE) / 9, 6) AS fat_g FROM activities"))
def d15(spark, d):
    f = A.fueling()
    return acts(spark, d).select("activity_id", *(F.round(f[n], 6).alias(n) for n in ("fat_kcal", "carb_kcal", "fat_g")))


@query("d16_fluid_loss", sql("SELECT activity_id, round(duration_minutes / 60 * (0.6::DOUBLE + greatest(0, coalesce(avg_temp, 20) - 20) * 0.1::DOUBLE), 7) AS fluid_l FROM activities"))
def d16(spark, d):
    return acts(spark, d).select("activity_id", F.round(A.fluid_loss_l(F.col("duration_minutes"), F.col("avg_temp")), 7).alias("fluid_l"))


@query("d17_temperature_effect", sql("SELECT athlete_id, n_hot, n_cool, CASE WHEN ok THEN round(h, 6) END AS drift_hot, CASE WHEN ok THEN round(c, 6) END AS drift_cool, CASE WHEN ok THEN round(h - c, 6) END AS temp_effect FROM (SELECT *, n_hot >= 3 AND n_cool >= 3 AS ok FROM (SELECT athlete_id, count(*) FILTER (coalesce(avg_temp > 25, false)) AS n_hot, count(*) FILTER (NOT coalesce(avg_temp > 25, false)) AS n_cool, avg(drift) FILTER (coalesce(avg_temp > 25, false)) AS h, avg(drift) FILTER (NOT coalesce(avg_temp > 25, false)) AS c FROM activities WHERE drift IS NOT NULL GROUP BY 1))"))
def d17(spark, d):
    t = A.temperature_effect(acts(spark, d))
    return t.select("athlete_id", "n_hot", "n_cool", *(F.round(c, 6).alias(c) for c in ("drift_hot", "drift_cool", "temp_effect")))


@query("d19_d20_threshold_epoc", sql("SELECT activity_id, z4 + z5 AS tte_min, 2 * z4 + 5 * z5 AS epoc, round(least(96, 0.08::DOUBLE * pow(coalesce(total_trimp, 0), 1.2::DOUBLE)), 5) AS recovery_h FROM activities"))
def d19(spark, d):
    c = F.col
    return acts(spark, d).select("activity_id", (c("z4") + c("z5")).alias("tte_min"), A.epoc_score(c("z4"), c("z5")).alias("epoc"), F.round(A.recovery_hours(c("total_trimp")), 5).alias("recovery_h"))


@query("d25_p18_climb_score", sql("SELECT activity_id, s AS climb_score, CASE WHEN s IS NULL THEN '' WHEN s < 1 THEN 'Flat' WHEN s < 3 THEN 'Rolling' WHEN s < 6 THEN 'Hilly' ELSE 'Mountainous' END AS category FROM (SELECT activity_id, round_even(round(ascent_m / nullif(distance_km * 1000, 0) * 100, 9), 2) AS s FROM activities)"))
def d25(spark, d):
    s = A.climb_score(F.col("ascent_m"), F.col("distance_km"))
    return acts(spark, d).select("activity_id", s.alias("climb_score")).withColumn("category", A.climb_category(F.col("climb_score")))


@query("d24_critical_hr", sql("g AS (SELECT athlete_id, count(*) AS n, quantile_cont(avg_hr, 0.85) FILTER (duration_minutes >= 30) AS q FROM activities WHERE regexp_matches(sport, 'cycl|bik|run') AND avg_hr IS NOT NULL AND duration_minutes >= 20 GROUP BY 1), r AS (SELECT athlete_id, CASE WHEN n >= 5 THEN CAST(floor(least(coalesce(q, 169.15), 169.15)) AS BIGINT) END AS critical_hr FROM g) SELECT activity_id, critical_hr, CASE WHEN critical_hr IS NULL THEN 0 ELSE z4 * greatest(0, 177 - critical_hr) + z5 * greatest(0, 191 - critical_hr) END AS tati FROM activities LEFT JOIN r USING (athlete_id)"))
def d24(spark, d):
    return A.critical_hr(acts(spark, d)).select("activity_id", "critical_hr", F.round("tati", 6).alias("tati"))


@query("a08_effort_quantile", sql("SELECT athlete_id, round(quantile_cont(avg_hr, 0.85), 6) AS q85 FROM activities WHERE duration_minutes >= 30 GROUP BY 1"))
def a08(spark, d):
    return acts(spark, d).filter("duration_minutes >= 30").groupBy("athlete_id").agg(F.round(F.percentile("avg_hr", F.lit(0.85)), 6).alias("q85"))


@query("p07_eligible_activities", sql("SELECT activity_id, sport, duration_minutes FROM activities WHERE regexp_matches(sport, 'running|cycling') AND duration_minutes >= 20"))
def p07(spark, d):
    return acts(spark, d).filter("sport RLIKE 'running|cycling' AND duration_minutes >= 20").select("activity_id", "sport", "duration_minutes")


@query("t01_newest_cardio", sql("SELECT activity_id, date FROM activities WHERE regexp_matches(sport, 'cycl|bik|run|walk|hik|ski') ORDER BY date DESC, activity_id LIMIT 10000"))
def t01(spark, d):
    """A top-k report: the newest 10,000 activities."""
    from stridelake.functions.scalars import is_cardio

    return acts(spark, d).filter(is_cardio(F.col("sport"))).orderBy(F.desc("date"), "activity_id").limit(10000).select("activity_id", "date")


@query("t03_arg_max_rows", sql("SELECT athlete_id, max(max_hrr) AS best_drop, min(activity_id) FILTER (max_hrr = m) AS activity_id FROM (SELECT *, max(max_hrr) OVER (PARTITION BY athlete_id) AS m FROM activities) GROUP BY 1"))
def t03(spark, d):
    best = F.max(F.when(F.col("max_hrr").isNotNull(), F.struct("max_hrr", (-F.col("activity_id")).alias("a"))))
    return acts(spark, d).groupBy("athlete_id").agg(best.alias("b")).select("athlete_id", F.col("b.max_hrr").alias("best_drop"), (-F.col("b.a")).alias("activity_id"))


@query("a22_run_summary", sql("SELECT sport, count(*) AS n, round(sum(total_trimp), 3) AS trimp, round(avg(total_trimp), 6) AS mean_trimp, count(DISTINCT athlete_id) AS athletes FROM activities GROUP BY 1"))
def a22(spark, d):
    return acts(spark, d).groupBy("sport").agg(F.count("*").alias("n"), F.round(F.sum("total_trimp"), 3).alias("trimp"), F.round(F.avg("total_trimp"), 6).alias("mean_trimp"), F.countDistinct("athlete_id").alias("athletes"))


# --- records --------------------------------------------------------------------------------------------------------------

Z = """CASE WHEN {h} IS NULL THEN '' WHEN {h} BETWEEN 100 AND 136 THEN 'Z1' WHEN {h} BETWEEN 137 AND 155 THEN 'Z2' WHEN {h} BETWEEN 156 AND 171 THEN 'Z3' WHEN {h} BETWEEN 172 AND 183 THEN 'Z4' WHEN {h} BETWEEN 184 AND 199 THEN 'Z5' WHEN {h} > 199 THEN 'Z5+' ELSE 'Z1' END"""
FILL = f"""known AS (SELECT *, max(CASE WHEN hr IS NOT NULL THEN idx END) OVER ({I} ROWS UNBOUNDED PRECEDING) AS p0, min(CASE WHEN hr IS NOT NULL THEN idx END) OVER ({I} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p1 FROM records),
filled AS (SELECT k.*, CASE WHEN k.hr IS NOT NULL THEN k.hr WHEN k.idx - p0 <= 15 THEN coalesce(a.hr + (b.hr - a.hr) * (k.idx - p0) / (p1 - p0), a.hr) END AS hf FROM known k
  LEFT JOIN records a ON a.activity_id = k.activity_id AND a.idx = k.p0 LEFT JOIN records b ON b.activity_id = k.activity_id AND b.idx = k.p1),
zoned AS (SELECT *, {Z.format(h="h")} AS zone, CASE WHEN prev IS NULL THEN 1 ELSE greatest(0, least(120, t - prev)) END::DOUBLE AS dt FROM (SELECT *, CAST(round_even(hf, 0) AS INTEGER) AS h, lag(t) OVER ({I}) AS prev FROM filled)),
active AS (SELECT *, coalesce(speed > CASE WHEN sport LIKE '%cycling%' THEN 0.833::DOUBLE ELSE 0.3::DOUBLE END, false) OR zone NOT IN ('Z1', '') AS is_active FROM zoned),
rec2 AS (SELECT *, CASE WHEN is_active AND h > 41 THEN dt / 60 * r * 0.64::DOUBLE * exp(1.92::DOUBLE * r) ELSE 0 END AS trimp FROM (SELECT *, greatest(0, least(1, (h - 41) / 158.0::DOUBLE)) AS r FROM active))"""


@query("w19_interpolation", sql(f"{FILL} SELECT activity_id, idx, round(hf, 6) AS hr FROM filled"))
def w19(spark, d):
    return recs(spark, d).select("activity_id", "idx", F.round(R.interpolated("hr", "idx", ["activity_id"], ["idx"], 15), 6).alias("hr"))


@query("p01_p04_zones_and_activity", sql(f"{FILL} SELECT activity_id, idx, zone, dt, is_active, round(trimp, 6) AS trimp FROM rec2"))
def p01(spark, d):
    return A.with_zones(recs(spark, d)).select("activity_id", "idx", "zone", "dt", "is_active", F.round("trimp", 6).alias("trimp"))


@query("d27_activity_roll_up", sql(f"{FILL}, sm AS (SELECT *, quantile_cont(speed, 0.5) OVER ({I} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS smooth, altitude - lag(altitude) OVER ({I}) AS up FROM rec2) SELECT activity_id, count(*) AS records_count, round(sum(trimp), 5) AS total_trimp, CAST(round_even(round(avg(h) FILTER (h > 0), 9), 0) AS BIGINT) AS avg_hr, CAST(max(least(h, 199)) FILTER (h IS NOT NULL) AS BIGINT) AS max_hr, " + ", ".join(f"round(coalesce(sum(dt) FILTER (is_active AND zone IN ('Z{i}', 'Z{i}+')), 0) / 60, 6) AS z{i}" for i in range(1, 6)) + ", round(coalesce(sum(dt) FILTER (is_active), 0) / 60, 6) AS active_minutes, round(quantile_cont(smooth, 0.99) FILTER (smooth > 0) * 3.6::DOUBLE, 6) AS max_speed_kmh, round((max(distance) - min(distance)) / 1000, 6) AS distance_km, round(coalesce(sum(up) FILTER (up > 0), 0), 6) AS ascent_m, round(coalesce(sum(dt) FILTER (up > 0), 0) / 60, 6) AS uphill_minutes FROM sm GROUP BY 1"))
def d27(spark, d):
    r = A.roll_up(recs(spark, d))
    whole = ("activity_id", "records_count", "avg_hr", "max_hr")
    return r.select(*whole, F.round("total_trimp", 5).alias("total_trimp"), *(F.round(c, 6).alias(c) for c in r.columns if c not in (*whole, "total_trimp")))


@query("w16_time_steps", sql(f"SELECT activity_id, idx, CASE WHEN p IS NULL THEN 1 ELSE greatest(0, least(120, t - p)) END::DOUBLE AS dt FROM (SELECT *, lag(t) OVER ({I}) AS p FROM records)"))
def w16(spark, d):
    return recs(spark, d).select("activity_id", "idx", R.time_step("t", ["activity_id"], ["idx"]).alias("dt"))


@query("w17_gap_islands", sql(f"SELECT activity_id, island, count(*) AS n, min(t) AS t0, max(t) AS t1 FROM (SELECT *, sum(CASE WHEN t - p > 600 THEN 1 ELSE 0 END) OVER ({I}) AS island FROM (SELECT *, lag(t) OVER ({I}) AS p FROM records)) GROUP BY 1, 2"))
def w17(spark, d):
    w = Window.partitionBy("activity_id").orderBy("idx")
    r = recs(spark, d).withColumn("gap", F.col("t") - F.lag("t").over(w))
    r = r.withColumn("island", R.islands(F.col("gap"), 600, ["activity_id"], ["idx"]))
    return r.groupBy("activity_id", "island").agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"))


@query("w15_running_median", sql(f"SELECT activity_id, idx, round(quantile_cont(speed, 0.5) OVER ({I} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS median3 FROM records"))
def w15(spark, d):
    return recs(spark, d).select("activity_id", "idx", F.round(R.rolling_median3("speed", ["activity_id"], ["idx"]), 6).alias("median3"))


@query("w18_merge_intervals", sql("iv AS (SELECT activity_id % 50 AS g, idx * 37 % 5000 AS a, idx * 37 % 5000 + 5 + (activity_id + idx) % 11 AS b FROM records), o AS (SELECT *, max(b) OVER (PARTITION BY g ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM iv), r AS (SELECT *, sum(CASE WHEN a - p > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM o) SELECT g, min(a) AS a, max(b) AS b FROM r GROUP BY g, run"))
def w18(spark, d):
    iv = recs(spark, d).selectExpr("activity_id % 50 AS g", "idx * 37 % 5000 AS a", "idx * 37 % 5000 + 5 + (activity_id + idx) % 11 AS b")
    return R.merged_intervals(iv, ["g"], "a", "b", 2)


@query("w22_gradient", sql(f"SELECT activity_id, idx, round((altitude - lag(altitude) OVER ({I})) / nullif(distance - lag(distance) OVER ({I}), 0) * 100, 6) AS gradient FROM records"))
def w22(spark, d):
    w = Window.partitionBy("activity_id").orderBy("idx")
    diff = lambda c: F.col(c) - F.lag(c).over(w)
    return recs(spark, d).select("activity_id", "idx", F.round(diff("altitude") / F.nullif(diff("distance"), F.lit(0.0)) * 100, 6).alias("gradient"))


@query("w31_first_last_valid", sql("SELECT activity_id, arg_min(altitude, idx) FILTER (altitude IS NOT NULL) AS first_altitude, arg_max(distance, idx) FILTER (distance IS NOT NULL) AS total_distance FROM records GROUP BY 1"))
def w31(spark, d):
    known = lambda c: F.when(F.col(c).isNotNull(), F.col("idx"))
    return recs(spark, d).groupBy("activity_id").agg(F.min_by("altitude", known("altitude")).alias("first_altitude"), F.max_by("distance", known("distance")).alias("total_distance"))


@query("a23_time_halves", sql("SELECT activity_id, round(avg(hr) FILTER (t <= mid), 6) AS hr1, round(avg(hr) FILTER (t > mid), 6) AS hr2 FROM (SELECT *, (min(t) OVER (PARTITION BY activity_id) + max(t) OVER (PARTITION BY activity_id)) / 2 AS mid FROM records) GROUP BY 1"))
def a23(spark, d):
    w = Window.partitionBy("activity_id")
    r = recs(spark, d).withColumn("mid", (F.min("t").over(w) + F.max("t").over(w)) / 2)
    half = lambda cond: F.round(F.avg(F.when(cond, F.col("hr"))), 6)
    return r.groupBy("activity_id").agg(half(F.col("t") <= F.col("mid")).alias("hr1"), half(F.col("t") > F.col("mid")).alias("hr2"))


@query("a24_hr_bins", sql("SELECT activity_id, CAST(floor(hr / 5) * 5 AS BIGINT) AS bin, count(*) AS n, round(avg(hrv), 6) AS mean_hrv FROM records WHERE hr > 0 GROUP BY 1, 2 HAVING count(*) >= 3"))
def a24(spark, d):
    b = (F.floor(F.col("hr") / 5) * 5).cast("long").alias("bin")
    return recs(spark, d).filter("hr > 0").groupBy("activity_id", b).agg(F.count("*").alias("n"), F.round(F.avg("hrv"), 6).alias("mean_hrv")).filter("n >= 3")


EFFORT = """eff AS (SELECT *, sport LIKE '%cycling%' AS cycling, CASE WHEN sport LIKE '%cycling%' THEN power ELSE speed END AS e FROM records),
mov AS (SELECT * FROM eff WHERE (coalesce(speed > CASE WHEN cycling THEN 0.833::DOUBLE ELSE 0.3::DOUBLE END, false) OR coalesce(hr, 0) > 136) AND hr > 0 AND e > 0)"""
HALF = """{out} AS (SELECT activity_id, any_value(cycling) AS cycling, count(*) AS n, max(hi) - max(lo) AS span, avg(e) FILTER (t <= (lo + hi) / 2) AS m1, avg(e) FILTER (t > (lo + hi) / 2) AS m2,
  avg(e) FILTER (t <= (lo + hi) / 2) / avg(hr) FILTER (t <= (lo + hi) / 2) AS ef1, avg(e) FILTER (t > (lo + hi) / 2) / avg(hr) FILTER (t > (lo + hi) / 2) AS ef2
  FROM (SELECT *, min(t) OVER (PARTITION BY activity_id) AS lo, max(t) OVER (PARTITION BY activity_id) AS hi FROM {src}) GROUP BY 1)"""


@query("d01_cardiac_drift", sql(f"""{EFFORT}, w1 AS (SELECT *, min(t) OVER (PARTITION BY activity_id) AS f0, count(*) OVER (PARTITION BY activity_id) AS n0 FROM mov),
w2 AS (SELECT *, count(*) OVER (PARTITION BY activity_id) AS n1, max(altitude) OVER (PARTITION BY activity_id) - min(altitude) OVER (PARTITION BY activity_id) AS rng, count(altitude) OVER (PARTITION BY activity_id) AS na FROM w1 WHERE n0 >= 20 AND t >= f0 + 600),
w3 AS (SELECT * FROM w2 WHERE n1 >= 20 AND (cycling OR (NOT coalesce(na >= 10 AND rng > 30, false) AND {Z.format(h='CAST(floor(hr) AS INTEGER)')} IN ('Z1', 'Z2', '')))), {HALF.format(out='h', src='w3')}
SELECT activity_id, CASE WHEN m1 >= CASE WHEN cycling THEN 30 ELSE 2 / 3.6::DOUBLE END AND m2 >= CASE WHEN cycling THEN 30 ELSE 2 / 3.6::DOUBLE END THEN round_even(round((ef1 - ef2) / ef1 * 100, 9), 2) END AS cardiac_drift FROM h WHERE n >= 20"""))
def d01(spark, d):
    return A.cardiac_drift(recs(spark, d))


@query("d18_durability", sql(f"""{EFFORT}, {HALF.format(out='h', src='mov')} SELECT activity_id, CASE WHEN m1 >= CASE WHEN cycling THEN 30 ELSE 0.56::DOUBLE END AND m2 >= CASE WHEN cycling THEN 30 ELSE 0.56::DOUBLE END THEN round_even(round((ef2 / ef1 - 1) * 100, 9), 2) END AS durability FROM h WHERE n >= 20 AND span >= 7200"""))
def d18(spark, d):
    return A.durability(recs(spark, d))


DENSE = """kn AS (SELECT activity_id, t, avg(hr) AS hr FROM records WHERE hr IS NOT NULL GROUP BY 1, 2),
pr AS (SELECT *, lead(t) OVER (PARTITION BY activity_id ORDER BY t) AS t2, lead(hr) OVER (PARTITION BY activity_id ORDER BY t) AS hr2 FROM kn),
ds AS (SELECT activity_id, s AS t, hr + coalesce((hr2 - hr) * (s - t) / (t2 - t), 0) AS hr FROM (SELECT *, unnest(range(t, least(coalesce(t2 - 1, t), t + 30) + 1)) AS s FROM pr))"""


@query("w20_resample", sql(f"{DENSE} SELECT activity_id, t, round(hr, 6) AS hr FROM ds"))
def w20(spark, d):
    return A.resampled_hr(recs(spark, d)).select("activity_id", "t", F.round("hr", 6).alias("hr"))


@query("d02_w21_max_hr_drop", sql(f"""{DENSE}, f AS (SELECT *, lead(hr, 60) OVER w AS e, hr - lead(hr, 3) OVER w AS f3 FROM ds WINDOW w AS (PARTITION BY activity_id ORDER BY t)),
g AS (SELECT *, max(f3) OVER (PARTITION BY activity_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 57 FOLLOWING) AS worst FROM f),
b AS (SELECT activity_id, count(*) AS n, max(hr - e) FILTER (hr >= 110 AND hr - e > 0 AND hr - e <= 90 AND worst <= 30) AS d FROM g GROUP BY 1)
SELECT c.activity_id, CASE WHEN known >= 60 AND n >= 61 THEN round_even(round(d, 9), 1) END AS max_hr_drop FROM (SELECT activity_id, count(hr) AS known FROM records GROUP BY 1) c LEFT JOIN b USING (activity_id)"""))
def d02(spark, d):
    return A.max_hr_drop(recs(spark, d))


SEG = """o AS (SELECT *, row_number() OVER (PARTITION BY activity_id ORDER BY speed, idx) - 1 AS rn, count(*) OVER (PARTITION BY activity_id) AS n FROM {src}),
k AS (SELECT *, least(10, n // 20) AS k FROM o WHERE n >= 100), s AS (SELECT *, rn // (n // k) AS segment FROM k WHERE k >= 4),
g AS (SELECT activity_id, segment, avg(speed) AS speed, avg(hr) AS hr FROM s WHERE segment < k GROUP BY 1, 2)"""
BREAK = f"""{FILL}, mv AS (SELECT *, count(*) OVER (PARTITION BY activity_id) AS n0, (altitude - lag(altitude) OVER ({I})) / nullif(distance - lag(distance) OVER ({I}), 0) * 100 AS grade FROM active WHERE is_active AND hr > 0 AND speed > 0.5),
flat AS (SELECT * EXCLUDE (n0, grade) FROM mv WHERE n0 >= 100 AND coalesce(abs(grade) <= 2, true)), {SEG.format(src='flat')},
sl AS (SELECT *, lead(hr) OVER w AS after, CASE WHEN abs(lead(speed) OVER w - speed) > 0.05 THEN (lead(hr) OVER w - hr) / (lead(speed) OVER w - speed) END AS slope FROM g WINDOW w AS (PARTITION BY activity_id ORDER BY segment)),
ch AS (SELECT *, lead(slope) OVER (PARTITION BY activity_id ORDER BY segment) - slope AS change FROM sl WHERE slope IS NOT NULL),
bp AS (SELECT activity_id, CASE WHEN count(*) >= 3 THEN CAST(floor(arg_max(after, {{'c': change, 's': -segment}}) FILTER (change IS NOT NULL)) AS BIGINT) END AS breakpoint_hr FROM ch GROUP BY 1)"""
PROXY = f"""{BREAK}, kn2 AS (SELECT *, CAST(floor(hr / 5) * 5 AS BIGINT) AS bin FROM records WHERE hr > 0 AND hrv IS NOT NULL), bn AS (SELECT activity_id, bin, avg(hrv) AS m FROM kn2 GROUP BY 1, 2 HAVING count(*) >= 3),
lo AS (SELECT activity_id, count(*) AS bins, min(bin) FILTER (m < best / 2) AS low FROM (SELECT *, max(m) OVER (PARTITION BY activity_id) AS best FROM bn) GROUP BY 1),
lw AS (SELECT activity_id, CASE WHEN vals > 60 AND pairs > 100 AND bins >= 4 THEN low END AS low FROM (SELECT activity_id, count(hrv) AS vals, count(*) FILTER (hr > 0 AND hrv IS NOT NULL) AS pairs FROM records GROUP BY 1) LEFT JOIN lo USING (activity_id)),
px AS (SELECT activity_id, CASE WHEN low > 159.2 THEN NULL WHEN low >= 130 THEN low WHEN breakpoint_hr BETWEEN 130 AND 159.2 THEN breakpoint_hr END AS threshold_hr FROM lw LEFT JOIN bp USING (activity_id))"""


@query("d21_threshold_proxy", sql(f"{PROXY} SELECT activity_id, threshold_hr FROM px"))
def d21(spark, d):
    return A.threshold_proxy(A.with_zones(recs(spark, d)))


@query("w24_speed_breakpoint", sql(f"{BREAK} SELECT activity_id, breakpoint_hr FROM bp"))
def w24(spark, d):
    return A.speed_breakpoint(A.with_zones(recs(spark, d)))


@query("d21_low_hrv_bin", sql(f"{PROXY} SELECT activity_id, low FROM lw"))
def d21_bin(spark, d):
    return A.low_hrv_bin(recs(spark, d))


@query("w23_w24_speed_segments", sql("""o AS (SELECT *, row_number() OVER (PARTITION BY activity_id ORDER BY speed, idx) - 1 AS rn, count(*) OVER (PARTITION BY activity_id) AS n FROM records WHERE speed > 0.5 AND hr > 0),
k AS (SELECT *, least(10, n // 20) AS k FROM o WHERE n >= 100), s AS (SELECT *, rn // (n // k) AS segment FROM k WHERE k >= 4),
g AS (SELECT activity_id, segment, avg(speed) AS speed, avg(hr) AS hr FROM s WHERE segment < k GROUP BY 1, 2)
SELECT activity_id, segment, round(speed, 6) AS speed, round(hr, 6) AS hr, round(CASE WHEN abs(lead(speed) OVER w - speed) > 0.05 THEN (lead(hr) OVER w - hr) / (lead(speed) OVER w - speed) END, 6) AS slope FROM g WINDOW w AS (PARTITION BY activity_id ORDER BY segment)"""))
def w23(spark, d):
    return A.speed_segments(recs(spark, d)).select("activity_id", "segment", *(F.round(c, 6).alias(c) for c in ("speed", "hr", "slope")))


# --- beat intervals -------------------------------------------------------------------------------------------------------

RRV = "rr AS (SELECT activity_id, idx AS beat, CASE WHEN hr > 0 THEN 60000 / hr + (idx * 37) % 41 - 20 + CASE WHEN idx % 23 = 0 THEN 400 ELSE 0 END END AS rr_ms FROM records WHERE hr > 0)"


def beats(spark, d):
    return recs(spark, d).filter("hr > 0").selectExpr("activity_id", "idx AS beat", "60000 / hr + (idx * 37) % 41 - 20 + CASE WHEN idx % 23 = 0 THEN 400 ELSE 0 END AS rr_ms")


@query("a25_rmssd", sql(f"{RRV} SELECT activity_id, round(sqrt(avg(pow(d, 2))), 5) AS rmssd FROM (SELECT activity_id, rr_ms - lag(rr_ms) OVER (PARTITION BY activity_id ORDER BY beat) AS d FROM rr) GROUP BY 1"))
def a25(spark, d):
    return RR.rmssd(beats(spark, d)).select("activity_id", F.round("rmssd", 5).alias("rmssd"))


@query("w30_ectopic_filter", sql(f"{RRV} SELECT activity_id, beat, round(rr_ms, 6) AS rr_ms FROM (SELECT *, lag(rr_ms) OVER (PARTITION BY activity_id ORDER BY beat) AS p FROM rr WHERE rr_ms BETWEEN 273 AND 2000) WHERE p IS NULL OR abs(rr_ms - p) / p <= 0.20"))
def w30(spark, d):
    return RR.without_ectopic(beats(spark, d)).select("activity_id", "beat", F.round("rr_ms", 6).alias("rr_ms"))


@query("f_arr2_beat_times", sql(f"{RRV} SELECT activity_id, beat, round(sum(rr_ms) OVER (PARTITION BY activity_id ORDER BY beat), 4) AS t_ms FROM rr"))
def f_arr2(spark, d):
    return RR.beat_times(beats(spark, d)).select("activity_id", "beat", F.round("t_ms", 4).alias("t_ms"))


@query("w27_beat_windows", sql(f"{RRV}, n AS (SELECT *, row_number() OVER (PARTITION BY activity_id ORDER BY beat) - 1 AS i, count(*) OVER (PARTITION BY activity_id) AS n FROM rr) SELECT activity_id, win, round(avg(rr_ms), 6) AS mean_rr, round(stddev_pop(rr_ms) / avg(rr_ms), 6) AS cv FROM (SELECT *, unnest(range(greatest(0, (i - 199 + 29) // 30), i // 30 + 1)) AS win FROM n) WHERE win * 30 <= n - 200 GROUP BY 1, 2"))
def w27(spark, d):
    return RR.beat_windows(beats(spark, d)).select("activity_id", "win", F.round("mean_rr", 6).alias("mean_rr"), F.round("cv", 6).alias("cv"))


#: Detrended fluctuations by the same definition: boxes as groups, regression sums, slopes over the logarithms of sizes.
ALPHA = f"""{RRV}, ok AS (SELECT activity_id, beat, rr_ms FROM (SELECT *, lag(rr_ms) OVER (PARTITION BY activity_id ORDER BY beat) AS p FROM rr WHERE rr_ms BETWEEN 273 AND 2000) WHERE {{of}} AND (p IS NULL OR abs(rr_ms - p) / p <= 0.20)),
nb AS (SELECT *, row_number() OVER (PARTITION BY activity_id ORDER BY beat) - 1 AS i, count(*) OVER (PARTITION BY activity_id) AS n FROM ok),
dw AS (SELECT * FROM (SELECT *, unnest(range(greatest(0, (i - 199 + 29) // 30), i // 30 + 1)) AS win FROM nb) WHERE win * 30 <= n - 200),
mw AS (SELECT *, avg(rr_ms) OVER (PARTITION BY activity_id, win) AS mean, stddev_pop(rr_ms) OVER (PARTITION BY activity_id, win) AS sd FROM dw),
wk AS (SELECT activity_id, win, mean, i - win * 30 AS pos, sum(rr_ms - mean) OVER (PARTITION BY activity_id, win ORDER BY i ROWS UNBOUNDED PRECEDING) AS y FROM mw WHERE sd / mean <= 0.25),
bx AS (SELECT activity_id, win, mean, s, pos // s AS box, pos % s - (s - 1) / 2.0::DOUBLE AS x, y, avg(y) OVER (PARTITION BY activity_id, win, s, pos // s) AS m FROM wk, (SELECT unnest(range(4, 17)) AS s) WHERE pos < (200 // s) * s),
rs AS (SELECT activity_id, win, mean, s, sum(pow(y - m, 2)) - pow(sum((y - m) * x), 2) / (s * (s * s - 1) / 12.0::DOUBLE) AS rest FROM bx GROUP BY activity_id, win, mean, s, box),
fl AS (SELECT activity_id, win, mean, ln(s) AS x, ln(sum(rest) / ((200 // s) * s)) / 2 AS y FROM rs GROUP BY activity_id, win, mean, s HAVING sum(rest) > 0),
al AS (SELECT activity_id, win, 60000 / mean AS hr, (count(*) * sum(x * y) - sum(x) * sum(y)) / (count(*) * sum(x * x) - sum(x) * sum(x)) AS alpha FROM fl GROUP BY activity_id, win, mean HAVING count(*) > 1),
pa AS (SELECT *, row_number() OVER (PARTITION BY activity_id ORDER BY hr, alpha) - 1 AS i, count(*) OVER (PARTITION BY activity_id) AS n, least(5, greatest(3, count(*) OVER (PARTITION BY activity_id) // 3)) AS size FROM al WHERE alpha > 0 AND alpha < 2),
of_ AS (SELECT *, unnest(range(i - size // 2, i - size // 2 + size)) AS j FROM pa WHERE n >= 10),
sm AS (SELECT o.activity_id, o.i, o.hr, avg(p.alpha) AS alpha FROM of_ o JOIN pa p ON p.activity_id = o.activity_id AND p.i = CASE WHEN j < 0 THEN -1 - j WHEN j >= o.n THEN 2 * o.n - 1 - j ELSE j END GROUP BY ALL),
nx AS (SELECT *, lead(alpha) OVER (PARTITION BY activity_id ORDER BY i) AS a2, lead(hr) OVER (PARTITION BY activity_id ORDER BY i) AS h2 FROM sm),
cr AS (SELECT activity_id, """ + ", ".join(f"arg_min(hr + (h2 - hr) * (alpha - {x}) / (alpha - a2), i) FILTER (alpha >= {x} AND a2 < {x}) AS {n}" for n, x in (("aet", "0.75::DOUBLE"), ("ant", "0.5::DOUBLE"))) + """ FROM nx GROUP BY 1),
th AS (SELECT activity_id, windows, aet_hr, CASE WHEN ant >= 100 AND (aet_hr IS NULL OR ant > aet_hr) THEN ant END AS ant_hr FROM (SELECT k.activity_id, coalesce(windows, 0) AS windows, CASE WHEN aet BETWEEN 100 AND 0.8::DOUBLE * {most} THEN aet END AS aet_hr, ant
  FROM (SELECT DISTINCT activity_id FROM ok) k LEFT JOIN (SELECT activity_id, count(*) AS windows FROM pa GROUP BY 1) USING (activity_id) LEFT JOIN cr USING (activity_id)))"""
_alpha = lambda of="true": ALPHA.replace("{of}", of).replace("{most}", str(DEFAULT.max_hr))


@query("w27_w28_alpha_windows", sql(f"{_alpha()} SELECT activity_id, win, round(hr, 6) AS hr, round(alpha, 6) AS alpha FROM al WHERE alpha > 0 AND alpha < 2"))
def w28_windows(spark, d):
    return RR.alpha_windows(beats(spark, d)).select("activity_id", "win", F.round("hr", 6).alias("hr"), F.round("alpha", 6).alias("alpha"))


@query("w28_smoothed_alpha", sql(f"{_alpha()} SELECT activity_id, i AS place, round(hr, 6) AS hr, round(alpha, 6) AS alpha FROM sm"))
def w28(spark, d):
    curves = RR.alpha_curves(beats(spark, d)).filter("windows >= 10")
    rows = curves.select("activity_id", F.posexplode(F.arrays_zip("hr", "alpha")).alias("place", "x"))
    return rows.select("activity_id", F.col("place").cast("long").alias("place"), F.round("x.hr", 6).alias("hr"), F.round("x.alpha", 6).alias("alpha"))


@query("w29_first_crossings", sql(f"{_alpha()} SELECT activity_id, round(aet, 5) AS aet, round(ant, 5) AS ant FROM cr"))
def w29(spark, d):
    """Where alpha first falls through both limits, whether or not these heart rates are plausible."""
    curves = RR.alpha_curves(beats(spark, d)).filter("windows >= 10")
    at = lambda limit: F.round(RR.first_crossing(F.col("hr"), F.col("alpha"), limit), 5)
    return curves.select("activity_id", at(0.75).alias("aet"), at(0.50).alias("ant"))


@query("d22_dfa_thresholds", sql(f"{_alpha()} SELECT activity_id, round(aet_hr, 5) AS aet_hr, round(ant_hr, 5) AS ant_hr, windows, CASE WHEN aet_hr IS NULL THEN 'none' ELSE 'real' END AS quality FROM th"))
def d22(spark, d):
    return RR.dfa_thresholds(beats(spark, d)).withColumns({c: F.round(c, 5) for c in ("aet_hr", "ant_hr")})


@query("d22_thresholds_with_fall_back", sql(f"{PROXY}, {_alpha('activity_id % 3 > 0')} SELECT activity_id, round(coalesce(aet_hr, threshold_hr), 5) AS aet_hr, round(ant_hr, 5) AS ant_hr, CASE WHEN aet_hr IS NOT NULL THEN 'real' WHEN threshold_hr IS NOT NULL THEN 'proxy' ELSE 'none' END AS dfa_quality FROM th FULL JOIN px USING (activity_id)"))
def d22_all(spark, d):
    """Every third activity has no beats."""
    out = RR.aerobic_thresholds(beats(spark, d).filter("activity_id % 3 > 0"), A.with_zones(recs(spark, d)))
    return out.withColumns({c: F.round(c, 5) for c in ("aet_hr", "ant_hr")})


@query("f_arr1_flattened_beats", sql("m AS (SELECT activity_id, idx // 10 AS message, idx, CASE WHEN idx % 7 = 0 THEN NULL WHEN idx % 11 = 0 THEN 0 ELSE 60 / hr END AS s FROM records WHERE hr > 0 AND idx // 10 % 9 > 0) SELECT activity_id, row_number() OVER (PARTITION BY activity_id ORDER BY idx) AS beat, round(s * 1000, 5) AS rr_ms FROM m WHERE s > 0"))
def f_arr1(spark, d):
    """Messages of up to ten intervals, some missing or 0, and messages without any."""
    seconds = F.when(F.col("idx") % 7 == 0, None).when(F.col("idx") % 11 == 0, 0.0).otherwise(60 / F.col("hr"))
    message = F.floor(F.col("idx") / 10)
    held = recs(spark, d).filter("hr > 0").groupBy("activity_id", message.alias("message")).agg(F.array_sort(F.collect_list(F.struct("idx", seconds.alias("s")))).alias("x"))
    held = held.select("activity_id", "message", F.when(F.col("message") % 9 > 0, F.transform("x", lambda e: e["s"])).alias("times"))
    return RR.flattened_beats(held).withColumn("rr_ms", F.round("rr_ms", 5))


#: The spline's equations (e0), reduced six times (e6), its values at 4 Hz, and sums of sine and cosine at the bins of the band.
BREATH = """tt AS (SELECT activity_id, rr_ms / 1000 AS y, round(sum(rr_ms) OVER (PARTITION BY activity_id ORDER BY beat ROWS UNBOUNDED PRECEDING), 6) AS ms FROM ok),
tn AS (SELECT activity_id, y, ms, ms / 1000 AS t, min(ms) OVER p AS f, CAST(ceil((max(ms) OVER p - min(ms) OVER p) / 250) AS BIGINT) AS points FROM tt WINDOW p AS (PARTITION BY activity_id) QUALIFY count(*) OVER p >= 120),
hh AS (SELECT *, t - lag(t) OVER w AS h0, lead(t) OVER w - t AS h1, y - lag(y) OVER w AS y0, lead(y) OVER w - y AS y1 FROM tn WINDOW w AS (PARTITION BY activity_id ORDER BY t)),
e0 AS (SELECT activity_id, f, points, ms, t, y, coalesce(h0 / (2 * (h0 + h1)), 0) AS a, coalesce(h1 / (2 * (h0 + h1)), 0) AS c, coalesce(3 * (y1 / h1 - y0 / h0) / (h0 + h1), 0) AS m FROM hh),
""" + "".join(
    f"""n{i} AS (SELECT *, {", ".join(f"{at}({x}, {2**i}, 0.0::DOUBLE) OVER w AS {x}{k}" for x in "acm" for k, at in enumerate(("lag", "lead")))} FROM e{i} WINDOW w AS (PARTITION BY activity_id ORDER BY t)),
e{i + 1} AS (SELECT activity_id, f, points, ms, t, y, -a * a0 / (1 - a * c0 - c * a1) AS a, -c * c1 / (1 - a * c0 - c * a1) AS c, (m - a * m0 - c * m1) / (1 - a * c0 - c * a1) AS m FROM n{i}),
""" for i in range(6)) + """iv AS (SELECT *, lead(ms) OVER w AS ms1, lead(t) OVER w - t AS h, lead(y) OVER w AS y1, lead(m) OVER w AS m1 FROM e6 WINDOW w AS (PARTITION BY activity_id ORDER BY t)),
gr AS (SELECT *, unnest(range(CAST(ceil((ms - f) / 250) AS BIGINT), CAST(ceil((ms1 - f) / 250) AS BIGINT))) AS k FROM iv WHERE ms1 IS NOT NULL),
uv AS (SELECT *, (ms1 - f) / 1000 - k / 4 AS u, k / 4 - (ms - f) / 1000 AS v FROM gr),
sp AS (SELECT activity_id, points, k, least(256, points // 2) AS size, (m * pow(u, 3) + m1 * pow(v, 3)) / (6 * h) + (y / h - m * h / 6) * u + (y1 / h - m1 * h / 6) * v AS x FROM uv WHERE points >= 64),
wn AS (SELECT activity_id, size, s, k - s * (size // 2) AS i, x FROM sp, LATERAL (SELECT unnest(range(0, (points - size) // (size // 2) + 1)) AS s) WHERE k >= s * (size // 2) AND k < s * (size // 2) + size),
wm AS (SELECT *, (x - avg(x) OVER (PARTITION BY activity_id, s)) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / size)) AS z FROM wn),
bn AS (SELECT *, unnest(range((3 * size + 79) // 80, size // 8 + 1)) AS j FROM wm),
pw AS (SELECT activity_id, size, j, pow(sum(z * cos(2 * pi() * i * j / size)), 2) + pow(sum(z * sin(2 * pi() * i * j / size)), 2) AS p FROM bn GROUP BY activity_id, size, s, j),
br AS (SELECT activity_id, arg_max(j, p) * 240.0::DOUBLE / size AS rate FROM (SELECT activity_id, size, j, avg(p) AS p FROM pw GROUP BY ALL) GROUP BY activity_id, size)"""


@query("d23_respiration_rate", sql(f"{_alpha().partition(chr(10))[0]} {BREATH} SELECT activity_id, round(rate, 6) AS respiration_rate FROM (SELECT DISTINCT activity_id FROM ok) LEFT JOIN br USING (activity_id)"))
def d23(spark, d):
    return RR.respiration_rate(beats(spark, d)).withColumn("respiration_rate", F.round("respiration_rate", 6))


# --- pauses, summaries, marts -----------------------------------------------------------------------------------------------

#: Timer events of an activity: stops (some in a row), starts, and others, at the times of its records.
TIMER = {0: ("timer", "stop"), 4: ("TIMER", "Stop_Disable"), 9: ("timer", "start"), 13: ("lap", "stop"), 20: ("timer", "start_data"), 31: ("timer", "stop_disable_all"), 32: ("timer", "marker"), 40: ("timer", "start")}
_WHICH = "CASE idx % 50 " + " ".join(f"WHEN {k} THEN '{{}}'".format(v) for k, v in ((k, "|".join(v)) for k, v in TIMER.items())) + " END"
PAUSES = f"""ev AS (SELECT activity_id, t, lower(split_part(x, '|', 1)) AS event, lower(split_part(x, '|', 2)) AS kind FROM (SELECT activity_id, t, {_WHICH} AS x FROM records) WHERE x IS NOT NULL),
tm AS (SELECT activity_id, t, CASE WHEN kind IN ('stop', 'stop_disable', 'stop_disable_all') THEN 0 ELSE 1 END AS k FROM ev WHERE event = 'timer' AND kind IN ('stop', 'stop_disable', 'stop_disable_all', 'start', 'start_data')),
pz AS (SELECT activity_id, a AS start_t, t AS end_t FROM (SELECT *, lag(k) OVER w AS b, lag(t) OVER w AS a FROM tm WINDOW w AS (PARTITION BY activity_id ORDER BY t, k)) WHERE k = 1 AND b = 0)"""


def timer_events(spark, d):
    which = F.expr(_WHICH)
    e = recs(spark, d).select("activity_id", "t", F.split(which, "[|]").alias("x")).filter("x IS NOT NULL")
    return e.select("activity_id", "t", F.col("x")[0].alias("event"), F.col("x")[1].alias("event_type"))


@query("j07_timer_pauses", sql(f"{PAUSES} SELECT * FROM pz"))
def j07_timer(spark, d):
    return A.pauses(timer_events(spark, d))


@query("p05_records_in_pause", sql(f"{PAUSES} SELECT activity_id, idx, EXISTS (SELECT 1 FROM pz WHERE pz.activity_id = r.activity_id AND r.t BETWEEN start_t AND end_t) AS in_pause FROM records r"))
def p05(spark, d):
    return A.with_pauses(recs(spark, d), A.pauses(timer_events(spark, d))).select("activity_id", "idx", "in_pause")


SUMMARY = f"""{PAUSES}, {FILL.replace("AS is_active FROM zoned", "AS moves FROM zoned").replace("active AS (SELECT *", "active0 AS (SELECT *")
  .replace("FROM active))", "FROM active))").replace("rec2 AS (", "act1 AS (SELECT a.*, EXISTS (SELECT 1 FROM pz WHERE pz.activity_id = a.activity_id AND a.t BETWEEN start_t AND end_t) AS in_pause FROM active0 a), active AS (SELECT *, moves AND NOT in_pause AS is_active FROM act1), rec2 AS (")},
se AS (SELECT s_suppkey AS activity_id, CASE s_suppkey % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'cycling' ELSE 'rowing' END AS sport, CASE WHEN s_suppkey % 8 > 0 THEN (s_suppkey * 2311 % 90000)::DOUBLE END AS distance_m, (s_suppkey * 7 % 19)::DOUBLE AS avg_speed,
  CASE WHEN s_suppkey % 4 = 0 THEN 2.5::DOUBLE END AS te_aerobic, CASE WHEN s_suppkey % 5 = 0 THEN 1.5::DOUBLE END AS te_anaerobic FROM supplier WHERE s_suppkey % 10 > 0),
sm AS (SELECT *, quantile_cont(speed, 0.5) OVER (PARTITION BY activity_id, coalesce(speed > 0, false) ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS smooth, altitude - lag(altitude) OVER ({I}) AS up FROM rec2),
sg AS (SELECT activity_id, count(*) AS records_count, count(*) FILTER (in_pause) AS paused_records, sum(trimp) AS trimp, CAST(round_even(round(avg(h), 9), 0) AS BIGINT) AS avg_hr, CAST(least(max(h), 199) AS BIGINT) AS max_hr,
  coalesce(sum(dt) FILTER (is_active), 0) AS act, coalesce(sum(dt) FILTER (is_active AND zone <> ''), 0) / 60 AS zm, coalesce(sum(dt) FILTER (is_active AND up > 0 AND speed > 0), 0) / 60 AS uphill,
  coalesce(sum(dt) FILTER (is_active AND zone = 'Z4'), 0) / 60 + coalesce(sum(dt) FILTER (is_active AND zone IN ('Z5', 'Z5+')), 0) / 60 AS z45, coalesce(sum(dt) FILTER (is_active AND zone = 'Z4+'), 0) / 60 AS none,
  round_even(round(quantile_cont(smooth, 0.99) FILTER (speed > 0) * 3.6::DOUBLE, 9), 2) AS max_kmh FROM sm GROUP BY 1),
su AS (SELECT sg.*, sport, round_even(round(distance_m / 1000, 9), 3) AS km, round_even(round(avg_speed * 3.6::DOUBLE, 9), 2) AS avg_kmh, te_aerobic AS ta, te_anaerobic AS tn,
  CASE WHEN act > 0 THEN act / 60 WHEN zm > 0 THEN zm ELSE records_count / 60 END AS minutes, CASE sport WHEN 'cycling' THEN 100 WHEN 'running' THEN 35 ELSE 45 END AS c0, CASE sport WHEN 'cycling' THEN 60 WHEN 'running' THEN 30 ELSE 40 END AS c1 FROM sg LEFT JOIN se USING (activity_id))
SELECT activity_id, records_count, paused_records, round(trimp, 5) AS total_trimp, avg_hr, max_hr, round(minutes, 6) AS duration_minutes, round(uphill, 6) AS uphill_minutes, CASE WHEN max_kmh <= c0 THEN max_kmh END AS max_speed_kmh, CASE WHEN avg_kmh <= c1 THEN avg_kmh END AS avg_speed_kmh,
  CASE WHEN NOT coalesce(avg_kmh > c1, false) AND NOT coalesce(km / (minutes / 60) > c1, false) THEN km END AS distance_km,
  coalesce(ta, CASE WHEN trimp > 0 THEN round_even(round(least(5, 5 * (1 - exp(-trimp / 50))), 9), 1) END) AS te_aerobic, coalesce(tn, CASE WHEN z45 > 0 THEN round_even(round(least(5, 5 * (1 - exp(-z45 / 20))), 9), 1) END) AS te_anaerobic FROM su"""


@query("d27_summary_from_messages", sql(SUMMARY))
def d27_messages(spark, d):
    from stridelake.sources.tables import table

    k = F.col("s_suppkey")
    sessions = table(spark, d, "supplier").filter("s_suppkey % 10 > 0").select(
        k.alias("activity_id"), F.when(k % 3 == 0, "running").when(k % 3 == 1, "cycling").otherwise("rowing").alias("sport"), F.when(k % 8 > 0, (k * 2311 % 90000).cast("double")).alias("distance_m"),
        (k * 7 % 19).cast("double").alias("avg_speed"), F.when(k % 4 == 0, 2.5).alias("te_aerobic"), F.when(k % 5 == 0, 1.5).alias("te_anaerobic"),
    )
    out = A.activity_summary(recs(spark, d), timer_events(spark, d), sessions)
    rounded = {"total_trimp": 5, "duration_minutes": 6, "uphill_minutes": 6}
    names = ("records_count", "paused_records", "avg_hr", "max_hr", "max_speed_kmh", "avg_speed_kmh", "distance_km", "te_aerobic", "te_anaerobic")
    return out.select("activity_id", *names, *(F.round(c, n).alias(c) for c, n in rounded.items()))


GAPS = """gp AS (SELECT *, CASE WHEN idx % 5 = 0 THEN NULL ELSE t END AS tt, CASE WHEN hr IS NULL OR idx % 37 IN (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11) OR idx <= activity_id % 15 THEN NULL ELSE hr END AS x FROM records),
nb AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN idx END) OVER (PARTITION BY activity_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS p0, min(CASE WHEN x IS NOT NULL THEN idx END) OVER (PARTITION BY activity_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p1,
  max(idx) OVER (PARTITION BY activity_id) AS e FROM gp)"""


@query("w19b_whole_gap_interpolation", sql(f"""{GAPS} SELECT n.activity_id, n.idx, round(CASE WHEN n.x IS NOT NULL THEN n.x WHEN coalesce(b.tt - a.tt <= 15, coalesce(p1, e + 1) - coalesce(p0, 0) - 1 <= 10)
  THEN coalesce(a.x + (b.x - a.x) * (n.idx - p0) / (p1 - p0), a.x, b.x) END, 6) AS hr FROM nb n LEFT JOIN gp a ON a.activity_id = n.activity_id AND a.idx = p0 LEFT JOIN gp b ON b.activity_id = n.activity_id AND b.idx = p1"""))
def w19b(spark, d):
    """Gaps of twelve rows, at edges too, and times that are unknown."""
    hidden = (F.col("idx") % 37 < 12) | (F.col("idx") <= F.col("activity_id") % 15)
    r = recs(spark, d).withColumns({"x": F.when(~hidden, F.col("hr")), "tt": F.when(F.col("idx") % 5 > 0, F.col("t"))})
    return r.select("activity_id", "idx", F.round(R.interpolated_by_time("x", "tt", "idx", ["activity_id"], ["idx"]), 6).alias("hr"))


def _sql_of(name: str) -> str:
    from stridelake.plans.registry import _FOUND

    return _FOUND[name][1]


MART = ["d24_critical_hr", "d09_vam", "d15_fueling", "d16_fluid_loss", "d19_d20_threshold_epoc", "d25_p18_climb_score"]
_ROWS = ["d01_cardiac_drift", "d02_w21_max_hr_drop", "d18_durability", "d21_threshold_proxy"]


@query("d26_activity_mart", "SELECT m.activity_id, critical_hr, tati, vam, fat_g, cardiac_drift, max_hr_drop, durability, threshold_hr AS aet_hr_proxy, sport FROM (SELECT activity_id, sport, duration_minutes >= 20 AND regexp_matches(sport, 'cycl|bik|run|walk|hik|ski') AS ok FROM (" + sql("SELECT * FROM activities") + ")) m" + "".join(f" LEFT JOIN ({_sql_of(n)}) USING (activity_id)" for n in MART[:3]) + "".join(f" LEFT JOIN ({_sql_of(n)}) r{i} ON ok AND r{i}.activity_id = m.activity_id" for i, n in enumerate(_ROWS)))
def d26_mart(spark, d):
    out = A.activity_metrics(acts(spark, d), A.with_zones(recs(spark, d)))
    rounded = {"tati": 6, "vam": 7, "fat_g": 6}
    return out.select("activity_id", "sport", "critical_hr", *(F.round(c, n).alias(c) for c, n in rounded.items()), "cardiac_drift", "max_hr_drop", "durability", "aet_hr_proxy")


#: Every measure's own query, joined: all activities for what their summaries tell, eligible ones (ok) for what records and beats do.
WITH_BEATS = f"""SELECT m.activity_id, m.sport, critical_hr, tati, vam, fat_kcal, carb_kcal, fat_g, fluid_l AS fluid_loss_l, epoc, recovery_h, climb_score, category AS climb_category, cardiac_drift, max_hr_drop, durability, threshold_hr AS aet_hr_proxy,
  coalesce(b.aet_hr, threshold_hr::DOUBLE) AS aet_hr, b.ant_hr, CASE WHEN b.aet_hr IS NOT NULL THEN 'real' WHEN threshold_hr IS NOT NULL THEN 'proxy' WHEN seen OR b.activity_id IS NOT NULL THEN 'none' END AS dfa_quality, respiration_rate
FROM (SELECT activity_id, sport, duration_minutes >= 20 AND regexp_matches(sport, 'cycl|bik|run|walk|hik|ski') AS ok FROM ({sql("SELECT * FROM activities")})) m""" + "".join(f" LEFT JOIN ({_sql_of(n)}) USING (activity_id)" for n in MART) + "".join(
    f" LEFT JOIN ({_sql_of(n)}) {a} ON ok AND {a}.activity_id = m.activity_id" for a, n in [*((f"r{i}", n) for i, n in enumerate(_ROWS)), ("b", "d22_dfa_thresholds"), ("q", "d23_respiration_rate")]
) + f" LEFT JOIN ({sql('SELECT DISTINCT activity_id, true AS seen FROM records')}) k ON ok AND k.activity_id = m.activity_id"


@query("d26_activity_mart_with_beats", WITH_BEATS)
def d26_beats(spark, d):
    out = A.activity_metrics(acts(spark, d), A.with_zones(recs(spark, d)), beats(spark, d))
    rounded = {"tati": 6, "vam": 7, "fat_kcal": 6, "carb_kcal": 6, "fat_g": 6, "fluid_loss_l": 7, "recovery_h": 5, "aet_hr": 5, "ant_hr": 5, "respiration_rate": 6}
    names = ("sport", "critical_hr", "epoc", "climb_score", "climb_category", "cardiac_drift", "max_hr_drop", "durability", "aet_hr_proxy", "dfa_quality")
    return out.select("activity_id", *names, *(F.round(c, n).alias(c) for c, n in rounded.items()))
