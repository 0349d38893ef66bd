"""Queries over the daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridelake.functions import rolling as R
from stridelake.functions.scalars import joined_text
from stridelake.operators import daily as D
from stridelake.plans.registry import query
from stridelake.sources.fixtures import sql, view

KEY, DAY = D.KEY, D.DAY


def rounded(df, *keep, **digits):
    """keep as they are; the others rounded at the query's edge, where the engines' sums may differ in the last bits."""
    return df.select(*keep, *(F.round(n, d).alias(n) for n, d in digits.items()))


LOAD = """sums AS (SELECT athlete_id, date, sum(coalesce(total_trimp, 0) * CASE WHEN sport IN ('hiking', 'walking') THEN 0.6::DOUBLE ELSE 1::DOUBLE END) AS trimp,
  sum(2 * coalesce(z4, 0) + 5 * coalesce(z5, 0)) AS epoc FROM activities GROUP BY 1, 2),
spine AS (SELECT athlete_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM activities GROUP BY 1),
load AS (SELECT athlete_id, date, coalesce(trimp, 0) AS trimp, coalesce(epoc, 0) AS epoc, coalesce(trimp, 0) + 0.1::DOUBLE * coalesce(epoc, 0) AS trimp_epoc
  FROM spine LEFT JOIN sums USING (athlete_id, date))"""
W = "PARTITION BY athlete_id ORDER BY date"
R7, R28, R14, R30 = (f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (7, 28, 14, 30))
ACWR = f"""acwr AS (SELECT *, acute / nullif(chronic, 0) AS acwr FROM (SELECT *, CASE WHEN count(*) {R7} = 7 THEN avg(trimp_epoc) {R7} END AS acute,
  CASE WHEN count(*) {R28} = 28 THEN avg(trimp_epoc) {R28} END AS chronic FROM load))"""
STRAIN = f"""strain AS (SELECT *, mono * s7 AS strain FROM (SELECT *, CASE WHEN n7 = 7 THEN least(4, m7 / (d7 + 1e-5)) END AS mono FROM
  (SELECT *, count(*) {R7} AS n7, avg(trimp) {R7} AS m7, stddev_samp(trimp) {R7} AS d7, sum(trimp) {R7} AS s7 FROM load)))"""
#: The closed form of the recursive average.
_EWMA = "pow(1 - {a}, k) * (sum(CASE WHEN k = 0 THEN trimp ELSE {a} * trimp / pow(1 - {a}, k) END) OVER (" + W + " ROWS UNBOUNDED PRECEDING))"
FITNESS = f"""fitness AS (SELECT *, lag(ctl) OVER ({W}) - atl AS tsb, ctl - lag(ctl, 7) OVER ({W}) AS ctl_ramp FROM
  (SELECT *, {_EWMA.format(a="(1.0::DOUBLE / 42)")} AS ctl, {_EWMA.format(a="(1.0::DOUBLE / 7)")} AS atl FROM (SELECT *, row_number() OVER ({W}) - 1 AS k FROM load)))"""


def loads(spark, d):
    return D.daily_load(view(spark, d, "activities"))


@query("flagship_daily_load", sql(f"{LOAD}, {ACWR}, {STRAIN}, {FITNESS} SELECT athlete_id, date, round(trimp, 4) AS trimp, round(acute, 4) AS acute, round(chronic, 4) AS chronic, round(acwr, 4) AS acwr, round(mono, 4) AS monotony, round(strain, 3) AS strain, round(ctl, 4) AS ctl, round(atl, 4) AS atl, round(tsb, 4) AS tsb FROM acwr JOIN strain s USING (athlete_id, date, trimp) JOIN fitness f USING (athlete_id, date, trimp)"))
def flagship(spark, d):
    days = D.fitness_fatigue(D.monotony_strain(D.acute_chronic(loads(spark, d))))
    return rounded(days, "athlete_id", "date", trimp=4, acute=4, chronic=4, acwr=4, monotony=4, strain=3, ctl=4, atl=4, tsb=4)


@query("a01_daily_load", sql(f"{LOAD} SELECT athlete_id, date, round(trimp, 4) AS trimp, round(epoc, 4) AS epoc, round(trimp_epoc, 4) AS trimp_epoc FROM load"))
def a01(spark, d):
    return rounded(loads(spark, d), "athlete_id", "date", trimp=4, epoc=4, trimp_epoc=4)


@query("j06_calendar_densify", sql("spine AS (SELECT athlete_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM bio GROUP BY 1) SELECT athlete_id, date, hrv, rhr FROM spine LEFT JOIN bio USING (athlete_id, date)"))
def j06(spark, d):
    return D.densify(view(spark, d, "bio").select("athlete_id", "date", "hrv", "rhr"))


@query("j06_densify_until", sql("spine AS (SELECT athlete_id, CAST(unnest(generate_series(min(date), greatest(max(date), DATE '1999-06-30'), INTERVAL 1 DAY)) AS DATE) AS date FROM bio GROUP BY 1) SELECT athlete_id, date, coalesce(hrv, 0) AS hrv, rhr FROM spine LEFT JOIN bio USING (athlete_id, date)"))
def j06_until(spark, d):
    return D.densify(view(spark, d, "bio").select("athlete_id", "date", "hrv", "rhr"), {"hrv": 0.0}, until="1999-06-30")


@query("d13_acwr", sql(f"{LOAD}, {ACWR} SELECT athlete_id, date, round(acute, 4) AS acute, round(chronic, 4) AS chronic, round(acwr, 4) AS acwr, CASE WHEN acwr < 0.8 THEN 'low' WHEN acwr <= 1.3 THEN 'optimal' WHEN acwr <= 1.5 THEN 'caution' WHEN acwr IS NOT NULL THEN 'danger' ELSE '' END AS status FROM acwr"))
def d13(spark, d):
    out = D.acute_chronic(loads(spark, d)).withColumn("status", D.acwr_label(F.col("acwr")))
    return rounded(out, "athlete_id", "date", "status", acute=4, chronic=4, acwr=4)


@query("d03_monotony_strain", sql(f"{LOAD}, {STRAIN} SELECT athlete_id, date, round(mono, 4) AS monotony, round(strain, 3) AS strain, round(21 * (1 - exp(-0.005::DOUBLE * trimp)), 4) AS log_strain FROM strain"))
def d03(spark, d):
    return rounded(D.monotony_strain(loads(spark, d)), "athlete_id", "date", monotony=4, strain=3, log_strain=4)


@query("w04_rolling_week", sql(f"{LOAD} SELECT athlete_id, date, CASE WHEN count(*) {R7} = 7 THEN round(avg(trimp) {R7}, 4) END AS mean7, CASE WHEN count(*) {R7} = 7 THEN round(stddev_samp(trimp) {R7}, 4) END AS std7, CASE WHEN count(*) {R7} = 7 THEN round(sum(trimp) {R7}, 4) END AS sum7 FROM load"))
def w04(spark, d):
    f = {"mean7": R.rolling_mean, "std7": R.rolling_std, "sum7": R.rolling_sum}
    return loads(spark, d).select(*KEY, *DAY, *(F.round(g("trimp", KEY, DAY, 7, 7), 4).alias(n) for n, g in f.items()))


@query("d12_fitness_fatigue", sql(f"{LOAD}, {FITNESS} SELECT athlete_id, date, round(ctl, 4) AS ctl, round(atl, 4) AS atl, round(tsb, 4) AS tsb FROM fitness"))
def d12(spark, d):
    return rounded(D.fitness_fatigue(loads(spark, d)), "athlete_id", "date", ctl=4, atl=4, tsb=4)


@query("w03_ctl_ramp", sql(f"{LOAD}, {FITNESS} SELECT athlete_id, date, round(ctl_ramp, 4) AS ctl_ramp, coalesce(round(ctl_ramp, 6) > 8, false) AS ramp_warning FROM fitness"))
def w03(spark, d):
    return rounded(D.ramp(D.fitness_fatigue(loads(spark, d))), "athlete_id", "date", "ramp_warning", ctl_ramp=4)


@query("w02_previous_day", sql(f"{LOAD} SELECT athlete_id, date, round(lag(trimp) OVER ({W}), 4) AS previous FROM load"))
def w02(spark, d):
    return loads(spark, d).select(*KEY, *DAY, F.round(F.lag("trimp").over(D._days()), 4).alias("previous"))


@query("p19_form_label", sql(f"{LOAD}, {FITNESS} SELECT athlete_id, date, CASE WHEN tsb < -30 THEN 'overreaching' WHEN tsb < -10 THEN 'productive' WHEN tsb <= 5 THEN 'maintaining' WHEN tsb <= 10 THEN 'fresh' WHEN tsb IS NOT NULL THEN 'detraining' ELSE '' END AS form FROM (SELECT * REPLACE (round(tsb, 8) AS tsb) FROM fitness)"))
def p19(spark, d):
    return D.fitness_fatigue(loads(spark, d)).select(*KEY, *DAY, D.form_label(F.round("tsb", 8)).alias("form"))


EFF = f"""pos AS (SELECT athlete_id, date, sum(total_trimp) / sum(distance_km) AS e FROM activities WHERE regexp_matches(sport, 'cycl|biking|ride') AND distance_km > 0 GROUP BY 1, 2),
espine AS (SELECT athlete_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM pos GROUP BY 1),
eff AS (SELECT *, last_value(m14 IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS idx FROM (SELECT athlete_id, date, e, CASE WHEN count(e) {R14} >= 3 THEN avg(e) {R14} END AS m14,
  CASE WHEN count(e) {R7} >= 3 AND avg(e) {R7} > 0 THEN e / avg(e) {R7} END AS fat FROM espine LEFT JOIN pos USING (athlete_id, date)))"""


@query("d04_efficiency_index", sql(f"{EFF} SELECT athlete_id, date, round(e, 4) AS daily_efficiency, round(idx, 4) AS efficiency_index FROM eff"))
def d04(spark, d):
    return rounded(D.efficiency_index(view(spark, d, "activities")), "athlete_id", "date", daily_efficiency=4, efficiency_index=4)


@query("d14_fatigue_index", sql(f"{EFF} SELECT athlete_id, date, round(fat, 3) AS fatigue_index FROM eff"))
def d14(spark, d):
    return rounded(D.fatigue_index(D.efficiency_index(view(spark, d, "activities"))), "athlete_id", "date", fatigue_index=3)


@query("a02_daily_efficiency", sql("SELECT athlete_id, date, round(sum(total_trimp) / sum(distance_km), 4) AS efficiency FROM activities WHERE distance_km > 0 GROUP BY 1, 2"))
def a02(spark, d):
    return view(spark, d, "activities").filter("distance_km > 0").groupBy(*KEY, *DAY).agg(F.round(F.sum("total_trimp") / F.sum("distance_km"), 4).alias("efficiency"))


@query("a03_daily_mean_drop", sql("SELECT athlete_id, date, round(avg(max_hrr), 4) AS mean_drop FROM activities GROUP BY 1, 2"))
def a03(spark, d):
    return view(spark, d, "activities").groupBy(*KEY, *DAY).agg(F.round(F.avg("max_hrr"), 4).alias("mean_drop"))


@query("a04_daily_sums", sql("SELECT athlete_id, date, sum(coalesce(z1, 0)) AS z1_daily, sum(coalesce(z2, 0)) AS z2_daily, sum(coalesce(z3, 0)) AS z3_daily, sum(coalesce(z4, 0)) AS z4_daily, sum(coalesce(z5, 0)) AS z5_daily, sum(coalesce(uphill_minutes, 0)) AS uphill_minutes_daily, coalesce(sum(ascent_m), 0) AS ascent_m_daily FROM activities GROUP BY 1, 2"))
def a04(spark, d):
    columns = ("z1", "z2", "z3", "z4", "z5", "uphill_minutes", "ascent_m")
    return view(spark, d, "activities").groupBy(*KEY, *DAY).agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{c}_daily") for c in columns))


SCALE = "greatest({lo}::DOUBLE, least({hi}::DOUBLE, {x}))"
HRVZ = f"""hz AS (SELECT athlete_id, date, CASE WHEN z IS NOT NULL THEN (greatest(-3, least(3, z)) + 3) / 6 * 100 END AS hrv_score FROM
  (SELECT *, CASE WHEN count(hrv) {R30} >= 7 THEN (hrv - avg(hrv) {R30}) / nullif(stddev_samp(hrv) {R30}, 0) END AS z FROM bio WHERE hrv IS NOT NULL))"""
PARTS = f"""hp AS (SELECT athlete_id, date, w AS hrv_weekly, CASE WHEN w IS NOT NULL THEN (greatest(0.7::DOUBLE, least(1.3::DOUBLE, hrv / w)) - 0.7::DOUBLE) / 0.6::DOUBLE * 100 END AS hrv_part FROM
  (SELECT *, CASE WHEN count(hrv) {R7} >= 3 THEN avg(hrv) {R7} END AS w FROM bio WHERE hrv IS NOT NULL)),
rp AS (SELECT athlete_id, date, CASE WHEN b IS NOT NULL THEN (greatest(-5, least(10, rhr - b)) - 10) / -15 * 100 END AS rhr_part FROM
  (SELECT *, CASE WHEN count(rhr) {R14} >= 5 THEN avg(rhr) {R14} END AS b FROM bio WHERE rhr IS NOT NULL)),
rec AS (SELECT bio.*, hrv_weekly, hrv_part, rhr_part, round_even(round(greatest(0, least(100, 0.4::DOUBLE * coalesce(hrv_part, 50) + 0.3::DOUBLE * coalesce(rhr_part, 50) + 0.3::DOUBLE * coalesce(sleep_score, 50))), 9), 1) AS pure_recovery
  FROM bio LEFT JOIN hp USING (athlete_id, date) LEFT JOIN rp USING (athlete_id, date))"""


@query("w06_hrv_z_score", sql(f"{HRVZ} SELECT athlete_id, date, round(hrv_score, 4) AS hrv_score FROM hz"))
def w06(spark, d):
    return rounded(D.hrv_score(view(spark, d, "bio")), "athlete_id", "date", hrv_score=4)


@query("w07_w08_recovery_parts", sql(f"{PARTS} SELECT athlete_id, date, round(hrv_part, 7) AS hrv_part, round(rhr_part, 7) AS rhr_part, round(hrv_weekly, 4) AS hrv_weekly FROM rec"))
def w07(spark, d):
    return rounded(D.recovery_parts(view(spark, d, "bio")), "athlete_id", "date", hrv_part=7, rhr_part=7, hrv_weekly=4)


@query("d06_pure_recovery", sql(f"{PARTS} SELECT athlete_id, date, pure_recovery FROM rec"))
def d06(spark, d):
    return D.pure_recovery(view(spark, d, "bio")).select(*KEY, *DAY, "pure_recovery")


READY = """ready AS (SELECT f.athlete_id, f.date, round_even(greatest(0, least(100, CASE WHEN sleep_score IS NOT NULL AND hrv IS NOT NULL
    THEN 0.3::DOUBLE * coalesce(hrv_score, 50) + 0.3::DOUBLE * sleep_score + 0.4::DOUBLE * legacy ELSE legacy END)), 1) AS readiness
  FROM (SELECT *, CASE WHEN tsb IS NOT NULL THEN (greatest(-30, least(10, tsb)) + 30) / 40 * 100 END AS legacy FROM fitness) f
  LEFT JOIN bio USING (athlete_id, date) LEFT JOIN hz USING (athlete_id, date))"""


@query("d05_readiness", sql(f"{LOAD}, {FITNESS}, {HRVZ}, {READY} SELECT athlete_id, date, CASE WHEN tsb IS NOT NULL THEN readiness END AS readiness FROM ready JOIN fitness USING (athlete_id, date)"))
def d05(spark, d):
    return D.readiness(D.fitness_fatigue(loads(spark, d)), view(spark, d, "bio")).select(*KEY, *DAY, "readiness")


@query("d07_sleep_need", sql(f"{LOAD} SELECT athlete_id, date, round(need, 4) AS sleep_need, round(sleep_minutes / need * 100, 4) AS sleep_performance, round(CASE WHEN count(hrv) {R7} >= 3 THEN stddev_samp(hrv) {R7} / avg(hrv) {R7} * 100 END, 4) AS hrv_cv FROM (SELECT l.athlete_id, l.date, hrv, sleep_minutes, least(780, 450 + 0.5::DOUBLE * coalesce(lag(trimp) OVER (PARTITION BY l.athlete_id ORDER BY l.date), 0)) AS need FROM load l LEFT JOIN bio b ON l.athlete_id = b.athlete_id AND l.date = b.date)"))
def d07(spark, d):
    return rounded(D.sleep_need(loads(spark, d), view(spark, d, "bio")), "athlete_id", "date", sleep_need=4, sleep_performance=4, hrv_cv=4)


POLAR = f"""psum AS (SELECT athlete_id, date, sum(z1 + z2) AS low, sum(z3) AS mid, sum(z4 + z5) AS high FROM activities GROUP BY 1, 2),
pd AS (SELECT athlete_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM psum GROUP BY 1),
pr AS (SELECT athlete_id, date, CASE WHEN n >= 3 THEN round_even(l / nullif(l + m + h, 0) * 100, 1) END AS low_pct, CASE WHEN n >= 3 THEN round_even(m / nullif(l + m + h, 0) * 100, 1) END AS mid_pct, CASE WHEN n >= 3 THEN round_even(h / nullif(l + m + h, 0) * 100, 1) END AS high_pct
  FROM (SELECT athlete_id, date, count(*) {R14} AS n, sum(coalesce(low, 0)) {R14} AS l, sum(coalesce(mid, 0)) {R14} AS m, sum(coalesce(high, 0)) {R14} AS h FROM pd LEFT JOIN psum USING (athlete_id, date)))"""


@query("d08_polarisation", sql(f"{POLAR} SELECT athlete_id, date, low_pct, mid_pct, high_pct, CASE WHEN low_pct IS NOT NULL THEN round(greatest(0, least(100, low_pct + high_pct - greatest(0, mid_pct - 5))), 4) END AS mix_efficiency FROM pr"))
def d08(spark, d):
    return rounded(D.polarisation(view(spark, d, "activities")), "athlete_id", "date", "low_pct", "mid_pct", "high_pct", mix_efficiency=4)


@query("p22_status_labels", sql(f"""{LOAD}, {ACWR}, {POLAR}, cv AS (SELECT athlete_id, date, round(CASE WHEN count(hrv) {R7} >= 3 THEN stddev_samp(hrv) {R7} / avg(hrv) {R7} * 100 END, 6) AS v
  FROM load LEFT JOIN bio USING (athlete_id, date)), mix AS (SELECT athlete_id, date, CASE WHEN low_pct IS NOT NULL THEN round(greatest(0, least(100, low_pct + high_pct - greatest(0, mid_pct - 5))), 4) END AS m FROM pr)
SELECT athlete_id, date, CASE WHEN round(acwr, 6) < 0.8 THEN 'low' WHEN round(acwr, 6) <= 1.3 THEN 'optimal' WHEN round(acwr, 6) <= 1.5 THEN 'caution' WHEN acwr IS NOT NULL THEN 'danger' ELSE '' END AS load_status,
  CASE WHEN v < 10 THEN 'stable' WHEN v < 15 THEN 'raised' WHEN v IS NOT NULL THEN 'high stress' ELSE '' END AS hrv_status,
  CASE WHEN m >= 80 THEN 'high' WHEN m >= 60 THEN 'reduced' WHEN m IS NOT NULL THEN 'low' ELSE '' END AS mix_status
FROM acwr LEFT JOIN cv USING (athlete_id, date) LEFT JOIN mix USING (athlete_id, date)"""))
def p22(spark, d):
    load = loads(spark, d)
    cv = D.sleep_need(load, view(spark, d, "bio")).select(*KEY, *DAY, F.round("hrv_cv", 6).alias("v"))
    mix = D.polarisation(view(spark, d, "activities")).select(*KEY, *DAY, F.round("mix_efficiency", 4).alias("m"))
    days = D.acute_chronic(load).join(cv, [*KEY, *DAY], "left").join(mix, [*KEY, *DAY], "left")
    return days.select(*KEY, *DAY, D.acwr_label(F.round("acwr", 6)).alias("load_status"), D.hrv_cv_label(F.col("v")).alias("hrv_status"), D.mix_label(F.col("m")).alias("mix_status"))


ILL = f"""dayz AS (SELECT s.athlete_id, s.date, round(strain, 6) AS strain, r.hrv, hrv_weekly, rhr, sleep_score, sleep_minutes, pure_recovery, tsb, acwr, ctl_ramp, trimp FROM strain s
  LEFT JOIN rec r USING (athlete_id, date) JOIN (SELECT athlete_id, date, tsb, ctl_ramp FROM fitness) USING (athlete_id, date) JOIN (SELECT athlete_id, date, acwr FROM acwr) USING (athlete_id, date)),
ill AS (SELECT *, f1::BIGINT + f2::BIGINT + f3::BIGINT + f4::BIGINT AS illness_count FROM (SELECT *, coalesce(hrv < hrv_weekly * 0.9::DOUBLE, false) AS f1, coalesce(rhr > 46, false) AS f2,
  coalesce(sleep_score < 60, false) OR coalesce(sleep_minutes < 360, false) AS f3,
  coalesce(CASE WHEN count(strain) {R30} >= 10 THEN strain > quantile_cont(strain, 0.75) {R30} END AND pure_recovery < 50, false) AS f4 FROM dayz))"""


@query("d10_illness_warning", sql(f"{LOAD}, {ACWR}, {STRAIN}, {FITNESS}, {PARTS}, {ILL} SELECT athlete_id, date, illness_count, illness_count >= 3 AS illness_warning, concat_ws(' | ', CASE WHEN f1 THEN 'low HRV' END, CASE WHEN f2 THEN 'high resting rate' END, CASE WHEN f3 THEN 'poor sleep' END, CASE WHEN f4 THEN 'strain without recovery' END) AS illness_text FROM ill"))
def d10(spark, d):
    days = D.monotony_strain(loads(spark, d)).withColumn("strain", F.round("strain", 6)).join(D.pure_recovery(view(spark, d, "bio")), [*KEY, *DAY], "left")
    return D.illness_flags(days).select(*KEY, *DAY, "illness_count", "illness_warning", "illness_text")


@query("w11_strain_quantile", sql(f"{LOAD}, {STRAIN} SELECT athlete_id, date, round(CASE WHEN count(strain) {R30} >= 10 THEN quantile_cont(strain, 0.75) {R30} END, 3) AS q75 FROM strain"))
def w11(spark, d):
    return D.monotony_strain(loads(spark, d)).select(*KEY, *DAY, F.round(R.rolling_quantile("strain", 0.75, KEY, DAY, 30, 10), 3).alias("q75"))


@query("d11_coach_advice", sql(f"{LOAD}, {ACWR}, {STRAIN}, {FITNESS}, {PARTS}, {ILL}" + """, m AS (SELECT *, CASE WHEN strain > 800 THEN 'very high strain' WHEN strain > 400 THEN 'high strain' END AS m1,
  CASE WHEN sleep_score < 60 THEN 'poor sleep' END AS m2, CASE WHEN sleep_minutes < 360 THEN 'short sleep' END AS m3, CASE WHEN hrv < hrv_weekly * 0.9::DOUBLE THEN 'HRV below week' END AS m4,
  CASE WHEN rhr > 46 THEN 'resting rate up' END AS m5, CASE WHEN illness_count >= 3 THEN 'illness risk: rest' END AS i, round(acwr, 8) AS a, round(tsb, 8) AS b, round(ctl_ramp, 8) AS r FROM ill)
SELECT athlete_id, date, concat_ws(' | ', CASE WHEN a > 1.5 THEN 'injury risk: cut load' END, i, m1, m2, m3, m4, m5,
  CASE WHEN pure_recovery < 40 THEN 'recover' WHEN coalesce(i, m1, m2, m3, m4, m5) IS NULL AND pure_recovery >= 80 THEN 'ready for hard work' WHEN coalesce(i, m1, m2, m3, m4, m5) IS NULL AND pure_recovery >= 60 THEN 'ready for steady work' END,
  CASE WHEN b < -30 THEN 'deep fatigue' WHEN b > 10 THEN 'fresh: add load' END, CASE WHEN a > 1.3 AND a <= 1.5 THEN 'load rising fast' END, CASE WHEN r > 8 THEN 'ramp too steep' END) AS advice FROM m"""))
def d11(spark, d):
    days = D.ramp(D.fitness_fatigue(D.monotony_strain(D.acute_chronic(loads(spark, d)))))
    days = days.withColumns({c: F.round(c, n) for c, n in (("strain", 6), ("acwr", 8), ("tsb", 8), ("ctl_ramp", 8))})
    days = days.join(D.pure_recovery(view(spark, d, "bio")), [*KEY, *DAY], "left")
    return D.coach_advice(D.illness_flags(days)).select(*KEY, *DAY, "advice")


@query("d26_daily_mart", sql(f"{LOAD}, {ACWR}, {STRAIN}, {FITNESS}, {HRVZ}, {PARTS}, {READY} SELECT s.athlete_id, s.date, round(s.trimp, 4) AS trimp, round(acwr, 4) AS acwr, round(ctl, 4) AS ctl, round(strain, 3) AS strain, CASE WHEN tsb IS NOT NULL THEN readiness END AS readiness, pure_recovery FROM strain s JOIN acwr a ON a.athlete_id = s.athlete_id AND a.date = s.date JOIN fitness f ON f.athlete_id = s.athlete_id AND f.date = s.date LEFT JOIN ready r ON r.athlete_id = s.athlete_id AND r.date = s.date LEFT JOIN rec ON rec.athlete_id = s.athlete_id AND rec.date = s.date"))
def d26(spark, d):
    return rounded(D.daily_mart(view(spark, d, "activities"), view(spark, d, "bio")), "athlete_id", "date", "readiness", "pure_recovery", trimp=4, acwr=4, ctl=4, strain=3)


@query("t04_latest_values", sql("SELECT athlete_id, arg_max(hrv, date) FILTER (hrv IS NOT NULL) AS last_hrv, arg_max(sleep_score, date) FILTER (sleep_score IS NOT NULL) AS last_sleep, max(date) AS last_date FROM bio GROUP BY 1"))
def t04(spark, d):
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date")))
    return view(spark, d, "bio").groupBy(*KEY).agg(last("hrv").alias("last_hrv"), last("sleep_score").alias("last_sleep"), F.max("date").alias("last_date"))


@query("t02_top_strain_days", sql(f"{LOAD}, {STRAIN} SELECT athlete_id, date, place, round(strain, 3) AS strain FROM (SELECT athlete_id, date, strain, row_number() OVER (PARTITION BY athlete_id ORDER BY round(strain, 6) DESC, date) AS place FROM strain WHERE strain IS NOT NULL) WHERE place <= 3"))
def t02(spark, d):
    from pyspark.sql import Window

    ranked = D.monotony_strain(loads(spark, d)).filter("strain IS NOT NULL").withColumn("place", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.round("strain", 6).desc(), "date")))
    return rounded(ranked.filter("place <= 3"), "athlete_id", "date", "place", strain=3)


@query("d47_quality_report", sql(f"{LOAD}, {ACWR}, {STRAIN}, {FITNESS} SELECT count(*) AS days, round(min(trimp), 4) AS min_trimp, round(max(trimp), 4) AS max_trimp, round(avg(trimp), 4) AS mean_trimp, round(min(tsb), 4) AS min_tsb, round(max(tsb), 4) AS max_tsb, count(acwr) AS acwr_days, count(*) FILTER (acwr > 1.5) AS danger_days, round(max(strain), 3) AS max_strain FROM fitness f JOIN (SELECT athlete_id, date, acwr FROM acwr) USING (athlete_id, date) JOIN (SELECT athlete_id, date, strain FROM strain) USING (athlete_id, date)"))
def d47(spark, d):
    days = D.fitness_fatigue(D.monotony_strain(D.acute_chronic(loads(spark, d))))
    r = lambda x, n, name: F.round(x, n).alias(name)
    return days.agg(F.count("*").alias("days"), r(F.min("trimp"), 4, "min_trimp"), r(F.max("trimp"), 4, "max_trimp"), r(F.avg("trimp"), 4, "mean_trimp"), r(F.min("tsb"), 4, "min_tsb"), r(F.max("tsb"), 4, "max_tsb"), F.count("acwr").alias("acwr_days"), F.count_if(F.col("acwr") > 1.5).alias("danger_days"), r(F.max("strain"), 3, "max_strain"))


@query("f_str10_joined_flags", sql("SELECT athlete_id, date, concat_ws(' | ', CASE WHEN rhr > 46 THEN 'rhr' END, CASE WHEN sleep_score < 60 THEN 'sleep' END, CASE WHEN hrv < 45 THEN 'hrv' END) AS flags FROM bio"))
def f_str10(spark, d):
    flags = joined_text(F.when(F.col("rhr") > 46, "rhr"), F.when(F.col("sleep_score") < 60, "sleep"), F.when(F.col("hrv") < 45, "hrv"))
    return view(spark, d, "bio").select(*KEY, *DAY, flags.alias("flags"))
