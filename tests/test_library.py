"""Operators outside llm on hand-worked rows."""

from __future__ import annotations

import datetime as dt
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridelake.functions import rolling as R
from stridelake.functions import scalars as S
from stridelake.operators import activity as A
from stridelake.operators import daily as D
from stridelake.operators import geo as G
from stridelake.operators import ingest as I
from stridelake.operators import rr as RR
from stridelake.operators import stops as ST
from stridelake.sources import tables as T

DAY = dt.date(2024, 1, 1)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("hr, zone", [(None, ""), (99, "Z1"), (100, "Z1"), (136, "Z1"), (137, "Z2"), (183, "Z4"), (199, "Z5"), (200, "Z5+")])
def test_zones(spark, hr, zone):
    assert one(spark, S.hr_zone(F.lit(hr).cast("int"))) == zone


@pytest.mark.parametrize("text, value", [('"1 980"', 1980.0), ("22,44-66,01", 44.225), ("97-98", 97.5), ("-", None), ("-3,5", -3.5), ("x", None), (None, None)])
def test_eu_numbers(spark, text, value):
    assert one(spark, S.eu_number(F.lit(text).cast("string"))) == (pytest.approx(value) if value is not None else None)


@pytest.mark.parametrize("text, value", [("7h 20m", 440), ("0h 0m", None), ("45m", 45), ("8h", 480), ("", None)])
def test_sleep(spark, text, value):
    assert one(spark, S.sleep_minutes(F.lit(text))) == value


@pytest.mark.parametrize("text, value", [("31.12.2024", dt.date(2024, 12, 31)), ("1.2.2024 10:00", dt.date(2024, 2, 1)), ("2024-05-06T01:02", dt.date(2024, 5, 6)), ("31.02.2024", None), ("soon", None)])
def test_dates(spark, text, value):
    assert one(spark, S.day_first_date(F.lit(text))) == value


def test_scalars(spark):
    assert one(spark, S.trimp_increment(F.lit(41), F.lit(60))) == 0
    assert one(spark, S.trimp_increment(F.lit(None).cast("int"), F.lit(60))) == 0
    assert one(spark, S.trimp_increment(F.lit(199), F.lit(60))) == pytest.approx(0.64 * math.exp(1.92))
    assert one(spark, S.sanitised(F.lit("Žďár nad Sázavou!"))) == "Zdar_nad_Sazavou"
    assert one(spark, S.sanitised(F.lit("--"))) == "Unknown"
    assert one(spark, S.activity_id_of(F.lit("/x/12_ACTIVITY.fit"))) == "12"
    assert one(spark, S.haversine_m(F.lit(50.0), F.lit(14.0), F.lit(51.0), F.lit(14.0))) == pytest.approx(6371000 * math.pi / 180)
    assert one(spark, S.step_score(F.lit(5.0), [(5, 15), (10, 35)], 100, strict=True)) == 35
    assert one(spark, S.step_score(F.lit(5.0), [(5, 15), (10, 35)], 100)) == 15
    assert one(spark, S.first_address_part(F.lit("12, North District, Oldtown, Land"))) == "Oldtown"


def series(spark, values, start=DAY):
    return spark.createDataFrame([(1, start + dt.timedelta(days=i), v) for i, v in enumerate(values)], "athlete_id long, date date, v double")


def test_rolling_counts_values(spark):
    rows = series(spark, [1.0, None, 3.0, None, None, 6.0]).select("date", R.rolling_mean("v", ["athlete_id"], ["date"], 3, 2).alias("m")).orderBy("date").collect()
    assert [r.m for r in rows] == [None, None, 2.0, None, None, None]


def test_ewma_is_recursive(spark):
    rng = np.random.default_rng(0)
    x = rng.random(200)
    got = [r.a for r in R.ewma(series(spark, x.tolist()), "athlete_id", "date", "v", {"a": 7}).orderBy("date").collect()]
    y, want = x[0], []
    for v in x:
        y = y + (v - y) / 7
        want.append(y)
    assert np.allclose(got, want)


def test_merge_equals_fold(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(g), int(a), int(a + w)) for g, a, w in zip(rng.integers(0, 5, 300), rng.integers(0, 800, 300), rng.integers(0, 9, 300), strict=True)]
    got = {tuple(r) for r in R.merged_intervals(spark.createDataFrame(pairs, "g long, a long, b long"), ["g"], "a", "b", 2).collect()}
    want = set()
    for g in range(5):
        cur = None
        for _, a, b in sorted(p for p in pairs if p[0] == g):
            if cur and a - cur[1] <= 2:
                cur[1] = max(cur[1], b)
            else:
                if cur:
                    want.add((g, *cur))
                cur = [a, b]
        if cur:
            want.add((g, *cur))
    assert got == want


def test_interpolation_limits(spark):
    values = [None, 1.0, *[None] * 4, 6.0, None, None, None]
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k long, i long, v double")
    got = [r.x for r in rows.select("i", R.interpolated("v", "i", ["k"], ["i"], 2).alias("x")).orderBy("i").collect()]
    assert got == [None, 1.0, 2.0, 3.0, None, None, 6.0, 6.0, 6.0, None]


def test_daily_load_and_acwr(spark):
    acts = spark.createDataFrame([(1, DAY, "hiking", 10.0, None, 1.0), (1, DAY + dt.timedelta(days=30), "cycling", 28.0, 2.0, None)], "athlete_id long, date date, sport string, total_trimp double, z4 double, z5 double")
    load = D.daily_load(acts).orderBy("date").collect()
    assert len(load) == 31 and load[0].trimp == 6 and load[0].epoc == 5 and load[1].trimp == 0 and load[30].trimp_epoc == pytest.approx(28.4)
    last = D.acute_chronic(D.daily_load(acts)).orderBy(F.desc("date")).first()
    assert last.acwr == pytest.approx((28.4 / 7) / (28.4 / 28))
    assert D.daily_load(acts.limit(0)).count() == 0


def test_monotony_needs_a_week(spark):
    got = D.monotony_strain(series(spark, [50.0] * 8).withColumnRenamed("v", "trimp")).orderBy("date").collect()
    assert [r.monotony for r in got] == [None] * 6 + [4.0] * 2 and got[7].strain == pytest.approx(1400)


def ride(spark):
    """Ten minutes of riding, fifteen of standing (slow rows every ten seconds), ten of riding."""
    t = [*range(0, 600, 10), *range(600, 1500, 10), *range(1500, 2100, 10)]
    rows = [(1, "cycling", i + 1, x, 120.0 + (x > 1400) * 30, 0.0 if 600 <= x < 1500 else 5.0, float(min(x, 600) * 5 + max(0, x - 1500) * 5), 100.0, 80.0, 150.0, 14.0, 50.0, 14.0) for i, x in enumerate(t)]
    return spark.createDataFrame(rows, "activity_id long, sport string, idx long, t long, hr double, speed double, distance double, altitude double, cadence double, power double, respiration double, lat double, lon double")


def test_stop_detection(spark):
    r = ride(spark)
    s = ST.detect_stops(r).collect()
    assert [(x.start_t, x.end_t, x.duration_s) for x in s] == [(600, 1490, 890)]
    report = ST.stop_report(r).first()
    assert report.a == pytest.approx(120 + 30 * 9 / 19 - 120, abs=3) and report.score_d == 0 and 0 <= report.confidence <= 100
    assert report.km_before == 3.0 and report.km_after == pytest.approx(2.95)
    p = ST.performance(r, ST.detect_stops(r)).first()
    assert p.before_moving_s == 591 and p.after_mean_kmh == 18.0
    assert ST.detect_stops(r.filter("t < 600 OR t >= 1500").withColumn("distance", F.lit(0.0))).count() == 1
    assert ST.detect_stops(r.limit(0)).count() == 0


@pytest.mark.parametrize("gap, stops", [(599, 0), (600, 1), (900, 1)])
def test_gap_lengths(spark, gap, stops):
    rows = [(1, i + 1, t, 5.0, 0.0) for i, t in enumerate([0, 10, 10 + gap, 20 + gap])]
    assert ST.implicit_stops(spark.createDataFrame(rows, "activity_id long, idx long, t long, speed double, distance double")).count() == stops


def test_clusters_do_not_depend_on_order(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    rng = np.random.default_rng(2)
    xy = [(i, 50 + float(a), 14 + float(b)) for i, (a, b) in enumerate(rng.random((60, 2)) * 0.03)] + [(100, 50.01, 14.0), (101, 50.01, 14.0)]
    root = {i: i for i, *_ in xy}

    def metres(a, b):
        p = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(p))

    for _ in xy:
        for a in xy:
            for b in xy:
                if metres(a, b) <= 300:
                    root[a[0]] = root[b[0]] = min(root[a[0]], root[b[0]])
    for rows in (xy, xy[::-1]):
        got = {r.point_id: r.cluster_id for r in G.clusters(spark.createDataFrame(rows, "point_id long, lat double, lon double")).collect()}
        assert got == root


def test_long_chain_is_one_cluster_and_ranks_run_on(spark):
    """A label that has to travel back over a hundred places; ranks over several ranges."""
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    xy = [(i, 50 + k * 0.002, 14.0) for k, i in enumerate([*range(100, 200), 0])] + [(500, 10.0, 10.0)]
    got = {r.point_id: r.cluster_id for r in G.clusters(spark.createDataFrame(xy, "point_id long, lat double, lon double")).collect()}
    assert got == {i: 0 if i < 500 else 500 for i, *_ in xy}
    spots = spark.range(40).selectExpr("id AS cluster_id", "60.0D AS confidence", "5.0D AS duration_min", "date'2024-01-01' AS date", "50.0D AS lat", "14.0D AS lon")
    ranked = {r.cluster_id: r["rank"] for r in G.hotspots(spots).collect()}
    assert ranked == {i: i + 1 for i in range(40)}
    assert G.hotspots(spots.limit(0)).count() == 0


def test_rolled_up_activity(spark):
    r = A.roll_up(ride(spark)).first()
    assert r.records_count == 210 and r.max_hr == 150 and r.z1 == pytest.approx((1 + 59 * 10 + 0) / 60) and r.max_speed_kmh == 18


def test_drop_needs_61_samples(spark):
    rows = [(1, i, float(150 - i // 4)) for i in range(80)]
    frame = spark.createDataFrame(rows, "activity_id long, t long, hr double")
    assert A.max_hr_drop(frame).first().max_hr_drop == 15.0
    assert A.max_hr_drop(frame.filter("t < 59")).first().max_hr_drop is None


def test_dfa_of_noise_and_walk(spark):
    noise = np.random.default_rng(0).normal(size=4000)
    rows = [(k, i, float(y)) for k, x in (("noise", noise), ("walk", np.cumsum(noise))) for i, y in enumerate(np.cumsum(x - x.mean()))] + [("still", i, 0.0) for i in range(4000)]
    got = {r.k: r.alpha for r in RR.dfa_alpha1(spark.createDataFrame(rows, "k string, pos long, y double"), ["k"], 4000).collect()}
    assert set(got) == {"noise", "walk"} and abs(got["noise"] - 0.5) < 0.1 and abs(got["walk"] - 1.5) < 0.2
    walk = np.cumsum(noise - noise.mean())
    levels = []
    for n in range(4, 17):
        parts = walk[: 4000 // n * n].reshape(-1, n)
        fits = [np.polyval(np.polyfit(np.arange(n), p, 1), np.arange(n)) for p in parts]
        levels.append((np.log(n), np.log(np.sqrt(np.mean((parts - fits) ** 2)))))
    assert got["noise"] == pytest.approx(np.polyfit(*zip(*levels, strict=True), 1)[0], abs=1e-9)


@pytest.mark.parametrize(("n", "size"), [(10, 3), (12, 4), (40, 5)])
def test_reflected_means_and_crossings(spark, n, size):
    x = [float((i * 37) % 11) for i in range(n)]
    at = lambda j: x[-1 - j if j < 0 else 2 * n - 1 - j if j >= n else j]
    want = [sum(at(i - size // 2 + k) for k in range(size)) / size for i in range(n)]
    frame = spark.createDataFrame([(x, size)], "x array<double>, size int")
    assert frame.select(RR.smoothed(F.col("x"), F.col("size")).alias("y")).first().y == pytest.approx(want)
    curve = spark.createDataFrame([([100.0, 110.0, 120.0, 130.0], [0.5, 0.9, 0.6, 0.4]), ([1.0], [1.0]), ([1.0, 2.0], [0.75, 0.75])], "hr array<double>, a array<double>")
    assert [r.x for r in curve.select(RR.first_crossing(F.col("hr"), F.col("a"), 0.75).alias("x")).collect()] == [pytest.approx(115.0), None, None]


def test_respiration(spark):
    t, rows = 0.0, []
    for i in range(400):
        rr = 0.8 + 0.05 * math.sin(2 * math.pi * 0.25 * t)
        t += rr
        rows.append((1, i, rr * 1000))
    got = RR.respiration_rate(spark.createDataFrame(rows, "activity_id long, beat long, rr_ms double")).first().respiration_rate
    assert got == pytest.approx(15, abs=1.5)


def plain_respiration(rr_ms):
    """D-23 with a dense solution of the spline and whole transforms."""
    rr = [x for x in rr_ms if 273 <= x <= 2000]
    y = np.array([x for i, x in enumerate(rr) if i == 0 or abs(x - rr[i - 1]) / rr[i - 1] <= 0.2]) / 1000
    if len(y) < 120:
        return None
    t, n = np.cumsum(y), len(y)
    h, slope = np.diff(t), np.diff(y) / np.diff(t)
    system, right = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        system[i, i - 1 : i + 2], right[i] = (h[i - 1], 2 * (h[i - 1] + h[i]), h[i]), 6 * (slope[i] - slope[i - 1])
    m = np.linalg.solve(system, right)
    at = np.arange(t[0], t[-1], 0.25)
    k = np.clip(np.searchsorted(t, at) - 1, 0, n - 2)
    a, b = t[k + 1] - at, at - t[k]
    x = (m[k] * a**3 + m[k + 1] * b**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * a + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * b
    size = min(256, len(x) // 2)
    if len(x) < 64 or size < 32:
        return None
    parts = [x[i : i + size] - x[i : i + size].mean() for i in range(0, len(x) - size + 1, size // 2)]
    power = np.mean([np.abs(np.fft.rfft(p * np.hanning(size + 1)[:-1])) ** 2 for p in parts], axis=0)
    f = np.fft.rfftfreq(size, 0.25)
    band = (f >= 0.15) & (f <= 0.5)
    return float(f[band][power[band].argmax()] * 60)


def test_respiration_equals_the_plain_definition(spark):
    rng = np.random.default_rng(5)
    beats = {1: 119, 2: 120, 3: 121, 4: 300, 5: 900, 6: 2500, 7: 1}
    # Fast hearts give the shortest windows, of 32 to 60 places; the last activity has no plausible beat.
    series = {k: (330 if k in (2, 3) else 800) * (1 + 0.05 * np.sin(0.9 * np.arange(n)) + 0.04 * rng.standard_normal(n)) for k, n in beats.items()} | {8: np.array([100.0, 5000.0])}
    rows = [(k, i, float(x)) for k, v in series.items() for i, x in enumerate(v)]
    frame = spark.createDataFrame(rows, "activity_id long, beat long, rr_ms double").repartition(5)
    got = {r.activity_id: r.respiration_rate for r in RR.respiration_rate(frame).collect()}
    assert set(got) == set(series) - {8} and sum(x is not None for x in got.values()) >= 4
    for k, rate in got.items():
        want = plain_respiration(list(series[k]))
        assert rate is None if want is None else rate == pytest.approx(want), k
    assert not RR.respiration_rate(frame.limit(0)).count()


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 400])
def test_curvature_equals_a_dense_solution(spark, n):
    rng = np.random.default_rng(n)
    x, y = np.cumsum(rng.choice([0.01, 1.0, 50.0], n)), rng.standard_normal(n)
    h = np.diff(x)
    system, right = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        system[i, i - 1 : i + 2], right[i] = (h[i - 1], 2 * (h[i - 1] + h[i]), h[i]), 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    want = np.linalg.solve(system, right)
    points = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y, strict=True)], "k long, x double, y double")
    got = [r.m for r in RR.with_curvature(points, ["k"], "x", "y", "m").orderBy("x").collect()]
    assert got == pytest.approx(list(want), rel=1e-9, abs=1e-9 * float(np.abs(want).max() or 1))


def test_upsert_and_unseen(spark):
    old, new = (spark.createDataFrame(x, "k long, v long") for x in ([(1, 1), (2, 2)], [(2, 5), (2, 7), (3, 9)]))
    assert sorted(map(tuple, T.upserted(old, new, ["k"]).collect())) == [(1, 1), (2, 7), (3, 9)]
    assert [tuple(r) for r in T.unseen(new, old, ["k"]).collect()] == [(3, 9)]


def test_streams_read_tables_of_part_files(spark, tmp_path):
    from stridelake.plans import streams
    from stridelake.streaming import jobs as J

    rows = spark.range(40).selectExpr("id AS event_id", "id % 3 AS user_id", "cast(id AS double) AS value", "'view' AS event_type", "timestamp_ntz'2024-01-01 00:00:00' AS ts")
    rows.repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    for name in (streams.st1, streams.st2, streams.st3):
        assert name(spark, str(tmp_path)).count() == (3 if name is streams.st3 else 40)
    write = J.upsert_sink(f"{tmp_path}/table", ["event_id"])
    write(rows.select("event_id", "value"), 0)
    write(rows.selectExpr("event_id + 20 AS event_id", "-1.0D AS value"), 1)
    got = {r.event_id: r.value for r in J.latest(spark, f"{tmp_path}/table", ["event_id"]).collect()}
    assert len(got) == 60 and got[19] == 19 and got[20] == got[59] == -1


def test_duplicate_sessions(spark):
    names = "athlete_id long, start_t long, file_id long, source string, n_records long, n_rr long, density double, sensor string, size long"
    rows = [(1, 0, 1, "primary", 100, 0, 0.95, "optical", 1), (1, 1800, 2, "secondary", 100, 0, 0.99, "strap", 1), (1, 3601, 3, "primary", 100, 0, 0.5, "unknown", 1), (1, 9000, 4, "primary", 100, 0, 0.5, "unknown", 1)]
    got = I.deduplicated(spark.createDataFrame(rows, names)).collect()
    assert sorted(r.file_id for r in got) == [2, 3, 4]
    assert I.deduplicated(spark.createDataFrame(rows, names).limit(0)).count() == 0


def test_registry_names_match():
    from stridelake.plans import registry

    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) > 100


def landed(spark, *payloads):
    return spark.createDataFrame([(1, DAY, p) for p in payloads], "athlete_id long, date date, payload string")


def test_hrv_response_is_kept_for_readings_or_a_night(spark):
    rows = I.extracted(landed(spark, '{"hrvReadings": [1, 2]}', '{"hrvSummary": {"lastNightAvg": 40, "lastNight5MinHigh": 0}}', '{"hrvSummary": {"weeklyAvg": 40}}', "{}", None, "no json"), "hrv").collect()
    assert sorted((r.sample_count, r.last_night_avg, r.last_night_5min_high) for r in rows if r.last_night_avg) == [(0, 40.0, None)]
    assert sorted(r.sample_count for r in rows) == [0, 2]


def test_activity_takes_the_date_of_its_start(spark):
    rows = I.extracted(landed(spark, '{"activityId": 1, "startTimeGMT": "2024-03-01 23:00:00", "startTimeLocal": "2024-03-02 00:00:00"}', '{"activityId": 2, "startTimeLocal": "2024-03-02 00:00:00"}', '{"activityId": 3}'), "activities").collect()
    assert sorted((r.activity_id, r.date) for r in rows) == [("1", dt.date(2024, 3, 1)), ("2", dt.date(2024, 3, 2))]


def test_sleep_is_in_whole_minutes_and_intensity_keeps_zeros(spark):
    rows = I.extracted(landed(spark, '{"dailySleepDTO": {"sleepTimeSeconds": 119}}', '{"dailySleepDTO": {"sleepTimeSeconds": 59}}'), "sleep").collect()
    assert [(r.duration_minutes, r.sleep_score) for r in rows] == [(1, None)]
    assert [r.total_intensity_min for r in I.extracted(landed(spark, '{"vigorousIntensityMinutes": 5}', "{}", None), "intensity").collect()] == [5.0, 0.0]


def test_training_status_history_falls_back_to_the_top(spark):
    both = landed(spark, '{"mostRecentTrainingStatus": {"latestTrainingStatusData": {"acuteLoad": 0}, "acuteLoad": 7}, "acuteLoad": 9}', '{"acuteLoad": 9}')
    assert sorted(r.acute_load for r in I.extracted(both, "training_status_history").collect()) == [7.0, 9.0]
    assert [r.acute_load for r in I.extracted(both, "training_status").collect()] == [7.0]


def test_changed_files(spark):
    files = spark.createDataFrame([("a", 100), ("b", 100), ("c", 100), ("d", 100), (None, 100), ("e", None)], "path string, mtime long")
    cache = spark.createDataFrame([("a", 101, 2), ("a", 300, 2), ("b", 102, 2), ("c", 100, 1), (None, 100, 2), ("e", None, 2)], "path string, mtime long, version int")
    assert {r.path for r in T.changed_files(files, cache, 2).collect()} == {"b", "c", "d", None, "e"}
    assert T.changed_files(files, cache.limit(0), 2).count() == 6


@pytest.mark.parametrize("label, value, text", [(D.hrv_cv_label, 9.9, "stable"), (D.hrv_cv_label, 10.0, "raised"), (D.hrv_cv_label, 15.0, "high stress"), (D.hrv_cv_label, None, ""), (D.mix_label, 80.0, "high"), (D.mix_label, 60.0, "reduced"), (D.mix_label, 59.9, "low"), (D.mix_label, None, "")])
def test_status_labels(spark, label, value, text):
    assert one(spark, label(F.lit(value).cast("double"))) == text


# --- pauses, thresholds, gaps, JSON, places -----------------------------------------------------------------------------------


def test_pauses_pair_the_last_stop_with_the_next_start(spark):
    told = [(1, 5, "timer", "start"), (1, 10, "timer", "stop"), (1, 12, "Timer", "STOP_DISABLE"), (1, 20, "timer", "start_data"), (1, 25, "lap", "stop"), (1, 30, "timer", "start"), (1, 40, "timer", "stop_disable_all"), (2, 1, "timer", "stop"), (1, None, "timer", "start")]
    p = A.pauses(spark.createDataFrame(told, "activity_id long, t long, event string, event_type string"))
    assert [tuple(r) for r in p.collect()] == [(1, 12, 20)]
    rows = spark.createDataFrame([(1, i, t, None) for i, t in enumerate([11, 12, 15, 20, 21, 50], 1)] + [(3, 1, 12, "x")], "activity_id long, idx long, t long, more string")
    got = {(r.activity_id, r.t): r.in_pause for r in A.with_pauses(rows, p).collect()}
    assert got == {(1, 11): False, (1, 12): True, (1, 15): True, (1, 20): True, (1, 21): False, (1, 50): False, (3, 12): False}
    assert A.with_pauses(rows, p.limit(0)).filter("in_pause").count() == 0 and A.with_pauses(rows, p).columns == [*rows.columns, "in_pause"]


def test_caps_follow_the_sport(spark):
    rows = [("cycling", 101.0, 50.0, 10.0, 60.0), ("cycling", 90.0, 61.0, 10.0, 60.0), ("trail_running", 36.0, 12.0, 40.0, 60.0), ("rowing", 44.0, 39.0, 5.0, 60.0), ("rowing", None, None, 5.0, 0.0)]
    got = A.capped(spark.createDataFrame(rows, "sport string, max_speed_kmh double, avg_speed_kmh double, distance_km double, duration_minutes double")).collect()
    assert [(r.max_speed_kmh, r.avg_speed_kmh, r.distance_km) for r in got] == [(None, 50.0, 10.0), (90.0, None, None), (None, 12.0, None), (44.0, 39.0, 5.0), (None, None, 5.0)]


def test_speed_breakpoint(spark):
    """Ten segments of 20 rows: heart rate rises by 5 a m/s up to the sixth segment, then by 20."""
    rows = []
    for i in range(200):
        seg = i // 20
        rows.append((1, i + 1, True, 120.0 + 5 * min(seg, 5) + 20 * max(0, seg - 5), 1.0 + seg, 100.0, 10.0 * i))
    r = spark.createDataFrame(rows, "activity_id long, idx long, is_active boolean, hr double, speed double, altitude double, distance double").withColumn("hrv", F.lit(None).cast("double"))
    # The slope rises most from the fifth to the sixth step; the heart rate after the fifth is that of the sixth segment.
    assert A.speed_breakpoint(r).first().breakpoint_hr == 145
    assert A.threshold_proxy(r).first().threshold_hr == 145
    assert A.threshold_proxy(r.filter("idx <= 99")).first().threshold_hr is None
    steep = r.withColumn("altitude", F.col("idx") * 5.0)
    assert A.threshold_proxy(steep).first().threshold_hr is None


def test_low_bins_outrank_the_breakpoint(spark):
    rows = [(1, i + 1, True, 100.0 + 5 * (i % 12), 1.0, 30.0 if 100 + 5 * (i % 12) >= 140 else 90.0) for i in range(240)]
    r = spark.createDataFrame(rows, "activity_id long, idx long, is_active boolean, hr double, speed double, hrv double").withColumns({"altitude": F.lit(0.0), "distance": F.col("idx") * 3.0})
    assert A.threshold_proxy(r).first().threshold_hr == 140
    assert A.threshold_proxy(r.withColumn("hr", F.col("hr") + 40)).first().threshold_hr is None


def test_whole_gaps(spark):
    values = [None, 1.0, None, None, 4.0, None, 6.0, None, None]
    times = [0, 1, 2, 3, 4, 5, 60, 61, 62]
    rows = spark.createDataFrame([(1, i, v, t) for i, (v, t) in enumerate(zip(values, times, strict=True))], "k long, i long, v double, t long")
    got = lambda **kw: [r.x for r in rows.select("i", R.interpolated_by_time("v", "t", "i", ["k"], ["i"], **kw).alias("x")).orderBy("i").collect()]
    assert got() == [1.0, 1.0, 2.0, 3.0, 4.0, None, 6.0, 6.0, 6.0]
    assert got(limit=1) == [1.0, 1.0, 2.0, 3.0, 4.0, None, 6.0, None, None]


def test_median_of_three(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, 4.0, None, 2.0, 9.0, 1.0])], "k long, i long, v double")
    assert [r.x for r in rows.select("i", R.rolling_median3("v", ["k"], ["i"]).alias("x")).orderBy("i").collect()] == [None, 4.0, 4.0, 3.0, 5.5, 2.0]


def test_interpolation_is_linear_in_rows(spark):
    import time

    rows = spark.range(60_000).selectExpr("1 AS k", "id AS i", "CASE WHEN id % 50 = 0 THEN id / 1.0 END AS v")
    began = time.time()
    assert rows.select(R.interpolated("v", "i", ["k"], ["i"], 15).alias("x")).filter("x IS NOT NULL").count() == 1200 * 16
    assert time.time() - began < 60


def test_search_in_json(spark):
    deep = '{"a": [[{"KEY1": [1, 2]}], {"b": {"key2": "x"}}], "key0": null, "z": {"theKey9": 5}}'
    found = lambda text, key: one(spark, I.found_anywhere(F.lit(text).cast("string"), key))
    assert found(deep, "key1") == "[1,2]" and found(deep, "key") == "[1,2]" and found(deep, "key9") == "5" and found(deep, "key0") is None and found(deep, "none") is None
    nest = lambda n: '{"n":' * n + '{"k": 7}' + "}" * n
    assert found(nest(10), "k") == "7" and found(nest(11), "k") is None
    assert found(None, "k") is None and found("no json", "k") is None and found("[]", "k") is None


def test_uptake_and_range(spark):
    rows = [(1, DAY, '{"generic": {"vo2MaxPreciseValue": 51.5}}'), (1, DAY, '[{"x": 1}, {"q": {"vo2MaxValue": 44}}]'), (1, DAY, '{"vo2Max": 0}'), (1, DAY, None), (1, DAY, "[]")]
    landing = spark.createDataFrame(rows, "athlete_id long, date date, payload string")
    assert sorted(r.vo2_max for r in I.extracted(landing, "vo2_max").collect()) == [44.0, 51.5]
    dated = spark.createDataFrame([(1, DAY), (1, DAY - dt.timedelta(days=5)), (2, DAY - dt.timedelta(days=29)), (2, DAY - dt.timedelta(days=31)), (3, DAY + dt.timedelta(days=1))], "athlete_id long, date date")
    got = sorted(map(tuple, I.in_range_or_before(dated, str(DAY - dt.timedelta(days=1)), str(DAY)).collect()))
    assert got == [(1, DAY), (2, DAY - dt.timedelta(days=29))]


def test_lactate_falls_back(spark):
    reports = spark.createDataFrame([(1, '[{"lactateThresholdHeartRate": 170, "date": "2024-02-03T10:00"}, {}]'), (2, '{"lactateThresholdSpeed": 0}'), (3, None)], "athlete_id long, payload string")
    daily = spark.createDataFrame([(a, DAY + dt.timedelta(days=i), f'{{"lactateThresholdHeartRate": {150 + i}}}') for a in (1, 2) for i in range(12)], "athlete_id long, date date, payload string")
    got = I.lactate_threshold(reports, daily, "2024-01-02", "2024-01-31", "2024-06-01").collect()
    assert sorted((r.date, r.lt_heart_rate) for r in got if r.athlete_id == 1) == [(dt.date(2024, 2, 3), 170.0), (dt.date(2024, 6, 1), 0.0)]
    assert sorted(r.lt_heart_rate for r in got if r.athlete_id == 2) == [151.0 + i for i in range(8)] and not [r for r in got if r.athlete_id == 3]


def test_sessions_without_records_are_no_error(spark):
    rows = [(1, 0, 1, "primary", 0, 0, 0.0, "unknown", 5), (1, 60, 2, "primary", 0, 0, 0.0, "unknown", 9)]
    got = I.deduplicated(spark.createDataFrame(rows, "athlete_id long, start_t long, file_id long, source string, n_records long, n_rr long, density double, sensor string, size long")).collect()
    assert [r.file_id for r in got] == [2]


@pytest.mark.parametrize("title, place", [("Brno - Cyklistika", "Brno"), ("Šumava Gravel", "Šumava"), ("Ride in Prague", "Prague"), ("Cyklistika", None), (None, None), ("Jízda / Bricktown", "Bricktown"), ("mountain  bike|Lužnice", "Lužnice")])
def test_places_in_titles(spark, title, place):
    assert one(spark, S.place_in_title(F.lit(title).cast("string"))) == place


def test_accents_by_decomposition(spark):
    import unicodedata

    for text in ("Żółć ąęśź İğşț Ĺôw ñ", "e\u0301 a\u0308\u0323", "Ὀδυσσεύς Йод", "straße øre", "한글 漢字"):
        nfd = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
        assert unicodedata.normalize("NFC", one(spark, S.strip_accents(F.lit(text)))) == unicodedata.normalize("NFC", nfd)
    assert one(spark, S.place_name(F.lit("Ride"), F.lit("12, 602 00, okres X, Stará Ves"), "none")) == "Stara_Ves" and one(spark, S.place_name(F.lit(None).cast("string"), F.lit(None).cast("string"), "none")) == "none"


def test_report_positions(spark):
    places = {3: 1.0, 40: 2.0, 45: None}
    rows = spark.createDataFrame([(1, i, i, 0.0, places.get(i), 5.0) for i in range(1, 61)], "activity_id long, idx long, t long, distance double, lat double, lon double")
    stops = spark.createDataFrame([(1, k, a, b, a, b) for k, a, b in ((1, 39, 45), (2, 41, 50), (3, 33, 35), (4, 32, 33))], "activity_id long, stop_id long, start_idx long, end_idx long, start_t long, end_t long")
    assert {r.stop_id: r.report_lat for r in ST.report_positions(rows, stops).collect()} == {1: 2.0, 2: 2.0, 4: 1.0}


def test_enriched_keeps_the_rows(spark):
    left, right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string"), spark.createDataFrame([(1, "x", 5)], "k long, v string, w int")
    assert sorted(map(tuple, T.enriched(left, right, ["k"]).collect()), key=str) == [(1, "a", 5), (1, "b", 5), (2, "c", None)]
    with pytest.raises(ValueError):
        T.enriched(left, right.unionByName(right), ["k"])


def test_tables_written_over_and_apart(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.25), (2, 2.35), (3, None)], "k long, x double")
    for frame in (df.limit(1), df):
        out = T.write_mart(frame, f"{tmp_path}/mart", {"x": 1})
    assert sorted((r.k, r.x) for r in out.collect()) == [(1, 2.2), (2, 2.4), (3, None)]
    T.export_by(df, f"{tmp_path}/by", "k")
    assert spark.read.parquet(f"{tmp_path}/by").count() == 3 and T.optional(spark, f"{tmp_path}/none", df.schema).count() == 0
    with pytest.raises(Exception):
        T.optional(spark, f"{tmp_path}/none", df.schema, required=True)
    assert T.find_column(df, "X") == "x" and T.find_column(df, "q") is None and T.first_existing(df, ["a", "k"]) == "k"


# --- clusters over cells ------------------------------------------------------------------------------------------------


def _plain_clusters(points, metres):
    """Union by comparing all pairs."""
    import math

    def far(a, b):
        x = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371000.0 * math.asin(min(1.0, math.sqrt(x)))

    root = {p: p for p, *_ in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, (p, *a) in enumerate(points):
        for q, *b in points[:i]:
            if far(a, b) <= metres:
                x, y = find(p), find(q)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p, *_ in points}


@pytest.mark.parametrize(("lat", "lon", "spread"), [(50.0, 14.0, 0.02), (-33.0, -70.0, 0.02), (0.0, 0.0, 0.02), (10.0, 180.0, 0.02), (89.99, 0.0, 0.02)])
def test_clusters_equal_all_pairs(spark, lat, lon, spread):
    import random

    rng = random.Random(int(lat * 7 + lon))
    wide = spread if lat < 89 else 180
    points = [(i, min(90.0, lat + rng.uniform(-spread, spread)), (lon + rng.uniform(-wide, wide) + 180) % 360 - 180) for i in range(150)]
    points += [(1000 + i, points[i][1], points[i][2]) for i in range(5)]
    got = {r.point_id: r.cluster_id for r in G.clusters(spark.createDataFrame(points, "point_id long, lat double, lon double"), 300.0).collect()}
    assert got == _plain_clusters(points, 300.0)


def test_clusters_at_the_limit(spark):
    """Pairs a millimetre below and above the distance, which only places of the finest boxes decide."""
    metre = 180 / (math.pi * 6371000)
    rows = []
    for k, gap in enumerate((299.999, 300.001)):
        base = 40 + k
        rows += [(100 * k + i, base + i * 2 * metre, 5.0) for i in range(20)] + [(100 * k + 50 + i, base + (19 * 2 + gap + i * 2) * metre, 5.0) for i in range(20)]
    got = {r.point_id: r.cluster_id for r in G.clusters(spark.createDataFrame(rows, "point_id long, lat double, lon double"), 300.0).collect()}
    assert {got[i] for i in range(70) if i in got} == {0} and {got[100 + i] for i in range(20)} == {100} and {got[150 + i] for i in range(20)} == {150}


def test_a_crowded_place_costs_no_pairs(spark):
    """50,000 places within a kilometre, where all pairs within 300 m would be some hundred millions."""
    crowd = spark.range(50_000).selectExpr("id AS point_id", "50 + (id % 223) * 4e-5 AS lat", "14 + floor(id / 223) * 4e-5 AS lon")
    apart = spark.range(50_000, 50_010).selectExpr("id AS point_id", "51D + id * 0.1 AS lat", "14D AS lon")
    began = time.perf_counter()
    out = G.clusters(crowd.unionByName(apart), 300.0).groupBy("cluster_id").count().collect()
    assert {(r.cluster_id, r["count"]) for r in out} == {(0, 50_000), *((i, 1) for i in range(50_000, 50_010))}
    assert time.perf_counter() - began < 180  # all pairs would take far longer


# --- stops by running sums ------------------------------------------------------------------------------------------------


def test_stop_measures_equal_rows_of_each_stop(spark):
    """Odometers that run backwards, missing values and equal times, against the rows of each stop and its sides."""
    rng = np.random.default_rng(3)
    rows = []
    for a in range(4):
        t = np.cumsum(rng.choice([0, 5, 10, 20, 40, 700], 400, p=[0.05, 0.3, 0.35, 0.2, 0.09, 0.01]))
        for i, x in enumerate(t.tolist()):
            some = lambda v: None if rng.random() < 0.1 else float(v)
            slow = (x // 1500) % 2 == 1
            rows.append((a, "cycling", i + 1, int(x), some(rng.integers(20, 180)), 0.0 if slow else some(rng.integers(0, 90) / 10), some(i * 3 if a % 2 else rng.integers(0, 5000)), some(rng.integers(0, 50)), some(rng.integers(0, 90)), some(rng.integers(0, 300)), some(rng.integers(0, 30)), None, None))
    r = spark.createDataFrame(rows, "activity_id long, sport string, idx long, t long, hr double, speed double, distance double, altitude double, cadence double, power double, respiration double, lat double, lon double").repartition(3)
    starts = [(a, k, 40 + 90 * k, 60 + 90 * k) for a in range(4) for k in range(1, 4)]
    at = {(x[0], x[2]): x[3] for x in rows}
    stops = spark.createDataFrame([(a, k, i, j, at[a, i], at[a, j]) for a, k, i, j in starts], "activity_id long, stop_id long, start_idx long, end_idx long, start_t long, end_t long")
    got = {(x.activity_id, x.stop_id): x for x in ST.performance(r, stops).collect()}
    marked = {(x.activity_id, x.stop_id): x for x in ST.markers(r, stops).collect()}
    mean = lambda xs: sum(xs) / len(xs) if xs else None
    for a, k, i, j in starts:
        own = [x for x in rows if x[0] == a]
        before, after = [x for x in own if x[3] < at[a, i]], [x for x in own if x[3] > at[a, j]]
        for name, side in (("before", before), ("after", after)):
            steps = [1] + [q[3] - p[3] for p, q in zip(side, side[1:], strict=False)]
            assert got[a, k][f"{name}_moving_s"] == sum(s for s in steps if s < 30)
            reads = [x[6] for x in side if x[6] is not None]
            assert got[a, k][f"{name}_km"] == pytest.approx((max(reads) - min(reads)) / 1000)
            assert got[a, k][f"{name}_mean_hr"] == pytest.approx(mean([x[4] for x in side if x[4] and 30 < x[4] < 250]))
            assert got[a, k][f"{name}_mean_power"] == pytest.approx(mean([x[9] for x in side if x[9] and x[9] > 0]))
        win_a = [x for x in own if x[2] > j and x[3] <= at[a, j] + 900]
        win_b = [x for x in own if x[2] < i and x[3] >= at[a, i] - 900]
        cost = lambda side: mean([x[4] / (x[5] * 3.6) for x in side if x[5] and x[5] * 3.6 > 5 and x[4]])
        assert marked[a, k].b == (pytest.approx((cost(win_a) / cost(win_b) - 1) * 100) if cost(win_a) and cost(win_b) else None)
        inside = [x for x in own if i <= x[2] <= j]
        first, last = ([x[4] for x in inside if x[4] is not None and ok(x)] for ok in (lambda x: x[3] <= at[a, i] + 180, lambda x: x[3] >= at[a, j] - 180))
        assert marked[a, k].a == (pytest.approx(mean(last) - mean(first)) if first and last else None)
        reads = [x[6] for x in win_a if x[6] is not None]
        climb = sum(q[7] - p[7] for p, q in zip(win_a, win_a[1:], strict=False) if p[7] is not None and q[7] is not None and q[7] - p[7] > 0.5)
        span = max(reads) - min(reads) if reads else 0
        assert marked[a, k].gradient_pct == pytest.approx(climb / span * 100 if span > 10 else 0.0, abs=0.006)


def test_measures_in_one_pass_equal_each_by_itself(spark):
    from stridelake.sources.fixtures import view

    records = A.with_zones(view(spark, "/root/testdata/sf0.01", "records"))
    one = {r.activity_id: r for r in A.record_measures(records).collect()}
    for frame, name, column in ((A.cardiac_drift(records), "cardiac_drift", "cardiac_drift"), (A.durability(records), "durability", "durability"), (A.threshold_proxy(records), "aet_hr_proxy", "threshold_hr")):
        alone = {r.activity_id: r[column] for r in frame.collect()}
        assert {k: r[name] for k, r in one.items()} == {k: alone.get(k) for k in one} and set(alone) <= set(one)


# --- files ----------------------------------------------------------------------------------------------------------------


def test_csvs_by_their_own_headers(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "one.csv").write_text('"id ", "name","day"\n1,"x, y",2024-01-02\n2, z ,soon\n\n"id ", "name","day"\n')
    (tmp_path / "a" / "b" / "two.csv").write_text("﻿extra,id\n5,3\nbroken\n7,8,9\n")
    (tmp_path / "a" / "b" / "three.csv").write_text("id\n")
    (tmp_path / "a" / "other.txt").write_text("id\n99\n")
    from pyspark.sql import types as PT

    schema = PT.StructType([PT.StructField("id", PT.LongType()), PT.StructField("name", PT.StringType()), PT.StructField("day", PT.DateType())])
    got = {tuple(r) for r in T.read_csvs(spark, str(tmp_path), schema).collect()}
    assert got == {(1, "x, y", dt.date(2024, 1, 2), None), (2, "z", None, None), (3, None, None, None), (None, None, None, "broken"), (None, None, None, "7,8,9")}


def test_upsert_leaves_other_partitions_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b"), (3, 3.0, "b")], "activity_id long, v double, part string")
    T.export_by(old, path, "part")
    before = {r.path: r.mtime for r in T.file_states(spark, path).collect()}
    new = spark.createDataFrame([(2, 20.0, "b"), (9, 9.0, "c"), (9, 8.0, "c")], "activity_id long, v double, part string")
    out = {(r.activity_id, r.v, r.part) for r in T.upsert_partitions(new, path, "part").collect()}
    assert out == {(1, 1.0, "a"), (2, 20.0, "b"), (3, 3.0, "b"), (9, 9.0, "c")}
    after = {r.path: r.mtime for r in T.file_states(spark, path).collect()}
    assert {p: m for p, m in before.items() if "part=a" in p} == {p: m for p, m in after.items() if "part=a" in p}
    assert not {p for p in before if "part=b" in p} & set(after)
    assert [T.upsert_key(spark.createDataFrame([], s)) for s in ("date string, activity_id int", "timestamp string, date string", "x int, date string")] == ["activity_id", "timestamp", "date"]
    with pytest.raises(ValueError, match="none of"):
        T.upsert_key(spark.createDataFrame([], "x int"))


def test_days_split_over_runs_are_closed_once(spark, tmp_path):
    from stridelake.streaming import jobs as J

    hour = lambda d, h: dt.datetime(2024, 1, d, h)
    runs = [[(1, hour(1, 1), 10.0), (1, hour(2, 9), 5.0)], [(1, hour(2, 20), 7.0), (1, hour(5, 1), 1.0), (1, hour(1, 2), 99.0)], [(1, hour(9, 0), 3.0)]]
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    J.rocks(spark)
    try:
        for rows in runs:
            spark.createDataFrame(rows, "user_id long, ts timestamp, load double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema("user_id long, ts timestamp, load double").parquet(str(tmp_path / "in"))
            out = J.drained(J.closed_fitness(stream, "1 hour"), str(tmp_path / "job"))
    finally:
        spark.conf.set(name, before)
    got = [(r.date.day, round(r.ctl, 9)) for r in out.orderBy("date").collect()]
    ctl = [10.0]
    for idle, load in ((0, 12.0), (2, 1.0)):  # the late row of the first day, which was closed by then, does not count
        c = ctl[-1] * (1 - 1 / 42) ** idle
        ctl.append(c + (load - c) / 42)
    assert got == [(d, round(c, 9)) for d, c in zip((1, 2, 5), ctl, strict=True)]


def test_recursive_averages_equal_the_recursion(spark):
    """Long series, gaps of nulls long enough for all to fade, leading nulls, and no values at all."""
    import pandas as pd

    rng = np.random.default_rng(2)
    long = [float(v) for v in rng.integers(0, 200, 6000)]
    holes = [None, None] + [None if rng.random() < 0.3 else float(v) for v in rng.normal(0, 50, 900)]
    gap = [5.0, 7.0] + [None] * 3000 + [1.0, 2.0] + [None] * 20 + [9.0]
    series = {1: long, 2: holes, 3: gap, 4: [None] * 5, 5: [3.0]}
    rows = [(k, i, v) for k, xs in series.items() for i, v in enumerate(xs)]
    out = R.ewma(spark.createDataFrame(rows, "k long, day long, v double").repartition(3), "k", "day", "v", {"a": 42, "b": 7, "c": 1.5}).orderBy("k", "day").toPandas()
    assert list(out.columns) == ["k", "day", "v", "a", "b", "c"]
    for k, xs in series.items():
        for name, span in (("a", 42), ("b", 7), ("c", 1.5)):
            want = pd.Series(xs, dtype=float).ewm(alpha=1 / span, adjust=False).mean().to_numpy()
            np.testing.assert_allclose(out[out.k == k][name].to_numpy(float), want, rtol=1e-9, atol=1e-9)
