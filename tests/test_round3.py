"""Faults that larger tables and odd inputs showed."""

from __future__ import annotations

import datetime as dt
import random
import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from stridelake.functions import rolling as R
from stridelake.functions import scalars as S
from stridelake.operators import activity as A
from stridelake.operators import daily as D
from stridelake.operators import ingest as I
from stridelake.operators import rr as RR
from stridelake.operators import stops as ST
from stridelake.sources import tables as T
from stridelake.sources.fixtures import view

DAY = dt.date(2024, 1, 1)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_shares_next_to_a_half_round_as_numpy_does(spark):
    assert [one(spark, S.half_even(F.lit(x), 1)) for x in (61.650000000000006, 63.949999999999996, 0.25, -0.25)] == [61.6, 64.0, 0.2, -0.2]
    days = [(1, DAY + dt.timedelta(days=i), z1, 0.0, z3, 0.0, 0.0) for i, (z1, z3) in enumerate([(0.0, 0.0), (0.0, 0.0), (1279.0, 721.0)])]
    acts = spark.createDataFrame(days, "athlete_id long, date date, z1 double, z2 double, z3 double, z4 double, z5 double")
    last = D.polarisation(acts).orderBy(F.desc("date")).first()
    assert 1279 / 2000 * 100 < 63.95 and last.low_pct == 64.0


def test_signed_text_keeps_the_sign_of_what_rounds_to_zero(spark):
    assert [one(spark, S.signed(F.lit(x))) for x in (-0.04, 0.04, -0.06, 2.25)] == ["-0.0", "+0.0", "-0.1", "+2.2"]


def test_equal_intervals_are_one(spark):
    rows = [(1, 0, 5), (1, 20, 30), (1, 20, 30), (1, 20, 30), (1, 33, 34), (2, 0, 1)]
    got = R.merged_intervals(spark.createDataFrame(rows, "g long, a long, b long").repartition(3), ["g"], "a", "b", 2)
    assert {tuple(r) for r in got.collect()} == {(1, 0, 5), (1, 20, 30), (1, 33, 34), (2, 0, 1)}


def riding(t, speed, distance, altitude=0.0):
    return {"t": t, "speed": speed, "distance": distance, "altitude": altitude}


def records(spark, rows):
    cols = "activity_id long, idx long, t long, hr double, speed double, distance double, altitude double, cadence double, power double, respiration double"
    own = [(1, i, r["t"], 120.0, r["speed"], float(r["distance"]), r["altitude"], 80.0, 200.0, 20.0) for i, r in enumerate(rows, 1)]
    return spark.createDataFrame(own, cols)


def test_a_gap_between_two_slow_rows_is_one_stop_and_leaves_the_stop_before_alone(spark):
    first = [riding(10 * i, 3.0, 30 * i) for i in range(5)] + [riding(100, 0.0, 150), riding(800, 0.0, 150)]
    between = [riding(810 + 10 * i, 3.0, 200 + 30 * i) for i in range(200)]
    second = [riding(3000, 0.0, 6500), riding(3700, 0.0, 6500)]
    got = ST.detect_stops(records(spark, first + between + second + [riding(3710 + 10 * i, 3.0, 6600 + 30 * i) for i in range(5)]))
    assert [(r.stop_id, r.start_t, r.end_t, r.duration_s) for r in got.orderBy("stop_id").collect()] == [(1, 100, 800, 700), (2, 3000, 3700, 700)]


def test_gradient_next_to_a_half(spark):
    rows = [riding(10 * i, 3.0, 30 * i) for i in range(30)] + [riding(300 + 10 * i, 0.0, 900) for i in range(80)]
    rows += [riding(1100 + 10 * i, 3.0, 1000 + 100 * i, 10.35 if i > 4 else 0.0) for i in range(11)]
    r = records(spark, rows)
    assert ST.markers(r, ST.detect_stops(r)).first().gradient_pct == 1.03 and 10.35 / 1000 * 100 == 1.035


def test_search_parses_only_what_may_hold_the_key(spark):
    found = lambda text, key: one(spark, I.found_anywhere(F.lit(text), key))
    assert found('{"a": {"b": "x"}, "\\u0046ar": 1}', "far") == "1"  # a name spelt with an escape
    assert found('{"a": "far", "b": {"c": [{"xFARx": {"far": 2}}]}}', "Far") == '{"far":2}'
    assert found('{"a": "far"}', "far") is None


def test_costly_rows_of_a_small_file_are_dealt_over_all_cores(spark):
    out = entry.queries()["f_json1_recursive_search"](spark, entry.SMOKE)
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_records_lie_in_partitions_by_their_number(spark):
    rows = spark.range(1000).selectExpr("id % 50 AS k", "id AS v")
    assert T.dealt(rows, "k", rows=10).rdd.getNumPartitions() == 101
    # Both the view and what is united with it keep a number that shuffle settings and coalescing do not touch.
    r = view(spark, entry.SMOKE, "records")
    assert r.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    told = ST.sides(r, ST.detect_stops(r))
    assert told.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    paused = spark.createDataFrame([(1, 0, 5)], "activity_id long, start_t long, end_t long")
    assert A.with_pauses(r, paused).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_sides_of_stops_get_smaller_tasks(spark):
    out = entry.queries()["d44_drift_and_drop"](spark, entry.SMOKE.replace("sf0.001", "sf0.1"))
    dealt = [int(x) for x in re.findall(r"hashpartitioning\(l_suppkey#\d+L?, (\d+)\)", out._jdf.queryExecution().executedPlan().toString())]
    assert dealt and min(dealt) >= 30


def test_drops_of_sides_are_those_of_their_rows(spark):
    rng = random.Random(3)
    rows, stops = [], []
    for a in range(6):
        t = 0
        for i in range(rng.choice([30, 250, 400])):
            t += rng.choice([1, 2, 5, 30, 31, 45])
            rows.append((a, i, t, None if rng.random() < 0.2 or (a == 5 and i < 150) else float(rng.randrange(100, 180))))
        at = sorted(rng.sample(range(-5, t + 50), 6))
        stops += [(a, k, at[2 * k], at[2 * k + 1]) for k in range(3)]
    r = spark.createDataFrame(rows, "activity_id long, idx long, t long, hr double")
    s = spark.createDataFrame(stops, "activity_id long, stop_id long, start_t long, end_t long")
    key = ("activity_id", "stop_id", "side")
    want = {tuple(x) for x in A.max_hr_drop(ST.sides(r, s), key=key).collect()}
    got = [tuple(x) for x in A.max_hr_drop_of_sides(r, s).collect()]
    assert len(got) == len(want) and set(got) == want and sum(x[3] is not None for x in got) > 10


def test_seconds_box_sizes_and_bins_are_no_rows(spark):
    """F16: a row for each second, for each of 13 box sizes and for each of 23 bins was sorted or grouped."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    r = view(spark, entry.SMOKE, "records")
    beats = r.filter("hr > 0").selectExpr("activity_id", "idx AS beat", "60000 / hr AS rr_ms")
    assert "Generate" not in plan(A.max_hr_drop(r))
    assert plan(RR.alpha_windows(beats)).count("Generate ") == 1  # windows
    assert plan(RR.band_power(beats.selectExpr("activity_id", "100L AS points", "beat AS at", "rr_ms AS x"))).count("Generate ") == 1  # bins of the result
    # A pass over records gives the thresholds of all activities, those without windows too.
    assert plan(RR.dfa_thresholds(beats)).count("FileScan") == 1
    few = spark.createDataFrame([(1, i, 800.0 + i) for i in range(50)], "activity_id long, beat long, rr_ms double")
    assert [tuple(x) for x in RR.dfa_thresholds(few).collect()] == [(1, None, None, 0, "none")]


def test_closed_days_of_a_group_ask_state_once():
    """state was asked eight times for each athlete and day."""
    import pandas as pd

    from stridelake.streaming.jobs import _ClosedDays

    class Store:
        rows, calls = [], 0

        def getListState(self, name, schema):
            return self

        def get(self):
            self.calls += 1
            return iter(self.rows)

        def put(self, rows):
            self.calls, self.rows = self.calls + 1, rows

    store, job = Store(), _ClosedDays(42, 7)
    job.init(store)
    frame = lambda *rows: pd.DataFrame(rows, columns=["user_id", "day", "load"])
    run = lambda *frames: [tuple(r) for f in job.handleInputRows((0,), iter(frames), None) for r in f.itertuples(index=False)]
    first = run(frame((2, 5, 8.0), (1, 3, 4.0)), frame((1, 0, 10.0)))
    assert store.calls == 2 and [(u, d.day, round(ctl, 9)) for u, d, ctl, *_ in first] == [(1, 1, 10.0), (1, 4, round(10 * (41 / 42) ** 3 + 4 / 42, 9)), (2, 6, 8.0)]
    then = run(frame((1, 4, 2.0)))
    c, a = first[1][2], first[1][3]
    assert store.calls == 4 and abs(then[0][2] - (c + (2 - c) / 42)) < 1e-9 and abs(then[0][4] - (c - (a + (2 - a) / 7))) < 1e-9
    assert sorted(u for u, *_ in store.rows) == [1, 2]
