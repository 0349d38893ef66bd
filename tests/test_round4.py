"""Faults that six times the driver's tables showed."""

from __future__ import annotations

import math
import random

import __spark_entry__ as entry
from stridelake.operators import activity as A
from stridelake.operators import geo as G
from stridelake.operators import stops as ST


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def metres_apart(a, b) -> float:
    dlat, dlon = math.radians(b[1] - a[1]), math.radians(b[2] - a[2])
    x = math.sin(dlat / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(dlon / 2) ** 2
    return 2 * 6371000.0 * math.asin(min(1.0, math.sqrt(x)))


def test_distances_of_neighbour_pairs_are_those_of_places(spark):
    """each pair of stops worked out and rounded its own distance; now that is done below the rows of the result."""
    told = plan(entry.queries()["j13_neighbour_pairs"](spark, entry.SMOKE))
    assert -1 < told.find("Generate") < told.find("ASIN") and told.count("round(") == 1


def test_neighbour_pairs_of_crowded_spots_are_dealt(spark, monkeypatch):
    """pairs of a crowded cell met in one task."""
    monkeypatch.setattr(G, "TASK_PAIRS", 10_000)
    crowd = spark.range(2000).selectExpr("id AS point_id", "50.0D AS lat", "14.0D + (id % 2) / 1000 AS lon")
    got = G.neighbour_pairs(crowd, 300, 3)
    assert got.rdd.getNumPartitions() >= 100
    assert got.count() == got.distinct().count() == 2000 * 1999 // 2
    tasks = [n for n in got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(tasks) > 4


def test_neighbour_pairs_are_those_of_all_pairs(spark, monkeypatch):
    """Poles, the antimeridian, longitudes beyond it, equal places, equal ids and what is no place."""
    monkeypatch.setattr(G, "BLOCK", 4)
    rng, points = random.Random(5), []
    for lat, lon, spread in ((50.0, 14.0, 0.004), (0.0, 180.0, 0.004), (-60.0, -179.999, 0.006), (89.9995, 0.0, 200.0), (10.0, 190.0, 0.004)):
        for _ in range(40):
            x = lon + rng.uniform(-spread, spread)
            points.append((len(points), min(90.0, lat + rng.uniform(-0.004, 0.004)), x if abs(x) <= 180 or lon > 180 else x - math.copysign(360, x)))
    points += [(1000 + i, *points[i % 3][1:]) for i in range(30)] + [(1000, *points[0][1:])]
    want = {(min(a[0], b[0]), max(a[0], b[0])): metres_apart(a, b) for i, a in enumerate(points) for b in points[:i] if a[0] != b[0] and metres_apart(a, b) <= 300}
    odd = [(2000, None, 14.0), (2001, 50.0, None), (2002, float("nan"), 14.0), (2003, 50.0, float("nan"))]
    got = G.neighbour_pairs(spark.createDataFrame(points + odd, "point_id long, lat double, lon double"), 300).collect()
    assert {(r.point_id, r.point_id_b) for r in got} == set(want) and all(abs(r.distance_m - want[r.point_id, r.point_id_b]) < 1e-6 for r in got)
    assert len(got) == len(want) + sum(1 for p in points if p[0] != 1000 and metres_apart(p, points[0]) <= 300)
    assert G.neighbour_pairs(spark.createDataFrame([], "point_id long, lat double, lon double"), 300).count() == 0


def test_sides_of_stops_are_no_rows(spark):
    """records were taken once for every stop, and a row a second, to tell drift and drop of sides."""
    told = plan(entry.queries()["d44_drift_and_drop"](spark, entry.SMOKE))
    assert "sequence(" not in told and told.count("Generate ") == 1  # segments of stops
    assert told.count("Join") == 1  # arrays of records, arrays of stops


def test_drifts_of_sides_are_those_of_their_rows(spark):
    """Flat and hilly, on wheels and on foot, missing values, equal times, overlapping stops and sides without rows."""
    rng = random.Random(11)
    rows, stops = [], []
    for a in range(40):
        t, hilly = 0, a % 4 > 1
        for i in range(rng.choice([15, 60, 250])):
            t += rng.choice([0, 5, 20, 45])
            some = lambda x, p=0.15: None if rng.random() < p else float(x)
            sport = None if a == 39 else ("cycling", "running")[a % 2]
            rows.append((a, i, t, sport, some(rng.randrange(90, 160)), some(rng.choice([0.0, 0.2, 0.5, 2.0, 9.0])), some(rng.choice([0, 20, 180])), some(rng.randrange(60 if hilly else 20), 0.9 if a == 7 else 0.15)))
        at = sorted(rng.sample(range(-5, max(t, 40) + 50), 8))
        stops += [(a, k, at[2 * k], at[2 * k + 1]) for k in range(4)] + [(a, 4, at[1], at[6])]
    r = spark.createDataFrame(rng.sample(rows, len(rows)), "activity_id long, idx long, t long, sport string, hr double, speed double, power double, altitude double").repartition(3)
    s = spark.createDataFrame(stops, "activity_id long, stop_id long, start_t long, end_t long")
    key = ["activity_id", "stop_id", "side"]
    sides = ST.sides(r, s)
    want = A.max_hr_drop(sides, key=tuple(key)).join(A.cardiac_drift(sides, key=tuple(key)), key, "left").select(*key, "cardiac_drift", "max_hr_drop")
    want = {tuple(x) for x in want.collect()}
    got = [tuple(x) for x in A.drift_and_drop_of_sides(r, s).collect()]
    assert len(got) == len(want) and set(got) == want
    assert sum(x[3] is not None and x[0] % 2 == 0 for x in got) > 10 and sum(x[3] is not None and x[0] % 2 == 1 for x in got) > 5
