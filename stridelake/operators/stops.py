"""Long stops in record streams: detection, physiological markers around them, confidence, and performance before and after.

Records: activity_id, idx (row number by time), t (seconds), hr, speed (m/s), distance (m), altitude, cadence, power, respiration,
lat, lon; any of the measured columns may be null. Rows are grouped by activity; an activity is some thousands of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.functions.scalars import half_even, haversine_m, is_cardio, kmh, map_url, step_score
from stridelake.profile import DEFAULT, Profile
from stridelake.sources.tables import dealt_again, stored

KEY = "activity_id"


def _order():
    return Window.partitionBy(KEY).orderBy("idx")


def implicit_stops(records: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """D-32: gaps between rows of at least the least stop, unless the odometer moved on faster than its limit.
    activity_id, start_idx, end_idx, start_t, end_t."""
    before = records.select(KEY, "idx", "t", "distance", F.lag("t").over(_order()).alias("t0"), F.lag("distance").over(_order()).alias("d0"), F.lag("idx").over(_order()).alias("i0"))
    gap = before.filter((F.col("t") - F.col("t0") > profile.gap_s) & (F.col("t") - F.col("t0") >= profile.min_stop_s))
    moved = (F.col("distance") - F.col("d0")) / (F.col("t") - F.col("t0")) * 3.6
    still = gap.filter(~F.coalesce(moved > profile.odometer_kmh, F.lit(False)))
    return still.select(KEY, F.col("i0").alias("start_idx"), F.col("idx").alias("end_idx"), F.col("t0").alias("start_t"), F.col("t").alias("end_t"))


def explicit_stops(records: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """D-33: islands of slow rows (a null speed is slow); a gap over the pause limit between slow rows begins a new one."""
    slow = records.filter(kmh(F.col("speed")) < profile.stop_kmh).select(KEY, "idx", "t")
    gap = F.col("t") - F.lag("t").over(_order())
    run = F.sum(F.coalesce((gap > profile.pause_gap_s).cast("int"), F.lit(0))).over(_order().rowsBetween(Window.unboundedPreceding, 0))
    grouped = slow.withColumn("_run", run).groupBy(KEY, "_run")
    return grouped.agg(F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.min("t").alias("start_t"), F.max("t").alias("end_t")).drop("_run")


def detect_stops(records: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """D-34: both kinds of stops, merged where they touch or where little riding lies between, of the least length at least,
    without those over which the odometer moved on; one for each start, the longest. stop_id counts within an activity.

    One pass over records: each row tells the segment it is part of (the gap before it, or its island of slow rows), with the
    odometer and the running count of fast rows at both of its ends, so that merging looks nothing up."""
    return _detected(records, profile).drop("start_distance")


def _detected(records: DataFrame, profile: Profile) -> DataFrame:
    """detect_stops() with the odometer at the start."""
    c, upto = F.col, _order().rowsBetween(Window.unboundedPreceding, 0)
    v = kmh(c("speed"))
    rows = records.select(KEY, "idx", "t", "distance", (v < profile.stop_kmh).alias("_slow"), (v > profile.moving_kmh).cast("long").alias("_own"))
    rows = rows.withColumns({
        "_fast": F.sum("_own").over(upto),
        "_before": F.lag(F.struct("idx", "t", "distance")).over(_order()),
        "_last": F.last(F.when(c("_slow"), c("t")), ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, -1)),
    })
    begins = c("_slow") & F.coalesce(c("t") - c("_last") > profile.pause_gap_s, F.lit(False))
    rows = rows.withColumn("_run", F.sum(begins.cast("long")).over(upto))
    gap = c("t") - c("_before.t")
    moved = (c("distance") - c("_before.distance")) / gap * 3.6
    still = (gap > profile.gap_s) & (gap >= profile.min_stop_s) & ~F.coalesce(moved > profile.odometer_kmh, F.lit(False))
    # Ends of a segment: place, time, odometer, and fast rows up to it (at a start without its own).
    end = F.struct("idx", "t", "distance", c("_fast").alias("fast"))
    own = F.struct(F.lit(1).alias("kind"), c("_run").alias("run"), F.struct("idx", "t", "distance", (c("_fast") - c("_own")).alias("fast")).alias("a"), end.alias("b"))
    # The row before a gap is at its start; what is fast up to it is what is fast up to here, without both rows' own.
    first = F.struct(c("_before.idx").alias("idx"), c("_before.t").alias("t"), c("_before.distance").alias("distance"), (c("_fast") - c("_own") - F.coalesce("_own_before", F.lit(0))).alias("fast"))
    rows = rows.withColumn("_own_before", F.lag("_own").over(_order()))
    gapped = F.struct(F.lit(0).alias("kind"), c("idx").cast("long").alias("run"), first.alias("a"), end.alias("b"))
    told = F.array_compact(F.array(F.when(c("_slow"), own), F.when(still, gapped)))
    segs = rows.select(KEY, F.explode(told).alias("x")).groupBy(KEY, "x.kind", "x.run").agg(F.min("x.a").alias("a"), F.max("x.b").alias("b"))

    # A gap between two slow rows by themselves is a segment of either kind: the kind makes the order total.
    ordered = Window.partitionBy(KEY).orderBy("a.t", "b.t", "a.idx", "b.idx", "kind", "run")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    segs = segs.withColumns({"_t": F.max("b.t").over(before), "_i": F.max(F.struct("b.idx", "b.fast")).over(before)})
    apart, between = c("a.t") - c("_t"), c("a.idx") - c("_i.idx") - 1
    near = (apart <= profile.pause_gap_s) & ((between <= 0) | (2 * (c("a.fast") - c("_i.fast")) < between))
    breaks = F.when(c("_t").isNull(), 0).otherwise((~((apart <= 0) | near)).cast("int"))
    run = F.sum("_break").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    merged = segs.withColumn("_break", breaks).withColumn("_run", run).groupBy(KEY, "_run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    long = merged.filter(c("b.t") - c("a.t") >= profile.min_stop_s)
    moved = (c("b.distance") - c("a.distance")) / (c("b.t") - c("a.t")) * 3.6
    still = long.filter(~F.coalesce(moved > profile.odometer_kmh, F.lit(False)))
    unique = still.withColumn("_n", F.row_number().over(Window.partitionBy(KEY, "a.t").orderBy(F.col("b.t").desc()))).filter("_n = 1")
    number = F.row_number().over(Window.partitionBy(KEY).orderBy("a.t")).cast("long")
    ends = [c("a.idx").alias("start_idx"), c("b.idx").alias("end_idx"), c("a.t").alias("start_t"), c("b.t").alias("end_t")]
    return unique.select(KEY, number.alias("stop_id"), *ends, (c("b.t") - c("a.t")).alias("duration_s"), c("a.distance").alias("start_distance"))


def around(records: DataFrame, stops: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """Rows of each stop and of the analysis windows before and after it (the rows at its edges belong to the stop),
    with side: before, in or after. Stops of an activity are few, so a row meets few. The measures of stops do without it, see edges()."""
    s = stops.select(KEY, "stop_id", "start_idx", "end_idx", "start_t", "end_t")
    joined = records.join(s, KEY).filter((F.col("t") >= F.col("start_t") - profile.analysis_s) & (F.col("t") <= F.col("end_t") + profile.analysis_s))
    side = F.when(F.col("idx") < F.col("start_idx"), "before").when(F.col("idx") > F.col("end_idx"), "after").otherwise("in")
    return joined.withColumn("side", side)


ZONES = ("Z1", "Z2", "Z3", "Z4", "Z5")


def _measures(records: DataFrame, zones: bool) -> tuple[dict[str, Column], dict[str, Column]]:
    """What is summed over rows (null where a row does not count), and what is counted."""
    have = set(records.columns)
    c = lambda name: F.col(name) if name in have else F.lit(None).cast("double")
    v = kmh(c("speed"))
    riding = v > 5
    sums = {
        "hr": c("hr"),
        "cost": F.when(riding & (c("hr") > 0), c("hr") / v),
        "spin": F.when(c("cadence") > 0, c("cadence")),
        "resp": F.when(c("respiration") > 0, c("respiration")),
        "pulse": F.when((c("hr") > 30) & (c("hr") < 250), c("hr")),
        "pace": F.when(c("speed") > 0, c("speed")),
        "power": F.when(c("power") > 0, c("power")),
        "climb": F.col("_climb"),
        "moving": F.col("_moving"),
    }
    counts = {"rows": F.lit(True), "riding": riding, "coast": riding & (c("cadence").isNull() | (c("cadence") < 2)), "readings": F.col("distance").isNotNull(), "drops": F.col("_drop")}
    if zones:
        counts |= {z: F.col("zone") == z for z in ZONES} | {"zoned": F.col("zone") != ""}
    return sums, counts


_LAST = 1 << 62
#: Moments of a stop: time, place and whether the rows there lie before it, as columns of the stop. Rows are ordered by time, then place.
_MOMENTS = {
    "first": lambda p: (F.lit(-_LAST), -1, False),
    "window_begin": lambda p: (F.col("start_t") - p.analysis_s, -1, False),
    "side_end": lambda p: (F.col("start_t"), -1, False),
    "start": lambda p: (F.col("start_t"), F.col("start_idx"), False),
    "started": lambda p: (F.col("start_t"), F.col("start_idx"), True),
    "settled": lambda p: (F.col("start_t") + p.settle_s, _LAST, True),
    "settling": lambda p: (F.col("end_t") - p.settle_s, -1, False),
    "ended": lambda p: (F.col("end_t"), F.col("end_idx"), True),
    "side_begin": lambda p: (F.col("end_t"), _LAST, True),
    "window_end": lambda p: (F.col("end_t") + p.analysis_s, _LAST, True),
    "last": lambda p: (F.lit(_LAST), _LAST, True),
}


#: What a purpose needs: measures, counts and moments.
_AROUND = ("hr cost spin resp climb rows riding coast readings drops".split(), "window_begin start started settled settling ended window_end last".split())
_SIDES = ("pulse pace power spin moving rows readings drops".split(), "first side_end side_begin last".split())


def edges(records: DataFrame, stops: DataFrame, profile: Profile = DEFAULT, needs: tuple[list[str], list[str]] = _AROUND, zones: bool = False) -> DataFrame:
    """stops, with a column for each of their moments: running sums and counts of measures up to it, and what is known next to it.

    One pass over records: moments and records are sorted together, and sums over any stretch are the difference of two moments.
    So neither rows are multiplied by stops nor does the length of a stretch matter. The result, a row for each stop, is stored."""
    c, order = F.col, Window.partitionBy(KEY).orderBy("t", "idx", "_flag")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    have = set(records.columns)
    step = c("t") - F.lag("t").over(_order())
    moving = F.when(step.isNull(), 1).when(step < 30, step).otherwise(0).cast("double")
    rise = c("altitude") - F.lag("altitude").over(_order()) if "altitude" in have else F.lit(None).cast("double")
    odometer = c("distance").cast("double")
    fell = F.coalesce(odometer < F.last(odometer, ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    rows = records.withColumns({"_moving": moving, "_climb": F.when(rise > 0.5, rise), "_drop": fell})
    sums, counts = _measures(rows, zones)
    sums, counts = {m: x for m, x in sums.items() if m in needs[0]}, {m: x for m, x in counts.items() if m in needs[0] or m in (*ZONES, "zoned")}
    place = F.when(c("lat").isNotNull() & c("lon").isNotNull(), F.struct("idx", "lat", "lon")) if {"lat", "lon"} <= have else F.lit(None).cast("struct<idx:bigint,lat:double,lon:double>")
    rows = rows.select(
        KEY, c("t").cast("long").alias("t"), c("idx").cast("long").alias("idx"), F.lit(1).alias("_flag"), odometer.alias("_odometer"), place.alias("_place"),
        *(x.alias(f"_{m}") for m, x in sums.items()), *(F.coalesce(x, F.lit(False)).alias(f"_{m}") for m, x in counts.items()),
    )
    at = [F.struct(F.lit(name).alias("name"), *(F.lit(x).cast("long").alias(n) if n != "_flag" else F.lit(2 if x else 0).alias(n) for n, x in zip(("t", "idx", "_flag"), _MOMENTS[name](profile), strict=True))) for name in needs[1]]
    asked = stops.select(KEY, F.struct(*(x for x in stops.columns if x != KEY)).alias("_stop"), F.explode(F.array(*at)).alias("x")).select(KEY, "_stop", "x.*")
    both = dealt_again(rows.unionByName(asked, allowMissingColumns=True), KEY)
    # A sum is kept as whole thousandths, which add up exactly, and what is left of each value, which is small.
    run = {"odometer": F.last("_odometer", ignorenulls=True).over(upto), "place": F.last("_place", ignorenulls=True).over(upto)}
    for m in sums:
        whole = F.floor(c(f"_{m}") * 1000).cast("long")
        run |= {f"{m}_n": F.count(f"_{m}").over(upto), f"{m}_w": F.sum(whole).over(upto), f"{m}_r": F.sum(c(f"_{m}") - whole / 1000).over(upto)}
    run |= {f"{m}_n": F.count_if(c(f"_{m}")).over(upto) for m in counts}
    down = Window.partitionBy(KEY).orderBy(F.desc("t"), F.desc("idx"), F.desc("_flag")).rowsBetween(Window.unboundedPreceding, 0)
    if ahead := [f"_{m}" for m in ("moving", "climb") if m in sums]:
        run["next"] = F.last(F.when(c("_flag") == 1, F.struct(*ahead)), ignorenulls=True).over(down)
    run |= {"next_odometer": F.last("_odometer", ignorenulls=True).over(down), "next_place": F.last("_place", ignorenulls=True).over(down)}
    told = both.select(KEY, "_stop", "name", F.struct(*(x.alias(n) for n, x in run.items())).alias("run")).filter("name IS NOT NULL")
    g = told.groupBy(KEY, c("_stop.stop_id").alias("stop_id")).agg(F.first("_stop").alias("_stop"), *(F.max(F.when(c("name") == n, c("run"))).alias(n) for n in needs[1]))
    return stored(g.select(KEY, *(c(f"_stop.{x}").alias(x) for x in stops.columns if x != KEY), *needs[1]))


def _n(m: str, a: Column, b: Column) -> Column:
    return F.coalesce(b[f"{m}_n"], F.lit(0)) - F.coalesce(a[f"{m}_n"], F.lit(0))


def _sum(m: str, a: Column, b: Column) -> Column:
    """The sum of a measure over the rows between two moments."""
    part = lambda k: F.coalesce(b[f"{m}_{k}"], F.lit(0)) - F.coalesce(a[f"{m}_{k}"], F.lit(0))
    return part("w") / 1000 + part("r")


def _mean(m: str, a: Column, b: Column) -> Column:
    return F.when(_n(m, a, b) > 0, _sum(m, a, b) / _n(m, a, b))


def _with_span(e: DataFrame, records: DataFrame, name: str, a: str, b: str) -> DataFrame:
    """e (as edges() gives it) with how far the odometer went (greatest reading less least) between two moments. Where it never runs
    back there, its first and last readings tell; else the rows between are looked at."""
    c = F.col
    known, back = _n("readings", c(a), c(b)) > 0, _n("drops", c(a), c(b)) > 0
    out = e.withColumns({name: F.when(known, c(b)["odometer"] - c(a)["next_odometer"]), "_bent": back})
    bent = out.filter("_bent").select(KEY, "stop_id", F.coalesce(c(a)["rows_n"], F.lit(0)).alias("_from"), c(b)["rows_n"].alias("_to"))
    if bent.limit(1).count():
        place = F.row_number().over(Window.partitionBy(KEY).orderBy("t", "idx"))
        rows = records.select(KEY, "distance", place.alias("_row")).join(bent, KEY).filter("_row > _from AND _row <= _to")
        true = rows.groupBy(KEY, "stop_id").agg((F.max("distance") - F.min("distance")).alias("_span"))
        out = out.join(true, [KEY, "stop_id"], "left").withColumn(name, F.when(c("_bent"), c("_span")).otherwise(c(name))).drop("_span")
    return out.drop("_bent")


def markers(records: DataFrame, stops: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """D-35 to D-39 for every stop: the four differences, their scores, and the gradient after it.
    A: heart rate at the stop's end against its start; B: heart rate a km/h, after against before, %; C: cadence drop, with
    coasting; D: respiration rise. B and A score 0 on thin data, C and D are null."""
    return _marked(edges(records, stops, profile), records)


def _marked(e: DataFrame, records: DataFrame) -> DataFrame:
    c = F.col
    e = _with_span(e, records, "span_m", "ended", "window_end")
    before, after = (c("window_begin"), c("start")), (c("ended"), c("window_end"))
    settled = F.when(_n("rows", c("settled"), c("ended")) >= 0, c("settled")).otherwise(c("ended"))
    settling = F.when(_n("rows", c("start"), c("settling")) >= 0, c("settling")).otherwise(c("start"))
    coasting = lambda side: F.when(_n("riding", *side) > 0, _n("coast", *side) / _n("riding", *side) * 100).otherwise(0.0)
    # A rise belongs to the row it ends at, so the first row's is none of this stretch.
    climb = F.when(_n("rows", *after) > 0, _sum("climb", *after) - F.coalesce(c("ended.next._climb"), F.lit(0.0))).otherwise(0.0)
    m = e.select(
        KEY, "stop_id", "span_m", climb.alias("climb"),
        (_mean("hr", settling, c("ended")) - _mean("hr", c("start"), settled)).alias("a"),
        ((_mean("cost", *after) / _mean("cost", *before) - 1) * 100).alias("b"),
        (_mean("spin", *before) - _mean("spin", *after)).alias("c"),
        (coasting(after) - coasting(before)).alias("rise"),
        (_mean("resp", *after) - _mean("resp", *before)).alias("d"),
    )
    a, b, drop, d = (c(x) for x in "abcd")
    bonus = F.when(c("rise") > 10, 15.0).when(c("rise") > 5, 8.0).otherwise(0.0)
    return m.select(
        KEY,
        "stop_id",
        "a",
        F.coalesce(F.when(a <= 0, 0.0).otherwise(step_score(a, [(5, 15), (10, 35), (15, 55), (20, 70), (30, 85)], 100, strict=True)), F.lit(0.0)).alias("score_a"),
        "b",
        F.coalesce(step_score(b, [(3, 0), (8, 20), (15, 45), (25, 70), (40, 85)], 100), F.lit(0.0)).alias("score_b"),
        "c",
        F.when(drop.isNotNull(), F.least(F.lit(100.0), step_score(drop, [(2, 0), (5, 20), (8, 40), (12, 60), (18, 80)], 100) + bonus)).alias("score_c"),
        "d",
        step_score(d, [(1, 0), (3, 25), (5, 50), (8, 75)], 100).alias("score_d"),
        half_even(F.when(c("span_m") > 10, c("climb") / c("span_m") * 100).otherwise(0.0), 2).alias("gradient_pct"),
    )


def confidence(marked: DataFrame) -> DataFrame:
    """D-40: scores weighted 35, 30, 20, 15 over the markers present; a fifth of it after a climb over 1.5 %; 0..100, one decimal."""
    c = F.col
    wc, wd = F.when(c("score_c").isNull(), 0.0).otherwise(20.0), F.when(c("score_d").isNull(), 0.0).otherwise(15.0)
    raw = (35 * c("score_a") + 30 * c("score_b") + wc * F.coalesce("score_c", F.lit(0.0)) + wd * F.coalesce("score_d", F.lit(0.0))) / (65 + wc + wd)
    penalty = F.coalesce(c("gradient_pct") > 1.5, F.lit(False))
    out = marked.withColumn("raw_confidence", F.bround(F.round(raw, 9), 1)).withColumn("gradient_penalty", penalty)
    return out.withColumn("confidence", F.bround(F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw * F.when(penalty, 0.2).otherwise(1.0))), 9), 1))


def anchors(records: DataFrame, stops: DataFrame) -> DataFrame:
    """A position for each stop: the last one on the 49 rows before its start, else at the start, else the first inside."""
    return edges(records, stops, needs=([], ["started"])).withColumn("p", _anchor()).filter("p IS NOT NULL").select(KEY, "stop_id", "p.lat", "p.lon")


def _anchor() -> Column:
    early, late = F.col("started.place"), F.col("started.next_place")
    return F.when(early["idx"] >= F.col("start_idx") - 49, early).when(late["idx"] <= F.col("end_idx"), late)


def report_positions(records: DataFrame, stops: DataFrame) -> DataFrame:
    """The first position inside each stop, else the last on the 29 rows before it."""
    return edges(records, stops).withColumn("p", _report_place()).filter("p IS NOT NULL").select(KEY, "stop_id", F.col("p.lat").alias("report_lat"), F.col("p.lon").alias("report_lon"))


def _report_place() -> Column:
    inside, before = F.col("start.next_place"), F.col("start.place")
    return F.when(inside["idx"] <= F.col("end_idx"), inside).when(before["idx"] >= F.col("start_idx") - 29, before)


def stop_report(records: DataFrame, profile: Profile = DEFAULT, km_digits: int = 2) -> DataFrame:
    """D-41: every stop with its markers, confidence, kilometres before and after, and a map link to its report position. Records are
    read twice: to detect the stops, and for all that is known of them (see edges())."""
    e = edges(records, _detected(records, profile), profile)
    km = lambda x: F.bround(F.round(x / 1000, 9), km_digits)
    p, at = _report_place(), F.col("start_distance")
    own = e.select(
        KEY, "stop_id", "start_idx", "end_idx", "start_t", "end_t", "duration_s", p["lat"].alias("report_lat"), p["lon"].alias("report_lon"), km(at).alias("km_before"),
        km(F.col("last.odometer") - at).alias("km_after"), F.when(p.isNotNull(), map_url(p["lat"], p["lon"])).alias("map_url"),
    )
    return own.join(confidence(_marked(e, records)), [KEY, "stop_id"])


def report_order(report: DataFrame) -> DataFrame:
    """T5: the likeliest stops first."""
    return report.orderBy(F.desc("confidence"), KEY, "stop_id")


def stop_points(records: DataFrame, areas: list[tuple[float, float, float]] | None = None, profile: Profile = DEFAULT) -> DataFrame:
    """D-41b: stops of cardio activities that have an anchor (W25) outside the excluded areas, with their confidence; what is
    excluded is dropped before it is scored. activity_id, stop_id, lat, lon, confidence, duration_min."""
    rows = records.filter(is_cardio(F.col("sport")))
    e = edges(rows, _detected(rows, profile), profile).withColumn("p", _anchor()).filter("p IS NOT NULL")
    e = e.filter(~in_any_area(F.col("p.lat"), F.col("p.lon"), areas or []))
    scored = confidence(_marked(e, rows)).select(KEY, "stop_id", "confidence")
    minutes = F.bround(F.round(F.col("duration_s") / 60, 9), 1)
    return e.select(KEY, "stop_id", "p.lat", "p.lon", minutes.alias("duration_min")).join(scored, [KEY, "stop_id"]).select(KEY, "stop_id", "lat", "lon", "confidence", "duration_min")


def read_report(rows: DataFrame, least_confidence: float = DEFAULT.min_confidence) -> DataFrame:
    """A stop report of texts (activity_id, date, start, end, confidence) with types, from the least confidence on: start and
    end times are put on the date, an end before the start on the next day. Rows whose date or times cannot be read are left out."""
    at = lambda c: F.try_to_timestamp(F.concat_ws(" ", "date", c), F.lit("yyyy-MM-dd HH:mm:ss"))
    out = rows.select(F.col("activity_id").try_cast("long").alias(KEY), at("start").alias("start_ts"), at("end").alias("end_ts"), F.col("confidence").try_cast("double").alias("confidence"))
    out = out.withColumn("end_ts", F.when(F.col("end_ts") < F.col("start_ts"), F.col("end_ts") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("end_ts")))
    return out.filter(F.col("start_ts").isNotNull() & F.col("end_ts").isNotNull() & (F.col("confidence") >= least_confidence))


METRICS = ("moving_s", "km", "mean_hr", "mean_kmh", "mean_power", "mean_cadence", "ef")
#: What A16 adds to a side: shares and minutes of zones.
ZONE_METRICS = tuple(f"{z.lower()}_{what}" for z in ZONES for what in ("pct", "min"))


def sides(records: DataFrame, stops: DataFrame) -> DataFrame:
    """The rows of an activity before and after each of its stops, with stop_id and side. Each stop takes the activity's rows once."""
    s = stops.select(KEY, "stop_id", "start_t", "end_t")
    side = F.when(F.col("t") < F.col("start_t"), "before").when(F.col("t") > F.col("end_t"), "after")
    return records.join(s, KEY).withColumn("side", side).filter("side IS NOT NULL").drop("start_t", "end_t")


def performance(records: DataFrame, stops: DataFrame, profile: Profile = DEFAULT, full: bool = False, zone_digits: int | None = 2) -> DataFrame:
    """D-44: each side of every stop over the whole activity: moving time (steps under 30 s, the first 1 s), distance, means of
    plausible values, efficiency; before_, after_ and delta_ columns where both sides have 5 rows. full (records as with_zones()
    gives them) adds shares and minutes of zones (A16: rows without a zone do not count, those over the last zone only in the
    whole), cardiac drift and greatest heart-rate drop of each side, with deltas of the zones. zone_digits None: zones are not rounded."""
    e = edges(records, stops, profile, _SIDES, full)
    e = _with_span(_with_span(e, records, "before_m", "first", "side_end"), records, "after_m", "side_begin", "last")
    c, key = F.col, [KEY, "stop_id"]
    stretch = {"before": (c("first"), c("side_end")), "after": (c("side_begin"), c("last"))}
    # The first row of a side counts a second, whatever came before it.
    first = {"before": F.lit(0.0), "after": 1 - c("side_begin.next._moving")}
    e = e.filter((_n("rows", *stretch["before"]) >= 5) & (_n("rows", *stretch["after"]) >= 5))
    m = {}
    for side, ends in stretch.items():
        m |= {
            f"{side}_moving_s": _sum("moving", *ends) + first[side],
            f"{side}_km": c(f"{side}_m") / 1000,
            f"{side}_mean_hr": _mean("pulse", *ends),
            f"{side}_mean_kmh": _mean("pace", *ends) * 3.6,
            f"{side}_mean_power": _mean("power", *ends),
            f"{side}_mean_cadence": _mean("spin", *ends),
            f"{side}_ef": _mean("power", *ends) / _mean("pulse", *ends),
        }
    compared = list(METRICS)
    if full:
        cut = lambda x: x if zone_digits is None else F.bround(F.round(x, 9), zone_digits)
        for side, ends in stretch.items():
            for z in ZONES:
                share = F.nullif(_n(z, *ends), F.lit(0)) / F.nullif(_n("zoned", *ends), F.lit(0)) * 100
                m |= {f"{side}_{z.lower()}_pct": cut(share), f"{side}_{z.lower()}_min": cut(m[f"{side}_moving_s"] / 60 * F.coalesce(share, F.lit(0.0)) / 100)}
        compared += ZONE_METRICS
    wide = e.select(*key, *(x.alias(n) for n, x in m.items()))
    wide = wide.withColumns({f"delta_{x}": c(f"after_{x}") - c(f"before_{x}") for x in compared})
    if not full:
        return wide
    from stridelake.operators.activity import drift_and_drop_of_sides

    both = drift_and_drop_of_sides(records, stops, profile=profile)
    pick = lambda s, x: F.max(F.when(c("side") == s, c(x))).alias(f"{s}_{x}")
    return wide.join(both.groupBy(*key).agg(*(pick(s, x) for s in stretch for x in ("cardiac_drift", "max_hr_drop"))), key, "left")


def in_any_area(lat: Column, lon: Column, areas: list[tuple[float, float, float]]) -> Column:
    """Whether a point lies in a circle (latitude, longitude, metres) of a list; false for null."""
    out = F.lit(False)
    for a, b, metres in areas:
        out = out | F.coalesce(haversine_m(lat, lon, F.lit(a), F.lit(b)) <= metres, F.lit(False))
    return out
