"""Measures of single activities: from summary rows (one for each activity) and from record streams (see stops.py for their columns)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridelake.functions import rolling as R
from stridelake.functions.scalars import hr_zone, is_cardio, is_cycling, moving_speed, sport_matches, trimp_increment
from stridelake.profile import DEFAULT, Profile
from stridelake.sources.tables import dealt_again

KEY = "activity_id"
VAM_SPORTS = "hiking|walking|running|cycling|biking"


def _order():
    return Window.partitionBy(KEY).orderBy("idx")


# --- summary rows -------------------------------------------------------------------------------------------------------


def vam(duration: Column, ascent: Column, km: Column, uphill: Column, sport: Column) -> Column:
    """D-9: metres climbed an hour, for climbing sports with enough ascent, time and slope; null else. No distance counts as 0."""
    minutes = F.when(uphill > 0, uphill).otherwise(duration / 2)
    slope = ascent / (F.coalesce(km, F.lit(0.0)) * 1000 + 1e-5)
    return F.when(sport_matches(sport, VAM_SPORTS) & (ascent > 50) & (duration > 15) & (slope > 0.04), ascent / (minutes / 60))


def fueling(profile: Profile = DEFAULT) -> dict[str, Column]:
    """D-15: kilocalories of fat and carbohydrate by zone minutes, and their grams."""
    zone = lambda z: F.coalesce(F.col(z), F.lit(0.0)) * profile.kcal_per_min[z]
    fat = sum((zone(z) * profile.fat_share[z] for z in profile.fat_share), F.lit(0.0))
    carb = sum((zone(z) * (1 - profile.fat_share[z]) for z in profile.fat_share), F.lit(0.0))
    return {"fat_kcal": fat, "carb_kcal": carb, "fat_g": fat / 9, "carb_g": carb / 4}


def fluid_loss_l(duration: Column, temp: Column) -> Column:
    """D-16."""
    return duration / 60 * (0.6 + F.greatest(F.lit(0.0), F.coalesce(temp, F.lit(20.0)) - 20) * 0.1)


def epoc_score(z4: Column, z5: Column) -> Column:
    """D-20."""
    return 2 * F.coalesce(z4, F.lit(0.0)) + 5 * F.coalesce(z5, F.lit(0.0))


def recovery_hours(trimp: Column) -> Column:
    """F-m7."""
    return F.least(F.lit(96.0), 0.08 * F.pow(F.coalesce(trimp, F.lit(0.0)), F.lit(1.2)))


def climb_score(ascent: Column, km: Column) -> Column:
    """D-25: metres climbed in a hundred, two decimals."""
    return F.bround(F.round(ascent / F.nullif(km * 1000, F.lit(0.0)) * 100, 9), 2)


def climb_category(score: Column) -> Column:
    """P18."""
    return F.when(score.isNull(), "").when(score < 1, "Flat").when(score < 3, "Rolling").when(score < 6, "Hilly").otherwise("Mountainous")


def temperature_effect(activities: DataFrame) -> DataFrame:
    """D-17: mean drift of hot (over 25 degrees) and cool activities of each athlete, where there are 3 of each, and the difference."""
    hot = F.coalesce(F.col("avg_temp") > 25, F.lit(False))
    known = activities.filter("drift IS NOT NULL")
    g = known.groupBy("athlete_id").agg(F.count_if(hot).alias("n_hot"), F.count_if(~hot).alias("n_cool"), F.avg(F.when(hot, F.col("drift"))).alias("_h"), F.avg(F.when(~hot, F.col("drift"))).alias("_c"))
    enough = (F.col("n_hot") >= 3) & (F.col("n_cool") >= 3)
    return g.select("athlete_id", "n_hot", "n_cool", F.when(enough, F.col("_h")).alias("drift_hot"), F.when(enough, F.col("_c")).alias("drift_cool"), F.when(enough, F.col("_h") - F.col("_c")).alias("temp_effect"))


def critical_hr(activities: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """D-24: the 85th percentile of mean heart rates over efforts of 30 minutes (at most 85 % of the greatest rate, which stands in
    without such efforts) as critical rate of each athlete with 5 cardio efforts of 20 minutes; and minutes above it, weighted."""
    cap = 0.85 * profile.max_hr
    cardio = activities.filter(sport_matches(F.col("sport"), "cycl|bik|run") & (F.col("avg_hr").isNotNull()) & (F.col("duration_minutes") >= 20))
    g = cardio.groupBy("athlete_id").agg(F.count("*").alias("_n"), F.percentile(F.when(F.col("duration_minutes") >= 30, F.col("avg_hr")), F.lit(0.85)).alias("_q"))
    rate = g.select("athlete_id", F.when(F.col("_n") >= 5, F.floor(F.least(F.coalesce("_q", F.lit(cap)), F.lit(cap)))).cast("long").alias("critical_hr"))
    z4_lo = round(0.82 * (profile.max_hr - profile.resting_hr) + profile.resting_hr)
    z5_lo = profile.zones["Z4"][1]
    z4_mid, z5_mid = (z4_lo + z5_lo) / 2, (z5_lo + profile.max_hr) / 2
    over = lambda mid: F.greatest(F.lit(0.0), F.lit(mid) - F.col("critical_hr"))
    out = activities.join(rate, "athlete_id", "left")
    return out.withColumn("tati", F.coalesce("z4", F.lit(0.0)) * over(z4_mid) + F.coalesce("z5", F.lit(0.0)) * over(z5_mid))


# --- record streams -----------------------------------------------------------------------------------------------------


STOPS, STARTS = ("stop", "stop_disable", "stop_disable_all"), ("start", "start_data")


def pauses(events: DataFrame) -> DataFrame:
    """activity_id, start_t, end_t of the pauses that timer events (activity_id, t, event, event_type) tell: from a stop to the next
    start; of stops in a row the last counts, a start without a stop before it says nothing. At one time stops come first."""
    kind = F.when(F.lower("event_type").isin(*STOPS), 0).when(F.lower("event_type").isin(*STARTS), 1)
    timer = events.filter((F.lower("event") == "timer") & F.col("t").isNotNull()).withColumn("_kind", kind).filter("_kind IS NOT NULL")
    order = Window.partitionBy(KEY).orderBy("t", "_kind")
    told = timer.withColumns({"_before": F.lag("_kind").over(order), "start_t": F.lag("t").over(order)})
    return told.filter("_kind = 1 AND _before = 0").select(KEY, "start_t", F.col("t").alias("end_t"))


def with_pauses(records: DataFrame, paused: DataFrame) -> DataFrame:
    """P5: records with in_pause: whether t lies in a pause of the activity, both ends included. Pauses follow one another, so the last
    one begun tells: records and pauses are sorted together, and nothing is multiplied."""
    rows = records.withColumns({"_end": F.lit(None).cast("long"), "_record": F.lit(1)})
    marks = paused.select(KEY, F.col("start_t").alias("t"), F.col("end_t").cast("long").alias("_end"), F.lit(0).alias("_record"))
    upto = Window.partitionBy(KEY).orderBy("t", "_record").rowsBetween(Window.unboundedPreceding, 0)
    both = dealt_again(rows.unionByName(marks, allowMissingColumns=True), KEY).withColumn("_open", F.max("_end").over(upto))
    return both.filter("_record = 1").withColumn("in_pause", F.coalesce(F.col("t") <= F.col("_open"), F.lit(False))).drop("_end", "_record", "_open")


def with_zones(records: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """Heart rate interpolated over 15 rows, zone, seconds of the row, activity and impulse of each record. A
    record in a pause is not active (where records have in_pause, see with_pauses())."""
    filled = R.with_interpolated(records, "hr", "idx", [KEY], 15, "hr_filled", "t", "dt").withColumn("hr_filled", F.bround("hr_filled", 0).cast("int"))
    out = filled.withColumn("zone", hr_zone(F.col("hr_filled"), profile))
    moving = F.coalesce(F.col("speed") > moving_speed(F.col("sport"), profile), F.lit(False))
    paused = F.col("in_pause") if "in_pause" in records.columns else F.lit(False)
    out = out.withColumn("is_active", (moving | ~F.col("zone").isin("Z1", "")) & ~paused)
    return out.withColumn("trimp", F.when(F.col("is_active"), trimp_increment(F.col("hr_filled"), F.col("dt"), profile)).otherwise(0.0))


#: Greatest plausible speeds, km/h (momentary, mean), by kind of sport: fixed values.
CAPS = {"cycling|biking": (100.0, 60.0), "running|trail|soccer|football|hiking|walking|fitness|gym|swim": (35.0, 30.0), "": (45.0, 40.0)}


def capped(summary: DataFrame) -> DataFrame:
    """max_speed_kmh and avg_speed_kmh are null over the caps of the sport; distance_km is null where the mean is, or where the
    distance over duration_minutes is over the cap of the mean."""
    (fast, fast_caps), (slow, slow_caps), (_, other_caps) = CAPS.items()
    cap = lambda i: F.when(sport_matches(F.col("sport"), fast), fast_caps[i]).when(sport_matches(F.col("sport"), slow), slow_caps[i]).otherwise(other_caps[i])
    over = lambda x, i: F.coalesce(x > cap(i), F.lit(False))
    implied = F.when(F.col("duration_minutes") > 0, F.col("distance_km") / (F.col("duration_minutes") / 60))
    return summary.withColumns({
        "max_speed_kmh": F.when(~over(F.col("max_speed_kmh"), 0), F.col("max_speed_kmh")),
        "avg_speed_kmh": F.when(~over(F.col("avg_speed_kmh"), 1), F.col("avg_speed_kmh")),
        "distance_km": F.when(~over(F.col("avg_speed_kmh"), 1) & ~over(implied, 1), F.col("distance_km")),
    })


def activity_summary(records: DataFrame, events: DataFrame, sessions: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """D-27 from messages: the roll-up of records, with the pauses of the timer events, the distance, mean speed and training effects
    of the sessions (activity_id, sport, distance_m, avg_speed, te_aerobic, te_anaerobic), a duration that falls back from active
    seconds to minutes in zones to rows (A6), caps (P12), and effects from the load where the device has none (F-m11)."""
    z = with_zones(with_pauses(records, pauses(events)), profile)
    z = z.withColumns({"_up": F.col("altitude") - F.lag("altitude").over(_order()), "_moves": F.coalesce(F.col("speed") > 0, F.lit(False))})
    z = z.withColumn("_smooth", R.rolling_median3("speed", [KEY, "_moves"], ["idx"]))
    active, c = F.col("is_active"), F.col
    seconds = lambda cond: F.sum(F.when(cond, c("dt")).otherwise(0.0))
    g = z.groupBy(KEY).agg(
        F.count("*").alias("records_count"),
        F.count_if("in_pause").alias("paused_records"),
        F.sum("trimp").alias("total_trimp"),
        F.bround(F.round(F.avg("hr_filled"), 9), 0).cast("long").alias("avg_hr"),
        F.least(F.max("hr_filled"), F.lit(profile.max_hr)).cast("long").alias("max_hr"),
        *((seconds(active & c("zone").isin(n, n + "+")) / 60).alias(n.lower()) for n in profile.zones),
        seconds(active).alias("_active"),
        (seconds(active & (c("zone") != "")) / 60).alias("_zones"),
        (seconds(active & (c("_up") > 0) & (c("speed") > 0)) / 60).alias("uphill_minutes"),
        F.bround(F.round(F.percentile(F.when(c("_moves"), c("_smooth")), F.lit(0.99)) * 3.6, 9), 2).alias("max_speed_kmh"),
    )
    duration = F.when(c("_active") > 0, c("_active") / 60).when(c("_zones") > 0, c("_zones")).otherwise(c("records_count") / 60)
    km = F.bround(F.round(c("distance_m") / 1000, 9), 3)
    out = g.join(sessions, KEY, "left").withColumns({"duration_minutes": duration, "distance_km": km, "avg_speed_kmh": F.bround(F.round(c("avg_speed") * 3.6, 9), 2)})
    effect = lambda device, load, scale: F.coalesce(device, F.when(load > 0, F.bround(F.round(F.least(F.lit(5.0), 5 * (1 - F.exp(-load / scale))), 9), 1)))
    out = out.withColumns({"te_aerobic": effect(c("te_aerobic"), c("total_trimp"), 50), "te_anaerobic": effect(c("te_anaerobic"), c("z4") + c("z5"), 20)})
    return capped(out).drop("_active", "_zones", "distance_m", "avg_speed")


def roll_up(records: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """D-27: one row for each activity from its records: counts, impulse, heart rates, minutes by zone, active minutes, robust
    greatest speed (99th percentile of 3-row medians), distance, ascent, uphill minutes."""
    z = with_zones(records, profile)
    median = R.rolling_median3("speed", [KEY], ["idx"])
    step = F.col("altitude") - F.lag("altitude").over(_order())
    z = z.withColumns({"_smooth": median, "_up": step})
    minutes = lambda names: F.sum(F.when(F.col("is_active") & F.col("zone").isin(*names), F.col("dt")).otherwise(0.0)) / 60
    return z.groupBy(KEY).agg(
        F.count("*").alias("records_count"),
        F.sum("trimp").alias("total_trimp"),
        F.bround(F.round(F.avg(F.when(F.col("hr_filled") > 0, F.col("hr_filled"))), 9), 0).cast("long").alias("avg_hr"),
        F.max(F.when(F.col("hr_filled").isNotNull(), F.least("hr_filled", F.lit(profile.max_hr)))).cast("long").alias("max_hr"),
        *(minutes([n, n + "+"]).alias(n.lower()) for n in profile.zones),
        (F.sum(F.when(F.col("is_active"), F.col("dt")).otherwise(0.0)) / 60).alias("active_minutes"),
        (F.percentile(F.when(F.col("_smooth") > 0, F.col("_smooth")), F.lit(0.99)) * 3.6).alias("max_speed_kmh"),
        ((F.max("distance") - F.min("distance")) / 1000).alias("distance_km"),
        F.coalesce(F.sum(F.when(F.col("_up") > 0, F.col("_up"))), F.lit(0.0)).alias("ascent_m"),
        (F.coalesce(F.sum(F.when(F.col("_up") > 0, F.col("dt"))), F.lit(0.0)) / 60).alias("uphill_minutes"),
    )


def _halves(records: DataFrame, effort: Column, profile: Profile, key: list[str]) -> DataFrame:
    """Efforts a heart beat in the first and second half (by time) of the rows of each key, with their count and span."""
    ends = Window.partitionBy(*key)
    rows = records.withColumn("_e", effort).withColumns({"_lo": F.min("t").over(ends), "_hi": F.max("t").over(ends), "_n": F.count("*").over(ends)})
    first = F.col("t") <= (F.col("_lo") + F.col("_hi")) / 2
    ratio = lambda side: F.avg(F.when(side, F.col("_e"))) / F.avg(F.when(side, F.col("hr")))
    mean = lambda side: F.avg(F.when(side, F.col("_e")))
    return rows.groupBy(*key).agg(F.first("_n").alias("n"), (F.first("_hi") - F.first("_lo")).alias("span_s"), ratio(first).alias("ef1"), ratio(~first).alias("ef2"), mean(first).alias("m1"), mean(~first).alias("m2"), F.first("cycling").alias("cycling"))


def _efforts(records: DataFrame) -> tuple[DataFrame, Column]:
    """Rows that move with a heart rate and an effort: power in cycling, speed else."""
    marked = records.withColumn("cycling", is_cycling(F.col("sport")))
    effort, moving = _effort(F.col("cycling"))
    return marked.filter(moving), effort


def _effort(cycling: Column) -> tuple[Column, Column]:
    """The effort of a row, and whether it moves with one and a heart rate."""
    effort = F.when(cycling, F.col("power")).otherwise(F.col("speed"))
    moving = F.coalesce(F.col("speed") > moving_speed(F.col("sport")), F.lit(False)) | (F.coalesce("hr", F.lit(0.0)) > DEFAULT.zones["Z1"][1])
    return effort, moving & (F.col("hr") > 0) & (effort > 0)


def cardiac_drift(records: DataFrame, profile: Profile = DEFAULT, key: tuple[str, ...] = (KEY,)) -> DataFrame:
    """D-1: percent by which effort a beat falls from the first to the second half, after the warm-up. Null where there are under
    20 rows, the effort is slight, or (not cycling) the ground is hilly; elsewhere on foot only easy zones count."""
    rows, effort = _efforts(records)
    whole = Window.partitionBy(*key)
    rows = rows.withColumns({"_first": F.min("t").over(whole), "_rows": F.count("*").over(whole)}).filter(F.col("_rows") >= 20)
    rows = rows.filter(F.col("t") >= F.col("_first") + profile.warmup_s)
    rows = rows.withColumns({"_rows": F.count("*").over(whole), "_range": F.max("altitude").over(whole) - F.min("altitude").over(whole), "_alts": F.count("altitude").over(whole)}).filter(F.col("_rows") >= 20)
    hilly = (F.col("_alts") >= 10) & (F.col("_range") > profile.drift_max_altitude)
    easy = hr_zone(F.col("hr").cast("int"), profile).isin("Z1", "Z2", "")
    rows = rows.filter(F.col("cycling") | (~F.coalesce(hilly, F.lit(False)) & easy))
    h = _halves(rows, effort, profile, list(key)).filter("n >= 20")
    least = F.when(F.col("cycling"), 30.0).otherwise(2 / 3.6)
    good = (F.col("m1") >= least) & (F.col("m2") >= least)
    return h.select(*key, F.bround(F.round(F.when(good, (F.col("ef1") - F.col("ef2")) / F.col("ef1") * 100), 9), 2).alias("cardiac_drift"))


def durability(records: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """D-18: percent by which effort a beat changes from the first to the second half of activities of two hours."""
    rows, effort = _efforts(records)
    h = _halves(rows, effort, profile, [KEY]).filter((F.col("n") >= 20) & (F.col("span_s") >= profile.durability_min * 60))
    least = F.when(F.col("cycling"), 30.0).otherwise(0.56)
    good = (F.col("m1") >= least) & (F.col("m2") >= least)
    return h.select(KEY, F.bround(F.round(F.when(good, (F.col("ef2") / F.col("ef1") - 1) * 100), 9), 2).alias("durability"))


def resampled_hr(records: DataFrame, limit_s: int = 30, key: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Heart rates at every second by linear interpolation over at most limit_s seconds into a gap; key, t, hr, n (place)."""
    times = records.filter("hr IS NOT NULL").groupBy(*key, "t").agg(F.avg("hr").alias("hr"))
    by_t = Window.partitionBy(*key).orderBy("t")
    pairs = times.withColumns({"_t": F.lead("t").over(by_t), "_hr": F.lead("hr").over(by_t)})
    until = F.least(F.coalesce(F.col("_t") - 1, F.col("t")), F.col("t") + limit_s)
    dense = pairs.withColumn("_s", F.explode(F.sequence("t", until)))
    value = F.col("hr") + F.coalesce((F.col("_hr") - F.col("hr")) * (F.col("_s") - F.col("t")) / (F.col("_t") - F.col("t")), F.lit(0.0))
    return dense.select(*key, F.col("_s").alias("t"), value.alias("hr")).withColumn("n", F.row_number().over(by_t))


def _best_drop(d: Column, values: Column, n: Column, samples: int) -> Column:
    return F.when((values >= 60) & (n >= samples + 1), F.bround(F.round(d, 9), 1)).alias("max_hr_drop")


def by_second(t: np.ndarray, hr: np.ndarray, limit_s: int) -> np.ndarray:
    """resampled_hr() of one activity: its heart rates at times (distinct, in order) at every second."""
    seconds = np.minimum(np.diff(t, append=t[-1] + 1) - 1, limit_s) + 1
    at = np.repeat(np.arange(len(t)), seconds)
    into = np.arange(len(at)) - np.repeat(np.cumsum(seconds) - seconds, seconds)
    return hr[at] + np.diff(hr, append=hr[-1])[at] * into / np.diff(t, append=t[-1] + 1)[at]


def falls(hr: np.ndarray, samples: int, profile: Profile = DEFAULT) -> np.ndarray:
    """How far heart rates by second fall over the next `samples`, at every second that has them; -inf where that does not count."""
    if len(hr) <= samples:
        return np.empty(0)
    drop = hr[:-samples] - hr[samples:]
    jumps = np.concatenate([[0], np.cumsum(~(hr[:-3] - hr[3:] <= profile.max_jump))])
    calm = jumps[samples - 2 :][: len(drop)] == jumps[: len(drop)]
    return np.where((hr[:-samples] >= profile.min_start_hr) & (drop > 0) & (drop <= profile.max_drop) & calm, drop, -np.inf)


def greatest_fall(hr: np.ndarray, samples: int, profile: Profile = DEFAULT) -> float | None:
    """The greatest fall of max_hr_drop() in heart rates by second, not rounded."""
    most = falls(hr, samples, profile).max(initial=-np.inf)
    return float(most) if most > -np.inf else None


def max_hr_drop(records: DataFrame, samples: int = 60, profile: Profile = DEFAULT, key: tuple[str, ...] = (KEY,)) -> DataFrame:
    """D-2: the greatest fall of the heart rate over 60 samples from 110 on, not over 90, without a fall over 30 in 3 samples; one
    decimal. Null where there are under 60 values or 61 samples. Times and heart rates of an activity meet as arrays; the row a
    second is one of an array while its activity is looked at, and no row of a table."""

    @F.pandas_udf("struct<n long, d double>")
    def fallen(t: pd.Series, hr: pd.Series) -> pd.DataFrame:
        out = []
        for when, rate in zip(t, hr, strict=True):
            dense = by_second(when, rate, 30) if len(when) else rate
            out.append((len(dense), greatest_fall(dense, samples, profile) if len(dense) > samples else None))
        return pd.DataFrame(out, columns=["n", "d"])

    times = records.filter("t IS NOT NULL").groupBy(*key, "t").agg(F.avg("hr").alias("hr"), F.count("hr").alias("values"))
    at = F.sort_array(F.collect_list(F.when(F.col("hr").isNotNull(), F.struct(F.col("t").cast("long").alias("t"), "hr"))))
    whole = times.groupBy(*key).agg(at.alias("x"), F.sum("values").alias("values"))
    told = whole.withColumn("f", fallen(F.transform("x", lambda x: x["t"]), F.transform("x", lambda x: x["hr"])))
    return told.select(*key, _best_drop(F.col("f.d"), F.col("values"), F.col("f.n"), samples))


def max_hr_drop_of_sides(records: DataFrame, stops: DataFrame, samples: int = 60, profile: Profile = DEFAULT) -> DataFrame:
    """max_hr_drop() of the rows before and after each stop: activity_id, stop_id, side, max_hr_drop; no row for a side without records."""
    return drift_and_drop_of_sides(records, stops, samples, profile).drop("cardiac_drift")


def drift_and_drop_of_sides(records: DataFrame, stops: DataFrame, samples: int = 60, profile: Profile = DEFAULT) -> DataFrame:
    """cardiac_drift() and max_hr_drop() of the rows before and after each stop: activity_id, stop_id, side, cardiac_drift, max_hr_drop;
    no row for a side without records. What records lack of sport, speed, power and altitude counts as null.

    Records and stops of an activity meet as arrays (see _drops_of_sides() and _drifts_of_sides()), so neither seconds nor the records of
    each side are rows of a table."""
    have = set(records.columns)
    rows = records.filter("t IS NOT NULL").withColumns({x: F.lit(None).cast("string" if x == "sport" else "double") for x in ("sport", "speed", "power", "altitude") if x not in have})
    cycling = is_cycling(F.col("sport"))
    effort, moving = _effort(cycling)
    easy = hr_zone(F.col("hr").cast("int"), profile).isin("Z1", "Z2", "")
    double = lambda x, name: x.cast("double").alias(name)
    row = F.struct(F.col("t").cast("long").alias("t"), double(F.col("hr"), "hr"), double(F.when(moving, effort), "effort"), double(F.col("altitude"), "altitude"), cycling.alias("cycling"), easy.alias("easy"))
    stop = F.struct(*(F.col(x).cast("long").alias(x) for x in ("stop_id", "start_t", "end_t")))
    whole = rows.groupBy(KEY).agg(F.collect_list(row).alias("rows")).join(stops.groupBy(KEY).agg(F.collect_list(stop).alias("stops")), KEY)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _sides_told(batch, samples, profile)

    out = whole.mapInArrow(told, T.StructType([whole.schema[KEY], *T.StructType.fromDDL("stop_id long, side string, n long, known long, drift double, drop double")]))
    return out.select(KEY, "stop_id", "side", F.bround(F.round("drift", 9), 2).alias("cardiac_drift"), _best_drop(F.col("drop"), F.col("known"), F.col("n"), samples))


def _sides_told(batch: pa.RecordBatch, samples: int, profile: Profile) -> pa.RecordBatch:
    """Two rows for each stop of a batch of activities (id, rows, stops), before and after it, without sides that have no rows."""
    rows, stops = batch.column(1), batch.column(2)
    field = lambda x, name: x.values.field(name)
    value = {n: field(rows, n).to_numpy(zero_copy_only=False) for n in ("t", "hr", "effort", "altitude", "cycling")}
    # A row that moves has a heart rate, and so a zone.
    has = {n: field(rows, n).is_valid().to_numpy(zero_copy_only=False) for n in ("hr", "effort", "altitude")}
    value["easy"] = field(rows, "easy").fill_null(False).to_numpy(zero_copy_only=False)
    stop_id, start_t, end_t = (field(stops, n).to_numpy(zero_copy_only=False) for n in ("stop_id", "start_t", "end_t"))
    found: list[list[np.ndarray]] = []
    for i, (r0, r1, s0, s1) in enumerate(zip(rows.offsets[:-1].to_pylist(), rows.offsets[1:].to_pylist(), stops.offsets[:-1].to_pylist(), stops.offsets[1:].to_pylist(), strict=True)):
        t = value["t"][r0:r1]
        order = np.arange(r0, r1) if (np.diff(t) >= 0).all() else r0 + np.argsort(t, kind="stable")
        t = value["t"][order]
        known = order[has["hr"][order]]
        n, values, drop = _drops_of_sides(value["t"][known], value["hr"][known], start_t[s0:s1], end_t[s0:s1], samples, profile)
        moving = order[has["effort"][order]]
        drift = _drifts_of_sides(*(value[x][moving] for x in ("t", "hr", "effort", "altitude")), has["altitude"][moving], value["cycling"][moving], value["easy"][moving], start_t[s0:s1], end_t[s0:s1], profile)
        some = np.concatenate([np.searchsorted(t, start_t[s0:s1]) > 0, np.searchsorted(t, end_t[s0:s1], "right") < len(t)])
        side = np.repeat([True, False], s1 - s0)
        found.append([x[some] for x in (np.full(len(some), i), np.tile(stop_id[s0:s1], 2), side, n, values, drift, drop)])
    activity, stop, early, n, values, drift, drop = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, t) for t in ("i8", "i8", "?", "i8", "i8", "f8", "f8"))
    side = pa.array(np.where(early, "before", "after"), pa.string())
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(activity)), pa.array(stop), side, pa.array(n), pa.array(values), pa.array(drift, mask=np.isnan(drift)), pa.array(drop, mask=~np.isfinite(drop))],
        names=[batch.schema.names[0], "stop_id", "side", "n", "known", "drift", "drop"],
    )


def _drops_of_sides(t: np.ndarray, hr: np.ndarray, start: np.ndarray, end: np.ndarray, samples: int, profile: Profile) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the sides before, then after all stops of an activity: samples by second, heart rates (at times in order), greatest fall.

    A side is the begin or the end of its activity, and its samples are those of the whole up to its last heart rate or from its first
    one. So running maxima over the whole, from either end, are read off at the stops."""
    if not len(t):
        none = np.zeros(2 * len(start), "i8")
        return none, none, np.full(len(none), -np.inf)
    first = np.flatnonzero(np.diff(t, prepend=t[0] - 1))
    times, count = t[first], np.diff(first, append=len(t))
    dense = by_second(times, np.add.reduceat(hr, first) / count, 30)
    place = np.cumsum(np.minimum(np.diff(times, append=times[-1] + 1) - 1, 30) + 1)  # samples up to the next heart rate
    fall, counted = falls(dense, samples, profile), np.concatenate([[0], np.cumsum(count)])
    up, down = np.maximum.accumulate(fall), np.maximum.accumulate(fall[::-1])  # by samples from the begin, and from the end
    # The last heart rate of a side before is its last sample.
    a, b = np.searchsorted(times, start), np.searchsorted(times, end, "right")
    begins = np.concatenate([[0], place])
    n = np.concatenate([np.where(a > 0, begins[np.maximum(a, 1) - 1] + 1, 0), begins[-1] - begins[b]])
    values = np.concatenate([counted[a], counted[-1] - counted[b]])
    enough = n > samples
    drop = np.full(len(n), -np.inf)
    for half, run in ((slice(0, len(a)), up), (slice(len(a), None), down)):
        drop[half][enough[half]] = run[n[half][enough[half]] - samples - 1]
    return n, values, drop


def _drifts_of_sides(t: np.ndarray, hr: np.ndarray, effort: np.ndarray, altitude: np.ndarray, has_altitude: np.ndarray, cycling: np.ndarray, easy: np.ndarray, start: np.ndarray, end: np.ndarray, profile: Profile) -> np.ndarray:
    """cardiac_drift(), not rounded, of the sides before, then after all stops of an activity, from its rows that move, in order of time. A
    side is a stretch of them; so is what is left of it after the warm-up. NaN where there is none."""
    lo, hi = np.concatenate([np.zeros(len(start), "i8"), np.searchsorted(t, end, "right")]), np.concatenate([np.searchsorted(t, start), np.full(len(end), len(t))])
    out = np.full(len(lo), np.nan)
    sides = np.flatnonzero(hi - lo >= 20)
    warm, hi = np.searchsorted(t, t[lo[sides]] + profile.warmup_s), hi[sides]
    enough = hi - warm >= 20
    sides, warm, hi = sides[enough], warm[enough], hi[enough]
    if not len(sides):
        return out
    high, low = _stretches(np.maximum, np.where(has_altitude, altitude, -np.inf), warm, hi), _stretches(np.minimum, np.where(has_altitude, altitude, np.inf), warm, hi)
    hilly = (_stretches(np.add, has_altitude.astype("i8"), warm, hi) >= 10) & ~(high - low <= profile.drift_max_altitude)
    for rough in (False, True):
        kept = np.flatnonzero(cycling if rough else cycling | easy)
        mine = np.flatnonzero(hilly == rough)
        a, b = np.searchsorted(kept, warm[mine]), np.searchsorted(kept, hi[mine])
        enough = b - a >= 20
        mine, a, b = sides[mine[enough]], a[enough], b[enough]
        if not len(mine):
            continue
        when, e, h = t[kept], effort[kept], hr[kept]
        half = np.minimum(np.searchsorted(when, (when[a] + when[b - 1]) / 2, "right"), b)
        both = half < b
        mine, a, half, b = mine[both], a[both], half[both], b[both]
        m1, m2 = _stretches(np.add, e, a, half) / (half - a), _stretches(np.add, e, half, b) / (b - half)
        ef1, ef2 = m1 / (_stretches(np.add, h, a, half) / (half - a)), m2 / (_stretches(np.add, h, half, b) / (b - half))
        least = np.where(cycling[kept[a]], 30.0, 2 / 3.6)
        out[mine] = np.where((m1 < least) | (m2 < least), np.nan, (ef1 - ef2) / ef1 * 100)
    return out


def _stretches(f: np.ufunc, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """f over x[a:b] for every stretch (none is empty); they may overlap."""
    return f.reduceat(np.append(x, x[-1:]), np.stack([a, b], 1).ravel())[::2]


def low_hrv_bin(records: DataFrame) -> DataFrame:
    """D-21 (a): activity_id and the lowest 5-bpm bin (3 values at least) whose mean HRV is under half of the best bin's; null with
    under 4 bins, or not over 60 values and 100 pairs."""
    known = records.filter("hr > 0 AND hrv IS NOT NULL").withColumn("bin", (F.floor(F.col("hr") / 5) * 5).cast("long"))
    bins = known.groupBy(KEY, "bin").agg(F.avg("hrv").alias("mean"), F.count("*").alias("n"))
    kept = bins.filter("n >= 3").withColumn("best", F.max("mean").over(Window.partitionBy(KEY)))
    low = kept.groupBy(KEY).agg(F.count("*").alias("bins"), F.min(F.when(F.col("mean") < F.col("best") / 2, F.col("bin"))).alias("low"))
    counts = records.groupBy(KEY).agg(F.count("hrv").alias("values"), F.count_if((F.col("hr") > 0) & F.col("hrv").isNotNull()).alias("pairs"))
    enough = (F.col("values") > 60) & (F.col("pairs") > 100) & (F.col("bins") >= 4)
    return counts.join(low, KEY, "left").select(KEY, F.when(enough, F.col("low")).alias("low"))


def speed_breakpoint(records: DataFrame) -> DataFrame:
    """D-21 (b), W24: activity_id and the mean heart rate (cut to a whole number) after the segment where the slope of heart rate over
    speed rises most, the first of equals. Active rows on flat ground (2 % at most, or unknown) count, 100 at least; 4 segments
    and 3 slopes are needed. records with is_active."""
    by_idx = Window.partitionBy(KEY).orderBy("idx")
    rows = records.filter("is_active AND hr > 0 AND speed > 0.5")
    diff = lambda c: F.col(c) - F.lag(c).over(by_idx)
    rows = rows.withColumns({"_n0": F.count("*").over(Window.partitionBy(KEY)), "_gradient": diff("altitude") / F.nullif(diff("distance"), F.lit(0.0)) * 100})
    flat = rows.filter((F.col("_n0") >= 100) & F.coalesce(F.abs("_gradient") <= 2, F.lit(True))).drop("_n0", "_gradient")
    by_segment = Window.partitionBy(KEY).orderBy("segment")
    steps = speed_segments(flat).withColumn("hr_after", F.lead("hr").over(by_segment)).filter("slope IS NOT NULL")
    steps = steps.withColumn("change", F.lead("slope").over(by_segment) - F.col("slope"))
    best = F.max_by("hr_after", F.when(F.col("change").isNotNull(), F.struct("change", -F.col("segment"))))
    g = steps.groupBy(KEY).agg(F.count("*").alias("_slopes"), F.floor(best).cast("long").alias("hr"))
    return g.select(KEY, F.when(F.col("_slopes") >= 3, F.col("hr")).alias("breakpoint_hr"))


def threshold_proxy(records: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """D-21: the aerobic threshold from a low HRV bin, if that is 130 at least (null if it is over 80 % of the greatest rate); else
    from the breakpoint of heart rate over speed, between these. records with is_active."""
    cap = 0.8 * profile.max_hr
    out = low_hrv_bin(records).join(speed_breakpoint(records), KEY, "left")
    other = F.when(F.col("breakpoint_hr").between(130, cap), F.col("breakpoint_hr"))
    return out.select(KEY, F.when(F.col("low") > cap, None).when(F.col("low") >= 130, F.col("low")).otherwise(other).alias("threshold_hr"))


def speed_segments(records: DataFrame) -> DataFrame:
    """Active rows sorted by speed in k = min(10, n // 20) equal segments (the rest is left out): mean speed, mean heart rate, and the slope to the next."""
    rows = records.filter("speed > 0.5 AND hr > 0")
    by_speed = Window.partitionBy(KEY).orderBy("speed", "idx")
    rows = rows.withColumns({"_rn": F.row_number().over(by_speed) - 1, "_n": F.count("*").over(Window.partitionBy(KEY))})
    k = F.least(F.lit(10), F.floor(F.col("_n") / 20))
    rows = rows.withColumn("_k", k).filter("_n >= 100 AND _k >= 4").withColumn("_size", F.floor(F.col("_n") / F.col("_k")))
    rows = rows.withColumn("segment", F.floor(F.col("_rn") / F.col("_size")).cast("long")).filter("segment < _k")
    g = rows.groupBy(KEY, "segment").agg(F.avg("speed").alias("speed"), F.avg("hr").alias("hr"))
    nxt = Window.partitionBy(KEY).orderBy("segment")
    ds = F.lead("speed").over(nxt) - F.col("speed")
    return g.withColumn("slope", F.when(F.abs(ds) > 0.05, (F.lead("hr").over(nxt) - F.col("hr")) / ds))


def record_measures(records: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """D-1, D-18 and D-21 of every activity in one pass: activity_id, cardiac_drift, durability, aet_hr_proxy. The rules are those of
    cardiac_drift(), durability(), low_hrv_bin() and speed_breakpoint(), each of which reads the records by itself; here each is a
    condition on rows, whose bounds windows over the activity give, and one aggregate ends them all: one scan, one shuffle.
    records as with_zones() gives them."""
    c, whole, by_idx = F.col, Window.partitionBy(KEY), Window.partitionBy(KEY).orderBy("idx")
    cycling = is_cycling(c("sport"))
    effort = F.when(cycling, c("power")).otherwise(c("speed"))
    moving = F.coalesce(c("speed") > moving_speed(c("sport")), F.lit(False)) | (F.coalesce("hr", F.lit(0.0)) > DEFAULT.zones["Z1"][1])
    yes = lambda x: F.coalesce(x, F.lit(False))
    rows = records.select(
        KEY, "idx", "t", "hr", "speed", "altitude", "distance", "hrv", cycling.alias("_cyc"), effort.alias("_e"), yes(moving & (c("hr") > 0) & (effort > 0)).alias("_eff"),
        yes(c("is_active") & (c("hr") > 0) & (c("speed") > 0.5)).alias("_fast"), yes((c("hr") > 0) & c("hrv").isNotNull()).alias("_pair"), (F.floor(c("hr") / 5) * 5).cast("long").alias("_bin"),
        hr_zone(c("hr").cast("int"), profile).isin("Z1", "Z2", "").alias("_easy"),
    )
    over = lambda f, cond, x: f(F.when(cond, x)).over(whole)
    rows = rows.withColumns({
        "_first": over(F.min, c("_eff"), c("t")),
        "_last": over(F.max, c("_eff"), c("t")),
        "_efforts": F.count_if("_eff").over(whole),
        "_quick": F.count_if("_fast").over(whole),
        "_before": F.last(F.when(c("_fast"), F.struct("altitude", "distance")), ignorenulls=True).over(by_idx.rowsBetween(Window.unboundedPreceding, -1)),
    })
    warm = c("_eff") & (c("_efforts") >= 20) & (c("t") >= c("_first") + profile.warmup_s)
    gradient = (c("altitude") - c("_before.altitude")) / F.nullif(c("distance") - c("_before.distance"), F.lit(0.0)) * 100
    rows = rows.withColumns({"_warm": warm, "_flat": c("_fast") & (c("_quick") >= 100) & F.coalesce(F.abs(gradient) <= 2, F.lit(True))})
    rows = rows.withColumns({
        "_warms": F.count_if("_warm").over(whole),
        "_range": over(F.max, c("_warm"), c("altitude")) - over(F.min, c("_warm"), c("altitude")),
        "_heights": F.count(F.when(c("_warm"), c("altitude"))).over(whole),
        "_flats": F.count_if("_flat").over(whole),
    })
    hilly = yes((c("_heights") >= 10) & (c("_range") > profile.drift_max_altitude))
    rows = rows.withColumn("_drift", c("_warm") & (c("_warms") >= 20) & (c("_cyc") | (~hilly & c("_easy"))))
    # Flat rows in k equal segments by speed: numbered among themselves.
    k = F.least(F.lit(10), F.floor(c("_flats") / 20))
    place = F.row_number().over(Window.partitionBy(KEY, "_flat").orderBy("speed", "idx")) - 1
    segment = F.when(c("_flat") & (c("_flats") >= 100) & (k >= 4), F.floor(place / F.floor(c("_flats") / k)).cast("long"))
    in_bin = Window.partitionBy(KEY, "_pair", "_bin")
    rows = rows.withColumns({
        "_from": over(F.min, c("_drift"), c("t")),
        "_to": over(F.max, c("_drift"), c("t")),
        "_segment": F.when(segment < k, segment),
        "_bin_mean": F.avg("hrv").over(in_bin),
        "_bin_rows": F.count("*").over(in_bin),
    })

    def halves(cond: Column, lo: str, hi: str, name: str) -> list[Column]:
        early = c("t") <= (c(lo) + c(hi)) / 2
        mean = lambda side, x: F.avg(F.when(cond & side, x))
        ratio = {f"{name}_r{i}": mean(side, c("_e")) / mean(side, c("hr")) for i, side in ((1, early), (2, ~early))}
        level = {f"{name}_m{i}": mean(side, c("_e")) for i, side in ((1, early), (2, ~early))}
        return [x.alias(n) for n, x in (ratio | level).items()]

    bins = F.collect_set(F.when(c("_pair") & (c("_bin_rows") >= 3), F.struct(c("_bin").alias("bin"), c("_bin_mean").alias("mean"))))  # one for each 5 beats a minute
    part = lambda i, x: F.avg(F.when(c("_segment") == i, c(x)))
    g = rows.groupBy(KEY).agg(
        F.first("_cyc").alias("cyc"), F.count_if("_drift").alias("n_drift"), F.first("_efforts").alias("n_efforts"), (F.first("_last") - F.first("_first")).alias("span"),
        *halves(c("_drift"), "_from", "_to", "d"), *halves(c("_eff"), "_first", "_last", "e"),
        bins.alias("bins"), F.count("hrv").alias("n_values"), F.count_if("_pair").alias("n_pairs"),
        F.array(*(F.struct(part(i, "speed").alias("v"), part(i, "hr").alias("h")) for i in range(10))).alias("segments"),
    )
    change = lambda name, least, x: F.when((c(f"{name}_m1") >= least) & (c(f"{name}_m2") >= least), F.bround(F.round(x, 9), 2))
    drift = change("d", F.when(c("cyc"), 30.0).otherwise(2 / 3.6), (c("d_r1") - c("d_r2")) / c("d_r1") * 100)
    lasting = change("e", F.when(c("cyc"), 30.0).otherwise(0.56), (c("e_r2") / c("e_r1") - 1) * 100)
    best = F.array_max(F.transform("bins", lambda b: b["mean"]))
    low = F.array_min(F.transform(F.filter("bins", lambda b: b["mean"] < best / 2), lambda b: b["bin"]))
    low = F.when((c("n_values") > 60) & (c("n_pairs") > 100) & (F.size("bins") >= 4), low)
    # Slopes of neighbouring segments, and the segment after the slope that rises most to the next (the first of equals).
    g = g.withColumn("segments", F.filter("segments", lambda x: x["v"].isNotNull()))
    steps = F.transform(F.slice("segments", 2, 9), lambda b, i: F.struct((b["v"] - c("segments")[i]["v"]).alias("dv"), (b["h"] - c("segments")[i]["h"]).alias("dh"), b["h"].alias("after"), i.alias("i")))
    g = g.withColumn("slopes", F.transform(F.filter(steps, lambda x: F.abs(x["dv"]) > 0.05), lambda x: F.struct((x["dh"] / x["dv"]).alias("s"), x["after"].alias("after"), x["i"].alias("i"))))
    rises = F.transform(F.slice("slopes", 2, 9), lambda b, i: F.struct((b["s"] - c("slopes")[i]["s"]).alias("change"), (-c("slopes")[i]["i"]).alias("i"), c("slopes")[i]["after"].alias("after")))
    turn = F.when(F.size("slopes") >= 3, F.floor(F.array_max(rises)["after"]).cast("long"))
    cap = 0.8 * profile.max_hr
    proxy = F.when(low > cap, None).when(low >= 130, low).otherwise(F.when(turn.between(130, cap), turn))
    return g.select(
        KEY,
        F.when(c("n_drift") >= 20, drift).alias("cardiac_drift"),
        F.when((c("n_efforts") >= 20) & (c("span") >= profile.durability_min * 60), lasting).alias("durability"),
        proxy.alias("aet_hr_proxy"),
    )


def activity_metrics(activities: DataFrame, records: DataFrame, beats: DataFrame | None = None, profile: Profile = DEFAULT, least_minutes: float = 20) -> DataFrame:
    """D-26: every activity with its measures: fuel, fluid, climb, excess oxygen, recovery and load over critical heart rate of all;
    drift, heart-rate drop, durability and thresholds of cardio activities of at least 20 minutes, from their records (read once for
    all measures by rows and once for the drop), and respiration from beats. records as with_zones() gives them."""
    from stridelake.operators import rr

    eligible = activities.filter(is_cardio(F.col("sport")) & (F.col("duration_minutes") >= least_minutes)).select(KEY)
    rows = records.join(eligible, KEY, "left_semi")
    fuel = fueling(profile)
    c = F.col
    out = critical_hr(activities, profile).withColumns(fuel).withColumns({
        "fluid_loss_l": fluid_loss_l(c("duration_minutes"), c("avg_temp")),
        "vam": vam(c("duration_minutes"), c("ascent_m"), c("distance_km"), c("uphill_minutes"), c("sport")),
        "epoc": epoc_score(c("z4"), c("z5")),
        "recovery_h": recovery_hours(c("total_trimp")),
        "climb_score": climb_score(c("ascent_m"), c("distance_km")),
    })
    out = out.withColumn("climb_category", climb_category(c("climb_score")))
    parts = [record_measures(rows, profile), max_hr_drop(rows, profile=profile)]
    if beats is not None:
        own = beats.join(eligible, KEY, "left_semi")
        parts += [rr.dfa_thresholds(own, profile).select(KEY, "aet_hr", "ant_hr", "quality"), rr.breaths(own)]
        parts[0] = parts[0].withColumn("_measured", F.lit(True))
    for part in parts:
        out = out.join(part, KEY, "left")
    if beats is not None:
        quality = F.when(c("aet_hr").isNotNull(), "real").when(c("aet_hr_proxy").isNotNull(), "proxy").when(c("_measured") | c("quality").isNotNull(), "none")
        out = out.withColumns({"dfa_quality": quality, "aet_hr": F.coalesce("aet_hr", c("aet_hr_proxy").cast("double"))}).drop("_measured", "quality")
    return out
