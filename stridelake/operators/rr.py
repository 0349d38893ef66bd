"""Beat-to-beat intervals: rows of activity_id, beat (number) and rr_ms. An activity's beats, some thousand, meet in a window."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.profile import DEFAULT, Profile

KEY = "activity_id"


def _order():
    return Window.partitionBy(KEY).orderBy("beat")


def rmssd(beats: DataFrame) -> DataFrame:
    """Root of the mean squared difference of successive intervals, ms."""
    diff = beats.withColumn("_d", F.col("rr_ms") - F.lag("rr_ms").over(_order()))
    return diff.groupBy(KEY).agg(F.sqrt(F.avg(F.pow("_d", F.lit(2)))).alias("rmssd"))


def without_ectopic(beats: DataFrame, share: float = 0.20, lo: float = 273, hi: float = 2000) -> DataFrame:
    """Plausible beats within `share` of the raw beat before; the first is kept."""
    ok = beats.filter(F.col("rr_ms").between(lo, hi)).withColumn("_p", F.lag("rr_ms").over(_order()))
    return ok.filter(F.col("_p").isNull() | (F.abs(F.col("rr_ms") - F.col("_p")) / F.col("_p") <= share)).drop("_p")


def beat_times(beats: DataFrame) -> DataFrame:
    """F-arr2: running sum of the intervals."""
    return beats.withColumn("t_ms", F.sum("rr_ms").over(_order().rowsBetween(Window.unboundedPreceding, 0)))


def beat_windows(beats: DataFrame, width: int = 200, step: int = 30) -> DataFrame:
    """Windows of `width` beats every `step` beats, with mean and variation (population)."""
    numbered = beats.withColumns({"_i": F.row_number().over(_order()) - 1, "_n": F.count("*").over(Window.partitionBy(KEY))})
    first = F.greatest(F.lit(0), F.ceil((F.col("_i") - (width - 1)) / step)).cast("long")
    last = F.floor(F.col("_i") / step).cast("long")
    dealt = numbered.withColumn("win", F.explode(F.sequence(first, last))).filter(F.col("win") * step <= F.col("_n") - width)
    return dealt.groupBy(KEY, "win").agg(F.avg("rr_ms").alias("mean_rr"), (F.stddev_pop("rr_ms") / F.avg("rr_ms")).alias("cv"))


def _let(value: Column, use) -> Column:
    """use(value), where value is worked out once."""
    return F.transform(F.array(value), use)[0]


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def smoothed(xs: Column, size: Column) -> Column:
    """Moving mean of an array, reflected at its edges; an even window reaches one further back."""

    def means(xs: Column) -> Column:
        n, left = F.size(xs), F.floor(size / 2).cast("int")
        at = lambda j: F.when(j < 0, -1 - j).when(j >= n, 2 * n - 1 - j).otherwise(j)
        mean = lambda i: _total(F.transform(F.sequence(i - left, i - left + size - 1), lambda j: F.get(xs, at(j)))) / size
        return F.transform(F.sequence(F.lit(0), n - 1), mean)

    return _let(xs, means)


def first_crossing(xs: Column, ys: Column, limit: float) -> Column:
    """X at which y first falls through the limit, between its neighbours; null where it never does."""
    falls = F.filter(F.sequence(F.lit(0), F.size(ys) - 2), lambda i: (F.get(ys, i) >= limit) & (F.get(ys, i + 1) < limit))
    between = lambda i: F.get(xs, i) + (F.get(xs, i + 1) - F.get(xs, i)) * (F.get(ys, i) - limit) / (F.get(ys, i) - F.get(ys, i + 1))
    return F.when(F.size(ys) > 1, F.get(F.transform(falls, between), F.lit(0)))


def scaling_exponents(walks: np.ndarray, sizes: range = range(4, 17)) -> np.ndarray:
    """Short-term scaling exponent of each row (a walk: running sums of deviations): the slope of log fluctuation over log box size,
    each box detrended by a line (Peng et al., 1994). Sizes without any fluctuation do not count; nan where fewer than two are left."""
    level = np.zeros((len(walks), len(sizes)))
    for i, size in enumerate(sizes):
        boxes = walks.shape[1] // size
        if not boxes:
            continue
        y = walks[:, : boxes * size].reshape(-1, boxes, size)
        y = y - y.mean(axis=2, keepdims=True)
        x = np.arange(size) - (size - 1) / 2
        rest = np.einsum("wbs,wbs->w", y, y) - (np.einsum("wbs,s->wb", y, x) ** 2).sum(axis=1) / np.einsum("s,s", x, x)
        level[:, i] = rest / (boxes * size)
    used = level > 0
    n = used.sum(axis=1)
    x = used * np.log(np.array(sizes))
    y = np.log(np.where(used, level, 1.0)) / 2
    with np.errstate(all="ignore"):
        x = np.where(used, x - (x.sum(axis=1) / n)[:, None], 0.0)
        return np.where(n > 1, (x * y).sum(axis=1) / (x * x).sum(axis=1), np.nan)


def _alpha(y: pd.Series) -> pd.Series:
    """scaling_exponents() of walks of any lengths."""
    return y.map(lambda walk: scaling_exponents(walk[None, :])[0])


def _window_measures(rr: pd.Series) -> pd.DataFrame:
    """Mean, variation (population) and alpha of windows of beats, all of one width; null for null."""
    out = pd.DataFrame(index=rr.index, columns=["mean", "cv", "alpha"], dtype=float)
    known = rr.notna()
    if known.any():
        x = np.stack(rr[known])
        mean = x.mean(axis=1)
        out.loc[known] = np.column_stack([mean, x.std(axis=1) / mean, scaling_exponents(np.cumsum(x - mean[:, None], axis=1))])
    return out


def dfa_alpha1(walks: DataFrame, key: list[str], width: int) -> DataFrame:
    """key, alpha: scaling_exponents() of walks (key, pos from 0 to width - 1, y: running sums of deviations). No row where there is none."""
    whole = walks.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", "y"))).alias("x")).filter(F.size("x") == width)
    return whole.select(*key, F.pandas_udf(_alpha, "double")(F.transform("x", lambda p: p["y"])).alias("alpha")).filter("alpha IS NOT NULL")


def _measured_windows(beats: DataFrame, width: int = 200, step: int = 30) -> DataFrame:
    """activity_id, win, mean, cv and alpha of all windows of `width` plausible beats every `step` beats, in one pass over beats; a row of
    nulls for activities of fewer. Beats meet as an array of their activity, of which windows are slices: what a window costs does not
    grow with the activity, and the exponents of many windows are worked out at once."""
    whole = without_ectopic(beats).groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("beat", "rr_ms"))).alias("x")).select(KEY, F.transform("x", lambda b: b["rr_ms"].cast("double")).alias("rr"))
    last = F.floor((F.size("rr") - width) / step).cast("int")
    windows = F.when(F.size("rr") >= width, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), last)), lambda i: F.slice("rr", i * step + 1, F.lit(width))))
    dealt = whole.select(KEY, F.posexplode_outer(windows).alias("win", "rr")).withColumn("m", F.pandas_udf(_window_measures, "struct<mean double, cv double, alpha double>")("rr"))
    return dealt.select(KEY, F.col("win").cast("long").alias("win"), "m.*")


def _plausible(windows: DataFrame) -> Column:
    return F.coalesce((F.col("cv") <= 0.25) & (F.col("alpha") > 0) & (F.col("alpha") < 2), F.lit(False))


def alpha_windows(beats: DataFrame, width: int = 200, step: int = 30) -> DataFrame:
    """Windows of `width` plausible beats every `step` beats with at most a quarter of variation, and alpha between 0 and 2:
    activity_id, win, hr (mean), alpha. An activity's beats meet by one shuffle."""
    windows = _measured_windows(beats, width, step)
    return windows.filter(_plausible(windows)).select(KEY, "win", (60000 / F.col("mean")).alias("hr"), "alpha")


def alpha_curves(beats: DataFrame) -> DataFrame:
    """activity_id, windows (how many), and for ten windows and more the arrays hr and alpha, by heart rate, alpha smoothed. A row
    for every activity with plausible beats."""
    windows = _measured_windows(beats).withColumn("hr", 60000 / F.col("mean"))
    good = F.when(_plausible(windows), F.struct("hr", "alpha"))
    g = windows.groupBy(KEY).agg(F.count(good).alias("windows"), F.array_sort(F.collect_list(good)).alias("x"))
    size = F.least(F.lit(5), F.greatest(F.lit(3), F.floor(F.col("windows") / 3))).cast("int")
    alpha = smoothed(F.transform("x", lambda x: x["alpha"]), size)
    enough = F.col("windows") >= 10
    return g.select(KEY, "windows", F.when(enough, F.transform("x", lambda x: x["hr"])).alias("hr"), F.when(enough, alpha).alias("alpha"))


def dfa_thresholds(beats: DataFrame, profile: Profile = DEFAULT, aerobic: float = 0.75, anaerobic: float = 0.50) -> DataFrame:
    """D-22: heart rates at which alpha1 of beat windows falls through both limits; null where there are too few beats or pairs.
    quality: real where the aerobic one was found, else none. A row for every activity with plausible beats."""
    cap = 0.8 * profile.max_hr
    found = alpha_curves(beats).select(KEY, "windows", *(first_crossing(F.col("hr"), F.col("alpha"), limit).alias(n) for n, limit in (("aet", aerobic), ("ant", anaerobic))))
    aet = F.when(F.col("aet").between(100, cap), F.col("aet"))
    out = found.withColumn("aet_hr", aet)
    ant = F.when((F.col("ant") >= 100) & (F.col("aet_hr").isNull() | (F.col("ant") > F.col("aet_hr"))), F.col("ant"))
    quality = F.when(F.col("aet_hr").isNotNull(), "real").otherwise("none")
    return out.select(KEY, "aet_hr", ant.alias("ant_hr"), "windows", quality.alias("quality"))


def aerobic_thresholds(beats: DataFrame, records: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """D-22 with its fall-back: activity_id, aet_hr, ant_hr, quality of every activity with records or beats: real where the beats tell
    the aerobic threshold, proxy where only the records do (D-21), else none. records with is_active."""
    from stridelake.operators.activity import threshold_proxy

    real, proxy = dfa_thresholds(beats, profile), threshold_proxy(records, profile)
    out = real.join(proxy, KEY, "full")
    quality = F.when(F.col("aet_hr").isNotNull(), "real").when(F.col("threshold_hr").isNotNull(), "proxy").otherwise("none")
    return out.select(KEY, F.coalesce("aet_hr", F.col("threshold_hr").cast("double")).alias("aet_hr"), "ant_hr", quality.alias("dfa_quality"))


def flattened_beats(messages: DataFrame) -> DataFrame:
    """F-arr1: activity_id, beat, rr_ms from beat messages (activity_id, message, times: array of seconds, or null): the intervals above
    0 of all messages in order, in milliseconds."""
    one = messages.select(KEY, "message", F.posexplode("times").alias("_at", "_s")).filter("_s > 0")
    number = F.row_number().over(Window.partitionBy(KEY).orderBy("message", "_at")).cast("long")
    return one.select(KEY, number.alias("beat"), (F.col("_s") * 1000).alias("rr_ms"))


def with_curvature(points: DataFrame, key: list[str], x: str, y: str, to: str) -> DataFrame:
    """points (key, x, y; x rising within a key) with the second derivatives, `to`, of the natural cubic spline through them.

    The tridiagonal system is reduced by windows of one order: each step puts the equations of both neighbours into a row's own, after
    which it names rows twice as far away. A row's off-diagonal share is at most 1/2 of its diagonal, then 1/3, 1/8, 1/63 ..., and under
    1e-14 after six steps, when it is dropped. Adds the columns _a, _c, _d (the last equation), which callers may drop."""
    w = Window.partitionBy(*key).orderBy(x)
    c = F.col
    before, after = c(x) - F.lag(x).over(w), F.lead(x).over(w) - c(x)
    rows = points.withColumns({"_h0": before, "_h1": after, "_s0": (c(y) - F.lag(y).over(w)) / before, "_s1": (F.lead(y).over(w) - c(y)) / after})
    both = c("_h0") + c("_h1")
    inner = {"_a": c("_h0") / (2 * both), "_c": c("_h1") / (2 * both), "_d": 3 * (c("_s1") - c("_s0")) / both}
    rows = rows.withColumns({n: F.coalesce(e, F.lit(0.0)) for n, e in inner.items()}).drop("_h0", "_h1", "_s0", "_s1")
    for step in (1, 2, 4, 8, 16, 32):
        near = {f"{n}{side}": at(n, step, 0.0).over(w) for n in ("_a", "_c", "_d") for side, at in (("0", F.lag), ("1", F.lead))}
        rows = rows.withColumns(near)
        rest = 1 - c("_a") * c("_c0") - c("_c") * c("_a1")
        reduced = {"_d": (c("_d") - c("_a") * c("_d0") - c("_c") * c("_d1")) / rest, "_a": -c("_a") * c("_a0") / rest, "_c": -c("_c") * c("_c1") / rest}
        rows = rows.withColumns(reduced).drop(*near)
    return rows.withColumn(to, c("_d"))


def resampled_beats(beats: DataFrame, least: int = 120) -> DataFrame:
    """Intervals (seconds) of plausible beats at 4 Hz, by a natural cubic spline over the times of beats (to the nanosecond):
    activity_id, points (how many), at (from 0), x. Nothing for activities of fewer than `least` beats."""
    whole, c = Window.partitionBy(KEY), F.col
    timed = without_ectopic(beats).select(KEY, "beat", (c("rr_ms") / 1000).alias("y"), F.round(F.sum("rr_ms").over(_order().rowsBetween(Window.unboundedPreceding, 0)), 6).alias("ms"))
    timed = timed.withColumns({"_n": F.count("*").over(whole), "_first": F.min("ms").over(whole), "_last": F.max("ms").over(whole)}).filter(c("_n") >= least)
    place = lambda ms: F.ceil((ms - c("_first")) / 250)  # noqa: E731  the first place at or after a time
    timed = timed.select(KEY, "y", "ms", "_first", (c("ms") / 1000).alias("t"), place(c("_last")).alias("points"))
    w = Window.partitionBy(KEY).orderBy("t")
    bent = with_curvature(timed, [KEY], "t", "y", "m").withColumns({f"_{n}": F.lead(n).over(w) for n in ("t", "y", "m", "ms")}).filter("_t IS NOT NULL")
    # Plausible beats are over 250 ms apart, so that each has a place or more before the next.
    placed = bent.withColumn("at", F.explode(F.sequence(place(c("ms")), place(c("_ms")) - 1)))
    h, left, right = c("_t") - c("t"), c("_ms") / 1000 - c("_first") / 1000 - c("at") / 4, c("_first") / 1000 + c("at") / 4 - c("t")
    cubic = (c("m") * left * left * left + c("_m") * right * right * right) / (6 * h)
    x = cubic + (c("y") / h - c("m") * h / 6) * left + (c("_y") / h - c("_m") * h / 6) * right
    return placed.select(KEY, "points", "at", x.alias("x"))


def _powers(x: pd.Series) -> pd.Series:
    """Welch's mean power of each array at the bins from 0.15 to 0.5 Hz; see band_power()."""

    def power(x: np.ndarray) -> np.ndarray:
        size = min(256, len(x) // 2)
        parts = np.lib.stride_tricks.sliding_window_view(x, size)[:: size // 2]
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
        return (np.abs(np.fft.rfft(parts * hann, axis=1)[:, -(-3 * size // 80) : size // 8 + 1]) ** 2).mean(axis=0)

    return x.map(power)


def band_power(samples: DataFrame) -> DataFrame:
    """Welch's mean power of resampled_beats() at the bins from 0.15 to 0.5 Hz: activity_id, size (places of a window), bin, power.
    Hann windows overlap by half and have 256 places, or half the points where there are fewer than 512; under 64 points there are none.

    An activity's points meet as an array, of which a row for each bin is left. Taking a window's mean away first would change
    nothing: a Hann window has no share in bins over 1, and the lowest here is 2."""
    whole = samples.filter("points >= 64").groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("x")).select(KEY, F.transform("x", lambda p: p["x"]).alias("x"))
    size = F.least(F.lit(256), F.floor(F.size("x") / 2))
    bins = whole.select(KEY, size.alias("size"), F.posexplode(F.pandas_udf(_powers, "array<double>")("x")).alias("_i", "power"))
    return bins.select(KEY, "size", (F.ceil(3 * F.col("size") / 80) + F.col("_i")).alias("bin"), "power")


def breaths(beats: DataFrame) -> DataFrame:
    """D-23 of the activities that have one: activity_id, respiration_rate, in one pass over beats."""
    best = band_power(resampled_beats(beats)).groupBy(KEY).agg(F.max(F.struct("power", (-F.col("bin")).alias("lower"), "size")).alias("b"))
    return best.select(KEY, (-F.col("b")["lower"] * 240 / F.col("b")["size"]).alias("respiration_rate")).filter("respiration_rate BETWEEN 6 AND 40")


def respiration_rate(beats: DataFrame) -> DataFrame:
    """D-23: breaths a minute from the strongest rhythm between 0.15 and 0.5 Hz of the intervals, resampled at 4 Hz (Welch's mean of
    half-overlapping Hann windows; of equal bins the lowest); null under 120 beats or outside 6 to 40. A row for every activity with
    plausible beats. An activity's beats meet by one shuffle."""
    return without_ectopic(beats).select(KEY).distinct().join(breaths(beats), KEY, "left")
