"""Row-based rolling windows, exponential averages, islands, interval merging and gap interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rows(partition, order, n: int):
    """The last n rows up to and with the current one."""
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(-(n - 1), 0)


def guarded(agg: Column, column: str, window, least: int) -> Column:
    """agg over the window where it holds at least `least` values that are not null, else null."""
    return F.when(F.count(column).over(window) >= least, agg.over(window))


def rolling_mean(column, partition, order, n, least):
    return guarded(F.avg(column), column, rows(partition, order, n), least)


def rolling_std(column, partition, order, n, least):
    return guarded(F.stddev_samp(column), column, rows(partition, order, n), max(least, 2))


def rolling_sum(column, partition, order, n, least):
    return guarded(F.sum(column), column, rows(partition, order, n), least)


def rolling_quantile(column, q, partition, order, n, least):
    return guarded(F.percentile(column, F.lit(q)), column, rows(partition, order, n), least)


def rolling_median3(column: str, partition, order) -> Column:
    """The median of the values (nulls left out) on the last three rows; null where all are."""
    w = Window.partitionBy(*partition).orderBy(*order)
    held = F.array_sort(F.array_compact(F.array(F.col(column).cast("double"), *(F.lag(F.col(column).cast("double"), k).over(w) for k in (1, 2)))))
    at = lambda i: F.get(held, F.lit(i))
    return F.when(F.size(held) == 2, at(0) + (at(1) - at(0)) / 2).when(F.size(held) == 3, at(1)).otherwise(at(0))


def forward_fill(column: str, partition, order) -> Column:
    return F.last(column, ignorenulls=True).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def clip(x: Column, lo: float, hi: float) -> Column:
    """x between lo and hi; null stays null."""
    return F.when(x < lo, float(lo)).when(x > hi, float(hi)).otherwise(x)


def scaled(x: Column, lo: float, hi: float) -> Column:
    """x clipped to lo..hi and mapped to 0..100; hi may be below lo."""
    return (clip(x, min(lo, hi), max(lo, hi)) - lo) / (hi - lo) * 100


#: Blocks of a recursive average end where what came before has faded by e to this power.
FADED = 200.0


def ewma(df: DataFrame, key: str, order: str, column: str, spans: dict[str, float]) -> DataFrame:
    """df with a recursive exponential average of `column` for each span over 1 (alpha = 1/span, started at the first value). Null values
    carry the average on, and a value after them weighs the more; before the first value there is none.

    Each row maps the average before it to a * average + b, and maps compose: the average is a running sum of the b, each faded by
    the product of the a since, which logarithms turn into sums. A block ends where that product would leave the range of doubles;
    of the blocks before only the last one still counts (the others have faded by e**-200). Windows alone, one shuffle by key."""
    by = Window.partitionBy(key).orderBy(order)
    upto, before = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    c, x = F.col, F.col(column).cast("double")
    out = df.withColumn("_ew_n", F.row_number().over(by))
    out = out.withColumns({"_ew_seen": F.last(F.when(x.isNotNull(), c("_ew_n")), ignorenulls=True).over(before), "_ew_any": F.count(column).over(upto) > 0})
    for name, span in spans.items():
        alpha = 1 / span
        old = F.pow(F.lit(1 - alpha), (c("_ew_n") - c("_ew_seen")).cast("double"))
        moves = x.isNotNull() & c("_ew_seen").isNotNull()
        out = out.withColumns({
            "_ew_l": F.when(moves, F.greatest(F.ln(old / (old + alpha)), F.lit(-700.0))).otherwise(0.0),
            "_ew_b": F.when(moves, alpha * x / (old + alpha)).when(x.isNotNull(), x).otherwise(0.0),
        })
        out = out.withColumn("_ew_l", F.sum("_ew_l").over(upto))
        out = out.withColumn("_ew_k", F.floor(-c("_ew_l") / FADED))
        block = Window.partitionBy(key, "_ew_k").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("_ew_0", F.first("_ew_l").over(block))
        own = F.sum(c("_ew_b") * F.exp(c("_ew_0") - c("_ew_l"))).over(block)
        out = out.withColumn("_ew_a", own * F.exp(c("_ew_l") - c("_ew_0")))
        out = out.withColumn("_ew_q", F.lag(F.struct("_ew_a", "_ew_l")).over(by)).withColumn("_ew_p", F.first("_ew_q").over(block))
        carried = F.coalesce(c("_ew_p._ew_a") * F.exp(c("_ew_l") - c("_ew_p._ew_l")), F.lit(0.0))
        out = out.withColumn(name, F.when(c("_ew_any"), c("_ew_a") + carried))
    return out.select(*df.columns, *spans)


def islands(gap: Column, limit: float, partition, order) -> Column:
    """Running number of the island a row is in: a new one begins where gap exceeds the limit."""
    return F.sum((F.coalesce(gap, F.lit(0)) > limit).cast("int")).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def merged_intervals(df: DataFrame, partition, start: str, end: str, gap: float = 0) -> DataFrame:
    """Unions of intervals that overlap or lie within `gap` of each other: partition columns, start, end.

    Sorted by start, the end of the open union is the greatest end so far, so a break needs no fold. Equal intervals are taken once,
    which cuts what is shuffled and leaves no tie in the order."""
    df = df.select(*partition, start, end).distinct()
    before = Window.partitionBy(*partition).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    breaks = F.coalesce((F.col(start) - F.max(end).over(before) > gap).cast("int"), F.lit(0))
    upto = Window.partitionBy(*partition).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    grouped = df.withColumn("_break", breaks).withColumn("_run", F.sum("_break").over(upto))
    return grouped.groupBy(*partition, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def _neighbours(known: Column, partition, order) -> tuple[Column, Column]:
    """The last value of `known` up to each row and the first from it on. The latter is the last in descending order: both frames
    grow from the partition's edge, so each row costs one step."""
    up_to_here = lambda columns: Window.partitionBy(*partition).orderBy(*columns).rowsBetween(Window.unboundedPreceding, 0)
    return (F.last(known, ignorenulls=True).over(up_to_here(order)), F.last(known, ignorenulls=True).over(up_to_here([F.desc(c) for c in order])))


def interpolated(column: str, position: str, partition, order, limit: int) -> Column:
    """Linear interpolation by row: the first `limit` rows of any gap are filled, a leading gap stays null, a trailing gap
    repeats the last value for `limit` rows. position: a gap-free row number of the partition."""
    known = F.when(F.col(column).isNotNull(), F.struct(F.col(position).alias("p"), F.col(column).cast("double").alias("v")))
    a, b = _neighbours(known, partition, order)
    return _on_line(column, position, a["p"], a["v"], b["p"], b["v"], limit)


def _on_line(column: str, position: str, p0: Column, v0: Column, p1: Column, v1: Column, limit: int) -> Column:
    line = v0 + (v1 - v0) * (F.col(position) - p0) / (p1 - p0)
    filled = F.when(F.col(position) - p0 <= limit, F.coalesce(line, v0))
    return F.when(F.col(column).isNotNull(), F.col(column).cast("double")).otherwise(filled)


def with_interpolated(df: DataFrame, column: str, position: str, partition, limit: int, to: str, t: str, step: str) -> DataFrame:
    """df, in order of position within the partition, with interpolated() of column as `to` and time_step() of t as `step`. Each
    neighbour is a column that is worked out once, the descending ones first, so that rows are sorted twice and stay in order."""
    w, c = Window.partitionBy(*partition), F.col
    at = F.when(c(column).isNotNull(), c(position))
    near = lambda order: [F.last(x, ignorenulls=True).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) for x in (at, c(column).cast("double"))]
    out = df.withColumns(dict(zip(("_p1", "_v1"), near(F.desc(position)), strict=True)))
    out = out.withColumns(dict(zip(("_p0", "_v0"), near(c(position)), strict=True)) | {"_t0": F.lag(t).over(w.orderBy(position))})
    out = out.withColumns({to: _on_line(column, position, c("_p0"), c("_v0"), c("_p1"), c("_v1"), limit), step: _since(t, c("_t0"))})
    return out.drop("_p0", "_v0", "_p1", "_v1", "_t0")


def time_step(t: str, partition, order, most: float = 120, first: float = 1) -> Column:
    """Seconds since the row before, between 0 and `most`; `first` for the first row."""
    before = F.lag(t).over(Window.partitionBy(*partition).orderBy(*order))
    return _since(t, before, most, first)


def _since(t: str, before: Column, most: float = 120, first: float = 1) -> Column:
    return F.when(before.isNull(), F.lit(float(first))).otherwise(clip((F.col(t) - before).cast("double"), 0, most))


def interpolated_by_time(column: str, t: str, position: str, partition, order, seconds: float = 15, limit: int = 10) -> Column:
    """A gap is filled as a whole or not at all: where its bounding times are at most `seconds` apart, or, where a time is
    unknown, its rows are at most `limit`. Gaps at the edges, which have one bound, take its value under the row limit."""
    known = F.when(F.col(column).isNotNull(), F.struct(F.col(position).alias("p"), F.col(column).cast("double").alias("v"), F.col(t).alias("t")))
    a, b = _neighbours(known, partition, order)
    ends = Window.partitionBy(*partition)
    first, last = F.min(position).over(ends), F.max(position).over(ends)
    rows = F.coalesce(b["p"], last + 1) - F.coalesce(a["p"], first - 1) - 1
    near = F.coalesce(b["t"] - a["t"] <= seconds, rows <= limit)
    line = a["v"] + (b["v"] - a["v"]) * (F.col(position) - a["p"]) / (b["p"] - a["p"])
    return F.when(F.col(column).isNotNull(), F.col(column).cast("double")).when(near, F.coalesce(line, a["v"], b["v"]))
