"""Daily load, recovery, readiness and warnings of each athlete. Inputs are one row for each athlete and day unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.functions import rolling as R
from stridelake.functions.scalars import half_even, sport_matches
from stridelake.profile import DEFAULT, Profile

KEY, DAY = ["athlete_id"], ["date"]


def _days():
    return Window.partitionBy(*KEY).orderBy(*DAY)


def densify(days: DataFrame, fill: dict[str, float] | None = None, until: str | None = None) -> DataFrame:
    """A row for every day between each athlete's first and last (or `until`, a date such as today's, if it is later); the columns
    in `fill` get its value on new days, others null."""
    last = F.max("date") if until is None else F.greatest(F.max("date"), F.lit(until).cast("date"))
    ends = days.groupBy(*KEY).agg(F.min("date").alias("lo"), last.alias("hi"))
    spine = ends.select(*KEY, F.explode(F.sequence("lo", "hi")).alias("date"))
    out = spine.join(days, [*KEY, *DAY], "left")
    return out.fillna(fill) if fill else out


def daily_load(activities: DataFrame) -> DataFrame:
    """A1: impulse of each day, walking and hiking at 60 %, with EPOC score and the load that counts a tenth of it; dense, empty days 0."""
    weight = F.when(sport_matches(F.col("sport"), "hiking|walking"), 0.6).otherwise(1.0)
    epoc = 2 * F.coalesce("z4", F.lit(0.0)) + 5 * F.coalesce("z5", F.lit(0.0))
    sums = activities.groupBy(*KEY, *DAY).agg(F.sum(F.coalesce("total_trimp", F.lit(0.0)) * weight).alias("trimp"), F.sum(epoc).alias("epoc"))
    return densify(sums, {"trimp": 0.0, "epoc": 0.0}).withColumn("trimp_epoc", F.col("trimp") + 0.1 * F.col("epoc"))


def acute_chronic(load: DataFrame, profile: Profile = DEFAULT, column: str = "trimp_epoc") -> DataFrame:
    """D-13: rolling means over whole acute and chronic windows, and their ratio (null without chronic load)."""
    acute = R.rolling_mean(column, KEY, DAY, profile.acute_days, profile.acute_days)
    chronic = R.rolling_mean(column, KEY, DAY, profile.chronic_days, profile.chronic_days)
    out = load.withColumns({"acute": acute, "chronic": chronic})
    return out.withColumn("acwr", F.col("acute") / F.nullif(F.col("chronic"), F.lit(0.0)))


def ramp(fitness: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """Change of ctl over 7 days, and whether it is above the warning rate."""
    out = fitness.withColumn("ctl_ramp", F.col("ctl") - F.lag("ctl", 7).over(_days()))
    return out.withColumn("ramp_warning", F.coalesce(F.col("ctl_ramp") > profile.ramp_warning, F.lit(False)))


def fitness_fatigue(load: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """D-12: ctl and atl by exponential averages, tsb = yesterday's ctl minus today's atl (null on the first day)."""
    out = R.ewma(load, "athlete_id", "date", "trimp", {"ctl": profile.ctl_days, "atl": profile.atl_days})
    return out.withColumn("tsb", F.lag("ctl").over(_days()) - F.col("atl"))


def monotony_strain(load: DataFrame) -> DataFrame:
    """D-3: monotony = min(4, mean / deviation of 7 days), strain = monotony times their sum, and the logarithmic strain of the day."""
    mean, std, total = (f("trimp", KEY, DAY, 7, 7) for f in (R.rolling_mean, R.rolling_std, R.rolling_sum))
    out = load.withColumn("monotony", F.least(F.lit(4.0), mean / (std + 1e-5)) + mean * 0).withColumn("strain", F.col("monotony") * total)
    return out.withColumn("log_strain", 21 * (1 - F.exp(-0.005 * F.col("trimp"))))


def efficiency_index(activities: DataFrame) -> DataFrame:
    """D-4: daily impulse a kilometre of cycling, dense, with its 14-day mean (3 values at least) carried forward."""
    rides = activities.filter(sport_matches(F.col("sport"), "cycl|biking|ride"))
    positive = rides.filter("distance_km > 0").groupBy(*KEY, *DAY).agg((F.sum("total_trimp") / F.sum("distance_km")).alias("daily_efficiency"))
    mean = densify(positive).withColumn("_mean", R.rolling_mean("daily_efficiency", KEY, DAY, 14, 3))
    return mean.withColumn("efficiency_index", R.forward_fill("_mean", KEY, DAY)).drop("_mean")


def fatigue_index(efficiency: DataFrame) -> DataFrame:
    """D-14: the day's efficiency over its 7-day mean (3 values at least, above 0)."""
    mean = R.rolling_mean("daily_efficiency", KEY, DAY, 7, 3)
    return efficiency.withColumn("fatigue_index", F.col("daily_efficiency") / F.when(mean > 0, mean))


def hrv_score(bio: DataFrame) -> DataFrame:
    """Z-score of HRV over 30 observed values (7 at least), clipped to 3 and scaled to 0..100."""
    seen = bio.filter("hrv IS NOT NULL")
    mean, std = R.rolling_mean("hrv", KEY, DAY, 30, 7), R.rolling_std("hrv", KEY, DAY, 30, 7)
    return seen.select(*KEY, *DAY, R.scaled((F.col("hrv") - mean) / F.nullif(std, F.lit(0.0)), -3, 3).alias("hrv_score"))


def recovery_parts(bio: DataFrame) -> DataFrame:
    """HRV against its 7-value mean (0.7..1.3 as 0..100), resting rate against its 14-value mean (+10..-5 as 0..100), over observed values."""
    hrv = bio.filter("hrv IS NOT NULL")
    hrv = hrv.select(*KEY, *DAY, R.scaled(F.col("hrv") / R.rolling_mean("hrv", KEY, DAY, 7, 3), 0.7, 1.3).alias("hrv_part"), R.rolling_mean("hrv", KEY, DAY, 7, 3).alias("hrv_weekly"))
    rhr = bio.filter("rhr IS NOT NULL")
    rhr = rhr.select(*KEY, *DAY, R.scaled(F.col("rhr") - R.rolling_mean("rhr", KEY, DAY, 14, 5), 10, -5).alias("rhr_part"))
    return bio.join(hrv, [*KEY, *DAY], "left").join(rhr, [*KEY, *DAY], "left")


def readiness(fitness: DataFrame, bio: DataFrame) -> DataFrame:
    """D-5: from form alone, or with sleep and HRV where both are there; 0..100, one decimal, null without form."""
    days = fitness.select(*KEY, *DAY, "tsb").join(bio.select(*KEY, *DAY, "hrv", "sleep_score"), [*KEY, *DAY], "left").join(hrv_score(bio), [*KEY, *DAY], "left")
    legacy = R.scaled(F.col("tsb"), -30, 10)
    modern = 0.3 * F.coalesce("hrv_score", F.lit(50.0)) + 0.3 * F.col("sleep_score") + 0.4 * legacy
    score = F.when(F.col("sleep_score").isNotNull() & F.col("hrv").isNotNull(), modern).otherwise(legacy)
    return days.withColumn("readiness", half_even(R.clip(score, 0, 100), 1))


def pure_recovery(bio: DataFrame) -> DataFrame:
    """D-6: 40 % HRV, 30 % resting rate, 30 % sleep; parts that are missing count 50."""
    half = F.lit(50.0)
    parts = recovery_parts(bio)
    score = 0.4 * F.coalesce("hrv_part", half) + 0.3 * F.coalesce("rhr_part", half) + 0.3 * F.coalesce(R.clip(F.col("sleep_score"), 0, 100), half)
    return parts.withColumn("pure_recovery", F.bround(F.round(R.clip(score, 0, 100), 9), 1))


def sleep_need(load: DataFrame, bio: DataFrame) -> DataFrame:
    """D-7: minutes needed after the day before's impulse, the share slept, and the 7-day variation of HRV."""
    days = load.select(*KEY, *DAY, "trimp").join(bio, [*KEY, *DAY], "left")
    need = F.least(F.lit(780.0), 450 + 0.5 * F.coalesce(F.lag("trimp").over(_days()), F.lit(0.0)))
    out = days.withColumn("sleep_need", need).withColumn("sleep_performance", F.col("sleep_minutes") / F.col("sleep_need") * 100)
    return out.withColumn("hrv_cv", R.rolling_std("hrv", KEY, DAY, 7, 3) / R.rolling_mean("hrv", KEY, DAY, 7, 3) * 100)


def polarisation(activities: DataFrame) -> DataFrame:
    """D-8: shares of low (z1, z2), middle and high (z4, z5) minutes over 14 dense days (3 at least), and the efficiency of the mix."""
    low, mid, high = F.col("z1") + F.col("z2"), F.col("z3"), F.col("z4") + F.col("z5")
    sums = activities.groupBy(*KEY, *DAY).agg(F.sum(low).alias("low"), F.sum(mid).alias("mid"), F.sum(high).alias("high"))
    dense = densify(sums, {"low": 0.0, "mid": 0.0, "high": 0.0})
    out = dense.withColumns({f"{c}14": R.rolling_sum(c, KEY, DAY, 14, 3) for c in ("low", "mid", "high")})
    total = F.nullif(F.col("low14") + F.col("mid14") + F.col("high14"), F.lit(0.0))
    out = out.withColumns({f"{c}_pct": half_even(F.col(f"{c}14") / total * 100, 1) for c in ("low", "mid", "high")})
    return out.withColumn("mix_efficiency", R.clip(F.col("low_pct") + F.col("high_pct") - F.greatest(F.lit(0.0), F.col("mid_pct") - 5), 0, 100))


def illness_flags(days: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """D-10: over hrv, hrv_weekly, rhr, sleep_score, sleep_minutes, strain, pure_recovery: four flags, their count and names, and the warning."""
    no = F.lit(False)
    heavy = F.col("strain") > R.rolling_quantile("strain", 0.75, KEY, DAY, 30, 10)
    flags = {
        "low HRV": F.col("hrv") < F.col("hrv_weekly") * (1 - profile.hrv_drop),
        "high resting rate": F.col("rhr") > profile.high_rhr,
        "poor sleep": (F.col("sleep_score") < profile.low_sleep_score) | (F.col("sleep_minutes") < profile.short_sleep_min),
        "strain without recovery": heavy & (F.col("pure_recovery") < 50),
    }
    held = days.withColumns({f"_f{i}": F.coalesce(f, no) for i, f in enumerate(flags.values())})
    count = reduce(lambda a, b: a + b, (F.col(f"_f{i}").cast("int") for i in range(len(flags))))
    names = F.concat_ws(" | ", *(F.when(F.col(f"_f{i}"), n) for i, n in enumerate(flags)))
    out = held.withColumns({"illness_count": count.cast("long"), "illness_text": names})
    return out.withColumn("illness_warning", F.col("illness_count") >= profile.illness_flags).drop(*(f"_f{i}" for i in range(len(flags))))


def coach_advice(days: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """D-11: short advice in order of weight, joined; over strain, sleep, hrv, rhr, illness_warning, pure_recovery, tsb, acwr, ctl_ramp."""
    c = F.col
    yes = lambda cond: F.coalesce(cond, F.lit(False))
    middle = [
        F.when(yes(c("strain") > 800), "very high strain").when(yes(c("strain") > 400), "high strain"),
        F.when(yes(c("sleep_score") < profile.low_sleep_score), "poor sleep"),
        F.when(yes(c("sleep_minutes") < profile.short_sleep_min), "short sleep"),
        F.when(yes(c("hrv") < c("hrv_weekly") * (1 - profile.hrv_drop)), "HRV below week"),
        F.when(yes(c("rhr") > profile.high_rhr), "resting rate up"),
    ]
    ill = F.when(yes(c("illness_warning")), "illness risk: rest")
    quiet = reduce(lambda a, b: a & b, (m.isNull() for m in [*middle, ill]))
    late = [
        F.when(yes(c("pure_recovery") < 40), "recover").when(quiet & yes(c("pure_recovery") >= 80), "ready for hard work").when(quiet & yes(c("pure_recovery") >= 60), "ready for steady work"),
        F.when(yes(c("tsb") < -30), "deep fatigue").when(yes(c("tsb") > 10), "fresh: add load"),
        F.when(yes(c("acwr") <= 1.5) & yes(c("acwr") > 1.3), "load rising fast"),
        F.when(yes(c("ctl_ramp") > profile.ramp_warning), "ramp too steep"),
    ]
    return days.withColumn("advice", F.concat_ws(" | ", F.when(yes(c("acwr") > 1.5), "injury risk: cut load"), ill, *middle, *late))


def form_label(tsb: Column) -> Column:
    """P19."""
    return F.when(tsb < -30, "overreaching").when(tsb < -10, "productive").when(tsb <= 5, "maintaining").when(tsb <= 10, "fresh").when(tsb.isNotNull(), "detraining").otherwise("")


def acwr_label(x: Column) -> Column:
    """P22."""
    return F.when(x < 0.8, "low").when(x <= 1.3, "optimal").when(x <= 1.5, "caution").when(x.isNotNull(), "danger").otherwise("")


def hrv_cv_label(x: Column) -> Column:
    """P22."""
    return F.when(x < 10, "stable").when(x < 15, "raised").when(x.isNotNull(), "high stress").otherwise("")


def mix_label(x: Column) -> Column:
    """P22."""
    return F.when(x >= 80, "high").when(x >= 60, "reduced").when(x.isNotNull(), "low").otherwise("")


def daily_mart(activities: DataFrame, bio: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """D-26 for days: load, form, strain, readiness, recovery, warnings and advice, one row for each athlete and dense day."""
    load = monotony_strain(acute_chronic(daily_load(activities), profile))
    fitness = ramp(fitness_fatigue(load, profile), profile)
    bio = bio.select(*KEY, *DAY, "hrv", "rhr", "sleep_score", "sleep_minutes")
    ready = readiness(fitness, bio).select(*KEY, *DAY, "readiness")
    recovery = pure_recovery(bio).drop("hrv_part", "rhr_part")
    days = fitness.join(ready, [*KEY, *DAY], "left").join(recovery, [*KEY, *DAY], "left")
    return coach_advice(illness_flags(days, profile), profile)
