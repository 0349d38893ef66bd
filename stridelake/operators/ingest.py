"""Landing: health-export text rows, raw JSON responses, file profiles and duplicate sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridelake.functions import rolling as R
from stridelake.functions.scalars import day_first_date, eu_number, is_cardio, sleep_minutes
from stridelake.profile import DEFAULT, Profile
from stridelake.sources.tables import enforced

# --- health export (D-28) -------------------------------------------------------------------------------------------------


def clean_export(rows: DataFrame) -> DataFrame:
    """Typed rows of a health export (all text: day, workout, vo2, rhr, hrv, spo2, sleep, active, resting). Blood oxygen, sleep and
    energy count on daily rows alone (those without a workout); rows without a date are left out."""
    daily = F.coalesce(F.trim("workout") == "", F.lit(True))
    on_days = lambda x: F.when(daily, x)
    out = rows.select(
        "athlete_id",
        day_first_date(F.col("day")).alias("date"),
        *(eu_number(F.col(c)).alias(c) for c in ("vo2", "rhr", "hrv")),
        on_days(eu_number(F.col("spo2"))).alias("spo2"),
        on_days(sleep_minutes(F.col("sleep"))).cast("double").alias("sleep_min"),
        *(on_days(eu_number(F.col(c))).alias(c) for c in ("active", "resting")),
    )
    return out.filter("date IS NOT NULL")


def export_days(cleaned: DataFrame) -> DataFrame:
    """A10: means of vo2, rhr, hrv, spo2 and sums of sleep and energy (0 is null) for each day, with the 7-value mean of HRV."""
    mean = lambda c: F.avg(c).alias(c)
    total = lambda c: F.nullif(F.sum(c), F.lit(0.0)).alias(c)
    days = cleaned.groupBy("athlete_id", "date").agg(*map(mean, ("vo2", "rhr", "hrv", "spo2")), *map(total, ("sleep_min", "active", "resting")))
    seen = days.filter("hrv IS NOT NULL").select("athlete_id", "date", R.rolling_mean("hrv", ["athlete_id"], ["date"], 7, 3).alias("hrv_weekly"))
    return days.join(seen, ["athlete_id", "date"], "left")


#: The columns of the four daily tables that a health export fills in part: fixed by the tables they stand beside.
EXPORT_TABLES = {
    "hrv": "weekly_avg double, last_night_avg double, last_night_5min_high double, status string, feedback_text string, sample_count long",
    "sleep": "sleep_score double, duration_minutes long, sleep_start_time string, sleep_end_time string, rem_sleep_percentage double, light_sleep_percentage double, deep_sleep_percentage double, awake_count double, avg_spo2 double, avg_respiration double",
    "daily_health": "body_battery_highest double, body_battery_lowest double, stress_average double, stress_max double, resting_heart_rate double, active_calories double, resting_calories double",
    "vo2_max": "vo2_max double",
}


def export_tables(cleaned: DataFrame) -> dict[str, DataFrame]:
    """D-28: the four daily tables of a cleaned export, each with all columns of the table it stands beside (null where an export has
    nothing): HRV to one decimal with its 7-value mean, sleep in whole minutes, health where any of its three sources is there,
    oxygen uptake to two decimals. Rounding is half to even."""
    days = export_days(cleaned)
    cut = lambda c, n: F.bround(F.round(c, 9), n)
    hrv = days.filter("hrv IS NOT NULL").select("athlete_id", "date", cut("hrv", 1).alias("last_night_avg"))
    hrv = hrv.withColumn("weekly_avg", cut(R.rolling_mean("last_night_avg", ["athlete_id"], ["date"], 7, 3), 1))
    sleep = days.filter("sleep_min IS NOT NULL").select("athlete_id", "date", cut("sleep_min", 0).cast("long").alias("duration_minutes"), cut("spo2", 1).alias("avg_spo2"))
    health = days.filter("rhr IS NOT NULL OR active IS NOT NULL OR resting IS NOT NULL")
    health = health.select("athlete_id", "date", cut("rhr", 1).alias("resting_heart_rate"), cut("active", 0).alias("active_calories"), cut("resting", 0).alias("resting_calories"))
    uptake = days.filter("vo2 IS NOT NULL").select("athlete_id", "date", cut("vo2", 2).alias("vo2_max"))
    made = {"hrv": hrv, "sleep": sleep, "daily_health": health, "vo2_max": uptake}
    return {name: enforced(made[name], T._parse_datatype_string(f"athlete_id long, date date, {columns}")) for name, columns in EXPORT_TABLES.items()}


# --- raw JSON (section E) ---------------------------------------------------------------------------------------------------


def parsed(json: Column, paths: list[str]) -> Column:
    """F-json3: the values at the paths ("$.a.b"), as texts in nested structs, by one parse of the JSON; of a list, its first
    element's. Null for null, and for an empty list."""
    tree: dict = {}
    for path in paths:
        *inner, leaf = path.removeprefix("$.").split(".")
        at = tree
        for name in inner:
            at = at.setdefault(name, {})
        at[leaf] = None

    def struct(names: dict) -> T.StructType:
        return T.StructType([T.StructField(n, T.StringType() if below is None else struct(below)) for n, below in names.items()])

    return F.get(F.from_json(json, T.ArrayType(struct(tree))), F.lit(0))  # an object is read as a list of one


def value_at(record: Column, *paths: str) -> Column:
    """F-json2: the first of the paths into a parsed record that holds something other than null, an empty text or 0."""

    def at(path: str) -> Column:
        out = record
        for name in path.removeprefix("$.").split("."):
            out = out[name]
        return out

    return F.coalesce(*(F.when((at(p) != "") & (at(p) != "0"), at(p)) for p in paths))


def first_record(json: Column) -> Column:
    """The text of the first element of a list, or of the object itself."""
    return F.when(F.ltrim(json).startswith("["), F.get_json_object(json, "$[0]")).otherwise(json)


def _any(*columns: str) -> str:
    return " OR ".join(f"{c} IS NOT NULL" for c in columns)


_SLEEP, _NEWEST = "$.dailySleepDTO", "$.mostRecentTrainingStatus"
_LATEST = f"{_NEWEST}.latestTrainingStatusData"


def _nested(field: str, root: bool = True) -> list[str]:
    """Where a field of the training status may stand: in the latest data, in the newest status, at the top."""
    return [f"{_LATEST}.{field}", f"{_NEWEST}.{field}", *([f"$.{field}"] if root else [])]


#: Columns of each daily table: name, type, paths by preference; and which rows are kept, as SQL over the columns.
EXTRACTORS: dict[str, tuple[list[tuple[str, str, list[str]]], str]] = {
    "hrv": ([("weekly_avg", "double", ["$.hrvSummary.weeklyAvg"]), ("last_night_avg", "double", ["$.hrvSummary.lastNightAvg"]), ("last_night_5min_high", "double", ["$.hrvSummary.lastNight5MinHigh"]), ("status", "string", ["$.hrvSummary.status"]), ("feedback_text", "string", ["$.hrvSummary.feedbackPhrase"])], "sample_count > 0 OR last_night_avg IS NOT NULL"),
    "sleep": (
        [("sleep_score", "double", [f"{_SLEEP}.sleepScores.overall.value"]), ("sleep_start_time", "string", [f"{_SLEEP}.sleepStartTimestampGMT"]), ("sleep_end_time", "string", [f"{_SLEEP}.sleepEndTimestampGMT"])]
        + [(f"{part}_sleep_percentage", "double", [f"{_SLEEP}.sleepScores.{part}Percentage.value"]) for part in ("rem", "light", "deep")]
        + [("awake_count", "double", [f"{_SLEEP}.awakeCount"]), ("avg_spo2", "double", [f"{_SLEEP}.averageSpO2Value"]), ("avg_respiration", "double", [f"{_SLEEP}.averageRespirationValue"])],
        "sleep_score > 0 OR duration_minutes > 0",
    ),
    "daily_health": ([("body_battery_highest", "double", ["$.bodyBatteryHighestValue"]), ("body_battery_lowest", "double", ["$.bodyBatteryLowestValue"]), ("stress_average", "double", ["$.averageStressLevel"]), ("stress_max", "double", ["$.maxStressLevel"]), ("resting_heart_rate", "double", ["$.restingHeartRate"])], _any("body_battery_highest", "body_battery_lowest", "stress_average", "stress_max", "resting_heart_rate")),
    "training_readiness": ([("score", "double", ["$.score"]), ("recovery_time", "double", ["$.recoveryTime"]), ("sleep_score", "double", ["$.sleepScore"]), ("hrv_factor_percent", "double", ["$.hrvFactorPercent"])], _any("score", "recovery_time", "sleep_score", "hrv_factor_percent")),
    "training_status": ([("training_status", "string", _nested("trainingStatus", False)), ("acute_load", "double", _nested("acuteLoad", False)), ("recovery_time", "double", _nested("recoveryTime", False)), ("load_focus", "string", _nested("loadFocus", False))], _any("training_status", "acute_load", "recovery_time")),
    "training_status_history": ([("training_status", "string", _nested("trainingStatus")), ("acute_load", "double", _nested("acuteLoad")), ("recovery_time", "double", _nested("recoveryTime")), ("vo2_max", "double", _nested("vo2Max"))], _any("training_status", "acute_load", "recovery_time")),
    "load_focus": (
        [(column, "double", [f"{_LATEST}.{field}", f"$.{field}"]) for column, field in (("anaerobic_load", "anaerobicLoad"), ("high_aerobic_load", "highAerobicLoad"), ("low_aerobic_load", "lowAerobicLoad"), ("vo2_max", "vo2Max"))] + [("recovery_time", "double", _nested("recoveryTime", False))],
        _any("anaerobic_load", "high_aerobic_load", "low_aerobic_load", "recovery_time", "vo2_max"),
    ),
    "vo2_max": ([("vo2_max", "double", ["$.generic.vo2MaxPreciseValue"])], _any("vo2_max")),
    "lactate_threshold": ([("lt_heart_rate", "double", ["$.lactateThresholdHeartRate"]), ("lt_speed", "double", ["$.lactateThresholdSpeed"])], _any("lt_heart_rate", "lt_speed")),
    "movement": ([("steps", "double", ["$.totalSteps"]), ("steps_goal", "double", ["$.stepsGoal"]), ("floors_ascended", "double", ["$.floorsAscended"])], "TRUE"),
    "intensity": ([("moderate_min", "double", ["$.moderateIntensityMinutes"]), ("vigorous_min", "double", ["$.vigorousIntensityMinutes"])], "TRUE"),
    "activities": (
        [("activity_id", "string", ["$.activityId"]), ("activity_name", "string", ["$.activityName"]), ("activity_type_id", "string", ["$.activityType.typeId"]), ("duration_seconds", "double", ["$.duration"]), ("distance_meters", "double", ["$.distance"])]
        + [("calories", "double", ["$.calories"]), ("avg_heart_rate", "double", ["$.averageHR"]), ("max_heart_rate", "double", ["$.maxHR"]), ("start_time", "string", ["$.startTimeLocal"]), ("start_time_utc", "string", ["$.startTimeGMT"])]
        + [("epoc_load", "double", ["$.trainingLoad"]), ("aerobic_te", "double", ["$.aerobicTrainingEffect"]), ("anaerobic_te", "double", ["$.anaerobicTrainingEffect"])],
        "date IS NOT NULL",
    ),
}


#: Paths of the columns that are not just a value at a path.
_MORE = {
    "hrv": ["$.hrvReadings"],
    "sleep": [f"{_SLEEP}.sleepTimeSeconds"],
    "intensity": ["$.moderateIntensityMinutes", "$.vigorousIntensityMinutes"],
    "activities": ["$.startTimeGMT", "$.startTimeLocal"],
}


def _computed(name: str, record: Column) -> dict[str, Column]:
    """The columns of a daily table that are not just a value at a path."""
    number = lambda path: F.coalesce(value_at(record, path).try_cast("double"), F.lit(0.0))
    if name == "hrv":
        return {"sample_count": F.coalesce(F.json_array_length(record["hrvReadings"]), F.lit(0)).cast("long")}
    if name == "sleep":
        return {"duration_minutes": F.floor(number(f"{_SLEEP}.sleepTimeSeconds") / 60).cast("long")}
    if name == "intensity":
        return {"total_intensity_min": number("$.moderateIntensityMinutes") + number("$.vigorousIntensityMinutes")}
    if name == "activities":
        return {"date": F.substring(value_at(record, "$.startTimeGMT", "$.startTimeLocal"), 1, 10).try_cast("date")}
    return {}


def extracted(landing: DataFrame, name: str) -> DataFrame:
    """A daily table out of landed responses (athlete_id, date, payload): one row for each response that holds what the
    table needs; a list counts as its first element. Values that are missing, empty or 0 are null. An activity's date is that of
    its start (UTC, else local); without either it is left out. The oxygen uptake is looked for everywhere, see vo2_max()."""
    columns, keep = EXTRACTORS[name]
    paths = [p for _, _, own in columns for p in own] + _MORE.get(name, [])
    # Generators bind what is used often: a plain projection would be merged with what reads it, and parse once for each value.
    one = landing.select("athlete_id", "date", "payload", F.inline(F.array(F.struct(parsed(F.col("payload"), paths).alias("_r")))))
    record = F.col("_r")
    values = {c: value_at(record, *own).try_cast(kind) for c, kind, own in columns} | _computed(name, record)
    if name == "vo2_max":
        values["vo2_max"] = F.coalesce(values["vo2_max"], vo2_max(F.col("payload")))
    date = values.pop("date", F.col("date"))
    row = F.struct(date.alias("date"), *(x.alias(c) for c, x in values.items()), record.isNotNull().alias("_found"))
    return one.select("athlete_id", F.inline(F.array(row))).filter("_found").filter(keep).drop("_found")


def vo2_max(payload: Column) -> Column:
    """Of the first item (of a list, or the object itself) that has one: the precise value, wherever it is, else the first value
    under a key with vo2max in its name."""
    number = lambda x: F.get(F.transform(F.array(x.try_cast("double")), lambda v: F.nullif(v, F.lit(0.0))), F.lit(0))  # noqa: E731  evaluates x once
    of = lambda item: F.coalesce(number(F.get_json_object(item, "$.generic.vo2MaxPreciseValue")), number(found_anywhere(item, "vo2MaxPreciseValue")), number(found_anywhere(item, "vo2Max")))
    items = F.when(F.ltrim(payload).startswith("["), F.from_json(payload, "array<string>")).otherwise(F.array(payload))
    return F.get(F.filter(F.transform(items, of), lambda x: x.isNotNull()), F.lit(0))


def in_range_or_before(rows: DataFrame, start: str, end: str, days: int = 30) -> DataFrame:
    """An athlete's rows with a date from start to end; for an athlete with none, those of the days before, from `days` before the end on."""
    date, whole = F.col("date"), Window.partitionBy("athlete_id")
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    near = rows.filter((date <= last) & (date >= F.least(first, F.date_sub(last, days)))).withColumn("_inside", date >= first)
    return near.withColumn("_any", F.max("_inside").over(whole)).filter("_inside OR NOT _any").drop("_inside", "_any")


def lactate_threshold(reports: DataFrame, summaries: DataFrame, start: str, end: str, as_of: str, most: int = 8) -> DataFrame:
    """athlete_id, date, lt_heart_rate, lt_speed from the reports (athlete_id, payload): every record of a list, and an object
    with either value; without a date, that of the run. For an athlete without any, the first `most` daily summaries (athlete_id,
    date, payload) from start to end that have either."""
    read = lambda j: {"lt_heart_rate": F.get_json_object(j, "$.lactateThresholdHeartRate").try_cast("double"), "lt_speed": F.get_json_object(j, "$.lactateThresholdSpeed").try_cast("double")}
    either = "coalesce(lt_heart_rate, 0) <> 0 OR coalesce(lt_speed, 0) <> 0"
    listed = F.ltrim("payload").startswith("[")
    items = reports.select("athlete_id", listed.alias("_list"), F.explode(F.when(listed, F.from_json("payload", "array<string>")).otherwise(F.array("payload"))).alias("j"))
    items = items.filter(F.ltrim("j").startswith("{")).withColumns(read(F.col("j")))
    items = items.withColumn("date", F.coalesce(F.substring(F.get_json_object("j", "$.date"), 1, 10).try_cast("date"), F.lit(as_of).cast("date"))).filter(f"_list OR {either}")
    daily = summaries.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).withColumns(read(F.col("payload"))).filter(either)
    daily = daily.join(items.select("athlete_id").distinct(), "athlete_id", "left_anti")
    daily = daily.withColumn("_n", F.row_number().over(Window.partitionBy("athlete_id").orderBy("date", "lt_heart_rate", "lt_speed"))).filter(F.col("_n") <= most)
    columns = ["athlete_id", "date", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("lt_heart_rate", "lt_speed"))]
    return items.select(*columns).unionByName(daily.select(*columns))


def heart_rate_details(landing: DataFrame) -> DataFrame:
    """E13, F-json4: [[time, rate], ...] as a row for each pair with a rate above 0."""
    pairs = F.from_json(F.get_json_object("payload", "$.heartRateValues"), "array<array<double>>")
    rows = landing.select("athlete_id", "date", F.explode(pairs).alias("p"))
    return rows.select("athlete_id", "date", F.get("p", F.lit(0)).cast("long").alias("ts_ms"), F.get("p", F.lit(1)).alias("heart_rate")).filter("heart_rate > 0")


def heart_rate_summary(landing: DataFrame) -> DataFrame:
    """Of each response the mean of its rates above 0 (one decimal; 0 without any), and the greatest, least and resting rate it
    states; responses without any of the four are left out."""
    record = parsed(F.col("payload"), ["$.heartRateValues", "$.maxHeartRate", "$.minHeartRate", "$.restingHeartRate"])
    one = landing.select("athlete_id", "date", F.inline(F.array(F.struct(record.alias("r")))))
    rates = F.filter(F.transform(F.from_json("r.heartRateValues", "array<array<double>>"), lambda p: F.get(p, F.lit(1))), lambda x: x > 0)
    mean = F.aggregate(rates, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(rates), F.lit(0))
    stated = {f"{short}_hr": F.coalesce(F.col(f"r.{long}HeartRate").try_cast("double"), F.lit(0.0)) for short, long in (("max", "max"), ("min", "min"), ("resting", "resting"))}
    out = one.select("athlete_id", "date", F.coalesce(F.bround(F.round(mean, 9), 1), F.lit(0.0)).alias("avg_hr"), *(x.alias(c) for c, x in stated.items()))
    return out.filter("avg_hr <> 0 OR max_hr <> 0 OR min_hr <> 0 OR resting_hr <> 0")


_ENTRY = "array<struct<path:array<int>,key:string,json:string>>"


def found_anywhere(json: Column, key: str, depth: int = 10) -> Column:
    """F-json1: the first value, in the order of the text, under a key whose name contains `key`, without case: in objects and lists
    down to `depth` levels below the outermost. Objects and lists come as their JSON text. Only what has `key` in its text, or an
    escape that could spell it, is parsed."""
    none, sought = F.array().cast(_ENTRY), key.lower()
    # The lower case of other than ASCII letters may hang on what stands beside them, so that a part says nothing.
    open_ = lambda j: F.lower(j).contains(sought) | j.contains("\\") if sought.isascii() else j.isNotNull()
    hit = lambda e: F.coalesce(F.lower(e["key"]).contains(sought), F.lit(False))

    def below(e: Column) -> Column:
        member = lambda i, name, value: F.struct(F.concat(e["path"], F.array(i)).alias("path"), name.alias("key"), value.alias("json"))
        fields = F.transform(F.map_entries(F.from_json(e["json"], "map<string,string>")), lambda x, i: member(i, x["key"], x["value"]))
        items = F.transform(F.from_json(e["json"], "array<string>"), lambda x, i: member(i, F.lit(None).cast("string"), x))
        start = F.ltrim(e["json"])
        told = F.when(open_(e["json"]) & start.startswith("{"), fields).when(open_(e["json"]) & start.startswith("["), items)
        return F.filter(F.coalesce(told, none), lambda m: hit(m) | open_(m["json"]))

    root = F.array(F.struct(F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("key"), json.alias("json"))).cast(_ENTRY)
    state = F.struct(none.alias("seen"), root.alias("level"))
    step = lambda a, _: F.struct(F.concat(a["seen"], F.filter(a["level"], hit)).alias("seen"), F.flatten(F.transform(a["level"], below)).alias("level"))
    hits = F.aggregate(F.sequence(F.lit(0), F.lit(depth)), state, step, lambda a: F.concat(a["seen"], F.filter(a["level"], hit)))
    return F.when(open_(json), F.array_min(F.transform(hits, lambda e: F.struct(e["path"], e["json"])))["json"])


# --- files and duplicate sessions -------------------------------------------------------------------------------------------


def file_profile(records: DataFrame, devices: DataFrame) -> DataFrame:
    """D-29: rows and heart-rate values of each file, their share, first time, and the kind of sensor: a strap (an external heart-rate
    device), optical (any other), else unknown. devices: file_id, device_type, source_type."""
    r = records.groupBy("file_id").agg(F.count("*").alias("n_records"), F.count_if(F.col("hr") > 0).alias("n_hr"), F.min("t").alias("start_t"))
    hr = F.col("device_type").isin("heart_rate", "120")
    d = devices.groupBy("file_id").agg(F.max(F.coalesce(hr & (F.col("source_type") == "antplus"), F.lit(False))).alias("_strap"), F.max(F.coalesce(hr, F.lit(False))).alias("_any"))
    kind = F.when(F.col("_strap"), "strap").when(F.col("_any"), "optical").otherwise("unknown")
    return r.join(d, "file_id", "left").select("file_id", "n_records", "n_hr", (F.col("n_hr") / F.col("n_records")).alias("density"), "start_t", kind.alias("sensor"))


def second_wins(a: Column, b: Column, profile: Profile = DEFAULT) -> Column:
    """D-30: whether the second of two duplicate sessions (structs a and b: source, n_records, n_rr, density, sensor, size) wins; ties
    go to the first. The rules in order: many more records; then, of different sources: a strap, beat intervals on one side
    only, the primary if its heart rate is dense; of one source: strap before unknown, better sensor, intervals, density, size."""
    n1, n2 = a["n_records"], b["n_records"]
    apart = F.abs(n1 - n2) / F.greatest(n1, n2, F.lit(1)) > profile.integrity_diff
    rank = lambda x: F.when(x["sensor"] == "strap", 2).when(x["sensor"] == "optical", 1).otherwise(0)
    strap = lambda x: F.coalesce(x["sensor"] == "strap", F.lit(False))
    rr = lambda x: F.coalesce(x["n_rr"] >= 30, F.lit(False))
    first = lambda x: x["source"] == "primary"
    prime = F.when(first(a), strap(a)).otherwise(strap(b))
    other = F.when(first(a), strap(b)).otherwise(strap(a))
    dense = F.when(first(a), a["density"]).otherwise(b["density"]) >= profile.hr_density
    across = F.when(prime, first(b)).when(other, first(a)).when(rr(a) != rr(b), rr(b)).when(dense, first(b)).otherwise(first(a))
    known = (rank(a) > 0) & (rank(b) > 0)
    unknown = (rank(a) == 0) & (rank(b) == 0)
    within = (
        F.when((strap(a) & (rank(b) == 0)) | (strap(b) & (rank(a) == 0)), strap(b))
        .when(known & (rank(a) != rank(b)), rank(b) > rank(a))
        .when(unknown & (rr(a) != rr(b)), rr(b))
        .when(a["density"] != b["density"], b["density"] > a["density"])
        .otherwise(b["size"] > a["size"])
    )
    return F.coalesce(F.when(apart, n2 > n1).when(a["source"] != b["source"], across).otherwise(within), F.lit(False))


def deduplicated(entries: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """D-31: sessions (athlete_id, start_t, file_id, source, n_records, n_rr, density, sensor, size) walked by start; each within the
    window of the one kept last is weighed against it, the winner stays. Islands split where starts are further apart; each is
    folded over its sorted array, so that a row holds the sessions of one island."""
    order = Window.partitionBy("athlete_id").orderBy("start_t", "file_id")
    held = entries.withColumn("_gap", F.col("start_t") - F.lag("start_t").over(order))
    held = held.withColumn("_island", R.islands(F.col("_gap"), profile.dedup_window_s, ["athlete_id"], ["start_t", "file_id"]))
    names = entries.columns
    held = held.withColumn("_size", F.count("*").over(Window.partitionBy("athlete_id", "_island")))
    alone = held.filter("_size = 1").select(*names)  # nearly all
    kind = entries.schema
    sortable = ["start_t", "file_id", *(c for c in names if c not in ("start_t", "file_id"))]
    crowd = held.filter("_size > 1").groupBy("athlete_id", "_island").agg(F.array_sort(F.collect_list(F.struct(*sortable))).alias("rows"))

    def step(kept: Column, row: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        near = F.coalesce(row["start_t"] - last["start_t"] <= profile.dedup_window_s, F.lit(False))
        replaced = F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(row))
        return F.when(~near, F.concat(kept, F.array(row))).when(second_wins(last, row, profile), replaced).otherwise(kept)

    element = "array<struct<" + ",".join(f"`{c}`:{kind[c].dataType.simpleString()}" for c in sortable) + ">>"
    folded = crowd.select(F.inline(F.aggregate("rows", F.array().cast(element), step)))
    return alone.unionByName(folded)


def records_of_newest(activities: DataFrame, records: DataFrame, most: int) -> DataFrame:
    """The records of the newest `most` cardio activities (T1: by date, then id). The ids are a top-k, broadcast as such: at most
    `most` of them, so that records are filtered where they are read."""
    newest = activities.filter(is_cardio(F.col("sport"))).orderBy(F.desc("date"), "activity_id").limit(most).select("activity_id")
    return records.join(F.broadcast(newest), "activity_id", "left_semi")
