"""Queries over scalar functions: each applies some to a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridelake.functions import scalars as S
from stridelake.operators import geo as G
from stridelake.plans.registry import query
from stridelake.sources.fixtures import sql, view
from stridelake.sources.tables import table


def acts(spark, d):
    return view(spark, d, "activities")


def events(spark, d):
    return table(spark, d, "events")


@query("f_m1_trimp_increment", sql("SELECT activity_id, idx, round(CASE WHEN hr > 41 THEN 30 / 60.0::DOUBLE * least(1, greatest(0, (hr - 41) / 158)) * 0.64::DOUBLE * exp(1.92::DOUBLE * least(1, greatest(0, (hr - 41) / 158))) ELSE 0 END, 7) AS trimp FROM records"))
def f_m1(spark, d):
    return view(spark, d, "records").select("activity_id", "idx", F.round(S.trimp_increment(F.col("hr"), F.lit(30.0)), 7).alias("trimp"))


@query("f_m2_safe_division", sql("SELECT activity_id, round(total_trimp / nullif(z5, 0), 7) AS ratio, round(coalesce(total_trimp / nullif(z5, 0), -1), 7) AS ratio_or FROM activities"))
def f_m2(spark, d):
    a, b = F.col("total_trimp"), F.col("z5")
    return acts(spark, d).select("activity_id", F.round(S.safe_div(a, b), 7).alias("ratio"), F.round(S.safe_div(a, b, -1), 7).alias("ratio_or"))


@query("f_m3_haversine", sql("SELECT activity_id, idx, round(2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(50.05::DOUBLE - lat) / 2), 2) + cos(radians(lat)) * cos(radians(50.05::DOUBLE)) * pow(sin(radians(14.05::DOUBLE - lon) / 2), 2)))), 4) AS metres FROM records WHERE lat IS NOT NULL"))
def f_m3(spark, d):
    r = view(spark, d, "records").filter("lat IS NOT NULL")
    return r.select("activity_id", "idx", F.round(S.haversine_m(F.col("lat"), F.col("lon"), F.lit(50.05), F.lit(14.05)), 4).alias("metres"))


@query("f_m4_f_m5_units", sql("SELECT activity_id, idx, round(CASE WHEN abs(lat * 11930464) > 180 THEN lat * 11930464 * 180 / 2147483648 ELSE lat * 11930464 END, 7) AS degrees, round(coalesce(speed, 0) * 3.6::DOUBLE, 7) AS kmh FROM records"))
def f_m4(spark, d):
    return view(spark, d, "records").select("activity_id", "idx", F.round(S.semicircles_to_degrees(F.col("lat") * 11930464), 7).alias("degrees"), F.round(S.kmh(F.col("speed")), 7).alias("kmh"))


@query("f_m8_scaling", sql("SELECT event_id, round(greatest(-1, least(1, (value - 100) / 50.0::DOUBLE)) * 50 + 50, 7) AS scaled FROM events"))
def f_m8(spark, d):
    from stridelake.functions.rolling import scaled

    return events(spark, d).select("event_id", F.round(scaled((F.col("value") - 100) / 50, -1, 1), 7).alias("scaled"))


@query("f_m9_step_scores", sql("SELECT event_id, CASE WHEN value <= 3 THEN 0 WHEN value <= 8 THEN 20 WHEN value <= 15 THEN 45 WHEN value <= 25 THEN 70 WHEN value <= 40 THEN 85 ELSE 100 END::DOUBLE AS score, CASE WHEN value < 5 THEN 15 WHEN value < 10 THEN 35 ELSE 55 END::DOUBLE AS strict_score FROM events"))
def f_m9(spark, d):
    v = F.col("value")
    return events(spark, d).select("event_id", S.step_score(v, [(3, 0), (8, 20), (15, 45), (25, 70), (40, 85)], 100).alias("score"), S.step_score(v, [(5, 15), (10, 35)], 55, strict=True).alias("strict_score"))


@query("f_m10_m11_effects", sql("SELECT activity_id, round(coalesce(nullif(z5, 0), least(5, 5 * (1 - exp(-total_trimp / 50)))), 7) AS effect, round(least(5, 5 * (1 - exp(-(z4 + z5) / 20))), 7) AS anaerobic FROM activities"))
def f_m11(spark, d):
    a = acts(spark, d)
    return a.select("activity_id", F.round(S.synthetic_effect(F.col("z5"), F.col("total_trimp"), 50), 7).alias("effect"), F.round(S.synthetic_effect(F.lit(None).cast("double"), F.col("z4") + F.col("z5"), 20), 7).alias("anaerobic"))


@query("p02_p03_p08_sports", sql("SELECT activity_id, CASE WHEN sport LIKE '%cycling%' OR sport LIKE '%biking%' THEN 0.833::DOUBLE ELSE 0.3::DOUBLE END AS threshold, regexp_matches(sport, 'cycl|bik|run|walk|hik|ski') AS cardio, regexp_matches(sport, 'cycl|biking|ride') AS cycling, regexp_matches(sport, 'hiking|walking') AS on_foot FROM activities"))
def p02(spark, d):
    c = F.col("sport")
    return acts(spark, d).select("activity_id", S.moving_speed(c).alias("threshold"), S.is_cardio(c).alias("cardio"), S.is_cycling(c).alias("cycling"), S.sport_matches(c, "hiking|walking").alias("on_foot"))


@query("p12_sanity_caps", sql("SELECT activity_id, CASE WHEN v <= cap THEN v END AS avg_kmh, CASE WHEN v <= cap THEN distance_km END AS distance_km FROM (SELECT *, round(distance_km / (duration_minutes / 60), 7) AS v, CASE WHEN regexp_matches(sport, 'cycl|biking|ride') THEN 60 WHEN regexp_matches(sport, 'run|walk|hik') THEN 30 ELSE 40 END AS cap FROM activities)"))
def p12(spark, d):
    c = F.col("sport")
    cap = F.when(S.is_cycling(c), 60).when(S.sport_matches(c, "run|walk|hik"), 30).otherwise(40)
    v = acts(spark, d).withColumn("v", F.round(F.col("distance_km") / (F.col("duration_minutes") / 60), 7))
    ok = F.col("v") <= cap
    return v.select("activity_id", F.when(ok, F.col("v")).alias("avg_kmh"), F.when(ok, F.col("distance_km")).alias("distance_km"))


@query("p13_lenient_cast", sql("SELECT doc_id, try_cast(text AS DOUBLE) AS whole, len(list_filter(string_split(text, ' '), lambda x: try_cast(x AS BIGINT) IS NOT NULL AND regexp_full_match(x, '[0-9]+'))) AS n_numbers, coalesce(list_sum(list_transform(list_filter(string_split(text, ' '), lambda x: regexp_full_match(x, '[0-9]+')), lambda x: coalesce(try_cast(x AS BIGINT) % 1000, 0))), 0)::BIGINT AS total FROM documents"))
def p13(spark, d):
    """Of whole texts: the text as a number, and its words that are whole numbers."""
    t = table(spark, d, "documents")
    numbers = F.transform(F.filter(F.split("text", " "), lambda w: w.rlike("^[0-9]+$")), lambda w: w.try_cast("bigint"))
    known = F.filter(numbers, lambda n: n.isNotNull())
    return t.select("doc_id", F.col("text").try_cast("double").alias("whole"), F.size(known).cast("long").alias("n_numbers"), F.coalesce(F.aggregate(known, F.lit(0).cast("long"), lambda a, n: a + n % 1000), F.lit(0)).alias("total"))


@query("p16_p17_range_filters", sql("SELECT activity_id, coalesce(avg_temp > 25, false) AS hot, CASE WHEN avg_hr > 30 AND avg_hr < 180 THEN avg_hr END AS hr FROM activities"))
def p16(spark, d):
    return acts(spark, d).select("activity_id", F.coalesce(F.col("avg_temp") > 25, F.lit(False)).alias("hot"), F.when((F.col("avg_hr") > 30) & (F.col("avg_hr") < 180), F.col("avg_hr")).alias("hr"))


@query("p20_p21_marker_styles", sql("SELECT event_id, CASE WHEN value >= 75 THEN 'red' WHEN value >= 50 THEN 'orange' WHEN value >= 25 THEN 'yellow' ELSE 'gray' END AS color, CASE WHEN value >= 50 THEN 'red' WHEN value >= 20 THEN 'orange' ELSE 'green' END AS color2, CASE WHEN value >= 75 THEN 'very likely' WHEN value >= 50 THEN 'likely' WHEN value >= 25 THEN 'possible' ELSE 'unlikely' END AS label, least(30, greatest(6, 4 + 1.5::DOUBLE * (user_id % 40))) AS radius, (8 + least(user_id % 40, 20))::DOUBLE AS radius2, CASE WHEN value >= 50 AND value * 0.8::DOUBLE >= 35 THEN 'high' WHEN user_id % 40 >= 3 AND value * 0.8::DOUBLE < 30 THEN 'frequent' ELSE 'moderate' END AS spot FROM events"))
def p20(spark, d):
    v, n = F.col("value"), F.col("user_id") % 40
    return events(spark, d).select("event_id", *(c.alias(k) for k, c in G.marker_style(v, n).items()), G.spot_category(v, v * 0.8, n).alias("spot"))


_SANITISED = lambda x: "regexp_replace(regexp_replace(regexp_replace(regexp_replace(strip_accents(trim(coalesce(" + x + ", ''))), '[\\s\\-]+', '_', 'g'), '[^\\pL\\pN_]', '', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"


@query("f_str1_str2_place_names", sql(f"SELECT doc_id, CASE WHEN s = '' THEN 'Unknown' ELSE s END AS place FROM (SELECT doc_id, {_SANITISED('text')} AS s FROM documents)"))
def f_str1(spark, d):
    return table(spark, d, "documents").select("doc_id", S.sanitised(F.col("text")).alias("place"))


TITLES = """CASE k % 6 WHEN 0 THEN 'Brno - Cyklistika' WHEN 1 THEN 'Sumava Gravel' WHEN 2 THEN 'Ride in ' || event_type WHEN 3 THEN 'MTB bike | road' WHEN 4 THEN NULL ELSE 'mountain  bike ' || user_id || '/Vltava' END"""
ADDRESSES = """CASE k % 5 WHEN 0 THEN '12, 602 00, okres Brno, Brno, Czechia' WHEN 1 THEN user_id || ' , Long Street 5' WHEN 2 THEN NULL WHEN 3 THEN '77, region X' ELSE 'Kraj Z,, Old Town' END"""


@query("f_str3_f_str4_places", sql(rf"""e AS (SELECT event_id, {TITLES} AS title, {ADDRESSES} AS address FROM (SELECT *, event_id AS k FROM events)),
t AS (SELECT *, nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '(?i)\b(cyklistika|gravel|ride|mtb|mountain\s*bike|bike|road)\b', ' ', 'g'), '(?i)\b(in)\b', ' ', 'g'), '[-|/]', ' ', 'g'), '\s+', ' ', 'g')), '') AS from_title,
  nullif(list_filter(list_transform(string_split(address, ','), lambda x: trim(x)), lambda x: NOT regexp_full_match(x, '[0-9\s]+') AND NOT regexp_matches(x, '(?i)\b(okres|kraj|region)\b'))[1], '') AS from_address FROM e)
SELECT event_id, from_title, from_address, CASE WHEN s = '' THEN 'Unknown' ELSE s END AS place FROM (SELECT *, {_SANITISED('coalesce(from_title, from_address)')} AS s FROM t)"""))
def f_str3(spark, d):
    e = events(spark, d).withColumn("k", F.col("event_id"))
    title, address = F.expr(TITLES), F.expr(ADDRESSES)
    return e.select("event_id", S.place_in_title(title).alias("from_title"), S.first_address_part(address).alias("from_address"), S.place_name(title, address).alias("place"))


@query("f_str5_eu_numbers", sql("SELECT event_id, value AS number, (value + (value + 2)) / 2 AS mean FROM events"))
def f_str5(spark, d):
    e = events(spark, d)
    eu = lambda x: F.regexp_replace(x.cast("string"), r"\.", ",")
    return e.select("event_id", S.eu_number(F.concat(F.lit("\""), eu(F.col("value")), F.lit("\""))).alias("number"), S.eu_number(F.concat(eu(F.col("value")), F.lit("-"), eu(F.col("value") + 2))).alias("mean"))


@query("f_str6_sleep_text", sql("SELECT event_id, nullif((user_id % 9) * 60 + event_id % 60, 0)::INTEGER AS minutes FROM events"))
def f_str6(spark, d):
    e = events(spark, d).withColumn("s", F.concat((F.col("user_id") % 9).cast("string"), F.lit("h "), (F.col("event_id") % 60).cast("string"), F.lit("m")))
    return e.select("event_id", S.sleep_minutes(F.col("s")).alias("minutes"))


@query("f_str8_map_urls", sql("SELECT activity_id, idx, printf('https://maps.example.org/?q=%.6f,%.6f', lat, lon) AS url, round(lat, 6) AS lat, round(lon, 6) AS lon FROM records WHERE lat IS NOT NULL"))
def f_str8(spark, d):
    r = view(spark, d, "records").filter("lat IS NOT NULL").withColumn("url", S.map_url(F.col("lat"), F.col("lon")))
    lat, lon = S.coordinates_of(F.col("url"))
    return r.select("activity_id", "idx", "url", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query("f_str9_export_names", sql("SELECT activity_id, printf('%s_%skm_%dmin_%dm_%d', date::VARCHAR, CASE WHEN distance_km IS NULL THEN '0.0' ELSE printf('%.1f', distance_km) END, CAST(duration_minutes AS BIGINT), CAST(coalesce(ascent_m, 0) AS BIGINT), activity_id) AS export_name FROM activities"))
def f_str9(spark, d):
    name = S.export_name(*map(F.col, ("date", "distance_km", "duration_minutes", "ascent_m", "activity_id")))
    return acts(spark, d).select("activity_id", name.alias("export_name"))


@query("f_str11_signed_text", sql("SELECT event_id, printf('%+.1f', round_even(round(value - 100, 9), 1)) AS delta FROM events"))
def f_str11(spark, d):
    return events(spark, d).select("event_id", S.signed(F.round(F.col("value") - 100, 9)).alias("delta"))


@query("f_dt2_day_first_dates", sql("SELECT event_id, CAST(ts AS DATE) AS d1, CAST(ts AS DATE) AS d2, NULL::DATE AS d3 FROM events"))
def f_dt2(spark, d):
    e = events(spark, d)
    return e.select("event_id", S.day_first_date(F.date_format("ts", "d.M.yyyy HH:mm")).alias("d1"), S.day_first_date(F.date_format("ts", "yyyy-MM-dd HH:mm")).alias("d2"), S.day_first_date(F.lit("soon")).alias("d3"))


@query("f_dt1_dt4_elapsed", sql("SELECT event_id, epoch_us(ts) // 1000000 AS unix_s, CAST(epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id)) AS DOUBLE) / 1000000 AS elapsed_s FROM events"))
def f_dt1(spark, d):
    from pyspark.sql import Window

    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = events(spark, d)
    return e.select("event_id", F.floor(us / 1000000).cast("long").alias("unix_s"), ((us - F.min(us).over(Window.partitionBy("user_id"))).cast("double") / 1000000).alias("elapsed_s"))


@query("f_dt5_clock_times", sql("SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS start_ts, CAST(date_trunc('second', ts) + INTERVAL 90 MINUTE AS TIMESTAMP) AS end_ts FROM events"))
def f_dt5(spark, d):
    start = F.try_to_timestamp(F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss")), F.lit("yyyy-MM-dd HH:mm:ss"))
    e = events(spark, d).withColumn("start_ts", start)
    return e.select("event_id", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), (F.col("start_ts") + F.expr("INTERVAL 90 MINUTES")).cast("timestamp_ntz").alias("end_ts"))


@query("f_map1_zone_energy", sql("SELECT event_id, CASE event_type WHEN 'view' THEN 6 WHEN 'click' THEN 8 WHEN 'purchase' THEN 10 ELSE 0 END::DOUBLE AS kcal FROM events"))
def f_map1(spark, d):
    m = F.create_map(*(F.lit(x) for kv in {"view": 6.0, "click": 8.0, "purchase": 10.0}.items() for x in kv))
    return events(spark, d).select("event_id", F.coalesce(F.element_at(m, F.col("event_type")), F.lit(0.0)).alias("kcal"))


@query("s06_activity_id_from_name", sql("SELECT event_id, user_id::VARCHAR AS id1, event_id::VARCHAR AS id2, 'ride' AS id3 FROM events"))
def s06(spark, d):
    c = lambda x: F.col(x).cast("string")
    e = events(spark, d)
    return e.select("event_id", S.activity_id_of(F.concat(F.lit("/a/activity_"), c("user_id"), F.lit(".fit"))).alias("id1"), S.activity_id_of(F.concat(F.lit("b/"), c("event_id"), F.lit("_ACTIVITY.fit.gz"))).alias("id2"), S.activity_id_of(F.lit("x/ride.fit")).alias("id3"))


@query("f_arr3_t06_date_lists", sql("SELECT user_id, array_to_string(d[greatest(1, len(d) - 4):], ', ') || CASE WHEN len(d) > 5 THEN ' + ' || (len(d) - 5) || ' older' ELSE '' END AS dates FROM (SELECT user_id, list_sort(list(DISTINCT CAST(ts AS DATE)::VARCHAR)) AS d FROM events GROUP BY 1)"))
def f_arr3(spark, d):
    g = events(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_set(F.to_date("ts").cast("string"))).alias("d"))
    last = F.array_join(F.slice("d", F.greatest(F.lit(1), F.size("d") - 4), F.lit(5)), ", ")
    return g.select("user_id", F.when(F.size("d") > 5, F.concat(last, F.lit(" + "), (F.size("d") - 5).cast("string"), F.lit(" older"))).otherwise(last).alias("dates"))
