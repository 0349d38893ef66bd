"""URL filters with dated lists: entries become validity intervals, and each capture is judged by those active at its fetch time.

A list change is (domain, category, ts, action): add opens an interval of the domain and category, the next remove closes it.
A capture matches the entries of its host and of every parent domain of the host. Overlapping intervals are first merged to
disjoint ones; joins are on domain and time bucket, so a capture meets only the intervals of its bucket, and a host that a
third of all captures have is split by time (and by Spark's skew join within a bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.llm.common import table

#: Seconds of a time bucket of the as-of join: captures of one host are split by it, and an interval is repeated for each it spans.
BUCKET_S = 5 * 86400


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and final dot; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^/?#:@]+)", 1)
    return F.nullif(F.regexp_replace(host, r"\.$", ""), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and its parent domains of two labels or more: a.b.c gives a.b.c and b.c. A host of one label gives itself."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    ends = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.when(host.isNotNull(), ends)


def intervals(changes: DataFrame) -> DataFrame:
    """Disjoint validity intervals (domain, category, valid_from, valid_to) of list changes; valid_to is null while open.

    An add while active and a remove while inactive change nothing; of changes at one time the remove comes last. Rows with
    a null domain, category or time and other actions are left out."""
    known = changes.filter("domain IS NOT NULL AND category IS NOT NULL AND ts IS NOT NULL AND action IN ('add', 'remove')")
    in_order = Window.partitionBy("domain", "category").orderBy("ts", "action")
    turned = known.withColumn("_before", F.lag("action").over(in_order)).filter("action <> coalesce(_before, 'remove')")
    ends = turned.withColumn("valid_to", F.lead("ts").over(in_order)).filter("action = 'add'")
    return ends.select("domain", "category", F.col("ts").alias("valid_from"), "valid_to").filter("valid_to IS NULL OR valid_to > valid_from")


def judged(captures: DataFrame, changes: DataFrame, bucket_s: int = BUCKET_S) -> DataFrame:
    """captures (page_id, url, fetch_ts) with host, n_active (entries active at the fetch), categories (sorted, comma-joined,
    empty if none) and blocked. valid_from counts as active, valid_to does not.

    A null or hostless URL and a null fetch time match nothing. Every capture has its row, repeated ones too. Empty lists block
    nothing."""
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1_000_000
    bucket = lambda c: F.floor(seconds(c) / bucket_s).cast("long")
    held = captures.select("page_id", "url", "fetch_ts").withColumn("host", host_of(F.col("url")))
    span = held.agg(F.min(bucket(F.col("fetch_ts"))).alias("lo"), F.max(bucket(F.col("fetch_ts"))).alias("hi")).first()
    lo, hi = span["lo"] or 0, span["hi"] or 0
    first = F.greatest(bucket(F.col("valid_from")), F.lit(lo))
    last = F.least(F.coalesce(bucket(F.col("valid_to")), F.lit(hi)), F.lit(hi))
    pieces = intervals(changes).withColumns({"_first": first, "_last": last}).filter("_first <= _last")
    pieces = pieces.select("domain", "category", "valid_from", "valid_to", F.explode(F.sequence("_first", "_last")).alias("_bucket"))
    asked = held.distinct().select("page_id", "url", "fetch_ts", F.explode(suffixes(F.col("host"))).alias("domain"), bucket(F.col("fetch_ts")).alias("_bucket"))
    active = asked.join(pieces, ["domain", "_bucket"]).filter("fetch_ts >= valid_from AND (valid_to IS NULL OR fetch_ts < valid_to)")
    found = active.groupBy("page_id", "url", "fetch_ts").agg(F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    out = held.alias("h").join(found.alias("f"), [F.col(f"h.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("page_id", "url", "fetch_ts")], "left")
    return out.select("h.page_id", "h.url", "h.fetch_ts", "h.host", F.coalesce("f.n_active", F.lit(0)).alias("n_active"), F.coalesce("f.categories", F.lit("")).alias("categories"), F.col("f.n_active").isNotNull().alias("blocked"))


#: The given tables hold no fetch times or lists, so the query derives both: a page is fetched in January 2024 at a second that its
#: id fixes, and each event of a user is a list change for the host of the page with that number, or for its parent domain.
CAPTURES = "page_id, url, timestamp_seconds(1704067200 + (page_id * 7919) % 2592000) AS fetch_ts"


def derived_changes(events: DataFrame, pages: DataFrame) -> DataFrame:
    listed = pages.select(F.col("page_id").alias("user_id"), host_of(F.col("url")).alias("host")).filter("host IS NOT NULL")
    parent = F.regexp_replace("host", r"^[^.]+\.(?=[^.]+\.)", "")
    category = F.when(F.col("event_type").isin("error", "signup"), "malware").when(F.col("event_type") == "purchase", "shop").otherwise("adult")
    action = F.when(F.col("value") < 50, "remove").otherwise("add")
    domain = F.when(F.col("value") > 150, parent).otherwise(F.col("host"))
    return events.join(listed, "user_id").select(domain.alias("domain"), category.alias("category"), F.col("ts").cast("timestamp").alias("ts"), action.alias("action"))


def page_verdicts(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    captures = pages.selectExpr(*(x.strip() for x in CAPTURES.split(", ", 2)))
    out = judged(captures, derived_changes(table(spark, sf_dir, "events"), pages))
    return out.select("page_id", "host", "n_active", "categories", "blocked")


SQL = r"""
WITH held AS (
  SELECT page_id, url, make_timestamp((1704067200 + (page_id * 7919) % 2592000) * 1000000) AS fetch_ts,
         nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^/?#:@]+)', 1), '\.$', ''), '') AS host
  FROM pages
), changes AS (
  SELECT CASE WHEN e.value > 150 AND len(string_split(h.host, '.')) > 2 THEN array_to_string(string_split(h.host, '.')[2:], '.') ELSE h.host END AS domain,
         CASE WHEN event_type IN ('error', 'signup') THEN 'malware' WHEN event_type = 'purchase' THEN 'shop' ELSE 'adult' END AS category,
         e.ts, CASE WHEN value < 50 THEN 'remove' ELSE 'add' END AS action
  FROM events e JOIN held h ON e.user_id = h.page_id WHERE h.host IS NOT NULL
), turned AS (
  SELECT * FROM (SELECT *, lag(action) OVER (PARTITION BY domain, category ORDER BY ts, action) AS b FROM changes)
  WHERE action <> coalesce(b, 'remove')
), iv AS (
  SELECT domain, category, ts AS valid_from, valid_to FROM
    (SELECT *, lead(ts) OVER (PARTITION BY domain, category ORDER BY ts, action) AS valid_to FROM turned)
  WHERE action = 'add' AND (valid_to IS NULL OR valid_to > ts)
), asked AS (
  SELECT page_id, fetch_ts, unnest(list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS domain
  FROM held WHERE host IS NOT NULL
), found AS (
  SELECT page_id, count(*) AS n_active, array_to_string(list_sort(list_distinct(list(category))), ',') AS categories
  FROM asked JOIN iv USING (domain) WHERE fetch_ts >= valid_from AND (valid_to IS NULL OR fetch_ts < valid_to) GROUP BY page_id
)
SELECT page_id, host, coalesce(n_active, 0) AS n_active, coalesce(categories, '') AS categories, n_active IS NOT NULL AS blocked
FROM held LEFT JOIN found USING (page_id)
"""
