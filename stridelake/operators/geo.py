"""Places: distance joins over grid cells, clusters of stops, hotspots and markers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.functions.scalars import haversine_m, map_url
from stridelake.profile import DEFAULT, Profile
from stridelake.sources.tables import stored

#: Metres of a degree of latitude, a little less than it has, so that cells are never too small.
DEGREE_M = 110_000.0


def _cells(lat: Column, lon: Column, metres: float, widest_lat: float = 85.0) -> tuple[Column, Column]:
    """Row and column of a grid whose cells are `metres` wide at least; the width of a column depends on its row alone."""
    row = F.floor(lat * DEGREE_M / metres)
    edge = F.least(F.lit(widest_lat), (F.abs(row) + 2) * metres / DEGREE_M)  # the latitude of the row's far side, and one more
    return row.cast("long"), F.floor(lon * DEGREE_M * F.cos(F.radians(edge)) / metres).cast("long")


def within(a: DataFrame, b: DataFrame, metres: float) -> DataFrame:
    """Pairs of rows of a (lat, lon, more) and b (lat_b, lon_b, more) at most `metres` apart, with the distance: an equality
    join on grid cells. Each row of b is put in the cells around it, in the columns of that cell's row."""
    row_a, col_a = _cells(F.col("lat"), F.col("lon"), metres)
    left = a.filter("lat IS NOT NULL AND lon IS NOT NULL").withColumns({"_row": row_a, "_col": col_a})
    near = b.filter("lat_b IS NOT NULL AND lon_b IS NOT NULL").withColumn("_step", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    row_b = F.floor(F.col("lat_b") * DEGREE_M / metres).cast("long") + F.col("_step")
    edge = F.least(F.lit(85.0), (F.abs(row_b) + 2) * metres / DEGREE_M)
    col_b = F.floor(F.col("lon_b") * DEGREE_M * F.cos(F.radians(edge)) / metres).cast("long")
    near = near.withColumns({"_row": row_b, "_mid": col_b}).withColumn("_col", F.explode(F.sequence(F.col("_mid") - 1, F.col("_mid") + 1))).drop("_step", "_mid")
    far = haversine_m(F.col("lat"), F.col("lon"), F.col("lat_b"), F.col("lon_b"))
    return left.join(near, ["_row", "_col"]).withColumn("distance_m", far).filter(F.col("distance_m") <= metres).drop("_row", "_col")


def _components(pairs: DataFrame) -> DataFrame:
    """node, root (the least node reachable) of an undirected graph of pairs (a, b), by alternating large and small stars: the
    rounds grow with the logarithm of the longest chain. Ends when nothing changes; a round's table goes once the next is written."""
    edges = stored(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    told = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(lower, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        edges = stored(star, instead_of=edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == told:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        told = now


#: Metres of a degree on the sphere of haversine_m.
SPHERE_DEGREE_M = 6371000.0 * math.pi / 180
#: A box is split in so many rows and columns at a time; from this many splits on, places stand by themselves.
SPLIT, LAST_SPLIT = 8, 14


def _box() -> list[Column]:
    """Aggregates of places: the box they fill and one of them."""
    ends = [f(c).alias(f"{c}{n}") for c in ("lat", "lon") for n, f in ((0, F.min), (1, F.max))]
    return [*ends, F.min(F.struct("lat", "lon")).alias("one")]


def _gap(a: str, b: str) -> Column:
    """Metres that any two places of two boxes (columns with prefixes a and b) are apart at least."""
    c = F.col
    apart = lambda x, turn=0: F.greatest(F.lit(0.0), c(f"{b}{x}0") + turn - c(f"{a}{x}1"), c(f"{a}{x}0") - c(f"{b}{x}1") - turn)
    dlat, dlon = F.radians(apart("lat")), F.radians(F.least(apart("lon"), apart("lon", 360.0), apart("lon", -360.0)))
    cos = lambda p: F.least(F.cos(F.radians(c(f"{p}lat0"))), F.cos(F.radians(c(f"{p}lat1"))))
    x = F.pow(F.sin(dlat / 2), 2) + F.greatest(F.lit(0.0), cos(a) * cos(b)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * 6371000.0 * F.asin(F.least(F.lit(1.0), F.sqrt(x)))


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))


def _judged(pairs: DataFrame, metres: float) -> DataFrame:
    """Pairs of boxes that may have places within `metres`, with linked: whether the places that stand for them are; and open: whether
    that they are not leaves the question open."""
    far = haversine_m(F.col("a_one.lat"), F.col("a_one.lon"), F.col("b_one.lat"), F.col("b_one.lon"))
    single = F.lit(True)
    for x in ("a_lat", "a_lon", "b_lat", "b_lon"):
        single = single & (F.col(f"{x}0") == F.col(f"{x}1"))
    near = pairs.filter(_gap("a_", "b_") <= metres + 1e-6).withColumn("linked", far <= metres)
    return near.withColumn("open", ~F.col("linked") & ~single)


def _near(cells: DataFrame, metres: float) -> DataFrame:
    """Pairs of cells (cell, row, col, the columns of _box(), more) that may have places at most `metres` apart, by the rows and columns
    around them: columns with prefixes a_ and b_, the lesser cell first, each with itself too. Around a pole a pair may come twice."""
    side = _side_m(metres)
    high, reach = F.least(F.lit(89.999999), F.greatest(F.abs("lat0"), F.abs("lat1")) + metres / SPHERE_DEGREE_M), metres / SPHERE_DEGREE_M * 1.01
    wide = F.least(F.lit(180.0), reach / F.cos(F.radians(high)))
    around = cells.withColumns({"_wide": wide, "_turn": F.explode(F.array(F.lit(-360.0), F.lit(0.0), F.lit(360.0)))})
    around = around.filter("lon0 + _turn - _wide <= 180 AND lon1 + _turn + _wide >= -180").withColumn("_row", F.explode(F.sequence(F.col("row") - 2, F.col("row") + 2)))
    dlon = _column_degrees(F.col("_row"), side)
    first, last = (F.floor((F.col("lon0") + F.col("_turn") - F.col("_wide")) / dlon), F.floor((F.col("lon1") + F.col("_turn") + F.col("_wide")) / dlon))
    first, last = F.greatest(first, F.floor(-180 / dlon)), F.least(last, F.floor(180 / dlon))
    around = around.withColumns({"_first": first, "_last": last}).filter("_first <= _last").withColumn("_col", F.explode(F.sequence("_first", "_last")))
    a = _prefixed(around.select("_row", "_col", *(c for c in cells.columns if c not in ("row", "col"))), "a_")
    b = _prefixed(cells, "b_")
    return a.join(b, (F.col("a__row") == F.col("b_row")) & (F.col("a__col") == F.col("b_col")) & (F.col("a_cell") <= F.col("b_cell")))


def _cell_links(placed: DataFrame, metres: float) -> DataFrame:
    """a, b: pairs of cells (by id) that have places at most `metres` apart. placed: cell, row, col, lat, lon of every place.

    Cells are compared by the boxes their places fill and by one place each. Where that does not decide, both boxes are split and
    only the parts that may still be near are compared, so that a pair of crowded cells costs some rounds and not all its pairs."""
    side = _side_m(metres)
    cells = stored(placed.groupBy("cell", "row", "col").agg(*_box()))
    pairs = _near(cells, metres).filter("a_cell < b_cell")
    told = stored(_judged(pairs, metres).groupBy(F.col("a_cell").alias("a"), F.col("b_cell").alias("b")).agg(F.max("linked").alias("linked"), F.max("open").alias("open")))
    links = told.filter("linked").select("a", "b")
    zero = F.lit(0).cast("long")
    left, split = told.filter("NOT linked AND open").select("a", "b", zero.alias("a_up_row"), zero.alias("a_up_col"), zero.alias("b_up_row"), zero.alias("b_up_col")), 0
    while left.limit(1).count():
        split += 1
        asked = left.select(F.col("a").alias("cell")).unionByName(left.select(F.col("b").alias("cell"))).distinct()
        own = placed.join(asked, "cell", "left_semi")
        dlat = side / SPHERE_DEGREE_M
        x, y = F.col("lat") / dlat - F.col("row"), F.col("lon") / _column_degrees(F.col("row"), side) - F.col("col")
        fine = float(SPLIT ** min(split, LAST_SPLIT))
        own = own.withColumns({"sub_row": F.floor(x * fine), "sub_col": F.floor(y * fine)})
        key = ["cell", "sub_row", "sub_col"] if split < LAST_SPLIT else ["cell", "sub_row", "sub_col", "lat", "lon"]
        parts = own.groupBy(*key).agg(*_box()).select("cell", "sub_row", "sub_col", "lat0", "lat1", "lon0", "lon1", "one")
        up = lambda c: F.floor(F.col(c) / SPLIT).cast("long")  # noqa: E731  what multiplies by a power of two is exact
        parts = parts.withColumns({"up_row": up("sub_row"), "up_col": up("sub_col")}) if split <= LAST_SPLIT else parts.withColumns({"up_row": F.col("sub_row"), "up_col": F.col("sub_col")})
        of = lambda p: _prefixed(parts, p).withColumnRenamed(f"{p}cell", p[0])
        both = left.join(of("a_"), ["a", "a_up_row", "a_up_col"]).join(of("b_"), ["b", "b_up_row", "b_up_col"])
        names = {"a_sub_row": "a_up_row", "a_sub_col": "a_up_col", "b_sub_row": "b_up_row", "b_sub_col": "b_up_col"}
        judged = _judged(both, metres).filter("linked OR open").select("a", "b", "linked", *(F.col(c).alias(n) for c, n in names.items()))
        left = stored(judged, instead_of=left)
        linked = stored(left.filter("linked").select("a", "b").distinct())
        links = links.unionByName(linked)
        left = left.filter("NOT linked").drop("linked").join(linked, ["a", "b"], "left_anti")
    return links


def _side_m(metres: float) -> float:
    """The side of cells whose diagonal is a little under `metres`."""
    return metres / math.sqrt(2) * 0.995


def _column_degrees(row: Column, side: float) -> Column:
    """Degrees of longitude of the cells of a row: its edge next to the equator, where they are widest, is `side` metres."""
    edge = F.when(row >= 0, row).otherwise(-row - 1) * (side / SPHERE_DEGREE_M)
    return side / SPHERE_DEGREE_M / F.greatest(F.cos(F.radians(edge)), F.lit(1e-9))


#: Points of a block: what a pair of blocks yields at once is at most the square.
BLOCK = 256
#: Pairs of points that a task compares, about, and pairs of blocks.
TASK_PAIRS, TASK_BLOCKS = 50_000_000, 100_000


def neighbour_pairs(points: DataFrame, metres: float, digits: int | None = None) -> DataFrame:
    """point_id, point_id_b (greater) and distance_m (rounded to digits, if given) of all pairs of points (point_id, lat, lon) at
    most `metres` apart.

    The result grows with the square of a spot's visits, and nothing else does: points of a grid cell are cut into blocks, pairs of near
    blocks are dealt over tasks by the pairs of points they hold, and a distance is worked out once for two places, however many points
    lie there. A task holds a pair of blocks at a time. Exact at poles and across the antimeridian too."""
    c, side = F.col, _side_m(metres)
    finite = (F.abs("lat") < float("inf")) & (F.abs("lon") < float("inf"))  # neither null nor NaN
    turned = F.when(F.abs("lon") <= 180, c("lon")).otherwise(F.pmod(c("lon") + 180, F.lit(360.0)) - 180)
    placed = points.filter(finite).select("point_id", "lat", c("lon").alias("_lon"), turned.alias("lon"))
    placed = placed.withColumn("row", F.floor(c("lat") * SPHERE_DEGREE_M / side)).withColumn("col", F.floor(c("lon") / _column_degrees(c("row"), side)))
    before = F.row_number().over(Window.partitionBy("row", "col").orderBy("lat", "lon", "point_id")) - 1
    cut = placed.withColumn("_block", F.floor(before / BLOCK))
    places = cut.groupBy("row", "col", "_block", "lat", "lon", "_lon").agg(F.collect_list("point_id").alias("ids"))
    whole = F.collect_list(F.struct("lat", c("_lon").alias("lon"), "ids")).alias("places")
    blocks = stored(places.groupBy("row", "col", "_block").agg(*_box(), F.sum(F.size("ids")).alias("points"), whole).drop("_block").withColumn("cell", F.monotonically_increasing_id()))

    near = _near(blocks.drop("places"), metres).filter(_gap("a_", "b_") <= metres + 1e-6)
    pairs = stored(near.select(c("a_cell").alias("a"), c("b_cell").alias("b"), (c("a_points") * c("b_points")).alias("work")).distinct())
    work, count = pairs.agg(F.coalesce(F.sum("work"), F.lit(0)), F.count("*")).first()
    parts = max(2 * points.sparkSession.sparkContext.defaultParallelism, work // TASK_PAIRS, count // TASK_BLOCKS)
    of = lambda p: blocks.select(c("cell").alias(p), c("places").alias(f"{p}_places")).repartition(parts, p)
    both = pairs.select("a", "b").repartition(parts, "a").join(of("a"), "a").repartition(parts, "b").join(of("b"), "b")
    two = both.select((c("a") == c("b")).alias("_own"), "b_places", F.explode("a_places").alias("p")).select("_own", "p", F.explode("b_places").alias("q"))
    far = haversine_m(c("p.lat"), c("p.lon"), c("q.lat"), c("q.lon"))
    two = two.withColumn("distance_m", far).filter(c("distance_m") <= metres)
    told = c("distance_m") if digits is None else F.round("distance_m", digits).alias("distance_m")
    two = two.select("_own", told, c("q.ids").alias("q"), F.explode("p.ids").alias("i")).select("_own", "distance_m", "i", F.explode("q").alias("j"))
    # A block meets itself in either order; two blocks meet once.
    once = F.when(c("_own"), c("i") < c("j")).otherwise(c("i") != c("j"))
    return two.filter(once).select(F.least("i", "j").alias("point_id"), F.greatest("i", "j").alias("point_id_b"), "distance_m")


def clusters(points: DataFrame, metres: float = DEFAULT.cluster_m) -> DataFrame:
    """D-42: points (point_id, lat, lon) with cluster_id, the least point_id that is reachable by steps of at most `metres`
    (density clustering with one point enough).

    Points of one place are one; places of one grid cell, whose diagonal is under `metres`, are one node. What is linked, and joined
    along links until nothing changes, is cells, so the links grow with the places however crowded a spot is."""
    known = points.filter("lat IS NOT NULL AND lon IS NOT NULL")
    side = _side_m(metres)
    row = F.floor(F.col("lat") * SPHERE_DEGREE_M / side)
    placed = known.groupBy("lat", "lon").agg(F.min("point_id").alias("place")).withColumn("row", row).withColumn("col", F.floor(F.col("lon") / _column_degrees(F.col("row"), side)))
    ids = placed.groupBy("row", "col").agg(F.min("place").alias("cell"))
    placed = stored(placed.join(ids, ["row", "col"]))
    roots = _components(_cell_links(placed, metres)).withColumnRenamed("node", "cell")
    own = placed.join(roots, "cell", "left").select("lat", "lon", F.coalesce("root", "cell").alias("cluster_id"))
    return known.join(own, ["lat", "lon"])


def _ranked(df: DataFrame, *order: Column) -> DataFrame:
    """df with rank (1 first) by a total order: row numbers within ranges of it, after the rows of the ranges before."""
    ranged = stored(df.orderBy(*order).withColumn("_range", F.spark_partition_id()))
    counts = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}  # a row for each partition
    before, offsets = 0, []
    for k in sorted(counts):
        offsets.append((k, before))
        before += counts[k]
    if not offsets:
        return ranged.withColumn("rank", F.lit(0).cast("long")).drop("_range")
    start = F.broadcast(df.sparkSession.createDataFrame(offsets, "_range int, _before long"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_own", own).join(start, "_range").withColumn("rank", F.col("_before") + F.col("_own")).drop("_range", "_before", "_own")


def hotspots(clustered: DataFrame, profile: Profile = DEFAULT, addresses: DataFrame | None = None) -> DataFrame:
    """D-43: a ranked row for each cluster that is likely enough or visited three times, from point rows with confidence,
    duration_min and date; the address is looked up by the centroid rounded to four decimals."""
    g = clustered.groupBy("cluster_id").agg(
        F.count("*").alias("visit_count"),
        F.bround(F.round(F.avg("confidence"), 9), 1).alias("avg_confidence"),
        F.max("confidence").alias("max_confidence"),
        F.bround(F.round(F.avg("duration_min"), 9), 1).alias("avg_duration_min"),
        F.round(F.round(F.avg("lat"), 9), 6).alias("centroid_lat"),
        F.round(F.round(F.avg("lon"), 9), 6).alias("centroid_lon"),
        F.array_sort(F.collect_set("date")).alias("_dates"),
    )
    g = g.filter((F.col("max_confidence") >= profile.min_confidence) | (F.col("visit_count") >= 3))
    g = _ranked(g, F.col("visit_count").desc(), F.col("avg_confidence").desc(), F.col("cluster_id"))
    older = F.size("_dates") - 5
    last = F.array_join(F.transform(F.slice("_dates", F.greatest(F.lit(1), older + 1), F.lit(5)), lambda x: x.cast("string")), ", ")
    out = g.withColumns({
        "spot_category": spot_category(F.col("max_confidence"), F.col("avg_confidence"), F.col("visit_count")),
        "dates": F.when(older > 0, F.concat(last, F.lit(" + "), older.cast("string"), F.lit(" older"))).otherwise(last),
        "map_url": map_url(F.col("centroid_lat"), F.col("centroid_lon")),
        "address_key": address_key(F.col("centroid_lat"), F.col("centroid_lon")),
    }).drop("_dates")
    return out if addresses is None else addressed(out, addresses)


def addressed(spots: DataFrame, addresses: DataFrame) -> DataFrame:
    """Rows with an address_key and the address of a table (key, address), null where it has none."""
    return spots.join(addresses.withColumnRenamed("key", "address_key"), "address_key", "left")


def spot_category(most: Column, mean: Column, visits: Column) -> Column:
    """P20."""
    return F.when((most >= 50) & (mean >= 35), "high").when((visits >= 3) & (mean < 30), "frequent").otherwise("moderate")


def address_key(lat: Column, lon: Column) -> Column:
    """Both coordinates rounded to four decimals, as texts without trailing zeros."""
    four = lambda x: F.bround(F.round(x, 9), 4).cast("string")
    return F.concat_ws(",", four(lat), four(lon))


def hotspot_listing(points: DataFrame, spots: DataFrame, metres: float = DEFAULT.match_m) -> DataFrame:
    """D-45: for each hotspot (cluster_id, centroid_lat, centroid_lon) its marker's listing, a row for each stop within `metres`: the stop
    with its distance, the line it stands on (likeliest first), and how many stops there are, the best confidence and the minutes in
    all. A hotspot without any has no row. The facts of the whole listing are joined back, so that a busy place is a sort and no list."""
    b = spots.select("cluster_id", F.col("centroid_lat").alias("lat_b"), F.col("centroid_lon").alias("lon_b"))
    near = stored(within(points, b, metres))
    facts = near.groupBy("cluster_id").agg(F.count("*").alias("n_stops"), F.max("confidence").alias("best_confidence"), F.sum("duration_min").alias("minutes"))
    line = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("confidence"), "point_id")).cast("long")
    return near.select("cluster_id", line.alias("line"), "point_id", "confidence", "duration_min", "date", F.round("distance_m", 1).alias("distance_m")).join(facts, "cluster_id")


def marker_style(confidence: Column, visits: Column) -> dict[str, Column]:
    """Colours on both scales, the label, and both radii."""
    return {
        "color": F.when(confidence >= 75, "red").when(confidence >= 50, "orange").when(confidence >= 25, "yellow").otherwise("gray"),
        "color2": F.when(confidence >= 50, "red").when(confidence >= 20, "orange").otherwise("green"),
        "label": F.when(confidence >= 75, "very likely").when(confidence >= 50, "likely").when(confidence >= 25, "possible").otherwise("unlikely"),
        "radius": F.least(F.lit(30.0), F.greatest(F.lit(6.0), 4 + 1.5 * visits)),
        "radius2": (8 + F.least(visits, F.lit(20))).cast("double"),
    }
