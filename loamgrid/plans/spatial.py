"""Queries of points, areas, grids and distances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamgrid.functions import geo
from loamgrid.operators import spatial as S
from loamgrid.plans import views as V

CELL = 0.2
#: Haversine metres between (x1, y1) and (x2, y2) in SQL, as the library's columns compute them.
METRES_SQL = (
    "asin(sqrt(least(1.0::DOUBLE, sin(radians({y2} - {y1}) / 2) * sin(radians({y2} - {y1}) / 2) + cos(radians({y1})) * cos(radians({y2}))"
    " * sin(radians({x2} - {x1}) / 2) * sin(radians({x2} - {x1}) / 2)))) * 12742017.6::DOUBLE"
)


def metres_sql(a: str, b: str) -> str:
    return METRES_SQL.format(x1=f"{a}.lon", y1=f"{a}.lat", x2=f"{b}.lon", y2=f"{b}.lat")


INSIDE = "p.lon >= a.xmin AND p.lon < a.xmax AND p.lat >= a.ymin AND p.lat < a.ymax"


def a01(spark, d):
    out = S.count_points_in_areas(V.event_points(spark, d), V.area_boxes(spark, d), "area_id", CELL)
    return out.select("area_id", "area", "point_count").orderBy(F.desc("point_count"), "area_id")


def a02(spark, d):
    """All statistics of an area's points from one join."""
    boxes = V.area_boxes(spark, d)
    pairs = S.points_in_boxes(V.event_points(spark, d), boxes, CELL)
    made = {"sum": F.sum("value"), "mean": F.avg("value"), "median": F.median("value"), "min": F.min("value"), "max": F.max("value"), "std": F.stddev_samp("value")}
    found = pairs.groupBy("area_id").agg(*[F.round(c, 6).alias(f"value_{n}") for n, c in made.items()])
    return boxes.select("area_id").join(found, "area_id", "left").na.fill(0.0, ["value_sum"])


def _metric(points):
    """Metres in the UTM zone of the middle of the layer, which one row of bounds tells."""
    low, high = points.agg(F.min("lon"), F.max("lon")).first()
    return geo.utm_xy(F.col("lon"), F.col("lat"), F.lit(geo.utm_central(((low or 0.0) + (high or 0.0)) / 2)))


def a03(spark, d):
    points = V.event_points(spark, d)
    return S.grid_square(points, 5000.0, *_metric(points), 2)


def a04(spark, d):
    points = V.event_points(spark, d)
    return S.grid_hex(points, 4000.0, *_metric(points))


def j01(spark, d):
    pairs = S.points_in_rings(V.event_points(spark, d), V.area_diamonds(spark, d), CELL)
    return pairs.groupBy("area_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def j02(spark, d):
    boxes = V.area_boxes(spark, d)
    pairs = S.points_in_boxes(V.site_points(spark, d), boxes, CELL).select("area_id", "site_id", "balance")
    return boxes.select("area_id").join(pairs, "area_id", "left")


def j04(spark, d):
    out = S.nearest_join(V.event_points(spark, d), V.site_points(spark, d), "event_id", "site_id", 4000.0)
    km = geo.convert_length(F.col("distance_m"), F.lit("m"), F.lit("mi"))
    return out.select("event_id", "site_id", F.round("distance_m", 3).alias("distance_m"), F.round(km, 6).alias("distance_mi"))


def j04_capped(spark, d):
    out = S.nearest_join(V.demand_points(spark, d), V.site_points(spark, d), "demand_id", "site_id", 1000.0, max_m=2500.0)
    return out.select("demand_id", "site_id", F.round("distance_m", 3).alias("distance_m"))


def j05(spark, d):
    return S.within_distance(V.demand_points(spark, d), V.site_points(spark, d), 1609.344, "demand_id", "site_id").withColumn("distance_m", F.round("distance_m", 3))


def j06(spark, d):
    events = V.event_points(spark, d).select("event_id", "lon", "lat", F.col("ts"), "event_type")
    anchors = events.where("event_type = 'error'").select(F.col("event_id").alias("anchor_id"), "lon", "lat", "ts")
    return S.space_time_counts(events, anchors, "anchor_id", 5_000.0, 86400).select("anchor_id", "n", F.round("farthest_m", 3).alias("farthest"))


def j11(spark, d, rook=False):
    pairs = S.contiguity(V.area_rings(spark, d), "area_id", rook=rook)
    return pairs.groupBy("i").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("j")), ",").alias("neighbours"))


def j12(spark, d):
    band = S.distance_band(V.site_points(spark, d), "site_id", 9000.0)
    return band.withColumn("distance_m", F.round("distance_m", 3))


def j12_least(spark, d):
    least = S.least_band_without_islands(V.site_points(spark, d), "site_id", 4000.0)
    return spark.range(1).select(F.round(F.lit(least), 2).alias("threshold_m"))


def j13(spark, d):
    return S.knn_weights(V.site_points(spark, d), "site_id", 6, 8000.0).select("i", "j", "rank", F.round("distance_m", 3).alias("distance_m"))


def j25(spark, d):
    left = V.area_boxes(spark, d)
    right = left.select(F.col("area_id").alias("moved_id"), *[(F.col(c) + 0.07).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])
    out = S.box_overlay(left, right, "area_id", "moved_id", CELL)
    return out.select("area_id", "moved_id", *[F.round(c, 9).alias(c) for c in ("xmin", "ymin", "xmax", "ymax", "area")])


def j25_difference(spark, d):
    """Left area less what the clips, which don't overlap one another, take."""
    left = V.area_boxes(spark, d)
    clips = left.where("area_id % 2 = 0").select(F.col("area_id").alias("clip_id"), *[(F.col(c) + 0.05).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])
    cut = S.box_overlay(left, clips, "area_id", "clip_id", CELL).groupBy("area_id").agg(F.sum("area").alias("cut"))
    own = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    return left.join(cut, "area_id", "left").select("area_id", F.round(own - F.coalesce("cut", F.lit(0.0)), 9).alias("left_over"))


def _mixed_boxes(spark, d):
    """Boxes, lines and points that lie to the areas in all ways: moved, shrunk, grown, equal, edges, crossing lines, corners and middles."""
    a = V.area_boxes(spark, d)
    w = F.lit(0.05)
    x, y = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    forms = [
        (F.col("xmin") + w, F.col("ymin") + w, F.col("xmax") + w, F.col("ymax") + w), (F.col("xmin") + w, F.col("ymin") + w, F.col("xmax") - w, F.col("ymax") - w), tuple(F.col(c) for c in S.CORNERS),
        (F.col("xmin"), F.col("ymin"), F.col("xmin"), F.col("ymax")), (F.col("xmin") - w, y, F.col("xmin") + w, y), (F.col("xmin"), F.col("ymin"), F.col("xmin"), F.col("ymin")), (x, y, x, y), (F.col("xmin") + w, F.col("ymin"), F.col("xmax") - w, F.col("ymax")),
    ]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("form"), *[v.alias(n) for v, n in zip(f, S.CORNERS, strict=True)]) for k, f in enumerate(forms)])).alias("f")
    return a.select("area_id", each).select((F.col("area_id") * 10 + F.col("f.form")).alias("shape_id"), *[f"f.{n}" for n in S.CORNERS])


def j02_predicates(spark, d):
    """Every pair of shapes and areas under each predicate."""
    left, right = _mixed_boxes(spark, d), V.area_boxes(spark, d)
    each = [S.spatial_join(left, right, "shape_id", "area_id", CELL, p).select(F.lit(p).alias("predicate"), "shape_id", "area_id") for p in S.PREDICATES]
    return reduce(lambda a, b: a.unionByName(b), each)


def j02_right(spark, d):
    return S.spatial_join(_mixed_boxes(spark, d).where("shape_id % 10 = 1"), V.area_boxes(spark, d).withColumn("xmin", F.col("xmin") + F.when(F.col("area_id") % 3 == 0, 0.1).otherwise(0.0)), "shape_id", "area_id", CELL, "within", "right")


def j25_modes(spark, d):
    """Area of each pair's common piece and of what is left of each box, in all modes."""
    left = V.area_boxes(spark, d)
    right = left.where("area_id % 3 <> 0").select(F.col("area_id").alias("moved_id"), *[(F.col(c) + 0.07).alias(c) for c in S.CORNERS])
    wide = left.where("area_id % 4 = 1").select((F.col("area_id") + 100).alias("moved_id"), F.col("xmin"), (F.col("ymin") + 0.1).alias("ymin"), (F.col("xmax") + 0.3).alias("xmax"), F.col("ymax"))
    each = [S.overlay(left, right.unionByName(wide), "area_id", "moved_id", CELL, m).groupBy("area_id", "moved_id").agg(F.round(F.sum("area"), 9).alias("area")).where("area > 0").withColumn("mode", F.lit(m)) for m in S.OVERLAYS]
    return reduce(lambda a, b: a.unionByName(b), each).select("mode", "area_id", "moved_id", "area")


def j26(spark, d, keep=True):
    mask = V.area_boxes(spark, d).where("region = 1")
    return S.clip_points(V.event_points(spark, d), mask, CELL, keep).select("event_id", "event_type")


def a13(spark, d):
    pairs = S.points_in_boxes(V.event_points(spark, d), V.area_boxes(spark, d), CELL)
    first = F.sum((F.dayofmonth("ts") <= 5).cast("long"))
    second = F.sum((F.dayofmonth("ts") > 5).cast("long"))
    counted = pairs.groupBy("area_id").agg(first.alias("count_a"), second.alias("count_b"))
    out = V.area_boxes(spark, d).select("area_id").join(counted, "area_id", "left").na.fill(0, ["count_a", "count_b"])
    change = F.col("count_b") - F.col("count_a")
    return out.select("area_id", "count_a", "count_b", change.alias("change"), F.round(change * 100 / F.nullif(F.col("count_a"), F.lit(0)), 2).alias("pct_change"))


def a14(spark, d):
    """Latest day against the mean of all days before it, zeros included."""
    points = V.event_points(spark, d).select(F.to_date("ts").alias("day"), F.floor(F.col("lon") / 0.1).alias("cx"), F.floor(F.col("lat") / 0.1).alias("cy"))
    span = points.agg(F.max("day").alias("last"), (F.count_distinct("day") - 1).alias("earlier"))
    latest, before = F.sum((F.col("day") == F.col("last")).cast("long")), F.sum((F.col("day") < F.col("last")).cast("long"))
    cells = points.crossJoin(F.broadcast(span)).groupBy("cx", "cy", "earlier").agg(latest.alias("latest"), before.alias("b"))
    baseline = F.col("b") / F.col("earlier")
    shift = F.col("latest") - baseline
    return cells.select("cx", "cy", "latest", F.round(baseline, 6).alias("baseline"), F.round(shift, 6).alias("shift"), F.round(shift * 100 / F.nullif(baseline, F.lit(0.0)), 2).alias("pct_shift"))


def w18(spark, d):
    cells = a14(spark, d)
    up = Window.orderBy(F.desc("shift"), "cx", "cy")
    down = Window.orderBy("shift", "cx", "cy")
    # ten rows a side are found before ranking, so that no window sees a whole table
    top = cells.orderBy(F.desc("shift"), "cx", "cy").limit(5).withColumn("rank", F.row_number().over(up)).withColumn("side", F.lit("emerging"))
    low = cells.orderBy("shift", "cx", "cy").limit(5).withColumn("rank", F.row_number().over(down)).withColumn("side", F.lit("cooling"))
    return top.unionByName(low).select("side", "rank", "cx", "cy", "shift")


def a20(spark, d):
    counted = S.count_points_in_areas(V.event_points(spark, d), V.area_boxes(spark, d), "area_id", CELL)
    population = (F.col("area_id") + 1) * 1000
    return counted.select("area_id", population.cast("long").alias("population"), F.round(F.col("point_count") * 1000 / population, 6).alias("per_thousand"))


def a36(spark, d):
    out = S.idw(V.demand_points(spark, d), V.site_points(spark, d), "demand_id", "site_id", "balance", 8000.0)
    return out.select("demand_id", F.round("estimate", 3).alias("estimate"))


def a37(spark, d):
    near = S.nearest_join(V.demand_points(spark, d), V.site_points(spark, d), "demand_id", "site_id", 4000.0)
    far = F.avg((F.col("distance_m") > 2000).cast("double"))
    return near.groupBy("site_id").agg(F.count("*").alias("served"), F.round(F.avg("distance_m"), 3).alias("mean_m"), F.round(far, 6).alias("share_over_2km"))


def j22(spark, d):
    return S.distance_matrix(V.demand_points(spark, d), V.site_points(spark, d), "demand_id", "site_id", digits=3)


def a38(spark, d):
    """The pair of all sites that serves all demand at the least weighted distance."""
    total = S.site_pair_costs(V.demand_points(spark, d), V.site_points(spark, d), "weight", "site_id")
    return total.withColumn("cost", F.round("cost", 0)).orderBy("cost", "site_a", "site_b").limit(1)


def f13(spark, d):
    a = V.area_boxes(spark, d)
    known = F.when(F.col("area_id") % 6 != 0, F.col("xmin"))
    apart = (F.col("xmax") < -87.5) | (known > -87.2) | (F.col("ymax") < 41.3) | (F.col("ymin") > 41.7)
    conflict = F.when(known.isNull(), F.lit(False)).otherwise(apart)
    iou = geo.box_iou(tuple(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")), tuple(map(F.lit, (-87.5, 41.3, -87.2, 41.7))))
    covers = (F.col("xmin") <= -87.5) & (F.col("xmax") >= -87.2) & (F.col("ymin") <= 41.3) & (F.col("ymax") >= 41.7)
    return a.select("area_id", conflict.alias("conflict"), F.round(iou, 9).alias("iou"), covers.alias("covers"), geo.plausible_lonlat(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]).alias("plausible"))


def g01(spark, d):
    x, y = geo.utm_xy(F.col("lon"), F.col("lat"), F.lit(geo.utm_central(-87.5)))
    bx, by = geo.from_mercator(*geo.mercator(F.col("lon"), F.col("lat")))
    return V.site_points(spark, d).select("site_id", F.round(x, 3).alias("east"), F.round(y, 3).alias("north"), F.round(bx, 7).alias("lon_back"), F.round(by, 7).alias("lat_back"))


def g03(spark, d):
    cx, cy = geo.ring_centroid(F.col("ring"))
    return V.area_diamonds(spark, d).select(
        "area_id", F.round(geo.ring_area(F.col("ring")), 9).alias("area"), F.round(geo.ring_length(F.col("ring")), 9).alias("perimeter"), F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy")
    )


def m19(spark, d):
    text = F.concat(F.col("c_custkey") % 90, F.lit("°"), F.col("c_custkey") % 60, F.lit("'"), F.col("c_custkey") % 7 * 5, F.lit('.5"'), F.when(F.col("c_custkey") % 2 == 0, "N").otherwise("S"))
    text = F.when(F.col("c_custkey") % 11 == 0, F.lit("n/a")).when(F.col("c_custkey") % 11 == 1, F.concat(F.lit("-"), F.col("c_custkey") % 90, F.lit(".25"))).otherwise(text)
    return V.read(spark, d, "customer").select("c_custkey", F.round(geo.dms_to_degrees(text), 9).alias("degrees"))


QUERIES = {
    "a01_count_points_in_areas": a01, "a02_area_statistics": a02, "a03_grid_square": a03, "a04_grid_hex": a04, "a13_compare_periods": a13, "a14_temporal_hotspots": a14, "a20_rate_per_population": a20,
    "a36_idw": a36, "a37_site_load": a37, "a38_p_median_pairs": a38, "f13_extent_relations": f13, "g01_projections": g01, "g03_ring_measures": g03, "j01_points_in_polygons": j01,
    "j02_spatial_join_left": j02, "j02_predicates": j02_predicates, "j02_spatial_join_right": j02_right, "j04_nearest_join": j04, "j04_nearest_join_capped": j04_capped, "j05_within_distance": j05, "j06_space_time_join": j06, "j11_contiguity_queen": j11,
    "j11_contiguity_rook": lambda s, d: j11(s, d, True), "j12_distance_band": j12, "j12_least_band": j12_least, "j13_knn_weights": j13, "j22_distance_matrix": j22, "j25_box_intersection": j25, "j25_box_difference": j25_difference, "j25_overlay_modes": j25_modes,
    "j26_clip": j26, "j27_erase": lambda s, d: j26(s, d, False), "m19_dms_to_degrees": m19, "w18_emerging_and_cooling": w18,
}

_CELLS = """, c AS (SELECT ts::DATE AS day, floor(lon / 0.1)::BIGINT AS cx, floor(lat / 0.1)::BIGINT AS cy FROM event_points),
m AS (SELECT max(day) AS last, count(DISTINCT day) - 1 AS earlier FROM c),
g AS (SELECT cx, cy, count(*) FILTER (day = last) AS latest, count(*) FILTER (day < last) / earlier::DOUBLE AS b FROM c, m GROUP BY cx, cy, earlier),
h AS (SELECT cx, cy, latest, round(b, 6) AS baseline, round(latest - b, 6) AS shift, round((latest - b) * 100 / nullif(b, 0), 2) AS pct_shift FROM g) """
_NEAREST = "SELECT {a}, first({b} ORDER BY m, {b}) AS {b}, min(m) AS m FROM (SELECT p.{a}, s.{b}, {metres} AS m FROM {left} p, site_points s) GROUP BY {a}"
_RING = """, e AS (SELECT area_id, (xmin + xmax) / 2 AS xm, (ymin + ymax) / 2 AS ym, xmin, xmax, ymin, ymax FROM area_boxes),
edges AS (SELECT area_id, xm AS x1, ymin AS y1, xmax AS x2, ym AS y2 FROM e UNION ALL SELECT area_id, xmax, ym, xm, ymax FROM e UNION ALL SELECT area_id, xm, ymax, xmin, ym FROM e UNION ALL SELECT area_id, xmin, ym, xm, ymin FROM e)"""
_OVERLAY = "greatest(a.xmin, b.xmin + {s}) AS xmin, greatest(a.ymin, b.ymin + {s}) AS ymin, least(a.xmax, b.xmax + {s}) AS xmax, least(a.ymax, b.ymax + {s}) AS ymax"
_CORNERS = """, v AS (SELECT area_id, unnest([{'x': round(xmin, 9), 'y': round(ymin, 9)}, {'x': round(xmax, 9), 'y': round(ymin, 9)}, {'x': round(xmax, 9), 'y': round(ymax, 9)}, {'x': round(xmin, 9), 'y': round(ymax, 9)}]) AS p FROM area_boxes)"""

#: Metres east and north of all events in zone 16, whose central meridian is 87 degrees west.
_UTM = """, u1 AS (SELECT lon, lat, 1 / 298.257223563::DOUBLE / (2 - 1 / 298.257223563::DOUBLE) AS n, radians(lat) AS phi, radians(lon - (-87.0)) AS lam FROM event_points),
u2 AS (SELECT *, 2 * sqrt(n) / (1 + n) AS e, 6378137.0::DOUBLE / (1 + n) * (1 + n**2 / 4 + n**4 / 64) AS big FROM u1), u3 AS (SELECT *, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) AS t FROM u2),
u4 AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta, n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 AS a1, 13 * n**2 / 48 - 3 * n**3 / 5 AS a2, 61 * n**3 / 240 AS a3 FROM u3),
utm AS (SELECT 500000 + 0.9996::DOUBLE * big * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)) AS east,
0.9996::DOUBLE * big * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)) AS north FROM u4)"""

_MIXED = """, f AS (SELECT area_id, k, xmin, ymin, xmax, ymax, 0.05::DOUBLE AS w FROM area_boxes, range(8) t(k)),
shapes AS (SELECT area_id * 10 + k AS shape_id,
CASE WHEN k IN (0, 1, 7) THEN xmin + w WHEN k = 4 THEN xmin - w WHEN k = 6 THEN (xmin + xmax) / 2 ELSE xmin END AS x0,
CASE WHEN k IN (0, 1) THEN ymin + w WHEN k IN (4, 6) THEN (ymin + ymax) / 2 ELSE ymin END AS y0,
CASE WHEN k = 0 THEN xmax + w WHEN k IN (1, 7) THEN xmax - w WHEN k = 4 THEN xmin + w WHEN k = 6 THEN (xmin + xmax) / 2 WHEN k IN (3, 5) THEN xmin ELSE xmax END AS x1,
CASE WHEN k = 0 THEN ymax + w WHEN k = 1 THEN ymax - w WHEN k IN (4, 6) THEN (ymin + ymax) / 2 WHEN k = 5 THEN ymin ELSE ymax END AS y1 FROM f)"""
# nine numbers of the usual model are not needed for boxes: interiors meet, boundaries and containment decide
_PREDICATES = _MIXED + """, m AS (SELECT shape_id, area_id, x0, y0, x1, y1, xmin, ymin, xmax, ymax, (x0 < x1)::INT + (y0 < y1)::INT AS dim,
(CASE WHEN x0 = x1 THEN xmin < x0 AND x0 < xmax ELSE greatest(x0, xmin) < least(x1, xmax) END) AND (CASE WHEN y0 = y1 THEN ymin < y0 AND y0 < ymax ELSE greatest(y0, ymin) < least(y1, ymax) END) AS inner_meet,
xmin <= x0 AND x1 <= xmax AND ymin <= y0 AND y1 <= ymax AS inside, x0 <= xmin AND xmax <= x1 AND y0 <= ymin AND ymax <= y1 AS outside,
x0 < xmin AND xmax < x1 AND y0 < ymin AND ymax < y1 AS around FROM shapes, area_boxes WHERE greatest(x0, xmin) <= least(x1, xmax) AND greatest(y0, ymin) <= least(y1, ymax))
SELECT predicate, shape_id, area_id FROM m, (VALUES ('intersects'), ('within'), ('contains'), ('covers'), ('covered_by'), ('touches'), ('crosses'), ('overlaps'), ('equals'), ('contains_properly')) p(predicate)
WHERE CASE predicate WHEN 'intersects' THEN true WHEN 'within' THEN inside AND inner_meet WHEN 'contains' THEN outside AND inner_meet WHEN 'covers' THEN outside WHEN 'covered_by' THEN inside WHEN 'equals' THEN inside AND outside
WHEN 'touches' THEN NOT inner_meet WHEN 'crosses' THEN dim = 1 AND inner_meet AND NOT inside WHEN 'overlaps' THEN dim = 2 AND inner_meet AND NOT inside AND NOT outside ELSE around END"""
_RIGHTS = "r AS (SELECT area_id AS moved_id, xmin + 0.07::DOUBLE AS x0, ymin + 0.07::DOUBLE AS y0, xmax + 0.07::DOUBLE AS x1, ymax + 0.07::DOUBLE AS y1 FROM area_boxes WHERE area_id % 3 <> 0 UNION ALL SELECT area_id + 100, xmin, ymin + 0.1::DOUBLE, xmax + 0.3::DOUBLE, ymax FROM area_boxes WHERE area_id % 4 = 1)"
# every side of every box cuts the plane; a cell belongs to the boxes that hold its middle
_MODES = f""", {_RIGHTS}, l AS (SELECT area_id, xmin AS x0, ymin AS y0, xmax AS x1, ymax AS y1 FROM area_boxes),
px AS (SELECT v, lead(v) OVER (ORDER BY v) AS v2 FROM (SELECT x0 AS v FROM l UNION SELECT x1 FROM l UNION SELECT x0 FROM r UNION SELECT x1 FROM r)), py AS (SELECT v, lead(v) OVER (ORDER BY v) AS v2 FROM (SELECT y0 AS v FROM l UNION SELECT y1 FROM l UNION SELECT y0 FROM r UNION SELECT y1 FROM r)),
g AS MATERIALIZED (SELECT (px.v + px.v2) / 2 AS mx, (py.v + py.v2) / 2 AS my, (px.v2 - px.v) * (py.v2 - py.v) AS area FROM px, py WHERE px.v2 IS NOT NULL AND py.v2 IS NOT NULL),
gl AS MATERIALIZED (SELECT g.*, area_id FROM g JOIN l ON mx > x0 AND mx < x1 AND my > y0 AND my < y1), gr AS MATERIALIZED (SELECT g.*, moved_id FROM g JOIN r ON mx > x0 AND mx < x1 AND my > y0 AND my < y1),
pieces AS (SELECT area_id, moved_id, sum(gl.area) AS area FROM gl JOIN gr USING (mx, my) GROUP BY 1, 2 UNION ALL SELECT area_id, NULL, sum(area) FROM gl ANTI JOIN gr USING (mx, my) GROUP BY 1 UNION ALL SELECT NULL, moved_id, sum(area) FROM gr ANTI JOIN gl USING (mx, my) GROUP BY 2)
SELECT mode, area_id, moved_id, round(area, 9) AS area FROM pieces, (VALUES ('intersection'), ('union'), ('identity'), ('symmetric_difference'), ('difference')) m(mode)
WHERE round(area, 9) > 0 AND CASE WHEN area_id IS NOT NULL AND moved_id IS NOT NULL THEN mode IN ('intersection', 'union', 'identity') WHEN moved_id IS NULL THEN mode <> 'intersection' ELSE mode IN ('union', 'symmetric_difference') END"""

SQL = {
    "j02_predicates": V.sql_with("area_boxes", body=_PREDICATES),
    "j02_spatial_join_right": V.sql_with("area_boxes", body=_MIXED + ", a AS (SELECT *, CASE WHEN area_id % 3 = 0 THEN xmin + 0.1::DOUBLE ELSE xmin END AS xm FROM area_boxes) SELECT shape_id, area_id FROM a LEFT JOIN shapes ON shape_id % 10 = 1 AND xm <= x0 AND x1 <= xmax AND ymin <= y0 AND y1 <= ymax"),
    "j25_overlay_modes": V.sql_with("area_boxes", body=_MODES),
    "a01_count_points_in_areas": V.sql_with("event_points", "area_boxes", body=f" SELECT a.area_id, a.area, count(p.event_id) AS point_count FROM area_boxes a LEFT JOIN event_points p ON {INSIDE} GROUP BY 1, 2"),
    "a02_area_statistics": V.sql_with("event_points", "area_boxes", body=f" SELECT a.area_id, round(coalesce(sum(value), 0), 6) AS value_sum, round(avg(value), 6) AS value_mean, round(median(value), 6) AS value_median, round(min(value), 6) AS value_min, round(max(value), 6) AS value_max, round(stddev_samp(value), 6) AS value_std FROM area_boxes a LEFT JOIN event_points p ON {INSIDE} GROUP BY 1"),
    "a03_grid_square": V.sql_with("event_points", body=_UTM + " SELECT floor(north / 5000.0)::BIGINT AS cell_y, floor(east / 5000.0)::BIGINT AS cell_x, count(*) AS n, round(count(*) / 25.0::DOUBLE, 4) AS per_km2 FROM utm GROUP BY 1, 2 HAVING count(*) >= 2"),
    "a04_grid_hex": V.sql_with("event_points", body=_UTM + """, q AS (SELECT east AS x, north AS y, 1.5::DOUBLE * 4000 / sqrt(3.0::DOUBLE) AS rise FROM utm),
r AS (SELECT x, y, rise, floor(y / rise) AS r0 FROM q), s AS (SELECT *, (r0 % 2 + 2) % 2 * 2000.0::DOUBLE AS o0, ((r0 + 1) % 2 + 2) % 2 * 2000.0::DOUBLE AS o1 FROM r),
t AS (SELECT *, round_even((x - o0) / 4000.0::DOUBLE, 0) AS c0, round_even((x - o1) / 4000.0::DOUBLE, 0) AS c1 FROM s),
u AS (SELECT r0, c0, c1, power(x - (c0 * 4000 + o0), 2) + power(y - r0 * rise, 2) AS d0, power(x - (c1 * 4000 + o1), 2) + power(y - (r0 + 1) * rise, 2) AS d1 FROM t)
SELECT (CASE WHEN d1 < d0 THEN r0 + 1 ELSE r0 END)::BIGINT AS hex_row, (CASE WHEN d1 < d0 THEN c1 ELSE c0 END)::BIGINT AS hex_col, count(*) AS n, round(count(*) / (sqrt(3.0::DOUBLE) / 2 * 16), 4) AS per_km2 FROM u GROUP BY 1, 2"""),
    "a13_compare_periods": V.sql_with("event_points", "area_boxes", body=f", c AS (SELECT a.area_id, count(*) FILTER (day(p.ts) <= 5) AS count_a, count(*) FILTER (day(p.ts) > 5) AS count_b FROM area_boxes a LEFT JOIN event_points p ON {INSIDE} GROUP BY 1) SELECT *, count_b - count_a AS change, round((count_b - count_a) * 100 / nullif(count_a, 0)::DOUBLE, 2) AS pct_change FROM c"),
    "a14_temporal_hotspots": V.sql_with("event_points", body=_CELLS + "SELECT * FROM h"),
    "w18_emerging_and_cooling": V.sql_with("event_points", body=_CELLS + "(SELECT 'emerging' AS side, (row_number() OVER (ORDER BY shift DESC, cx, cy))::INT AS rank, cx, cy, shift FROM h ORDER BY shift DESC, cx, cy LIMIT 5) UNION ALL (SELECT 'cooling', (row_number() OVER (ORDER BY shift, cx, cy))::INT, cx, cy, shift FROM h ORDER BY shift, cx, cy LIMIT 5)"),
    "a20_rate_per_population": V.sql_with("event_points", "area_boxes", body=f" SELECT a.area_id, ((a.area_id + 1) * 1000)::BIGINT AS population, round(count(p.event_id) * 1000 / ((a.area_id + 1) * 1000)::DOUBLE, 6) AS per_thousand FROM area_boxes a LEFT JOIN event_points p ON {INSIDE} GROUP BY 1"),
    "a36_idw": V.sql_with("demand_points", "site_points", body=f", m AS (SELECT p.demand_id, s.balance, {metres_sql('p', 's')} AS m FROM demand_points p, site_points s) SELECT demand_id, round(sum(balance / (m * m)) / sum(1 / (m * m)), 3) AS estimate FROM m WHERE m <= 8000 GROUP BY 1"),
    "a37_site_load": V.sql_with("demand_points", "site_points", body=f", n AS ({_NEAREST.format(a='demand_id', b='site_id', metres=metres_sql('p', 's'), left='demand_points')}) SELECT site_id, count(*) AS served, round(avg(m), 3) AS mean_m, round(avg((m > 2000)::INT), 6) AS share_over_2km FROM n GROUP BY 1"),
    "a38_p_median_pairs": V.sql_with("demand_points", "site_points", body=f", m AS (SELECT p.demand_id, p.weight, s.site_id, round({metres_sql('p', 's')}, 3) AS m FROM demand_points p, site_points s) SELECT a.site_id AS site_a, b.site_id AS site_b, round(sum(a.weight * least(a.m, b.m)), 0) AS cost FROM m a JOIN m b ON a.demand_id = b.demand_id AND a.site_id < b.site_id GROUP BY 1, 2 ORDER BY cost, 1, 2 LIMIT 1"),
    "f13_extent_relations": V.sql_with("area_boxes", body=", i AS (SELECT *, greatest(0, least(xmax, -87.2) - greatest(xmin, -87.5)) * greatest(0, least(ymax, 41.7) - greatest(ymin, 41.3)) AS inter FROM area_boxes) SELECT area_id, CASE WHEN area_id % 6 = 0 THEN false ELSE xmax < -87.5 OR xmin > -87.2 OR ymax < 41.3 OR ymin > 41.7 END AS conflict, round(inter / ((xmax - xmin) * (ymax - ymin) + (-87.2::DOUBLE + 87.5) * (41.7::DOUBLE - 41.3) - inter), 9) AS iou, xmin <= -87.5 AND xmax >= -87.2 AND ymin <= 41.3 AND ymax >= 41.7 AS covers, xmin >= -180 AND xmax <= 180 AND ymin >= -90 AND ymax <= 90 AND xmin <= xmax AND ymin <= ymax AS plausible FROM i"),
    "g01_projections": V.sql_with("site_points", body=""", k AS (SELECT site_id, lon, lat, 1 / 298.257223563::DOUBLE / (2 - 1 / 298.257223563::DOUBLE) AS n, radians(lat) AS phi, radians(lon - (-87.0)) AS lam FROM site_points),
l AS (SELECT *, 2 * sqrt(n) / (1 + n) AS e, 6378137.0::DOUBLE / (1 + n) * (1 + n**2 / 4 + n**4 / 64) AS big FROM k), t AS (SELECT *, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) AS t FROM l),
x AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta, n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 AS a1, 13 * n**2 / 48 - 3 * n**3 / 5 AS a2, 61 * n**3 / 240 AS a3 FROM t)
SELECT site_id, round(500000 + 0.9996::DOUBLE * big * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)), 3) AS east,
round(0.9996::DOUBLE * big * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)), 3) AS north, round(lon, 7) AS lon_back, round(lat, 7) AS lat_back FROM x"""),
    "g03_ring_measures": V.sql_with("area_boxes", body=_RING + " SELECT area_id, round(abs(sum(x1 * y2 - x2 * y1)) / 2, 9) AS area, round(sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))), 9) AS perimeter, round(any_value(xm), 6) AS cx, round(any_value(ym), 6) AS cy FROM (SELECT edges.*, e.xm, e.ym FROM edges JOIN e USING (area_id)) GROUP BY 1"),
    "j01_points_in_polygons": V.sql_with("event_points", "area_boxes", body=_RING + ", h AS (SELECT p.event_id, any_value(p.value) AS value, d.area_id, count(*) FILTER ((y1 > p.lat) <> (y2 > p.lat) AND p.lon < (x2 - x1) * (p.lat - y1) / (y2 - y1) + x1) AS k FROM event_points p, edges d GROUP BY 1, 3) SELECT area_id, count(*) AS n, round(sum(value), 6) AS total FROM h WHERE k % 2 = 1 GROUP BY 1"),
    "j02_spatial_join_left": V.sql_with("site_points", "area_boxes", body=f" SELECT a.area_id, p.site_id, p.balance FROM area_boxes a LEFT JOIN site_points p ON {INSIDE}"),
    "j04_nearest_join": V.sql_with("event_points", "site_points", body=f", n AS ({_NEAREST.format(a='event_id', b='site_id', metres=metres_sql('p', 's'), left='event_points')}) SELECT event_id, site_id, round(m, 3) AS distance_m, round(m / 1609.344, 6) AS distance_mi FROM n"),
    "j04_nearest_join_capped": V.sql_with("demand_points", "site_points", body=f", n AS ({_NEAREST.format(a='demand_id', b='site_id', metres=metres_sql('p', 's'), left='demand_points')}) SELECT demand_id, CASE WHEN m <= 2500 THEN site_id END AS site_id, CASE WHEN m <= 2500 THEN round(m, 3) END AS distance_m FROM n"),
    "j05_within_distance": V.sql_with("demand_points", "site_points", body=f", n AS (SELECT p.demand_id, s.site_id, {metres_sql('p', 's')} AS m FROM demand_points p, site_points s) SELECT demand_id, site_id, round(m, 3) AS distance_m FROM n WHERE m <= 1609.344"),
    "j06_space_time_join": V.sql_with("event_points", body=f", n AS (SELECT a.event_id AS anchor_id, {metres_sql('a', 'p')} AS m FROM event_points a JOIN event_points p ON p.ts > a.ts AND p.ts <= a.ts + INTERVAL 1 DAY WHERE a.event_type = 'error') SELECT anchor_id, count(*) AS n, round(max(m), 3) AS farthest FROM n WHERE m <= 5000 GROUP BY 1"),
    "j11_contiguity_queen": V.sql_with("area_boxes", body=_CORNERS + ", q AS (SELECT DISTINCT a.area_id AS i, b.area_id AS j FROM v a JOIN v b ON a.p = b.p AND a.area_id <> b.area_id) SELECT i, count(*) AS n, string_agg(j::VARCHAR, ',' ORDER BY j) AS neighbours FROM q GROUP BY 1"),
    "j11_contiguity_rook": V.sql_with("area_boxes", body=_CORNERS + ", q AS (SELECT a.area_id AS i, b.area_id AS j FROM v a JOIN v b ON a.p = b.p AND a.area_id <> b.area_id GROUP BY 1, 2 HAVING count(*) >= 2) SELECT i, count(*) AS n, string_agg(j::VARCHAR, ',' ORDER BY j) AS neighbours FROM q GROUP BY 1"),
    "j12_distance_band": V.sql_with("site_points", body=f", n AS (SELECT p.site_id AS i, s.site_id AS j, {metres_sql('p', 's')} AS m FROM site_points p JOIN site_points s ON p.site_id <> s.site_id) SELECT i, j, round(m, 3) AS distance_m FROM n WHERE m <= 9000"),
    "j12_least_band": V.sql_with("site_points", body=f", n AS (SELECT p.site_id AS i, min({metres_sql('p', 's')}) AS m FROM site_points p JOIN site_points s ON p.site_id <> s.site_id GROUP BY 1) SELECT round(max(m) * (1 + 1e-9), 2) AS threshold_m FROM n"),
    "j13_knn_weights": V.sql_with("site_points", body=f", n AS (SELECT p.site_id AS i, s.site_id AS j, {metres_sql('p', 's')} AS m FROM site_points p JOIN site_points s ON p.site_id <> s.site_id), r AS (SELECT *, (row_number() OVER (PARTITION BY i ORDER BY m, j))::INT AS rank FROM n) SELECT i, j, rank, round(m, 3) AS distance_m FROM r WHERE rank <= 6"),
    "j22_distance_matrix": V.sql_with("demand_points", "site_points", body=f" SELECT p.demand_id, s.site_id, round({metres_sql('p', 's')}, 3) AS distance_m FROM demand_points p, site_points s"),
    "j25_box_intersection": V.sql_with("area_boxes", body=f", o AS (SELECT a.area_id, b.area_id AS moved_id, {_OVERLAY.format(s='0.07::DOUBLE')} FROM area_boxes a, area_boxes b) SELECT area_id, moved_id, round(xmin, 9) AS xmin, round(ymin, 9) AS ymin, round(xmax, 9) AS xmax, round(ymax, 9) AS ymax, round((xmax - xmin) * (ymax - ymin), 9) AS area FROM o WHERE xmin < xmax AND ymin < ymax"),
    "j25_box_difference": V.sql_with("area_boxes", body=f", o AS (SELECT a.area_id, {_OVERLAY.format(s='0.05::DOUBLE')} FROM area_boxes a, area_boxes b WHERE b.area_id % 2 = 0), c AS (SELECT area_id, sum((xmax - xmin) * (ymax - ymin)) AS cut FROM o WHERE xmin < xmax AND ymin < ymax GROUP BY 1) SELECT a.area_id, round((xmax - xmin) * (ymax - ymin) - coalesce(cut, 0), 9) AS left_over FROM area_boxes a LEFT JOIN c USING (area_id)"),
    "j26_clip": V.sql_with("event_points", "area_boxes", body=f" SELECT event_id, event_type FROM event_points p WHERE EXISTS (SELECT 1 FROM area_boxes a WHERE region = 1 AND {INSIDE})"),
    "j27_erase": V.sql_with("event_points", "area_boxes", body=f" SELECT event_id, event_type FROM event_points p WHERE NOT EXISTS (SELECT 1 FROM area_boxes a WHERE region = 1 AND {INSIDE})"),
    "m19_dms_to_degrees": "SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 11 = 1 THEN -(c_custkey % 90 + 0.25::DOUBLE) ELSE round((c_custkey % 90 + c_custkey % 60 / 60.0::DOUBLE + (c_custkey % 7 * 5 + 0.5::DOUBLE) / 3600) * CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END, 9) END AS degrees FROM customer",
}
