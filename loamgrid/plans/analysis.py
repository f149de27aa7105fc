"""Queries of spatial statistics, rasters and graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from loamgrid.operators import autocorrelation as A
from loamgrid.operators import graphs as G
from loamgrid.operators import raster as R
from loamgrid.operators import spatial as S
from loamgrid.operators.components import connected_components
from loamgrid.operators.pairs import paired
from loamgrid.plans import spatial as Q
from loamgrid.plans import views as V
from loamgrid.plans.durable import durable
from loamgrid.plans.views import read


def _areas(spark, d):
    """Area values: points counted in each."""
    return S.count_points_in_areas(V.event_points(spark, d), V.area_boxes(spark, d), "area_id", 0.2).select("area_id", F.col("point_count").cast("double").alias("x"))


def _weights(spark, d):
    return A.row_standardised(S.contiguity(V.area_rings(spark, d), "area_id"))


def a16(spark, d):
    band = S.distance_band(V.site_points(spark, d), "site_id", 6000.0)
    degree = V.site_points(spark, d).select("site_id").join(band.groupBy(F.col("i").alias("site_id")).agg(F.count("*").alias("k")), "site_id", "left").na.fill(0, ["k"])
    return degree.agg(F.count("*").alias("n"), F.count_if(F.col("k") == 0).alias("islands"), F.min("k").alias("least"), F.max("k").alias("most"), F.round(F.avg("k"), 6).alias("mean"), F.median("k").alias("median"), F.round(F.sum("k") * 100 / (F.count("*") * F.count("*")), 6).alias("percent_nonzero"))


def a17(spark, d):
    out = A.global_statistics(_areas(spark, d), _weights(spark, d), "area_id", "x")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


def a18(spark, d):
    out = A.permutation_p(_areas(spark, d), _weights(spark, d), "area_id", "x", 199)
    return out.select(F.round("seen", 6).alias("seen"), "draws", F.round("p_sim", 9).alias("p_sim"))


def p01(spark, d):
    return A.lisa(_areas(spark, d), _weights(spark, d), "area_id", "x").select("area_id", F.round("local_i", 9).alias("local_i"), "quadrant")


def p01_classes(spark, d):
    out = A.lisa_classes(_areas(spark, d), _weights(spark, d), "area_id", "x", 199)
    return out.select("area_id", "quadrant", F.round("p_sim", 9).alias("p_sim"), "class")


def p02(spark, d):
    z = A.getis_star(_areas(spark, d), S.contiguity(V.area_rings(spark, d), "area_id"), "area_id", "x")
    band = F.when(F.col("z") >= 2.576, "hot 99").when(F.col("z") >= 1.96, "hot 95").when(F.col("z") <= -2.576, "cold 99").when(F.col("z") <= -1.96, "cold 95").otherwise("none")
    return z.select("area_id", F.round("z", 9).alias("z"), band.alias("band"))


def p03(spark, d):
    z = A.spatial_lag(A.z_scores(_areas(spark, d), "area_id", "x"), _weights(spark, d), "area_id", ["z"])
    counts = [F.count_if(A.quadrant(F.col("z"), F.col("lag_z")) == q).alias(q.lower()) for q in ("HH", "LH", "LL", "HL")]
    return z.agg(F.round(F.regr_slope("lag_z", "z"), 9).alias("slope"), *counts)


def p04(spark, d):
    a = _areas(spark, d).withColumn("x1", F.col("area_id") % 5 * 1.0).withColumn("x2", F.pow(F.col("area_id") % 7, F.lit(2.0)))
    out = A.spatial_diagnostics(a, _weights(spark, d), "area_id", "x", ["x1", "x2"])
    return out.select(*[F.round(c, 6).alias(c) for c in ("r2", "jarque_bera", "lm_error", "lm_lag", "robust_lm_error", "robust_lm_lag")], "verdict")


def p04_residuals(spark, d):
    a = _areas(spark, d).withColumn("x1", F.col("area_id") % 5 * 1.0).withColumn("x2", F.pow(F.col("area_id") % 7, F.lit(2.0)))
    out = A.residual_table(a, _weights(spark, d), "area_id", "x", ["x1", "x2"])
    return out.select("area_id", *[F.round(c, 6).alias(c) for c in ("fitted", "residual", "standardised", "lag_residual")])


def p04_ols(spark, d):
    fit = A.ols(read(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    return spark.range(1).select(F.round(F.lit(float(fit["r2"])), 6).alias("r2"), *[F.round(F.lit(float(b)), 2).alias(f"b{k}") for k, b in enumerate(fit["beta"])])


def p05(spark, d):
    """Density clusters: core points by neighbours within a distance, joined where core points meet, borders to the smallest."""
    return S.density_clusters(V.demand_points(spark, d), "demand_id", 1500.0, 5)


def p05_summary(spark, d):
    """Size, centre and radius of each density cluster; noise is -1."""
    return S.cluster_summary(V.demand_points(spark, d).join(p05(spark, d), "demand_id"), "cluster").select("cluster", "n", *[F.round(c, 6).alias(c) for c in ("lon", "lat")], F.round("radius_m", 2).alias("radius_m"))


def a15(spark, d):
    p = V.pixels(spark, d).withColumn("value", F.when(F.col("prow") % 9 != 0, F.col("value")))
    zone = F.floor(F.col("prow") / 20) * 5 + F.floor(F.col("pcol") / 20)
    return R.zonal_stats(p, zone, "value")


def a39(spark, d):
    out = R.change_index(V.pixels(spark, d), "before", "after", 0.2)
    return out.select("cells", F.round("mean_change", 6).alias("mean_change"), "loss_cells")


def a40(spark, d):
    """Cells that pass every rule, and a weighted score of the best."""
    p = V.pixels(spark, d)
    fit = (F.col("value") > 20) & (F.col("prow") % 10 > 2) & (F.col("pcol") < 80)
    score = F.round(F.col("value") * 0.6 + F.col("prow") * 0.3 - F.col("pcol") * 0.1, 6)
    return p.where(fit).agg(F.count("*").alias("cells"), F.max(score).alias("best"), F.max_by(F.col("prow") * 100 + F.col("pcol"), F.struct(score, -F.col("prow"), -F.col("pcol"))).alias("best_cell"))


def a41(spark, d):
    out = R.inundation(V.pixels(spark, d).withColumn("value", F.when(F.col("pcol") % 10 != 0, F.col("value"))), "value", 24.0)
    return out.select("wet", *[F.round(c, 6).alias(c) for c in ("mean_depth", "max_depth", "percent")])


def a43(spark, d):
    band = F.floor(F.col("value") / 10).cast("long")
    counted = V.pixels(spark, d).groupBy(band.alias("band")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("band", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def g08(spark, d):
    p = R.gradients(V.pixels(spark, d).select("prow", "pcol", "value"), "value", 30.0)
    return p.select(
        "prow", "pcol", F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"), F.round(R.slope_degrees(F.col("dx"), F.col("dy")), 4).alias("slope"), F.round(R.aspect_degrees(F.col("dx"), F.col("dy")), 3).alias("aspect"),
        F.round(R.hillshade(F.col("dx"), F.col("dy")), 2).alias("shade"),
    )


def p09(spark, d):
    out = R.pooled_by_zone(read(spark, d, "embeddings"), "label", "embedding")
    return out.select("label", "n", F.posexplode("pooled").alias("k", "v")).select("label", "n", "k", (F.round("v", 6) + 0.0).alias("v"))


def _edges(spark, d):
    """Suppliers that share orders, by the number of these over the mean of all pairs, from 1.5 standard deviations above it on. An order has seven lines at most.

    Stored, as loops and sums read them many times.
    """
    of_order = read(spark, d, "lineitem").where("l_suppkey is not null and l_orderkey is not null").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s"))
    pairs = of_order.select(F.explode("s").alias("src"), "s").select("src", F.explode(F.filter("s", lambda x: x > F.col("src"))).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("shared"))
    mean = pairs.agg(F.avg("shared").alias("mean"), F.stddev_pop("shared").alias("sd"))
    return durable(pairs.crossJoin(F.broadcast(mean)).where("shared >= mean + 1.5D * sd").select("src", "dst", F.round(F.col("shared") / F.col("mean"), 6).alias("weight")))


def c01(spark, d):
    comp = connected_components(_edges(spark, d))
    nodes = read(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))
    return nodes.join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def c01_all(spark, d):
    """Parts of the graph of all suppliers and parts that met in a line of an odd order, whatever the number of lines."""
    l = read(spark, d, "lineitem").where("l_orderkey % 2 = 1 and l_suppkey % 3 = l_partkey % 3")  # noqa: E741
    edges = l.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst")).distinct()
    return connected_components(edges)


def c05_modularity(spark, d):
    """Weighted modularity of groupings of the suppliers: each alone, by nation, and all together."""
    e, s = _edges(spark, d), read(spark, d, "supplier")
    groupings = {"alone": F.col("s_suppkey"), "nation": F.col("s_nationkey"), "together": F.lit(0)}
    each = [G.modularity(e, "weight", s.select(F.col("s_suppkey").alias("node"), g.alias("community"))).select(F.lit(k).alias("grouping"), (F.round("modularity", 9) + 0).alias("modularity")) for k, g in groupings.items()]
    return reduce(lambda a, b: a.unionByName(b), each)


def c02(spark, d):
    starts = read(spark, d, "supplier").where("s_suppkey % 25 = 0").select(F.col("s_suppkey").alias("node"))
    return G.within_hops(G.both_ways(_edges(spark, d).select("src", "dst")), starts, 2)


def c03(spark, d):
    """Everything upstream of some orders, along made-up lineage: a part's order of half the number."""
    o = read(spark, d, "orders").where("o_orderkey > 0").select(F.col("o_orderkey").alias("src"), F.floor(F.col("o_orderkey") / 2).alias("dst"))
    return G.upstream(o, o.where("src % 3000 = 1").select(F.col("src").alias("node")))


def c04(spark, d):
    starts = read(spark, d, "supplier").where("s_suppkey % 50 = 0").select(F.col("s_suppkey").alias("node"))
    edges = G.both_ways(_edges(spark, d)).withColumn("minutes", F.lit(3.0) / F.col("weight"))
    return G.cheapest(edges, starts, "minutes", budget=4.5).select("start", "node", F.round("cost", 6).alias("cost"))


def c05(spark, d):
    """Communities by labels, and how well they part the graph."""
    e = _edges(spark, d)
    found = durable(G.label_communities(e, "weight"))
    return found.crossJoin(G.modularity(e, "weight", found).select(F.round("modularity", 9).alias("modularity")))


def j14(spark, d):
    """Nearest vectors of those with ids divisible by 20 among all: found both ways at full weight, one way at 0.6; half the cosine, not under 0."""
    from loamgrid.plans.retrieval import R as X

    v = read(spark, d, "embeddings").select("vec_id", "embedding")
    hits = X.knn(v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("e")), v, "q", "e", "vec_id", "embedding", 5)
    pair = hits.select(F.least("q", "vec_id").alias("src"), F.greatest("q", "vec_id").alias("dst"), "cosine").groupBy("src", "dst").agg(F.count("*").alias("ways"), F.max("cosine").alias("cosine"))
    weight = F.greatest(F.col("cosine"), F.lit(0.0)) * 0.5 * F.when(F.col("ways") == 2, 1.0).otherwise(0.6)
    return pair.select("src", "dst", F.round(weight, 6).alias("weight"))


def j15(spark, d):
    """Pairs of suppliers in one nation; each clique shares out its weight."""
    s = read(spark, d, "supplier").select("s_nationkey", F.col("s_suppkey").alias("src"))
    n = s.groupBy("s_nationkey").agg(F.count("*").alias("n")).where("n > 1")
    pairs = paired(s, s.withColumnRenamed("src", "dst"), "s_nationkey", "src", "dst").where("src < dst").join(F.broadcast(n), "s_nationkey")
    return pairs.select("src", "dst", F.round(F.lit(0.5) * 2 / (F.col("n") - 1), 9).alias("weight"))


def j16(spark, d):
    """Curated lists to undirected pairs between known rows, self left out."""
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("src"))
    lists = s.select("src", F.explode(F.array(*[(F.col("src") * k + 3) % 130 for k in (2, 3, 7)])).alias("dst"))
    return G.undirected(lists.join(s.select(F.col("src").alias("dst")), "dst", "left_semi"))


def u02(spark, d):
    co = _edges(spark, d)
    out = G.fuse_layers({"parts": co, "nation": j15(spark, d), "curated": j16(spark, d).withColumn("weight", F.lit(1.0))})
    return out.select("src", "dst", F.round("weight", 6).alias("weight"), "rels", "support")


def u05(spark, d):
    s = read(spark, d, "customer")
    old, new = s.select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("community")), s.select(F.col("c_custkey").alias("node"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey") + 100).otherwise(F.col("c_nationkey")).alias("community"))
    return G.carried(G.membership_overlap(old, new), 0.5).withColumn("jaccard", F.round("jaccard", 6))


def a33(spark, d):
    """Size, purity of kind and top tag of groups."""
    c = read(spark, d, "customer").select(F.col("c_nationkey").alias("community"), F.col("c_mktsegment").alias("kind"))
    tags = c.groupBy("community", "kind").agg(F.count("*").alias("inside"))
    overall = c.groupBy("kind").agg(F.count("*").alias("overall"))
    scored = tags.join(overall, "kind").withColumn("score", F.round(F.col("inside") * F.log1p(F.col("inside") / F.col("overall")), 9)).where("inside >= 2")
    return scored.groupBy("community").agg(F.sum("inside").alias("size"), F.max_by("kind", F.struct("inside", "kind")).alias("main_kind"), F.round(F.max("inside") / F.sum("inside"), 6).alias("purity"), F.max_by("kind", F.struct("score", "kind")).alias("top_tag"))


def c09(spark, d):
    """Groupings of the areas held against what a regionalisation has to be: five regions, each in one piece."""
    boxes = V.area_boxes(spark, d)
    areas = boxes.select("area_id", F.floor(F.col("area_id") / 5).alias("rows"), (F.col("area_id") % 5).alias("columns"), F.when(F.col("area_id") != 7, F.col("area_id") % 5).alias("with_a_gap"), (F.col("area_id") % 2).alias("two"), F.when(F.col("area_id").isin(0, 24), 0).otherwise(1 + F.col("area_id") % 4).alias("scattered"))
    pairs = S.contiguity(V.area_rings(spark, d), "area_id")
    return G.region_check(areas, pairs, "area_id", ["rows", "columns", "with_a_gap", "two", "scattered"], 25, 5)


QUERIES = {
    "a15_zonal_stats": a15, "a16_weights_diagnostics": a16, "a17_global_statistics": a17, "a18_permutation_p": a18, "a33_community_profiles": a33, "a39_ndvi_change": a39, "a40_suitability": a40, "a41_inundation": a41, "a43_segment_share": a43,
    "c01_connected_parts": c01, "c01_unfiltered_parts": c01_all, "c05_modularity": c05_modularity, "c02_within_hops": c02, "c03_upstream": c03, "c04_cheapest_paths": c04, "c05_label_communities": c05, "c09_region_check": c09, "g08_slope_aspect_shade": g08, "j14_knn_graph": j14, "j15_collection_pairs": j15,
    "j16_curated_pairs": j16, "p01_lisa": p01, "p01_lisa_classes": p01_classes, "p02_getis_star": p02, "p03_moran_scatter": p03, "p04_spatial_diagnostics": p04, "p04_residual_table": p04_residuals, "p04_ols": p04_ols, "p05_dbscan": p05, "p05_cluster_summary": p05_summary, "p09_zone_pooling": p09, "u02_fuse_layers": u02, "u05_jaccard_match": u05,
}

_AREAS = f"v AS (SELECT a.area_id AS k, count(p.event_id)::DOUBLE AS x FROM area_boxes a LEFT JOIN event_points p ON {Q.INSIDE} GROUP BY 1), z AS (SELECT k, x, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS z FROM v)"
_QUEEN = "n AS (SELECT a.area_id AS i, b.area_id AS j FROM area_boxes a JOIN area_boxes b ON a.area_id <> b.area_id AND abs(a.area_id % 5 - b.area_id % 5) <= 1 AND abs(a.area_id // 5 - b.area_id // 5) <= 1), w AS (SELECT i, j, 1.0::DOUBLE / count(*) OVER (PARTITION BY i) AS w FROM n)"
_LAG = "g AS (SELECT z.k, any_value(z.z) AS z, coalesce(sum(w.w * o.z), 0) AS lag FROM z LEFT JOIN w ON w.i = z.k LEFT JOIN z o ON o.k = w.j GROUP BY 1)"


def _stats(body: str) -> str:
    return V.sql_with("event_points", "area_boxes", body=f", {_AREAS}, {_QUEEN}, {_LAG} {body}")


_EDGES = "l AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), p AS (SELECT a.l_suppkey AS src, b.l_suppkey AS dst, count(*) AS shared FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2), mean AS (SELECT avg(shared) AS mean, stddev_pop(shared) AS sd FROM p), e AS (SELECT src, dst, round(shared / mean, 6) AS weight FROM p, mean WHERE shared >= mean + 1.5::DOUBLE * sd), b AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e)"
_J15 = "x AS (SELECT s_nationkey, s_suppkey, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier), clique AS (SELECT a.s_suppkey AS src, b.s_suppkey AS dst, round(1.0::DOUBLE / (a.n - 1), 9) AS weight FROM x a JOIN x b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey)"
_J16 = "cur AS (SELECT DISTINCT least(s_suppkey, d) AS src, greatest(s_suppkey, d) AS dst FROM (SELECT s_suppkey, (s_suppkey * k + 3) % 130 AS d FROM supplier, (VALUES (2), (3), (7)) t(k)) WHERE d <> s_suppkey AND d IN (SELECT s_suppkey FROM supplier))"
_COS = "list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))"
_GRAD = "g AS (SELECT prow, pcol, value, CASE WHEN lag(pcol) OVER r = pcol - 1 THEN lag(value) OVER r END AS l, CASE WHEN lead(pcol) OVER r = pcol + 1 THEN lead(value) OVER r END AS t, CASE WHEN lag(prow) OVER c = prow - 1 THEN lag(value) OVER c END AS u, CASE WHEN lead(prow) OVER c = prow + 1 THEN lead(value) OVER c END AS b FROM pixels WINDOW r AS (PARTITION BY prow ORDER BY pcol), c AS (PARTITION BY pcol ORDER BY prow)), h AS (SELECT prow, pcol, coalesce((t - l) / 60.0::DOUBLE, (t - value) / 30.0::DOUBLE, (value - l) / 30.0::DOUBLE) AS dx, coalesce((b - u) / 60.0::DOUBLE, (b - value) / 30.0::DOUBLE, (value - u) / 30.0::DOUBLE) AS dy FROM g), k AS (SELECT *, CASE WHEN dx <> 0 OR dy <> 0 THEN fmod(degrees(atan2(-dx, dy)) + 360, 360.0::DOUBLE) END AS aspect, atan(sqrt(dx * dx + dy * dy)) AS s FROM h)"

# rows and neighbours as in _stats; numbers 0 to 24 are the areas' ranks, which are their ids
_P01_CLASSES = """, d AS MATERIALIZED (SELECT rep, s, ('0x' || substr(md5(rep || ':' || s), 1, 8))::BIGINT % 25 AS spot FROM range(199) a(rep), range(400) b(s)),
u AS (SELECT rep, spot, row_number() OVER (PARTITION BY rep ORDER BY min(s)) AS pos FROM d GROUP BY rep, spot),
deg AS (SELECT i, count(*) AS k FROM w GROUP BY i),
q AS (SELECT deg.i, deg.k, u.rep, z.z, row_number() OVER (PARTITION BY deg.i, u.rep ORDER BY u.pos) AS n FROM deg JOIN u ON u.spot <> deg.i JOIN z ON z.k = u.spot),
m AS (SELECT i, rep, sum(z) / any_value(k) AS lag FROM q WHERE n <= k GROUP BY 1, 2),
l AS (SELECT m.i, count(*) FILTER (g.z * m.lag >= g.z * g.lag - 1e-9) AS larger FROM m JOIN g ON g.k = m.i GROUP BY 1),
p AS (SELECT i, (least(larger, 199 - larger) + 1) / 200.0::DOUBLE AS p_sim FROM l),
c AS (SELECT k, CASE WHEN z >= 0 AND lag >= 0 THEN 'HH' WHEN z < 0 AND lag >= 0 THEN 'LH' WHEN z < 0 THEN 'LL' ELSE 'HL' END AS quadrant FROM g)
SELECT k AS area_id, quadrant, round(p_sim, 9) AS p_sim, CASE WHEN p_sim < 0.05 THEN quadrant ELSE 'not significant' END AS class FROM c JOIN p ON p.i = k"""
# least squares of x on two columns by centred moments, the lags, and the sums that the tests need
_P04 = """, r AS MATERIALIZED (SELECT k, x AS y, (k % 5)::DOUBLE AS x1, ((k % 7) * (k % 7))::DOUBLE AS x2 FROM v),
a0 AS (SELECT avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS v11, var_pop(x2) AS v22, covar_pop(x1, x2) AS v12, covar_pop(x1, y) AS v1y, covar_pop(x2, y) AS v2y, var_pop(y) AS vyy FROM r),
a1 AS (SELECT *, (v1y * v22 - v2y * v12) / (v11 * v22 - v12 * v12) AS b1, (v2y * v11 - v1y * v12) / (v11 * v22 - v12 * v12) AS b2 FROM a0),
b AS MATERIALIZED (SELECT r.*, my + b1 * (x1 - m1) + b2 * (x2 - m2) AS f, y - my - b1 * (x1 - m1) - b2 * (x2 - m2) AS e FROM r, a1),
c AS MATERIALIZED (SELECT b.k, any_value(b.y) AS y, any_value(b.x1) AS x1, any_value(b.x2) AS x2, any_value(b.f) AS f, any_value(b.e) AS e, coalesce(sum(w.w * o.e), 0) AS le, coalesce(sum(w.w * o.y), 0) AS ly, coalesce(sum(w.w * o.f), 0) AS lf FROM b LEFT JOIN w ON w.i = b.k LEFT JOIN b o ON o.k = w.j GROUP BY b.k),
t AS (SELECT count(*)::DOUBLE AS n, sum(e * e) / count(*) AS s2, sum(e * le) AS ewe, sum(e * ly) AS ewy, sum(e ^ 3) AS e3, sum(e ^ 4) AS e4, var_pop(lf) AS vff, covar_pop(x1, lf) AS v1f, covar_pop(x2, lf) AS v2f FROM c)"""
_P04_TESTS = """, tr AS (SELECT sum(p.w * p.w) + sum(p.w * coalesce(q.w, 0)) AS tr FROM w p LEFT JOIN w q ON q.i = p.j AND q.j = p.i),
jj AS (SELECT t.*, a1.*, tr, n * (vff - (v1f * v1f * v22 - 2 * v1f * v2f * v12 + v2f * v2f * v11) / (v11 * v22 - v12 * v12)) / s2 + tr AS j, ewe / s2 AS de, ewy / s2 AS dl FROM t, a1, tr),
lm AS (SELECT 1 - s2 / vyy AS r2, n / 6 * ((e3 / n / s2 ^ 1.5) ^ 2 + (e4 / n / s2 ^ 2 - 3) ^ 2 / 4) AS jb, de * de / tr AS lme, dl * dl / j AS lml, (de - tr / j * dl) ^ 2 / (tr * (1 - tr / j)) AS rle, (dl - de) ^ 2 / (j - tr) AS rll, 3.841458820694124::DOUBLE AS sig FROM jj)
SELECT round(r2, 6) AS r2, round(jb, 6) AS jarque_bera, round(lme, 6) AS lm_error, round(lml, 6) AS lm_lag, round(rle, 6) AS robust_lm_error, round(rll, 6) AS robust_lm_lag,
CASE WHEN greatest(lme, lml) < sig THEN 'ols' WHEN least(lme, lml) < sig THEN CASE WHEN lml >= sig THEN 'lag' ELSE 'error' END WHEN (rll >= sig) <> (rle >= sig) THEN CASE WHEN rll >= sig THEN 'lag' ELSE 'error' END WHEN rll >= rle THEN 'lag' ELSE 'error' END AS verdict FROM lm"""

# areas touch where they share a corner; a region is in one piece where its areas reach one another inside it
_C09 = """, v AS (SELECT area_id, unnest([{'x': round(xmin, 9), 'y': round(ymin, 9)}, {'x': round(xmax, 9), 'y': round(ymin, 9)}, {'x': round(xmax, 9), 'y': round(ymax, 9)}, {'x': round(xmin, 9), 'y': round(ymax, 9)}]) AS p FROM area_boxes),
q AS (SELECT DISTINCT a.area_id AS i, b.area_id AS j FROM v a JOIN v b ON a.p = b.p AND a.area_id <> b.area_id),
l AS (SELECT area_id, 'rows' AS name, area_id // 5 AS r FROM area_boxes UNION ALL SELECT area_id, 'columns', area_id % 5 FROM area_boxes UNION ALL SELECT area_id, 'with_a_gap', CASE WHEN area_id <> 7 THEN area_id % 5 END FROM area_boxes
UNION ALL SELECT area_id, 'two', area_id % 2 FROM area_boxes UNION ALL SELECT area_id, 'scattered', CASE WHEN area_id IN (0, 24) THEN 0 ELSE 1 + area_id % 4 END FROM area_boxes),
t(name, r, start, spot) AS (SELECT name, r, area_id, area_id FROM l WHERE r IS NOT NULL UNION SELECT t.name, t.r, t.start, q.j FROM t JOIN q ON q.i = t.spot JOIN l ON l.area_id = q.j AND l.name = t.name AND l.r = t.r),
pieces AS (SELECT name, r, count(DISTINCT first) AS k FROM (SELECT name, r, start, min(spot) AS first FROM t GROUP BY 1, 2, 3) GROUP BY 1, 2),
s AS (SELECT name, count(*) AS areas, count(*) FILTER (r IS NULL) AS without, count(DISTINCT r) AS regions FROM l GROUP BY 1)
SELECT s.name AS label, areas, without, regions, (SELECT count(*) FROM pieces p WHERE p.name = s.name AND k > 1) AS split, areas = 25 AND without = 0 AND regions = 5 AND NOT EXISTS (SELECT 1 FROM pieces p WHERE p.name = s.name AND k > 1) AS matched FROM s"""

_P05 = V.sql_with("demand_points", body=f", n AS (SELECT p.demand_id AS i, s.demand_id AS j FROM demand_points p, demand_points s WHERE {Q.metres_sql('p', 's')} <= 1500), core AS (SELECT i FROM n GROUP BY 1 HAVING count(*) >= 5), l AS (SELECT i, j FROM n WHERE i IN (FROM core) AND j IN (FROM core)), r(node, c) AS (SELECT i, i FROM core UNION SELECT r.node, l.j FROM r JOIN l ON l.i = r.c), comp AS (SELECT node, min(c) AS c FROM r GROUP BY 1), edge AS (SELECT n.i, min(comp.c) AS c FROM n JOIN comp ON comp.node = n.j WHERE n.i NOT IN (FROM core) GROUP BY 1) SELECT demand_id, coalesce(comp.c, edge.c, -1) AS cluster FROM demand_points LEFT JOIN comp ON comp.node = demand_id LEFT JOIN edge ON edge.i = demand_id").replace("WITH ", "WITH RECURSIVE ", 1)

SQL = {
    "a15_zonal_stats": V.sql_with("pixels", body=", p AS (SELECT prow // 20 * 5 + pcol // 20 AS zone, CASE WHEN prow % 9 <> 0 THEN value END AS v FROM pixels) SELECT zone, count(*) AS pixels, round(count(v) / count(*), 4) AS coverage, round(avg(v), 4) AS mean, round(min(v), 4) AS min, round(max(v), 4) AS max, round(max(v) - min(v), 4) AS relief, round(stddev_pop(v), 4) AS std FROM p GROUP BY 1"),
    "a16_weights_diagnostics": V.sql_with("site_points", body=f", m AS (SELECT p.site_id AS i, {Q.metres_sql('p', 's')} AS m FROM site_points p JOIN site_points s ON p.site_id <> s.site_id), k AS (SELECT i, count(*) FILTER (m <= 6000) AS k FROM m GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (k = 0) AS islands, min(k) AS least, max(k) AS most, round(avg(k), 6) AS mean, median(k) AS median, round(sum(k) * 100 / (count(*) * count(*))::DOUBLE, 6) AS percent_nonzero FROM k"),
    "a17_global_statistics": _stats("SELECT round(any_value(c.n) / sum(w.w) * sum(w.w * a.z * b.z) / any_value(c.zz), 9) AS moran_i, round(any_value(-1.0::DOUBLE / (c.n - 1)), 9) AS expected_i, round(any_value(c.n - 1) * sum(w.w * (a.z - b.z) * (a.z - b.z)) / (sum(w.w) * 2 * any_value(c.zz)), 9) AS geary_c, round(sum(w.w * a.x * b.x) / any_value(c.sx * c.sx - c.sxx), 9) AS getis_g FROM w JOIN z a ON a.k = w.i JOIN z b ON b.k = w.j, (SELECT count(*) AS n, sum(z * z) AS zz, sum(x) AS sx, sum(x * x) AS sxx FROM z) c"),
    "a33_community_profiles": "WITH t AS (SELECT c_nationkey AS community, c_mktsegment AS kind, count(*) AS inside FROM customer GROUP BY 1, 2), o AS (SELECT c_mktsegment AS kind, count(*) AS overall FROM customer GROUP BY 1), s AS (SELECT *, round(inside * ln(1 + inside / overall), 9) AS score FROM t JOIN o USING (kind) WHERE inside >= 2) SELECT community, sum(inside)::BIGINT AS size, arg_max(kind, (inside, kind)) AS main_kind, round(max(inside) / sum(inside), 6) AS purity, arg_max(kind, (score, kind)) AS top_tag FROM s GROUP BY 1",
    "a39_ndvi_change": V.sql_with("pixels", body=", d AS (SELECT (after - before) / nullif(after + before, 0) AS d FROM pixels) SELECT count(d) AS cells, round(avg(d), 6) AS mean_change, count(*) FILTER (d < -0.2) AS loss_cells FROM d"),
    "a40_suitability": V.sql_with("pixels", body=", s AS (SELECT prow, pcol, round(value * 0.6::DOUBLE + prow * 0.3::DOUBLE - pcol * 0.1::DOUBLE, 6) AS s FROM pixels WHERE value > 20 AND prow % 10 > 2 AND pcol < 80) SELECT count(*) AS cells, max(s) AS best, first(prow * 100 + pcol ORDER BY s DESC, prow, pcol) AS best_cell FROM s"),
    "a41_inundation": V.sql_with("pixels", body=", p AS (SELECT CASE WHEN pcol % 10 <> 0 THEN value END AS v FROM pixels) SELECT count(*) FILTER (v <= 24) AS wet, round(avg(24 - v) FILTER (v <= 24), 6) AS mean_depth, round(max(24 - v) FILTER (v <= 24), 6) AS max_depth, round(count(*) FILTER (v <= 24) * 100 / count(v)::DOUBLE, 6) AS percent FROM p"),
    "a43_segment_share": V.sql_with("pixels", body=" SELECT floor(value / 10)::BIGINT AS band, count(*) AS n, round(count(*) / (SELECT count(*) FROM pixels)::DOUBLE, 6) AS share FROM pixels GROUP BY 1"),
    "c01_connected_parts": f"WITH RECURSIVE {_EDGES}, r(node, c) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT r.node, b.dst FROM r JOIN b ON b.src = r.c) SELECT node, min(c) AS component FROM r GROUP BY 1",
    "c01_unfiltered_parts": "WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem WHERE l_orderkey % 2 = 1 AND l_suppkey % 3 = l_partkey % 3), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, c) AS (SELECT a, a FROM b UNION SELECT r.node, b.b FROM r JOIN b ON b.a = r.c) SELECT node, min(c) AS component FROM r GROUP BY 1",
    "c05_modularity": f"WITH {_EDGES}, t AS (SELECT sum(weight) AS m FROM e), k AS (SELECT s_suppkey AS node, 'alone' AS grouping, s_suppkey AS c FROM supplier UNION ALL SELECT s_suppkey, 'nation', s_nationkey FROM supplier UNION ALL SELECT s_suppkey, 'together', 0 FROM supplier), i AS (SELECT a.grouping, coalesce(sum(weight) FILTER (a.c = b.c), 0) AS inside FROM e JOIN k a ON a.node = src JOIN k b ON b.node = dst AND b.grouping = a.grouping GROUP BY 1), g AS (SELECT grouping, c, sum(weight) AS d FROM b JOIN k ON k.node = src GROUP BY 1, 2), dd AS (SELECT grouping, sum(d * d) AS dd FROM g GROUP BY 1) SELECT grouping, round(inside / m - dd / (4 * m * m), 9) + 0 AS modularity FROM i JOIN dd USING (grouping), t",
    "p05_cluster_summary": _P05.replace("SELECT demand_id, coalesce(comp.c, edge.c, -1) AS cluster FROM", ", k AS (SELECT demand_points.*, coalesce(comp.c, edge.c, -1) AS cluster FROM", 1) + f"), o AS (SELECT cluster, count(*) AS n, avg(lon) AS lon, avg(lat) AS lat FROM k GROUP BY 1) SELECT o.cluster, any_value(n) AS n, round(any_value(o.lon), 6) AS lon, round(any_value(o.lat), 6) AS lat, round(max({Q.metres_sql('k', 'o')}), 2) AS radius_m FROM k JOIN o ON o.cluster = k.cluster GROUP BY 1",
    "c02_within_hops": f"WITH RECURSIVE {_EDGES}, r(start, node, depth) AS (SELECT s_suppkey, s_suppkey, 0 FROM supplier WHERE s_suppkey % 25 = 0 UNION SELECT r.start, b.dst, r.depth + 1 FROM r JOIN b ON b.src = r.node WHERE r.depth < 2) SELECT start, node, min(depth) AS depth FROM r GROUP BY 1, 2",
    "c03_upstream": "WITH RECURSIVE r(start, node, depth) AS (SELECT o_orderkey, o_orderkey, 0 FROM orders WHERE o_orderkey % 3000 = 1 UNION SELECT start, node // 2, depth + 1 FROM r WHERE node > 0) SELECT start, node, min(depth) AS depth FROM r GROUP BY 1, 2",
    "c04_cheapest_paths": f"WITH RECURSIVE {_EDGES}, r(start, node, cost) AS (SELECT s_suppkey, s_suppkey, 0.0::DOUBLE FROM supplier WHERE s_suppkey % 50 = 0 UNION SELECT r.start, b.dst, round(r.cost + 3.0::DOUBLE / b.weight, 9) FROM r JOIN b ON b.src = r.node WHERE r.cost + 3.0::DOUBLE / b.weight <= 4.5) SELECT start, node, round(min(cost), 6) AS cost FROM r GROUP BY 1, 2",
    "c09_region_check": V.sql_with("area_boxes", body=_C09).replace("WITH ", "WITH RECURSIVE ", 1),
    "g08_slope_aspect_shade": V.sql_with("pixels", body=f", {_GRAD} SELECT prow, pcol, round(dx, 6) AS dx, round(dy, 6) AS dy, round(degrees(s), 4) AS slope, round(aspect, 3) AS aspect, round(greatest(0, (sin(radians(45.0::DOUBLE)) * cos(s) + cos(radians(45.0::DOUBLE)) * sin(s) * cos(radians(315.0::DOUBLE) - radians(coalesce(aspect, 0)))) * 255), 2) AS shade FROM k"),
    "j14_knn_graph": f"WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id AS q, b.vec_id AS v, round({_COS}, 9) AS c FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id), k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY q ORDER BY c DESC, v) <= 5) SELECT least(q, v) AS src, greatest(q, v) AS dst, round(greatest(max(c), 0) * 0.5::DOUBLE * CASE WHEN count(*) = 2 THEN 1.0 ELSE 0.6 END, 6) AS weight FROM k GROUP BY 1, 2",
    "j15_collection_pairs": f"WITH {_J15} SELECT * FROM clique",
    "j16_curated_pairs": f"WITH {_J16} SELECT * FROM cur",
    "p01_lisa": _stats("SELECT k AS area_id, round(z * lag, 9) AS local_i, CASE WHEN z >= 0 AND lag >= 0 THEN 'HH' WHEN z < 0 AND lag >= 0 THEN 'LH' WHEN z < 0 THEN 'LL' ELSE 'HL' END AS quadrant FROM g"),
    "a18_permutation_p": _stats(""", o AS (SELECT k, z, row_number() OVER (ORDER BY k) AS n FROM z), s AS MATERIALIZED (SELECT rep, z, row_number() OVER (PARTITION BY rep ORDER BY md5(rep || ':' || k), k) AS n FROM z, range(199) t(rep)),
h AS MATERIALIZED (SELECT s.rep, o.k, s.z FROM s JOIN o USING (n)), m AS (SELECT a.rep, sum(w.w * a.z * b.z) AS m FROM w JOIN h a ON a.k = w.i JOIN h b ON b.k = w.j AND b.rep = a.rep GROUP BY 1),
x AS (SELECT sum(w.w * a.z * b.z) AS seen FROM w JOIN z a ON a.k = w.i JOIN z b ON b.k = w.j), c AS (SELECT any_value(seen) AS seen, count(*) AS draws, count(*) FILTER (m >= seen - 1e-9) AS larger FROM m, x)
SELECT round(seen, 6) AS seen, draws, round((least(larger, draws - larger) + 1) / (draws + 1)::DOUBLE, 9) AS p_sim FROM c"""),
    "p01_lisa_classes": _stats(_P01_CLASSES),
    "p04_spatial_diagnostics": _stats(_P04 + _P04_TESTS),
    "p04_residual_table": _stats(_P04 + " SELECT c.k AS area_id, round(f, 6) AS fitted, round(e, 6) AS residual, round(e / sqrt(s2), 6) AS standardised, round(le, 6) AS lag_residual FROM c, t"),
    "p02_getis_star": _stats(", s AS (SELECT i, j FROM n UNION ALL SELECT k, k FROM v), t AS (SELECT s.i, sum(v.x) AS wx, count(*)::DOUBLE AS w FROM s JOIN v ON v.k = s.j GROUP BY 1), m AS (SELECT count(*)::DOUBLE AS n, avg(x) AS mean, stddev_pop(x) AS sd FROM v), q AS (SELECT i AS area_id, (wx - mean * w) / (sd * sqrt((n * w - w * w) / (n - 1))) AS z FROM t, m) SELECT area_id, round(z, 9) AS z, CASE WHEN z >= 2.576 THEN 'hot 99' WHEN z >= 1.96 THEN 'hot 95' WHEN z <= -2.576 THEN 'cold 99' WHEN z <= -1.96 THEN 'cold 95' ELSE 'none' END AS band FROM q"),
    "p03_moran_scatter": _stats("SELECT round(regr_slope(lag, z), 9) AS slope, count(*) FILTER (z >= 0 AND lag >= 0) AS hh, count(*) FILTER (z < 0 AND lag >= 0) AS lh, count(*) FILTER (z < 0 AND lag < 0) AS ll, count(*) FILTER (z >= 0 AND lag < 0) AS hl FROM g"),
    "p05_dbscan": _P05,
    "p09_zone_pooling": "WITH x AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings) SELECT label, count(*) AS n, k::INT AS k, round(avg(v::DOUBLE), 6) + 0 AS v FROM x GROUP BY label, k",
    "u02_fuse_layers": f"WITH {_EDGES}, {_J15}, {_J16}, a AS (SELECT src, dst, weight, 'parts' AS rel FROM e UNION ALL SELECT src, dst, weight, 'nation' FROM clique UNION ALL SELECT src, dst, 1.0, 'curated' FROM cur) SELECT src, dst, round(sum(weight), 6) AS weight, string_agg(rel, '+' ORDER BY rel) AS rels, count(*) AS support FROM a GROUP BY 1, 2",
    "u05_jaccard_match": "WITH c AS (SELECT c_custkey, c_nationkey AS o, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS n FROM customer), i AS (SELECT o, n, count(*) AS i FROM c GROUP BY 1, 2), j AS (SELECT i.o AS old_c, i.n AS new_c, i / (a.k + b.k - i)::DOUBLE AS jaccard FROM i JOIN (SELECT o, count(*) AS k FROM c GROUP BY 1) a USING (o) JOIN (SELECT n, count(*) AS k FROM c GROUP BY 1) b USING (n)), m AS (SELECT *, row_number() OVER (PARTITION BY old_c ORDER BY jaccard DESC, new_c) AS x, row_number() OVER (PARTITION BY new_c ORDER BY jaccard DESC, old_c) AS y FROM j WHERE jaccard >= 0.5) SELECT old_c, new_c, round(jaccard, 6) AS jaccard FROM m WHERE x = 1 AND y = 1",
    "p04_ols": "WITH m AS (SELECT count(*) AS n, avg(l_extendedprice) AS y, avg(l_quantity) AS a, avg(l_discount) AS b, var_pop(l_quantity) AS vaa, var_pop(l_discount) AS vbb, covar_pop(l_quantity, l_discount) AS vab, covar_pop(l_quantity, l_extendedprice) AS vay, covar_pop(l_discount, l_extendedprice) AS vby, var_pop(l_extendedprice) AS vyy FROM lineitem), s AS (SELECT *, (vay * vbb - vby * vab) / (vaa * vbb - vab * vab) AS b1, (vby * vaa - vay * vab) / (vaa * vbb - vab * vab) AS b2 FROM m) SELECT round((b1 * vay + b2 * vby) / vyy, 6) AS r2, round(y - b1 * a - b2 * b, 2) AS b0, round(b1, 2) AS b1, round(b2, 2) AS b2 FROM s",
}
