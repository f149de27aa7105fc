"""Operators on small hand-made inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from loamgrid.functions import geo, temporal, text
from loamgrid.operators import autocorrelation, graphs, learning, retrieval, spatial, tables
from loamgrid.operators.components import connected_components
from loamgrid.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_entry_runs(spark):
    if not __import__("os").path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the given tables are not here")
    assert __spark_entry__.entry(spark).count() == 25


def test_names_of_oracles_are_registered():
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(190)] + [(k, k + 1) for k in range(1000, 1040)] + [(7777, 7777), (None, 3)]
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: top(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_wards_and_incidents(spark):
    wards = spark.createDataFrame([("west", -88.3, 40.05, -88.2, 40.15), ("east", -88.2, 40.05, -88.1, 40.15), ("empty", -80.0, 40.0, -79.9, 40.1)], "name string, xmin double, ymin double, xmax double, ymax double")
    pts = spark.createDataFrame([(-88.25, 40.1, 10), (-88.24, 40.1, 20), (-88.23, 40.1, 30), (-88.15, 40.1, 100), (-70.0, 40.1, 7)], "lon double, lat double, val int")
    counted = {r["name"]: r["point_count"] for r in spatial.count_points_in_areas(pts, wards, "name", 0.1).collect()}
    assert counted == {"west": 3, "east": 1, "empty": 0}
    std = {r["name"]: r["val_std"] for r in spatial.count_points_in_areas(pts, wards, "name", 0.1, "val", "std").collect()}
    assert std["west"] == 10 and std["east"] is None and std["empty"] is None


def test_projection_and_distance(spark):
    x, y = geo.utm_xy(F.lit(-87.0), F.lit(0.0), F.lit(-87.0))
    assert one(spark, x) == pytest.approx(500000) and one(spark, y) == pytest.approx(0)
    x, y = geo.utm_xy(F.lit(-88.2434), F.lit(40.1164), F.lit(-87.0))
    assert one(spark, x) == pytest.approx(394054, abs=60) and one(spark, y) == pytest.approx(4441500, abs=400)
    assert one(spark, geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(111195, abs=1)


@pytest.mark.parametrize(("written", "degrees"), [("24°07'12.0\"N", 24.12), ("-88.25", -88.25), ("10 30 00 W", -10.5), ("n/a", None), ("", None)])
def test_dms(spark, written, degrees):
    got = one(spark, geo.dms_to_degrees(F.lit(written)))
    assert got is None if degrees is None else got == pytest.approx(degrees)


def test_null_semantics_of_selection(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "v string")
    kept = lambda op, v: [r["v"] for r in df.where(tables.predicate(F.col("v"), op, v)).collect()]
    assert kept("!=", 1) == ["x", None] and kept("not_in", ["x"]) == ["1", None] and kept("==", 1) == ["1"] and kept("isnull", None) == [None]


def test_column_format_is_chosen_once(spark):
    df = spark.createDataFrame([("07/04/2024 01:02:03 PM",), ("12/31/2023 11:59:59 AM",), ("2024-01-01",), (None,), ("soon",)], "w string")
    out, name = temporal.parse_text(df, "w")
    assert name == "MM/dd/yyyy hh:mm:ss a" and out.where("parsed is null").count() == 3


def test_period_bound_precision(spark):
    assert str(one(spark, temporal.bound(F.lit("2026-07"), True))) == "2026-07-31 23:59:59.999999"
    assert one(spark, temporal.bound(F.lit("soon"), True)) is None


def test_text_keys(spark):
    assert one(spark, text.canonical_url(F.lit("HTTP://WWW.Example.com:80/A?utm_source=x&b=1#top"))) == "http://www.example.com/A?b=1"
    assert one(spark, text.dois(F.lit("see 10.1000/ABC.) and 10.1000/abc"))) == ["10.1000/abc"]
    assert one(spark, text.identifier_tokens(F.lit("fooBar_baz2"))) == ["foobar", "baz2", "foo", "bar", "baz", "2"]


def test_html_to_text(spark):
    page = "<html><head><title>T</title></head><body><script>var x='<p>'</script><p>One &amp; two</p><!-- no --><div>Three</div></body></html>"
    assert one(spark, text.html_to_text(F.lit(page))) == "One & two\nThree"


def test_cheapest_path_isn_t_the_shortest(spark):
    edges = spark.createDataFrame([(1, 2, 10.0), (1, 3, 1.0), (3, 4, 1.0), (4, 2, 1.0)], "src long, dst long, c double")
    got = {r["node"]: r["cost"] for r in graphs.cheapest(edges, spark.createDataFrame([(1,)], "node long"), "c").collect()}
    assert got == {1: 0.0, 2: 3.0, 3: 1.0, 4: 2.0}


def test_communities_of_two_cliques(spark):
    pairs = [(a, b, 1.0) for base in (0, 10) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(4, 10, 0.1)]
    edges = spark.createDataFrame(pairs, "src long, dst long, weight double")
    labels = graphs.label_communities(edges, "weight")
    assert {(r["node"], r["community"]) for r in labels.collect()} == {(k, 0) for k in range(5)} | {(k, 10) for k in range(10, 15)}
    assert graphs.modularity(edges, "weight", labels).first()["modularity"] > 0.4


def test_moran_of_a_gradient(spark):
    side = 6
    rings = spark.createDataFrame([(r * side + c, [(float(c), float(r)), (c + 1.0, float(r)), (c + 1.0, r + 1.0), (float(c), r + 1.0)]) for r in range(side) for c in range(side)], "k long, ring array<struct<x:double,y:double>>")
    weights = autocorrelation.row_standardised(spatial.contiguity(rings, "k"))
    values = spark.createDataFrame([(k, float(k // side)) for k in range(side * side)], "k long, x double")
    row = autocorrelation.global_statistics(values, weights, "k", "x").first()
    assert row["moran_i"] > 0.7 and row["expected_i"] == pytest.approx(-1 / 35)
    assert autocorrelation.permutation_p(values, weights, "k", "x", 99).first()["p_sim"] <= 0.02


def test_ols_with_a_known_line(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    df = spark.createDataFrame([(float(v), float(2 + 1.5 * v)) for v in x], "x double, y double")
    fit = autocorrelation.ols(df, "y", ["x"])
    assert fit["beta"] == pytest.approx([2, 1.5]) and fit["r2"] == pytest.approx(1)


def test_knn_ties_and_zero_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [0.0, 1.0]), (5, None)], "id long, v array<double>")
    q = v.where("id = 1").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    got = [(r["id"], r["cosine"]) for r in retrieval.knn(q, v, "q", "qv", "id", "v", 3).orderBy("rank").collect()]
    assert got == [(2, 1.0), (3, 0.0), (4, 0.0)]


def test_ridge_finds_a_linear_label(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 3))
    rows = [(int(k % 4), x[k].tolist(), float(x[k] @ [1, -2, 0.5] + 3)) for k in range(120)]
    df = spark.createDataFrame(rows, "block int, v array<double>, y double")
    assert learning.ridge_block_cv(df, "y", "v", "block", [1e-6]).first()["r2"] > 0.999
    assert learning.ridge_block_cv(df.limit(5), "y", "v", "block").first()["r2"] is None


def test_hull_of_a_disc(spark):
    pts = [("a", math.cos(k), math.sin(k)) for k in range(40)] + [("a", 0.1 * k / 40, 0.0) for k in range(40)]
    hull = learning.convex_hull(spark.createDataFrame(pts, "g string, x double, y double"), "g", "x", "y").first()["hull"]
    assert len(hull) == 40


def test_headers_and_notebooks(spark, tmp_path):
    las = bytearray(227)
    las[:4] = b"LASF"
    import json
    import struct

    struct.pack_into("<I", las, 107, 42)
    struct.pack_into("<4d", las, 179, 4.0, 1.0, 5.0, 2.0)
    (tmp_path / "a.las").write_bytes(las)
    found = files.header_catalog(spark.read.format("binaryFile").load(str(tmp_path / "a.las"))).first()
    assert (found["kind"], found["n"], found["xmin"], found["ymax"]) == ("las", 42, 1.0, 5.0)
    (tmp_path / "n.ipynb").write_text(json.dumps({"cells": [{"cell_type": "code", "source": ["a=1\n", "b"]}, {"cell_type": "markdown", "source": ["# t"]}]}))
    assert [(r["kind"], r["source"]) for r in files.notebook_cells(spark, str(tmp_path / "n.ipynb")).orderBy("cell").collect()] == [("code", "a=1\nb"), ("markdown", "# t")]


def test_nearest_join_plan_has_no_cross_join(spark):
    p = spark.createDataFrame([(k, -88 + k / 100, 41.0) for k in range(50)], "a long, lon double, lat double")
    q = p.withColumnRenamed("a", "b")
    plan = spatial.within_distance(p, q, 3000.0, "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_nearest_join_goes_round_the_globe(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, -80.0)], "a long, lon double, lat double")
    q = spark.createDataFrame([(7, 50.0, 0.0), (8, -100.0, 88.0)], "b long, lon double, lat double")
    got = {r["a"]: (r["b"], round(r["distance_m"] / 1000)) for r in spatial.nearest_join(p, q, "a", "b", 1000.0).collect()}
    assert got == {1: (7, 5560), 2: (7, 9295)}


def test_loops_never_return_a_cut_result(spark):
    chain = spark.createDataFrame([(k, k + 1, 1.0) for k in range(4)], "src long, dst long, w double")
    start = spark.createDataFrame([(0,)], "node long")
    assert graphs.upstream(chain, start, most=5).count() == 5
    for cut in (lambda: graphs.upstream(chain, start, most=2), lambda: graphs.cheapest(chain, start, "w", most=2), lambda: graphs.label_communities(chain, "w", rounds=1)):
        with pytest.raises(RuntimeError):
            cut()


def test_communities_settle_where_a_pair_moves_together(spark):
    pairs = spark.createDataFrame([(k, k + 100, 1.0) for k in range(40)], "src long, dst long, w double")
    got = {r["node"]: r["community"] for r in graphs.label_communities(pairs, "w").collect()}
    assert got == {k + side: k for k in range(40) for side in (0, 100)}


def test_communities_use_every_order(spark, tmp_path):
    from loamgrid.plans import registry

    cliques = [(1, 2, 3), (7, 8)]
    rows = [(100 * k + o, s) for k, members in enumerate(cliques) for o in range(1, 11) for s in members]
    rows += [(1000 + k, 100 + 2 * k + s) for k in range(60) for s in (0, 1)]  # pairs that share one order are no edges
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    out = registry.queries()["c05_label_communities"](spark, str(tmp_path)).collect()
    assert {(r["node"], r["community"], r["n"]) for r in out} == {(s, m[0], len(m)) for m in cliques for s in m}
