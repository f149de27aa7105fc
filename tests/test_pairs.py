"""Pairs of the rows of a key, fused layers, links of tools and units, links in texts."""

import random

from pyspark.sql import functions as F

from loamgrid.operators import context as C
from loamgrid.operators import graphs as G
from loamgrid.operators import lookups as U
from loamgrid.operators import pairs as P
from loamgrid.plans import analysis


def test_lists_and_pairs(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["a", "a", "a", "b", None])) for k in range(200)]
    left = spark.createDataFrame(rows, "x long, k string")
    lists = P.in_lists(left, ["k"], "x", "ids", most=20).collect()
    assert sorted(x for r in lists for x in r["ids"]) == list(range(200)) and max(len(r["ids"]) for r in lists) < 60 and len(lists) > 6
    got = sorted((r["k"], r["x"], r["y"]) for r in P.paired(left, left.where("x % 3 = 0").withColumnRenamed("x", "y"), "k", "x", "y").collect())
    assert got == sorted((k, x, y) for x, k in rows for y, j in rows if k is not None and k == j and y % 3 == 0)


def test_layers_are_fused_in_one_grouping(spark):
    a = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.25), (3, 3, 9.0), (4, 5, 1.0)], "src long, dst long, weight double")
    b = spark.createDataFrame([(2, 1, 1.0), (6, 5, 2.0)], "src long, dst long, weight double")
    out = G.fuse_layers({"late": a, "early": b})
    assert sorted(map(tuple, out.collect())) == [(1, 2, 1.75, "early+late", 2), (4, 5, 1.0, "late", 1), (5, 6, 2.0, "early", 1)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_units_with_several_symbols(spark):
    specs = spark.createDataFrame([(s, ["ring", "bolt (x)", "none"]) for s in range(40)] + [(40, ["bolt"])], "s long, tools array<string>")
    units = spark.createDataFrame([(1, "ring"), (1, "bolt"), (2, "Ring"), (3, "bolt"), (3, "bolt"), (4, "other")], "u long, symbol string")
    out = U.spec_unit_links(specs, units, "s", "tools", "u", "symbol", F.lit(False), F.lit(False))
    got = sorted((r["s"], r["u"], r["matched"]) for r in out.collect())
    assert got == sorted([(s, u, m) for s in range(40) for u, m in ((1, "bolt"), (2, "ring"), (3, "bolt"))] + [(40, 1, "bolt"), (40, 3, "bolt")])


def test_edges_are_stored(spark, sf_dir):
    assert "lineitem" not in analysis._edges(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_links_are_looked_for_once(spark):
    one, two = "0a1b2c3d-0000-1111-2222-333344445555", "ffffffff-0000-1111-2222-333344445555"
    text = f"https://a.org/Maps/{one} HTTP://A.org/x/y/{one.upper()} https://b.org/files/{one} https://a.org/m/{two} https://c.org/m/{two}"
    df = spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "k long, t string")
    out = df.select("k", C.platform_citations(F.col("t"), {"a.org": "CITES", "b.org": "USES"}).alias("c"))
    got = {r["k"]: None if r["c"] is None else [tuple(c) for c in r["c"]] for r in out.collect()}
    assert got == {1: [(one, "CITES", "maps", "a.org"), (one, "USES", "files", "b.org"), (two, "CITES", "m", "a.org")], 2: [], 3: None}
    assert "array_position" not in out._jdf.queryExecution().optimizedPlan().toString()
