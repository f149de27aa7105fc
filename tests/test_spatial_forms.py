"""Spatial operators against plain versions: the date line and the poles, predicates, overlays, permutations, site pairs."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.operators import autocorrelation as A
from loamgrid.operators import graphs as G
from loamgrid.operators import spatial as S

PLACE = "{} long, lon double, lat double"


def metres(a, b):
    dlat, dlon = math.radians(b[1] - a[1]) / 2, math.radians(b[0] - a[0]) / 2
    h = math.sin(dlat) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(dlon) ** 2
    return math.asin(math.sqrt(min(1, h))) * 2 * 6371008.8


@pytest.fixture(scope="module")
def globe():
    rng = random.Random(5)
    near = [(179.999, 10.0), (-179.999, 10.0), (180.0, 10.001), (-180.0, 9.999), (0.0, 90.0), (120.0, 89.99), (-60.0, 89.99), (30.0, -90.0), (-150.0, -89.995), (10.0, 89.5), (10.5, 89.5), (-170.0, 89.5)]
    near += [(rng.uniform(-180, 180), rng.uniform(88, 90)) for _ in range(60)] + [(rng.choice([-1, 1]) * rng.uniform(179.9, 180), rng.uniform(-1, 1)) for _ in range(60)]
    return near + [(rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1)))) for _ in range(120)]


@pytest.mark.parametrize("reach", [300.0, 20_000.0, 400_000.0, 9_000_000.0, 30_000_000.0])
def test_distances_close_round_the_globe(spark, globe, reach):
    a = spark.createDataFrame([(k, *p) for k, p in enumerate(globe)], PLACE.format("a"))
    b = a.withColumnRenamed("a", "b")
    want = {(i, j) for i, p in enumerate(globe) for j, q in enumerate(globe) if metres(p, q) <= reach}
    got = [(r["a"], r["b"]) for r in S.within_distance(a, b, reach, "a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_nearest_over_the_date_line_and_the_pole(spark, globe):
    left, right = [(k, *p) for k, p in enumerate(globe[:90])], [(k, *p) for k, p in enumerate(globe[90:])]
    out = S.nearest_join(spark.createDataFrame(left, PLACE.format("a")), spark.createDataFrame(right, PLACE.format("b")), "a", "b", 1000.0).collect()
    want = {k: min((metres(p, q), j) for j, *q in right) for k, *p in left}
    assert {r["a"]: r["b"] for r in out} == {k: j for k, (_, j) in want.items()}
    assert all(abs(r["distance_m"] - want[r["a"]][0]) < 1e-3 for r in out)
    knn = {(r["i"], r["rank"]): r["j"] for r in S.knn_weights(spark.createDataFrame(left, PLACE.format("a")), "a", 3, 5000.0).collect()}
    for k, *p in left:
        near = sorted((metres(p, q), j) for j, *q in left if j != k)[:3]
        assert [knn[k, n + 1] for n in range(3)] == [j for _, j in near]


BOX = "{} long, xmin double, ymin double, xmax double, ymax double"


def boxes(seed, n, flat=True):
    rng = random.Random(seed)
    grid = [k / 4 for k in range(-8, 9)]
    out = []
    for k in range(n):
        x, y = sorted(rng.sample(grid, 2)), sorted(rng.sample(grid, 2))
        if flat and k % 4 == 1:
            x[1] = x[0]
        if flat and k % 8 in (1, 2):
            y[1] = y[0]
        out.append((k, x[0], y[0], x[1], y[1]))
    return out


def holds(name, a, b):
    """A predicate from sample points of all cells that both boxes' sides cut: interiors, boundaries and outside."""
    axes = [sorted({a[k], a[k + 2], b[k], b[k + 2], -9.0, 9.0}) for k in (0, 1)]
    points = [sorted({*axis, *((p + q) / 2 for p, q in itertools.pairwise(axis))}) for axis in axes]
    dim = lambda s: (s[0] < s[2]) + (s[1] < s[3])

    def place(s, p):
        """i inside, b on the boundary, e outside, by relative interiors."""
        if not all(s[k] <= p[k] <= s[k + 2] for k in (0, 1)):
            return "e"
        return "i" if all(s[k] == s[k + 2] or s[k] < p[k] < s[k + 2] for k in (0, 1)) else "b"

    seen = {(place(a, p), place(b, p)) for p in itertools.product(*points)}
    in_a, in_b = {x for x in seen if x[0] != "e"}, {x for x in seen if x[1] != "e"}
    meet, a_in_b, b_in_a = ("i", "i") in seen, all(x[1] != "e" for x in in_a), all(x[0] != "e" for x in in_b)
    both = [(max(a[k], b[k]), min(a[k + 2], b[k + 2])) for k in (0, 1)]
    shared = sum(p < q for p, q in both)
    low, high = sorted((dim(a), dim(b)))
    return {
        "intersects": any(x[0] != "e" and x[1] != "e" for x in seen), "within": a_in_b and meet, "contains": b_in_a and meet, "covers": b_in_a, "covered_by": a_in_b, "equals": a_in_b and b_in_a,
        "touches": not meet and any(x[0] != "e" and x[1] != "e" for x in seen), "contains_properly": all(x[0] == "i" for x in in_b),
        "overlaps": dim(a) == dim(b) == shared and meet and not a_in_b and not b_in_a,
        "crosses": low > 0 and meet and ((low < high and not (a_in_b if dim(a) < dim(b) else b_in_a)) or (low == high == 1 and shared == 0)),
    }[name]


@pytest.mark.parametrize("name", S.PREDICATES)
def test_predicates(spark, name):
    left, right = boxes(1, 60), boxes(2, 40)
    a, b = spark.createDataFrame(left, BOX.format("a")), spark.createDataFrame(right, BOX.format("b"))
    want = sorted((p[0], q[0]) for p in left for q in right if holds(name, p[1:], q[1:]))
    assert sorted(map(tuple, S.spatial_join(a, b, "a", "b", 0.7, name).collect())) == want
    for how, side in (("left", 0), ("right", 1)):
        rows = [tuple(r) for r in S.spatial_join(a, b, "a", "b", 0.7, name, how).collect()]
        assert {r[side] for r in rows} == {p[0] for p in (left, right)[side]} and sorted(r for r in rows if None not in r) == want
    with pytest.raises(ValueError):
        S.spatial_join(a, b, "a", "b", 1.0, "near")


@pytest.mark.parametrize("mode", S.OVERLAYS)
def test_overlay_pieces(spark, mode):
    left, right = boxes(3, 30, flat=False), boxes(4, 25, flat=False)
    a, b = spark.createDataFrame(left, BOX.format("a")), spark.createDataFrame(right, BOX.format("b"))
    pieces = [tuple(r) for r in S.overlay(a, b, "a", "b", 0.9, mode).collect()]
    step, cells = 0.25, list(itertools.product(range(-8, 8), repeat=2))
    hold = lambda s, c: s[1] <= c[0] * step and (c[0] + 1) * step <= s[3] and s[2] <= c[1] * step and (c[1] + 1) * step <= s[4]
    want = {}
    for c in cells:
        l, r = [s[0] for s in left if hold(s, c)], [s[0] for s in right if hold(s, c)]
        keys = []
        if mode in ("intersection", "identity", "union"):
            keys += [(i, j) for i in l for j in r]
        if mode != "intersection" and not r:
            keys += [(i, None) for i in l]
        if mode in ("union", "symmetric_difference") and not l:
            keys += [(None, j) for j in r]
        for k in keys:
            want[k] = want.get(k, 0) + step * step
    got = {}
    for i, j, x0, y0, x1, y1, area in pieces:
        assert x0 < x1 and y0 < y1 and math.isclose(area, (x1 - x0) * (y1 - y0))
        got[i, j] = got.get((i, j), 0) + area
    assert got.keys() == want.keys() and all(math.isclose(got[k], v, abs_tol=1e-9) for k, v in want.items())
    for k in {k for k in got if None in k}:  # pieces of one box don't overlap one another
        mine = [p for p in pieces if p[:2] == k]
        for p, q in itertools.combinations(mine, 2):
            assert max(p[2], q[2]) >= min(p[4], q[4]) - 1e-12 or max(p[3], q[3]) >= min(p[5], q[5]) - 1e-12


def grid_case(spark, n=5):
    rng = np.random.default_rng(7)
    x = {k: float((k % n) + (k // n)) + float(rng.normal()) for k in range(n * n)}
    pairs = [(i, j) for i in x for j in x if i != j and abs(i % n - j % n) <= 1 and abs(i // n - j // n) <= 1]
    w = A.row_standardised(spark.createDataFrame(pairs, "i long, j long"))
    return x, pairs, spark.createDataFrame(list(x.items()), "area long, x double"), w


def test_conditional_permutations(spark):
    x, pairs, values, w = grid_case(spark)
    got = {r["area"]: r for r in A.lisa_classes(values, w, "area", "x", 1999).collect()}
    z = np.array([x[k] for k in sorted(x)])
    z = (z - z.mean()) / z.std()
    rng = np.random.default_rng(42)
    for i in x:
        near = [j for p, j in pairs if p == i]
        seen, others = z[i] * z[near].mean(), [j for j in x if j != i]
        sims = np.array([z[i] * z[rng.choice(others, len(near), replace=False)].mean() for _ in range(1999)])
        larger = int((sims >= seen - 1e-9).sum())
        want = (min(larger, 1999 - larger) + 1) / 2000
        assert abs(got[i]["p_sim"] - want) < 0.035, i
        assert got[i]["class"] == (got[i]["quadrant"] if got[i]["p_sim"] < 0.05 else "not significant")
    few = {r["area"]: r["p_sim"] for r in A.conditional_p(A.z_scores(values, "area", "x"), w, "area", 1999, cells=500).collect()}
    assert few == {i: r["p_sim"] for i, r in got.items()}  # passes of any size draw the same


def test_draws_are_without_replacement(spark):
    for n, most in ((25, 9), (7, 7), (1000, 3)):
        rows = A.draws(n, most, 0, 50, spark).groupBy("rep").agg(F.count("*").alias("k"), F.count_distinct("at").alias("d"), F.max("at").alias("m")).collect()
        assert len(rows) == 50 and all(r["k"] == r["d"] == most and r["m"] < n for r in rows)


def test_islands_have_no_class(spark):
    _, pairs, values, _ = grid_case(spark)
    w = A.row_standardised(spark.createDataFrame([(i, j) for i, j in pairs if 24 not in (i, j)], "i long, j long"))
    got = {r["area"]: r for r in A.lisa_classes(values, w, "area", "x", 99).collect()}
    assert got[24]["class"] == "island" and got[24]["p_sim"] is None and got[0]["p_sim"] is not None


def test_robust_tests_against_matrices(spark):
    x, pairs, values, w = grid_case(spark)
    rng = np.random.default_rng(3)
    cov = {k: float(rng.normal()) for k in x}
    df = values.join(spark.createDataFrame(list(cov.items()), "area long, c double"), "area")
    got = A.spatial_diagnostics(df, w, "area", "x", ["c"]).first()
    n = len(x)
    W = np.zeros((n, n))
    for i, j in pairs:
        W[i, j] = 1
    W /= W.sum(axis=1, keepdims=True)
    y, X = np.array([x[k] for k in range(n)]), np.c_[np.ones(n), [cov[k] for k in range(n)]]
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    e = y - X @ b
    s2, T = e @ e / n, np.trace(W.T @ W + W @ W)
    M = np.eye(n) - X @ np.linalg.inv(X.T @ X) @ X.T
    f = W @ X @ b
    J = f @ M @ f / s2 + T
    de, dl = e @ W @ e / s2, e @ W @ y / s2
    want = {"lm_error": de**2 / T, "lm_lag": dl**2 / J, "robust_lm_lag": (dl - de) ** 2 / (J - T), "robust_lm_error": (de - T / J * dl) ** 2 / (T * (1 - T / J))}
    assert all(math.isclose(got[k], v, rel_tol=1e-9) for k, v in want.items())
    assert [A.chosen_model(*v) for v in ((1, 1, 9, 9), (1, 9, 0, 0), (9, 1, 0, 0), (9, 9, 5, 1), (9, 9, 1, 5), (9, 9, 6, 5))] == ["ols", "lag", "error", "error", "lag", "error"]


def test_site_pairs(spark):
    rng = random.Random(6)
    sites = [(k, rng.uniform(-1, 1), rng.uniform(50, 52)) for k in range(23)]
    demand = [(k, rng.uniform(-1, 1), rng.uniform(50, 52), float(rng.randrange(100))) for k in range(200)]
    s, d = spark.createDataFrame(sites, PLACE.format("s")), spark.createDataFrame(demand, "d long, lon double, lat double, w double").repartition(5)
    want = {(a[0], b[0]): sum(w * min(round(metres(p, a[1:]), 3), round(metres(p, b[1:]), 3)) for _, *p, w in demand) for a, b in itertools.combinations(sites, 2)}
    for block, splits in ((256, 2), (5, 3)):
        got = {(r["site_a"], r["site_b"]): r["cost"] for r in S.site_pair_costs(d, s, "w", "s", block, splits).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], v, rel_tol=1e-9) for k, v in want.items())
    assert S.distance_matrix(d, s, "d", "s", block=30).count() == 23 * 200


def test_region_check(spark):
    x, pairs, _, _ = grid_case(spark)
    areas = spark.createDataFrame([(k, k // 5, k % 25 in (0, 24), None if k == 3 else k // 5) for k in x], "area long, rows long, apart boolean, gap long")
    got = {r["label"]: r for r in G.region_check(areas, spark.createDataFrame(pairs, "i long, j long"), "area", ["rows", "apart", "gap"], 25, 5).collect()}
    assert got["rows"]["matched"] and not got["apart"]["matched"] and not got["gap"]["matched"]
    assert (got["apart"]["split"], got["gap"]["without"], got["rows"]["regions"]) == (1, 1, 5)
    two = G.region_check(areas, spark.createDataFrame(pairs, "i long, j long"), "area", ["apart"], 25, 2).first()
    assert two["regions"] == 2 and not two["matched"]  # as many as wanted, but one is in two pieces
