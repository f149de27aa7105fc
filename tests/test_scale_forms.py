"""Forms that keep a task's share bounded, against plain versions; streams over several batches; lookups."""

import hashlib
import os
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.operators import learning, lookups, retrieval, tables
from loamgrid.sources.store import RecordStore
from loamgrid.streaming import jobs


def test_knn_in_blocks_finds_the_same(spark):
    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(i, rng.normal(size=8).round(1).tolist()) for i in range(150)], "id long, v array<double>")
    q = v.where("id % 3 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    rows = lambda block: [tuple(r) for r in retrieval.knn(q, v, "q", "qv", "id", "v", 4, block).orderBy("q", "rank").collect()]
    assert rows(5000) == rows(20) and len(rows(20)) == 200
    assert retrieval.knn(q.where("q < 0"), v, "q", "qv", "id", "v", 4).count() == 0


@pytest.mark.parametrize("cap", [1, 7, 499, 500, 600])
def test_first_by_hash_is_the_sorted_beginning(spark, cap):
    order = sorted(range(500), key=lambda k: hashlib.md5(str(k).encode()).hexdigest())
    got = tables.first_by_hash(spark.range(500).withColumn("x", F.lit(1)), "id", cap)
    assert got.columns == ["id", "x"] and {r["id"] for r in got.collect()} == set(order[:cap])


def test_weighted_median_by_hand(spark):
    rnd = random.Random(3)
    rows = [(g, v, w) for g in ("a", "b", None) for v, w in [(rnd.choice([-5.5, 0.0, 2.0, 1e6, rnd.random()]), rnd.randint(1, 9)) for _ in range(60)]]
    rows += [("one", 3.0, 2), ("none", None, 1), ("a", None, 4), ("b", 1.0, None)]
    want = {}
    for g in {r[0] for r in rows}:
        have = sorted((v, w) for k, v, w in rows if k == g and v is not None and w)
        upto = 0
        for v, w in have:
            upto += w
            if upto * 2 >= sum(x for _, x in have):
                want[g] = v
                break
    df = spark.createDataFrame(rows, "g string, v double, w long")
    for buckets in (1, 4, 1024):
        assert {r["g"]: r["weighted_median"] for r in tables.weighted_median(df, "g", "v", "w", buckets).collect()} == want
    assert tables.weighted_median(df.where("false"), "g", "v", "w").count() == 0


def _land(spark, folder, name, rows, schema, age):
    """One Parquet file in ``folder``, ``age`` seconds old."""
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{name}.parquet"
    spark.createDataFrame(rows, schema).toPandas().to_parquet(path, coerce_timestamps="us")
    os.utime(path, (1_700_000_000 - age,) * 2)


def test_period_counts_drop_what_is_later_than_the_watermark(spark, tmp_path):
    day = lambda n: datetime(2024, 1, 1, 12) + timedelta(days=n)
    folder = str(tmp_path / "in")
    for k, days in enumerate([[0, 0, 1], [1, 9], [8, 9], [0, 9]]):  # the last file's day 0 is behind the watermark of the batch before
        _land(spark, folder, f"f{k}", [(day(n),) for n in days], "ts timestamp", 100 - k)
    out = jobs.drain(jobs.period_counts(jobs.stream_of(spark, f"{folder}/*.parquet", 1), "ts"), "update")
    assert out.select("__batch").distinct().count() > 2
    got = {r["start"].day - 1: r["n"] for r in out.groupBy("start").agg(F.max_by("n", "__batch").alias("n")).collect()}
    assert got == {0: 2, 1: 2, 8: 1, 9: 3}


def test_ingest_goes_on_after_a_restart_and_skips_what_is_known(spark, tmp_path):
    folder, store, schema = str(tmp_path / "in"), str(tmp_path / "store"), "doc long, turn long, digest string"

    def run():
        out = jobs.ingest_changed(jobs.stream_of(spark, f"{folder}/*.parquet", 1), store, "doc")
        return sorted((r["doc"], r["turn"], r["digest"]) for r in out.collect())

    _land(spark, folder, "a", [(1, 0, "x"), (1, 1, "y"), (2, 0, "z")], schema, 90)
    _land(spark, folder, "b", [(1, 0, "x"), (1, 1, "y"), (3, 0, "w")], schema, 80)  # 1 is known
    first = [(1, 0, "x"), (1, 1, "y"), (2, 0, "z"), (3, 0, "w")]
    assert run() == first and run() == first
    _land(spark, folder, "c", [(1, 0, "new"), (2, 0, "z")], schema, 70)  # 1 loses a row
    assert run() == [(1, 0, "new"), (2, 0, "z"), (3, 0, "w")]
    layers = RecordStore(spark, store, "doc").manifest()["layers"]
    written = [spark.read.parquet(f"{store}/tables/records/__layer={x['name']}").count() for x in layers]
    assert written == [3, 1, 1]


def test_lookups(spark):
    urls = ["https://data.portal.org/a", "http://Portal.org:80/x", "https://notportal.org", "https://u@deep.store.net/portal.org", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    kind = lookups.link_kind(F.col("u"), {"portal": ["portal.org"], "deposit": ["store.net"]})
    assert [r[0] for r in df.select(kind).collect()] == ["portal", "portal", "direct", "deposit", "direct"]
    texts = spark.createDataFrame([("Are you a ROBOT",), ("robot " * 1000,), ("",), (None,)], "t string")
    assert [r[0] for r in texts.select(lookups.page_kind(F.col("t"), {"check": ["robot"]})).collect()] == ["check", "document", "document", "document"]
    docs = spark.createDataFrame([(1, "red ring", "a ring"), (2, None, "ring"), (3, "blue", None)], "id long, a string, b string")
    use = spark.createDataFrame([(1, 9, 2)], "id long, clicks long, degree long")
    got = {r["id"]: round(r["score"], 9) for r in lookups.keyword_graph_rank(docs, "id", "a", "b", use, ["Red", "ring"]).collect()}
    assert got == {1: 5.3, 2: 1.0}
    hits = lookups.lookups(docs, {"x": F.col("a") == "blue", "y": F.col("id") == 2}, {"x": 1.5}).select("id", "score").collect()
    assert sorted(map(tuple, hits)) == [(2, 0.0), (3, 1.5)]


def test_ridge_chooses_alpha_by_leaving_each_row_out(spark):
    rng = np.random.default_rng(8)
    x, blocks, alphas = rng.normal(size=(60, 4)), np.arange(60) % 3, [0.1, 10.0, 1000.0]
    y = x @ [1, 0, 0.5, 0] + rng.normal(size=60) * 2

    def fit(xs, ys, alpha):
        design = np.c_[np.ones(len(xs)), xs]
        return np.linalg.solve(design.T @ design + alpha * np.diag([0, 1, 1, 1, 1]), design.T @ ys)

    rss = 0.0
    for f in range(3):
        tx, ty = x[blocks != f], y[blocks != f]
        press = [sum((ty[k] - np.r_[1, tx[k]] @ fit(np.delete(tx, k, 0), np.delete(ty, k), a)) ** 2 for k in range(len(tx))) for a in alphas]
        beta = fit(tx, ty, alphas[int(np.argmin(press))])
        rss += ((y[blocks == f] - np.c_[np.ones(20), x[blocks == f]] @ beta) ** 2).sum()
    df = spark.createDataFrame([(int(b), v.tolist(), float(t)) for b, v, t in zip(blocks, x, y, strict=True)], "block int, v array<double>, y double")
    got = learning.ridge_block_cv(df, "y", "v", "block", alphas).first()
    total = y.var() * 60
    assert got["n"] == 60 and got["blocks"] == 3
    assert got["r2"] == pytest.approx(1 - rss / total) and got["rmse"] == pytest.approx((rss / 60) ** 0.5)
    assert got["skill"] == pytest.approx(100 * (1 - (rss / total) ** 0.5)) and got["naive_r2"] < 1


def test_space_blocks_part_two_places(spark):
    df = spark.createDataFrame([(k, float(k % 2) * 10, 0.0) for k in range(20)] + [(99, None, 0.0)], "id long, x double, y double")
    got = learning.space_blocks(df, "x", "y", 2).collect()
    assert len(got) == 20 and len({(r["id"] % 2, r["block"]) for r in got}) == 2
