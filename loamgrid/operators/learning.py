"""Clusters, components and regressions over vectors, with Spark's own learners or small aggregated sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.operators.retrieval import unit_vector


def look_alike_groups(zones: DataFrame, key: str, vector: str, k: int, seed: int = 42) -> DataFrame:
    """(key, group) from 1 on by k-means++ on unit vectors; rows without a vector get no group. Group numbers go by least key."""
    have = zones.where(F.col(vector).isNotNull()).select(key, array_to_vector(unit_vector(F.col(vector))).alias("features"))
    k = min(k, have.select("features").distinct().count())
    if k < 2:
        return zones.select(key, F.when(F.col(vector).isNotNull(), 1).alias("group"))
    model = KMeans(k=k, seed=seed, maxIter=30).fit(have)
    assigned = model.transform(have).select(key, "prediction")
    order = assigned.groupBy("prediction").agg(F.min(key).alias("least"))
    from pyspark.sql import Window

    numbered = order.withColumn("group", F.row_number().over(Window.orderBy("least"))).select("prediction", "group")
    return zones.select(key).join(assigned.join(F.broadcast(numbered), "prediction").select(key, "group"), key, "left")


def shared_pca(vectors: DataFrame, key: str, vector: str, k: int = 3) -> DataFrame:
    """(key, colours): the first ``k`` components of one basis over all rows, scaled to 0..1 by the least and largest."""
    have = vectors.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
    scores = PCA(k=k, inputCol="features", outputCol="pc").fit(have).transform(have).select(key, vector_to_array("pc").alias("pc"))
    ends = scores.agg(*[f(F.col("pc")[i]).alias(f"{n}{i}") for i in range(k) for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = F.array(*[(F.col("pc")[i] - F.col(f"lo{i}")) / F.nullif(F.col(f"hi{i}") - F.col(f"lo{i}"), F.lit(0.0)) for i in range(k)])
    return scores.crossJoin(F.broadcast(ends)).select(key, scaled.alias("colours"))


def space_blocks(rows: DataFrame, x: str, y: str, k: int, seed: int = 42) -> DataFrame:
    """``rows`` with ``block``: k-means clusters of their coordinates; rows without coordinates are left out."""
    have = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("__xy", array_to_vector(F.array(F.col(x).cast("double"), F.col(y).cast("double"))))
    k = min(k, have.select(x, y).distinct().limit(k).count())
    if k < 2:
        return have.drop("__xy").withColumn("block", F.lit(0))
    return KMeans(k=k, seed=seed, maxIter=30, featuresCol="__xy", predictionCol="block").fit(have).transform(have).drop("__xy")


def _held_out_errors(data: DataFrame, alphas: list[float]) -> dict[int, float]:
    """Squared errors of each fold of (fold, y, x) under a ridge model of the other folds, its alpha chosen there by leaving one out.

    Three passes that each leave sums: normal equations of a fold, leave-one-out errors of a fold's model and
    alpha (by the hat matrix, no model a row), squared errors of a fold. The driver solves small systems.
    """

    def arrays(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.stack(b["x"].to_numpy())
        return b["fold"].to_numpy(), b["y"].to_numpy(), np.hstack([np.ones((len(x), 1)), x])

    def normal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                fold, y, x = arrays(b)
                each = [(f, np.concatenate([(x[fold == f].T @ x[fold == f]).ravel(), x[fold == f].T @ y[fold == f]])) for f in np.unique(fold)]
                yield pd.DataFrame({"fold": [f for f, _ in each], "s": [s for _, s in each]})

    def summed(parts: DataFrame) -> DataFrame:
        return parts.groupBy("fold", "k").agg(F.sum("v").alias("v"))

    flat = summed(data.mapInPandas(normal, "fold int, s array<double>").select("fold", F.posexplode("s").alias("k", "v")))
    per = {r["fold"]: np.array(r["s"]) for r in flat.groupBy("fold").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda r: r["v"]).alias("s")).collect()}
    if len(per) < 2:
        return {}
    whole, d = sum(per.values()), int((-1 + (1 + 4 * len(next(iter(per.values())))) ** 0.5) / 2)
    free = np.diag([0.0] + [1.0] * (d - 1))
    models = {}
    for f, s in per.items():
        rest = whole - s
        inverses = [np.linalg.pinv(rest[: d * d].reshape(d, d) + a * free, hermitian=True) for a in alphas]
        models[f] = [(m, m @ rest[d * d :]) for m in inverses]

    def left_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                fold, y, x = arrays(b)
                out = []
                for f, tried in models.items():
                    xs, ys = x[fold != f], y[fold != f]
                    for k, (inverse, beta) in enumerate(tried):
                        hat = np.einsum("ij,ij->i", xs @ inverse, xs)
                        out.append((f, k, float((((ys - xs @ beta) / np.maximum(1 - hat, 1e-12)) ** 2).sum())))
                yield pd.DataFrame(out, columns=["fold", "k", "v"])

    loo = summed(data.mapInPandas(left_out, "fold int, k int, v double")).collect()
    best = {f: min((r["v"], r["k"]) for r in loo if r["fold"] == f)[1] for f in models}
    chosen = {f: models[f][best[f]][1] for f in models}

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                fold, y, x = arrays(b)
                e = (y - np.einsum("ij,ij->i", x, np.stack([chosen[f] for f in fold]))) ** 2
                yield pd.DataFrame({"fold": fold, "k": 0, "v": e}).groupby(["fold", "k"], as_index=False).sum()

    return {r["fold"]: r["v"] for r in summed(data.mapInPandas(errors, "fold int, k int, v double")).collect()}


#: Penalties tried.
ALPHAS = [0.01, 0.1, 1.0, 10.0, 100.0, 1000.0]


def ridge_block_cv(rows: DataFrame, label: str, vector: str, block: str, alphas: list[float] = ALPHAS, least: int = 12) -> DataFrame:
    """One row: rows, blocks, r2 and rmse of ridge predictions for each block by a model fitted on the others, naive_r2, skill.

    naive_r2 comes from as many folds dealt by a hash of the row, so what it has over r2 is nearness and not
    knowledge; skill is the percentage by which rmse is under that of the mean. Under ``least`` rows, under
    two blocks or with a constant label everything but the counts is null. Rows with a null don't count.
    """
    x = F.transform(vector, lambda v: v.cast("double"))
    data = rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & F.col(block).isNotNull()).select(F.col(block).cast("int").alias("fold"), F.col(label).cast("double").alias("y"), x.alias("x"))
    m = data.agg(F.count("*").alias("n"), F.var_pop("y").alias("v"), F.count_distinct("fold").alias("blocks")).first()
    n, blocks, total = m["n"], m["blocks"], m["n"] * (m["v"] or 0.0)
    found = (None, None, None, None)
    if n >= least and total and blocks > 1:
        rss = sum(_held_out_errors(data, alphas).values())
        dealt = _held_out_errors(data.withColumn("fold", F.pmod(F.xxhash64("x", "y"), F.lit(blocks)).cast("int")), alphas)
        naive = 1 - sum(dealt.values()) / total if dealt else None
        found = (1 - rss / total, (rss / n) ** 0.5, naive, 100 * (1 - (rss / total) ** 0.5))
    return rows.sparkSession.createDataFrame([(n, blocks, *found)], "n long, blocks long, r2 double, rmse double, naive_r2 double, skill double")


def convex_hull(points: DataFrame, group: str, x: str, y: str, directions: int = 64) -> DataFrame:
    """(group, hull): corners counter-clockwise. Only points extreme in one of some directions, and what they leave
    outside, reach the task that closes the hull, so a group's size doesn't matter much."""
    import math

    import pandas as pd

    angles = [2 * math.pi * k / directions for k in range(directions)]
    far = [F.max_by(F.struct(x, y), F.col(x) * math.cos(a) + F.col(y) * math.sin(a)).alias(f"p{k}") for k, a in enumerate(angles)]
    ends = points.groupBy(group).agg(*far)
    inner = ends.select(group, F.array_distinct(F.array(*[F.col(f"p{k}") for k in range(directions)])).alias("ring"))
    nxt = F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1))
    inside = F.forall(F.zip_with("ring", nxt, lambda a, b: (b[x] - a[x]) * (F.col(y) - a[y]) - (b[y] - a[y]) * (F.col(x) - a[x])), lambda c: c > 0)
    left = points.select(group, x, y).join(inner, group).where(~inside).select(group, x, y).distinct()

    def close(g: pd.DataFrame) -> pd.DataFrame:
        pts = sorted(set(zip(g[x], g[y], strict=True)))
        cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

        def half(seq: list) -> list:
            out: list = []
            for p in seq:
                while len(out) > 1 and cross(out[-2], out[-1], p) <= 0:
                    out.pop()
                out.append(p)
            return out

        ring = pts if len(pts) < 3 else half(pts)[:-1] + half(pts[::-1])[:-1]
        return pd.DataFrame({group: [g[group].iloc[0]], "hull": [[{"x": float(a), "y": float(b)} for a, b in ring]]})

    kind = points.schema[group].dataType.simpleString()
    return left.groupBy(group).applyInPandas(close, f"`{group}` {kind}, hull array<struct<x:double,y:double>>")
