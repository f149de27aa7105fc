"""Spatial statistics over a table of weights (i, j, w) and a table of values (key, x)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgrid.plans.durable import durable


def row_standardised(pairs: DataFrame) -> DataFrame:
    """(i, j, w) with the weights of each i summing to one."""
    w = Window.partitionBy("i")
    return pairs.select("i", "j", (F.lit(1.0) / F.count("*").over(w)).alias("w"))


def z_scores(values: DataFrame, key: str, x: str) -> DataFrame:
    """(key, x, z) with the population standard deviation; moments are one broadcast row."""
    moments = values.agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.count(x).alias("n"))
    return values.where(F.col(x).isNotNull()).crossJoin(F.broadcast(moments)).select(key, F.col(x).cast("double").alias("x"), ((F.col(x) - F.col("mean")) / F.col("sd")).alias("z"), "n")


def spatial_lag(values: DataFrame, weights: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, lag_<column>...): weighted sums over neighbours; areas without neighbours have lag 0."""
    right = values.select(F.col(key).alias("j"), *columns)
    lags = weights.join(right, "j").groupBy("i").agg(*[F.sum(F.col("w") * F.col(c)).alias(f"lag_{c}") for c in columns])
    out = values.join(lags, values[key] == lags["i"], "left").drop("i")
    return out.na.fill(0.0, [f"lag_{c}" for c in columns])


def global_statistics(values: DataFrame, weights: DataFrame, key: str, x: str) -> DataFrame:
    """One row: Moran's I and its expectation, Geary's C, and Getis' G where no value is negative."""
    z = z_scores(values, key, x)
    a, b = z.select(F.col(key).alias("i"), F.col("z").alias("zi"), F.col("x").alias("xi")), z.select(F.col(key).alias("j"), F.col("z").alias("zj"), F.col("x").alias("xj"))
    pairs = weights.join(a, "i").join(b, "j")
    s = pairs.agg(F.sum("w").alias("s0"), F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("num"), F.sum(F.col("w") * (F.col("zi") - F.col("zj")) ** 2).alias("diff"), F.sum(F.col("w") * F.col("xi") * F.col("xj")).alias("g"))
    t = z.agg(F.count("*").alias("n"), F.sum(F.col("z") ** 2).alias("zz"), F.sum("x").alias("sx"), F.sum(F.col("x") ** 2).alias("sxx"), F.min("x").alias("least"))
    n = F.col("n")
    both = s.crossJoin(t)
    getis = F.when(F.col("least") >= 0, F.col("g") / (F.col("sx") ** 2 - F.col("sxx")))
    return both.select((n / F.col("s0") * F.col("num") / F.col("zz")).alias("moran_i"), (F.lit(-1.0) / (n - 1)).alias("expected_i"), ((n - 1) * F.col("diff") / (F.col("s0") * 2 * F.col("zz"))).alias("geary_c"), getis.alias("getis_g"))


def quadrant(z: Column, lag: Column) -> Column:
    return F.when((z >= 0) & (lag >= 0), "HH").when((z < 0) & (lag >= 0), "LH").when((z < 0) & (lag < 0), "LL").otherwise("HL")


def lisa(values: DataFrame, weights: DataFrame, key: str, x: str) -> DataFrame:
    """(key, local_i, quadrant); areas without neighbours are named islands."""
    z = z_scores(values, key, x)
    lagged = spatial_lag(z, weights, key, ["z"])
    degree = weights.groupBy(F.col("i").alias(key)).agg(F.count("*").alias("neighbours"))
    out = lagged.join(degree, key, "left")
    local = F.col("z") * F.col("lag_z")
    return out.select(key, local.alias("local_i"), F.when(F.col("neighbours").isNull(), "island").otherwise(quadrant(F.col("z"), F.col("lag_z"))).alias("quadrant"))


def numbered(values: DataFrame, key: str | list[str], name: str = "at") -> DataFrame:
    """``values`` with a number from 0 without gaps in the order of ``key``: a sort by ranges, and one count a partition on the driver."""
    placed = durable(values.orderBy(*([key] if isinstance(key, str) else key)).withColumn("__row", F.monotonically_increasing_id()))
    part = F.shiftright("__row", 33)
    before, total = {}, 0
    for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        before[r["p"]], total = total, total + r["n"]
    offsets = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    return placed.withColumn(name, (offsets[part] + F.col("__row").bitwiseAND(2**33 - 1)).cast("long")).drop("__row")


def draws(n: int, most: int, first: int, last: int, spark: SparkSession) -> DataFrame:
    """(rep, pos, at): for each replicate, ``most`` of the numbers below ``n`` without replacement, in the order drawn.

    Number s of replicate r is 32 bits of the MD5 of "r:s" modulo n; numbers drawn before are passed over. So many are
    tried that ``most`` distinct ones are missed with probability below 1e-13.
    """
    tries = 8 * most + 128 if n >= 2 * most else int(n * (math.log(max(n, 2)) + 32))
    one = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("rep").cast("string"), F.col("s").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % n
    each = spark.range(first, last).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("s")).select("rep", "s", one.alias("at"))
    drawn = each.groupBy("rep").agg(F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("s", "at"))), lambda x: x["at"])), 1, most).alias("drawn"))
    return drawn.select("rep", F.posexplode("drawn").alias("pos", "at"))


def conditional_p(z: DataFrame, weights: DataFrame, key: str, permutations: int = 999, cells: int = 2_000_000) -> DataFrame:
    """(key, p_sim): pseudo p of each local Moran's I, its own value held while its neighbours' are drawn from all others.

    Every replicate draws its areas once, one more than the largest number of neighbours; an area takes the
    first of them, and the last one in place of itself. Draws and their values are found by Spark and go to all tasks,
    at most ``cells`` numbers at a time, so a hub with very many neighbours means more passes, not more memory.
    An area's weights are one row. Equal sums are told apart from larger ones by 1e-9, so ties count as in exact arithmetic.
    """
    permutations = min(max(permutations, 99), 99_999)
    spark = z.sparkSession
    placed = durable(numbered(z.select(key, "z"), key))
    n = placed.count()
    ends = placed.select(F.col(key).alias("j"))
    own = weights.join(ends, "j", "left_semi").groupBy(F.col("i").alias(key)).agg(F.array_sort(F.collect_list("w"), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)).alias("ws"))
    seen = weights.join(placed.select(F.col(key).alias("j"), F.col("z").alias("zj")), "j").groupBy(F.col("i").alias(key)).agg(F.sum(F.col("w") * F.col("zj")).alias("lag"))
    rows = durable(placed.join(own, key).join(seen, key))
    most = rows.agg(F.max(F.size("ws"))).first()[0]
    if most is None:
        return z.select(key, F.lit(None).cast("double").alias("p_sim")).limit(0)
    most = min(most + 1, n)
    step = max(1, cells // most)
    out = None
    for first in range(0, permutations, step):
        last = min(permutations, first + step)
        got = draws(n, most, first, last, spark).join(placed.select("at", "z"), "at").select("rep", "pos", "at", "z").toPandas().sort_values(["rep", "pos"])
        at, value = (got[c].to_numpy().reshape(last - first, most) for c in ("at", "z"))

        def larger(batches: Iterator[pa.RecordBatch], at: np.ndarray = at, value: np.ndarray = value) -> Iterator[pa.RecordBatch]:
            for b in batches:
                counts = []
                for me, zi, lag, ws in zip(*(b.column(c).to_pylist() for c in ("at", "z", "lag", "ws")), strict=True):
                    k = min(len(ws), at.shape[1] - 1)
                    taken = np.where(at[:, :k] == me, value[:, k, None], value[:, :k])
                    counts.append(int((zi * (taken @ np.asarray(ws[:k])) >= zi * lag - 1e-9).sum()))
                yield pa.RecordBatch.from_arrays([b.column("at"), pa.array(counts, pa.int64())], ["at", "larger"])

        part = rows.select("at", "z", "lag", "ws").mapInArrow(larger, "at long, larger long")
        out = part if out is None else out.unionByName(part)
    total = out.groupBy("at").agg(F.sum("larger").alias("larger"))
    extreme = F.least(F.col("larger"), permutations - F.col("larger"))
    return total.join(placed, "at").select(key, ((extreme + 1) / (permutations + 1)).alias("p_sim"))


def lisa_classes(values: DataFrame, weights: DataFrame, key: str, x: str, permutations: int = 999, alpha: float = 0.05) -> DataFrame:
    """(key, local_i, quadrant, p_sim, class): the class is the quadrant where p_sim is below ``alpha``, else not significant; islands have no p."""
    local = lisa(values, weights, key, x)
    p = conditional_p(z_scores(values, key, x), weights, key, permutations)
    name = F.when(F.col("quadrant") == "island", "island").when(F.col("p_sim") < alpha, F.col("quadrant")).otherwise("not significant")
    return local.join(p, key, "left").withColumn("class", name)


def getis_star(values: DataFrame, pairs: DataFrame, key: str, x: str) -> DataFrame:
    """(key, z): the Gi* score in closed form with binary weights, the area itself included."""
    own = values.select(F.col(key).alias("i"), F.col(key).alias("j"))
    w = pairs.select("i", "j").unionByName(own)
    sums = w.join(values.select(F.col(key).alias("j"), F.col(x).cast("double").alias("x")), "j").groupBy("i").agg(F.sum("x").alias("wx"), F.count("*").cast("double").alias("w"))
    m = values.agg(F.count(x).cast("double").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"))
    spread = F.col("sd") * F.sqrt((F.col("n") * F.col("w") - F.col("w") ** 2) / (F.col("n") - 1))
    return sums.crossJoin(F.broadcast(m)).select(F.col("i").alias(key), ((F.col("wx") - F.col("mean") * F.col("w")) / spread).alias("z"))


def permutation_p(values: DataFrame, weights: DataFrame, key: str, x: str, permutations: int = 99) -> DataFrame:
    """One row: Moran's I and its pseudo p from shuffles of the values.

    A shuffle is the order of the MD5 of "replicate:key", matched with the order of keys, which all replicates share. All
    replicates are sorted together by ranges and numbered there, so no task holds a replicate or all areas.
    """
    permutations = min(max(permutations, 99), 99_999)
    z = durable(z_scores(values, key, x).select(key, "z"))
    n = z.count()
    reps = z.sparkSession.range(permutations).select(F.col("id").alias("rep"))
    each = z.crossJoin(F.broadcast(reps)).withColumn("__hash", F.md5(F.concat_ws(":", F.col("rep").cast("string"), F.col(key).cast("string")).cast("binary")))
    by_hash = numbered(each, ["rep", "__hash", key]).select("rep", (F.col("at") % max(n, 1)).alias("n"), "z")
    by_key = numbered(z, key, "n").select(key, "n")
    moved = by_hash.join(by_key, "n").select("rep", key, "z")
    a, b = moved.select("rep", F.col(key).alias("i"), F.col("z").alias("zi")), moved.select("rep", F.col(key).alias("j"), F.col("z").alias("zj"))
    draws = weights.join(a, "i").join(b, ["rep", "j"]).groupBy("rep").agg(F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("m"))
    seen = weights.join(z.select(F.col(key).alias("i"), F.col("z").alias("zi")), "i").join(z.select(F.col(key).alias("j"), F.col("z").alias("zj")), "j").agg(F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("seen"))
    larger = draws.crossJoin(F.broadcast(seen)).agg(F.count_if(F.col("m") >= F.col("seen") - 1e-9).alias("larger"), F.count("*").alias("draws"), F.first("seen").alias("seen"))
    extreme = F.least(F.col("larger"), F.col("draws") - F.col("larger"))
    return larger.select("seen", "draws", ((extreme + 1) / (F.col("draws") + 1)).alias("p_sim"))


def ols(df: DataFrame, y: str, xs: list[str]) -> dict:
    """Coefficients, R2, residual variance and count by normal equations: one aggregate of k x k sums, solved on the driver."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in xs]]
    made = [F.sum(a * b).alias(f"a{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]
    made += [F.sum(a * F.col(y)).alias(f"b{i}") for i, a in enumerate(cols)]
    r = df.dropna(subset=[y, *xs]).agg(*made, F.count("*").alias("n"), F.sum(F.col(y) * F.col(y)).alias("yy"), F.sum(y).alias("sy")).first()
    k = len(cols)
    a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    b = np.array([r[f"b{i}"] for i in range(k)], float)
    beta = np.linalg.solve(a, b)
    rss = r["yy"] - beta @ b
    tss = r["yy"] - r["sy"] ** 2 / r["n"]
    return {"beta": beta.tolist(), "r2": 1 - rss / tss, "sigma2": rss / r["n"], "n": r["n"], "xtx": a}


def residuals(df: DataFrame, y: str, xs: list[str], beta: list[float]) -> DataFrame:
    fitted = F.lit(beta[0])
    for c, b in zip(xs, beta[1:], strict=True):
        fitted = fitted + F.col(c) * b
    return df.withColumn("fitted", fitted).withColumn("residual", F.col(y) - F.col("fitted"))


def spatial_diagnostics(df: DataFrame, weights: DataFrame, key: str, y: str, xs: list[str]) -> DataFrame:
    """One row: R2, Jarque-Bera, LM error and LM lag with their robust forms, and the model they point to.

    The choice: OLS if neither LM is significant at 5 %; the one that is, if one is; of two, the one whose robust
    form is, or the larger robust form if both or neither are.
    """
    fit = ols(df, y, xs)
    res = residuals(df, y, xs, fit["beta"])
    lagged = spatial_lag(res.select(key, y, "fitted", "residual", *xs), weights, key, ["residual", y, "fitted"])
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in xs]]
    s = lagged.agg(
        F.sum(F.col("residual") * F.col("lag_residual")).alias("ewe"), F.sum(F.col("residual") * F.col(f"lag_{y}")).alias("ewy"), F.sum(F.col("residual") ** 2).alias("ee"), F.sum(F.col("residual") ** 3).alias("e3"),
        F.sum(F.col("residual") ** 4).alias("e4"), F.sum(F.col("lag_fitted") ** 2).alias("ff"), *[F.sum(c * F.col("lag_fitted")).alias(f"xf{i}") for i, c in enumerate(cols)],
    ).first()
    back = weights.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("w").alias("v"))
    t = weights.join(back, ["i", "j"], "left").agg(F.sum(F.col("w") ** 2).alias("ww"), F.sum(F.col("w") * F.coalesce("v", F.lit(0.0))).alias("wv")).first()
    n, s2, trace = fit["n"], fit["sigma2"], t["ww"] + t["wv"]
    xf = np.array([s[f"xf{i}"] for i in range(len(cols))])
    j = (s["ff"] - xf @ np.linalg.solve(fit["xtx"], xf)) / s2 + trace
    lm_error, lm_lag = (s["ewe"] / s2) ** 2 / trace, (s["ewy"] / s2) ** 2 / j
    skew, kurt = s["e3"] / n / s2**1.5, s["e4"] / n / s2**2
    de, dl = s["ewe"] / s2, s["ewy"] / s2
    robust_lag = (dl - de) ** 2 / (j - trace) if j > trace else 0.0
    robust_error = (de - trace / j * dl) ** 2 / (trace * (1 - trace / j)) if j > trace else 0.0
    verdict = chosen_model(lm_error, lm_lag, robust_error, robust_lag)
    row = (fit["r2"], n / 6 * (skew**2 + (kurt - 3) ** 2 / 4), lm_error, lm_lag, robust_error, robust_lag)
    names = ("r2", "jarque_bera", "lm_error", "lm_lag", "robust_lm_error", "robust_lm_lag")
    return df.sparkSession.createDataFrame([(*map(float, row), verdict)], ", ".join(f"{c} double" for c in names) + ", verdict string")


#: The 5 % point of chi-squared with one degree of freedom.
SIGNIFICANT = 3.841458820694124


def chosen_model(lm_error: float, lm_lag: float, robust_error: float, robust_lag: float) -> str:
    if max(lm_error, lm_lag) < SIGNIFICANT:
        return "ols"
    if min(lm_error, lm_lag) < SIGNIFICANT:
        return "lag" if lm_lag >= SIGNIFICANT else "error"
    if (robust_lag >= SIGNIFICANT) != (robust_error >= SIGNIFICANT):
        return "lag" if robust_lag >= SIGNIFICANT else "error"
    return "lag" if robust_lag >= robust_error else "error"


def residual_table(df: DataFrame, weights: DataFrame, key: str, y: str, xs: list[str]) -> DataFrame:
    """(key, y, fitted, residual, standardised, lag_residual): where a fit by least squares misses, and whether its neighbours do."""
    fit = ols(df, y, xs)
    res = residuals(df, y, xs, fit["beta"])
    made = res.select(key, F.col(y).cast("double").alias(y), "fitted", "residual", (F.col("residual") / math.sqrt(fit["sigma2"] or 1.0)).alias("standardised"))
    return spatial_lag(made, weights, key, ["residual"])
