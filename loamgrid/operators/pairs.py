"""Pairs of the rows of a key: lists of rows meet, and are paired out in tasks of even size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.plans.durable import evenly


def shares(spark: SparkSession) -> int:
    """In how many partitions rows are dealt: four a core, at most those of a shuffle."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def dealt(df: DataFrame, *keys: str | Column) -> DataFrame:
    """``df`` by ``keys`` in a fixed number of partitions, four a core, at most those of a shuffle. Rows that meet many others are few bytes, so these aren't merged into few tasks."""
    return df.repartition(shares(df.sparkSession), *keys)


def in_lists(rows: DataFrame, keys: list[str], value: str, out: str = "ids", most: int = 512) -> DataFrame:
    """(keys, out): rows of the same keys as one row with a list of their values, or as several rows where keys have over ``most``. Nulls are a key too."""
    rows = rows.select(value, *keys)
    many = evenly(rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > most), *keys).withColumnsRenamed({k: f"__{k}" for k in keys})
    told = rows.join(many, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), "left")
    part = F.pmod(F.xxhash64(value), F.ceil(F.coalesce("__n", F.lit(1)) / most)).alias("__part")
    return told.groupBy(*keys, part).agg(F.collect_list(value).alias(out)).drop("__part")


def paired(left: DataFrame, right: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, a, b): all pairs of a left and a right row of the same key. Lists of both meet and are dealt out, so a key with many rows on both sides is many tasks."""
    met = in_lists(left, [key], a, "__a").join(in_lists(right, [key], b, "__b"), key)
    return dealt(met, F.xxhash64(F.col("__a")[0], F.col("__b")[0])).select(key, F.explode("__a").alias(a), "__b").select(key, a, F.explode("__b").alias(b))
