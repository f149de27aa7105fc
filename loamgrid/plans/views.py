"""The given tables as layers: plain column arithmetic that DuckDB repeats exactly (VIEWS)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same layers for the SQL side, as common table expressions.
VIEWS = {
    "event_points": "SELECT *, -88 + (user_id * 37 % 1000) / 1000.0::DOUBLE + 0.00037 AS lon, 41 + (event_id * 53 % 1000) / 1000.0::DOUBLE + 0.00053 AS lat FROM events",
    "area_boxes": "SELECT n_nationkey AS area_id, n_name AS area, n_regionkey AS region, -88 + (n_nationkey % 5) * 0.2::DOUBLE AS xmin, 41 + (n_nationkey // 5) * 0.2::DOUBLE AS ymin, -88 + (n_nationkey % 5) * 0.2::DOUBLE + 0.2::DOUBLE AS xmax, 41 + (n_nationkey // 5) * 0.2::DOUBLE + 0.2::DOUBLE AS ymax FROM nation",
    "site_points": "SELECT s_suppkey AS site_id, s_acctbal AS balance, -88 + (s_suppkey * 71 % 1000) / 1000.0::DOUBLE AS lon, 41 + (s_suppkey * 29 % 1000) / 1000.0::DOUBLE AS lat FROM supplier",
    "demand_points": "SELECT c_custkey AS demand_id, c_acctbal AS weight, -88 + (c_custkey * 13 % 1000) / 1000.0::DOUBLE + 0.00041 AS lon, 41 + (c_custkey * 87 % 1000) / 1000.0::DOUBLE + 0.00047 AS lat FROM customer",
    "pixels": "SELECT l_orderkey % 100 AS prow, l_partkey % 100 AS pcol, round(avg(l_quantity), 6) AS value, round(avg(CASE WHEN year(l_shipdate) < 1998 THEN l_quantity END), 6) AS before, round(avg(CASE WHEN year(l_shipdate) >= 1998 THEN l_quantity END), 6) AS after FROM lineitem GROUP BY 1, 2",
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sql_with(*names: str, body: str) -> str:
    """``body`` after the named layers."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + body


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumns(
        {"lon": F.lit(-88) + (F.col("user_id") * 37 % 1000) / F.lit(1000.0) + 0.00037, "lat": F.lit(41) + (F.col("event_id") * 53 % 1000) / F.lit(1000.0) + 0.00053}
    )


def area_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    xmin, ymin = F.lit(-88) + (k % 5) * 0.2, F.lit(41) + F.floor(k / 5) * 0.2
    return read(spark, sf_dir, "nation").select(
        k.alias("area_id"), F.col("n_name").alias("area"), F.col("n_regionkey").alias("region"),
        xmin.alias("xmin"), ymin.alias("ymin"), (xmin + 0.2).alias("xmax"), (ymin + 0.2).alias("ymax"),
    )


def area_diamonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diamonds between the middles of the edges of each box."""
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    xm, ym = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    ring = F.array(at(xm, F.col("ymin")), at(F.col("xmax"), ym), at(xm, F.col("ymax")), at(F.col("xmin"), ym))
    return area_boxes(spark, sf_dir).withColumn("ring", ring)


def area_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes as rings of four corners."""
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return area_boxes(spark, sf_dir).withColumn("ring", F.array(at("xmin", "ymin"), at("xmax", "ymin"), at("xmax", "ymax"), at("xmin", "ymax")))


def site_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        k.alias("site_id"), F.col("s_acctbal").alias("balance"), (F.lit(-88) + (k * 71 % 1000) / F.lit(1000.0)).alias("lon"), (F.lit(41) + (k * 29 % 1000) / F.lit(1000.0)).alias("lat")
    )


def demand_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        k.alias("demand_id"), F.col("c_acctbal").alias("weight"),
        (F.lit(-88) + (k * 13 % 1000) / F.lit(1000.0) + 0.00041).alias("lon"), (F.lit(41) + (k * 87 % 1000) / F.lit(1000.0) + 0.00047).alias("lat"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = F.year("l_shipdate") < 1998
    return (
        read(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 100).alias("prow"), (F.col("l_partkey") % 100).alias("pcol"))
        .agg(
            F.round(F.avg("l_quantity"), 6).alias("value"), F.round(F.avg(F.when(early, F.col("l_quantity"))), 6).alias("before"),
            F.round(F.avg(F.when(~early, F.col("l_quantity"))), 6).alias("after"),
        )
    )
