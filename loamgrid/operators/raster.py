"""Rasters as rows: (prow, pcol, value), NoData as null. Neighbours are joins or windows along a row or column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zonal_stats(pixels: DataFrame, zone: Column, value: str) -> DataFrame:
    """Per zone: all pixels, share with data, mean, least, largest, relief, population std, rounded to 4."""
    v = F.col(value)
    r = lambda c: F.round(c, 4)
    return pixels.groupBy(zone.alias("zone")).agg(
        F.count("*").alias("pixels"), r(F.count(v) / F.count("*")).alias("coverage"), r(F.avg(v)).alias("mean"), r(F.min(v)).alias("min"),
        r(F.max(v)).alias("max"), r(F.max(v) - F.min(v)).alias("relief"), r(F.stddev_pop(v)).alias("std"),
    )


def gradients(pixels: DataFrame, value: str, cell: float) -> DataFrame:
    """``pixels`` with dx (along columns) and dy (along rows): central differences, one-sided at edges and gaps."""

    def along(part: str, order: str) -> Column:
        w = Window.partitionBy(part).orderBy(order)
        near = lambda f: F.when(F.abs(f(order).over(w) - F.col(order)) == 1, f(value).over(w))
        before, after, here = near(F.lag), near(F.lead), F.col(value)
        return F.coalesce((after - before) / (2 * cell), (after - here) / cell, (here - before) / cell)

    return pixels.withColumn("dx", along("prow", "pcol")).withColumn("dy", along("pcol", "prow"))


def slope_degrees(dx: Column, dy: Column) -> Column:
    return F.degrees(F.atan(F.hypot(dx, dy)))


def aspect_degrees(dx: Column, dy: Column) -> Column:
    """Bearing of the way down (rows run south); null where flat."""
    return F.when((dx != 0) | (dy != 0), F.pmod(F.degrees(F.atan2(-dx, dy)) + 360, F.lit(360.0)))


def hillshade(dx: Column, dy: Column, azimuth: float = 315.0, altitude: float = 45.0) -> Column:
    """Shade 0 to 255 for a light at a bearing and height."""
    slope = F.atan(F.hypot(dx, dy))
    aspect = F.radians(F.coalesce(aspect_degrees(dx, dy), F.lit(0.0)))
    up, way = F.radians(F.lit(altitude)), F.radians(F.lit(azimuth))
    return F.greatest(F.lit(0.0), (F.sin(up) * F.cos(slope) + F.cos(up) * F.sin(slope) * F.cos(way - aspect)) * 255)


def inundation(pixels: DataFrame, value: str, level: float) -> DataFrame:
    """One row: cells at or below a level, their mean and largest depth, their share of the land. NoData never floods."""
    wet = F.col(value) <= level
    depth = F.when(wet, level - F.col(value))
    return pixels.agg(F.count_if(wet).alias("wet"), F.avg(depth).alias("mean_depth"), F.max(depth).alias("max_depth"), (F.count_if(wet) * 100 / F.count(value)).alias("percent"))


def change_index(pixels: DataFrame, before: str, after: str, loss: float) -> DataFrame:
    """One row: mean normalised change (after - before) / (after + before) and cells below ``-loss``; both dates must have data."""
    d = (F.col(after) - F.col(before)) / F.nullif(F.col(after) + F.col(before), F.lit(0.0))
    return pixels.agg(F.count(d).alias("cells"), F.avg(d).alias("mean_change"), F.count_if(d < -loss).alias("loss_cells"))


def pooled_by_zone(vectors: DataFrame, zone: str, vector: str) -> DataFrame:
    """(zone, n, pooled): the mean vector of each zone, over components that are numbers."""
    parts = vectors.select(zone, F.posexplode(vector).alias("k", "v")).where(~F.isnan("v"))
    mean = parts.groupBy(zone, "k").agg(F.avg("v").alias("m"))
    pooled = mean.groupBy(zone).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]).alias("pooled"))
    return vectors.groupBy(zone).agg(F.count("*").alias("n")).join(pooled, zone, "left")
