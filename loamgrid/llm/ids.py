"""Ids of any type that can be ordered, as numbers in the same order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.batches import INTEGRAL
from loamgrid.plans.durable import durable, evenly


def numbered(rows: DataFrame, id_col: str, name: str) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` with their id as the long column ``name``, and the table (id, name) if ids aren't whole numbers.

    Other ids are sorted over all partitions, where a row's number grows from partition to partition and inside
    each, so the smallest id of a group has its smallest number. Null ids have null numbers.
    """
    if isinstance(rows.schema[id_col].dataType, INTEGRAL):
        return rows.withColumn(name, F.col(id_col).cast("long")).drop(*({id_col} - {name})), None
    ids = rows.select(F.col(id_col).alias("__id")).where("__id is not null").distinct().orderBy("__id")
    table = durable(ids.withColumn(name, F.monotonically_increasing_id()))
    given = rows.withColumnRenamed(id_col, "__given")
    return given.join(evenly(table, "__id"), F.col("__given") == F.col("__id"), "left").drop("__id", "__given"), table


def named(out: DataFrame, table: DataFrame | None, columns: list[str], name: str) -> DataFrame:
    """``out`` with the numbers in ``columns`` turned back into ids; a plain table if ids were numbers already."""
    if table is None:
        return out
    order = out.columns
    for c in columns:
        back = evenly(table, name).select(F.col(name).alias("__number"), F.col("__id"))
        out = out.join(back, out[c] == F.col("__number"), "left").drop(c, "__number").withColumnRenamed("__id", c)
    return out.select(order)
