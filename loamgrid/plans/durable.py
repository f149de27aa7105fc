"""Cutting lineage in a way that survives the loss of an executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: what the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is empty and the master is local (tests) a fresh temporary folder is used; a cluster
    without the setting is an error, as no folder of the driver's own is seen by its executors.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.partition("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="loamgrid-checkpoint-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the checkpoint folder, so later reads need no lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def evenly(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` (one row a key) dealt anew by a hash of ``keys``, so that a join on them gets a plain exchange on this side.

    A grouped result joins where it was grouped, in one task a key; with an exchange of its own the skew join can
    split the rows that a hot key has on the other side.
    """
    return df.repartition(F.xxhash64(*keys, F.lit("even")))
