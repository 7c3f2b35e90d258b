"""Session-level helpers: table access and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Blanks that surround identifiers in the wild: ASCII white space, no-break and
# zero-width characters.
BLANKS = " \t\n\r\x0b\x0c ​‌‍⁠﻿　"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share.

    Where the setting is missing, a local session gets a temporary folder; a
    cluster session without it is an error, as no machine-local folder would do.
    """
    return f"{_checkpoint_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def _checkpoint_root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if root:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(root)
        return root.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return str(current.get()).rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="tallyforge-")
    sc.setCheckpointDir(root)
    return f"file://{root}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage; survives the loss of executors."""
    _checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Rows for costly work per row: a few small files are spread over all cores, many partitions stay as they are.

    For scans and checkpoints: of other plans, counting the partitions would run the shuffles.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def normal_id(c: Column | str) -> Column:
    """An identifier without outer blanks and case."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.btrim(c, F.lit(BLANKS)))


def hot_keys(df: DataFrame, keys: list[str], rows_per_task: int) -> DataFrame:
    """Key combinations with more than ``rows_per_task`` rows and their number of salts.

    The result has at most (rows of df / rows_per_task) rows, which bounds a broadcast of it.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__rows"))
        .filter(F.col("__rows") > rows_per_task)
        .select(*keys, F.ceil(F.col("__rows") / rows_per_task).cast("int").alias("__salts"))
    )
