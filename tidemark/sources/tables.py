"""Parquet tables of a scale directory, and where lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the directory ``sf_dir``; one Parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints.

    The cluster names it in ``spark.checkpoint.dir``, a folder that all executors share. Where that is unset, a temporary
    folder is taken if all tasks run on this machine (master ``local``); on a cluster it would not be shared, so that fails.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if named:
        if current.isEmpty():
            sc.setCheckpointDir(named)
        return named
    if current.isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
