"""Cutting lineage on storage every executor can reach."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local session (one machine) gets a temporary folder; on a cluster executors
    would not see each other's files, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    return tempfile.mkdtemp(prefix="cytoframe-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder for a table written and read back."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write the table to the shared folder and read it back.

    Later steps restart from stored rows, also after losing executors. Unlike an RDD
    checkpoint the stored table keeps column pruning, filter pushdown and a known size, so
    joins with a small one can still be broadcast by the optimizer.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
