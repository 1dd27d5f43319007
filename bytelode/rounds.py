"""Relations that are built in rounds: each round's rows are written to the shared folder, which cuts lineage and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master may leave it out and gets a temporary folder of this machine."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(sc, "_bytelode_rounds"):
        sc._bytelode_rounds = "file://" + tempfile.mkdtemp(prefix="bytelode-rounds-")
    return sc._bytelode_rounds


def kept(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """``df`` written once and read back; with ``by``, cut by a column of few values, so that a filter on it reads only its part."""
    path = f"{_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    # such tables pack to few bytes for many rows, so a choice by size would build tables of all of them on the driver to broadcast them
    out = df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns).hint("merge")
    out._bytelode_round = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete what ``kept`` wrote for these frames, once nothing that is still to run reads them."""
    for df in frames:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(df._bytelode_round)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
