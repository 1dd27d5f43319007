"""Session and table helpers shared by the non-LLM parts of the library."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "bytelode", cpus: int | None = None, **more: str) -> SparkSession:
    """A local session with the settings the tests and the bench use; ``more`` holds further settings."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(map=more)
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that one task makes files of.
TASK_ROWS = 20_000


def dealt(groups: DataFrame, rows: int) -> DataFrame:
    """``groups`` of ``rows`` table rows over as many tasks as these need. Groups are small when packed, so they would be left to a few tasks otherwise."""
    return groups.repartition(max(1, -(-rows // TASK_ROWS)))


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 8) -> Iterator[pa.RecordBatch]:
    """Slices of a few rows, each of which becomes a file, so that a task holds the objects of these alone."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def ship_package(spark: SparkSession) -> SparkSession:
    """Give the Python workers this package (once a context), for drivers that only have it on their own path."""
    sc = spark.sparkContext
    if getattr(sc, "_bytelode_shipped", False):
        return spark
    import shutil
    import tempfile
    from pathlib import Path

    root = Path(__file__).resolve().parent
    stage = Path(tempfile.mkdtemp(prefix="bytelode-ship-"))
    shutil.copytree(root, stage / "src" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(stage / root.name), "zip", stage / "src"))
    sc._bytelode_shipped = True
    return spark
