"""Sinks: units of text as files, and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_units(units: DataFrame, path: str, keys: tuple[str, ...] = ("file_id", "file_name")) -> None:
    """One folder of text per unit below ``path``, written by the tasks; earlier output there is replaced."""
    units.select(*keys, F.col("source").alias("value")).write.mode("overwrite").partitionBy(*keys).option("lineSep", "\n").text(path)


def summary(files: DataFrame, errors: DataFrame) -> DataFrame:
    """Files by kind: n, and how many have an entry in ``errors`` (file_id, error)."""
    bad = errors.filter("error is not null").groupBy("file_id").agg(F.count("*").alias("n_errors"))
    return files.select("file_id", "kind").join(bad, "file_id", "left").groupBy("kind").agg(F.count("*").alias("n"), F.count("n_errors").alias("n_failed"))
