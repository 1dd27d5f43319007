"""Files that arrive, decoded as they come. The decoders keep no state, so the batch stages apply unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelode.sources import binaries, classfile


def arriving_classes(spark: SparkSession, path: str) -> DataFrame:
    """Streaming rows of ``classfile.decode_classes`` for class files and archives that arrive below ``path``."""
    files = binaries.input_stream(spark, path)
    bare = files.filter("kind = 'class'").select(F.xxhash64("file_id", F.lit(0)).alias("class_id"), F.col("content").alias("bytes"), F.lit(None).cast("string").alias("error"))
    packed = binaries.archive_entries(files, ".class").select(F.xxhash64("file_id", "entry_idx").alias("class_id"), "bytes", "error")
    return classfile.decode_classes(bare.unionByName(packed))
