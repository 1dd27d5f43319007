"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local master may run without the setting; it then gets a temporary folder of this machine.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(sc, "_bytelode_shared"):
        sc._bytelode_shared = "file://" + tempfile.mkdtemp(prefix="bytelode-shared-")
    return sc._bytelode_shared


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._bytelode_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these frames, once nothing that is still to run reads them."""
    for df in frames:
        remove(df.sparkSession, df._bytelode_path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is used where the text is ASCII, which is the cheap and equal case."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def crc_fold(c: Column) -> Column:
    """crc32 of the decimal text of an id, modulo 5: the hold-out rule of the learned operators."""
    return F.crc32(c.cast("string").cast("binary")) % 5


def batched(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, to bound the memory of what is built per step."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices that hold about ``limit`` bytes of one string or binary column (a longer single row stays whole)."""
    for b in batches:
        if not b.num_rows:
            continue
        arr = b.column(b.schema.get_field_index(column))
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(arr), 0), dtype=np.int64))
        start = 0
        while start < b.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield b.slice(start, stop - start)
            start = stop


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of equal ``keys`` from batches that are sorted by them, joined across batch borders."""
    held: list[pa.Table] = []
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        cols = [np.asarray(t.column(k)) for k in keys]
        change = np.zeros(t.num_rows, bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(change)
        for i, s in enumerate(at):
            e = at[i + 1] if i + 1 < len(at) else t.num_rows
            key = tuple(c[s].item() if hasattr(c[s], "item") else c[s] for c in cols)
            if last is not None and key != last:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held.append(t.slice(s, e - s))
            last = key
    if held:
        yield pa.concat_tables(held).combine_chunks()
