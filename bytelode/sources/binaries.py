"""Binary inputs: files, archive entries and class blobs as DataFrames."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("dll", "exe", "class", "jar")


def inputs(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Files under ``path`` with one of ``extensions`` in any case: file_id, path, kind, length, content.

    ``kind`` comes from the first bytes, not the name: ``class``, ``zip``, ``pe`` or ``unknown``. Names filter before
    contents are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return classified(files.filter(_named(extensions)).select(F.sha2("path", 256).alias("file_id"), "path", "length", "content"))


def _named(extensions: tuple[str, ...]) -> Column:
    return F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*extensions)


def input_stream(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """The same rows for files that arrive in ``path``, as a stream; later stages are stateless and apply as they are."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path)
    return classified(files.filter(_named(extensions)).select(F.sha2("path", 256).alias("file_id"), "path", "length", "content"))


def classified(files: DataFrame) -> DataFrame:
    head = F.hex(F.substring("content", 1, 4))
    kind = F.when(head == "CAFEBABE", "class").when(head == "504B0304", "zip").when(head.startswith("4D5A"), "pe").otherwise("unknown")
    return files.withColumn("kind", kind)


ENTRY = "file_id string, entry_idx int, name string, bytes binary, error string"


def archive_entries(files: DataFrame, suffix: str = "") -> DataFrame:
    """One row per entry of every zip among ``files`` (file_id, kind, content), directories left out.

    Only entries whose name ends with ``suffix`` are inflated. An entry or archive that can't be read gives a row with
    ``error`` and without bytes, and the others go on. Entries leave the decoder one at a time.
    """
    names = ["file_id", "entry_idx", "name", "bytes", "error"]

    def one(file_id, i, name, data, error):
        return pa.RecordBatch.from_arrays(
            [pa.array([file_id], pa.string()), pa.array([i], pa.int32()), pa.array([name], pa.string()), pa.array([data], pa.binary()), pa.array([error], pa.string())], names
        )

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                file_id, content = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for i, info in enumerate(z.infolist()):
                            if info.is_dir() or not info.filename.endswith(suffix):
                                continue
                            try:
                                yield one(file_id, i, info.filename, z.read(info), None)
                            except Exception as e:  # a damaged entry must not stop the others
                                yield one(file_id, i, info.filename, None, str(e) or type(e).__name__)
                except zipfile.BadZipFile as e:
                    yield one(file_id, None, None, None, str(e))

    return files.filter("kind = 'zip'").select("file_id", "content").mapInArrow(run, ENTRY)


def class_blobs(files: DataFrame) -> DataFrame:
    """Class files, bare and in archives: class_id, file_id, entry_idx, name, bytes, error.

    Entries are dealt out by id, so an archive of very many classes spreads over all tasks.
    """
    bare = files.filter("kind = 'class'").select("file_id", F.lit(0).alias("entry_idx"), F.lit(None).cast("string").alias("name"), F.col("content").alias("bytes"), F.lit(None).cast("string").alias("error"))
    both = archive_entries(files, ".class").unionByName(bare)
    with_id = both.withColumn("class_id", F.xxhash64("file_id", "entry_idx"))
    return with_id.repartition("class_id").select("class_id", "file_id", "entry_idx", "name", "bytes", "error")
