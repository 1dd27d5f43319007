"""A sink of one file a row, under the name the row gives.

    register(spark)
    rows.select("file_name", "source").write.format("units").mode("append").save("/shared/out")

A task writes below a folder of its own, and only the folders of tasks whose work counts are moved to their places when the job commits, so tasks that
were tried twice leave no twin, and a job that fails leaves no unit (a task that outlives it may leave a folder whose name begins with ``_``, which readers skip). Two rows of
one name in a task are an error, and of two tasks the last one moved stays: ``with_own_names`` tells names apart first.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from bytelode.session import ship_package

STAGING = "_staging"


def _files(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    n: int


class UnitsWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.job = f"{self.path}/{STAGING}-{uuid.uuid4().hex}"

    def write(self, rows) -> WriterCommitMessage:
        """Files of one task, below a folder that no other try of it has."""
        own = f"{self.job}/{uuid.uuid4().hex}"
        files, folder = _files(own)
        files.create_dir(folder, recursive=True)
        seen = set()
        for row in rows:
            name, source = row[0], row[1]
            if name is None or "/" in name or name in ("", ".", ".."):
                raise ValueError(f"not a file name: {name!r}")
            if name in seen:
                raise ValueError(f"two units are called {name}")
            seen.add(name)
            with files.open_output_stream(f"{folder}/{name}") as out:
                out.write((source or "").encode())
        return _Written(own, len(seen))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Move the files of the tries that count. Only names pass through here, one folder at a time."""
        files, target = _files(self.path)
        files.create_dir(target, recursive=True)
        if self.overwrite:
            for old in files.get_file_info(fs.FileSelector(target)):
                if old.type == fs.FileType.File:
                    files.delete_file(old.path)
        for m in messages:
            if m is not None and m.n:
                for info in files.get_file_info(fs.FileSelector(_files(m.folder)[1])):
                    files.move(info.path, f"{target}/{info.base_name}")
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, folder = _files(self.job)
        if files.get_file_info(folder).type == fs.FileType.Directory:
            files.delete_dir(folder)


class Units(DataSource):
    """``path`` is the folder; rows are (file_name, source)."""

    @classmethod
    def name(cls) -> str:
        return "units"

    def schema(self) -> str:
        return "file_name string, source string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if [f.name for f in schema.fields] != ["file_name", "source"]:
            raise ValueError("units have the columns file_name and source")
        return UnitsWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> SparkSession:
    ship_package(spark).dataSource.register(Units)
    return spark


def with_own_names(units: DataFrame) -> DataFrame:
    """``units`` (file_id, rid, file_name, source) -> file_name, source: of names that differ by case at most, later ones get a number before their ending.

    Files of one folder may share a name on some systems if they differ by case, so the second ``A.cs`` is ``a_2.cs``. Rows are numbered by file_id and
    rid, and by what they hold where these are null or equal.
    """
    same = W.partitionBy(F.lower("file_name")).orderBy("file_id", "rid", "source")
    n = F.row_number().over(same)
    numbered = F.concat(F.regexp_extract("file_name", r"^(.*?)(\.[^.]*)?$", 1), F.lit("_"), n.cast("string"), F.regexp_extract("file_name", r"^(.*?)(\.[^.]*)?$", 2))
    return units.filter("file_name is not null").select(F.when(n == 1, F.col("file_name")).otherwise(numbered).alias("file_name"), "source")
