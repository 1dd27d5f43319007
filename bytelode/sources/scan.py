"""A source of types below a path, which takes filters on names before it decodes more than names.

    register(spark)
    spark.read.format("binary_types").load("/shared/binaries").filter("simple = 'Main'")

A row is a type: a class of a class file or an archive, or a type that an assembly defines. Without a filter every file's names are decoded, never more: of a class file
the part of the pool that leads to its name, of an assembly its rows of types. Filters ``=`` and ``in`` on ``name``, ``simple`` and ``kind`` are
taken over by the scan, so what doesn't match never leaves it, and what does comes with its bytes for the decoders.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
from dataclasses import dataclass

import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from bytelode.session import ship_package
from bytelode.sources import pe
from bytelode.sources.binaries import EXTENSIONS
from bytelode.sources.classfile import POOL

SCHEMA = "file_id string, path string, entry_idx int, kind string, name string, simple string, rid int, decoded long, content binary, error string"
#: Bytes of files that one task reads, unless one file is larger.
TASK_BYTES = 32 << 20
_SIZES = {tag: struct.calcsize(layout) for tag, layout in POOL.items()}


def class_name(data: bytes) -> tuple[str, int]:
    """The slashed name of a class file and the bytes walked to find it. No text but the name is decoded."""
    if data[:4] != b"\xca\xfe\xba\xbe":
        raise ValueError("not a class file")
    n, at, i, texts, classes = struct.unpack_from(">H", data, 8)[0], 10, 1, {}, {}
    while i < n:
        tag = data[at]
        if tag == 1:
            size = struct.unpack_from(">H", data, at + 1)[0]
            texts[i] = (at + 3, size)
            at += 3 + size
        else:
            if tag == 7:
                classes[i] = struct.unpack_from(">H", data, at + 1)[0]
            at += 1 + _SIZES[tag]
        i += 2 if tag in (5, 6) else 1
    start, size = texts[classes[struct.unpack_from(">H", data, at + 2)[0]]]
    return data[start : start + size].decode("utf-8", "replace"), at + 4


def type_rows(data: bytes) -> tuple[list[tuple[int, str, str]], int]:
    """(row number, namespace, name) of the types an assembly defines, and the bytes decoded: rows of other tables are stepped over."""
    image = pe.Image(data)
    s = image.heaps.get("#~", image.heaps.get("#-", b""))
    ids = [t for t in range(64) if struct.unpack_from("<Q", s, 8)[0] >> t & 1]
    counts = dict(zip(ids, struct.unpack_from(f"<{len(ids)}I", s, 24), strict=True))
    heaps = tuple(4 if s[6] & bit else 2 for bit in (1, 2, 4))
    at = 24 + 4 * len(ids)
    for t in (0, 1):
        at += counts.get(t, 0) * sum(pe.widths(t, counts, heaps))
    w, out, start = pe.widths(2, counts, heaps), [], at
    for rid in range(1, counts.get(2, 0) + 1):
        name, space = (int.from_bytes(s[at + sum(w[:i]) : at + sum(w[: i + 1])], "little") for i in (1, 2))
        out.append((rid, image.string(space), image.string(name)))
        at += sum(w)
    return out, at - start


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class TypesReader(DataSourceReader):
    def __init__(self, path: str, with_content: bool):
        self.path, self.with_content = path, with_content
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute in (("name",), ("simple",), ("kind",)):
                column = f.attribute[0]
                self.wanted[column] = self.wanted[column] & values if column in self.wanted else values
            else:
                yield f

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[InputPartition]:
        files, root = self._system()
        found = [i for i in files.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File and i.extension.lower() in EXTENSIONS]
        groups: list[list[str]] = []
        held = TASK_BYTES
        for i in sorted(found, key=lambda i: i.path):
            if held + i.size > TASK_BYTES:
                groups.append([])
                held = 0
            groups[-1].append(i.path)
            held += i.size
        return [Files(tuple(g)) for g in groups]

    def _matches(self, **row) -> bool:
        return all(row.get(c) in values for c, values in self.wanted.items())

    def read(self, partition: Files):
        files, _ = self._system()
        for path in partition.paths:
            shown = f"file:{path}" if isinstance(files, fs.LocalFileSystem) else path
            file_id = hashlib.sha256(shown.encode()).hexdigest()
            with files.open_input_file(path) as f:
                data = f.read()
            row = lambda entry, kind, name=None, simple=None, rid=None, n=None, raw=None, error=None, at=(file_id, shown): (*at, entry, kind, name, simple, rid, n, raw if self.with_content else None, error)
            kind = "class" if data[:4] == b"\xca\xfe\xba\xbe" else "zip" if data[:4] == b"PK\3\4" else "pe" if data[:2] == b"MZ" else "unknown"
            if "kind" in self.wanted and (kind if kind != "zip" else "class") not in self.wanted["kind"]:
                continue
            try:
                if kind == "class":
                    yield from self._class(row, 0, data)
                elif kind == "zip":
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        for i, info in enumerate(z.infolist()):
                            if info.filename.endswith(".class"):
                                yield from self._class(row, i, z.read(info))
                elif kind == "pe":
                    rows, n = type_rows(data)
                    first = True
                    for rid, space, name in rows:
                        whole = f"{space}.{name}" if space else name
                        if name != "<Module>" and self._matches(kind=kind, name=whole, simple=name):
                            # the first row of an assembly carries its bytes
                            yield row(None, kind, whole, name, rid, n, data if first else None)
                            first = False
            except Exception as e:  # any damage is the file's, not the scan's
                if self._matches(kind=kind):
                    yield row(None, kind, error=str(e) or type(e).__name__)

    def _class(self, row, entry: int, data: bytes):
        try:
            slashed, n = class_name(data)
        except (ValueError, KeyError, IndexError, struct.error) as e:
            if self._matches(kind="class"):
                yield row(entry, "class", error=str(e) or type(e).__name__)
            return
        name = slashed.replace("/", ".").replace("$", ".")
        simple = name.rsplit(".", 1)[-1]
        if self._matches(kind="class", name=name, simple=simple):
            yield row(entry, "class", name, simple, None, n, data)


class BinaryTypes(DataSource):
    """``path`` is the folder; with ``content`` ``false`` rows come without bytes."""

    @classmethod
    def name(cls) -> str:
        return "binary_types"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TypesReader(self.options["path"], self.options.get("content", "true") == "true")


def register(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    ship_package(spark).dataSource.register(BinaryTypes)
    return spark


def class_blobs(types: DataFrame) -> DataFrame:
    """The classes among ``types`` as ``classfile.decode_classes`` takes them: class_id, file_id, entry_idx, name, bytes, error."""
    rows = types.filter("kind = 'class'").withColumn("class_id", F.xxhash64("file_id", "entry_idx"))
    return rows.select("class_id", "file_id", "entry_idx", "name", F.col("content").alias("bytes"), "error")


def images(types: DataFrame) -> DataFrame:
    """The assemblies among ``types`` as ``pe.decode_images`` takes them: file_id, kind, content."""
    return types.filter("kind = 'pe' and content is not null").select("file_id", "kind", "content")
