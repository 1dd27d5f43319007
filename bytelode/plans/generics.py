"""Generic types, bases, enums and parameters of assemblies made from ``part``.

The parts of one brand of 512 keys become one assembly: a part is a class whose base, interfaces, fields and calls are instances of generic types, and by
its size an enum. The queries read only the binaries; their SQL computes the same from the table.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelode.operators import dotnet
from bytelode.session import dealt, sliced, table
from bytelode.sources import binaries, encode, pe

NAMES = (
    ("Object", "System"), ("Enum", "System"), ("IEnumerable`1", "System.Collections.Generic"), ("List`1", "System.Collections.Generic"),
    ("Dictionary`2", "System.Collections.Generic"), ("IComparable`1", "System"), ("ParamArrayAttribute", "System"), ("Component", "System.ComponentModel"),
)
OBJECT, ENUM, ENUMERABLE, LIST, DICTIONARY, COMPARABLE, OPEN, COMPONENT = range(1, len(NAMES) + 1)


def _type(table: int, rid: int) -> bytes:
    """A class by its coded index, as it stands in a signature."""
    return b"\x12" + pe.compressed(rid << 2 | pe.CODED["TypeDefOrRef"].index(table))


def _instance(rid: int, *arguments: bytes) -> bytes:
    return b"\x15" + _type(1, rid) + bytes([len(arguments)]) + b"".join(arguments)


INT, STRING, FIRST = b"\x08", b"\x0e", b"\x13\x00"


def _part_image(parts: list[dict]) -> bytes:
    a = encode.Assembly()
    a.add(0, 0, "image", 1, 0, 0)
    a.add(35, 8, 0, 0, 0, 0, b"", "System.Runtime", "", b"")
    for name, space in NAMES:
        a.add(1, (35, 1), name, space)
    # the third points to the fourth, which points to the second
    strings, ints, nested, lists, own = 1, 2, 3, 4, 5
    for blob in (_instance(ENUMERABLE, STRING), _instance(LIST, INT), _instance(DICTIONARY, STRING, _type(27, lists)), b"\x1d" + _type(27, ints), _instance(COMPARABLE, FIRST)):
        a.add(27, blob)
    a.add(10, (27, ints), "Add", b"\x20\x01\x01\x13\x00")
    a.add(10, (27, nested), "Clear", b"\x20\x00\x01")
    a.add(10, (1, OPEN), ".ctor", b"\x20\x00\x01")
    a.add(2, 0, "<Module>", "", 0, 1, 1)
    root = a.add(2, 0x81, "Root", "Parts", (1, OBJECT), 1, 1)
    fields = methods = params = 0

    def method(flags: int, name: str, signature: bytes, code: bytes | None, *rows: tuple) -> None:
        nonlocal methods, params
        methods = a.add(6, a.body(code) if code else 0, 0, flags, name, signature, params + 1)
        for i, (flag, n, text, many) in enumerate(rows, 1):
            params = a.add(8, flag, i, n)
            if text is not None:
                a.add(11, 0x0E, (8, params), text.encode("utf-16-le"))
            if many:
                a.add(12, (8, params), (10, 3), b"\1\0\0\0")

    for p in parts:
        k, size = p["k"], p["size"]
        generic = size % 3 == 0
        base = ((1, OBJECT), (2, root), (27, ints), (1, COMPONENT))[size % 4]
        rid = a.add(2, 1 | (0x80, 0x100, 0)[min(size % 5, 2)], f"Part{k}" + "`1" * generic, "Parts", base, fields + 1, methods + 1)
        fields = a.add(4, 6, "Item", b"\x06" + (FIRST if generic else STRING))
        fields = a.add(4, 6, "Map", b"\x06" + _type(27, nested))
        if size % 2 == 0:
            a.add(9, rid, (27, strings))
        if generic:
            a.add(9, rid, (27, own))
            a.add(42, 0, 0, (2, rid), f"T{k}")
        method(6, f"Fill{k}", b"\x20\x03\x01\x08\x10\x08\x10\x0e", b"\x14\x16\x6f" + struct.pack("<I", 0x0A000001) + b"\x14\x6f" + struct.pack("<I", 0x0A000002) + b"\x2a", (0, "count", None, 0), (0, "total", None, 0), (2, "note", None, 0))
        method(0x46 if size % 2 else 0x146, f"Say{k}", b"\x20\x02\x0e" + (FIRST if generic else INT) + b"\x1d\x0e", b"\x14\x2a", (0x1000 if not generic else 0, "first", None, 0), (0, "rest", None, 1))
        method(0x16, f"Tell{k}", b"\x00\x02\x01\x0e\x08", b"\x2a", (0x1010, "text", p["brand"], 0))
        if size % 7 == 0:
            a.add(2, 0x101, f"Kind{k}", "Parts", (1, ENUM), fields + 1, methods + 1)
            fields = a.add(4, 0x606, "value__", b"\x06" + (b"\x05" if size % 2 else b"\x06"))
            for i, name in enumerate(("None", "Some")):
                fields = a.add(4, 0x8056, name, b"\x06\x08")
                a.add(11, 0x05 if size % 2 else 0x06, (4, fields), struct.pack("<B" if size % 2 else "<h", i * size))
    return a.bytes()


def part_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id (the brand and a span of keys), kind, content."""
    rows = table(spark, sf_dir, "part").withColumn("file_id", F.concat_ws("@", "p_brand", F.floor(F.col("p_partkey") / 512).cast("int")))
    one = F.struct(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))
    groups = rows.groupBy("file_id").agg(F.sort_array(F.collect_list(one)).alias("parts"))

    def build(batches):
        for b in sliced(batches):
            raw = [_part_image(x["parts"]) for x in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["file_id", "content"])

    return binaries.classified(dealt(groups, rows.count()).mapInArrow(build, "file_id string, content binary"))


def _md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pe.stored_images(part_images(spark, sf_dir))


def pe_type_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of type specifications, of which some point to others."""
    return dotnet.spec_names(_md(spark, sf_dir)).select("file_id", F.col("rid").cast("long").alias("rid"), "name")


def pe_generic_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases and interfaces that are instances of generic types."""
    md = _md(spark, sf_dir)
    names = pe.view(md, 2).filter("Name like 'Part%'").select("file_id", "rid", F.col("Name").alias("type_name"))
    both = names.join(dotnet.base_types(md), ["file_id", "rid"], "left").join(dotnet.interfaces(md), ["file_id", "rid"], "left")
    return both.select("file_id", "type_name", "base", F.array_join("interfaces", ",").alias("interfaces"))


def pe_generic_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls on instances of generic types, by name."""
    md = _md(spark, sf_dir)
    calls = dotnet.method_instructions(md).filter("name = 'callvirt'").select("file_id", "rid", "ref", F.col("pos").cast("long").alias("pos"))
    names = pe.view(md, 6).select("file_id", "rid", F.col("Name").alias("caller"))
    return calls.join(dotnet.token_names(md), ["file_id", "ref"]).join(names, ["file_id", "rid"]).select("file_id", "caller", "pos", F.col("text").alias("callee"))


def pe_part_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 without bodies, R2: bases, abstract and sealed types, enum bases, virtual and overriding methods, parameters by name, direction and default."""
    return dotnet.declarations(_md(spark, sf_dir)).select("file_id", "file_name", "source")


def pe_il_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IL of types with their class heads, fields and methods."""
    return dotnet.il_units(_md(spark, sf_dir)).select("file_id", "file_name", "source")
