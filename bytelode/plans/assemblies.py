"""The analyses of members and their relations, on assemblies made from ``supplier``.

Each nation's suppliers of 1024 keys become one assembly: a supplier is a type with a constant, a property, and by its key an event,
an interface, an attribute, type parameters, a native function and nested types. The queries read only the binaries; their
SQL computes the same from the tables.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelode.operators import dotnet
from bytelode.session import dealt, sliced, table
from bytelode.sources import binaries, encode, pe

OBJECT, DISPOSABLE, CLONEABLE, HANDLER, OBSOLETE, LIST, COMPONENT = 1, 2, 3, 4, 5, 6, 7


def _supplier_image(nation: str, keys: list[int]) -> bytes:
    a = encode.Assembly()
    a.add(0, 0, "image", 1, 0, 0)
    a.add(35, 8, 0, 0, 0, 0, b"", "System.Runtime", "", b"")
    for name in ("Object", "IDisposable", "ICloneable", "EventHandler", "ObsoleteAttribute"):
        a.add(1, (35, 1), name, "System")
    a.add(1, (35, 1), "List`1", "System.Collections.Generic")
    a.add(1, (35, 1), "Component", "System.ComponentModel")
    a.add(27, b"\x15\x12" + pe.compressed(LIST << 2 | 1) + b"\x01\x0e")
    a.add(10, (1, OBSOLETE), ".ctor", b"\x20\x01\x01\x0e")
    a.add(10, (1, DISPOSABLE), "Dispose", b"\x20\x00\x01")
    a.add(17, b"\x07\x02\x08\x0e")
    a.add(26, f"lib{nation}")
    a.add(2, 0, "<Module>", "", 0, 1, 1)
    fields = methods = properties = events = params = 0

    def method(flags: int, name: str, signature: bytes, body: int, *names: str) -> int:
        nonlocal methods, params
        methods = a.add(6, body, 0, flags, name, signature, params + 1)
        for i, n in enumerate(names, 1):
            params = a.add(8, 0, i, n)
        return methods

    for k in keys:
        flags = 1 | (0x80 if k % 10 == 2 else 0x100 if k % 10 == 3 else 0)
        base = (27, 1) if k % 11 == 0 else (1, COMPONENT if k % 11 == 1 else OBJECT)
        own = a.add(2, flags, f"S{k}" + ("`2" if k % 7 == 0 else ""), "Supply", base, fields + 1, methods + 1)
        fields = a.add(4, 0x8056, f"C{k}", b"\x06\x08")
        a.add(11, 8, (4, fields), struct.pack("<i", k))
        fields = a.add(4, 1, f"<P{k}>k__BackingField", b"\x06\x0e")
        getter = method(0x806, f"get_P{k}", b"\x20\x00\x0e", a.body(b"\x14\x2a"))
        properties = a.add(23, 0, f"P{k}", b"\x28\x00\x0e")
        a.add(21, own, properties)
        a.add(24, 2, getter, (23, properties))
        if k % 2 == 0:
            a.add(24, 1, method(0x806, f"set_P{k}", b"\x20\x01\x01\x0e", a.body(b"\x2a")), (23, properties))
        if k % 4 == 0:
            fields = a.add(4, 1, f"E{k}", b"\x06\x12" + pe.compressed(HANDLER << 2 | 1))
            events = a.add(20, 0, f"E{k}", (1, HANDLER))
            a.add(18, own, events)
            for role, bit in (("add", 8), ("remove", 16)):
                a.add(24, bit, method(0x806, f"{role}_E{k}", b"\x20\x01\x01\x12" + pe.compressed(HANDLER << 2 | 1), a.body(b"\x2a")), (20, events))
        method(0x16, f"Run{k}", b"\x00\x00\x01", a.body(b"\x14\x28" + struct.pack("<I", 0x06000000 | getter) + b"\x26\x2a", 1))
        if k % 6 == 0:
            a.add(28, 0, (6, method(0x2016, f"Native{k}", b"\x00\x01\x08\x08", 0, "count")), f"fn{k}", 1)
        if k % 3 == 0:
            a.add(9, own, (1, DISPOSABLE))
            a.add(25, own, (6, method(0x1E1, "System.IDisposable.Dispose", b"\x20\x00\x01", a.body(b"\x2a"))), (10, 2))
        if k % 9 == 0:
            a.add(9, own, (1, CLONEABLE))
        if k % 5 == 0:
            text = f"use \"{nation}\"".encode()
            a.add(12, (2, own), (10, 1), b"\1\0" + pe.compressed(len(text)) + text + b"\0\0")
        if k % 7 == 0:
            for i, p in enumerate("TU"):
                a.add(42, i, 0, (2, own), p)
        if k % 8 == 7:
            inner = a.add(2, 2, f"Inner{k}", "", (1, OBJECT), fields + 1, methods + 1)
            a.add(41, inner, own)
            deep = a.add(2, 3, f"Deep{k}", "", (1, OBJECT), fields + 1, methods + 1)
            a.add(41, deep, inner)
            method(0x6, f"Dive{k}", b"\x20\x00\x02", a.body(b"\x16\x2a"))
    return a.bytes()


def supplier_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id (the nation and a span of keys), kind, content."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    named = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("file_id", F.concat_ws("#", "n_name", F.floor(F.col("s_suppkey") / 1024).cast("int")))
    groups = named.groupBy("file_id").agg(F.min("n_name").alias("nation"), F.sort_array(F.collect_list("s_suppkey")).alias("keys"))

    def build(batches):
        for b in sliced(batches):
            raw = [_supplier_image(x["nation"], x["keys"]) for x in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["file_id", "content"])

    return binaries.classified(dealt(groups, s.count()).mapInArrow(build, "file_id string, content binary"))


def _md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pe.stored_images(supplier_images(spark, sf_dir))


def _types(md: DataFrame) -> DataFrame:
    return pe.view(md, 2).select("file_id", F.col("rid").alias("type_rid"), F.col("Name").alias("type_name"))


def _methods(md: DataFrame, name: str) -> DataFrame:
    return pe.view(md, 6).select("file_id", F.col("rid").alias(name), F.col("Name").alias(f"{name}_name"))


def pe_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties with their types and accessors."""
    md = _md(spark, sf_dir)
    rows = dotnet.properties(md).join(dotnet.property_types(md), ["file_id", "rid"]).join(_types(md), ["file_id", "type_rid"])
    named = rows.join(_methods(md, "getter"), ["file_id", "getter"], "left").join(_methods(md, "setter"), ["file_id", "setter"], "left")
    return named.select("file_id", "type_name", "name", "type", "getter_name", "setter_name")


def pe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their types and accessors."""
    md = _md(spark, sf_dir)
    named = dotnet.events(md).join(_types(md), ["file_id", "type_rid"]).join(_methods(md, "adder"), ["file_id", "adder"]).join(_methods(md, "remover"), ["file_id", "remover"])
    return named.select("file_id", "type_name", "name", "type", "adder_name", "remover_name")


def pe_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of types as source lines."""
    md = _md(spark, sf_dir)
    return dotnet.attribute_lines(md).filter("Parent_table = 2").withColumnRenamed("Parent_rid", "type_rid").join(_types(md), ["file_id", "type_rid"]).select("file_id", "type_name", "line")


def pe_interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interfaces of types, in order."""
    md = _md(spark, sf_dir)
    return dotnet.interfaces(md).withColumnRenamed("rid", "type_rid").join(_types(md), ["file_id", "type_rid"]).select("file_id", "type_name", F.array_join("interfaces", ",").alias("interfaces"))


def pe_type_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: type parameters by number."""
    md = _md(spark, sf_dir)
    return dotnet.generic_params(md).filter("table = 2").withColumnRenamed("rid", "type_rid").join(_types(md), ["file_id", "type_rid"]).select("file_id", "type_name", F.array_join("params", ",").alias("params"))


def pe_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native functions behind methods."""
    md = _md(spark, sf_dir)
    return dotnet.pinvokes(md).join(_methods(md, "rid"), ["file_id", "rid"]).select("file_id", F.col("rid_name").alias("name"), "import_name", "library")


def pe_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit implementations, with the type that has them."""
    md = _md(spark, sf_dir)
    owner = dotnet.owned(pe.view(md, 2), "MethodList", pe.view(md, 6)).withColumnRenamed("owner", "type_rid")
    return dotnet.explicit_implementations(md).join(owner, ["file_id", "rid"]).join(_types(md), ["file_id", "type_rid"]).select("file_id", "type_name", "interface", "name")


def pe_accessor_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that read or write a property."""
    md = _md(spark, sf_dir)
    calls = dotnet.method_instructions(md).filter("name in ('call', 'callvirt')").select("file_id", "rid", "ref")
    return calls.join(dotnet.accessors(md), ["file_id", "ref"]).join(_methods(md, "rid"), ["file_id", "rid"]).select("file_id", F.col("rid_name").alias("caller"), "property", "role")


def pe_locals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of local variables."""
    md = _md(spark, sf_dir)
    return dotnet.local_types(md).join(_methods(md, "rid"), ["file_id", "rid"]).select("file_id", F.col("rid_name").alias("name"), F.array_join("locals", ", ").alias("locals"))


def pe_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constants of fields as literals."""
    md = _md(spark, sf_dir)
    return dotnet.constants(md).filter("table = 4").join(pe.view(md, 4).select("file_id", "rid", F.col("Name").alias("name")), ["file_id", "rid"]).select("file_id", "name", "literal")


def pe_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types nested at any depth, with the outermost type."""
    md = _md(spark, sf_dir)
    below = dotnet.nested_paths(md).filter("size(rids) > 0").withColumnRenamed("rid", "type_rid")
    top = _types(md).select("file_id", F.col("type_rid").alias("top"), F.col("type_name").alias("top_name"))
    return below.join(_types(md), ["file_id", "type_rid"]).join(top, ["file_id", "top"]).select("file_id", "type_name", "top_name", F.size("rids").cast("long").alias("depth"))


def pe_source_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fields and methods a source listing shows."""
    md = _md(spark, sf_dir)
    return dotnet.source_fields(md).select("file_id", "name").unionByName(dotnet.source_methods(md).select("file_id", "name"))


def pe_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the top-level type a name filter finds, and the nested one that only a listing of all types finds."""
    md = _md(spark, sf_dir)
    one = lambda wanted, nested: dotnet.filter_types(md, wanted, nested).select("file_id", "name")
    return one("Supply.S1", False).unionByName(one("S2", False)).unionByName(one("Inner7", False)).unionByName(one("Inner15", True))


def pe_supplier_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 without bodies: declarations with attributes, constants, properties, events, native functions and nested types."""
    return dotnet.declarations(_md(spark, sf_dir)).select("file_id", "file_name", "source")


def pe_verify_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: numbers of names looked for, and of missing ones; the text here is the list of constants."""
    md = _md(spark, sf_dir)
    texts = dotnet.fields(md).filter("name like 'C%'").select("file_id", F.col("name").alias("source"))
    return dotnet.verify_summary(md, texts, exact=True)
