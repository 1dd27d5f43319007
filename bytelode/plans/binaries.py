"""The binary analyses on images made from the driver's tables.

No binaries are supplied, so rows of ``part`` become class files (one for each brand and 4096 keys) and rows of
``region``, ``nation``, ``supplier`` and ``customer`` become assemblies (one for each region and 4096 keys). The queries read only the
binaries; their SQL computes the same from the tables.
"""

from __future__ import annotations

import io
import struct
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelode.operators import dotnet, flow, jvm
from bytelode.rounds import kept
from bytelode.sources import binaries, classfile, encode, pe
from bytelode.session import dealt, sliced, table


def _class_of(brand: str, chunk: int, parts: list[tuple[int, int]]) -> bytes:
    name = "part/" + brand.replace("#", "_") + (f"${chunk}" if chunk else "")
    fields, methods = [], []
    for key, size in parts:
        number = size % 2 == 0
        fields.append(encode.Member(f"f{key}", "I" if number else "Ljava/lang/String;", 0x19 | (0x1000 if size % 10 == 0 else 0), size if number else None))
        own = (9, name, f"f{key}", "I" if number else "Ljava/lang/String;")
        if size % 3 == 0:
            code = [b"\x1b\x99\0\x07\x11" + struct.pack(">h", size) + b"\xac\x03\xac"]
            handlers = [(0, 8, 8, 0), (0, 4, 8, 0)] if number else []
            methods.append(encode.Member(f"m{key}", "(IJ)I", 1, None, code, 2, 4, handlers))
        elif size % 3 == 1:
            methods.append(encode.Member(f"m{key}", "([Ljava/lang/String;[[D)V", 0x49, None, [b"\xb2", own, b"\x57\xb1"], 1, 2))
        else:
            methods.append(encode.Member(f"m{key}", "()Ljava/util/List;", 0x11, None, [b"\x01\xb0"], 1, 1))
    return encode.class_bytes(name, fields, methods)


def part_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """class_id, bytes, error of class files made from ``part``."""
    p = table(spark, sf_dir, "part")
    groups = p.groupBy("p_brand", F.floor(F.col("p_partkey") / 4096).cast("int").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_size"))).alias("parts"))

    def build(batches):
        for b in sliced(batches):
            raw = [_class_of(g["p_brand"], g["chunk"], [(x["p_partkey"], x["p_size"]) for x in g["parts"]]) for g in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary())], ["p_brand", "chunk", "bytes"])

    made = dealt(groups, p.count()).mapInArrow(build, "p_brand string, chunk int, bytes binary")
    return made.select(F.xxhash64("p_brand", "chunk").alias("class_id"), "bytes", F.lit(None).cast("string").alias("error"), "p_brand", "chunk")


def _decoded(spark: SparkSession, sf_dir: str):
    classes = classfile.stored_classes(part_classes(spark, sf_dir))
    resolved = jvm.resolved_constants(classes)
    return classes, resolved, jvm.class_names(classes)


def _with_class(rows: DataFrame, named: DataFrame) -> DataFrame:
    return rows.join(jvm.list_types(named).withColumnRenamed("name", "class_name"), "class_id")


def jvm_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted names with numbers of fields and methods."""
    classes, _, named = _decoded(spark, sf_dir)
    n = lambda k: F.size(F.filter("members", lambda m: m["kind"] == k)).cast("long")
    return _with_class(classes.select("class_id", n("field").alias("n_fields"), n("method").alias("n_methods")), named).drop("class_id")


def jvm_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the classes whose simple or qualified name matches."""
    _, _, named = _decoded(spark, sf_dir)
    both = jvm.filter_types(named, "Brand_11").unionByName(jvm.filter_types(named, "part.Brand_12"))
    return both.select(jvm.N.dotted(F.col("this_name")).alias("name"), jvm.N.package_of(F.col("this_name")).alias("package"))


def jvm_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members with types and modifiers."""
    classes, resolved, named = _decoded(spark, sf_dir)
    rows = _with_class(jvm.members(classes), named)
    return rows.select("class_name", "kind", "name", "type", F.array_join("params", ",").alias("params"), "modifiers", "constant")


def jvm_source_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: members a source listing shows."""
    classes, resolved, named = _decoded(spark, sf_dir)
    rows = _with_class(jvm.source_members(jvm.members(classes)), named)
    return rows.groupBy("class_name", "kind").agg(F.count("*").alias("n"))


def jvm_opcode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions by name and class."""
    classes, resolved, named = _decoded(spark, sf_dir)
    instr = _with_class(jvm.method_instructions(jvm.members(classes)), named)
    return instr.groupBy("class_name", "name").agg(F.count("*").alias("n"))


def jvm_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What static reads refer to, through four pool entries."""
    classes, resolved, _ = _decoded(spark, sf_dir)
    instr = jvm.operand_text(resolved, jvm.method_instructions(jvm.members(classes)))
    return instr.filter("name = 'getstatic'").select("operand")


def jvm_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct branch targets by class."""
    classes, resolved, named = _decoded(spark, sf_dir)
    t = _with_class(jvm.branch_targets(jvm.method_instructions(jvm.members(classes))), named)
    return t.groupBy("class_name", "target").agg(F.count("*").alias("n"))


def jvm_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catch ranges without consecutive repeats, each with its end."""
    classes, resolved, _ = _decoded(spark, sf_dir)
    rows = jvm.members(classes)
    return jvm.handlers(rows).join(rows.select("class_id", "kind", "ord", "name").filter("kind = 'method'"), ["class_id", "ord"]).select("name", "start", "handler", "handler_stop")


def jvm_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disassembled methods."""
    classes, resolved, named = _decoded(spark, sf_dir)
    return jvm.disassemble(named, jvm.members(classes), resolved).select("name", "listing")


def jvm_constructs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source constructs that jumps stand for."""
    classes, resolved, _ = _decoded(spark, sf_dir)
    found = flow.constructs(kept(jvm.method_instructions(jvm.members(classes)), "instructions"), ["class_id", "ord"])
    return found.groupBy("kind", "start", "stop").agg(F.count("*").alias("n"))


def jvm_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basic blocks, counted by shape."""
    classes, resolved, _ = _decoded(spark, sf_dir)
    found = flow.blocks(jvm.method_instructions(jvm.members(classes)), ["class_id", "ord"])
    return found.groupBy("start", "stop", "n", "last").agg(F.count("*").alias("n_blocks"))


def jvm_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 without bodies, K6: declarations of classes with their members."""
    classes, resolved, named = _decoded(spark, sf_dir)
    return jvm.declarations(named, jvm.members(classes)).select("file_name", "source")


def jar_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of archives, with a damaged one and a folder in each."""
    classes = part_classes(spark, sf_dir)
    jars = classes.groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("chunk", "bytes"))).alias("cs"))

    def build(batches):
        for b in sliced(batches):
            out = []
            for brand, cs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = io.BytesIO()
                with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("part/", b"")
                    for c in cs:
                        z.writestr(f"part/{brand}_{c['chunk']}.class", c["bytes"])
                    z.writestr("damaged.class", b"damaged entry", zipfile.ZIP_STORED)
                    z.writestr("notes.txt", b"notes")
                out.append(raw.getvalue().replace(b"damaged entry", b"dAmaged entry"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["file_id", "content"])

    files = binaries.classified(dealt(jars, table(spark, sf_dir, "part").count()).mapInArrow(build, "file_id string, content binary"))
    got = binaries.archive_entries(files, ".class")
    return got.select("file_id", "name", F.col("error").isNull().alias("ok"), F.hex(F.substring("bytes", 1, 4)).alias("magic"))


def _image_of(region: str, nations: list[dict]) -> bytes:
    a = encode.Assembly()
    a.add(0, 0, "image", 1, 0, 0)
    a.add(35, 8, 0, 0, 0, 0, b"", "System.Runtime", "", b"")
    base = a.add(1, (35, 1), "Object", "System"), a.add(1, (35, 1), "Enum", "System")
    a.add(2, 0, "<Module>", "", 0, 1, 1)
    rid = {n["key"]: 2 + i for i, n in enumerate(nations)}
    n_fields = n_methods = 0
    for i, n in enumerate(nations):
        key, nested = n["key"], n["key"] % 5 == 4 and i > 0
        flags = 0x1 | (0x180 if key % 7 == 0 else 0) | (0x20 if key % 11 == 3 else 0)
        a.add(2, flags, n["name"].replace(" ", "_"), "" if nested else region.replace(" ", "_"), (1, base[key % 6 == 0]), n_fields + 1, n_methods + 1)
        if nested:
            a.add(41, rid[key], 2)
        for s in n["suppliers"]:
            own = bytes([0x12]) + pe.compressed(rid[key] << 2)
            a.add(4, 1, f"S{s}", b"\x06" + (b"\x1d\x08", b"\x0e", own)[s % 3])
        first = n_methods + 1
        for c in n["customers"]:
            k = c["k"]
            if k % 2 == 0:
                code = b"\x72" + struct.pack("<I", a.user_string(c["seg"])) + b"\x28" + struct.pack("<I", 0x06000000 | first) + b"\x2a"
                sig = b"\x20\x02\x01\x08\x1d\x0e"
            else:
                code = b"\x16" + (b"\x45" + struct.pack(f"<I{k % 60}I", k % 60, *[0] * (k % 60)) if k % 50 == 1 else b"") + b"\x2a"
                sig = b"\x00\x00\x08"
            a.add(6, a.body(code), 0, 0x6, f"M{k}", sig, 1)
        n_fields += len(n["suppliers"])
        n_methods += len(n["customers"])
    return a.bytes()


def region_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id (the region and a span of keys), kind, content. A file holds the region's nations with the rows of 4096 keys."""
    r, n, s, c = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier", "customer"))
    span = lambda key: F.floor(F.col(key) / 4096).cast("int").alias("chunk")
    sup = s.groupBy(F.col("s_nationkey").alias("n_nationkey"), span("s_suppkey")).agg(F.sort_array(F.collect_list("s_suppkey")).alias("suppliers"))
    cus = c.groupBy(F.col("c_nationkey").alias("n_nationkey"), span("c_custkey")).agg(F.sort_array(F.collect_list(F.struct(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg")))).alias("customers"))
    one = F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.coalesce("suppliers", F.array()).alias("suppliers"), F.coalesce("customers", F.array()).alias("customers"))
    held = n.join(sup.join(cus, ["n_nationkey", "chunk"], "full"), "n_nationkey")
    files = held.select("n_regionkey", "chunk").distinct().join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_regionkey", "chunk", F.concat_ws("#", "r_name", "chunk").alias("file_id"))
    rows = files.join(n, "n_regionkey").join(held.select("n_nationkey", "chunk", "suppliers", "customers"), ["n_nationkey", "chunk"], "left")
    nations = rows.groupBy("file_id").agg(F.sort_array(F.collect_list(one)).alias("nations"))

    def build(batches):
        for b in sliced(batches):
            raw = [_image_of(x.split("#")[0], ns) for x, ns in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["file_id", "content"])

    return binaries.classified(dealt(nations, s.count() + c.count()).mapInArrow(build, "file_id string, content binary"))


def _md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pe.stored_images(region_images(spark, sf_dir))


def pe_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type names, nested ones under their parent."""
    return dotnet.list_types(_md(spark, sf_dir)).select("file_id", "name")


def pe_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kinds of types from flags and base types."""
    return dotnet.kinds(_md(spark, sf_dir)).filter("name <> '<Module>'").select("file_id", "name", "kind", "is_static")


def pe_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with their types."""
    return dotnet.fields(_md(spark, sf_dir)).select("file_id", "name", "type")


def pe_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods with return and parameter types."""
    return dotnet.methods(_md(spark, sf_dir)).select("file_id", "name", "return_type", F.array_join("params", ", ").alias("params"))


def pe_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: the JSON model, read back to scalars."""
    schema = "types array<struct<name:string,namespace:string,fields:array<struct<name:string,type:string>>,methods:array<struct<name:string,returnType:string,params:array<string>>>>>"
    types = dotnet.json_model(_md(spark, sf_dir)).select("file_id", F.explode(F.from_json("model", schema)["types"]).alias("t"))
    return types.select(
        "file_id", F.col("t.name").alias("name"), F.col("t.namespace").alias("namespace"), F.size("t.fields").cast("long").alias("n_fields"), F.size("t.methods").cast("long").alias("n_methods"),
        F.get("t.methods", F.lit(0))["returnType"].alias("first_return"),
    )


def pe_obfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The obfuscation report."""
    return dotnet.obfuscation(_md(spark, sf_dir))


def pe_opcode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions by name."""
    return dotnet.method_instructions(_md(spark, sf_dir)).groupBy("file_id", "name").agg(F.count("*").alias("n"))


def pe_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disassembled methods."""
    return dotnet.disassemble(_md(spark, sf_dir)).select("file_id", "listing")


def pe_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 without bodies, F6, F7, K6: declarations of top-level types with their members."""
    return dotnet.declarations(_md(spark, sf_dir)).select("file_id", "file_name", "source")


def pe_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that a source text lacks; the text here is the field list."""
    md = _md(spark, sf_dir)
    texts = dotnet.fields(md).select("file_id", F.concat("type", F.lit(" "), "name", F.lit(";")).alias("source"))
    return dotnet.verify(md, texts, exact=True)


def pe_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External namespaces."""
    return dotnet.external_namespaces(_md(spark, sf_dir))
