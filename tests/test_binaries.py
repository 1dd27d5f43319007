import glob
import io
import os
import struct
import subprocess
import zipfile

import pytest
from pyspark.sql import functions as F

from bytelode.functions import bytecode, names, opcodes, signatures
from bytelode.operators import dotnet, jvm
from bytelode.sources import binaries, classfile, encode, pe


def decoded(code, machine=bytecode.jvm_instructions):
    return [(r[0], r[2]) for r in machine(bytes(code))]


def test_opcode_tables_are_complete():
    table = opcodes.jvm_opcodes()
    assert len(table) == 202 and len({n for n, _ in table.values()}) == 202
    assert [table[i][0] for i in (0, 18, 87, 132, 147, 153, 172, 186, 196, 201)] == ["nop", "ldc", "pop", "iinc", "i2s", "ifeq", "ireturn", "invokedynamic", "wide", "jsr_w"]
    cil = opcodes.cil_opcodes()
    assert len({n for n, _ in cil.values()}) == len(cil) == 226
    assert [cil[i][0] for i in (0x28, 0x44, 0x6E, 0x8B, 0xA2, 0xBA, 0xE0, 0xFE1E)] == ["call", "blt.un", "conv.u8", "conv.ovf.u.un", "stelem.ref", "conv.ovf.u8", "conv.u", "readonly."]


def test_jvm_decoder():
    assert decoded([0x10, 0x2A, 0x3D, 0x1C, 0x1C, 0x68, 0xAC]) == [(0, "bipush"), (2, "istore_2"), (3, "iload_2"), (4, "iload_2"), (5, "imul"), (6, "ireturn")]
    rows = list(bytecode.jvm_instructions(bytes([0x1A, 0x9D, 0, 5, 0x03, 0xAC, 0x04, 0xAC])))
    assert [r[2] for r in rows] == ["iload_0", "ifgt", "iconst_0", "ireturn", "iconst_1", "ireturn"] and rows[1][6] == [6]
    wide = list(bytecode.jvm_instructions(b"\xc4\x84" + struct.pack(">Hh", 517, -300) + b"\xc4\x16" + struct.pack(">H", 700)))
    assert [(r[2], r[3], r[4], r[5], r[8]) for r in wide] == [("iinc", 6, 517, -300, True), ("lload", 4, 700, None, True)]
    table = b"\0\0\xaa\0" + struct.pack(">iii2i", 30, -1, 0, 16, 18)
    assert [r[6:8] for r in bytecode.jvm_instructions(table)][2] == ([18, 20, 32], [-1, 0])
    lookup = b"\xab\0\0\0" + struct.pack(">ii6i", 40, 3, -9, 28, 0, 30, 1000, 32)
    assert list(bytecode.jvm_instructions(lookup))[0][6:8] == ([28, 30, 32, 40], [-9, 0, 1000])
    assert decoded([0x2A, 0xB9, 0, 7, 1, 0, 0x57]) == [(0, "aload_0"), (1, "invokeinterface"), (6, "pop")]
    assert decoded([0, 0xCB, 0]) == [(0, "nop"), (1, "invalid")]
    assert decoded([0x11, 0]) == [(0, "invalid")]


def test_cil_decoder():
    m = bytecode.cil_instructions
    assert decoded([0x02, 0x17, 0x59, 0x0A, 0x06, 0x2A], m) == [(0, "ldarg.0"), (1, "ldc.i4.1"), (2, "sub"), (3, "stloc.0"), (4, "ldloc.0"), (5, "ret")]
    rows = list(m(bytes([0x02, 0x1F, 100, 0x32, 2, 0x16, 0x2A, 0x17, 0x2A])))
    assert [(r[2], r[3], r[6]) for r in rows][1:4] == [("ldc.i4.s", 2, []), ("blt.s", 2, [7]), ("ldc.i4.0", 1, [])]
    assert decoded([0x24, 0xFE, 0x08, 0x2A], m) == [(0, "unknown"), (1, "unknown"), (3, "ret")]
    assert list(m(b"\x45" + struct.pack("<I3i", 3, 4, -60, 0)))[0][6] == [21, 0, 17]
    assert decoded([0x20, 1], m) == [(0, "invalid")]
    assert [(r[2], r[5]) for r in m(b"\x21" + struct.pack("<q", 2**62 + 1) + b"\xf9\x23" + struct.pack("<d", 0.5))] == [("ldc.i8", 2**62 + 1), ("prefix6", None), ("ldc.r8", 0.5)]


def test_whole_numbers_keep_all_digits(spark):
    code = b"\x21" + struct.pack("<q", 2**62 + 1) + b"\x23" + struct.pack("<d", 0.5) + b"\x2a"
    rows = bytecode.instructions(spark.createDataFrame([(1, bytearray(code))], "id int, code binary"), ["id"], "cil").orderBy("pos").collect()
    assert [(r["name"], r.whole, r.value) for r in rows] == [("ldc.i8", 2**62 + 1, float(2**62)), ("ldc.r8", None, 0.5), ("ret", None, None)]


def test_signatures():
    text = lambda sig: [[p[0] if p[0] is not None else p[1:] for p in t if p[0] != ""] for t in sig]
    method = lambda h: text(signatures.parse_signature(bytes.fromhex(h), "method"))
    assert method("20030A0E1D0802") == [["long"], ["string"], ["int", "[]"], ["bool"]]
    assert method("05020E0D411C") == [["string"], ["double"], ["object"]]
    assert text(signatures.parse_signature(bytes.fromhex("0615110D010A"), "field")) == [[(1, 3), "<", "long", ">"]]
    assert signatures.parse_signature(b"\x06", "field") is None and signatures.parse_signature(None, "method") is None
    assert [pe.read_compressed(bytes.fromhex(h), 0) for h in ("1F", "9234", "C0012345")] == [(31, 1), (4660, 2), (74565, 4)]
    assert all(pe.read_compressed(pe.compressed(n), 0)[0] == n for n in (0, 127, 128, 16383, 16384, 1 << 28))


def test_descriptors(spark):
    df = spark.createDataFrame([("[[I",), ("(ID)V",), ("(J[Ljava/util/Map$Entry;Z)[B",), ("(X)V",), ("",)], "d string")
    rows = df.select(
        "d", names.type_text(F.col("d")).alias("t"), names.parameter_texts(F.col("d")).alias("p"), names.return_text(F.col("d")).alias("r"),
        names.valid_descriptor(F.col("d")).alias("ok"), names.parameter_slots(F.col("d")).alias("n"),
    ).collect()
    assert rows[0].t == "int[][]" and rows[1].p == ["int", "double"] and rows[1].r == "void" and rows[1].n == 3
    assert rows[2].p == ["long", "java.util.Map.Entry[]", "boolean"] and rows[2].r == "byte[]" and rows[2].n == 4
    assert [r.ok for r in rows] == [True, True, True, False, False]


def test_class_strings_and_damage(spark):
    assert classfile.modified_utf8(b"a\xc0\x80b") == "a\0b"
    name = "demo/A\0é😀"
    good = encode.class_bytes(name, [], [encode.Member("m", "()V", code=[b"\xb1"])])
    got = classfile.decode_class(good)
    assert name in {c["text"] for c in got["pool"]}
    rows = [(1, good, None), (2, good[:40], None), (3, b"nonsense", None), (4, None, "gone"), (5, b"", None)]
    out = {r.class_id: r.error for r in classfile.decode_classes(spark.createDataFrame(rows, "class_id long, bytes binary, error string")).collect()}
    assert out[1] is None and out[4] == "gone" and all(out[i] for i in (2, 3, 5))
    assert classfile.decode_classes(spark.createDataFrame([], "class_id long, bytes binary, error string")).count() == 0


def test_files_and_archives(spark, tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a/B.class", encode.class_bytes("a/B", [], []))
        z.writestr("a/C.CLASS", b"x")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "x.JAR").write_bytes(raw.getvalue())
    (tmp_path / "y.class").write_bytes(encode.class_bytes("Y$1", [], []))
    (tmp_path / "broken.jar").write_bytes(b"PK\3\4 nothing")
    (tmp_path / "z.txt").write_bytes(b"no")
    (tmp_path / "w.dll").write_bytes(b"MZ nothing")
    files = binaries.inputs(spark, f"file://{tmp_path}")
    assert sorted(r.kind for r in files.collect()) == ["class", "pe", "zip", "zip"]
    blobs = binaries.class_blobs(files)
    classes = classfile.decode_classes(blobs)
    named = jvm.class_names(classes)
    assert sorted(r.name for r in jvm.list_types(named).collect()) == ["Y.1", "a.B"]
    assert blobs.filter("error is not null").count() == 1
    md = pe.decode_images(files)
    assert [bool(r.error) for r in md.collect()] == [True]


def test_windows_over_instructions(spark):
    code = b"\x4b\x2a\xc3\x1e\x1e\x94\x9e\0\x05\xb1\x02\xac"  # astore_0 aload_0 monitorexit lload_0 lload_0 lcmp ifle +5
    rows = spark.createDataFrame([(1, 0, "method", bytearray(code))], "class_id long, ord int, kind string, code binary")
    instr = jvm.method_instructions(rows)
    assert [r.offset for r in jvm.synchronized_handlers(instr).collect()] == [0]
    assert [(r.name, r.test, r.target) for r in jvm.fused_comparisons(instr).collect()] == [("lcmp", "ifle", 11)]


def assembly():
    a = encode.Assembly()
    a.add(0, 0, "m", 1, 0, 0)
    a.add(35, 8, 0, 0, 0, 0, b"", "System.Runtime", "", b"")
    for n, ns in (("Object", "System"), ("MulticastDelegate", "System"), ("ObsoleteAttribute", "System"), ("IDisposable", "System")):
        a.add(1, (35, 1), n, ns)
    a.add(2, 0, "<Module>", "", 0, 1, 1)
    a.add(2, 1, "Box`1", "Shapes", (1, 1), 1, 1)
    a.add(2, 1, "Empty", "Shapes", (1, 1), 2, 3)
    a.add(2, 1, "Notify", "Shapes", (1, 2), 2, 3)
    a.add(4, 1, "Max", b"\x06\x08")
    a.add(6, a.body(b"\x2a"), 0, 6, "get_Size", b"\x20\x00\x08", 1)
    a.add(6, 0, 0, 6, "getpid", b"\x00\x00\x08", 1)
    a.add(6, a.body(b"\0" * 70 + b"\x2a"), 0, 6, "héllo\x01", b"\x20\x01\x01\x13\x00", 1)
    a.add(9, 2, (1, 4))
    a.add(10, (1, 3), ".ctor", b"\x20\x00\x01")
    a.add(11, 8, (4, 1), struct.pack("<i", 7))
    a.add(12, (2, 2), (10, 1), b"\1\0\0\0")
    a.add(21, 2, 1)
    a.add(23, 0, "Size", b"\x28\x00\x08")
    a.add(24, 2, 1, (23, 1))
    a.add(26, "libc")
    a.add(28, 0, (6, 2), "getpid", 1)
    a.add(42, 0, 0, (2, 2), "T")
    return a.bytes()


def test_assembly_relations(spark):
    files = spark.createDataFrame([("f", "pe", bytearray(assembly()))], "file_id string, kind string, content binary")
    md = pe.decode_images(files).cache()
    assert md.filter("error is not null").count() == 0
    assert [r.name for r in dotnet.list_types(md).orderBy("rid").collect()] == ["Shapes.Box`1", "Shapes.Empty", "Shapes.Notify"]
    assert {(r.name, r.kind) for r in dotnet.kinds(md).collect()} >= {("Shapes.Notify", "delegate"), ("Shapes.Empty", "class")}
    owners = {(r.rid, r.owner) for r in dotnet.owned(pe.view(md, 2), "MethodList", pe.view(md, 6)).collect()}
    assert owners == {(1, 2), (2, 2), (3, 4)}
    assert [(r.name, bytes(r.constant)) for r in dotnet.fields(md).collect()] == [("Max", b"\7\0\0\0")]
    assert {(r.name, r.return_type, tuple(r.params)) for r in dotnet.methods(md).collect()} == {("get_Size", "int", ()), ("getpid", "int", ()), ("héllo\x01", "void", ("!0",))}
    assert [(r.rid, r.import_name, r.library) for r in dotnet.pinvokes(md).collect()] == [(2, "getpid", "libc")]
    assert [(r.name, r.type_rid, r.getter, r.setter) for r in dotnet.properties(md).collect()] == [("Size", 2, 1, None)]
    assert [(r.Parent_rid, r.attribute) for r in dotnet.custom_attributes(md).collect()] == [(2, "System.ObsoleteAttribute")]
    assert [(r.rid, r.params) for r in dotnet.generic_params(md).collect()] == [(2, ["T"])]
    assert [(r.rid, r.interfaces) for r in dotnet.interfaces(md).collect()] == [(2, ["IDisposable"])]
    assert {r.namespace for r in dotnet.external_namespaces(md).collect()} == {"System", "System.Runtime.InteropServices"}
    assert [(r.severity, r.category) for r in dotnet.obfuscation(md).orderBy("ord").collect()] == [("high", "names"), ("info", "summary")]
    assert {r.rid for r in dotnet.method_instructions(md).collect()} == {1, 3}
    texts = spark.createDataFrame([("f", "class Box { int Max; void getpid() }")], "file_id string, source string")
    assert {r.name for r in dotnet.verify(md, texts).collect()} == {"Empty", "Notify", "héllo\x01"}
    assert [r.rid for r in dotnet.filter_types(md, "Empty", nested=False).collect()] == [3]


JARS = glob.glob(os.path.join(os.path.dirname(__import__("pyspark").__file__), "jars", "jta-*.jar"))


@pytest.mark.skipif(not JARS, reason="no real archive here")
def test_real_archive_against_javap(spark, tmp_path):
    files = binaries.classified(spark.read.format("binaryFile").load(f"file://{JARS[0]}").select(F.lit("j").alias("file_id"), "path", "content"))
    classes = classfile.decode_classes(binaries.class_blobs(files)).cache()
    resolved = jvm.resolved_constants(classes).cache()
    named = jvm.class_names(classes)
    with zipfile.ZipFile(JARS[0]) as z:
        want = {n[:-6].replace("/", ".").replace("$", ".") for n in z.namelist() if n.endswith(".class")}
    assert {r.name for r in jvm.list_types(named).collect()} == want
    instr = jvm.method_instructions(jvm.members(classes))
    assert instr.filter("name = 'invalid'").count() == 0
    try:
        one = sorted(want)[0]
        text = subprocess.run(["javap", "-c", "-p", "-cp", JARS[0], one], capture_output=True, text=True, timeout=60).stdout
    except (OSError, subprocess.TimeoutExpired):
        pytest.skip("no javap")
    n = sum(1 for line in text.splitlines() if line.strip()[:1].isdigit() and ": " in line)
    mine = instr.join(jvm.list_types(named).filter(F.col("name") == one), "class_id").count()
    assert mine == n
