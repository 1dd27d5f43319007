import struct

import pytest
from pyspark.sql import functions as F

from bytelode import api
from bytelode.functions import bytecode, generics, literals
from bytelode.operators import dotnet, flow, jvm, output
from bytelode.sources import encode, pe
from bytelode.streaming import inputs as streaming
from tests.test_binaries import assembly

KEYS = ["m"]


def instr(spark, *codes, machine="jvm"):
    return bytecode.instructions(spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(codes)], "m int, code binary"), KEYS, machine)


def found(df):
    return sorted((r.m, r.kind, r.start, r.stop, r.alt_stop) for r in df.collect())


def test_constructs(spark):
    codes = [
        b"\x1a\x9a\0\x07\x04\x3c\xa7\0\x05\x05\x3c\xb1",  # iload_0; ifne 8 (misses the goto's end), if
        b"\x1a\x99\0\x08\x04\x3c\xa7\0\x05\x05\x3c\xb1",  # if (x) 1 else 2: branch to 9, goto 11
        b"\x1a\x9e\0\x09\x84\0\xff\xa7\xff\xf9\xb1",  # while (x > 0) x--: branch to 10, goto 0
        b"\x84\0\xff\x1a\x9d\xff\xfc\xb1",  # do x--; while (x > 0)
        b"\xa7\0\0",  # for (;;)
        b"\x1a\xaa\0\0" + b"\0\0\0\x17\0\0\0\1\0\0\0\2\0\0\0\x17\0\0\0\x18" + b"\0\0\xb1",
    ]
    got = found(flow.constructs(instr(spark, *codes), KEYS))
    assert got == [
        (0, "if", 1, 8, None), (1, "if_else", 1, 9, 11), (2, "while", 1, 10, None), (3, "do_while", 0, 4, None), (4, "loop", 0, 0, None), (5, "switch", 1, 25, None),
    ]


def test_rotated_while(spark):
    code = bytes([0x2B, 2, 0, 0x26, 0x02, 0x2D, 0xFB, 0x2A])  # br.s 4; 2: nop pop; 4: ldarg.0 brtrue.s 2; ret
    got = found(flow.constructs(instr(spark, code, machine="cil"), KEYS))
    assert got == [(0, "while", 2, 5, None)]


def test_blocks_and_edges(spark):
    df = instr(spark, b"\x1a\x99\0\x08\x04\x3c\xa7\0\x05\x05\x3c\xb1")
    assert sorted((r.start, r.stop, r.n, r.last) for r in flow.blocks(df, KEYS).collect()) == [(0, 4, 2, "ifeq"), (4, 9, 3, "goto"), (9, 11, 2, "istore_1"), (11, 12, 1, "return")]
    assert sorted((r.source, r.target, r.kind) for r in flow.edges(df, KEYS).collect()) == [(0, 4, "fall"), (0, 9, "branch"), (4, 11, "goto"), (9, 11, "fall")]
    labels = spark.createDataFrame([(0, 9), (0, 4)], "m int, offset int")
    assert [r.offset for r in flow.unreferenced_labels(df, KEYS, labels).collect()] == [4]


def test_generic_signatures(spark):
    cases = {
        "TT;": ([], ["T"]),
        "Ljava/util/List<+Ljava/lang/Number;>;": ([], ["java.util.List<? extends java.lang.Number>"]),
        "Ljava/util/Map<TK;[I>.Entry<*>;": ([], ["java.util.Map<K, int[]>.Entry<?>"]),
        "<K:Ljava/lang/Object;V::Ljava/lang/Comparable<TV;>;>(TK;J)TV;": (["K", "V extends java.lang.Comparable<V>"], ["K", "long", "V"]),
        "<T:Ljava/lang/Object;>Ljava/lang/Object;Ljava/lang/Iterable<TT;>;": (["T"], ["java.lang.Object", "java.lang.Iterable<T>"]),
        "Lbroken": None, "": ([], []), None: None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "s string").select("s", generics.generic_signature(F.col("s")).alias("g")).collect()
    assert {r.s: (r.g.params, r.g.types) if r.g else None for r in rows} == cases


def test_events_and_explicit_implementations(spark):
    a = encode.Assembly()
    a.add(1, 0, "IReset", "Shapes")
    a.add(2, 0, "<Module>", "", 0, 1, 1)
    a.add(2, 1, "C", "", 0, 1, 1)
    a.add(4, 1, "Changed", b"\x06\x1c")
    a.add(4, 1, "<N>k__BackingField", b"\x06\x08")
    a.add(4, 1, "plain", b"\x06\x08")
    for n in ("add_Changed", "remove_Changed", "Shapes.IReset.Reset"):
        a.add(6, 0, 0, 6, n, b"\x20\x00\x01", 1)
    a.add(10, (1, 1), "Reset", b"\x20\x00\x01")
    a.add(18, 2, 1)
    a.add(20, 0, "Changed", (1, 1))
    a.add(24, 8, 1, (20, 1))
    a.add(24, 16, 2, (20, 1))
    a.add(25, 2, (6, 3), (10, 1))
    md = pe.decode_images(spark.createDataFrame([("f", "pe", bytearray(a.bytes()))], "file_id string, kind string, content binary")).cache()
    assert [(r.name, r.type, r.type_rid, r.adder, r.remover) for r in dotnet.events(md).collect()] == [("Changed", "IReset", 2, 1, 2)]
    assert [(r.rid, r.interface, r.name) for r in dotnet.explicit_implementations(md).collect()] == [(3, "IReset", "Reset")]
    assert [r.name for r in dotnet.source_fields(md).collect()] == ["plain"]
    assert [r.name for r in dotnet.source_methods(md).collect()] == ["Shapes.IReset.Reset"]


def test_literals():
    c = literals.constant
    assert [c(13, struct.pack("<d", 2.0)), c(8, struct.pack("<i", 999)), c(14, "bo\"ok".encode("utf-16-le")), c(2, b"\1"), c(3, b"'\0"), c(18, b"\0\0\0\0")] == ["2.0", "999", '"bo\\"ok"', "true", "'\\''", "null"]
    assert [c(12, struct.pack("<f", 0.1)), c(13, struct.pack("<d", float("nan"))), c(8, b"\1"), c(99, b""), c(None, b"")] == ["0.1f", "double.NaN", None, None, None]
    sig = bytes.fromhex("2004010E080A02")
    value = b"\1\0\2hi" + struct.pack("<iq?", -5, 1 << 40, True) + b"\0\0"
    assert literals.attribute_arguments(value, sig) == ['"hi"', "-5", str(1 << 40), "true"]
    assert literals.attribute_arguments(b"\1\0\xff\0\0", bytes.fromhex("2001010E")) == ["null"]
    assert literals.attribute_arguments(value[:5], sig) is None and literals.attribute_arguments(value, bytes.fromhex("2001011C")) is None


def test_attributes_locals_and_accessors(spark):
    a = encode.Assembly()
    a.add(1, 0, "ObsoleteAttribute", "System")
    a.add(2, 0, "<Module>", "", 0, 1, 1)
    a.add(2, 1, "C", "", 0, 1, 1)
    a.add(4, 1, "Max", b"\x06\x08")
    a.add(6, a.body(b"\x2a"), 0, 6, "get_Size", b"\x20\x00\x08", 1)
    a.add(10, (1, 1), ".ctor", bytes.fromhex("2001010E"))
    a.add(10, (2, 2), "get_Size", b"\x20\x00\x08")
    a.add(11, 8, (4, 1), struct.pack("<i", 7))
    a.add(12, (2, 2), (10, 1), b"\1\0\3old\0\0")
    a.add(17, b"\x07\x02\x08\x1d\x0e")
    a.add(21, 2, 1)
    a.add(23, 0, "Size", b"\x28\x00\x08")
    a.add(24, 2, 1, (23, 1))
    md = pe.decode_images(spark.createDataFrame([("f", "pe", bytearray(a.bytes()))], "file_id string, kind string, content binary"))
    md = md.withColumn("local_token", F.when(F.col("code").isNotNull(), F.lit(0x11000001)).cast("long")).cache()
    assert [(r.table, r.rid, r.literal) for r in dotnet.constants(md).collect()] == [(4, 1, "7")]
    assert [(r.Parent_table, r.Parent_rid, r.line) for r in dotnet.attribute_lines(md).collect()] == [(2, 2, '[Obsolete("old")]')]
    assert [(r.rid, r.locals) for r in dotnet.local_types(md).collect()] == [(1, ["int", "string[]"])]
    assert {(hex(r.ref), r.property, r.role) for r in dotnet.accessors(md).collect()} == {("0x6000001", "Size", "get"), ("0xa000002", "Size", "get")}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.class").write_bytes(encode.class_bytes("demo/A", [], [encode.Member("m", "()V", code=[b"\xb1"])]))
    return tmp_path


def test_api(spark, folder):
    path = f"file://{folder}/in"
    assert [r.name for r in api.analyze(spark, path, "list").collect()] == ["demo.A"]
    with pytest.raises(ValueError):
        api.analyze(spark, path, "json")
    with pytest.raises(ValueError):
        api.analyze(spark, path, "nothing")
    (folder / "in" / "b.dll").write_bytes(assembly())
    assert sorted(r.name for r in api.analyze(spark, path, "list").collect()) == ["Shapes.Box`1", "Shapes.Empty", "Shapes.Notify", "demo.A"]
    assert sorted(r.name for r in api.analyze(spark, path, "list", "Empty").collect()) == ["Shapes.Empty"]
    assert {r.name for r in api.analyze(spark, path, "il").collect()} == {"m", "get_Size", "héllo\x01"}
    units = {r.name: r.text for r in api.analyze(spark, path, "declarations").collect()}
    assert units["demo_A.java"] == "package demo;\n\npublic class A {\n    public void m();\n}\n"
    native = '[DllImport("libc", EntryPoint = "getpid")] public extern int getpid();'
    assert units["Shapes_Box_1.cs"] == f"namespace Shapes;\n\n[Obsolete]\npublic class Box<T> : IDisposable\n{{\n    private int Max = 7;\n    public int Size {{ get; }}\n    {native}\n}}\n"
    assert '"returnType":"int"' in api.analyze(spark, path, "json").first().text
    assert {r.name for r in api.analyze(spark, path, "verify").collect()} == {"héllo\x01"}
    assert [r.name for r in api.analyze(spark, path, "detect-obfuscation").collect()] == ["high/names", "info/summary"]


def test_units_and_summary(spark, tmp_path):
    units = spark.createDataFrame([("f", "a.java", "class A {\n}\n"), ("f", "b.java", "class B {}")], "file_id string, file_name string, source string")
    output.write_units(units, f"file://{tmp_path}/out")
    texts = {p.parent.name: p.read_text() for p in (tmp_path / "out").glob("*/*/*.txt")}
    assert texts["file_name=a.java"].strip() == "class A {\n}"
    files = spark.createDataFrame([("a", "pe"), ("b", "pe"), ("c", "zip")], "file_id string, kind string")
    errors = spark.createDataFrame([("b", "x"), ("b", "y"), ("c", None)], "file_id string, error string")
    assert {(r.kind, r.n, r.n_failed) for r in output.summary(files, errors).collect()} == {("pe", 2, 1), ("zip", 1, 0)}


def test_arriving_files(spark, folder):
    query = streaming.arriving_classes(spark, f"file://{folder}/in").select("class_id", "major", "error").writeStream.format("memory").queryName("arriving").option("checkpointLocation", f"file://{folder}/cp").start()
    try:
        query.processAllAvailable()
        (folder / "in" / "c.class").write_bytes(b"\xca\xfe\xba\xbe broken")
        query.processAllAvailable()
        rows = spark.table("arriving").collect()
    finally:
        query.stop()
    assert sorted((r.major, bool(r.error)) for r in rows if r.major) == [(61, False)] and len(rows) == 2
