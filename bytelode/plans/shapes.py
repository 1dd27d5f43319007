"""Handler regions, stack heights, statements, concatenations and chains of jumps, on code made from ``customer``.

Each nation's customers of 512 keys become one class file and one assembly: a customer is a method whose code has a shape named by its key. The queries read
only the binaries; their SQL computes the same from the table.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelode.operators import flow, frames, jvm, patterns, regions
from bytelode.rounds import kept
from bytelode.session import dealt, sliced, table
from bytelode.sources import binaries, classfile, encode, pe

KEYS, NET = ["class_id", "ord"], ["file_id", "rid"]

CONCAT = ("java/lang/invoke/StringConcatFactory", "makeConcatWithConstants", "(Ljava/lang/invoke/MethodHandles$Lookup;Ljava/lang/String;Ljava/lang/invoke/MethodType;Ljava/lang/String;[Ljava/lang/Object;)Ljava/lang/invoke/CallSite;")
PLAIN = ("java/lang/invoke/StringConcatFactory", "makeConcat", "(Ljava/lang/invoke/MethodHandles$Lookup;Ljava/lang/String;Ljava/lang/invoke/MethodType;)Ljava/lang/invoke/CallSite;")
_ITERATOR = lambda name, back: (11, "java/util/Iterator", name, f"(){back}")

#: Class-file code by key modulo 7, and its handlers as labels.
JVM_SHAPES: list[tuple[list, list]] = [
    # a try with a catch inside a try with a finally
    (["a", ("nop",), "b", ("iconst_0",), ("istore_1",), "c", ("goto", "d"), "h", ("astore_2",), "d", ("iinc", 1, 1), "e", ("return",), "f", ("astore_3",), ("aload_3",), ("athrow",)],
     [("b", "c", "h", "java/io/IOException"), ("a", "e", "f", 0)]),
    # a synchronized block: its handler covers itself
    ([("aload_0",), ("dup",), ("astore_1",), ("monitorenter",), "a", ("nop",), ("aload_1",), ("monitorexit",), "b", ("goto", "e"), "h", ("astore_2",), ("aload_1",), ("monitorexit",), "x", ("aload_2",), ("athrow",), "e", ("return",)],
     [("a", "b", "h", 0), ("h", "x", "h", 0)]),
    # a value chosen by a test: two blocks meet with a long on the stack
    ([("iload_1",), ("ifeq", "n"), ("lconst_0",), ("goto", "j"), "n", ("lconst_1",), "j", ("lstore_2",), ("return",)], []),
    # a loop over an iterator
    ([("aload_2",), ("invokeinterface", (11, "java/util/List", "iterator", "()Ljava/util/Iterator;"), 1, 0), ("astore", 4), "t", ("aload", 4), ("invokeinterface", _ITERATOR("hasNext", "Z"), 1, 0), ("ifeq", "x"),
      ("aload", 4), ("invokeinterface", _ITERATOR("next", "Ljava/lang/Object;"), 1, 0), ("checkcast", (7, "java/lang/String")), ("astore_3",), ("iinc", 1, 1), ("goto", "t"), "x", ("return",)], []),
    # a concatenation by a recipe
    ([("aload_2",), ("iload_1",), ("invokedynamic", (18, 0, "makeConcatWithConstants", "(Ljava/lang/Object;I)Ljava/lang/String;"), 0, 0), ("pop",), ("return",)], []),
    # gotos to gotos, and two that only go round
    ([("iload_1",), ("ifeq", "a"), ("goto", "b"), "a", ("goto", "b"), "b", ("goto", "c"), "c", ("goto", "d"), "d", ("return",), "r", ("goto", "s"), "s", ("goto", "r")], []),
    # a concatenation of values alone, and heights that differ where two blocks meet
    ([("aload_2",), ("iload_1",), ("invokedynamic", (18, 1, "makeConcat", "(Ljava/lang/Object;I)Ljava/lang/String;"), 0, 0), ("ifnull", "n"), ("iconst_1",), ("goto", "j"), "n", ("nop",), "j", ("return",)], []),
]


@cache
def _jvm_code(shape: int) -> tuple[list, list]:
    lines, handlers = JVM_SHAPES[shape]
    code, at = encode.assemble(lines, "jvm")
    return code, [(at[a], at[b], at[h], t) for a, b, h, t in handlers]


def _class_of(nation: str, chunk: int, keys: list[int]) -> bytes:
    methods = []
    for k in keys:
        code, handlers = _jvm_code(k % len(JVM_SHAPES))
        methods.append(encode.Member(f"run{k}", "(ILjava/util/List;)V", 1, code=code, stack=4, locals=5, handlers=handlers))
    recipe = f"{nation}=\1, \2:\1."
    return encode.class_bytes(f"shape/{nation.replace(' ', '_')}{chunk}", [], methods, bootstraps=((*CONCAT, (recipe, "a\"b")), (*PLAIN, ())))


#: Rows of type and member references of the assemblies.
NET_TYPES = (("Object", "System"), ("Monitor", "System.Threading"), ("IDisposable", "System"), ("IEnumerable", "System.Collections"), ("IEnumerator", "System.Collections"), ("Exception", "System"))
NET_MEMBERS = (
    (2, "Enter", b"\x00\x02\x01\x1c\x10\x02"), (2, "Exit", b"\x00\x01\x01\x1c"), (3, "Dispose", b"\x20\x00\x01"), (4, "GetEnumerator", b"\x20\x00\x1c"), (5, "MoveNext", b"\x20\x00\x02"), (5, "get_Current", b"\x20\x00\x1c"),
)
ENTER, EXIT, DISPOSE, GET, MOVE, CURRENT = (0x0A000000 + i for i in range(1, 7))
EXCEPTION = 0x01000006
_DISPOSES = ["h", ("ldloc.1",), ("brfalse", "z"), ("ldloc.1",), ("callvirt", DISPOSE), "z", ("endfinally",), "e", ("ret",)]

#: Assembly code by key modulo 6, and its clauses as labels: flags, try, stop, handler, stop, type or filter.
NET_SHAPES: list[tuple[list, list]] = [
    # a try with a catch and a filter inside a try with a finally
    (["a", ("nop",), "b", ("nop",), ("leave", "g"), "c", ("pop",), ("leave", "g"), "w", ("pop",), ("ldc.i4.1",), ("endfilter",), "d", ("pop",), ("leave", "g"), "g", ("leave", "e"), "f", ("nop",), ("endfinally",), "e", ("ret",)],
     [(0, "b", "c", "c", "w", EXCEPTION), (1, "b", "c", "d", "g", "w"), (2, "a", "f", "f", "e", 0)]),
    # a lock
    ([("ldarg.0",), ("stloc.s", 7), ("ldc.i4.0",), ("stloc.0",), "a", ("ldloc.s", 7), ("ldloca.s", 0), ("call", ENTER), ("nop",), ("leave", "e"), "h", ("ldloc.0",), ("brfalse", "z"), ("ldloc.s", 7), ("call", EXIT), "z", ("endfinally",), "e", ("ret",)],
     [(2, "a", "h", "h", "e", 0)]),
    # a using
    ([("ldarg.0",), ("stloc.1",), "a", ("nop",), ("leave", "e"), *_DISPOSES], [(2, "a", "h", "h", "e", 0)]),
    # a foreach
    ([("ldarg.0",), ("callvirt", GET), ("stloc.1",), "a", ("br", "t"), "b", ("ldloc.1",), ("callvirt", CURRENT), ("stloc.2",), ("nop",), "t", ("ldloc.1",), ("callvirt", MOVE), ("brtrue", "b"), ("leave", "e"), *_DISPOSES], [(2, "a", "h", "h", "e", 0)]),
    # a value chosen by a test under another one
    ([("ldc.i4.7",), ("ldarg.0",), ("brtrue", "n"), ("ldc.i4.1",), ("br", "j"), "n", ("ldc.i4.2",), "j", ("add",), ("pop",), ("ret",)], []),
    # a handler that disposes of another local than the one stored: no statement; heights differ where two blocks meet
    ([("ldarg.0",), ("stloc.0",), "a", ("nop",), ("leave", "e"), "h", ("ldloc.1",), ("brfalse", "z"), ("ldloc.1",), ("callvirt", DISPOSE), "z", ("endfinally",), "e", ("ldarg.0",), ("brtrue", "n"), ("ldc.i4.1",), ("br", "j"), "n", ("nop",), "j", ("ret",)], [(2, "a", "h", "h", "e", 0)]),
]


@cache
def _net_code(shape: int) -> tuple[bytes, tuple]:
    lines, clauses = NET_SHAPES[shape]
    parts, at = encode.assemble(lines, "cil")
    return b"".join(parts), tuple((f, at[t], at[u] - at[t], at[h], at[s] - at[h], at[x] if isinstance(x, str) else x) for f, t, u, h, s, x in clauses)


def _image_of(keys: list[int]) -> bytes:
    a = encode.Assembly()
    a.add(0, 0, "image", 1, 0, 0)
    a.add(35, 8, 0, 0, 0, 0, b"", "System.Runtime", "", b"")
    for name, space in NET_TYPES:
        a.add(1, (35, 1), name, space)
    for owner, name, signature in NET_MEMBERS:
        a.add(10, (1, owner), name, signature)
    a.add(2, 0, "<Module>", "", 0, 1, 1)
    a.add(2, 1, "Shapes", "Shape", (1, 1), 1, 1)
    for k in keys:
        code, handlers = _net_code(k % len(NET_SHAPES))
        a.add(6, a.body(code, 0, handlers), 0, 0x16, f"Run{k}", b"\x00\x01\x01\x1c", 1)
    return a.bytes()


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("chunk", F.floor(F.col("c_custkey") / 512).cast("int"))
    return dealt(rows.groupBy("n_name", "chunk").agg(F.sort_array(F.collect_list("c_custkey")).alias("keys")), c.count())


def customer_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """class_id, bytes, error."""

    def build(batches):
        for b in sliced(batches):
            raw = [_class_of(x["n_name"], x["chunk"], x["keys"]) for x in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary())], ["n_name", "chunk", "bytes"])

    made = _groups(spark, sf_dir).mapInArrow(build, "n_name string, chunk int, bytes binary")
    return made.select(F.xxhash64("n_name", "chunk").alias("class_id"), "bytes", F.lit(None).cast("string").alias("error"))


def customer_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id (the nation and a span of keys), kind, content."""

    def build(batches):
        for b in sliced(batches):
            raw = [_image_of(x["keys"]) for x in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["file_id", "content"])

    rows = _groups(spark, sf_dir).select(F.concat_ws("@", "n_name", "chunk").alias("file_id"), "keys")
    return binaries.classified(rows.mapInArrow(build, "file_id string, content binary"))


def _classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    classes = classfile.stored_classes(customer_classes(spark, sf_dir))
    rows = jvm.members(classes)
    return classes, rows, kept(jvm.method_instructions(rows), "instructions")


def _md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pe.stored_images(customer_images(spark, sf_dir))


def _shown(found: DataFrame) -> DataFrame:
    """``found`` with -1 for numbers that there are none of."""
    return found.fillna(-1, [c for c in ("parent_start", "height", "item") if c in found.columns])


def _jvm_named(found: DataFrame, rows: DataFrame) -> DataFrame:
    return _shown(found).join(rows.filter("kind = 'method'").select(*KEYS, F.col("name").alias("method")), KEYS).drop(*KEYS)


def _net_named(found: DataFrame, md: DataFrame) -> DataFrame:
    return _shown(found).join(pe.view(md, 6).select(*NET, F.col("Name").alias("method")), NET).drop(*NET)


def jvm_handler_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protected ranges and handlers as a forest; the compiler's own handlers and those that cover themselves are left out."""
    classes, rows, instr = _classes(spark, sf_dir)
    return _jvm_named(regions.regions(regions.jvm_clauses(rows, instr, jvm.resolved_constants(classes)), KEYS), rows)


def pe_handler_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protected ranges, handlers and filters as a forest."""
    md = _md(spark, sf_dir)
    return _net_named(regions.regions(regions.clr_clauses(md), NET), md)


def jvm_stack_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height of the stack where blocks begin, and what lies there where several meet; a handler begins with the exception."""
    classes, rows, instr = _classes(spark, sf_dir)
    entries = rows.filter("size(handlers) > 0").select(*KEYS, F.explode("handlers.handler").alias("offset")).distinct().select(*KEYS, F.col("offset").cast("int").alias("offset"), F.lit(1).alias("height"))
    found = frames.stack_heights(frames.jvm_changes(instr, jvm.resolved_constants(classes)), KEYS, entries)
    return _jvm_named(found.select(*KEYS, "start", "height", "n_before", "conflict", F.array_join("temps", ",").alias("temps")), rows)


def pe_stack_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X6 on the other machine, where only catches and filters begin with a value."""
    md = _md(spark, sf_dir)
    clauses = regions.clr_clauses(md)
    begins = clauses.select(*NET, F.col("start").alias("offset"), F.when(F.col("kind").isin("catch", "filter"), 1).otherwise(0).alias("height"))
    begins = begins.unionByName(clauses.filter("filter_start is not null").select(*NET, F.col("filter_start").alias("offset"), F.lit(1).alias("height"))).distinct()
    return _net_named(frames.stack_heights(frames.clr_changes(md), NET, begins).select(*NET, "start", "height", "n_before", "conflict", F.array_join("temps", ",").alias("temps")), md)


def jvm_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loops over iterators."""
    classes, rows, instr = _classes(spark, sf_dir)
    return _jvm_named(patterns.jvm_statements(instr, jvm.resolved_constants(classes)), rows)


def pe_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lock, using and foreach."""
    md = _md(spark, sf_dir)
    return _net_named(patterns.clr_statements(md), md)


def jvm_concatenations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String concatenations behind dynamic calls."""
    classes = classfile.stored_classes(customer_classes(spark, sf_dir))
    rows = jvm.members(classes)
    return _jvm_named(jvm.concatenations(classes, rows), rows)


def jvm_threaded_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where jumps end once gotos to gotos are skipped."""
    _, rows, instr = _classes(spark, sf_dir)
    return _jvm_named(flow.threaded_jumps(instr, KEYS), rows)


def jvm_dropped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that no jump ends at any more, and gotos to the next instruction."""
    _, rows, instr = _classes(spark, sf_dir)
    return _jvm_named(flow.dropped_labels(instr, KEYS), rows)
