"""Loops by dominance, on class files made from ``supplier``: a supplier is a method whose loops have a layout named by its key."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelode.operators import flow, jvm
from bytelode.session import dealt, sliced, table
from bytelode.sources import classfile, encode

KEYS = ["class_id", "ord"]

#: Code by key modulo 4.
LAYOUTS: list[list] = [
    # a loop in a loop, the inner one with two ways back
    [("iconst_0",), ("istore_1",), "outer", ("iload_1",), ("ifeq", "exit"), "inner", ("iload_2",), ("ifeq", "after"), ("iload_3",), ("ifne", "inner"), ("iinc", 2, -1), ("goto", "inner"), "after", ("iinc", 1, 1), ("goto", "outer"), "exit", ("return",)],
    # the test last: the loop's header stands behind its body
    [("goto", "test"), "body", ("iinc", 1, 1), "test", ("iload_1",), ("ifne", "body"), ("return",)],
    # a ring with two entries has no header
    [("iload_1",), ("ifeq", "b"), "a", ("iinc", 1, 1), "b", ("iinc", 2, 1), ("iload_2",), ("ifne", "a"), ("return",)],
    # a block that is its own loop, and code that nothing reaches
    ["self", ("iload_1",), ("ifne", "self"), ("return",), "dead", ("goto", "dead")],
]


def supplier_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """class_id, bytes, error; a class holds the suppliers of 512 keys."""
    rows = table(spark, sf_dir, "supplier").withColumn("chunk", F.floor(F.col("s_suppkey") / 512).cast("int"))
    groups = rows.groupBy("chunk").agg(F.sort_array(F.collect_list("s_suppkey")).alias("keys"))

    def build(batches):
        for b in sliced(batches):
            raw = []
            for x in b.to_pylist():
                methods = [encode.Member(f"loop{k}", "(I)V", 1, code=encode.assemble(LAYOUTS[k % len(LAYOUTS)], "jvm")[0]) for k in x["keys"]]
                raw.append(encode.class_bytes(f"loops/C{x['chunk']}", [], methods))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["chunk", "bytes"])

    made = dealt(groups, rows.count()).mapInArrow(build, "chunk int, bytes binary")
    return made.select(F.xxhash64("chunk").alias("class_id"), "bytes", F.lit(None).cast("string").alias("error"))


def jvm_natural_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2 to W6, nested: loops by dominance, with those around them; -1 for none."""
    rows = jvm.members(classfile.stored_classes(supplier_classes(spark, sf_dir)))
    found = flow.natural_loops(jvm.method_instructions(rows), KEYS)
    return found.join(rows.filter("kind = 'method'").select(*KEYS, F.col("name").alias("method")), KEYS).drop(*KEYS).fillna(-1, ["parent"])
