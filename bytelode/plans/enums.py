"""Java enums made from ``part``: each brand of 512 keys is an enum whose constants are its parts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelode.operators import jvm
from bytelode.session import dealt, sliced, table
from bytelode.sources import classfile, encode


def _enum_of(name: str, keys: list[int]) -> bytes:
    own = f"brand/{name}"
    fields = [encode.Member(f"P{k}", f"L{own};", 0x4019) for k in keys]
    fields += [encode.Member("size", "I", 0x12), encode.Member("$VALUES", f"[L{own};", 0x101A)]
    body = [b"\x01\xb0"]
    methods = [
        encode.Member("values", f"()[L{own};", 9, code=body), encode.Member("valueOf", f"(Ljava/lang/String;)L{own};", 9, code=body), encode.Member("$values", f"()[L{own};", 0x100A, code=body),
        encode.Member("<init>", "(Ljava/lang/String;I)V", 2, code=[b"\xb1"]), encode.Member("label", "(I)Ljava/lang/String;", 1, code=body), encode.Member("values", "()I", 1, code=[b"\x03\xac"]),
    ]
    return encode.class_bytes(own, fields, methods, "java/lang/Enum", 0x4031)


def part_enums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """class_id, bytes, error."""
    rows = table(spark, sf_dir, "part").withColumn("name", F.concat_ws("_", F.translate("p_brand", "#", "_"), F.floor(F.col("p_partkey") / 512).cast("int")))
    groups = rows.groupBy("name").agg(F.sort_array(F.collect_list("p_partkey")).alias("keys"))

    def build(batches):
        for b in sliced(batches):
            raw = [_enum_of(x["name"], x["keys"]) for x in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["name", "bytes"])

    made = dealt(groups, rows.count()).mapInArrow(build, "name string, bytes binary")
    return made.select(F.xxhash64("name").alias("class_id"), "bytes", F.lit(None).cast("string").alias("error"))


def jvm_enum_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enums begin with their constants, and the compiler's own members are left out."""
    classes = classfile.stored_classes(part_enums(spark, sf_dir))
    return jvm.declarations(jvm.class_names(classes), jvm.members(classes)).select("file_name", "source")
