"""One call per question, over all files below a path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelode.operators import dotnet, jvm
from bytelode.rounds import kept
from bytelode.sources import binaries, classfile, pe

#: Questions that only assemblies can answer.
ASSEMBLY_ONLY = ("json", "detect-obfuscation", "verify")
MODES = ("list", "json", "detect-obfuscation", "verify", "il", "declarations")


def analyze(spark: SparkSession, path: str, mode: str, wanted: str | None = None) -> DataFrame:
    """Answer ``mode`` for every class, jar and assembly below ``path``.

    Columns: file_id, name, text. ``wanted`` keeps the types of that simple or qualified name. A question that only
    assemblies can answer is an error if there are no assemblies; class files are then left out of the answer.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    files = binaries.inputs(spark, path)
    if mode in ASSEMBLY_ONLY and files.filter("kind = 'pe'").isEmpty():
        raise ValueError(f"{mode} needs .NET assemblies")
    md = pe.stored_images(files)
    if mode == "json":
        return dotnet.json_model(md).select("file_id", F.lit(None).cast("string").alias("name"), F.col("model").alias("text"))
    if mode == "detect-obfuscation":
        return dotnet.obfuscation(md).select("file_id", F.concat_ws("/", "severity", "category").alias("name"), F.col("message").alias("text"))
    if mode == "verify":
        return dotnet.verify(md, dotnet.declarations(md), exact=True).select("file_id", "name", F.col("category").alias("text"))
    blobs = kept(binaries.class_blobs(files), "blobs")  # archives are inflated once
    classes = classfile.stored_classes(blobs)
    resolved = jvm.resolved_constants(classes)
    named = jvm.class_names(classes)
    named = jvm.filter_types(named, wanted) if wanted else named
    of_class = blobs.select("class_id", "file_id").join(named, "class_id")
    types = dotnet.filter_types(md, wanted) if wanted else dotnet.list_types(md)
    if mode == "list":
        java = of_class.select("file_id", jvm.N.dotted(F.col("this_name")).alias("name"), F.lit(None).cast("string").alias("text"))
        return java.unionByName(types.select("file_id", "name", F.lit(None).cast("string").alias("text")))
    if mode == "il":
        java = jvm.disassemble(named, jvm.members(classes), resolved).join(of_class.select("class_id", "file_id"), "class_id").select("file_id", "name", F.col("listing").alias("text"))
        m = dotnet.methods(md).select("file_id", "rid", "name", F.col("owner")).join(types.select("file_id", F.col("rid").alias("owner")), ["file_id", "owner"])
        return java.unionByName(dotnet.disassemble(md).join(m, ["file_id", "rid"]).select("file_id", "name", F.col("listing").alias("text")))
    java = jvm.declarations(named, jvm.members(classes)).join(of_class.select("class_id", "file_id"), "class_id").select("file_id", F.col("file_name").alias("name"), F.col("source").alias("text"))
    net = dotnet.declarations(md).join(types.select("file_id", "rid"), ["file_id", "rid"]).select("file_id", F.col("file_name").alias("name"), F.col("source").alias("text"))
    return java.unionByName(net)
