"""Heights of the operand stack where blocks begin, as a data-flow fixpoint over the edges of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bytelode.functions import names as N
from bytelode.functions.effects import change_table
from bytelode.functions.signatures import signature_parts
from bytelode.operators import dotnet
from bytelode.operators.flow import ENDS, GOTO, jumps
from bytelode.rounds import drop, kept

#: Jumps that empty the stack.
EMPTIES = r"^leave(\.s)?$"
#: Switches that don't go on behind themselves.
CLOSED = r"^(table|lookup)switch$"


def jvm_changes(instr: DataFrame, resolved: DataFrame) -> DataFrame:
    """``instr`` (of class files) with ``delta``, the change of height in slots; calls and fields follow their descriptors."""
    fixed = F.broadcast(change_table(instr.sparkSession, "jvm"))  # the opcodes
    pool = resolved.filter("descriptor is not null").select("class_id", F.col("idx").alias("ref"), "descriptor")
    joined = instr.join(fixed, "name", "left").join(pool.withColumn("ref", F.col("ref").cast("long")), ["class_id", "ref"], "left")
    slots = lambda t: F.when(t == "void", 0).when(t.isin("long", "double"), 2).otherwise(1)
    field, name = slots(N.type_text(F.col("descriptor"))), F.col("name")
    called = slots(N.return_text(F.col("descriptor"))) - N.parameter_slots(F.col("descriptor")) - F.when(name.isin("invokestatic", "invokedynamic"), 0).otherwise(1)
    own = F.when(name == "getstatic", field).when(name == "putstatic", -field).when(name == "getfield", field - 1).when(name == "putfield", -field - 1)
    return joined.withColumn("delta", F.coalesce("delta", own.when(name.startswith("invoke"), called).when(name == "multianewarray", 1 - F.col("whole")).cast("int"), F.lit(0)).cast("int")).drop("descriptor")


def clr_changes(md: DataFrame) -> DataFrame:
    """Instructions of all methods with ``delta``, the change of height in values; calls follow their signatures."""
    instr = dotnet.method_instructions(md)
    fixed = F.broadcast(change_table(instr.sparkSession, "cil"))  # the opcodes
    ref = lambda t: (F.lit(t).cast("long") * (1 << 24) + F.col("rid")).alias("ref")
    sig = lambda t: dotnet.view(md, t).select("file_id", ref(t), "Signature")
    every = sig(6).unionByName(sig(10))
    of_spec = dotnet.view(md, 43).select("file_id", ref(43), (F.col("Method_table").cast("long") * (1 << 24) + F.col("Method_rid")).alias("of"))
    every = every.unionByName(of_spec.join(every.withColumnRenamed("ref", "of"), ["file_id", "of"]).select("file_id", "ref", "Signature"))
    alone = sig(17)  # of calls through pointers
    parsed = every.unionByName(alone).withColumn("sig", signature_parts(F.col("Signature"), "method"))
    this = F.conv(F.hex(F.substring("Signature", 1, 1)), 16, 10).cast("int").bitwiseAND(0x20)
    shape = parsed.select("file_id", "ref", (F.size("sig") - 1).alias("n"), (this != 0).cast("int").alias("this"), F.when(F.get(F.get("sig", F.lit(0)), F.lit(0))["text"] == "void", 0).otherwise(1).alias("back"))
    joined = instr.join(fixed, "name", "left").join(shape, ["file_id", "ref"], "left")
    made = F.when(F.col("name") == "newobj", 1 - F.col("n")).when(F.col("name") == "calli", F.col("back") - F.col("n") - F.col("this") - 1).when(F.col("name").isin("call", "callvirt"), F.col("back") - F.col("n") - F.col("this"))
    return joined.withColumn("delta", F.coalesce("delta", made, F.lit(0)).cast("int")).drop("n", "this", "back")


def stack_heights(instr: DataFrame, keys: list[str], entries: DataFrame) -> DataFrame:
    """keys, start, height, n_before, conflict, temps of each block of ``instr`` (with ``delta``); ``entries`` (keys, offset, height) are handlers.

    Blocks that go on into one another form a run, in which heights are prefix sums. Between runs each jump fixes the difference of two heights.
    Every run points to the smallest run it is joined to, with the difference to it, and halves its way there each round, so rounds grow with the
    logarithm of a method's runs. Heights are counted from the first instruction; code that nothing reaches has none. A block that is reached with
    different heights is a conflict. ``n_before`` counts the blocks that go on to it, and ``temps`` names what lies on the stack where several meet.
    """
    order = W.partitionBy(*keys).orderBy("pos")
    instr = kept(instr.select(*keys, "pos", "offset", "name", "targets", "delta"), "changes")
    j = jumps(instr, keys)
    led = j.select(*keys, F.col("target").alias("offset")).unionByName(entries.select(*keys, "offset")).distinct().withColumn("led", F.lit(True))
    name = F.col("name")
    marked = instr.join(led, [*keys, "offset"], "left").withColumn("after", F.coalesce(F.lag((F.size("targets") > 0) | name.rlike(ENDS)).over(order), F.lit(True)))
    numbered = marked.withColumn("block", F.sum((F.col("led").isNotNull() | F.col("after")).cast("int")).over(order))
    blocks = numbered.groupBy(*keys, "block").agg(F.min("offset").alias("start"), F.sum("delta").cast("int").alias("net"), F.max_by(F.struct("offset", "name"), "pos").alias("last"))
    goes_on = ~F.col("last.name").rlike(f"{GOTO}|{ENDS}|{CLOSED}")
    by_start = W.partitionBy(*keys).orderBy("start")
    blocks = blocks.withColumn("goes_on", goes_on & F.lead("start").over(by_start).isNotNull()).withColumn("fallen", F.coalesce(F.lag("goes_on").over(by_start), F.lit(False)))
    blocks = blocks.withColumn("run", F.last(F.when(~F.col("fallen"), F.col("start")), True).over(by_start))
    blocks = blocks.withColumn("rel", F.coalesce(F.sum("net").over(W.partitionBy(*keys, "run").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    blocks = kept(blocks.select(*keys, "start", "net", F.col("last.offset").alias("source"), F.col("last.name").alias("last"), "goes_on", "run", "rel"), "blocks")

    into = blocks.select(*keys, F.col("start").alias("target"), F.col("run").alias("b"), F.col("rel").alias("rel_b"))
    first = blocks.groupBy(*keys).agg(F.min("run").alias("a"))
    jumped = j.join(blocks.select(*keys, "source", F.col("start").alias("from"), "last", F.col("run").alias("a"), (F.col("rel") + F.col("net")).alias("out")), [*keys, "source"]).join(into, [*keys, "target"])
    # leaving a region empties the stack, so the height there is known without its source
    open_ = jumped.filter(~F.col("last").rlike(EMPTIES)).select(*keys, "from", "target", "a", "b", "out", "rel_b")
    known = jumped.filter(F.col("last").rlike(EMPTIES)).select(*keys, "from", "target", "b", F.lit(0).alias("out"), "rel_b")
    known = known.unionByName(entries.withColumnRenamed("offset", "target").join(into, [*keys, "target"]).select(*keys, F.lit(-1).alias("from"), "target", "b", F.col("height").cast("int").alias("out"), "rel_b"))
    edges = kept(open_.unionByName(known.join(first, keys).select(*keys, "from", "target", "a", "b", "out", "rel_b")).withColumn("w", F.col("out") - F.col("rel_b")), "edges")

    ways = edges.filter("a <> b").select(*keys, "a", "b", "w").distinct()
    ways = kept(ways.unionByName(ways.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("w")).alias("w"))), "ways")
    label = kept(ways.select(*keys, F.col("a").alias("run")).distinct().withColumn("root", F.col("run")).withColumn("off", F.lit(0)).withColumn("moved", F.lit(True)), "label")
    while not label.filter("moved").isEmpty():
        now = label.drop("moved")
        told = ways.join(now.withColumnRenamed("run", "a"), [*keys, "a"]).select(*keys, F.col("b").alias("run"), "root", (F.col("off") + F.col("w")).alias("off"))
        told = told.groupBy(*keys, "run").agg(F.min(F.struct("root", "off")).alias("l"))
        # a run keeps its difference until it hears of a smaller run, so a conflict can't move what is known
        least = now.join(told, [*keys, "run"]).select(*keys, "run", F.when(F.col("l.root") < F.col("root"), F.col("l")).otherwise(F.struct("root", "off")).alias("l"))
        least = kept(least.select(*keys, "run", "l.root", "l.off"), "least")
        up = least.select(*keys, F.col("run").alias("root"), F.col("root").alias("above"), F.col("off").alias("more"))
        jumped_ = least.join(up, [*keys, "root"]).select(*keys, "run", F.col("above").alias("root"), (F.col("off") + F.col("more")).alias("off"))
        after = kept(jumped_.join(now.select(*keys, "run", F.col("root").alias("was")), [*keys, "run"]).select(*keys, "run", "root", "off", (F.col("root") != F.col("was")).alias("moved")), "label")
        drop(label, least)
        label = after
    base = blocks.join(first, keys).join(label.drop("moved"), [*keys, "run"], "left")
    at_first = F.coalesce("root", "run") == F.col("a")
    high = base.select(*keys, "start", "goes_on", "net", F.when(at_first, F.coalesce("off", F.lit(0)) + F.col("rel")).alias("height"), F.when(at_first, F.coalesce("off", F.lit(0))).alias("at"), "run")
    # what each block is told by those before it
    told = edges.join(high.select(*keys, F.col("run").alias("a"), "at").distinct(), [*keys, "a"]).select(*keys, F.col("target").alias("start"), F.col("from"), F.when(F.col("from") == -1, F.col("out")).otherwise(F.col("at") + F.col("out")).alias("told"))
    falls = high.withColumn("next", F.lead("start").over(by_start)).filter("goes_on").select(*keys, F.col("next").alias("start"), F.col("start").alias("from"), (F.col("height") + F.col("net")).alias("told"))
    heard = told.unionByName(falls).groupBy(*keys, "start").agg(F.count_distinct(F.when(F.col("from") >= 0, F.col("from"))).cast("int").alias("n_before"), F.count_distinct("told").alias("ways"))
    out = high.select(*keys, "start", "height").join(heard, [*keys, "start"], "left")
    conflict = F.coalesce(F.col("ways") > 1, F.lit(False))
    names = F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda i: F.concat(F.lit("T"), F.lpad(F.hex("start"), 4, "0"), F.lit("_"), i.cast("string")))
    temps = F.when((F.col("n_before") > 1) & (F.col("height") > 0) & ~conflict, names).otherwise(F.array().cast("array<string>"))
    return out.select(*keys, "start", F.when(~conflict, F.col("height")).alias("height"), F.coalesce("n_before", F.lit(0)).alias("n_before"), conflict.alias("conflict"), temps.alias("temps"))
