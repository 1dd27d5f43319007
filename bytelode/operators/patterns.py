"""Source statements that compilers spell out, found as patterns over the ordered instructions of a method.

Each instruction of interest becomes a symbol and its number in the method, all of one width, and a method's symbols one string, on which
regular expressions find candidates; the numbers in a match lead back to the instructions. What the pattern can't say, that two places use one variable or
a jump goes to a certain place, is said by equality of what the joined instructions hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytelode.operators import dotnet, regions
from bytelode.operators.flow import GOTO
from bytelode.rounds import kept

#: Digits behind a symbol.
DIGITS = 6
STEP = 1 + DIGITS


def variable() -> Column:
    """The local an instruction loads, stores or takes the address of: the number in its name, else its operand."""
    in_name = F.regexp_extract("name", r"^(?:[ilfda](?:load|store)_|(?:ld|st)loc\.)([0-3])$", 1)
    return F.when(in_name != "", in_name.cast("long")).when(F.col("name").rlike(r"^([ilfda](load|store)|ldloca?(\.s)?|stloc(\.s)?)$"), F.col("ref"))


def symbols(instr: DataFrame, callee: DataFrame, calls: dict[str, str], on: list[str]) -> DataFrame:
    """``instr`` with ``symbol`` and ``var``; ``calls`` maps patterns of the callee's name, from ``callee`` (on, ref, text), to symbols.

    L, S and A load, store and take the address of a local; B branches on a value, J jumps, Z ends a handler, R returns, and a point is anything else. What does nothing
    has no symbol.
    """
    name = F.col("name")
    named = instr.join(callee.select(*on, "ref", "text"), [*on, "ref"], "left").withColumn("var", variable())
    symbol = F.when(name.rlike(r"^(nop|volatile\.|constrained\.)$"), "")
    for pattern, s in calls.items():
        symbol = symbol.when(name.rlike("^(call|callvirt|invoke.*)$") & F.coalesce("text", F.lit("")).rlike(pattern), s)
    symbol = (
        symbol.when(name.rlike(r"^([ilfda]load(_\d)?|ldloc(\.\d|\.s)?)$"), "L").when(name.rlike(r"^([ilfda]store(_\d)?|stloc(\.\d|\.s)?)$"), "S").when(name.rlike(r"^ldloca"), "A")
        .when(name.rlike(GOTO), "J").when(F.size("targets") == 1, "B").when(name == "endfinally", "Z").when(name.rlike("return$|^ret$"), "R").otherwise(".")
    )
    return named.withColumn("symbol", symbol).drop("text")


def matches(marked: DataFrame, keys: list[str], pattern: str) -> DataFrame:
    """keys, nth, places: every match of ``pattern``, a regular expression over symbols alone, with the number of each symbol's instruction.

    A method is one string of at most 64 KiB of code on one machine; on the other it is as long as the method.
    """
    spelled = "".join(f"{c}\\d{{{DIGITS}}}" if c.isalpha() else f"\\.\\d{{{DIGITS}}}" if c == "." else c for c in pattern)
    one = F.concat("symbol", F.lpad(F.col("pos").cast("string"), DIGITS, "0"))
    text = marked.filter("symbol <> ''").groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", one.alias("s"))))["s"], "").alias("text"))
    found = text.select(*keys, F.posexplode(F.regexp_extract_all("text", F.lit(f"({spelled})"), F.lit(0))).alias("nth", "m"))
    steps = F.sequence(F.lit(0), (F.length("m") / STEP).cast("int") - 1)
    return found.select(*keys, "nth", F.transform(steps, lambda i: F.substring(F.col("m"), i * STEP + 2, F.lit(DIGITS)).cast("int")).alias("places"))


def captured(found: DataFrame, marked: DataFrame, keys: list[str], **places: int) -> DataFrame:
    """``found`` with a struct (offset, var, target, after) for each named place of a match; negative numbers count from its end."""
    facts = marked.select(*keys, "pos", F.struct("offset", "var", F.get("targets", F.lit(0)).alias("target"), (F.col("offset") + F.col("size")).alias("after")).alias("f"))
    for name, i in places.items():
        at = F.element_at("places", i + 1 if i >= 0 else i)
        found = found.withColumn("pos", at).join(facts.withColumnRenamed("f", name), [*keys, "pos"]).drop("pos")
    return found


#: Callees by name -> symbol, for the statements of C#.
CLR_CALLS = {r"Monitor::Enter$": "E", r"Monitor::Exit$": "X", r"::Dispose$": "D", r"::GetEnumerator$": "G", r"::MoveNext$": "M", r"::get_Current$": "C"}
JVM_CALLS = {r"\.iterator:": "I", r"\.hasNext:": "H", r"\.next:": "T"}
STATEMENT = ["kind", "variable", "item", "start", "stop"]


def clr_statements(md: DataFrame) -> DataFrame:
    """file_id, rid, kind (lock, using, foreach), variable, item, start, stop: the protected range and the local that is locked, disposed of or walked.

    * ``lock``: the range enters a monitor on a local first, or stands right behind that, and its handler leaves the monitor on the same local.
    * ``using``: a local is stored right before the range, and the handler disposes of it if it isn't null.
    * ``foreach``: as ``using``, of an enumerator just got, and the range asks the same local for its current value, which it stores in ``item``, and for the next one.
    """
    keys = ["file_id", "rid"]
    marked = kept(symbols(dotnet.method_instructions(md), dotnet.token_names(md), CLR_CALLS, ["file_id"]), "symbols")
    last = regions.clr_clauses(md).filter("kind = 'finally'").select(*keys, "try_start", "try_stop", F.col("start").alias("handler"), "stop")
    # handlers: a lock may test a flag first
    exits = captured(matches(marked, keys, "(?:LB)?LXZ"), marked, keys, first=0, monitor=-3, end=-1)
    exits = exits.select(*keys, F.col("first.offset").alias("handler"), F.col("end.after").alias("stop"), F.col("monitor.var").alias("variable"))
    enters = captured(matches(marked, keys, "LA?E"), marked, keys, monitor=0, end=-1)
    enters = enters.select(*keys, F.col("monitor.var").alias("variable"), F.explode(F.array_distinct(F.array("monitor.offset", "end.after"))).alias("try_start"))
    locks = last.join(exits, [*keys, "handler", "stop"]).join(enters, [*keys, "variable", "try_start"]).select(*keys, F.lit("lock").alias("kind"), "variable", F.lit(None).cast("long").alias("item"), F.col("try_start").alias("start"), F.col("try_stop").alias("stop"))

    freed = captured(matches(marked, keys, "LBLDZ"), marked, keys, test=0, freed=2, end=-1).filter("test.var = freed.var")
    freed = freed.select(*keys, F.col("test.offset").alias("handler"), F.col("end.after").alias("stop"), F.col("freed.var").alias("variable"))
    stored = marked.filter("symbol = 'S'").select(*keys, F.col("var").alias("variable"), (F.col("offset") + F.col("size")).alias("try_start"))
    held = last.join(freed, [*keys, "handler", "stop"]).join(stored, [*keys, "variable", "try_start"]).select(*keys, "variable", "try_start", "try_stop")
    walked = captured(matches(marked, keys, "GS"), marked, keys, kept=-1).select(*keys, F.col("kept.var").alias("variable"), F.col("kept.after").alias("try_start"))
    items = captured(matches(marked, keys, "(?:L|A)C(?:.)?S"), marked, keys, of=0, item=-1)
    items = items.select(*keys, F.col("of.var").alias("variable"), F.col("of.offset").alias("body"), F.col("item.var").alias("item"))
    asks = captured(matches(marked, keys, "(?:L|A)MB"), marked, keys, of=0, back=-1).select(*keys, F.col("of.var").alias("variable"), F.col("back.target").alias("body"), F.col("back.offset").alias("asked"))
    loops = held.join(walked, [*keys, "variable", "try_start"]).join(items, [*keys, "variable"]).join(asks, [*keys, "variable", "body"])
    loops = loops.filter((F.col("body") >= F.col("try_start")) & (F.col("asked") < F.col("try_stop")))
    loops = loops.select(*keys, F.lit("foreach").alias("kind"), "variable", "item", F.col("try_start").alias("start"), F.col("try_stop").alias("stop"))
    using = held.join(walked, [*keys, "variable", "try_start"], "left_anti").select(*keys, F.lit("using").alias("kind"), "variable", F.lit(None).cast("long").alias("item"), F.col("try_start").alias("start"), F.col("try_stop").alias("stop"))
    return locks.unionByName(using).unionByName(loops)


def jvm_statements(instr: DataFrame, resolved: DataFrame) -> DataFrame:
    """class_id, ord, kind (foreach), variable, item, start, stop: loops over an iterator that is stored in a local, from the store to behind the jump back.

    The test asks the stored iterator for more and leaves the loop to ``stop``; the body takes the next value of the same local into ``item``.
    """
    keys = ["class_id", "ord"]
    callee = resolved.select("class_id", F.col("idx").cast("long").alias("ref"), "text")
    marked = kept(symbols(instr, callee, JVM_CALLS, ["class_id"]), "symbols")
    found = captured(matches(marked, keys, "ISLHBLT(?:.)?S"), marked, keys, kept=1, asked=2, leaves=4, of=5, item=-1)
    back = instr.filter(F.col("name").rlike(GOTO)).select(*keys, F.get("targets", F.lit(0)).alias("head"), (F.col("offset") + F.col("size")).alias("behind"))
    same = found.filter("kept.var = asked.var and kept.var = of.var").withColumn("head", F.col("asked.offset")).withColumn("behind", F.col("leaves.target"))
    return same.join(back, [*keys, "head", "behind"]).select(
        *keys, F.lit("foreach").alias("kind"), F.col("kept.var").alias("variable"), F.col("item.var").alias("item"), F.col("kept.offset").alias("start"), F.col("behind").alias("stop")
    )
