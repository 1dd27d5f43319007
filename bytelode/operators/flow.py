"""Control flow of methods as tables: basic blocks, edges, and the source constructs they stand for.

Everything works on an instruction table with the method's key columns, ``pos``, ``offset``, ``name``, ``size`` and
``targets``, of either machine; patterns are windows and equi-joins on offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bytelode.rounds import drop, kept

GOTO = r"^(goto|goto_w|br|br\.s|leave|leave\.s)$"
SWITCH = r"^(tableswitch|lookupswitch|switch)$"
#: Instructions after which control never goes on to the next one.
ENDS = r"^([ilfda]?return|athrow|ret|throw|rethrow|endfinally|endfilter|jmp)$"


def _is(pattern: str) -> Column:
    return F.col("name").rlike(pattern)


def jumps(instr: DataFrame, keys: list[str]) -> DataFrame:
    """keys, source, target, kind (goto, branch, switch, call of a subroutine) of every jump."""
    kind = F.when(_is(GOTO), "goto").when(_is(SWITCH), "switch").when(_is("^jsr"), "subroutine").otherwise("branch")
    return instr.filter(F.size("targets") > 0).select(*keys, F.col("offset").alias("source"), kind.alias("kind"), F.explode(F.array_distinct("targets")).alias("target"))


def blocks(instr: DataFrame, keys: list[str]) -> DataFrame:
    """Basic blocks: keys, start, stop (exclusive), n instructions, ``last`` instruction's name.

    A block starts at the first instruction, at a target, and behind a jump or an instruction that never goes on.
    """
    order = W.partitionBy(*keys).orderBy("pos")
    ends = (F.size("targets") > 0) | _is(ENDS)
    led = jumps(instr, keys).select(*keys, F.col("target").alias("offset")).distinct().withColumn("led", F.lit(True))
    marked = instr.join(led, [*keys, "offset"], "left").withColumn("after", F.coalesce(F.lag(ends).over(order), F.lit(True)))
    numbered = marked.withColumn("block", F.sum((F.col("led").isNotNull() | F.col("after")).cast("int")).over(order))
    return numbered.groupBy(*keys, "block").agg(
        F.min("offset").alias("start"), F.max(F.col("offset") + F.col("size")).alias("stop"), F.count("*").cast("int").alias("n"), F.max_by("name", "pos").alias("last")
    ).drop("block")


def edges(instr: DataFrame, keys: list[str]) -> DataFrame:
    """Edges between block starts: keys, source, target, kind (fall, goto, branch, switch)."""
    b = blocks(instr, keys)
    order = W.partitionBy(*keys).orderBy("pos")
    lasts = instr.join(b.select(*keys, "start", "stop"), keys).filter((F.col("offset") >= F.col("start")) & (F.col("offset") + F.col("size") == F.col("stop")))
    jumped = lasts.select(*keys, "start", F.col("offset").alias("source")).join(jumps(instr, keys), [*keys, "source"]).select(*keys, F.col("start").alias("source"), "target", "kind")
    # one machine's switch goes on behind itself
    goes_on = ~(_is(GOTO) | _is("^(table|lookup)switch$") | _is(ENDS))
    following = instr.withColumn("next", F.lead("offset").over(order)).filter(goes_on & F.col("next").isNotNull())
    fall = lasts.select(*keys, "start", "pos").join(following.select(*keys, "pos", "next"), [*keys, "pos"]).select(*keys, F.col("start").alias("source"), F.col("next").alias("target"), F.lit("fall").alias("kind"))
    return jumped.unionByName(fall).distinct()


def constructs(instr: DataFrame, keys: list[str]) -> DataFrame:
    """Source constructs that jumps stand for: keys, kind, start, stop, alt_stop.

    * ``do_while``: a branch back; the body is from its target to it.
    * ``while``: a forward branch over a body whose last instruction goes back to the test, or a first goto to a test
      whose branch goes back to the body.
    * ``loop``: any other goto back.
    * ``if_else``: a forward branch to just behind a goto further forward: [start, stop) and [stop, alt_stop).
    * ``if``: any other forward branch.
    * ``switch``: from the instruction to its farthest target.
    """
    order = W.partitionBy(*keys).orderBy("pos")
    j = jumps(instr, keys)
    behind = instr.select(*keys, "pos", F.col("offset").alias("target"), F.lag("offset").over(order).alias("before"))
    gotos = j.filter("kind = 'goto'").select(*keys, F.col("source").alias("before"), F.col("target").alias("goes"))
    forward = j.filter("kind = 'branch' and target > source").join(behind.select(*keys, "target", "before"), [*keys, "target"], "left").join(gotos, [*keys, "before"], "left")
    # a test may have loaded operands first, so the way back goes to the test's block, not to the branch itself
    heads = blocks(instr, keys).select(*keys, F.col("start").alias("head"), "stop")
    tests = instr.select(*keys, F.col("offset").alias("source"), "size").withColumn("stop", F.col("source") + F.col("size")).join(heads, [*keys, "stop"]).select(*keys, "source", "head")
    forward = forward.join(tests, [*keys, "source"])
    kind = F.when(F.col("goes") == F.col("head"), "while").when(F.col("goes") > F.col("target"), "if_else").otherwise("if")
    ahead = forward.select(*keys, kind.alias("kind"), F.col("source").alias("start"), F.col("target").alias("stop"), F.when(kind == "if_else", F.col("goes")).alias("alt_stop"))

    back = j.filter("kind = 'branch' and target <= source").join(tests, [*keys, "source"])
    entry = j.filter("kind = 'goto' and target > source").select(*keys, F.col("source").alias("entry"), F.col("target").alias("head"))
    first = instr.select(*keys, F.col("offset").alias("entry"), (F.col("offset") + F.col("size")).alias("target"))
    rotated = entry.join(first, [*keys, "entry"]).select(*keys, "head", "target", F.lit(True).alias("rotated")).distinct()
    turned = back.join(rotated, [*keys, "head", "target"], "left").select(
        *keys, F.when(F.col("rotated"), "while").otherwise("do_while").alias("kind"), F.col("target").alias("start"), F.col("source").alias("stop"), F.lit(None).cast("int").alias("alt_stop")
    )
    used = ahead.filter("kind = 'while'").select(*keys, F.col("stop").alias("after")).distinct()
    nexts = instr.select(*keys, F.col("offset").alias("source"), F.lead("offset").over(order).alias("after"))
    loops = (
        j.filter("kind = 'goto' and target <= source").join(nexts, [*keys, "source"]).join(used, [*keys, "after"], "left_anti")
        .select(*keys, F.lit("loop").alias("kind"), F.col("target").alias("start"), F.col("source").alias("stop"), F.lit(None).cast("int").alias("alt_stop"))
    )
    switches = j.filter("kind = 'switch'").groupBy(*keys, "source").agg(F.max("target").alias("stop")).select(
        *keys, F.lit("switch").alias("kind"), F.col("source").alias("start"), "stop", F.lit(None).cast("int").alias("alt_stop")
    )
    return ahead.unionByName(turned).unionByName(loops).unionByName(switches)


def _variable() -> Column:
    """The local an instruction loads, stores or counts up: the number in its name, else its operand."""
    in_name = F.regexp_extract("name", r"^(?:[ilfda](?:load|store)_|ld(?:loc|arg)\.|stloc\.)([0-3])$", 1)
    return F.when(in_name != "", in_name.cast("long")).otherwise(F.col("ref"))


def for_loops(instr: DataFrame, keys: list[str]) -> DataFrame:
    """``while`` loops that count: keys, variable, start, test, step, stop.

    The instruction before the loop stores the variable (start), and the last one of the body counts the same variable up or
    down (step). The test is the loop's head; stop is the place behind the loop.
    """
    order = W.partitionBy(*keys).orderBy("pos")
    v, store = _variable(), _is(r"^([ilfda]store|stloc)")
    counts = _is("^iinc$") | (store & F.lag(_is(r"^([ilfd](add|sub)|add|sub)$")).over(order))
    marked = instr.select(
        *keys, "offset", "name", "targets", (F.col("offset") + F.col("size")).alias("after"), F.when(store, v).alias("stored"), F.when(counts, v).alias("counted"),
        F.lag("offset").over(order).alias("before"),
    )
    init = marked.filter("stored is not null").select(*keys, F.col("offset").alias("start"), F.col("stored").alias("variable"), F.col("after").alias("at"))
    step = marked.filter("counted is not null").select(*keys, F.col("offset").alias("step"), F.col("counted").alias("variable"), F.col("after").alias("step_stop"))
    j = jumps(instr, keys)
    # test first: the step stands before the goto back to the test's head, which the initial store stands before
    heads = blocks(instr, keys).select(*keys, F.col("start").alias("test"), F.col("stop").alias("test_stop"))
    branch = j.filter("kind = 'branch' and target > source").join(marked.select(*keys, F.col("offset").alias("source"), F.col("after").alias("test_stop")), [*keys, "source"]).join(heads, [*keys, "test_stop"])
    back = j.filter("kind = 'goto' and target <= source").join(marked.select(*keys, F.col("offset").alias("source"), F.col("after").alias("stop")), [*keys, "source"])
    first = back.select(*keys, F.col("target").alias("test"), F.col("source").alias("step_stop"), "stop").join(branch.select(*keys, "test", F.col("target").alias("stop")), [*keys, "test", "stop"]).withColumn("at", F.col("test"))
    # test last: the initial store stands before a goto to the test, the step before the test, whose branch goes to the body
    enter = j.filter("kind = 'goto' and target > source").join(marked.select(*keys, F.col("offset").alias("source"), F.col("after").alias("body")), [*keys, "source"])
    turn = j.filter("kind = 'branch' and target <= source").join(marked.select(*keys, F.col("offset").alias("source"), F.col("after").alias("test_stop")), [*keys, "source"]).join(heads, [*keys, "test_stop"])
    last = enter.select(*keys, F.col("source").alias("at"), F.col("target").alias("test"), "body").join(turn.select(*keys, "test", F.col("target").alias("body"), F.col("test_stop").alias("stop")), [*keys, "test", "body"])
    both = first.select(*keys, "at", "test", "step_stop", "stop").unionByName(last.select(*keys, "at", "test", F.col("test").alias("step_stop"), "stop"))
    return both.join(init, [*keys, "at"]).join(step, [*keys, "step_stop", "variable"]).select(*keys, "variable", "start", "test", "step", "stop").distinct()


def switch_arms(instr: DataFrame, keys: list[str]) -> DataFrame:
    """Arms of switches: keys, source, start, stop, cases (sorted, empty for the default alone), is_default, exit, shared.

    Cases that go to one place are one arm, which ends where the next begins, the last one at the exit. ``exit`` is where the goto
    that ends the arm goes; ``shared``, whether all arms that end with a goto go to the same place.
    """
    order = W.partitionBy(*keys).orderBy("pos")
    found = instr.filter(_is(SWITCH))
    # one machine lists its default as the last target, the other goes on behind the instruction
    labels = F.transform("cases", lambda c: F.struct(c.alias("case"), F.lit(False).alias("is_default")))
    rest = F.array(F.struct(F.lit(None).cast("long").alias("case"), F.lit(True).alias("is_default")))
    places = F.when(F.size("targets") > F.size("cases"), F.col("targets")).otherwise(F.concat("targets", F.array(F.col("offset") + F.col("size"))))
    each = found.select(*keys, F.col("offset").alias("source"), F.explode(F.arrays_zip(F.concat(labels, rest).alias("l"), places.alias("p"))).alias("a"))
    arms = each.groupBy(*keys, "source", F.col("a.p").alias("start")).agg(F.sort_array(F.collect_list("a.l.case")).alias("cases"), F.max("a.l.is_default").alias("is_default"))
    of_switch = W.partitionBy(*keys, "source")
    arms = arms.withColumn("stop", F.lead("start").over(of_switch.orderBy("start")))
    ends = instr.select(*keys, (F.col("offset") + F.col("size")).alias("stop"), F.when(_is(GOTO), F.get("targets", F.lit(0))).alias("exit"))
    ended = arms.join(ends, [*keys, "stop"], "left")
    alike = (F.min("exit").over(of_switch) == F.max("exit").over(of_switch)) & F.max("exit").over(of_switch).isNotNull()
    return ended.withColumn("shared", F.coalesce(alike, F.lit(False))).withColumn("stop", F.coalesce("stop", F.max("exit").over(of_switch)))


def unreferenced_labels(instr: DataFrame, keys: list[str], labels: DataFrame) -> DataFrame:
    """``labels`` (keys, offset) that no jump goes to."""
    return labels.join(jumps(instr, keys).select(*keys, F.col("target").alias("offset")).distinct(), [*keys, "offset"], "left_anti")


def threaded_jumps(instr: DataFrame, keys: list[str]) -> DataFrame:
    """keys, source, kind, target, final, hops, ring: every jump with the place it ends at once gotos that only go to a goto are skipped.

    Chains of gotos are halved each round, so a chain of n takes log2(n) rounds. Gotos that only lead round to one another have no end: a jump to them is a ``ring``
    and keeps its target.
    """
    j = jumps(instr, keys)
    links = j.filter("kind = 'goto'").select(*keys, "source", "target")
    at = links.select(*keys, F.col("source").alias("target"), F.col("target").alias("further"))
    step = kept(links.join(at, [*keys, "target"]).select(*keys, F.col("source").alias("at"), F.col("target").alias("end"), F.lit(1).alias("hops"), F.lit(True).alias("moved")), "gotos")
    # ``at`` is a goto that goes to a goto; ``end`` is the last goto known behind it
    size = links.groupBy(*keys).agg(F.count("*").alias("n"))
    while not step.filter("moved").isEmpty():
        up = step.select(*keys, F.col("at").alias("end"), F.col("end").alias("beyond"), F.col("hops").alias("more"))
        joined = step.join(up, [*keys, "end"], "left").join(size, keys)
        hops = F.col("hops") + F.coalesce("more", F.lit(0))
        ring = hops > F.col("n")
        after = kept(joined.select(*keys, "at", F.coalesce("beyond", "end").alias("end"), F.when(ring, F.col("n") + 1).otherwise(hops).cast("int").alias("hops"), (F.col("beyond").isNotNull() & ~ring).alias("moved")), "gotos")
        drop(step)
        step = after
    ends = step.join(size, keys).join(links.select(*keys, F.col("source").alias("end"), F.col("target").alias("last")), [*keys, "end"])
    ends = ends.select(*keys, F.col("at").alias("target"), "last", "hops", (F.col("hops") > F.col("n")).alias("ring"))
    # the first goto a jump meets may go to no further one
    single = links.join(ends.select(*keys, F.col("target").alias("source")), [*keys, "source"], "left_anti").select(*keys, F.col("source").alias("target"), F.col("target").alias("last"), F.lit(0).alias("hops"), F.lit(False).alias("ring"))
    out = j.join(ends.unionByName(single), [*keys, "target"], "left")
    met = F.col("last").isNotNull() & ~F.coalesce("ring", F.lit(False))
    return out.select(*keys, "source", "kind", "target", F.when(met, F.col("last")).otherwise(F.col("target")).alias("final"), F.when(met, F.col("hops") + 1).otherwise(0).alias("hops"), F.coalesce("ring", F.lit(False)).alias("ring"))


def dropped_labels(instr: DataFrame, keys: list[str]) -> DataFrame:
    """keys, offset, kind of what jump threading leaves over: ``label`` where no jump ends any more, ``goto`` that only goes to the next instruction."""
    t = threaded_jumps(instr, keys)
    gone = t.select(*keys, F.col("target").alias("offset")).distinct().join(t.select(*keys, F.col("final").alias("offset")).distinct(), [*keys, "offset"], "left_anti")
    after = instr.select(*keys, F.col("offset").alias("source"), (F.col("offset") + F.col("size")).alias("behind"))
    idle = t.filter("kind = 'goto'").join(after, [*keys, "source"]).filter("final = behind and not ring").select(*keys, F.col("source").alias("offset"), F.lit("goto").alias("kind"))
    return gone.withColumn("kind", F.lit("label")).unionByName(idle)


def dominators(steps: DataFrame, keys: list[str]) -> DataFrame:
    """keys, block, dom: of each block that the first one reaches by ``steps`` (keys, source, target; the first block has the smallest number) the blocks on all ways to it.

    A block's dominators are itself and what those of all blocks before it share, as far as they are known. Each round takes this one step on; methods
    that a round leaves as they were are done and take no part in the next, so late rounds hold only the longest methods.
    """
    steps = kept(steps.select(*keys, "source", "target").distinct(), "steps")
    first = steps.groupBy(*keys).agg(F.least(F.min("source"), F.min("target")).alias("block"))
    now = kept(first.select(*keys, "block", F.array("block").alias("dom")), "dominators")
    done, active = [], steps
    while True:
        told = active.join(now.withColumnRenamed("block", "source"), [*keys, "source"]).groupBy(*keys, F.col("target").alias("block")).agg(F.collect_list("dom").alias("doms"))
        shared = F.aggregate(F.slice("doms", 2, F.size("doms")), F.get("doms", F.lit(0)), F.array_intersect)
        met = told.join(first, [*keys, "block"], "left_anti").select(*keys, "block", F.sort_array(F.array_union(shared, F.array("block"))).alias("dom"))
        after = met.unionByName(first.select(*keys, "block", F.array("block").alias("dom")).join(now.select(*keys).distinct(), keys, "left_semi"))
        was = now.withColumnRenamed("dom", "was")
        state = kept(after.join(was, [*keys, "block"], "left").select(*keys, "block", "dom", (~F.col("dom").eqNullSafe(F.col("was"))).alias("moved")), "dominators")
        moving = state.filter("moved").select(*keys).distinct()
        done.append(kept(state.join(moving, keys, "left_anti").select(*keys, "block", "dom"), "dominators"))
        more = kept(state.join(moving, keys, "left_semi").select(*keys, "block", "dom"), "dominators")
        drop(now, state)
        now = more
        if now.isEmpty():
            break
        rest = kept(active.join(now.select(*keys).distinct(), keys, "left_semi"), "steps")
        if active is not steps:
            drop(active)
        active = rest
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def natural_loops(instr: DataFrame, keys: list[str]) -> DataFrame:
    """keys, header, n_back, n_blocks, stop, depth, parent: loops by dominance, whatever their layout.

    A step to a block on all ways to its source closes a loop; its body are the blocks that reach the step without the header. Steps to one header, such as those of
    ``continue``, are one loop. ``depth`` counts the loops around and with it, ``parent`` is the header of the next one around, and ``stop`` the end of
    its last block. Rings with two entries have no header and give no row.
    """
    steps = edges(instr, keys).select(*keys, "source", "target").distinct()
    b = blocks(instr, keys).select(*keys, F.col("start").alias("block"), F.col("stop").alias("block_stop"))
    steps = kept(steps, "steps")
    dom = dominators(steps, keys)
    back = steps.join(dom.withColumnRenamed("block", "source"), [*keys, "source"]).filter(F.array_contains("dom", F.col("target"))).select(*keys, F.col("target").alias("header"), F.col("source").alias("block"))
    back = kept(back, "back")
    body = kept(back.unionByName(back.select(*keys, "header", F.col("header").alias("block"))).distinct(), "body")
    edge = kept(back.filter("block <> header").distinct(), "front")
    while not edge.isEmpty():
        came = edge.join(steps.withColumnRenamed("target", "block"), [*keys, "block"]).select(*keys, "header", F.col("source").alias("block")).distinct()
        fresh = kept(came.join(body, [*keys, "header", "block"], "left_anti"), "front")
        grown = kept(body.unionByName(fresh), "body")
        drop(edge, body)
        edge, body = fresh, grown
    size = body.join(b, [*keys, "block"]).groupBy(*keys, "header").agg(F.count("*").cast("int").alias("n_blocks"), F.max("block_stop").alias("stop"))
    n_back = back.groupBy(*keys, "header").agg(F.count("*").cast("int").alias("n_back"))
    around = body.withColumnRenamed("header", "outer").withColumnRenamed("block", "header").join(size.select(*keys, F.col("header").alias("outer"), "n_blocks"), [*keys, "outer"])
    heads = n_back.select(*keys, "header").join(around, [*keys, "header"]).groupBy(*keys, "header").agg(
        F.count("*").cast("int").alias("depth"), F.min(F.when(F.col("outer") != F.col("header"), F.struct("n_blocks", "outer")))["outer"].alias("parent")
    )
    return n_back.join(size, [*keys, "header"]).join(heads, [*keys, "header"]).select(*keys, "header", "n_back", "n_blocks", "stop", "depth", "parent")
