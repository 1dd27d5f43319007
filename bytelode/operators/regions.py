"""Protected regions of methods as forests of nested intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bytelode.operators import dotnet, jvm
from bytelode.rounds import kept

CLAUSE = ["kind", "type", "try_start", "try_stop", "start", "stop", "filter_start"]


def nested(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """``intervals`` (keys, start, stop, rank, id) with depth (0 outside), parent (its id), parent_stop and crosses.

    A sweep over starts and stops counts the open intervals before each start; the parent is the last one that opened a level above. So containment
    needs two windows over a method's intervals and no join of pairs. Of equal intervals the one of smaller rank is outside. ``crosses`` marks an
    interval that ends behind its parent, which damaged tables hold; empty intervals are left out.
    """
    rows = intervals.filter("start < stop")
    place = ["at", "opens", "tie", "rank", "id"]
    starts = rows.select("*", F.col("start").alias("at"), F.lit(1).alias("opens"), (-F.col("stop")).alias("tie"))
    stops = rows.select("*", F.col("stop").alias("at"), F.lit(0).alias("opens"), (-F.col("start")).alias("tie"))
    step = F.when(F.col("opens") == 1, 1).otherwise(-1)
    swept = starts.unionByName(stops).withColumn("depth", (F.sum(step).over(W.partitionBy(*keys).orderBy(*place)) - 1).cast("int")).filter("opens = 1")
    own = swept.withColumn("level", F.col("depth")).withColumn("own", F.struct("id", "stop"))
    seeks = swept.withColumn("level", F.col("depth") - 1).withColumn("own", F.lit(None).cast(own.schema["own"].dataType))
    above = F.last("own", True).over(W.partitionBy(*keys, "level").orderBy(*place))
    found = own.unionByName(seeks).withColumn("above", above).filter(F.col("level") == F.col("depth") - 1)
    return found.select(*intervals.columns, "depth", F.col("above.id").alias("parent"), F.col("above.stop").alias("parent_stop"), F.coalesce(F.col("above.stop") < F.col("stop"), F.lit(False)).alias("crosses"))


def clr_clauses(md: DataFrame) -> DataFrame:
    """file_id, rid and ``CLAUSE`` of each method's exception clauses; a caught type by name."""
    kinds = F.create_map(*(F.lit(x) for pair in {0: "catch", 1: "filter", 2: "finally", 4: "fault"}.items() for x in pair))
    rows = dotnet.view(md, 6).select("file_id", "rid", F.explode("handlers").alias("h"))
    end = lambda a, n: (F.col(a) + F.col(n)).cast("int")
    each = rows.select("file_id", "rid", kinds[F.col("h.flags").cast("int")].alias("kind"), F.col("h.type").alias("ref"), F.col("h.try_start").cast("int").alias("try_start"), end("h.try_start", "h.try_length").alias("try_stop"),
        F.col("h.start").cast("int").alias("start"), end("h.start", "h.length").alias("stop"))
    named = each.join(dotnet.token_names(md).withColumnRenamed("text", "caught"), ["file_id", "ref"], "left")
    return named.select("file_id", "rid", "kind", F.when(F.col("kind") == "catch", F.coalesce("caught", F.lit("?"))).alias("type"), "try_start", "try_stop", "start", "stop", F.when(F.col("kind") == "filter", F.col("ref").cast("int")).alias("filter_start"))


def jvm_clauses(rows: DataFrame, instr: DataFrame, resolved: DataFrame) -> DataFrame:
    """class_id, ord and ``CLAUSE`` of the members ``rows``: the handlers a source shows, one of any type as ``finally``.

    Repeated handlers, those that cover their own start and the compiler's own of synchronized blocks go. Class files give no end of a handler:
    it ends with the innermost protected range it starts in, where the next handler begins, or with the code.
    """
    keys = ["class_id", "ord"]
    each = jvm.handlers(rows).filter(~((F.col("handler") >= F.col("start")) & (F.col("handler") < F.col("stop"))))
    each = kept(each.join(jvm.synchronized_handlers(instr).withColumnRenamed("offset", "handler"), [*keys, "handler"], "left_anti"), "handlers")
    # where each handler starts, among the ranges
    ranges = each.select(*keys, "start", "stop", F.lit(0).alias("rank")).distinct().withColumn("id", F.concat_ws(":", "start", "stop"))
    points = each.select(*keys, F.col("handler").alias("start"), (F.col("handler") + 1).alias("stop"), F.lit(1).alias("rank")).distinct().withColumn("id", F.lit("handler"))
    inside = nested(ranges.unionByName(points), keys).filter("rank = 1").select(*keys, F.col("start").alias("handler"), "parent_stop")
    caught = resolved.filter("tag = 7").select("class_id", F.col("idx").alias("type_idx"), jvm.N.dotted(F.col("name")).alias("caught"))
    named = each.join(inside, [*keys, "handler"]).join(caught, ["class_id", "type_idx"], "left")
    return named.select(
        *keys, F.when(F.col("type_idx") == 0, "finally").otherwise("catch").alias("kind"), F.when(F.col("type_idx") != 0, F.coalesce("caught", F.lit("?"))).alias("type"),
        F.col("start").cast("int").alias("try_start"), F.col("stop").cast("int").alias("try_stop"), F.col("handler").cast("int").alias("start"),
        F.least("handler_stop", F.coalesce("parent_stop", "handler_stop")).cast("int").alias("stop"), F.lit(None).cast("int").alias("filter_start"),
    )


def regions(clauses: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind, type, start, stop, depth, parent_kind, parent_start, crosses: protected ranges (``try``), handlers and filters as a forest.

    Clauses of one protected range share its ``try``. Roots have no parent.
    """
    none = F.lit(None).cast("string")
    one = lambda rows, kind, type_, a, b, rank: rows.select(*keys, kind.alias("kind"), type_.alias("type"), F.col(a).alias("start"), F.col(b).alias("stop"), F.lit(rank).alias("rank"))
    tries = one(clauses, F.lit("try"), none, "try_start", "try_stop", 1)
    filters = one(clauses.filter("filter_start is not null"), F.lit("when"), none, "filter_start", "start", 0)
    every = one(clauses, F.col("kind"), F.col("type"), "start", "stop", 0).unionByName(filters).unionByName(tries).distinct()
    named = every.withColumn("id", F.concat_ws(":", "kind", "start", "stop", "type"))
    split = F.split("parent", ":")
    return nested(named, keys).select(*keys, "kind", "type", "start", "stop", "depth", F.get(split, F.lit(0)).alias("parent_kind"), F.get(split, F.lit(1)).cast("int").alias("parent_start"), "crosses")
