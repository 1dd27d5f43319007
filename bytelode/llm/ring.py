"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every row has a place on a ring of ``cells`` equal arcs; every shard owns ``vnodes`` points on it. A cell prefers the
shard of the first point clockwise, then the next different shard, and so on. Cells are placed in a fixed pseudo-random order that
neither loads nor the number of shards change; only cells heavier than ``HEAVY`` of the capacity come before them, the heaviest
first. A cell that would fill its shard beyond the capacity continues clockwise to the first shard that has room for it. Capacity is
``(1 + slack) * total / shards``. A cell with room nowhere goes to the lightest shard; unless all cells are heavy it is lighter than
``HEAVY`` of the capacity, so shards end within that share of it.

Two things keep movement low when a shard is added: the order is the same before and after, so that mostly the same cells of a shard
overflow; and with ``vnodes`` points the shares of the ring differ by about 1 / sqrt(vnodes), which is what has to overflow at all.

The placement works on one aggregated row per cell, so its size is bounded by ``cells``, whatever the input: this is the
bound that makes the broadcast of the cell table safe. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bytelode.llm._shared import materialize, table

CELLS = 16384
VNODES = 512
#: Share of the capacity beyond which a cell is placed before the others.
HEAVY = 0.005


def _preferences(spark: SparkSession, used: DataFrame, shards: int, cells: int, vnodes: int) -> DataFrame:
    """cell -> shards in clockwise order of their next point. Both sides are fixed-size parameter tables."""
    points = spark.range(shards * vnodes).select(
        (F.col("id") % shards).cast("int").alias("shard"),
        F.pmod(F.xxhash64(F.lit("vnode"), F.col("id") % shards, F.floor(F.col("id") / shards)), F.lit(cells)).cast("int").alias("at"),
    )
    ends = points.groupBy("shard").agg(F.min("at").alias("first_at"))
    asks = used.select("cell", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    both = points.select("shard", "at", F.col("at").alias("point"), F.lit(None).cast("int").alias("cell")).unionByName(
        asks.select("shard", F.col("cell").alias("at"), F.lit(None).cast("int").alias("point"), "cell")
    )
    clockwise = W.partitionBy("shard").orderBy(F.col("at").desc(), F.col("point").desc_nulls_last())
    near = (
        both.withColumn("next", F.last("point", ignorenulls=True).over(clockwise))
        .filter("cell is not null")
        .join(F.broadcast(ends), "shard")
        .select("cell", "shard", F.coalesce(F.col("next") - F.col("cell"), F.col("first_at") + cells - F.col("cell")).alias("d"))
    )
    return near.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("d", "shard")))["shard"].alias("prefs"))


def place_cells(loads: DataFrame, shards: int, slack: float, cells: int = CELLS, vnodes: int = VNODES) -> DataFrame:
    """``loads`` (cell int, load long, n long) -> cell, shard, first_choice, slot_base."""
    spark = loads.sparkSession
    prefs = _preferences(spark, loads.select("cell"), shards, cells, vnodes)
    row = F.struct(F.xxhash64(F.lit("order"), "cell").alias("o"), "cell", "load", "n", "prefs")

    def ranked(c):
        heavy = F.when(c["load"] > F.col("cap") * HEAVY, -c["load"]).otherwise(0)
        return F.struct(heavy.alias("weight"), *(c[n].alias(n) for n in ("o", "cell", "load", "n", "prefs")))

    line = (
        loads.join(prefs, "cell")
        .agg(F.collect_list(row).alias("cells"), F.ceil(F.sum("load") * (1.0 + slack) / shards).alias("cap"))
        .filter("cap is not null")
        .select("cap", F.sort_array(F.transform("cells", ranked)).alias("line"))
    )
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("at")
    )

    def step(acc, c):
        free = F.filter(c["prefs"], lambda s: F.get(acc["loads"], s) + c["load"] <= F.col("cap"))
        lightest = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        shard = F.coalesce(F.get(free, F.lit(0)), lightest)
        return F.struct(
            F.transform(acc["loads"], lambda v, i: F.when(i == shard, v + c["load"]).otherwise(v)).alias("loads"),
            F.concat(acc["at"], F.array(shard)).alias("at"),
        )

    placed = line.withColumn("at", F.aggregate("line", start, step)["at"]).select(
        F.posexplode("line").alias("i", "c"), "at"
    ).select("c.cell", "c.n", F.get(F.col("at"), F.col("i")).alias("shard"), F.get(F.col("c.prefs"), F.lit(0)).alias("first_choice"))
    before = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    return placed.withColumn("slot_base", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))).drop("n")


def shard_rows(rows: DataFrame, key: list[str], size: str, shards: int = 8, slack: float = 0.0, cells: int = CELLS, vnodes: int = VNODES) -> DataFrame:
    """``rows`` with ``shard``, ``slot`` (gapless from 0 in a shard) and ``moved`` (not its first choice).

    ``key`` columns give the place on the ring and, within a cell, the order; ``size`` is a non-null long. Null keys
    hash like any value. Rows that tie in every key column are interchangeable. Input columns named ``shard``, ``slot`` or
    ``moved`` are replaced, unless they are keys or the size, which are read first; all others pass through. No rows give no rows.
    """
    pos = F.xxhash64(*key)
    at = rows.select(
        F.struct(*(c for c in rows.columns if c not in ("shard", "slot", "moved"))).alias("row"), F.struct(*key).alias("key"), F.col(size).cast("long").alias("load"),
        pos.alias("pos"), F.pmod(F.shiftrightunsigned(pos, 17), F.lit(cells)).cast("int").alias("cell"),
    )
    at = materialize(at, "ring")
    loads = at.groupBy("cell").agg(F.sum("load").alias("load"), F.count("*").alias("n"))
    placed = F.broadcast(place_cells(loads, shards, slack, cells, vnodes))
    within = W.partitionBy("cell").orderBy("pos", "key")
    return at.withColumn("r", F.row_number().over(within)).join(placed, "cell").select(
        "row.*", "shard", (F.col("slot_base") + F.col("r") - 1).cast("long").alias("slot"), (F.col("shard") != F.col("first_choice")).alias("moved")
    )


def op4_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in shards 0 to 7 under the law ``bytes``: no shard exceeds an eighth of all bytes by more than a light cell."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")
    )
    out = shard_rows(docs, ["doc_id", "text_crc32", "size"], "size", 8)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "moved"
    )
