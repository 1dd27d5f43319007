"""Relational kernels: the shapes the binary analyses are made of, on the driver's tables.

Each query names the survey row (R, F, D or A number) whose shape it has. They are derived kernels on ordinary tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bytelode.session import table


def qualified_name_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a name matches alone or qualified."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    full = F.concat_ws(".", "r_name", "n_name")
    wanted = n.join(r, n.n_regionkey == r.r_regionkey).withColumn("full_name", full)
    picked = F.min_by("n_name", "n_nationkey").over(W.partitionBy("r_regionkey"))
    return (
        wanted.withColumn("first_name", picked)
        .filter((F.col("n_name") == F.col("first_name")) | (F.col("full_name") == F.concat_ws(".", "r_name", "first_name")))
        .select("n_nationkey", "full_name")
    )


def anti_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows without a row in the table that would make them nested."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.select("doc_id", "lang").join(labels.select("doc_id"), "doc_id", "left_anti")


def range_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners have a start only; a range ends where the next begins. The last start before a key, in spans of keys."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    width, span = 64, 64 * 4096
    starts = orders.groupBy(F.floor(F.col("o_orderkey") / width)).agg(F.min("o_orderkey").alias("start")).select("start")
    keys = items.groupBy(F.col("l_orderkey").alias("key")).agg(F.count("*").alias("n"))
    both = starts.select(F.col("start").alias("key"), F.lit(0).alias("n"), "start").unionByName(keys.select("key", "n", F.lit(None).cast("long").alias("start")))
    both = both.withColumn("part", F.floor(F.col("key") / span))
    # the last start before a span carries over into it: one row a span, a small part of the keys
    spans = both.groupBy("part").agg(F.max("start").alias("top"))
    before = spans.select("part", F.max("top").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    last = F.last("start", ignorenulls=True).over(W.partitionBy("part").orderBy("key", "n").rowsBetween(W.unboundedPreceding, 0))
    owned = both.withColumn("last", last).join(before, "part").withColumn("start", F.coalesce("last", "carried"))
    return owned.filter("start is not null and n > 0").groupBy("start").agg(F.sum("n").alias("n_items"))


def first_match_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row that refers to a key."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"), F.min("event_id").alias("event_id"))


def ordered_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of an owner in their order."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    listed = F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))["n_name"]
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(F.array_join(listed, ",").alias("members"))


def accessor_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per owner, the last row of each role as columns."""
    e = table(spark, sf_dir, "events")
    role = lambda t: F.max(F.when(F.col("event_type") == t, F.col("event_id")))
    return e.groupBy("user_id").agg(role("view").alias("last_view"), role("click").alias("last_click"), role("purchase").alias("last_purchase"))


def polymorphic_union_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference is a tag and a key; one join resolves all tags."""
    c, s, n = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    refs = c.select(F.lit("customer").alias("tag"), F.col("c_nationkey").alias("key"), F.col("c_acctbal").alias("bal")).unionByName(
        s.select(F.lit("supplier").alias("tag"), F.col("s_nationkey").alias("key"), F.col("s_acctbal").alias("bal"))
    )
    return (
        refs.join(F.broadcast(n), F.col("key") == n.n_nationkey)
        .groupBy("tag", "n_name")
        .agg(F.count("*").alias("n"), F.sum(F.round(F.col("bal") * 100).cast("long")).alias("cents"))
    )


def coded_index_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The low bits are the table, the rest is the row."""
    p = table(spark, sf_dir, "part")
    return p.groupBy(F.col("p_partkey").bitwiseAND(7).alias("tag")).agg(
        F.count("*").alias("n"), F.max(F.shiftright("p_partkey", 3)).alias("max_row")
    )


def distinct_sorted_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names, and one more name when another table has rows."""
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    extra = s.limit(1).select(F.lit("(supplied)").alias("name"))
    return p.select(F.col("p_type").alias("name")).distinct().unionByName(extra)


def name_anomaly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of rows that break rules, in bytes and in characters, by language."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(
        F.count("*").alias("n"),
        F.count_if(F.octet_length("text") > 4000).alias("n_long"),
        F.count_if(F.octet_length("text") > F.char_length("text")).alias("n_wide"),
    )


def max_of_first_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of a kind per group counts; then the largest of those."""
    e = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    firsts = e.groupBy("user_id").agg(F.min_by("value", "event_id").alias("v"), F.min("event_id").alias("event_id"))
    return firsts.agg(F.max(F.struct("v", "event_id")).alias("m")).select(F.col("m.v").alias("value"), F.col("m.event_id").alias("event_id"))


def adjacent_pair_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows right after a view, counted per user, only counts above ten."""
    e = table(spark, sf_dir, "events")
    before = F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return (
        e.withColumn("before", before)
        .filter("before = 'view'")
        .groupBy("user_id")
        .agg(F.count("*").alias("n_after_view"))
        .filter("n_after_view > 10")
    )


def containment_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that no document contains. Candidates share the passage's rarest-looking word, not all pairs."""
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    spaced = lambda c: F.split(c, r"\s+")
    # inner words of a passage are whole words of any text that contains it; the longest one is the probe
    inner = F.slice(spaced(F.col("text")), 2, F.greatest(F.size(spaced(F.col("text"))) - 2, F.lit(0)))
    probe = F.array_sort(inner, lambda x, y: F.when(F.length(x) != F.length(y), F.length(y) - F.length(x)).when(x < y, -1).when(x > y, 1).otherwise(0))
    b = b.select("item_id", F.col("text").alias("passage"), F.get(probe, F.lit(0)).alias("word"))
    hits = d.select("doc_id", F.explode(F.array_distinct(spaced(F.col("text")))).alias("word")).join(b.select("item_id", "word"), "word")
    found = (
        hits.join(d.select("doc_id", "text"), "doc_id")
        .join(b.select("item_id", "passage"), "item_id")
        .filter(F.col("text").contains(F.col("passage")))
        .select("item_id")
        .distinct()
    )
    return b.select("item_id").join(found, "item_id", "left_anti")


def handler_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An open range ends where the next distinct one starts, else at a default."""
    e = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("user_id", "event_id")
    return e.withColumn("stop", F.lead("event_id", 1, 1 << 40).over(W.partitionBy("user_id").orderBy("event_id")))


def consecutive_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted rows, a row that repeats the one before it is dropped."""
    e = table(spark, sf_dir, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.withColumn("before", F.lag("event_type").over(w)).filter(~F.col("event_type").eqNullSafe(F.col("before"))).select("event_id", "user_id", "event_type")


def severity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: thresholds to severities, one row per finding, a summary row last."""
    d = table(spark, sf_dir, "documents")
    c = d.agg(
        F.count("*").alias("n"),
        F.count_if(F.octet_length("text") > F.char_length("text")).alias("wide"),
        F.count_if(F.octet_length("text") > 10000).alias("long"),
    )
    rows = F.array(
        F.struct(F.lit(1).alias("ord"), F.when(F.col("wide") > 0, "high").alias("severity"), F.concat(F.col("wide").cast("string"), F.lit(" wide texts")).alias("message")),
        F.struct(F.lit(2).alias("ord"), F.when(F.col("long") > 50, "high").when(F.col("long") > 20, "low").alias("severity"), F.concat(F.col("long").cast("string"), F.lit(" long texts")).alias("message")),
        F.struct(F.lit(3).alias("ord"), F.lit("info").alias("severity"), F.concat(F.col("n").cast("string"), F.lit(" texts")).alias("message")),
    )
    return c.select(F.inline(rows)).filter("severity is not null")


def json_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: a nested model as JSON; the scalars are read back from the text."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    members = F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))
    model = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(F.to_json(F.struct(F.first("r_name").alias("name"), members.alias("types"))).alias("j"))
    back = F.from_json("j", "name string, types array<struct<n_nationkey:int,n_name:string>>")
    return model.select(back.alias("m")).select(F.col("m.name").alias("r_name"), F.size("m.types").cast("long").alias("n_types"), F.get(F.col("m.types"), F.lit(0))["n_name"].alias("first_type"))


def owner_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners with at least one member of a kind and none of another (semi and anti joins)."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    open_, urgent = o.filter("o_orderstatus = 'O'").select("o_custkey"), o.filter("o_orderpriority = '1-URGENT'").select("o_custkey")
    return (
        c.join(open_, c.c_custkey == open_.o_custkey, "left_semi")
        .join(urgent, c.c_custkey == urgent.o_custkey, "left_anti")
        .groupBy("c_mktsegment")
        .agg(F.count("*").alias("n"))
    )


def flag_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bit masks to names, then a kind by priority."""
    p = table(spark, sf_dir, "part")
    bit = lambda m: F.col("p_size").bitwiseAND(m) != 0
    kind = F.when(bit(0x20), "interface").when(bit(0x10), "enum").when(bit(0x8), "struct").otherwise("class")
    static = bit(0x1) & bit(0x2) & ~bit(0x20)
    return p.groupBy(kind.alias("kind"), static.alias("is_static")).agg(F.count("*").alias("n"))


def name_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6, scalar functions: file names from qualified names."""
    p = table(spark, sf_dir, "part")
    simple = F.substring_index("p_type", " ", -1)
    return p.select("p_partkey", F.concat(F.translate("p_type", " `/\\", "____"), F.lit("."), F.lower(simple)).alias("file_name"))
