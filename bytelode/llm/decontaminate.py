"""Benchmark decontamination on a distributed positional inverted index, in DataFrame expressions only.

* ``build_index`` stores postings (row, term, position) of the training tokens, and one row of length per document.
* ``exact_matches`` works on lists shifted by the term's offset in its item: a posting at ``pos`` of the item's word ``i``
  supports the alignment ``pos - i``. Per window of the item, the two rarest words (by their corpus counts) are its
  anchors. Only the anchors' lists are intersected at first; an alignment two anchors agree on is a candidate, and the
  lists of the item's other words are intersected with the candidates only. Runs of agreeing offsets that are as long
  as a window are exact phrase matches.
* ``proximity_matches`` reports places where many different words of an item stand close together in any order. Of an item's
  words few may be missing, so some of its rarest must be there: only these lists are intersected at first, by stretches of a
  document, and the lists of the other words are read in the stretches that are left. The number of different words in every
  window is a running sum: an occurrence adds one from where the one before it, or the window's reach, ends.

The vocabulary and the list of candidate rows are broadcast only after they have been counted and found below
``BROADCAST_ROWS``; beyond it the same joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bytelode.llm._shared import ascii_lower, materialize, table

WINDOW = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 200_000
#: Term of the row that holds a document's length; no word is empty.
LENGTH_TERM = ""
#: Words that one number tells apart, and words of a document in a chunk of its postings.
BITS = 62
CHUNK = 64
#: Room of a proximity match in the query: further words for each word of the item.
SLOP = 1


def words(text: Column) -> Column:
    """Lower-cased words of a text; none for null."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), SEPARATORS), ""), F.array().cast("array<string>"))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_terms(items: DataFrame) -> DataFrame:
    """``items`` (item_id, text) -> item_id, i, term, n. Equal ids with several texts stay apart by ``item``."""
    return (
        items.select("item_id", words(F.col("text")).alias("w"))
        .filter(F.size("w") > 0)
        .distinct()
        .select(F.xxhash64("item_id", "w").alias("item"), "item_id", F.size("w").alias("n"), F.posexplode("w").alias("i", "term"))
    )


def build_index(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Store the postings of ``docs`` (doc_id, text): ``row``, ``term``, ``pos``, and ``doc_id`` in length rows only.

    ``row`` tells rows apart that share a doc_id. With ``vocabulary`` (one column ``term``) only its terms get postings.
    The row with term '' has the number of words in ``pos``. The table lies in the shared folder.
    """
    toks = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("w")
    ).select("row", "doc_id", F.posexplode(F.concat("w", F.array(F.lit(LENGTH_TERM)))).alias("pos", "term"))
    if vocabulary is not None:
        vocab = materialize(
            vocabulary.select("term").union(docs.sparkSession.createDataFrame([(LENGTH_TERM,)], "term string")).distinct(), "vocabulary"
        )
        toks = toks.join(_bounded(vocab, vocab.count()), "term")
    return materialize(
        toks.select("row", "term", "pos", F.when(F.col("term") == LENGTH_TERM, F.col("doc_id")).alias("doc_id")), "postings"
    )


def _anchors(terms: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """The two rarest places of every window of every item: item, i, term. Items shorter than a window are one window."""
    known = terms.join(counts, "term", "left").withColumn("rank", F.struct(F.coalesce("count", F.lit(0)).alias("c"), "i"))
    start = F.greatest(F.lit(0), F.col("n") - window)
    covers = known.select(
        "item", "i", "term", "rank", F.explode(F.sequence(F.greatest(F.lit(0), F.col("i") - window + 1), F.least(F.col("i"), start))).alias("s")
    )
    by_rarity = W.partitionBy("item", "s").orderBy("rank")
    return covers.withColumn("k", F.row_number().over(by_rarity)).filter("k <= 2").select("item", "i", "term").distinct()


def exact_matches(index: DataFrame, terms: DataFrame, window: int = WINDOW) -> DataFrame:
    """Maximal runs of item words in documents that hold a window: row, item, item_id, start, stop (exclusive)."""
    terms = materialize(terms, "terms")
    postings = index.filter(F.col("term") != LENGTH_TERM).select("row", "term", "pos")
    counts = postings.groupBy("term").count()
    anchors = materialize(_anchors(terms, counts, window), "anchors")
    n_anchors = anchors.count()
    lengths = terms.select("item", "n").distinct()
    agreed = materialize(
        postings.join(_bounded(anchors, n_anchors), "term")
        .groupBy("row", "item", (F.col("pos") - F.col("i")).alias("shift"))
        .agg(F.count("*").alias("k"))
        .join(lengths, "item")
        .filter(F.col("k") >= F.least(F.lit(2), "n"))
        .select("row", "item", "shift"),
        "agreed",
    )
    rows = materialize(agreed.select("row").distinct(), "candidates")
    near = postings.join(_bounded(rows, rows.count()), "row", "left_semi")
    asked = agreed.join(terms, "item").select("row", "item", "item_id", "n", "shift", "i", "term", (F.col("shift") + F.col("i")).alias("pos"))
    agree = asked.join(near, ["row", "pos", "term"])
    along = W.partitionBy("row", "item", "shift").orderBy("i")
    return (
        agree.withColumn("run", F.col("i") - F.row_number().over(along))
        .groupBy("row", "item", "item_id", "n", "shift", "run")
        .agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"))
        .filter(F.col("stop") - F.col("start") >= F.least(F.lit(window), "n"))
        .select("row", "item", "item_id", "start", "stop")
    )


def proximity_matches(index: DataFrame, terms: DataFrame, slop: int = 3, share: float = 0.8) -> DataFrame:
    """Places where at least ``share`` of an item's different words stand within ``(1 + slop) * n`` words, in any order.

    ``n`` is the item's number of words. Windows that overlap are one place. Returns row, item_id, start, stop, n_terms: where the first
    and behind where the last of its words stands, and the most different words a window holds. No terms or postings give no rows.
    """
    terms = materialize(terms, "terms")
    postings = index.filter(F.col("term") != LENGTH_TERM).select("row", "term", "pos")
    sizes = terms.groupBy("item", "item_id", "n").agg(F.count_distinct("term").alias("size"))
    need = F.ceil(F.col("size") * share - 1e-9).cast("int")
    sizes = sizes.select("item", "item_id", (F.col("n") * (1 + slop)).alias("span"), F.greatest(F.lit(1), need).alias("need"), "size")
    asked = terms.select("item", "term").distinct().join(sizes, "item")
    # of the rarest missing + k words at least k are in every place
    missing = F.col("size") - F.col("need")
    k = F.greatest(F.least(F.lit(2), "need"), F.ceil(F.col("size") / 10).cast("int"))
    by_rarity = W.partitionBy("item").orderBy(F.coalesce("count", F.lit(0)), "term")
    ranked = asked.join(postings.groupBy("term").count(), "term", "left").withColumn("i", F.row_number().over(by_rarity) - 1)
    anchors = materialize(ranked.filter(F.col("i") < missing + k).select("item", "term", "span", "i", k.alias("k")), "rarest")
    block = F.floor(F.col("pos") / F.col("span"))
    # a window that begins in a block reaches into the next at most; words are bits of as many numbers as they need
    cands = materialize(
        postings.join(_bounded(anchors, anchors.count()), "term")
        .select("row", "item", "span", "k", F.floor(F.col("i") / BITS).alias("g"), F.expr(f"shiftleft(1L, i % {BITS})").alias("bit"), F.explode(F.array(block - 1, block)).alias("block"))
        .filter("block >= 0")
        .groupBy("row", "item", "span", "k", "block", "g")
        .agg(F.expr("bit_or(bit)").alias("bits"))
        .groupBy("row", "item", "span", "k", "block")
        .agg(F.sum(F.bit_count("bits")).alias("found"))
        .filter(F.col("found") >= F.col("k"))
        .select("row", "item", "block", "span"),
        "stretches",
    )
    first, last = F.floor(F.col("block") * F.col("span") / CHUNK), F.floor(((F.col("block") + 2) * F.col("span") - 1) / CHUNK)
    chunks = cands.select("row", "item", F.explode(F.sequence(first, last)).alias("chunk")).distinct()
    rows = materialize(chunks.select("row").distinct(), "near")
    near = postings.join(_bounded(rows, rows.count()), "row", "left_semi").withColumn("chunk", F.floor(F.col("pos") / CHUNK))
    hits = chunks.join(asked.drop("size"), "item").join(near, ["row", "term", "chunk"])
    before = F.lag("pos").over(W.partitionBy("row", "item", "term").orderBy("pos"))
    reach = F.col("pos") - F.col("span") + 1
    event = lambda at, delta, hit: F.struct(at.cast("int").alias("at"), F.lit(delta).alias("delta"), F.lit(hit).alias("hit"))
    steps = hits.withColumn("since", F.greatest(F.coalesce(before + 1, reach), reach)).select(
        "row", "item", "item_id", "span", "need", F.inline(F.array(event(F.col("since"), 1, False), event(F.col("pos") + 1, -1, False), event(F.col("pos"), 0, True)))
    )
    along = W.partitionBy("row", "item").orderBy("at")
    begins = F.when(F.col("n_terms") >= F.col("need"), F.col("at"))
    open_at = F.last("begins", ignorenulls=True)
    places = (
        steps.withColumn("n_terms", F.sum("delta").over(along))
        .filter("hit")
        .withColumn("begins", begins)
        .withColumn("now", open_at.over(along.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("ago", open_at.over(along.rowsBetween(W.unboundedPreceding, -1)))
        .filter(F.col("at") < F.col("now") + F.col("span"))
        .withColumn("place", F.sum(F.coalesce((F.col("at") >= F.col("ago") + F.col("span")).cast("int"), F.lit(0))).over(along))
    )
    return (
        places.groupBy("row", "item", "item_id", "place")
        .agg(F.min("at").alias("start"), (F.max("at") + 1).alias("stop"), F.max(F.when(F.col("begins").isNotNull(), F.col("n_terms"))).alias("n_terms"))
        .select("row", "item_id", "start", "stop", "n_terms")
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items (sorted array of ids as strings), contaminated.

    A window is ``window`` consecutive words of an item, or a whole shorter item. Null or wordless texts have no words and
    no hits; null or wordless items match nothing; equal items all count; rows that share a doc_id each get a row. Other
    columns are ignored. An empty ``items`` leaves every document clean. With ``slop`` there is also ``near``, the sorted ids of items
    with proximity matches; these don't make a document contaminated.
    """
    terms = item_terms(items)
    index = build_index(docs.select("doc_id", "text"), terms.select("term"))
    spans = exact_matches(index, terms, window)
    before = W.partitionBy("row").orderBy("start", "stop").rowsBetween(W.unboundedPreceding, -1)
    covered = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(before), F.lit(0))))
    hits = (
        spans.withColumn("covered", covered)
        .groupBy("row")
        .agg(F.sum("covered").alias("n_hit"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    lengths = index.filter(F.col("term") == LENGTH_TERM).select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    out, more = lengths.join(hits, "row", "left"), []
    if slop is not None:
        close = proximity_matches(index, terms, slop).groupBy("row").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("near"))
        out, more = out.join(close, "row", "left"), [F.coalesce("near", none).alias("near")]
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        *more,
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return contamination(docs.select("doc_id", "text"), items.select("item_id", "text"), slop=SLOP).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
        F.size("near").cast("long").alias("n_near"), F.sha2(F.array_join("near", ","), 256).alias("near_sha256"),
    )


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 8, 2))) AS s FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw))
), h AS (
  SELECT dw.doc_id, dw.s, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.p = bw.p
), c AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM h) GROUP BY doc_id
), i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id
), bt AS (
  SELECT item, item_id, n * 2 AS span, (count(*) OVER (PARTITION BY item) * 4 + 4) // 5 AS need, term
  FROM (SELECT DISTINCT item, item_id, len(w) AS n, unnest(w) AS term FROM (SELECT *, row_number() OVER () AS item FROM b WHERE len(w) > 0))
), dt AS (
  SELECT doc_id, pos, term FROM (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d) WHERE term IN (SELECT term FROM bt)
), pairs AS (
  SELECT doc_id, item FROM (SELECT DISTINCT doc_id, term FROM dt) JOIN bt USING (term)
  GROUP BY doc_id, item, need HAVING count(*) >= need
), near AS (
  SELECT doc_id, item_id, need, count(DISTINCT term) OVER (PARTITION BY doc_id, item ORDER BY pos RANGE BETWEEN CURRENT ROW AND span - 1 FOLLOWING) AS n_terms
  FROM pairs JOIN bt USING (item) JOIN dt USING (doc_id, term)
), nd AS (
  SELECT doc_id, count(*) AS n_near, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM near WHERE n_terms >= need) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n_near, 0) AS n_near, sha256(coalesce(nd.ids, '')) AS near_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN nd USING (doc_id)
"""
