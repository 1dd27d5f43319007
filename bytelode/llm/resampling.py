"""Importance resampling of documents towards a target distribution of hashed word n-grams.

A block of texts gets a dictionary of its distinct words, which become integers. Its n-grams are tuples of these integers: a pair is one number, and
a triple is the number of its first pair with the id of its last word. The bytes of each distinct tuple are put together from the dictionary and hashed once;
the buckets join back to all places by the tuples' numbers. So a word is looked up once a place, and bytes are hashed once a
distinct tuple of a block. Blocks bound the dictionary: nothing but one counter a bucket is gathered from the corpus.

Buckets are written with the documents, so texts are read once: their counts over corpus and target give each bucket's gain, and a
document's weight is the sum of the gains of its features. Gumbel noise from a hash of the doc_id makes the highest scores a
draw without replacement. Ranks are places in an order that is spread by range, plus the rows of the ranges before.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bytelode.llm._shared import by_bytes, materialize, table
from bytelode.llm.blocks import byte_lists, words_of

BUCKETS = 10_000
ORDERS = 3
SEED = 42
PERCENT = 5
LEAST_WORDS = 20
#: Bytes of text that share a dictionary; a longer text has one of its own.
BLOCK = 8 << 20
#: In place of a bucket where fewer words follow than an n-gram needs.
NONE = 0xFFFF

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def _hashed(parts: list[pa.Array], buckets: int) -> np.ndarray:
    """Buckets of tuples whose words stand in ``parts``, one array a place."""
    joined = pc.binary_join_element_wise(*parts, b" ") if len(parts) > 1 else parts[0]
    return np.fromiter(map(zlib.crc32, byte_lists(joined)), np.int64, len(joined)) % buckets


def ngram_buckets(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1- to 3-grams that start at each word (``NONE`` where there is none), and the number of words of each text."""
    words, counts = words_of(texts, lambda data: _WORD[data])
    out = np.full((len(words), ORDERS), NONE, np.uint16)
    if not len(words):
        return out, counts
    encoded = words.dictionary_encode()
    names, ids = encoded.dictionary, np.asarray(encoded.indices).astype(np.int64)
    out[:, 0] = _hashed([names], buckets)[ids]
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(words))  # words from here to the end of the text
    heads, tuples = ids, names
    at = np.arange(len(words))
    for order in range(1, ORDERS):
        # (number of the tuple before, id of the next word)
        longer = left[at] > order
        at, heads = at[longer], heads[longer]
        if not len(at):
            break
        encoded = pa.array(heads * len(names) + ids[at + order]).dictionary_encode()
        pair, heads = np.asarray(encoded.dictionary), np.asarray(encoded.indices).astype(np.int64)
        tuples = pc.binary_join_element_wise(tuples.take(pa.array(pair // len(names))), names.take(pa.array(pair % len(names))), b" ")
        out[at, order] = _hashed([tuples], buckets)[heads]
    return out, counts


def featurize(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, buckets (little-endian 16 bits; three a word, ``NONE`` for none) of ``docs`` (doc_id, text)."""

    def run(batches):
        for b in by_bytes(batches, "text", BLOCK):
            found, counts = ngram_buckets(pc.fill_null(b.column(1), ""), buckets)
            ends = np.cumsum(counts)
            grams = sum(np.maximum(counts - i, 0) for i in range(ORDERS))
            places = np.concatenate([[0], ends * (2 * ORDERS)]).astype(np.int32)
            blobs = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(places), pa.py_buffer(found.astype("<u2").tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(grams, pa.int64()), blobs], ["doc_id", "n_words", "n_features", "buckets"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary")


def _flat(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = blobs.buffers()
    at = np.frombuffer(offsets, np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]
    return np.frombuffer((data or pa.py_buffer(b""))[at[0] : at[-1]], "<u2"), (at - at[0]) // 2


def bucket_counts(features: DataFrame) -> DataFrame:
    """(bucket, n): how often each bucket occurs; one row a task and bucket is shuffled."""

    def run(batches):
        total = np.zeros(NONE + 1, np.int64)
        for b in batches:
            for part in by_bytes([b], "buckets", BLOCK):
                total += np.bincount(_flat(part.column(0))[0], minlength=NONE + 1)
        at = np.flatnonzero(total[:NONE])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    return features.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of all buckets from the counts of corpus and target; ``buckets`` rows whatever the input."""
    every = corpus.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0)
    total = lambda c: F.sum(c).over(W.partitionBy(F.lit(0)))  # noqa: E731  # ``buckets`` rows
    ratio = ((F.col("t") + 1) * (total("s") + buckets)).cast("double") / ((F.col("s") + 1) * (total("t") + buckets)).cast("double")
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def noise(doc_id, seed: int = SEED):
    """Gumbel noise of a document in thousandths, from the first 32 bits of a SHA-256."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_features, weight, score, rank; ``target`` needs text.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. Of the documents with ``least_words`` words and
    more, ``percent`` in a hundred (rounded down) with the highest scores have a rank from 1, ties by the smaller doc_id. Null and empty texts
    have no features and weigh 0. Repeated rows are documents of their own with the same score. Rows without doc_id count in the corpus, and have a
    weight but no score and no rank. An empty target gives each bucket the gain of no occurrence; no rows give no rows. Other columns are ignored.
    """
    features = materialize(featurize(docs, buckets), "features")
    of_target = featurize(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets)
    by_bucket = np.zeros(NONE + 1, np.int64)
    for row in gains(bucket_counts(features), bucket_counts(of_target), buckets).collect():  # ``buckets`` rows
        by_bucket[row["bucket"]] = row["gain"]

    def weigh(batches):
        for b in by_bytes(batches, "buckets", BLOCK):
            flat, at = _flat(b.column(3))
            total = np.concatenate([[0], np.cumsum(by_bucket[flat])])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.diff(total[at]), pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    scored = features.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("out", F.col("doc_id").isNull() | (F.col("n_words") < least_words))
    order = [F.col("out"), F.desc_nulls_last("score"), F.asc_nulls_last("doc_id")]
    # an id that counts rows inside a range and ranges in their order
    placed = materialize(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "placed")
    ranges = placed.groupBy(F.shiftright("at", 33).alias("range")).agg(F.count("*").alias("rows"), F.count_if(~F.col("out")).alias("n"))  # one row a task
    every = W.partitionBy(F.lit(0))
    ranges = ranges.select(
        "range", F.coalesce(F.sum("rows").over(every.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("n").over(every).alias("all")
    )
    place = F.col("base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    drawn = ~F.col("out") & (place <= F.floor(F.col("all") * percent / 100))
    return placed.withColumn("range", F.shiftright("at", 33)).join(F.broadcast(ranges), "range").select("doc_id", "n_features", "weight", "score", F.when(drawn, place).alias("rank"))


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


#: Parts of SQL that give the CRC-32 of a text: its table, the bytes of ``x`` in hexadecimal, and the fold over them.
CRC_TABLE = """SELECT list(c ORDER BY i) AS crc FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM range(256) r(i))"""


def crc_sql(hexed: str) -> str:
    byte = f"('0x' || substr({hexed}, 2 * i + 1, 2))::BIGINT"
    steps = f"list_prepend(4294967295::BIGINT, list_transform(range(0, len({hexed}) // 2), lambda i: {byte}))"
    return f"xor(list_reduce({steps}, lambda c, b: xor(c // 256, crc[1 + xor(c % 256, b)])), 4294967295)"


OP12_SQL = rf"""
WITH k AS ({CRC_TABLE}), d AS (
  SELECT 0 AS kind, doc_id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 1, NULL, row_number() OVER (), text FROM benchmark
), w AS (
  SELECT kind, doc_id, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d
), g AS (
  SELECT kind, r, array_to_string(w[i:i + n], ' ') AS g
  FROM (SELECT kind, r, w, n, unnest(range(1, len(w) + 1 - n)) AS i FROM w, range(3) q(n) WHERE len(w) > n)
), f AS (
  SELECT kind, r, g, count(*) AS c FROM g GROUP BY ALL
), h AS (
  SELECT g, {crc_sql("hexed")} % 10000 AS bucket FROM (SELECT g, hex(encode(g)) AS hexed FROM (SELECT DISTINCT g FROM f)), k
), n AS (
  SELECT bucket, sum(c) FILTER (WHERE kind = 0) AS s, sum(c) FILTER (WHERE kind = 1) AS t FROM f JOIN h USING (g) GROUP BY bucket
), b AS (
  SELECT bucket, coalesce(s, 0)::BIGINT AS s, coalesce(t, 0)::BIGINT AS t FROM range(10000) q(bucket) LEFT JOIN n USING (bucket)
), gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::DOUBLE / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE))::BIGINT AS gain FROM b
), sums AS (
  SELECT r, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight FROM f JOIN h USING (g) JOIN gain USING (bucket) WHERE kind = 0 GROUP BY r
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN sums USING (r) WHERE kind = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM ranked
"""
