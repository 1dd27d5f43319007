"""Language ID by nearest centroid.

A text is a TF-IDF vector of hashed byte n-grams (one to three bytes of the lower-cased text, runs of other characters
as one blank), with damped counts and unit length. Each language has several centroids, from spherical k-means on a
bounded sample of its training texts; small clusters are dropped as noise. A text gets the language of the centroid with
the largest cosine; a text farther from it than almost all training texts of that centroid is marked as rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from bytelode.llm._shared import by_bytes, crc_fold, materialize, runs, table
from bytelode.llm.embeddings import spherical_kmeans

DIM = 4096
#: Number of different texts a language's centroids are learned from at most, and of centroids of a language.
SAMPLE = 1500
CENTROIDS = 4
MIN_CLUSTER = 0.05
REJECT_QUANTILE = 0.001
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(128)]


def ngrams(text: str | None) -> np.ndarray:
    """Counts of hashed n-grams of the whole text."""
    b = _FOLD[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    if len(b) > 1:
        b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])]
    x = np.concatenate([[32], b, [32]]).astype(np.uint32)
    two = x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + x[2:] * np.uint32(0x27D4EB2F)
    h = np.concatenate([(x * np.uint32(0x165667B1)) >> np.uint32(20), two >> np.uint32(20), three >> np.uint32(20)])
    return np.bincount(h, minlength=DIM)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    reach: np.ndarray  # least cosine of each centroid's own texts, but for a few


def training_texts(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """lang, text: at most ``sample`` different texts of each language outside the hold-out fold."""
    rows = docs.filter("lang is not null and text is not null and doc_id is not null").filter(crc_fold(F.col("doc_id")) != 0)
    rows = rows.select("lang", "text", F.xxhash64("text").alias("h"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("texts"))
    span = 1 << 30
    # a few more than wanted by the estimated count; copies meet before the shuffle, and the window makes the bound exact
    few = (
        rows.join(F.broadcast(sizes), "lang")
        .filter(F.pmod("h", F.lit(span)) < F.lit(1.3 * sample * span) / F.col("texts"))
        .groupBy("lang", "h")
        .agg(F.min("text").alias("text"))
    )
    least = W.partitionBy("lang").orderBy(F.pmod("h", F.lit(span)), "h")
    return few.withColumn("k", F.row_number().over(least)).filter(F.col("k") <= sample).select("lang", "text")


def train(docs: DataFrame, sample: int = SAMPLE, per_language: int = CENTROIDS) -> LanguageModel | None:
    """Learn from ``docs`` (doc_id, text, lang) outside the hold-out fold. None without a training row.

    A language gives at most ``sample`` different texts, those with the smallest hashes; a text that is repeated counts
    once. What returns to the driver is ``per_language`` vectors and one count vector a language.
    """
    def vectors(batches):
        for t in runs(batches, ["lang"]):
            tf = np.log1p(np.stack([ngrams(x) for x in t.column("text").to_pylist()]).astype(np.float32))
            df = (tf > 0).sum(axis=0)
            yield pa.RecordBatch.from_arrays(
                [t.column("lang").combine_chunks().slice(0, 1), pa.array([len(tf)]), pa.array([df.astype("<i8").tobytes()], pa.binary())], ["lang", "n", "df"]
            )

    near = materialize(training_texts(docs, sample), "languages").repartition("lang").sortWithinPartitions("lang")
    found = near.mapInArrow(vectors, "lang string, n long, df binary").collect()
    if not found:
        return None
    total = sum(r["n"] for r in found)
    df = sum(np.frombuffer(bytes(r["df"]), "<i8") for r in found)
    idf = np.log((1 + total) / (1 + df)).astype(np.float32) + 0.1

    def cluster(batches):
        for t in runs(batches, ["lang"]):
            v = _unit(np.log1p(np.stack([ngrams(x) for x in t.column("text").to_pylist()]).astype(np.float32)) * idf)
            c = spherical_kmeans(v, per_language)
            own = (v @ c.T).argmax(axis=1)
            share = np.bincount(own, minlength=len(c)) / len(v)
            use = np.flatnonzero(share >= min(MIN_CLUSTER, share.max()))
            reach = [float(np.quantile((v @ c.T)[own == j, j], REJECT_QUANTILE)) for j in use]
            lang = t.column("lang")[0].as_py()
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(use)), pa.array(reach), pa.array([c[j].astype("<f4").tobytes() for j in use], pa.binary())], ["lang", "reach", "c"]
            )

    cells = near.mapInArrow(cluster, "lang string, reach double, c binary").collect()
    cells.sort(key=lambda r: (r["lang"], bytes(r["c"])))
    return LanguageModel(
        tuple(r["lang"] for r in cells), idf, np.stack([np.frombuffer(bytes(r["c"]), "<f4") for r in cells]), np.array([r["reach"] for r in cells])
    )


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (largest cosine, 0 to 1) and ``rejected`` added, replacing such columns.

    Null texts and texts without letters (Unicode's classes L) are ``und`` with score 0, as is every text without a model.
    Only text is read, so repeated rows get equal results; of centroids at the same cosine the first by language wins. No
    rows give no rows.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    names = [*docs.columns, "lang_pred", "score", "rejected"]
    at = names.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for big in by_bytes(batches, "text", 2 << 20):
            for b in (big.slice(i, 256) for i in range(0, big.num_rows, 256)):
                texts = b.column(at).to_pylist()
                read = np.array([m is not None and t is not None and any(map(str.isalpha, t)) for t in texts])
                lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
                far = ~read
                if read.any():
                    v = _unit(np.log1p(np.stack([ngrams(t) for t, r in zip(texts, read, strict=True) if r]).astype(np.float32)) * m.idf)
                    sim = v @ m.centroids.T
                    best = sim.argmax(axis=1)
                    top = sim[np.arange(len(best)), best]
                    lang[read] = np.array(m.languages, object)[best]
                    score[read] = np.clip(top, 0, 1)
                    far[read] = top < m.reach[best]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(far)], names)

    return docs.mapInArrow(run, schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "rejected"
    )
