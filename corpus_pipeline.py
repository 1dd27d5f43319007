"""A training-corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``, whatever
they are besides doc_id, text and (for packing) source. In all stages rows without doc_id are judged by their own text alone, rows that share
a doc_id are one document and go or stay together, equal rows are all kept or all go, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelode.llm import decontaminate, lines, minhash, packing, toxicity
from bytelode.llm._shared import discard, materialize, table
from bytelode.session import ship_package

#: Documents with at least this score go.
TOXIC = 0.5

#: Documents of at least this Jaccard similarity, in percent, are near copies.
NEAR = 80


def _by_operator(operator, docs: DataFrame) -> DataFrame:
    """``operator`` on ``docs`` with all columns but doc_id and text renamed, so they can't clash with its own, and their old names."""
    own = {c: c if c in ("doc_id", "text") else f"_kept_{i}" for i, c in enumerate(docs.columns)}
    out = operator(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items())))
    return out.select(*(F.col(n).alias(c) for c, n in own.items()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below ``TOXIC``. The model learns from the labelled ones among ``docs``.

    Null and empty texts score as texts without hits and stay. Without labels of both classes all stay.
    """
    labels = table(ship_package(spark), sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    return _by_operator(lambda d: toxicity.score(d, model).filter(F.col("score") < TOXIC), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a smaller doc_id has; ``n_chars`` follows the text if there is such a column.

    A document that lost lines and has no word left goes, since all it said stands in others. Other documents without words stay. A
    null text becomes an empty one. Of equal lines in one doc_id all stay or all go.
    """
    ship_package(spark)
    left = (F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    out = _by_operator(lambda d: lines.drop_repeated_lines(d).filter(left), docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of ``NEAR`` percent join, the one with the smallest doc_id.

    Texts without words link with nothing and stay, so do rows without doc_id. Ties can't arise, as ids tell documents apart.
    """
    ship_package(spark)
    gone = materialize(minhash.near_duplicates(docs.select("doc_id", "text"), NEAR).filter(~F.col("kept")).select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Null and wordless texts hold none; nor does an empty benchmark.

    Rows that share a doc_id go if one of them holds a window; rows without doc_id stay.
    """
    items = table(ship_package(spark), sf_dir, "benchmark").select("item_id", "text")
    found = decontaminate.contamination(docs.select("doc_id", "text"), items)
    gone = materialize(found.filter("contaminated").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens. A null or empty text is its end token; repeated rows are packed again."""
    ship_package(spark)
    return packing.pack(docs.select("doc_id", "source", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The learned and the packing stage can't be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), []
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
            discard(*written)
            written = [docs]
    return docs
