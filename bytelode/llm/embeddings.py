"""Embedding near-dedup: spherical k-means cells, blocked cosine products inside cells, one representative a group.

Vectors are compared only within a partition value (the label). Equal vectors collapse first, with their number. Cells
come from spherical k-means on a bounded sample; a vector belongs to the cell of its nearest centroid and visits every
other cell that could hold a partner: if x and y have cosine >= t, x lies in cell d and y in cell p, then
``y.(c_p - c_d) <= sqrt(1 - t^2) * |c_p - c_d|``. Of two cells only one takes visitors from the other, and both sides of a
link are counted where they meet, so links are complete, not approximate. A cell's own vectors are dealt into row blocks, these
and the visitors into column blocks, of ``BLOCK`` vectors each; a vector is sent once to a pair of blocks. A pair gives counts per
vector and the star edges of its own components, never its pairs of vectors.

In data without clusters the bound rules out few cells, and the products grow with the square of a label, as an exact answer
does there; the copies then grow with that square over ``CELL``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelode.llm._shared import batched, materialize, runs, table
from bytelode.llm.graph import components, local_roots

THRESHOLD = 0.93
BLOCK = 2048
CELL = 4096
#: What a vector is in a pair of blocks.
ROW, COLUMN, VISITOR = 1, 2, 4
#: Bound of the centroids that are broadcast, and of the vectors k-means learns a label's cells from.
MAX_CENTROIDS = 4096
SAMPLE = 20_000


def _unit(blobs: list[bytes]) -> np.ndarray:
    v = np.stack([np.frombuffer(x, "<f8") for x in blobs])
    v = v / np.abs(v).max(axis=1, keepdims=True)  # else squares of tiny or huge components are lost
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def spherical_kmeans(v: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors. Empty cells keep their centroid."""
    rng = np.random.default_rng(seed)
    c = v[rng.choice(len(v), min(k, len(v)), replace=False)]
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, v)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), c)
    return c


def _valid(vectors: DataFrame) -> DataFrame:
    """id, part, vec (little-endian doubles) of vectors that can link."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter("part is not null and embedding is not null and size(embedding) > 0").filter(finite).filter(F.exists(e, lambda x: x != 0))

    def pack(batches):
        for b in batches:
            blobs = [np.asarray(x, "<f8").tobytes() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(blobs, pa.binary())], ["id", "part", "vec"])

    return rows.select("id", "part", e.alias("e")).mapInArrow(pack, "id long, part string, vec binary")


def _centroids(distinct: DataFrame) -> dict[str, np.ndarray]:
    """part -> centroids, only for parts larger than a cell. At most ``MAX_CENTROIDS`` in all."""
    sizes = distinct.groupBy("part").count().filter(F.col("count") > CELL)
    n = sizes.agg(F.sum("count")).first()[0]
    if not n:
        return {}
    k = F.least(F.ceil(F.col("count") / (CELL // 2)), F.floor(F.lit(MAX_CENTROIDS) * F.col("count") / n)).cast("int")
    rate = F.lit(float(SAMPLE)) / F.col("count")
    picked = (
        distinct.join(sizes.withColumn("k", k).withColumn("rate", rate), "part")
        .filter("k > 1")
        .filter(F.pmod(F.xxhash64("vec"), F.lit(1 << 20)) < F.col("rate") * (1 << 20))
        .select("part", "k", "vec")
    )

    def learn(batches):
        for t in runs(batches, ["part"]):
            c = spherical_kmeans(_unit(t.column("vec").to_pylist()), t.column("k")[0].as_py())
            yield pa.RecordBatch.from_arrays([t.column("part").combine_chunks().slice(0, 1), pa.array([c.astype("<f8").tobytes()], pa.binary()), pa.array([len(c)])], ["part", "c", "k"])

    out = picked.repartition("part").sortWithinPartitions("part").mapInArrow(learn, "part string, c binary, k long")
    return {r["part"]: np.frombuffer(bytes(r["c"]), "<f8").reshape(r["k"], -1) for r in out.toLocalIterator()}


def _cells(distinct: DataFrame, centroids: dict[str, np.ndarray], threshold: float) -> DataFrame:
    """part, cell, own, id, n, vec: each vector in its cell (own) and in those it visits."""
    shared = distinct.sparkSession.sparkContext.broadcast(centroids)
    reach = float(np.sqrt(max(0.0, 1 - threshold * threshold))) + 1e-9

    def assign(batches):
        spread = {p: np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T))) for p, c in shared.value.items()}
        for b in batches:
            for s in batched([b], 2000):
                part, ids, n, vec = (s.column(i) for i in range(4))
                rows, cells, own = [], [], []
                names = np.array(part.to_pylist(), object)
                for p in set(names):
                    at = np.flatnonzero(names == p)
                    if (c := shared.value.get(p)) is None:
                        rows.append(at), cells.append(np.zeros(len(at), np.int64)), own.append(np.ones(len(at), bool))
                        continue
                    sim = _unit([vec[int(i)].as_py() for i in at]) @ c.T
                    best = sim.argmax(axis=1)
                    gap = sim[np.arange(len(at)), best][:, None] - sim
                    near = gap <= reach * spread[p][best] + 1e-9
                    home, cell = best[:, None], np.arange(len(c))[None, :]
                    i, d = np.nonzero(near & ((home == cell) | (((home + cell) % 2 == 0) == (home > cell))))
                    rows.append(at[i]), cells.append(d), own.append(best[i] == d)
                r = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [part.take(r), pa.array(np.concatenate(cells), pa.int32()), pa.array(np.concatenate(own)), ids.take(r), n.take(r), vec.take(r)],
                    ["part", "cell", "own", "id", "n", "vec"],
                )

    return distinct.select("part", "id", "n", "vec").mapInArrow(assign, "part string, cell int, own boolean, id long, n long, vec binary")


def link(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vectors`` (id long, part string, embedding array) -> id, n_links, component_id, kept, one row per input row.

    ``n_links`` counts other rows of the same part with cosine >= ``threshold``; ``component_id`` is the smallest id
    reachable. Null, empty and zero vectors, vectors with null or non-finite components and rows without part link with
    nothing. Vectors of different lengths never link. Rows that repeat an id and
    vector link with each other; rows that repeat an id with another vector count as one node.
    """
    vectors = vectors.select("id", "part", "embedding")
    valid = materialize(_valid(vectors).withColumn("part", F.concat_ws("/", "part", F.octet_length("vec").cast("string"))), "vectors")
    distinct = materialize(valid.groupBy("part", "vec").agg(F.min("id").alias("id"), F.count("*").alias("n")), "distinct")
    members = materialize(_cells(distinct, _centroids(distinct), threshold), "cells")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = members.groupBy("part", "cell").agg(blocks(F.count_if("own")).alias("rows"), blocks(F.count("*")).alias("columns")).filter("rows > 0")
    at = lambda n: F.pmod(F.xxhash64("id", "vec"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    placed = members.join(sizes, ["part", "cell"]).withColumn("row_at", F.when(F.col("own"), at("rows"))).withColumn("column_at", at("columns"))
    cols = ["part", "cell", "row_block", "col_block", "role", "id", "n", "vec"]
    as_row = placed.filter("own").withColumn("row_block", F.col("row_at")).withColumn("col_block", every("columns"))
    as_column = placed.withColumn("col_block", F.col("column_at")).withColumn("row_block", every("rows")).filter("not own or row_block <> row_at")
    sides = as_row.withColumn("role", F.when(F.col("col_block") == F.col("column_at"), ROW + COLUMN).otherwise(ROW)).select(cols).unionByName(
        as_column.withColumn("role", F.when(F.col("own"), COLUMN).otherwise(COLUMN + VISITOR)).select(cols)
    )
    keys = cols[:4]

    def compare(batches):
        for t in runs(batches, keys):
            role, ids, n = (np.asarray(t.column(c)) for c in ("role", "id", "n"))
            r, c = np.flatnonzero(role & ROW), np.flatnonzero(role & COLUMN)
            if not len(r) or not len(c):
                continue
            v = _unit(t.column("vec").to_pylist())
            hit = (v[r] @ v[c].T >= threshold) & (ids[r][:, None] != ids[c][None, :])
            x, y = local_roots(ids[r], ids[c], hit)
            of_rows, of_columns = hit @ n[c], np.where(role[c] & VISITOR, n[r] @ hit, 0)
            left, right = of_rows > 0, y != ids[c]
            right |= of_columns > 0
            # counts and star edges of both sides; a cell's own vectors are counted as rows
            a = np.concatenate([ids[r][left], ids[c][right]])
            root = np.concatenate([x[left], y[right]])
            k = np.concatenate([of_rows[left], of_columns[right]])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(root), pa.array(k.astype(np.int64))], ["a", "b", "k"])

    found = materialize(
        sides.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long, k long"), "links"
    )
    roots = components(found.select("a", "b"))
    counts = found.groupBy("a").agg(F.sum("k").alias("k"))
    linked = (
        distinct.join(counts, F.col("id") == F.col("a"), "left")
        .select("part", "vec", "id", (F.coalesce("k", F.lit(0)) + F.col("n") - 1).alias("n_links"))
        .join(roots, "id", "left")
        .select("part", "vec", "n_links", F.coalesce("root", "id").alias("component_id"))
    )
    out = valid.join(linked, ["part", "vec"]).select("id", "n_links", "component_id")
    rest = vectors.select("id").exceptAll(out.select("id")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("id") == F.col("component_id"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("part"), "embedding")
    return link(e).withColumnRenamed("id", "vec_id")


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON v.vec_id = c.a LEFT JOIN n ON v.vec_id = n.a
"""
