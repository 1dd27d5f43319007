"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelode.llm._shared import discard, materialize


def local_roots(rows: np.ndarray, columns: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id reachable inside a block of links, for its rows and its columns."""
    a, b = rows.copy(), columns.copy()
    big = np.iinfo(np.int64).max
    while True:
        x = np.minimum(a, np.where(hit, b[None, :], big).min(axis=1, initial=big))
        y = np.minimum(b, np.where(hit, x[:, None], big).min(axis=0, initial=big))
        if (x == a).all() and (y == b).all():
            return x, y
        a, b = x, y


#: Edges that a task contracts at a time.
CHUNK = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, smallest id of its component) with the components of the edges ``a``, ``b``; never more than these."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        now, low = root.copy(), np.minimum(root[x], root[y])
        np.minimum.at(now, root[x], low)
        np.minimum.at(now, root[y], low)
        while (now[now] != now).any():
            now = now[now]
        if (now == root).all():
            far = root != np.arange(len(ids))
            return ids[far], ids[root[far]]
        root = now


def _contract(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) with the links that a task reads replaced by their stars, ``CHUNK`` edges at a time."""

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                yield contracted(held)
                held, rows = [], 0
        if rows:
            yield contracted(held)

    def contracted(held):
        t = pa.Table.from_batches(held)
        a, b = stars(np.asarray(t.column("a")), np.asarray(t.column("b")))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long) -> (id, root): the smallest id reachable from every id that has an edge.

    Each round first contracts the edges that lie together in a task, as a map-side combine that shortens paths, and then points all neighbours of a node at its smallest neighbour, first the larger ones, then the smaller ones;
    the edge set becomes a set of stars in a number of rounds that grows with the logarithm of the longest path. Minima
    combine before the shuffle and joins split hot nodes, so no node's neighbours are gathered in one place. Every round
    is written to the shared folder. Once one task can hold what is left (``CHUNK`` edges), its contraction is the result.
    """
    down = lambda df: df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(down(edges), "edges")
    state = None
    while True:
        sums = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if sums == state or sums[0] <= CHUNK:
            found = now if sums == state else _contract(now.coalesce(1))
            ends = found.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(found.select(F.col("b").alias("id"), F.col("b").alias("root")))
            roots = materialize(ends.distinct(), "roots")
            discard(now)
            return roots
        state = sums
        near = _contract(now)
        both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = down(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(small, "a")
        after = materialize(
            down(pairs.select("a", F.col("m").alias("b")).unionByName(pairs.select(F.col("b").alias("a"), F.col("m").alias("b")))), "edges"
        )
        discard(now)
        now = after


def united(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (id, root) with further ``links`` (a, b): only the links between different roots are searched."""
    by = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}"))
    named = links.join(by("a"), "a", "left").join(by("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    more = components(named)
    moved = roots.join(more.select(F.col("id").alias("root"), F.col("root").alias("further")), "root", "left").select("id", F.coalesce("further", "root").alias("root"))
    out = materialize(moved.unionByName(more.join(roots, "id", "left_anti").select("id", "root")), "roots")
    discard(more, roots)
    return out
