"""MinHash near-dedup on an LSH forest.

Documents with equal shingle sets collapse into one class first. A class has ``TREES`` signature orders of ``DEPTH`` hash
values; every order is sorted, and classes that share the first ``MIN_DEPTH`` values of a tree form a region of it.

* Candidates are neighbours in a sorted order: of a class, the next ``WINDOW`` classes of its region, which are those with
  the longest common prefixes. So the depth adapts to the density: a region of up to ``WINDOW`` + 1 classes is compared whole,
  at ``MIN_DEPTH``; in a denser one the window holds only those that share more values.
* Pass 1 walks ``FIRST_TREES`` orders; each class proposes its nearest neighbour whose signature agrees within ``MARGIN`` of the
  threshold. Proposals are confirmed on the full shingle sets, and confirmed links are joined into components.
* Pass 2 walks all orders of regions that still hold several components, and proposes agreeing neighbours of other components:
  all of the window in regions of up to ``WINDOW`` + 1 classes, the nearest one in denser regions.
* A denser region that is still open after that is closed exactly: the full sets of its classes outside its largest component
  are intersected with those of all its classes, in blocks of ``BLOCK`` of either; a block gives the star edges of its links,
  never its pairs. No pair of a region is dropped, and regions the window covers never get there.

Small regions meet in one task; denser ones are spread by range over (tree, values, hash), so none is gathered. What the
borders of the ranges separate, other orders and the last pass find. With similarity s the chance to share no region is
``(1 - s^MIN_DEPTH)^TREES``: 8e-6 at 0.85, 2e-4 at 0.8. A pair that shares small regions only must also agree in its signature within ``MARGIN``,
which at exactly the threshold it misses with a chance of 1.0e-4 at 0.85 and 4.5e-4 at 0.8; further above it the chance vanishes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelode.llm._shared import by_bytes, discard, materialize, runs, table
from bytelode.llm.graph import components, local_roots, united

SHINGLE = 5
THRESHOLD = 85
TREES, DEPTH, MIN_DEPTH = 16, 8, 4
HASHES = TREES * DEPTH
FIRST_TREES = 4
WINDOW = 32
MARGIN = 0.12
BLOCK = 512
#: Bound of an id list that is broadcast, counted before.
BROADCAST_IDS = 500_000

_U = np.uint64
_rng = np.random.default_rng(20_240)
_MUL = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_PLACE = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def shingle_sets(texts: list[str | None], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; a shorter text is one shingle, a wordless one has none."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    blank = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.diff(np.concatenate([[True], blank]).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _powers(_BASE, len(buf)), out=total[1:])
    words = _mix((total[ends] - total[starts]) * _powers(_INVERSE, len(buf))[starts] + (ends - starts).astype(np.uint64))
    stops = np.cumsum([len(r) + 1 for r in raw])
    cut = np.searchsorted(starts, stops)
    out = []
    rolled = sum((words[i : len(words) - width + 1 + i] * _PLACE[i] for i in range(width)), np.uint64(0)) if len(words) >= width else words[:0]
    rolled = _mix(np.atleast_1d(rolled))
    first = 0
    for last in cut.tolist():
        n = last - first
        if n >= width:
            out.append(np.unique(rolled[first : last - width + 1]))
        elif n:
            out.append(_mix((words[first:last] * _PLACE[:n]).sum(keepdims=True) + _U(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        first = last
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of the hash functions, in 16 bits."""
    x = (shingles >> _U(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(low, (x[i : i + 2048, None] * _MUL + _ADD).min(axis=0), out=low)
    return ((low * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.uint16)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n, cls (hash of the set), keys (a region key a tree), sig of ``docs`` (doc_id, text); nulls for no words."""

    def run(batches):
        for b in by_bytes(batches, "text", 2 << 20):
            n, cls, keys, sigs = [], [], [], []
            for s in shingle_sets(b.column(1).to_pylist()):
                n.append(len(s))
                if not len(s):
                    cls.append(None), keys.append(None), sigs.append(None)
                    continue
                sig = signature(s)
                heads = np.ascontiguousarray(sig.reshape(TREES, DEPTH)[:, :MIN_DEPTH]).view("<i8").ravel()
                cls.append(xxhash.xxh3_128_digest(s.tobytes())), keys.append(heads.tolist()), sigs.append(sig.tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                ["doc_id", "n", "cls", "keys", "sig"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, cls binary, keys array<long>, sig binary")


def _proposals(ids: np.ndarray, region: np.ndarray, comp: np.ndarray, sig: np.ndarray, dense: np.ndarray, need: int, window: int) -> set[tuple[int, int]]:
    """Agreeing neighbours of different components in a sorted order: the nearest of each class where ``dense``, else all."""
    pairs: set[tuple[int, int]] = set()
    waiting = np.ones(len(ids), bool)
    for o in range(1, min(window, len(ids) - 1) + 1):
        at = np.flatnonzero((region[:-o] == region[o:]) & (comp[:-o] != comp[o:]) & (waiting[:-o] | ~dense[:-o]))
        if not len(at):
            if not (region[:-o] == region[o:]).any():
                break
            continue
        close = at[(sig[at] == sig[at + o]).sum(axis=1) >= need]
        waiting[close] = False
        pairs.update(zip(np.minimum(ids[close], ids[close + o]).tolist(), np.maximum(ids[close], ids[close + o]).tolist(), strict=True))
    return pairs


def _common(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each row's set with each column's."""
    out = np.zeros((len(rows), len(columns)), np.float32)
    if out.size <= 8:
        for i, x in enumerate(rows):
            for j, y in enumerate(columns):
                out[i, j] = len(np.intersect1d(x, y, assume_unique=True))
        return out
    # each shingle of either side gets a number; only those of both sides count, a band of numbers at a time
    flat = [np.concatenate(x) for x in (rows, columns)]
    owner = [np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (rows, columns)]
    shared = np.intersect1d(*flat)
    if not len(shared):
        return out
    number = [np.minimum(np.searchsorted(shared, x), len(shared) - 1) for x in flat]
    both = [shared[n] == x for n, x in zip(number, flat, strict=True)]
    number, owner = [n[k] for n, k in zip(number, both, strict=True)], [o[k] for o, k in zip(owner, both, strict=True)]
    order = [np.argsort(n, kind="stable") for n in number]
    number, owner = [n[k] for n, k in zip(number, order, strict=True)], [o[k] for o, k in zip(owner, order, strict=True)]
    step = 2048

    def dense(side: int, lo: int, height: int) -> np.ndarray:
        m = np.zeros((height, min(step, len(shared) - lo)), np.float32)
        i, j = np.searchsorted(number[side], (lo, lo + step))
        m[owner[side][i:j], number[side][i:j] - lo] = 1
        return m

    for lo in range(0, len(shared), step):
        out += dense(0, lo, len(rows)) @ dense(1, lo, len(columns)).T
    return out


def _pair_batch(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
    rows = sorted(pairs)
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in rows], pa.int64()), pa.array([p[1] for p in rows], pa.int64())], ["a", "b"])


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) with 100 * intersection >= percent * union of the full sets."""
    left = sets.select(F.col("nid").alias("a"), F.col("n").alias("n_a"), F.col("s").alias("s_a"))
    right = sets.select(F.col("nid").alias("b"), F.col("n").alias("n_b"), F.col("s").alias("s_b"))

    def run(batches):
        for big in batches:
            for b in (big.slice(i, 500) for i in range(0, big.num_rows, 500)):
                ok = []
                for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * common >= percent * (len(x) + len(y) - common))
                t = pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"])
                yield t.filter(pa.array(ok, pa.bool_()))

    # a pair whose sizes alone rule it out needs no sets
    joined = pairs.join(left, "a").join(right, "b").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    return joined.select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def _neighbours(rows: DataFrame, need: int, nearest: bool, window: int = WINDOW) -> DataFrame:
    """(a, b) proposed by ``rows`` (nid, tree, key, k, comp, sig); ``k`` counts the region. ``nearest``: only the nearest anywhere."""
    tail = F.substring("sig", F.col("tree") * (2 * DEPTH) + (2 * MIN_DEPTH + 1), F.lit(2 * (DEPTH - MIN_DEPTH)))
    rows = rows.select("tree", "key", tail.alias("tail"), F.xxhash64("nid", "tree").alias("tie"), "nid", "k", "comp", "sig")
    order = ["tree", "key", "tail", "tie"]

    def walk(batches):
        held = None  # the last rows, which the next batch's first ones may follow
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            t = t.combine_chunks()
            tree, key, ids, k, comp = (np.asarray(t.column(c)) for c in ("tree", "key", "nid", "k", "comp"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
            change = np.append(True, (tree[1:] != tree[:-1]) | (key[1:] != key[:-1]))
            if pairs := _proposals(ids, np.cumsum(change), comp, sig, (k > window + 1) | nearest, need, window):
                yield _pair_batch(pairs)
            held = t.slice(max(0, t.num_rows - window))

    dense = F.col("k") > BLOCK
    apart = rows.filter(~dense).repartition("tree", "key").sortWithinPartitions(*order).mapInArrow(walk, "a long, b long")
    spread = rows.filter(dense).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(walk, "a long, b long")
    return apart.unionByName(spread).distinct()


def _parts() -> Column:
    """Into how many parts a region of ``k`` classes is dealt, so that no join gathers a dense one in a task."""
    return F.ceil(F.col("k") / BLOCK).cast("int")


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` (nid, tree, key, k) with the part of its region that each lies in."""
    return rows.withColumn("part", F.pmod(F.xxhash64("nid"), _parts()).cast("int"))


def _in_each_part(per_region: DataFrame) -> DataFrame:
    """``per_region`` (tree, key, k), a row for each part of the region; regions of up to ``BLOCK`` classes have one."""
    return per_region.withColumn("part", F.explode(F.sequence(F.lit(0), _parts() - 1))).drop("k")


def _close(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Star edges (a, b) of all links between a region's smaller components and the region: ``open_`` (nid, tree, key, k, comp)."""
    regional = ["tree", "key", "k"]
    sizes = open_.groupBy(*regional, "comp").agg(F.count("*").alias("c"))
    split = sizes.groupBy(*regional).agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("all"))
    few = F.col("all") - F.col("m.c")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    split = materialize(split.filter(few > 0).select(*regional, F.col("m.comp").alias("major"), blocks(few).alias("few_blocks"), blocks(F.col("all")).alias("all_blocks")), "split")
    placed = _dealt(open_).join(_in_each_part(split), ["tree", "key", "part"])
    at = lambda n: F.pmod(F.xxhash64("nid"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["tree", "key", "row_block", "column_block"]
    minor = placed.filter("comp <> major").withColumn("side", F.lit(0)).withColumn("row_block", at("few_blocks")).withColumn("column_block", every("all_blocks"))
    whole = placed.withColumn("side", F.lit(1)).withColumn("column_block", at("all_blocks")).withColumn("row_block", every("few_blocks"))
    asked = minor.select("nid", *keys, "side").unionByName(whole.select("nid", *keys, "side"))

    def close(batches):
        for t in runs(batches, keys):
            side, ids, n = (np.asarray(t.column(c)) for c in ("side", "nid", "n"))
            r, c = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(r) or not len(c):
                continue
            found = [np.frombuffer(x, "<u8") for x in t.column("s").to_pylist()]
            common = _common([found[i] for i in r], [found[i] for i in c]).astype(np.int64)
            hit = (100 * common >= percent * (n[r][:, None] + n[c][None, :] - common)) & (ids[r][:, None] != ids[c][None, :])
            x, y = local_roots(ids[r], ids[c], hit)
            edges = set(zip(ids[r][x != ids[r]].tolist(), x[x != ids[r]].tolist(), strict=True)) | set(zip(ids[c][y != ids[c]].tolist(), y[y != ids[c]].tolist(), strict=True))
            if edges:
                yield _pair_batch(edges)

    return asked.join(sets, "nid").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(close, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = THRESHOLD) -> DataFrame:
    """Per row of ``docs`` (doc_id long, text): doc_id, n_shingles, component_id, kept.

    Words are runs of other than ASCII white space, A-Z lower-cased; a set holds the distinct shingles of five words, or
    the whole shorter text. Two documents are linked if their sets reach ``percent`` in Jaccard similarity;
    ``component_id`` is the smallest doc_id reachable. Null, empty and wordless texts have no shingles and link with
    nothing. Rows that share a doc_id are one node with the links of all their texts. Rows without doc_id link with nothing: their
    component is null and they are kept. Other columns are ignored; no rows give no rows.
    """
    need = int(np.floor(HASHES * (percent / 100 - MARGIN)))
    rows = materialize(sketch(docs), "sketch")
    classes = materialize(
        rows.filter("cls is not null and doc_id is not null").groupBy("cls").agg(
            F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"), F.first("sig").alias("sig")
        ).withColumn("nid", F.monotonically_increasing_id()),
        "classes",
    )
    places = classes.select("nid", F.posexplode("keys").alias("tree", "key"))
    shared = materialize(places.groupBy("tree", "key").agg(F.count("*").alias("k")).filter("k > 1"), "shared")
    regions = materialize(places.join(shared, ["tree", "key"]), "regions")
    ids = materialize(regions.select("nid").distinct().join(classes.select("nid", "doc_id", "cls"), "nid"), "ids")
    small = ids.count() <= BROADCAST_IDS
    bounded = F.broadcast if small else lambda df: df
    sigs = materialize(classes.join(bounded(ids.select("nid")), "nid", "left_semi").select("nid", "sig"), "sigs")

    def full(batches):
        for b in by_bytes(batches, "text", 2 << 20):
            found = shingle_sets(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary()), pa.array([len(s) for s in found], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in found], pa.binary())],
                ["cls", "n", "s"],
            )

    own = docs.select("doc_id", "text").join(bounded(ids.select("doc_id").distinct()), "doc_id", "left_semi").select("text").mapInArrow(full, "cls binary, n long, s binary")
    sets = materialize(own.join(bounded(ids.select("nid", "cls")), "cls").select("nid", "n", "s").dropDuplicates(["nid"]), "sets")

    def links_of(rows: DataFrame, nearest: bool) -> DataFrame:
        pairs = materialize(_neighbours(rows.join(sigs, "nid"), need, nearest), "pairs")
        links = materialize(_confirm(pairs, sets, percent), "links")
        discard(pairs)
        return links

    def still_open(roots: DataFrame, least: int) -> DataFrame:
        """nid, tree, key, k, comp of regions of ``least`` classes and more that hold several components."""
        placed = materialize(
            regions.filter(F.col("k") >= least).join(roots.withColumnRenamed("id", "nid"), "nid", "left").select("nid", "tree", "key", "k", F.coalesce("root", "nid").alias("comp")), "placed"
        )
        several = placed.groupBy("tree", "key", "k").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
        open_ = materialize(_dealt(placed).join(_in_each_part(several), ["tree", "key", "part"], "left_semi").drop("part"), "open")
        discard(placed)
        return open_

    member = materialize(
        rows.join(classes.select("cls", "nid", F.col("doc_id").alias("first")), "cls", "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("nid")).alias("nid"), "first"),
        "member",
    )
    # the texts of a doc_id are one node
    several = member.filter("nid is not null").groupBy("doc_id").agg(F.min("nid").alias("a"), F.max("nid").alias("b")).filter("a < b")
    same = member.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("nid").alias("b"))
    links = links_of(regions.filter(F.col("tree") < FIRST_TREES).withColumn("comp", F.col("nid")), True).unionByName(same)
    roots = components(links)
    open_ = still_open(roots, 2)
    more = links_of(open_, False)
    roots = roots if more.isEmpty() else united(roots, more)
    discard(open_)
    open_ = still_open(roots, WINDOW + 2)
    more = materialize(_close(open_, sets, percent), "closed")
    roots = roots if more.isEmpty() else united(roots, more)
    least = classes.select(F.col("nid").alias("id"), "doc_id").join(roots, "id").groupBy("root").agg(F.min("doc_id").alias("component"))
    label = materialize(roots.join(least, "root").select(F.col("id").alias("nid"), "component"), "labels")
    discard(rows, classes, shared, regions, ids, sigs, sets, open_, roots)
    return member.join(label, "nid", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "first", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op1_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS same FROM s GROUP BY doc_id
), f AS (
  SELECT same, min(doc_id) AS doc_id FROM n GROUP BY same
), t AS (
  SELECT s.doc_id, g FROM s JOIN f ON s.doc_id = f.doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM t x JOIN t y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)
  UNION SELECT n.doc_id, f.doc_id FROM n JOIN f ON n.same = f.same
  UNION SELECT f.doc_id, n.doc_id FROM n JOIN f ON n.same = f.same
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a, min(b) AS component_id FROM r GROUP BY a
)
SELECT c.a AS doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.a = c.component_id AS kept
FROM c LEFT JOIN n ON c.a = n.doc_id
"""
