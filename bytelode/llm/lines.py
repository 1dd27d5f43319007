"""Line dedup with two Bloom filters.

A line's 64-bit hash names a segment of the filters and its bits in it. Pass 1 sends each batch's hashes to their segments, where
they set the bits of two filters: seen once, and seen twice (``twice`` takes the bits that ``once`` has already), so a key of
two or more documents has all its bits in ``twice``; there are no false negatives at any fill. Pass 2 probes ``twice``;
only suspected lines shuffle as texts, and they are confirmed on their exact text, where the smallest document wins.

The number of segments follows from the counted lines, ``BITS_PER_KEY`` bits each, so the fill and with it the share of
false suspects (below 0.1 %) are the same at every size. Filters of at most ``BROADCAST_BITS`` are broadcast and probed where
the lines are; larger ones stay distributed, and hashes that a batch holds once go to their segment to be probed there. A
key that a batch holds in two documents needs no probe, so a very common line is sent once a batch, not once a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytelode.llm._shared import by_bytes, materialize, table

BLANK = " \t\n\x0b\x0c\r"
MIN_KEY = 10
BITS_PER_KEY = 8
SEGMENT_BITS = 1 << 20
PROBES = 4
#: Bound of the filter that is broadcast (64 MiB); a larger one is probed by a join on its segments.
BROADCAST_BITS = 1 << 29
FLUSH = 4_000_000


def line_key(line: str, least: int) -> bytes | None:
    """The key of a line, or None if it is shorter than ``least`` code points. ``bytes.lower`` touches A-Z only."""
    line = line.strip(BLANK)
    return line.encode("utf-8", "surrogatepass").lower() if len(line) >= least else None


def _hash(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key)


def _segments(hashes: np.ndarray, count: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)).astype(np.int64)


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions in the segment, one row per hash."""
    x = hashes * np.uint64(0x9E3779B97F4A7C15)
    lo, hi = x >> np.uint64(40), (x & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return np.stack([(lo + np.uint64(i) * hi + np.uint64(i * i)) % np.uint64(bits) for i in range(PROBES)], axis=1).astype(np.int64)


def _keys(texts: list[str | None], least: int) -> Iterator[tuple[int, dict[bytes, None]]]:
    for i, t in enumerate(texts):
        found = {k: None for line in (t or "").split("\n") if (k := line_key(line, least)) is not None}
        if found:
            yield i, found


def _holders(batch: pa.RecordBatch, least: int) -> tuple[list[bytes], np.ndarray, list[list[int]]]:
    """Distinct keys of a batch (doc_id, text), their hashes, and the rows that hold them."""
    held: dict[bytes, list[int]] = {}
    for i, ks in _keys(batch.column(1).to_pylist(), least):
        for k in ks:
            held.setdefault(k, []).append(i)
    keys = list(held)
    return keys, np.array([_hash(k) for k in keys], np.uint64), list(held.values())


def _by_segment(hashes: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
    """Segment and places in ``hashes`` of what belongs to it."""
    seg = _segments(hashes, count)
    order = np.argsort(seg, kind="stable")
    cuts = np.flatnonzero(np.diff(seg[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        yield int(seg[order[a]]), order[a:b]


def segments_for(docs: DataFrame) -> int:
    """Segments that hold all lines of ``docs`` at ``BITS_PER_KEY``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    lines = docs.agg(F.sum((breaks + 1).cast("long"))).first()[0] or 0
    return max(1, -(-lines * BITS_PER_KEY // SEGMENT_BITS))


def twice_filter(docs: DataFrame, count: int, least: int = MIN_KEY) -> DataFrame:
    """(segment, twice): bitmaps of the twice-seen filter over ``count`` segments, empty ones left out."""

    def partial(batches):
        held: list[np.ndarray] = []

        def flush():
            u, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            for s, at in _by_segment(u, count):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int32()), pa.array([u[at].astype("<u8").tobytes()], pa.binary()), pa.array([np.packbits(n[at] > 1).tobytes()], pa.binary())], ["segment", "keys", "many"]
                )

        size = 0
        for b in by_bytes(batches, "text", 8 << 20):
            got = np.array([_hash(k) for _, ks in _keys(b.column(0).to_pylist(), least) for k in ks], np.uint64)
            if len(got):
                held.append(got)
                size += len(got)
            if size > FLUSH:
                size = 0
                yield from flush()
        if held:
            yield from flush()

    def merge(batches):
        now, once, twice = None, None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], ["segment", "twice"])

        for b in batches:
            for s, keys, many in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if s != now:
                    if now is not None and twice.any():
                        yield out()
                    now, once, twice = s, np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
                bits = _probes(np.frombuffer(keys, "<u8"), SEGMENT_BITS)
                twice[bits[once[bits]]] = True
                twice[bits[np.unpackbits(np.frombuffer(many, np.uint8), count=len(bits)).astype(bool)].ravel()] = True
                once[bits.ravel()] = True
        if now is not None and twice.any():
            yield out()

    parts = docs.select("text").mapInArrow(partial, "segment int, keys binary, many binary")
    return parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, twice binary")


def _suspected(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = _probes(hashes, 8 * len(bitmap))
    return ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def _probe_apart(docs: DataFrame, filters: DataFrame, count: int, least: int) -> DataFrame:
    """(doc_id, h): suspected hashes of each document, by sending hashes to the segments of a distributed filter."""

    def ask(batches):
        for b in by_bytes(batches, "text", 8 << 20):
            names = np.asarray(b.column(0))
            _, h, rows = _holders(b, least)
            if not len(h):
                continue
            many = np.array([len(r) > 1 for r in rows])
            pairs = [(names[i], h[j]) for j in np.flatnonzero(many) for i in rows[j]]
            if pairs:  # a batch's own repeats are suspects without a probe
                yield pa.RecordBatch.from_arrays(
                    [pa.array([-1], pa.int32()), pa.array([1], pa.int32()), pa.array([np.array([x for _, x in pairs], "<u8").tobytes()], pa.binary()), pa.array([np.array([d for d, _ in pairs], "<i8").tobytes()], pa.binary())],
                    ["segment", "side", "keys", "ids"],
                )
            single = np.flatnonzero(~many)
            owner = np.array([names[rows[j][0]] for j in single], "<i8")
            for s, at in _by_segment(h[single], count):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int32()), pa.array([1], pa.int32()), pa.array([h[single][at].astype("<u8").tobytes()], pa.binary()), pa.array([owner[at].tobytes()], pa.binary())],
                    ["segment", "side", "keys", "ids"],
                )

    def probe(batches):
        now, bitmap = None, None
        for b in batches:
            for s, side, keys, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if side == 0:
                    now, bitmap = s, np.frombuffer(keys, np.uint8)
                    continue
                h, d = np.frombuffer(keys, "<u8"), np.frombuffer(ids, "<i8")
                hit = np.ones(len(h), bool) if s < 0 else _suspected(h, bitmap) if s == now else np.zeros(len(h), bool)
                if hit.any():
                    yield pa.RecordBatch.from_arrays([pa.array(d[hit]), pa.array(h[hit].view(np.int64))], ["doc_id", "h"])

    asked = docs.select("doc_id", "text").mapInArrow(ask, "segment int, side int, keys binary, ids binary")
    found = asked.filter("segment < 0").mapInArrow(probe, "doc_id long, h long")
    table_ = filters.select("segment", F.lit(0).alias("side"), F.col("twice").alias("keys"), F.lit(None).cast("binary").alias("ids"))
    both = table_.unionByName(asked.filter("segment >= 0")).repartition("segment").sortWithinPartitions("segment", "side")
    return found.unionByName(both.mapInArrow(probe, "doc_id long, h long"))


def suspected_lines(docs: DataFrame, least: int = MIN_KEY, broadcast_bits: int = BROADCAST_BITS) -> DataFrame:
    """(key, h, ids, low, high): suspected keys of each batch, their hash, and the documents that hold them."""
    spark = docs.sparkSession
    count = segments_for(docs)
    filters = twice_filter(docs, count, least)
    small = count * SEGMENT_BITS <= broadcast_bits
    if small:
        shared = spark.sparkContext.broadcast({r["segment"]: bytes(r["twice"]) for r in filters.toLocalIterator()})
        asked = docs.select("doc_id", "text", F.lit(None).cast("array<bigint>").alias("hs"))
    else:
        hits = _probe_apart(docs, filters, count, least).groupBy("doc_id").agg(F.collect_set("h").alias("hs"))
        asked = docs.select("doc_id", "text").join(hits, "doc_id").select("doc_id", "text", "hs")

    def emit(batches):
        bitmaps = {s: np.frombuffer(x, np.uint8) for s, x in shared.value.items()} if small else {}
        for b in by_bytes(batches, "text", 8 << 20):
            keys, h, rows = _holders(b, least)
            keep = np.zeros(len(keys), bool)
            if small:
                for s, at in _by_segment(h, count) if len(h) else ():
                    if (m := bitmaps.get(s)) is not None:
                        keep[at] = _suspected(h[at], m)
            else:
                wanted = {x & 0xFFFFFFFFFFFFFFFF for hs in b.column(2).to_pylist() for x in hs}
                keep[:] = [x in wanted for x in h.tolist()]
            names = b.column(0).to_pylist()
            at = np.flatnonzero(keep)
            ids = [[names[i] for i in rows[j]] for j in at]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[j] for j in at], pa.binary()), pa.array(h[at].view(np.int64)), pa.array(ids, pa.list_(pa.int64())),
                    pa.array([min(x) for x in ids], pa.int64()), pa.array([max(x) for x in ids], pa.int64()),
                ],
                ["key", "h", "ids", "low", "high"],
            )

    # a batch sends each key once, with its documents, so a very common line is as many rows as there are batches
    return materialize(asked.mapInArrow(emit, "key binary, h long, ids array<long>, low long, high long"), "suspects")


def repeated_lines(docs: DataFrame, least: int = MIN_KEY, broadcast_bits: int = BROADCAST_BITS) -> DataFrame:
    """(doc_id, h): hash of each line key that ``doc_id`` must lose. Confirmed on the exact keys."""
    found = suspected_lines(docs, least, broadcast_bits)
    first = found.groupBy("key").agg(F.min("low").alias("first"), F.max("high").alias("last")).filter("first < last")
    held = found.join(first, "key").select("h", "first", F.explode("ids").alias("doc_id"))
    return held.filter("doc_id > first").select("doc_id", "h").distinct()


def drop_repeated_lines(docs: DataFrame, least: int = MIN_KEY, broadcast_bits: int = BROADCAST_BITS) -> DataFrame:
    """``docs`` with ``text`` without its repeated lines, and ``n_lines`` and ``n_dropped`` added.

    A line's key is the line stripped of ASCII white space and with A-Z lower-cased. A key of at least ``least`` code
    points found in two or more doc_ids loses all its lines except in the smallest doc_id. A null text counts as one empty
    line and becomes an empty text. Rows of one doc_id count as one document and are all kept; rows without doc_id keep
    all their lines. Further columns pass through; ``n_lines`` and ``n_dropped`` of the input are replaced. An empty
    table gives no rows.
    """
    docs = docs.drop("n_lines", "n_dropped")
    cut = "_cut"
    while cut in (c.lower() for c in docs.columns):
        cut += "_"
    cuts = (
        repeated_lines(docs.select("doc_id", "text").filter("doc_id is not null"), least, broadcast_bits)
        .groupBy("doc_id")
        .agg(F.collect_list("h").alias(cut))
    )
    joined = docs.join(cuts, "doc_id", "left").select(*docs.columns, cut)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    names = [*docs.columns, "n_lines", "n_dropped"]
    at = names.index("text")

    def rewrite(batches):
        for b in by_bytes(batches, "text", 8 << 20):
            kept, n, gone = [], [], []
            for text, cut in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                n.append(len(lines))
                if cut:
                    out = {h & 0xFFFFFFFFFFFFFFFF for h in cut}
                    left = [x for x in lines if (k := line_key(x, least)) is None or _hash(k) not in out]
                else:
                    left = lines
                gone.append(len(lines) - len(left))
                kept.append("\n".join(left))
            cols = list(b.columns[:-1])
            cols[at] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names)

    return joined.mapInArrow(rewrite, schema)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), d AS (
  SELECT k.*, f.first IS NOT NULL AND k.doc_id <> f.first AS gone FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
