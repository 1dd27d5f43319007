"""Removal of repeated byte strings by merging shard Burrows-Wheeler transforms with interleave refinement.

A transform over every byte would need one refinement round a byte over all suffixes, so the texts are parsed first:
every place whose next ``GRAM`` bytes hash to 0 modulo ``SPACING`` starts a phrase (equal bytes always parse alike), and a
shard's string is its sequence of phrases. A phrase's symbol is a hash of its bytes and the gram after them.

* Each shard sorts its suffixes once, by their first ``SORTED`` phrases, and stores the transform (the symbol before each suffix
  in this order) with the places of its suffixes.
* Round h of the merge refines the interleave of all shards. A row's block is the set of suffixes of all shards that agree in the
  first h - 1 phrases. One last-to-first step leads from a row to the suffix one phrase longer, whose block is the pair (symbol, block of the row).
  A shard has its pairs in order already, because its suffixes are, so its list is sent as it is; the lists of all shards are
  merged by symbol ranges. What comes back is the shard's part of the interleave: one bit a pair, whether its border to its neighbours is still open,
  and the rank of open pairs, which names their blocks in the next round. No suffix is sorted again.
* A block of one row is closed: the common prefix of this suffix with its neighbours in the merged order is the round before, in phrases. Open
  blocks are repeated intervals. A row leaves as soon as its common prefix proves that the strings which start in its first phrase repeat.
* Strings of ``length`` bytes inside a proven prefix repeat. At the ends of repeated intervals, where a string reaches into phrases that
  differ, and where a string holds no phrase or a row is still open after ``ROUNDS``, candidates are compared by fingerprints of all their
  bytes, 64 bits within buckets that a second hash names.
* A proven string needs no answer, but a place elsewhere may ask for the same bytes: where what stands around them differs there, nothing is proven.
  Each round also counts the rows of a block. Where the places that share the phrases inside a string are as many as those that share the phrases around
  it, the string is proven everywhere and nobody asks; all other proven strings are sent too.

Shards are rows of a table bucketed by shard in the shared folder, so texts are written once and never shuffled. Each merge sends
a pair once a shard, so a string of many copies costs no more than the number of shards; the merges' buckets follow from the counted phrases.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelode.llm._shared import by_bytes, materialize, remove, runs, shared_dir, table

LENGTH = 200
GRAM = 32
SPACING = 40
ROUNDS = 12
#: Phrases by which a shard's suffixes are sorted; a power of two, at least ``ROUNDS``.
SORTED = 16
SHARD_BYTES = 2 << 20
#: Phrases for which a merge gets one bucket.
BUCKET_KEYS = 250_000
#: Bound of the list of repeated whole texts that is broadcast; with more, whole texts get no short cut.
BROADCAST_TEXTS = 1_000_000
NEVER = 255

_U = np.uint64
_rng = np.random.default_rng(7)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SECOND = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        p = np.full(n, base, np.uint64)
        p[:1] = 1
        _POWERS[base] = np.multiply.accumulate(p)
    return _POWERS[base][:n]


def _prefix(buf: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    total = np.zeros(len(buf) + 1, np.uint64)
    x = values[buf]
    x *= _powers(_BASE, len(buf))
    np.cumsum(x, out=total[1:])
    return total


def _fingerprints(total: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return _mix((total[ends] - total[at]) * _powers(_INVERSE, len(total))[at] + (ends - at).astype(np.uint64))


def parse(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of phrases in a shard, and each phrase's symbol: its bytes with the next phrase's gram; 0 for a text's last."""
    n = len(buf) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = _prefix(buf)
    g = total[GRAM:] - total[:-GRAM]
    g *= _powers(_INVERSE, len(total))[:n]
    g = _mix(g)
    g >>= _U(40)
    g %= _U(SPACING)
    at = np.flatnonzero(g == 0)
    text = np.searchsorted(ends, at, side="right")
    inside = at + GRAM <= ends[text]
    at, text = at[inside], text[inside]
    sym = np.zeros(len(at), np.uint64)
    if len(at) > 1:
        both = np.flatnonzero(text[1:] == text[:-1])
        sym[both] = np.maximum(_fingerprints(total, at[both], at[both + 1] + GRAM), _U(1))
    return at, sym


def text_ends(sym: np.ndarray) -> np.ndarray:
    """Of each place, the last place of its text."""
    last = np.flatnonzero(sym == 0)
    return last[np.searchsorted(last, np.arange(len(sym)))]


def suffix_order(sym: np.ndarray, depth: int = SORTED) -> np.ndarray:
    """Places of a shard's suffixes, sorted by their first ``depth`` phrases (a power of two); the end of a text comes first."""
    n = len(sym)
    if not n:
        return np.zeros(0, np.int64)
    end = text_ends(sym)
    rank = np.unique(sym, return_inverse=True)[1].astype(np.int64)
    k = 1
    while k < depth:
        after = np.arange(k, n + k)
        rank = rank * (n + 1) + np.where(after <= end, rank[np.minimum(after, n - 1)] + 1, 0)
        u, rank = np.unique(rank, return_inverse=True)
        if len(u) == n:
            break
        k *= 2
    return np.argsort(rank, kind="stable")


def transform(sym: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The symbol before each suffix; 0 before a text's first."""
    return np.where(order > 0, sym[order - 1], _U(0)) if len(sym) else sym


def symbols(bwt: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Undoes ``transform``."""
    sym = np.zeros(len(bwt), np.uint64)
    sym[order[order > 0] - 1] = bwt[order > 0]
    return sym


def _bucket(keys: np.ndarray, count: int) -> np.ndarray:
    """Ranges of the keys' upper halves, so buckets keep the order."""
    return (((keys >> _U(32)) * _U(count)) >> _U(32)).astype(np.int64)


def _runs_of(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal rows."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.zeros(n, bool)
    change[0] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(change)
    return at, np.diff(at, append=n)


KEYS = "bucket long, shard long, a binary, b binary, many binary"


def _sent(shard: int, bucket: np.ndarray, a: np.ndarray, b: np.ndarray | None, many: np.ndarray):
    """One row for each bucket of a shard's list, which is in the order of the buckets; ``many`` as bits if it is boolean, else as numbers of rows."""
    at, size = _runs_of(bucket)
    if len(at):
        cut = lambda x: pa.array([x[i : i + k].tobytes() for i, k in zip(at, size, strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[at]), pa.array(np.full(len(at), shard)), cut(a.astype("<u8")), cut(b.astype("<u8")) if b is not None else pa.nulls(len(at), pa.binary()),
                pa.array([np.packbits(many[i : i + k]).tobytes() for i, k in zip(at, size, strict=True)], pa.binary()) if many.dtype == bool else cut(many.astype("<u4")),
            ],
            ["bucket", "shard", "a", "b", "many"],
        )


def merge(lists: DataFrame, named: bool = True) -> DataFrame:
    """``lists`` (``KEYS``) -> (shard, replies): by bucket, a bit for each pair that several rows have, and if ``named`` the ranks and rows of these."""

    def run(batches):
        for t in runs(batches, ["bucket"]):
            a = [np.frombuffer(x, "<u8") for x in t.column("a").to_pylist()]
            sizes = [len(x) for x in a]
            many = t.column("many").to_pylist()
            own = np.frombuffer(b"".join(many), "<u4").astype(np.int64) if named else np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(many, sizes, strict=True)]).astype(np.int64) + 1
            a = np.concatenate(a)
            if t.column("b").null_count:
                order = np.argsort(a, kind="stable")
                at, size = _runs_of(a[order])
            else:
                b = np.frombuffer(b"".join(t.column("b").to_pylist()), "<u8")
                order = np.lexsort((b, a))
                at, size = _runs_of(a[order], b[order])
            rank = np.empty(len(a), "<u4")
            rank[order] = np.repeat(np.arange(len(at)), size)
            rows = np.add.reduceat(own[order], at)[rank]
            open_ = rows > 1
            ends = np.cumsum(sizes)
            bits = [np.packbits(open_[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)]
            ranks = [rank[e - n : e][open_[e - n : e]].tobytes() if named else b"" for e, n in zip(ends, sizes, strict=True)]
            counts = [rows[e - n : e][open_[e - n : e]].astype("<u4").tobytes() if named else b"" for e, n in zip(ends, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [t.column("shard").combine_chunks(), t.column("bucket").combine_chunks(), *(pa.array(x, pa.binary()) for x in (bits, ranks, counts))], ["shard", "bucket", "bits", "ranks", "counts"]
            )

    got = lists.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "shard long, bucket long, bits binary, ranks binary, counts binary")
    return got.groupBy("shard").agg(F.collect_list(F.struct("bucket", "bits", "ranks", "counts")).alias("replies"))


def _answer(bucket: np.ndarray, replies: list[dict] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a shard's list: which pairs are open, and the names and rows of the open ones."""
    count = dict(zip(*(x.tolist() for x in np.unique(bucket, return_counts=True)), strict=True))
    bits, names, rows = [np.zeros(0, bool)], [np.zeros(0, np.uint64)], [np.zeros(0, "<u4")]
    for r in sorted(replies or (), key=lambda r: r["bucket"]):
        bits.append(np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=count[r["bucket"]]).astype(bool))
        names.append((np.frombuffer(r["ranks"], "<u4").astype(np.uint64) + _U(1)) | _U(r["bucket"] << 32))
        rows.append(np.frombuffer(r["counts"], "<u4"))
    return np.concatenate(bits), np.concatenate(names), np.concatenate(rows)


def first_list(bwt: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Round 1: the first symbols of the sorted suffixes. Rank where they begin, their runs' starts and lengths, and symbols."""
    first = symbols(bwt, order)[order]
    skip = int(np.searchsorted(first, 1))
    at, size = _runs_of(first[skip:])
    return skip, at, size, first[skip:][at]


def _needed(at: np.ndarray, sym: np.ndarray, pos: np.ndarray, length: int, rounds: int) -> np.ndarray:
    """Phrases whose common prefix proves all strings that start in a place's first phrase; ``NEVER`` if the text ends before."""
    end = text_ends(sym)[pos] if len(pos) else pos
    out = np.full(len(pos), NEVER, np.uint8)
    for h in range(rounds, 0, -1):
        to = np.minimum(pos + h, end)
        enough = (pos + h <= end) & (at[to] + GRAM - at[pos] >= length + at[np.minimum(pos + 1, end)] - at[pos])
        out[enough] = h
    return out


class Rows:
    """A shard's rows of repeated intervals, in the order of its suffixes; arrays as stored between rounds.

    ``held`` and ``before`` are the rows of all shards in a row's block in its last round and the one before. Bit h of ``same`` says that those that share h
    phrases with the row are as many as those that share the h - 2 phrases behind its first.
    """

    FIELDS = (("pos", "<u4"), ("sym", "<u8"), ("succ", "<i4"), ("need", "u1"), ("name", "<u8"), ("reach", "u1"), ("held", "<u4"), ("before", "<u4"), ("same", "<u2"))

    def __init__(self, blobs):
        for (f, kind), x in zip(self.FIELDS, blobs, strict=True):
            setattr(self, f, np.frombuffer(x, kind).copy() if isinstance(x, bytes) else x.astype(kind))

    def asked(self, h: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of round ``h`` whose next suffix is open, with the starts and lengths of their runs of equal pairs."""
        at = np.flatnonzero((self.reach == h - 1) & (self.reach < self.need) & (self.succ >= 0))
        at = at[self.reach[self.succ[at]] == h - 1]
        return at, *_runs_of(self.sym[at], self.name[self.succ[at]])

    def stored(self, shard: int, h: int) -> pa.RecordBatch:
        live = len(self.asked(h + 1)[0])
        return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([live]), *(pa.array([getattr(self, f).tobytes()], pa.binary()) for f, _ in self.FIELDS)], ["shard", "live", *(f for f, _ in self.FIELDS)])


ROWS = "shard long, live long, " + ", ".join(f"{f} binary" for f, _ in Rows.FIELDS)
TABLES = "bytelode_suffixes_"


def _bucketed(df: DataFrame, count: int) -> DataFrame:
    """``df`` as a table bucketed by shard in the shared folder."""
    spark, name = df.sparkSession, TABLES + uuid.uuid4().hex
    path = f"{shared_dir(spark)}/{name}"
    df.write.bucketBy(count, "shard").sortBy("shard").option("path", path).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    out._bytelode_table, out._bytelode_path = name, path
    return out


def _drop(df: DataFrame) -> None:
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._bytelode_table}")
    remove(df.sparkSession, df._bytelode_path)


def drop_tables(spark: SparkSession) -> None:
    """Drop the shard tables of earlier calls, once their results have been written."""
    for t in spark.catalog.listTables():
        if t.name.startswith(TABLES):
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")
            remove(spark, f"{shared_dir(spark)}/{t.name}")


def shard_table(docs: DataFrame) -> tuple[DataFrame, int]:
    """Shards of ``docs`` (doc_id, whole, text binary) with their transforms, and the number of the table's buckets."""

    def cut(batches):
        number = TaskContext.get().partitionId() << 32
        for b in by_bytes(batches, "text", SHARD_BYTES):
            raw = [x or b"" for x in b.column(2).to_pylist()]
            ends = np.cumsum([len(x) for x in raw])
            text = b"".join(raw)
            at, sym = parse(np.frombuffer(text, np.uint8), ends)
            order = suffix_order(sym)
            blobs = (text, np.diff(at, prepend=0).astype("<u4").tobytes(), transform(sym, order).astype("<u8").tobytes(), order.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number]), pa.array([len(at)]), pa.array([b.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([b.column(1).to_pylist()], pa.list_(pa.bool_())),
                    pa.array([ends.tolist()], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in blobs),
                ],
                ["shard", "n", "ids", "whole", "ends", "text", "gaps", "bwt", "places"],
            )
            number += 1

    rows = docs.mapInArrow(cut, "shard long, n long, ids array<long>, whole array<boolean>, ends array<long>, text binary, gaps binary, bwt binary, places binary")
    count = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    return _bucketed(rows, count), count


def _places(gaps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(gaps, "<u4").astype(np.int64))


def refine(shards: DataFrame, tables: int, buckets: int, length: int, rounds: int = ROUNDS) -> DataFrame:
    """(``ROWS``): the rows of repeated intervals and the common prefix of each, in phrases."""

    def ask_first(batches):
        for b in batches:
            for shard, bwt, order in zip(*(c.to_pylist() for c in b.columns), strict=True):
                _, _, size, sym = first_list(np.frombuffer(bwt, "<u8"), np.frombuffer(order, "<u4").astype(np.int64))
                yield from _sent(shard, _bucket(sym, buckets), sym, None, size)

    def close_first(batches):
        for b in batches:
            for shard, bwt, order, gaps, replies in zip(*(c.to_pylist() for c in b.columns), strict=True):
                bwt, order = np.frombuffer(bwt, "<u8"), np.frombuffer(order, "<u4").astype(np.int64)
                skip, _, size, keys = first_list(bwt, order)
                open_, names, counts = _answer(_bucket(keys, buckets), replies)
                sym, pos = symbols(bwt, order), order[skip:][np.repeat(open_, size)]
                inverse = np.full(len(sym) + 1, -1)
                inverse[pos] = np.arange(len(pos))
                need = _needed(_places(gaps), sym, pos, length, rounds)
                names, counts = (np.repeat(x, size[open_]) for x in (names, counts))
                yield Rows((pos, sym[pos], inverse[pos + 1], need, names, np.ones(len(pos)), counts, np.zeros(len(pos)), np.zeros(len(pos)))).stored(shard, 1)

    listed = merge(shards.select("shard", "bwt", "places").mapInArrow(ask_first, KEYS))
    given = shards.select("shard", "bwt", "places", "gaps").join(listed, "shard", "left").select("shard", "bwt", "places", "gaps", "replies")
    state = _bucketed(given.mapInArrow(close_first, ROWS), tables)
    fields = [f for f, _ in Rows.FIELDS]
    for h in range(2, rounds + 1):
        live = state.agg(F.sum("live")).first()[0]
        if not live:
            break
        state = _round(state, h, max(1, -(-live // BUCKET_KEYS)), tables, fields)
    return state


def _round(state: DataFrame, h: int, buckets: int, tables: int, fields: list[str]) -> DataFrame:
    def ask(batches):
        for b in batches:
            for shard, *blobs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = Rows(blobs)
                at, first, size = rows.asked(h)
                sym = rows.sym[at][first]
                yield from _sent(shard, _bucket(sym, buckets), sym, rows.name[rows.succ[at]][first], size)

    def close(batches):
        for b in batches:
            for shard, *blobs, replies in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = Rows(blobs)
                at, first, size = rows.asked(h)
                open_, names, counts = _answer(_bucket(rows.sym[at][first], buckets), replies)
                stay, counts = at[np.repeat(open_, size)], np.repeat(counts, size[open_])
                rows.same[stay] |= ((rows.before[rows.succ[stay]] == counts).astype(np.uint16) << np.uint16(h)).astype(np.uint16)
                rows.before[stay], rows.held[stay] = rows.held[stay], counts
                rows.reach[stay] = h
                rows.name[stay] = np.repeat(names, size[open_])
                yield rows.stored(shard, h)

    listed = merge(state.select("shard", *fields).mapInArrow(ask, KEYS))
    given = state.select("shard", *fields).join(listed, "shard", "left").select("shard", *fields, "replies")
    after = _bucketed(given.mapInArrow(close, ROWS), tables)
    _drop(state)
    return after


def _marked(starts: np.ndarray, stops: np.ndarray, size: int) -> np.ndarray:
    """Which bytes lie in one of the ranges."""
    ok = stops > starts
    d = np.zeros(size + 1, np.int32)
    np.add.at(d, starts[ok], 1)
    np.add.at(d, stops[ok], -1)
    return np.cumsum(d[:-1]) > 0


def strings(
    at: np.ndarray, ends: np.ndarray, pos: np.ndarray, need: np.ndarray, reach: np.ndarray, same: np.ndarray, length: int, rounds: int = ROUNDS
) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes start a string that is proven to repeat, and where strings start that are compared: those that only their bytes can tell, and proven
    ones whose bytes may stand elsewhere unproven."""
    n, size = len(at), int(ends[-1]) if len(ends) else 0
    begin = np.concatenate([[0], ends[:-1]])
    prefix = np.zeros(n, np.int64)
    prefix[pos] = reach
    further = np.zeros(n, bool)
    further[pos] = (reach >= need) | (reach == rounds)
    stop = at[np.minimum(np.arange(n) + prefix, n - 1)] + GRAM if n else at
    sure = _marked(at[prefix > 0], (stop - length + 1)[prefix > 0], size)
    if n:
        text = np.searchsorted(ends, at, side="right")
        tail = np.flatnonzero(np.append(text[1:] != text[:-1], True))
        head = np.append(True, text[1:] != text[:-1])
        last = tail[np.searchsorted(tail, np.arange(n))]
        breaks = np.arange(n) + prefix + 1
        # the first phrase start that would break the chain must lie behind the last gram of the string
        limit = np.where(further | (breaks > last), size, at[np.minimum(breaks, n - 1)] - (length - GRAM + 1))
        lo = np.where(head, begin[text], np.append(0, at[:-1]) + 1)
        hi = np.minimum(np.minimum(at, limit), ends[text] - length)
        # behind the last start of a text, and in texts without starts, strings hold no phrase
        rest = begin.copy()
        rest[text[tail]] = at[tail] + 1
        lo, hi = np.concatenate([lo, rest]), np.concatenate([hi, ends - length])
    else:
        lo, hi = begin, ends - length
    known = np.flatnonzero(sure)
    alike = np.zeros(n + 1, np.int64)
    alike[pos] = same
    before = np.searchsorted(at, known) - 1  # the phrase start before a string; none is the last place, which has no bits
    apart = np.searchsorted(at, known + (length - GRAM)) - before  # phrases from there to behind the string
    alone = (alike[before] >> np.minimum(apart, rounds + 1)) & 1 == 1
    asked = _marked(lo, hi + 1, size)
    asked[known] = ~alone
    return sure, np.flatnonzero(asked)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, starts, stops (arrays of byte offsets), kept (binary).

    Every byte in a string of ``length`` bytes (at least ``GRAM``) that also starts anywhere else, in the same text too,
    is in a span; spans are maximal and are judged on the input. Null texts are empty; rows that share a doc_id are
    separate texts; other columns are ignored; no rows give no rows. The result reads two tables of the shared folder,
    which ``drop_tables`` removes.
    """
    raw = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("text")).withColumn("h", F.md5("text"))
    copies = materialize(
        raw.filter(F.octet_length("text") >= length).groupBy("h").agg(F.count("*").alias("k"), F.min("doc_id").alias("first")).filter("k > 1").select("h", "first"),
        "copies",
    )
    if copies.count() <= BROADCAST_TEXTS:
        raw = raw.join(F.broadcast(copies), "h", "left").withColumn("whole", F.col("first").isNotNull())
    else:
        raw = raw.withColumn("first", F.lit(None).cast("long")).withColumn("whole", F.lit(False))
    # of equal whole texts one goes on, to be found by others; all are covered from end to end
    stays = ~F.col("whole") | F.col("doc_id").eqNullSafe(F.col("first"))
    shards, tables = shard_table(raw.filter(stays).select("doc_id", "whole", "text"))
    buckets = max(1, -(-(shards.agg(F.sum("n")).first()[0] or 0) // BUCKET_KEYS))
    rows = refine(shards, tables, buckets, length)

    def listed(text: bytes, ends: list[int], gaps: bytes, pos: bytes, need: bytes, reach: bytes, same: bytes):
        """Proven starts, candidates, and the candidates' buckets and fingerprints in the order they are sent in."""
        kinds = [np.frombuffer(x, k).astype(np.int64) for x, k in ((pos, "<u4"), (need, "u1"), (reach, "u1"), (same, "<u2"))]
        sure, at = strings(_places(gaps), np.array(ends, np.int64), *kinds, length)
        buf = np.frombuffer(text, np.uint8)
        key = _fingerprints(_prefix(buf), at, at + length)
        bucket = _bucket(_fingerprints(_prefix(buf, _SECOND), at, at + length), buckets)
        order = np.lexsort((key, bucket))
        return sure, at[order], bucket[order], key[order]

    def ask(batches):
        for big in batches:
            for i in range(big.num_rows):
                shard, *args = (c[i].as_py() for c in big.columns)
                _, _, bucket, key = listed(*args)
                at, size = _runs_of(bucket, key)
                yield from _sent(shard, bucket[at], key[at], None, size > 1)

    def cut(batches):
        for big in batches:
            for i in range(big.num_rows):
                text, *args, replies, ids, whole = (c[i].as_py() for c in big.columns[1:])
                ends, size = args[0], len(text)
                sure, at, bucket, key = listed(text, *args)
                first, n = _runs_of(bucket, key)
                open_, *_ = _answer(bucket[first], replies)
                sure[at[np.repeat(open_, n)]] = True
                starts = np.flatnonzero(sure)
                gone = _marked(starts, starts + length, size)
                out: list[list] = [[] for _ in range(5)]
                buf = np.frombuffer(text, np.uint8)
                for doc, all_, a, e in zip(ids, whole, [0, *ends[:-1]], ends, strict=True):
                    g = np.ones(e - a, bool) if all_ else gone[a:e]
                    d = np.diff(np.concatenate([[False], g, [False]]).view(np.int8))
                    row = (doc, e - a, np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist(), buf[a:e][~g].tobytes())
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.binary())],
                    ["doc_id", "n_bytes", "starts", "stops", "kept"],
                )

    fields = ["shard", "text", "ends", "gaps", "pos", "need", "reach", "same"]
    before = shards.select("shard", "text", "ends", "gaps", "ids", "whole").join(rows.select("shard", "pos", "need", "reach", "same"), "shard")
    shared = merge(before.select(*fields).mapInArrow(ask, KEYS), named=False)
    done = before.join(shared, "shard", "left").select(*fields, "replies", "ids", "whole")
    found = done.mapInArrow(cut, "doc_id long, n_bytes long, starts array<long>, stops array<long>, kept binary")
    n = F.octet_length("text").cast("long")
    rest = raw.filter(~stays).select(
        "doc_id", n.alias("n_bytes"), F.array(F.lit(0).cast("long")).alias("starts"), F.array(n).alias("stops"), F.lit("").cast("binary").alias("kept")
    )
    return found.unionByName(rest)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
