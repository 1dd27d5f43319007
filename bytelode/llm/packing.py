"""Mixture-controlled packing of tokenized documents into fixed windows.

Every source is a queue of documents, and deficit round-robin serves the queues. A packet is a document, or each ``packet`` tokens of a longer
one, a small part of a window, so that a window has room for packets of many sources. In a round a queue's deficit grows by its quantum, its target share of a window; while the packet at its head is not longer than
the deficit, it is served and the deficit shrinks by its length. What is left of the deficit is carried to the next round. The packets in
the order of their service are one stream of tokens, cut into windows: a document is cut between its packets and at window borders only,
what adjoins stays one piece, and at any time a queue has been served its target share to within one packet.

A deficit that is carried is the quantum times the rounds so far less the tokens served, so a packet that ends the first ``C`` tokens of its queue leaves in
round ``ceil(C / quantum)``. ``C`` needs the tokens of a queue in the partitions before: these carry over by a prefix sum over one row a partition and
queue. The place in the stream is a prefix sum over the packets, which are spread by range over (round, queue, C): each range sums
its own, and the sums of the ranges before are carried over. Only packets without their ids are sorted; ids join them at the end.

Targets are token shares: those of the corpus by default, so the mixture lasts to the last window, or given weights,
where the others go on at their proportions when a queue runs dry. Queues with less than one token a window share a common
queue, so at most ``window`` + 1 queues exist whatever the number of sources.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from bytelode.llm._shared import by_bytes, materialize, table

WINDOW = 2048
#: Packets in a window.
PACKETS = 12
END_ID = 1
#: Characters that ``str.split`` takes for white space and the tokenizer doesn't.
SEPARATORS = "[\x1c-\x1f]"
CACHED_WORDS = 2_000_000
REST = "\0rest"
#: Last round; only weights below about 1e-10 of the others reach it.
LAST = 1 << 62


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The parts of a tokenizer file under which words can be encoded one by one.
WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


#: How byte-level tokenizers write the bytes of a letter that is not ASCII: 0x80 to 0xA0 and 0xAD follow 255 + 34 bytes that come before.
BYTE_LETTERS = {0x80 + i: 290 + i for i in range(33)} | {0xAD: 323}
#: Letters for which lower-casing and normalization act letter by letter.
LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"


_BYTE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        p = np.full(n + n // 2 + 1, base, np.uint64)
        p[0] = 1
        _POWERS[base] = np.multiply.accumulate(p)
    return _POWERS[base][:n]


def word_hashes(words: pa.StringArray) -> np.ndarray:
    """64-bit hashes of the words' bytes and lengths."""
    if not len(words):
        return np.zeros(0, np.uint64)
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    buf = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _powers(_BASE, len(buf)), out=total[1:])
    x = (total[ends[1:]] - total[ends[:-1]]) * _powers(pow(_BASE, -1, 1 << 64), len(buf) + 1)[ends[:-1]] + np.diff(ends).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordTokens:
    """Ids of texts, each distinct word tokenized once while it is cached.

    A tokenizer with the rules of ``WORD_RULES`` starts a new piece at any white space, and between a letter and a last stop or
    comma, so texts can be encoded word by word, a word of letters by the model alone. Others encode whole texts. The cache is a
    sorted array of 64-bit word hashes with the places of their ids; two of a million words share a hash with a chance of 3e-8.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.by_word = {k: spec[k] for k in WORD_RULES} == WORD_RULES and spec["model"]["type"] == "BPE"
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self._clear()

    def _clear(self) -> None:
        self.keys, self.codes = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.starts, self.lengths, self.used = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint8)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Codes of cached words, -1 for others."""
        if not len(self.keys):
            return np.full(len(hashes), -1, np.int32)
        order = np.argsort(hashes)  # sorted look-ups stay in the processor's caches
        at = np.empty(len(hashes), np.int64)
        at[order] = np.searchsorted(self.keys, hashes[order])
        at = np.minimum(at, len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.codes[at], np.int32(-1))

    def _add(self, hashes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Cache new words; a hash that is given twice is cached once."""
        hashes, first = np.unique(hashes, return_index=True)
        starts = len(self.ids) + np.cumsum(lengths) - lengths
        at = np.searchsorted(self.keys, hashes)
        self.codes = np.insert(self.codes, at, len(self.lengths) + first)
        self.keys = np.insert(self.keys, at, hashes)
        for name, more in (("ids", ids), ("starts", starts), ("lengths", lengths), ("used", np.zeros(len(lengths), np.uint8))):
            old = getattr(self, name)
            setattr(self, name, np.concatenate([old, more.astype(old.dtype)]))

    def _learn(self, words: pa.StringArray, hashes: np.ndarray) -> None:
        # a word is a head, lower-cased if it is all letters, and perhaps a stop; different heads are encoded once
        apart = pc.match_substring_regex(words, f"{LETTER}[.,]$")
        heads = pc.if_else(apart, pc.utf8_slice_codeunits(words, 0, -1), words)
        heads = pc.if_else(pc.match_substring_regex(heads, f"^{LETTER}+$"), pc.utf8_lower(heads), heads)
        stops = pc.if_else(apart, pc.utf8_slice_codeunits(words, -1, len(words) + 1), "")
        parts = pa.concat_arrays([heads, stops]).dictionary_encode()
        fresh = parts.dictionary
        own = word_hashes(fresh)
        code = self._find(own).astype(np.int64)
        plain = np.asarray(pc.match_substring_regex(fresh, f"^{LETTER}+$"))
        text = lambda at: fresh.take(pa.array(at)).to_numpy(zero_copy_only=False).tolist()
        lower, other = np.flatnonzero((code < 0) & plain), np.flatnonzero((code < 0) & ~plain)
        encode = self.tokenizer.model.tokenize
        found = [[t.id for t in encode(w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_LETTERS))] for w in text(lower)]
        got = self.tokenizer.encode(text(other), is_pretokenized=True, add_special_tokens=False)
        counts = np.bincount(np.array(got.word_ids, np.int64), minlength=len(other)) if got.ids else np.zeros(len(other), np.int64)
        ids = np.fromiter(itertools.chain(itertools.chain.from_iterable(found), got.ids), np.uint32)
        lengths = np.concatenate([np.fromiter(map(len, found), np.int64, len(found)), counts])
        new = np.concatenate([lower, other])
        code[new] = len(self.lengths) + np.arange(len(new))
        # behind what is cached, the new heads and then the words: the ids of the head and of the stop
        flat, starts = np.concatenate([self.ids, ids]), np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        sizes = np.concatenate([self.lengths, lengths])
        each = code[np.asarray(parts.indices)].reshape(2, -1).T.ravel()
        n = sizes[each]
        self._add(np.concatenate([own[new], hashes]), np.concatenate([ids, _gather(flat, starts[each], n)]), np.concatenate([lengths, n.reshape(-1, 2).sum(axis=1)]))

    def _shrink(self) -> None:
        """Forget the words that no two batches had; all if that leaves many."""
        kept = self.used[self.codes] > 1
        if kept.sum() > CACHED_WORDS // 2:
            return self._clear()
        keys, old = self.keys[kept], self.codes[kept]
        ids, lengths = _gather(self.ids, self.starts[old], self.lengths[old]), self.lengths[old]
        self._clear()
        self._add(keys, ids, lengths)

    def _words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts in a row, and the number of each text."""
        odd = pc.match_substring_regex(texts, SEPARATORS)
        if not pc.any(odd).as_py():
            lists = pc.utf8_split_whitespace(texts)
            return lists.flatten(), np.asarray(pc.list_value_length(lists), np.int64)
        found, counts = [], []
        at, size = _runs_of_flags(np.asarray(odd))
        for i, n in zip(at, size, strict=True):
            if odd[i].as_py():
                lists = pa.array([re.split("[ \\t\\n\\r]+", t) for t in texts.slice(i, n).to_pylist()], pa.list_(texts.type))
            else:
                lists = pc.utf8_split_whitespace(texts.slice(i, n))
            found.append(lists.flatten())
            counts.append(np.asarray(pc.list_value_length(lists), np.int64))
        return pa.concat_arrays(found), np.concatenate(counts)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` (strings without nulls) in a row, and the number of each text, its end id included."""
        if not self.by_word:
            each = [e.ids + [end_id] for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for ids in each for i in ids], "<u4"), np.array([len(ids) for ids in each], np.int64)
        if len(self.keys) > CACHED_WORDS:
            self._shrink()
        words, counts = self._words(texts)
        words = words.dictionary_encode()
        hashes = word_hashes(words.dictionary)
        codes = self._find(hashes)
        if (codes < 0).any():
            new = np.flatnonzero(codes < 0)
            self._learn(words.dictionary.take(pa.array(new)), hashes[new])
            codes = self._find(hashes)
        self.used[codes] += self.used[codes] < 2
        codes = codes[np.asarray(words.indices)]
        n = self.lengths[codes]
        total = np.concatenate([[0], np.cumsum(n)])
        body, stops = _gather(self.ids, self.starts[codes], n), total[np.cumsum(counts)]
        return np.insert(body, stops, end_id).astype("<u4"), np.diff(stops, prepend=0) + 1


def _runs_of_flags(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.append(True, flags[1:] != flags[:-1]))
    return at, np.diff(at, append=len(flags))


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return flat[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)]


#: Word tokens by tokenizer, kept while a Python worker lives.
_WORDS: dict[str, WordTokens] = {}


TOKENS = "doc_id long, queue string, part int, row int, at long, n long, ids binary"


def tokenize(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, queue, part, row, at, n, ids: ``at`` counts the ids of the same queue that precede in the same partition."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        words = _WORDS.get(path) or _WORDS.setdefault(path, WordTokens(path))
        part, row = TaskContext.get().partitionId(), 0
        served: dict[str, int] = {}
        for b in by_bytes(batches, "text", 4 << 20):
            ids, counts = words.encode(pc.fill_null(b.column(2), ""), end_id)
            raw = ids if words.wide else ids.astype("<u2")
            ends = np.cumsum(counts)
            queues, at = b.column(1).to_pylist(), []
            for q, n in zip(queues, counts.tolist(), strict=True):
                at.append(served.get(q, 0))
                served[q] = at[-1] + n
            blobs = [raw[e - n : e].tobytes() for e, n in zip(ends, counts, strict=True)]
            rows = pa.array(range(row, row + len(at)), pa.int32())
            row += len(at)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(queues, pa.string()), pa.array([part] * len(at), pa.int32()), rows, pa.array(at, pa.int64()), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())],
                ["doc_id", "queue", "part", "row", "at", "n", "ids"],
            )

    rows = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("queue"), "text")
    return materialize(rows.mapInArrow(run, TOKENS), "tokens")


PIECES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    + [T.StructField("ids", T.BinaryType())]
)


def lanes_of(tokens: DataFrame, window: int, weights: dict[str, float] | None) -> tuple[DataFrame, dict[str, int]]:
    """(part, queue, lane, base): the lane's tokens before this queue's in this partition; and the totals of the lanes.

    Without weights there are at most ``window`` + 1 lanes.
    """
    sums = materialize(tokens.groupBy("part", "queue").agg(F.sum("n").alias("n")), "sums")
    total = sums.agg(F.sum("n")).first()[0] or 0
    by_queue = sums.groupBy("queue").agg(F.sum("n").alias("n"))
    own = F.col("queue").isin(list(weights)) if weights else F.col("n") * window >= total
    big = {r["queue"]: r["n"] for r in by_queue.filter(own).toLocalIterator()}
    rest = total - sum(big.values())
    lane_of_rest = REST
    if big and not weights and rest * window < total:
        lane_of_rest = min(big, key=lambda q: (big[q], q))
    if rest:
        big[lane_of_rest] = big.get(lane_of_rest, 0) + rest
    lane = F.when(F.col("queue").isin([q for q in big if q != REST]), F.col("queue")).otherwise(F.lit(lane_of_rest))
    laned = sums.withColumn("lane", lane)
    earlier = W.rowsBetween(W.unboundedPreceding, -1)
    carried = lambda over: F.coalesce(F.sum("n").over(over), F.lit(0).cast("long"))
    # a lane's partitions in a row, then the queues of one partition, so no window gathers more than a row a partition
    parts = laned.groupBy("lane", "part").agg(F.sum("n").alias("n"))
    parts = parts.select("lane", "part", carried(earlier.partitionBy("lane").orderBy("part")).alias("before"))
    inside = laned.select("part", "queue", "lane", carried(earlier.partitionBy("lane", "part").orderBy("queue")).alias("inner"))
    return inside.join(parts, ["lane", "part"]).select("part", "queue", "lane", (F.col("before") + F.col("inner")).alias("base")), big


def quanta(totals: dict[str, int], window: int, weights: dict[str, float] | None = None) -> dict[str, Fraction]:
    """Tokens a lane may be served a round: its share of a window, 0 for a lane that waits for all others."""
    if weights and any(weights.get(k, 0) for k in totals):
        w = {k: Fraction(weights.get(k, 0)) for k in totals}
    else:
        w = {k: Fraction(n) for k, n in totals.items()}
    total = sum(w.values())
    return {k: window * x / total for k, x in w.items()}


def _packets(rows: DataFrame, totals: dict[str, int], window: int, weights: dict[str, float] | None, packet: int) -> DataFrame:
    """``rows`` (part, row, lane, x0, n) -> part, row, k, size, lane, round, stop: the packets, and the round each is served in."""
    each = quanta(totals, window, weights)
    last = max((-(-totals[k] * q.denominator // q.numerator) for k, q in each.items() if q), default=0)
    # a lane without a quantum comes behind the last round of the others
    plan = {k: (i, q.numerator or window, q.denominator, 0 if q else last) for i, (k, q) in enumerate(sorted(each.items()))}

    def run(batches):
        for b in batches:
            out: list[list[int]] = [[] for _ in range(7)]
            for part, row, lane, x0, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                i, top, bottom, first = plan[lane]
                for k, at in enumerate(range(0, n, packet)):
                    size = min(packet, n - at)
                    stop = x0 + at + size
                    for c, v in zip(out, (part, row, k, size, i, min(first + -(-stop * bottom // top), LAST), stop), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["part", "row", "k", "size", "lane", "round", "stop"])

    return rows.mapInArrow(run, "part long, row long, k long, size long, lane long, round long, stop long")


def _stream(packets: DataFrame) -> DataFrame:
    """(part, row, places): where the packets of each row start in the stream, in their order."""

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            ends = at + np.cumsum(np.asarray(b.column(3)))
            if len(ends):
                at = int(ends[-1])
                begin = pa.array(ends - np.asarray(b.column(3)))
                yield pa.RecordBatch.from_arrays([*b.columns[:4], begin, pa.array([part] * len(ends), pa.int64())], ["part", "row", "k", "size", "begin", "range"])

    order = ["round", "lane", "stop"]
    ranged = packets.repartitionByRange(*order).sortWithinPartitions(*order).select("part", "row", "k", "size")
    placed = materialize(ranged.mapInArrow(run, "part long, row long, k long, size long, begin long, range long"), "stream")
    sums = placed.groupBy("range").agg(F.sum("size").alias("n"))  # one row a task
    before = sums.select("range", F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("base"))
    placed = placed.join(F.broadcast(before), "range").select("part", "row", F.struct("k", (F.col("base") + F.col("begin")).alias("place")).alias("p"))
    return placed.groupBy("part", "row").agg(F.sort_array(F.collect_list("p"))["place"].alias("places"))


def pack(docs: DataFrame, window: int = WINDOW, weights: dict[str, float] | None = None, tokenizer: str | None = None, end_id: int = END_ID, with_ids: bool = True, packet: int | None = None) -> DataFrame:
    """Pieces of ``docs`` (doc_id, source, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Each row's ids and ``end_id`` are cut into pieces that fill sequences of ``window`` tokens without gaps; only the last
    sequence is shorter. A null text has only ``end_id``; null and empty sources are one queue; repeated rows are packed
    again, rows without doc_id too; other columns are ignored; no rows give no pieces. With ``weights``, sources without a weight
    share the rest queue, which is served after all others. ``ids`` holds little-endian unsigned 32-bit ids. ``packet`` is the most tokens a
    source is served at a time, by default a window's ``PACKETS``-th part: smaller ones bring each window nearer to its targets and cut
    documents into more pieces.
    """
    packet = packet or max(1, window // PACKETS)
    tokens = tokenize(docs, tokenizer, end_id)
    offsets, totals = lanes_of(tokens, window, weights)
    size = 4 if _wide(tokenizer) else 2
    rows = tokens.select("part", "row", "queue", "at", "n").join(offsets, ["part", "queue"]).select("part", "row", "lane", (F.col("base") + F.col("at")).alias("x0"), "n")
    places = _stream(_packets(rows, totals, window, weights, packet))

    def cut(batches):
        for b in by_bytes(batches, "ids", 2 << 20):
            out: list[list] = [[] for _ in range(8)]
            blobs = b.column(3)
            for i, (doc, n, at) in enumerate(zip(*(b.column(j).to_pylist() for j in range(3)), strict=True)):
                ids = np.frombuffer(blobs[i].as_buffer(), f"<u{size}").astype("<u4").tobytes()
                for x, g, length in pieces_of(at, n, window, packet):
                    piece = ids[4 * x : 4 * (x + length)]
                    for c, v in zip(out, (doc, x, length, zlib.crc32(piece), n, g // window, g % window, piece if with_ids else None), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:7]), pa.array(out[7], pa.binary())], PIECES.names)

    return tokens.join(places, ["part", "row"]).select("doc_id", "n", "places", "ids").mapInArrow(cut, PIECES)


def pieces_of(places: list[int], n: int, window: int, packet: int | None = None) -> Iterator[tuple[int, int, int]]:
    """(start in the document, place in the stream, length) of its packets, cut at window borders; what adjoins stays one piece."""
    packet = packet or window
    start = place = length = 0
    for k, g in enumerate(places):
        size = min(packet, n - k * packet)
        at = k * packet
        if length and (g != place + length or g % window == 0):
            yield start, place, length
            length = 0
        if not length:
            start, place = at, g
        while size:
            room = window - (place + length) % window
            take = min(room, size)
            length += take
            size -= take
            at += take
            if size:
                yield start, place, length
                start, place, length = at, place + length, 0
    if length:
        yield start, place, length


def _wide(tokenizer: str | None) -> bool:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer or default_tokenizer()).get_vocab_size() > 1 << 16


def op5_mixture_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return pack(docs, with_ids=False).drop("ids")
