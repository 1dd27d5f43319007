"""Best-fit decreasing packing of tokenized documents into as few sequences as it can.

Best-fit decreasing places pieces from the longest to the shortest, each in the open sequence with the least room that holds it. A segment
tree over the remaining capacities finds that room in logarithmic time. Pieces of one length are alike and so are sequences with
equal room, so the tree's leaves hold groups of sequences, and a step places a whole run of equal pieces: the sequence that took one of them is the tightest for
the next, until it has no more room for them. The plan is the same as piece by piece, but its size depends on the window alone, whatever the number of
documents: it is made from one count a length (at most ``WINDOW`` of them), and no task sees the documents in a row.

The plan says which ranks of each length go where. A piece's rank is a prefix sum: pieces of the same length before it in its partition, and in the
partitions before. Lengths that a third of all pieces share need no care, since ranks come from counts and no group is gathered.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bytelode.llm._shared import by_bytes, materialize, table
from bytelode.llm.blocks import byte_lists, text_bytes
from bytelode.llm.packing import BYTE_LETTERS, WINDOW, WordTokens

END_ID = 0
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
#: How byte-level tokenizers write bytes that are no printable letters.
BYTE_NAMES = {i: 256 + i for i in range(33)} | {127: 289} | BYTE_LETTERS
#: The endings that the tokenizer cuts off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _classes() -> np.ndarray:
    """The class of each code point up to U+FFFF; unassigned ones are unknown."""
    major = {"L": LETTER, "N": NUMBER, "C": OTHER, "M": OTHER, "P": OTHER, "S": OTHER, "Z": SPACE}
    found = np.array([UNKNOWN if (k := unicodedata.category(chr(c))) in ("Cn", "Cs") else major[k[0]] for c in range(1 << 16)], np.uint8)
    found[9:14] = SPACE
    found[0x85] = SPACE
    return found


class PieceTokens(WordTokens):
    """Ids of texts by a byte-level tokenizer, each distinct pre-token merged once while it is cached.

    Pre-tokens are cut with array operations over all characters of a block: runs of letters, of numbers and of others, each with one space
    before it, apostrophe endings, and white space. A text with an added token or with characters beyond the known classes goes to the tokenizer whole,
    and so does every text if the tokenizer isn't of this kind.
    """

    RULES = {
        "normalizer": None,
        "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
        "post_processor": None,
    }

    def __init__(self, path: str):
        import json

        super().__init__(path)
        spec = json.loads(self.tokenizer.to_str())
        self.by_word = {k: spec[k] for k in self.RULES} == self.RULES and spec["model"]["type"] == "BPE"
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.classes = _classes()

    def _learn(self, words: pa.Array, hashes: np.ndarray) -> None:
        merge = self.tokenizer.model.tokenize
        found = [[t.id for t in merge(w.decode("latin-1").translate(BYTE_NAMES))] for w in byte_lists(words)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self._add(hashes, np.fromiter((i for ids in found for i in ids), np.uint32, lengths.sum()), lengths)

    def _characters(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each character starts and its class."""
        at = np.flatnonzero((data & 0xC0) != 0x80)
        lead = data[at]
        kind = self.classes[lead]
        wide = np.flatnonzero(lead >= 0x80)
        if len(wide):
            padded = np.append(data, np.zeros(3, np.uint8)).astype(np.int64)
            p, b = at[wide], lead[wide].astype(np.int64)
            two = (b & 0x1F) << 6 | padded[p + 1] & 0x3F
            three = (b & 0x0F) << 12 | (padded[p + 1] & 0x3F) << 6 | padded[p + 2] & 0x3F
            kind[wide] = np.where(b >= 0xF0, UNKNOWN, self.classes[np.where(b < 0xE0, two, three)])
        return at, kind

    def _words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All pre-tokens in a row, and the number of each text; texts hold known characters only."""
        data, ends = text_bytes(texts)
        at, kind = self._characters(data)
        if not len(at):
            return pa.array([], pa.binary()), np.zeros(len(texts), np.int64)
        char = data[at]
        begins = np.searchsorted(at, ends)  # the first character of each text, and their number
        first = np.zeros(len(at) + 4, bool)
        first[begins] = True
        first[len(at) :] = True
        before = np.empty_like(kind)
        before[0], before[1:] = UNKNOWN, kind[:-1]
        before[first[: len(at)]] = UNKNOWN
        spaced = np.append(False, char[:-1] == 32) & (before == SPACE)
        start = np.where(kind == SPACE, before != SPACE, (kind != before) & ~spaced)
        # of white space before something else the last character stands apart
        last = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1 : len(at)]
        start[:-1] |= last
        marks = np.flatnonzero(start & (char == 39))
        text = np.append(char, np.zeros(4, np.uint8))
        flags = np.append(start, np.ones(4, bool))
        for ending in ENDINGS:
            hit = marks
            for i, c in enumerate(ending, 1):
                hit = hit[(text[hit + i] == ord(c)) & ~first[hit + i]]
            for i in range(1, len(ending) + 1):
                flags[hit + i] = False
            flags[hit + len(ending) + 1] = True
        starts = np.flatnonzero(flags[: len(at)])
        places = np.append(at[starts], len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data)])
        return pieces, np.diff(np.searchsorted(starts, begins))

    def _odd(self, texts: pa.Array) -> np.ndarray:
        """Texts that the tokenizer must see whole."""
        odd = np.zeros(len(texts), bool)
        for t in self.added:
            odd |= np.asarray(pc.match_substring(texts, t))
        data, ends = text_bytes(texts)
        at, kind = self._characters(data)
        strange = at[kind == UNKNOWN]
        odd[np.searchsorted(ends, strange, side="right") - 1] = True
        return odd

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        odd = self._odd(texts) if self.by_word else np.zeros(len(texts), bool)
        if not odd.any():
            return super().encode(texts, end_id)
        ids, counts = [], []
        for i in range(len(texts)):
            if odd[i]:
                ids.append(np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids + [end_id], "<u4"))
                counts.append([len(ids[-1])])
            elif i == 0 or odd[i - 1]:
                stop = i + 1
                while stop < len(texts) and not odd[stop]:
                    stop += 1
                found, n = super().encode(texts.slice(i, stop - i), end_id)
                ids.append(found)
                counts.append(n)
        return np.concatenate(ids), np.concatenate(counts).astype(np.int64)


#: Tokens by tokenizer, kept while a Python worker lives.
_TOKENS: dict[str, PieceTokens] = {}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long, ids binary"


def pieces(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text), whose ``place`` counts the pieces of the same length before it in the same partition.

    A document of more than ``window`` tokens is cut into full windows from its end, so only its first piece may be shorter.
    """
    path = tokenizer or default_tokenizer()

    def run(batches):
        tokens = _TOKENS.get(path) or _TOKENS.setdefault(path, PieceTokens(path))
        part = TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        for b in by_bytes(batches, "text", 4 << 20):
            ids, counts = tokens.encode(pc.fill_null(b.column(1), ""), end_id)
            each = -(-counts // window)
            row = np.repeat(np.arange(len(counts)), each)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            head = (counts - 1) % window + 1
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * window)
            length = np.where(piece == 0, head[row], window)
            at = np.repeat(np.cumsum(counts) - counts, each) + start
            raw = memoryview(np.ascontiguousarray(ids, "<u4").tobytes())
            cut = [raw[4 * x : 4 * (x + n)] for x, n in zip(at.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            runs = np.append(0, np.cumsum(np.bincount(length, minlength=window + 1)))[length[order]]
            place = np.empty(len(row), np.int64)
            place[order] = np.arange(len(row)) - runs + seen[length[order]]
            seen += np.bincount(length, minlength=window + 1)
            blobs = [bytes(c) for c in cut] if with_ids else [None] * len(cut)
            columns = [b.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(c) for c in cut], pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.full(len(row), part), pa.int32()), pa.array(place), pa.array(blobs, pa.binary())], [f.split()[0] for f in PIECES.split(", ")]
            )

    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES), "pieces")


class Rooms:
    """A segment tree over remaining capacities; each leaf holds the groups of open sequences with that much room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.size)
        self.groups: dict[int, deque] = {}

    def put(self, room: int, first: int, n: int, ahead: bool = False) -> None:
        """``n`` sequences from number ``first`` on have ``room`` left."""
        if room and n:
            held = self.groups.setdefault(room, deque())
            held.appendleft((first, n)) if ahead else held.append((first, n))
            i = room + self.size
            while i and not self.tree[i]:
                self.tree[i] = 1
                i >>= 1

    def take(self, need: int) -> tuple[int, int, int] | None:
        """(room, first, n): a group with the least room of at least ``need``, taken out."""
        i = need + self.size
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.size
        held = self.groups[room]
        first, n = held.popleft()
        if not held:
            self.tree[i] = 0
            while i > 1 and not self.tree[i ^ 1]:
                i >>= 1
                self.tree[i] = 0
        return room, first, n


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces a sequence, first sequence, offset) that place ``counts`` pieces of each length by best-fit decreasing."""
    rooms, runs, opened = Rooms(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            group = rooms.take(length)
            if group is None:
                group = (capacity, opened, -(-left // (capacity // length)))
                opened += group[2]
            room, first, n = group
            each = room // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, each, first, capacity - room))
                rooms.put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left < each:
                # the last sequence gets what is left, if anything; the others stay as they are
                if left:
                    runs.append((length, rank, left, first + full, capacity - room))
                    rooms.put(room - left * length, first + full, 1)
                rooms.put(room, first + full + bool(left), n - full - bool(left), ahead=True)
                left = 0
    return runs


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids.

    A document is its text's ids and ``end_id``. One of up to ``window`` tokens is one piece; a longer one is cut into full windows, but for its
    first piece. Sequences hold at most ``window`` tokens, without gaps, and are numbered from 0. A null or empty text has only ``end_id``;
    repeated rows are packed again, rows without doc_id too; equal lengths are served in the order of partitions and rows. Other columns are
    ignored; no rows give no pieces. ``ids`` holds little-endian unsigned 32-bit ids, null without ``with_ids``.
    """
    cut = pieces(docs, window, tokenizer, end_id, with_ids)
    sums = materialize(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``window`` rows
    runs = np.array(sorted(best_fit(counts, window)), np.int64).reshape(-1, 5)
    keys = runs[:, 0] << 44 | runs[:, 1]
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]

    def place(batches):
        for b in batches:
            length, rank = np.asarray(b.column(3)), np.asarray(b.column(6))
            run = runs[np.searchsorted(keys, length << 44 | rank, side="right") - 1] if len(length) else runs[:0]
            nth = rank - run[:, 1]
            sequence, offset = run[:, 3] + nth // run[:, 2], run[:, 4] + nth % run[:, 2] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset), b.column(5)], [*names[:5], "sequence_id", "offset", "ids"])

    ranked = cut.join(before, ["part", "length"]).select(*names, (F.col("base") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary")


def op11_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False).drop("ids")
