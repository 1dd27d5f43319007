"""Grouping of spelling variants: words one code point apart, found by forward and backward minimal acyclic automata.

If two words differ by one inserted, deleted or replaced code point, the place of the difference lies in one half of the shorter word, and the other
half stands exactly in both. So words are dealt twice, by their first ``EDGE`` code points and by their last ones, which any pair shares in one of
the two. A task builds the minimal acyclic automaton of a group's words, forward or reversed, with the number of words before each edge: walking
a word adds up its perfect-hash number, which is its place in the sorted group. Each word walks its exact half, and completes the rest with one error: at
every later state it leaves its own path by one deletion, or by an edge of a larger code point. Of several places that give the same pair only the
last one in the word counts, and its half decides which direction reports the pair, so each pair is found once.

A group of more than ``LIMIT`` code points, and words of more than ``LONG``, are never gathered: the range of places where the
difference may lie is halved, words are dealt by all that stands outside it, and groups of one word are dropped, until the rest is small. A
group whose range is one place holds at most two free code points of a fixed alphabet, so this ends. Automata then hold the ranges alone.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelode.llm._shared import by_bytes, discard, materialize, runs, table
from bytelode.llm.blocks import byte_lists, words_of
from bytelode.llm.resampling import CRC_TABLE, crc_sql

LEAST_LENGTH = 7
LEAST_COUNT = 2
FACTOR = 10
EVERY = 31
EDGE = 3
#: Code points of a group that one task turns into an automaton.
LIMIT = 1_000_000
#: Code points of a word that is dealt whole.
LONG = 64
#: Into how many parts the words of a group are dealt where they only meet the group's size.
PARTS = 16
BLOCK = 8 << 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _in_run(data: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and U+00C0 to U+00FF, which are 0xC3 and a byte."""
    lead = data == 0xC3
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    return inside


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, every: int = EVERY) -> DataFrame:
    """(word, n) of ``docs`` (doc_id, text): their runs of letters, of which every so many lose a code point, counted a block."""

    def run(batches):
        for b in by_bytes(batches, "text", BLOCK):
            words, counts = words_of(pc.fill_null(b.column(1), ""), _in_run)
            length = pc.utf8_length(words.cast(pa.string()))
            long_ = np.asarray(pc.greater_equal(length, least_length))
            doc = np.repeat(np.arange(len(counts)), counts)[long_]
            encoded = words.filter(pa.array(long_)).dictionary_encode()
            if not len(doc):
                continue
            names = byte_lists(encoded.dictionary)
            both, n = np.unique(doc * len(names) + np.asarray(encoded.indices), return_counts=True)
            of, word = both // len(names), both % len(names)
            first = [None if d is None else zlib.crc32(b"%d:" % d) for d in b.column(0).to_pylist()]
            ids = word.tolist()
            hashes = [1 if first[d] is None else zlib.crc32(names[w], first[d]) for d, w in zip(of.tolist(), ids, strict=True)]
            hit = np.array(hashes) % every == 0
            kept = np.bincount(word[~hit], n[~hit], len(names)).astype(np.int64)
            out, sums = [w.decode() for w, k in zip(names, kept, strict=True) if k], kept[kept > 0].tolist()
            for i in np.flatnonzero(hit).tolist():
                text = names[ids[i]].decode()
                at = hashes[i] % len(text)
                if len(text) > least_length:
                    out.append(text[:at] + text[at + 1 :])
                    sums.append(int(n[i]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(sums, pa.int64())], ["word", "n"])

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


class Automaton:
    """The minimal acyclic automaton of sorted distinct words; ``edges[s]`` maps a code point to (next state, words before that edge)."""

    def __init__(self, words: list[str]):
        self.edges: list[dict] = [{}]
        self.final = [False]
        register: dict[tuple, int] = {}
        free: list[int] = []
        path = [0]
        last = ""
        for word in words:
            same, top = 0, min(len(word), len(last))
            while same < top and word[same] == last[same]:
                same += 1
            self._close(path, last, same, register, free)
            for c in word[same:]:
                if free:
                    state = free.pop()
                    self.edges[state], self.final[state] = {}, False
                else:
                    state = len(self.edges)
                    self.edges.append({})
                    self.final.append(False)
                self.edges[path[-1]][c] = state
                path.append(state)
            self.final[path[-1]] = True
            last = word
        self._close(path, last, 0, register, free)
        self._number()

    def _close(self, path: list[int], last: str, keep: int, register: dict, free: list[int]) -> None:
        """Replace the states of the last word's path beyond ``keep`` code points by equal ones that exist."""
        while len(path) > keep + 1:
            state = path.pop()
            form = (self.final[state], *self.edges[state].items())
            known = register.setdefault(form, state)
            if known != state:
                free.append(state)
                self.edges[path[-1]][last[len(path) - 1]] = known

    def _number(self) -> None:
        total = [0] * len(self.edges)
        done = [False] * len(self.edges)
        stack = [0]
        while stack:
            state = stack[-1]
            todo = [t for t in self.edges[state].values() if not done[t]] if not done[state] else []
            if todo:
                stack.extend(todo)
                continue
            stack.pop()
            if done[state]:
                continue
            n, numbered = int(self.final[state]), {}
            for c, t in self.edges[state].items():
                numbered[c] = (t, n)
                n += total[t]
            self.edges[state], total[state], done[state] = numbered, n, True

    def finish(self, state: int, number: int, rest: str) -> int:
        """The number of the word that goes on with exactly ``rest``, or -1."""
        for c in rest:
            step = self.edges[state].get(c)
            if step is None:
                return -1
            state, before = step
            number += before
        return number if self.final[state] else -1

    def one_error(self, word: str, exact: int):
        """(number, place, shorter): words that replace the code point at ``place`` by a larger one or, where ``shorter``, lack it.

        ``word`` is one of the automaton's, and ``place`` is the first one where the two differ, ``exact`` or more.
        """
        edges, state, number = self.edges, 0, 0
        end = len(word) - 1
        for i, c in enumerate(word):
            steps = edges[state]
            if i >= exact:
                if (i == end or word[i + 1] != c) and (i == end or word[i + 1] in steps) and (found := self.finish(state, number, word[i + 1 :])) >= 0:
                    yield found, i, True
                if len(steps) > 1:
                    for other, (target, before) in steps.items():
                        if other > c and (found := self.finish(target, number + before, word[i + 1 :])) >= 0:
                            yield found, i, False
            state, before = steps[c]
            number += before


def _last_place(word: str, at: int) -> int:
    """The last place whose deletion gives the same word as the deletion at ``at``."""
    c, end = word[at], len(word) - 1
    while at < end and word[at + 1] == c:
        at += 1
    return at


def _pairs_of(words: list[str], backward: bool) -> list[tuple[int, int]]:
    """Pairs of places in ``words`` (sorted; reversed if ``backward``) that one error in this direction's half separates."""
    automaton, out = Automaton(words), []
    for i, word in enumerate(words):
        n = len(word)
        for j, at, shorter in automaton.one_error(word, n // 2 if backward else (n - 1) // 2):
            half = (n - 1) // 2 if shorter else n // 2
            if backward:
                place = n - 1 - at
                mine = (_last_place(word[::-1], place) if shorter else place) < half
            else:
                mine = at >= half
            if mine:
                out.append((i, j))
    return out


PAIRS = "a long, b long, n_b long"


def _both_ways(pairs: list[tuple[int, int]], ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    at = np.array(pairs, np.int64).reshape(-1, 2)
    a, b = np.concatenate([at[:, 0], at[:, 1]]), np.concatenate([at[:, 1], at[:, 0]])
    return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(n[b])], ["a", "b", "n_b"])


def _whole(groups: DataFrame) -> DataFrame:
    """Pairs of ``groups`` (way, key, s, id, n) of whole words; ``s`` is reversed where ``way`` is 1. Pairs of two words of ``LONG`` are left out."""
    keys = ["way", "key"]

    def run(batches):
        for t in runs(batches, keys):
            if t.num_rows == 1:
                continue
            words, ids, n = t.column("s").to_pylist(), np.asarray(t.column("id")), np.asarray(t.column("n"))
            pairs = _pairs_of(words, t.column("way")[0].as_py() == 1)
            if pairs := [p for p in pairs if min(len(words[p[0]]), len(words[p[1]])) < LONG]:
                yield _both_ways(pairs, ids, n)

    return groups.select(*keys, "s", "id", "n").repartition(*keys).sortWithinPartitions(*keys, "s").mapInArrow(run, PAIRS)


def _ranged(groups: DataFrame) -> DataFrame:
    """Pairs of ``groups`` (key, lo, hi, more, s, id, n) whose words are equal outside of ``s``; ``more`` marks the longer ones."""

    def run(batches):
        for t in runs(batches, ["key"]):
            words, ids, n, more = t.column("s").to_pylist(), np.asarray(t.column("id")), np.asarray(t.column("n")), t.column("more").to_pylist()
            width = t.column("hi")[0].as_py() - t.column("lo")[0].as_py()
            automaton, pairs = Automaton(words), []
            for i, word in enumerate(words):
                for j, at, shorter in automaton.one_error(word, 0):
                    if at < width and more[i] == int(shorter) and not more[j]:
                        pairs.append((i, j))
            if pairs:
                yield _both_ways(pairs, ids, n)

    return groups.select("key", "lo", "hi", "more", "s", "id", "n").repartition("key").sortWithinPartitions("key", "s").mapInArrow(run, PAIRS)


def _range_rows(words: DataFrame, lengths: Column) -> DataFrame:
    """A row for each of ``lengths`` (of the shorter word of a pair) and half (``halves``) of ``words`` (s, id, n, halves): key, lo, hi, more, s, id, n."""
    rows = words.withColumn("m", F.explode(lengths)).withColumn("half", F.explode("halves"))
    middle = F.floor(F.col("m") / 2).cast("int")
    rows = rows.withColumn("lo", F.when(F.col("half") == 0, middle).otherwise(0)).withColumn("hi", F.when(F.col("half") == 0, F.col("m") + 1).otherwise(middle))
    behind = F.greatest(F.col("m") - F.col("hi"), F.lit(0))
    inner = F.length("s") - behind - F.col("lo")
    outside = F.concat_ws(":", "m", "lo", "hi", F.expr("substring(s, 1, lo)"), F.expr("substring(s, length(s) - greatest(m - hi, 0) + 1)"))
    return rows.select(F.md5(outside).alias("key"), "m", "lo", "hi", (F.length("s") > F.col("m")).cast("int").alias("more"), F.substring("s", F.col("lo") + 1, inner).alias("s"), "id", "n")


def _halved(rows: DataFrame) -> DataFrame:
    """``rows`` dealt by twice as much outside of half the range."""
    rows = rows.withColumn("mid", F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")).withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    # what the suffix gains in the first half, and the prefix in the second
    tail = F.greatest(F.col("m") - F.col("mid"), F.lit(0)) - F.greatest(F.col("m") - F.col("hi"), F.lit(0))
    head = F.col("mid") - F.col("lo")
    first = F.col("half") == 0
    gained = F.when(first, F.substring("s", F.length("s") - tail + 1, tail)).otherwise(F.substring("s", F.lit(1), head))
    rest = F.when(first, F.substring("s", F.lit(1), F.length("s") - tail)).otherwise(F.substring("s", head + 1, F.length("s")))
    return rows.select(
        F.md5(F.concat_ws(":", "key", "half", gained)).alias("key"), "m", F.when(first, F.col("lo")).otherwise(F.col("mid")).alias("lo"), F.when(first, F.col("mid")).otherwise(F.col("hi")).alias("hi"),
        "more", rest.alias("s"), "id", "n",
    )


def _with_sizes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the number of words (``k``) and code points (``size``) of their group; a group's rows meet these in ``PARTS`` parts."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("k"), F.sum(F.length("s")).alias("size")).filter("k > 1")
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int"))
    return dealt.join(sizes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), [*keys, "part"]).drop("part")


def near_words(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(a, b, n_b) for all ``words`` (id, word, n) that are one code point apart, both ways. Words have ``LEAST_LENGTH`` code points or more."""
    length = F.length("word")
    ways = F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("word").alias("s")), F.struct(F.lit(1).alias("way"), F.reverse("word").alias("s"))))
    edges = words.filter(length <= LONG).withColumn("w", ways).select("w.way", F.substring("w.s", 1, EDGE).alias("key"), "w.s", "id", "n")
    sized = materialize(_with_sizes(edges, ["way", "key"]), "edges")
    found = [materialize(_whole(sized.filter(F.col("size") <= limit)), "near")]
    # words of groups that are too large in one direction, and long words in both
    hot = sized.filter(F.col("size") > limit).select(F.when(F.col("way") == 1, F.reverse("s")).otherwise(F.col("s")).alias("s"), "id", "n", F.array("way").alias("halves"))
    shorter = F.filter(F.array(F.length("s") - 1, F.length("s")), lambda m: (m >= LEAST_LENGTH) & (m < LONG))
    lengthy = words.filter(length >= LONG).select(F.col("word").alias("s"), "id", "n", F.array(F.lit(0), F.lit(1)).alias("halves"))
    longer = F.filter(F.array(F.length("s") - 1, F.length("s")), lambda m: m >= LONG)
    rows = _range_rows(hot, shorter).unionByName(_range_rows(lengthy, longer))
    rows = materialize(_with_sizes(rows, ["key"]), "ranges")
    small = ((F.col("size") <= limit) & (F.col("hi") - F.col("lo") <= LONG)) | (F.col("hi") - F.col("lo") <= 1)
    while not rows.isEmpty():
        found.append(materialize(_ranged(rows.filter(small)), "near"))
        after = materialize(_with_sizes(_halved(rows.filter(~small).drop("k", "size")), ["key"]), "ranges")
        discard(rows)
        rows = after
    discard(rows, sized)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """(a, root) of ``forms`` (a, b): where following them ends. Counts grow along a chain, so there is no ring; each round doubles the steps."""
    now = materialize(forms.select("a", F.col("b").alias("root")), "roots")
    while True:
        next_ = now.select(F.col("a").alias("root"), F.col("root").alias("further"))
        after = materialize(now.join(next_, "root", "left").select("a", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(now)
        if after.filter("moved").isEmpty():
            return after.drop("moved")
        now = materialize(after.drop("moved"), "roots")
        discard(after)


def spelling_variants(docs: DataFrame, factor: int = FACTOR, least_count: int = LEAST_COUNT, every: int = EVERY, limit: int = LIMIT) -> DataFrame:
    """Per word of ``docs`` (doc_id, text): word, form, root, n, n_near, form_n.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of ``LEAST_LENGTH`` code points and more, that occur ``least_count`` times. Where
    ``every`` divides the CRC-32 of doc_id and run, the run loses a code point first. The form of a word is its near word of largest count, the
    smaller word of a tie, if it counts ``factor`` times as much; the root follows forms to the last. Null and empty texts and texts without such
    runs have no words; runs of rows without doc_id lose nothing; repeated rows count again; other columns are ignored; no rows give no rows.
    """
    counted = materialize(count_words(docs, every=every).filter(F.col("n") >= least_count), "counted")
    # ids follow the order of the words, so of two ids the smaller is the smaller word
    words = materialize(counted.repartitionByRange("word").sortWithinPartitions("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    discard(counted)
    best = near_words(words, limit).groupBy("a").agg(F.count("*").alias("n_near"), F.max(F.struct("n_b", (-F.col("b")).alias("b"))).alias("best"))
    found = words.join(best, words["id"] == best["a"], "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("best.n_b") >= factor * F.col("n"), -F.col("best.b")).alias("form_id"))
    found = materialize(found, "found")
    ends = _roots(found.filter("form_id is not null").select(F.col("id").alias("a"), F.col("form_id").alias("b")))
    name = lambda i, w, *more: words.select(F.col("id").alias(i), F.col("word").alias(w), *more)
    formed = ends.join(name("root", "root_word"), "root").select("a", F.col("root_word").alias("root")).join(found.select(F.col("id").alias("a"), "form_id"), "a")
    formed = formed.join(name("form_id", "form", F.col("n").alias("form_n")), "form_id").select(F.col("a").alias("id"), "form", "root", "form_n")
    return found.join(formed, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP13_SQL = rf"""
WITH RECURSIVE k AS ({CRC_TABLE}), r AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents
), d AS (
  SELECT doc_id, w, count(*) AS c, hex(encode(doc_id || ':' || w)) AS hexed FROM r WHERE length(w) >= 7 GROUP BY doc_id, w
), h AS (
  SELECT w, c, {crc_sql("hexed")} AS h FROM d, k
), m AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM h
), v AS (
  SELECT word, sum(c)::BIGINT AS n FROM m WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2
), p AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
), l AS (
  SELECT x.word AS a, y.word AS b FROM p x JOIN p y ON x.less = y.less AND x.i = y.i WHERE x.word <> y.word
  UNION SELECT p.word, v.word FROM p JOIN v ON p.less = v.word
  UNION SELECT v.word, p.word FROM p JOIN v ON p.less = v.word
), o AS (
  SELECT a, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS place, count(*) OVER (PARTITION BY a) AS n_near FROM l JOIN v ON l.b = v.word
), f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN o.n >= 10 * v.n THEN b END AS form, CASE WHEN o.n >= 10 * v.n THEN o.n END AS form_n
  FROM v LEFT JOIN o ON v.word = o.a AND place = 1
), s AS (
  SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION ALL SELECT s.word, f.form FROM s JOIN f ON s.root = f.word WHERE f.form IS NOT NULL
), e AS (
  SELECT s.word, s.root FROM s JOIN f ON s.root = f.word WHERE f.form IS NULL
)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN e ON f.word = e.word
"""
