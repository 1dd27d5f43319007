"""Toxicity scores from a learned lexicon, matched by Levenshtein automata on a trie.

Words and word beginnings that mark toxic training rows form the lexicon. Its trie is intersected with the Levenshtein
automaton of each token: a state is a set of (trie node, edits so far), states and transitions are built when first
needed and kept, so a token costs one look-up a character and most tokens die after a few. Terms of ``FUZZY_FROM`` or
more characters allow one edit; a term that is a beginning accepts any ending.

Each hit is read in its context window: quotation marks around it, and address (an exclamation or another hit nearby).
A logistic model on counts of exact, misspelled, quoted and addressed hits and their density gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytelode.llm._shared import by_bytes, crc_fold, table

#: Bound of the labelled rows the lexicon and the model are learned from (the rows with the smallest id hashes).
MAX_ROWS = 20_000
MAX_TERMS = 2_000
STEMS = range(4, 9)
MIN_ROWS = 4
MIN_G2 = 22.0
MIN_SHARE = 0.75
FUZZY_FROM = 5
CONTEXT = 6
CACHED_TOKENS = 400_000
TOKEN = re.compile(r"[\w@$*]+")
OPEN, CLOSE = "\"“”„«‹»'‘", "\"”“«»›'’"
N_FEATURES = 8


@dataclass(frozen=True)
class Term:
    text: str
    is_stem: bool


class FuzzyTrie:
    """The product of a lexicon trie and Levenshtein automata, made lazily deterministic."""

    def __init__(self, terms: list[Term]):
        self.children: list[dict[str, int]] = [{}]
        self.accepts: list[int] = [-1]  # edits allowed where a term ends
        self.absorbs: list[bool] = [False]
        self.below: list[int] = [0]  # most edits allowed by a term at or under a node
        for t in terms:
            allowed = 1 if len(t.text) >= FUZZY_FROM else 0
            node = 0
            self.below[0] = max(self.below[0], allowed)
            for ch in t.text:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({}), self.accepts.append(-1), self.absorbs.append(False), self.below.append(0)
                node = self.children[node][ch]
                self.below[node] = max(self.below[node], allowed)
            self.accepts[node] = max(self.accepts[node], allowed)
            self.absorbs[node] |= t.is_stem
        self.letters = {c for t in terms for c in t.text}
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.found: list[int] = []
        self.dead = self._state(set())
        self.start = self._state({(0, 0)})

    def _state(self, places: set[tuple[int, int]]) -> int:
        best: dict[int, int] = {}
        todo = list(places)
        while todo:
            node, e = todo.pop()
            if e > self.below[node] or best.get(node, 9) <= e:
                continue
            best[node] = e
            todo += [(child, e + 1) for child in self.children[node].values()]  # a missing character
        key = frozenset(best.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            self.found.append(min((e for node, e in key if e <= self.accepts[node]), default=-1))
        return self.states[key]

    def _move(self, state: int, ch: str) -> int:
        """The next state. Characters of no term all act alike and share one stored move, so a state keeps few."""
        ch = ch if ch in self.letters else ""
        if ch in self.moves[state]:
            return self.moves[state][ch]
        out: set[tuple[int, int]] = set()
        for node, e in self.sets[state]:
            if self.absorbs[node] and e <= self.accepts[node]:
                out.add((node, e))
            out.add((node, e + 1))  # a surplus character
            for c, child in self.children[node].items():
                out.add((child, e if c == ch else e + 1))
        self.moves[state][ch] = to = self._state(out)
        return to

    def distance(self, token: str) -> int:
        """Edits to the nearest term it is accepted by, -1 if none."""
        s, dead = self.start, self.dead
        for ch in token:
            to = self.moves[s].get(ch)
            s = self._move(s, ch) if to is None else to
            if s == dead:
                return -1
        return self.found[s]


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def _distances(words: set[str], known: dict[str, int], trie: FuzzyTrie) -> dict[str, int]:
    """Distances of ``words``, from a cache of at most ``CACHED_TOKENS``; a text with more words than that gets its own."""
    if len(known) + len(words) > CACHED_TOKENS:
        known.clear()
    if len(words) > CACHED_TOKENS:
        return {w: trie.distance(w) for w in words}
    for w in words.difference(known):
        known[w] = trie.distance(w)
    return known


def features(text: str | None, known: dict[str, int], trie: FuzzyTrie) -> list[float]:
    """Counts over the whole text, as logarithms."""
    low = (text or "").lower()
    words = TOKEN.findall(low)
    get = _distances(set(words), known, trie).__getitem__
    n = len(words)
    if not any(get(w) >= 0 for w in set(words)):
        return [1.0, 0, 0, 0, 0, 0, 0, math.log1p(n)]
    exact = fuzzy = quoted = addressed = 0
    spans = [m.span() for m in TOKEN.finditer(low)]
    hits = [i for i, w in enumerate(words) if get(w) >= 0]
    for k, i in enumerate(hits):
        lo, hi = spans[max(0, i - CONTEXT)][0], spans[min(n - 1, i + CONTEXT)][1]
        left, right = low[lo : spans[i][0]], low[spans[i][1] : hi + 1]
        near = (k and i - hits[k - 1] <= CONTEXT) or (k + 1 < len(hits) and hits[k + 1] - i <= CONTEXT)
        if sum(left.count(q) for q in set(OPEN)) % 2 and any(q in right for q in CLOSE):
            quoted += 1
        elif get(words[i]):
            fuzzy += 1
        else:
            exact += 1
        addressed += bool(near or "!" in right)
    return [1.0, math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), math.log1p(addressed), float(exact > 1), 100.0 * (exact + fuzzy) / n, math.log1p(n)]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Penalised Newton steps. The penalty keeps separable data finite."""
    w = np.zeros(x.shape[1])
    pen = np.full(x.shape[1], ridge)
    pen[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pen), x.T @ (y - p) - pen * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class ToxicityModel:
    terms: tuple[Term, ...]
    weights: tuple[float, ...]


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = MAX_ROWS) -> DataFrame:
    """doc_id, text, toxic of at most ``bound`` labelled documents outside the hold-out fold."""
    usable = (
        labels.filter("toxic is not null and doc_id is not null")
        .filter(crc_fold(F.col("doc_id")) != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    picked = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    learned = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return learned.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def learn_lexicon(rows: DataFrame) -> tuple[Term, ...]:
    """Words and beginnings of words that stand in toxic rows far more often than chance allows (likelihood ratio)."""

    def count(batches):
        seen: Counter = Counter()
        for b in by_bytes(batches, "text", 4 << 20):
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = set(tokens(text or ""))
                found = {(w, False) for w in words} | {(w[:k], True) for w in words for k in STEMS if k < len(w)}
                seen.update((t, s, y) for t, s in found)
            if len(seen) > 1_000_000:
                yield from out(seen)
        yield from out(seen)

    def out(seen):
        both: dict = {}
        for (t, s, y), n in seen.items():
            both.setdefault((t, s), [0, 0])[1 if y else 0] += n
        seen.clear()
        if both:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in both], pa.string()), pa.array([k[1] for k in both]), pa.array([v[1] for v in both.values()], pa.int64()), pa.array([v[0] for v in both.values()], pa.int64())],
                ["term", "stem", "bad", "good"],
            )

    sizes = {bool(r["y"]): r["n"] for r in rows.groupBy((F.col("toxic") > 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(True, 0), sizes.get(False, 0)
    if not bad or not good:
        return ()
    base = bad / (bad + good)
    counted = rows.select("text", (F.col("toxic") > 0).alias("y")).mapInArrow(count, "term string, stem boolean, bad long, good long")
    a, b = F.col("bad"), F.col("good")
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    g2 = 2 * (part(a, (a + b) * base) + part(b, (a + b) * (1 - base)))
    strong = (
        counted.groupBy("term", "stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .withColumn("g2", g2)
        .filter((a >= MIN_ROWS) & (a >= MIN_SHARE * (a + b)) & (F.col("g2") >= MIN_G2))
        .orderBy(F.col("g2").desc(), "stem", F.length("term"), "term")
        .limit(MAX_TERMS)
    )
    found = strong.collect()
    words = {r["term"]: r["bad"] for r in found if not r["stem"]}
    stems = {r["term"]: r["bad"] for r in found if r["stem"]}
    kept: list[Term] = []
    for t in sorted(stems, key=lambda t: (len(t), t)):
        # a stem must be productive, beyond any one word, and as long as it can be without losing rows
        productive = stems[t] >= 1.5 * max((n for w, n in words.items() if w.startswith(t)), default=0)
        longer = any(u != t and u.startswith(t) and n >= 0.9 * stems[t] for u, n in stems.items())
        if productive and not longer and not any(t.startswith(k.text) for k in kept):
            kept.append(Term(t, True))
    kept += [Term(w, False) for w in words if not any(w.startswith(k.text) for k in kept)]
    return tuple(kept)


def train(docs: DataFrame, labels: DataFrame, bound: int = MAX_ROWS) -> ToxicityModel:
    """Lexicon and weights. Without rows of both classes every score is next to 0.

    A doc_id with several labels counts as toxic if one of them says so; of several rows of a doc_id the one with the smallest text is learned from.
    """
    rows = training_rows(docs, labels, bound).cache()
    terms = learn_lexicon(rows)
    if not terms:
        rows.unpersist()
        return ToxicityModel((), (-20.0, *[0.0] * (N_FEATURES - 1)))

    def extract(batches):
        trie, known = FuzzyTrie(list(terms)), {}
        for b in by_bytes(batches, "text", 4 << 20):
            x = np.array([features(t, known, trie) for t in b.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), b.column(1)], [f"f{i}" for i in range(N_FEATURES)] + ["y"])

    schema = ", ".join(f"f{i} double" for i in range(N_FEATURES)) + ", y double"
    m = rows.select("text", (F.col("toxic") > 0).cast("double").alias("y")).mapInArrow(extract, schema).toPandas().to_numpy()
    rows.unpersist()
    m = m[np.lexsort(m.T)]  # sums in one order whatever the partitions
    return ToxicityModel(terms, tuple(fit_logistic(m[:, :-1], m[:, -1]).tolist()))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: toxic) and ``n_hits`` added; input columns of these names are replaced.

    The whole text counts, at any length. Null and empty texts get the score of a text without hits. Only the text is read, so
    repeated rows get equal scores; no rows give no rows.
    """
    docs = docs.drop("score", "n_hits")
    names = docs.columns
    at = names.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("n_hits", T.LongType())])

    def run(batches):
        trie, known, w = FuzzyTrie(list(model.terms)), {}, np.array(model.weights)
        for b in by_bytes(batches, "text", 4 << 20):
            x = np.array([features(t, known, trie) for t in b.column(at).to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hits = np.rint(np.expm1(x[:, 1:4]).sum(axis=1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array(hits)], [*names, "score", "n_hits"])

    return docs.mapInArrow(run, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return score(docs, train(docs, labels)).select(
        "doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits"
    )
