"""Best-fit packing, importance resampling and spelling variants against plain versions."""

import bisect
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from bytelode.llm import bestfit, packing, resampling, spelling
from tests.llm.brute import LOW


# -- best-fit packing


def sequential_best_fit(items, capacity):
    """Rooms left, in order: each item in the tightest open sequence, longest first."""
    rooms = []
    for n in sorted(items, reverse=True):
        at = bisect.bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else capacity
        bisect.insort(rooms, room - n)
    return rooms


def filled(rows):
    """Sequence -> (offset, length) in order, for rows (sequence, offset, length); offsets are gapless from 0."""
    by = collections.defaultdict(list)
    for s, o, n in rows:
        by[s].append((o, n))
    for s, v in by.items():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:i]) for i in range(len(v))], s
    return by


def test_plan_equals_sequential_best_fit():
    rng = random.Random(5)
    for _ in range(300):
        capacity = rng.choice([1, 7, 10, 16, 33, 64])
        items = [rng.randint(1, capacity) if rng.random() < 0.5 else rng.randint(1, max(1, capacity // 4)) for _ in range(rng.randint(0, 150))]
        counts = collections.Counter(items)
        rows = []
        for length, first, each, sequence, offset in bestfit.best_fit(counts, capacity):
            later = [r[1] for r in bestfit.best_fit(counts, capacity) if r[0] == length and r[1] > first]
            rows += [(sequence + (r - first) // each, offset + (r - first) % each * length, length) for r in range(first, min(later, default=counts[length]))]
        assert len(rows) == len(items)
        rooms = sorted(capacity - sum(n for _, n in v) for v in filled(rows).values())
        assert rooms == sequential_best_fit(items, capacity)


def test_plan_does_not_grow_with_the_documents():
    rng = random.Random(6)
    counts = collections.Counter(min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(20_000))
    few, many = (len(bestfit.best_fit({n: k * f for n, k in counts.items()}, 2048)) for f in (1, 10_000))
    assert many < 3 * few


def test_fast_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = bestfit.default_tokenizer()
    fast, plain = bestfit.PieceTokens(path), Tokenizer.from_file(path)
    assert fast.by_word
    rng = random.Random(7)
    letters = " \n\t'sStdmrevlL12!?.é×ß \u0085  “α日😀\x1c\x00²ªx  '́"
    for k in range(60):
        texts = ["".join(rng.choices(letters, k=rng.randint(0, 25))) for _ in range(50)]
        if k % 5 == 0:
            texts[3] += "<|endoftext|>'s"
        ids, counts = fast.encode(pa.array(texts), 0)
        ends = np.cumsum(counts)
        for t, e, n in zip(texts, ends, counts, strict=True):
            assert ids[e - n : e].tolist() == plain.encode(t, add_special_tokens=False).ids + [0], t


def packed_docs():
    rng = random.Random(8)
    words = ["ab", "Hello", "naïve", "don't", "x1", "\n", "  ", "日本", "<|endoftext|>"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 9, 30, 60])))) for i in range(300)]
    docs += [(900, None), (901, ""), (902, "a " * 5000), (None, "no id"), (903, "twin"), (903, "twin"), (904, "x" * 30_000)]
    return docs


@pytest.mark.parametrize("window", [64, 2048])
def test_best_fit_packing(spark, window):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(bestfit.default_tokenizer())
    docs = packed_docs()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, ids string, part int").repartition(5)
    got = bestfit.pack(df, window).collect()
    ids = collections.Counter((d, tuple(plain.encode(t or "", add_special_tokens=False).ids + [0])) for d, t in docs)
    want = collections.Counter()
    for (d, tokens), n in ids.items():
        head = (len(tokens) - 1) % window + 1
        cuts = [0, *range(head, len(tokens) + 1, window)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            raw = np.array(tokens[a:b], "<u4").tobytes()
            want[d, i, a, b - a, zlib.crc32(raw), raw] += n
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == want
    rooms = sorted(window - sum(n for _, n in v) for v in filled([(r.sequence_id, r.offset, r.length) for r in got]).values())
    assert rooms == sequential_best_fit([k[3] for k, n in want.items() for _ in range(n)], window)


def test_best_fit_packing_of_nothing(spark):
    assert bestfit.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_best_fit_with_a_tokenizer_of_another_kind(spark):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    docs = [(1, "Some words, and more."), (2, None)]
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bestfit.pack(spark.createDataFrame(docs, "doc_id long, text string"), 64, path, 5).collect()}
    plain = Tokenizer.from_file(path)
    assert got == {d: plain.encode(t or "", add_special_tokens=False).ids + [5] for d, t in docs}


# -- importance resampling


def grams(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOW))
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resample(docs, target, percent=5, least=20):
    bucket = lambda g: zlib.crc32(g.encode()) % 10_000
    features = [(d, *grams(t)) for d, t in docs]
    s, t = collections.Counter(bucket(g) for _, _, f in features for g in f), collections.Counter(bucket(g) for x in target for g in grams(x)[1])
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (s.total() + 10_000)) / ((s[b] + 1) * (t.total() + 10_000))))
    rows = []
    for d, n, f in features:
        h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(g)) for g in f)
        rows.append([d, n, len(f), weight, None if d is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    ok = sorted((r for r in rows if r[1] >= least and r[0] is not None), key=lambda r: (-r[4], r[0]))
    ranks = {id(r): i + 1 for i, r in enumerate(ok[: len(ok) * percent // 100])}
    return sorted((r[0] is None, r[0], r[2], r[3], r[4], ranks.get(id(r))) for r in rows if r[0] is not None), [(r[2], r[3]) for r in rows if r[0] is None]


def resampled_docs(seed, ids):
    rng = random.Random(seed)
    words = ["The", "cat", "naïve", "x1", "日本", "dog", "of", "a", "Z"]
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 19, 20, 21, 60])))) for i in ids]
    return docs + [(9001, None), (9002, ""), (9003, "..."), (9004, "word " * 4000), (9005, "q" * 100_000), (None, "no id " * 30), (9006, "same ids twice " * 10)]


@pytest.mark.parametrize("block", [60, 8 << 20])
def test_resampling_equals_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(resampling, "BLOCK", block)
    docs, target = resampled_docs(3, range(400)), ["the cat of the dog", None, "", "naïve x1"]
    df = spark.createDataFrame([(*d, "x", 0) for d in docs], "doc_id long, text string, bucket string, at int").repartition(5)
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    rows, without = plain_resample(docs, target)
    assert sorted((False, r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got if r.doc_id is not None) == rows
    assert [(r.n_features, r.weight) for r in got if r.doc_id is None] == without
    assert all(r.score is None and r["rank"] is None for r in got if r.doc_id is None)
    assert sum(r["rank"] is not None for r in got) > 5


def test_resampling_of_repeated_rows_and_nothing(spark):
    text = "one two three four five six seven eight nine ten " * 3
    df = spark.createDataFrame([(1, text)] * 40 + [(2, text)] * 40, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    got = resampling.resample(df, none.select("text")).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4] and len({(r.doc_id, r.score) for r in got}) == 2
    assert resampling.resample(none, df.select("text")).count() == 0


# -- spelling variants


def plain_words(docs, every=31, least=2):
    n = collections.Counter()
    for d, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{d}:{w}".encode())
            if d is not None and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                n[w] += 1
    return {w: k for w, k in n.items() if k >= least}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and v != w and one_apart(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    root = {}
    for w in n:
        r = w
        while form[r] is not None:
            r = form[r]
        root[w] = r
    return sorted((w, form[w] or "", root[w], n[w], len(near[w]), n.get(form[w], 0)) for w in n)


def variant_docs():
    rng = random.Random(12)
    letters = "abÀÿ÷é"
    base = ["".join(rng.choices(letters, k=rng.choice([7, 8, 9, 12]))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "q" * 63, "q" * 64, "q" * 65, "r" * 3000, "r" * 3001]
    words = []
    for i, w in enumerate(base):
        words += [w] * rng.choice([1, 2, 25, 300 if i < 20 else 30])
        for _ in range(4):
            at, c = rng.randrange(len(w) + 1), rng.choice(letters)
            words += [rng.choice([w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :]])] * rng.choice([1, 2, 3])
    rng.shuffle(words)
    docs = [(i, rng.choice([" ", ", ", "-1"]).join(words[k : k + 9]).replace("a", rng.choice("aA"))) for i, k in enumerate(range(0, len(words), 9))]
    return docs + [(None, "abababab unpaired unpaired"), (7000, None), (7001, ""), (7002, "12 34"), (7003, "short Àÿ÷é")]


@pytest.mark.parametrize(("limit", "block"), [(1_000_000, 8 << 20), (40, 100)])
def test_variants_equal_plain_version(spark, monkeypatch, limit, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    docs = variant_docs()
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, word int").repartition(3)
    got = spelling.spelling_variants(df, limit=limit).collect()
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in got) == plain_variants(plain_words(docs))


@pytest.mark.parametrize("long", [8, 11])
def test_long_words_are_found_by_ranges(spark, monkeypatch, long):
    monkeypatch.setattr(spelling, "LONG", long)
    docs = variant_docs()
    got = spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"), limit=60).collect()
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in got) == plain_variants(plain_words(docs))


def test_automaton_numbers_words_and_is_minimal():
    words = sorted({"".join(random.Random(i).choices("abc", k=random.Random(i).randint(1, 6))) for i in range(200)})
    made = spelling.Automaton(words)
    assert [made.finish(0, 0, w) for w in words] == list(range(len(words))) and made.finish(0, 0, "zz") == -1
    # the states reached are as many as there are different sets of endings
    endings = {p: frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in (w[:i] for i in range(len(w) + 1))}
    seen, stack = {0}, [0]
    while stack:
        for target, _ in made.edges[stack.pop()].values():
            if target not in seen:
                seen.add(target)
                stack.append(target)
    assert len(seen) == len(set(endings.values()))


def test_variants_of_nothing(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_roots_follow_long_chains(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(13)] + [(100, 5)], "a long, b long")
    assert {r.a: r.root for r in spelling._roots(df).collect()} == {**{i: 13 for i in range(13)}, 100: 13}
