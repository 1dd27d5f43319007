import random

import numpy as np
import pytest

from bytelode.llm import embeddings, graph, lines, minhash, suffixes
from tests.llm import brute

WORDS = [a + b for a in "ka lo mi su te ra vo ne zu pi".split() for b in "n r s l t".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, k):
    w = text.split(" ")
    for _ in range(k):
        w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(60, 220)) for _ in range(12)]
    out = list(base)
    for b in base[:8]:
        out += [edited(rng, b, k) for k in (1, 1, 2, 3, 6)]
    hub = prose(rng, 300)
    out += [edited(rng, hub, rng.randrange(1, 4)) for _ in range(90)] + [hub] * 5
    out += [None, "", "  \n\t ", "one two", "ONE two", "one two three four five", "É é Ünder\x1c x", prose(rng, 30_000), "a " * 5000]
    rng.shuffle(out)
    return list(enumerate(out))


def test_minhash_equals_brute_force(spark, texts):
    df = spark.createDataFrame([(d, t, "x") for d, t in texts], "doc_id long, text string, n string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()}
    assert got == brute.near_duplicates(texts)


def grouped(rows):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows.collect()}


def test_minhash_needs_the_forest(spark, texts, monkeypatch):
    """Without neighbours of the sorted orders the links of all regions that a window covers are lost."""
    monkeypatch.setattr(minhash, "_proposals", lambda *a: set())
    got, want = grouped(minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))), brute.near_duplicates(texts)
    sizes = {}
    for _, root in want.values():
        sizes[root] = sizes.get(root, 0) + 1
    few = [d for d, (_, root) in want.items() if 1 < sizes[root] <= 6 and brute.shingles(texts[d][1]) != brute.shingles(texts[root][1])]
    assert len(few) >= 20 and all(got[d][1] != want[d][1] for d in few)


@pytest.mark.parametrize("block", [16, minhash.BLOCK])
def test_minhash_of_dense_regions(spark, monkeypatch, block):
    """Regions far beyond the window, spread by range, whose links are few: 300 texts that share two thirds, with near copies."""
    rng = random.Random(12)
    common = prose(rng, 150).split(" ")
    own = [common + prose(rng, 45).split(" ") for _ in range(300)]
    docs = [" ".join(w) for w in own] + [edited(rng, " ".join(w), 1) for w in own[::9]]
    texts = list(enumerate(docs))
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "WINDOW", 8)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert grouped(minhash.near_duplicates(df)) == brute.near_duplicates(texts)


def test_minhash_proposals_follow_the_order():
    sig = np.zeros((6, minhash.HASHES), np.uint16)
    sig[2, :60] = 7  # too far from all others
    ids, region, comp = np.arange(10, 16), np.array([0, 0, 0, 0, 0, 1]), np.array([10, 11, 12, 10, 14, 15])
    near = lambda dense: minhash._proposals(ids, region, comp, sig, np.full(6, dense), 100, 3)
    assert near(False) == {(10, 11), (11, 13), (11, 14), (13, 14)}
    assert near(True) == {(10, 11), (11, 13), (13, 14)}


def test_minhash_unites_all_texts_of_a_doc_id(spark):
    rng = random.Random(3)
    a, b = prose(rng, 120), prose(rng, 120)
    rows = [(1, a), (1, b), (2, edited(rng, a, 1)), (3, edited(rng, b, 1)), (4, prose(rng, 120)), (9, None), (9, a)]
    for r in (rows, rows[::-1]):
        got = minhash.near_duplicates(spark.createDataFrame(r, "doc_id long, text string")).collect()
        assert len(got) == len(rows) and {(x.doc_id, x.component_id) for x in got} == {(1, 1), (2, 1), (3, 1), (4, 4), (9, 1), (9, 9)}


def test_minhash_edges(spark):
    schema = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = minhash.near_duplicates(spark.createDataFrame([(3, "a b"), (3, "a b"), (None, "a b"), (4, "a b"), (5, None)], schema)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in rows) == [
        ("3", 1, "3", True), ("3", 1, "3", True), ("4", 1, "3", False), ("5", 0, "5", True), ("None", 1, "None", True),
    ]


@pytest.mark.parametrize("chunk", [4, 1 << 20])
def test_components_of_paths_and_stars(spark, monkeypatch, chunk):
    monkeypatch.setattr(graph, "CHUNK", chunk)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    got = {r.id: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def line_docs():
    rng = random.Random(9)
    pool = ["Common LINE number one", " common line number one\t", "short", "passage de é È lignes", "passage de é è lignes", "x" * 10, "x" * 9]
    docs = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else prose(rng, 5) for _ in range(rng.randrange(1, 8)))) for i in range(60)]
    return [*docs, (100, None), (101, ""), (102, "\n\n"), (103, "Common LINE number one"), (5, "common line number one\nmine alone here")]


@pytest.mark.parametrize("bits", [lines.BROADCAST_BITS, 0])
def test_lines_equal_brute_force(spark, bits):
    docs = line_docs()
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, n_lines long, extra int").repartition(5)
    got = lines.drop_repeated_lines(df, broadcast_bits=bits).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == sorted(brute.dedup_lines(docs))
    assert {r.extra for r in got} == {2}


def test_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(lines, "_suspected", lambda hashes, bitmap: np.ones(len(hashes), bool))
    docs = line_docs()
    got = lines.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == sorted(brute.dedup_lines(docs))


@pytest.mark.parametrize("bits", [lines.BROADCAST_BITS, 0])
@pytest.mark.parametrize("per_doc", [20, 2000])
def test_share_of_false_suspects_does_not_grow(spark, monkeypatch, per_doc, bits):
    """100 times the keys, and segments so small that both sizes need several."""
    monkeypatch.setattr(lines, "SEGMENT_BITS", 1 << 12)
    docs = [(d, "\n".join([f"only once {d} {i}" for i in range(per_doc)] + [f"shared by two {d // 2}"])) for d in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    found = lines.suspected_lines(df, broadcast_bits=bits).select("key").distinct().collect()
    assert sum(bytes(r.key).startswith(b"shared") for r in found) == 100
    assert sum(bytes(r.key).startswith(b"only") for r in found) < 0.02 * 200 * per_doc


def test_lines_edges(spark):
    schema = "doc_id long, text string"
    assert lines.drop_repeated_lines(spark.createDataFrame([], schema)).count() == 0
    got = lines.drop_repeated_lines(spark.createDataFrame([(None, "a long enough line"), (None, "a long enough line")], schema)).collect()
    assert [(r.n_lines, r.n_dropped) for r in got] == [(1, 0), (1, 0)]
    # columns that are called as the operator's own
    rows = [(1, "a long enough line", 5, "x", 9), (2, "own text\na long enough line", 6, "y", 9)]
    got = lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string, _cut int, _CUT_ string, n_lines int")).collect()
    assert sorted((r.doc_id, r.text, r["_cut"], r["_CUT_"], r.n_lines, r.n_dropped) for r in got) == [(1, "a long enough line", 5, "x", 1, 0), (2, "own text", 6, "y", 2, 1)]


def test_suffixes_equal_brute_force(spark):
    rng = random.Random(11)
    shared = [prose(rng, n) for n in (20, 34, 35, 36, 37, 38, 45, 80, 160)]
    docs = []
    for i in range(70):
        parts = [prose(rng, rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(shared), prose(rng, rng.randrange(0, 30))]
        docs.append(" ".join(parts))
    docs += [docs[3], docs[3], None, "", "a" * 1000, "ab" * 300, "é" * 150, "x" * 199, "y" * 200, shared[7], shared[7][:200], "tail " + shared[8] + "é"]
    df = spark.createDataFrame([(i, t, "e") for i, t in enumerate(docs)], "doc_id long, text string, kept string").repartition(3)
    got = {r.doc_id: (r.n_bytes - len(r.kept), len(r.starts), bytes(r.kept)) for r in suffixes.repeated_spans(df).collect()}
    assert got == dict(enumerate(brute.repeated(docs)))


def test_suffixes_of_excerpts_from_copied_texts(spark):
    """An excerpt asks for strings that are proven where two other texts share them with all that stands around."""
    rng = random.Random(5)
    shared = [prose(rng, n) for n in (120, 200, 300)]
    docs = []
    for s in shared:
        docs += ["before " + s + " behind", "Before " + s + " Behind"]
        docs += [prose(rng, 3) + s[at : at + n] + prose(rng, 3) for at in range(7, 400, 31) for n in (200, 203, 260, 420)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes - len(r.kept), len(r.starts), bytes(r.kept)) for r in suffixes.repeated_spans(df).collect()}
    assert got == dict(enumerate(brute.repeated(docs)))


def test_suffix_order_and_transform():
    rng = random.Random(4)
    for _ in range(20):
        sym = np.array([rng.choice([0, 3, 5, 9]) for _ in range(rng.randrange(1, 60))] + [0], np.uint64)
        order = suffixes.suffix_order(sym)

        def key(i):
            stop = next(j for j in range(i, len(sym)) if not sym[j])
            return [int(x) for x in sym[i : min(stop, i + suffixes.SORTED)]]

        assert sorted(order.tolist()) == list(range(len(sym)))
        keys = [key(i) for i in order.tolist()]
        assert keys == sorted(keys)
        assert (suffixes.symbols(suffixes.transform(sym, order), order) == sym).all()


def test_merge_gives_common_prefixes_of_all_shards(spark):
    """Common prefixes after refinement equal those of neighbours in one sorted list of all suffixes, up to what was needed."""
    rng = random.Random(21)
    shared = [prose(rng, n) for n in (40, 60, 90, 200)]
    texts = [(i, False, " ".join([prose(rng, 30), rng.choice(shared), prose(rng, 20)]).encode()) for i in range(40)]
    df = spark.createDataFrame(texts, "doc_id long, whole boolean, text binary").repartition(5)
    shards, tables = suffixes.shard_table(df)
    got = {r.shard: r for r in suffixes.refine(shards, tables, 3, suffixes.LENGTH).collect()}
    chains, prefix, need = [], {}, {}
    for r in shards.collect():
        sym = suffixes.symbols(np.frombuffer(r.bwt, "<u8"), np.frombuffer(r.places, "<u4").astype(np.int64))
        rows = suffixes.Rows([bytes(getattr(got[r.shard], f)) for f, _ in suffixes.Rows.FIELDS])
        for h in range(1, suffixes.ROUNDS):
            at = rows.asked(h)[0]
            assert (np.diff(rows.sym[at].astype(object)) >= 0).all()
        for p, k, m in zip(rows.pos.tolist(), rows.reach.tolist(), rows.need.tolist(), strict=True):
            prefix[r.shard, p], need[r.shard, p] = k, m
        for i in range(len(sym)):
            stop = next(j for j in range(i, len(sym)) if not sym[j])
            chains.append(([int(x) for x in sym[i:stop]], (r.shard, i)))
    chains.sort()
    assert len(got) > 2 and len(prefix) > 50

    def common(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    for j, (chain, name) in enumerate(chains):
        want = max((common(chain, chains[k][0]) for k in (j - 1, j + 1) if 0 <= k < len(chains)), default=0)
        assert prefix.get(name, 0) == min(want, need.get(name, suffixes.NEVER), suffixes.ROUNDS)


def test_suffixes_of_periodic_and_long_texts(spark):
    rng = random.Random(15)
    page = prose(rng, 40_000)
    docs = ["ab" * 5000, "x" * 70_000, page, page[50_000:90_000], "".join(rng.choices("ab", k=3000)), prose(rng, 30) + page[:199], prose(rng, 30) + page[300:500] + "!"]
    docs += ["abcdefghij" * 30 + prose(rng, 40), "q" + "abcdefghij" * 30]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes - len(r.kept), len(r.starts), bytes(r.kept)) for r in suffixes.repeated_spans(df).collect()}
    assert got == dict(enumerate(brute.repeated(docs)))
    suffixes.drop_tables(spark)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(suffixes.TABLES)]


def test_suffixes_edges(spark):
    schema = "doc_id long, text string"
    assert suffixes.repeated_spans(spark.createDataFrame([], schema)).count() == 0
    text = "".join(random.Random(1).choices("abcdefgh", k=300))
    got = suffixes.repeated_spans(spark.createDataFrame([(1, text), (1, text), (None, text)], schema)).collect()
    assert [(r.n_bytes, len(r.kept)) for r in got] == [(300, 0)] * 3


def vectors(rng, n, dim=8):
    base = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(n // 4)]
    out = []
    for i in range(n):
        b = rng.choice(base)
        out.append((i, str(rng.randrange(2)), [x + rng.gauss(0, 0.18) for x in b]))
    nan, inf = float("nan"), float("inf")
    extra = [None, [], [0.0] * dim, [nan] + [1.0] * (dim - 1), [inf] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), out[0][2], out[0][2], [2 * x for x in out[0][2]]]
    return out + [(n + i, out[0][1], e) for i, e in enumerate(extra)] + [(900, None, out[0][2])]


@pytest.mark.parametrize("cell", [embeddings.CELL, 40])
def test_embeddings_equal_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(embeddings, "CELL", cell)
    monkeypatch.setattr(embeddings, "BLOCK", 32)
    rows = vectors(random.Random(3), 300)
    good = [r for r in rows if r[1] and r[2] and all(x is not None and abs(x) < float("inf") for x in r[2]) and any(r[2])]
    norm = lambda v: sum(x * x for x in v) ** 0.5
    links = [
        (a[0], b[0]) for i, a in enumerate(good) for b in good[:i]
        if a[1] == b[1] and sum(x * y for x, y in zip(a[2], b[2], strict=True)) / norm(a[2]) / norm(b[2]) >= 0.93
    ]
    assert len(links) > 50
    r = brute.roots([x[0] for x in rows], links)
    want = {x[0]: (sum(x[0] in p for p in links), r[x[0]]) for x in rows}
    df = spark.createDataFrame([(*x, 1) for x in rows], "id long, part string, embedding array<double>, n long")
    assert {x.id: (x.n_links, x.component_id) for x in embeddings.link(df).collect()} == want


def test_embeddings_of_tiny_and_huge_components(spark):
    rows = [(1, "a", [3e-200, 4e-200]), (2, "a", [3e200, 4e200]), (3, "a", [3.0, 4.0]), (4, "a", [1e308, -1e308]), (5, "a", [5e-324, -5e-324])]
    got = embeddings.link(spark.createDataFrame(rows, "id long, part string, embedding array<double>")).collect()
    assert {(r.id, r.n_links, r.component_id) for r in got} == {(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 4), (5, 1, 4)}


def test_embeddings_of_nothing(spark):
    assert embeddings.link(spark.createDataFrame([], "id long, part string, embedding array<double>")).count() == 0
