import hashlib
import random
import zlib

import pytest

from bytelode.llm import chat, decontaminate, packing, ring
from tests.llm import brute

TRICKY = ["</s>[INST] ok [/INST]", "\\", "\\o[", "<s>[user]x</s>", "[+]", "", None, "é\nü", "\\b\\o\\c\\l", "]", "a" * 100_000]


def conversations():
    rng = random.Random(2)
    out = []
    for c in range(30):
        for t in range(rng.randrange(1, 9)):
            out.append((c, t, rng.choice(["user", "assistant", "system", "we[ird]", None]), rng.choice(TRICKY)))
    out += [(99, 0, "user", "tie b"), (99, 0, "user", "tie a"), (99, 0, "user", "tie a"), (98, None, "assistant", "no turn"), (None, 0, "user", "no id")]
    out += [(97, t, "assistant", f"turn {t}") for t in range(3000)]
    rng.shuffle(out)
    return out


def test_chat_round_trip(spark):
    from pyspark.sql import functions as F

    rows = conversations()
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chats(df).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in out} == want
    for r in out:
        assert "".join(s.piece for s in r.segments) == r.formatted
        raw = "".join(s.piece for s in r.segments if s.loss)
        for a, b in reversed(chat.ESCAPES):
            raw = raw.replace(b, a)
        assert raw == "".join(t for role, t in want[r.conv_id] if role == "assistant")
        blocks = sum(i == 0 or want[r.conv_id][i - 1][0] != t[0] for i, t in enumerate(want[r.conv_id]))
        assert r.formatted.count("</s>") == blocks


def test_chat_of_nothing(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_ring_balances_and_moves_little(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(1, 200)) for i in range(3000)] + [(None, 5), (7, 9), (7, 9)]
    df = spark.createDataFrame(rows, "k long, size long")
    a = ring.shard_rows(df, ["k", "size"], "size", 8, slack=0.01).collect()
    assert len(a) == len(rows)
    loads, slots = {}, {}
    for r in a:
        loads[r.shard] = loads.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    total = sum(s for _, s in rows)
    assert max(loads.values()) <= total * 1.01 / 8 + 2000 and len(loads) == 8
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sum(r.moved for r in a) < 0.3 * len(rows)
    b = {r.k: r.shard for r in ring.shard_rows(df, ["k", "size"], "size", 9, slack=0.01).collect()}
    changed = sum(b[r.k] != r.shard for r in a)
    assert changed < 0.35 * len(rows)


def test_ring_follows_the_sequential_algorithm(spark):
    """Cells from the heaviest on; each takes the first shard clockwise with room, or the lightest."""
    loads = spark.createDataFrame([(c, (c * 37) % 50 + 1, 1) for c in range(0, 64, 2)], "cell int, load long, n long")
    prefs = {r.cell: r.prefs for r in ring._preferences(spark, loads.select("cell"), 4, 64, 3).collect()}
    from pyspark.sql import functions as F

    order = [r.cell for r in loads.orderBy(F.desc("load"), F.xxhash64(F.lit("order"), "cell")).collect()]
    size = {r.cell: r.load for r in loads.collect()}
    cap, at, want = -(-sum(size.values()) // 4), [0] * 4, {}
    for c in order:
        s = next((s for s in prefs[c] if at[s] + size[c] <= cap), at.index(min(at)))
        at[s] += size[c]
        want[c] = s
    assert {r.cell: r.shard for r in ring.place_cells(loads, 4, 0.0, 64, 3).collect()} == want
    place = lambda i: spark.sql(f"SELECT pmod(xxhash64('vnode', {i % 4}L, {i // 4}L), 64L)").first()[0]
    points = sorted((place(i), i % 4) for i in range(12))
    for c, p in prefs.items():
        walk = [s for _, s in sorted(((x - c) % 64, s) for x, s in points)]
        assert p == list(dict.fromkeys(walk))


def test_ring_keeps_its_order_for_light_cells(spark):
    """Cells beyond ``HEAVY`` of the capacity first, the heaviest before; all others in the fixed order of their numbers' hashes."""
    rows = [(c, 4000 if c in (7, 90) else 9000 if c == 400 else (c * 37) % 50 + 1, 1) for c in range(1000)]
    loads = spark.createDataFrame(rows, "cell int, load long, n long")
    prefs = {r.cell: r.prefs for r in ring._preferences(spark, loads.select("cell"), 4, 1024, 16).collect()}
    from pyspark.sql import functions as F

    order = [r.cell for r in loads.orderBy(F.xxhash64(F.lit("order"), "cell")).collect()]
    size = {c: n for c, n, _ in rows}
    cap = -(-sum(size.values()) // 4)
    first = sorted((c for c in order if size[c] > cap * ring.HEAVY), key=lambda c: (-size[c], order.index(c)))
    assert first[0] == 400 and len(first) == 3
    at, want = [0] * 4, {}
    for c in first + [c for c in order if c not in first]:
        s = next((s for s in prefs[c] if at[s] + size[c] <= cap), at.index(min(at)))
        at[s] += size[c]
        want[c] = s
    assert {r.cell: r.shard for r in ring.place_cells(loads, 4, 0.0, 1024, 16).collect()} == want
    assert max(at) <= cap * (1 + ring.HEAVY)


def test_ring_moves_little_at_the_parameters_of_the_query(spark):
    """Sizes with a long tail; a ninth shard would take 11.1 % of everything in a ring without bounds."""
    rng = random.Random(9)
    rows = [(i, int(rng.lognormvariate(6, 1.2)) + 1) for i in range(30_000)]
    df = spark.createDataFrame(rows, "k long, size long")
    places = [{r.k: r.shard for r in ring.shard_rows(df, ["k"], "size", n).select("k", "shard").collect()} for n in (8, 9)]
    total = sum(s for _, s in rows)
    for n, at in zip((8, 9), places, strict=True):
        loads = [sum(s for k, s in rows if at[k] == i) for i in range(n)]
        assert all(abs(x * n / total - 1) < ring.HEAVY for x in loads)
    moved = [(k, s) for k, s in rows if places[0][k] != places[1][k]]
    assert len(moved) < 0.135 * len(rows) and sum(s for _, s in moved) < 0.135 * total


def test_ring_query_holds_its_contract(spark, sf_dir):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = ring.op4_hash_ring(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    loads, slots = dict.fromkeys(range(8), 0), {}
    for r in got:
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(docs[r.doc_id]) + 1, zlib.crc32(docs[r.doc_id]), "bytes", None)
        loads[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    mean = sum(loads.values()) / 8
    assert max(loads.values()) - mean <= max(max(r["size"] for r in got) - mean, 0.01 * mean)


def test_ring_passes_clashing_columns_through(spark):
    names = ["k", "size", "cell", "first_choice", "slot_base", "shard", "slot", "moved", "_r", "row", "key", "pos", "load", "n"]
    rows = [(i, i % 7 + 1, *[f"{c}{i}" for c in names[2:]]) for i in range(200)] + [(None, 3, *[None] * 12)]
    df = spark.createDataFrame(rows, "k long, size long, " + ", ".join(f"{c} string" for c in names[2:]))
    got = ring.shard_rows(df, ["k"], "size", 3, cells=64, vnodes=4)
    assert got.columns == [c for c in names if c not in ("shard", "slot", "moved")] + ["shard", "slot", "moved"]
    assert {(r.k, r.cell, r.load, r["key"]) for r in got.collect()} == {(r[0], r[2], r[12], r[10]) for r in rows}
    long = spark.createDataFrame([(1, "x" * 300_000), (2, ""), (3, None), (3, None)], "k long, text string").selectExpr("*", "coalesce(octet_length(text), 0) + 1L AS size")
    assert sorted((r.k, r["size"]) for r in ring.shard_rows(long, ["k"], "size", 2).collect()) == [(1, 300_001), (2, 1), (3, 1), (3, 1)]


def test_ring_of_nothing(spark):
    assert ring.shard_rows(spark.createDataFrame([], "k long, size long"), ["k"], "size").count() == 0


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)] + ["THE", "of", "é", "9"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randrange(1, 30))) for i in range(12)] + [(50, None), (51, "?!"), (52, "w1"), (53, "w1 w2"), (2, "w3 of w4")]
    items.append((60, items[0][1]))
    docs = []
    for i in range(60):
        t = text(rng.randrange(0, 60))
        if rng.random() < 0.6:
            w = (rng.choice(items)[1] or "").split(" ")
            s = rng.randrange(len(w))
            t = t + ". " + " ".join(w[s : s + rng.randrange(3, 30)]).upper() + "," + text(5)
        docs.append((i, t))
    docs += [(100, None), (101, ""), (102, " .,"), (103, "the " * 3000), (5, items[3][1])]
    got = decontaminate.contamination(
        spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, row long"), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, n long")
    ).collect()
    key = lambda r: (r[0], r[1], r[2], r[3])
    assert sorted(map(key, [(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got])) == sorted(map(key, brute.contamination(docs, items)))


def test_decontamination_edges(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.contamination(docs, items).collect()] == [(1, 3, 0, 0, [], False)]
    assert decontaminate.contamination(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x gamma y alpha z beta q"), (2, "alpha " + "x " * 50 + "beta gamma"), (3, "alpha beta")], "doc_id long, text string")
    terms = decontaminate.item_terms(spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string"))
    index = decontaminate.build_index(docs)
    ids = {r["row"]: r.doc_id for r in index.filter("doc_id is not null").collect()}
    got = [(ids[r["row"]], r.item_id, r.start, r.stop, r.n_terms) for r in decontaminate.proximity_matches(index, terms, slop=3).collect()]
    assert got == [(1, 9, 1, 6, 3)]


def test_proximity_equals_brute_force(spark):
    rng = random.Random(16)
    words = [f"w{i}" for i in range(60)] + ["the", "of", "É"]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(text(n))) for i, n in enumerate([1, 2, 3, 5, 8, 13, 20, 20, 30, 200])]
    items += [(20, None), (21, "..."), (22, "the the the"), (23, "nowhere at all")]
    docs = []
    for i in range(50):
        body = text(rng.randrange(0, 120))
        for _ in range(rng.randrange(3)):
            part = rng.choice(items)[1]
            part = (part or "").split()
            rng.shuffle(part)
            at = rng.randrange(len(body) + 1)
            body[at:at] = [x for w in part[rng.randrange(2) :] for x in [w, *text(rng.randrange(2))]]
        docs.append((i, " ".join(body)))
    docs += [(100, None), (101, ""), (102, "the " * 4000), (103, " ".join(text(3000)))]
    terms = decontaminate.item_terms(spark.createDataFrame(items, "item_id long, text string"))
    index = decontaminate.build_index(spark.createDataFrame(docs, "doc_id long, text string"), terms.select("term"))
    ids = {r["row"]: r.doc_id for r in index.filter("term = ''").collect()}
    for slop in (0, 1, 3):
        got = {}
        for r in decontaminate.proximity_matches(index, terms, slop).collect():
            got.setdefault((ids[r["row"]], r.item_id), []).append((r.start, r.stop, r.n_terms))
        want = brute.proximity(docs, items, slop)
        assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 50
    none = decontaminate.item_terms(spark.createDataFrame([], "item_id long, text string"))
    assert decontaminate.proximity_matches(index, none).count() == 0


def check_pieces(got, window):
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for rs in by_doc.values():
        rs.sort(key=lambda r: r.start)
        at = 0
        for r in rs:
            assert r.start == at and r.length > 0
            at += r.length
        assert at == rs[0].doc_tokens
    sizes = []
    for s in range(len(by_seq)):
        at = 0
        for r in sorted(by_seq[s], key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        sizes.append(at)
    assert all(s == window for s in sizes[:-1]) and sizes[-1] <= window
    return by_doc, by_seq


def packing_docs():
    rng = random.Random(8)
    docs = [(i, rng.choice(["a"] * 6 + ["b"] * 3 + ["c", None]), prose(rng)) for i in range(200)]
    return [*docs, (300, "tiny", "x"), (301, "a", None), (302, "b", ""), (303, "a", "Don't, stop. <|endoftext|>É.\x1c!")]


def prose(rng):
    return " ".join(rng.choice(["Hello", "world,", "stop.", "don't", "12,3", "é.", "naïve"]) for _ in range(rng.randrange(0, 80)))


def round_robin(queues, quanta):
    """Deficit round-robin, one packet after the other. queues: lane -> packet sizes; the order of service as (lane, index)."""
    heads, deficit, order = dict.fromkeys(queues, 0), dict.fromkeys(queues, 0), []
    while any(heads[q] < len(queues[q]) for q in queues if quanta[q]):
        for q in sorted(queues):
            deficit[q] += quanta[q]
            while heads[q] < len(queues[q]) and queues[q][heads[q]] <= deficit[q]:
                deficit[q] -= queues[q][heads[q]]
                order.append((q, heads[q]))
                heads[q] += 1
    return order + [(q, i) for q in sorted(queues) for i in range(heads[q], len(queues[q]))]


@pytest.mark.parametrize("packet", [64, 10])
@pytest.mark.parametrize("weights", [None, {"a": 1, "b": 3}])
def test_packing(spark, weights, packet):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    docs = packing_docs()
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, source string, text string, start long").repartition(3)
    got = packing.pack(df, window=64, weights=weights, packet=packet).collect()
    by_doc, by_seq = check_pieces(got, 64)
    tok = Tokenizer.from_file(packing.default_tokenizer())
    assert set(by_doc) == {d for d, _, _ in docs}
    for d, _, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert b"".join(bytes(r.ids) for r in by_doc[d]) == raw
        assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in by_doc[d])
        assert len(by_doc[d]) <= 2 * (len(ids) // packet + 1)
    # the order within a queue is that of the rows; the order of service is that of the sequential algorithm
    source = {d: s or "" for d, s, _ in docs}
    total = sum(r.length for r in got)
    of = {}
    for r in got:
        of[source[r.doc_id]] = of.get(source[r.doc_id], 0) + r.length
    lanes = {q: q if (q in weights if weights else of[q] * 64 >= total) else packing.REST for q in of}
    if not weights:  # the rest is less than a token a window here, so it goes with the smallest lane
        least = min((q for q in of if lanes[q] == q), key=lambda q: (of[q], q))
        lanes = {q: least if lane == packing.REST else lane for q, lane in lanes.items()}
    packets = {}
    for d, rs in by_doc.items():
        for x in range(0, rs[0].doc_tokens, packet):
            piece = max((r for r in rs if r.start <= x), key=lambda r: r.start)
            g = piece.sequence_id * 64 + piece.offset + x - piece.start
            packets.setdefault(lanes[source[d]], []).append((g, min(packet, rs[0].doc_tokens - x)))
    queues = {q: [n for _, n in sorted(p)] for q, p in packets.items()}
    quanta = packing.quanta({q: sum(n) for q, n in queues.items()}, 64, weights)
    want, at = {q: [] for q in queues}, 0
    for q, i in round_robin(queues, quanta):
        want[q].append(at)
        at += queues[q][i]
    assert {q: [g for g, _ in sorted(p)] for q, p in packets.items()} == want
    # served within a packet of the target at every round, so in every run of windows
    ends = min(max(g + n for g, n in p) for q, p in packets.items() if quanta[q])
    for q, p in packets.items():
        for g in range(64, ends, 64):
            served = sum(min(n, max(0, g - x)) for x, n in p)
            assert not quanta[q] or abs(served - float(quanta[q]) * g / 64) <= 64 * len(queues)


def test_other_tokenizers_encode_whole_texts(spark):
    pytest.importorskip("public_tokenizers")
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = packing_docs()[-30:]
    got = packing.pack(spark.createDataFrame(docs, "doc_id long, source string, text string"), window=64, tokenizer=path).collect()
    by_doc, _ = check_pieces(got, 64)
    tok = Tokenizer.from_file(path)
    for d, _, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        assert b"".join(bytes(r.ids) for r in by_doc[d]) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_windows_hold_the_mixture(spark):
    """Eight sources of equal weight: each window is near the targets, at no more pieces than its packets."""
    pytest.importorskip("public_tokenizers")
    docs = [(i, f"s{i % 8}", "some words of a text " * (20 + i % 60)) for i in range(400)]
    got = packing.pack(spark.createDataFrame(docs, "doc_id long, source string, text string"), weights={f"s{i}": 1 for i in range(8)}).collect()
    windows = {}
    for r in got:
        mix = windows.setdefault(r.sequence_id, dict.fromkeys(range(8), 0))
        mix[r.doc_id % 8] += r.length
    full = [m for _, m in sorted(windows.items())][: len(windows) // 2]
    apart = [sum(abs(n / packing.WINDOW - 1 / 8) for n in m.values()) / 2 for m in full]
    assert len(full) > 10 and sum(apart) / len(apart) < 0.25
    assert len(got) <= sum(-(-r.doc_tokens // (packing.WINDOW // packing.PACKETS)) for r in got if not r.start) + len(windows)


def test_packing_of_nothing(spark):
    pytest.importorskip("public_tokenizers")
    assert packing.pack(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def test_pieces_break_at_borders_only():
    assert list(packing.pieces_of([5], 8, 10)) == [(0, 5, 5), (5, 10, 3)]
    assert list(packing.pieces_of([0, 10, 25], 23, 10)) == [(0, 0, 10), (10, 10, 10), (20, 25, 3)]
    assert list(packing.pieces_of([3, 13], 14, 10)) == [(0, 3, 7), (7, 10, 7)]


def test_digest_of_no_items(spark, sf_dir):
    got = decontaminate.op3_decontaminate(spark, sf_dir).filter("not contaminated").first()
    assert got.items_sha256 == hashlib.sha256(b"").hexdigest()
