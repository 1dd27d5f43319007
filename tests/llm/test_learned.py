import math
import random
import re
import zlib

from bytelode.llm import language, toxicity


def test_fuzzy_trie_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    terms = [toxicity.Term("idiot", False), toxicity.Term("idiom", False), toxicity.Term("scum", False), toxicity.Term("lowei", True)]
    trie = toxicity.FuzzyTrie(terms)

    def want(w):
        best = 9
        for t in terms:
            allowed = 1 if len(t.text) >= toxicity.FUZZY_FROM else 0
            for end in range(len(w) + 1) if t.is_stem else [len(w)]:
                d = distance(w[:end], t.text)
                if d <= allowed:
                    best = min(best, d)
        return -1 if best == 9 else best

    rng = random.Random(1)
    words = ["", "idiot", "idit", "idiiot", "idoit", "scum", "scvm", "lowei", "loweixyz", "lowexyz", "lweixyz", "xlowei"]
    for t in terms:
        for _ in range(300):
            w = list(t.text)
            for _ in range(rng.randrange(3)):
                i = rng.randrange(len(w) + 1)
                w[i : i + rng.randrange(2)] = rng.choice(["", "x", "i", "o"])
            words.append("".join(w) + rng.choice(["", "", "ab"]))
    for w in words:
        assert trie.distance(w) == want(w), w


def test_quotation_is_told_from_abuse():
    trie = toxicity.FuzzyTrie([toxicity.Term("idiot", False)])
    f = lambda t: [round(x, 3) for x in toxicity.features(t, {}, trie)]
    assert f("you idiot go away")[1] > 0 and f("you idiot go away")[3] == 0
    assert f('he wrote "you idiot" there')[3] > 0 and f('he wrote "you idiot" there')[1] == 0
    assert f("you idi0t")[2] > 0
    assert f(None) == f("") == [1, 0, 0, 0, 0, 0, 0, 0]
    assert f("x " * 50_000 + "idiot")[1] > 0


def test_text_of_more_words_than_the_cache(monkeypatch):
    trie, known = toxicity.FuzzyTrie([toxicity.Term("idiot", False)]), {}
    text = " ".join(f"word{i}" for i in range(450_000)) + " idiot"
    assert toxicity.features(text, known, trie)[1] > 0 and len(known) <= toxicity.CACHED_TOKENS
    monkeypatch.setattr(toxicity, "CACHED_TOKENS", 5)
    for t in ("a b c idiot", "d e f g", "a b c d e f g h idiot", "idiot", "ш щ 中 国 idiot"):
        assert (toxicity.features(t, known, trie)[1] > 0) == ("idiot" in t) and len(known) <= 5
    assert all(set(m) <= trie.letters | {""} | set("".join(map(str, m))) for m in trie.moves)


def labelled(spark):
    rng = random.Random(2)
    words = "the tree of house green river stone walks slowly under bright sky".split()
    docs, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        w = [rng.choice(words) for _ in range(30)]
        if bad:
            for _ in range(3):
                w[rng.randrange(30)] = rng.choice(["vilest", "scorner", "lowei" + rng.choice(["ab", "cd", "ef", "gh", "ij"])])
        docs.append((i, " ".join(w), "en"))
        labels.append((i, int(bad)))
    docs += [(1000, None, "en"), (1001, "", "en"), (None, "vilest scorner", "en")]
    labels += [(1000, 0), (1001, None), (None, 1), (0, 1), (5000, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    assert {t.text for t in model.terms if t.is_stem} == {"lowei"}
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(got) == 603 and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(600))
    assert got[1000] < 0.5 and got[1001] < 0.5
    novel = spark.createDataFrame([(1, "walks loweizz slowly viilest stone sc0rner river")], "doc_id long, text string")
    assert toxicity.score(novel, model).first().score >= 0.5


def test_toxicity_of_repeated_rows_and_clashing_columns(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs.unionByName(docs), labels.unionByName(labels))
    twice = docs.unionByName(docs).withColumnRenamed("score", "bad").selectExpr("*", "'x' AS n_hits", "'y' AS toxic", "'z' AS f0")
    got = toxicity.score(twice, model)
    assert got.columns == ["doc_id", "text", "bad", "toxic", "f0", "score", "n_hits"]
    rows = got.collect()
    assert len(rows) == 1206 and len({(r.doc_id, r.score) for r in rows}) == 603


def test_toxicity_without_labels(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels.limit(0))
    assert {r.score < 0.01 for r in toxicity.score(docs, model).collect()} == {True}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_language_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language.op9_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.9 * len(got)


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "123 !?", "en"), (4, "some words here", None)], "doc_id long, text string, lang string")
    model = language.train(docs.filter("doc_id = 4"))
    assert model is None
    assert {r.lang_pred for r in language.predict(docs, model).collect()} == {"und"}
    train = spark.createDataFrame([(i, "the cat " * 5, "en") for i in range(9)] + [(i, "le chat ça " * 5, "fr") for i in range(20, 29)], "doc_id long, text string, lang string")
    model = language.train(train)
    out = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, model).collect()}
    assert [out[i][0] for i in (1, 2, 3)] == ["und"] * 3 and out[4][0] in ("en", "fr") and 0 <= out[4][1] <= 1
    assert language.predict(docs.limit(0), model).count() == 0
    long = spark.createDataFrame([(1, "le chat ça " * 50_000)], "doc_id long, text string")
    assert language.predict(long, model).first().lang_pred == "fr"


def test_language_of_marks_that_are_no_letters(spark):
    train = spark.createDataFrame([(i, "the cat " * 5, "en") for i in range(9)] + [(i, "le chat ça " * 5, "fr") for i in range(20, 29)], "doc_id long, text string, lang string")
    model = language.train(train)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(["² ½", "①②", "Ⅷ", "12 _ ٣", "é", "中"])], "doc_id long, text string, lang_pred string, rejected int")
    got = language.predict(docs.unionByName(docs), model)
    assert got.columns == ["doc_id", "text", "lang_pred", "score", "rejected"]
    rows = got.collect()
    assert len(rows) == 12 and len(set(rows)) == 6
    assert {r.doc_id: r.lang_pred == "und" for r in rows} == {0: True, 1: True, 2: True, 3: True, 4: False, 5: False}


def test_language_sample_counts_a_repeated_text_once(spark):
    from pyspark.sql import functions as F

    copies = spark.range(100_000).select("id", F.lit("the cat sat on the mat").alias("text"), F.lit("en").alias("lang"))
    rest = spark.range(100_000, 102_000).select("id", F.concat(F.lit("a house and a green river "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    other = spark.range(200_000, 200_300).select("id", F.concat(F.lit("le chat vert "), F.col("id").cast("string")).alias("text"), F.lit("fr").alias("lang"))
    docs = copies.unionByName(rest).unionByName(other).withColumnRenamed("id", "doc_id")
    few = language.training_texts(docs, 500).collect()
    assert len(few) == len(set(few)) and 400 < sum(r.lang == "en" for r in few) <= 500
    assert 180 < sum(r.lang == "fr" for r in few) <= 300


def test_toxicity_of_repeated_ids_learns_from_the_smallest_text(spark):
    docs = spark.createDataFrame([(i, t) for i in range(40) for t in (f"b {i}", f"a {i}", None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i in range(40) for y in (0, i % 2)], "doc_id long, toxic int")
    for n in (1, 5):
        got = {(r.doc_id, r.text, r.toxic) for r in toxicity.training_rows(docs.repartition(n), labels).collect()}
        assert got == {(i, f"a {i}", i % 2) for i in range(40) if zlib.crc32(str(i).encode()) % 5}


def test_toxicity_scores_equal_brute_force(spark):
    """Every token against every term by edit distance, its context read anew, then the weighted sum."""
    words = {"idiot": 1, "morons": 1, "scum": 0}
    model = toxicity.ToxicityModel(tuple(toxicity.Term(w, False) for w in words), (-2.0, 1.5, 0.7, -0.4, 0.9, 0.3, 0.02, -0.1))

    def within_one(a, b):
        edits = {b} | {b[:i] + b[i + 1 :] for i in range(len(b))}
        return a in edits or b in {a[:i] + a[i + 1 :] for i in range(len(a))} or len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1

    def want(text):
        low = (text or "").lower()
        places = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[\w@$*]+", low)]
        kind = [0 if w in words else 1 if any(k and within_one(w, t) for t, k in words.items()) else -1 for _, _, w in places]
        counts = dict.fromkeys(("exact", "fuzzy", "quoted", "addressed"), 0)
        for i, k in enumerate(kind):
            if k < 0:
                continue
            left = low[places[max(0, i - 6)][0] : places[i][0]]
            right = low[places[i][1] : places[min(len(places) - 1, i + 6)][1] + 1]
            opened = sum(left.count(q) for q in "\"“”„«‹»'‘") % 2 == 1
            closed = any(q in right for q in "\"”“«»›'’")
            counts["quoted" if opened and closed else ("exact", "fuzzy")[k]] += 1
            other = [j for j, o in enumerate(kind) if o >= 0 and j != i and abs(j - i) <= 6]
            counts["addressed"] += bool(other) or "!" in right
        some = any(k >= 0 for k in kind)
        share = 100 * (counts["exact"] + counts["fuzzy"]) / len(places) if some else 0
        x = [1, *(math.log1p(counts[c]) for c in counts), counts["exact"] > 1, share, math.log1p(len(places))]
        return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights, strict=True))))

    rng = random.Random(8)
    pool = ["idiot", "idot", "idi0t", "ixiox", "morons", "moron", "scum", "scom", "you", "are", "he", "said", "!", '"', "“", "”", "'", "don't", "été", ".", "IDIOT"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(200)] + [None, "", "!!!", "idiot", "you " * 20_000 + "scum!"]
    rows = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert all(abs(r.score - want(texts[r.doc_id])) < 1e-9 for r in rows) and len(rows) == len(texts)


def test_language_equals_nearest_centroid_by_brute_force(spark):
    """N-grams counted one by one, cosines in exact order of the centroids."""
    rng = random.Random(3)
    words = {"xx": ["alpha", "beta", "gamma", "delta"], "yy": ["ein", "zwei", "drei", "über"], "zz": ["один", "два", "три", "пять"]}
    texts = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(3, 30))), lang) for i, lang in enumerate(list(words) * 40)]
    texts += [(900, None, None), (901, "", None), (902, "12 34", None), (903, "alpha " * 30_000 + "zwei", None), (904, "beta два", None)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    model = language.train(df)

    def grams(text):
        raw = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 else 32 for c in text.encode())
        x = b" " + re.sub(b" +", b" ", raw) + b" "
        mask, found = (1 << 32) - 1, {}
        for i in range(len(x)):
            two = (x[i] * 0x9E3779B1 + x[i + 1] * 0x85EBCA77) & mask if i + 1 < len(x) else None
            three = (two * 0xC2B2AE3D + x[i + 2] * 0x27D4EB2F) & mask if i + 2 < len(x) else None
            for h in (x[i] * 0x165667B1 & mask, two, three):
                if h is not None:
                    found[h >> 20] = found.get(h >> 20, 0) + 1
        return found

    for r in language.predict(df, model).collect():
        text = dict((d, t) for d, t, _ in texts)[r.doc_id]
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0, True)
            continue
        v = {h: math.log1p(n) * float(model.idf[h]) for h, n in grams(text).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cosines = [sum(x * float(c[h]) for h, x in v.items()) / norm for c in model.centroids]
        best = max(range(len(cosines)), key=lambda j: (cosines[j], -j))
        assert abs(r.score - min(1, max(0, cosines[best]))) < 1e-4
        near = {model.languages[j] for j, c in enumerate(cosines) if c > cosines[best] - 1e-5}
        assert r.lang_pred in near
        if abs(cosines[best] - model.reach[best]) > 1e-4 and len(near) == 1:
            assert r.rejected == (cosines[best] < model.reach[best])
