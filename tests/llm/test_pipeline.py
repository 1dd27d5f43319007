"""Every stage against brute force over what its predecessor kept."""

import corpus_pipeline as pipeline
from bytelode.llm import toxicity
from tests.llm import brute


def test_near_copies_from_80_percent_go(spark, sf_dir):
    words = [f"w{i}" for i in range(204)]
    swap = lambda *at: " ".join("new" if i in at else w for i, w in enumerate(words))
    texts = [(1, swap()), (2, swap(20, 80, 140)), (3, swap(20, 60, 100, 140)), (4, swap(*range(5, 200, 9)))]
    want = {d for d, (_, root) in brute.near_duplicates(texts, 80).items() if d == root}
    assert want == {1, 4} and {d for d, (_, root) in brute.near_duplicates(texts[::2]).items() if d == root} == {1, 3}
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()} == want
    pair = pipeline.drop_near_duplicates(spark, docs.filter("doc_id in (1, 3)"), sf_dir)
    assert {r.doc_id for r in pair.collect()} == {1}


NAMES = ["doc_id", "text", "lang", "source", "n_chars", "score", "n_hits", "n_lines", "n_dropped", "kept", "n", "row", "cls", "h", "key", "term", "contaminated", "rep"]


def edge_docs(spark, sf_dir):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with the operators' names."""
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    line = "a line that stands in two of the documents here"
    texts = [
        (1, line), (2, line.upper()), (3, f"{line}\nand one that is its own, long enough to stay"), (4, None), (5, ""), (6, " \n\t "), (7, "tiny"), (7, "tiny"),
        (8, "word " * 200_000), (9, f"before it {item} and behind it"), (None, "no id and a text of its own to be kept"), (None, None), (10, "x" * 300_000), (11, "é" * 9 + "\n" + "é" * 9),
    ]
    rows = [(d, t, None if i % 2 else "en", None if i % 3 else "src", None, *[f"{c}{i}" for c in NAMES[5:]]) for i, (d, t) in enumerate(texts)]
    types = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in NAMES[5:])
    return spark.createDataFrame(rows, types), texts


def test_stages_on_edges(spark, sf_dir):
    docs, texts = edge_docs(spark, sf_dir)
    want = {"toxicity": [d for d, _ in texts], "line_dedup": [d for d, _ in texts if d != 2], "minhash_near_dedup": [d for d, _ in texts if d != 2], "decontamination": [d for d, _ in texts if d != 9]}
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        out = stage(spark, docs, sf_dir)
        if name == "packing":
            got = out.collect()
            assert sum(r.length for r in got if r.start == 0 and r.doc_id == 7) == sum(r.doc_tokens for r in got if r.doc_id == 7)
            assert {r.doc_id for r in got} == {d for d, _ in texts} and {r.doc_tokens for r in got if r.doc_id in (4, 5, 6)} == {1}
            continue
        assert out.columns == NAMES and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        rows = out.collect()
        assert sorted(r.doc_id or 0 for r in rows) == sorted(d or 0 for d in want[name]), name
        held = {r.rep: r for r in docs.collect()}
        assert all(tuple(r)[5:] == tuple(held[r.rep])[5:] and (name == "line_dedup" or r == held[r.rep]) for r in rows)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == columns
            out = spark.createDataFrame(out.collect(), docs.schema)
        kept[name] = out
        if name == "toxicity":
            model = toxicity.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
            bad = {r.doc_id for r in toxicity.score(docs, model).filter("score >= 0.5").collect()}
            assert {r.doc_id for r in out.collect()} == set(before) - bad
        if name == "line_dedup":
            left = [(d, t) for d, _, lost, t in brute.dedup_lines(sorted(before.items())) if not lost or t.strip(" \t\n\x0b\x0c\r")]
            assert sorted((r.doc_id, r.text, r.n_chars) for r in out.collect()) == sorted((d, t, len(t)) for d, t in left)
        if name == "minhash_near_dedup":
            want = {d for d, (_, root) in brute.near_duplicates(sorted(before.items()), pipeline.NEAR).items() if d == root}
            assert {r.doc_id for r in out.collect()} == want
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            want = {d for d, _, hit, _ in brute.contamination(sorted(before.items()), items) if not hit}
            assert {r.doc_id for r in out.collect()} == want
        if name == "packing":
            assert {r.doc_id for r in out.select("doc_id").collect()} == set(before)
        docs = out
    assert sorted(r.doc_id for r in pipeline.run(spark, sf_dir).select("doc_id").distinct().collect()) == sorted(
        r.doc_id for r in kept["decontamination"].select("doc_id").collect()
    )
