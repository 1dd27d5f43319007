"""Generic names, nesting, regions, stack heights, statements and jump chains against plain versions and damaged input."""

import random
import time

import pytest
from pyspark.sql import functions as F

from bytelode.functions.bytecode import cil_instructions, jvm_instructions
from bytelode.functions.effects import changes
from bytelode.operators import dotnet, flow, frames, patterns, regions
from bytelode.plans import generics
from bytelode.sources import encode, pe

META = pe.MD


def metadata(spark, rows):
    """Metadata of rows (file_id, table, rid, cells, texts, blobs)."""
    filled = [(f, t, r, c, x, [None if b is None else bytearray(b) for b in blobs], None, None, None, None, None) for f, t, r, c, x, blobs in rows]
    return spark.createDataFrame(filled, META)


def types(file_id, names):
    return [(file_id, 2, i, [0, 0, 0, 0, 1, 1], [None, n, "", None, None, None], [None] * 6) for i, n in enumerate(names, 1)]


def nest(file_id, pairs):
    return [(file_id, 41, i, [child, parent], [None, None], [None, None]) for i, (child, parent) in enumerate(pairs, 1)]


def test_nested_types_in_a_ring_leave_other_files_alone(spark):
    rows = types("ring", ["<Module>", "A", "B", "C", "D", "Top"]) + nest("ring", [(2, 3), (3, 4), (4, 2), (5, 2)])
    rows += types("self", ["<Module>", "A"]) + nest("self", [(2, 2)])
    rows += types("deep", ["<Module>", *(f"T{i}" for i in range(40))]) + nest("deep", [(i + 1, i) for i in range(2, 41)])
    md = metadata(spark, rows)
    start = time.time()
    got = {(r.file_id, r.rid): (r.top, r.rids, r.ring) for r in dotnet.nested_paths(md).collect()}
    assert all(got["ring", i] == (None, [], True) for i in (2, 3, 4, 5)) and got["ring", 6] == (6, [], False)
    assert got["self", 2] == (None, [], True)
    assert all(got["deep", i] == (2, list(range(3, i + 1)), False) for i in range(2, 42))
    out = dotnet.declarations(md).collect()
    assert time.time() - start < 120
    assert sorted((r.file_id, r.error) for r in out if r.error) == [("ring", "nested types form a ring"), ("self", "nested types form a ring")]
    assert {(r.file_id, r.file_name) for r in out if not r.error} == {("ring", "Top.cs"), ("deep", "T0.cs")}


def test_specifications_in_a_ring_show_as_unknown(spark):
    ref = lambda rid: b"\x1d" + generics._type(27, rid)
    spec = lambda f, rid, blob: (f, 27, rid, [0], [None], [blob])
    rows = [spec("a", 1, ref(2)), spec("a", 2, ref(1)), spec("a", 3, ref(4)), spec("a", 4, ref(5)), spec("a", 5, b"\x1d\x08"), spec("a", 6, b"\xff"), spec("a", 7, ref(99)), spec("a", 8, None)]
    got = {r.rid: r.name for r in dotnet.spec_names(metadata(spark, rows)).collect()}
    assert got == {1: "?[]", 2: "?[]", 3: "int[][][]", 4: "int[][]", 5: "int[]", 6: "?", 7: "?[]", 8: "?"}


def test_names_in_context(spark):
    names = [f"T{i}" for i in range(12)]
    df = spark.createDataFrame([("Map<!0, !!0>, !11, !1", names, ["U"]), ("!0", None, None)], "t string, own array<string>, method array<string>")
    got = [r[0] for r in df.select(dotnet.in_context(F.col("t"), F.col("own"), F.col("method"))).collect()]
    assert got == ["Map<T0, U>, T11, T1", "!0"]


def plain_nesting(intervals):
    """id -> (depth, parent, crosses), by a stack."""
    out, open_ = {}, []
    for a, b, rank, i in sorted(intervals, key=lambda x: (x[0], -x[1], x[2], x[3])):
        while open_ and open_[-1][0] <= a:
            open_.pop()
        out[i] = (len(open_), open_[-1][1] if open_ else None, bool(open_) and open_[-1][0] < b)
        open_.append((b, i))
    return out


def test_nesting_equals_a_stack(spark):
    rng = random.Random(3)

    def cut(a, b, depth, into):
        while a < b and depth:
            x = rng.randint(a, b)
            y = rng.randint(x, b)
            if x < y:
                into.append((x, y))
                cut(x, y, depth - 1, into)
            a = max(y, a + 1)
        return into

    rows, want = [], {}
    for m in range(60):
        found = sorted(set(cut(0, 60, 4, [])))
        own = [(a, b, 0, f"i{i}") for i, (a, b) in enumerate(found)]
        rows += [(m, *r) for r in own] + [(m, 5, 5, 0, "empty")]
        want |= {(m, i): v for i, v in plain_nesting(own).items()}
    df = spark.createDataFrame(rows, "m int, start int, stop int, rank int, id string").repartition(7)
    got = {(r.m, r.id): (r.depth, r.parent, r.crosses) for r in regions.nested(df, ["m"]).collect()}
    assert got == want


def test_crossing_regions_are_marked(spark):
    df = spark.createDataFrame([(1, 0, 10, 0, "a"), (1, 5, 15, 0, "b")], "m int, start int, stop int, rank int, id string")
    assert {r.id: (r.depth, r.parent, r.crosses) for r in regions.nested(df, ["m"]).collect()} == {"a": (0, None, False), "b": (1, "a", True)}


def plain_heights(code, entries):
    """Heights where instructions begin, by a walk over all paths from the start; None where they differ."""
    delta, rows = changes("jvm"), {r[0]: r for r in jvm_instructions(code)}
    found, work = {}, [(0, 0), *entries]
    while work:
        at, h = work.pop()
        if at in found:
            if found[at] != h:
                found[at] = None
            continue
        if at not in rows:
            continue
        found[at] = h
        _, _, name, size, _, _, targets, *_ = rows[at]
        h += delta[name]
        work += [(t, h) for t in targets]
        if name not in ("goto", "return", "athrow"):
            work.append((at + size, h))
    return found


def random_code(rng, consistent):
    """Code of labelled blocks; each keeps the height its label stands for if ``consistent``."""
    n = rng.randint(2, 14)
    height = [0, *(rng.randint(0, 3) for _ in range(n - 1))]
    lines = []
    for i in range(n):
        lines.append(f"b{i}")
        h = height[i]
        to = rng.randrange(n)
        want = height[to] if consistent else rng.randint(0, 3)
        how = rng.choice(["goto", "if", "return"]) if i < n - 1 else "return"
        if how == "return":
            lines.append(("return",))
            continue
        if how == "if":
            # the branch takes one value, and both ways must fit
            want = height[i + 1]
            if consistent and height[to] != want:
                to = i + 1
            want += 1
        lines += [("iconst_0",)] * max(0, want - h) + [("pop",)] * max(0, h - want)
        lines.append(("goto", f"b{to}") if how == "goto" else ("ifeq", f"b{to}"))
    return encode.assemble(lines, "jvm")


def test_stack_heights_equal_a_walk(spark):
    rng = random.Random(9)
    rows, entries, want = [], [], {}
    for m in range(80):
        parts, places = random_code(rng, True)
        code = b"".join(parts)
        rows.append((m, bytearray(code)))
        want[m] = plain_heights(code, [])
    from bytelode.functions.bytecode import instructions
    from bytelode.functions.effects import change_table

    methods = spark.createDataFrame(rows, "m int, code binary").repartition(5)
    df = instructions(methods, ["m"], "jvm").join(F.broadcast(change_table(spark, "jvm")), "name")
    none = spark.createDataFrame(entries, "m int, offset int, height int")
    got = frames.stack_heights(df, ["m"], none).collect()
    assert len(got) > 200
    for r in got:
        assert not r.conflict
        # a block that nothing reaches has a height only if it goes on to one that has
        if r.start in want[r.m]:
            assert r.height == want[r.m][r.start], (r, want[r.m])
            assert r.temps == ([f"T{r.start:04X}_{i}" for i in range(r.height)] if r.n_before > 1 else [])


def test_every_opcode_has_a_change_of_height():
    assert {n for n, d in changes("jvm").items() if d is None} == {"getstatic", "putstatic", "getfield", "putfield", "invokevirtual", "invokespecial", "invokestatic", "invokeinterface", "invokedynamic", "multianewarray"}
    assert changes("cil")["ldelem.i4"] == -1 and changes("cil")["stfld"] == -2 and changes("jvm")["dup2_x1"] == 2 and changes("jvm")["lushr"] == -1


def test_assembler_reads_back():
    parts, places = encode.assemble(["a", ("bipush", -3), ("ifeq", "a"), ("iinc", 1, 2), ("goto", "z"), "z", ("return",)], "jvm")
    assert [(r[0], r[2], r[6]) for r in jvm_instructions(b"".join(parts))] == [(0, "bipush", []), (2, "ifeq", [0]), (5, "iinc", []), (8, "goto", [11]), (11, "return", [])] and places == {"a": 0, "z": 11}
    parts, _ = encode.assemble([("ldc.i4", 7), ("br", "z"), ("ldftn", 0x06000001), "z", ("ceq",)], "cil")
    assert [(r[0], r[2], r[6]) for r in cil_instructions(b"".join(parts))] == [(0, "ldc.i4", []), (5, "br", [16]), (10, "ldftn", []), (16, "ceq", [])]


def test_threaded_jumps_equal_a_walk(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for m in range(40):
        n = rng.randint(1, 12)
        goes = [rng.randrange(n + 1) if rng.random() < 0.5 else min(i + 1, n) for i in range(n)]
        parts, places = encode.assemble([x for i, g in enumerate(goes) for x in (f"b{i}", ("goto", f"b{g}"))] + [f"b{n}", ("return",)], "jvm")
        rows.append((m, bytearray(b"".join(parts))))
        for i, g in enumerate(goes):
            at, seen = g, set()
            while at < n and at not in seen:
                seen.add(at)
                at = goes[at]
            ring = at < n
            want[m, places[f"b{i}"]] = (places[f"b{g if ring else at}"], 0 if ring else len(seen), ring)
    from bytelode.functions.bytecode import instructions

    instr = instructions(spark.createDataFrame(rows, "m int, code binary").repartition(3), ["m"], "jvm")
    assert {(r.m, r.source): (r.final, r.hops, r.ring) for r in flow.threaded_jumps(instr, ["m"]).collect()} == want


@pytest.mark.parametrize("same", [True, False])
def test_a_lock_must_leave_the_monitor_it_entered(spark, same):
    from bytelode.plans import shapes

    lines, clauses = shapes.NET_SHAPES[1]
    if not same:
        at = max(i for i, x in enumerate(lines) if x == ("ldloc.s", 7))
        lines = [*lines[:at], ("ldloc.s", 6), *lines[at + 1 :]]
    was = shapes.NET_SHAPES
    try:
        shapes.NET_SHAPES = [(lines, clauses)]
        image = shapes._image_of([0, 1])
    finally:
        shapes.NET_SHAPES = was
    md = pe.decode_images(spark.createDataFrame([("f", "pe", bytearray(image))], "file_id string, kind string, content binary"))
    got = [(r.kind, r.variable, r.start, r.stop) for r in patterns.clr_statements(md).collect()]
    assert got == ([("lock", 7, 5, 20)] * 2 if same else [])


def test_empty_inputs(spark):
    instr = spark.createDataFrame([], "m int, pos int, offset int, name string, size int, ref long, targets array<int>, delta int, text string")
    none = spark.createDataFrame([], "m int, offset int, height int")
    assert frames.stack_heights(instr, ["m"], none).count() == 0 and flow.threaded_jumps(instr, ["m"]).count() == 0
    assert dotnet.spec_names(metadata(spark, [])).count() == 0 and dotnet.nested_paths(metadata(spark, [])).count() == 0


def test_units_are_files_of_their_names(spark, tmp_path):
    from bytelode.sources import units

    units.register(spark)
    rows = [("f", 1, "A.cs", "one\n"), ("f", 2, "a.cs", "two"), ("g", 1, "A.cs", None), ("g", 2, "B_é.cs", "ü"), ("g", 3, None, "no name"), ("g", 4, "bare", "x"), ("h", 4, "bare", "y")]
    df = spark.createDataFrame(rows, "file_id string, rid int, file_name string, source string").repartition(4)
    out = tmp_path / "out"
    units.with_own_names(df).write.format("units").mode("append").save(str(out))
    assert {p.name: p.read_text() for p in out.iterdir()} == {"A.cs": "one\n", "a_2.cs": "two", "A_3.cs": "", "B_é.cs": "ü", "bare": "x", "bare_2": "y"}
    # a job that fails leaves nothing, and what was there stays
    bad = df.select(F.when(F.col("rid") == 4, "a/b").otherwise(F.concat("file_name", F.col("rid").cast("string"), "file_id")).alias("file_name"), "source").filter("file_name is not null")
    with pytest.raises(Exception, match="not a file name"):
        bad.write.format("units").mode("append").save(str(out))
    assert len([p for p in out.iterdir() if not p.name.startswith("_")]) == 6
    units.with_own_names(df.filter("rid = 2")).write.format("units").mode("overwrite").save(str(out))
    assert {p.name for p in out.iterdir() if not p.name.startswith("_")} == {"a.cs", "B_é.cs"}


def test_a_retried_task_leaves_no_twin(tmp_path):
    from bytelode.sources.units import UnitsWriter

    w = UnitsWriter(str(tmp_path / "out"), False)
    first, again, other = w.write([("A.cs", "lost")]), w.write([("A.cs", "kept")]), w.write([])
    assert not (tmp_path / "out" / "A.cs").exists()
    w.commit([again, other])
    assert first.folder != again.folder and {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"A.cs": "kept"}


def test_many_names_in_one_text(spark):
    from bytelode.functions import search

    rng = random.Random(2)
    for _ in range(200):
        words = list({"".join(rng.choices("ab", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 9))})
        text = "".join(rng.choices("abc", k=rng.randint(0, 12)))
        assert search.missing(text, words) == [w for w in words if w not in text]
    df = spark.createDataFrame([("xay", ["a", "b"]), (None, ["a"]), ("a", None)], "t string, n array<string>")
    assert [r[0] for r in df.select(search.names_missing_in(F.col("t"), F.col("n"))).collect()] == [["b"], ["a"], []]


@pytest.fixture(scope="module")
def binaries_dir(tmp_path_factory):
    import zipfile

    from bytelode.plans import shapes

    out = tmp_path_factory.mktemp("binaries")
    classes = {f"p{i}/C{i}": encode.class_bytes(f"p{i}/C{i}", [], [encode.Member(f"m{j}", "()V", 1, code=[b"\xb1"]) for j in range(50)]) for i in range(6)}
    (out / "sub").mkdir()
    for name, data in list(classes.items())[:3]:
        (out / "sub" / f"{name.split('/')[1]}.CLASS").write_bytes(data)
    with zipfile.ZipFile(out / "all.jar", "w") as z:
        for name, data in list(classes.items())[3:]:
            z.writestr(f"{name}.class", data)
        z.writestr("damaged.class", b"\xca\xfe\xba\xbe\0\0")
        z.writestr("readme.txt", "text")
    (out / "image.dll").write_bytes(shapes._image_of(list(range(20))))
    (out / "broken.dll").write_bytes(b"MZ")
    (out / "notes.txt").write_text("not read")
    return str(out)


def test_names_are_filtered_in_the_scan(spark, binaries_dir):
    from bytelode.operators import jvm
    from bytelode.sources import binaries, classfile, scan

    types_ = scan.register(spark).read.format("binary_types").load(binaries_dir)
    every = types_.collect()
    assert {r.name for r in every if not r.error} == {*(f"p{i}.C{i}" for i in range(6)), "Shape.Shapes"} and sum(bool(r.error) for r in every) == 2
    assert all(r.decoded < len(r.content) for r in every if not r.error)
    one = types_.filter("simple = 'C4'")
    got = one.collect()
    assert [r.name for r in got] == ["p4.C4"] and sum(len(r.content) for r in got) * 5 < sum(len(r.content or b"") for r in every)
    assert types_.filter("name in ('p1.C1', 'Shape.Shapes', 'none')").count() == 2 and types_.filter("kind = 'pe' and error is null").count() == 1
    assert types_.filter("simple = 'C4' and simple = 'C3'").count() == 0 and types_.filter("length(name) = 5").count() == 6
    # what is left decodes as before
    named = jvm.class_names(classfile.decode_classes(scan.class_blobs(one)))
    assert [r.this_name for r in named.collect()] == ["p4/C4"]
    assert {r.name for r in dotnet.list_types(pe.decode_images(scan.images(types_))).collect()} == {"Shape.Shapes"}
    # files have the same ids as when they are read whole
    assert {r.file_id for r in every} == {r.file_id for r in binaries.inputs(spark, binaries_dir).collect()}
    assert all(r.content is None for r in spark.read.format("binary_types").option("content", "false").load(binaries_dir).collect())


def plain_dominators(steps):
    """block -> dominators of those that the first block reaches: without a dominator a block is out of reach."""
    nodes = {n for e in steps for n in e}
    first = min(nodes)

    def reached(without):
        seen, work = set(), [first] if first != without else []
        while work:
            n = work.pop()
            if n not in seen:
                seen.add(n)
                work += [t for s, t in steps if s == n and t != without]
        return seen

    every = reached(None)
    gone = {d: every - reached(d) for d in every}
    return {n: sorted(d for d in every if n in gone[d]) for n in every}


def test_dominators_equal_removal_of_blocks(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for m in range(60):
        n = rng.randint(2, 10)
        steps = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 2 * n))}
        rows += [(m, *e) for e in steps]
        want |= {(m, k): v for k, v in plain_dominators(steps).items()}
    df = spark.createDataFrame(rows, "m int, source int, target int").repartition(5)
    assert {(r.m, r.block): r.dom for r in flow.dominators(df, ["m"]).collect()} == want
