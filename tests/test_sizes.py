"""What shows on larger tables only: names that meet, files over tasks, joins by size."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import types as T

import __spark_entry__ as entry
from bytelode import session
from bytelode.functions import bytecode, signatures
from bytelode.operators import dotnet
from bytelode.plans import assemblies, enums, generics, loops
from bytelode.sources import classfile, encode, pe


def test_sources_of_one_class_name_are_one_class(spark, tmp_path):
    """NATION_1 with span 17 and NATION_11 with span 7 give one name."""
    spark.createDataFrame([(1, "NATION_1"), (11, "NATION_11")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    keys = [(17 * 1024 + i, 1) for i in range(3)] + [(7 * 1024 + i, 11) for i in range(4)] + [(5, 1)]
    spark.createDataFrame(keys, "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    got = entry.queries()["jvm_generic_sources"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    for t in ("nation", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["jvm_generic_sources"]).fetchall()
    assert len(want) == 2 and sorted(map(tuple, got)) == sorted(want)


class _Files:
    """Stands for a frame of files: runs the decoder in place."""

    def __init__(self, *images):
        self.images = images

    def filter(self, *_):
        return self

    select = filter

    def mapInArrow(self, run, _):
        ids = pa.array([str(i) for i in range(len(self.images))])
        return run([pa.RecordBatch.from_arrays([ids, pa.array(self.images, pa.binary())], ["file_id", "content"])])


def test_decoded_rows_leave_a_task_in_batches_of_bounded_bytes(spark):
    """F8: a batch was 1000 rows of one file: few for a small file, any number of bytes for a large one."""
    large, small = encode.Assembly(), encode.Assembly()
    for a, n, size in ((large, 400, 50_000), (small, 3, 10)):
        a.add(0, 0, "image", 1, 0, 0)
        for i in range(n):
            a.add(17, bytes([i % 251]) * size)
    batches = list(pe.decode_images(_Files(large.bytes(), *[small.bytes()] * 300, b"MZ")))
    assert max(b.nbytes for b in batches) < 2 * pe.BATCH_BYTES and max(b.num_rows for b in batches) <= pe.BATCH_ROWS
    assert len(batches) < 12
    rows = [r for b in batches for r in b.to_pylist()]
    assert len(rows) == 401 + 300 * 4 + 1 and rows[-1]["error"] and [r["blobs"][0] for r in rows if r["file_id"] == "0" and r["table"] == 17] == [bytes([i % 251]) * 50_000 for i in range(400)]


def test_method_signatures_are_worked_out_once(spark, sf_dir):
    """declarations read them three times, units of IL twice."""
    md = generics._md(spark, sf_dir)
    assert dotnet.method_types(md) is dotnet.method_types(md)
    wanted = dotnet.render_types(md, pe.view(md, 6), "Signature", "method")
    assert sorted(dotnet.method_types(md).collect()) == sorted(wanted.collect())


class _Batch:
    """Stands for a frame of one Arrow batch: runs a stage in place."""

    def __init__(self, *columns, names):
        self.batch = pa.RecordBatch.from_arrays(list(columns), names)

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run([self.batch])


def test_decoded_classes_leave_a_task_in_batches_of_bounded_bytes(spark):
    """F16: sixteen classes of any size were one batch of objects."""
    large = encode.class_bytes("a/Large", [], [encode.Member(f"m{k}", "(IJ)I", 1, code=[b"\x03\xac"], stack=1, locals=4) for k in range(2500)])
    small = encode.class_bytes("a/Small", [encode.Member("f", "I", 1)], [])
    assert len(large) > 1 << 16
    blobs = [large] * 4 + [small] * 40 + [b"no class", None]
    batches = list(classfile.decode_classes(_Batch(pa.array(range(46)), pa.array(blobs, pa.binary()), pa.nulls(46, pa.string()), names=["class_id", "bytes", "error"])))
    assert [b.num_rows for b in batches] == [1] * 4 + [16, 16, 10]
    rows = [r for b in batches for r in b.to_pylist()]
    assert [r["class_id"] for r in rows] == list(range(46)) and [len(r["members"] or ()) for r in rows] == [2500] * 4 + [1] * 40 + [0, 0]
    assert [r["error"] for r in rows[-3:]] == [None, "not a class file", None]


class _Code(_Batch):
    schema = T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("code", T.BinaryType())])
    filter = _Batch.select


def test_instructions_leave_a_task_in_batches_of_bounded_rows(spark):
    """the instructions of 512 methods of any length were one batch of objects."""
    switch = b"\xaa\0\0\0" + (0).to_bytes(4) + (0).to_bytes(4) + (2999).to_bytes(4) + b"\0\0\0\x10" * 3000
    codes = [b"\0" * 10_000, b"", b"\x03\xac", *[switch] * 3, b"\x03\xac"]
    batches = list(bytecode.instructions(_Code(pa.array(range(7), pa.int32()), pa.array(codes, pa.binary()), names=["ord", "code"]), ["ord"], "jvm"))
    assert max(b.num_rows for b in batches) == 4096 and max(sum(len(t) for t in b.column("targets").to_pylist()) for b in batches) < 2 * 4096
    rows = [r for b in batches for r in b.to_pylist()]
    want = [(i, pos, *row) for i, code in enumerate(codes) for pos, row in enumerate(bytecode.jvm_instructions(code))]
    assert len(want) == 10_007 and [(r["ord"], r["pos"], r["offset"], r["op"], r["name"], r["size"], r["ref"], r["value"], r["targets"], r["cases"], r["wide"]) for r in rows] == [tuple(list(x) if isinstance(x, tuple) else x for x in w) for w in want]


def test_rows_of_one_signature_share_its_parts():
    """each row's parts were objects of their own, up to a batch of them."""
    blob, long = b"\x20\x02\x01\x08\x1d\x0e", b"\x20\x40\x01" + b"\x1d" * 100 + b"\x08" * 64
    assert signatures.shared_signature(blob, "method") is signatures.shared_signature(bytes(bytearray(blob)), "method")
    for b in (blob, long, b"", b"\x20\x05\x01", None):
        for kind in ("method", "field", "property", "spec", "locals"):
            assert signatures.shared_signature(b, kind) == signatures.parse_signature(b, kind)
    assert signatures._remembered.cache_info().maxsize == 1024 and len(long) > signatures.SHORT


@pytest.mark.parametrize("make", [assemblies.supplier_images, loops.supplier_classes, enums.part_enums])
def test_files_are_made_by_as_many_tasks_as_rows_need(spark, sf_dir, monkeypatch, make):
    """the last makers of files that left all groups, which are small when packed, to a few tasks."""
    monkeypatch.setattr(session, "TASK_ROWS", 1)
    rows = spark.read.parquet(f"{sf_dir}/{'part' if make is enums.part_enums else 'supplier'}.parquet").count()
    assert make(spark, sf_dir).rdd.getNumPartitions() == rows > 8
