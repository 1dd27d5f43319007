"""JVM class files to nested rows. The decoder only cuts bytes; names are resolved by joins (``operators.jvm``)."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from bytelode.rounds import kept

#: Constant pool tags with their layout after the tag byte.
POOL = {3: ">i", 4: ">f", 5: ">q", 6: ">d", 7: ">H", 8: ">H", 9: ">HH", 10: ">HH", 11: ">HH", 12: ">HH", 15: ">BH", 16: ">H", 17: ">HH", 18: ">HH", 19: ">H", 20: ">H"}

HANDLER = "array<struct<start:int,stop:int,handler:int,type_idx:int>>"
LOCALS = "array<struct<start:int,length:int,name_idx:int,desc_idx:int,slot:int>>"
MEMBER = (
    f"struct<kind:string,ord:int,access:int,name_idx:int,desc_idx:int,const_idx:int,sig_idx:int,throws:array<int>,"
    f"max_stack:int,max_locals:int,code:binary,handlers:{HANDLER},locals:{LOCALS}>"
)
CLASS = (
    "class_id long, minor int, major int, access int, this_idx int, super_idx int, interfaces array<int>,"
    "pool array<struct<idx:int,tag:int,a:int,b:int,num:string,text:string>>,"
    f"members array<{MEMBER}>, source_idx int, sig_idx int,"
    "inner_classes array<struct<inner:int,outer:int,name:int,access:int>>, bootstraps array<struct<ref:int,args:array<int>>>, error string"
)

#: Classes, and bytes of class files, whose decoded rows a task holds at once. Objects take some fifty times a file's bytes.
BATCH_ROWS, BATCH_BYTES = 16, 1 << 16


def modified_utf8(raw: bytes) -> str:
    """JVM strings: NUL as two bytes, characters beyond the first plane as two surrogates of three bytes each."""
    text = raw.replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass" if b"\xed" in raw else "replace")
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if b"\xed" in raw else text


class _Bytes:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def read(self, fmt: str) -> tuple:
        got = struct.unpack_from(fmt, self.data, self.at)
        self.at += struct.calcsize(fmt)
        return got

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise struct.error("truncated")
        self.at += n
        return self.data[self.at - n : self.at]

    def shorts(self, n: int) -> list[int]:
        return list(self.read(f">{n}H"))


def _pool(r: _Bytes) -> tuple[list[dict], dict[int, str]]:
    rows, texts = [], {}
    i, n = 1, r.read(">H")[0]
    while i < n:
        tag = r.read(">B")[0]
        row = {"idx": i, "tag": tag, "a": None, "b": None, "num": None, "text": None}
        if tag == 1:
            raw = r.take(r.read(">H")[0])
            try:
                texts[i] = row["text"] = modified_utf8(raw)
            except UnicodeDecodeError:
                texts[i] = row["text"] = raw.decode("utf-8", "replace")
        elif tag in (3, 4, 5, 6):
            row["num"] = repr(r.read(POOL[tag])[0])
        else:
            row["a"], row["b"] = (*r.read(POOL[tag]), None)[:2]
        rows.append(row)
        i += 2 if tag in (5, 6) else 1
    return rows, texts


def _attributes(r: _Bytes, texts: dict[int, str]) -> dict[str, bytes]:
    out = {}
    for _ in range(r.read(">H")[0]):
        name, size = r.read(">HI")
        out[texts.get(name, "")] = r.take(size)
    return out


def _groups(raw: bytes, fields: tuple[str, ...]) -> list[dict]:
    r = _Bytes(raw)
    return [dict(zip(fields, r.shorts(len(fields)), strict=True)) for _ in range(r.read(">H")[0])]


def _members(r: _Bytes, kind: str, texts: dict[int, str]) -> list[dict]:
    out = []
    for i in range(r.read(">H")[0]):
        access, name, desc = r.shorts(3)
        a = _attributes(r, texts)
        first = lambda k, a=a: struct.unpack(">H", a[k][:2])[0] if k in a else None
        m = {"kind": kind, "ord": i, "access": access, "name_idx": name, "desc_idx": desc, "const_idx": first("ConstantValue"), "sig_idx": first("Signature"), "throws": [],
             "max_stack": None, "max_locals": None, "code": None, "handlers": [], "locals": []}
        if "Exceptions" in a:
            e = _Bytes(a["Exceptions"])
            m["throws"] = e.shorts(e.read(">H")[0])
        if "Code" in a:
            c = _Bytes(a["Code"])
            m["max_stack"], m["max_locals"], size = c.read(">HHI")
            m["code"] = c.take(size)
            m["handlers"] = [dict(zip(("start", "stop", "handler", "type_idx"), c.shorts(4), strict=True)) for _ in range(c.read(">H")[0])]
            inner = _attributes(c, texts)
            if "LocalVariableTable" in inner:
                m["locals"] = _groups(inner["LocalVariableTable"], ("start", "length", "name_idx", "desc_idx", "slot"))
        out.append(m)
    return out


def decode_class(data: bytes) -> dict:
    r = _Bytes(data)
    if r.read(">I")[0] != 0xCAFEBABE:
        raise ValueError("not a class file")
    out: dict = {}
    out["minor"], out["major"] = r.shorts(2)
    out["pool"], texts = _pool(r)
    out["access"], out["this_idx"], out["super_idx"] = r.shorts(3)
    out["interfaces"] = r.shorts(r.read(">H")[0])
    out["members"] = _members(r, "field", texts) + _members(r, "method", texts)
    a = _attributes(r, texts)
    for key, name in (("source_idx", "SourceFile"), ("sig_idx", "Signature")):
        out[key] = struct.unpack(">H", a[name][:2])[0] if name in a else None
    out["inner_classes"] = _groups(a["InnerClasses"], ("inner", "outer", "name", "access")) if "InnerClasses" in a else []
    out["bootstraps"] = []
    if "BootstrapMethods" in a:
        b = _Bytes(a["BootstrapMethods"])
        for _ in range(b.read(">H")[0]):
            ref, n = b.shorts(2)
            out["bootstraps"].append({"ref": ref, "args": b.shorts(n)})
    return out


def decode_classes(blobs: DataFrame) -> DataFrame:
    """``blobs`` (class_id, bytes, error) -> one nested row each. What can't be decoded has ``error`` and nulls."""

    arrow = to_arrow_schema(T.StructType.fromDDL(CLASS))

    def run(batches):
        for b in batches:
            held, size = [], 0
            for k in range(b.num_rows):
                class_id, data, error = (c[k].as_py() for c in b.columns)
                row = dict.fromkeys(arrow.names) | {"class_id": class_id, "error": error}
                if data is not None and not error:
                    try:
                        row |= decode_class(data)
                    except Exception as e:  # any damage is the row's, not the job's
                        row["error"] = str(e) or type(e).__name__
                held.append(row)
                size += len(data or b"")
                if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(held, arrow)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, arrow)

    return blobs.select("class_id", "bytes", "error").mapInArrow(run, CLASS)


def stored_classes(blobs: DataFrame) -> DataFrame:
    """``decode_classes``, decoded once and written, for uses that take several relations from it."""
    return kept(decode_classes(blobs), "classes")
