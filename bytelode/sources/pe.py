"""Managed PE images to metadata rows. The decoder cuts bytes into table cells; references are followed by joins."""

from __future__ import annotations

import struct
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytelode.rounds import kept

#: Fixed values (ECMA-335 II.24.2.6): the tables each kind of coded index can point to, in tag order; -1 is unused.
CODED = {
    "TypeDefOrRef": (2, 1, 27), "HasConstant": (4, 8, 23), "HasFieldMarshal": (4, 8), "HasDeclSecurity": (2, 6, 32),
    "HasCustomAttribute": (6, 4, 1, 2, 8, 9, 10, 0, 14, 23, 20, 17, 26, 27, 32, 35, 38, 39, 40, 42, 44, 43),
    "MemberRefParent": (2, 1, 26, 6, 27), "HasSemantics": (20, 23), "MethodDefOrRef": (6, 10), "MemberForwarded": (4, 6),
    "Implementation": (38, 35, 39), "CustomAttributeType": (-1, -1, 6, 10, -1), "ResolutionScope": (0, 26, 35, 1), "TypeOrMethodDef": (2, 6),
}
#: Fixed values (ECMA-335 II.22): columns of each table. u1-u4 numbers, s string, g guid, b blob, tN row of table N.
_LAYOUT = """
0 Generation:u2 Name:s Mvid:g EncId:g EncBaseId:g
1 Scope:ResolutionScope Name:s Namespace:s
2 Flags:u4 Name:s Namespace:s Extends:TypeDefOrRef FieldList:t4 MethodList:t6
3 Field:t4
4 Flags:u2 Name:s Signature:b
5 Method:t6
6 Rva:u4 ImplFlags:u2 Flags:u2 Name:s Signature:b ParamList:t8
7 Param:t8
8 Flags:u2 Sequence:u2 Name:s
9 Class:t2 Interface:TypeDefOrRef
10 Class:MemberRefParent Name:s Signature:b
11 Type:u2 Parent:HasConstant Value:b
12 Parent:HasCustomAttribute Type:CustomAttributeType Value:b
13 Parent:HasFieldMarshal NativeType:b
14 Action:u2 Parent:HasDeclSecurity PermissionSet:b
15 PackingSize:u2 ClassSize:u4 Parent:t2
16 Offset:u4 Field:t4
17 Signature:b
18 Parent:t2 EventList:t20
19 Event:t20
20 EventFlags:u2 Name:s EventType:TypeDefOrRef
21 Parent:t2 PropertyList:t23
22 Property:t23
23 Flags:u2 Name:s Type:b
24 Semantics:u2 Method:t6 Association:HasSemantics
25 Class:t2 MethodBody:MethodDefOrRef MethodDeclaration:MethodDefOrRef
26 Name:s
27 Signature:b
28 MappingFlags:u2 MemberForwarded:MemberForwarded ImportName:s ImportScope:t26
29 Rva:u4 Field:t4
30 Token:u4 FuncCode:u4
31 Token:u4
32 HashAlg:u4 Major:u2 Minor:u2 Build:u2 Revision:u2 Flags:u4 PublicKey:b Name:s Culture:s
33 Processor:u4
34 Platform:u4 Major:u4 Minor:u4
35 Major:u2 Minor:u2 Build:u2 Revision:u2 Flags:u4 PublicKeyOrToken:b Name:s Culture:s HashValue:b
36 Processor:u4 AssemblyRef:t35
37 Platform:u4 Major:u4 Minor:u4 AssemblyRef:t35
38 Flags:u4 Name:s HashValue:b
39 Flags:u4 TypeDefId:u4 TypeName:s TypeNamespace:s Implementation:Implementation
40 Offset:u4 Flags:u4 Name:s Implementation:Implementation
41 NestedClass:t2 EnclosingClass:t2
42 Number:u2 Flags:u2 Owner:TypeOrMethodDef Name:s
43 Method:MethodDefOrRef Instantiation:b
44 Owner:t42 Constraint:TypeDefOrRef
"""
SCHEMAS: dict[int, list[tuple[str, str]]] = {int(t): [tuple(c.split(":")) for c in cols] for t, *cols in (x.split() for x in _LAYOUT.strip().splitlines())}
#: Table number given to user strings; their row is the heap offset.
USER_STRINGS = 0x70
#: What a task holds of decoded rows at once.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
_LISTS = ("cells", "texts", "blobs")


def compressed(n: int) -> bytes:
    return bytes([n]) if n < 0x80 else struct.pack(">H", n | 0x8000) if n < 0x4000 else struct.pack(">I", n | 0xC0000000)


def read_compressed(b: bytes, at: int) -> tuple[int, int]:
    """(value, place behind it)."""
    first = b[at]
    if first < 0x80:
        return first, at + 1
    if first < 0xC0:
        return struct.unpack_from(">H", b, at)[0] & 0x3FFF, at + 2
    return struct.unpack_from(">I", b, at)[0] & 0x1FFFFFFF, at + 4


def widths(table: int, counts: dict[int, int], heaps: tuple[int, int, int]) -> list[int]:
    """Bytes of each cell: wide where a heap is large, or a table has too many rows for the bits left."""
    out = []
    for _, kind in SCHEMAS[table]:
        if kind in CODED:
            bits = max(1, (len(CODED[kind]) - 1).bit_length())
            out.append(4 if max((counts.get(t, 0) for t in CODED[kind]), default=0) >= 1 << (16 - bits) else 2)
        elif kind[0] == "t":
            out.append(4 if counts.get(int(kind[1:]), 0) > 0xFFFF else 2)
        elif kind in "sgb":
            out.append(heaps["sgb".index(kind)])
        else:
            out.append(int(kind[1]))
    return out


class Image:
    def __init__(self, data: bytes):
        self.data = data
        if data[:2] != b"MZ":
            raise ValueError("not a PE image")
        pe = struct.unpack_from("<I", data, 0x3C)[0]
        if data[pe : pe + 4] != b"PE\0\0":
            raise ValueError("no PE signature")
        n, optional_size = struct.unpack_from("<H", data, pe + 6)[0], struct.unpack_from("<H", data, pe + 20)[0]
        optional = pe + 24
        magic = struct.unpack_from("<H", data, optional)[0] if optional_size else 0
        if magic not in (0x10B, 0x20B):
            raise ValueError("no optional header")
        self.sections = [struct.unpack_from("<IIII", data, optional + optional_size + 40 * i + 8) for i in range(n)]
        cli = struct.unpack_from("<I", data, optional + (96 if magic == 0x10B else 112) + 14 * 8)[0]
        if not cli:
            raise ValueError("not a managed .NET assembly")
        root = self.offset(struct.unpack_from("<I", data, self.offset(cli) + 8)[0])
        if struct.unpack_from("<I", data, root)[0] != 0x424A5342:
            raise ValueError("no metadata root")
        at = root + 16 + struct.unpack_from("<I", data, root + 12)[0]
        self.heaps: dict[str, bytes] = {}
        n, at = struct.unpack_from("<H", data, at + 2)[0], at + 4
        for _ in range(n):
            where, size = struct.unpack_from("<II", data, at)
            end = data.index(b"\0", at + 8)
            self.heaps[data[at + 8 : end].decode("ascii", "replace")] = data[root + where : root + where + size]
            at += 8 + (end - at - 8) // 4 * 4 + 4
        self.strings, self.blobs = self.heaps.get("#Strings", b""), self.heaps.get("#Blob", b"")

    def offset(self, rva: int) -> int:
        for size, start, raw_size, raw in self.sections:
            if start <= rva < start + (size or raw_size):
                return raw + min(rva - start, raw_size)
        raise ValueError(f"address {rva:#x} is in no section")

    def string(self, at: int) -> str:
        end = self.strings.find(b"\0", at)
        return self.strings[at:end].decode("utf-8", "replace") if 0 <= at < len(self.strings) and end >= 0 else ""

    def blob(self, at: int) -> bytes:
        try:
            n, at = read_compressed(self.blobs, at)
        except (IndexError, struct.error):
            return b""
        return self.blobs[at : at + n]

    def tables(self):
        """(table, row number, cells)."""
        s = self.heaps.get("#~", self.heaps.get("#-", b""))
        flags, present = s[6], struct.unpack_from("<Q", s, 8)[0]
        heaps = tuple(4 if flags & bit else 2 for bit in (1, 2, 4))
        ids = [t for t in range(64) if present >> t & 1]
        if unknown := [t for t in ids if t not in SCHEMAS]:
            raise ValueError(f"unknown table {unknown[0]}")
        counts = dict(zip(ids, struct.unpack_from(f"<{len(ids)}I", s, 24), strict=True))
        at = 24 + 4 * len(ids)
        for t in ids:
            row = struct.Struct("<" + "".join({1: "B", 2: "H", 4: "I"}[n] for n in widths(t, counts, heaps)))
            for first in range(0, counts[t], BATCH_ROWS):
                n = min(BATCH_ROWS, counts[t] - first)
                # what a cut file lacks reads as zeros
                cut = s[at : at + n * row.size].ljust(n * row.size, b"\0")
                at += n * row.size
                for rid, cells in enumerate(row.iter_unpack(cut), first + 1):
                    yield t, rid, cells

    def user_strings(self):
        heap, at = self.heaps.get("#US", b""), 1
        while at < len(heap):
            n, body = read_compressed(heap, at)
            if n:
                yield at, heap[body : body + n - 1].decode("utf-16-le", "replace")
            at = body + n

    def body(self, rva: int) -> dict:
        at, d = self.offset(rva), self.data
        if d[at] & 3 == 2:
            size = d[at] >> 2
            return {"code": d[at + 1 : at + 1 + size], "max_stack": 8, "local_token": 0, "handlers": []}
        flags, stack, size, local = struct.unpack_from("<HHII", d, at)
        end = at + (flags >> 12) * 4 + size
        out = {"code": d[end - size : end], "max_stack": stack, "local_token": local, "handlers": []}
        more = bool(flags & 8)
        end = end + 3 & ~3
        while more:
            kind = d[end]
            fat, more = bool(kind & 0x40), bool(kind & 0x80)
            length = int.from_bytes(d[end + 1 : end + 4], "little") if fat else d[end + 1]
            for p in range(end + 4, end + length - (23 if fat else 11), 24 if fat else 12):
                f = struct.unpack_from("<IIIIII" if fat else "<HHBHBI", d, p)
                out["handlers"].append(dict(zip(("flags", "try_start", "try_length", "start", "length", "type"), f, strict=True)))
            end += length + 3 & ~3
        return out


MD = (
    "file_id string, table int, rid int, cells array<long>, texts array<string>, blobs array<binary>, code binary, max_stack int, local_token long, "
    "handlers array<struct<flags:long,try_start:long,try_length:long,start:long,length:long,type:long>>, error string"
)


_TEXT_AT = {t: [i for i, (_, k) in enumerate(cols) if k == "s"] for t, cols in SCHEMAS.items()}
_BLOB_AT = {t: [i for i, (_, k) in enumerate(cols) if k == "b"] for t, cols in SCHEMAS.items()}


def _batch(held: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    """Rows of ``MD``, whose body is one dictionary, by column. A list column is its items in one list and where each row's begin."""
    file_id, table, rid, *lists, bodies, error = zip(*held, strict=True)
    of = dict(zip(("file_id", "table", "rid", "error"), (file_id, table, rid, error), strict=True))
    cols = []
    for f in arrow:
        if f.name in _LISTS:
            each = lists[_LISTS.index(f.name)]
            ends = list(accumulate((len(x) if x else 0 for x in each), initial=0))
            begins = [None if x is None else n for x, n in zip(each, ends)]  # noqa: B905
            items = pa.array(list(chain.from_iterable(x for x in each if x)), f.type.value_type)
            cols.append(pa.ListArray.from_arrays(pa.array([*begins, ends[-1]], pa.int32()), items, type=f.type))
        else:
            cols.append(pa.array(of[f.name] if f.name in of else [x and x[f.name] for x in bodies], f.type))
    return pa.RecordBatch.from_arrays(cols, schema=arrow)


def decode_images(files: DataFrame) -> DataFrame:
    """``files`` (file_id, kind, content) -> one row per metadata row of every image, and per user string.

    ``cells`` holds all raw numbers; ``texts`` and ``blobs`` hold what string and blob cells point to, at the same places.
    A file that isn't a readable managed image gives one row with ``error``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(MD))

    def rows(file_id: str, data: bytes):
        """A file's rows, each with about how many bytes it points to."""
        image = Image(data)
        for t, rid, cells in image.tables():
            texts, blobs, body, error, size = [None] * len(cells), [None] * len(cells), None, None, 0
            for i in _TEXT_AT[t]:
                texts[i] = found = image.string(cells[i])
                size += len(found)
            for i in _BLOB_AT[t]:
                blobs[i] = found = image.blob(cells[i])
                size += len(found)
            if t == 6 and cells[0]:
                try:
                    body = image.body(cells[0])
                    size += len(body["code"])
                except (ValueError, IndexError, struct.error) as e:
                    error = str(e)
            yield (file_id, t, rid, cells, texts, blobs, body, error), size
        for at, text in image.user_strings():
            yield (file_id, USER_STRINGS, at, None, [text], None, None, None), len(text)

    def run(batches):
        # rows of small files go out together
        held, size = [], 0
        for b in batches:
            for k in range(b.num_rows):
                file_id, data = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                try:
                    for row, n in rows(file_id, data):
                        held.append(row)
                        size += n
                        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                            yield _batch(held, arrow)
                            held, size = [], 0
                except (ValueError, IndexError, struct.error) as e:
                    held.append((file_id, None, None, None, None, None, None, str(e) or type(e).__name__))
        if held:
            yield _batch(held, arrow)

    return files.filter("kind = 'pe'").select("file_id", "content").mapInArrow(run, MD)


def stored_images(files: DataFrame) -> DataFrame:
    """``decode_images``, decoded once and cut by metadata table, for uses that take several relations from it: each reads its tables only."""
    return kept(decode_images(files), "metadata", "table")


def view(md: DataFrame, table: int) -> DataFrame:
    """One metadata table with its columns by name; a coded index becomes ``X_table`` and ``X_rid`` (null for none)."""
    cols: list[Column] = [F.col("file_id"), F.col("rid")]
    for i, (name, kind) in enumerate(SCHEMAS[table]):
        cell = F.get("cells", F.lit(i))
        if kind == "s":
            cols.append(F.get("texts", F.lit(i)).alias(name))
        elif kind == "b":
            cols.append(F.get("blobs", F.lit(i)).alias(name))
        elif kind in CODED:
            bits = max(1, (len(CODED[kind]) - 1).bit_length())
            rid = F.shiftright(cell, bits).cast("int")
            tag = F.get(F.array(*(F.lit(t) for t in CODED[kind])), cell.bitwiseAND((1 << bits) - 1).cast("int"))
            cols += [F.when(rid > 0, tag).alias(f"{name}_table"), F.when(rid > 0, rid).alias(f"{name}_rid")]
        else:
            cols.append(cell.alias(name))
    if table == 6:
        cols += [F.col(c) for c in ("code", "max_stack", "local_token", "handlers")]
    return md.filter(F.col("table") == table).select(*cols)
