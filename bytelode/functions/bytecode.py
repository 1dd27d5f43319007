"""Instruction decoders: code bytes to ordered instruction rows. One small function a machine, run inside Arrow stages."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytelode.functions.opcodes import cil_opcodes, jvm_opcodes

INSTRUCTION = "pos int, offset int, op int, name string, size int, ref long, value double, targets array<int>, cases array<long>, wide boolean, whole long"
_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.bool_()]
#: Instructions, and targets of their jumps, that a task holds as objects at once.
BATCH_ITEMS = 4096

Row = tuple  # of the columns of INSTRUCTION but pos


def jvm_instructions(code: bytes, table: dict = jvm_opcodes()) -> Iterator[Row]:  # noqa: B008
    """``ref`` is a pool index, local or type code; targets are absolute. Undecodable rests end with ``invalid``."""
    at = 0
    while at < len(code):
        op = code[at]
        name, kind = table.get(op, ("invalid", ""))
        ref = value = None
        targets: list[int] = []
        cases: list[int] = []
        wide = False
        try:
            if name == "invalid":
                raise struct.error
            if kind == "wide":
                op, wide = code[at + 1], True
                name, inner = table[op]
                ref = struct.unpack_from(">H", code, at + 2)[0]
                size = 4
                if inner == "iinc":
                    value, size = struct.unpack_from(">h", code, at + 4)[0], 6
                elif inner != "local":
                    raise struct.error
            elif kind in ("table", "lookup"):
                p = (at + 4) & ~3
                default, a = struct.unpack_from(">ii", code, p)
                if kind == "table":
                    high = struct.unpack_from(">i", code, p + 8)[0]
                    n = max(0, high - a + 1)
                    jumps = struct.unpack_from(f">{n}i", code, p + 12)
                    cases, size = list(range(a, high + 1)), p + 12 + 4 * n - at
                else:
                    pairs = struct.unpack_from(f">{2 * a}i", code, p + 8)
                    cases, jumps, size = list(pairs[::2]), pairs[1::2], p + 8 + 8 * a - at
                targets = [at + j for j in (*jumps, default)]
            else:
                fmt, size = {
                    "": ("", 1), "byte": ("b", 2), "short": ("h", 3), "cp1": ("B", 2), "cp2": ("H", 3), "local": ("B", 2), "iinc": ("Bb", 3),
                    "branch2": ("h", 3), "branch4": ("i", 5), "cp2x2": ("HH", 5), "atype": ("B", 2), "cp2dims": ("HB", 4),
                }[kind]
                got = struct.unpack_from(">" + fmt, code, at + 1)
                if kind in ("byte", "short"):
                    value = got[0]
                elif kind.startswith("branch"):
                    targets = [at + got[0]]
                elif got:
                    ref = got[0]
                    value = got[1] if kind in ("iinc", "cp2dims") else None
        except (struct.error, IndexError, KeyError):
            yield at, op, "invalid", len(code) - at, None, None, [], [], False
            return
        yield at, op, name, size, ref, value, targets, cases, wide
        at += size


def cil_instructions(code: bytes, table: dict = cil_opcodes()) -> Iterator[Row]:  # noqa: B008
    """``ref`` is a token or variable; targets are absolute, at least 0. Unknown opcodes are ``unknown``, without operand."""
    at = 0
    while at < len(code):
        two = code[at] == 0xFE and at + 1 < len(code)
        op = 0xFE00 + code[at + 1] if two else code[at]
        name, kind = table.get(op, ("unknown", ""))
        p = at + 1 + two
        ref = value = None
        targets: list[int] = []
        cases: list[int] = []
        try:
            if kind == "switch":
                n = struct.unpack_from("<I", code, p)[0]
                end = p + 4 + 4 * n
                targets = [max(0, end + j) for j in struct.unpack_from(f"<{n}i", code, p + 4)]
                cases = list(range(n))
            else:
                fmt = {"": "", "u1": "B", "u2": "H", "i1": "b", "i4": "i", "i8": "q", "r4": "f", "r8": "d", "token": "I", "branch1": "b", "branch4": "i"}[kind]
                got = struct.unpack_from("<" + fmt, code, p)
                end = p + struct.calcsize("<" + fmt)
                if kind.startswith("branch"):
                    targets = [max(0, end + got[0])]
                elif kind in ("u1", "u2", "token"):
                    ref = got[0]
                elif got:
                    value = got[0]
        except struct.error:
            yield at, op, "invalid", len(code) - at, None, None, [], [], False
            return
        yield at, op, name, end - at, ref, value, targets, cases, False
        at = end


def instructions(methods: DataFrame, keys: list[str], machine: str) -> DataFrame:
    """``methods`` (``keys``, code binary) -> one row an instruction. Rows without code give none."""
    decode = jvm_instructions if machine == "jvm" else cil_instructions
    source = methods.select(*keys, "code").filter(F.col("code").isNotNull())
    schema = T.StructType([*source.schema.fields[:-1], *T.StructType.fromDDL(INSTRUCTION).fields])
    names = schema.names

    def batch(own: list[pa.Array], owner: list[int], rows: list[tuple]) -> pa.RecordBatch:
        cols = [pa.array([r[k] for r in rows], t) if k != 6 else pa.array([None if r[6] is None else float(r[6]) for r in rows], t) for k, t in enumerate(_TYPES)]
        # a double can't hold all 64-bit numbers, so whole ones have a column of their own
        cols.append(pa.array([r[6] if isinstance(r[6], int) else None for r in rows], pa.int64()))
        take = pa.array(owner, pa.int32())
        return pa.RecordBatch.from_arrays([*(c.take(take) for c in own), *cols], names)

    def run(batches):
        for b in batches:
            *own, codes = b.columns
            owner: list[int] = []
            rows: list[tuple] = []
            size = 0
            for i in range(b.num_rows):
                for pos, row in enumerate(decode(codes[i].as_py())):
                    owner.append(i)
                    rows.append((pos, *row))
                    size += 1 + len(row[6])
                    if size >= BATCH_ITEMS:
                        yield batch(own, owner, rows)
                        owner, rows, size = [], [], 0
            if rows:
                yield batch(own, owner, rows)

    return source.mapInArrow(run, schema)
