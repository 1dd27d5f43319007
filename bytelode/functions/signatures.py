"""Metadata signatures to parts: literal text, or a reference (table, row) a join resolves later."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from bytelode.sources.pe import CODED, read_compressed

#: Fixed values (ECMA-335 II.23.1.16): element types with a plain name.
ELEMENTS = {
    0x01: "void", 0x02: "bool", 0x03: "char", 0x04: "sbyte", 0x05: "byte", 0x06: "short", 0x07: "ushort", 0x08: "int", 0x09: "uint", 0x0A: "long",
    0x0B: "ulong", 0x0C: "float", 0x0D: "double", 0x0E: "string", 0x16: "typedref", 0x18: "nint", 0x19: "nuint", 0x1C: "object",
}
PARTS = "array<array<struct<text:string,table:int,rid:int>>>"


def _type(b: bytes, at: int) -> tuple[list[tuple], int]:
    e, at = b[at], at + 1
    if e in ELEMENTS:
        return [(ELEMENTS[e], None, None)], at
    if e in (0x11, 0x12):
        v, at = read_compressed(b, at)
        return [(None, CODED["TypeDefOrRef"][v & 3], v >> 2)], at
    if e in (0x0F, 0x10, 0x1D, 0x45):
        inner, at = _type(b, at)
        before, after = {0x0F: ("", "*"), 0x10: ("ref ", ""), 0x1D: ("", "[]"), 0x45: ("", "")}[e]
        return [(before, None, None), *inner, (after, None, None)], at
    if e in (0x13, 0x1E):
        n, at = read_compressed(b, at)
        return [(("!" if e == 0x13 else "!!") + str(n), None, None)], at
    if e in (0x1F, 0x20):  # custom modifiers are skipped
        return _type(b, read_compressed(b, at)[1])
    if e == 0x14:
        inner, at = _type(b, at)
        rank, at = read_compressed(b, at)
        for _ in range(2):
            n, at = read_compressed(b, at)
            for _ in range(n):
                _, at = read_compressed(b, at)
        return [*inner, ("[" + "," * (rank - 1) + "]", None, None)], at
    if e == 0x15:
        out, at = _type(b, at)
        n, at = read_compressed(b, at)
        for i in range(n):
            inner, at = _type(b, at)
            out += [("<" if i == 0 else ", ", None, None), *inner]
        return [*out, (">", None, None)], at
    if e == 0x1B:
        _, at = _signature(b, at)
        return [("fnptr", None, None)], at
    raise ValueError(f"element type {e:#x}")


def _signature(b: bytes, at: int) -> tuple[list[list[tuple]], int]:
    call, at = b[at], at + 1
    if call & 0x10:
        _, at = read_compressed(b, at)
    n, at = read_compressed(b, at)
    out = []
    for _ in range(n + 1):
        if b[at] == 0x41:  # the rest are variable arguments
            at += 1
        t, at = _type(b, at)
        out.append(t)
    return out, at


def parse_signature(b: bytes | None, kind: str) -> list[list[tuple]] | None:
    """``method``: return type, then parameters. ``field``, ``property``, ``spec`` (bare type), ``locals``. None if damaged."""
    try:
        if kind == "method":
            return _signature(b, 0)[0]
        if kind == "property":
            n, at = read_compressed(b, 1)
            return [_type(b, at)[0]]
        if kind == "locals":
            n, at = read_compressed(b, 1)
            out = []
            for _ in range(n):
                t, at = _type(b, at)
                out.append(t)
            return out
        return [_type(b, 1 if kind == "field" else 0)[0]]
    except (IndexError, ValueError, KeyError, TypeError):
        return None


#: Bytes of signatures that are remembered; longer ones are parsed each time.
SHORT = 128
_remembered = lru_cache(maxsize=1024)(parse_signature)


def shared_signature(b: bytes | None, kind: str) -> list[list[tuple]] | None:
    """``parse_signature``, whose parts rows of one signature share: a file has few different ones, and a batch's objects are those of the different ones alone."""
    return parse_signature(b, kind) if b is None or len(b) > SHORT else _remembered(b, kind)


def signature_parts(blob: Column, kind: str) -> Column:
    """``PARTS`` of a signature column; an Arrow-batched function, since signatures are recursive."""
    return F.udf(lambda b: shared_signature(b if b is None else bytes(b), kind), PARTS, useArrow=True)(blob)
