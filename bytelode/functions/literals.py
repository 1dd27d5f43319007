"""Constant and attribute blobs to literals, behind Arrow-batched functions (their layout depends on their bytes)."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from bytelode.functions.signatures import parse_signature
from bytelode.sources.pe import read_compressed

#: Fixed values (ECMA-335 II.23.1.16): element type -> layout of a constant of it.
LAYOUTS = {0x02: "<?", 0x03: "<H", 0x04: "<b", 0x05: "<B", 0x06: "<h", 0x07: "<H", 0x08: "<i", 0x09: "<I", 0x0A: "<q", 0x0B: "<Q", 0x0C: "<f", 0x0D: "<d"}
#: Types an attribute argument is read for, with the layout.
ARGUMENTS = {"bool": "<?", "int": "<i", "long": "<q"}


def quoted(s: str) -> str:
    """A C# string literal."""
    out = "".join({"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\0": "\\0"}.get(c, c) for c in s)
    return f'"{out}"'


def float_text(v: float, single: bool = False) -> str:
    """Shortest text that reads back to the value, always with a point or exponent."""
    if v != v or v in (float("inf"), float("-inf")):
        kind = "float" if single else "double"
        return f"{kind}.NaN" if v != v else f"{kind}.{'Positive' if v > 0 else 'Negative'}Infinity"
    if single:
        text = next(t for p in range(1, 10) if struct.unpack("<f", struct.pack("<f", float(t := f"{v:.{p}g}")))[0] == v)
        text = repr(float(text))
    else:
        text = repr(v)
    return text + ("f" if single else "")


def constant(kind: int | None, blob: bytes | None) -> str | None:
    """The literal of a constant row. Strings are raw UTF-16; a class constant is null."""
    if kind is None or blob is None:
        return None
    try:
        if kind == 0x0E:
            return quoted(bytes(blob).decode("utf-16-le"))
        if kind == 0x12:
            return "null"
        v = struct.unpack(LAYOUTS[kind], blob)[0]
        if kind == 0x02:
            return "true" if v else "false"
        if kind == 0x03:
            return "'" + quoted(chr(v))[1:-1].replace('\\"', '"').replace("'", "\\'") + "'"
        return float_text(v, kind == 0x0C) if kind in (0x0C, 0x0D) else str(v)
    except (KeyError, struct.error, UnicodeDecodeError, StopIteration):
        return None


def attribute_arguments(value: bytes | None, signature: bytes | None) -> list[str] | None:
    """Fixed arguments of an attribute whose parameters are strings, int, long or bool; None for others and damage."""
    sig = parse_signature(bytes(signature) if signature is not None else None, "method")
    if sig is None or value is None or value[:2] != b"\1\0":
        return None
    out, at, value = [], 2, bytes(value)
    try:
        for parts in sig[1:]:
            kind = parts[0][0] if len(parts) == 1 else None
            if kind == "string":
                if value[at] == 0xFF:
                    out.append("null")
                    at += 1
                    continue
                n, at = read_compressed(value, at)
                out.append(quoted(value[at : at + n].decode("utf-8")))
                at += n
            else:
                v = struct.unpack_from(ARGUMENTS[kind], value, at)[0]
                at += struct.calcsize(ARGUMENTS[kind])
                out.append(str(v).lower() if kind == "bool" else str(v))
        return out
    except (KeyError, IndexError, struct.error, UnicodeDecodeError):
        return None


def constant_literal(kind: Column, blob: Column) -> Column:
    return F.udf(constant, "string", useArrow=True)(kind.cast("int"), blob)


def argument_literals(value: Column, signature: Column) -> Column:
    return F.udf(attribute_arguments, "array<string>", useArrow=True)(value, signature)
