"""Name and descriptor functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base type letters of JVM descriptors.
BASE_TYPES = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": "void"}
#: Access flag bit -> keyword, for classes, fields and methods.
FLAGS = {
    "class": {0x1: "public", 0x10: "final", 0x200: "interface", 0x400: "abstract", 0x1000: "synthetic", 0x2000: "annotation", 0x4000: "enum"},
    "field": {0x1: "public", 0x2: "private", 0x4: "protected", 0x8: "static", 0x10: "final", 0x40: "volatile", 0x80: "transient", 0x1000: "synthetic"},
    "method": {0x1: "public", 0x2: "private", 0x4: "protected", 0x8: "static", 0x10: "final", 0x20: "synchronized", 0x40: "bridge", 0x80: "varargs", 0x100: "native", 0x400: "abstract", 0x1000: "synthetic"},
}
TYPE = r"\[*(?:[BCDFIJSZV]|L[^;]+;)"


def dotted(c: Column) -> Column:
    """A binary class name with dots."""
    return F.translate(c, "/$", "..")


def package_of(name: Column) -> Column:
    """The package of a slashed name; nested classes keep their outer class's package."""
    return F.translate(F.regexp_extract(name, r"^(.*)/[^/]*$", 1), "/", ".")


def simple_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def type_text(d: Column) -> Column:
    """One field descriptor as source text."""
    dims = F.length(F.regexp_extract(d, r"^(\[*)", 1))
    base = F.regexp_replace(d, r"^\[+", "")
    table = F.create_map(*(F.lit(x) for kv in BASE_TYPES.items() for x in kv))
    named = F.when(base.startswith("L"), dotted(F.regexp_replace(base, "^L|;$", ""))).otherwise(F.element_at(table, base))
    return F.concat(named, F.repeat(F.lit("[]"), dims))


def parameter_texts(descriptor: Column) -> Column:
    """The parameter types of a method descriptor."""
    inner = F.regexp_extract(descriptor, r"^\((.*)\)", 1)
    return F.transform(F.regexp_extract_all(inner, F.lit(f"({TYPE})"), F.lit(1)), type_text)


def return_text(descriptor: Column) -> Column:
    return type_text(F.regexp_extract(descriptor, r"\)(.*)$", 1))


def valid_descriptor(descriptor: Column) -> Column:
    return descriptor.rlike(rf"^(?:\((?:{TYPE})*\))?{TYPE}$")


def parameter_slots(descriptor: Column) -> Column:
    """Local slots of the parameters; long and double take two."""
    return F.aggregate(parameter_texts(descriptor), F.lit(0), lambda n, t: n + F.when(t.isin("long", "double"), 2).otherwise(1))


def flag_names(access: Column, kind: str) -> Column:
    """Keywords of the set access bits, in bit order."""
    words = [F.when(access.bitwiseAND(bit) != 0, F.lit(word)) for bit, word in FLAGS[kind].items()]
    return F.array_compact(F.array(*words))


def clean_generic(name: Column) -> Column:
    """A metadata type name without its arity mark."""
    return F.regexp_replace(name, "`[0-9]+", "")


def qualified(namespace: Column, name: Column) -> Column:
    return F.when(F.coalesce(namespace, F.lit("")) == "", name).otherwise(F.concat_ws(".", namespace, name))


def file_name(namespace: Column, name: Column, suffix: str) -> Column:
    """Output file of a type: separators and arity marks become underscores."""
    return F.concat(F.translate(F.concat_ws("_", F.when(F.coalesce(namespace, F.lit("")) != "", F.translate(namespace, ".", "_")), name), "`/\\", "___"), F.lit(suffix))


def coded_index(value: Column, bits: int) -> tuple[Column, Column]:
    """Tag and row of a coded index."""
    return value.bitwiseAND((1 << bits) - 1), F.shiftright(value, bits)
