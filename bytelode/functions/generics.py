"""Generic signatures of class files as source text. Recursive, so one small parser behind an Arrow-batched function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bytelode.functions.names import BASE_TYPES

_PARTS = "struct<params:array<string>,types:array<string>>"


class _Reader:
    def __init__(self, s: str):
        self.s, self.at = s, 0

    def peek(self) -> str:
        return self.s[self.at] if self.at < len(self.s) else ""

    def next(self) -> str:
        self.at += 1
        return self.s[self.at - 1]

    def until(self, stops: str) -> str:
        start = self.at
        while self.s[self.at] not in stops:
            self.at += 1
        return self.s[start : self.at]

    def type(self) -> str:
        c = self.next()
        if c in BASE_TYPES:
            return BASE_TYPES[c]
        if c == "[":
            return self.type() + "[]"
        if c == "T":
            name = self.until(";")
            self.at += 1
            return name
        if c != "L":
            raise ValueError(c)
        out = ""
        while True:
            out += self.until("<;.").replace("/", ".").replace("$", ".")
            c = self.next()
            if c == "<":
                args = []
                while self.peek() != ">":
                    args.append(self.argument())
                self.at += 1
                out += "<" + ", ".join(args) + ">"
                c = self.next()
            if c == ";":
                return out
            out += "."

    def argument(self) -> str:
        c = self.peek()
        if c == "*":
            self.at += 1
            return "?"
        if c in "+-":
            self.at += 1
            return ("? extends " if c == "+" else "? super ") + self.type()
        return self.type()

    def parameters(self) -> list[str]:
        """Type variables with their bounds; a bound of Object is left out."""
        out: list[str] = []
        if self.peek() != "<":
            return out
        self.at += 1
        while self.peek() != ">":
            name, bounds = self.until(":"), []
            while self.peek() == ":":
                self.at += 1
                if self.peek() not in (":", ">"):
                    bounds.append(self.type())
            bounds = [b for b in bounds if b != "java.lang.Object"]
            out.append(name + (" extends " + " & ".join(bounds) if bounds else ""))
        self.at += 1
        return out


def parse_generic(s: str | None) -> tuple[list[str], list[str]] | None:
    """(type parameters, types): of a field its type; of a method its parameter types, then its return type; of a class
    its superclass, then its interfaces. None for null or damaged text."""
    try:
        r = _Reader(s)
        params, types = r.parameters(), []
        if r.peek() == "(":
            r.at += 1
            while r.peek() != ")":
                types.append(r.type())
            r.at += 1
            types.append(r.type())
            while r.peek() == "^":
                r.at += 1
                r.type()
        else:
            while r.at < len(s):
                types.append(r.type())
        return params, types
    except (IndexError, ValueError, TypeError):
        return None


def generic_signature(c: Column) -> Column:
    """struct(params, types) of a generic signature."""
    return F.udf(parse_generic, _PARTS, useArrow=True)(c)
