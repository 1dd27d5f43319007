"""Writers of small class files and assemblies, to turn table rows into binaries the decoders can be tested on."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from bytelode.functions.opcodes import cil_opcodes, jvm_opcodes
from bytelode.sources.pe import CODED, SCHEMAS, compressed, widths

_NUMBERS = {"byte": "b", "short": "h", "cp1": "B", "local": "B", "atype": "B", "u1": "B", "u2": "H", "i1": "b", "i4": "i", "i8": "q", "r4": "f", "r8": "d", "token": "I"}


def assemble(lines: list, machine: str) -> tuple[list, dict[str, int]]:
    """The code of ``lines``, as bytes and references, and the offset of each label.

    A line is a label, or a tuple of a mnemonic and its operands: numbers, labels of jumps (all in their long forms), and references as ``Member`` takes them.
    """
    table = jvm_opcodes() if machine == "jvm" else cil_opcodes()
    codes = {name: (op, kind) for op, (name, kind) in table.items()}
    order, start = (">", 0) if machine == "jvm" else ("<", 1)
    parts, at, places, waiting = [], 0, {}, []
    for line in lines:
        if isinstance(line, str):
            places[line] = at
            continue
        name, *operands = line
        op, kind = codes[name]
        head = bytes([0xFE, op & 0xFF]) if op > 0xFF else bytes([op])
        if kind in ("branch2", "branch4"):
            size = len(head) + int(kind[-1])
            waiting.append((len(parts), head, "h" if kind == "branch2" else "i", operands[0], at + size * start))
            parts.append(b"")
        elif kind in ("cp2", "cp2x2"):
            parts += [head, operands[0], *([bytes(operands[1:] or (0, 0))] if kind == "cp2x2" else [])]
            size = 3 + 2 * (kind == "cp2x2")
        else:
            fmt = "Bb" if kind == "iinc" else _NUMBERS.get(kind, "")
            raw = head + struct.pack(order + fmt, *operands)
            parts.append(raw)
            size = len(raw)
        at += size
    for i, head, fmt, label, base in waiting:
        parts[i] = head + struct.pack(order + fmt, places[label] - base)
    return parts, places


class Pool:
    """A constant pool that numbers each entry once."""

    def __init__(self):
        self.at: dict[bytes, int] = {}

    def _put(self, raw: bytes) -> int:
        return self.at.setdefault(raw, len(self.at) + 1)

    def utf8(self, s: str) -> int:
        # characters beyond the first plane become two surrogates, NUL two bytes
        units = struct.unpack(f">{len(s.encode('utf-16-be')) // 2}H", s.encode("utf-16-be"))
        raw = b"".join(b"\xc0\x80" if u == 0 else chr(u).encode("utf-8", "surrogatepass") for u in units)
        return self._put(b"\1" + struct.pack(">H", len(raw)) + raw)

    def integer(self, n: int) -> int:
        return self._put(b"\3" + struct.pack(">i", n))

    def one(self, tag: int, s: str) -> int:
        return self._put(struct.pack(">BH", tag, self.utf8(s)))

    def reference(self, tag: int, owner: str, name: str, descriptor: str) -> int:
        nat = self._put(struct.pack(">BHH", 12, self.utf8(name), self.utf8(descriptor)))
        return self._put(struct.pack(">BHH", tag, self.one(7, owner), nat))

    def dynamic(self, bootstrap: int, name: str, descriptor: str) -> int:
        return self._put(struct.pack(">BHH", 18, bootstrap, self._put(struct.pack(">BHH", 12, self.utf8(name), self.utf8(descriptor)))))

    def bootstrap(self, owner: str, name: str, descriptor: str, constants: tuple) -> bytes:
        """An entry of the bootstrap table: a static method and its arguments."""
        handle = self._put(struct.pack(">BBH", 15, 6, self.reference(10, owner, name, descriptor)))
        args = [self.integer(c) if isinstance(c, int) else self.one(8, c) for c in constants]
        return struct.pack(f">{len(args) + 2}H", handle, len(args), *args)

    def bytes(self) -> bytes:
        return struct.pack(">H", len(self.at) + 1) + b"".join(self.at)


@dataclass
class Member:
    name: str
    descriptor: str
    access: int = 1
    constant: int | None = None
    code: list | None = None  # bytes, or (tag, owner, name, descriptor) for the index of a reference, (18, bootstrap, name, descriptor) for one of a dynamic call
    stack: int = 2
    locals: int = 4
    handlers: list[tuple] = field(default_factory=list)  # start, stop, handler, and 0 or the caught class's name
    signature: str | None = None
    throws: tuple[str, ...] = ()


def class_bytes(name: str, fields: list[Member], methods: list[Member], super_name: str = "java/lang/Object", access: int = 0x21, interfaces: tuple[str, ...] = (), signature: str | None = None, source: str | None = None, bootstraps: tuple[tuple, ...] = ()) -> bytes:
    pool = Pool()
    attr = lambda k, raw: struct.pack(">HI", pool.utf8(k), len(raw)) + raw

    def one(m: Member) -> bytes:
        attrs = []
        if m.constant is not None:
            attrs.append(attr("ConstantValue", struct.pack(">H", pool.integer(m.constant))))
        if m.code is not None:
            code = b"".join(c if isinstance(c, bytes) else struct.pack(">H", pool.one(*c) if len(c) == 2 else pool.dynamic(*c[1:]) if c[0] == 18 else pool.reference(*c)) for c in m.code)
            table = struct.pack(">H", len(m.handlers)) + b"".join(struct.pack(">4H", *h[:3], pool.one(7, h[3]) if h[3] else 0) for h in m.handlers)
            attrs.append(attr("Code", struct.pack(">HHI", m.stack, m.locals, len(code)) + code + table + b"\0\0"))
        if m.signature:
            attrs.append(attr("Signature", struct.pack(">H", pool.utf8(m.signature))))
        if m.throws:
            attrs.append(attr("Exceptions", struct.pack(f">{len(m.throws) + 1}H", len(m.throws), *(pool.one(7, t) for t in m.throws))))
        return struct.pack(">4H", m.access, pool.utf8(m.name), pool.utf8(m.descriptor), len(attrs)) + b"".join(attrs)

    ids = struct.pack(">3H", access, pool.one(7, name), pool.one(7, super_name)) + struct.pack(">H", len(interfaces)) + b"".join(struct.pack(">H", pool.one(7, i)) for i in interfaces)
    body = b"".join(struct.pack(">H", len(ms)) + b"".join(map(one, ms)) for ms in (fields, methods))
    own = [attr(k, struct.pack(">H", pool.utf8(v))) for k, v in (("Signature", signature), ("SourceFile", source)) if v]
    if bootstraps:
        own.append(attr("BootstrapMethods", struct.pack(">H", len(bootstraps)) + b"".join(pool.bootstrap(*b) for b in bootstraps)))
    return struct.pack(">IHH", 0xCAFEBABE, 0, 61) + pool.bytes() + ids + body + struct.pack(">H", len(own)) + b"".join(own)


class Assembly:
    """Metadata rows, heaps and bodies of a managed image."""

    def __init__(self):
        self.strings, self.blobs, self.user = {"": 0}, {b"": 0}, {}
        self.string_heap, self.blob_heap, self.user_heap = bytearray(b"\0"), bytearray(b"\0"), bytearray(b"\0")
        self.rows: dict[int, list[list[int]]] = {}
        self.code = bytearray()

    def string(self, s: str) -> int:
        if s not in self.strings:
            self.strings[s] = len(self.string_heap)
            self.string_heap += s.encode() + b"\0"
        return self.strings[s]

    def blob(self, b: bytes) -> int:
        if b not in self.blobs:
            self.blobs[b] = len(self.blob_heap)
            self.blob_heap += compressed(len(b)) + b
        return self.blobs[b]

    def user_string(self, s: str) -> int:
        """The token of a string literal."""
        if s not in self.user:
            raw = s.encode("utf-16-le") + b"\0"
            self.user[s] = len(self.user_heap)
            self.user_heap += compressed(len(raw)) + raw
        return 0x70000000 | self.user[s]

    def add(self, table: int, *cells) -> int:
        """Strings and bytes go to their heaps; (table, row) pairs become coded indexes. Returns the row number."""
        row = []
        for (_, kind), v in zip(SCHEMAS[table], cells, strict=True):
            if kind == "s":
                v = self.string(v)
            elif kind == "b":
                v = self.blob(v)
            elif kind in CODED and isinstance(v, tuple):
                bits = max(1, (len(CODED[kind]) - 1).bit_length())
                v = v[1] << bits | CODED[kind].index(v[0])
            row.append(v)
        self.rows.setdefault(table, []).append(row)
        return len(self.rows[table])

    def body(self, code: bytes, locals_row: int = 0, handlers: tuple[tuple, ...] = ()) -> int:
        """Place of a method body; the section starts at 0x2000. ``locals_row`` is the row of its local variables' signature.

        ``handlers`` are clauses: flags, try start and length, start and length, and a type's token or the filter's place.
        """
        while len(self.code) % 4:
            self.code.append(0)
        at = 0x2000 + 72 + len(self.code)
        tiny = len(code) < 64 and not locals_row and not handlers
        self.code += bytes([len(code) << 2 | 2]) if tiny else struct.pack("<HHII", 0x300B if handlers else 0x3003, 8, len(code), locals_row and 0x11000000 | locals_row)
        self.code += code
        if handlers:
            while len(self.code) % 4:
                self.code.append(0)
            self.code += b"\x41" + (4 + 24 * len(handlers)).to_bytes(3, "little") + b"".join(struct.pack("<6I", *h) for h in handlers)
        return at

    def bytes(self) -> bytes:
        counts = {t: len(r) for t, r in self.rows.items()}
        sizes = (4 if len(self.string_heap) > 0xFFFF else 2, 2, 4 if len(self.blob_heap) > 0xFFFF else 2)
        flags = (sizes[0] == 4) * 1 | (sizes[2] == 4) * 4
        present = sum(1 << t for t in counts)
        stream = struct.pack("<IBBBBQQ", 0, 2, 0, flags, 1, present, 0) + b"".join(struct.pack("<I", counts[t]) for t in sorted(counts))
        for t in sorted(counts):
            w = widths(t, counts, sizes)
            for row in self.rows[t]:
                stream += b"".join(v.to_bytes(n, "little") for v, n in zip(row, w, strict=True))
        heaps = [("#~", stream), ("#Strings", bytes(self.string_heap)), ("#US", bytes(self.user_heap)), ("#GUID", b"\0" * 16), ("#Blob", bytes(self.blob_heap))]
        pad = lambda b: b + b"\0" * (-len(b) % 4)
        version = pad(b"v4.0.30319\0")
        heads_size = sum(8 + len(pad(n.encode() + b"\0")) for n, _ in heaps)
        root = struct.pack("<IHHII", 0x424A5342, 1, 1, 0, len(version)) + version + struct.pack("<HH", 0, len(heaps))
        at = len(root) + heads_size
        heads, data = b"", b""
        for n, h in heaps:
            heads += struct.pack("<II", at + len(data), len(pad(h))) + pad(n.encode() + b"\0")
            data += pad(h)
        meta = root + heads + data
        code = pad(bytes(self.code))
        cli = struct.pack("<IHHIIII", 72, 2, 5, 0x2000 + 72 + len(code), len(meta), 1, 0).ljust(72, b"\0")
        section = cli + code + meta
        optional = struct.pack("<H", 0x10B).ljust(96, b"\0") + b"\0" * (14 * 8) + struct.pack("<II", 0x2000, 72) + b"\0" * 8
        head = b"MZ".ljust(0x3C, b"\0") + struct.pack("<I", 0x40) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x14C, 1, 0, 0, 0, len(optional), 0x2102) + optional
        head += b".text\0\0\0" + struct.pack("<IIII", len(section), 0x2000, len(section), 0x400).ljust(32, b"\0")
        return head.ljust(0x400, b"\0") + section
