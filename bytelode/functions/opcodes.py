"""Opcode tables of both virtual machines, built from their families.

The values are those of the public JVM and ECMA-335 specifications. A table maps an opcode to (mnemonic, operand kind).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

JVM_TYPES = "ilfda"
JVM_ARRAYS = "ilfdabcs"
#: Code of ``newarray`` -> element type.
NEWARRAY = {4: "boolean", 5: "char", 6: "float", 7: "double", 8: "byte", 9: "short", 10: "int", 11: "long"}


def jvm_opcodes() -> dict[int, tuple[str, str]]:
    names: list[tuple[str, str]] = []

    def add(kind: str, *more: str) -> None:
        names.extend((m, kind) for m in more)

    add("", "nop", "aconst_null", *(f"iconst_{n}" for n in ("m1", 0, 1, 2, 3, 4, 5)), "lconst_0", "lconst_1")
    add("", "fconst_0", "fconst_1", "fconst_2", "dconst_0", "dconst_1")
    add("byte", "bipush")
    add("short", "sipush")
    add("cp1", "ldc")
    add("cp2", "ldc_w", "ldc2_w")
    for verb in ("load", "store"):
        add("local", *(t + verb for t in JVM_TYPES))
        add("", *(f"{t}{verb}_{n}" for t in JVM_TYPES for n in range(4)), *(t + "a" + verb for t in JVM_ARRAYS))
    add("", "pop", "pop2", "dup", "dup_x1", "dup_x2", "dup2", "dup2_x1", "dup2_x2", "swap")
    add("", *(t + op for op in ("add", "sub", "mul", "div", "rem", "neg") for t in "ilfd"))
    add("", *(t + op for op in ("shl", "shr", "ushr", "and", "or", "xor") for t in "il"))
    add("iinc", "iinc")
    add("", *(f"{a}2{b}" for a in "ilfd" for b in "ilfd" if a != b), "i2b", "i2c", "i2s")
    add("", "lcmp", "fcmpl", "fcmpg", "dcmpl", "dcmpg")
    tests = ("eq", "ne", "lt", "ge", "gt", "le")
    add("branch2", *("if" + c for c in tests), *("if_icmp" + c for c in tests), "if_acmpeq", "if_acmpne", "goto", "jsr")
    add("local", "ret")
    add("table", "tableswitch")
    add("lookup", "lookupswitch")
    add("", *(t + "return" for t in JVM_TYPES), "return")
    add("cp2", *(a + b for b in ("static", "field") for a in ("get", "put")), "invokevirtual", "invokespecial", "invokestatic")
    add("cp2x2", "invokeinterface", "invokedynamic")
    add("cp2", "new")
    add("atype", "newarray")
    add("cp2", "anewarray")
    add("", "arraylength", "athrow")
    add("cp2", "checkcast", "instanceof")
    add("", "monitorenter", "monitorexit")
    add("wide", "wide")
    add("cp2dims", "multianewarray")
    add("branch2", "ifnull", "ifnonnull")
    add("branch4", "goto_w", "jsr_w")
    return dict(enumerate(names))


def cil_opcodes() -> dict[int, tuple[str, str]]:
    """Two-byte opcodes have 0xFE00 added. Numbers without a name are left out."""
    out: dict[int, tuple[str, str]] = {}

    def add(first: int, kind: str, *more: str) -> None:
        out.update({first + i: (m, kind) for i, m in enumerate(more)})

    quads = lambda p: [f"{p}.{n}" for n in range(4)]
    tests = ("beq", "bge", "bgt", "ble", "blt", "bne.un", "bge.un", "bgt.un", "ble.un", "blt.un")
    branches = ("br", "brfalse", "brtrue", *tests)
    math = ("add", "sub", "mul", "div", "div.un", "rem", "rem.un", "and", "or", "xor", "shl", "shr", "shr.un", "neg", "not")
    add(0x00, "", "nop", "break", *quads("ldarg"), *quads("ldloc"), *quads("stloc"))
    add(0x0E, "u1", "ldarg.s", "ldarga.s", "starg.s", "ldloc.s", "ldloca.s", "stloc.s")
    add(0x14, "", "ldnull", "ldc.i4.m1", *(f"ldc.i4.{n}" for n in range(9)))
    add(0x1F, "i1", "ldc.i4.s")
    add(0x20, "i4", "ldc.i4")
    add(0x21, "i8", "ldc.i8")
    add(0x22, "r4", "ldc.r4")
    add(0x23, "r8", "ldc.r8")
    add(0x25, "", "dup", "pop")
    add(0x27, "token", "jmp", "call", "calli")
    add(0x2A, "", "ret")
    add(0x2B, "branch1", *(b + ".s" for b in branches))
    add(0x38, "branch4", *branches)
    add(0x45, "switch", "switch")
    add(0x46, "", *("ldind." + t for t in ("i1", "u1", "i2", "u2", "i4", "u4", "i8", "i", "r4", "r8", "ref")))
    add(0x51, "", *("stind." + t for t in ("ref", "i1", "i2", "i4", "i8", "r4", "r8")))
    add(0x58, "", *math, *("conv." + t for t in ("i1", "i2", "i4", "i8", "r4", "r8", "u4", "u8")))
    add(0x6F, "token", "callvirt", "cpobj", "ldobj", "ldstr", "newobj", "castclass", "isinst")
    add(0x76, "", "conv.r.un")
    add(0x79, "token", "unbox")
    add(0x7A, "", "throw")
    add(0x7B, "token", "ldfld", "ldflda", "stfld", "ldsfld", "ldsflda", "stsfld", "stobj")
    wide = ("i1", "i2", "i4", "i8", "u1", "u2", "u4", "u8", "i", "u")
    add(0x82, "", *(f"conv.ovf.{t}.un" for t in wide))
    add(0x8C, "token", "box", "newarr")
    add(0x8E, "", "ldlen")
    add(0x8F, "token", "ldelema")
    add(0x90, "", *("ldelem." + t for t in ("i1", "u1", "i2", "u2", "i4", "u4", "i8", "i", "r4", "r8", "ref")))
    add(0x9B, "", *("stelem." + t for t in ("i", "i1", "i2", "i4", "i8", "r4", "r8", "ref")))
    add(0xA3, "token", "ldelem", "stelem", "unbox.any")
    add(0xB3, "", *("conv.ovf." + t for t in ("i1", "u1", "i2", "u2", "i4", "u4", "i8", "u8")))
    add(0xC2, "token", "refanyval")
    add(0xC3, "", "ckfinite")
    add(0xC6, "token", "mkrefany")
    add(0xD0, "token", "ldtoken")
    add(0xD1, "", "conv.u2", "conv.u1", "conv.i", "conv.ovf.i", "conv.ovf.u", *(f"{m}.ovf{u}" for m in ("add", "mul", "sub") for u in ("", ".un")), "endfinally")
    add(0xDD, "branch4", "leave")
    add(0xDE, "branch1", "leave.s")
    add(0xDF, "", "stind.i", "conv.u")
    add(0xF8, "", *(f"prefix{n}" for n in range(7, 0, -1)), "prefixref")
    add(0xFE00, "", "arglist", "ceq", "cgt", "cgt.un", "clt", "clt.un")
    add(0xFE06, "token", "ldftn", "ldvirtftn")
    add(0xFE09, "u2", "ldarg", "ldarga", "starg", "ldloc", "ldloca", "stloc")
    add(0xFE0F, "", "localloc")
    add(0xFE11, "", "endfilter")
    add(0xFE12, "u1", "unaligned.")
    add(0xFE13, "", "volatile.", "tail.")
    add(0xFE15, "token", "initobj", "constrained.")
    add(0xFE17, "", "cpblk", "initblk")
    add(0xFE1A, "", "rethrow")
    add(0xFE1C, "token", "sizeof")
    add(0xFE1D, "", "refanytype", "readonly.")
    return out


def opcode_table(spark: SparkSession, machine: str) -> DataFrame:
    """The opcodes as a dimension table (op, name, kind); at most a few hundred rows."""
    table = jvm_opcodes() if machine == "jvm" else cil_opcodes()
    return spark.createDataFrame([(op, n, k) for op, (n, k) in table.items()], "op int, name string, kind string")
