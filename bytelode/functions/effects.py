"""How instructions change the height of the operand stack, as a small dimension table for each machine.

Heights count slots on one machine (long and double take two) and values on the other. Instructions whose change follows from what they refer to,
such as calls, have none here.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from bytelode.functions.opcodes import cil_opcodes, jvm_opcodes

#: Fixed values (the public specifications of both machines): patterns of names and the change of height; the first that fits counts.
JVM_RULES = [
    (r"(get|put)(static|field)|invoke\w+|multianewarray", None),
    (r"[ld]aload", 0), (r"[ifabcs]aload", -1), (r"[ld]astore", -4), (r"[ifabcs]astore", -3),
    (r"[ifa]load(_\d)?|aconst_null|[if]const_\w+|bipush|sipush|ldc|ldc_w|new|dup|dup_x[12]|jsr(_w)?|[if]2[ld]", 1),
    (r"[ld]load(_\d)?|[ld]const_\w+|ldc2_w|dup2(_x[12])?", 2),
    (r"[ifa]store(_\d)?|pop|[if](add|sub|mul|div|rem)|[il](shl|shr|ushr)|i(and|or|xor)|[ld]2[if]|fcmp[lg]", -1),
    (r"if(eq|ne|lt|ge|gt|le|null|nonnull)|(table|lookup)switch|monitor\w+|athrow|[ifa]return", -1),
    (r"[ld]store(_\d)?|pop2|[ld](add|sub|mul|div|rem)|l(and|or|xor)|if_[ia]cmp\w+|[ld]return", -2),
    (r"lcmp|dcmp[lg]", -3), (r".*", 0),
]
CIL_RULES = [
    (r"call|calli|callvirt|newobj", None),
    (r"ldarg.*|ldloc.*|ldnull|ldc\..*|dup|ldstr|ldsflda?|ldtoken|ldftn|sizeof|arglist", 1),
    (r"stloc.*|starg.*|pop|br(false|true)(\.s)?|switch|throw|stsfld|initobj|endfilter|ldelem.*", -1),
    (r"(add|sub|mul|div|rem)(\.ovf)?(\.un)?|and|or|xor|shl|shr(\.un)?|ceq|c[gl]t(\.un)?", -1),
    (r"b(eq|ge|gt|le|lt|ne)(\.un)?(\.s)?|stind\..*|stfld|stobj|cpobj", -2), (r"stelem.*|cpblk|initblk", -3), (r".*", 0),
]


def changes(machine: str) -> dict[str, int | None]:
    """Mnemonic -> change of height, None where it depends on the operand."""
    table, rules = (jvm_opcodes(), JVM_RULES) if machine == "jvm" else (cil_opcodes(), CIL_RULES)
    return {name: next(n for pattern, n in rules if re.fullmatch(pattern, name)) for name, _ in table.values()}


def change_table(spark: SparkSession, machine: str) -> DataFrame:
    """(name, delta) of the opcodes; at most a few hundred rows."""
    return spark.createDataFrame(list(changes(machine).items()), "name string, delta int")
