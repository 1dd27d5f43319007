"""Relations over decoded class files: resolution, listing, filtering, disassembly, control-flow tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bytelode.functions import names as N
from bytelode.functions.bytecode import instructions
from bytelode.functions.generics import generic_signature
from bytelode.functions.opcodes import NEWARRAY

METHOD_TAGS = (9, 10, 11)


def _aligned(classes: DataFrame) -> DataFrame:
    """``classes`` with ``at``: the pool as an array whose element i - 1 is constant i, as longs and doubles take two places."""
    twice = F.transform("pool", lambda c: F.when(c["tag"].isin(5, 6), F.array(c, F.lit(None))).otherwise(F.array(c)))
    return classes.withColumn("at", F.flatten(twice))


def _entry(i: Column, *tags: int) -> Column:
    c = F.get(F.col("at"), i - 1)
    return F.when(c["tag"].isin(*tags), c)


def _string(i: Column) -> Column:
    return _entry(i, 1)["text"]


def _class(i: Column) -> Column:
    return _string(_entry(i, 7)["a"])


def _resolved(c: Column) -> Column:
    """idx, tag, owner, name, descriptor, text of a constant, its references followed in the same row's pool."""
    tag, empty = c["tag"], F.lit(None).cast("string")
    pair = _entry(c["b"], 12)
    is_ref, has_pair = tag.isin(*METHOD_TAGS), tag.isin(*METHOD_TAGS, 17, 18)
    owner = F.when(is_ref, _class(c["a"])).otherwise(empty)
    name = F.when(has_pair, _string(pair["a"])).when(tag.isin(7, 8, 12, 16, 19, 20), _string(c["a"])).otherwise(F.coalesce(c["text"], c["num"]))
    descriptor = F.when(has_pair, _string(pair["b"])).when(tag == 12, _string(c["b"])).otherwise(empty)
    text = F.concat(F.coalesce(F.concat(owner, F.lit(".")), F.lit("")), name, F.coalesce(F.concat(F.lit(":"), descriptor), F.lit("")))
    return F.struct(c["idx"].alias("idx"), tag.alias("tag"), owner.alias("owner"), name.alias("name"), descriptor.alias("descriptor"), text.alias("text"))


def resolved_constants(classes: DataFrame) -> DataFrame:
    """class_id, idx, tag, owner, name, descriptor, text: references followed to their strings, without a shuffle.

    ``text`` is what a listing shows: the string, number, class name, or owner.name:descriptor. A dangling reference
    leaves nulls.
    """
    shown = F.filter("pool", lambda c: c["tag"].isin(1, 7, 8, 12, 16, 17, 18, 19, 20, *METHOD_TAGS) | c["num"].isNotNull())
    return _aligned(classes).select("class_id", F.inline(F.transform(shown, _resolved)))


def class_names(classes: DataFrame) -> DataFrame:
    """class_id, access, major, minor, this_name, super_name, interfaces (slashed), signature, source_file."""
    return _aligned(classes.filter("error is null")).select(
        "class_id", "access", "major", "minor", _class(F.col("this_idx")).alias("this_name"), _class(F.col("super_idx")).alias("super_name"),
        F.transform("interfaces", _class).alias("interfaces"), _string(F.col("sig_idx")).alias("signature"), _string(F.col("source_idx")).alias("source_file"),
    )


def bootstraps(classes: DataFrame) -> DataFrame:
    """class_id, ord, ref, args: bootstrap methods, their handle and arguments as pool rows."""
    return classes.filter("error is null").select("class_id", F.posexplode("bootstraps").alias("ord", "b")).select("class_id", "ord", "b.ref", "b.args")


def list_types(named: DataFrame) -> DataFrame:
    return named.select("class_id", N.dotted(F.col("this_name")).alias("name"))


def filter_types(named: DataFrame, wanted: str) -> DataFrame:
    """Classes whose simple or qualified dotted name is ``wanted``."""
    name = N.dotted(F.col("this_name"))
    return named.filter((name == wanted) | (N.simple_name(name) == wanted))


def members(classes: DataFrame) -> DataFrame:
    """One row per field and method with names, types, modifiers, thrown and caught classes as text, and the generic signature."""
    rows = _aligned(classes.filter("error is null"))
    texts = lambda m: F.struct(
        m.alias("m"), _string(m["name_idx"]).alias("name"), _string(m["desc_idx"]).alias("descriptor"), _resolved(F.get(F.col("at"), m["const_idx"] - 1))["text"].alias("constant"),
        _string(m["sig_idx"]).alias("signature"), F.transform(m["throws"], lambda i: N.dotted(_class(i))).alias("thrown"),
        F.transform(m["handlers"], lambda h: F.coalesce(N.dotted(_class(h["type_idx"])), F.lit("any"))).alias("caught"),
    )
    rows = rows.select("class_id", F.inline(F.transform("members", texts)))
    rows = rows.select("class_id", "m.*", "name", "descriptor", "constant", "signature", "thrown", "caught")
    is_method = F.col("kind") == "method"
    return rows.select(
        "class_id", "kind", "ord", "name", "descriptor", "access", "constant", "max_stack", "max_locals", "code", "handlers", "signature", "thrown", "caught",
        F.when(is_method, N.return_text(F.col("descriptor"))).otherwise(N.type_text(F.col("descriptor"))).alias("type"),
        F.when(is_method, N.parameter_texts(F.col("descriptor"))).alias("params"),
        F.array_join(F.when(is_method, N.flag_names(F.col("access"), "method")).otherwise(N.flag_names(F.col("access"), "field")), " ").alias("modifiers"),
    )


def source_members(rows: DataFrame) -> DataFrame:
    """Members a source listing shows: no synthetic or ``$`` fields, no synthetic or bridge methods."""
    bit = lambda m: F.col("access").bitwiseAND(m) != 0
    field = (F.col("kind") == "field") & ~bit(0x1000) & ~F.col("name").startswith("$")
    return rows.filter(field | ((F.col("kind") == "method") & ~bit(0x1000) & ~bit(0x40)))


def enum_utilities() -> Column:
    """Whether a member of an enum is the compiler's own: ``values``, ``valueOf``, ``$values`` and the constructor of name and number."""
    name, descriptor = F.col("name"), F.col("descriptor")
    made = ((name == "values") & descriptor.startswith("()[L")) | ((name == "valueOf") & descriptor.startswith("(Ljava/lang/String;)L")) | (name == "$values")
    return (F.col("kind") == "method") & (made | ((name == "<init>") & descriptor.startswith("(Ljava/lang/String;I)")))


def method_instructions(rows: DataFrame) -> DataFrame:
    return instructions(rows.filter("kind = 'method'"), ["class_id", "ord"], "jvm")


def branch_targets(instr: DataFrame) -> DataFrame:
    """Distinct jump targets of each method."""
    return instr.select("class_id", "ord", F.explode("targets").alias("target")).distinct()


def _escaped(text: Column) -> Column:
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return text


def operand_text(resolved: DataFrame, instr: DataFrame) -> DataFrame:
    """``instr`` with ``operand``: pool references as text (strings quoted), else numbers, else targets, those of a switch with their cases."""
    uses_pool = F.col("name").startswith("ldc") | F.col("op").between(178, 189) & (F.col("op") != 188) | F.col("op").isin(192, 193, 197)
    keyed = instr.withColumn("idx", F.when(uses_pool, F.col("ref")).cast("int"))
    shown = F.when(F.col("tag") == 8, F.concat(F.lit('"'), _escaped(F.col("text")), F.lit('"'))).otherwise(F.col("text"))
    joined = keyed.join(resolved.select("class_id", "idx", shown.alias("text")), ["class_id", "idx"], "left")
    array_type = F.create_map(*(F.lit(x) for pair in NEWARRAY.items() for x in pair))[F.col("ref").cast("int")]
    number = F.when(F.col("name") == "newarray", F.coalesce(array_type, F.col("ref").cast("string"))).otherwise(F.concat_ws(", ", F.when(~uses_pool, F.col("ref").cast("string")), F.col("whole").cast("string")))
    labels = F.concat(F.col("cases").cast("array<string>"), F.when(F.size("cases") < F.size("targets"), F.array(F.lit("default"))).otherwise(F.array().cast("array<string>")))
    arms = F.array_join(F.zip_with(labels, F.col("targets").cast("array<string>"), lambda c, t: F.concat(c, F.lit(": "), t)), ", ")
    jumps = F.when(F.col("name").endswith("switch"), arms).when(F.size("targets") > 0, F.array_join(F.col("targets").cast("array<string>"), ", "))
    return joined.withColumn("operand", F.coalesce("text", jumps, number)).drop("idx", "text")


def disassemble(named: DataFrame, rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """class_id, ord, name, listing: a header, figures, one line an instruction, the exception table. Methods without a body have the header only."""
    lines = operand_text(resolved, method_instructions(rows)).select(
        "class_id", "ord", F.struct("pos", F.rtrim(F.concat(F.lpad(F.col("offset").cast("string"), 6, " "), F.lit(": "), "name", F.lit(" "), "operand")).alias("line")).alias("l")
    )
    body = lines.groupBy("class_id", "ord").agg(F.array_join(F.sort_array(F.collect_list("l"))["line"], "\n").alias("body"))
    table = F.zip_with("handlers", "caught", lambda h, c: F.format_string("    [%d, %d) -> %d %s", h["start"], h["stop"], h["handler"], c))
    slots = N.parameter_slots(F.col("descriptor")) + F.when(F.col("access").bitwiseAND(8) != 0, 0).otherwise(1)
    thrown = F.when(F.size("thrown") > 0, F.concat(F.lit(" throws "), F.array_join("thrown", ", "))).otherwise("")
    flags = F.when(F.col("modifiers") != "", F.concat(F.lit("\n  flags: "), "modifiers")).otherwise("")
    head = F.concat(N.dotted(F.col("this_name")), F.lit("."), "name", F.lit("("), F.array_join("params", ", "), F.lit(") -> "), "type", thrown, flags)
    figures = F.concat(F.lit("\n  stack="), F.col("max_stack").cast("string"), F.lit(", locals="), F.col("max_locals").cast("string"), F.lit(", args="), slots.cast("string"), F.lit("\n"))
    tail = F.when(F.size("handlers") > 0, F.concat(F.lit("\n  Exception table:\n"), F.array_join(table, "\n"))).otherwise("")
    methods = rows.filter("kind = 'method'").join(named.select("class_id", "this_name"), "class_id").join(body, ["class_id", "ord"], "left")
    return methods.select("class_id", "ord", "name", F.concat(head, F.coalesce(F.concat(figures, "body", tail), F.lit(""))).alias("listing"))


def class_listing(named: DataFrame, rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """class_id, listing: a class's header with version, flags and source file, its fields, and all its methods."""
    fields = rows.filter("kind = 'field'")
    shown = F.concat("type", F.lit(" "), "name", F.when(F.col("modifiers") != "", F.concat(F.lit(" flags: "), "modifiers")).otherwise(""), F.coalesce(F.concat(F.lit(" = "), "constant"), F.lit("")))
    units = fields.select("class_id", F.struct(F.lit(0).alias("o"), "ord", shown.alias("text")).alias("u")).unionByName(
        disassemble(named, rows, resolved).select("class_id", F.struct(F.lit(1).alias("o"), "ord", F.col("listing").alias("text")).alias("u"))
    )
    body = units.groupBy("class_id").agg(F.array_join(F.sort_array(F.collect_list("u"))["text"], "\n\n").alias("body"))
    above = F.coalesce(F.concat(F.lit(" extends "), N.dotted(F.col("super_name"))), F.lit(""))
    sides = F.when(F.size("interfaces") > 0, F.concat(F.lit(" implements "), F.array_join(F.transform("interfaces", N.dotted), ", "))).otherwise("")
    flags = F.array_join(N.flag_names(F.col("access"), "class"), " ")
    head = F.concat(
        F.lit("class "), N.dotted(F.col("this_name")), above, sides, F.lit("\n  version: "), F.concat_ws(".", F.col("major").cast("string"), F.col("minor").cast("string")),
        F.when(flags != "", F.concat(F.lit("\n  flags: "), flags)).otherwise(""), F.coalesce(F.concat(F.lit("\n  source: "), "source_file"), F.lit("")),
    )
    return named.join(body, "class_id", "left").select("class_id", F.concat(head, F.coalesce(F.concat(F.lit("\n\n"), "body"), F.lit(""))).alias("listing"))


def handlers(rows: DataFrame) -> DataFrame:
    """Catch ranges: sorted, a handler that repeats the one before is dropped, each ends where the next handler begins."""
    each = rows.filter("size(handlers) > 0").select("class_id", "ord", F.octet_length("code").alias("code_length"), F.explode("handlers").alias("h")).select("class_id", "ord", "code_length", "h.*")
    order = W.partitionBy("class_id", "ord").orderBy("handler", "start")
    same = F.lag("handler").over(order).eqNullSafe(F.col("handler")) & F.lag("type_idx").over(order).eqNullSafe(F.col("type_idx"))
    kept = each.withColumn("same", same).filter(~F.col("same")).drop("same")
    points = kept.select("class_id", "ord", "code_length", "handler").distinct()
    ends = points.withColumn("handler_stop", F.lead("handler").over(W.partitionBy("class_id", "ord").orderBy("handler")))
    ends = ends.withColumn("handler_stop", F.coalesce("handler_stop", "code_length")).drop("code_length")
    return kept.join(ends, ["class_id", "ord", "handler"])


def synchronized_handlers(instr: DataFrame) -> DataFrame:
    """Offsets where an exception is stored, the monitor loaded and left: the compiler's own handlers of synchronized blocks."""
    order = W.partitionBy("class_id", "ord").orderBy("pos")
    starts: Column = F.col("name").startswith("astore") & F.lead("name", 1).over(order).startswith("aload") & (F.lead("name", 2).over(order) == "monitorexit")
    return instr.withColumn("is_start", starts).filter("is_start").select("class_id", "ord", "offset")


def fused_comparisons(instr: DataFrame) -> DataFrame:
    """Comparisons whose result the next instruction tests: one condition with its target."""
    order = W.partitionBy("class_id", "ord").orderBy("pos")
    pairs = instr.withColumn("next_name", F.lead("name").over(order)).withColumn("next_targets", F.lead("targets").over(order))
    return pairs.filter(F.col("name").rlike("^(lcmp|[fd]cmp[lg])$") & F.col("next_name").rlike("^if(eq|ne|lt|ge|gt|le)$")).select(
        "class_id", "ord", "offset", "name", F.col("next_name").alias("test"), F.get("next_targets", F.lit(0)).alias("target")
    )


def switch_sizes(instr: DataFrame) -> DataFrame:
    """Cases of the first switch of each method."""
    return instr.filter("name in ('tableswitch', 'lookupswitch', 'switch')").groupBy("class_id", "ord").agg(F.min_by(F.size("targets"), "pos").alias("n_targets"))


def declarations(named: DataFrame, rows: DataFrame) -> DataFrame:
    """class_id, file_name, source: each class's declaration with the members a listing shows, bodies left out; generic types where there are any.

    An enum begins with its constants, which are no fields, and the compiler's own members of enums are left out.
    """
    rows = rows.withColumn("g", generic_signature(F.col("signature")))
    last = F.get("g.types", F.size("g.types") - 1)
    own_params = F.when(F.size("g.params") > 0, F.concat(F.lit("<"), F.array_join("g.params", ", "), F.lit("> "))).otherwise("")
    some = F.when(F.size("g.types") > 0, F.slice("g.types", 1, F.size("g.types") - 1))
    rows = rows.withColumn("type", F.coalesce(last, "type")).withColumn("params", F.coalesce(some, "params")).withColumn("own_params", F.coalesce(own_params, F.lit("")))
    thrown = F.when(F.size("thrown") > 0, F.concat(F.lit(" throws "), F.array_join("thrown", ", "))).otherwise("")
    constant = F.coalesce(F.concat(F.lit(" = "), "constant"), F.lit(""))
    words = F.when(F.col("modifiers") != "", F.concat("modifiers", F.lit(" "))).otherwise("")
    is_field = F.col("kind") == "field"
    simple = N.simple_name(N.dotted(F.col("this_name")))
    line = F.concat(
        F.lit("    "), words,
        F.when(is_field, F.concat("type", F.lit(" "), "name", constant, F.lit(";")))
        .when(F.col("name") == "<init>", F.concat("own_params", simple, F.lit("("), F.array_join("params", ", "), F.lit(")"), thrown, F.lit(";")))
        .when(F.col("name") == "<clinit>", F.lit("{ }"))
        .otherwise(F.concat("own_params", "type", F.lit(" "), "name", F.lit("("), F.array_join("params", ", "), F.lit(")"), thrown, F.lit(";"))),
    )
    of_enum = F.col("class_access").bitwiseAND(0x4000) != 0
    constant_ = of_enum & is_field & (F.col("access").bitwiseAND(0x4000) != 0)
    shown = source_members(rows).join(named.select("class_id", "this_name", F.col("access").alias("class_access")), "class_id").filter(~(of_enum & enum_utilities()))
    first = shown.filter(constant_).groupBy("class_id").agg(F.concat(F.lit("    "), F.array_join(F.sort_array(F.collect_list(F.struct("ord", "name")))["name"], ", "), F.lit(";")).alias("line"))
    lines = shown.filter(~constant_).select("class_id", F.struct(F.when(is_field, 1).otherwise(2).alias("o"), "ord", line.alias("line")).alias("l"))
    lines = lines.unionByName(first.select("class_id", F.struct(F.lit(0).alias("o"), F.lit(0).alias("ord"), "line").alias("l")))
    body = lines.groupBy("class_id").agg(F.array_join(F.sort_array(F.collect_list("l"))["line"], "\n").alias("body"))
    bit = lambda m: F.col("access").bitwiseAND(m) != 0
    kind = F.when(bit(0x2000), "@interface").when(bit(0x200), "interface").when(bit(0x4000), "enum").otherwise("class")
    package = N.package_of(F.col("this_name"))
    named = named.withColumn("g", generic_signature(F.col("signature")))
    own = F.coalesce(F.when(F.size("g.params") > 0, F.concat(F.lit("<"), F.array_join("g.params", ", "), F.lit(">"))), F.lit(""))
    above = F.coalesce(F.get("g.types", F.lit(0)), N.dotted(F.col("super_name")))
    wide = F.coalesce(F.slice("g.types", 2, F.greatest(F.size("g.types"), F.lit(1))), F.transform("interfaces", N.dotted))
    sides = F.when(F.size(wide) > 0, F.concat(F.when(bit(0x200), " extends ").otherwise(" implements "), F.array_join(wide, ", "))).otherwise("")
    plain = F.col("super_name").isNull() | F.col("super_name").isin("java/lang/Object", "java/lang/Enum")
    head = F.concat(
        F.when(package != "", F.concat(F.lit("package "), package, F.lit(";\n\n"))).otherwise(""), F.when(bit(1), "public ").otherwise(""), F.when(bit(0x10) & ~bit(0x4000), "final ").otherwise(""),
        F.when(bit(0x400) & ~bit(0x200), "abstract ").otherwise(""), kind, F.lit(" "), simple, own, F.when(plain, "").otherwise(F.concat(F.lit(" extends "), above)), sides, F.lit(" {\n"),
    )
    return named.join(body, "class_id", "left").select(
        "class_id", N.file_name(package, F.translate(F.regexp_extract("this_name", "([^/]*)$", 1), "$", "_"), ".java").alias("file_name"), F.concat(head, F.coalesce(F.concat("body", F.lit("\n")), F.lit("")), F.lit("}\n")).alias("source")
    )


def concatenations(classes: DataFrame, rows: DataFrame) -> DataFrame:
    """class_id, ord, offset, text: string concatenations behind dynamic calls, as the source has them, with ``argN`` for the Nth value on the stack.

    A call site names a bootstrap method and its arguments. Where that is the recipe form, U+0001 in the recipe stands for the next value, U+0002 for the next
    constant; where it is the plain form, all values are joined. Other bootstraps give no row. All references lie in the row's own pool, so nothing is shuffled for them.
    """
    sites = F.transform(F.filter("pool", lambda c: c["tag"] == 18), lambda c: F.struct(c["idx"].cast("long").alias("ref"), F.get(F.col("bootstraps"), c["a"]).alias("b"), _string(_entry(c["b"], 12)["b"]).alias("descriptor")))
    each = _aligned(classes.filter("error is null")).select("class_id", "at", F.inline(sites))
    handle = _entry(_entry(F.col("b.ref"), 15)["b"], *METHOD_TAGS)
    named = each.withColumn("owner", _class(handle["a"])).withColumn("made", _string(_entry(handle["b"], 12)["a"])).filter("owner = 'java/lang/invoke/StringConcatFactory'")
    quoted = lambda t: F.concat(F.lit('"'), _escaped(t), F.lit('"'))
    const = lambda i: F.coalesce(F.when(_entry(i, 8).isNotNull(), quoted(_string(_entry(i, 8)["a"]))), _class(i), _entry(i, 3, 4, 5, 6)["num"], F.lit("?"))
    tokens = F.regexp_extract_all(_string(_entry(F.get("b.args", F.lit(0)), 8)["a"]), F.lit("([\x01\x02]|[^\x01\x02]+)"), F.lit(1))
    named = named.withColumn("tokens", tokens).withColumn("constants", F.transform(F.slice("b.args", 2, F.size("b.args")), const)).withColumn("n", F.size(N.parameter_texts(F.col("descriptor"))))
    nth = lambda mark, i: F.size(F.filter(F.slice("tokens", 1, i + 1), lambda t: t == mark)) - 1
    part = lambda t, i: F.when(t == "\x01", F.concat(F.lit("arg"), nth("\x01", i).cast("string"))).when(t == "\x02", F.coalesce(F.get("constants", nth("\x02", i)), F.lit("?"))).otherwise(quoted(t))
    plain = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.concat(F.lit("arg"), i.cast("string")))
    parts = F.when(F.col("made") == "makeConcatWithConstants", F.transform("tokens", part)).when((F.col("made") == "makeConcat") & (F.col("n") > 0), plain)
    shown = named.select("class_id", "ref", F.array_join(parts, " + ").alias("text")).filter("text is not null")
    calls = method_instructions(rows).filter("name = 'invokedynamic'").select("class_id", "ord", "offset", "ref")
    return calls.join(shown, ["class_id", "ref"]).select("class_id", "ord", "offset", "text")
