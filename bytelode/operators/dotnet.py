"""Relations over decoded assemblies: ownership, names, listing, JSON model, obfuscation report, IL text, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bytelode.functions import names as N
from bytelode.functions.bytecode import instructions
from bytelode.functions.literals import argument_literals, constant_literal
from bytelode.functions.search import names_missing_in
from bytelode.functions.signatures import signature_parts
from bytelode.rounds import drop, kept
from bytelode.sources.pe import USER_STRINGS, view

MODULE_TYPE = "<Module>"


def owned(owners: DataFrame, start: str, members: DataFrame) -> DataFrame:
    """(file_id, owner, rid) for members that belong to an owner by ranges of row numbers.

    An owner's range ends where the next owner's begins, the last one's at the last member. Ranges are unfolded, so what
    uses the map joins on equality.
    """
    last = members.groupBy("file_id").agg(F.max("rid").alias("last"))
    ends = owners.select("file_id", F.col("rid").alias("owner"), F.col(start).alias("start")).withColumn(
        "stop", F.lead("start").over(W.partitionBy("file_id").orderBy("owner"))
    )
    ranges = ends.join(last, "file_id").withColumn("stop", F.coalesce("stop", F.col("last") + 1)).filter("start < stop")
    return ranges.select("file_id", "owner", F.explode(F.sequence(F.col("start").cast("int"), F.col("stop").cast("int") - 1)).alias("rid"))


def _plain_type_names(md: DataFrame) -> DataFrame:
    defs, refs = view(md, 2), view(md, 1)
    one = lambda df, t: df.select("file_id", F.lit(t).alias("table"), "rid", F.col("Namespace").alias("namespace"), F.col("Name").alias("name"))
    return one(defs, 2).unionByName(one(refs, 1))


def type_names(md: DataFrame) -> DataFrame:
    """file_id, table, rid, namespace, name of defined and referenced types, and of type specifications, which have no namespace."""
    specs = spec_names(md).select("file_id", F.lit(27).alias("table"), "rid", F.lit("").alias("namespace"), "name")
    return _plain_type_names(md).unionByName(specs)


def spec_names(md: DataFrame) -> DataFrame:
    """file_id, rid, name of type specifications: instances of generic types, arrays and pointers, as text.

    The names come from signatures, whose parts are literal text or point to types; one that points to further specifications is
    named once all of these are, so each round names the next layer. What a ring or damage leaves without a name shows as ``?``. The
    names are worked out once a frame of metadata.
    """
    if not hasattr(md, "_bytelode_specs"):
        md._bytelode_specs = _spec_names(md)
    return md._bytelode_specs


def _spec_names(md: DataFrame) -> DataFrame:
    sigs = view(md, 27).select("file_id", "rid", F.get(signature_parts(F.col("Signature"), "spec"), F.lit(0)).alias("parts"))
    each = sigs.select("file_id", "rid", F.posexplode_outer("parts").alias("k", "p")).select("file_id", "rid", "k", "p.text", F.col("p.table").alias("table"), F.col("p.rid").alias("ref"))
    plain = _plain_type_names(md).select("file_id", "table", F.col("rid").alias("ref"), N.clean_generic(F.col("name")).alias("found"))
    parts = each.join(plain, ["file_id", "table", "ref"], "left").select("file_id", "rid", "k", F.coalesce("text", "found").alias("text"), "table", "ref")
    # only parts that point to a specification wait
    waits = F.col("text").isNull() & (F.col("table") == 27)
    now = kept(parts, "specs")
    shown = lambda df: df.groupBy("file_id", "rid").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("k", F.coalesce("text", F.lit("?")).alias("t"))))["t"], "").alias("name"), F.count_if(waits).alias("open")
    )
    left = now.filter(waits).count()
    while left:
        ready = shown(now).filter("open = 0").select("file_id", F.col("rid").alias("ref"), F.col("name").alias("found")).withColumn("table", F.lit(27))
        after = kept(now.join(ready, ["file_id", "table", "ref"], "left").select("file_id", "rid", "k", F.coalesce("text", "found").alias("text"), "table", "ref"), "specs")
        drop(now)
        now, before = after, left
        left = now.filter(waits).count()
        if left == before:
            break
    return shown(now).select("file_id", "rid", "name")


def in_context(text: Column, of_type: Column, of_method: Column | None = None) -> Column:
    """``text`` with the numbers of generic parameters replaced by the names of the type's and the method's; higher numbers first."""
    def filled(text: Column, mark: str, names: Column) -> Column:
        numbered = F.reverse(F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n, i: F.struct(i.cast("string").alias("i"), n.alias("n"))))
        return F.aggregate(numbered, text, lambda t, x: F.replace(t, F.concat(F.lit(mark), x["i"]), x["n"]))

    return filled(text if of_method is None else filled(text, "!!", of_method), "!", of_type)


def nested_in(md: DataFrame) -> DataFrame:
    """file_id, rid, parent: the first enclosing row of each nested type."""
    return view(md, 41).groupBy("file_id", F.col("NestedClass").cast("int").alias("rid")).agg(F.min_by("EnclosingClass", "rid").cast("int").alias("parent"))


def list_types(md: DataFrame) -> DataFrame:
    """All defined types but the module's: ``Parent/Name`` for nested ones, else with namespace, in row order."""
    defs = view(md, 2).filter(F.col("Name") != MODULE_TYPE)
    outer = view(md, 2).select("file_id", F.col("rid").alias("parent"), F.col("Name").alias("parent_name"))
    joined = defs.join(nested_in(md), ["file_id", "rid"], "left").join(outer, ["file_id", "parent"], "left")
    name = F.when(F.col("parent_name").isNotNull(), F.concat_ws("/", "parent_name", "Name")).otherwise(N.qualified(F.col("Namespace"), F.col("Name")))
    return joined.select("file_id", "rid", name.alias("name"))


def filter_types(md: DataFrame, wanted: str, nested: bool = True) -> DataFrame:
    """Types whose name or qualified name is ``wanted``. Without ``nested``, the first top-level match of each file."""
    name = N.qualified(F.col("Namespace"), F.col("Name"))
    hits = view(md, 2).filter((F.col("Name") != MODULE_TYPE) & ((F.col("Name") == wanted) | (name == wanted)))
    if nested:
        return hits.select("file_id", "rid", name.alias("name"))
    top = hits.join(nested_in(md), ["file_id", "rid"], "left_anti")
    return top.groupBy("file_id").agg(F.min("rid").alias("rid"), F.min_by(name, "rid").alias("name"))


def kinds(md: DataFrame) -> DataFrame:
    """Kind of each type: interface by flag; enum, struct, delegate by base; static class by flags and no instance constructor."""
    base = type_names(md).select("file_id", F.col("table").alias("Extends_table"), F.col("rid").alias("Extends_rid"), F.col("name").alias("base"))
    defs = view(md, 2)
    methods = view(md, 6)
    instance = methods.filter("Name = '.ctor'").select("file_id", "rid").join(owned(defs, "MethodList", methods), ["file_id", "rid"]).select("file_id", F.col("owner").alias("rid")).distinct()
    kind = (
        F.when(F.col("Flags").bitwiseAND(0x20) != 0, "interface")
        .when(F.col("base") == "Enum", "enum").when(F.col("base") == "ValueType", "struct").when(F.col("base") == "MulticastDelegate", "delegate")
        .otherwise("class")
    )
    both = defs.join(base, ["file_id", "Extends_table", "Extends_rid"], "left").join(instance.withColumn("has_ctor", F.lit(True)), ["file_id", "rid"], "left")
    return both.withColumn("kind", kind).select(
        "file_id", "rid", N.qualified(F.col("Namespace"), F.col("Name")).alias("name"), "kind",
        ((F.col("kind") == "class") & (F.col("Flags").bitwiseAND(0x180) == 0x180) & F.col("has_ctor").isNull()).alias("is_static"),
    )


def render_types(md: DataFrame, rows: DataFrame, blob: str, kind: str) -> DataFrame:
    """(file_id, rid, i, text): the types of each signature as text; 0 is the return or field type. ``?`` if damaged."""
    parts = rows.select("file_id", "rid", signature_parts(F.col(blob), kind).alias("sig"))
    each = parts.select("file_id", "rid", F.posexplode_outer("sig").alias("i", "parts")).select("file_id", "rid", F.coalesce("i", F.lit(0)).alias("i"), F.posexplode_outer("parts").alias("k", "p"))
    flat = each.select("file_id", "rid", "i", "k", F.col("p.text").alias("text"), F.col("p.table").alias("table"), F.col("p.rid").alias("ref"))
    known = type_names(md).select("file_id", "table", F.col("rid").alias("ref"), N.clean_generic(F.col("name")).alias("type_name"))
    text = F.coalesce("text", "type_name", F.lit("?"))
    return flat.join(known, ["file_id", "table", "ref"], "left").groupBy("file_id", "rid", "i").agg(F.array_join(F.sort_array(F.collect_list(F.struct("k", text.alias("t"))))["t"], "").alias("text"))


def method_types(md: DataFrame) -> DataFrame:
    """``render_types`` of all methods' signatures, worked out once a frame of metadata and written, as several relations use it."""
    if not hasattr(md, "_bytelode_method_types"):
        md._bytelode_method_types = kept(render_types(md, view(md, 6), "Signature", "method"), "signatures")
    return md._bytelode_method_types


def fields(md: DataFrame) -> DataFrame:
    """file_id, owner, rid, name, type, flags, and the raw constant if there is one."""
    defs, rows = view(md, 2), view(md, 4)
    types = render_types(md, rows, "Signature", "field").select("file_id", "rid", F.col("text").alias("type"))
    consts = view(md, 11).filter("Parent_table = 4").groupBy("file_id", F.col("Parent_rid").alias("rid")).agg(F.min_by("Value", "rid").alias("constant"))
    base = rows.select("file_id", "rid", F.col("Name").alias("name"), F.col("Flags").alias("flags"))
    return base.join(owned(defs, "FieldList", rows), ["file_id", "rid"]).join(types, ["file_id", "rid"]).join(consts, ["file_id", "rid"], "left")


def methods(md: DataFrame, named: str | None = None) -> DataFrame:
    """file_id, owner, rid, name, return_type, params (array of type texts), flags, code and its figures; only those ``named`` so, if given."""
    defs, every = view(md, 2), view(md, 6)
    rows = every.filter(F.col("Name") == named) if named else every
    sig = method_types(md).groupBy("file_id", "rid").agg(F.max(F.when(F.col("i") == 0, F.col("text"))).alias("return_type"), F.sort_array(F.collect_list(F.when(F.col("i") > 0, F.struct("i", "text"))))["text"].alias("params"))
    base = rows.select("file_id", "rid", F.col("Name").alias("name"), F.col("Flags").alias("flags"), "code", "max_stack")
    return base.join(owned(defs, "MethodList", every), ["file_id", "rid"]).join(sig, ["file_id", "rid"])


def generic_params(md: DataFrame) -> DataFrame:
    """Names of an owner's generic parameters by number."""
    names = F.sort_array(F.collect_list(F.struct("Number", "Name")))["Name"]
    return view(md, 42).groupBy("file_id", F.col("Owner_table").alias("table"), F.col("Owner_rid").alias("rid")).agg(names.alias("params"))


def interfaces(md: DataFrame) -> DataFrame:
    """Interfaces of each type, in row order; one without a name shows as ``?``."""
    known = type_names(md).select("file_id", F.col("table").alias("Interface_table"), F.col("rid").alias("Interface_rid"), F.col("name").alias("known"))
    named = view(md, 9).join(known, ["file_id", "Interface_table", "Interface_rid"], "left").withColumn("name", N.clean_generic(F.coalesce("known", F.lit("?"))))
    return named.groupBy("file_id", F.col("Class").cast("int").alias("rid")).agg(F.sort_array(F.collect_list(F.struct("rid", "name")))["name"].alias("interfaces"))


def base_types(md: DataFrame) -> DataFrame:
    """file_id, rid, base: the name of the type each type extends, if it extends one other than ``Object``."""
    known = type_names(md).select("file_id", F.col("table").alias("Extends_table"), F.col("rid").alias("Extends_rid"), "namespace", "name")
    rows = view(md, 2).filter(F.col("Extends_rid").isNotNull()).select("file_id", "rid", "Extends_table", "Extends_rid").join(known, ["file_id", "Extends_table", "Extends_rid"], "left")
    root = (F.col("namespace") == "System") & (F.col("name") == "Object")
    return rows.filter(~F.coalesce(root, F.lit(False))).select("file_id", "rid", N.clean_generic(F.coalesce("name", F.lit("?"))).alias("base"))


def parameters(md: DataFrame) -> DataFrame:
    """file_id, rid, params: each method's parameters as they stand in source, in order.

    Names, directions and defaults come from the parameter table by number; one without a row is ``argN``. A parameter of the last
    number that has the attribute of open argument lists is ``params``.
    """
    rows, defs = view(md, 8), view(md, 6)
    types = method_types(md).filter("i > 0")
    owner = owned(defs, "ParamList", rows)
    fixed = constants(md).filter("table = 8").select("file_id", "rid", "literal")
    many = custom_attributes(md).filter("Parent_table = 8").groupBy("file_id", F.col("Parent_rid").alias("rid")).agg(F.bool_or(F.col("attribute") == "System.ParamArrayAttribute").alias("many"))
    facts = rows.join(owner, ["file_id", "rid"]).join(fixed, ["file_id", "rid"], "left").join(many, ["file_id", "rid"], "left")
    facts = facts.select("file_id", F.col("owner").alias("rid"), F.col("Sequence").cast("int").alias("i"), F.col("Flags").alias("flags"), F.col("Name").alias("name"), "literal", "many")
    joined = types.join(facts, ["file_id", "rid", "i"], "left")
    out = (F.col("flags").bitwiseAND(3) == 2) & F.col("text").startswith("ref ")
    shown = F.concat(
        F.when(F.col("many"), "params ").otherwise(""), F.when(out, F.concat(F.lit("out "), F.substring("text", F.lit(5), F.length("text")))).otherwise(F.col("text")),
        F.lit(" "), F.coalesce(F.when(F.col("name") != "", F.col("name")), F.concat(F.lit("arg"), (F.col("i") - 1).cast("string"))),
        F.when(F.col("flags").bitwiseAND(0x1000) != 0, F.coalesce(F.concat(F.lit(" = "), "literal"), F.lit(""))).otherwise(""),
    )
    return joined.groupBy("file_id", "rid").agg(F.sort_array(F.collect_list(F.struct("i", shown.alias("p"))))["p"].alias("shown"))


def pinvokes(md: DataFrame) -> DataFrame:
    """Native functions behind methods: rid, import_name, library."""
    libs = view(md, 26).select("file_id", F.col("rid").cast("long").alias("ImportScope"), F.col("Name").alias("library"))
    return view(md, 28).filter("MemberForwarded_table = 6").join(libs, ["file_id", "ImportScope"]).select("file_id", F.col("MemberForwarded_rid").alias("rid"), F.col("ImportName").alias("import_name"), "library")


def properties(md: DataFrame) -> DataFrame:
    """Properties of types with the rows of their accessors; the last accessor of a kind counts."""
    maps, rows, sem = view(md, 21), view(md, 23), view(md, 24).filter("Association_table = 23")
    owner = owned(maps, "PropertyList", rows).join(maps.select("file_id", F.col("rid").alias("owner"), F.col("Parent").cast("int").alias("type_rid")), ["file_id", "owner"]).drop("owner")
    role = lambda bit: F.max_by(F.when(F.col("Semantics").bitwiseAND(bit) != 0, F.col("Method").cast("int")), F.when(F.col("Semantics").bitwiseAND(bit) != 0, F.col("rid")))
    access = sem.groupBy("file_id", "Association_rid").agg(role(2).alias("getter"), role(1).alias("setter")).withColumnRenamed("Association_rid", "rid")
    return rows.select("file_id", "rid", F.col("Name").alias("name")).join(owner, ["file_id", "rid"]).join(access, ["file_id", "rid"], "left")


def custom_attributes(md: DataFrame) -> DataFrame:
    """Attribute type names of entities: the constructor is a definition or a member reference, each with its own owner."""
    defs, meth, refs = view(md, 2), view(md, 6), view(md, 10)
    types = type_names(md).select("file_id", "table", F.col("rid").alias("t"), N.qualified(F.col("namespace"), F.col("name")).alias("attribute"))
    by_def = owned(defs, "MethodList", meth).select("file_id", F.lit(6).alias("ctor_table"), F.col("rid").alias("ctor"), F.lit(2).alias("table"), F.col("owner").alias("t"))
    by_ref = refs.select("file_id", F.lit(10).alias("ctor_table"), F.col("rid").alias("ctor"), F.col("Class_table").alias("table"), F.col("Class_rid").alias("t"))
    ctor = by_def.unionByName(by_ref).join(types, ["file_id", "table", "t"]).select("file_id", "ctor_table", "ctor", "attribute")
    rows = view(md, 12).select("file_id", "rid", "Parent_table", "Parent_rid", F.col("Type_table").alias("ctor_table"), F.col("Type_rid").alias("ctor"))
    return rows.join(ctor, ["file_id", "ctor_table", "ctor"]).select("file_id", "rid", "Parent_table", "Parent_rid", "attribute")


def external_namespaces(md: DataFrame, interop: str = "System.Runtime.InteropServices") -> DataFrame:
    """Distinct namespaces of referenced types, and the interop one where native functions are declared."""
    refs = view(md, 1).filter("Namespace <> ''").select("file_id", F.col("Namespace").alias("namespace"))
    native = view(md, 28).select("file_id", F.lit(interop).alias("namespace"))
    return refs.unionByName(native).distinct()


def json_model(md: DataFrame) -> DataFrame:
    """file_id, model: all types with fields and methods as JSON, in row order."""
    f = fields(md).groupBy("file_id", F.col("owner").alias("rid")).agg(F.sort_array(F.collect_list(F.struct("rid", "name", "type"))).alias("f"))
    m = methods(md).groupBy("file_id", F.col("owner").alias("rid")).agg(F.sort_array(F.collect_list(F.struct("rid", "name", F.col("return_type").alias("returnType"), "params"))).alias("m"))
    types = view(md, 2).filter(F.col("Name") != MODULE_TYPE).join(f, ["file_id", "rid"], "left").join(m, ["file_id", "rid"], "left")
    one = F.struct(
        "rid", F.col("Name").alias("name"), F.col("Namespace").alias("namespace"),
        F.coalesce(F.transform("f", lambda x: x.dropFields("rid")), F.array()).alias("fields"), F.coalesce(F.transform("m", lambda x: x.dropFields("rid")), F.array()).alias("methods"),
    )
    listed = F.transform(F.sort_array(F.collect_list(F.struct(F.col("rid").alias("o"), one.alias("t")))), lambda x: x["t"].dropFields("rid"))
    return types.groupBy("file_id").agg(F.to_json(F.struct(listed.alias("types"))).alias("model"))


def unprintable(name: Column) -> Column:
    """Names with a character that is no letter, digit, ASCII graphic or blank."""
    return name.rlike(r"[^\p{L}\p{N}\x20-\x7E]")


def method_instructions(md: DataFrame) -> DataFrame:
    return instructions(view(md, 6), ["file_id", "rid"], "cil")


def encrypted_string_calls(instr: DataFrame) -> DataFrame:
    """Callees that directly follow a string load: file_id, callee, n."""
    before = F.lag("name").over(W.partitionBy("file_id", "rid").orderBy("pos"))
    return instr.withColumn("before", before).filter("before = 'ldstr' and name in ('call', 'callvirt')").groupBy("file_id", F.col("ref").alias("callee")).agg(F.count("*").alias("n"))


def obfuscation(md: DataFrame) -> DataFrame:
    """file_id, ord, severity, category, message. Lengths are bytes; the summary comes last."""
    names = view(md, 2).filter(F.col("Name") != MODULE_TYPE).select("file_id", F.lit("type").alias("what"), "Name").unionByName(view(md, 6).select("file_id", F.lit("method").alias("what"), "Name"))
    counts = names.groupBy("file_id").agg(
        F.count_if(F.col("what") == "type").alias("types"), F.count_if(F.col("what") == "method").alias("methods"),
        F.count_if(unprintable(F.col("Name"))).alias("odd"), F.count_if(F.octet_length("Name") > 100).alias("long"),
    )
    instr = method_instructions(md)
    switches = instr.filter("name = 'switch'").groupBy("file_id", "rid").agg(F.min_by(F.size("targets"), "pos").alias("n")).groupBy("file_id").agg(F.max("n").alias("cases"))
    strings = encrypted_string_calls(instr).groupBy("file_id").agg(F.max("n").alias("calls"))
    all_ = counts.join(switches, "file_id", "left").join(strings, "file_id", "left")
    row = lambda o, sev, cat, msg: F.struct(F.lit(o).alias("ord"), sev.alias("severity"), F.lit(cat).alias("category"), msg.alias("message"))
    text = lambda *c: F.concat(*(x.cast("string") if isinstance(x, Column) else F.lit(x) for x in c))
    c = F.col
    found = F.array(
        row(1, F.when(c("odd") > 0, "high"), "names", text(c("odd"), " names with unprintable characters")),
        row(2, F.when(c("long") > 0, "medium"), "names", text(c("long"), " names over 100 bytes")),
        row(3, F.when(c("cases") > 50, "high").when(c("cases") > 20, "low"), "control-flow", text("a switch of ", c("cases"), " cases")),
        row(4, F.when(c("calls") > 10, "high"), "strings", text(c("calls"), " strings passed to one method")),
        row(5, F.lit("info"), "summary", text(c("types"), " types, ", c("methods"), " methods")),
    )
    return all_.select("file_id", F.inline(found)).filter("severity is not null")


def _quoted(text: Column) -> Column:
    """A string literal on one line."""
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return F.concat(F.lit('"'), text, F.lit('"'))


def token_names(md: DataFrame) -> DataFrame:
    """file_id, ref, text: what tokens show as: types, methods, fields, member references and strings."""
    types = type_names(md)
    key = lambda t: (F.lit(t).cast("long") * (1 << 24) + F.col("rid")).alias("ref")
    named = types.withColumn("text", N.clean_generic(N.qualified(F.col("namespace"), F.col("name"))))
    by_type = named.select("file_id", (F.col("table").cast("long") * (1 << 24) + F.col("rid")).alias("ref"), "text")
    defs, meth, fld, refs = view(md, 2), view(md, 6), view(md, 4), view(md, 10)
    owner = named.filter("table = 2").select("file_id", F.col("rid").alias("owner"), F.col("text").alias("o"))
    member = lambda rows, start, t: rows.select("file_id", "rid", "Name").join(owned(defs, start, rows), ["file_id", "rid"]).join(owner, ["file_id", "owner"]).select("file_id", key(t), F.concat_ws("::", "o", "Name").alias("text"))
    ref_owner = named.select("file_id", F.col("table").alias("Class_table"), F.col("rid").alias("Class_rid"), F.col("text").alias("o"))
    by_ref = refs.join(ref_owner, ["file_id", "Class_table", "Class_rid"], "left").select("file_id", key(10), F.concat_ws("::", F.coalesce("o", F.lit("?")), "Name").alias("text"))
    strings = md.filter(F.col("table") == USER_STRINGS).select("file_id", key(USER_STRINGS), _quoted(F.get("texts", F.lit(0))).alias("text"))
    out = by_type
    for part in (member(meth, "MethodList", 6), member(fld, "FieldList", 4), by_ref, strings):
        out = out.unionByName(part)
    return out


def disassemble(md: DataFrame) -> DataFrame:
    """file_id, rid, listing: each method with a body, its stack and locals, one line an instruction, tokens as names."""
    text = token_names(md)
    instr = method_instructions(md).join(text, ["file_id", "ref"], "left")
    label = lambda at: F.concat(F.lit("IL_"), F.lpad(F.lower(F.hex(at)), F.greatest(F.lit(4), F.length(F.hex(at))), F.lit("0")))
    jump = F.transform("targets", label)
    number = F.coalesce(F.col("whole").cast("string"), F.when(F.col("value") == F.floor("value"), F.col("value").cast("long").cast("string")).otherwise(F.col("value").cast("string")))
    operand = F.coalesce(F.when(F.size("targets") > 0, F.array_join(jump, ", ")), "text", F.col("ref").cast("string"), number, F.lit(""))
    line = F.rtrim(F.concat(F.lit("  "), label(F.col("offset")), F.lit(": "), "name", F.lit(" "), operand))
    body = instr.select("file_id", "rid", F.struct("pos", line.alias("line")).alias("l")).groupBy("file_id", "rid").agg(F.array_join(F.sort_array(F.collect_list("l"))["line"], "\n").alias("body"))
    m = methods(md)
    owner = type_names(md).filter("table = 2").select("file_id", F.col("rid").alias("owner"), F.col("name").alias("owner_name"))
    head = F.concat("return_type", F.lit(" "), "owner_name", F.lit("::"), "name", F.lit("("), F.array_join("params", ", "), F.lit(")\n"))
    stack = F.concat(F.lit("  .maxstack "), F.col("max_stack").cast("string"), F.lit("\n"))
    held = F.coalesce(F.concat(F.lit("  .locals init ("), F.array_join("locals", ", "), F.lit(")\n")), F.lit(""))
    whole = m.join(owner, ["file_id", "owner"]).join(body, ["file_id", "rid"]).join(local_types(md), ["file_id", "rid"], "left")
    return whole.select("file_id", "rid", F.concat(head, stack, held, "body").alias("listing"))


def il_units(md: DataFrame) -> DataFrame:
    """file_id, rid, file_name, source: each defined type's IL, a class head with what it extends and implements, its fields, and its methods.

    Nested types are units of their own, as every type is here. Methods without a body say so.
    """
    defs = view(md, 2).filter(F.col("Name") != MODULE_TYPE).select("file_id", "rid", "Name", "Namespace", "Flags")
    bit = lambda c, n, text: F.when(F.col(c).bitwiseAND(n) != 0, text).otherwise("")
    seen = F.when(F.col("Flags").bitwiseAND(7).isin(1, 2), "public ").otherwise("private ")
    above = F.coalesce(F.concat(F.lit(" extends "), "base"), F.lit(""))
    sides = F.coalesce(F.concat(F.lit(" implements "), F.array_join("interfaces", ", ")), F.lit(""))
    heads = defs.join(base_types(md), ["file_id", "rid"], "left").join(interfaces(md), ["file_id", "rid"], "left").join(_generic_lists(md, 2, "generic"), ["file_id", "rid"], "left")
    name = N.qualified(F.col("Namespace"), N.clean_generic(F.col("Name")))
    head = F.concat(F.lit(".class "), bit("Flags", 0x20, "interface "), seen, bit("Flags", 0x80, "abstract "), bit("Flags", 0x100, "sealed "), name, F.coalesce("generic", F.lit("")), above, sides, F.lit("\n{"))
    line = lambda rows, o, text: rows.select("file_id", F.col("owner").alias("rid"), F.struct(F.lit(o).alias("o"), F.col("rid").alias("m"), text.alias("text")).alias("l"))
    how = F.concat(_word(F.col("flags"), MEMBER_ACCESS, "private "), bit("flags", 0x10, "static "), bit("flags", 0x20, "initonly "), bit("flags", 0x40, "literal "))
    lines = line(fields(md), 1, F.concat(F.lit("  .field "), how, "type", F.lit(" "), "name"))
    owner = type_names(md).filter("table = 2").select("file_id", F.col("rid").alias("owner"), F.col("name").alias("owner_name"))
    bare = F.concat("return_type", F.lit(" "), "owner_name", F.lit("::"), "name", F.lit("("), F.array_join("params", ", "), F.lit(")\n  // no body"))
    shown = methods(md).join(owner, ["file_id", "owner"]).join(disassemble(md), ["file_id", "rid"], "left").withColumn("text", F.concat(F.lit(".method "), F.coalesce("listing", bare)))
    lines = lines.unionByName(line(shown, 2, F.regexp_replace("text", "(?m)^", "  ")))
    body = lines.groupBy("file_id", "rid").agg(F.array_join(F.sort_array(F.collect_list("l"))["text"], "\n").alias("body"))
    return heads.join(body, ["file_id", "rid"], "left").select(
        "file_id", "rid", N.file_name(F.col("Namespace"), F.col("Name"), ".il").alias("file_name"), F.concat(head, F.lit("\n"), F.coalesce(F.concat("body", F.lit("\n")), F.lit("")), F.lit("}\n")).alias("source")
    )


def _wanted_names(md: DataFrame) -> DataFrame:
    """file_id, category, name a source should hold: not accessors, constructors, delegate methods, dotted names and compiler fields."""
    skip = F.col("name").rlike(r"^(get_|set_|add_|remove_)|^(Invoke|BeginInvoke|EndInvoke|value__)$|\.|k__BackingField")
    one = lambda t, what: view(md, t).select("file_id", F.lit(what).alias("category"), N.clean_generic(F.col("Name")).alias("name"))
    return one(2, "type").unionByName(one(6, "method")).unionByName(one(4, "field")).filter((F.col("name") != MODULE_TYPE) & ~skip).distinct()


def verify(md: DataFrame, sources: DataFrame, exact: bool = False) -> DataFrame:
    """Names of types, methods and fields that ``sources`` (file_id, source) don't hold: file_id, category, name.

    Loose, a name counts as present if it is anywhere in the file's text; ``exact``, if it is one of the text's words.
    """
    wanted = _wanted_names(md)
    if exact:
        words = sources.select("file_id", F.explode(F.array_distinct(F.regexp_extract_all("source", F.lit(r"(?U)([\w$]+)"), F.lit(1)))).alias("name"))
        return wanted.join(words, ["file_id", "name"], "left_anti")
    # a row a file: its text is searched once for all its names
    texts = sources.groupBy("file_id").agg(F.array_join(F.collect_list("source"), "\n").alias("source"))
    names = wanted.groupBy("file_id").agg(F.collect_set("name").alias("names"))
    missing = names.join(texts, "file_id", "left").select("file_id", F.explode(names_missing_in(F.col("source"), F.col("names"))).alias("name"))
    return wanted.join(missing, ["file_id", "name"]).select("file_id", "category", "name")


def verify_summary(md: DataFrame, sources: DataFrame, exact: bool = False) -> DataFrame:
    """file_id, n_types, n_methods, n_fields that were looked for, and n_missing."""
    n = lambda what: F.count_if(F.col("category") == what).alias(f"n_{what}s")
    missing = verify(md, sources, exact).groupBy("file_id").agg(F.count("*").alias("n_missing"))
    return _wanted_names(md).groupBy("file_id").agg(n("type"), n("method"), n("field")).join(missing, "file_id", "left").fillna(0, "n_missing")


def events(md: DataFrame) -> DataFrame:
    """Events of types with the rows of their accessors; the last accessor of a kind counts."""
    maps, rows, sem = view(md, 18), view(md, 20), view(md, 24).filter("Association_table = 20")
    owner = owned(maps, "EventList", rows).join(maps.select("file_id", F.col("rid").alias("owner"), F.col("Parent").cast("int").alias("type_rid")), ["file_id", "owner"]).drop("owner")
    role = lambda bit: F.max_by(F.when(F.col("Semantics").bitwiseAND(bit) != 0, F.col("Method").cast("int")), F.when(F.col("Semantics").bitwiseAND(bit) != 0, F.col("rid")))
    access = sem.groupBy("file_id", "Association_rid").agg(role(8).alias("adder"), role(16).alias("remover")).withColumnRenamed("Association_rid", "rid")
    known = type_names(md).select("file_id", F.col("table").alias("EventType_table"), F.col("rid").alias("EventType_rid"), N.clean_generic(F.col("name")).alias("type"))
    return rows.join(owner, ["file_id", "rid"]).join(access, ["file_id", "rid"], "left").join(known, ["file_id", "EventType_table", "EventType_rid"], "left").select("file_id", "rid", F.col("Name").alias("name"), "type", "type_rid", "adder", "remover")


def explicit_implementations(md: DataFrame) -> DataFrame:
    """Methods that implement another type's method under its name: file_id, rid, interface, name."""
    defs, meth, refs = view(md, 2), view(md, 6), view(md, 10)
    types = type_names(md).select("file_id", F.col("table").alias("t_table"), F.col("rid").alias("t_rid"), F.col("name").alias("interface"))
    by_def = owned(defs, "MethodList", meth).join(meth.select("file_id", "rid", "Name"), ["file_id", "rid"]).select("file_id", F.lit(6).alias("d_table"), F.col("rid").alias("d_rid"), "Name", F.lit(2).alias("t_table"), F.col("owner").alias("t_rid"))
    by_ref = refs.select("file_id", F.lit(10).alias("d_table"), F.col("rid").alias("d_rid"), "Name", F.col("Class_table").alias("t_table"), F.col("Class_rid").alias("t_rid"))
    declared = by_def.unionByName(by_ref).join(types, ["file_id", "t_table", "t_rid"])
    rows = view(md, 25).filter("MethodBody_table = 6").select("file_id", F.col("MethodBody_rid").alias("rid"), F.col("MethodDeclaration_table").alias("d_table"), F.col("MethodDeclaration_rid").alias("d_rid"))
    return rows.join(declared, ["file_id", "d_table", "d_rid"]).select("file_id", "rid", "interface", F.col("Name").alias("name"))


def source_fields(md: DataFrame) -> DataFrame:
    """Fields a source listing shows: no backing fields, none named like an event of the type."""
    shown = fields(md).filter(~F.col("name").endswith("k__BackingField"))
    return shown.join(events(md).select("file_id", F.col("type_rid").alias("owner"), "name"), ["file_id", "owner", "name"], "left_anti")


def source_methods(md: DataFrame) -> DataFrame:
    """Methods a source listing shows: no accessors of properties and events."""
    roles = view(md, 24).select("file_id", F.col("Method").cast("int").alias("rid")).distinct()
    return methods(md).join(roles, ["file_id", "rid"], "left_anti")


def nested_paths(md: DataFrame) -> DataFrame:
    """file_id, rid, top, rids, ring: of every defined type its outermost type, and the rows below that one down to its own, outer ones first.

    Parents are followed by doubling, so a chain of n levels takes log2(n) rounds, each written before the next. In a damaged file types may lie in a
    ring: once a type's path meets a row again, it leaves the rounds with ``ring`` true and neither top nor rows.
    """
    step = kept(nested_in(md).select("file_id", "rid", F.col("parent").alias("top"), F.array("rid").alias("rids"), F.lit(False).alias("ring"), F.lit(True).alias("moved")), "nested")
    while not step.filter("moved").isEmpty():
        up = step.select("file_id", F.col("rid").alias("top"), F.col("top").alias("above"), F.col("rids").alias("more"), F.col("ring").alias("into"))
        joined = step.join(up, ["file_id", "top"], "left")
        rids = F.concat(F.coalesce("more", F.array().cast("array<int>")), "rids")
        ring = F.col("ring") | F.coalesce("into", F.lit(False)) | (F.size(F.array_distinct(rids)) < F.size(rids))
        after = joined.select("file_id", "rid", F.when(~ring, F.coalesce("above", "top")).alias("top"), F.when(ring, F.array().cast("array<int>")).otherwise(rids).alias("rids"), ring.alias("ring"), (F.col("above").isNotNull() & ~ring).alias("moved"))
        after = kept(after, "nested")
        drop(step)
        step = after
    own = view(md, 2).select("file_id", "rid").join(step.drop("moved"), ["file_id", "rid"], "left").withColumn("ring", F.coalesce("ring", F.lit(False)))
    return own.select("file_id", "rid", F.when(~F.col("ring"), F.coalesce("top", "rid")).alias("top"), F.coalesce("rids", F.array().cast("array<int>")).alias("rids"), "ring")


def property_types(md: DataFrame) -> DataFrame:
    """file_id, rid, type of each property."""
    return render_types(md, view(md, 23), "Type", "property").select("file_id", "rid", F.col("text").alias("type"))


#: Fixed values (ECMA-335 II.23.1): the access bits of members and of nested types to C# words.
MEMBER_ACCESS = {6: "public ", 5: "protected internal ", 4: "protected ", 3: "internal ", 2: "private protected "}
NESTED_ACCESS = {2: "public ", 4: "protected ", 5: "internal ", 6: "private protected ", 7: "protected internal "}


def _word(flags: Column, words: dict[int, str], other: str) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in words.items() for x in pair))[flags.bitwiseAND(7).cast("int")], F.lit(other))


def _generic_lists(md: DataFrame, table: int, name: str) -> DataFrame:
    return generic_params(md).filter(F.col("table") == table).select("file_id", "rid", F.concat(F.lit("<"), F.array_join("params", ", "), F.lit(">")).alias(name), F.col("params").alias(f"{name}_names"))


def _member_lines(md: DataFrame, types: DataFrame) -> DataFrame:
    """file_id, owner, o, m, table, text: a declaration for each field, property, event and method a listing shows.

    ``types`` has file_id, owner, kind, type_name and type_params, the names of the type's generic parameters.
    """
    set_ = lambda bit: F.col("flags").bitwiseAND(bit) != 0
    word = lambda bit, text: F.when(set_(bit), text).otherwise("")
    access = _word(F.col("flags"), MEMBER_ACCESS, "private ")
    literal = constants(md)
    line = lambda rows, o, table, text: rows.select("file_id", "owner", F.lit(o).alias("o"), F.col("rid").alias("m"), F.lit(table).alias("table"), text.alias("text"))
    own = lambda c: in_context(F.col(c), F.col("type_params"))

    value = literal.filter("table = 4").select("file_id", "rid", "literal")
    f = source_fields(md).join(value, ["file_id", "rid"], "left").join(types, ["file_id", "owner"])
    # an enum's instance field holds its value and isn't written
    f = f.filter((F.col("kind") != "enum") | set_(0x10))
    how = F.when(set_(0x40), "const ").otherwise(F.concat(word(0x10, "static "), word(0x20, "readonly ")))
    fixed = F.coalesce(F.concat(F.lit(" = "), "literal"), F.lit(""))
    f_text = F.when(F.col("kind") == "enum", F.concat("name", fixed, F.lit(","))).otherwise(F.concat(access, how, own("type"), F.lit(" "), "name", fixed, F.lit(";")))

    m0 = view(md, 6).select("file_id", "rid", F.col("Flags").alias("flags"))
    by = lambda rows, *c: rows.withColumn("own", F.coalesce(*c)).join(m0.withColumnRenamed("rid", "own"), ["file_id", "own"], "left").withColumnRenamed("type_rid", "owner").join(types, ["file_id", "owner"])
    p = by(properties(md).join(property_types(md), ["file_id", "rid"]), "getter", "setter")
    half = lambda c, text: F.when(F.col(c).isNotNull(), text).otherwise("")
    p_text = F.concat(access, word(0x10, "static "), own("type"), F.lit(" "), "name", F.lit(" { "), half("getter", "get; "), half("setter", "set; "), F.lit("}"))
    e = by(events(md), "adder", "remover")
    e_text = F.concat(access, word(0x10, "static "), F.lit("event "), F.coalesce(own("type"), F.lit("?")), F.lit(" "), "name", F.lit(";"))

    native = pinvokes(md).select("file_id", "rid", F.format_string('[DllImport("%s", EntryPoint = "%s")] ', "library", "import_name").alias("native"))
    m = source_methods(md).join(types, ["file_id", "owner"]).join(native, ["file_id", "rid"], "left").join(_generic_lists(md, 6, "generic"), ["file_id", "rid"], "left").join(parameters(md), ["file_id", "rid"], "left")
    m = m.filter("kind <> 'delegate'")
    both = lambda c: in_context(c, F.col("type_params"), F.col("generic_names"))
    args = F.concat(F.lit("("), both(F.array_join(F.coalesce("shown", F.array().cast("array<string>")), ", ")), F.lit(");"))
    explicit = F.col("name").contains(".") & ~F.col("name").startswith(".")
    virtual = F.when(set_(0x440) & (F.col("flags").bitwiseAND(0x440) == 0x40) & (F.col("kind") != "interface"), F.when(set_(0x100), "virtual ").otherwise("override ")).otherwise("")
    how = F.concat(word(0x10, "static "), F.when(set_(0x400) & (F.col("kind") != "interface"), "abstract ").otherwise(""), virtual, F.when(F.col("native").isNotNull(), "extern ").otherwise(""))
    m_text = (
        F.when(F.col("name") == ".cctor", F.concat(F.lit("static "), "type_name", F.lit("();"))).when(F.col("name") == ".ctor", F.concat(access, "type_name", args))
        .otherwise(F.concat(F.coalesce("native", F.lit("")), F.when(explicit, "").otherwise(F.concat(access, how)), both(F.col("return_type")), F.lit(" "), "name", F.coalesce("generic", F.lit("")), args))
    )
    return line(f, 1, 4, f_text).unionByName(line(p, 2, 23, p_text)).unionByName(line(e, 3, 20, e_text)).unionByName(line(m, 4, 6, m_text))


def declarations(md: DataFrame) -> DataFrame:
    """file_id, rid, file_name, source, error: each top-level type's declaration with its members and nested types, bodies left out.

    Every line has a key of row numbers, by which the lines of a top-level type are sorted: a nested type's key starts with its
    outer type's. A file whose nested types form a ring has a row with ``error`` instead of these types; all others are written.
    """
    kind = kinds(md).select("file_id", F.col("rid").alias("owner"), "kind", "is_static")
    names_ = view(md, 2).filter(F.col("Name") != MODULE_TYPE).select("file_id", F.col("rid").alias("owner"), "Name", "Namespace", "Flags", N.clean_generic(F.col("Name")).alias("type_name"))
    reached = nested_paths(md).withColumnRenamed("rid", "owner")
    paths = reached.filter(~F.col("ring")).drop("ring")
    types = names_.join(kind, ["file_id", "owner"]).join(paths, ["file_id", "owner"])
    prefix = F.flatten(F.transform("rids", lambda r: F.array(F.lit(3), r)))
    key = lambda *more: F.concat(prefix, F.array(*(F.lit(x) if isinstance(x, int) else x for x in more)))
    depth = lambda more: F.repeat(F.lit("    "), F.size("rids") + more)
    line = lambda rows, k, text: rows.select("file_id", F.col("top").alias("rid"), F.struct(k.alias("k"), text.alias("text")).alias("l"))

    invoked = methods(md, "Invoke").join(parameters(md), ["file_id", "rid"], "left")
    signature = invoked.groupBy("file_id", "owner").agg(F.min_by(F.struct("return_type", F.coalesce("shown", F.array().cast("array<string>")).alias("params")), "rid").alias("invoke"))
    stored = view(md, 4).filter("Name = 'value__'")
    value = render_types(md, stored, "Signature", "field").join(owned(view(md, 2), "FieldList", view(md, 4)), ["file_id", "rid"]).groupBy("file_id", "owner").agg(F.min("text").alias("stored"))
    of_type = lambda rows: rows.withColumnRenamed("rid", "owner")
    heads = (
        types.join(of_type(interfaces(md)), ["file_id", "owner"], "left").join(of_type(_generic_lists(md, 2, "generic")), ["file_id", "owner"], "left").join(of_type(base_types(md)), ["file_id", "owner"], "left")
        .join(signature, ["file_id", "owner"], "left").join(value, ["file_id", "owner"], "left")
    )
    access = F.when(F.size("rids") > 0, _word(F.col("Flags"), NESTED_ACCESS, "private ")).otherwise(F.when(F.col("Flags").bitwiseAND(7) == 1, "public ").otherwise("internal "))
    named = F.concat("type_name", F.coalesce("generic", F.lit("")))
    extended = F.when((F.col("kind") == "class") & F.col("base").isNotNull(), F.array("base")).when(F.col("kind") == "enum", F.array(F.coalesce("stored", F.lit("int")))).otherwise(F.array().cast("array<string>"))
    above = F.concat(extended, F.coalesce("interfaces", F.array().cast("array<string>")))
    bases = F.when(F.size(above) > 0, F.concat(F.lit(" : "), in_context(F.array_join(above, ", "), F.col("generic_names")))).otherwise("")
    flag = lambda bit, text, *but: F.when((F.col("Flags").bitwiseAND(bit) != 0) & ~F.col("kind").isin(*but) & ~F.col("is_static"), text).otherwise("")
    how = F.concat(F.when(F.col("is_static"), "static ").otherwise(""), flag(0x80, "abstract ", "interface", "struct", "enum", "delegate"), flag(0x100, "sealed ", "interface", "struct", "enum", "delegate"))
    delegate = F.col("kind") == "delegate"
    head = F.when(delegate & F.col("invoke").isNotNull(), F.concat(access, F.lit("delegate "), in_context(F.col("invoke.return_type"), F.col("generic_names")), F.lit(" "), named, F.lit("("), in_context(F.array_join("invoke.params", ", "), F.col("generic_names")), F.lit(");"))).otherwise(
        F.concat(access, how, "kind", F.lit(" "), named, bases, F.lit("\n"), depth(0), F.lit("{"))
    )
    spaces = heads.filter((F.size("rids") == 0) & (F.col("Namespace") != ""))
    lines = line(spaces, key(-1), F.concat(F.lit("namespace "), "Namespace", F.lit(";\n")))
    lines = lines.unionByName(line(heads, key(0, 1), F.concat(depth(0), head)))
    lines = lines.unionByName(line(heads.filter(~(delegate & F.col("invoke").isNotNull())), key(4), F.concat(depth(0), F.lit("}"))))
    members = _member_lines(md, heads.select("file_id", "owner", "kind", "type_name", F.col("generic_names").alias("type_params")))
    tagged = attribute_lines(md).groupBy("file_id", F.col("Parent_table").alias("table"), F.col("Parent_rid").alias("m")).agg(F.array_join(F.sort_array(F.collect_list(F.struct("rid", "line")))["line"], " ").alias("tags"))
    placed = members.join(types.select("file_id", "owner", "top", "rids"), ["file_id", "owner"]).join(tagged, ["file_id", "table", "m"], "left")
    lines = lines.unionByName(line(placed, key(1, F.col("o"), F.col("m")), F.concat(depth(1), F.coalesce(F.concat("tags", F.lit(" ")), F.lit("")), "text")))
    of_types = types.join(tagged.filter("table = 2").select("file_id", F.col("m").alias("owner"), "tags"), ["file_id", "owner"])
    lines = lines.unionByName(line(of_types, key(0, 0), F.concat(depth(0), "tags")))
    text = lines.groupBy("file_id", "rid").agg(F.concat(F.array_join(F.sort_array(F.collect_list("l"))["text"], "\n"), F.lit("\n")).alias("source"))
    tops = names_.withColumnRenamed("owner", "rid")
    written = tops.join(text, ["file_id", "rid"]).select("file_id", "rid", N.file_name(F.col("Namespace"), F.col("Name"), ".cs").alias("file_name"), "source", F.lit(None).cast("string").alias("error"))
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    rings = reached.filter("ring").select("file_id").distinct().select("file_id", none("int", "rid"), none("string", "file_name"), none("string", "source"), F.lit("nested types form a ring").alias("error"))
    return written.unionByName(rings)


def constants(md: DataFrame) -> DataFrame:
    """Literals of fields, parameters and properties: file_id, table, rid, literal; the first row of an owner counts."""
    first = view(md, 11).groupBy("file_id", F.col("Parent_table").alias("table"), F.col("Parent_rid").alias("rid")).agg(F.min_by(F.struct("Type", "Value"), "rid").alias("c"))
    return first.select("file_id", "table", "rid", constant_literal(F.col("c.Type"), F.col("c.Value")).alias("literal"))


def attribute_lines(md: DataFrame) -> DataFrame:
    """Attributes as they stand in source: file_id, rid, Parent_table, Parent_rid, line. Unread arguments are left out."""
    defs, refs = view(md, 6), view(md, 10)
    ctor = lambda rows, t: rows.select("file_id", F.lit(t).alias("Type_table"), F.col("rid").alias("Type_rid"), "Signature")
    rows = view(md, 12).join(ctor(defs, 6).unionByName(ctor(refs, 10)), ["file_id", "Type_table", "Type_rid"])
    names = custom_attributes(md).withColumn("short", F.regexp_replace(N.simple_name(F.col("attribute")), "Attribute$", ""))
    named = rows.select("file_id", "rid", "Parent_table", "Parent_rid", argument_literals(F.col("Value"), F.col("Signature")).alias("args"))
    keyed = names.select("file_id", F.col("rid"), "short")
    args = F.when(F.size(F.coalesce("args", F.array())) > 0, F.concat(F.lit("("), F.array_join("args", ", "), F.lit(")"))).otherwise("")
    return named.join(keyed, ["file_id", "rid"]).select("file_id", "rid", "Parent_table", "Parent_rid", F.concat(F.lit("["), "short", args, F.lit("]")).alias("line"))


def local_types(md: DataFrame) -> DataFrame:
    """Types of each method's local variables, in order: file_id, rid, locals."""
    sigs = view(md, 17)
    text = render_types(md, sigs, "Signature", "locals").groupBy("file_id", F.col("rid").alias("sig")).agg(F.sort_array(F.collect_list(F.struct("i", "text")))["text"].alias("locals"))
    rows = view(md, 6).filter(F.coalesce("local_token", F.lit(0)) != 0).select("file_id", "rid", F.col("local_token").bitwiseAND(0xFFFFFF).cast("int").alias("sig"))
    return rows.join(text, ["file_id", "sig"]).select("file_id", "rid", "locals")


def accessors(md: DataFrame) -> DataFrame:
    """Tokens that are calls of a property: file_id, ref, property, role.

    A token is the accessor's own row, or a reference to a member of that name on the type that defines it.
    """
    p = properties(md)
    one = lambda c, role: p.filter(F.col(c).isNotNull()).select("file_id", F.col(c).alias("rid"), F.col("name").alias("property"), F.col("type_rid"), F.lit(role).alias("role"))
    own = one("getter", "get").unionByName(one("setter", "set"))
    direct = own.select("file_id", (F.lit(6 << 24).cast("long") + F.col("rid")).alias("ref"), "property", "role")
    named = own.join(view(md, 6).select("file_id", "rid", "Name"), ["file_id", "rid"]).select("file_id", F.lit(2).alias("Class_table"), F.col("type_rid").alias("Class_rid"), "Name", "property", "role")
    refs = view(md, 10).join(named, ["file_id", "Class_table", "Class_rid", "Name"])
    return direct.unionByName(refs.select("file_id", (F.lit(10 << 24).cast("long") + F.col("rid")).alias("ref"), "property", "role"))
