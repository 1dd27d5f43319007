"""DuckDB SQL for the queries of ``generics``."""

_PARTS = """
WITH p AS (SELECT p_brand || '@' || (p_partkey // 512) AS file_id, p_partkey AS k, p_size AS size, p_brand AS brand, p_size % 3 = 0 AS generic FROM part)
"""

SQL = {
    "pe_type_specs": _PARTS
    + """
, s(rid, name) AS (VALUES (1, 'IEnumerable<string>'), (2, 'List<int>'), (3, 'Dictionary<string, List<int>[]>'), (4, 'List<int>[]'), (5, 'IComparable<!0>'))
SELECT file_id, rid::BIGINT AS rid, name FROM (SELECT DISTINCT file_id FROM p), s""",
    "pe_generic_bases": _PARTS
    + """
SELECT file_id, 'Part' || k || CASE WHEN generic THEN '`1' ELSE '' END AS type_name, CASE size % 4 WHEN 1 THEN 'Root' WHEN 2 THEN 'List<int>' WHEN 3 THEN 'Component' END AS base,
  nullif(concat_ws(',', CASE WHEN size % 2 = 0 THEN 'IEnumerable<string>' END, CASE WHEN generic THEN 'IComparable<!0>' END), '') AS interfaces FROM p""",
    "pe_generic_calls": _PARTS
    + """
SELECT file_id, 'Fill' || k AS caller, 2::BIGINT AS pos, 'List<int>::Add' AS callee FROM p UNION ALL SELECT file_id, 'Fill' || k, 4, 'Dictionary<string, List<int>[]>::Clear' FROM p""",
    "pe_part_sources": _PARTS
    + """
SELECT file_id, 'Parts_Part' || k || CASE WHEN generic THEN '_1' ELSE '' END || '.cs' AS file_name, concat_ws(chr(10), 'namespace Parts;', '',
  'public ' || CASE size % 5 WHEN 0 THEN 'abstract ' WHEN 1 THEN 'sealed ' ELSE '' END || 'class Part' || k || CASE WHEN generic THEN '<T' || k || '>' ELSE '' END
  || coalesce(' : ' || nullif(concat_ws(', ', CASE size % 4 WHEN 1 THEN 'Root' WHEN 2 THEN 'List<int>' WHEN 3 THEN 'Component' END,
    CASE WHEN size % 2 = 0 THEN 'IEnumerable<string>' END, CASE WHEN generic THEN 'IComparable<T' || k || '>' END), ''), ''), '{',
  '    public ' || CASE WHEN generic THEN 'T' || k ELSE 'string' END || ' Item;', '    public Dictionary<string, List<int>[]> Map;',
  '    public void Fill' || k || '(int count, ref int total, out string note);',
  '    public ' || CASE WHEN size % 2 = 1 THEN 'override' ELSE 'virtual' END || ' string Say' || k || '(' || CASE WHEN generic THEN 'T' || k ELSE 'int' END || ' first, params string[] rest);',
  '    public static void Tell' || k || '(string text = "' || brand || '", int arg1);', '}', '') AS source FROM p
UNION ALL SELECT file_id, 'Parts_Kind' || k || '.cs', concat_ws(chr(10), 'namespace Parts;', '', 'public enum Kind' || k || ' : ' || CASE WHEN size % 2 = 1 THEN 'byte' ELSE 'short' END, '{',
  '    None = 0,', '    Some = ' || size || ',', '}', '') FROM p WHERE size % 7 = 0
UNION ALL SELECT DISTINCT file_id, 'Parts_Root.cs', concat_ws(chr(10), 'namespace Parts;', '', 'public abstract class Root', '{', '}', '') FROM p""",
    "pe_il_units": _PARTS
    + """
, n AS (SELECT *, 'Part' || k || CASE WHEN generic THEN '`1' ELSE '' END AS name, CASE WHEN generic THEN '!0' ELSE 'string' END AS item FROM p)
SELECT file_id, 'Parts_Part' || k || CASE WHEN generic THEN '_1' ELSE '' END || '.il' AS file_name, concat_ws(chr(10),
  '.class public ' || CASE size % 5 WHEN 0 THEN 'abstract ' WHEN 1 THEN 'sealed ' ELSE '' END || 'Parts.Part' || k || CASE WHEN generic THEN '<T' || k || '>' ELSE '' END
  || CASE size % 4 WHEN 1 THEN ' extends Root' WHEN 2 THEN ' extends List<int>' WHEN 3 THEN ' extends Component' ELSE '' END
  || coalesce(' implements ' || nullif(concat_ws(', ', CASE WHEN size % 2 = 0 THEN 'IEnumerable<string>' END, CASE WHEN generic THEN 'IComparable<!0>' END), ''), ''), '{',
  '  .field public ' || item || ' Item', '  .field public Dictionary<string, List<int>[]> Map',
  '  .method void ' || name || '::Fill' || k || '(int, ref int, ref string)', '    .maxstack 8', '    IL_0000: ldnull', '    IL_0001: ldc.i4.0', '    IL_0002: callvirt List<int>::Add', '    IL_0007: ldnull',
  '    IL_0008: callvirt Dictionary<string, List<int>[]>::Clear', '    IL_000d: ret',
  '  .method string ' || name || '::Say' || k || '(' || CASE WHEN generic THEN '!0' ELSE 'int' END || ', string[])', '    .maxstack 8', '    IL_0000: ldnull', '    IL_0001: ret',
  '  .method void ' || name || '::Tell' || k || '(string, int)', '    .maxstack 8', '    IL_0000: ret', '}', '') AS source FROM n
UNION ALL SELECT file_id, 'Parts_Kind' || k || '.il', concat_ws(chr(10), '.class public sealed Parts.Kind' || k || ' extends Enum', '{',
  '  .field public ' || CASE WHEN size % 2 = 1 THEN 'byte' ELSE 'short' END || ' value__', '  .field public static literal int None', '  .field public static literal int Some', '}', '') FROM p WHERE size % 7 = 0
UNION ALL SELECT DISTINCT file_id, 'Parts_Root.il', concat_ws(chr(10), '.class public abstract Parts.Root', '{', '}', '') FROM p""",
}
