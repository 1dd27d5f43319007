"""DuckDB SQL for the queries of ``binaries``, from the tables the binaries were made of."""

_PART = """
WITH p AS (SELECT *, 'part.' || replace(p_brand, '#', '_') || CASE WHEN p_partkey // 4096 > 0 THEN '.' || (p_partkey // 4096) ELSE '' END AS class_name FROM part)
"""
_NET = """
WITH n0 AS (SELECT *, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS first_key, replace(n_name, ' ', '_') AS nm FROM nation JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT DISTINCT n_regionkey, c_custkey // 4096 AS chunk FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION SELECT DISTINCT n_regionkey, s_suppkey // 4096 FROM supplier JOIN nation ON s_nationkey = n_nationkey),
n AS (SELECT n_nationkey, chunk, r_name || '#' || chunk AS file_id, nm, n_nationkey % 5 = 4 AND n_nationkey <> first_key AS nested,
        (SELECT m.nm FROM n0 m WHERE m.n_nationkey = n0.first_key) AS parent, (first_key) AS parent_key, replace(r_name, ' ', '_') AS ns0 FROM n0 JOIN f USING (n_regionkey)),
t AS (SELECT *, CASE WHEN nested THEN '' ELSE ns0 END AS ns, CASE WHEN nested THEN nm ELSE ns0 || '.' || nm END AS full_name FROM n),
c AS (SELECT t.*, c_custkey AS k, c_mktsegment AS seg, min(c_custkey) OVER (PARTITION BY file_id, n_nationkey) AS first_k
  FROM customer JOIN t ON c_nationkey = n_nationkey AND c_custkey // 4096 = chunk),
s AS (SELECT t.*, s_suppkey AS k FROM supplier JOIN t ON s_nationkey = n_nationkey AND s_suppkey // 4096 = chunk)
"""

SQL = {
    "jvm_list": _PART + "SELECT class_name, count(*) AS n_fields, count(*) AS n_methods FROM p GROUP BY class_name",
    "jvm_filter": _PART
    + "SELECT DISTINCT class_name AS name, 'part' AS package FROM p WHERE class_name IN ('part.Brand_11', 'part.Brand_12')",
    "jvm_members": _PART
    + """
SELECT class_name, 'field' AS kind, 'f' || p_partkey AS name, CASE WHEN p_size % 2 = 0 THEN 'int' ELSE 'java.lang.String' END AS type, CAST(NULL AS VARCHAR) AS params,
  'public static final' || CASE WHEN p_size % 10 = 0 THEN ' synthetic' ELSE '' END AS modifiers, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) END AS constant FROM p
UNION ALL
SELECT class_name, 'method', 'm' || p_partkey, ['int', 'void', 'java.util.List'][p_size % 3 + 1], ['int,long', 'java.lang.String[],double[][]', ''][p_size % 3 + 1],
  ['public', 'public static bridge', 'public final'][p_size % 3 + 1], NULL FROM p""",
    "jvm_source_members": _PART
    + """
SELECT class_name, 'field' AS kind, count(*) AS n FROM p WHERE p_size % 10 <> 0 GROUP BY class_name
UNION ALL SELECT class_name, 'method', count(*) FROM p WHERE p_size % 3 <> 1 GROUP BY class_name""",
    "jvm_opcode_counts": _PART
    + """
, i AS (SELECT class_name, unnest([['iload_1', 'ifeq', 'sipush', 'ireturn', 'iconst_0', 'ireturn'], ['getstatic', 'pop', 'return'], ['aconst_null', 'areturn']][p_size % 3 + 1]) AS name FROM p)
SELECT class_name, name, count(*) AS n FROM i GROUP BY class_name, name""",
    "jvm_references": _PART
    + """
SELECT 'part/' || replace(p_brand, '#', '_') || CASE WHEN p_partkey // 4096 > 0 THEN '$' || (p_partkey // 4096) ELSE '' END || '.f' || p_partkey || ':' ||
  CASE WHEN p_size % 2 = 0 THEN 'I' ELSE 'Ljava/lang/String;' END AS operand FROM p WHERE p_size % 3 = 1""",
    "jvm_branches": _PART + "SELECT class_name, 8 AS target, count(*) AS n FROM p WHERE p_size % 3 = 0 GROUP BY class_name",
    "jvm_handlers": _PART + "SELECT 'm' || p_partkey AS name, 0 AS start, 8 AS handler, 10 AS handler_stop FROM p WHERE p_size % 6 = 0",
    "jvm_listing": _PART
    + """
SELECT 'm' || p_partkey AS name, class_name || '.m' || p_partkey || [
  '(int, long) -> int' || chr(10) || '  flags: public' || chr(10) || '  stack=2, locals=4, args=4' || chr(10) || '     0: iload_1' || chr(10) || '     1: ifeq 8' || chr(10) || '     4: sipush ' || p_size || chr(10)
    || '     7: ireturn' || chr(10) || '     8: iconst_0' || chr(10) || '     9: ireturn'
    || CASE WHEN p_size % 2 = 0 THEN chr(10) || '  Exception table:' || chr(10) || '    [0, 8) -> 8 any' || chr(10) || '    [0, 4) -> 8 any' ELSE '' END,
  '(java.lang.String[], double[][]) -> void' || chr(10) || '  flags: public static bridge' || chr(10) || '  stack=1, locals=2, args=2' || chr(10) || '     0: getstatic part/' || replace(p_brand, '#', '_')
    || CASE WHEN p_partkey // 4096 > 0 THEN '$' || (p_partkey // 4096) ELSE '' END || '.f' || p_partkey || ':' || CASE WHEN p_size % 2 = 0 THEN 'I' ELSE 'Ljava/lang/String;' END || chr(10)
    || '     3: pop' || chr(10) || '     4: return',
  '() -> java.util.List' || chr(10) || '  flags: public final' || chr(10) || '  stack=1, locals=1, args=1' || chr(10) || '     0: aconst_null' || chr(10) || '     1: areturn'][p_size % 3 + 1] AS listing FROM p""",
    "jvm_constructs": "SELECT 'if' AS kind, 1 AS start, 8 AS stop, count(*) AS n FROM part WHERE p_size % 3 = 0 HAVING count(*) > 0",
    "jvm_blocks": """
WITH b AS (SELECT unnest([[{'s': 0, 'e': 4, 'n': 2, 'l': 'ifeq'}, {'s': 4, 'e': 8, 'n': 2, 'l': 'ireturn'}, {'s': 8, 'e': 10, 'n': 2, 'l': 'ireturn'}],
  [{'s': 0, 'e': 5, 'n': 3, 'l': 'return'}], [{'s': 0, 'e': 2, 'n': 2, 'l': 'areturn'}]][p_size % 3 + 1]) AS x FROM part)
SELECT x.s AS start, x.e AS stop, x.n AS n, x.l AS last, count(*) AS n_blocks FROM b GROUP BY 1, 2, 3, 4""",
    "jvm_declarations": _PART
    + """
, l AS (SELECT class_name, 1 AS o, p_partkey AS k, '    public static final ' || CASE WHEN p_size % 2 = 0 THEN 'int f' || p_partkey || ' = ' || p_size ELSE 'java.lang.String f' || p_partkey END || ';' AS line
  FROM p WHERE p_size % 10 <> 0
UNION ALL SELECT class_name, 2, p_partkey, '    public ' || CASE WHEN p_size % 3 = 0 THEN 'int m' || p_partkey || '(int, long);' ELSE 'final java.util.List m' || p_partkey || '();' END FROM p WHERE p_size % 3 <> 1)
SELECT replace(class_name, '.', '_') || '.java' AS file_name,
  'package part;' || chr(10) || chr(10) || 'public class ' || list_last(string_split(class_name, '.')) || ' {' || chr(10) || string_agg(line, chr(10) ORDER BY o, k) || chr(10) || '}' || chr(10) AS source
FROM l GROUP BY class_name""",
    "jar_entries": """
SELECT DISTINCT p_brand AS file_id, 'part/' || p_brand || '_' || (p_partkey // 4096) || '.class' AS name, true AS ok, 'CAFEBABE' AS magic FROM part
UNION ALL SELECT DISTINCT p_brand, 'damaged.class', false, CAST(NULL AS VARCHAR) FROM part""",
    "pe_list": _NET + "SELECT file_id, CASE WHEN nested THEN parent || '/' || nm ELSE ns0 || '.' || nm END AS name FROM t",
    "pe_kinds": _NET
    + """
SELECT file_id, full_name AS name, CASE WHEN n_nationkey % 11 = 3 THEN 'interface' WHEN n_nationkey % 6 = 0 THEN 'enum' ELSE 'class' END AS kind,
  n_nationkey % 11 <> 3 AND n_nationkey % 6 <> 0 AND n_nationkey % 7 = 0 AS is_static FROM t""",
    "pe_fields": _NET + "SELECT file_id, 'S' || k AS name, ['int[]', 'string', nm][k % 3 + 1] AS type FROM s",
    "pe_methods": _NET
    + "SELECT file_id, 'M' || k AS name, ['void', 'int'][k % 2 + 1] AS return_type, ['int, string[]', ''][k % 2 + 1] AS params FROM c",
    "pe_json": _NET
    + """
SELECT file_id, nm AS name, ns AS namespace, (SELECT count(*) FROM s WHERE s.file_id = t.file_id AND s.n_nationkey = t.n_nationkey) AS n_fields,
  (SELECT count(*) FROM c WHERE c.file_id = t.file_id AND c.n_nationkey = t.n_nationkey) AS n_methods,
  (SELECT ['void', 'int'][min(k) % 2 + 1] FROM c WHERE c.file_id = t.file_id AND c.n_nationkey = t.n_nationkey) AS first_return FROM t""",
    "pe_obfuscation": _NET
    + """
, calls AS (SELECT file_id, n_nationkey, count(*) AS x FROM c WHERE k % 2 = 0 GROUP BY 1, 2),
m AS (SELECT t.file_id, count(DISTINCT t.n_nationkey) AS types, (SELECT count(*) FROM c WHERE c.file_id = t.file_id) AS methods,
  (SELECT max(k % 60) FROM c WHERE c.file_id = t.file_id AND k % 50 = 1) AS cases, (SELECT max(x) FROM calls WHERE calls.file_id = t.file_id) AS calls FROM t GROUP BY t.file_id)
SELECT file_id, 3 AS ord, CASE WHEN cases > 50 THEN 'high' ELSE 'low' END AS severity, 'control-flow' AS category, 'a switch of ' || cases || ' cases' AS message FROM m WHERE cases > 20
UNION ALL SELECT file_id, 4, 'high', 'strings', calls || ' strings passed to one method' FROM m WHERE calls > 10
UNION ALL SELECT file_id, 5, 'info', 'summary', types || ' types, ' || methods || ' methods' FROM m""",
    "pe_opcode_counts": _NET
    + """
, i AS (SELECT file_id, unnest(CASE WHEN k % 2 = 0 THEN ['ldstr', 'call', 'ret'] WHEN k % 50 = 1 THEN ['ldc.i4.0', 'switch', 'ret'] ELSE ['ldc.i4.0', 'ret'] END) AS name FROM c)
SELECT file_id, name, count(*) AS n FROM i GROUP BY 1, 2""",
    "pe_listing": _NET
    + """
SELECT file_id, CASE WHEN k % 2 = 0 THEN 'void ' || nm || '::M' || k || '(int, string[])' || chr(10) || '  .maxstack 8' || chr(10) || '  IL_0000: ldstr "' || seg || '"' || chr(10)
    || '  IL_0005: call ' || full_name || '::M' || first_k || chr(10) || '  IL_000a: ret'
  ELSE 'int ' || nm || '::M' || k || '()' || chr(10) || '  .maxstack 8' || chr(10) || '  IL_0000: ldc.i4.0' || chr(10) || CASE WHEN k % 50 = 1 THEN
    rtrim('  IL_0001: switch ' || array_to_string(list_transform(range(k % 60), lambda x: 'IL_' || lower(lpad(to_hex(6 + 4 * (k % 60)), 4, '0'))), ', ')) || chr(10)
    || '  IL_' || lower(lpad(to_hex(6 + 4 * (k % 60)), 4, '0')) || ': ret' ELSE '  IL_0001: ret' END END AS listing FROM c""",
    "pe_declarations": _NET
    + """
, t2 AS (SELECT *, CASE WHEN n_nationkey % 11 = 3 THEN 'interface ' WHEN n_nationkey % 6 = 0 THEN 'enum ' WHEN n_nationkey % 7 = 0 THEN 'static class ' ELSE 'class ' END AS kind,
  CASE WHEN nested THEN '    ' ELSE '' END AS d FROM t),
l AS (SELECT s.file_id, s.n_nationkey, 1 AS o, k, d || '    private ' || ['int[]', 'string', s.nm][k % 3 + 1] || ' S' || k || ';' AS line FROM s JOIN t2 USING (file_id, n_nationkey) WHERE kind <> 'enum '
UNION ALL SELECT c.file_id, c.n_nationkey, 2, k, d || '    public ' || ['void M' || k || '(int arg0, string[] arg1);', 'int M' || k || '();'][k % 2 + 1] FROM c JOIN t2 USING (file_id, n_nationkey)),
b AS (SELECT file_id, n_nationkey, string_agg(line, chr(10) ORDER BY o, k) || chr(10) AS body FROM l GROUP BY ALL),
x AS (SELECT file_id, n_nationkey, ns0, nm, nested, parent_key, d || CASE WHEN nested THEN 'private ' ELSE 'public ' END || kind || nm || CASE WHEN kind = 'enum ' THEN ' : int' ELSE '' END || chr(10) || d || '{' || chr(10) || coalesce(body, '') AS opened, d || '}' || chr(10) AS closed
  FROM t2 LEFT JOIN b USING (file_id, n_nationkey)),
inner_ AS (SELECT file_id, parent_key AS n_nationkey, string_agg(opened || closed, '' ORDER BY n_nationkey) AS nested_text FROM x WHERE nested GROUP BY ALL)
SELECT file_id, ns0 || '_' || nm || '.cs' AS file_name, 'namespace ' || ns0 || ';' || chr(10) || chr(10) || opened || coalesce(nested_text, '') || closed AS source
FROM x LEFT JOIN inner_ USING (file_id, n_nationkey) WHERE NOT nested""",
    "pe_verify": _NET
    + """
SELECT file_id, 'method' AS category, 'M' || k AS name FROM c
UNION ALL SELECT file_id, 'type', nm FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.file_id = t.file_id AND s.n_nationkey = t.n_nationkey AND k % 3 = 2)""",
    "pe_namespaces": _NET + "SELECT DISTINCT file_id, 'System' AS namespace FROM t",
}
