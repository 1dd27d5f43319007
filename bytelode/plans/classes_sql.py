"""DuckDB SQL for the queries of ``classes``, from the tables the binaries were made of."""

_JVM = """
WITH s AS (SELECT n_name AS nation, s_suppkey // 1024 AS chunk, s_suppkey AS k, replace(n_name, ' ', '_') || (s_suppkey // 1024) AS cls FROM supplier JOIN nation ON s_nationkey = n_nationkey)
"""

SQL = {
    "jvm_for_loops": _JVM + "SELECT 'run' || k AS method, 1 AS variable, 1 AS start, 2 AS test, 8 AS step, 14 AS stop FROM s WHERE k % 4 = 0",
    "jvm_loops": _JVM
    + """
SELECT 'run' || k AS method, ['while', 'switch', '', 'if'][k % 4 + 1] AS kind, [5, 1, 0, 3][k % 4 + 1] AS start, [14, 44, 0, 7][k % 4 + 1] AS stop FROM s WHERE k % 4 <> 2""",
    "jvm_switch_arms": _JVM
    + """
, a AS (SELECT * FROM (VALUES (36, 40, '5,7', false, 44), (40, 44, '9', false, 44), (44, 44, '', true, -1)) v(start, stop, cases, is_default, exit))
SELECT 'run' || k AS method, start, stop, cases, is_default, exit, true AS shared FROM s, a WHERE k % 4 = 1""",
    "jvm_synchronized": _JVM + "SELECT 'run' || k AS method, 0 AS \"offset\" FROM s WHERE k % 4 = 2",
    "jvm_fused": _JVM + "SELECT 'run' || k AS method, 2 AS \"offset\", 'lcmp' AS name, 'ifle' AS test, 7 AS target FROM s WHERE k % 4 = 3",
    "jvm_edges": _JVM
    + """
, e AS (SELECT * FROM (VALUES (0, 0, 2, 'fall'), (0, 2, 8, 'fall'), (0, 2, 14, 'branch'), (0, 8, 2, 'goto'), (1, 0, 36, 'switch'), (1, 0, 40, 'switch'), (1, 0, 44, 'switch'), (1, 36, 44, 'goto'),
  (1, 40, 44, 'goto'), (3, 0, 6, 'fall'), (3, 0, 7, 'branch'), (3, 6, 7, 'fall')) v(shape, source, target, kind))
SELECT source, target, kind, count(*) AS n FROM s JOIN e ON k % 4 = shape GROUP BY ALL""",
    "jvm_class_listing": _JVM
    + """
, u AS (SELECT cls, nation, 0 AS o, 2 * k AS ord, 'java.util.List f' || k || ' flags: private' AS txt FROM s
UNION ALL SELECT cls, nation, 1, 2 * k, 'supply.' || cls || '.run' || k || '(int) -> void' || chr(10) || '  flags: public' || chr(10) || '  stack=4, locals=2, args=2' || chr(10) || array_to_string([
  ['     0: iconst_0', '     1: istore_1', '     2: iload_1', '     3: bipush 10', '     5: if_icmpge 14', '     8: iinc 1, 1', '    11: goto 2', '    14: return'],
  ['     0: iload_1', '     1: lookupswitch 5: 36, 7: 36, 9: 40, default: 44', '    36: nop', '    37: goto 44', '    40: nop', '    41: goto 44', '    44: return'],
  ['     0: astore_1', '     1: aload_1', '     2: monitorexit', '     3: return', '  Exception table:', '    [0, 1) -> 3 java.lang.Exception'],
  ['     0: lconst_0', '     1: lconst_1', '     2: lcmp', '     3: ifle 7', '     6: nop', '     7: return']][k % 4 + 1], chr(10)) FROM s
UNION ALL SELECT cls, nation, 1, 2 * k + 1, 'supply.' || cls || '.map' || k || '(java.lang.Object, int[]) -> java.util.Map' || CASE WHEN k % 3 = 0 THEN ' throws java.io.IOException' ELSE '' END
  || chr(10) || '  flags: public abstract' FROM s)
SELECT 'class supply.' || cls || ' extends java.lang.Object implements java.util.concurrent.Callable' || chr(10) || '  version: 61.0' || chr(10) || '  flags: public abstract' || chr(10)
  || '  source: ' || nation || '.java' || chr(10) || chr(10) || string_agg(txt, chr(10) || chr(10) ORDER BY o, ord) AS listing FROM u GROUP BY cls, nation""",
    "jvm_generic_sources": _JVM
    + """
, l AS (SELECT cls, 0 AS o, 2 * k AS ord, '    private java.util.List' || CASE WHEN k % 2 = 1 THEN '<java.lang.String>' ELSE '' END || ' f' || k || ';' AS txt FROM s
UNION ALL SELECT cls, 1, 2 * k, '    public void run' || k || '(int);' FROM s
UNION ALL SELECT cls, 1, 2 * k + 1, '    public abstract ' || CASE WHEN k % 5 = 0 THEN '<T> java.util.Map<T, ? extends java.lang.Number> map' || k || '(T, int[])' ELSE 'java.util.Map map' || k || '(java.lang.Object, int[])' END
  || CASE WHEN k % 3 = 0 THEN ' throws java.io.IOException' ELSE '' END || ';' FROM s)
SELECT 'supply_' || cls || '.java' AS file_name, 'package supply;' || chr(10) || chr(10) || 'public abstract class ' || cls || '<V> implements java.util.concurrent.Callable<V> {' || chr(10)
  || string_agg(txt, chr(10) ORDER BY o, ord) || chr(10) || '}' || chr(10) AS source FROM l GROUP BY cls""",
}
