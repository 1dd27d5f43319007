"""DuckDB SQL for the queries of ``enums``."""

SQL = {
    "jvm_enum_sources": r"""
WITH e AS (SELECT replace(p_brand, '#', '_') || '_' || (p_partkey // 512) AS name, string_agg('P' || p_partkey, ', ' ORDER BY p_partkey) AS constants FROM part GROUP BY 1)
SELECT 'brand_' || name || '.java' AS file_name, concat_ws(chr(10), 'package brand;', '', 'public enum ' || name || ' {', '    ' || constants || ';', '    private final int size;',
  '    public java.lang.String label(int);', '    public int values();', '}', '') AS source FROM e""",
}
