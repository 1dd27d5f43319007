"""DuckDB SQL for the queries of ``assemblies``, from the tables the binaries were made of."""

_NET = """
WITH s AS (SELECT n_name AS nation, n_name || '#' || (s_suppkey // 1024) AS file_id, s_suppkey AS k, 'S' || s_suppkey || CASE WHEN s_suppkey % 7 = 0 THEN '`2' ELSE '' END AS type_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)
"""

SQL = {
    "pe_properties": _NET
    + "SELECT file_id, type_name, 'P' || k AS name, 'string' AS type, 'get_P' || k AS getter_name, CASE WHEN k % 2 = 0 THEN 'set_P' || k END AS setter_name FROM s",
    "pe_events": _NET
    + "SELECT file_id, type_name, 'E' || k AS name, 'EventHandler' AS type, 'add_E' || k AS adder_name, 'remove_E' || k AS remover_name FROM s WHERE k % 4 = 0",
    "pe_attributes": _NET + r"""SELECT file_id, type_name, '[Obsolete("use \"' || nation || '\"")]' AS line FROM s WHERE k % 5 = 0""",
    "pe_interfaces": _NET
    + "SELECT file_id, type_name, CASE WHEN k % 9 = 0 THEN 'IDisposable,ICloneable' ELSE 'IDisposable' END AS interfaces FROM s WHERE k % 3 = 0",
    "pe_type_parameters": _NET + "SELECT file_id, type_name, 'T,U' AS params FROM s WHERE k % 7 = 0",
    "pe_native": _NET + "SELECT file_id, 'Native' || k AS name, 'fn' || k AS import_name, 'lib' || nation AS library FROM s WHERE k % 6 = 0",
    "pe_explicit": _NET + "SELECT file_id, type_name, 'IDisposable' AS interface, 'Dispose' AS name FROM s WHERE k % 3 = 0",
    "pe_accessor_calls": _NET + "SELECT file_id, 'Run' || k AS caller, 'P' || k AS property, 'get' AS role FROM s",
    "pe_locals": _NET + "SELECT file_id, 'Run' || k AS name, 'int, string' AS locals FROM s",
    "pe_constants": _NET + "SELECT file_id, 'C' || k AS name, CAST(k AS VARCHAR) AS literal FROM s",
    "pe_nesting": _NET
    + """
SELECT file_id, 'Inner' || k AS type_name, type_name AS top_name, 1 AS depth FROM s WHERE k % 8 = 7
UNION ALL SELECT file_id, 'Deep' || k, type_name, 2 FROM s WHERE k % 8 = 7""",
    "pe_source_members": _NET
    + """
SELECT file_id, 'C' || k AS name FROM s UNION ALL SELECT file_id, 'Run' || k FROM s UNION ALL SELECT file_id, 'Native' || k FROM s WHERE k % 6 = 0
UNION ALL SELECT file_id, 'System.IDisposable.Dispose' FROM s WHERE k % 3 = 0 UNION ALL SELECT file_id, 'Dive' || k FROM s WHERE k % 8 = 7""",
    "pe_first_match": _NET
    + """
SELECT file_id, 'Supply.' || type_name AS name FROM s WHERE type_name IN ('S1', 'S2') UNION ALL SELECT file_id, 'Inner15' FROM s WHERE k = 15""",
    "pe_supplier_sources": _NET
    + r"""
SELECT file_id, 'Supply_S' || k || CASE WHEN k % 7 = 0 THEN '_2' ELSE '' END || '.cs' AS file_name, concat_ws(chr(10), 'namespace Supply;', '',
  CASE WHEN k % 5 = 0 THEN '[Obsolete("use \"' || nation || '\"")]' END,
  'public ' || CASE k % 10 WHEN 2 THEN 'abstract ' WHEN 3 THEN 'sealed ' ELSE '' END || 'class S' || k || CASE WHEN k % 7 = 0 THEN '<T, U>' ELSE '' END
  || coalesce(' : ' || nullif(concat_ws(', ', CASE k % 11 WHEN 0 THEN 'List<string>' WHEN 1 THEN 'Component' END, CASE WHEN k % 3 = 0 THEN 'IDisposable' END, CASE WHEN k % 9 = 0 THEN 'ICloneable' END), ''), ''), '{',
  '    public const int C' || k || ' = ' || k || ';',
  '    public string P' || k || ' { get; ' || CASE WHEN k % 2 = 0 THEN 'set; ' ELSE '' END || '}',
  CASE WHEN k % 4 = 0 THEN '    public event EventHandler E' || k || ';' END,
  '    public static void Run' || k || '();',
  CASE WHEN k % 6 = 0 THEN '    [DllImport("lib' || nation || '", EntryPoint = "fn' || k || '")] public static extern int Native' || k || '(int count);' END,
  CASE WHEN k % 3 = 0 THEN '    void System.IDisposable.Dispose();' END,
  CASE WHEN k % 8 = 7 THEN concat_ws(chr(10), '    public class Inner' || k, '    {', '        private class Deep' || k, '        {', '            public bool Dive' || k || '();', '        }', '    }') END,
  '}', '') AS source FROM s""",
    "pe_verify_summary": _NET
    + """
, c AS (SELECT file_id, count(*) + 2 * count(*) FILTER (k % 8 = 7) AS n_types, count(*) + count(*) FILTER (k % 6 = 0) + count(*) FILTER (k % 8 = 7) AS n_methods,
  count(*) + count(*) FILTER (k % 4 = 0) AS n_fields, count(*) AS n FROM s GROUP BY file_id)
SELECT file_id, n_types, n_methods, n_fields, n_types + n_methods + n_fields - n AS n_missing FROM c""",
}
