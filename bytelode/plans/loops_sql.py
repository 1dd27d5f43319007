"""DuckDB SQL for the queries of ``loops``: what each layout holds, by hand from its code."""

SQL = {
    "jvm_natural_loops": """
WITH v(m, header, n_back, n_blocks, stop, depth, parent) AS (VALUES (0, 2, 1, 5, 26, 1, -1), (0, 6, 2, 3, 20, 2, 2), (1, 6, 1, 2, 10, 1, -1), (3, 0, 1, 1, 4, 1, -1))
SELECT 'loop' || s_suppkey AS method, v.* EXCLUDE (m) FROM supplier JOIN v ON s_suppkey % 4 = m""",
}
