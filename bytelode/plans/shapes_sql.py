"""DuckDB SQL for the queries of ``shapes``: what each shape holds, by hand from its code, for the customers that have it."""

_C = "WITH c AS (SELECT c_custkey AS k, n_name AS nation, 'run' || c_custkey AS jvm, 'Run' || c_custkey AS net FROM customer JOIN nation ON c_nationkey = n_nationkey)\n"


def _shaped(method: str, n: int, columns: str, rows: str) -> str:
    return f"{_C}, v(m, {columns}) AS (VALUES {rows})\nSELECT c.{method} AS method, v.* EXCLUDE (m) FROM c JOIN v ON c.k % {n} = v.m"


_REGION = "kind, type, start, stop, depth, parent_kind, parent_start, crosses"
_HEIGHT = "start, height, n_before, conflict, temps"
_FINALLY = lambda m, a, h, e: f"({m}, 'try', NULL, {a}, {h}, 0, NULL, -1, false), ({m}, 'finally', NULL, {h}, {e}, 0, NULL, -1, false)"
_HIGH = lambda m, *rows: ", ".join(f"({m}, {s}, {-1 if h is None else h}, {n}, {str(c).lower()}, '{t}')" for s, h, n, c, t in rows)
_DISPOSED = lambda h, z: [(h, 0, 0, False, ""), (h + 6, 0, 1, False, ""), (z, 0, 2, False, "")]

SQL = {
    "jvm_handler_regions": _shaped("jvm", 7, _REGION, """
(0, 'try', NULL, 0, 10, 0, NULL, -1, false), (0, 'try', NULL, 1, 3, 1, 'try', 0, false), (0, 'catch', 'java.io.IOException', 6, 10, 1, 'try', 0, false), (0, 'finally', NULL, 11, 14, 0, NULL, -1, false)"""),
    "pe_handler_regions": _shaped("net", 6, _REGION, f"""
(0, 'try', NULL, 0, 28, 0, NULL, -1, false), (0, 'try', NULL, 1, 7, 1, 'try', 0, false), (0, 'catch', 'System.Exception', 7, 13, 1, 'try', 0, false), (0, 'when', NULL, 13, 17, 1, 'try', 0, false),
(0, 'filter', NULL, 17, 23, 1, 'try', 0, false), (0, 'finally', NULL, 28, 30, 0, NULL, -1, false), {_FINALLY(1, 5, 20, 34)}, {_FINALLY(2, 2, 8, 21)}, {_FINALLY(3, 7, 36, 49)}, {_FINALLY(5, 2, 8, 21)}"""),
    "jvm_stack_heights": _shaped("jvm", 7, _HEIGHT, ", ".join((
        _HIGH(0, (0, 0, 0, False, ""), (6, 1, 0, False, ""), (7, 0, 2, False, ""), (11, 1, 0, False, "")),
        _HIGH(1, (0, 0, 0, False, ""), (10, 1, 0, False, ""), (15, 0, 1, False, "")),
        _HIGH(2, (0, 0, 0, False, ""), (4, 0, 1, False, ""), (8, 0, 1, False, ""), (9, 2, 2, False, "T0009_0,T0009_1")),
        _HIGH(3, (0, 0, 0, False, ""), (8, 0, 2, False, ""), (18, 0, 1, False, ""), (35, 0, 1, False, "")),
        _HIGH(4, (0, 0, 0, False, "")),
        _HIGH(5, (0, 0, 0, False, ""), (4, 0, 1, False, ""), (7, 0, 1, False, ""), (10, 0, 2, False, ""), (13, 0, 1, False, ""), (16, 0, 1, False, ""), (17, None, 1, False, ""), (20, None, 1, False, "")),
        _HIGH(6, (0, 0, 0, False, ""), (10, 0, 1, False, ""), (14, 0, 1, False, ""), (15, None, 2, True, "")),
    ))),
    "pe_stack_heights": _shaped("net", 6, _HEIGHT, ", ".join((
        _HIGH(0, (0, 0, 0, False, ""), (7, 1, 0, False, ""), (13, 1, 0, False, ""), (17, 1, 0, False, ""), (23, 0, 3, False, ""), (28, 0, 0, False, ""), (30, 0, 1, False, "")),
        _HIGH(1, (0, 0, 0, False, ""), (20, 0, 0, False, ""), (26, 0, 1, False, ""), (33, 0, 2, False, ""), (34, 0, 1, False, "")),
        _HIGH(2, (0, 0, 0, False, ""), *_DISPOSED(8, 20), (21, 0, 1, False, "")),
        _HIGH(3, (0, 0, 0, False, ""), (12, 0, 1, False, ""), (20, 0, 2, False, ""), (31, 0, 1, False, ""), *_DISPOSED(36, 48), (49, 0, 1, False, "")),
        _HIGH(4, (0, 0, 0, False, ""), (7, 1, 1, False, ""), (13, 1, 1, False, ""), (14, 2, 2, False, "T000E_0,T000E_1")),
        _HIGH(5, (0, 0, 0, False, ""), *_DISPOSED(8, 20), (21, 0, 1, False, ""), (27, 0, 1, False, ""), (33, 0, 1, False, ""), (34, None, 2, True, "")),
    ))),
    "jvm_statements": _shaped("jvm", 7, "kind, variable, item, start, stop", "(3, 'foreach', 4::BIGINT, 3::BIGINT, 6, 35)"),
    "pe_statements": _shaped("net", 6, "kind, variable, item, start, stop", "(1, 'lock', 7::BIGINT, -1::BIGINT, 5, 20), (2, 'using', 1, -1, 2, 8), (3, 'foreach', 1, 2, 7, 36)"),
    "jvm_concatenations": _C + r"""SELECT jvm AS method, 2 AS "offset", '"' || nation || '=" + arg0 + ", " + "a\"b" + ":" + arg1 + "."' AS text FROM c WHERE k % 7 = 4 UNION ALL SELECT jvm, 2, 'arg0 + arg1' FROM c WHERE k % 7 = 6""",
    "jvm_threaded_jumps": _shaped("jvm", 7, "source, kind, target, final, hops, ring", """
(0, 3, 'goto', 7, 7, 0, false), (1, 7, 'goto', 15, 15, 0, false), (2, 1, 'branch', 8, 8, 0, false), (2, 5, 'goto', 9, 9, 0, false), (3, 15, 'branch', 35, 35, 0, false), (3, 32, 'goto', 8, 8, 0, false),
(5, 1, 'branch', 7, 16, 3, false), (5, 4, 'goto', 10, 16, 2, false), (5, 7, 'goto', 10, 16, 2, false), (5, 10, 'goto', 13, 16, 1, false), (5, 13, 'goto', 16, 16, 0, false), (5, 17, 'goto', 20, 20, 0, true),
(5, 20, 'goto', 17, 17, 0, true), (6, 7, 'branch', 14, 14, 0, false), (6, 11, 'goto', 15, 15, 0, false)"""),
    "jvm_dropped_labels": _shaped("jvm", 7, '"offset", kind', "(5, 7, 'label'), (5, 10, 'label'), (5, 13, 'label'), (5, 13, 'goto')"),
}
