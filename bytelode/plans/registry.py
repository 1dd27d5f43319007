"""Queries of the library without the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from bytelode.plans import assemblies, assemblies_sql, binaries, binaries_sql, classes, classes_sql, enums, enums_sql, generics, generics_sql, kernels, kernels_sql, loops, loops_sql, shapes, shapes_sql

FLAGSHIP = "adjacent_pair_having"
_MODULES = ((kernels, kernels_sql), (binaries, binaries_sql), (assemblies, assemblies_sql), (classes, classes_sql), (generics, generics_sql), (shapes, shapes_sql), (enums, enums_sql), (loops, loops_sql))
QUERIES = {name: getattr(plans, name) for plans, sql in _MODULES for name in sql.SQL}
SQL = {name: text for _, sql in _MODULES for name, text in sql.SQL.items()}
