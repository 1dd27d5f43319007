"""DuckDB SQL for the queries of ``kernels``."""

SQL = {
    "qualified_name_filter": """
WITH j AS (SELECT *, r_name || '.' || n_name AS full_name, arg_min(n_name, n_nationkey) OVER (PARTITION BY r_regionkey) AS first_name
           FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT n_nationkey, full_name FROM j WHERE n_name = first_name OR full_name = r_name || '.' || first_name""",
    "anti_nested": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "range_ownership": """
WITH s AS (SELECT min(o_orderkey) AS start FROM orders GROUP BY o_orderkey // 64),
     o AS (SELECT start, lead(start, 1, 1::BIGINT << 62) OVER (ORDER BY start) AS stop FROM s)
SELECT start, count(*) AS n_items FROM lineitem JOIN o ON l_orderkey >= start AND l_orderkey < stop GROUP BY start""",
    "first_match_lookup": "SELECT user_id, arg_min(event_type, event_id) AS first_type, min(event_id) AS event_id FROM events GROUP BY user_id",
    "ordered_collect": """
SELECT r_name, string_agg(n_name, ',' ORDER BY n_nationkey) AS members FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    "accessor_pivot": """
SELECT user_id, max(event_id) FILTER (event_type = 'view') AS last_view, max(event_id) FILTER (event_type = 'click') AS last_click,
  max(event_id) FILTER (event_type = 'purchase') AS last_purchase FROM events GROUP BY user_id""",
    "polymorphic_union_join": """
WITH r AS (SELECT 'customer' AS tag, c_nationkey AS key, c_acctbal AS bal FROM customer
           UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier)
SELECT tag, n_name, count(*) AS n, CAST(sum(CAST(round(bal * 100) AS BIGINT)) AS BIGINT) AS cents FROM r JOIN nation ON key = n_nationkey GROUP BY tag, n_name""",
    "coded_index_decode": "SELECT p_partkey & 7 AS tag, count(*) AS n, max(p_partkey >> 3) AS max_row FROM part GROUP BY 1",
    "distinct_sorted_union": "SELECT DISTINCT p_type AS name FROM part UNION ALL SELECT '(supplied)' WHERE EXISTS (SELECT 1 FROM supplier)",
    "name_anomaly_counts": """
SELECT lang, count(*) AS n, count(*) FILTER (strlen(text) > 4000) AS n_long, count(*) FILTER (strlen(text) > length(text)) AS n_wide
FROM documents GROUP BY lang""",
    "max_of_first_per_group": """
WITH f AS (SELECT user_id, arg_min(value, event_id) AS v, min(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT v AS value, event_id FROM f ORDER BY v DESC, event_id DESC LIMIT 1""",
    "adjacent_pair_having": """
WITH l AS (SELECT user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, count(*) AS n_after_view FROM l WHERE before = 'view' GROUP BY user_id HAVING count(*) > 10""",
    "containment_missing": "SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))",
    "handler_lead": """
SELECT user_id, event_id, lead(event_id, 1, 1::BIGINT << 40) OVER (PARTITION BY user_id ORDER BY event_id) AS stop
FROM events WHERE event_type = 'purchase'""",
    "consecutive_dedupe": """
WITH l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, user_id, event_type FROM l WHERE event_type IS DISTINCT FROM before""",
    "severity_report": """
WITH c AS (SELECT count(*) AS n, count(*) FILTER (strlen(text) > length(text)) AS wide, count(*) FILTER (strlen(text) > 10000) AS long FROM documents),
r AS (SELECT 1 AS ord, CASE WHEN wide > 0 THEN 'high' END AS severity, wide || ' wide texts' AS message FROM c
      UNION ALL SELECT 2, CASE WHEN long > 50 THEN 'high' WHEN long > 20 THEN 'low' END, long || ' long texts' FROM c
      UNION ALL SELECT 3, 'info', n || ' texts' FROM c)
SELECT * FROM r WHERE severity IS NOT NULL""",
    "json_model": """
SELECT r_name, count(*) AS n_types, arg_min(n_name, n_nationkey) AS first_type FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    "owner_counts": """
SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
  AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY c_mktsegment""",
    "flag_decode": """
SELECT CASE WHEN p_size & 32 <> 0 THEN 'interface' WHEN p_size & 16 <> 0 THEN 'enum' WHEN p_size & 8 <> 0 THEN 'struct' ELSE 'class' END AS kind,
  (p_size & 1 <> 0 AND p_size & 2 <> 0 AND p_size & 32 = 0) AS is_static, count(*) AS n FROM part GROUP BY 1, 2""",
    "name_cleanup": r"""
SELECT p_partkey, translate(p_type, ' `/\', '____') || '.' || lower(list_last(string_split(p_type, ' '))) AS file_name FROM part""",
}
