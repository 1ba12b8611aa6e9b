"""SQL counterparts of the catalogue's queries."""

from __future__ import annotations

_SETS = "SELECT o_custkey AS owner, list_sort(list(DISTINCT o_orderpriority || '/' || o_orderstatus)) AS s FROM orders GROUP BY 1"
_HALVES = "SELECT *, CASE WHEN o_orderdate < '1999-01-01' THEN 0 ELSE 1 END AS half FROM orders"
_GEO = "SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer"
_DAILY = "SELECT event_type, ts::DATE AS day, count(*) FILTER (value > 95) AS hits FROM events GROUP BY 1, 2"
_BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160)"
_REF = f"nullif(regexp_replace(trim({{}}, {_BLANK}), '^\\./', ''), '')"
_IDENT = f"nullif(lower(trim({{}}, {_BLANK})), '')"
_LINKS = f"SELECT {_REF.format('source')} AS src, {_REF.format('target')} AS dst FROM impact_links WHERE lower(trim(source_kind)) = 'doc' AND lower(trim(confidence)) = 'explicit' AND nullif(trim(source), '') IS NOT NULL AND nullif(trim(target), '') IS NOT NULL"
_MARKERS = """
SELECT event_id, kind, profile, CASE WHEN expired THEN 'expired_exemption' WHEN profile = 'observe' THEN CASE WHEN kind = 'unknown' OR NOT witness THEN 'unresolved' ELSE 'resolved' END
  WHEN allowed IS NULL OR NOT list_contains(allowed, kind) THEN 'illegal_locus' WHEN NOT witness THEN 'missing_witness' WHEN kind = 'unknown' THEN 'unresolved' ELSE 'resolved' END AS status
FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'control_ambiguity' WHEN 'view' THEN 'schema_drift' ELSE 'unknown' END AS kind, CASE WHEN user_id % 3 = 0 THEN 'observe' ELSE 'enforce' END AS profile,
  event_id % 11 = 0 AS expired, value > 50 AS witness,
  CASE WHEN user_id % 5 = 1 THEN ['control_ambiguity'] WHEN user_id % 5 = 2 THEN ['schema_drift', 'control_ambiguity'] WHEN user_id % 7 = 3 THEN ['schema_drift', 'control_ambiguity'] END AS allowed FROM events)
"""

ORACLES: dict[str, str] = {
    "proj_flagship": "SELECT event_type, count(*) AS count FROM events GROUP BY 1 HAVING count(*) > 1 ORDER BY count DESC, event_type LIMIT 10",
    "proj_select": "SELECT event_id, user_id, value FROM events WHERE value > 90 AND event_type = 'purchase'",
    "proj_project": "SELECT o_orderkey, o_orderstatus, NULL::VARCHAR AS absent FROM orders",
    "proj_count_by": "SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY 1, 2",
    "proj_having": "SELECT l_partkey, l_suppkey, count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "proj_traverse_index": "SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INTEGER AS position, unnest(embedding) AS weight FROM embeddings",
    "proj_traverse_merge": "SELECT event_id, 0 AS prop_index, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS prop_k FROM events",
    "proj_sort_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "proj_params_override": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P')",
    "spec_lint_findings": "SELECT path, line, col, code, message FROM lint_entries",
    "spec_ambiguity_virtual_set": "SELECT col AS span_col, col AS span_end_col, line AS span_end_line, line AS span_line, severity AS suite_kind, path AS suite_path, code AS suite_qual, count(*) AS count FROM lint_entries GROUP BY path, code, severity, line, col HAVING count(*) > 1",
    "spec_call_cluster_summary": "SELECT l_suppkey AS identity, 'supplier ' || l_suppkey AS display, count(DISTINCT l_partkey) AS count FROM lineitem GROUP BY 1",
    "agg_conditional": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p, count(*) AS n FROM orders GROUP BY 1",
    "agg_grouping_sets": "SELECT code, severity, grouping(code, severity)::BIGINT AS level, count(*) AS n FROM (SELECT upper(trim(code)) AS code, coalesce(severity, 'warning') AS severity FROM lint_entries) GROUP BY GROUPING SETS ((), (code), (severity), (code, severity))",
    "agg_histogram": "SELECT lines, count(*) AS orders FROM (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1) GROUP BY 1",
    "agg_top_counts": "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10",
    "agg_distinct_members": "SELECT l_partkey, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1",
    "agg_zero_filled": "SELECT status, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) AS k(status) LEFT JOIN orders ON o_orderstatus = status GROUP BY 1",
    "agg_constant_values": "SELECT l_suppkey, l_returnflag, min(l_tax) AS tax, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING min(l_tax) = max(l_tax)",
    "set_bundle_signature": "SELECT min(owner) AS first_owner, len(s)::BIGINT AS members, count(*) AS owners FROM (SELECT l_orderkey AS owner, list_sort(list(DISTINCT s_nationkey)) AS s FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) GROUP BY s HAVING count(*) > 1",
    "set_dominators": f"""WITH u AS ({_SETS}), c AS (SELECT DISTINCT s FROM u), sup AS (SELECT a.s AS a, b.s AS b, rank() OVER (PARTITION BY a.s ORDER BY len(b.s)) AS r FROM c a JOIN c b ON len(b.s) > len(a.s) AND list_has_all(b.s, a.s))
        SELECT u.owner, count(*) AS dominators FROM u JOIN sup ON sup.a = u.s AND r = 1 GROUP BY 1""",
    "set_equivalence_pareto": f"WITH u AS ({_SETS}) SELECT owner, c_acctbal FROM (SELECT owner, c_acctbal, row_number() OVER (PARTITION BY s ORDER BY c_acctbal DESC, owner) AS n FROM u JOIN customer ON c_custkey = owner) WHERE n = 1",
    "set_jaccard": f"""WITH c AS (SELECT s, min(owner) AS o FROM ({_SETS}) GROUP BY 1), p AS (SELECT x.o AS a, y.o AS b, len(list_intersect(x.s, y.s))::DOUBLE AS k, len(x.s) + len(y.s) AS t FROM c x JOIN c y ON x.o < y.o)
        SELECT a, b, round(k / (t - k), 6) AS jaccard FROM p WHERE k / (t - k) >= 0.75""",
    "set_last_witness": "SELECT l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1",
    "set_obsolescence": f"""WITH u AS ({_SETS}), c AS (SELECT s, min(owner) AS o FROM u GROUP BY 1), d AS (SELECT DISTINCT a.s FROM c a JOIN c b ON len(b.s) > len(a.s) AND list_has_all(b.s, a.s))
        SELECT c_custkey AS owner, CASE WHEN u.s IS NULL THEN 'unmapped' WHEN d.s IS NOT NULL THEN 'redundant_by_evidence' WHEN c_custkey <> c.o THEN 'equivalent_witness' ELSE 'active_candidate' END AS class
        FROM customer LEFT JOIN u ON u.owner = c_custkey LEFT JOIN d ON d.s = u.s LEFT JOIN c ON c.s = u.s""",
    "classify_ladder": "SELECT CASE WHEN event_type = 'error' THEN 'error' WHEN value > 80 THEN 'large' WHEN event_type = 'purchase' THEN 'buyer' ELSE 'other' END AS class, count(*) AS n FROM events GROUP BY 1",
    "join_interval": "WITH e AS (SELECT user_id, event_id, epoch(ts)::BIGINT AS x, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + floor(value)::BIGINT * 60 AS t FROM events) SELECT a.user_id, a.event_id AS a_id, b.event_id AS b_id FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.s <= b.t AND b.s <= a.t",
    "join_semi": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "join_anti": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "join_priority_fallback": """WITH near AS (SELECT s_nationkey AS k, min(s_suppkey) AS v, count(DISTINCT s_suppkey) AS h FROM supplier GROUP BY 1),
        far AS (SELECT a.n_nationkey AS k, min(s_suppkey) AS v, count(DISTINCT s_suppkey) AS h FROM nation a JOIN nation b USING (n_regionkey) JOIN supplier ON s_nationkey = b.n_nationkey GROUP BY 1)
        SELECT c_custkey, coalesce(near.v, far.v) AS supp, (CASE WHEN near.v IS NOT NULL THEN 0 WHEN far.v IS NOT NULL THEN 1 END)::BIGINT AS level, coalesce(near.h, far.h) AS hits FROM customer LEFT JOIN near ON near.k = c_nationkey LEFT JOIN far ON far.k = c_nationkey""",
    "join_ambiguity": "SELECT p_partkey, n, round(CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE greatest(0.1::DOUBLE, 1::DOUBLE / n) END, 6) AS confidence, n > 1 AS inferred FROM (SELECT p_partkey, count(*) OVER (PARTITION BY split_part(p_name, ' ', 1)) AS n FROM part)",
    "join_as_of": "SELECT e.event_id, p.value AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts",
    "delta_counts": f"SELECT o_orderpriority, count(*) FILTER (half = 0) AS baseline, count(*) FILTER (half = 1) AS current, count(*) FILTER (half = 1) - count(*) FILTER (half = 0) AS delta FROM ({_HALVES}) GROUP BY 1",
    "delta_entities": f"SELECT o_custkey, CASE WHEN a = 0 THEN 'added' WHEN b = 0 THEN 'removed' ELSE 'changed' END AS change_kind FROM (SELECT o_custkey, count(*) FILTER (half = 0) AS a, count(*) FILTER (half = 1) AS b FROM ({_HALVES}) GROUP BY 1) WHERE a <> b",
    "delta_gate": f"SELECT o_orderpriority, CASE WHEN b - a >= 20 THEN 'block' WHEN b - a >= 1 THEN 'warn' ELSE 'pass' END AS gate, a || ' -> ' || b || ' (' || CASE WHEN b >= a THEN '+' ELSE '' END || (b - a) || ')' AS shown FROM (SELECT o_orderpriority, count(*) FILTER (half = 0) AS a, count(*) FILTER (half = 1) AS b FROM ({_HALVES}) GROUP BY 1)",
    "ratchet_new": "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'R'",
    "structure_diff": "SELECT l_linenumber, l_returnflag, a AS baseline, b AS current, b - a AS delta, CASE WHEN a = 0 THEN 'added' WHEN b = 0 THEN 'removed' ELSE 'changed' END AS change_kind FROM (SELECT l_linenumber, l_returnflag, count(*) FILTER (l_linestatus = 'F') AS a, count(*) FILTER (l_linestatus <> 'F') AS b FROM lineitem GROUP BY 1, 2) WHERE a <> b",
    "gap_score": """WITH n AS (SELECT scope_id, coalesce(severity, 'warning') AS s, count(*) AS n FROM lint_entries GROUP BY 1, 2), g AS (SELECT scope_id, greatest(0.0::DOUBLE, 100 - sum(CASE s WHEN 'error' THEN 10.0::DOUBLE WHEN 'warning' THEN 4.0 ELSE 1.0 END * (1 + floor(log10(n))))) AS score FROM n GROUP BY 1)
        SELECT scope_id, score, CASE WHEN score >= 95 THEN 'strong' WHEN score >= 80 THEN 'good' WHEN score >= 60 THEN 'fair' ELSE 'weak' END AS band FROM g""",
    "trend_recurrence": f"SELECT event_type, strftime(day, '%Y-%m-%d') AS day, hits, round(avg((hits > 0)::INTEGER::DOUBLE) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 4) AS rate, hits - lag(hits) OVER (PARTITION BY event_type ORDER BY day) AS trend FROM ({_DAILY})",
    "trend_correction": f"SELECT event_type, strftime(day, '%Y-%m-%d') AS day, hits, n - max(CASE WHEN hits > 0 THEN n END) OVER (PARTITION BY event_type ORDER BY day) AS since FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS n FROM ({_DAILY}))",
    "trend_slo": f"SELECT event_type, max(rate) AS max_rate, max(rate) <= 0.5 AS meets_target, bool_and(coalesce(trend, 0) <= 0) AS not_rising FROM (SELECT event_type, round(avg((hits > 0)::INTEGER::DOUBLE) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 4) AS rate, hits - lag(hits) OVER (PARTITION BY event_type ORDER BY day) AS trend FROM ({_DAILY})) GROUP BY 1",
    "order_violation": "SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders) WHERE previous > o_totalprice",
    "determinism_duplicates": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "ledger_fold": "SELECT user_id, seq, value FROM (SELECT user_id, max(event_id) AS seq, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS op FROM events WHERE event_type <> 'view' GROUP BY 1) WHERE op <> 'error'",
    "ledger_parity": "SELECT user_id, event_id AS seq, value, 'a' AS side FROM events WHERE false",
    "graph_reach": f"WITH RECURSIVE e AS ({_GEO}), r(node, depth) AS (SELECT x, 0 FROM (VALUES ('r0'), ('r3')) v(x) UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 2) SELECT node, min(depth)::BIGINT AS depth FROM r GROUP BY 1",
    "graph_wl": f"""WITH g AS ({_GEO}), e AS (SELECT src, dst FROM g UNION ALL SELECT dst, src FROM g), l0 AS (SELECT DISTINCT src AS node, sha256(substr(src, 1, 1)) AS l FROM e),
        l1 AS (SELECT a.node, sha256(a.l || '#' || (SELECT string_agg(b.l, ',' ORDER BY b.l) FROM e JOIN l0 b ON b.node = e.dst WHERE e.src = a.node)) AS l FROM l0 a),
        l2 AS (SELECT a.node, sha256(a.l || '#' || (SELECT string_agg(b.l, ',' ORDER BY b.l) FROM e JOIN l1 b ON b.node = e.dst WHERE e.src = a.node)) AS l FROM l1 a)
        SELECT min(node) AS first_node, count(*) AS size FROM l2 GROUP BY l""",
    "graph_scc": f"""WITH RECURSIVE e AS ({_LINKS}), r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b), m AS (SELECT x.a AS node, least(min(x.b), x.a) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
        SELECT node, component, n FROM (SELECT node, component, count(*) OVER (PARTITION BY component) AS n FROM m) WHERE n > 1""",
    "graph_toposort": f"""WITH RECURSIVE e AS ({_LINKS}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b), c AS (SELECT DISTINCT a AS node FROM r WHERE a = b),
        bad AS (SELECT node FROM c UNION SELECT b FROM r WHERE a IN (SELECT node FROM c)), good AS (SELECT node FROM n WHERE node NOT IN (SELECT node FROM bad)),
        l(node, d) AS (SELECT node, 0 FROM good UNION SELECT e.dst, d + 1 FROM l JOIN e ON e.src = l.node WHERE e.dst IN (SELECT node FROM good))
        SELECT node, max(d)::BIGINT AS level FROM l GROUP BY 1 UNION ALL SELECT node, NULL FROM bad""",
    "graph_invalidate": f"WITH RECURSIVE e AS ({_GEO}), r(node) AS (SELECT dst FROM e WHERE src = 'r1' UNION SELECT dst FROM r JOIN e ON src = node) SELECT node FROM r",
    "fp_exponents": "SELECT l_linenumber::BIGINT AS key, least(a, b) AS gcd, greatest(a, b) AS lcm, abs(a - b) AS symdiff FROM (SELECT l_linenumber, count(*) FILTER (l_linestatus = 'O') AS a, count(*) FILTER (l_linestatus = 'F') AS b FROM lineitem GROUP BY 1)",
    "fp_contains": "SELECT bool_and(a >= b) AND sum(b) > 0 AS contains FROM (SELECT count(*) AS a, count(*) FILTER (l_linestatus = 'F') AS b FROM lineitem GROUP BY l_linenumber)",
    "fp_bitmask": "WITH k AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS b FROM (SELECT DISTINCT l_returnflag || l_linestatus AS key FROM lineitem)) SELECT l_orderkey, bit_or((1::BIGINT << b::INTEGER)::BIGINT) AS mask FROM lineitem JOIN k ON key = l_returnflag || l_linestatus GROUP BY 1",
    "id_digest": "SELECT p_partkey, 'suite:' || substr(sha256('int:' || p_partkey || '|str:' || p_name), 1, 16) AS suite_id, sha256('int:' || p_partkey || '|str:' || p_name) AS digest FROM part",
    "scalar_paramset": "SELECT row_id, array_to_string(s, ',') AS requires, len(s)::BIGINT AS n FROM (SELECT row_id, list_sort(list_distinct(list_filter(list_transform(coalesce(doc_requires, []), lambda x: trim(x)), lambda x: x <> ''))) AS s FROM doc_frontmatter)",
    "scalar_durations": "SELECT event_id, floor(value)::BIGINT * 60000000000 + (event_id % 60) * 1000000000 AS ns FROM events",
    "path_tests": "SELECT link_id, regexp_matches(split_part(source, '::', 1), '(^|/)tests?/|(^|/)test_[^/]*\\.py$|_test\\.py$') AS is_test FROM impact_links WHERE source IS NOT NULL",
    "text_headings": """WITH l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS no FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS s FROM documents WHERE text IS NOT NULL)),
        h AS (SELECT *, CASE WHEN regexp_matches(line, '^#{1,6}\\s+\\S') THEN trim(regexp_replace(line, '^#{1,6}\\s+', '')) END AS t FROM l), c AS (SELECT doc_id, t, last_value(t IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY no) AS heading FROM h)
        SELECT doc_id, heading, count(*) AS n FROM c WHERE heading IS NOT NULL AND t IS NULL GROUP BY 1, 2""",
    "text_front_matter": """WITH l AS (SELECT doc_id, unnest(string_split(split_part(replace(text, chr(13), '')[5:], chr(10) || '---', 1), chr(10))) AS line FROM documents WHERE starts_with(replace(text, chr(13), ''), '---' || chr(10)))
        SELECT doc_id, regexp_extract(line, '^([A-Za-z_][A-Za-z0-9_.-]*)\\s*:', 1) AS field, trim(regexp_replace(line, '^[^:]*:', '')) AS value FROM l WHERE regexp_matches(line, '^[A-Za-z_][A-Za-z0-9_.-]*\\s*:')""",
    "doc_contains": "SELECT doc_id FROM documents WHERE contains(lower(text), 'decision surface')",
    "taint_ladder": _MARKERS,
    "taint_summary": f"WITH m AS ({_MARKERS}) SELECT 'total' AS metric, '' AS key, count(*) AS n FROM m UNION ALL SELECT 'status', status, count(*) FROM m GROUP BY 2 UNION ALL SELECT 'kind', kind, count(*) FROM m GROUP BY 2",
    "taint_lifecycle": "SELECT event_type AS profile, CASE WHEN bool_or(g) THEN 'demote' WHEN bool_and(r) THEN 'promote' ELSE 'hold' END AS decision FROM (SELECT event_type, avg(value) > 30 AS r, max(value) > 99.99 AS g FROM events GROUP BY event_type, ts::DATE) GROUP BY 1",
    "window_tumbling": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "window_session": "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS s FROM events)) GROUP BY user_id, g",
    "rank_classes": "SELECT p_type, n, dense_rank() OVER (ORDER BY n DESC) - 1 AS class_rank FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1)",
    "join_point_in_span_all": """WITH e AS (SELECT DISTINCT scope_id, snapshot_no, path, line, severity FROM lint_entries)
        SELECT a.scope_id, a.snapshot_no, a.path, a.line, b.line AS error_line FROM e a JOIN e b ON a.scope_id = b.scope_id AND a.snapshot_no = b.snapshot_no AND a.path = b.path AND a.severity = 'info' AND b.severity = 'error' AND abs(a.line - b.line) <= 5""",
    "text_lint_lines_all": "SELECT trim(code) AS code, count(*) AS n, sum(line)::BIGINT AS lines FROM lint_entries GROUP BY 1",
    "graph_signature_all": f"WITH e AS (SELECT * FROM ({_GEO})), n AS (SELECT name, row_number() OVER (ORDER BY substr(name, 1, 1), name) - 1 AS i FROM (SELECT src AS name FROM e UNION SELECT dst FROM e)) SELECT DISTINCT a.i AS src_no, b.i AS dst_no FROM e JOIN n a ON a.name = src JOIN n b ON b.name = dst",
    "ledger_tail_runs": f"""WITH snap AS (SELECT run, arg_max(coalesce(replay_cursor, -9223372036854775808), (coalesce(seq, -9223372036854775808), coalesce(replay_cursor, -9223372036854775808), snapshot_id)) AS cur FROM (
        SELECT {_IDENT.format('run_id')} AS run, seq, replay_cursor, snapshot_id, try_cast(state_json AS JSON) AS j FROM snapshot_envelopes) WHERE run IS NOT NULL AND json_type(CASE WHEN json_type(j) = 'VARCHAR' THEN try_cast(j->>'$' AS JSON) ELSE j END) = 'OBJECT' GROUP BY 1),
        com AS (SELECT {_IDENT.format('run_id')} AS run, max(last_durable_sequence) AS last FROM commit_markers WHERE last_durable_sequence IS NOT NULL GROUP BY 1),
        e AS (SELECT {_IDENT.format('run_id')} AS run, sequence AS seq, {_IDENT.format('op_kind')} AS kind FROM event_envelopes)
        SELECT e.run AS run_id, kind AS op_kind, count(*) AS n FROM e LEFT JOIN snap ON snap.run = e.run LEFT JOIN com ON com.run = e.run WHERE e.run IS NOT NULL AND seq IS NOT NULL AND (cur IS NULL OR seq > cur) AND (last IS NULL OR seq <= last) GROUP BY 1, 2""",
    "graph_components": f"""WITH RECURSIVE l AS (SELECT {_REF.format('source')} AS a, {_REF.format('target')} AS b FROM impact_links), n AS (SELECT a AS x FROM l WHERE a IS NOT NULL UNION SELECT b FROM l WHERE b IS NOT NULL),
        e AS (SELECT a AS x, b AS y FROM l WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM l WHERE a IS NOT NULL AND b IS NOT NULL), r(x, y) AS (SELECT x, x FROM n UNION SELECT e.y, r.y FROM r JOIN e ON e.x = r.x WHERE r.y < e.y)
        SELECT x AS node, min(y) AS component FROM r GROUP BY 1""",
    "graph_union_sets": f"""WITH RECURSIVE m AS (SELECT DISTINCT row_id::VARCHAR AS o, {_REF.format('x')} AS x FROM (SELECT row_id, unnest(doc_requires) AS x FROM doc_frontmatter)), k AS (SELECT o, x FROM m WHERE x IS NOT NULL),
        e AS (SELECT DISTINCT a.o AS x, b.o AS y FROM k a JOIN k b ON a.x = b.x), r(x, y) AS (SELECT o, o FROM k UNION SELECT e.y, r.y FROM r JOIN e ON e.x = r.x)
        SELECT x AS owner, min(y) AS "group" FROM r GROUP BY 1""",
    "stream_once_only": f"""SELECT delivery_id FROM (SELECT delivery_id, row_number() OVER (PARTITION BY r, sequence, o ORDER BY received_at, delivery_id) AS n
        FROM (SELECT delivery_id, {_IDENT.format('run_id')} AS r, sequence, {_IDENT.format('op_id')} AS o, received_at FROM event_envelopes) WHERE r IS NOT NULL AND sequence IS NOT NULL AND o IS NOT NULL) WHERE n > 1""",
    "scalar_type_keys": "SELECT * FROM (VALUES ('Optional[int]', 'Union[None, int]'), ('int | None', 'Union[None, int]'), ('typing.List[str]', 'list[str]'), ('Union[str, int]', 'Union[int, str]'), ('dict[str, Optional[int]]', 'dict[str, Union[None, int]]')) v(hint, type_key)",
}
