"""The training-data queries in SQL, for comparison; written from the statements, not from the operators."""

from __future__ import annotations

_BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160)"
_IDENT = f"nullif(lower(trim({{}}, {_BLANK})), '')"
_REF = f"nullif(regexp_replace(trim({{}}, {_BLANK}), '^\\./', ''), '')"


def _ident(c: str) -> str:
    return _IDENT.format(c)


def _ref(c: str) -> str:
    return _REF.format(c)


def _readable(table: str, col: str, keep: str) -> str:
    """Rows whose col is a readable object, as j."""
    return f"""(SELECT {keep}, j FROM (
        SELECT {keep}, CASE WHEN json_type(j) = 'VARCHAR' THEN try_cast(j->>'$' AS JSON) ELSE j END AS j
        FROM (SELECT {keep}, try_cast({col} AS JSON) AS j FROM {table})) WHERE json_type(j) = 'OBJECT')"""


def _list(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR json_type({x}) = 'NULL' THEN []::JSON[] WHEN json_type({x}) = 'ARRAY' THEN json_extract({x}, '$[*]') ELSE [{x}] END"


P1 = f"""
WITH art AS {_readable("aspf_artifacts", "artifact_json", "record_id")},
sc AS (SELECT record_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS i FROM (SELECT record_id, {_list("x")} AS l FROM (SELECT record_id, j->'$.boundary_asymmetry_scenario' AS x FROM art))),
side AS (SELECT record_id, i, side, s->side AS s FROM sc, (VALUES ('left'), ('right')) AS v(side)),
step AS (SELECT record_id, i, side, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS k FROM (SELECT record_id, i, side, {_list("x")} AS l FROM (SELECT record_id, i, side, s->'$.basis_path' AS x FROM side))),
cs AS (SELECT record_id, unnest(l) AS c, generate_subscripts(l, 1) - 1 AS i FROM (SELECT record_id, {_list("x")} AS l FROM (SELECT record_id, j->'$.cases' AS x FROM art))),
dims AS (
  SELECT record_id, i, c->>'$.case_id' AS cid, n, c->'$.dimensions'->n AS dim FROM (SELECT *, unnest(json_keys(c, '$.dimensions')) AS n FROM cs WHERE json_type(c, '$.dimensions') = 'OBJECT')
  UNION ALL
  SELECT record_id, i, cid, dim->>'$.name', dim FROM (SELECT record_id, i, c->>'$.case_id' AS cid, unnest(json_extract(c, '$.dimensions[*]')) AS dim FROM cs WHERE json_type(c, '$.dimensions') = 'ARRAY')),
pay AS {_readable("event_envelopes", "payload_json", "delivery_id")},
val AS (SELECT delivery_id, coalesce(j->>'$.key', '') AS key, CASE WHEN json_type(j, '$.value') = 'ARRAY' THEN json_extract(j, '$.value[*]') ELSE {_list("(j->'$.value.sites')")} END AS l FROM pay),
site AS (SELECT * FROM (SELECT delivery_id, key, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS i FROM val) WHERE json_type(s) = 'OBJECT'),
param AS (SELECT delivery_id, i, unnest(l) AS p, generate_subscripts(l, 1) - 1 AS k FROM (SELECT delivery_id, i, {_list("x")} AS l FROM (SELECT delivery_id, i, s->'$.params' AS x FROM site)))
SELECT record_id, 'basis_step' AS entity, i || '/' || side AS parent_key, k::BIGINT AS item_index, CASE WHEN json_type(s) = 'OBJECT' THEN s->>'$.key' ELSE s->>'$' END AS item FROM step
UNION ALL SELECT record_id, 'mask', cid || '/' || n, i::BIGINT, dim->>'$.mask' FROM dims WHERE dim->>'$.mask' IS NOT NULL
UNION ALL SELECT delivery_id, 'site', key, i::BIGINT, s->>'$.path' FROM site
UNION ALL SELECT delivery_id, 'site_param', i::VARCHAR, k::BIGINT, p->>'$' FROM param
"""

P2 = f"""
WITH snap AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY seq DESC NULLS LAST, replay_cursor DESC NULLS LAST, snapshot_id DESC) AS n
  FROM (SELECT {_ident("run_id")} AS run, seq, replay_cursor, snapshot_id, j FROM {_readable("snapshot_envelopes", "state_json", "run_id, seq, replay_cursor, snapshot_id")}) WHERE run IS NOT NULL) WHERE n = 1),
com AS (SELECT {_ident("run_id")} AS run, max(last_durable_sequence) AS last FROM commit_markers WHERE last_durable_sequence IS NOT NULL GROUP BY 1),
msg AS (
  SELECT e.run, e.sequence AS seq, e.kind, e.key FROM (SELECT {_ident("run_id")} AS run, sequence, {_ident("op_kind")} AS kind, j->>'$.key' AS key FROM {_readable("event_envelopes", "payload_json", "run_id, sequence, op_kind")}) AS e
  LEFT JOIN snap ON snap.run = e.run LEFT JOIN com ON com.run = e.run
  WHERE e.run IS NOT NULL AND e.sequence IS NOT NULL AND e.kind IN ('set', 'delete') AND e.key <> '' AND (replay_cursor IS NULL OR e.sequence > replay_cursor) AND (last IS NULL OR e.sequence <= last)),
every AS (SELECT run, seq, kind, key, seq AS shown FROM msg UNION ALL SELECT run, -9223372036854775808, 'set', unnest(json_keys(j)), 0 FROM snap)
SELECT run AS run_id, key AS state_key, arg_max(shown, seq)::BIGINT AS sequence FROM every GROUP BY run, key HAVING arg_max(kind, seq) = 'set'
"""

P3 = f"""
SELECT delivery_id FROM (SELECT delivery_id, row_number() OVER (PARTITION BY r, sequence, o ORDER BY received_at, delivery_id) AS n
FROM (SELECT delivery_id, {_ident("run_id")} AS r, sequence, {_ident("op_id")} AS o, received_at FROM event_envelopes) WHERE r IS NOT NULL AND sequence IS NOT NULL AND o IS NOT NULL) WHERE n > 1
"""

P4 = """
WITH once AS (SELECT family, producer, written_at, min(file_id) AS file_id FROM archive_files WHERE written_at IS NOT NULL GROUP BY ALL),
pair AS (SELECT * FROM (SELECT file_id, lag(file_id) OVER (PARTITION BY family, producer ORDER BY written_at) AS before_id FROM once) WHERE before_id IS NOT NULL),
rec AS (
  SELECT file_id, unnest(json_extract(body, '$[*]')) AS r FROM archive_files WHERE json_type(try_cast(body AS JSON)) = 'ARRAY'
  UNION ALL SELECT file_id, try_cast(line AS JSON) FROM (SELECT file_id, unnest(string_split(body, chr(10))) AS line FROM archive_files WHERE json_type(try_cast(body AS JSON)) IS DISTINCT FROM 'ARRAY') WHERE trim(line) <> ''),
leaf AS (
  SELECT file_id, r->>'$.record_key' AS rk, replace(t.fullkey[3:], '"', '') AS f, t.type AS t, CASE WHEN t.type = 'NULL' THEN 'null' ELSE coalesce(t.atom, r->t.fullkey)::VARCHAR END AS v
  FROM rec, json_tree(r) AS t WHERE t.type <> 'OBJECT' AND NOT contains(t.fullkey, '[')),
kinds AS (
  SELECT file_id, f, string_agg(DISTINCT k, ',' ORDER BY k) AS ks FROM (SELECT file_id, f, CASE WHEN t IN ('BIGINT', 'UBIGINT') THEN 'i' WHEN t = 'DOUBLE' THEN 'd' WHEN t = 'NULL' THEN NULL ELSE t END AS k FROM leaf) GROUP BY 1, 2),
lost AS (SELECT p.file_id, p.before_id, k.f FROM pair p JOIN kinds k ON k.file_id = p.before_id WHERE NOT EXISTS (FROM kinds x WHERE x.file_id = p.file_id AND x.f = k.f)),
gain AS (SELECT p.file_id, p.before_id, k.f FROM pair p JOIN kinds k ON k.file_id = p.file_id WHERE NOT EXISTS (FROM kinds x WHERE x.file_id = p.before_id AND x.f = k.f)),
shared AS (SELECT p.file_id, p.before_id, a.rk FROM pair p JOIN (SELECT DISTINCT file_id, rk FROM leaf WHERE rk IS NOT NULL) a ON a.file_id = p.before_id JOIN (SELECT DISTINCT file_id, rk FROM leaf WHERE rk IS NOT NULL) b ON b.file_id = p.file_id AND b.rk = a.rk),
ren AS (
  SELECT l.file_id, l.f AS a, g.f AS b FROM lost l JOIN gain g ON g.file_id = l.file_id JOIN shared s ON s.file_id = l.file_id
  LEFT JOIN leaf x ON x.file_id = l.before_id AND x.rk = s.rk AND x.f = l.f LEFT JOIN leaf y ON y.file_id = l.file_id AND y.rk = s.rk AND y.f = g.f
  GROUP BY ALL HAVING bool_and(x.v IS NOT DISTINCT FROM y.v AND x.t IS NOT DISTINCT FROM y.t) AND bool_or(x.v <> 'null'))
SELECT file_id, a AS old_field, b AS new_field FROM ren
UNION ALL SELECT file_id, f, '' FROM lost l WHERE NOT EXISTS (FROM ren WHERE ren.file_id = l.file_id AND ren.a = l.f)
UNION ALL SELECT file_id, '', f FROM gain g WHERE NOT EXISTS (FROM ren WHERE ren.file_id = g.file_id AND ren.b = g.f)
UNION ALL SELECT p.file_id, a.f, a.f FROM pair p JOIN kinds a ON a.file_id = p.before_id JOIN kinds b ON b.file_id = p.file_id AND b.f = a.f WHERE a.ks <> b.ks
"""

P5 = f"""
WITH rows AS (
  SELECT 'lint_entries' AS t, scope_id, snapshot_no::BIGINT AS n, {_ref("replace(path, chr(92), '/')")} || ':' || line || ':' || col || ':' || upper(trim(code, {_BLANK})) AS k,
    trim(regexp_replace(message, '\\s+', ' ', 'g')) AS a, coalesce(severity, 'warning') AS b, CASE WHEN param IS NULL THEN 'n' ELSE 'v' || param END AS c FROM lint_entries
  UNION SELECT 'advisory_metrics', scope_id, snapshot_no, trim(advisory, {_BLANK}) || '/' || trim(metric_key, {_BLANK}), coalesce(baseline_count, 0)::VARCHAR, coalesce(current_count, 0)::VARCHAR, '' FROM advisory_metrics),
snaps AS (SELECT t, scope_id, n, lag(n) OVER (PARTITION BY t, scope_id ORDER BY n) AS p, lead(n) OVER (PARTITION BY t, scope_id ORDER BY n) AS q FROM (SELECT DISTINCT t, scope_id, n FROM rows)),
cur AS (SELECT r.*, s.n AS pair FROM rows r JOIN snaps s USING (t, scope_id, n) WHERE s.p IS NOT NULL),
old AS (SELECT r.*, s.q AS pair FROM rows r JOIN snaps s USING (t, scope_id, n) WHERE s.q IS NOT NULL)
SELECT coalesce(c.t, o.t) AS source_table, coalesce(c.scope_id, o.scope_id) AS scope_id, coalesce(c.pair, o.pair) AS snapshot_no, coalesce(c.k, o.k) AS record_key,
  CASE WHEN o.k IS NULL THEN 'added' WHEN c.k IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM cur c FULL JOIN old o ON c.t = o.t AND c.scope_id = o.scope_id AND c.pair = o.pair AND c.k = o.k
WHERE o.k IS NULL OR c.k IS NULL OR (c.a, c.b, c.c) IS DISTINCT FROM (o.a, o.b, o.c)
"""

#: A bare ./ isn't blank, and names the empty string.
_TARGET = f"CASE WHEN trim({{}}, {_BLANK}) <> '' THEN regexp_replace(trim({{}}, {_BLANK}), '^\\./', '') END"

P6 = f"""
WITH refs AS (
  SELECT 'impact_links' AS ref_table, link_id AS row_id, {_TARGET.replace("{}", "target")} AS target, NULL AS need, seen_at AS tm FROM impact_links
  UNION ALL SELECT 'doc_requires', row_id, {_TARGET.replace("{}", "x")}, NULL, tm FROM (SELECT row_id, unnest(doc_requires) AS x, published_at AS tm FROM doc_frontmatter)
  UNION ALL SELECT 'doc_reviewed_as_of', row_id, {_TARGET.replace("{}", "e.key")}, e.value, tm FROM (SELECT row_id, unnest(map_entries(doc_reviewed_as_of)) AS e, published_at AS tm FROM doc_frontmatter)),
found AS (
  SELECT r.ref_table, r.row_id, r.target, r.need, r.tm, coalesce(bool_or(n.valid_from <= r.tm AND (n.valid_to IS NULL OR r.tm < n.valid_to)), false) AS alive,
    max(n.revision) FILTER (n.valid_from <= r.tm AND (n.valid_to IS NULL OR r.tm < n.valid_to)) AS rev, coalesce(bool_or(n.valid_to <= r.tm), false) AS ended, bool_or(n.node_id IS NOT NULL) AS known
  FROM refs r LEFT JOIN impact_nodes n ON n.node_id = r.target WHERE r.target IS NOT NULL AND r.tm IS NOT NULL GROUP BY ALL)
SELECT DISTINCT ref_table, row_id, target, CASE WHEN alive THEN 'missing_revision' WHEN ended THEN 'deleted' WHEN known THEN 'late' ELSE 'missing' END AS reason, strftime(tm, '%Y-%m') AS period_month
FROM found WHERE NOT alive OR need > rev
"""

_P7_EDGES = f"""
links AS (SELECT {_ref("source")} AS p, {_ref("target")} AS c FROM impact_links WHERE lower(trim(source_kind)) = 'doc' AND lower(trim(confidence)) = 'explicit'),
docs AS (SELECT c, nullif(split_part(list_filter(list_transform(doc_requires, lambda x: {_ref("x")}), lambda x: x IS NOT NULL)[1], '#', 1), '') AS p
  FROM (SELECT {_ref("doc_path")} AS c, doc_requires, row_number() OVER (PARTITION BY {_ref("doc_path")} ORDER BY doc_revision DESC NULLS LAST, published_at DESC NULLS LAST, row_id DESC) AS n FROM doc_frontmatter) WHERE n = 1 AND c IS NOT NULL),
node AS (SELECT DISTINCT h, n FROM (SELECT 'impact_links' AS h, unnest([p, c]) AS n FROM links UNION ALL SELECT 'doc_requires', unnest([p, c]) FROM docs) WHERE n IS NOT NULL),
edge AS (SELECT h, c, min(p) AS p FROM (SELECT 'impact_links' AS h, c, p FROM links UNION ALL SELECT 'doc_requires', c, p FROM docs) WHERE c IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2)
"""

P7 = f"""
WITH RECURSIVE {_P7_EDGES.strip()},
up(h, n, a, d) AS (SELECT h, n, n, 0 FROM node UNION SELECT u.h, u.n, e.p, least(u.d + 1, 100000) FROM up u JOIN edge e ON e.h = u.h AND e.c = u.a WHERE u.d < 400),
reach AS (SELECT h, n, a, min(d) AS d, count(*) > 1 AS again FROM up GROUP BY ALL),
oncycle AS (SELECT h, n FROM reach WHERE a = n AND again),
cyc AS (SELECT r.h, r.n, min(r.a) AS root FROM reach r JOIN oncycle o ON o.h = r.h AND o.n = r.a GROUP BY 1, 2),
dist AS (SELECT r.h, r.n, min(r.d) AS d FROM reach r JOIN oncycle o ON o.h = r.h AND o.n = r.a GROUP BY 1, 2),
top AS (SELECT h, n, arg_max(a, d) AS root, max(d) AS d FROM reach GROUP BY 1, 2),
below AS (SELECT h, a AS n, count(DISTINCT n) - 1 AS k FROM reach GROUP BY 1, 2)
SELECT v.h AS hierarchy, v.n AS node_name, CASE WHEN o.n IS NOT NULL THEN 'cycle' WHEN c.n IS NOT NULL THEN 'below_cycle' ELSE 'tree' END AS node_class, coalesce(c.root, t.root) AS root_node,
  (CASE WHEN o.n IS NOT NULL THEN 0 WHEN c.n IS NOT NULL THEN s.d ELSE t.d END)::BIGINT AS node_depth, b.k::BIGINT AS descendants
FROM node v LEFT JOIN oncycle o ON o.h = v.h AND o.n = v.n LEFT JOIN cyc c ON c.h = v.h AND c.n = v.n LEFT JOIN dist s ON s.h = v.h AND s.n = v.n JOIN top t ON t.h = v.h AND t.n = v.n JOIN below b ON b.h = v.h AND b.n = v.n
"""

P7_PATHS = P7[: P7.index("SELECT v.h AS hierarchy")] + """
SELECT v.h AS hierarchy, v.n AS node_name, string_agg(r.a, ' > ' ORDER BY r.d DESC) AS path
FROM node v LEFT JOIN oncycle o ON o.h = v.h AND o.n = v.n LEFT JOIN dist s ON s.h = v.h AND s.n = v.n JOIN reach r ON r.h = v.h AND r.n = v.n AND r.d <= CASE WHEN o.n IS NOT NULL THEN 0 ELSE coalesce(s.d, r.d) END
GROUP BY v.h, v.n
"""

P7_DESCENDANTS = P7[: P7.index("oncycle AS")].rstrip().rstrip(",") + """
SELECT DISTINCT h AS hierarchy, a AS node_name, n AS descendant FROM up WHERE a <> n
"""

ORACLES = {"p7_descendants": P7_DESCENDANTS, "p1_found": P1, "p2_found": P2, "p3_found": P3, "p4_found": P4, "p5_found": P5, "p6_found": P6, "p7_found": P7, "p7_paths": P7_PATHS}
