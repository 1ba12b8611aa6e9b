"""Queries of the resolution, evidence, trace, key and fingerprint operators, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import keys
from ledgerloom.functions.text import reference
from ledgerloom.operators import deltas, evidence, fingerprints, graphs, ledger, program, resolution, sets, traces
from ledgerloom.plans.catalogue_sql import _GEO, _LINKS, _MARKERS, _REF
from ledgerloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_T = _REF.format("target")
_S = _REF.format("source")
_TESTS = f"SELECT link_id, {_S} AS test, {_T} AS evidence, confidence FROM impact_links WHERE source_kind = 'test' AND {_S} IS NOT NULL AND {_T} IS NOT NULL"


def _tests(spark, d):
    """Tests and the symbols they name: link_id, test, evidence, confidence."""
    l = table(spark, d, "impact_links").where("source_kind = 'test'")
    return l.select("link_id", reference("source").alias("test"), reference("target").alias("evidence"), "confidence").dropna(subset=["test", "evidence"])


def _functions(spark, d):
    """Symbols package.class.method as functions."""
    at = F.split("node_id", r"\.")
    n = table(spark, d, "impact_nodes").where("node_type = 'symbol'").select("node_id").distinct()
    return n.select(F.col("node_id").alias("fn"), at[0].alias("path"), F.array(at[1]).alias("scope"), at[2].alias("name"))


# Resolution

_F = "f AS (SELECT DISTINCT node_id AS fn, split_part(node_id, '.', 1) AS p, split_part(node_id, '.', 2) AS c, split_part(node_id, '.', 3) AS n FROM impact_nodes WHERE node_type = 'symbol')"


@query(f"""WITH {_F}, l AS (SELECT link_id AS id, test AS src, evidence AS t, confidence AS k FROM ({_TESTS})),
cand AS (SELECT id, 1 AS lv, fn FROM l JOIN f ON k = 'inferred' AND p = split_part(t, '.', 1) AND c = split_part(t, '.', 2) AND n = split_part(t, '.', 3)
  UNION ALL SELECT l.id, 2, f.fn FROM l JOIN (SELECT DISTINCT src AS s, split_part(t, '.', 3) AS a, split_part(t, '.', 1) AS m, split_part(t, '.', 2) || '.' || split_part(t, '.', 3) AS q FROM l WHERE k = 'weak') i ON l.k = 'weak' AND i.s = l.src AND i.a = split_part(l.t, '.', 3) JOIN f ON f.p = i.m AND f.c || '.' || f.n = i.q
  UNION ALL SELECT id, 3, fn FROM l JOIN f ON k NOT IN ('inferred', 'weak') AND fn = t),
lv AS (SELECT id, lv, count(DISTINCT fn) AS n, min(fn) AS fn FROM cand GROUP BY 1, 2),
g AS (SELECT id, min(lv) FILTER (n = 1) AS i, arg_min(fn, lv) FILTER (n = 1) AS fn, min(lv) FILTER (n > 1) AS s FROM lv GROUP BY 1)
SELECT l.id AS call_id, CASE i WHEN 1 THEN 'lexical' WHEN 2 THEN 'import' WHEN 3 THEN 'exact' END AS level, g.fn, coalesce(s < coalesce(i, 9), false) AS ambiguous FROM l LEFT JOIN g ON g.id = l.id""")
def resolve_calls(spark, d):
    """Symbols that tests name: inferred ones by scope, weak ones by the imports of their file, the others by whole name."""
    f, t = _functions(spark, d), _tests(spark, d)
    at = F.split("evidence", r"\.")
    method, owner = F.coalesce(F.get(at, F.lit(2)), F.lit("")), F.coalesce(F.get(at, F.lit(1)), F.lit(""))
    inferred, weak = F.col("confidence") == "inferred", F.col("confidence") == "weak"
    calls = t.select(F.col("link_id").alias("call_id"), F.when(inferred, at[0]).otherwise(F.col("test")).alias("path"), F.when(inferred, F.array(owner)).otherwise(F.array().cast("array<string>")).alias("scope"), F.when(inferred | weak, method).otherwise(F.col("evidence")).alias("name"), "confidence")
    imports = t.where(weak).select(F.col("test").alias("path"), method.alias("alias"), at[0].alias("module"), F.concat_ws(".", owner, method).alias("target"))
    rules = {"lexical": resolution.lexical(calls, f), "import": resolution.imported(calls.where(weak), f, imports), "exact": resolution.exact(calls.where(~(inferred | weak)), f)}
    return resolution.resolve(calls, rules)


@query(f"""WITH RECURSIVE m AS (SELECT DISTINCT split_part(dst, '#', 1) AS c, doc_role AS r FROM ({_LINKS}) JOIN doc_frontmatter ON {_REF.format('doc_path')} = split_part(dst, '#', 1) WHERE doc_role IS NOT NULL),
b AS (SELECT DISTINCT split_part(dst, '#', 1) AS c, split_part(src, '#', 1) AS base FROM ({_LINKS}) WHERE split_part(dst, '#', 1) <> split_part(src, '#', 1)),
own AS (SELECT c FROM m UNION SELECT c FROM b UNION SELECT base FROM b), a(c, x, d) AS (SELECT c, c, 0 FROM own UNION SELECT a.c, b.base, a.d + 1 FROM a JOIN b ON b.c = a.x WHERE a.d < 60),
n AS (SELECT c, x, min(d) AS d FROM a GROUP BY 1, 2), h AS (SELECT n.c, m.r, m.c AS fn, n.d FROM n JOIN m ON m.c = n.x)
SELECT c AS class, r AS method, fn, d::INTEGER AS distance FROM h QUALIFY d = min(d) OVER (PARTITION BY c, r)""")
def resolve_inherited(spark, d):
    """Roles of documents as methods, links between documents as bases: what each document has or inherits from the nearest."""
    from ledgerloom.operators.hierarchy import link_edges

    l = link_edges(table(spark, d, "impact_links")).dropna().select(F.split("child", "#")[0].alias("class"), F.split("parent", "#")[0].alias("base"))
    roles = table(spark, d, "doc_frontmatter").select(reference("doc_path").alias("class"), F.col("doc_role").alias("method")).dropna().distinct()
    methods = roles.join(l.select("class").distinct(), "class", "left_semi").withColumn("fn", F.col("class"))
    return resolution.inherited(methods, l)


@query()
def resolve_type_flow(spark, d):
    """Annotations carried up the links between documents: sections have the type of their name's first word, others none."""
    from ledgerloom.operators.hierarchy import link_edges

    l = link_edges(table(spark, d, "impact_links")).dropna()
    bound = l.select(F.col("parent").alias("caller"), F.lit("p").alias("caller_param"), F.col("child").alias("callee"), F.lit("p").alias("callee_param"))
    leaf = l.select(F.col("child").alias("fn")).distinct().join(l.select(F.col("parent").alias("fn")).distinct(), "fn", "left_anti")
    known = leaf.select("fn", F.lit("p").alias("param"), F.regexp_extract("fn", r"#([a-z]+)", 1).alias("annotation"))
    rest = l.select(F.col("parent").alias("fn")).distinct().select("fn", F.lit("p").alias("param"), F.lit("Any").alias("annotation"))
    return resolution.type_flow(known.unionByName(rest), bound)


# Evidence

@query(f"SELECT evidence, count(DISTINCT test) AS witness_count, min(test) AS first_test, max(test) AS last_test FROM ({_TESTS}) GROUP BY 1")
def evidence_index(spark, d):
    return evidence.evidence_index(_tests(spark, d))


@query("SELECT link_id, confidence FROM impact_links")
def evidence_unique(spark, d):
    """Links under their ids; an id that occurs twice would be an error."""
    return evidence.unique(table(spark, d, "impact_links").select("link_id", "confidence"), "link_id")


@query(f"SELECT test, len(s)::BIGINT AS targets, count(*) OVER (PARTITION BY s) AS alike FROM (SELECT test, list_sort(list(DISTINCT evidence)) AS s FROM ({_TESTS}) GROUP BY 1)")
def evidence_footprints(spark, d):
    """Tests, how many symbols they name, and how many tests name just the same."""
    p = evidence.footprints(_tests(spark, d).select("test", F.col("evidence").alias("target")))
    return p.join(p.groupBy("footprint").agg(F.count("*").alias("alike")), "footprint").select("test", "targets", "alike")


@query(f"""WITH p AS (SELECT test, list_sort(list(DISTINCT evidence)) AS s, bool_or(confidence = 'explicit') AS x FROM ({_TESTS}) GROUP BY 1)
SELECT min(test) AS first_test, count(*) AS tests, len(s)::BIGINT AS targets FROM p WHERE NOT coalesce(x, false) GROUP BY s HAVING count(*) >= 2""")
def evidence_consolidation(spark, d):
    """Groups of tests without explicit links that name just the same symbols."""
    t = _tests(spark, d)
    return evidence.consolidation(evidence.footprints(t.select("test", F.col("evidence").alias("target"))), t.where("confidence = 'explicit'").select("test"))


@query(f"""WITH t AS (SELECT test AS subject, evidence, count(*) AS n FROM ({_TESTS}) GROUP BY 1, 2), a AS (SELECT DISTINCT node_id AS evidence FROM impact_nodes WHERE node_type = 'symbol')
SELECT subject, t.evidence, CASE WHEN n > 1 THEN 'duplicate' WHEN a.evidence IS NOT NULL THEN 'mapped' ELSE 'dead' END AS state FROM t LEFT JOIN a ON a.evidence = t.evidence
UNION ALL SELECT NULL, evidence, 'unmapped' FROM a WHERE evidence NOT IN (SELECT evidence FROM t)""")
def evidence_semantic_coverage(spark, d):
    nodes = table(spark, d, "impact_nodes").where("node_type = 'symbol'").select(F.col("node_id").alias("evidence"))
    none = nodes.limit(0)
    return evidence.coverage(_tests(spark, d).select(F.col("test").alias("subject"), "evidence"), nodes, none)


_RULES = [
    {"column": "source", "needles": ["test_parser", "test_codec"], "excludes": ["phase"], "evidence": "reading"},
    {"column": "source", "needles": ["ledger", "replay"], "evidence": "ledger"},
    {"column": "target", "needles": [".emit", ".fold"], "excludes": ["gone"], "evidence": "output"},
]


@query("""SELECT link_id, CASE WHEN (contains(s, 'test_parser') OR contains(s, 'test_codec')) AND NOT contains(s, 'phase') THEN 'reading' WHEN contains(s, 'ledger') OR contains(s, 'replay') THEN 'ledger'
WHEN (contains(t, '.emit') OR contains(t, '.fold')) AND NOT contains(t, 'gone') THEN 'output' END AS suggestion FROM (SELECT link_id, lower(coalesce(source, '')) AS s, lower(coalesce(target, '')) AS t FROM impact_links)""")
def evidence_suggestions(spark, d):
    return evidence.suggest(table(spark, d, "impact_links"), _RULES).select("link_id", "suggestion")


@query(f"""WITH t AS (SELECT {_REF.format('doc_path')} AS id, doc_authority AS e, doc_role AS k FROM doc_frontmatter WHERE {_REF.format('doc_path')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_REF.format('doc_path')} ORDER BY coalesce(doc_revision, -1) DESC, row_id DESC) = 1),
b AS (SELECT row_id, split_part({_REF.format('x')}, '#', 1) AS t, y FROM (SELECT row_id, doc_requires[1] AS x, doc_requires AS y FROM doc_frontmatter)),
j AS (SELECT row_id, y, t.id, t.e, t.k FROM b LEFT JOIN t ON t.id = b.t)
SELECT row_id AS bundle_id, 'empty_members' AS violation FROM j WHERE coalesce(len(y), 0) = 0 UNION ALL SELECT row_id, 'missing_table' FROM j WHERE id IS NULL
UNION ALL SELECT row_id, 'missing_evidence' FROM j WHERE id IS NOT NULL AND (e IS NULL OR trim(e) = '') UNION ALL SELECT row_id, 'missing_checklist' FROM j WHERE id IS NOT NULL AND (k IS NULL OR trim(k) = '')""")
def evidence_protocol(spark, d):
    """Front matter as bundles, the document of its first requirement as its decision table."""
    f = table(spark, d, "doc_frontmatter")
    best = F.max(F.struct(F.coalesce("doc_revision", F.lit(-1)).alias("r"), "row_id", F.col("doc_authority").alias("evidence"), F.col("doc_role").alias("checklist")))
    tables = f.select(reference("doc_path").alias("table_id"), "doc_revision", "row_id", "doc_authority", "doc_role").dropna(subset=["table_id"]).groupBy("table_id").agg(best.alias("m")).select("table_id", "m.evidence", "m.checklist")
    bundles = f.select(F.col("row_id").alias("bundle_id"), F.split(reference(F.get("doc_requires", F.lit(0))), "#")[0].alias("table_id"), F.col("doc_requires").alias("members"))
    return evidence.protocol_violations(bundles, tables)


@query("""WITH c AS (SELECT c_custkey AS owner, CASE WHEN c_acctbal < 0 THEN 'unmapped' WHEN c_acctbal < 3000 THEN 'redundant_by_evidence' WHEN c_acctbal < 6000 THEN 'active_candidate' ELSE 'new_class' END AS class FROM customer)
SELECT owner, class, CASE class WHEN 'redundant_by_evidence' THEN 0 WHEN 'unmapped' THEN 3 WHEN 'active_candidate' THEN 4 ELSE 5 END::INTEGER AS rank, CASE class WHEN 'redundant_by_evidence' THEN 'remove' WHEN 'unmapped' THEN 'annotate' WHEN 'active_candidate' THEN 'keep' ELSE 'review' END AS action FROM c""")
def evidence_worklist(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("owner"), F.when(F.col("c_acctbal") < 0, "unmapped").when(F.col("c_acctbal") < 3000, "redundant_by_evidence").when(F.col("c_acctbal") < 6000, "active_candidate").otherwise("new_class").alias("class"))
    return evidence.worklist(c)


@query("""WITH r AS (SELECT 'priced' AS rule, coalesce(o_orderstatus = 'F', false) AS t, coalesce(o_totalprice > 50000, false) AS m FROM orders UNION ALL SELECT 'urgent', coalesce(o_orderpriority LIKE '1%', false), coalesce(o_orderstatus <> 'P', false) FROM orders)
SELECT rule, count(*) AS total, count(*) FILTER (t) AS triggered, count(*) FILTER (NOT t) AS untriggered, count(*) FILTER (t AND m) AS met, count(*) FILTER (t AND NOT m) AS unmet FROM r GROUP BY 1""")
def evidence_obligations(spark, d):
    rules = {"priced": (F.col("o_orderstatus") == "F", F.col("o_totalprice") > 50000), "urgent": (F.col("o_orderpriority").startswith("1"), F.col("o_orderstatus") != "P")}
    return evidence.obligation_summary(evidence.obligations(table(spark, d, "orders"), "o_orderkey", rules))


@query("""WITH b AS (SELECT row_id, array_to_string(list_sort(list_distinct(list_filter(doc_requires, lambda x: x IS NOT NULL))), ',') AS b FROM doc_frontmatter WHERE doc_requires IS NOT NULL)
SELECT b AS bundle, count(*) AS tables, count(DISTINCT row_id) AS functions FROM b WHERE b <> '' GROUP BY 1 HAVING count(*) >= 2""")
def evidence_repeated_bundles(spark, d):
    t = table(spark, d, "doc_frontmatter").select(F.col("row_id").alias("fn"), F.array_compact("doc_requires").alias("params"))
    return evidence.repeated_bundles(t)


@query("SELECT code AS bundle, count(*) AS n, count(DISTINCT path) AS files, count(*) FILTER (severity = 'error') AS boundary, count(*) + 2 * count(DISTINCT path) + count(*) FILTER (severity = 'error') AS score FROM lint_entries GROUP BY 1")
def evidence_consolidation_scores(spark, d):
    return evidence.suggestions(table(spark, d, "lint_entries").select(F.col("code").alias("bundle"), F.col("path").alias("file"), (F.col("severity") == "error").alias("boundary")))


@query(f"""WITH r AS (SELECT {_S} AS s, {_T} AS target, CASE confidence WHEN 'explicit' THEN 0 WHEN 'inferred' THEN 1 WHEN 'weak' THEN 2 END AS i FROM impact_links WHERE {_S} IS NOT NULL AND {_T} IS NOT NULL), k AS (SELECT DISTINCT * FROM r WHERE i IS NOT NULL)
SELECT s AS source, target, CASE i WHEN 0 THEN 'explicit' WHEN 1 THEN 'inferred' ELSE 'weak' END AS confidence FROM k QUALIFY i = min(i) OVER (PARTITION BY s)""")
def evidence_link_sources(spark, d):
    """Targets of each source by the most certain kind of link that it has."""
    l = table(spark, d, "impact_links").select(reference("source").alias("source"), reference("target").alias("target"), "confidence").dropna(subset=["source", "target"])
    of = lambda c: l.where(F.col("confidence") == c).drop("confidence")
    return evidence.link_sources(of("explicit"), of("inferred"), of("weak"), ["source"])


# Sets and deltas that have rows where the star schema's have none

@query(f"SELECT evidence, min(test) AS test FROM ({_TESTS}) GROUP BY 1 HAVING count(DISTINCT test) = 1")
def set_last_witness_tests(spark, d):
    h = sets.held_once(_tests(spark, d).select(F.col("test").alias("owner"), F.col("evidence").alias("element")))
    return h.select(F.col("element").alias("evidence"), F.col("owner").alias("test"))


@query(f"SELECT DISTINCT node_id FROM impact_nodes WHERE node_id NOT IN (SELECT {_T} FROM impact_links WHERE {_T} IS NOT NULL)")
def join_anti_nodes(spark, d):
    """Nodes that no link names."""
    named = table(spark, d, "impact_links").select(reference("target").alias("node_id")).dropna()
    return table(spark, d, "impact_nodes").select("node_id").distinct().join(named, "node_id", "left_anti")


@query(f"SELECT DISTINCT node_id FROM impact_nodes WHERE node_id IN (SELECT {_T} FROM impact_links WHERE {_T} IS NOT NULL)")
def join_semi_nodes(spark, d):
    named = table(spark, d, "impact_links").select(reference("target").alias("node_id")).dropna()
    return table(spark, d, "impact_nodes").select("node_id").distinct().join(named, "node_id", "left_semi")


@query("SELECT path, code, min(severity) AS severity, count(*) AS n FROM lint_entries WHERE severity IS NOT NULL GROUP BY 1, 2 HAVING min(severity) = max(severity)")
def agg_constant_severity(spark, d):
    """Codes that a path only ever gets with one severity."""
    g = table(spark, d, "lint_entries").where("severity is not null").groupBy("path", "code").agg(F.min("severity").alias("severity"), F.max("severity").alias("hi"), F.count("*").alias("n"))
    return g.where("severity = hi").drop("hi")


_FOLD = "SELECT user_id, arg_max(event_id, event_id) AS seq, arg_max(value, event_id) AS value FROM events WHERE {} GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'"


@query(f"""WITH a AS ({_FOLD.format('true')}), b AS ({_FOLD.format("ts < TIMESTAMP '2024-01-20'")}) SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def ledger_divergence(spark, d):
    """What a replay that ends early has that the whole one hasn't, and the other way."""
    e = table(spark, d, "events")
    op = F.when(F.col("event_type") == "error", "delete").otherwise("set")
    f = lambda x: ledger.fold(x, ["user_id"], "event_id", op, F.col("value")).select("user_id", "seq", "value")
    return ledger.same_state(f(e), f(e.where("ts < '2024-01-20'")))


@query(f"SELECT count(*) AS rows, 64 AS digits FROM (SELECT 1) WHERE (SELECT count(*) FROM ({_FOLD.format('true')})) > 0")
def ledger_state_digest(spark, d):
    """The digest of the folded state is one row of 64 digits, alike for any order of the ledger."""
    e = table(spark, d, "events")
    op = F.when(F.col("event_type") == "error", "delete").otherwise("set")
    of = lambda x: ledger.state_digest(ledger.fold(x, ["user_id"], "event_id", op, F.col("value")), ["user_id"], "value")
    both = of(e).union(of(e.repartition(7, "value"))).groupBy("digest").agg(F.count("*").alias("n"))
    return both.groupBy(F.length("digest").cast("int").alias("digits")).agg(F.count("*").alias("rows"))


@query("""WITH a AS (SELECT DISTINCT scope_id, code FROM lint_entries WHERE snapshot_no <= 2), b AS (SELECT DISTINCT scope_id, code FROM lint_entries WHERE snapshot_no > 2)
SELECT *, 'removed' AS change_kind FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'added' FROM (FROM b EXCEPT FROM a)""")
def delta_decisions(spark, d):
    """Codes that a scope gained or lost after its first snapshots."""
    l = table(spark, d, "lint_entries")
    return deltas.set_diff(l.where("snapshot_no <= 2"), l.where("snapshot_no > 2"), ["scope_id", "code"])


@query("SELECT DISTINCT path FROM lint_entries WHERE snapshot_no <= 2 AND path IS NOT NULL AND path NOT IN (SELECT path FROM lint_entries WHERE snapshot_no > 2 AND path IS NOT NULL)")
def delta_extinct(spark, d):
    l = table(spark, d, "lint_entries").where("path is not null")
    return deltas.extinct(l.where("snapshot_no <= 2"), l.where("snapshot_no > 2"), ["path"])


_ADVICE = "SELECT scope_id, metric_key, max(current_count) AS v FROM advisory_metrics WHERE snapshot_no {} AND scope_id IS NOT NULL AND metric_key IS NOT NULL GROUP BY 1, 2"


def _advice(spark, d, when):
    return table(spark, d, "advisory_metrics").where(when).dropna(subset=["scope_id", "metric_key"]).groupBy("scope_id", "metric_key").agg(F.max("current_count").alias("v"))


@query(f"WITH a AS ({_ADVICE.format('= 1')}), b AS ({_ADVICE.format('> 1')}) SELECT scope_id, metric_key, a.v AS before, b.v AS after FROM a JOIN b USING (scope_id, metric_key) WHERE b.v < a.v")
def delta_losses(spark, d):
    return deltas.losses(_advice(spark, d, "snapshot_no = 1"), _advice(spark, d, "snapshot_no > 1"), ["scope_id", "metric_key"], "v")


@query(f"WITH a AS ({_ADVICE.format('= 1')}), b AS ({_ADVICE.format('> 1')}) SELECT scope_id, metric_key, coalesce(a.v, 0) AS baseline, b.v AS current, b.v - coalesce(a.v, 0) AS delta FROM b LEFT JOIN a USING (scope_id, metric_key) WHERE b.v - coalesce(a.v, 0) > 3")
def delta_regressions(spark, d):
    return deltas.regressions(_advice(spark, d, "snapshot_no = 1"), _advice(spark, d, "snapshot_no > 1"), ["scope_id", "metric_key"], "v", 3)


@query("SELECT scope_id, coalesce(nullif(trim(severity), ''), 'unknown') AS status, count(*) AS n FROM lint_entries GROUP BY 1, 2")
def delta_state(spark, d):
    return deltas.state(table(spark, d, "lint_entries"), ["scope_id"], "severity")


@query("""WITH c AS (SELECT code, count(*) AS n FROM lint_entries WHERE code IS NOT NULL GROUP BY 1), r AS (SELECT code || ' ' || n AS line, row_number() OVER (ORDER BY n DESC, code) - 1 AS i FROM c)
SELECT i::INTEGER AS place, line FROM r WHERE i < 20 UNION ALL SELECT 20, '... ' || (count(*) - 20) || ' more' FROM r HAVING count(*) > 20""")
def summary_truncation(spark, d):
    """The 20 most frequent codes as lines, and how many more there are."""
    c = table(spark, d, "lint_entries").where("code is not null").groupBy("code").agg(F.count("*").alias("n"))
    return deltas.truncated(c, [F.desc("n"), "code"], F.concat_ws(" ", "code", F.col("n").cast("string")), 20)


@query(f"""WITH n AS (SELECT DISTINCT node_id AS target, node_type FROM impact_nodes), l AS (SELECT {_T} AS target, count(*) AS links FROM impact_links WHERE {_T} IS NOT NULL GROUP BY 1)
SELECT CASE WHEN node_type IS NULL THEN 'unknown' WHEN links IS NULL THEN 'dead' ELSE 'mapped' END AS state, node_type, count(*) AS n, sum(coalesce(links, 0))::BIGINT AS links FROM n FULL JOIN l USING (target) GROUP BY 1, 2""")
def evidence_reference_coverage(spark, d):
    """Referenced nodes by kind: mapped, dead, or named by links only; targets as references."""
    nodes = table(spark, d, "impact_nodes").select(F.col("node_id").alias("target"), "node_type").distinct()
    links = table(spark, d, "impact_links").select(reference("target").alias("target")).dropna().groupBy("target").agg(F.count("*").alias("links"))
    state = F.when(F.col("node_type").isNull(), "unknown").when(F.col("links").isNull(), "dead").otherwise("mapped")
    return nodes.join(links, "target", "full").groupBy(state.alias("state"), "node_type").agg(F.count("*").alias("n"), F.sum(F.coalesce("links", F.lit(0))).alias("links"))


@query(f"SELECT source_kind, {_S} AS source, {_T} AS target, min(CASE confidence WHEN 'explicit' THEN 0 WHEN 'inferred' THEN 1 ELSE 2 END)::BIGINT AS confidence_rank FROM impact_links WHERE {_S} IS NOT NULL AND {_T} IS NOT NULL GROUP BY 1, 2, 3")
def link_best_confidence(spark, d):
    """The most certain confidence of every link between references, explicit before inferred before weak."""
    rank = F.when(F.col("confidence") == "explicit", 0).when(F.col("confidence") == "inferred", 1).otherwise(2).cast("bigint")
    l = table(spark, d, "impact_links").select("source_kind", reference("source").alias("source"), reference("target").alias("target"), rank.alias("r")).dropna(subset=["source", "target"])
    return l.groupBy("source_kind", "source", "target").agg(F.min("r").alias("confidence_rank"))


@query(f"""WITH RECURSIVE e AS (SELECT {_T} AS src, {_S} AS dst, max(CASE confidence WHEN 'explicit' THEN 1.0::DOUBLE WHEN 'inferred' THEN 0.6 ELSE 0.3 END) AS c FROM impact_links WHERE {_S} IS NOT NULL AND {_T} IS NOT NULL GROUP BY 1, 2),
r(node, c, d) AS (SELECT DISTINCT node_id, 1.0::DOUBLE, 0 FROM impact_nodes UNION SELECT e.dst, least(r.c, e.c), r.d + 1 FROM r JOIN e ON e.src = r.node WHERE r.d < 3)
SELECT node, round(max(c), 3) AS confidence, CASE WHEN max(c) >= 0.9 THEN 'must' ELSE 'likely' END AS kind FROM r GROUP BY 1""")
def graph_impact_references(spark, d):
    """Reverse reach from all known nodes over references, a path worth its weakest link; must from 0.9."""
    worth = F.when(F.col("confidence") == "explicit", 1.0).when(F.col("confidence") == "inferred", 0.6).otherwise(0.3)
    l = table(spark, d, "impact_links").select(reference("target").alias("src"), reference("source").alias("dst"), worth.alias("confidence")).dropna(subset=["src", "dst"])
    hit = graphs.strongest_paths(l, table(spark, d, "impact_nodes").select(F.col("node_id").alias("node")), 3)
    return hit.select("node", F.round("confidence", 3).alias("confidence"), F.when(F.col("confidence") >= 0.9, "must").otherwise("likely").alias("kind"))


@query("""WITH l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS no FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS s FROM documents WHERE text IS NOT NULL)),
f AS (SELECT *, regexp_matches(line, '^\\s{0,3}(```|~~~)') AS x FROM l), o AS (SELECT * FROM (SELECT *, sum(x::INT) OVER (PARTITION BY doc_id ORDER BY no) AS k FROM f) WHERE NOT x AND k % 2 = 0),
h AS (SELECT *, CASE WHEN regexp_matches(line, '^#{1,6}\\s+\\S') THEN trim(regexp_replace(line, '^#{1,6}\\s+', '')) END AS t FROM o), c AS (SELECT doc_id, t, last_value(t IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY no) AS heading FROM h)
SELECT doc_id, heading, count(*) AS n FROM c WHERE heading IS NOT NULL AND t IS NULL GROUP BY 1, 2""")
def text_headings_outside_code(spark, d):
    """How many lines stand under each heading of each document, code fences aside."""
    from ledgerloom.sources import text as lines_of

    lines = lines_of.numbered_lines(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    h = lines_of.headings(lines_of.outside_code(lines, "doc_id"), "doc_id").where("heading is not null and not is_heading")
    return h.groupBy("doc_id", "heading").agg(F.count("*").alias("n"))


@query(f"SELECT user_id::VARCHAR AS state_key, seq, value::VARCHAR AS val FROM ({_FOLD.format('true')})")
def stream_state(spark, d):
    """Current state under the stream of events: micro-batches upserted in two runs, one of them twice."""
    from ledgerloom.streaming.ledger import LedgerState

    e = table(spark, d, "events")
    changes = e.select(F.col("user_id").cast("string").alias("state_key"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("dead"), F.col("value").cast("string").alias("val"))
    state = LedgerState(spark, ["state_key"])
    late = F.col("seq") % 2 == 0
    for name, part in (("b", changes.where(late)), ("a", changes.where(~late)), ("b", changes.where(late))):
        state.apply(part, name)
    return state.current().select("state_key", "seq", "val")


@query()
def stream_sessions(spark, d):
    """Sessions of users through a file stream; the watermark leaves the last ones open."""
    from ledgerloom.streaming import ledger as streams

    s = streams.file_stream(spark, f"{d}/events.parquet", table(spark, d, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.run_once(streams.sessions(s, "ts", "12 hours", "1 day", ["user_id"]), "sessions")


_PRIORITIES = "SELECT o_custkey AS owner, list_sort(list(DISTINCT o_orderpriority || '/' || o_orderstatus)) AS s FROM orders GROUP BY 1"


@query(f"SELECT owner, min(owner) OVER (PARTITION BY s) AS stands FROM ({_PRIORITIES})")
def set_jaccard_members(spark, d):
    """Every customer and the one that stands for its set in set_jaccard."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.concat("o_orderpriority", F.lit("/"), "o_orderstatus").alias("element"))
    return sets.class_members(o)


@query("SELECT 'never' AS kind, count(*) AS n FROM lint_entries WHERE severity = 'error' AND line < 10 UNION ALL SELECT 'excess', count(*) FROM (SELECT DISTINCT code FROM lint_entries WHERE code IS NOT NULL AND code NOT IN (SELECT code FROM lint_entries WHERE code IS NOT NULL AND param IS NULL AND line < 5))")
def invariant_kinds(spark, d):
    """Errors in the first lines, a requirement that holds, and codes that the first lines never have without a parameter."""
    from ledgerloom.sources.documents import invariant

    l = table(spark, d, "lint_entries").select("path", "line", "code", "severity", "param")
    found = invariant(l, "never", (F.col("severity") == "error") & (F.col("line") < 10)).unionByName(invariant(l, "require", F.col("line") > 0))
    found = found.unionByName(invariant(l, "cover", F.col("param").isNull() & (F.col("line") < 5), "code", l))
    return found.groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT delivery_id, sequence, run_id, payload_json AS record FROM event_envelopes")
def wire_round_trip(spark, d):
    """Every delivery as a wire message and back."""
    from ledgerloom.sources.wire import from_wire, to_wire

    e = table(spark, d, "event_envelopes").select("delivery_id", "sequence", "run_id", F.col("payload_json").alias("record"))
    return from_wire(to_wire(e, "delivery_id", "event"), "delivery_id", "event")


@query()
def text_front_matter_nested(spark, d):
    """Front matter of documents as canonical JSON, with its lists and maps."""
    from ledgerloom.sources.documents import front_matter_json

    m = table(spark, d, "documents").select("doc_id", front_matter_json("text").alias("front_matter"))
    return m.where("front_matter is not null")


# Graphs

@query(f"WITH RECURSIVE e AS ({_LINKS}), r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b) SELECT DISTINCT a AS node FROM r WHERE a = b")
def graph_recursive(spark, d):
    from ledgerloom.operators.hierarchy import link_edges

    return graphs.recursive(link_edges(table(spark, d, "impact_links")).dropna().select(F.col("parent").alias("src"), F.col("child").alias("dst")))


@query(f"WITH RECURSIVE e AS ({_LINKS}), r(n) AS (SELECT DISTINCT dst FROM e WHERE contains(dst, '#policy') UNION SELECT e.src FROM r JOIN e ON e.dst = r.n) SELECT n AS fn, 'p' AS param FROM r")
def graph_carried_params(spark, d):
    """A parameter of every section on policies, and of all documents that hand theirs on to one."""
    from ledgerloom.operators.hierarchy import link_edges

    l = link_edges(table(spark, d, "impact_links")).dropna()
    bound = l.select(F.col("parent").alias("caller"), F.lit("p").alias("caller_param"), F.col("child").alias("callee"), F.lit("p").alias("callee_param"))
    return graphs.carried(l.where("child like '%#policy%'").select(F.col("child").alias("fn"), F.lit("p").alias("param")), bound)


@query(f"WITH e AS (SELECT DISTINCT * FROM ({_GEO})), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT node, (SELECT count(*) FROM e WHERE src = node) AS dependents, (SELECT count(*) FROM e WHERE dst = node) AS dependencies FROM n")
def graph_neighbours(spark, d):
    from ledgerloom.plans.catalogue import _geo

    e = _geo(spark, d)
    return graphs.neighbours(e, e.select(F.explode(F.array("src", "dst")).alias("node")))


@query("SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) - 1 AS fiber_rank FROM customer")
def graph_fiber_rank(spark, d):
    c = table(spark, d, "customer")
    return graphs.fiber_rank(c, ["c_nationkey"], "c_acctbal", "c_custkey").select("c_nationkey", "c_custkey", "fiber_rank")


@query(f"""WITH e AS ({_GEO}), b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), l0 AS (SELECT DISTINCT src AS node, substr(src, 1, 1) AS l FROM b),
l1 AS (SELECT b.src AS node, x.l || '(' || string_agg(y.l, '' ORDER BY y.l) || ')' AS l, count(*) AS degree FROM b JOIN l0 x ON x.node = b.src JOIN l0 y ON y.node = b.dst GROUP BY b.src, x.l),
l2 AS (SELECT b.src AS node, x.l || '[' || string_agg(y.l, ',' ORDER BY y.l) || ']' AS l, max(x.degree) AS degree FROM b JOIN l1 x ON x.node = b.src JOIN l1 y ON y.node = b.dst GROUP BY b.src, x.l)
SELECT node, degree, count(*) OVER (PARTITION BY l) AS class_size FROM l2""")
def graph_wl_classes(spark, d):
    """Degree and class size of every node after two rounds of refinement."""
    from ledgerloom.plans.catalogue import _geo

    e = _geo(spark, d)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("seed", F.substring("node", 1, 1))
    return graphs.refine_classes(nodes, e, 2).select("node", "degree", "class_size")


@query(f"""WITH e AS ({_GEO}), n AS (SELECT src AS s FROM e UNION SELECT dst FROM e)
SELECT s AS suite, CASE substr(s, 1, 1) WHEN 'r' THEN 0 WHEN 'n' THEN 1 ELSE 2 END::BIGINT AS depth, substr(s, 1, 1) || '|' || lpad(CASE substr(s, 1, 1) WHEN 'r' THEN '0' WHEN 'n' THEN '1' ELSE '2' END, 10, '0') || '|' || lpad(substr(s, 2), 10, '0') || '|0000000001|' || lpad(substr(s, 2), 10, '0') || '|0000000009|' || s AS order_key FROM n""")
def graph_suite_order(spark, d):
    """Regions, nations and customers as nested suites."""
    from ledgerloom.plans.catalogue import _geo

    e = _geo(spark, d)
    no = F.substring("suite", 2, 20).cast("int")
    s = e.select(F.explode(F.array("src", "dst")).alias("suite")).distinct().select("suite", F.substring("suite", 1, 1).alias("path"), F.col("suite").alias("qual"), no.alias("line"), F.lit(1).alias("col"), no.alias("end_line"), F.lit(9).alias("end_col"))
    return graphs.suite_order(s, e)


# Traces and sessions

@query("SELECT event_id, CASE event_type WHEN 'view' THEN 4 ELSE 4 END::INTEGER AS kind_rank FROM events")
def trace_order(spark, d):
    """Events in the order of sequence, kind and line; none of their kinds is a trace's, so all rank last."""
    e = table(spark, d, "events").select("event_id", F.col("event_id").alias("sequence"), F.col("event_type").alias("kind"), F.col("user_id").alias("line"))
    return traces.ordered(e).select("event_id", "kind_rank")


@query("SELECT DISTINCT run_id, op_id FROM event_envelopes")
def trace_merge(spark, d):
    """Traces of late and of early deliveries, each row once."""
    e = table(spark, d, "event_envelopes").select("run_id", "op_id", "delivery_id")
    half = F.col("delivery_id") % 2 == 0
    return traces.merge(e.where(half).select("run_id", "op_id"), e.where(~half).select("run_id", "op_id"))


@query("SELECT user_id, event_id, r::INTEGER AS place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 5")
def trace_tail(spark, d):
    return traces.tail(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", 5)


@query("""WITH o AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r, avg(l_discount) AS a FROM lineitem GROUP BY 1),
k AS (SELECT l_suppkey, 'load_fusion' AS kind, (n >= 500)::INT + (r > 100)::INT + (a > 0.05)::INT AS satisfied, 3 AS total FROM o UNION ALL SELECT l_suppkey, 'reusable_boundary', (r * 3 > n)::INT + (n > 10)::INT, 2 FROM o)
SELECT l_suppkey, kind, satisfied::INTEGER AS satisfied, total::INTEGER AS total, round(satisfied / total, 2) AS confidence FROM k""")
def trace_opportunities(spark, d):
    o = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.avg("l_discount").alias("a"))
    n, r, a = F.col("n"), F.col("r"), F.col("a")
    return traces.opportunities(o, "l_suppkey", {"load_fusion": [n >= 500, r > 100, a > 0.05], "reusable_boundary": [r * 3 > n, n > 10]})


@query("""WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR) AS q FROM events WHERE event_type <> 'error'),
r AS (SELECT user_id, arg_max(event_type, (ts, value::VARCHAR)) AS s, event_id % 10 + 1 AS q FROM (SELECT user_id, ts, value, event_id, 'failed' AS event_type FROM events WHERE event_type = 'error') GROUP BY user_id, event_id % 10 + 1)
SELECT p.user_id AS session, p.q::INTEGER AS sequence, event_id::VARCHAR AS step, coalesce(s, 'prepared') AS status FROM p LEFT JOIN r ON r.user_id = p.user_id AND r.q = p.q""")
def trace_manifest(spark, d):
    """A manifest per user: events prepare steps, errors record that one of the first ten failed."""
    e = table(spark, d, "events")
    error = F.col("event_type") == "error"
    rows = e.select(F.col("user_id").alias("session"), F.col("ts").alias("at"), F.when(error, "record_step").otherwise("prepare_step").alias("kind"), F.when(error, F.col("event_id") % 10 + 1).cast("int").alias("sequence"), F.col("event_id").cast("string").alias("step"), F.when(error, "failed").alias("status"))
    return traces.manifest(rows)


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE -1 END AS k FROM orders), w AS (SELECT *, max(k) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM r)
SELECT o_custkey, o_orderkey, o_orderstatus, reached::INTEGER AS reached FROM w WHERE k < reached""")
def trace_phases(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return traces.phase_regressions(o, ["o_custkey"], "o_orderkey", "o_orderstatus", ["O", "P", "F"])


@query("SELECT event_id, event_id + 1 + (SELECT max(o_orderkey) FROM orders) AS seq FROM events")
def trace_appended(spark, d):
    """Events numbered on from the last order."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"))
    return traces.appended(o, table(spark, d, "events").select("event_id"), ["event_id"])


# Keys and scalars

@query("""SELECT p_partkey, '{"kind":"paramset","name":"' || p_name || '","size":"' || p_size || '"}' AS identity, 'E:paramset::' || p_name || '::' || p_size AS display, 'int=' || p_size AS typed FROM part""")
def key_evidence(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", keys.evidence_key("paramset", name=F.col("p_name"), size=F.col("p_size")).alias("identity"), keys.display("paramset", F.col("p_name"), F.col("p_size").cast("string")).alias("display"), keys.typed(F.col("p_size"), "int").alias("typed"))


@query("SELECT p_partkey, p_brand AS kind, p_name || ',' || p_type AS parts FROM part")
def key_display_round_trip(spark, d):
    p = table(spark, d, "part").select("p_partkey", keys.parse_display(keys.display(F.col("p_brand"), F.col("p_name"), F.col("p_type"))).alias("k"))
    return p.select("p_partkey", "k.kind", F.array_join("k.parts", ",").alias("parts"))


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, 0::BIGINT AS absent FROM events")
def key_nested_int(spark, d):
    return table(spark, d, "events").select("event_id", keys.nested_int("props", "$.k").alias("k"), keys.nested_int("props", "$.no.such").alias("absent"))


@query("SELECT link_id, nullif(regexp_extract(split_part(source, '::', 2), '^test_([A-Za-z0-9]+)', 1), '') AS prefix FROM impact_links WHERE source IS NOT NULL")
def key_test_prefix(spark, d):
    l = table(spark, d, "impact_links").where("source is not null")
    return l.select("link_id", keys.test_prefix(F.coalesce(F.get(F.split("source", "::"), F.lit(1)), F.lit(""))).alias("prefix"))


@query("SELECT * FROM (VALUES ('entries', 'entry'), ('boxes', 'box'), ('classes', 'class'), ('status', 'status'), ('nodes', 'node'), ('glass', 'glass'), ('branches', 'branch')) v(word, singular)")
def key_singular(spark, d):
    return spark.createDataFrame([(w,) for w in "entries boxes classes status nodes glass branches".split()], "word string").select("word", keys.singular("word").alias("singular"))


@query("SELECT * FROM (VALUES ('KeyError', 'LookupError', 'compatible'), ('KeyError', 'ValueError', 'incompatible'), ('OwnError', 'Exception', 'unknown'), ('OSError', 'Exception', 'compatible')) v(raised, caught, fits)")
def key_exceptions(spark, d):
    rows = [("KeyError", "LookupError"), ("KeyError", "ValueError"), ("OwnError", "Exception"), ("OSError", "Exception")]
    return spark.createDataFrame(rows, "raised string, caught string").select("raised", "caught", keys.exception_match("raised", "caught").alias("fits"))


@query("SELECT user_id, 'x' AS a, event_type AS b FROM events")
def key_with_path(spark, d):
    m = keys.with_path(keys.with_path(F.create_map(F.lit("state.a"), F.lit("old")), "state.a", F.lit("x")), "state.b", F.col("event_type"))
    return table(spark, d, "events").select("user_id", m["state.a"].alias("a"), m["state.b"].alias("b"))


# Fingerprints

@query("""SELECT * FROM (VALUES (1, 'base', 'int', 2::BIGINT), (1, 'base', 'str', 1), (1, 'ctor', 'dict', 1), (1, 'ctor', 'list', 1), (2, 'base', 'None', 1), (2, 'base', 'int', 1), (2, 'ctor', 'Union', 1), (3, 'base', 'str', 1)) v(id, dimension, atom, exponent)""")
def fp_dimensions(spark, d):
    hints = [(1, "dict[str, List[int]]"), (2, "Optional[int]"), (3, "str"), (1, "int")]
    h = spark.createDataFrame(hints, "id int, hint string")
    return fingerprints.dimensions(h, "id", "hint")


_FLAGS = "SELECT l_orderkey AS owner, list_sort(list(DISTINCT l_returnflag || l_linestatus)) AS s FROM lineitem GROUP BY 1"
_NAMED = "SELECT l_suppkey || '/' || strftime(l_shipdate, '%Y-%m') AS name, list_sort(list(DISTINCT l_returnflag || l_linestatus)) AS s FROM lineitem GROUP BY 1"


@query(f"WITH o AS ({_FLAGS}), g AS (SELECT s, count(*) AS names FROM ({_NAMED}) GROUP BY 1) SELECT owner, coalesce(names, 0) AS names, CASE WHEN names IS NULL THEN 'warning' WHEN names = 1 THEN 'match' ELSE 'ambiguous' END AS kind FROM o LEFT JOIN g USING (s)")
def fp_glossary(spark, d):
    """Orders' sets of flags against those of suppliers' months."""
    key = F.concat("l_returnflag", "l_linestatus").alias("key")
    l = table(spark, d, "lineitem")
    named = l.select(F.concat_ws("/", F.col("l_suppkey").cast("string"), F.date_format("l_shipdate", "yyyy-MM")).alias("name"), key)
    return fingerprints.glossary_matches(l.select(F.col("l_orderkey").alias("owner"), key), named)


@query(f"SELECT len(s)::BIGINT AS members, min(owner) AS first_owner, count(*) AS owners FROM ({_FLAGS}) GROUP BY s HAVING count(*) >= 3")
def fp_recurring(spark, d):
    l = table(spark, d, "lineitem")
    return fingerprints.recurring(l.select(F.col("l_orderkey").alias("owner"), F.concat("l_returnflag", "l_linestatus").alias("key")), 3)


@query("SELECT true AS sound")
def fp_sound(spark, d):
    from ledgerloom.plans.catalogue import _flag_counts

    return fingerprints.sound(_flag_counts(spark, d, "O"), _flag_counts(spark, d, "F"))


# Programs

@query(f"SELECT min(test) AS cluster, count(*) AS tests, len(s)::BIGINT AS targets FROM (SELECT test, list_sort(list(DISTINCT evidence)) AS s FROM ({_TESTS}) GROUP BY 1) GROUP BY s HAVING count(*) >= 2")
def program_call_clusters(spark, d):
    return program.call_clusters(_tests(spark, d).select("test", F.col("evidence").alias("target")))


@query(f"""WITH u AS (SELECT DISTINCT node_id AS i, split_part(node_id, '.', 2) AS disp FROM impact_nodes WHERE node_type = 'symbol'), s AS (SELECT disp, count(DISTINCT i) AS n FROM u GROUP BY 1),
t AS (SELECT test, CASE WHEN confidence = 'weak' THEN split_part(evidence, '.', 2) ELSE evidence END AS tag FROM ({_TESTS}))
SELECT test, tag, CASE WHEN tag IN (SELECT i FROM u) THEN 'ok' WHEN n = 1 THEN 'legacy_tag' WHEN n > 1 THEN 'legacy_ambiguous' ELSE 'orphaned' END AS status FROM t LEFT JOIN s ON s.disp = tag""")
def program_annotation_drift(spark, d):
    t = _tests(spark, d)
    tags = t.select("test", F.when(F.col("confidence") == "weak", F.split("evidence", r"\.")[1]).otherwise(F.col("evidence")).alias("tag"))
    return program.annotation_drift(tags, _functions(spark, d).select(F.col("fn").alias("identity"), F.col("scope")[0].alias("display")))


_BUNDLES = "SELECT scope_id AS path, row_id AS fn, list_filter(doc_requires, lambda x: x IS NOT NULL) AS b FROM doc_frontmatter WHERE doc_requires IS NOT NULL"


def _bundles(spark, d):
    return table(spark, d, "doc_frontmatter").where("doc_requires is not null").select(F.col("scope_id").alias("path"), F.col("row_id").alias("fn"), F.array_compact("doc_requires").alias("bundle"))


@query(f"SELECT count(DISTINCT path) AS files, count(DISTINCT (path, fn)) FILTER (path IS NOT NULL) AS functions, count(*) AS bundles, avg(len(b)) AS mean_size, max(len(b))::INTEGER AS max_size FROM ({_BUNDLES}) WHERE len(b) > 0")
def program_structure_metrics(spark, d):
    return program.structure_metrics(_bundles(spark, d))


@query(f"SELECT 'bundle' AS kind, count(*) AS uses FROM (SELECT list_sort(list_distinct(b)) AS s FROM ({_BUNDLES})) GROUP BY s HAVING count(*) >= 2 UNION ALL SELECT 'function', count(*) FROM (SELECT path, fn, list_sort(list(array_to_string(list_sort(list_distinct(b)), ','))) AS s FROM ({_BUNDLES}) GROUP BY 1, 2) GROUP BY s HAVING count(*) >= 2")
def program_structure_reuse(spark, d):
    return program.structure_reuse(_bundles(spark, d)).select("kind", "uses")


@query("SELECT n_name AS source, c_name AS target, r_name || '>' || n_name || '>' || c_name AS basis FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey")
def program_compose(spark, d):
    """Steps from regions to nations and on to customers, stitched where they meet."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    first = n.select(F.col("n_name").alias("source"), F.col("n_nationkey").alias("target"), F.array("r_name", "n_name").alias("basis"))
    second = table(spark, d, "customer").join(n.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_nationkey").alias("source"), F.col("c_name").alias("target"), F.array("n_name", "c_name").alias("basis"))
    return program.compose(first, second).select("source", "target", F.array_join("basis", ">").alias("basis"))


@query("SELECT count(*) = count(DISTINCT b) AS injective, count(*) = count(DISTINCT a) AS functional FROM (SELECT DISTINCT c_custkey AS a, c_nationkey AS b FROM customer)")
def program_faithful(spark, d):
    return program.faithful(table(spark, d, "customer").select(F.col("c_custkey").alias("domain"), F.col("c_nationkey").alias("image")))


@query("""WITH a AS (SELECT o_custkey AS s, min(o_orderpriority) AS r FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS s, min(o_orderpriority) AS r FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT coalesce(a.s, b.s) AS surface, CASE WHEN a.r IS NULL OR b.r IS NULL THEN 'missing' WHEN a.r = b.r THEN 'non_drift' WHEN least(a.r, b.r) = '1-URGENT' AND greatest(a.r, b.r) = '2-HIGH' THEN 'linked' ELSE 'drift' END AS classification FROM a FULL JOIN b ON a.s = b.s""")
def program_drift(spark, d):
    """Customers' first priorities in closed and in open orders; the two highest are witnessed to be one."""
    o = table(spark, d, "orders")
    of = lambda w: o.where(w).groupBy(F.col("o_custkey").alias("surface")).agg(F.min("o_orderpriority").alias("representative"))
    w = spark.createDataFrame([("2-HIGH", "1-URGENT")], "left string, right string")
    return program.drift(of("o_orderstatus = 'F'"), of("o_orderstatus <> 'F'"), w)


# Guards, registries, rollups

@query("""SELECT * FROM (VALUES ('f', 1, 'VIOLATION'), ('g', 2, 'PROVEN_UNREACHABLE'), ('h', 3, 'OBLIGATION'), ('k', 4, 'OBLIGATION')) v(fn, site, status)""")
def guard_never_invariants(spark, d):
    """Never-marks under the constants of their calls; one guard asks a call, one function is never called."""
    from ledgerloom.operators import guards

    marks = spark.createDataFrame([("f", 1, "flag and not other"), ("g", 2, "n > 3 or flag"), ("h", 3, "flag and ready()"), ("k", 4, "x == 1")], "fn string, site int, guard string")
    calls = [("f", {"flag": True, "other": False}), ("f", {"flag": False}), ("g", {"n": 2, "flag": False}), ("h", {"flag": True})]
    import json

    return guards.never_invariants(marks, spark.createDataFrame([(f, json.dumps(e)) for f, e in calls], "fn string, env string"))


@query("""SELECT o_orderpriority AS fn, CAST(o_orderkey AS BIGINT) AS site, CASE WHEN o_totalprice > 100000 AND o_orderstatus <> 'F' THEN 'VIOLATION' ELSE 'PROVEN_UNREACHABLE' END AS status FROM orders""")
def guard_orders(spark, d):
    """A guard of its own for every order, under the one constant that its priority passes."""
    from ledgerloom.operators import guards

    o = table(spark, d, "orders")
    guard = F.concat(F.col("o_totalprice").cast("string"), F.lit(" > limit and '"), "o_orderstatus", F.lit("' != 'F'"))
    calls = o.select(F.col("o_orderpriority").alias("fn"), F.lit('{"limit": 100000}').alias("env")).distinct()
    return guards.never_invariants(o.select(F.col("o_orderpriority").alias("fn"), F.col("o_orderkey").alias("site"), guard.alias("guard")), calls)


@query("""SELECT * FROM (VALUES ('f', 1, 'DEAD'), ('g', 2, 'FORBIDDEN'), ('h', 3, 'UNKNOWN')) v(fn, site, status)""")
def guard_exceptions(spark, d):
    from ledgerloom.operators import guards

    raises = spark.createDataFrame([("f", 1, "not ok", False), ("g", 2, "ok", False), ("h", 3, "len(x) > 1", False), ("h", 4, "ok", True)], "fn string, site int, guard string, never boolean")
    return guards.exception_obligations(raises, spark.createDataFrame([("f", '{"ok": true}'), ("g", '{"ok": true}'), ("h", "{}")], "fn string, env string"))


@query("SELECT p_type AS key, row_number() OVER (ORDER BY min(p_partkey), p_type) - 1 AS bit, [2, 3, 5, 7, 11, 13, 17, 19, 23, 29][row_number() OVER (ORDER BY min(p_partkey), p_type)]::BIGINT AS prime FROM part GROUP BY 1")
def fp_registry(spark, d):
    """Part types numbered as they are first seen, each with its prime."""
    return fingerprints.with_primes(fingerprints.registry_by_first_seen(table(spark, d, "part"), "p_type", "p_partkey"))


@query("""WITH e AS (SELECT l_orderkey AS owner, l_returnflag || l_linestatus AS k, count(*) AS n FROM lineitem GROUP BY 1, 2), c AS (SELECT owner, string_agg(k || '^' || n, '*' ORDER BY k) AS canonical FROM e GROUP BY 1)
SELECT owner, canonical, 'fp:' || substr(sha256(canonical), 1, 16) AS digest FROM c""")
def fp_identity_layers(spark, d):
    return fingerprints.identity_layers(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("owner"), F.concat("l_returnflag", "l_linestatus").alias("key")))


@query("SELECT path, code, grouping(path, code)::BIGINT AS level, count(*) AS n, sum(line)::BIGINT AS total FROM lint_entries GROUP BY ROLLUP (path, code)")
def trace_rollup(spark, d):
    """Lines summed by path and code, by path, and in all."""
    return traces.rollup(table(spark, d, "lint_entries").select("path", "code", "line"), ["path", "code"], "line")


@query(f"SELECT evidence AS representative, count(DISTINCT confidence) AS surfaces, count(DISTINCT test) AS witnesses, min(test) AS first_witness FROM ({_TESTS}) GROUP BY 1")
def trace_witnesses(spark, d):
    return traces.witnesses(_tests(spark, d).select(F.col("evidence").alias("representative"), F.col("confidence").alias("surface"), F.col("test").alias("witness")))


@query("SELECT p_type AS kind, p_partkey AS plan_id, CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'LARGE' THEN 1 ELSE 2 END::INTEGER AS kind_rank FROM part")
def trace_plan_order(spark, d):
    return traces.plan_order(table(spark, d, "part").select(F.col("p_type").alias("kind"), F.col("p_partkey").alias("plan_id")), ["ECONOMY", "LARGE"])


@query("SELECT count(*) AS refs, count(*) FILTER (target IS NULL OR trim(target) = '') AS opaque FROM impact_links")
def evidence_opaque(spark, d):
    return evidence.opaque(table(spark, d, "impact_links").select(F.col("target").alias("key")))


@query("SELECT row_id AS fn, (i - 1)::INTEGER AS position, x[i] AS param, concat_ws('::', 'E:decision_surface', row_id::VARCHAR, x[i]) AS evidence FROM (SELECT row_id, doc_requires AS x, unnest(generate_series(1, len(doc_requires))) AS i FROM doc_frontmatter)")
def evidence_decision_table(spark, d):
    return evidence.decision_table(table(spark, d, "doc_frontmatter").select(F.col("row_id").alias("fn"), F.col("doc_requires").alias("params")))


@query("SELECT DISTINCT 'lint' AS source, path AS subject, code AS kind FROM lint_entries UNION SELECT 'advice', scope_id, advisory FROM advisory_metrics")
def evidence_markers(spark, d):
    l, a = table(spark, d, "lint_entries"), table(spark, d, "advisory_metrics")
    return evidence.marker_rows(lint=l.select(F.col("path").alias("subject"), F.col("code").alias("kind")), advice=a.select(F.col("scope_id").alias("subject"), F.col("advisory").alias("kind")))


@query(f"WITH RECURSIVE e AS ({_LINKS}), r(n) AS (SELECT DISTINCT src FROM e WHERE contains(src, '#policy') UNION SELECT e.dst FROM r JOIN e ON e.src = r.n) SELECT n AS node FROM r")
def graph_trusted(spark, d):
    """Sections on policies and all that lies below them."""
    from ledgerloom.operators.hierarchy import link_edges

    l = link_edges(table(spark, d, "impact_links")).dropna().select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    return graphs.trusted(l, l.where("src like '%#policy%'").select(F.col("src").alias("node")))


@query("SELECT DISTINCT x AS src, row_id::VARCHAR AS dst FROM (SELECT row_id, unnest(doc_requires) AS x FROM doc_frontmatter) WHERE trim(x) <> ''")
def graph_blockers(spark, d):
    return graphs.blockers(table(spark, d, "doc_frontmatter").select(F.col("row_id").cast("string").alias("node"), F.col("doc_requires").alias("blockers")))[1]


@query(f"WITH m AS ({_MARKERS}) SELECT profile, status, count(*) AS n FROM m WHERE status <> 'resolved' GROUP BY 1, 2")
def taint_incidents(spark, d):
    from ledgerloom.operators import taint
    from ledgerloom.plans.catalogue import _markers

    return taint.incidents(_markers(spark, d))


#: A small program whose facts are plain to read.
SAMPLE = {
    "app/core.py": """
def merge(left, right, mode):
    if mode:
        return join(left, right)
    return join(left, right, sep=",")

def join(a, b, sep="-"):
    return pack(a, b)

def pack(x, y):
    return (x, y)

def unused(value, spare):
    return value
""",
    "app/other.py": """
def pack(x):
    return x

def caller(p, q):
    merge(p, q, True)
    unused(p, q)
    return pack(p)
""",
    "tests/test_core.py": """
def test_merge():
    assert merge(1, 2, False)
""",
}


def _pinned(columns: str, rows: str) -> str:
    """SQL of fixed rows, one a line, with values between bars."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(v.strip() for v in r.split('|')) + ')' for r in rows.strip().splitlines())}) v({columns})"


def _facts(spark):
    from ledgerloom.sources import python_code

    return python_code.scan(spark.createDataFrame(sorted(SAMPLE.items()), "path string, source string"))


@query(_pinned("path, kind, n", """
'app/core.py' | 'call' | 3::BIGINT
'app/core.py' | 'decision' | 1
'app/core.py' | 'function' | 4
'app/core.py' | 'param_use' | 10
'app/other.py' | 'call' | 3
'app/other.py' | 'function' | 2
'app/other.py' | 'param_use' | 3
'tests/test_core.py' | 'call' | 1
'tests/test_core.py' | 'function' | 1
'tests/test_core.py' | 'test' | 1
"""))
def program_facts(spark, d):
    """Facts of the sample program by file and kind."""
    return _facts(spark).groupBy("path", "kind").agg(F.count("*").alias("n"))


@query(_pinned("caller, callee, confidence, inferred", """
'app/core.py::join' | 'app/core.py::pack' | 0.5::DOUBLE | true
'app/core.py::join' | 'app/other.py::pack' | 0.5 | true
'app/core.py::merge' | 'app/core.py::join' | 1.0 | false
'app/other.py::caller' | 'app/core.py::merge' | 1.0 | false
'app/other.py::caller' | 'app/core.py::pack' | 0.5 | true
'app/other.py::caller' | 'app/core.py::unused' | 1.0 | false
'app/other.py::caller' | 'app/other.py::pack' | 0.5 | true
'tests/test_core.py::test_merge' | 'app/core.py::merge' | 1.0 | false
"""))
def program_call_edges(spark, d):
    return program.call_edges(_facts(spark)).select("caller", "callee", F.round("confidence", 3).alias("confidence"), "inferred")


@query(_pinned("caller, name, candidates", """
'app/core.py::join' | 'pack' | 2::BIGINT
'app/other.py::caller' | 'pack' | 2
"""))
def program_call_ambiguities(spark, d):
    return program.call_ambiguities(_facts(spark))


@query(_pinned("fn, bundle", """
'app/core.py::join' | 'a,b'
'app/core.py::merge' | 'left,right'
"""))
def program_signature_groups(spark, d):
    return program.signature_groups(_facts(spark)).select("fn", F.array_join("bundle", ",").alias("bundle"))


@query(_pinned("caller, caller_param, callee, callee_param", """
'app/core.py::merge' | 'left' | 'app/core.py::join' | 'a'
'app/core.py::merge' | 'right' | 'app/core.py::join' | 'b'
'app/other.py::caller' | 'p' | 'app/core.py::merge' | 'left'
'app/other.py::caller' | 'p' | 'app/core.py::unused' | 'value'
'app/other.py::caller' | 'q' | 'app/core.py::merge' | 'right'
'app/other.py::caller' | 'q' | 'app/core.py::unused' | 'spare'
"""))
def program_bindings(spark, d):
    return program.bindings(_facts(spark))


@query(_pinned("fn, param, bundle_id", """
'app/core.py::join' | 'a' | 'app/core.py::join#a'
'app/core.py::join' | 'b' | 'app/core.py::join#a'
'app/core.py::merge' | 'left' | 'app/core.py::merge#left'
'app/core.py::merge' | 'right' | 'app/core.py::merge#left'
'app/other.py::caller' | 'p' | 'app/other.py::caller#p'
'app/other.py::caller' | 'q' | 'app/other.py::caller#p'
"""))
def program_bundles(spark, d):
    """Bundles of the sample program carried to its callers."""
    f = _facts(spark)
    return program.propagate_bundles(program.signature_groups(f), program.bindings(f))


@query(_pinned("fn, params, callers, tier", """
'app/core.py::merge' | 'mode' | 2::BIGINT | 'internal'
"""))
def program_decision_surfaces(spark, d):
    return program.decision_surfaces(_facts(spark)).select("fn", F.array_join("params", ",").alias("params"), "callers", "tier")


@query(_pinned("fn, confidence, kind", """
'tests/test_core.py::test_merge' | 1.0::DOUBLE | 'must'
"""))
def program_impact(spark, d):
    """Tests that a change of the innermost function may reach."""
    return program.impact(_facts(spark), spark.createDataFrame([("app/core.py", 7, 8)], "path string, start int, end int"))


@query(_pinned("path, callee, param, value, calls", """
'app/core.py' | 'join' | 'sep' | concat(chr(39), ',', chr(39)) | 1::BIGINT
'app/core.py' | 'merge' | 'mode' | 'True' | 1
"""))
def program_constant_flow(spark, d):
    from ledgerloom.sources import python_code

    return python_code.constant_flow(_facts(spark))


@query(_pinned("callee, param, path, qual", """
'unused' | 'spare' | 'app/other.py' | 'caller'
"""))
def program_unused_arguments(spark, d):
    from ledgerloom.sources import python_code

    return python_code.unused_arguments(_facts(spark))
