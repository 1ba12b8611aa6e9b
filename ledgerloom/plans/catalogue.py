"""One query per operator of the engine, over the star-schema and event tables; SQL counterparts are in catalogue_sql."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalars
from ledgerloom.functions.text import identifier, reference
from ledgerloom.operators import changefeed, deltas, fingerprints, graphs, joins, ledger, series, sets, taint
from ledgerloom.plans.compile import apply_spec
from ledgerloom.plans.registry import PREDICATES, SPECS
from ledgerloom.plans.spec import Op, Spec, identity
from ledgerloom.session import join_measured, table
from ledgerloom.sources import text as lines_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _spec(name: str, *ops: tuple[str, dict], **params) -> Spec:
    return Spec(name, tuple(Op(o, p) for o, p in ops), "catalogue", params)


_LOCAL = {
    "big_value": lambda df, p: F.col("value") > p.get("least", 50),
    "is_purchase": lambda df, p: F.col("event_type") == "purchase",
    "status_in": lambda df, p: F.col("o_orderstatus").isin(*p["statuses"]),
}

# Projection algebra


@query
def proj_flagship(spark, d):
    """Project, group, keep groups of several, order, cut."""
    spec = _spec("flagship", ("project", {"fields": ["event_type", "user_id"]}), ("count_by", {"field": "event_type"}), ("select", {"predicates": ["count_gt_1"]}), ("sort", {"by": [{"field": "count", "order": "desc"}, "event_type"]}), ("limit", {"count": 10}))
    return apply_spec(spec, table(spark, d, "events"), PREDICATES)


@query
def proj_select(spark, d):
    spec = _spec("select", ("select", {"predicates": ["big_value", "unknown_name"]}), ("select", {"predicate": "is_purchase"}), ("project", {"fields": ["event_id", "user_id", "value"]}), least=90)
    return apply_spec(spec, table(spark, d, "events"), _LOCAL)


@query
def proj_project(spark, d):
    spec = _spec("project", ("project", {"fields": ["o_orderkey", "o_orderstatus", "absent", "o_orderkey"]}))
    return apply_spec(spec, table(spark, d, "orders"))


@query
def proj_count_by(spark, d):
    return apply_spec(_spec("count_by", ("count_by", {"fields": ["l_returnflag", "l_linestatus"]})), table(spark, d, "lineitem"))


@query
def proj_having(spark, d):
    spec = _spec("having", ("count_by", {"fields": ["l_suppkey", "l_partkey"]}), ("select", {"predicates": ["count_gt_1"]}))
    return apply_spec(spec, table(spark, d, "lineitem"), PREDICATES)


@query
def proj_traverse_index(spark, d):
    spec = _spec("traverse", ("traverse", {"field": "embedding", "index": "position", "as": "weight"}), ("project", {"fields": ["vec_id", "position", "weight"]}))
    return apply_spec(spec, table(spark, d, "embeddings"))


@query
def proj_traverse_merge(spark, d):
    """Struct elements parsed from JSON, merged into the row with a prefix."""
    e = table(spark, d, "events").withColumn("props_list", F.array(F.from_json("props", "k bigint")))
    spec = _spec("merge", ("traverse", {"field": "props_list", "prefix": "prop_", "index": "prop_index"}), ("project", {"fields": ["event_id", "prop_index", "prop_k"]}))
    return apply_spec(spec, e)


@query
def proj_sort_limit(spark, d):
    """Two sorts compose stably: the later one leads."""
    spec = _spec("sort", ("sort", {"by": "o_orderkey"}), ("sort", {"by": [{"field": "o_totalprice", "order": "desc"}]}), ("limit", {"count": "25"}), ("project", {"fields": ["o_orderkey", "o_totalprice"]}))
    return apply_spec(spec, table(spark, d, "orders"))


@query
def proj_params_override(spark, d):
    spec = _spec("params", ("select", {"predicates": ["status_in"]}), ("project", {"fields": ["o_orderkey", "o_orderstatus"]}), statuses=["F"])
    return apply_spec(spec, table(spark, d, "orders"), _LOCAL, {"statuses": ["O", "P"]})


@query
def spec_lint_findings(spark, d):
    return apply_spec(SPECS["lint_findings"], table(spark, d, "lint_entries"), PREDICATES)


@query
def spec_ambiguity_virtual_set(spark, d):
    """The registered spec of sets with more than one candidate, over lint sites as suites."""
    e = table(spark, d, "lint_entries").select(F.col("path").alias("suite_path"), F.col("code").alias("suite_qual"), F.col("severity").alias("suite_kind"), F.col("line").alias("span_line"), F.col("col").alias("span_col"), F.col("line").alias("span_end_line"), F.col("col").alias("span_end_col"))
    return apply_spec(SPECS["ambiguity_virtual_set"], e, PREDICATES)


@query
def spec_call_cluster_summary(spark, d):
    e = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("identity")).agg(F.countDistinct("l_partkey").alias("count")).withColumn("display", F.concat(F.lit("supplier "), F.col("identity").cast("string")))
    return apply_spec(SPECS["call_cluster_summary"], e, PREDICATES)


@query
def spec_identities(spark, d):
    """Digest of the identity of every registered spec: the canonical text is a fixed value of the registry."""
    return spark.createDataFrame([(n, identity(s)) for n, s in sorted(SPECS.items())], "name string, spec_id string")


# Aggregates


@query
def agg_conditional(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy("o_orderpriority").agg(*(F.count_if(F.col("o_orderstatus") == s).alias(f"n_{s.lower()}") for s in "FOP"), F.count("*").alias("n"))


@query
def agg_grouping_sets(spark, d):
    """Totals by code, by path and together, as a lint summary has them."""
    e = table(spark, d, "lint_entries").select(F.upper(F.trim("code")).alias("code"), F.coalesce("severity", F.lit("warning")).alias("severity"))
    return e.groupingSets([[], ["code"], ["severity"], ["code", "severity"]], "code", "severity").agg(F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("n"))


@query
def agg_histogram(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines")).groupBy("lines").agg(F.count("*").alias("orders"))


@query
def agg_top_counts(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@query
def agg_distinct_members(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("suppliers"))


@query
def agg_zero_filled(spark, d):
    """Counts of every known status, absent ones as 0."""
    kinds = spark.createDataFrame([(x,) for x in ("F", "O", "P", "X")], "status string")
    n = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return kinds.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query
def agg_constant_values(spark, d):
    """Parameters that only ever get one value: suppliers whose lines all have one tax."""
    g = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.min("l_tax").alias("lo"), F.max("l_tax").alias("hi"), F.count("*").alias("n"))
    return g.where("lo = hi").select("l_suppkey", "l_returnflag", F.col("lo").alias("tax"), "n")


# Sets and evidence


def _baskets(spark, d):
    """Orders and the suppliers' nations on their lines."""
    l, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    return l.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("owner"), F.col("s_nationkey").alias("element"))


@query
def set_bundle_signature(spark, d):
    """Sets shared by at least two orders, with how many share them."""
    g = sets.signatures(_baskets(spark, d)).groupBy("set_id", "n").agg(F.count("*").alias("owners"), F.min("owner").alias("first_owner"))
    return g.where("owners > 1").select("first_owner", F.col("n").alias("members"), "owners")


@query
def set_dominators(spark, d):
    """Customers whose set of order priorities is properly contained in another's, and how many least such sets there are."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.concat("o_orderpriority", F.lit("/"), "o_orderstatus").alias("element"))
    return sets.dominators(o).groupBy("owner").agg(F.count("*").alias("dominators"))


@query
def set_equivalence_pareto(spark, d):
    """Of customers with equal sets the one with the highest balance stands for the others."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.concat("o_orderpriority", F.lit("/"), "o_orderstatus").alias("element"))
    c = sets.signatures(o).join(table(spark, d, "customer").select(F.col("c_custkey").alias("owner"), "c_acctbal"), "owner")
    w = sets.winners(c.select("set_id", "owner", "c_acctbal"), ["set_id"], [-F.col("c_acctbal"), F.col("owner")])
    return w.select("owner", "c_acctbal")


@query
def set_jaccard(spark, d):
    """Representative customers whose sets of priority and status are alike by 0.75."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.concat("o_orderpriority", F.lit("/"), "o_orderstatus").alias("element"))
    return sets.likeness_join(o, 0.75).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query
def set_last_witness(spark, d):
    """Parts that one supplier alone delivers."""
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("element"))
    return sets.held_once(l).select(F.col("element").alias("l_partkey"), F.col("owner").alias("l_suppkey"))


@query
def set_obsolescence(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.concat("o_orderpriority", F.lit("/"), "o_orderstatus").alias("element"))
    return sets.obsolescence(o, table(spark, d, "customer").select(F.col("c_custkey").alias("owner")))


@query
def classify_ladder(spark, d):
    e = table(spark, d, "events")
    ladder = [("error", F.col("event_type") == "error"), ("large", F.col("value") > 80), ("buyer", F.col("event_type") == "purchase")]
    return sets.classify(e, ladder, "other").groupBy("class").agg(F.count("*").alias("n"))


@query
def merge_bundles(spark, d):
    """Greedy agglomeration of sets of part sizes per brand; sequential within a group."""
    import pandas as pd

    p = table(spark, d, "part").select("p_brand", "p_type", "p_size").distinct()
    bundles = p.groupBy("p_brand", "p_type").agg(F.array_sort(F.collect_set(F.col("p_size").cast("string"))).alias("members"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out = sets.merge_greedily([list(m) for m in g["members"]], 0.66)
        return pd.DataFrame({"p_brand": g["p_brand"].iloc[0], "bundle": [",".join(m) for m in out]})

    return bundles.groupBy("p_brand").applyInPandas(run, "p_brand string, bundle string")


# Joins


@query
def join_interval(spark, d):
    """Pairs of a user's events whose spans of time meet, by cells."""
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), F.floor("value").alias("v"))
    side = lambda p: e.select("user_id", F.col("event_id").alias(f"{p}_id"), F.col("s").alias(f"{p}_start"), (F.col("s") + F.col("v") * 60).alias(f"{p}_end"))
    return joins.interval_join(side("a"), side("b"), ["user_id"], 7200).where("a_id < b_id").select("user_id", "a_id", "b_id")


@query
def join_semi(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query
def join_anti(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query
def join_priority_fallback(spark, d):
    """A customer's representative supplier: of the nation, else of the region."""
    c, n, s = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "supplier")
    near = s.select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_suppkey").alias("supp"))
    region = n.select("n_nationkey", "n_regionkey").join(n.select(F.col("n_nationkey").alias("other"), "n_regionkey"), "n_regionkey").join(s, F.col("other") == F.col("s_nationkey")).select("n_nationkey", F.col("s_suppkey").alias("supp"))
    left = c.select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return joins.first_match(left, [near, region], "n_nationkey", "supp").select("c_custkey", "supp", F.col("level").cast("bigint").alias("level"), "hits")


@query
def join_ambiguity(spark, d):
    p = joins.ambiguity(table(spark, d, "part").select("p_partkey", F.substring_index("p_name", " ", 1).alias("short")), "short")
    return p.select("p_partkey", "n", F.round("confidence", 6).alias("confidence"), "inferred")


@query
def join_as_of(spark, d):
    """Each error with the value of the user's last purchase before it."""
    e = table(spark, d, "events")
    left = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return joins.as_of(left, right, ["user_id"], "ts", "value", F.date_trunc("month", "ts")).select("event_id", F.col("asof_value").alias("last_purchase"))


def _near_errors(entries, keys):
    """Info entries with the errors of the same keys within 5 lines of them."""
    e = entries.select(*keys, F.col("line").alias("at"), "severity").distinct()
    spans = e.where("severity = 'error'").select(*keys, (F.col("at") + 5).alias("start"), (F.col("at") - 5).alias("end"), F.col("at").alias("error_line"))
    return joins.point_join(e.where("severity = 'info'").drop("severity"), spans, keys, 50).select(*keys, F.col("at").alias("line"), "error_line")


@query
def join_point_in_span_all(spark, d):
    """Info entries within 5 lines of an error of their path, within each snapshot."""
    return _near_errors(table(spark, d, "lint_entries"), ["scope_id", "snapshot_no", "path"])


# Deltas, gates, trends


def _halves(spark, d):
    """Orders before and from a date: a baseline and a current state that together are the whole table."""
    o = table(spark, d, "orders")
    return o.where("o_orderdate < '1999-01-01'"), o.where("o_orderdate >= '1999-01-01'")


@query
def delta_counts(spark, d):
    a, b = (x.groupBy("o_orderpriority").agg(F.count("*").alias("count")) for x in _halves(spark, d))
    return deltas.count_delta(a, b, ["o_orderpriority"])


@query
def delta_entities(spark, d):
    """Customers of the two halves of the orders: added, removed, or with another number of orders."""
    a, b = (x.groupBy("o_custkey").agg(F.count("*").alias("n")) for x in _halves(spark, d))
    return deltas.entity_delta(a, b, ["o_custkey"], ["n"])


@query
def delta_gate(spark, d):
    a, b = (x.groupBy("o_orderpriority").agg(F.count("*").alias("count")) for x in _halves(spark, d))
    return deltas.count_delta(a, b, ["o_orderpriority"]).select("o_orderpriority", deltas.gate(F.col("delta"), 1, 20).alias("gate"), scalars.format_transition(F.col("baseline"), F.col("current")).alias("shown"))


@query
def ratchet_new(spark, d):
    l = table(spark, d, "lineitem")
    new, _ = deltas.ratchet(l.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey").distinct(), l.where("l_returnflag <> 'R'"), ["l_partkey", "l_suppkey"])
    return new


@query
def structure_diff(spark, d):
    """Multisets of numbers and flags of finished and of open lines."""
    l = table(spark, d, "lineitem").select("l_linestatus", "l_linenumber", "l_returnflag")
    return deltas.multiset_diff(l.where("l_linestatus = 'F'"), l.where("l_linestatus <> 'F'"), ["l_linenumber", "l_returnflag"])


@query
def gap_score(spark, d):
    e = table(spark, d, "lint_entries").groupBy("scope_id", F.coalesce("severity", F.lit("warning")).alias("severity")).agg(F.count("*").alias("n"))
    w = F.when(F.col("severity") == "error", 10.0).when(F.col("severity") == "warning", 4.0).otherwise(1.0)
    return deltas.penalty_score(e.withColumn("w", w), ["scope_id"], "w", "n")


def _daily(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count_if(F.col("value") > 95).alias("hits"))


def _shown(df):
    return df.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query
def trend_recurrence(spark, d):
    return _shown(series.recurrence(_daily(spark, d), ["event_type"], "day", "hits", 7))


@query
def trend_correction(spark, d):
    return _shown(series.runs_since(_daily(spark, d), ["event_type"], "day", "hits"))


@query
def trend_slo(spark, d):
    r = series.recurrence(_daily(spark, d), ["event_type"], "day", "hits", 7)
    return series.within_target(r, ["event_type"], "rate", "trend", 0.5)


@query
def order_violation(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return series.violations(o, ["o_custkey"], "o_orderkey", "o_totalprice")


@query
def determinism_duplicates(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


# Ledgers


@query
def ledger_fold(spark, d):
    """Last writer wins per user; an error deletes."""
    e = table(spark, d, "events")
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "noop").otherwise("set")
    return ledger.fold(e, ["user_id"], "event_id", op, F.col("value"))


@query
def ledger_tail_runs(spark, d):
    """Deliveries by run and kind of change, each run after its own snapshot and up to its own committed sequence."""
    _, bounds = changefeed.run_bounds(table(spark, d, "snapshot_envelopes"), table(spark, d, "commit_markers"))
    e = table(spark, d, "event_envelopes").select(identifier("run_id").alias("run_id"), "sequence", identifier("op_kind").alias("op_kind")).dropna(subset=["run_id", "sequence"])
    tail = ledger.committed(join_measured(e, bounds, "run_id", "left"), "sequence", F.col("cursor"), F.col("last"))
    return tail.groupBy("run_id", "op_kind").agg(F.count("*").alias("n"))


@query
def ledger_parity(spark, d):
    """A replay in two steps agrees with one replay: no rows."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    op = F.when(F.col("event_type") == "error", "delete").otherwise("set")
    whole = ledger.fold(e, ["user_id"], "event_id", op, F.col("value")).select("user_id", "seq", "value")
    first = e.withColumn("op", op).where("event_id <= 500").groupBy("user_id").agg(F.max(F.struct("event_id", "op", "value")).alias("m")).select("user_id", "m.*")
    both = first.unionByName(e.withColumn("op", op).where("event_id > 500").select("user_id", "event_id", "op", "value"))
    return ledger.same_state(whole, ledger.fold(both, ["user_id"], "event_id", F.col("op"), F.col("value")).select("user_id", "seq", "value"))


# Graphs


def _geo(spark, d):
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    a = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("r"), "r_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    b = c.select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"))
    return a.unionByName(b)


def _links(spark, d):
    from ledgerloom.operators.hierarchy import link_edges

    return link_edges(table(spark, d, "impact_links")).dropna().select(F.col("parent").alias("src"), F.col("child").alias("dst"))


@query
def graph_reach(spark, d):
    seeds = spark.createDataFrame([("r0",), ("r3",)], "node string")
    return graphs.reach(_geo(spark, d), seeds, 2).select("node", F.col("depth").cast("bigint").alias("depth"))


@query
def graph_components(spark, d):
    """Components of everything that links join; only names that both ends have count."""
    l = table(spark, d, "impact_links")
    return graphs.components(l.select(reference("source").alias("src"), reference("target").alias("dst")))


@query
def graph_union_sets(spark, d):
    """Documents whose requirements overlap, directly or over others."""
    r = table(spark, d, "doc_frontmatter").select(F.col("row_id").alias("owner"), F.explode("doc_requires").alias("x"))
    return graphs.union_sets(r.select("owner", reference("x").alias("element")).dropna())


@query
def graph_wl(spark, d):
    """Sizes of the classes of nodes that two rounds of refinement can't tell apart."""
    e = _geo(spark, d)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("seed", F.substring("node", 1, 1))
    return graphs.refine(nodes, e, 2).groupBy("label").agg(F.count("*").alias("size"), F.min("node").alias("first_node")).select("first_node", "size")


def _numbered_edges(e):
    kinds = e.select(F.explode(F.array("src", "dst")).alias("name")).distinct().withColumn("kind", F.substring("name", 1, 1))
    _, numbered = graphs.graph_signature(e, kinds)
    return numbered.select(F.col("src_no").cast("bigint").alias("src_no"), F.col("dst_no").cast("bigint").alias("dst_no"))


@query
def graph_signature_all(spark, d):
    """Edges between regions, nations and customers by dense numbers of their ends."""
    return _numbered_edges(_geo(spark, d))


@query
def graph_scc(spark, d):
    """Strongly connected components of several nodes in the explicit links between documents."""
    c = graphs.strong_components(_links(spark, d))
    size = c.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    return c.join(size, "component").select("node", "component", "n")


@query
def graph_toposort(spark, d):
    return graphs.levels(_links(spark, d))


@query
def graph_invalidate(spark, d):
    seeds = _geo(spark, d).where("src = 'r1'").select(F.col("src").alias("node")).distinct()
    return graphs.downstream(_geo(spark, d), seeds)


# Fingerprints


def _flag_counts(spark, d, flag):
    return fingerprints.exponents(table(spark, d, "lineitem").where(F.col("l_linestatus") == flag).select(F.lit(1).alias("owner"), F.col("l_linenumber").alias("key")))


@query
def fp_exponents(spark, d):
    return fingerprints.algebra(_flag_counts(spark, d, "O"), _flag_counts(spark, d, "F")).select(F.col("key").cast("bigint").alias("key"), "gcd", "lcm", "symdiff")


@query
def fp_contains(spark, d):
    l = table(spark, d, "lineitem").select(F.lit(1).alias("owner"), F.col("l_linenumber").alias("key"))
    return fingerprints.contains(fingerprints.exponents(l), _flag_counts(spark, d, "F"))


@query
def fp_bitmask(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("owner"), F.concat("l_returnflag", "l_linestatus").alias("key"))
    return fingerprints.masks(items, fingerprints.registry(items)).withColumnRenamed("owner", "l_orderkey")


# Scalars and text


@query
def id_digest(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat_ws("|", scalars.typed_part("p_partkey", "int"), scalars.typed_part("p_name", "str")).alias("t"))
    return p.select("p_partkey", scalars.short_id("suite", "t").alias("suite_id"), scalars.digest("t").alias("digest"))


@query
def scalar_paramset(spark, d):
    e = table(spark, d, "doc_frontmatter").select("row_id", scalars.paramset(F.coalesce("doc_requires", F.array())).alias("s"))
    return e.select("row_id", F.array_join("s", ",").alias("requires"), F.size("s").cast("bigint").alias("n"))


@query
def scalar_durations(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.floor("value").cast("string"), F.lit("m"), (F.col("event_id") % 60).cast("string"), F.lit("s")).alias("t"))
    return e.select("event_id", scalars.duration_ns("t").alias("ns"))


@query
def scalar_canonical_objects(spark, d):
    """All readable payloads in canonical form."""
    e = table(spark, d, "event_envelopes").select("delivery_id", scalars.canonical_object("payload_json").alias("canonical"))
    return e.where("canonical is not null")


@query
def scalar_evidence_fingerprint(spark, d):
    return table(spark, d, "part").select("p_partkey", scalars.evidence_fingerprint("p_name").alias("ekf"))


@query
def scalar_type_keys(spark, d):
    hints = [("Optional[int]",), ("int | None",), ("typing.List[str]",), ("Union[str, int]",), ("dict[str, Optional[int]]",)]
    return spark.createDataFrame(hints, "hint string").select("hint", scalars.type_keys("hint").alias("type_key"))


@query
def path_tests(spark, d):
    e = table(spark, d, "impact_links").where("source is not null").select("link_id", scalars.path_is_test(F.split("source", "::")[0]).alias("is_test"))
    return e


@query
def text_headings(spark, d):
    """How many lines stand under each heading of each document."""
    lines = lines_of.numbered_lines(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    h = lines_of.headings(lines, "doc_id").where("heading is not null and not is_heading")
    return h.groupBy("doc_id", "heading").agg(F.count("*").alias("n"))


@query
def text_front_matter(spark, d):
    return lines_of.front_matter(table(spark, d, "documents"), "doc_id", "text")


def _lint_lines(entries):
    e = entries.select(F.format_string("%s:%d:%d: %s %s", F.trim(F.regexp_replace("path", r"\\", "/")), "line", "col", F.trim("code"), "message").alias("t"))
    return lines_of.lint_lines(e, "t").groupBy("code").agg(F.count("*").alias("n"), F.sum("line").alias("lines"))


@query
def text_lint_lines_all(spark, d):
    """Lint entries of all snapshots written as lines and read again."""
    return _lint_lines(table(spark, d, "lint_entries"))


@query
def doc_contains(spark, d):
    """Documents that name a section title, whatever the case."""
    docs = table(spark, d, "documents").where("text is not null")
    return docs.where(F.contains(F.lower("text"), F.lit("decision surface"))).select("doc_id")


# Taint


def _markers(spark, d):
    e = table(spark, d, "events")
    kind = taint.resolve_kind(F.when(F.col("event_type") == "error", "control_ambiguity").when(F.col("event_type") == "view", "Schema_Drift ").otherwise(F.col("event_type")))
    m = e.select("event_id", kind.alias("kind"), F.when(F.col("user_id") % 3 == 0, "observe").otherwise("enforce").alias("profile"), (F.col("event_id") % 11 == 0).alias("expired"), (F.col("user_id") % 5).cast("string").alias("boundary_id"), F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("suite_id"), (F.col("value") > 50).alias("witness"))
    b = spark.createDataFrame([("1", None, ["control_ambiguity"]), ("2", "u3", ["schema_drift", "control_ambiguity"]), (" ", "u1", ["unknown"])], "boundary_id string, suite_id string, allowed_kinds array<string>")
    j = taint.with_boundary(m, b)
    return j.select("event_id", "kind", "profile", taint.status(F.col("profile"), F.col("kind"), F.col("expired"), F.col("boundary_known"), F.array_contains("allowed_kinds", F.col("kind")), F.col("witness")).alias("status"))


@query
def taint_ladder(spark, d):
    return _markers(spark, d)


@query
def taint_summary(spark, d):
    return taint.summary(_markers(spark, d))


@query
def taint_lifecycle(spark, d):
    e = table(spark, d, "events")
    g = e.groupBy(F.col("event_type").alias("profile"), F.to_date("ts").alias("gate")).agg((F.avg("value") > 30).alias("ready"), (F.max("value") > 99.99).alias("regressed"))
    return taint.lifecycle(g)


# Streams


@query
def stream_tumbling(spark, d):
    """Counts per day and type through a file stream; the watermark leaves the last windows open."""
    from ledgerloom.streaming import ledger as streams

    schema = table(spark, d, "events").schema
    s = streams.file_stream(spark, f"{d}/events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.run_once(streams.tumbling(s, "ts", "1 day", "2 days", ["event_type"]), "tumbling")


@query
def window_tumbling(spark, d):
    e = table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return e.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")


@query
def window_session(spark, d):
    e = table(spark, d, "events").groupBy(F.session_window("ts", "12 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return e.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


@query
def stream_once_only(spark, d):
    """Deliveries in two micro-batches by batch name through the identifier index: surplus ones."""
    from ledgerloom.operators.onceonly import IdentifierIndex

    e = table(spark, d, "event_envelopes")
    parts = [identifier("run_id"), F.col("sequence"), identifier("op_id")]
    index = IdentifierIndex(spark)
    first = F.col("received_at") < F.lit("2025-07-01").cast("timestamp")
    return index.admit(e.where(first), parts, "received_at", "delivery_id").unionByName(index.admit(e.where(~first), parts, "received_at", "delivery_id"))


@query
def rank_classes(spark, d):
    """Dense rank of part types by how many parts they have."""
    n = table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    return n.withColumn("class_rank", (F.dense_rank().over(Window.orderBy(F.desc("n"))) - 1).cast("bigint"))
