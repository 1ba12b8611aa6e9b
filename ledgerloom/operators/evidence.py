"""Tests and what they witness: indexes, footprints, coverage, suggestions, protocols, obligations and worklists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.sets import signatures


def unique(df: DataFrame, key: str) -> DataFrame:
    """df, or an error when it is read if a key occurs twice; null keys don't count."""
    twice = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    known = df.join(twice, key, "left")
    fail = F.raise_error(F.concat(F.lit(f"duplicate {key}: "), F.col(key).cast("string"))).cast("boolean")
    return known.where(F.when(F.col("_n") > 1, fail).otherwise(True)).drop("_n")


def evidence_index(pairs: DataFrame) -> DataFrame:
    """evidence, witness_count, first_test, last_test from (test, evidence); no evidence's tests are gathered in a list."""
    return pairs.select("test", "evidence").dropna().groupBy("evidence").agg(F.count_distinct("test").alias("witness_count"), F.min("test").alias("first_test"), F.max("test").alias("last_test"))


def footprints(targets: DataFrame) -> DataFrame:
    """test, footprint, targets: tests (test, target) with the id and size of the set of what they call directly."""
    s = signatures(targets.select(F.col("test").alias("owner"), F.col("target").alias("element")))
    return s.select(F.col("owner").alias("test"), F.col("set_id").alias("footprint"), F.col("n").alias("targets"))


def consolidation(prints: DataFrame, clustered: DataFrame, least: int = 2) -> DataFrame:
    """first_test, tests, targets: groups of at least so many tests of one footprint that are in no cluster (test) yet."""
    free = prints.join(clustered.select("test").distinct(), "test", "left_anti")
    g = free.groupBy("footprint", "targets").agg(F.min("test").alias("first_test"), F.count_distinct("test").alias("tests"))
    return g.where(F.col("tests") >= least).select("first_test", "tests", "targets")


def coverage(mapping: DataFrame, annotated: DataFrame, collected: DataFrame) -> DataFrame:
    """subject, evidence, state of mappings (subject, evidence): duplicate where a pair occurs twice, mapped where the
    evidence is annotated or collected (evidence each), else dead; annotated evidence that none maps is unmapped."""
    m = mapping.select("subject", "evidence").dropna().groupBy("subject", "evidence").agg(F.count("*").alias("n"))
    a = annotated.select("evidence").dropna().distinct().withColumn("a", F.lit(True))
    c = collected.select("evidence").dropna().distinct().withColumn("c", F.lit(True))
    named = m.join(a.unionByName(c, allowMissingColumns=True).groupBy("evidence").agg(F.max("a").alias("a"), F.max("c").alias("c")), "evidence", "left")
    state = F.when(F.col("n") > 1, "duplicate").when(F.col("a").isNotNull() | F.col("c").isNotNull(), "mapped").otherwise("dead")
    free = a.join(m.select("evidence"), "evidence", "left_anti").select(F.lit(None).cast("string").alias("subject"), "evidence", F.lit("unmapped").alias("state"))
    return named.select("subject", "evidence", state.alias("state")).unionByName(free)


def suggest(df: DataFrame, rules: list[dict]) -> DataFrame:
    """df with suggestion: the first rule whose needles occur in its column, and none of whose excludes do; else null.

    A rule: column, needles (any of them), excludes, evidence. Case doesn't matter; rules are code, so they are columns.
    """
    out: Column = F.lit(None).cast("string")
    for r in reversed(rules):
        text = F.coalesce(F.lower(F.col(r["column"])), F.lit(""))
        some = lambda words: reduce(Column.__or__, [F.contains(text, F.lit(w.lower())) for w in words], F.lit(False))  # noqa: B023, E731
        out = F.when(some(r["needles"]) & ~some(r.get("excludes", [])), r["evidence"]).otherwise(out)
    return df.withColumn("suggestion", out)


def protocol_violations(bundles: DataFrame, tables: DataFrame) -> DataFrame:
    """bundle_id, violation of bundles (bundle_id, table_id, members array) against decision tables (table_id, evidence,
    checklist): empty_members, missing_table, missing_evidence, missing_checklist; a bundle may have several."""
    t = tables.select("table_id", "evidence", "checklist", F.lit(True).alias("there")).dropDuplicates(["table_id"])
    j = bundles.select("bundle_id", "table_id", "members").join(t, "table_id", "left")
    none = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    found = F.array_compact(F.array(
        F.when(F.coalesce(F.size("members"), F.lit(0)) <= 0, "empty_members"), F.when(F.col("there").isNull(), "missing_table"),
        F.when(F.col("there") & none("evidence"), "missing_evidence"), F.when(F.col("there") & none("checklist"), "missing_checklist"),
    ))
    return j.select("bundle_id", F.explode(found).alias("violation"))


# What is proposed for each class.
ACTIONS = {"redundant_by_evidence": "remove", "equivalent_witness": "merge", "obsolete_candidate": "review", "unmapped": "annotate", "active_candidate": "keep"}
RANKS = {c: i for i, c in enumerate(("redundant_by_evidence", "equivalent_witness", "obsolete_candidate", "unmapped", "active_candidate"))}


def worklist(classes: DataFrame) -> DataFrame:
    """owner, class, rank, action: the proposed action of each class; classes without one are reviewed last."""
    lookup = lambda d, other: F.coalesce(F.create_map(*(F.lit(x) for p in d.items() for x in p))[F.col("class")], F.lit(other))
    return classes.select("owner", "class", lookup(RANKS, len(RANKS)).alias("rank"), lookup(ACTIONS, "review").alias("action"))


def obligations(df: DataFrame, key: str, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """key, rule, triggered, met: every rule (trigger, met) on every row; what isn't triggered is met."""
    row = lambda n, t, m: F.struct(F.lit(n).alias("rule"), F.coalesce(t, F.lit(False)).alias("triggered"), (~F.coalesce(t, F.lit(False)) | F.coalesce(m, F.lit(False))).alias("met"))
    return df.select(key, F.explode(F.array(*(row(n, t, m) for n, (t, m) in rules.items()))).alias("r")).select(key, "r.*")


def obligation_summary(rows: DataFrame) -> DataFrame:
    """rule, total, triggered, untriggered, met, unmet."""
    t, m = F.col("triggered"), F.col("met")
    return rows.groupBy("rule").agg(F.count("*").alias("total"), F.count_if(t).alias("triggered"), F.count_if(~t).alias("untriggered"), F.count_if(t & m).alias("met"), F.count_if(t & ~m).alias("unmet"))


def repeated_bundles(tables: DataFrame, least: int = 2) -> DataFrame:
    """bundle, tables, functions: parameter sets (fn, params array) that at least so many decision tables share."""
    b = tables.select("fn", F.array_join(F.array_sort(F.array_distinct("params")), ",").alias("bundle")).where("bundle <> ''")
    return b.groupBy("bundle").agg(F.count("*").alias("tables"), F.count_distinct("fn").alias("functions")).where(F.col("tables") >= least)


def suggestions(bundles: DataFrame) -> DataFrame:
    """bundle, n, files, boundary, score of bundles (bundle, file, boundary): n + 2 per file + 1 per boundary."""
    g = bundles.groupBy("bundle").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"), F.count_if("boundary").alias("boundary"))
    return g.withColumn("score", F.col("n") + 2 * F.col("files") + F.col("boundary"))


def link_sources(explicit: DataFrame, inferred: DataFrame, weak: DataFrame, keys: list[str]) -> DataFrame:
    """keys, target, confidence: explicit targets of each key, else inferred, else weak ones."""
    every = [df.select(*keys, "target", F.lit(i).alias("_r"), F.lit(n).alias("confidence")) for i, (n, df) in enumerate((("explicit", explicit), ("inferred", inferred), ("weak", weak)))]
    rows = reduce(DataFrame.unionByName, every).dropna(subset=["target"]).distinct()
    best = rows.groupBy(*keys).agg(F.min("_r").alias("_r"))
    return rows.join(best, [*keys, "_r"], "left_semi").drop("_r")


def opaque(refs: DataFrame) -> DataFrame:
    """One row, refs and opaque: how many references there are, and how many without a readable key (null or blank)."""
    return refs.agg(F.count("*").alias("refs"), F.count_if(F.col("key").isNull() | (F.trim("key") == "")).alias("opaque"))


def decision_table(surfaces: DataFrame) -> DataFrame:
    """fn, position, param, evidence of decision surfaces (fn, params array), a row per parameter in its order."""
    each = surfaces.select("fn", F.posexplode("params").alias("position", "param"))
    return each.withColumn("evidence", F.concat(F.lit("E:decision_surface::"), F.concat_ws("::", "fn", "param")))


def marker_rows(**sources: DataFrame) -> DataFrame:
    """source, subject, kind: rows of several analyses (subject, kind) as taint markers, each once."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("source"), "subject", "kind") for n, df in sources.items()]).distinct()
