"""Facts about programs related: call edges, bundles of parameters, impact of changes, decision surfaces, structure.

Facts are rows of sources.python_code.FACT. Calls are resolved by name; where several functions share it every one is a
candidate and the edge carries the confidence of the ambiguity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import path_is_test
from ledgerloom.operators.graphs import components, strongest_paths
from ledgerloom.operators.joins import interval_join
from ledgerloom.session import stored_with

MAX_ROUNDS = 200


def _short(c: str) -> Column:
    return F.element_at(F.split(F.col(c), r"\."), -1)


def functions(facts: DataFrame) -> DataFrame:
    """path, fn (path::qualified name), name, start, end, params, is_test."""
    full = F.concat_ws(".", F.nullif("qual", F.lit("")), F.col("name"))
    d = F.from_json("detail", "params array<string>")
    return facts.where("kind = 'function'").select("path", F.concat_ws("::", "path", full).alias("fn"), "name", F.col("line").alias("start"), F.col("end_line").alias("end"), d["params"].alias("params"), (path_is_test("path") | F.col("name").startswith("test")).alias("is_test"))


def call_edges(facts: DataFrame) -> DataFrame:
    """caller, callee (as fn), confidence (1 if the name is unique, else at least 0.1 of 1/n), inferred, n."""
    fn = functions(facts).select(F.col("fn").alias("callee"), "name")
    n = fn.groupBy("name").agg(F.count("*").alias("n"))
    named = fn.join(n, "name").withColumn("confidence", F.when(F.col("n") == 1, 1.0).otherwise(F.greatest(F.lit(0.1), 1 / F.col("n"))))
    calls = facts.where("kind = 'call' and qual <> ''").select(F.concat_ws("::", "path", "qual").alias("caller"), _short("name").alias("name")).distinct()
    return calls.join(named, "name").select("caller", "callee", "confidence", (F.col("n") > 1).alias("inferred"), "n")


def call_ambiguities(facts: DataFrame) -> DataFrame:
    """caller, name, candidates of the calls outside tests that several functions answer to."""
    e = call_edges(facts).where("n > 1").where(~path_is_test(F.split("caller", "::")[0]))
    return e.groupBy("caller", F.col("n").alias("candidates"), F.regexp_extract("callee", r"([^.:]+)$", 1).alias("name")).agg(F.count("*").alias("edges")).select("caller", "name", "candidates")


def signature_groups(facts: DataFrame) -> DataFrame:
    """fn, bundle: parameters of a function that are forwarded to just the same slots and used for nothing else."""
    u = facts.where("kind = 'param_use'").select(F.concat_ws("::", "path", "qual").alias("fn"), F.col("name").alias("param"), F.from_json("detail", "forward array<string>, non_forward boolean").alias("d"))
    alike = u.where("not d.non_forward and size(d.forward) > 0").groupBy("fn", F.array_join(F.transform("d.forward", lambda x: F.regexp_replace(x, r":(arg\[\d+\]|kw\[.*\])$", ":slot")), ";").alias("signature"))
    return alike.agg(F.array_sort(F.collect_set("param")).alias("bundle")).where("size(bundle) > 1").select("fn", "bundle")


def bindings(facts: DataFrame) -> DataFrame:
    """caller, caller_param, callee, callee_param: variables passed on, by position or keyword, to a function of a unique name."""
    fn = functions(facts)
    unique = fn.groupBy("name").agg(F.count("*").alias("n"), F.min("fn").alias("callee"), F.min_by("params", "fn").alias("params")).where("n = 1")
    calls = facts.where("kind = 'call' and qual <> ''").select(F.concat_ws("::", "path", "qual").alias("caller"), _short("name").alias("name"), F.from_json("detail", "pos array<array<string>>, kw array<array<string>>").alias("d")).join(unique, "name")
    pos = calls.select("caller", "callee", "params", F.explode("d.pos").alias("a")).select("caller", F.col("a")[1].alias("caller_param"), "callee", F.get("params", F.col("a")[0].cast("int")).alias("callee_param"))
    kw = calls.select("caller", "callee", "params", F.explode("d.kw").alias("a")).where(F.array_contains("params", F.col("a")[0])).select("caller", F.col("a")[1].alias("caller_param"), "callee", F.col("a")[0].alias("callee_param"))
    own = fn.select(F.col("fn").alias("caller"), F.explode("params").alias("caller_param"))
    return pos.unionByName(kw).dropna().distinct().join(own, ["caller", "caller_param"], "left_semi")


def propagate_bundles(groups: DataFrame, bound: DataFrame, opaque: tuple[str, ...] = ()) -> DataFrame:
    """fn, param, bundle_id at the fixpoint: bundles of callees carried to callers' parameters, meeting ones merged.

    groups: fn, bundle (array). Parameters of one function are linked if they are in one bundle; a link between two
    parameters of a callee becomes one between the caller's variables bound to them, until no new link appears.
    Opaque callees pass nothing on.
    """
    first = groups.select("fn", F.explode("bundle").alias("a"), "bundle").select("fn", "a", F.explode("bundle").alias("b")).where("a < b")
    links, n = stored_with(first.distinct(), "links", n=F.count(F.lit(1)))
    b = bound.where(~F.col("callee").isin(*opaque)) if opaque else bound
    x = b.select("caller", "callee", F.col("caller_param").alias("x"), F.col("callee_param").alias("a"))
    y = b.select("caller", "callee", F.col("caller_param").alias("y"), F.col("callee_param").alias("b"))
    for _ in range(MAX_ROUNDS):
        up = links.withColumnRenamed("fn", "callee").join(x, ["callee", "a"]).join(y, ["callee", "caller", "b"]).where("x <> y")
        new = up.select(F.col("caller").alias("fn"), F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        links, m = stored_with(links.unionByName(new).distinct(), "links", n=F.count(F.lit(1)))
        if m == n:
            break
        n = m
    else:
        raise RuntimeError(f"bundles did not settle in {MAX_ROUNDS} rounds")
    key = lambda c: F.concat_ws("#", "fn", F.col(c))
    c = components(links.select(key("a").alias("src"), key("b").alias("dst")))
    return c.select(F.substring_index("node", "#", 1).alias("fn"), F.substring_index("node", "#", -1).alias("param"), F.col("component").alias("bundle_id"))


def decision_surfaces(facts: DataFrame) -> DataFrame:
    """fn, params, callers, tier: functions that branch on parameters; 'boundary' where nothing calls them."""
    d = facts.where("kind = 'decision'").select(F.concat_ws("::", "path", "qual").alias("fn"), F.explode(F.from_json("detail", "params array<string>")["params"]).alias("p"))
    s = d.groupBy("fn").agg(F.array_sort(F.collect_set("p")).alias("params"))
    callers = call_edges(facts).where("caller <> callee").groupBy(F.col("callee").alias("fn")).agg(F.count_distinct("caller").alias("callers"))
    j = s.join(callers, "fn", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))
    return j.withColumn("tier", F.when(F.col("callers") == 0, "boundary").otherwise("internal"))


def impact(facts: DataFrame, changes: DataFrame, max_depth: int = 10, must: float = 0.9) -> DataFrame:
    """fn, confidence, kind (must or likely) of the tests that changed lines (path, start, end) may reach.

    Functions overlapping a change are the seeds; confidence flows against the call edges, a path being worth its
    weakest edge.
    """
    fn = functions(facts)
    a = changes.select("path", F.monotonically_increasing_id().alias("a_id"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = fn.select("path", F.col("fn").alias("b_id"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    seeds = interval_join(a, b, ["path"], 200).select(F.col("b_id").alias("node")).distinct()
    back = call_edges(facts).select(F.col("callee").alias("src"), F.col("caller").alias("dst"), "confidence")
    hit = strongest_paths(back, seeds, max_depth)
    tests = fn.where("is_test").select(F.col("fn").alias("node"))
    return hit.join(tests, "node").select(F.col("node").alias("fn"), F.round("confidence", 3).alias("confidence"), F.when(F.col("confidence") >= must, "must").otherwise("likely").alias("kind"))


def call_clusters(targets: DataFrame, least: int = 2) -> DataFrame:
    """cluster (first test), tests, targets: tests (test, target) that call just the same targets, least of them at least."""
    from ledgerloom.operators.sets import signatures

    s = signatures(targets.select(F.col("test").alias("owner"), F.col("target").alias("element")))
    return s.groupBy("set_id", "n").agg(F.min("owner").alias("cluster"), F.count("*").alias("tests")).where(F.col("tests") >= least).select("cluster", "tests", F.col("n").alias("targets"))


def annotation_drift(tags: DataFrame, universe: DataFrame) -> DataFrame:
    """test, tag, status of tags (test, tag) against identities (display, identity): ok, legacy_tag, legacy_ambiguous, orphaned.

    A tag is ok as an identity, legacy as the display of one identity, ambiguous as that of several.
    """
    ident = universe.select(F.col("identity").alias("tag")).distinct().withColumn("known", F.lit(True))
    shown = universe.groupBy(F.col("display").alias("tag")).agg(F.count_distinct("identity").alias("n"))
    j = tags.select("test", "tag").join(ident, "tag", "left").join(shown, "tag", "left")
    return j.select("test", "tag", F.when(F.col("known"), "ok").when(F.col("n") == 1, "legacy_tag").when(F.col("n") > 1, "legacy_ambiguous").otherwise("orphaned").alias("status"))


def structure_metrics(bundles: DataFrame) -> DataFrame:
    """One row: files, functions, bundles, mean and largest size of bundles (path, fn, bundle array)."""
    n = F.size("bundle")
    return bundles.where(n > 0).agg(F.count_distinct("path").alias("files"), F.count_distinct("path", "fn").alias("functions"), F.count("*").alias("bundles"), F.avg(n).alias("mean_size"), F.max(n).alias("max_size"))


def structure_reuse(bundles: DataFrame, least: int = 2) -> DataFrame:
    """kind, digest, uses: bundles, and functions by all their bundles, that occur at least so often whatever the order."""
    b = bundles.select("path", "fn", F.sha1(F.array_join(F.array_sort(F.array_distinct("bundle")), ",")).alias("h"))
    f = b.groupBy("path", "fn").agg(F.sha1(F.concat_ws("|", F.count("*").cast("string"), F.sum(F.xxhash64("h").cast("decimal(20,0)")).cast("string"))).alias("h"))
    every = b.select(F.lit("bundle").alias("kind"), "h").unionByName(f.select(F.lit("function").alias("kind"), "h"))
    return every.groupBy("kind", F.col("h").alias("digest")).agg(F.count("*").alias("uses")).where(F.col("uses") >= least)


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """source, target, basis of composed steps (source, target, basis array): where one ends the next begins; a basis is stitched."""
    a, b = first.toDF("source", "mid", "p"), second.toDF("mid", "target", "q")
    stitched = F.when(F.try_element_at("p", F.lit(-1)) == F.try_element_at("q", F.lit(1)), F.concat("p", F.slice("q", 2, F.greatest(F.size("q") - 1, F.lit(0))))).otherwise(F.concat("p", "q"))
    return a.join(b, "mid").select("source", "target", stitched.alias("basis"))


def faithful(mapping: DataFrame) -> DataFrame:
    """One row of a mapping (domain, image): injective (no image twice) and functional (no key with two images)."""
    pairs = mapping.select("domain", "image").distinct()
    return pairs.agg((F.count("*") == F.count_distinct("image")).alias("injective"), (F.count("*") == F.count_distinct("domain")).alias("functional"))


def drift(baseline: DataFrame, current: DataFrame, witnesses: DataFrame) -> DataFrame:
    """surface, classification of representatives (surface, representative): equal, linked by a witness (left, right) in
    either direction, drift, or missing on one side."""
    w = witnesses.select(F.least("left", "right").alias("x"), F.greatest("left", "right").alias("y")).distinct().withColumn("linked", F.lit(True))
    j = baseline.select("surface", F.col("representative").alias("a")).join(current.select("surface", F.col("representative").alias("b")), "surface", "full")
    j = j.withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")}).join(w, ["x", "y"], "left")
    kind = F.when(F.col("a").isNull() | F.col("b").isNull(), "missing").when(F.col("a") == F.col("b"), "non_drift").when(F.col("linked"), "linked").otherwise("drift")
    return j.select("surface", kind.alias("classification"))
