"""Which function a call means: an ordered fall-through over scopes, imports, qualified names and class hierarchies.

Functions are rows (fn, path, scope array of enclosing names, name); calls (call_id, path, scope, name). Every rule
gives candidates of one level; the first level with just one candidate resolves a call, and a level with several before
it is an ambiguity. All rules are equi-joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import stored, stored_with

#: Levels in the order in which they are tried.
LEVELS = ("lexical", "import", "exact", "class")
MAX_ROUNDS = 1000


def lexical(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """call_id, fn: functions of the name in the innermost enclosing scope that has one."""
    f = functions.select("fn", "path", F.col("scope").alias("at"), "name")
    hit = calls.select("call_id", "path", "scope", "name").join(f, ["path", "name"]).where(F.slice("scope", 1, F.size("at")) == F.col("at"))
    depth = hit.groupBy("call_id", F.size("at").alias("depth")).agg(F.count_distinct("fn").alias("n"), F.min("fn").alias("fn"))
    return depth.groupBy("call_id").agg(F.max(F.struct("depth", "n", "fn")).alias("m")).select("call_id", "m.n", "m.fn")


def imported(calls: DataFrame, functions: DataFrame, imports: DataFrame) -> DataFrame:
    """As lexical, through imports (path, alias, module, target): the target is a qualified name in the module."""
    f = functions.select("fn", F.col("path").alias("module"), F.concat_ws(".", F.concat("scope", F.array("name"))).alias("target"))
    via = imports.select("path", F.col("alias").alias("name"), "module", "target").dropna().distinct()
    return _counted(calls.select("call_id", "path", "name").join(via, ["path", "name"]).join(f, ["module", "target"]))


def exact(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """As lexical, where the name called is a function's whole id."""
    return _counted(calls.select("call_id", F.col("name").alias("fn")).join(functions.select("fn"), "fn"))


def inherited(methods: DataFrame, bases: DataFrame) -> DataFrame:
    """class, method, fn, distance: every class's methods (class, method, fn), its own or those of its nearest ancestors.

    bases: class, base. Several ancestors at one distance give a row each; cycles of bases end, as each pair counts once.
    """
    b = stored(bases.select("class", "base").dropna().where("class <> base").distinct(), "bases")
    own = methods.select("class").union(b.select("class")).union(b.select("base")).distinct()
    seen = front = stored(own.select("class", F.col("class").alias("ancestor"), F.lit(0).alias("distance")), "ancestors")
    for d in range(1, MAX_ROUNDS):
        step = front.join(b, F.col("ancestor") == b["class"]).select(front["class"], F.col("base").alias("ancestor")).distinct()
        front, n = stored_with(step.join(seen.select("class", "ancestor"), ["class", "ancestor"], "left_anti").withColumn("distance", F.lit(d)), "ancestors", n=F.count(F.lit(1)))
        if not n["n"]:
            break
        seen = seen.unionByName(front)
    else:
        raise RuntimeError("class hierarchy did not end")
    all_ = seen.join(methods.select(F.col("class").alias("ancestor"), "method", "fn"), "ancestor")
    near = all_.groupBy("class", "method").agg(F.min("distance").alias("distance"))
    return all_.join(near, ["class", "method", "distance"]).select("class", "method", "fn", "distance").distinct()


def by_class(calls: DataFrame, methods: DataFrame, bases: DataFrame) -> DataFrame:
    """As lexical, for names of the form Class.method, through the class's ancestors."""
    at = F.split("name", r"\.")
    c = calls.where(F.size(at) == 2).select("call_id", at[0].alias("class"), at[1].alias("method"))
    return _counted(c.join(inherited(methods, bases).select("class", "method", "fn"), ["class", "method"]))


def _counted(hits: DataFrame) -> DataFrame:
    return hits.groupBy("call_id").agg(F.count_distinct("fn").alias("n"), F.min("fn").alias("fn"))


def resolve(calls: DataFrame, rules: dict[str, DataFrame]) -> DataFrame:
    """call_id, level, fn, ambiguous of every call: the first level with one candidate; null where there is none.

    rules: results of lexical, imported, exact and by_class by level; a level that isn't given isn't tried. ambiguous
    says that an earlier level had several candidates, or the only ones.
    """
    tried = [rules[level].select("call_id", F.lit(i).alias("i"), "n", "fn") for i, level in enumerate(LEVELS) if level in rules]
    hits = reduce(DataFrame.unionByName, tried)
    one = F.min(F.when(F.col("n") == 1, F.struct("i", "fn")))
    g = hits.groupBy("call_id").agg(one.alias("m"), F.min(F.when(F.col("n") > 1, F.col("i"))).alias("several"))
    name = F.element_at(F.array(*map(F.lit, LEVELS)), F.col("m.i") + 1)
    found = g.select("call_id", F.when(F.col("m").isNotNull(), name).alias("level"), F.col("m.fn").alias("fn"), (F.col("several") < F.coalesce("m.i", F.lit(len(LEVELS)))).alias("ambiguous"))
    return calls.select("call_id").join(found, "call_id", "left").select("call_id", "level", "fn", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


# Annotations that say nothing.
BROAD = ("", "Any", "object", "typing.Any")


def type_flow(params: DataFrame, bound: DataFrame) -> DataFrame:
    """fn, param, annotation, kind of every parameter (fn, param, annotation or null) that its callees say something of.

    bound: caller, caller_param, callee, callee_param. A broad parameter whose callees agree on one type adopts it
    ('adopted'), which may inform its own callers in the next round; of several types it is 'ambiguous' and passes
    nothing on. Rounds go on until none adopts.
    """
    broad = F.col("annotation").isNull() | F.trim("annotation").isin(*BROAD)
    state = stored(params.select("fn", "param", F.when(~broad, F.trim("annotation")).alias("annotation"), F.lit(False).alias("adopted")).dropDuplicates(["fn", "param"]), "types")
    b = stored(bound.select(F.col("caller").alias("fn"), F.col("caller_param").alias("param"), "callee", "callee_param").dropna().distinct(), "bound")
    for _ in range(MAX_ROUNDS):
        down = state.select(F.col("fn").alias("callee"), F.col("param").alias("callee_param"), F.col("annotation").alias("t")).dropna()
        said = b.join(down, ["callee", "callee_param"]).groupBy("fn", "param").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
        new = state.join(said, ["fn", "param"], "left")
        adopts = F.col("annotation").isNull() & (F.col("lo") == F.col("hi"))
        new = new.select("fn", "param", F.when(adopts, F.col("lo")).otherwise(F.col("annotation")).alias("annotation"), (F.col("adopted") | F.coalesce(adopts, F.lit(False))).alias("adopted"), F.coalesce(F.col("annotation").isNull() & (F.col("lo") != F.col("hi")), F.lit(False)).alias("several"), F.coalesce(adopts, F.lit(False)).alias("moved"))
        new, n = stored_with(new, "types", moved=F.count(F.when(F.col("moved"), 1)))
        state = new.select("fn", "param", "annotation", "adopted")
        if not n["moved"]:
            kind = F.when(F.col("adopted"), "adopted").when(F.col("several"), "ambiguous")
            return new.select("fn", "param", "annotation", kind.alias("kind")).where("kind is not null")
    raise RuntimeError("types did not settle")
