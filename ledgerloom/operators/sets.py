"""Relations of sets: equivalence, containment, likeness, winners and classes of evidence.

Sets are given long, as (owner, element). Owners with equal sets are one class, and only classes are compared. Set joins
use that a pair that meets must share one of the first elements in order of rarity, so no element that everyone has
brings owners together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import join_measured, stored


def signatures(members: DataFrame) -> DataFrame:
    """owner, set_id, n: owners whose distinct elements are the same share a set_id; null elements don't count.

    The id is built from commutative sums of element hashes, so a set of any size needs no list in memory.
    """
    m = members.select("owner", "element").dropna().distinct()
    a, b = F.xxhash64("element"), F.xxhash64(F.lit("b"), "element")
    wide = lambda h: F.sum(h.cast("decimal(20,0)")).cast("string")
    g = m.groupBy("owner").agg(F.count("*").alias("n"), wide(a).alias("a"), wide(b).alias("b"))
    return g.select("owner", F.sha2(F.concat_ws("|", F.col("n").cast("string"), "a", "b"), 256).alias("set_id"), "n")


def set_classes(members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """Owners (owner, set_id, n); elements (set_id, element, n, rank) ranked from rare to frequent within each set;
    classes (set_id, n, mask); and whether the masks are exact.

    A mask has a bit per element, elements numbered by frequency share bits beyond 64 of them; then a mask only rules
    pairs out and the survivors are compared element by element.
    """
    owners = stored(signatures(members), "owners")
    one = owners.groupBy("set_id", "n").agg(F.min("owner").alias("owner"))
    elements = stored(members.select("owner", "element").dropna().distinct().join(one, "owner").select("set_id", "element", "n"), "members")
    rare = stored(elements.groupBy("element").agg(F.count("*").alias("sets")), "rare")
    exact = rare.count() <= 64
    bit = F.dense_rank().over(Window.orderBy(F.desc("sets"), "element")) - 1 if exact else F.pmod(F.xxhash64("element"), F.lit(64))
    ranked = elements.join(rare.withColumn("bit", bit.cast("int")), "element").withColumn("rank", F.row_number().over(Window.partitionBy("set_id").orderBy("sets", F.desc("element"))))
    elements = stored(ranked.select("set_id", "element", "n", "rank", "bit"), "elements")
    classes = elements.groupBy("set_id", "n").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    return owners, elements, stored(classes, "classes"), exact


def _side(df: DataFrame, classes: DataFrame, as_: str) -> DataFrame:
    """element, and set id, size and mask of its class under the names as_, n + as_, m + as_."""
    return df.select("set_id", "element").join(classes, "set_id").select("element", F.col("set_id").alias(as_), F.col("n").alias(f"n{as_}"), F.col("mask").alias(f"m{as_}"))


def _common(cand: DataFrame, elements: DataFrame, exact: bool) -> DataFrame:
    """cand (a, b, na, nb, ma, mb) with k, the number of common elements."""
    if exact:
        return cand.withColumn("k", F.bit_count(F.col("ma").bitwiseAND(F.col("mb"))).cast("bigint"))
    shared = cand.join(elements.select(F.col("set_id").alias("a"), "element"), "a").join(elements.select(F.col("set_id").alias("b"), "element"), ["b", "element"])
    return shared.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k"))


def containing(elements: DataFrame, classes: DataFrame, exact: bool) -> DataFrame:
    """a, b, nb: classes b that properly contain class a; candidates share a's rarest element."""
    x, y = _side(elements.where("rank = 1"), classes, "a"), _side(elements, classes, "b")
    n = 4 * int(elements.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cand = join_measured(y.repartition(n, "b"), x, "element").where("nb > na and (ma & ~mb) = 0").drop("element")
    return _common(cand, elements, exact).where("k = na").select("a", "b", "nb")


def dominators(members: DataFrame) -> DataFrame:
    """owner, set_id, dominator (set_id): the smallest classes that properly contain an owner's set."""
    owners, elements, classes, exact = set_classes(members)
    sup = containing(elements, classes, exact)
    least = sup.withColumn("r", F.rank().over(Window.partitionBy("a").orderBy("nb"))).where("r = 1")
    return owners.join(least.select(F.col("a").alias("set_id"), F.col("b").alias("dominator")), "set_id").select("owner", "set_id", "dominator")


def likeness_join(members: DataFrame, least: float) -> DataFrame:
    """a, b (owners that stand for their class, a < b) and jaccard, of all classes at least as alike as least.

    Prefix filtering: sets that alike share one of the first n - ceil(least * n) + 1 elements by rarity.
    """
    owners, elements, classes, exact = set_classes(members)
    stands = owners.groupBy("set_id").agg(F.min("owner").alias("owner"))
    reps = stored(classes.join(stands, "set_id"), "reps")
    prefix = elements.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select("set_id", "element", "rank", "bit").join(reps, "set_id")
    side = lambda x, *more: prefix.select("element", "rank", *more, F.col("owner").alias(x), F.col("n").alias(f"n{x}"), F.col("mask").alias(f"m{x}"))
    #: No more elements in common than either set has under the other's bits.
    most = F.least(F.expr("na - bit_count(ma & ~mb)"), F.expr("nb - bit_count(mb & ~ma)"))
    near = (F.col("a") < F.col("b")) & (F.col("nb") >= least * F.col("na") - 1e-9) & (F.col("na") >= least * F.col("nb") - 1e-9)
    if exact:  # each pair once, by its rarest common element: no higher bit is common
        near = near & F.expr("shiftrightunsigned(shiftrightunsigned(ma & mb, bit), 1) = 0")
    near = near & (most >= least * (F.col("na") + F.col("nb") - most) - 1e-9)
    #: The rarest common element and those after it in either order are all that can be common. Sets are spread over
    #: tasks once more, as their pairs are many more than they are.
    after = 1 + F.least(F.col("na") - F.col("rank"), F.col("nb") - F.col("rank_b"))
    ahead = after >= least / (1 + least) * (F.col("na") + F.col("nb")) - 1e-9
    n = 4 * int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = side("a", "bit").repartition(n, "a")
    cand = join_measured(x, side("b").withColumnRenamed("rank", "rank_b"), "element").where((ahead & near) if exact else near).drop("element", "bit", "rank", "rank_b")
    if exact:
        common = cand.withColumn("k", F.bit_count(F.col("ma").bitwiseAND(F.col("mb"))).cast("bigint"))
    else:
        named = elements.join(stands, "set_id").select(F.col("owner").alias("o"), "element")
        common = cand.distinct().join(named.toDF("a", "element"), "a").join(named.toDF("b", "element"), ["b", "element"]).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k"))
    return common.withColumn("jaccard", F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).where(F.col("jaccard") >= least - 1e-12).select("a", "b", "jaccard")


def class_members(members: DataFrame) -> DataFrame:
    """owner, stands: every owner and the one that stands for its class in likeness_join."""
    owners = stored(signatures(members), "owners")
    return owners.join(owners.groupBy("set_id").agg(F.min("owner").alias("stands")), "set_id").select("owner", "stands")


def winners(df: DataFrame, group: list[str], objectives: list[Column]) -> DataFrame:
    """The first row of each group by the objectives in turn, which must end in a unique one.

    Groups may be large: the best of each is found by a partial aggregate, not by sorting the group.
    """
    best = F.min(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(objectives)), *(F.col(c).alias(f"v_{c}") for c in df.columns if c not in group)))
    return df.groupBy(*group).agg(best.alias("m")).select(*group, *(F.col(f"m.v_{c}").alias(c) for c in df.columns if c not in group))


def held_once(members: DataFrame) -> DataFrame:
    """element, owner of the elements that exactly one owner has."""
    g = members.select("owner", "element").dropna().groupBy("element").agg(F.min("owner").alias("owner"), F.max("owner").alias("other"))
    return g.where("owner = other").select("element", "owner")


def classify(df: DataFrame, ladder: list[tuple[str, Column]], default: str) -> DataFrame:
    """df with column class: the first rung whose condition is true."""
    c = F.lit(default)
    for name, condition in reversed(ladder):
        c = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(c)
    return df.withColumn("class", c)


def obsolescence(members: DataFrame, everyone: DataFrame, risky: DataFrame | None = None) -> DataFrame:
    """owner, class: unmapped, redundant_by_evidence, equivalent_witness or active_candidate for every owner.

    A dominated owner that is the last to hold a risky element stays active; of equal sets the smallest owner stays.
    """
    owners, elements, classes, exact = set_classes(members)
    dominated = containing(elements, classes, exact).select(F.col("a").alias("set_id")).distinct().withColumn("dominated", F.lit(True))
    first = owners.groupBy("set_id").agg(F.min("owner").alias("stays"))
    guard = (held_once(members).join(risky.select("element").distinct(), "element") if risky is not None else held_once(members).limit(0)).select("owner").distinct().withColumn("guarded", F.lit(True))
    all_ = everyone.select("owner").dropna().distinct().join(owners, "owner", "left").join(dominated, "set_id", "left").join(first, "set_id", "left").join(guard, "owner", "left")
    ladder = [("unmapped", F.col("set_id").isNull()), ("active_candidate", F.col("guarded")), ("redundant_by_evidence", F.col("dominated")), ("equivalent_witness", F.col("owner") != F.col("stays"))]
    return classify(all_, ladder, "active_candidate").select("owner", "class")


def merge_greedily(sets: list[list[str]], least: float) -> list[list[str]]:
    """Greedy agglomeration of sets: smallest first, each absorbs the first other that is alike enough, until none is.

    Its result depends on the order, which is fixed by size and members; an inherently sequential step for one group.
    """
    todo = sorted({tuple(sorted(set(s))) for s in sets}, key=lambda s: (len(s), s))
    changed = True
    while changed:
        changed, out = False, []
        while todo:
            s = set(todo.pop(0))
            for i, other in enumerate(todo):
                o = set(other)
                if (len(s & o) / len(s | o) if s | o else 1.0) >= least:
                    todo.pop(i)
                    todo.append(tuple(sorted(s | o)))
                    changed = True
                    break
            else:
                out.append(tuple(sorted(s)))
        todo = sorted(set(out), key=lambda s: (len(s), s))
    return [list(s) for s in todo]
