"""Fingerprints of multisets as exponent vectors and bit masks.

A product of primes per key is a multiset of keys; kept as (owner, key, exponent) it has no size limit, and greatest
common divisor, least common multiple, divisibility and symmetric difference are per-key minimum, maximum, comparison
and difference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.ordering import numbered


def exponents(items: DataFrame) -> DataFrame:
    """owner, key, exponent from (owner, key) rows; null keys don't count."""
    return items.select("owner", "key").dropna().groupBy("owner", "key").agg(F.count("*").alias("exponent"))


def algebra(a: DataFrame, b: DataFrame) -> DataFrame:
    """key, gcd, lcm, symdiff exponents of two multisets (key, exponent); one shuffle, no join."""
    both = a.select("key", F.col("exponent").alias("x"), F.lit(0).alias("y")).unionByName(b.select("key", F.lit(0).alias("x"), F.col("exponent").alias("y")))
    g = both.groupBy("key").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    return g.select("key", F.least("x", "y").alias("gcd"), F.greatest("x", "y").alias("lcm"), F.abs(F.col("x") - F.col("y")).alias("symdiff"))


def contains(whole: DataFrame, part: DataFrame) -> DataFrame:
    """One row, contains: every exponent of part is reached in whole, and part isn't empty."""
    both = whole.select("key", F.col("exponent").alias("x"), F.lit(0).alias("y")).unionByName(part.select("key", F.lit(0).alias("x"), F.col("exponent").alias("y")))
    g = both.groupBy("key").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    return g.agg((F.coalesce(F.bool_and(F.col("x") >= F.col("y")), F.lit(False)) & (F.coalesce(F.sum("y"), F.lit(0)) > 0)).alias("contains"))


def registry(keys: DataFrame) -> DataFrame:
    """key, bit: distinct keys numbered from 0 in their order."""
    return numbered(keys.select("key").dropna().distinct(), ["key"], "bit")


def masks(items: DataFrame, bits: DataFrame) -> DataFrame:
    """owner, mask: the or of the bits of an owner's keys; a bit that a bigint can't hold as a positive number is an error."""
    fits = F.when(F.col("bit").between(0, 62), F.col("bit").cast("int")).otherwise(F.raise_error(F.concat(F.lit("bit beyond 62: "), F.col("bit").cast("string"))).cast("int"))
    return items.join(bits.select("key", fits.alias("bit")), "key").groupBy("owner").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))


def wide_masks(items: DataFrame, bits: DataFrame) -> DataFrame:
    """owner, word, mask: as masks for any number of keys, in words of 62 bits."""
    words = bits.select("key", F.floor(F.col("bit") / 62).cast("bigint").alias("word"), F.pmod("bit", F.lit(62)).cast("int").alias("b"))
    return items.join(words, "key").groupBy("owner", "word").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("mask"))


def primes(n: int) -> list[int]:
    """The first n primes."""
    out: list[int] = []
    x = 2
    while len(out) < n:
        if all(x % p for p in out if p * p <= x):
            out.append(x)
        x += 1
    return out


def factor(product: int, registered: list[int]) -> tuple[dict[int, int], int]:
    """Exponents of the registered primes in product, and the remainder."""
    found = {}
    for p in registered:
        while product > 1 and product % p == 0:
            found[p] = found.get(p, 0) + 1
            product //= p
    return found, product


def dimensions(hints: DataFrame, key: str, hint: str) -> DataFrame:
    """key, dimension (base or ctor), atom, exponent of type hints: leaf types and constructors as multisets of their own."""
    from ledgerloom.functions.keys import atoms

    a = hints.select(key, atoms(hint).alias("a"))
    rows = a.select(key, F.lit("base").alias("dimension"), F.explode("a.base").alias("atom")).unionByName(a.select(key, F.lit("ctor").alias("dimension"), F.explode("a.ctor").alias("atom")))
    return rows.groupBy(key, "dimension", "atom").agg(F.count("*").alias("exponent"))


def glossary_matches(bundles: DataFrame, glossary: DataFrame) -> DataFrame:
    """owner, names, kind of bundles (owner, key) against named sets (name, key): how many names have a bundle's very set.

    kind is match for one name, ambiguous for several (a coherence witness), warning for none. Both sides meet by the
    digest of the set and by the number of its names, so a set that everyone has makes no pairs.
    """
    from ledgerloom.operators.sets import signatures

    own = signatures(bundles.select("owner", F.col("key").alias("element")))
    named = signatures(glossary.select(F.col("name").alias("owner"), F.col("key").alias("element"))).groupBy("set_id").agg(F.count("*").alias("names"))
    j = own.join(named, "set_id", "left").select("owner", F.coalesce("names", F.lit(0)).alias("names"))
    return j.withColumn("kind", F.when(F.col("names") == 0, "warning").when(F.col("names") == 1, "match").otherwise("ambiguous"))


def recurring(bundles: DataFrame, least: int) -> DataFrame:
    """members, first_owner, owners: sets that at least so many owners have, candidates for a registered name of their own."""
    from ledgerloom.operators.sets import signatures

    s = signatures(bundles.select("owner", F.col("key").alias("element")))
    g = s.groupBy("set_id", F.col("n").alias("members")).agg(F.min("owner").alias("first_owner"), F.count("*").alias("owners"))
    return g.where(F.col("owners") >= least).drop("set_id")


def sound(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, sound: multisets (key, exponent) whose masks are disjoint share no factor, and those that share one aren't."""
    g = algebra(a, b).agg(F.coalesce(F.max("gcd"), F.lit(0)).alias("g"), F.count_if(F.col("lcm") > F.col("symdiff")).alias("common"))
    return g.select(((F.col("g") == 0) == (F.col("common") == 0)).alias("sound"))


def registry_by_first_seen(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """key, bit: distinct keys numbered from 0 in the order in which they are first seen (then by name)."""
    first = rows.select(F.col(key).alias("key"), F.col(seq).alias("seq")).dropna(subset=["key"]).groupBy("key").agg(F.min("seq").alias("seq"))
    return numbered(first, ["seq", "key"], "bit").select("key", "bit")


def with_primes(registered: DataFrame) -> DataFrame:
    """registry rows (key, bit) with the prime of each; registered names are schema, and so are as many primes."""
    n = registered.agg(F.coalesce(F.max("bit") + 1, F.lit(0)).alias("n")).first()["n"]  # one number
    table = registered.sparkSession.createDataFrame(list(enumerate(primes(int(n)))), "bit bigint, prime bigint")
    return registered.join(table, "bit").select("key", "bit", "prime")


def save_registry(registered: DataFrame, root: str) -> str:
    """Makes a registry the current version below root in one step."""
    from ledgerloom.session import publish

    return publish(registered, root)


def identity_layers(items: DataFrame) -> DataFrame:
    """owner, canonical (keys with exponents in order), digest: a fingerprint's readable and its short identity.

    Owners are bundles of parameters; the text of one is as long as its distinct keys.
    """
    e = exponents(items).select("owner", F.struct(F.col("key").cast("string").alias("k"), "exponent").alias("p"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: F.concat(p["k"], F.lit("^"), p["exponent"].cast("string"))), "*")
    return e.groupBy("owner").agg(text.alias("canonical")).withColumn("digest", F.concat(F.lit("fp:"), F.substring(F.sha2("canonical", 256), 1, 16)))
