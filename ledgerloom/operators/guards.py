"""Guards under constant arguments: what can be known of a condition, and what follows for never-marks and raises.

Conditions are evaluated in three values, known true, known false and unknown: false decides an 'and', true an 'or',
names stand for the constants that a call passes, and everything else (calls, attributes, unbound names) is unknown.
"""

from __future__ import annotations

import ast
import json
import operator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = object()
_COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}


def value_of(node: ast.expr, env: dict):
    """The value of an expression, or UNKNOWN."""
    if isinstance(node, ast.Constant):
        return UNKNOWN if isinstance(node.value, bytes) else node.value
    if isinstance(node, ast.Name):
        return env.get(node.id, UNKNOWN)
    if isinstance(node, ast.UnaryOp):
        if isinstance(node.op, ast.Not):
            t = truth_of(node.operand, env)
            return UNKNOWN if t is None else not t
        v = value_of(node.operand, env)
        if isinstance(v, (int, float)) and not isinstance(v, bool) and isinstance(node.op, (ast.USub, ast.UAdd)):
            return -v if isinstance(node.op, ast.USub) else v
        return UNKNOWN
    if isinstance(node, (ast.BoolOp, ast.Compare)):
        t = truth_of(node, env)
        return UNKNOWN if t is None else t
    return UNKNOWN


def truth_of(node: ast.expr, env: dict) -> bool | None:
    """Whether a condition holds, None if that can't be known."""
    if isinstance(node, ast.BoolOp):
        parts = [truth_of(v, env) for v in node.values]
        decides = isinstance(node.op, ast.Or)
        return decides if decides in parts else None if None in parts else not decides
    if isinstance(node, ast.Compare):
        left, known = value_of(node.left, env), True
        for op, right in zip(node.ops, node.comparators):
            v = value_of(right, env)
            if left is UNKNOWN or v is UNKNOWN or type(op) not in _COMPARE:
                known = False
            else:
                try:
                    if not _COMPARE[type(op)](left, v):
                        return False
                except TypeError:
                    known = False
            left = v
        return True if known else None
    v = value_of(node, env)
    return None if v is UNKNOWN else bool(v)


def holds(guard: str | None, env: str | None) -> bool | None:
    """Whether a guard holds under constants given as a JSON object; None for unknown, and for texts that don't parse."""
    try:
        constants = json.loads(env) if env else {}
        return truth_of(ast.parse(guard.strip(), mode="eval").body, constants if isinstance(constants, dict) else {})
    except (SyntaxError, ValueError, AttributeError, RecursionError):
        return None


@F.pandas_udf(T.BooleanType())
def guard_holds(guard: pd.Series, env: pd.Series) -> pd.Series:
    return pd.Series([holds(g, e) for g, e in zip(guard, env)], dtype=object)


def _verdicts(sites: DataFrame, calls: DataFrame) -> DataFrame:
    """sites (fn, site, guard) with how many distinct sets of constants reach them, and make the guard true or false."""
    envs = calls.select("fn", "env").distinct()
    each = sites.select("fn", "site", "guard").distinct().join(envs, "fn", "left").withColumn("h", guard_holds("guard", "env"))
    return each.groupBy("fn", "site", "guard").agg(F.count_if(F.col("h")).alias("yes"), F.count_if(~F.col("h")).alias("no"), F.count("*").alias("n"))


def never_invariants(marks: DataFrame, calls: DataFrame) -> DataFrame:
    """fn, site, status of never-marks (fn, site, guard) under calls (fn, env: constants as JSON): VIOLATION if a call
    makes the guard true, PROVEN_UNREACHABLE if all make it false, else OBLIGATION, as without any call."""
    status = F.when(F.col("yes") > 0, "VIOLATION").when(F.col("no") == F.col("n"), "PROVEN_UNREACHABLE").otherwise("OBLIGATION")
    return _verdicts(marks, calls).select("fn", "site", status.alias("status"))


def exception_obligations(raises: DataFrame, calls: DataFrame) -> DataFrame:
    """fn, site, status of raises (fn, site, guard, never): DEAD under a guard that all calls make false, FORBIDDEN under
    one that a call makes true, else UNKNOWN; raises that are never-marks are left out."""
    status = F.when(F.col("no") == F.col("n"), "DEAD").when(F.col("yes") > 0, "FORBIDDEN").otherwise("UNKNOWN")
    return _verdicts(raises.where(~F.coalesce("never", F.lit(False))), calls).select("fn", "site", status.alias("status"))
