"""Configuration and document formats as relations: TOML, nested front matter, pretty JSON, and diffs of a work tree."""

from __future__ import annotations

import json
import re
import subprocess

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONFIG = "section string, key string, value string"
_ITEM = re.compile(r"^(\s*)-\s+(.*)$")
_PAIR = re.compile(r"^(\s*)([^\s:#][^:]*?)\s*:(?:\s+(.*))?$")


def toml_config(spark: SparkSession, text: str) -> DataFrame:
    """section (dotted), key, value (JSON) of a TOML text; a text that doesn't parse has no rows."""
    import tomllib

    try:
        todo, rows = [("", tomllib.loads(text))], []
    except tomllib.TOMLDecodeError:
        todo, rows = [], []
    while todo:
        section, table = todo.pop(0)
        for k, v in table.items():
            if isinstance(v, dict):
                todo.append((f"{section}.{k}" if section else k, v))
            else:
                rows.append((section, k, json.dumps(v, default=str)))
    return spark.createDataFrame(rows, CONFIG)


def _scalar(text: str):
    t = text.strip()
    if t[:1] == "[" and t[-1:] == "]":
        return [_scalar(x) for x in t[1:-1].split(",") if x.strip()]
    if len(t) > 1 and t[0] == t[-1] and t[0] in "\"'":
        return t[1:-1]
    if t in ("", "null", "~"):
        return None
    if t in ("true", "false"):
        return t == "true"
    if re.fullmatch(r"[+-]?\d+", t):
        return int(t)
    return float(t) if re.fullmatch(r"[+-]?\d+\.\d+", t) else t


def read_mapping(lines: list[str]):
    """Block maps and lists by indentation, scalars, quoted texts and flat lists in brackets; other lines are left out."""
    lines = [x.rstrip() for x in lines if x.strip() and not x.lstrip().startswith("#")]

    def block(at: int, indent: int):
        out = None
        while at < len(lines):
            line = lines[at]
            depth = len(line) - len(line.lstrip())
            if depth < indent:
                break
            item, pair = _ITEM.match(line), _PAIR.match(line)
            if item and not isinstance(out, dict):
                out = [] if out is None else out
                if _PAIR.match(item[2]) and item[2][:1] not in "\"'[":
                    lines[at] = " " * (depth + 2) + item[2]
                    value, at = block(at, depth + 2)
                    out.append(value)
                else:
                    out.append(_scalar(item[2]))
                    at += 1
            elif pair and not isinstance(out, list):
                out = {} if out is None else out
                at += 1
                if pair[3] is not None and pair[3].strip():
                    out[pair[2]] = _scalar(pair[3])
                else:
                    below = len(lines[at]) - len(lines[at].lstrip()) if at < len(lines) else -1
                    nested = below > depth or below == depth and bool(_ITEM.match(lines[at]))
                    out[pair[2]], at = block(at, below) if nested else (None, at)
            elif item or pair:
                break
            else:
                at += 1
        return out, at

    return block(0, 0)[0]


@F.pandas_udf(T.StringType())
def front_matter_json(s: pd.Series) -> pd.Series:
    """The mapping between leading --- lines as JSON, with nested lists and maps; null where there is none."""

    def one(text):
        lines = text.split("\n") if text else []
        if not lines or lines[0].strip() != "---":
            return None
        end = next((i for i, x in enumerate(lines[1:], 1) if x.strip() == "---"), None)
        value = read_mapping(lines[1:end]) if end else None
        return json.dumps(value, ensure_ascii=False, sort_keys=True) if isinstance(value, dict) else None

    return s.map(one)


def pretty_json(value) -> str:
    """Indented JSON with ordered keys and a final line break."""
    return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def forest_json(nodes: DataFrame, alts: DataFrame, path: str) -> None:
    """Nodes (kind, key array, meta) and alternatives (kind, inputs, evidence) in order, as JSON lines in two folders."""
    nodes.orderBy("kind", "key").write.mode("overwrite").json(f"{path}/nodes")
    alts.orderBy("kind", "inputs", "evidence").write.mode("overwrite").json(f"{path}/alts")


def phase_timeline(rows: DataFrame, path: str) -> str:
    """Appends phase rows (at, phase, seconds) as JSON lines, and gives their table in Markdown; a run's phases are few."""
    rows.write.mode("append").json(path)
    lines = [f"| {r.at} | {r.phase} | {r.seconds:.3f} |" for r in rows.orderBy("at").toLocalIterator()]
    return "\n".join(["| at | phase | seconds |", "|-|-|-|", *lines]) + "\n"


def git_diff(spark: SparkSession, root: str, *revisions: str) -> DataFrame:
    """line_no, line of a work tree's diff with no context lines, for the diff operators; empty where git fails."""
    done = subprocess.run(["git", "-C", root, "diff", "--unified=0", "--no-color", *revisions], capture_output=True, text=True, check=False)
    lines = done.stdout.splitlines() if done.returncode == 0 else []
    return spark.createDataFrame(list(enumerate(lines)), "line_no bigint, line string")


def invariant(df: DataFrame, kind: str, matches: Column, evidence: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """Violations: of 'never' every row that matches; of 'require' one row if none does; of 'cover' each known evidence
    (column evidence) that no matching row has, as excess. Columns kind, subject."""
    hit = df.where(F.coalesce(matches, F.lit(False)))
    if kind == "never":
        return hit.select(F.lit("never").alias("kind"), F.to_json(F.struct(*df.columns)).alias("subject"))
    if kind == "require":
        return hit.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("require").alias("kind"), F.lit(None).cast("string").alias("subject"))
    if kind == "cover":
        return known.select(evidence).dropna().distinct().join(hit.select(evidence), evidence, "left_anti").select(F.lit("excess").alias("kind"), F.col(evidence).cast("string").alias("subject"))
    raise ValueError(f"unknown kind of invariant: {kind}")
