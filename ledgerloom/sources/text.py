"""Line-oriented sources as relations: JSON lines, unified diffs, Markdown sections, lint and decision lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON-lines file; blank lines, unreadable ones and other values are left out."""
    raw = spark.read.text(path).where("trim(value) <> ''")
    parsed = raw.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").alias("v"))
    return parsed.where(F.schema_of_variant("v").startswith("OBJECT")).select("r.*")


def json_object(spark: SparkSession, path: str) -> dict:
    """A JSON object file on the driver; anything else reads as an empty object."""
    import json

    rows = spark.read.text(path, wholetext=True).collect()
    try:
        value = json.loads(rows[0].value) if rows else {}
    except ValueError:
        value = {}
    return value if isinstance(value, dict) else {}


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path, ignoreNullFields=False)


def state_or_ledger(spark: SparkSession, folder: str, schema: str, embedded: DataFrame) -> DataFrame:
    """Delta records of *.delta.jsonl in folder if there are any, else the embedded ones."""
    from ledgerloom.session import _hadoop

    p, fs = _hadoop(spark, f"{folder}/*.delta.jsonl")
    found = fs.globStatus(p)
    return json_lines(spark, f"{folder}/*.delta.jsonl", schema) if found else embedded


def numbered_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 0), line of every text; a null text has no lines."""
    return df.select(F.col(key), F.posexplode(F.split(F.col(text), "\r?\n")).alias("line_no", "line"))


def outside_code(lines: DataFrame, key: str) -> DataFrame:
    """Lines that no fence of ``` or ~~~ holds, the fences themselves left out; an open fence holds all that follows."""
    fence = F.col("line").rlike(r"^\s{0,3}(```|~~~)")
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("_n", F.sum(fence.cast("int")).over(w)).where(~fence & (F.col("_n") % 2 == 0)).drop("_n")


def headings(lines: DataFrame, key: str) -> DataFrame:
    """Lines with level and heading of the section they stand in (null before the first); for Markdown with code, of
    outside_code's lines."""
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s+\S", 1))
    title = F.when(level > 0, F.trim(F.regexp_replace("line", r"^#{1,6}\s+", "")))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("heading", F.last(title, ignorenulls=True).over(w)).withColumn("level", F.last(F.when(level > 0, level), ignorenulls=True).over(w)).withColumn("is_heading", level > 0)


def front_matter(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, field, value of the `field: value` lines between leading --- lines."""
    block = F.regexp_extract(F.col(text), r"\A---\r?\n([\s\S]*?)\r?\n---", 1)
    lines = df.select(F.col(key), F.explode(F.split(block, "\r?\n")).alias("l"))
    got = lines.select(key, F.regexp_extract("l", r"^([A-Za-z_][\w.-]*)\s*:", 1).alias("field"), F.trim(F.regexp_replace("l", r"^[^:]*:", "")).alias("value"))
    return got.where("field <> ''")


def diff_ranges(lines: DataFrame, key: str) -> DataFrame:
    """key, path, start, end of the changed ranges of a unified diff given as (key, line_no, line); pure deletions have none."""
    target = F.regexp_extract("line", r"^\+\+\+ (?:b/)?(.+?)(?:\t.*)?$", 1)
    hunk = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    at = lines.withColumn("path", F.last(F.when(target != "", target), ignorenulls=True).over(w)).where(F.regexp_like("line", F.lit(hunk)))
    start = F.regexp_extract("line", hunk, 1).cast("int")
    count = F.coalesce(F.nullif(F.regexp_extract("line", hunk, 2), F.lit("")).cast("int"), F.lit(1))
    return at.where((count > 0) & (F.col("path") != "/dev/null")).select(key, "path", start.alias("start"), (start + count - 1).alias("end"))


def diff_lines(lines: DataFrame, key: str) -> DataFrame:
    """key, path, line: one row per changed line."""
    return diff_ranges(lines, key).select(key, "path", F.explode(F.sequence("start", "end")).alias("line"))


def lint_lines(df: DataFrame, text: str) -> DataFrame:
    """path, line, col, code, message of `path:line:col: CODE message` texts; others are left out."""
    p = r"^(.+?):(\d+):(\d+):\s*([A-Za-z][\w-]*)\s*(.*)$"
    x = lambda i: F.regexp_extract(F.col(text), p, i)
    return df.where(F.regexp_like(F.col(text), F.lit(p))).select(x(1).alias("path"), x(2).cast("int").alias("line"), x(3).cast("int").alias("col"), x(4).alias("code"), F.trim(x(5)).alias("message"), F.lit("warning").alias("severity"))


def decision_lines(df: DataFrame, text: str) -> DataFrame:
    """path, qual, mode, params, meta of `file:qual decision surface params: a, b (meta)` texts."""
    p = r"^(\S+?\.py):(\S+) (decision surface|value-encoded decision) params: ([^(]*?)\s*(?:\((.*)\))?$"
    x = lambda i: F.regexp_extract(F.col(text), p, i)
    return df.where(F.regexp_like(F.col(text), F.lit(p))).select(x(1).alias("path"), x(2).alias("qual"), x(3).alias("mode"), F.filter(F.transform(F.split(x(4), ","), lambda v: F.trim(v)), lambda v: v != "").alias("params"), x(5).alias("meta"))


def perf_samples(df: DataFrame) -> DataFrame:
    """stack (frames joined by ;), weight from (frames array, weight): empty stacks go, a weight that isn't positive is 1."""
    w = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1)
    return df.where(F.size(F.coalesce("frames", F.array())) > 0).groupBy(F.array_join("frames", ";").alias("stack")).agg(F.sum(w).alias("weight"))
