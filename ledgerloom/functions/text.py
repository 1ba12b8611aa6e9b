"""Normal forms of strings and JSON that several operators share."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks: what may surround a value without being part of it.
BLANKS = " \t\n\r\f\v "


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tidy(c: str | Column) -> Column:
    """Surrounding blanks removed."""
    return F.trim(col(c), F.lit(BLANKS))


def identifier(c: str | Column) -> Column:
    """Tidied and lower-cased; blank becomes null."""
    t = F.lower(tidy(c))
    return F.when(t != "", t)


def reference(c: str | Column) -> Column:
    """Tidied, then one leading ./ removed; blank becomes null."""
    t = F.regexp_replace(tidy(c), r"^\./", "")
    return F.when(t != "", t)


def collapse(c: str | Column) -> Column:
    """Runs of blanks become one space, surrounding ones go."""
    return tidy(F.regexp_replace(col(c), r"[\s ]+", " "))


def read_object(text: str | None) -> dict | None:
    """The JSON object in text, also when it was encoded once more as a JSON string; None if there is none."""
    if text is None:
        return None
    try:
        value = json.loads(text)
        if isinstance(value, str):
            value = json.loads(value)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def scalar_text(value) -> str | None:
    """A JSON value as text: strings as they are, everything else as compact JSON; null stays null."""
    if value is None or isinstance(value, str):
        return value
    if value is True or value is False:
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    return json.dumps(value, separators=(",", ":"), sort_keys=True, ensure_ascii=False)
