"""All queries by name, their SQL counterparts where SQL can express them, and SQL fragments that several of them use."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..functions import rules as R
from .fixtures import FRAMES, frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, frames: str, make, sql: str | None = None) -> None:
    """make gets the frames, in order; sql may use them by name, and starts with further CTEs or SELECT."""
    names = frames.split()
    QUERIES[name] = lambda spark, sf_dir: make(*(frame(spark, sf_dir, n) for n in names))
    if sql:
        used = [n for n in FRAMES if n in names or re.search(rf"\b{n}\b", sql)]
        SQL[name] = "WITH " + ", ".join(f"{n} AS ({FRAMES[n]})" for n in used) + (
            "\n" if re.match(r"\s*SELECT", sql) else ",\n"
        ) + sql


def strip_sql(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def blank_sql(c: str) -> str:
    return f"(coalesce({strip_sql(f'CAST({c} AS VARCHAR)')}, '') = '')"


def sanitize_sql(c: str) -> str:
    c = reduce(lambda x, w: f"replace({x}, '{w}', '')", (*R.NOISE, *R.PLACEHOLDERS), c)
    return strip_sql(f"regexp_replace(regexp_replace({c}, '无([0-9])', '\\1', 'g'), '无{{2,}}', '', 'g')")


FIELDS = ["province", "city", "district", "street", "poi"]
