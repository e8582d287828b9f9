"""Registry of the named queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import UNIT_SIGN, UNIT_WORDS, street_words

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a function under its own name, with the SQL that gives the same rows."""

    def add(fn: QueryFn) -> QueryFn:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def sql_normalize(expr: str, strict: bool = True) -> str:
    """DuckDB text of the address rule."""
    units = "|".join((*UNIT_WORDS, UNIT_SIGN))
    out = rf"regexp_replace(trim(lower({expr})), '\b({units})\s*\.?\s*\w*$', '')"
    for word, short in street_words(strict).items():
        out = rf"regexp_replace({out}, '\b{word}\b', '{short}', 'g')"
    out = rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"
    return f"trim(rtrim({out}, '.,'))"


def sql_cell(expr: str) -> str:
    x = f"({expr} * 1000)"
    return f"CAST(floor({x}) + CASE WHEN {x} - floor({x}) >= 0.5 THEN 1 ELSE 0 END AS BIGINT)"
