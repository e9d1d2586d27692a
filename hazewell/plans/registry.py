"""Registry of runnable queries and the SQL text each is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazewell.plans.oracle_tables import CTES
from hazewell.sources.adapters import Tables


class Query(NamedTuple):
    code: str
    build: Callable[[Tables], DataFrame]
    sql: str | None
    rounded: tuple[str, ...]


QUERIES: dict[str, Query] = {}


def query(key: str, code: str, build: Callable[[Tables], DataFrame], sql: str | None = None, rnd: str = "") -> None:
    if key in QUERIES:
        raise ValueError(f"query {key} is registered twice")
    QUERIES[key] = Query(code, build, sql, tuple(rnd.split()))


def tidy(df: DataFrame) -> DataFrame:
    """Round doubles to six places and drop the zone of timestamps, so results compare by value."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def runnable(key: str) -> Callable:
    def run(spark, sf_dir: str) -> DataFrame:
        return tidy(QUERIES[key].build(Tables(spark, sf_dir)))

    run.__name__ = key
    return run


def _needed(text: str, found: list[str]) -> None:
    for name, body in CTES.items():
        if name not in found and re.search(rf"\b{name}\b", text):
            _needed(body, found)
            if name not in found:
                found.append(name)


def oracle_text(key: str) -> str | None:
    q = QUERIES[key]
    if q.sql is None:
        return None
    body = q.sql.strip()
    found: list[str] = []
    _needed(body, found)
    head = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in found)
    if q.rounded:
        cols = ", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in q.rounded)
        select = f"SELECT * REPLACE ({cols}) FROM (\n{body}\n)"
    else:
        select = f"SELECT * FROM (\n{body}\n)"
    return f"WITH {head}\n{select}" if head else select
