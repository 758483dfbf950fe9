"""Query registry: name -> (Spark function, oracle SQL text or None)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfold.sources.fixtures import TABLES, Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NUMBERED = """
select user_id, event_id, event_type,
       row_number() over (partition by user_id order by ts, event_id) as rn
from events"""


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` with the SQL it must agree with."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_tables(sql)
        return fn
    return wrap


def with_tables(body: str) -> str:
    """Prefix a statement with the table definitions it mentions."""
    texts = {"numbered_events": NUMBERED, **TABLES}
    need: list[str] = []

    def add(name):
        if name in need:
            return
        for other in texts:
            if other != name and re.search(rf"\b{other}\b", texts[name]):
                add(other)
        need.append(name)

    for name in texts:
        if re.search(rf"\b{name}\b", body):
            add(name)
    head = ",\n".join(f"{n} as ({texts[n].strip()})" for n in need)
    body = body.strip()
    if not head:
        return body
    if body.lower().startswith("with recursive "):
        return f"with recursive {head},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {head},\n{body[5:]}"
    return f"with {head}\n{body}"


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: fn(Tables(spark, sf_dir))
    return {k: bind(f) for k, f in QUERIES.items()}


# -- SQL fragments for oracles, written from the formulas and apart from functions.geo
def sql_hav(lat1, lon1, lat2, lon2, radius="6371.0*0.539957") -> str:
    a = (f"(pow(sin((radians({lat2})-radians({lat1}))/2),2)+cos(radians({lat1}))*cos(radians({lat2}))"
         f"*pow(sin((radians({lon2})-radians({lon1}))/2),2))")
    return f"(2*{radius}*atan2(sqrt({a}),sqrt(greatest(1-{a},0))))"


def sql_delta(h1, h0) -> str:
    return f"((({h1})-({h0})+540)-360*floor((({h1})-({h0})+540)/360)-180)"


def sql_bearing(lat1, lon1, lat2, lon2) -> str:
    y = f"sin(radians({lon2})-radians({lon1}))*cos(radians({lat2}))"
    x = (f"cos(radians({lat1}))*sin(radians({lat2}))-sin(radians({lat1}))*cos(radians({lat2}))"
         f"*cos(radians({lon2})-radians({lon1}))")
    d = f"(degrees(atan2({y},{x}))+360)"
    return f"({d}-360*floor({d}/360))"


def sql_date(ts="ts") -> str:
    return f"cast(date '1970-01-01' + cast(floor({ts}/86400) as int) as varchar)"


def sql_month(ts="ts") -> str:
    return f"substr({sql_date(ts)},1,7)"


def sql_hour(ts="ts") -> str:
    return f"cast(floor(({ts}%86400)/3600) as int)"


def sql_dow(ts="ts") -> str:
    return f"cast(dayofweek(date '1970-01-01' + cast(floor({ts}/86400) as int)) as int)"


def sql_cell(x, step) -> str:
    return f"round_even({x}/{step},0)*{step}"


def sql_fixed(x) -> str:
    return f"cast(floor({x}*1e7+0.5) as bigint)"


def sql_mean(x) -> str:
    return f"(cast(sum({sql_fixed(x)}) as bigint)/count({x})/1e7)"
