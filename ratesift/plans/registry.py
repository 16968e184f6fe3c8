"""Query registry: a Spark plan per operator and, where SQL can say the same, its SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ratesift.sources.views import Views

PLANS: dict[str, Callable[[Views], DataFrame]] = {}
SQL_BODIES: dict[str, tuple[str, str, bool]] = {}

# Shared WITH entries of the SQL texts, in dependency order.
CTES: dict[str, str] = {
    "log": """SELECT o_custkey AS userId, l_partkey AS itemId, CAST(ceil(l_quantity / 5) * 0.5 AS DOUBLE) AS rating,
        CAST(epoch(o_orderdate) AS BIGINT) AS ts, l_orderkey, l_linenumber
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "ratings": """SELECT userId, itemId, rating, ts FROM (SELECT *, row_number() OVER (PARTITION BY userId, itemId
        ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC, rating DESC) AS rn FROM log) WHERE rn = 1""",
    "items": """SELECT p_partkey AS itemId, p_name AS title, CASE WHEN p_size = 50 THEN '(no genres listed)'
        ELSE p_type || '|' || split_part(p_name, ' ', 2) END AS genres FROM part""",
    "users": """SELECT c_custkey AS userId, 18 + c_custkey % 60 AS age,
        CASE WHEN c_nationkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender, c_mktsegment AS occupation FROM customer""",
    "trust": """SELECT truster, trusted, value, date FROM (SELECT o_custkey AS truster,
        lag(o_custkey) OVER (PARTITION BY c_nationkey ORDER BY o_orderdate, o_orderkey) AS trusted,
        CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE 1 END AS value, CAST(o_orderdate AS DATE) AS date
        FROM orders JOIN customer ON o_custkey = c_custkey) WHERE trusted IS NOT NULL AND truster <> trusted""",
    "sequences": """SELECT event_id, user_id AS userId, CAST(json_extract_string(props, '$.k') AS BIGINT) AS itemId,
        event_type AS category, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events""",
    "rg": """SELECT r.userId, r.itemId, r.rating, unnest(string_split(i.genres, '|')) AS genre
        FROM ratings r JOIN items i USING (itemId) WHERE i.genres <> '(no genres listed)'""",
}
NEEDS: dict[str, tuple[str, ...]] = {"ratings": ("log",), "rg": ("ratings", "items")}


def cte(name: str, text: str, needs: tuple[str, ...] = ()) -> None:
    """Add a shared WITH entry; ``needs`` names the entries it reads."""
    if name in CTES:
        raise ValueError(f"duplicate entry {name}")
    CTES[name], NEEDS[name] = text, needs


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """``WITH`` the named entries (and what they need) in front of ``body``; body may start with its own entries."""
    wanted: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS.get(name, ()):
            visit(need)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        visit(name)
    own = body.lstrip()
    head = ", ".join(f'"{n}" AS ({CTES[n]})' for n in wanted)
    if own[:5].upper() == "WITH ":
        return f"WITH {'RECURSIVE ' if recursive else ''}{head}{', ' if head else ''}{own[5:]}"
    return f"WITH {head} {own}" if head else own


def query(key: str, views: str = "", sql: str | None = None, recursive: bool = False):
    """Register a plan under ``key``; ``sql`` is its SQL body over the named shared views."""

    def add(plan: Callable[[Views], DataFrame]):
        if key in PLANS:
            raise ValueError(f"duplicate query {key}")
        PLANS[key] = plan
        if sql is not None:
            SQL_BODIES[key] = (views, sql, recursive)
        return plan

    return add


def runnable(plan: Callable[[Views], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return plan(Views(spark, folder))

    run.__doc__ = plan.__doc__
    return run


def sql_texts() -> dict[str, str]:
    return {key: with_views(*body) for key, body in SQL_BODIES.items()}
