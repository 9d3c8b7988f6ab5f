"""Registration of queries, and rounding of their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that gives the same rows if there is one."""

    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            ORACLES[query.__name__] = sql
        return query

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns rounded, as sums of floats depend on their order."""
    return df.select(*[F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema])


def thinned_sql(source: str, key: str, event_id: str, t: str, depth: str, dead: int) -> str:
    """Recursive SQL (after WITH RECURSIVE) of dead-time thinning that keeps the event of least depth: table ``thinned(key, event_id)``."""
    far, deeper = f"o.{t} - k.last >= {dead}", "o.depth < k.best"
    keep = lambda new, old: f"CASE WHEN {far} OR {deeper} THEN {new} ELSE {old} END"
    return f"""o AS (SELECT {key}, {event_id}, {t}, {depth} AS depth, row_number() OVER (PARTITION BY {key} ORDER BY {t}, {depth}, {event_id}) AS rn FROM {source}),
k AS (SELECT {key}, rn, {t} AS last, depth AS best, {event_id}, 1 AS slot FROM o WHERE rn = 1
 UNION ALL SELECT o.{key}, o.rn, {keep("o." + t, "k.last")}, {keep("o.depth", "k.best")}, {keep("o." + event_id, "k." + event_id)}, k.slot + CASE WHEN {far} THEN 1 ELSE 0 END FROM k JOIN o ON o.{key} = k.{key} AND o.rn = k.rn + 1),
thinned AS (SELECT {key}, arg_max({event_id}, rn) AS {event_id} FROM k GROUP BY {key}, slot)"""
