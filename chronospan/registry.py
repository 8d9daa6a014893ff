"""The registered queries and their SQL, and the SQL fragments that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sources.tables import HOUR

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SERIES = "s AS (SELECT user_id AS rec, epoch_us(ts) AS t, value AS y, event_type AS topic, event_id AS seq FROM events)"
INSTANCES = f"""inst AS (SELECT rec, topic, seq AS iid, t AS a, t + {HOUR} AS b, t + {HOUR // 2} AS e,
    CASE WHEN y >= 20 THEN 'TRUE' ELSE 'UNKNOWN' END AS truth, y FROM s)"""
#: Log edges, each topic's span and median period, and its gaps over five periods.
SPANS = """lg AS (SELECT rec, min(t) AS l0, max(t) AS l1 FROM s GROUP BY rec),
    gp AS (SELECT rec, topic, t AS g0, lead(t) OVER (PARTITION BY rec, topic ORDER BY t, seq) AS g1 FROM s),
    f AS (SELECT rec, topic, min(g0) AS f0, max(g0) AS f1, median(g1 - g0) AS period FROM gp GROUP BY rec, topic),
    wide AS (SELECT gp.* FROM gp JOIN f USING (rec, topic) WHERE g1 - g0 > greatest(1000000, 5 * coalesce(period, 0)))"""


def query(sql: str | None = None):
    """Registers a query and, where given, its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add
