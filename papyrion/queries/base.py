"""The registry of queries and the projection that they share.

Papers are orders (year, journal = customer's nation, citations = price) with three coded
dimensions; keywords are words of part names; raters are pairs of codes on one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.plans.registry import Panel, Scope

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its DuckDB equivalent if SQL can say it."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("paper_id"), "o_custkey", F.year("o_orderdate").cast("int").alias("year"), F.col("o_totalprice").alias("citations"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"),
    )
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    people = people.select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("journal"), F.col("c_mktsegment").alias("segment"))
    return orders.join(people, "o_custkey").drop("o_custkey")


P = """WITH papers AS (SELECT o_orderkey AS paper_id, year(o_orderdate)::INT AS year, o_totalprice AS citations, o_orderpriority AS priority,
o_orderstatus AS status, n_name AS journal, c_mktsegment AS segment
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""

PRIORITY = Panel("priority", "priority", ("4-NOT SPECIFIED",), 3)
STATUS = Panel("status", "status", ("P",), 2)
SEGMENT = Panel("segment", "segment", (), 4)
PANELS = [PRIORITY, STATUS, SEGMENT]
SCOPES = {
    "all": Scope("all", lambda: F.lit(True)),
    "urgent": Scope("urgent", lambda: F.col("priority").isin("1-URGENT", "2-HIGH")),
    "open": Scope("open", lambda: F.col("status") == "O"),
    "recent": Scope("recent", lambda: F.col("year") >= 1999),
}
SCOPE_SQL = P + """, scoped AS (SELECT 'all' AS scope, * FROM papers UNION ALL SELECT 'urgent', * FROM papers WHERE priority IN ('1-URGENT', '2-HIGH')
UNION ALL SELECT 'open', * FROM papers WHERE status = 'O' UNION ALL SELECT 'recent', * FROM papers WHERE year >= 1999)
"""
LONG = """, long AS (SELECT paper_id, 'priority' AS panel, priority AS value, priority <> '4-NOT SPECIFIED' AS observed FROM papers
UNION ALL SELECT paper_id, 'status', status, status <> 'P' FROM papers UNION ALL SELECT paper_id, 'segment', segment, true FROM papers)
"""


