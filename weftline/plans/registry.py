"""The queries over the test tables by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under its name, with its SQL if there is any."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("dq_fk_orphans", "SELECT 'orders' AS child, 'customer' AS parent, count(*) AS orphans FROM orders o WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)")
def dq_fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    lost = orders.select("o_custkey").filter("o_custkey is not null").join(customer.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    return lost.agg(F.count("*").alias("orphans")).select(F.lit("orders").alias("child"), F.lit("customer").alias("parent"), "orphans")
