"""The supplied tables seen as evidence, in Spark and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The cut-off that queries over events read at.
CUTOFF = "2024-01-20 00:00:00"


class Tables:
    """The tables of a folder by name, each read with the columns that a query asks for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def cutoff(self):
        return F.lit(CUTOFF).cast("timestamp_ntz")

    def evidence(self) -> DataFrame:
        """events as an evidence log: id, observed_at, package_id, surface, state, version, value, props."""
        e = F.col("event_type")
        state = F.when(e == "view", "ok").when(e == "click", "unknown").when(e == "purchase", "not_found").when(e == "signup", "not_applicable").otherwise("error")
        return self.events.select(
            F.col("event_id").alias("id"),
            F.col("ts").alias("observed_at"),
            F.col("user_id").alias("package_id"),
            (F.col("event_id") % 4).alias("surface"),
            state.alias("state"),
            F.floor(F.col("value") / 100).cast("string").alias("version"),
            "value",
            "props",
        )

    def packages(self) -> DataFrame:
        """customer as packages: package_id, canonical_name, confidence."""
        n = F.col("c_nationkey") % 3
        confidence = F.when(n == 0, "verified").when(n == 1, "inventory-derived").otherwise("unmapped")
        return self.customer.select(F.col("c_custkey").alias("package_id"), F.col("c_name").alias("canonical_name"), confidence.alias("confidence"))

    def findings(self) -> DataFrame:
        """lineitem as findings in sweeps: package_id, id, observed_at, verdict, state, severity."""
        flag = F.col("l_returnflag")
        return self.lineitem.select(
            F.col("l_partkey").alias("package_id"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.col("l_shipdate").alias("observed_at"),
            F.when(flag == "A", "forbidden").when(flag == "N", "manual_review").otherwise("allowed").alias("verdict"),
            F.when(flag == "A", "matched").when(flag == "N", "unknown").otherwise("not_found").alias("state"),
            F.element_at(F.array(*[F.lit(s) for s in ("critical", "High", " moderate", "low", "odd")]), (F.col("l_linenumber") % 5 + 1).cast("int")).alias("severity"),
            F.floor(F.col("l_quantity") / 10).cast("string").alias("fixed_range"),
        )

    def items(self) -> DataFrame:
        """orders as work items: item_id, package_id, state, bucket, opened_at."""
        status = F.col("o_orderstatus")
        return self.orders.select(
            F.col("o_orderkey").alias("item_id"),
            F.col("o_custkey").alias("package_id"),
            F.when(status == "O", "open").when(status == "P", "in_progress").otherwise("resolved").alias("state"),
            F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)).alias("bucket"),
            F.col("o_orderdate").alias("opened_at"),
            F.col("o_totalprice").alias("price"),
        )


EV = """ev AS (SELECT event_id AS id, ts AS observed_at, user_id AS package_id, event_id % 4 AS surface,
  CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'unknown' WHEN 'purchase' THEN 'not_found' WHEN 'signup' THEN 'not_applicable' ELSE 'error' END AS state,
  CAST(CAST(floor(value / 100) AS BIGINT) AS VARCHAR) AS version, value, props FROM events)"""
EVC = EV + f", evc AS (SELECT * FROM ev WHERE observed_at <= TIMESTAMP '{CUTOFF}')"
PKG = """pkg AS (SELECT c_custkey AS package_id, c_name AS canonical_name,
  CASE c_nationkey % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'inventory-derived' ELSE 'unmapped' END AS confidence FROM customer)"""
FIND = """find AS (SELECT l_partkey AS package_id, l_orderkey * 10 + l_linenumber AS id, l_shipdate AS observed_at,
  CASE l_returnflag WHEN 'A' THEN 'forbidden' WHEN 'N' THEN 'manual_review' ELSE 'allowed' END AS verdict,
  CASE l_returnflag WHEN 'A' THEN 'matched' WHEN 'N' THEN 'unknown' ELSE 'not_found' END AS state,
  ['critical', 'High', ' moderate', 'low', 'odd'][l_linenumber % 5 + 1] AS severity,
  CAST(CAST(floor(l_quantity / 10) AS BIGINT) AS VARCHAR) AS fixed_range FROM lineitem)"""
ITEM = """item AS (SELECT o_orderkey AS item_id, o_custkey AS package_id,
  CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'in_progress' ELSE 'resolved' END AS state,
  'p' || substr(o_orderpriority, 1, 1) AS bucket, o_orderdate AS opened_at, o_totalprice AS price FROM orders)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of Tables as a query, with its SQL."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register
