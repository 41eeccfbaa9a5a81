"""Reading an append-only evidence log as of a cut-off."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upto(evidence: DataFrame, cutoff) -> DataFrame:
    """Rows observed at or before the cut-off; the filter reaches the scan."""
    return evidence.where(F.col("observed_at") <= F.lit(cutoff))


def latest(evidence: DataFrame, keys: Sequence[str], cutoff, ties: Sequence[Column] = ()) -> DataFrame:
    """The newest row of each key; of rows at one instant the first by `ties`, then the largest id.

    One shuffle on the keys; tasks drop all but their own newest rows before it.
    """
    order = [F.col("observed_at").desc(), *ties, F.col("id").desc()]
    at = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return upto(evidence, cutoff).withColumn("_at", at).where(F.col("_at") == 1).drop("_at")


def determinate(state: str = "state") -> Column:
    """Tie order: an ok row before others."""
    return F.when(F.col(state) == "ok", 0).otherwise(1)


def sweep(evidence: DataFrame, keys: Sequence[str], cutoff) -> DataFrame:
    """All rows of each key's newest instant."""
    at = F.rank().over(W.partitionBy(*keys).orderBy(F.col("observed_at").desc()))
    return upto(evidence, cutoff).withColumn("_at", at).where(F.col("_at") == 1).drop("_at")


def last(evidence: DataFrame, keys: Sequence[str], cutoff, n: int) -> DataFrame:
    """The newest n rows of each key with their place, newest first."""
    at = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("observed_at").desc(), F.col("id").desc()))
    return upto(evidence, cutoff).withColumn("place", at).where(F.col("place") <= n)


def of(evidence: DataFrame, packages: DataFrame, cutoff) -> DataFrame:
    """The histories of some packages as of the cut-off."""
    return upto(evidence, cutoff).join(packages.select("package_id").distinct(), "package_id", "left_semi")


def newest(evidence: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest instant of each key."""
    return evidence.groupBy(*keys).agg(F.max("observed_at").alias("observed_at"))


def stale(observed_at: Column, now, target: str) -> Column:
    """Whether an observation is older than the target allows; never observed is not stale."""
    return F.coalesce(observed_at < F.lit(now) - F.expr(f"INTERVAL {target}"), F.lit(False))


#: Each collector's freshness target in days.
FRESHNESS_DAYS = {"source_release": 2, "pypi_release": 2, "feedstock": 14, "conda_package": 2, "vulnerability": 2, "kev": 2, "license": 2, "python_readiness": 14, "py314_verification": 30, "resolve_identity": 2, "inventory": 2}
