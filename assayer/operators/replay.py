"""Comparing two runs' derived rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differences(one: DataFrame, other: DataFrame, columns: Sequence[str], key: str = "package_id") -> DataFrame:
    """key, column, before, after for each column that differs; a missing row differs in all."""
    side = lambda rows, name: rows.select(key, F.struct(*[F.col(c).cast("string").alias(c) for c in columns]).alias(name))
    both = side(one, "a").join(side(other, "b"), key, "full_outer")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col("a")[c].alias("before"), F.col("b")[c].alias("after")) for c in columns])
    lone = F.col("a").isNull() | F.col("b").isNull()
    return both.select(key, lone.alias("lone"), F.explode(cells).alias("x")).where(F.col("lone") | ~F.col("x.before").eqNullSafe(F.col("x.after"))).select(key, "x.column", "x.before", "x.after")


def known_cutoffs(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Requests (evidence_cutoff) with known: whether a retained run read at it; what no run read at, a purge may have thinned."""
    held = runs.select("evidence_cutoff").where(F.col("evidence_cutoff").isNotNull()).distinct().withColumn("known", F.lit(True))
    return requests.join(held, "evidence_cutoff", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def require_run(runs: DataFrame, cutoff) -> None:
    """An error if no retained run read at the cut-off."""
    if runs.where(F.col("evidence_cutoff") == F.lit(cutoff)).isEmpty():
        raise ValueError(f"no retained run read at {cutoff}: a replay there would not reproduce one")
