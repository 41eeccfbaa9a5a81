"""The inventory as a table that entries are merged into, with an audit of each change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merged(held: DataFrame, entries: DataFrame, columns: Sequence[str], replace: bool, key: str = "source_package_key") -> DataFrame:
    """key, outcome, and each column's prior and new value.

    held also has retired.  An entry adds, changes (or brings back) or leaves its
    row; with `replace` an active row without an entry is retired.
    """
    old = held.select(key, "retired", F.struct(*columns).alias("prior"))
    new = entries.select(key, F.struct(*columns).alias("new"))
    both = old.join(new, key, "full_outer")
    same = F.to_json("prior").eqNullSafe(F.to_json("new")) & ~F.col("retired")
    gone = F.when(F.col("retired"), "retired_kept").otherwise("retired" if replace else "unchanged")
    outcome = F.when(F.col("prior").isNull(), "added").when(F.col("new").isNull(), gone).when(same, "unchanged").otherwise("changed")
    return both.select(key, outcome.alias("outcome"), "prior", "new")


def changed_fields(changes: DataFrame, columns: Sequence[str], key: str = "source_package_key") -> DataFrame:
    """key, field, prior, new for each column that a change alters."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col("prior")[c].cast("string").alias("prior"), F.col("new")[c].cast("string").alias("new")) for c in columns])
    rows = changes.where(F.col("outcome") == "changed").select(key, F.explode(cells).alias("x"))
    return rows.where(~F.col("x.prior").eqNullSafe(F.col("x.new"))).select(key, "x.field", "x.prior", "x.new")


def repeated(entries: DataFrame, key: str = "source_package_key") -> DataFrame:
    """Keys that stand more than once: must be empty."""
    return entries.groupBy(key).count().where(F.col("count") > 1)


def due(selected: DataFrame, ledger: DataFrame, now, hours: int) -> DataFrame:
    """Packages without a success of the collector inside the observation window."""
    recent = ledger.where((F.col("status") == "succeeded") & (F.col("finished_at") >= F.lit(now) - F.expr(f"INTERVAL {hours} HOURS")))
    return selected.join(recent.select("collector", "package_id").distinct(), ["collector", "package_id"], "left_anti")


def remembered(calls: DataFrame, seconds: int) -> DataFrame:
    """Calls (collector, id, at, refused) with until: for calls after a refusal of their collector's credentials in the same window, when that window ends; null for others."""
    index = F.floor(F.unix_seconds(F.col("at").cast("timestamp")) / seconds)
    rows = calls.withColumn("window", index)
    before = F.max(F.coalesce("refused", F.lit(False))).over(W.partitionBy("collector", "window").orderBy("at", "id").rowsBetween(W.unboundedPreceding, -1))
    until = F.timestamp_seconds((F.col("window") + 1) * seconds).cast("timestamp_ntz")
    return rows.withColumn("until", F.when(before, until)).drop("window")


def admitted(calls: DataFrame, seconds: int, most: int) -> DataFrame:
    """Calls (collector, id, at, cost) with their window and whether its allowance covers them; refused calls use it too."""
    index = F.floor(F.unix_seconds(F.col("at").cast("timestamp")) / seconds).alias("window")
    rows = calls.withColumn("window", index)
    used = F.sum("cost").over(W.partitionBy("collector", "window").orderBy("at", "id").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("admitted", used <= most)
