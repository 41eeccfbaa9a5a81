"""Evidence that arrived after a run that would have read it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def missed(evidence: DataFrame, runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """run_id, keys, id, changes: rows that a run's cut-off admits but that arrived after it began, and whether the run would now read that row for its key.

    evidence: keys, id, observed_at, arrived_at.  runs: run_id, started_at, evidence_cutoff.
    A run would read otherwise where the newest row that its cut-off admits is a late
    one: where the cut-off stands before the key's next row.  Rows and cut-offs meet
    on the days between observation and arrival, as an equality; nothing is dropped
    for being late, however late it is.
    """
    following = F.lead("observed_at").over(W.partitionBy(*keys).orderBy("observed_at", "id"))
    rows = evidence.select(*keys, "id", "observed_at", "arrived_at").withColumn("next", following).where(F.col("arrived_at") > F.col("observed_at"))
    day = lambda c: F.to_date(c)
    days = rows.withColumn("day", F.explode(F.sequence(day("observed_at"), day("arrived_at"))))
    begun = runs.where(F.col("evidence_cutoff").isNotNull()).select("run_id", "started_at", "evidence_cutoff", day("evidence_cutoff").alias("day"))
    met = days.join(begun, "day").where((F.col("observed_at") <= F.col("evidence_cutoff")) & (F.col("arrived_at") > F.col("started_at")))
    return met.select("run_id", *keys, "id", (F.col("next").isNull() | (F.col("evidence_cutoff") < F.col("next"))).alias("changes"))


def affected(late: DataFrame) -> DataFrame:
    """run_id, late_rows, changed_keys of runs that late rows concern."""
    return late.groupBy("run_id").agg(F.count("*").alias("late_rows"), F.count_if("changes").alias("changed_keys"))  # a key has one newest row
