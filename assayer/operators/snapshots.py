"""As-of reads from the newest rows that were stored at an earlier cut-off, and the days after it."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators import asof
from assayer.sources.parts import Parts


class Snapshots:
    """An evidence log in folders by day (`observed_date`) and each key's newest row at some cut-offs.

    A read takes the last cut-off before its own and only the days since, so what it
    scans doesn't grow with the history.  Appending rows older than a stored cut-off
    drops the cut-offs that they belong under: late rows are never missed.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: Sequence[str]):
        self.spark, self.keys, self.schema = spark, list(keys), schema
        self.log = f"{folder}/log"
        self.stored = Parts(spark, f"{folder}/newest", "taken_at", f"{schema}, taken_at timestamp_ntz")

    def evidence(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, observed_date date").parquet(self.log)

    def append(self, rows: DataFrame) -> None:
        """Appends evidence; stored cut-offs at or after its first instant are dropped before."""
        first = rows.agg(F.min("observed_at")).first()[0]
        version, held = self.stored.manifest()
        if first is not None and (old := [p for p in held if datetime.fromisoformat(p) >= first]):
            self.stored.rewrite(old, self.stored.read([]), version)
        rows.withColumn("observed_date", F.to_date("observed_at")).write.mode("append").partitionBy("observed_date").parquet(self.log)

    def since(self, start: datetime | None, cutoff: datetime) -> DataFrame:
        """Evidence after `start` and up to the cut-off; both bounds prune folders."""
        rows = self.evidence().where((F.col("observed_date") <= F.lit(cutoff.date())) & (F.col("observed_at") <= F.lit(cutoff)))
        return (rows if start is None else rows.where((F.col("observed_date") >= F.lit(start.date())) & (F.col("observed_at") > F.lit(start)))).drop("observed_date")

    def latest(self, cutoff: datetime) -> DataFrame:
        """The newest row of each key at the cut-off, as `asof.latest` gives it."""
        before = [p for p in self.stored.manifest()[1] if datetime.fromisoformat(p) <= cutoff]
        if not before:
            return asof.latest(self.since(None, cutoff), self.keys, cutoff)
        last = max(before, key=datetime.fromisoformat)
        held = self.stored.read([last]).drop("taken_at")
        return asof.latest(held.unionByName(self.since(datetime.fromisoformat(last), cutoff)), self.keys, cutoff)

    def take(self, cutoff: datetime) -> None:
        """Stores the newest rows at a cut-off, from those stored before it."""
        rows = self.latest(cutoff).withColumn("taken_at", F.lit(cutoff).cast("timestamp_ntz"))
        self.stored.rewrite([str(cutoff)], rows)
