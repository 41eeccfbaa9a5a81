"""Presence of packages in the inventory, folded from their observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators.asof import upto
from assayer.operators.joined import beside


def presence(inventory: DataFrame, cutoff) -> DataFrame:
    """package_id, absent_since, last_listed, listed_since.

    Only ok and not_found count.  absent_since is the first not_found after the
    last ok, listed_since the first ok after the last not_found.  Both last marks
    come from one aggregation and meet the log again on package_id.
    """
    seen = upto(inventory, cutoff).where(F.col("state").isin("ok", "not_found"))
    mark = F.struct("observed_at", "id")
    of = lambda state: F.max(F.when(F.col("state") == state, mark))
    marks = seen.groupBy("package_id").agg(of("ok").alias("last_ok"), of("not_found").alias("last_missing"))
    both = seen.select("package_id", "state", "observed_at", mark.alias("mark")).join(marks, "package_id")
    gone = (F.col("state") == "not_found") & (F.col("last_ok").isNull() | (F.col("mark") > F.col("last_ok")))
    back = (F.col("state") == "ok") & F.col("last_missing").isNotNull() & (F.col("mark") > F.col("last_missing"))
    folded = both.groupBy("package_id").agg(
        F.min(F.when(gone, F.col("observed_at"))).alias("absent_since"),
        F.max(F.when(F.col("state") == "ok", F.col("observed_at"))).alias("last_listed"),
        F.min(F.when(back, F.col("observed_at"))).alias("listed_since"),
    )
    every = upto(inventory, cutoff).select("package_id").distinct()
    return every.join(folded, "package_id", "left")


def live(inventory: DataFrame) -> DataFrame:
    """The rows that any later fold can still depend on, whatever arrives and in whatever order.

    A fold needs the last ok, the last not_found, and what came after the earlier of
    the two; a row before both can't become part of it.  One row of another state
    stays for a package that has none of these, so that it is still there.
    """
    mark = F.struct("observed_at", "id")
    of = lambda state: F.max(F.when(F.col("state") == state, mark))
    counts = F.col("state").isin("ok", "not_found")
    marks = inventory.groupBy("package_id").agg(of("ok").alias("_ok"), of("not_found").alias("_missing"), F.min(F.when(~counts, mark)).alias("_other"))
    rows = inventory.join(marks, "package_id")
    bound = F.when(F.col("_ok").isNotNull() & F.col("_missing").isNotNull(), F.least("_ok", "_missing"))
    none = F.col("_ok").isNull() & F.col("_missing").isNull()
    keep = (counts & (bound.isNull() | (mark >= bound))) | (~counts & none & (mark == F.col("_other")))
    return rows.where(keep).select(*inventory.columns)


def merged(parts, batch: DataFrame, slots: int = 16) -> int:
    """Takes a batch of observations into a stored summary (`sources.parts.Parts` by slot, live rows only); the same batch again changes nothing.

    Only slots of packages that the batch names are read and written.
    """
    slot = F.pmod(F.xxhash64("package_id"), F.lit(slots)).cast("int")
    rows = batch.withColumn("slot", slot)
    touched = [str(r["slot"]) for r in rows.select("slot").distinct().collect()]  # at most `slots`
    version, _ = parts.manifest()
    columns = [*batch.columns, "slot"]
    held = parts.read(touched).select(*columns).unionByName(rows).dropDuplicates(["package_id", "observed_at", "id"])
    return parts.rewrite(touched, live(held).select(*columns), version) if touched else version


def breadth(inventory: DataFrame, cutoff) -> DataFrame:
    """package_id with the counts of its newest row."""
    counts = F.max_by(F.struct("components", "lobs"), F.struct("observed_at", "id"))
    return upto(inventory, cutoff).groupBy("package_id").agg(counts.alias("b")).select("package_id", "b.components", "b.lobs")


def unnamed(inventory: DataFrame, named: DataFrame, cutoff) -> DataFrame:
    """Packages whose newest row outside the named source keys is ok: package_id, source_key."""
    rest = upto(inventory, cutoff).join(named.select("source_key").distinct(), "source_key", "left_anti")
    newest = rest.groupBy("package_id").agg(F.max_by(F.struct("state", "source_key"), F.struct("observed_at", "id")).alias("n"))
    return newest.where(F.col("n.state") == "ok").select("package_id", "n.source_key")


def stamped(health: DataFrame, folded: DataFrame) -> DataFrame:
    """Health rows with absence stamps: set for packages that are absent, null for others."""
    gone = folded.where(F.col("absent_since").isNotNull()).select("package_id", F.col("absent_since").alias("inventory_absent_since"), F.col("last_listed").alias("inventory_last_listed"))
    return beside(health.drop("inventory_absent_since", "inventory_last_listed"), gone)
