"""One health row per package, composed from a run's verdicts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import vocab
from assayer.operators.joined import beside


def compose(packages: DataFrame, verdicts: Mapping[str, DataFrame], stamps: Mapping[str, Column]) -> DataFrame:
    """package_id, confidence, a gated status for each of `verdicts` (column: DataFrame of package_id and it), and stamps.

    A package without a verdict is unknown.  Each table has one owner of its column.
    """
    out = beside(packages.select("package_id", "confidence"), *[rows.select("package_id", column) for column, rows in verdicts.items()])
    gates = {c: vocab.gated(F.coalesce(F.col(c), F.lit("unknown")), F.col("confidence")) for c in verdicts}
    return out.withColumns({**gates, **stamps})


def upsert(previous: DataFrame, new: DataFrame, key: str = "package_id") -> DataFrame:
    """New rows, and previous ones of packages that have none: whole rows, never mixed."""
    return beside(previous, new.select(key), on=key, how="left_anti").unionByName(new)


def ending(rows: DataFrame) -> DataFrame:
    """How a run ends, from a row for each package with an error or null: packages, failed, status."""
    bad, good = F.count("error"), F.count_if(F.col("error").isNull())
    status = F.when(bad == 0, "succeeded").when(good == 0, "failed").otherwise("partial")
    return rows.agg(F.count("*").alias("packages"), bad.alias("failed"), status.alias("status"))


def evidence_cutoff(ledger: DataFrame, purge: str = "prune") -> DataFrame:
    """The newest finish that no unfinished run began before: one row; null where none is.  Runs of the purge don't count."""
    ledger = ledger.where(F.col("collector") != purge) if "collector" in ledger.columns else ledger
    bound = ledger.agg(F.min(F.when(F.col("finished_at").isNull(), F.col("started_at"))).alias("bound"))
    done = ledger.where(F.col("finished_at").isNotNull()).crossJoin(F.broadcast(bound))  # the bound is one row
    return done.agg(F.max(F.when(F.col("bound").isNull() | (F.col("finished_at") <= F.col("bound")), F.col("finished_at"))).alias("cutoff"))


def stated_cutoff(ledger: DataFrame):
    """The cut-off of a new run; an error where no finished collection gives one."""
    at = evidence_cutoff(ledger).first()["cutoff"]
    if at is None:
        raise ValueError("no finished collection run gives this policy run a cut-off")
    return at


def needing_review(packages: DataFrame) -> DataFrame:
    """Packages whose identity is anything but verified; a null confidence is not verified."""
    return packages.where(F.coalesce(F.col("confidence") != "verified", F.lit(True)))


def unresolved_left_out(packages: DataFrame, folded: DataFrame) -> DataFrame:
    """How many packages that need review the inventory no longer lists: one row, left_out."""
    absent = folded.where(F.col("absent_since").isNotNull()).select("package_id")
    return needing_review(packages).join(absent, "package_id", "left_semi").agg(F.count("*").alias("left_out"))


def unresolved(packages: DataFrame, folded: DataFrame, breadth: DataFrame) -> DataFrame:
    """Packages that need review and that the inventory still lists, the broadest first."""
    rows = needing_review(packages).join(folded.where(F.col("absent_since").isNotNull()).select("package_id"), "package_id", "left_anti")
    rows = rows.join(breadth, "package_id", "left").select("package_id", "components", "lobs")
    return rows.orderBy(F.desc_nulls_last("components"), F.desc_nulls_last("lobs"), "package_id")


def owned(rows: DataFrame, column: str, values) -> DataFrame:
    """Rows of a pass whose verdict is null or outside its vocabulary: must be empty."""
    return rows.where(F.col(column).isNull() | ~F.col(column).isin(*values))
