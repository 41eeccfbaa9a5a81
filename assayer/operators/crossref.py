"""Which findings of a package a catalog is asked about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: most advisories that one collection of a package cross-references.
MOST = 500


def _folded(advisory: Column) -> Column:
    return F.lower(F.trim(advisory))


def current(findings: DataFrame, now, fresh: str = "2 DAYS") -> DataFrame:
    """package_id, finding_id, advisory_id: the newest matched finding of each advisory that is fresh, whatever the case of its name, as the newest row spells it.

    findings: package_id, id, observed_at, state, advisory_id.  A finding names no
    advisory where nothing stands in the name: its package is refused (`evidence`).
    """
    rows = findings.where((F.col("state") == "matched") & (F.col("observed_at") >= F.lit(now) - F.expr(f"INTERVAL {fresh}")))
    newest = F.max_by(F.struct(F.col("id").alias("finding_id"), F.trim("advisory_id").alias("advisory_id")), F.struct("observed_at", "id"))
    return rows.groupBy("package_id", _folded(F.col("advisory_id")).alias("name")).agg(newest.alias("n")).select("package_id", "name", "n.finding_id", "n.advisory_id")


def evidence(findings: DataFrame, now, fresh: str = "2 DAYS", most: int = MOST) -> DataFrame:
    """package_id, advisories, excluded, observed, matched, refused: what is recorded against each package that has findings.

    excluded counts matched findings that aren't fresh, matched says whether one was
    ever recorded; refused says why none may be cross-referenced: a finding without
    a name, or more than `most` advisories.
    """
    matched = F.col("state") == "matched"
    recent = F.col("observed_at") >= F.lit(now) - F.expr(f"INTERVAL {fresh}")
    blank = F.coalesce(F.trim("advisory_id"), F.lit("")) == ""
    counts = findings.groupBy("package_id").agg(F.count_if(matched & ~recent).alias("excluded"), (F.count_if(matched) > 0).alias("matched"), (F.count_if(matched & recent & blank) > 0).alias("nameless"))
    named = current(findings, now, fresh).groupBy("package_id").agg(F.count("*").alias("advisories"))
    rows = counts.join(named, "package_id", "left").withColumn("advisories", F.coalesce("advisories", F.lit(0)).cast("long"))
    refused = F.when(F.col("nameless"), "a finding names no advisory").when(F.col("advisories") > most, f"more than {most} advisories")
    return rows.select("package_id", "advisories", "excluded", F.lit(True).alias("observed"), "matched", refused.alias("refused"))


def asked(findings: DataFrame, now, fresh: str = "2 DAYS", most: int = MOST) -> DataFrame:
    """Current findings of the packages that aren't refused, with how many old ones each package left out."""
    sound = evidence(findings, now, fresh, most).where(F.col("refused").isNull()).select("package_id", "excluded")
    return current(findings, now, fresh).drop("name").join(sound, "package_id")


def answers(findings: DataFrame, entries: DataFrame, now, fresh: str = "2 DAYS", most: int = MOST) -> DataFrame:
    """asked's rows with the catalog's answer, and a clause about what was left out where something was."""
    from assayer.sources.documents import listed

    clause = F.when(F.col("excluded") > 0, F.concat(F.col("excluded").cast("string"), F.lit(f" older than {fresh.lower()} were left out"))).otherwise("")
    return listed(asked(findings, now, fresh, most), entries).withColumn("detail", clause)
