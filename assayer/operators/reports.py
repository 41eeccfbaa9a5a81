"""The standing reports and the health rows that people read."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import vocab
from assayer.operators.surface import versions


@dataclass(frozen=True)
class Report:
    """Where a report's rows come from (a derived table, or health itself), which hold, and its columns."""

    table: str | None
    condition: str
    columns: tuple[str, ...]
    drops_absent: bool = False


# The six reports.
REPORTS = {
    "kev": Report("vulnerability", "kev_membership = 'listed'", ("vulnerability_status", "risk_level")),
    "feedstock-lag": Report(None, "currency_status = 'behind' OR coalesce(feedstock_presence_status <> 'present_and_maintained', true)", ("currency_status", "feedstock_presence_status"), drops_absent=True),
    "python-314": Report("python_readiness", "readiness IN ('verified_not_ready', 'inferred_not_ready')", ("readiness", "evidence_type")),
    "licence-exceptions": Report("licence", "license_outcome IN ('manual_review', 'restricted', 'forbidden')", ("license_outcome", "matched_rule")),
    "unmapped-identities": Report(None, "confidence = 'unmapped'", ("identity_source",)),
    "stale-evidence": Report(None, "currency_status IN ('unknown', 'error') OR feedstock_presence_status IN ('unknown', 'error')", ("currency_status", "feedstock_presence_status")),
}


def rows(name: str, health: DataFrame, derived: Mapping[str, DataFrame], current_run_only: bool = False) -> DataFrame:
    """canonical_name and the report's columns of packages that it is about, distinct, by name.

    A derived row of any run counts unless current_run_only; packages absent from
    the inventory leave reports that say so.
    """
    report = REPORTS[name]
    base = health.where(F.col("inventory_absent_since").isNull()) if report.drops_absent else health
    if report.table is None:
        base = base.where(F.coalesce(F.expr(report.condition), F.lit(False)))
    else:
        keys = ["package_id", "policy_run_id"] if current_run_only else ["package_id"]
        held = derived[report.table].where(report.condition).select(*keys, *report.columns).distinct()
        base = base.join(held, keys)
    return base.select("package_id", "canonical_name", *report.columns).distinct().orderBy("canonical_name", "package_id")


def left_out(health: DataFrame, name: str) -> DataFrame:
    """One row: how many packages a report leaves out because the inventory doesn't list them."""
    report = REPORTS[name]
    hit = F.coalesce(F.expr(report.condition), F.lit(False)) if report.table is None else F.lit(True)
    gone = F.lit(report.drops_absent) & hit & F.col("inventory_absent_since").isNotNull()
    return health.agg(F.count_if(gone).alias("excluded"))


#: Fixed value: why a report leaves packages out.
ABSENT_REASON = "absent from the inventory at the run's cut-off"


def page(name: str, health: DataFrame, derived: Mapping[str, DataFrame]) -> DataFrame:
    """A report's rows, each with its package's absence tag ('' where the inventory lists it)."""
    tag = F.coalesce(absence_tag(F.col("inventory_absent_since"), F.col("inventory_last_listed")), F.lit(""))
    return rows(name, health, derived).join(health.select("package_id", tag.alias("absence")), "package_id", "left")


def summary(name: str, health: DataFrame, derived: Mapping[str, DataFrame]) -> DataFrame:
    """One row about a report: how many rows, the newest cut-off and the policy versions of their packages, how many packages are left out, and the sentence that says so."""
    own = rows(name, health, derived).select("package_id")
    held = health.join(own.distinct(), "package_id", "left_semi")
    n, counted = F.col("excluded"), own.agg(F.count("*").alias("rows"))
    said = F.when(n == 1, F.concat(F.lit("1 package excluded: "), F.lit(ABSENT_REASON))).otherwise(F.concat(n.cast("string"), F.lit(" packages excluded: "), F.lit(ABSENT_REASON)))
    out = counted.crossJoin(provenance(held)).crossJoin(left_out(health, name))  # one row each
    return out.withColumn("sentence", said if REPORTS[name].drops_absent else F.lit(""))


def provenance(health: DataFrame) -> DataFrame:
    """One row: the newest cut-off and the policy versions behind a report."""
    return health.agg(F.max("evidence_cutoff").alias("evidence_cutoff")).crossJoin(versions(health))  # one row each


def absence_tag(since: Column, last_listed: Column) -> Column:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return F.when(since.isNotNull(), F.concat(F.lit("absent from the inventory since "), day(since), F.coalesce(F.concat(F.lit(" (last listed "), day(last_listed), F.lit(")")), F.lit(""))))


#: Fixed value: what a cell says where the pass wrote no row at this run.
NO_ROW = "no evaluation recorded at this run"


def health_rows(health: DataFrame, derived: Mapping[str, DataFrame], observed: Mapping[str, DataFrame]) -> DataFrame:
    """A row for each package with six cells (status, note, observed_at): of this run only, gated by confidence.

    observed: id and observed_at of the evidence that cells cite: surfaces, findings,
    kev, licences, assessments, verifications, feedstock.
    """
    keys, out = ["package_id", "policy_run_id"], health
    read = {
        "currency": ("chosen_authority", *(f"{s}_snapshot_id" for s in vocab.SURFACES)),  # known as {surface}_cites, as another table has a name of these
        "vulnerability": ("vulnerability_status", "risk_level", "kev_membership", "vulnerability_finding_id", "kev_finding_id"),
        "licence": ("license_outcome", "matched_rule", "license_finding_id"),
        "python_readiness": ("readiness", "evidence_type", "assessment_id", "verification_id"),
        "feedstock_presence": ("feedstock_snapshot_id",),
    }
    for table, columns in read.items():
        own = [F.col(c).alias(c.replace("_snapshot_id", "_cites")) if table == "currency" else F.col(c) for c in columns]
        out = out.join(derived[table].select(*keys, *own, F.lit(True).alias(f"{table}_row")), keys, "left")
    authority, kind = F.col("chosen_authority"), F.col("evidence_type")
    chosen = F.coalesce(*[F.when(authority == s, F.col(f"{s}_cites")) for s in vocab.SURFACES])
    cited = {"surfaces": chosen, "findings": F.col("vulnerability_finding_id"), "kev": F.col("kev_finding_id"), "licences": F.col("license_finding_id"), "assessments": F.when(kind == "inferred", F.col("assessment_id")), "verifications": F.when(kind == "verified", F.col("verification_id")), "feedstock": F.col("feedstock_snapshot_id")}
    out = out.withColumns({f"{n}_cited": c for n, c in cited.items()})
    for n in cited:
        out = out.join(observed[n].select(F.col("id").alias(f"{n}_cited"), F.col("observed_at").alias(f"{n}_at")), f"{n}_cited", "left")
    shown = lambda c, row: F.when(F.col(f"{row}_row").isNull(), "unknown").otherwise(vocab.gated(F.col(c), F.col("confidence")))
    said = lambda note, row, empty: F.when(F.col(f"{row}_row").isNull(), F.lit(NO_ROW)).otherwise(F.coalesce(F.nullif(note, F.lit("")), F.lit(empty)))
    cell = lambda status, note, at: F.struct(status.alias("status"), note.alias("note"), at.alias("observed_at"))
    at = lambda n: F.col(f"{n}_at")
    return out.select(
        "package_id",
        "canonical_name",
        cell(F.col("currency_status"), said(authority, "currency", "no authority chosen"), at("surfaces")).alias("currency"),
        cell(shown("vulnerability_status", "vulnerability"), said(F.col("risk_level"), "vulnerability", "advisory"), at("findings")).alias("vulnerability"),
        cell(shown("kev_membership", "vulnerability"), said(F.lit("kev"), "vulnerability", "kev"), at("kev")).alias("kev"),
        cell(shown("license_outcome", "licence"), said(F.col("matched_rule"), "licence", "licence"), at("licences")).alias("licence"),
        cell(shown("readiness", "python_readiness"), said(kind, "python_readiness", "no evidence"), F.coalesce(at("verifications"), at("assessments"))).alias("python"),
        cell(F.col("feedstock_presence_status"), said(F.lit("feedstock"), "feedstock_presence", "feedstock"), at("feedstock")).alias("feedstock"),
    )


def problems(figures: DataFrame) -> DataFrame:
    """collector, clause: what still stands of a digest's figures; collectors without a problem have no row.

    figures: collector, failed, rate_limited, past_target, never_observed.
    """
    part = lambda c, one, many: F.when(F.coalesce(F.col(c), F.lit(0)) > 0, F.concat(F.col(c).cast("string"), F.lit(" "), F.when(F.col(c) == 1, one).otherwise(many)))
    clause = F.concat_ws(", ", part("failed", "failed collection", "failed collections"), part("rate_limited", "rate-limited", "rate-limited"), part("past_target", "past target", "past target"), part("never_observed", "never observed", "never observed"))
    return figures.select("collector", F.concat(F.col("collector"), F.lit(" "), clause).alias("clause")).where(clause != "")


