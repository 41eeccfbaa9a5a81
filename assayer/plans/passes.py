"""Policy passes: each reads evidence as of one cut-off and returns a verdict per package."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import licence_terms, vocab
from assayer.functions.text import comparable_version, fix_kind, usage_score
from assayer.operators import asof
from assayer.operators.joined import beside
from assayer.plans import details


def currency(packages: DataFrame, evidence: DataFrame, cutoff, surfaces=vocab.SURFACES) -> DataFrame:
    """package_id, a verdict for each surface, overall_status, chosen_authority, detail, error (an odd state of a surface).

    evidence: package_id, surface, id, observed_at, state, version.  packages may
    hold authority_order.  Versions are compared for equality only.
    """
    ties = [asof.determinate(), *[F.col(c).asc_nulls_first() for c in ("channel", "platform") if c in evidence.columns]]
    newest = asof.latest(evidence, ["package_id", "surface"], cutoff, ties)
    stated = F.when(F.col("state") == "ok", F.nullif(comparable_version(F.col("version")), F.lit("")))
    by = newest.select("package_id", F.struct("surface", F.struct("state", stated.alias("version"), "id").alias("row")).alias("entry"))
    found = by.groupBy("package_id").agg(F.map_from_entries(F.collect_list("entry")).alias("rows"))  # a row for each surface at most
    order = F.coalesce(F.expr("nullif(authority_order, array())"), vocab.strings(surfaces)) if "authority_order" in packages.columns else vocab.strings(surfaces)
    whole = beside(packages.select("package_id", order.alias("ordered")), found)
    rows = F.coalesce(F.col("rows"), F.expr("cast(map() as map<string, struct<state: string, version: string, id: bigint>>)"))
    whole = whole.withColumn("rows", rows)
    whole = whole.withColumn("chosen_authority", F.get(F.filter("ordered", lambda s: F.col("rows")[s]["version"].isNotNull()), F.lit(0)))
    head = F.col("rows")[F.col("chosen_authority")]["version"]

    def verdict(surface: str) -> Column:
        row = F.col("rows")[F.lit(surface)]
        return F.when(row.isNull(), "unknown").when(row["state"].isin(*vocab.SENTINELS), row["state"]).when(row["version"].isNull() | head.isNull(), "unknown").when(row["version"] == head, "current").otherwise("behind")

    whole = whole.withColumns({f"{s}_status": verdict(s) for s in surfaces})
    every = F.array(*[f"{s}_status" for s in surfaces])
    counted = F.filter(every, lambda v: v != "not_applicable")
    overall = F.when(F.size(counted) == 0, "not_applicable").otherwise(vocab.worst_of(counted, vocab.CURRENCY))
    detail = F.array_join(F.filter(F.array(*[F.when(F.col(f"{s}_status") == "behind", F.concat(F.lit(f"{s}: "), F.col("rows")[F.lit(s)]["version"], F.lit(" is not "), head)) for s in surfaces]), lambda x: x.isNotNull()), "\n")
    ids = [F.col("rows")[F.lit(s)]["id"].alias(f"{s}_snapshot_id") for s in surfaces]
    fault = F.coalesce(*[_fault(F.col("rows")[F.lit(s)]["state"], vocab.OUTCOME) for s in surfaces])
    return whole.select("package_id", *[f"{s}_status" for s in surfaces], overall.alias("overall_status"), "chosen_authority", detail.alias("detail"), *ids, fault.alias("error"))


def feedstock_presence(packages: DataFrame, evidence: DataFrame, cutoff, days: int = 180) -> DataFrame:
    """package_id, presence_status, activity_age (seconds), feedstock_snapshot_id, detail, error (null but where the state isn't one).

    evidence: package_id, id, observed_at, state, last_activity_at, staged_url, absence_established.
    """
    row = asof.latest(evidence, ["package_id"], cutoff)
    seconds = lambda c: F.unix_seconds(F.lit(cutoff).cast("timestamp")) - F.unix_seconds(F.col(c).cast("timestamp"))
    age, seen, limit = seconds("last_activity_at"), seconds("observed_at"), days * 86400
    status = (
        F.when(F.col("state").isNull(), "unknown")
        .when(F.col("state").isin("error", "unknown", "not_applicable"), F.col("state"))
        .when((F.col("state") == "not_found") & ~F.coalesce("absence_established", F.lit(False)), "unknown")
        .when((F.col("state") == "not_found") & (F.trim(F.coalesce("staged_url", F.lit(""))) != ""), "staged_recipe_pending")
        .when(F.col("state") == "not_found", "absent")
        .when(age.isNull() | (seen > limit), "unknown")
        .when(age <= limit, "present_and_maintained")
        .otherwise("present_and_inactive")
    )
    detail = details.feedstock(status, age, seen, limit)
    return beside(packages.select("package_id"), row).select("package_id", status.alias("presence_status"), F.when(F.col("state") == "ok", age).alias("activity_age"), F.col("id").alias("feedstock_snapshot_id"), detail.alias("detail"), _fault(F.col("state"), vocab.OUTCOME).alias("error"))


def _fault(state: Column, states) -> Column:
    return F.when(~state.isin(*states), F.concat(F.lit("not a state: "), state))


def _finding_verdict() -> Column:
    """A finding row's verdict, null for an odd state; nothing_matched says that the source answered and matched nothing."""
    known = F.col("state").isin("error", "not_found", "unknown")
    return F.when(F.col("state") == "matched", "advisories_matched").when((F.col("state") == "unknown") & F.coalesce("nothing_matched", F.lit(False)), "no_advisory_matched").when(known, "unknown")


def vulnerability(packages: DataFrame, findings: DataFrame, kev: DataFrame, cutoff, risk_order: list[str]) -> DataFrame:
    """package_id, vulnerability_status, kev_membership, risk_level, the rows that support them, detail, and error (an odd state of a finding).

    findings: package_id, id, observed_at, state, nothing_matched, severity.
    kev: package_id, id, observed_at, state, finding_id (null: about the package).
    Findings meet the cross-references that name one; those about a package join the
    rows as they are, since a table that names none would leave a join without a key,
    of every row with every other.  One aggregate reads both.
    """
    current = asof.sweep(findings, ["package_id"], cutoff).select("package_id", "id", "state", "severity", _finding_verdict().alias("verdict"))
    crossed = asof.sweep(kev, ["package_id"], cutoff).select(F.col("package_id").alias("kev_package"), F.col("id").alias("kev_id"), F.col("state").alias("kev_state"), "finding_id")
    named, whole = crossed.where(F.col("finding_id").isNotNull()), crossed.where(F.col("finding_id").isNull())
    both = current.join(named, (current["package_id"] == named["kev_package"]) & (current["id"] == named["finding_id"]), "full_outer").unionByName(whole, allowMissingColumns=True)
    severity = F.array_position(vocab.strings(risk_order), F.lower(F.trim("severity")))
    place = F.when((F.col("state") == "matched") & (severity > 0), severity)
    worst = vocab.rank(F.col("verdict"), vocab.VULNERABILITY)
    said = F.when(F.col("kev_state").isin("listed", "not_listed"), F.col("kev_state")).otherwise("not_established")
    about = F.col("kev_id").isNotNull() & (F.col("id").isNotNull() | F.col("finding_id").isNull())
    answer = F.when(about, said).when(F.col("kev_id").isNull() & (F.col("state") == "matched"), "not_established")
    status = both.groupBy(F.coalesce("package_id", "kev_package").alias("package_id")).agg(
        F.min(F.when(worst.isNotNull(), F.struct(worst.alias("r"), F.col("id"), F.col("state")))).alias("support"),
        F.coalesce(vocab.ranked(F.min(place), risk_order), F.lit("")).alias("risk_level"),
        F.min(F.when(answer.isNotNull(), F.struct(vocab.rank(answer, vocab.KEV).alias("r"), F.col("kev_id")))).alias("kev"),
        F.max(F.when(F.col("id").isNotNull() & F.col("verdict").isNull(), F.concat(F.lit("not a finding state: "), F.coalesce("state", F.lit("none"))))).alias("error"),
        *details.finding_counts(),
    )
    out = beside(packages.select("package_id"), status)
    return out.select(
        "package_id",
        F.coalesce(vocab.ranked(F.col("support.r"), vocab.VULNERABILITY), F.lit("unknown")).alias("vulnerability_status"),
        F.coalesce(vocab.ranked(F.col("kev.r"), vocab.KEV), F.lit("not_established")).alias("kev_membership"),
        F.coalesce("risk_level", F.lit("")).alias("risk_level"),
        F.col("support.id").alias("vulnerability_finding_id"),
        F.col("kev.kev_id").alias("kev_finding_id"),
        details.vulnerability(F.coalesce(vocab.ranked(F.col("support.r"), vocab.VULNERABILITY), F.lit("unknown")), risk_order).alias("detail"),
        "error",
    )


def licence(packages: DataFrame, findings: DataFrame, cutoff, rules: list[tuple[str, str]]) -> DataFrame:
    """package_id, license_outcome, matched_rule, license_finding_id, detail, error (an odd state of a finding).

    findings: package_id, id, observed_at, state, normalized_license.  Rules are
    few and judge an expression on its row.
    """
    said = F.nullif(F.trim("normalized_license"), F.lit(""))
    spoken = (F.col("state") == "normalized") & said.isNotNull()
    rows = asof.sweep(findings, ["package_id"], cutoff).withColumn("judged", licence_terms.disposition(said, rules))
    rows = rows.withColumn("verdict", F.when(spoken, F.coalesce("judged.disposition", F.lit("manual_review"))).otherwise("unknown"))
    counted = F.col("state") != "not_found"
    place = vocab.rank(F.col("verdict"), vocab.LICENCE)
    mark = F.struct(place.alias("r"), F.col("id"), F.col("judged.rule").alias("rule"), F.when(F.col("state") == "normalized", said).alias("expression"))
    status = rows.groupBy("package_id").agg(F.min(F.when(counted, mark)).alias("best"), F.min("id").alias("any_id"), F.max(_fault(F.col("state"), ("normalized", "error", "not_found", "unknown"))).alias("error"), *details.licence_counts(spoken))
    out = beside(packages.select("package_id"), status)
    outcome = F.coalesce(vocab.ranked(F.col("best.r"), vocab.LICENCE), F.lit("unknown"))
    return out.select("package_id", outcome.alias("license_outcome"), F.when(outcome.isin("forbidden", "restricted", "allowed", "manual_review"), F.col("best.rule")).alias("matched_rule"), F.coalesce("best.id", "any_id").alias("license_finding_id"), details.licence(outcome, len(rules)).alias("detail"), "error")


def remediation(packages: DataFrame, findings: DataFrame, evidence: DataFrame, cutoff, targets: dict[str, int], advisory_days: int | None = 2, surfaces=vocab.SURFACES) -> DataFrame:
    """package_id, readiness_status, fixed_version, a fix availability for each surface and the row it was read from, evidence_stale, detail, error (an odd state of a finding).

    findings also hold fixed_range; targets give the days that a surface's evidence
    stays fresh, and a surface without one isn't relied on.  A surface names its first
    row that states the fix, else its first that states a version, and none where it
    wasn't relied on or no version was looked for.  Evidence is stale where the
    advisories are, or any surface that was asked about a matched finding.
    """
    current = asof.sweep(findings, ["package_id"], cutoff)
    checked = current.groupBy("package_id").agg(
        F.max(asof.stale(F.col("observed_at"), cutoff, f"{advisory_days} DAYS") if advisory_days is not None else F.lit(False)).alias("stale"),
        F.count_if(F.col("state") == "matched").alias("matched"),
        F.count_if((F.col("state") != "matched") & ~F.coalesce("nothing_matched", F.lit(False))).alias("open"),
        F.max(F.when(~F.coalesce(F.col("state").isin("matched", "error", "not_found", "unknown"), F.lit(False)), F.concat(F.lit("not a finding state: "), F.coalesce("state", F.lit("none"))))).alias("error"),
    )
    fixed = F.trim("fixed_range")
    kind = fix_kind(F.col("fixed_range"))
    matched = current.where(F.col("state") == "matched").select("package_id", F.col("id").alias("finding_id"), kind.alias("kind"), F.when(kind == "recorded", comparable_version(fixed)).alias("fixed_version"))
    aged = reduce(lambda a, b: a | b, [(F.col("surface") == s) & asof.stale(F.col("observed_at"), cutoff, f"{d} DAYS") for s, d in targets.items()], F.lit(False))
    said = F.when(F.col("state") == "ok", F.nullif(comparable_version(F.col("version")), F.lit("")))
    relied = ~aged & F.col("surface").isin(*targets)
    read = asof.sweep(evidence, ["package_id", "surface"], cutoff).select("package_id", "surface", "id", F.when(relied, said).alias("said"), aged.alias("aged"))
    stated = read.where(F.col("said").isNotNull()).groupBy("package_id", "surface", F.col("said").alias("fixed_version")).agg(F.min("id").alias("row_id"))
    seen = beside(matched, stated, on=["package_id", "fixed_version"]).groupBy("package_id", "finding_id", "kind", "fixed_version").agg(*[F.min(F.when(F.col("surface") == s, F.col("row_id"))).alias(s) for s in surfaces])
    carries = lambda s: F.col(s).isNotNull()
    readiness = F.when(carries("conda_package"), "ready").when(carries("feedstock"), "awaiting_build").when(carries("source") | carries("pypi"), "awaiting_packaging").otherwise("unknown")
    place = vocab.rank(readiness, vocab.READINESS)
    support = seen.groupBy("package_id").agg(F.min(F.struct(place.alias("r"), F.col("finding_id"), F.col("kind"), F.col("fixed_version"), *[F.col(s) for s in surfaces])).alias("s"))
    by_surface = read.groupBy("package_id").agg(*details.surface_marks(surfaces))
    out = beside(packages.select("package_id"), checked, support, by_surface)
    blind = F.coalesce("stale", F.lit(False))
    status = F.when(F.col("matched").isNull() | blind, "unknown").when((F.col("matched") == 0) & (F.col("open") > 0), "unknown").when(F.col("matched") == 0, "not_applicable").otherwise(vocab.ranked(F.col("s.r"), vocab.READINESS))
    fix = lambda s: F.when(~blind & F.col("s")[s].isNotNull(), "published").otherwise("not_read").alias(f"{s}_fix")
    cited = lambda s: F.when(~blind & F.col("s.fixed_version").isNotNull(), F.coalesce(F.col("s")[s], F.col(f"{s}_first"))).alias(f"{s}_snapshot_id")
    old = blind | ((F.coalesce("matched", F.lit(0)) > 0) & reduce(lambda a, b: a | b, [F.coalesce(f"{s}_old", F.lit(False)) for s in surfaces]))
    detail = details.remediation(status, blind, surfaces, targets, advisory_days is not None)
    return out.select("package_id", status.alias("readiness_status"), *[fix(s) for s in surfaces], F.when(~blind, F.col("s.fixed_version")).alias("fixed_version"), F.when(~blind, F.col("s.finding_id")).alias("vulnerability_finding_id"), *[cited(s) for s in surfaces], old.alias("evidence_stale"), detail.alias("detail"), "error")


def python_readiness(packages: DataFrame, assessments: DataFrame, verifications: DataFrame, cutoff, assessed_for: str = "14 DAYS", verified_for: str = "30 DAYS") -> DataFrame:
    """package_id, readiness, evidence_type, evidence_stale, assessment_id, verification_id, detail; a fresh verification beats a fresh assessment."""
    one = lambda rows, name: asof.latest(rows, ["package_id"], cutoff).select("package_id", F.col("id").alias(f"{name}_id"), F.col("state").alias(f"{name}_state"), F.col("observed_at").alias(f"{name}_at"))
    out = beside(packages.select("package_id"), one(assessments, "assessment"), one(verifications, "verification"))
    old_a, old_v = asof.stale(F.col("assessment_at"), cutoff, assessed_for), asof.stale(F.col("verification_at"), cutoff, verified_for)
    verified = F.when(F.col("verification_state") == "verified_compatible", "verified_ready").when(F.col("verification_state") == "verification_failed", "verified_not_ready")
    inferred = F.when(F.col("assessment_state") == "inferred_ready", "inferred_ready").when(F.col("assessment_state") == "inferred_not_ready", "inferred_not_ready")
    none = F.coalesce(F.col("assessment_state") == "not_applicable", F.lit(False)) | F.coalesce(F.col("verification_state") == "not_applicable", F.lit(False))
    use_v, use_a = verified.isNotNull() & ~old_v, inferred.isNotNull() & ~old_a
    return out.select(
        "package_id",
        F.when(none, "not_applicable").when(use_v, verified).when(use_a, inferred).otherwise("unknown").alias("readiness"),
        F.when(none, "none").when(use_v, "verified").when(use_a, "inferred").otherwise("none").alias("evidence_type"),
        F.when(none, False).when(use_v, old_a).when(use_a, old_v).otherwise(old_a | old_v).alias("evidence_stale"),  # what a row says doesn't matter to its age
        F.when(~none, F.col("assessment_id")).alias("assessment_id"),
        F.when(~none, F.col("verification_id")).alias("verification_id"),
        details.python_readiness(none, use_v, use_a, verified, inferred, old_a | old_v).alias("detail"),
    )


# What kind of work a package's verdicts recommend, the first that holds.
WORK_RULES = (
    ("fix_vulnerability", "vulnerability_status", ("advisories_matched",)),
    ("review_license", "license_outcome", ("forbidden", "restricted", "manual_review")),
    ("create_recipe", "feedstock_presence_status", ("absent",)),
    ("update_feedstock", "feedstock_presence_status", ("present_and_inactive", "staged_recipe_pending")),
    ("validate_python_314", "python_readiness", ("inferred_ready", "inferred_not_ready")),
    ("file_tracking_issue", "python_readiness", ("verified_not_ready",)),
    ("file_tracking_issue", "currency_status", ("behind",)),
)
# Priority rules of the standard parameters, the first whose verdicts all hold.
PRIORITY_RULES = (
    ("p1", {"vulnerability_status": "advisories_matched", "remediation_readiness": "ready"}),
    ("p2", {"vulnerability_status": "advisories_matched", "remediation_readiness": "awaiting_build"}),
    ("p3", {"vulnerability_status": "advisories_matched"}),
    ("p4", {"license_outcome": "forbidden"}),
    ("p5", {"currency_status": "behind", "feedstock_presence_status": "present_and_inactive"}),
    ("p6", {"currency_status": "behind", "feedstock_presence_status": "absent"}),
    ("p7", {"license_outcome": "restricted"}),
    ("p8", {"python_readiness": "verified_not_ready"}),
    ("p9", {"python_readiness": "inferred_not_ready"}),
    ("p10", {"currency_status": "behind"}),
)
RISK_ORDER = ["critical", "high", "moderate", "low"]
SCORE_WEIGHTS = {"lobs": 5, "components": 1}


def work_type(verdicts: DataFrame, rules=WORK_RULES) -> Column:
    """The first kind of work whose domain has one of its verdicts; a domain without a row never matches."""
    out = F
    for name, domain, values in rules:
        out = out.when(F.col(domain).isin(*values), name)
    return out.otherwise("unknown")


def priority(verdicts: DataFrame, rules=PRIORITY_RULES) -> Column:
    """A struct of bucket and rule; unknown with no rule where none holds."""
    out = F
    for i, (bucket, when) in enumerate(rules):
        holds = reduce(lambda a, b: a & b, [F.col(c) == v for c, v in when.items()])
        out = out.when(holds, F.struct(F.lit(bucket).alias("bucket"), F.lit(f"rule {i + 1}").alias("rule")))
    none = F.struct(F.lit("unknown").alias("bucket"), F.lit("").alias("rule"))
    return out.otherwise(none) if rules else none


def score(weights: dict[str, int] = SCORE_WEIGHTS) -> Column:
    """The usage score; null without weights."""
    return usage_score([(F.col(c), w) for c, w in weights.items()])


def stated_expressions(findings: DataFrame, cutoff) -> DataFrame:
    """package_id, expressions: the distinct normal expressions that a package's current findings state, sorted."""
    said = F.nullif(F.trim("normalized_license"), F.lit(""))
    rows = asof.sweep(findings, ["package_id"], cutoff).where(F.col("state") == "normalized").select("package_id", said.alias("said")).where(F.col("said").isNotNull())
    return rows.groupBy("package_id").agg(F.array_sort(F.collect_set("said")).alias("expressions"))  # a channel states one
