"""Closed vocabularies with a total precedence, worst first, and aggregates over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The vocabularies and their order, worst first.
OUTCOME = ("error", "unknown", "not_found", "not_applicable", "ok")
CURRENCY = ("error", "behind", "unknown", "not_found", "current")
VULNERABILITY = ("advisories_matched", "unknown", "no_advisory_matched")
KEV = ("listed", "not_established", "not_listed")
LICENCE = ("forbidden", "restricted", "unknown", "manual_review", "allowed")
READINESS = ("blocked", "unknown", "awaiting_packaging", "awaiting_build", "ready")
BUCKETS = ("p1", "p2", "p3", "p4", "p5", "p6", "p7", "p8", "p9", "p10")
SURFACES = ("source", "pypi", "feedstock", "conda_package")
SENTINELS = ("error", "unknown", "not_found", "not_applicable")
CONFIDENCES = ("verified", "inventory-derived", "unmapped")
RUN_STATES = ("running", "succeeded", "partial", "failed", "skipped")
FEEDSTOCK = ("present_and_maintained", "present_and_inactive", "staged_recipe_pending", "absent")
PYTHON = ("verified_ready", "inferred_ready", "verified_not_ready", "inferred_not_ready")
WORK = ("fix_vulnerability", "create_recipe", "file_tracking_issue", "already_tracked", "update_feedstock", "validate_python_314", "review_license", "resolve_identity")


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def rank(value: Column, order) -> Column:
    """The value's place in the order, from 1; null stays null, and a value outside the vocabulary is an error."""
    place = F.array_position(strings(order), value)
    return F.when(place > 0, place).when(value.isNotNull(), F.raise_error(F.concat(F.lit("not in the vocabulary: "), value)).cast("long"))


def known(value: Column, order) -> Column:
    """The value if the vocabulary has it, else null: what else is wrong is for the caller to say."""
    return F.when(value.isin(*order), value)


def ranked(place: Column, order) -> Column:
    return F.when(place.isNotNull(), F.get(strings(order), (place - 1).cast("int")))


def worst(value: Column, order, empty: str = "unknown") -> Column:
    """Aggregate: the worst value of a group; `empty` where it has none."""
    return F.coalesce(ranked(F.min(rank(value, order)), order), F.lit(empty))


def worst_currency(value: Column) -> Column:
    """Aggregate: the worst verdict, with not_applicable left out first."""
    counted = F.when(value != "not_applicable", value)
    return F.when(F.count(value) == 0, "unknown").when(F.count(counted) == 0, "not_applicable").otherwise(ranked(F.min(rank(counted, CURRENCY)), CURRENCY))


def worst_of(values: Column, order, empty: str = "unknown") -> Column:
    """The worst element of an array column."""
    return F.coalesce(ranked(F.array_min(F.transform(values, lambda v: rank(v, order))), order), F.lit(empty))


def bucket_order(bucket: Column) -> Column:
    """A bucket's ordinal; anything else comes last."""
    place = F.array_position(strings(BUCKETS), F.coalesce(bucket, F.lit("")))
    return F.when(place > 0, place).otherwise(len(BUCKETS) + 1).cast("int")


def gated(status: Column, confidence: Column) -> Column:
    """A status as it may be shown: unknown for packages whose identity is unmapped."""
    place = F.array_position(strings(CONFIDENCES), confidence)
    return F.when(place == len(CONFIDENCES), F.lit("unknown")).when(place > 0, status).otherwise(F.raise_error(F.lit("confidence is not in the vocabulary")).cast("string"))


#: Values that aren't shown as their own words.
LABELS = {
    "ok": "OK",
    "kev": "KEV",
    "kev_findings": "KEV findings",
    "pypi_release": "PyPI release",
    "pypi_release_snapshots": "PyPI release snapshots",
    "py314_verification": "Python 3.14 verification",
    "python_verification_results": "Python 3.14 verification results",
    "validate_python_314": "Validate Python 3.14",
}
#: How each status is toned; anything else is plain.
TONES = {
    "tone-ok": ("ok", "current", "no_advisory_matched", "not_listed", "allowed", "verified_ready", "inferred_ready", "present_and_maintained", "already_tracked", "verified", "active", "succeeded"),
    "tone-warn": ("behind", "restricted", "manual_review", "inferred_not_ready", "present_and_inactive", "staged_recipe_pending", "p3", "fix_vulnerability", "review_license", "resolve_identity", "inventory-derived", "partial"),
    "tone-crit": ("advisories_matched", "listed", "forbidden", "verified_not_ready", "p1", "p2", "failed"),
    "tone-unknown": ("unknown", "not_established", "unmapped"),
    "tone-notfound": ("not_found", "absent", "retired"),
    "tone-na": ("not_applicable",),
    "tone-error": ("error",),
    "tone-info": ("running",),
}


def label(value: Column) -> Column:
    """A value in words: fixed ones, else sentence case."""
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    plain = F.translate(value, "_-", "  ")
    return F.coalesce(known[value], F.concat(F.upper(F.left(plain, F.lit(1))), F.substring(plain, 2, 1 << 30)))


def tone(value: Column) -> Column:
    out = F
    for name, values in TONES.items():
        out = out.when(value.isin(*values), name)
    return out.otherwise("tone-plain")
