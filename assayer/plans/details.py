"""What a pass says about a verdict where its other columns don't: empty where they do.

Findings are told by how many there are and the first of them, so that no package
gathers a list of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _lines(*lines: Column) -> Column:
    """The lines that aren't null, in order, apart by a space."""
    return F.concat_ws(" ", *lines)


def feedstock(status: Column, age: Column, seen: Column, limit: int) -> Column:
    """Of a feedstock row (id, state, staged_url): unsure absences, old rows, undatable, queued and future activity."""
    found, ok = F.col("state") == "not_found", F.col("state") == "ok"
    days = limit // 86400
    return F.coalesce(
        F.when(status == "staged_recipe_pending", _text("no feedstock; row ", F.col("id"), " holds an open recipe at ", F.trim("staged_url"))),
        F.when((status == "unknown") & found, _text("row ", F.col("id"), " found no feedstock but could not establish its absence")),
        F.when((status == "unknown") & ok & (seen > limit), _text("row ", F.col("id"), " is older than the ", str(days), " days that activity is judged by")),
        F.when((status == "unknown") & ok, _text("row ", F.col("id"), " states no activity that could be measured against ", str(days), " days")),
        F.when((status == "present_and_maintained") & (age < 0), _text("row ", F.col("id"), " states activity after the cut-off")),
        F.lit(""),
    )


def finding_counts() -> list[Column]:
    """Over findings joined with their cross-references: what the lines about severities and a sweep that doesn't fit need."""
    matched = F.col("state") == "matched"
    loose = matched & F.col("kev_id").isNull()
    other = F.col("id").isNull() & F.col("kev_id").isNotNull() & F.col("finding_id").isNotNull()
    odd = F.col("kev_id").isNotNull() & ~F.coalesce(F.col("kev_state").isin("listed", "not_listed", "error", "not_found", "unknown"), F.lit(False))
    return [
        F.count_if(matched).alias("matched"),
        F.count_if(F.col("kev_id").isNotNull()).alias("crossed"),
        F.count_if(loose).alias("loose"),
        F.min(F.when(loose, F.col("id"))).alias("first_loose"),
        F.count_if(other).alias("foreign"),
        F.min(F.when(other, F.col("kev_id"))).alias("first_foreign"),
        F.count_if(odd).alias("odd_kev"),
        F.min(F.when(odd, F.col("kev_id"))).alias("first_odd"),
        F.count_if(matched & (F.trim(F.coalesce("severity", F.lit(""))) != "")).alias("severities"),
    ]


def vulnerability(status: Column, risk_order: list[str]) -> Column:
    said, by = F.col("support.state"), F.col("support.id")
    none = (status == "unknown") & by.isNotNull()
    blank = (status == "advisories_matched") & (F.coalesce("risk_level", F.lit("")) == "")
    apart = F.concat_ws(", ", F.when(F.col("loose") > 0, _text(F.col("loose"), " matched without a cross-reference, the first ", F.col("first_loose"))), F.when(F.col("foreign") > 0, _text(F.col("foreign"), " cross-references about other findings, the first ", F.col("first_foreign"))))
    return _lines(
        F.when(none & (said == "error"), _text("finding ", by, ": the lookup failed")).when(none & (said == "not_found"), _text("finding ", by, ": the source does not know the locator")).when(none, _text("finding ", by, " establishes nothing")),
        F.when(blank, F.lit("no risk order is recorded") if not risk_order else F.when(F.col("severities") == 0, _text("none of ", F.col("matched"), " matched findings states a severity")).otherwise(_text("no severity of ", F.col("matched"), " matched findings is ranked"))),
        F.when((F.col("crossed") > 0) & (apart != ""), _text("the two sweeps differ: ", apart)),
        F.when(F.col("odd_kev") > 0, _text(F.col("odd_kev"), " cross-references have no state that is known, the first ", F.col("first_odd"))),
    )


def licence_counts(spoken: Column) -> list[Column]:
    state = F.col("state")
    said = F.when(spoken, F.trim("normalized_license"))
    kinds = {"unread": state == "error", "unserved": state == "not_found", "blank": (state == "normalized") & ~spoken, "unclear": ~state.isin("error", "not_found", "normalized")}
    out = [F.count_if(state != "not_found").alias("answered"), F.min(said).alias("one"), F.max(said).alias("other")]
    for name, kind in kinds.items():
        out += [F.count_if(kind).alias(name), F.min(F.when(kind, F.col("id"))).alias(f"first_{name}")]
    return out


def licence(outcome: Column, rules: int) -> Column:
    by = F.col("best.expression")
    told = {"unread": "channels could not be read", "unserved": "channels do not serve the package", "blank": "rows are normalized without an expression", "unclear": "channels state nothing that could be normalized"}
    shown = lambda name: (F.col(name) > 0) & (F.lit(name != "unserved") | (F.col("answered") == 0))
    several = F.coalesce(F.col("one") != F.col("other"), F.lit(False))
    return _lines(
        F.when((outcome == "manual_review") & by.isNotNull(), F.lit("no licence rule is recorded") if not rules else _text(f"none of {rules} rules names ", by)),
        *[F.when((outcome == "unknown") & shown(name), _text(F.col(name), f" {words}, the first ", F.col(f"first_{name}"))) for name, words in told.items()],
        F.when(outcome.isin("forbidden", "restricted", "allowed") & (F.lower("best.rule") != F.lower(by)), _text("no rule names ", by, " whole; its operand ", F.col("best.rule"), " is ", outcome)),
        F.when(several, _text("channels state different licences, from ", F.col("one"), " to ", F.col("other"))).when(F.col("one").isNotNull() & by.isNull(), _text("a channel states ", F.col("one"))),
    )


def surface_marks(surfaces) -> list[Column]:
    """By package, over the surfaces' sweeps: whether a surface's evidence is old, and its first row whose version is relied on."""
    out = []
    for s in surfaces:
        own = F.col("surface") == s
        out += [F.coalesce(F.max(own & F.col("aged")), F.lit(False)).alias(f"{s}_old"), F.min(F.when(own & F.col("said").isNotNull(), F.col("id"))).alias(f"{s}_first")]
    return out


def remediation(status: Column, blind: Column, surfaces, targets: dict[str, int], advisory_target: bool) -> Column:
    by, kind, fixed = F.col("s.finding_id"), F.col("s.kind"), F.col("s.fixed_version")
    named = lambda of: F.array_join(F.filter(F.array(*[F.when(of(s), s) for s in surfaces]), lambda x: x.isNotNull()), ", ")
    old = named(lambda s: F.col(f"{s}_old"))
    unread = named(lambda s: F.col("s")[s].isNull())
    apart = named(lambda s: F.col(f"{s}_first").isNotNull() & F.col("s")[s].isNull())
    without = [s for s in surfaces if s not in targets]
    none = F.when(F.col("matched").isNull(), "no advisory evidence at the cut-off").when(F.col("open") > 0, _text("no advisory matched, and ", F.col("open"), " findings establish nothing")).otherwise("no advisory matched")
    some = _lines(
        F.when(F.col("matched") > 1, _text(F.col("matched"), " findings matched; this is the least ready, ", by)),
        F.when(kind == "unrecorded", _text("finding ", by, " states no fix")).when(kind == "not_comparable", _text("finding ", by, " states a range, not a version")),
        F.when(old != "", _text("old evidence: ", old)),
        F.lit(f"no freshness target: {', '.join(without)}" if without else None).cast("string"),
        F.when((kind == "recorded") & (status == "unknown") & (unread != ""), _text("version ", fixed, " was not seen on: ", unread)),
        F.when((kind == "recorded") & (apart != ""), _text("other versions than ", fixed, " on: ", apart)),
    )
    untimed = F.lit(None if advisory_target else "no freshness target: advisories").cast("string")
    return _lines(untimed, F.when(blind, "the advisory evidence is older than its target").when(by.isNull(), none).otherwise(F.nullif(some, F.lit(""))))


def python_readiness(none: Column, use_v: Column, use_a: Column, verified: Column, inferred: Column, old: Column) -> Column:
    agree = (verified == "verified_ready") == (inferred == "inferred_ready")
    return (
        F.when(none, "the package has no release ecosystem that declares a Python")
        .when(use_v & use_a & agree, "assessment and verification agree")
        .when(use_v & use_a, "assessment and verification disagree; the build decides")
        .when(use_v | use_a, "")
        .when(old, "evidence is older than its target")
        .when(F.col("assessment_id").isNull() & F.col("verification_id").isNull(), "no evidence of either kind")
        .otherwise("the evidence establishes nothing")
    )
