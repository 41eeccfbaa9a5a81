"""Columns of the evidence and derived tables, and what each row must satisfy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADER = "id bigint, observed_at timestamp, package_id bigint, source string, state string, detail string, trace_id string"

# What evidence tables hold beside the header.
EVIDENCE = {
    "inventory_snapshots": "source_package_key string, internal_component_count int, internal_lob_count int, apps int, platforms int, downloads int, versions int",
    "source_release_snapshots": "latest_version string, released_at timestamp, last_activity_at timestamp, releases_seen int",
    "pypi_release_snapshots": "latest_version string, released_at timestamp, requires_python string",
    "feedstock_snapshots": "feedstock_name string, feedstock_url string, recipe_version string, recipe_build_number int, recipe_metadata_url string, last_recipe_activity_at timestamp, staged_recipe_url string, absence_established boolean",
    "conda_package_snapshots": "channel string, platform string, published_version string, build_string string, build_number int",
    "vulnerability_findings": "advisory_id string, severity string, affected_range string, fixed_range string, matched_version string, match_confidence string",
    "kev_findings": "vulnerability_finding_id bigint, catalog_date_added timestamp",
    "license_findings": "channel string, raw_license string, normalized_license string, detection_method string",
    "python_readiness_assessments": "python_series string, requires_python string, matching_classifier string, deciding_signal string",
    "python_verification_results": "python_series string, platform string, architecture string, log_reference string",
    "identity_resolution_snapshots": "repository_url string, repository_key string, pypi_asked boolean, pypi_found boolean, pypi_source string, feedstocks array<string>, confidence_recorded string, downgrade_refused boolean",
}

_SENTINELS = "'error', 'unknown', 'not_found', 'not_applicable'"
# The states of each table beside the sentinels, and conditions that no row may break.
STATES = {
    "vulnerability_findings": ("matched",),
    "kev_findings": ("listed", "not_listed"),
    "license_findings": ("normalized",),
    "python_readiness_assessments": ("inferred_ready", "inferred_not_ready"),
    "python_verification_results": ("verified_compatible", "verification_failed"),
}
CHECKS = {
    "inventory_snapshots": ("(internal_component_count IS NOT NULL AND internal_lob_count IS NOT NULL) = (state = 'ok')",),
    "source_release_snapshots": ("(coalesce(latest_version, '') <> '') = (state = 'ok')",),
    "pypi_release_snapshots": ("(coalesce(latest_version, '') <> '') = (state = 'ok')",),
    "feedstock_snapshots": ("coalesce(staged_recipe_url, '') = '' OR state = 'not_found'", "NOT coalesce(absence_established, false) OR state = 'not_found'"),
    "conda_package_snapshots": ("(coalesce(published_version, '') <> '') = (state = 'ok')",),
    "vulnerability_findings": ("(coalesce(advisory_id, '') <> '') = (state = 'matched')", "state <> 'not_applicable'"),
    "kev_findings": ("state <> 'listed' OR vulnerability_finding_id IS NOT NULL",),
    "license_findings": ("(coalesce(normalized_license, '') <> '') = (state = 'normalized')",),
    "python_readiness_assessments": ("(coalesce(deciding_signal, '') <> '') = (state LIKE 'inferred%')",),
    "python_verification_results": ("(coalesce(platform, '') <> '') = (state IN ('verified_compatible', 'verification_failed'))",),
    "identity_resolution_snapshots": ("confidence_recorded IN ('verified', 'inventory-derived', 'unmapped')",),
}
#: Columns that make a reader's key beside package_id.
KEYS = {
    "inventory_snapshots": ("source_package_key",),
    "conda_package_snapshots": ("channel", "platform"),
    "vulnerability_findings": ("advisory_id",),
    "license_findings": ("channel",),
    "python_readiness_assessments": ("python_series",),
    "python_verification_results": ("python_series",),
}


def ddl(table: str) -> str:
    return f"{HEADER}, {EVIDENCE[table]}"


def broken(rows: DataFrame, table: str) -> DataFrame:
    """Rows that break a condition of their table, with which: must be empty."""
    own = STATES.get(table, ("ok",))
    known = f"state IN ({_SENTINELS}, {', '.join(repr(s) for s in own)})"
    rules = [known, "observed_at IS NOT NULL", *CHECKS[table]]
    bad = [F.when(~F.coalesce(F.expr(r), F.lit(False)), F.lit(r)) for r in rules]
    return rows.withColumn("broken", reduce(lambda a, b: F.coalesce(a, b), bad)).where(F.col("broken").isNotNull())
