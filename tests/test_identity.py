"""Identities: what documents establish, what stays, and corrections one after another."""

from __future__ import annotations

from datetime import datetime, timedelta

from assayer.operators import identity

T0 = datetime(2024, 1, 1)
KNOWN = "package_id long, canonical_name string, source_outcome string, source_repository_url string, release_outcome string, primary_purl string, primary_type string, has_feedstocks boolean, feedstocks array<string>, asked boolean, found boolean, repository_url string"
HELD = "package_id long, canonical_name string, confidence string, source_repository_url string, primary_purl string, primary_type string, conda_purl string, resolved_at timestamp"


def resolutions(spark):
    rows = [
        (1, "Zope.Interface", "not_found", "", "not_found", "", "", False, ["zope", "b-feedstock"], True, True, "https://github.com/z/i"),
        (2, "b", "established", "https://github.com/b/b", "established", "pkg:pypi/b", "pypi", False, None, False, None, None),
        (3, "c", "error", "https://github.com/c/c", "established", "", "", False, [], None, None, None),
        (4, "d", "established", "https://github.com/d/d", "established", "pkg:pypi/d", "pypi", True, None, True, False, None),
        (5, "e", None, None, None, None, None, None, None, True, True, ""),
    ]
    return identity.resolution(spark.createDataFrame(rows, KNOWN))


def test_an_index_that_cannot_be_asked_lowers_nothing(spark):
    out = {r.package_id: r for r in resolutions(spark).collect()}
    said = {p: (r.source_repository_outcome, r.release_ecosystem_outcome, r.feedstock_outcome, r.confidence) for p, r in out.items()}
    assert said == {
        1: ("established", "established", "established", "inventory-derived"),
        2: ("established", "established", "not_found", "inventory-derived"),
        3: ("error", "error", "not_found", "unmapped"),  # what isn't established, or is blank, isn't kept
        4: ("not_found", "not_found", "established", "inventory-derived"),
        5: ("not_found", "established", "not_found", "inventory-derived"),
    }
    assert (out[1].primary_purl, out[1].conda_purl) == ("pkg:pypi/zope-interface", "pkg:conda/zope.interface")
    assert [tuple(f) for f in out[1].feedstocks] == [("zope-feedstock", "https://github.com/conda-forge/zope-feedstock"), ("b-feedstock", "https://github.com/conda-forge/b-feedstock")]
    assert "kept" in out[2].detail and "recorded ones are kept" in out[4].detail and out[5].detail.startswith("the project names no repository")


def test_a_record_keeps_what_a_later_look_does_not_find(spark):
    held = spark.createDataFrame([(p, "n", c, "u", "p", "pypi", "", T0) for p, c in ((1, "verified"), (2, "unmapped"), (3, "inventory-derived"), (4, "verified"), (9, "unmapped"))], HELD)
    at = T0 + timedelta(days=9)
    out = {r.package_id: r for r in identity.recorded(held, resolutions(spark), at).collect()}
    assert {p: (r.confidence, r.downgrade_refused) for p, r in out.items()} == {1: ("verified", True), 2: ("inventory-derived", False), 3: ("unmapped", False), 4: ("verified", True), 9: ("unmapped", False)}
    assert (out[1].source_repository_url, out[4].source_repository_url, out[4].conda_purl) == ("https://github.com/z/i", "u", "pkg:conda/d")
    again = identity.recorded(spark.createDataFrame([r[:-1] for r in out.values()], HELD), resolutions(spark), at + timedelta(days=1))
    assert {r.package_id: r.resolved_at for r in again.collect()} == {1: at, 2: at, 3: at, 4: at, 9: T0}  # nothing changed the second time


def test_feedstocks_are_added_and_outcomes_replaced(spark):
    held = spark.createDataFrame([(1, "zope-feedstock", "old"), (1, "gone-feedstock", "x"), (2, "b2", "y")], "package_id long, name string, url string")
    out = {(r.package_id, r.name): r.url for r in identity.feedstocks(held, resolutions(spark)).collect()}
    assert set(out) == {(1, "zope-feedstock"), (1, "gone-feedstock"), (1, "b-feedstock"), (2, "b2")}
    assert out[1, "zope-feedstock"].endswith("conda-forge/zope-feedstock") and out[1, "gone-feedstock"] == "x"
    kinds = spark.createDataFrame([(1, "feedstock", "unknown", T0), (7, "feedstock", "unknown", T0)], "package_id long, kind string, outcome string, resolved_at timestamp")
    rows = {(r.package_id, r.kind): r.outcome for r in identity.mappings(kinds, resolutions(spark), T0).collect()}
    assert len(rows) == 5 * 5 + 1 and rows[1, "feedstock"] == "established" and rows[7, "feedstock"] == "unknown"


def test_corrections_are_made_one_after_another(spark):
    schema = "correction_id long, package_id long, actor string, permitted boolean, reason string, canonical_name string, display_name string, decided_at timestamp"
    packages = spark.createDataFrame([(1, "a", "A", "unmapped", T0), (2, "b", None, "verified", T0 + timedelta(days=50)), (3, "c", "", "verified", None)], "package_id long, canonical_name string, display_name string, confidence string, resolved_at timestamp")
    day = lambda n: T0 + timedelta(days=n)
    asked = [
        (12, 1, "u", True, "r", "", "", day(2)),
        (11, 1, "u", True, "r", " new ", None, day(1)),
        (13, 2, "u", True, "r", "new", "B", day(3)),  # 11 gave that name to 1
        (14, 2, "u", True, "r", "b", "B", day(4)),  # its own name
        (15, 3, "u", True, "r", None, None, day(5)),  # changes nothing, and is still recorded
        (16, 3, "u", None, "r", "x", None, day(5)),
        (17, 3, "u", True, " \t"[:1], "x", None, day(5)),
        (18, 8, "u", True, "r", "x", None, day(5)),
        (19, 3, "u", True, "r", "b", None, day(5)),
    ]
    after, audit, refused = identity.corrected(packages, spark.createDataFrame(asked, schema))
    assert {r.package_id: tuple(r)[1:] for r in after.collect()} == {1: ("new", "", "verified", day(2)), 2: ("b", "B", "verified", day(50)), 3: ("c", "", "verified", None)}
    told = {r.correction_id: (r.prior_canonical_name, r.new_canonical_name, r.prior_display_name, r.new_display_name, r.prior_confidence) for r in audit.collect()}
    assert told == {11: ("a", "new", "A", "A", "unmapped"), 12: ("new", "new", "A", "", "verified"), 14: ("b", "b", None, "B", "verified"), 15: ("c", "c", "", "", "verified")}
    assert {r.correction_id: r.refused for r in refused.collect()} == {13: "name taken", 16: "not permitted", 17: "no reason", 18: "no such package", 19: "name taken"}
    none = identity.corrected(packages, spark.createDataFrame([], schema))
    assert sorted(none[0].collect()) == sorted(packages.collect()) and not none[1].count() and not none[2].count()
