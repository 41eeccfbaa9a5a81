"""Operators against brute force on small histories."""

from __future__ import annotations

import itertools
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayer import adapters
from assayer.functions import licence_terms, specifiers, text, vocab
from assayer.operators import asof, collection, digest, inventory, presence, replay, retention, surface, workflow
from assayer.plans import passes, registry, rollup, run
from assayer.queries import reading, records, runs, stored, upkeep  # noqa: F401
from assayer.sources import documents, files

T0 = datetime(2024, 1, 1)


def at(n: int) -> datetime:
    return T0 + timedelta(hours=n)


def test_latest_takes_an_ok_row_before_others_at_one_instant(spark):
    rows = spark.createDataFrame([(9, 1, at(1), "error"), (3, 1, at(1), "ok"), (4, 2, at(5), "ok"), (5, 2, None, "ok")], "id long, package_id long, observed_at timestamp, state string")
    got = {r.package_id: r.id for r in asof.latest(rows, ["package_id"], at(2), [asof.determinate()]).collect()}
    assert got == {1: 3}


def test_latest_reads_the_row_between_two_others(spark):
    rows = spark.createDataFrame([(1, 1, at(1), "ok"), (2, 1, at(2), "error"), (3, 1, at(3), "ok")], "id long, package_id long, observed_at timestamp, state string")
    assert asof.latest(rows, ["package_id"], at(2)).first().state == "error"


def test_sweep_keeps_all_rows_of_the_newest_instant(spark):
    rows = spark.createDataFrame([(i, 1, at(1)) for i in range(5)] + [(i, 1, at(2)) for i in range(5, 7)], "id long, package_id long, observed_at timestamp")
    assert asof.sweep(rows, ["package_id"], at(9)).count() == 2


def test_presence_against_a_fold(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for p in range(120):
        history = [(at(rng.randrange(12)), i, rng.choice(["ok", "not_found", "error"])) for i in range(rng.randrange(1, 9))]
        rows += [(p * 100 + i, p, when, s) for when, i, s in history]
        counted = sorted((w, i, s) for w, i, s in history if s in ("ok", "not_found"))
        ok = [x for x in counted if x[2] == "ok"]
        gone = [x for x in counted if x[2] == "not_found"]
        want[p] = (
            min((w for w, i, s in gone if not ok or (w, i) > ok[-1][:2]), default=None),
            max((w for w, _, _ in ok), default=None),
            min((w for w, i, _ in ok if gone and (w, i) > gone[-1][:2]), default=None),
        )
    df = spark.createDataFrame(rows, "id long, package_id long, observed_at timestamp, state string")
    got = {r.package_id: (r.absent_since, r.last_listed, r.listed_since) for r in presence.presence(df, at(99)).collect()}
    assert got == want


def test_retention_against_its_definition(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(8), at(rng.randrange(300))) for i in range(150)]
    cuts = [at(rng.randrange(300)) for _ in range(3)]
    cutoff = at(220)
    times = {k: sorted({t for _, q, t in rows if q == k}) for k in range(8)}
    want = set()
    for i, k, t in rows:
        after = [x for x in times[k] if x > t]
        if t < cutoff and after and not any(t <= c < after[0] for c in cuts):
            want.add(i)
    df = spark.createDataFrame(rows, "id long, package_id long, observed_at timestamp")
    surviving = spark.createDataFrame([(c,) for c in cuts], "evidence_cutoff timestamp")
    assert {r.id for r in retention.removable(df, ["package_id"], surviving, cutoff).collect()} == want
    none = spark.createDataFrame([], "evidence_cutoff timestamp")
    assert retention.removable(df, ["package_id"], none, cutoff).count() >= len(want)


@pytest.mark.parametrize("order", [vocab.OUTCOME, vocab.VULNERABILITY, vocab.KEV, vocab.LICENCE, vocab.READINESS])
def test_the_earlier_of_any_two_states_wins(spark, order):
    pairs = list(itertools.product(order, order))
    df = spark.createDataFrame([(i, v) for i, p in enumerate(pairs) for v in p], "k int, v string")
    got = {r.k: r.w for r in df.groupBy("k").agg(vocab.worst(F.col("v"), order).alias("w")).collect()}
    assert all(got[i] == min(p, key=order.index) for i, p in enumerate(pairs))


def test_lattices_of_nothing_and_of_what_they_do_not_know(spark):
    df = spark.createDataFrame([(1, None), (2, "not_applicable"), (3, "current"), (3, "not_applicable")], "k int, v string")
    got = {r.k: r.w for r in df.groupBy("k").agg(vocab.worst_currency(F.col("v")).alias("w")).collect()}
    assert got == {1: "unknown", 2: "not_applicable", 3: "current"}
    with pytest.raises(Exception, match="not in the vocabulary"):
        spark.createDataFrame([("odd",)], "v string").select(vocab.rank(F.col("v"), vocab.OUTCOME)).collect()


def test_currency_of_the_standard_case(spark):
    rows = [(1, 7, "source", at(1), "ok", "v2.0"), (2, 7, "pypi", at(1), "ok", "2.0"), (3, 7, "feedstock", at(1), "ok", "1.9")]
    evidence = spark.createDataFrame(rows, "id long, package_id long, surface string, observed_at timestamp, state string, version string")
    packages = spark.createDataFrame([(7, ["feedstock"]), (8, [])], "package_id long, authority_order array<string>")
    got = {r.package_id: r for r in passes.currency(packages.drop("authority_order"), evidence, at(9)).collect()}
    assert (got[7].source_status, got[7].pypi_status, got[7].feedstock_status, got[7].conda_package_status, got[7].overall_status) == ("current", "current", "behind", "unknown", "behind")
    assert got[8].overall_status == "unknown" and got[8].chosen_authority is None
    ordered = {r.package_id: r.chosen_authority for r in passes.currency(packages, evidence, at(9)).collect()}
    assert ordered == {7: "feedstock", 8: None}


def test_score_of_the_standard_case(spark):
    got = spark.createDataFrame([(9, 312), (None, 3)], "lobs int, components int").select(passes.score().alias("s")).collect()
    assert [r.s for r in got] == [59, None]


def version_admitted(spec: str, *v: int) -> bool:
    for clause in spec.split(","):
        clause = clause.strip()
        op = next(o for o in ("===", "~=", "==", "!=", ">=", "<=", ">", "<") if clause.startswith(o))
        wild = clause.endswith(".*")
        release = tuple(int(x) for x in clause[len(op) :].removesuffix(".*").split("."))
        padded = (release + (0, 0, 0, 0))[:4]
        starts = v[: len(release)] == release
        good = {"===": v == padded, "==": starts if wild else v == padded, "!=": not starts if wild else v != padded, ">=": v >= padded, "<=": v <= padded, ">": v > padded, "<": v < padded, "~=": v >= padded and v[: len(release) - 1] == release[:-1]}
        if not good[op]:
            return False
    return True


def test_specifiers_against_all_micro_versions(spark):
    rng = random.Random(8)
    specs = []
    for _ in range(250):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            op = rng.choice(["==", "!=", ">=", "<=", ">", "<", "~=", "!=", "=="])
            release = f"3.{rng.randrange(12, 17)}" + rng.choice(["", f".{rng.randrange(3)}"])
            parts.append(op + release + (".*" if op in ("==", "!=") and rng.random() < 0.5 else ""))
        specs.append(",".join(parts))
    got = [r.a for r in spark.createDataFrame([(i, s) for i, s in enumerate(specs)], "i int, s string").orderBy("i").select(specifiers.admits(F.col("s")).alias("a")).collect()]
    for spec, reading in zip(specs, got):
        assert (reading == "admitted") == any(version_admitted(spec, 3, 14, m, k) for m in range(60) for k in (0, 1)), spec


def test_specifiers_that_cannot_be_read(spark):
    rows = [("", "unstated"), (None, "unstated"), (">=x", "unreadable"), ("~=3", "unreadable"), (">=3.*", "unreadable"), (",", "unreadable"), ("3.14", "unreadable"), (",".join(["!=3.1"] * 33), "unreadable")]
    got = [r.a for r in spark.createDataFrame([(i, s) for i, (s, _) in enumerate(rows)], "i int, s string").orderBy("i").select(specifiers.admits(F.col("s")).alias("a")).collect()]
    assert got == [w for _, w in rows]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["MIT", "mit-license", "mit license", "ISC", "odd", "Zlib", "Apache 2.0"]), st.sampled_from([" AND ", " OR ", "  AND "])), min_size=1, max_size=4))
def test_licences_are_read_operand_by_operand(spark, parts):
    raw = "".join(p + (op if i < len(parts) - 1 else "") for i, (p, op) in enumerate(parts))
    whole = {"MIT": "MIT", "mit-license": "MIT", "mit license": "MIT", "ISC": "ISC", "Zlib": "Zlib", "Apache 2.0": "Apache-2.0"}
    one_token = {p: n for p, n in whole.items() if " " not in p}
    ops = {op.strip() for _, op in parts[:-1]}
    want = None
    if len(parts) == 1:
        want = whole.get(parts[0][0])
    elif all(p in one_token for p, _ in parts) and len(ops) == 1:
        want = f" {next(iter(ops))} ".join(one_token[p] for p, _ in parts)
    got = spark.createDataFrame([(raw,)], "r string").select(licence_terms.normalised(F.col("r"))["expression"].alias("e")).first().e
    assert got == want


def test_replay_shows_each_column_that_differs(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", "z")], "package_id long, s string, t string")
    b = spark.createDataFrame([(1, "x", "q"), (3, "n", None)], "package_id long, s string, t string")
    got = {(r.package_id, r["column"], r.before, r.after) for r in replay.differences(a, b, ["s", "t"]).collect()}
    assert got == {(1, "t", None, "q"), (2, "s", "y", None), (2, "t", "z", None), (3, "s", None, "n"), (3, "t", None, None)}
    assert replay.differences(a, a, ["s", "t"]).count() == 0


def test_replay_of_a_pass_is_the_same_after_new_evidence(spark):
    packages = spark.createDataFrame([(1,), (2,)], "package_id long")
    schema = "id long, package_id long, surface string, observed_at timestamp, state string, version string"
    old = [(i, i % 2 + 1, "pypi", at(i), "ok", str(i)) for i in range(6)]
    before = passes.currency(packages, spark.createDataFrame(old, schema), at(5))
    after = passes.currency(packages, spark.createDataFrame([*old, (99, 1, "pypi", at(7), "error", "")], schema), at(5))
    assert replay.differences(before, after, [c for c in before.columns if c != "package_id"]).count() == 0


def test_facets_refuse_values_they_do_not_know(spark):
    health = spark.createDataFrame([(1, 1, "verified")], "package_id long, policy_run_id long, confidence string")
    facets = {"confidence": (None, "confidence", vocab.CONFIDENCES)}
    with pytest.raises(ValueError, match="no such value"):
        surface.faceted(health, facets, {"confidence": ["odd"]})
    assert surface.faceted(health, facets, {"confidence": [""], "other": ["x"]}).count() == 1


def test_transitions_need_the_role_and_the_reason(spark):
    items = spark.createDataFrame([(1, "triaged")], "item_id long, state string")
    requests = [(1, "triaged", "accepted", "leadership", "r"), (1, "triaged", "accepted", "security_reviewer", " "), (1, "triaged", "accepted", "security_reviewer", "r"), (1, "open", "triaged", "leadership", ""), (1, "triaged", "open", "leadership", ""), (2, "open", "triaged", "leadership", "")]
    df = spark.createDataFrame(requests, "item_id long, expected_state string, to_state string, role string, justification string")
    got = {(r.item_id, r.expected_state, r.to_state, r.role, r.justification): r.answer for r in workflow.judged(df, items).collect()}
    assert [got[r] for r in requests] == ["role", "justification", "applied", "stale", "undeclared", "no such item"]


def test_upsert_replaces_whole_rows(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "package_id long, s string")
    b = spark.createDataFrame([(2, None), (3, "c")], "package_id long, s string")
    assert {tuple(r) for r in rollup.upsert(a, b).collect()} == {(1, "a"), (2, None), (3, "c")}


def test_inventory_merge_and_repeats(spark):
    held = spark.createDataFrame([("a", 1, False), ("b", 2, False), ("c", 3, True), ("d", 4, False)], "source_package_key string, n int, retired boolean")
    entries = spark.createDataFrame([("a", 1), ("b", 9), ("e", 5)], "source_package_key string, n int")
    got = {r.source_package_key: r.outcome for r in inventory.merged(held, entries, ["n"], replace=True).collect()}
    assert got == {"a": "unchanged", "b": "changed", "c": "retired_kept", "d": "retired", "e": "added"}
    assert inventory.repeated(entries.union(entries)).count() == 3


def test_documents_are_refused_whole(spark):
    bodies = [(1, '{"identified": true, "findings": [{"advisory_id": "A"}, {"advisory_id": "a"}]}'), (2, '{"findings": [], "odd": 1}'), (3, "not json"), (4, '{"findings": [{"advisory_id": "B"}]}')]
    rows = documents.advisories(spark.createDataFrame(bodies, "package_id long, body string")).collect()
    assert {(r.package_id, r.fault, r.advisory_id) for r in rows} == {(1, "repeated", None), (2, "malformed", None), (3, "malformed", None), (4, None, "B")}


def test_recipe_versions(spark):
    bodies = ['{% set version = "1.2" %}\npackage:\n  version: {{ version }}\n', "package:\n  name: x\n  version: 3.4  # note\nsource:\n  version: 9\n", "package:\n  version: {{ v }}\n", "version: 1\n", "build:\n  number: 7\n"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string").orderBy("i")
    got = df.select(text.recipe_version(F.col("b")).alias("v"), text.build_number(F.col("b")).alias("n")).collect()
    assert [(r.v, r.n) for r in got] == [("1.2", None), ("3.4", None), (None, None), (None, None), (None, 7)]


def test_instants_need_a_zone(spark):
    rows = ["2024-01-01T00:00:00Z", "2024-01-01T01:00:00+01:00", "2024-01-01T00:00:00", "odd", None]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r string").orderBy("i").select(text.instant(F.col("r")).alias("t")).collect()
    assert [r.t for r in got] == [T0, T0, None, None, None]


def test_staged_recipe_needs_one_title(spark):
    item = lambda *titles: '{"items": [' + ", ".join(f'{{"title": "{t}", "html_url": "{t}"}}' for t in titles) + "]}"
    rows = [(1, "my_pkg", item("Add my-pkg recipe", "other")), (2, "p", item("p", "Add p")), (3, "q", item("pq"))]
    got = {r.package_id: r.url for r in documents.staged_recipe(spark.createDataFrame(rows, "package_id long, name string, body string")).collect()}
    assert got == {1: "Add my-pkg recipe", 2: None, 3: None}


def test_collected_states_in_order(spark):
    rows = [(False, True, 200, "b"), (True, True, 200, "b"), (True, False, 404, None), (True, False, 304, None), (True, False, 500, "b"), (True, False, 200, " "), (True, False, 200, "b"), (True, False, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, applicable boolean, refused boolean, status_code int, body string")
    assert [r.state for r in documents.collected(df).orderBy("i").collect()] == ["not_applicable", "error", "not_found", "unmodified", "error", "error", "ok", "error"]


def test_files_round_trip(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_text(",".join(files.WATCHLIST) + "\nk1,n1,1,2,,,,\nk2,n2,x,2,,,,\n")
    assert {(r.source_package_key, r.fault) for r in files.typed(files.watchlist(spark, str(path))).collect()} == {("k1", None), ("k2", "internal_component_count")}
    path.write_text("odd\n")
    with pytest.raises(ValueError, match="header"):
        files.watchlist(spark, str(path))
    rows = spark.createDataFrame([(1, 'a"b'), (2, None)], "i int, s string")
    assert files.export_csv(rows, str(tmp_path / "out"), "run 1") == 2
    assert spark.read.text(str(tmp_path / "out")).count() == 4
    with pytest.raises(ValueError, match="more than"):
        files.export_csv(rows, str(tmp_path / "out"), "run 1", cap=1)
    evidence = spark.createDataFrame([(1, T0)], "id long, observed_at timestamp")
    files.append_evidence(evidence, str(tmp_path / "ev"))
    files.append_evidence(evidence, str(tmp_path / "ev"))
    assert spark.read.parquet(str(tmp_path / "ev")).count() == 2
    derived = spark.createDataFrame([(1, 1), (1, 2)], "package_id int, policy_run_id int")
    files.write_derived(derived, str(tmp_path / "d"))
    files.write_derived(derived.where("policy_run_id = 2"), str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 2


def test_parameters_and_newest_version():
    assert files.newest(["2026.09.4", "2026.09.10", "2026.09.a"]) == "2026.09.a"
    held = files.parameters('[versions."1"]\nfeedstock_inactivity_days = 180\n')
    assert held["1"]["feedstock_inactivity_days"] == 180
    with pytest.raises(ValueError):
        files.parameters('[versions."1"]\nfeedstock_inactivity_days = 0\n')


def test_digest_window_continues_for_two_days():
    assert digest.window_start(at(50), at(2)) == at(2)
    assert digest.window_start(at(51), at(2)) == at(27)
    assert digest.window_start(at(51), None) == at(27)


def test_a_purge_plan_keeps_what_a_surviving_run_cites(spark):
    runs = spark.createDataFrame([(1, at(0), at(1)), (2, at(0), at(1)), (3, at(50), None)], "run_id long, started_at timestamp, finished_at timestamp").withColumn("evidence_cutoff", F.col("started_at"))
    health = spark.createDataFrame([(7, 2)], "package_id long, policy_run_id long")
    rows = spark.createDataFrame([(i, 7, at(i)) for i in range(1, 6)], "id long, package_id long, observed_at timestamp")
    cited = spark.createDataFrame([(1, 1), (2, 2)], "run_id long, cited_id long")
    ledger = spark.createDataFrame([(at(1),), (at(40),), (None,)], "finished_at timestamp")
    plan = retention.plan({"e": rows}, {"e": ["package_id"]}, {"e": [cited]}, runs, health, ledger, at(30))
    assert {r.run_id for r in plan["runs"].collect()} == {1}
    assert {r.id for r in plan["e"].collect()} == {1, 3, 4}
    assert plan["ledger"].count() == 1


def test_everything_but_verified_needs_review(spark):
    from assayer.plans import rollup

    packages = spark.createDataFrame([(1, "verified"), (2, "unmapped"), (3, "inventory_derived"), (4, None), (5, "other"), (6, "inventory_derived")], "package_id long, confidence string")
    folded = spark.createDataFrame([(1, "x"), (6, "x"), (5, None)], "package_id long, absent_since string")
    breadth = spark.createDataFrame([(i, i, i) for i in range(1, 7)], "package_id long, components long, lobs long")
    assert [r.package_id for r in rollup.unresolved(packages, folded, breadth).collect()] == [5, 4, 3, 2]
    assert rollup.unresolved_left_out(packages, folded).first().left_out == 1


def test_a_rollup_column_has_one_owner():
    assert run.REGISTRY.owners() == {"currency_status": "currency", "feedstock_presence_status": "feedstock_presence", "work_type_status": "work_type", "priority_status": "priority"}
    with pytest.raises(ValueError, match="two owners"):
        registry.Registry([registry.Pass("a", "x", None, column="c"), registry.Pass("b", "y", None, column="c")], columns=("c",))


def test_a_run_takes_the_newest_version_unless_told():
    held = {"2024.2": {"feedstock_inactivity_days": 1}, "2024.10": {"feedstock_inactivity_days": 2}}
    assert run.requested(held) == ("2024.10", held["2024.10"])
    assert run.requested(held, "2024.2")[0] == "2024.2"
    with pytest.raises(ValueError, match="nothing is recorded"):
        run.requested(held, "2023")


def test_a_version_without_weights_gives_no_score(spark):
    rows = spark.createDataFrame([(1, 3, 4)], "package_id long, lobs int, components int")
    for weights in ({}, {"lobs": 0}, {"lobs": 0, "components": 0}):
        assert rows.select(passes.score(weights).alias("s")).first().s is None
    assert rows.select(passes.score({"lobs": 1}).alias("s")).first().s == 1 + 3 * 99 // 100


@pytest.mark.parametrize(
    "line",
    [
        "feedstock_inactivity_days = 0",
        "feedstock_inactivity_days = 40000",
        "feedstock_inactivity_days = true",
        "feedstock_inactivity_days = 9\nodd = 1",
        'feedstock_inactivity_days = 9\nlicense_rules = [{expression = "MIT", disposition = "perhaps"}]',
        'feedstock_inactivity_days = 9\nlicense_rules = [{expression = "MIT", disposition = "allowed"}, {expression = "mit", disposition = "forbidden"}]',
        "feedstock_inactivity_days = 9\nvulnerability_risk_order = []",
        'feedstock_inactivity_days = 9\nvulnerability_risk_order = ["High"]',
        'feedstock_inactivity_days = 9\npriority_rules = [{bucket = "p1", when = {}}]',
        'feedstock_inactivity_days = 9\npriority_rules = [{bucket = "p11", when = {currency_status = "behind"}}]',
        'feedstock_inactivity_days = 9\npriority_rules = [{bucket = "p1", when = {odd = "behind"}}]',
        "feedstock_inactivity_days = 9\npriority_score_weights = {apps = 1}",
        "feedstock_inactivity_days = 9\npriority_score_weights = {internal_lob_count = -1}",
    ],
)
def test_parameters_that_cannot_be_applied_are_refused(line):
    with pytest.raises(ValueError, match="1: "):
        files.parameters(f'[versions."1"]\n{line}\n')


def test_a_batch_of_evidence_has_one_instant(spark, tmp_path):
    rows = spark.createDataFrame([(1, at(1)), (2, at(2))], "id long, observed_at timestamp")
    with pytest.raises(ValueError, match="one observed_at"):
        files.append_evidence(rows, f"{tmp_path}/x")
    files.append_evidence(rows.where("id = 1"), f"{tmp_path}/x")
    files.append_evidence(rows.where("id = 2"), f"{tmp_path}/x")
    assert spark.read.parquet(f"{tmp_path}/x").count() == 2


def test_a_run_without_a_finished_collection_has_no_cutoff(spark):
    rows = lambda data: spark.createDataFrame(data, "collector string, started_at timestamp, finished_at timestamp")
    with pytest.raises(ValueError, match="cut-off"):
        rollup.stated_cutoff(rows([("prune", at(1), at(2)), ("c", at(3), None)]))
    assert rollup.stated_cutoff(rows([("prune", at(1), at(9)), ("c", at(1), at(2)), ("c", at(3), None), ("c", at(2), at(4))])) == at(2)


def test_a_replay_needs_a_run_at_its_cutoff(spark):
    runs = spark.createDataFrame([(at(5),), (None,)], "evidence_cutoff timestamp")
    replay.require_run(runs, at(5))
    with pytest.raises(ValueError, match="no retained run"):
        replay.require_run(runs, at(6))


def test_collectors_outlast_their_cadence():
    assert collection.cadence_faults() == []


def test_an_odd_state_costs_its_package_only(spark):
    packages = spark.createDataFrame([(1, "verified"), (2, "verified"), (3, "odd")], "package_id long, confidence string")
    findings = spark.createDataFrame([(1, 10, at(1), "matched", False, "high"), (2, 11, at(1), "odd", False, "high"), (2, 12, at(1), "matched", False, "low")], "package_id long, id long, observed_at timestamp, state string, nothing_matched boolean, severity string")
    kev = spark.createDataFrame([], "package_id long, id long, observed_at timestamp, state string, finding_id long")
    out = passes.vulnerability(packages, findings, kev, at(9), ["high", "low"])
    assert {r.package_id: (r.vulnerability_status, r.error) for r in out.collect()} == {1: ("advisories_matched", None), 2: ("advisories_matched", "not a finding state: odd"), 3: ("unknown", None)}
    assert {r.package_id: r.error for r in run.failures(packages, {"vulnerability": out}).collect()} == {2: "not a finding state: odd", 3: "not a confidence"}


def test_a_declared_pass_runs_where_what_it_needs_is_there(spark, sf_dir):
    """A ninth pass, its rollup column and a step of its own, without a change to the run."""
    from assayer.adapters import Tables
    from assayer.plans.registry import ROLLUP_COLUMNS, Pass, Registry
    from assayer.queries.runs import _PARAMETERS, _tables

    def alarm(c):
        rows = c.verdicts()
        return rows.select("package_id", F.when((F.col("vulnerability_status") == "advisories_matched") & (F.col("currency_status") == "behind"), "unknown").otherwise("not_applicable").alias("alarm"))

    mine = Registry([Pass("alarm", "alarm", alarm, needs=("vulnerability", "currency"), column="alarm_status"), *run.REGISTRY.passes.values()], run.REGISTRY.steps.items(), (*ROLLUP_COLUMNS, "alarm_status"))
    mine.after_run("alarms", lambda out, t: out["alarm"].groupBy("alarm").count())
    assert [p.name for p in mine.ordered()].index("alarm") > [p.name for p in mine.ordered()].index("currency")
    out = run.execute(_tables(Tables(spark, sf_dir)), "2024-01-20 00:00:00", _PARAMETERS, 1, "1", registry=mine)
    assert "alarm_status" in out["health"].columns and sum(r["count"] for r in out["alarms"].collect()) == out["alarm"].count() > 0
    assert "alarm" not in run.REGISTRY.passes


def test_passes_that_need_each_other_or_nobody_are_refused():
    both = registry.Registry([registry.Pass("a", "x", None, needs=("b",)), registry.Pass("b", "y", None, needs=("a",))])
    with pytest.raises(ValueError, match="need each other"):
        both.ordered()
    with pytest.raises(ValueError, match="nobody declares"):
        registry.Registry([registry.Pass("a", "x", None, needs=("z",))]).ordered()
    with pytest.raises(ValueError, match="taken"):
        both.register(registry.Pass("a", "x", None))
    both.after_run("s", len)
    with pytest.raises(ValueError, match="taken"):
        both.after_run("s", len)
    with pytest.raises(ValueError, match="no column"):
        both.register(registry.Pass("c", "x", None, column="odd_status"))


def test_a_table_of_parts_changes_at_once_or_not_at_all(spark, tmp_path):
    from assayer.sources.parts import Changed, Parts

    rows = lambda *values: spark.createDataFrame(values, "id long, day string")
    table = Parts(spark, str(tmp_path / "t"), "day", "id bigint, day string")
    ids = lambda version=None: sorted(r.id for r in table.read(version=version).collect())
    assert ids() == [] and table.append(rows((1, "a"), (2, "b/c"), (3, None))) == 1
    table.append(rows((4, "a")))
    assert ids() == [1, 2, 3, 4] and ids(1) == [1, 2, 3]
    before = table.manifest()[1]
    assert table.rewrite(["a"], rows((4, "a"))) == 3 and ids() == [2, 3, 4]
    assert {k: v for k, v in table.manifest()[1].items() if k != "a"} == {k: v for k, v in before.items() if k != "a"}
    with pytest.raises(Changed):
        table.rewrite(["a"], rows(), version=2)
    with pytest.raises(Changed):
        table._commit(2, {})
    with pytest.raises(ValueError, match="other parts"):
        table.rewrite(["a"], rows((9, "z")))
    assert table.rewrite(["a", ""], rows()) == 4 and ids() == [2]
    assert table.swept() > 0 and ids() == [2] and table.versions() == [4]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.sampled_from(["ok", "not_found", "error"])), min_size=1, max_size=25), st.randoms())
def test_live_rows_fold_like_all_rows_after_each_batch(spark, log, rng):
    rows = [(p, i, datetime(2024, 1, 1) + timedelta(hours=i // 2), s) for i, (p, s) in enumerate(log)]
    shape = "package_id long, id long, observed_at timestamp_ntz, state string"
    mixed = rng.sample(rows, len(rows))
    held, shown = [], lambda df: sorted(presence.presence(df, datetime(2030, 1, 1)).collect(), key=lambda r: r.package_id)
    for k in range(0, len(mixed), 9):
        held = [tuple(r) for r in presence.live(spark.createDataFrame(held + mixed[k : k + 9], shape)).collect()]
        assert shown(spark.createDataFrame(held, shape)) == shown(spark.createDataFrame(mixed[: k + 9], shape))


def test_snapshot_reads_scan_only_the_days_after_the_last_one(spark, sf_dir):
    from assayer.adapters import Tables
    from assayer.queries.stored import snapshots

    kept = snapshots(Tables(spark, sf_dir))
    assert sorted(kept.stored.manifest()[1]) == ["2024-01-04 00:00:00", "2024-01-15 00:00:00"]  # late rows dropped the others
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = kept.latest(datetime(2024, 1, 20))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "observed_date" in line)
    assert "(observed_date" in scan and "<= 2024-01-20" in scan and ">= 2024-01-15" in scan


def test_a_pass_over_buckets_shuffles_nothing(spark, sf_dir):
    from assayer.adapters import Tables
    from assayer.queries.stored import bucketed_currency

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables of any size
    try:
        out = bucketed_currency(Tables(spark, sf_dir), 4)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SelectedBucketsCount" in plan
        assert out.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_batch_of_documents_leaves_a_row_each_and_the_same_twice(spark, tmp_path):
    from assayer.streaming import typed

    at = datetime(2024, 1, 1)
    rows = [(1, at, "license", 1, True, False, 200, '{"license": "MIT"}'), (2, at, "license", 1, True, False, 304, None), (3, at, "license", 2, True, False, 304, None), (4, at, "license", 2, None, None, None, None), (5, None, "license", None, True, False, 200, "{["), (6, at, "odd", 1, True, False, 200, "{}"), (7, at, "pypi_release", 1, True, False, 200, '{"info": {"version": "1"}}')]
    df = spark.createDataFrame(rows, typed.BRONZE)
    for _ in range(2):
        typed.batch(df, 3, str(tmp_path))
    got = {r.id: (r.state, r.normalized_license, r.detail) for r in typed.table(spark, str(tmp_path), "license_findings").collect()}
    assert got == {1: ("normalized", "MIT", ""), 2: ("normalized", "MIT", ""), 3: ("error", None, "unmodified, and nothing was kept"), 4: ("error", None, "status none"), 5: ("error", None, "the document could not be read")}
    typed.batch(spark.createDataFrame([(8, at, "license", 1, True, False, 304, None)], typed.BRONZE), 4, str(tmp_path))
    assert {r.id: r.state for r in typed.table(spark, str(tmp_path), "license_findings").collect()}[8] == "normalized"


def test_late_rows_are_told_whatever_their_delay(spark):
    from assayer.operators import late

    at = lambda d, h=0: datetime(2024, 1, d, h)
    rows = [(1, 1, at(1), at(1)), (1, 2, at(2), at(9)), (1, 3, at(5), at(5)), (2, 4, at(3), at(30))]
    runs = [(2, at(2, 2), at(2, 1)), (4, at(4, 2), at(4, 1)), (6, at(6, 2), at(6, 1)), (9, at(9, 2), at(8, 1)), (31, at(31), None)]
    got = late.missed(spark.createDataFrame(rows, "package_id long, id long, observed_at timestamp_ntz, arrived_at timestamp_ntz"), spark.createDataFrame(runs, "run_id long, started_at timestamp_ntz, evidence_cutoff timestamp_ntz"), ["package_id"])
    assert {(r.run_id, r.id): r.changes for r in got.collect()} == {(2, 2): True, (4, 2): True, (6, 2): False, (4, 4): True, (6, 4): True, (9, 4): True}
    assert late.affected(got).where("run_id = 6").first().changed_keys == 1


def test_a_run_that_breaks_off_is_recorded_and_unknown_cutoffs_are_refused(spark, sf_dir, tmp_path):
    from assayer.adapters import Tables
    from assayer.queries.runs import _PARAMETERS, _tables

    t = _tables(Tables(spark, sf_dir))
    t["ledger"] = spark.createDataFrame([(datetime(2024, 1, 1), datetime(2024, 1, 2))], "started_at timestamp_ntz, finished_at timestamp_ntz")
    held = run.Recorded(spark, str(tmp_path))
    with pytest.raises(ValueError, match="no such signal"):
        held.run(t, {"1": {**_PARAMETERS, "priority_score_weights": {"odd": 1}}}, datetime.now)
    assert [(r.run_id, r.status, r.evidence_cutoff) for r in held.runs().collect()] == [(1, "failed", datetime(2024, 1, 2))]
    with pytest.raises(ValueError, match="no retained run"):
        run.compare(t, datetime(2024, 1, 3), _PARAMETERS, {}, held.runs())
    with pytest.raises(ValueError, match="no finished run"):
        held.replay(t, {"1": _PARAMETERS}, 5)
    empty = {**t, "ledger": t["ledger"].where("false")}
    with pytest.raises(ValueError, match="no finished collection"):
        held.run(empty, {"1": _PARAMETERS}, datetime.now)
    assert held.runs().count() == 1


def test_requests_about_one_item_are_judged_in_turn(spark):
    at = lambda m: datetime(2024, 1, 1, 0, m)
    rows = [(1, at(0), 7, "open", "triaged", "leadership", None), (2, at(0), 7, "open", "triaged", "leadership", None), (3, at(5), 7, "triaged", "accepted", "leadership", "x"), (4, at(5), 7, "triaged", "accepted", "security_reviewer", " "), (5, at(6), 7, "triaged", "accepted", "security_reviewer", "x"), (6, at(6), 7, "accepted", "open", "leadership", None), (7, at(0), 8, "open", "triaged", "leadership", None)]
    requests = spark.createDataFrame(rows, "request_id long, requested_at timestamp_ntz, item_id long, expected_state string, to_state string, role string, justification string")
    items = spark.createDataFrame([(7, "open")], "item_id long, state string")
    for chunk in ("minute", "year"):
        got = {r.request_id: r.answer for r in workflow.in_order(requests, items, chunk).collect()}
        assert got == {1: "applied", 2: "stale", 3: "role", 4: "justification", 5: "applied", 6: "undeclared", 7: "no such item"}


def test_a_surface_names_the_row_that_its_fix_was_read_from(spark):
    packages = spark.createDataFrame([(p,) for p in range(1, 7)], "package_id long")
    fixes = [(1, "2.0"), (2, "2.0"), (3, "2.0"), (4, ">=2"), (5, "2.0")]
    findings = spark.createDataFrame([(p, 100 + p, at(-100 if p == 5 else 0), "matched", False, fixed) for p, fixed in fixes], "package_id long, id long, observed_at timestamp, state string, nothing_matched boolean, fixed_range string")
    said = [(1, 11, "source", "1.0", 0), (1, 12, "source", "2.0", 0), (1, 13, "source", "2.0", 0), (1, 14, "pypi", "2.0", 0), (1, 15, "feedstock", "1.5", 0), (1, 16, "conda_package", "2.0", -100), (2, 21, "feedstock", "1.0", 0), (3, 31, "source", None, 0), (3, 32, "feedstock", "2.0", -100), (3, 33, "feedstock", "1.0", 0), (4, 41, "source", "2.0", 0)]
    evidence = spark.createDataFrame([(p, i, at(h), s, "ok", v) for p, i, s, v, h in said], "package_id long, id long, observed_at timestamp, surface string, state string, version string")
    out = {r.package_id: r for r in passes.remediation(packages, findings, evidence, at(1), {"source": 2, "feedstock": 2, "conda_package": 2}).collect()}
    cited = {p: tuple(r[f"{s}_snapshot_id"] for s in vocab.SURFACES) for p, r in out.items()}
    assert cited == {1: (12, None, 15, None), 2: (None, None, 21, None), 3: (None, None, 33, None), 4: (None,) * 4, 5: (None,) * 4, 6: (None,) * 4}
    assert [p for p, r in out.items() if r.evidence_stale] == [1, 5]  # a surface of 1 is old, the advisories of 5 are
    assert (out[1].readiness_status, out[1].source_fix, out[1].pypi_fix) == ("awaiting_packaging", "published", "not_read")
    assert out[1].detail == "old evidence: conda_package no freshness target: pypi other versions than 2.0 on: feedstock"  # no target: not compared
    untimed = passes.remediation(packages, findings, evidence, at(1), {"source": 2}, advisory_days=None).where("package_id >= 5").orderBy("package_id").collect()
    assert [r.detail for r in untimed] == ["no freshness target: advisories no freshness target: pypi, feedstock, conda_package version 2.0 was not seen on: source, pypi, feedstock, conda_package", "no freshness target: advisories no advisory evidence at the cut-off"]


def test_moves_claim_release_and_requeue_items(spark):
    day = lambda n: T0 + timedelta(days=n)
    items = spark.createDataFrame([(1, "a", "open", None, day(0), "x"), (2, "a", "in_progress", "old", day(0), "y"), (3, "b", "open", None, day(0), "z")], "item_id long, queue string, state string, claimed_by string, changed_at timestamp, note string")
    schema = "move_id long, item_id long, from_state string, to_state string, queue string, author string, justification string, occurred_at timestamp"
    rows = [(3, 1, "triaged", "in_progress", None, "u2", None, day(2)), (1, 1, "open", "triaged", "c", "u1", "r", day(1)), (2, 2, "in_progress", "resolved", " ", "system", "absent", day(1)), (4, 9, "open", "triaged", None, "u", None, day(1))]
    after, made = workflow.applied(spark.createDataFrame(rows, schema), items)
    assert sorted(tuple(r) for r in after.collect()) == [(1, "c", "in_progress", "u2", day(2), "x"), (2, "a", "resolved", None, day(1), "y"), (3, "b", "open", None, day(0), "z")]
    assert sorted((r.move_id, r.queue, r.author) for r in made.collect()) == [(1, "c", "u1"), (2, "a", "system"), (3, "c", "u2")]
    none = workflow.applied(spark.createDataFrame([], schema), items)
    assert sorted(none[0].collect()) == sorted(items.collect()) and none[1].count() == 0


def test_listing_composed_numbers_its_whole_order(spark, sf_dir):
    got = adapters.QUERIES["listing_composed"](spark, sf_dir).collect()
    assert len(got) > 2 and [r.place for r in sorted(got, key=lambda r: (r.canonical_name, r.package_id))] == list(range(1, len(got) + 1))


def test_places_count_over_partitions(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 5).select(((F.col("id") * 7919) % 1009).alias("k"), "id")
    got = surface.placed(rows.repartition(7).orderBy("k"), str(tmp_path / "rows")).collect()
    assert [r.place for r in sorted(got, key=lambda r: r.k)] == list(range(1, 1001))
    assert surface.placed(rows.where("id < 0").orderBy("k"), str(tmp_path / "none")).collect() == []


def test_purge_survivors_takes_out_what_any_returned_line_names(spark, tmp_path):
    spark.createDataFrame([(i, i * 10) for i in range(1, 6)], "p_partkey long, p_size long").write.parquet(str(tmp_path / "part.parquet"))
    lines = [(1, "R", 41), (2, "R", 40), (2, "N", 7), (3, "N", 40), (4, None, 80)]
    spark.createDataFrame(lines, "l_partkey long, l_returnflag string, l_orderkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = adapters.QUERIES["purge_survivors"](spark, str(tmp_path)).collect()
    assert sorted((r.id, r.p_size) for r in got) == [(3, 30), (4, 40), (5, 50)]


def test_index_facts_work_each_specifier_out_once_and_over_all_cores(spark, sf_dir):
    docs = spark.createDataFrame([(1, "{}")], "package_id long, body string")
    plan = documents.index_facts(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 1 and plan.count("transform_keys(") == 1
    whole = adapters.QUERIES["index_readiness"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [p_partkey" in whole and whole.index("from_json") < whole.index("RepartitionByExpression")


def test_vulnerability_pass_has_a_key_where_no_cross_reference_names_a_finding(spark):
    packages = spark.range(5).select(F.col("id").alias("package_id"))
    found = spark.range(20).select((F.col("id") % 5).alias("package_id"), "id", F.lit(at(1)).alias("observed_at"), F.lit("matched").alias("state"), F.lit(False).alias("nothing_matched"), F.lit("high").alias("severity"))
    kev = spark.range(4).select(F.col("id").alias("package_id"), "id", F.lit(at(1)).alias("observed_at"), F.lit("listed").alias("state"), F.lit(None).cast("long").alias("finding_id"))
    out = passes.vulnerability(packages, found, kev, at(2), passes.RISK_ORDER)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.package_id: r.kev_membership for r in out.collect()} == {0: "listed", 1: "listed", 2: "listed", 3: "listed", 4: "not_established"}


def test_derive_judges_packages_over_all_cores(spark):
    packages = spark.range(0, 300_000, 1, 1).select(F.col("id").alias("package_id"), F.sha2(F.col("id").cast("string"), 256).alias("canonical_name"))
    split = registry.Registry([registry.Pass("place", "place", lambda c: c.packages.select("package_id", F.spark_partition_id().alias("place")))])
    out = run.derive({"packages": packages}, at(2), {}, registry=split)
    assert out["place"].count() == 300_000 and out["place"].select("place").distinct().count() > 1


def test_typed_evidence_spreads_its_documents(spark, sf_dir, monkeypatch):
    files_read, plain = [], stored.typed.batch
    monkeypatch.setattr(stored.typed, "batch", lambda rows, number, folder: (files_read.append(rows.select(F.input_file_name()).distinct().count()), plain(rows, number, folder))[1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a thousand events would be one part
    try:
        adapters.QUERIES["typed_evidence"](spark, sf_dir).count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files_read) == 3 and min(files_read) > 1


def test_a_part_has_files_by_its_size_and_not_by_tasks(spark, tmp_path):
    from pathlib import Path

    from assayer.sources.parts import Parts

    rows = spark.range(0, 800, 1, 16).selectExpr("id", "id % 5 AS part")
    held = Parts(spark, str(tmp_path / "held"), "part", rows.schema)
    held.append(rows)
    held.rewrite(["3"], held.read(["3"]).repartition(16))
    files = {part: sum(len(list(Path(f).glob("*.parquet"))) for f in folders) for part, folders in held.manifest()[1].items()}
    assert files == {str(i): 1 for i in range(5)}
    assert sorted(r["id"] for r in held.read().collect()) == list(range(800))


def test_a_run_broadcasts_no_table_that_grows_with_the_packages(spark, sf_dir):
    from assayer.adapters import Tables
    from assayer.queries.runs import _PARAMETERS, _tables

    t = Tables(spark, sf_dir)
    tables = _tables(t)
    tables["health"] = t.packages().select("package_id", "confidence", *[F.lit("unknown").alias(c) for c in registry.ROLLUP_COLUMNS], F.lit(2).cast("long").alias("policy_run_id"), F.lit("0").alias("policy_version"), t.cutoff.alias("evidence_cutoff"), *[F.lit(None).cast("timestamp_ntz").alias(c) for c in ("inventory_absent_since", "inventory_last_listed")])
    tables["items"] = t.items().select("item_id", "package_id", "state", F.col("item_id").cast("string").alias("finding_key"), F.lit("compliance_review").alias("queue"))
    plans, written = {}, run._written_once(tables)
    shown = lambda rows: rows._jdf.queryExecution().executedPlan().toString()

    def keep(name, rows):
        plans[name] = shown(rows)
        return written(name, rows)

    out = run.execute(tables, t.cutoff, _PARAMETERS, 3, "1", keep)
    plans |= {name: shown(out[name]) for name in ("verdicts", "ending", "health", "new_items", "closed_items", "rollup")}
    del plans["presence"]  # meets the log itself with its marks: the log's files hold ids and instants, which tell its size
    assert {"currency", "feedstock_presence", "vulnerability", "licence", "remediation", "python_readiness", "work_type", "priority"} < set(plans)
    assert [name for name, plan in plans.items() if "Broadcast" in plan] == []
    assert plans["verdicts"].count("SortMergeJoin") == 6
    assert "isnotnull(vulnerability_finding_id" in plans["new_items"] and "isnotnull(license_finding_id" in plans["new_items"]
