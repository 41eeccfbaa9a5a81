"""Whole policy runs, collection and row checks over the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from assayer import schemas
from assayer.adapters import CUTOFF, EV, EVC, ORACLE_SQL, PKG, Tables, query
from assayer.functions import vocab
from assayer.operators import collection
from assayer.plans import rollup, run
from assayer.queries.evidence import _FOLD, _INV, LATEST, _feedstock, _readiness_rows, _surfaces, inventory
from assayer.queries.surface import ITEMS_OF_V, ledger
from assayer.streaming.folders import scratch


def _tables(t: Tables):
    """Evidence of every kind from events; findings about a third of the surfaces' rows."""
    e = t.evidence()
    assessed, verified = _readiness_rows(t)
    found = e.where(F.col("surface") == 1).select("package_id", "id", "observed_at", F.when(F.col("state") == "ok", "matched").when(F.col("state") == "not_found", "unknown").otherwise("error").alias("state"), (F.col("state") == "not_found").alias("nothing_matched"), F.lit("high").alias("severity"), F.col("version").alias("fixed_range"), F.concat(F.lit("ADV-"), (F.col("id") % 7).cast("string")).alias("advisory_id"), F.lit(None).cast("string").alias("affected_range"))
    kev = e.where(F.col("surface") == 2).select("package_id", "id", "observed_at", F.lit("not_listed").alias("state"), F.lit(None).cast("long").alias("finding_id"))
    licences = e.where(F.col("surface") == 3).select("package_id", "id", "observed_at", F.when(F.col("state") == "ok", "normalized").otherwise("unknown").alias("state"), F.when(F.col("state") == "ok", "GPL-3.0-only").alias("normalized_license"), F.lit("main").alias("channel"))
    return {"packages": t.packages(), "surfaces": _surfaces(t), "feedstock": _feedstock(t), "findings": found, "kev": kev, "licences": licences, "assessments": assessed, "verifications": verified, "inventory": inventory(t)}


_PARAMETERS = {
    "feedstock_inactivity_days": 180,
    "license_rules": [{"expression": "GPL-3.0-only", "disposition": "forbidden"}],
    "priority_rules": [{"bucket": "p1", "when": {"vulnerability_status": "advisories_matched", "license_outcome": "forbidden"}}, {"bucket": "p3", "when": {"vulnerability_status": "advisories_matched"}}, {"bucket": "p10", "when": {"currency_status": "behind"}}],
    "priority_score_weights": {"internal_lob_count": 5, "internal_component_count": 1},
}

_SWEPT = """fi AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY package_id ORDER BY observed_at DESC) AS r FROM evc WHERE surface = 1) WHERE r = 1),
li AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY package_id ORDER BY observed_at DESC) AS r FROM evc WHERE surface = 3) WHERE r = 1),
fo AS (SELECT package_id, bool_or(state = 'ok') AS vulnerable, min(id) FILTER (WHERE state = 'ok') AS fid FROM fi GROUP BY 1), lo AS (SELECT package_id, bool_or(state = 'ok') AS forbidden, min(id) FILTER (WHERE state = 'ok') AS lid FROM li GROUP BY 1)"""
_READY = ORACLE_SQL["py_readiness_pass"].replace("INTERVAL 6 HOUR", "INTERVAL 14 DAY").replace("INTERVAL 12 HOUR", "INTERVAL 30 DAY")
#: SQL of a run's verdicts by package, before the gate.
_RUN = f"""WITH {EVC}, {PKG}, {_INV}, {_FOLD}, {_SWEPT}, cur AS ({ORACLE_SQL["currency_pass"]}), feed AS ({ORACLE_SQL["feedstock_presence_pass"]}), py AS ({_READY}),
j AS (SELECT pkg.package_id, confidence, cur.overall_status AS currency, feed.presence_status AS feedstock, coalesce(vulnerable, false) AS vulnerable, coalesce(forbidden, false) AS forbidden, py.readiness AS python FROM pkg JOIN cur USING (package_id) JOIN feed USING (package_id) JOIN py USING (package_id) LEFT JOIN fo USING (package_id) LEFT JOIN lo USING (package_id)),
vd AS (SELECT *, CASE WHEN vulnerable AND forbidden THEN 1 WHEN vulnerable THEN 2 WHEN currency = 'behind' THEN 3 END AS rule, CASE WHEN vulnerable THEN 'fix_vulnerability' WHEN forbidden THEN 'review_license' WHEN feedstock = 'absent' THEN 'create_recipe' WHEN feedstock IN ('present_and_inactive', 'staged_recipe_pending') THEN 'update_feedstock'
  WHEN python IN ('inferred_ready', 'inferred_not_ready') THEN 'validate_python_314' WHEN python = 'verified_not_ready' OR currency = 'behind' THEN 'file_tracking_issue' ELSE 'unknown' END AS work FROM j),
g AS (SELECT vd.*, coalesce(['p1', 'p3', 'p10'][rule], 'unknown') AS bucket, confidence = 'unmapped' AS hidden, absent_since, last_listed, listed_since FROM vd LEFT JOIN fold USING (package_id))"""


@query("policy_run_health", _RUN + """ SELECT package_id, CASE WHEN hidden THEN 'unknown' ELSE currency END AS currency_status, CASE WHEN hidden THEN 'unknown' ELSE feedstock END AS feedstock_presence_status, CASE WHEN hidden THEN 'unknown' ELSE bucket END AS priority_status, CASE WHEN hidden THEN 'unknown' ELSE work END AS work_type_status,
  CAST(3 AS BIGINT) AS policy_run_id, '1' AS policy_version, absent_since AS inventory_absent_since, CASE WHEN absent_since IS NOT NULL THEN last_listed END AS inventory_last_listed FROM g""")
def policy_run_health(t: Tables):
    out = run.execute(_tables(t), t.cutoff, _PARAMETERS, 3, "1")
    return out["health"].select("package_id", "currency_status", "feedstock_presence_status", "priority_status", "work_type_status", "policy_run_id", "policy_version", "inventory_absent_since", "inventory_last_listed")


@query("policy_run_stored", _RUN + " SELECT package_id, CASE WHEN hidden THEN 'unknown' ELSE bucket END AS priority_status, CASE WHEN hidden THEN 'unknown' ELSE work END AS work_type_status FROM g")
def policy_run_stored(t: Tables):
    keep = run.stored(f"{scratch(t.spark)}/run-{uuid.uuid4().hex}", 3)
    return run.execute(_tables(t), t.cutoff, _PARAMETERS, 3, "1", keep)["health"].select("package_id", "priority_status", "work_type_status")


@query("policy_run_work", _RUN + " SELECT package_id, vulnerable, forbidden, work AS work_type FROM g")
def policy_run_work(t: Tables):
    out = run.derive(_tables(t), t.cutoff, _PARAMETERS)
    rows = out["verdicts"].join(out["work_type"], "package_id")
    return rows.select("package_id", (F.col("vulnerability_status") == "advisories_matched").alias("vulnerable"), (F.col("license_outcome") == "forbidden").alias("forbidden"), "work_type")


@query("policy_run_priority", _RUN + """, b AS (SELECT package_id, arg_max(components, (observed_at, id)) AS c, max((observed_at, id)) AS m FROM inv GROUP BY 1), l AS (SELECT b.package_id, b.c, inv.lobs FROM b JOIN inv ON inv.package_id = b.package_id AND (inv.observed_at, inv.id) = b.m)
SELECT package_id, bucket, CASE WHEN rule IS NULL THEN '' ELSE 'rule ' || rule END AS matched_rule, CASE WHEN lobs IS NOT NULL THEN CAST(1 + (least(5 * lobs + c, 600) * 99) // 600 AS INTEGER) END AS score FROM g LEFT JOIN l USING (package_id)""")
def policy_run_priority(t: Tables):
    return run.derive(_tables(t), t.cutoff, _PARAMETERS)["priority"]


@query("policy_run_without_rules", f"WITH {PKG} SELECT package_id, 'unknown' AS bucket, '' AS matched_rule, CAST(NULL AS INTEGER) AS score FROM pkg")
def policy_run_without_rules(t: Tables):
    return run.derive(_tables(t), t.cutoff, {"feedstock_inactivity_days": 180, "priority_score_weights": {"internal_lob_count": 0}})["priority"]


@query("policy_run_items", _RUN + f""", v AS (SELECT g.package_id, g.confidence, g.listed_since, fo.fid, 'ADV-' || (fo.fid % 7) AS advisory_id, '' AS affected_range, lo.lid, 'GPL-3.0-only' AS normalized_license, 'main' AS channel
  FROM g LEFT JOIN fo USING (package_id) LEFT JOIN lo USING (package_id) WHERE g.absent_since IS NULL), {ITEMS_OF_V} SELECT finding_key, package_id, queue FROM opened""")
def policy_run_items(t: Tables):
    return run.execute(_tables(t), t.cutoff, _PARAMETERS, 3, "1")["new_items"]


_ODD = f"""odd AS (SELECT DISTINCT package_id FROM fi WHERE package_id % 10 = 0 AND state NOT IN ('ok', 'not_found'))"""


def _half_broken(t: Tables):
    tables = _tables(t)
    broken = (F.col("package_id") % 10 == 0) & (F.col("state") == "error")
    tables["findings"] = tables["findings"].withColumn("state", F.when(broken, "odd").otherwise(F.col("state")))
    tables["health"] = t.packages().select("package_id", "confidence", *[F.lit("unknown").alias(c) for c in ("currency_status", "feedstock_presence_status", "work_type_status", "priority_status")], F.lit(2).cast("long").alias("policy_run_id"), F.lit("0").alias("policy_version"), t.cutoff.alias("evidence_cutoff"), *[F.lit(None).cast("timestamp_ntz").alias(c) for c in ("inventory_absent_since", "inventory_last_listed")])
    return run.execute(tables, t.cutoff, _PARAMETERS, 3, "1")


@query("policy_run_ending", f"WITH {EVC}, {PKG}, {_SWEPT}, {_ODD} SELECT count(*) AS packages, count(odd.package_id) AS failed, CASE WHEN count(odd.package_id) = 0 THEN 'succeeded' WHEN count(odd.package_id) = count(*) THEN 'failed' ELSE 'partial' END AS status FROM pkg LEFT JOIN odd USING (package_id)")
def policy_run_ending(t: Tables):
    return _half_broken(t)["ending"]


@query("policy_run_survivors", f"WITH {EVC}, {PKG}, {_SWEPT}, {_ODD} SELECT package_id, CAST(CASE WHEN odd.package_id IS NULL THEN 3 ELSE 2 END AS BIGINT) AS policy_run_id, CASE WHEN odd.package_id IS NULL THEN '1' ELSE '0' END AS policy_version FROM pkg LEFT JOIN odd USING (package_id)")
def policy_run_survivors(t: Tables):
    return _half_broken(t)["rollup"].select("package_id", "policy_run_id", "policy_version")


@query("policy_run_replay", f"""WITH {EVC}, {PKG}, {_SWEPT} SELECT package_id, 'license_outcome' AS "column", 'forbidden' AS before, 'restricted' AS after FROM pkg JOIN lo USING (package_id) WHERE forbidden""")
def policy_run_replay(t: Tables):
    tables = _tables(t)
    recorded = run.derive(tables, t.cutoff, _PARAMETERS)
    other = {**_PARAMETERS, "license_rules": [{"expression": "GPL-3.0-only", "disposition": "restricted"}]}
    found = run.compare(tables, t.cutoff, other, {n: recorded[n] for n in ("currency", "licence")})
    return found["currency"].unionByName(found["licence"])


@query("owned_violations", "SELECT s_suppkey AS package_id, CASE s_suppkey % 4 WHEN 0 THEN 'odd' END AS verdict FROM supplier WHERE s_suppkey % 4 < 2")
def owned_violations(t: Tables):
    i = F.col("s_suppkey") % 4
    rows = t.supplier.select(F.col("s_suppkey").alias("package_id"), F.when(i == 0, "odd").when(i > 1, "current").alias("verdict"))
    return rollup.owned(rows, "verdict", (*vocab.CURRENCY, "not_applicable"))


@query("row_shape_checks", "SELECT s_suppkey AS package_id, CASE WHEN s_suppkey % 3 = 0 THEN 'state' ELSE 'facts' END AS rule FROM supplier WHERE s_suppkey % 3 < 2")
def row_shape_checks(t: Tables):
    i = F.col("s_suppkey") % 3
    rows = t.supplier.select(F.col("s_suppkey").alias("package_id"), F.lit(CUTOFF).cast("timestamp_ntz").alias("observed_at"), F.when(i == 0, "odd").otherwise("ok").alias("state"), F.when(i == 1, "").otherwise("1").alias("latest_version"))
    return schemas.broken(rows, "pypi_release_snapshots").select("package_id", F.when(F.col("broken").contains("IN ("), "state").otherwise("facts").alias("rule"))


@query("collector_selection", "SELECT p_partkey AS package_id FROM part WHERE p_partkey % 3 = 0")
def collector_selection(t: Tables):
    i = F.col("p_partkey") % 3
    packages = t.part.select(F.col("p_partkey").alias("package_id"), F.when(i == 0, F.concat(F.lit("pkg:pypi/n"), F.col("p_partkey").cast("string"))).when(i == 1, "pkg:conda/x").otherwise("odd").alias("primary_purl"), F.lit(None).cast("string").alias("source_repository_url"))
    mappings = t.part.select(F.col("p_partkey").alias("package_id"), F.lit("feedstock").alias("kind"), F.lit("ok").alias("outcome"))
    return collection.selected(packages, mappings, "pypi_release")


def _covered(t: Tables):
    k = F.col("p_partkey")
    n = k.cast("string")
    purl = F.when(k % 3 == 0, F.concat(F.lit("pkg:pypi/n"), n)).when(k % 3 == 1, F.concat(F.lit("pkg:conda/x"), n)).otherwise("odd")
    packages = t.part.select(k.alias("package_id"), purl.alias("primary_purl"), F.when(k % 2 == 0, F.concat(F.lit("https://github.com/o/r"), n)).alias("source_repository_url"), F.when(k % 5 == 0, "verified").otherwise("unmapped").alias("confidence"), F.when(k % 4 != 0, "inventory").otherwise("").alias("identity_source"), F.lit("key").alias("associator_key"))
    mappings = t.part.select(k.alias("package_id"), F.when(k % 2 == 0, "feedstock").otherwise("conda_package").alias("kind"), F.when(k % 7 == 0, "not_found").otherwise("ok").alias("outcome"))
    return packages, mappings


_COVERED = """c AS (SELECT 'source_release' AS collector, p_partkey AS package_id FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT unnest(['pypi_release', 'python_readiness']), p_partkey FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'feedstock', p_partkey FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 7 <> 0
 UNION ALL SELECT unnest(['license', 'conda_package']), p_partkey FROM part WHERE p_partkey % 2 <> 0 AND p_partkey % 7 <> 0 UNION ALL SELECT 'vulnerability', p_partkey FROM part WHERE p_partkey % 3 < 2 UNION ALL SELECT 'kev', p_partkey FROM part UNION ALL SELECT 'resolve_identity', p_partkey FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 4 <> 0)"""


@query("selections_all", f"WITH {_COVERED} SELECT collector, package_id FROM c")
def selections_all(t: Tables):
    return collection.selections(*_covered(t))


@query("selection_without_catalog", "SELECT true AS declared, p_partkey AS package_id FROM part UNION ALL SELECT NULL, p_partkey FROM part WHERE p_partkey % 3 < 2")
def selection_without_catalog(t: Tables):
    """What a cross-reference sweep selects where a catalog is declared and where none is (nothing); beside it what the advisory sweep selects."""
    found = [collection.selected(*_covered(t), "kev", kev_declared=declared).select(F.lit(declared).alias("declared"), "package_id") for declared in (True, False)]
    return found[0].unionByName(found[1]).unionByName(collection.selected(*_covered(t), "vulnerability").select(F.lit(None).cast("boolean").alias("declared"), "package_id"))


@query("recollection_requests", f"WITH {_COVERED}, s AS (SELECT package_id, string_agg(collector, ',' ORDER BY collector) AS w FROM c GROUP BY 1) SELECT p_partkey AS package_id, 'u1' AS actor, CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 THEN w END AS collectors, CASE WHEN p_partkey % 13 = 0 THEN 'in flight' WHEN p_partkey % 11 = 0 THEN 'pending' END AS refused FROM part LEFT JOIN s ON package_id = p_partkey")
def recollection_requests(t: Tables):
    packages, mappings = _covered(t)
    some = lambda n: packages.where(F.col("package_id") % n == 0).select("package_id")
    rows = collection.recollected(packages, collection.selections(packages, mappings), some(11), some(13), "u1", t.cutoff)
    return rows.select("package_id", "actor", F.array_join("collectors", ",").alias("collectors"), "refused")


@query("selection_by_mapping", "SELECT p_partkey AS package_id FROM part WHERE p_partkey % 4 = 1")
def selection_by_mapping(t: Tables):
    packages = t.part.select(F.col("p_partkey").alias("package_id"), F.lit("").alias("primary_purl"), F.lit("").alias("source_repository_url"))
    mappings = t.part.select(F.col("p_partkey").alias("package_id"), F.lit("feedstock").alias("kind"), F.when(F.col("p_partkey") % 4 == 1, "ok").otherwise("not_found").alias("outcome"))
    return collection.selected(packages, mappings, "feedstock")


@query("conditional_cache", f"WITH {EVC}, b AS (SELECT package_id, 'b' || id AS body FROM ({LATEST.format(keys='package_id', ties='', rows='(SELECT * FROM evc WHERE id % 3 = 0)')})) SELECT evc.id, CASE WHEN evc.state = 'unknown' THEN b.body ELSE 'own' END AS body FROM evc LEFT JOIN b USING (package_id)")
def conditional_cache(t: Tables):
    rows = t.evidence().where(F.col("observed_at") <= t.cutoff)
    answers = rows.select("id", F.col("package_id").alias("key"), F.when(F.col("state") == "unknown", 304).otherwise(200).alias("status_code"), F.lit("own").alias("body"))
    bodies = rows.select("id", F.col("package_id").alias("key"), "observed_at", F.when(F.col("id") % 3 == 0, F.concat(F.lit("b"), F.col("id").cast("string"))).alias("body"))
    return collection.replayed(answers, bodies, t.cutoff).select("id", "body")


@query("pending_recollection", f"""WITH {EVC}, r AS (SELECT id AS request_id, package_id, observed_at AS asked, unnest(['c0', 'c1', 'c2', 'c3']) AS c FROM evc WHERE state = 'error' AND observed_at >= TIMESTAMP '{CUTOFF}' - INTERVAL 72 HOUR),
d AS (SELECT package_id, 'c' || surface AS c, max(observed_at) AS done FROM evc WHERE state <> 'unknown' GROUP BY 1, 2),
o AS (SELECT r.* FROM r LEFT JOIN d ON d.package_id = r.package_id AND d.c = r.c WHERE d.done IS NULL OR d.done < r.asked),
w AS (SELECT package_id, request_id, asked, string_agg(c, ',' ORDER BY c) AS waiting FROM o GROUP BY 1, 2, 3)
SELECT package_id, request_id, waiting FROM (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY asked DESC, request_id DESC) AS rn FROM w) WHERE rn = 1""")
def pending_recollection(t: Tables):
    rows = t.evidence().where(F.col("observed_at") <= t.cutoff)
    requests = rows.where(F.col("state") == "error").select(F.col("id").alias("request_id"), "package_id", F.col("observed_at").alias("requested_at"), vocab.strings(("c0", "c1", "c2", "c3")).alias("collectors"))
    return collection.pending(requests, ledger(t).where(F.col("started_at") <= t.cutoff), t.cutoff, 72)


@query("authority_order_faults", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'repeated' END AS fault FROM supplier")
def authority_order_faults(t: Tables):
    i = F.col("s_suppkey") % 3
    order = F.when(i == 0, vocab.strings(("pypi", "odd"))).when(i == 1, vocab.strings(("pypi", "pypi"))).otherwise(vocab.strings(("pypi", "source")))
    return t.supplier.select("s_suppkey", collection.authority_fault(order).alias("fault"))


@query("sentinel_rows", f"WITH {EV} SELECT id, state, CAST(NULL AS VARCHAR) AS version FROM ev WHERE state <> 'ok'")
def sentinel_rows(t: Tables):
    return collection.sentinels(t.evidence().select("id", "state", "version"), ["version"])


@query("verification_states", "SELECT s_suppkey AS package_id, CASE s_suppkey % 3 WHEN 0 THEN 'verified_compatible' WHEN 1 THEN 'verification_failed' ELSE 'error' END AS state, CASE WHEN s_suppkey % 3 < 2 THEN 'linux' END AS platform FROM supplier")
def verification_states(t: Tables):
    from assayer.sources import documents

    i = F.col("s_suppkey") % 3
    body = F.when(i == 0, '{"verified": true, "platform": "linux"}').when(i == 1, '{"verified": false, "platform": "linux"}').otherwise("{}")
    return documents.verifications(t.supplier.select(F.col("s_suppkey").alias("package_id"), body.alias("body"))).select("package_id", "state", "platform")
