"""The standing reports and health rows over the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from assayer.adapters import CUTOFF, EV, EVC, PKG, Tables, query
from assayer.functions import vocab
from assayer.operators import asof, digest, reports, surface, workflow
from assayer.queries.surface import _LEDGER, ledger
from assayer.sources import documents
from assayer.streaming.folders import scratch

_H = f"""WITH {PKG}, health AS (SELECT package_id, canonical_name, confidence, CAST(package_id % 2 AS BIGINT) AS policy_run_id,
  CASE package_id % 5 WHEN 0 THEN 'behind' WHEN 1 THEN 'error' WHEN 2 THEN 'unknown' ELSE 'current' END AS currency_status,
  CASE package_id % 3 WHEN 0 THEN 'absent' WHEN 1 THEN 'present_and_maintained' END AS feedstock_presence_status, 'p' || (package_id % 10 + 1) AS priority_status,
  CASE WHEN package_id % 7 = 0 THEN TIMESTAMP '2024-01-05 10:00:00' END AS inventory_absent_since, CASE WHEN package_id % 14 = 0 THEN TIMESTAMP '2024-01-03 00:00:00' END AS inventory_last_listed, 'src' || (package_id % 4) AS identity_source FROM pkg),
d AS (SELECT o_custkey AS package_id, CAST(o_orderkey % 4 AS BIGINT) AS policy_run_id, o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'a' WHEN '2-HIGH' THEN 'b' ELSE 'c' END AS p FROM orders)"""


def _health(t: Tables):
    p = F.col("package_id")
    return t.packages().select(
        "*",
        (p % 2).alias("policy_run_id"),
        F.when(p % 5 == 0, "behind").when(p % 5 == 1, "error").when(p % 5 == 2, "unknown").otherwise("current").alias("currency_status"),
        F.when(p % 3 == 0, "absent").when(p % 3 == 1, "present_and_maintained").alias("feedstock_presence_status"),
        F.concat(F.lit("p"), (p % 10 + 1).cast("string")).alias("priority_status"),
        F.when(p % 7 == 0, F.lit("2024-01-05 10:00:00").cast("timestamp_ntz")).alias("inventory_absent_since"),
        F.when(p % 14 == 0, F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")).alias("inventory_last_listed"),
        F.concat(F.lit("src"), (p % 4).cast("string")).alias("identity_source"),
        F.element_at(F.array(*[F.lit(w) for w in ("fix_vulnerability", "create_recipe", "unknown")]), (p % 3 + 1).cast("int")).alias("work_type_status"),
        F.create_map(F.lit("currency"), F.concat(F.lit("2024."), (p % 2 + 1).cast("string"))).alias("policy_versions"),
        F.when(p % 2 == 0, F.lit("2024-01-06 00:00:00")).otherwise("2024-01-07 00:00:00").cast("timestamp_ntz").alias("evidence_cutoff"),
    )


def _derived(t: Tables):
    o = F.substring("o_orderpriority", 1, 1)
    pick = lambda a, b, c: F.when(o == "1", a).when(o == "2", b).otherwise(c)
    rows = t.orders.select(
        F.col("o_custkey").alias("package_id"),
        (F.col("o_orderkey") % 4).alias("policy_run_id"),
        F.col("o_orderkey").alias("id"),
        pick("source", "pypi", "feedstock").alias("chosen_authority"),
        pick("listed", "not_listed", "not_established").alias("kev_membership"),
        pick("advisories_matched", "unknown", "no_advisory_matched").alias("vulnerability_status"),
        pick("high", "", "").alias("risk_level"),
        pick("verified_not_ready", "inferred_not_ready", "inferred_ready").alias("readiness"),
        pick("verified", "inferred", "inferred").alias("evidence_type"),
        pick("forbidden", "restricted", "allowed").alias("license_outcome"),
        pick("rule a", "rule b", "rule c").alias("matched_rule"),
        (F.col("o_orderkey") % 100).alias("score"),
        *[F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")).alias(f"{s}_snapshot_id") for s in ("source", "pypi", "feedstock", "conda_package")],
        *[F.col("o_orderkey").alias(c) for c in ("vulnerability_finding_id", "kev_finding_id", "license_finding_id", "assessment_id", "verification_id")],
    )
    return {n: rows for n in ("currency", "vulnerability", "licence", "python_readiness", "feedstock_presence", "priority")}


def _one(t: Tables):
    """Derived rows, one for each package and run."""
    derived = _derived(t)
    newest = derived["currency"].groupBy("package_id", "policy_run_id").agg(F.max("id").alias("id"))
    return {n: rows.join(newest, ["package_id", "policy_run_id", "id"], "left_semi") for n, rows in derived.items()}


_X = """, o AS (SELECT package_id, policy_run_id, max(id) AS id FROM d GROUP BY 1, 2), x AS (SELECT d.*, o_orderdate AS seen FROM d JOIN o USING (package_id, policy_run_id, id) JOIN orders ON o_orderkey = id),
work AS (SELECT package_id, ['fix_vulnerability', 'create_recipe', 'unknown'][package_id % 3 + 1] AS work_type_status FROM health)"""


def _report(name: str, sql: str):
    @query("report_" + name.replace("-", "_"), _H + sql)
    def report(t: Tables):
        return reports.rows(name, _health(t), _derived(t))


_report("kev", " SELECT DISTINCT package_id, canonical_name, 'advisories_matched' AS vulnerability_status, 'high' AS risk_level FROM health JOIN d USING (package_id) WHERE p = 'a'")
_report("feedstock-lag", " SELECT package_id, canonical_name, currency_status, feedstock_presence_status FROM health WHERE inventory_absent_since IS NULL AND (currency_status = 'behind' OR feedstock_presence_status IS DISTINCT FROM 'present_and_maintained')")
_report("python-314", " SELECT DISTINCT package_id, canonical_name, CASE p WHEN 'a' THEN 'verified_not_ready' ELSE 'inferred_not_ready' END AS readiness, CASE p WHEN 'a' THEN 'verified' ELSE 'inferred' END AS evidence_type FROM health JOIN d USING (package_id) WHERE p <> 'c'")
_report("licence-exceptions", " SELECT DISTINCT package_id, canonical_name, CASE p WHEN 'a' THEN 'forbidden' ELSE 'restricted' END AS license_outcome, 'rule ' || p AS matched_rule FROM health JOIN d USING (package_id) WHERE p <> 'c'")
_report("unmapped-identities", " SELECT package_id, canonical_name, identity_source FROM health WHERE confidence = 'unmapped'")
_report("stale-evidence", " SELECT package_id, canonical_name, currency_status, feedstock_presence_status FROM health WHERE currency_status IN ('unknown', 'error')")


@query("report_left_out", _H + " SELECT count(*) AS excluded FROM health WHERE inventory_absent_since IS NOT NULL AND (currency_status = 'behind' OR feedstock_presence_status IS DISTINCT FROM 'present_and_maintained')")
def report_left_out(t: Tables):
    return reports.left_out(_health(t), "feedstock-lag")


@query("report_absence_tags", _H + " SELECT package_id, 'absent from the inventory since 2024-01-05' || CASE WHEN inventory_last_listed IS NULL THEN '' ELSE ' (last listed 2024-01-03)' END AS tag FROM health WHERE inventory_absent_since IS NOT NULL")
def report_absence_tags(t: Tables):
    tag = reports.absence_tag(F.col("inventory_absent_since"), F.col("inventory_last_listed"))
    return _health(t).select("package_id", tag.alias("tag")).where(F.col("tag").isNotNull())


@query("health_rows", _H + _X + """, y AS (SELECT health.package_id, confidence, currency_status, feedstock_presence_status, x.id, x.p, x.seen FROM health LEFT JOIN x ON x.package_id = health.package_id AND x.policy_run_id = health.policy_run_id)
SELECT package_id, currency_status AS currency, CASE p WHEN 'a' THEN 'source' WHEN 'b' THEN 'pypi' WHEN 'c' THEN 'feedstock' ELSE 'no evaluation recorded at this run' END AS currency_note, CASE WHEN id % 3 <> 0 THEN seen END AS currency_at,
 CASE WHEN p IS NULL OR confidence = 'unmapped' THEN 'unknown' WHEN p = 'a' THEN 'advisories_matched' WHEN p = 'b' THEN 'unknown' ELSE 'no_advisory_matched' END AS vulnerability, CASE WHEN p IS NULL THEN 'no evaluation recorded at this run' WHEN p = 'a' THEN 'high' ELSE 'advisory' END AS vulnerability_note,
 CASE WHEN p IS NULL OR confidence = 'unmapped' THEN 'unknown' WHEN p = 'a' THEN 'listed' WHEN p = 'b' THEN 'not_listed' ELSE 'not_established' END AS kev, seen AS kev_at,
 CASE WHEN p IS NULL OR confidence = 'unmapped' THEN 'unknown' WHEN p = 'a' THEN 'forbidden' WHEN p = 'b' THEN 'restricted' ELSE 'allowed' END AS licence, coalesce('rule ' || p, 'no evaluation recorded at this run') AS licence_note,
 CASE WHEN p IS NULL OR confidence = 'unmapped' THEN 'unknown' WHEN p = 'a' THEN 'verified_not_ready' WHEN p = 'b' THEN 'inferred_not_ready' ELSE 'inferred_ready' END AS python, CASE WHEN p IS NULL THEN 'no evaluation recorded at this run' WHEN p = 'a' THEN 'verified' ELSE 'inferred' END AS python_note, seen AS python_at,
 feedstock_presence_status AS feedstock, CASE WHEN p IS NULL THEN 'no evaluation recorded at this run' ELSE 'feedstock' END AS feedstock_note FROM y""")
def health_rows(t: Tables):
    seen = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("observed_at"))
    rows = reports.health_rows(_health(t), _one(t), {n: seen for n in ("surfaces", "findings", "kev", "licences", "assessments", "verifications", "feedstock")})
    part = lambda c, what: F.col(c)[what].alias(f"{c}_{'at' if what == 'observed_at' else what}")
    return rows.select("package_id", *[F.col(c)["status"].alias(c) for c in ("currency", "vulnerability", "kev", "licence", "python", "feedstock")], *[part(c, "note") for c in ("currency", "vulnerability", "licence", "python", "feedstock")], *[part(c, "observed_at") for c in ("currency", "kev", "python")])


@query("report_page_rows", _H + " SELECT package_id, canonical_name, currency_status, feedstock_presence_status, CASE WHEN inventory_absent_since IS NULL THEN '' ELSE 'absent from the inventory since 2024-01-05' || CASE WHEN inventory_last_listed IS NULL THEN '' ELSE ' (last listed 2024-01-03)' END END AS absence FROM health WHERE currency_status IN ('unknown', 'error')")
def report_page_rows(t: Tables):
    return reports.page("stale-evidence", _health(t), _derived(t))


@query("report_page_summary", _H + """, r AS (SELECT * FROM health WHERE inventory_absent_since IS NULL AND (currency_status = 'behind' OR feedstock_presence_status IS DISTINCT FROM 'present_and_maintained')), x AS (SELECT count(*) AS n FROM health WHERE inventory_absent_since IS NOT NULL AND (currency_status = 'behind' OR feedstock_presence_status IS DISTINCT FROM 'present_and_maintained'))
SELECT count(*) AS rows, max(CASE package_id % 2 WHEN 0 THEN TIMESTAMP '2024-01-06' ELSE TIMESTAMP '2024-01-07' END) AS evidence_cutoff, (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT 'currency@2024.' || (package_id % 2 + 1) AS v FROM r)) AS versions, any_value(x.n) AS excluded,
 CASE WHEN any_value(x.n) = 1 THEN '1 package' ELSE any_value(x.n) || ' packages' END || ' excluded: absent from the inventory at the run''s cut-off' AS sentence FROM r, x""")
def report_page_summary(t: Tables):
    return reports.summary("feedstock-lag", _health(t), _derived(t))


@query("report_screen", _H + " SELECT package_id, canonical_name, identity_source FROM health WHERE confidence = 'unmapped' ORDER BY canonical_name, package_id LIMIT 200")
def report_screen(t: Tables):
    return reports.rows("unmapped-identities", _health(t), _derived(t)).limit(surface.REPORT_ROWS)


_ASKED = "licence_x.p IN ('a', 'b') AND feedstock_presence_status = 'absent' AND contains(lower(canonical_name), 'customer#0000')"
_WITH_X = " FROM health LEFT JOIN x licence_x ON licence_x.package_id = health.package_id AND licence_x.policy_run_id = health.policy_run_id"
_PARAMS = {"licence": ["forbidden", "restricted"], "feedstock": ["absent"], "q": [" Customer#0000 "], "other": ["x"]}


@query("listing_composed", _H + _X + f" SELECT health.package_id, canonical_name, licence_x.id % 100 AS score, row_number() OVER (ORDER BY canonical_name, health.package_id) AS place{_WITH_X} WHERE {_ASKED} AND inventory_absent_since IS NULL")
def listing_composed(t: Tables):
    rows = surface.listing(_health(t), _one(t), _PARAMS, "odd")
    return surface.placed(rows.select("package_id", "canonical_name", "score"), f"{scratch(t.spark)}/listing-{uuid.uuid4().hex}")  # the order, as a column to compare


@query("listing_by_rank", _H + _X + f" SELECT health.package_id, priority_status, licence_x.id % 100 AS score{_WITH_X} WHERE work_type_status = 'create_recipe' AND currency_status IN ('current', 'behind') ORDER BY CAST(substr(priority_status, 2) AS INTEGER), score DESC NULLS FIRST, health.package_id LIMIT 50".replace("FROM health LEFT", "FROM health JOIN work USING (package_id) LEFT"))
def listing_by_rank(t: Tables):
    params = {"work": ["create_recipe"], "currency": ["current", "behind"]}
    return surface.page(surface.listing(_health(t), _one(t), params, "rank")).select("package_id", "priority_status", "score")


@query("listing_facets", _H + _X + " SELECT count(*) AS packages" + _WITH_X + " WHERE licence_x.p = 'a' AND confidence <> 'unmapped' AND priority_status IN ('p1', 'p2')")
def listing_facets(t: Tables):
    params = {"vuln": ["advisories_matched"], "kev": ["listed", ""], "confidence": ["verified", "inventory-derived"], "priority": ["p1", "p2"], "py314": ["verified_not_ready"]}
    return surface.asked(_health(t), _one(t), params).agg(F.count("*").alias("packages"))


@query("feedstock_gap_exclusions", _H + _X + f" SELECT count(*) FILTER (WHERE feedstock_presence_status = 'absent' AND inventory_absent_since IS NOT NULL) AS absent_from_inventory, count(*) FILTER (WHERE confidence = 'unmapped') AS unmapped{_WITH_X} WHERE licence_x.p IN ('a', 'b') AND contains(lower(canonical_name), 'customer#0000')")
def feedstock_gap_exclusions(t: Tables):
    return surface.feedstock_gap(_health(t), _one(t), _PARAMS)


@query("ranking_global", _H + _X + f" SELECT health.package_id, priority_status AS bucket, licence_x.id % 100 AS score{_WITH_X} ORDER BY bucket, score DESC NULLS FIRST, health.package_id LIMIT 50")
def ranking_global(t: Tables):
    rows = _health(t).join(_one(t)["priority"].select("package_id", "policy_run_id", "score"), ["package_id", "policy_run_id"], "left")
    return surface.page(surface.globally_ranked(rows.withColumn("bucket", F.col("priority_status")))).select("package_id", "bucket", "score")


@query("absent_unresolved", _H + " SELECT count(*) AS not_offered FROM health WHERE inventory_absent_since IS NOT NULL AND confidence <> 'verified'")
def absent_unresolved(t: Tables):
    return workflow.absent_unresolved(_health(t), t.packages())


@query("identity_block", _H + """, ov AS (SELECT p_partkey AS id, p_size AS package_id, CAST(floor(p_retailprice) AS BIGINT) AS observed_at, 'u' || (p_partkey % 3) AS actor, p_type AS reason FROM part), n AS (SELECT package_id, arg_max(id, (observed_at, id)) AS override_id, arg_max(actor, (observed_at, id)) AS actor, arg_max(reason, (observed_at, id)) AS reason FROM ov GROUP BY 1),
mp AS (SELECT s_nationkey AS package_id, count(*) AS mappings, arg_max(s_suppkey, (CAST(floor(s_acctbal) AS BIGINT), s_suppkey)) AS newest FROM supplier GROUP BY 1)
SELECT package_id, confidence, override_id, actor, reason, coalesce(mappings, 0) AS mappings, newest FROM pkg LEFT JOIN n USING (package_id) LEFT JOIN mp USING (package_id)""")
def identity_block(t: Tables):
    overrides = t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("package_id"), F.floor("p_retailprice").alias("observed_at"), F.concat(F.lit("u"), (F.col("p_partkey") % 3).cast("string")).alias("actor"), F.col("p_type").alias("reason"))
    mappings = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("package_id"), F.floor("s_acctbal").alias("resolved_at"), F.lit("feedstock").alias("kind"), F.lit("ok").alias("outcome"))
    rows = surface.identity(t.packages(), overrides, mappings)
    return rows.select("package_id", "confidence", F.col("override.id").alias("override_id"), "override.actor", "override.reason", F.coalesce(F.size("mappings"), F.lit(0)).cast("long").alias("mappings"), F.get("mappings", F.lit(0))["id"].alias("newest"))


_ENTRIES = "entries AS (SELECT c_name AS source_package_key, c_custkey AS id, c_mktsegment AS package_name, CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '2024-01-01' END AS retired_at FROM customer)"


def _entries(t: Tables):
    k = F.col("c_custkey")
    return t.customer.select(F.col("c_name").alias("source_package_key"), k.alias("id"), F.col("c_mktsegment").alias("package_name"), (k % 7).cast("int").alias("internal_component_count"), F.when(k % 3 != 0, (k % 5).cast("int")).alias("internal_lob_count"), F.lit(None).cast("int").alias("apps"), F.lit(1).alias("platforms"), F.lit(None).cast("int").alias("downloads"), F.lit(None).cast("int").alias("versions"), F.when(k % 4 == 0, F.lit("2024-01-01")).cast("timestamp_ntz").alias("retired_at"))


@query("inventory_page", f"WITH {_ENTRIES} SELECT source_package_key, package_name FROM entries WHERE retired_at IS NULL AND starts_with(source_package_key, 'Customer#00000001')")
def inventory_page(t: Tables):
    return surface.inventory_page(_entries(t), True, "Customer#00000001").select("source_package_key", "package_name")


@query("inventory_recent_changes", "SELECT o_orderkey AS id, 'k' || o_custkey AS source_package_key, o_orderpriority AS actor FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def inventory_recent_changes(t: Tables):
    changes = t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("source_package_key"), F.col("o_orderpriority").alias("actor"), F.col("o_orderdate").alias("changed_at"))
    return surface.recent(changes, "changed_at").select("id", "source_package_key", "actor")


@query("inventory_records", "SELECT c_name AS source_package_key, '{\"source_package_key\":\"' || c_name || '\",\"package_name\":\"' || c_mktsegment || '\",\"internal_component_count\":' || (c_custkey % 7) || CASE WHEN c_custkey % 3 <> 0 THEN ',\"internal_lob_count\":' || (c_custkey % 5) ELSE '' END || ',\"platforms\":1}' AS record FROM customer WHERE c_custkey % 4 <> 0")
def inventory_records(t: Tables):
    return documents.active_records(_entries(t))


@query("digest_problems", f"WITH {EV}, {_LEDGER}, g AS (SELECT collector, count(*) FILTER (WHERE status = 'failed') AS f, count(*) FILTER (WHERE status = 'failed' AND contains(detail, 'rate limit')) AS r FROM ledger WHERE finished_at >= TIMESTAMP '2024-01-19' AND finished_at < TIMESTAMP '2024-01-20' GROUP BY 1) SELECT collector, collector || ' ' || CASE WHEN f > 0 THEN f || CASE WHEN f = 1 THEN ' failed collection' ELSE ' failed collections' END || CASE WHEN r > 0 THEN ', ' ELSE '' END ELSE '' END || CASE WHEN r > 0 THEN r || ' rate-limited' ELSE '' END AS clause FROM g WHERE f > 0 OR r > 0")
def digest_problems(t: Tables):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    figures = digest.histogram(ledger(t), at("2024-01-19"), at("2024-01-20"))
    return reports.problems(figures.select("collector", "failed", "rate_limited", F.lit(0).alias("past_target"), F.lit(0).alias("never_observed")))


@query("digest_lines", f"WITH {EV}, {_LEDGER}, g AS (SELECT collector, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in vocab.RUN_STATES) + """, count(*) FILTER (WHERE status = 'failed' AND contains(detail, 'rate limit')) AS r FROM ledger WHERE finished_at >= TIMESTAMP '2024-01-19' AND finished_at < TIMESTAMP '2024-01-20' GROUP BY 1),
w AS (SELECT collector, r, concat_ws(', ', """ + ", ".join(f"CASE WHEN {s} > 0 THEN {s} || ' {s}' END" for s in vocab.RUN_STATES) + """) AS said FROM g)
SELECT n.collector, 'collections ' || coalesce(nullif(said, ''), 'none') || '; ' || coalesce(r, 0) || ' rate-limited' || CASE WHEN n.days IS NOT NULL THEN '; 4 past the freshness target of ' || n.days || CASE WHEN n.days = 1 THEN ' day' ELSE ' days' END || ', 2 never observed' ELSE '' END AS line
FROM (VALUES ('c0', 1), ('c1', 2), ('c2', NULL), ('c3', 14), ('never', 2)) n(collector, days) LEFT JOIN w USING (collector)""")
def digest_lines(t: Tables):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    scopes = t.spark.createDataFrame([("c0", 1), ("c1", 2), ("c2", None), ("c3", 14), ("never", 2)], "collector string, target_days int")
    fresh = scopes.select("collector", F.lit(4).alias("past_target"), F.lit(2).alias("never_observed"))
    return digest.composed(scopes, digest.histogram(ledger(t), at("2024-01-19"), at("2024-01-20")), fresh)


_FIGURES = """lg AS (SELECT collector, status, count(*) AS n, count(*) FILTER (WHERE status = 'failed' AND detail LIKE '%rate limit%') AS r FROM ledger WHERE finished_at >= TIMESTAMP '2024-01-19' AND finished_at < TIMESTAMP '2024-01-20' GROUP BY 1, 2),
c AS (SELECT collector, coalesce(sum(n) FILTER (WHERE status = 'failed'), 0) AS failed, coalesce(sum(r), 0) AS limited FROM lg GROUP BY 1), sc AS (SELECT * FROM (VALUES ('c3', 1), ('c0', 2), ('c1', 3), ('never', 4)) x(collector, position)),
s AS (SELECT position, sc.collector, concat_ws(', ', CASE WHEN failed > 0 THEN failed || ' failed collection' || CASE WHEN failed = 1 THEN '' ELSE 's' END END, CASE WHEN limited > 0 THEN limited || ' rate-limited' END, CASE WHEN position > 2 THEN '4 past target' END, CASE WHEN position = 4 THEN '2 never observed' END) AS p FROM sc LEFT JOIN c USING (collector)),
stand AS (SELECT coalesce(string_agg(collector || ' ' || p, '; ' ORDER BY position), 'nothing') AS standing FROM s WHERE p <> '')"""


def _figures(t: Tables):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    scopes = t.spark.createDataFrame([("c3", 1, None), ("c0", 2, None), ("c1", 3, 2), ("never", 4, 14)], "collector string, position int, target_days int")
    counted = digest.histogram(ledger(t), at("2024-01-19"), at("2024-01-20"))
    fresh = scopes.select("collector", F.when(F.col("position") > 2, 4).otherwise(0).alias("past_target"), F.when(F.col("position") == 4, 2).otherwise(0).alias("never_observed"))
    return scopes, counted, fresh


@query("digest_unchanged", f"WITH {EV}, {_LEDGER}, {_FIGURES} SELECT 'evidence digest 2024-01-20 (unchanged)' || chr(10) || 'Nothing changed since the digest of 2024-01-18 -- standing: ' || standing || chr(10) || 'Trace: t1' AS text FROM stand")
def digest_unchanged(t: Tables):
    return digest.unchanged_text("evidence digest", "2024-01-20", "2024-01-18", digest.standing(*_figures(t)), "t1")


@query("digest_text", f"""WITH {EV}, {_LEDGER}, {PKG}, {_FIGURES}, st AS (SELECT sc.position, sc.collector, coalesce(string_agg(n || ' ' || status, ', ' ORDER BY list_position(['running', 'succeeded', 'partial', 'failed', 'skipped'], status)) FILTER (WHERE n > 0), 'none') AS states, coalesce(sum(r), 0) AS limited FROM sc LEFT JOIN lg USING (collector) GROUP BY 1, 2),
ln AS (SELECT position, '  ' || collector || ': ' || concat_ws('; ', 'collections ' || states, limited || ' rate-limited', CASE position WHEN 3 THEN '4 past the freshness target of 2 days, 0 never observed' WHEN 4 THEN '4 past the freshness target of 14 days, 2 never observed' END) AS line FROM st),
body AS (SELECT string_agg(line, chr(10) ORDER BY position) AS body FROM ln), n AS (SELECT count(*) FILTER (WHERE confidence = 'verified') AS v, count(*) FILTER (WHERE confidence = 'inventory-derived') AS i, count(*) FILTER (WHERE confidence = 'unmapped') AS u FROM pkg),
q AS (SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS failed, count(*) FILTER (WHERE o_orderstatus = 'O') AS succeeded FROM orders), inv AS (SELECT count(*) FILTER (WHERE state = 'ok') AS ingested, count(*) FILTER (WHERE state = 'not_found') AS absent, max(observed_at) FILTER (WHERE observed_at <= TIMESTAMP '{CUTOFF}') AS ended FROM ev)
SELECT concat_ws(chr(10), 'evidence digest 2024-01-20', 'Window: 2024-01-19 00:00Z to 2024-01-20 00:00Z', 'Trace: none', '', 'Collectors', body, '', 'Overall', '  prune runs: ' || CASE WHEN succeeded + failed = 0 THEN 'none' ELSE concat_ws(', ', CASE WHEN succeeded > 0 THEN succeeded || ' succeeded' END, CASE WHEN failed > 0 THEN failed || ' failed' END) END, '  inventory: ' || ingested || ' ingested, ' || absent || ' absent',
 '  packages: ' || v || ' resolved (' || v || ' verified), ' || (i + u) || ' unresolved (' || i || ' inventory-derived, ' || u || ' unmapped)', '  policy run: version 2024.10 finished ' || strftime(ended, '%Y-%m-%d %H:%MZ') || ', ' || (SELECT k || CASE WHEN h THEN ' hour' ELSE ' minute' END || CASE WHEN k = 1 THEN '' ELSE 's' END FROM (SELECT g >= 3600 AS h, CAST(floor(g / CASE WHEN g >= 3600 THEN 3600 ELSE 60 END) AS BIGINT) AS k FROM (SELECT epoch(TIMESTAMP '2024-01-20') - floor(epoch(ended)) AS g))) || ' ago, partial') AS text FROM body, n, q, inv""")
def digest_text(t: Tables):
    """The whole digest of a day."""
    scopes, counted, fresh = _figures(t)
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    lines = digest.composed(scopes, counted, fresh)
    prune = t.orders.agg(F.count_if(F.col("o_orderstatus") == "O").alias("prune_succeeded"), F.count_if(F.col("o_orderstatus") == "F").alias("prune_failed"), *[F.lit(0).alias(f"prune_{s}") for s in digest.RUN_STATES if s not in ("succeeded", "failed")])
    seen = t.evidence().agg(F.count_if(F.col("state") == "ok").alias("ingested"), F.count_if(F.col("state") == "not_found").alias("absent"), F.lit("2024.10").alias("version"), F.max(F.when(F.col("observed_at") <= t.cutoff, F.col("observed_at"))).alias("finished_at"), F.lit("partial").alias("status"))
    sure = t.packages().agg(*[F.count_if(F.col("confidence") == c).alias(c) for c in ("verified", "inventory-derived", "unmapped")])
    return digest.full_text("evidence digest", lines, scopes, prune.crossJoin(seen).crossJoin(sure), at("2024-01-20"), at("2024-01-19"))  # one row each


@query("detail_traces", f"""WITH {EVC}, {PKG}, d AS (SELECT package_id, max(state) FILTER (WHERE id = m) AS state, m FROM (SELECT *, max(id) OVER (PARTITION BY package_id) AS m FROM evc WHERE package_id % 6 <> 0) GROUP BY package_id, m),
o AS (SELECT package_id, id, state, observed_at, row_number() OVER (PARTITION BY package_id ORDER BY observed_at DESC, id DESC) AS rn, count(*) OVER (PARTITION BY package_id) AS n FROM evc),
t AS (SELECT pkg.package_id, CASE WHEN d.package_id IS NULL OR confidence = 'unmapped' THEN 'unknown' ELSE d.state END AS status, CASE WHEN d.package_id IS NULL THEN 'no evaluation recorded at this run' WHEN m % 4 = 0 THEN 'no observation cited at this run' ELSE 'snapshots' END AS produced_from, CASE WHEN m % 4 <> 0 THEN m END AS cited FROM pkg LEFT JOIN d USING (package_id))
SELECT t.package_id, status, produced_from, CASE WHEN cited IS NULL THEN 0 ELSE max(n) END AS observation_count, coalesce(string_agg(o.id || ' ' || o.state || CASE WHEN o.id = cited THEN ' cited' ELSE '' END, ', ' ORDER BY rn) FILTER (WHERE cited IS NOT NULL), '') AS observations
FROM t LEFT JOIN o ON o.package_id = t.package_id AND rn <= 20 GROUP BY t.package_id, status, produced_from, cited""")
def detail_traces(t: Tables):
    """Each package's status at its run, the newest twenty rows behind it and how many there are."""
    rows = asof.upto(t.evidence(), t.cutoff)
    derived = rows.where(F.col("package_id") % 6 != 0).groupBy("package_id").agg(F.max(F.struct("id", "state")).alias("m")).select("package_id", F.lit(3).alias("policy_run_id"), "m.state", "m.id")
    health = t.packages().select("package_id", F.lit(3).alias("policy_run_id"), "confidence")
    out = surface.trace(health, derived, "state", F.when(F.col("id") % 4 != 0, F.col("id")), rows, "snapshots")
    shown = F.transform("observations", lambda o: F.concat(o["id"].cast("string"), F.lit(" "), o["state"], F.when(o["cited"], " cited").otherwise("")))
    return out.select("package_id", "status", "produced_from", "observation_count", F.array_join(shown, ", ").alias("observations"))


@query("digest_history", "WITH d AS (SELECT date_trunc('hour', ts) AS observed_at, count(*) AS figures, max(event_id) AS id FROM events GROUP BY 1) SELECT observed_at, figures, row_number() OVER (ORDER BY observed_at DESC, id DESC) AS place FROM d QUALIFY place <= 31")
def digest_history(t: Tables):
    digests = t.events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("observed_at")).agg(F.count("*").alias("figures"), F.max("event_id").alias("id"))
    return digest.history(digests).select("observed_at", "figures", F.col("place").cast("long").alias("place"))


@query("detail_recent_runs", f"WITH {EV}, {_LEDGER} SELECT package_id, id, collector, status FROM (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY started_at DESC, id DESC) AS rn FROM ledger WHERE started_at <= TIMESTAMP '{CUTOFF}') WHERE rn <= 20")
def detail_recent_runs(t: Tables):
    return asof.last(ledger(t).withColumn("observed_at", F.col("started_at")), ["package_id"], t.cutoff, 20).select("package_id", "id", "collector", "status")
