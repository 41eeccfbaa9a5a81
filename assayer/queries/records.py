"""Documents, guards, written tables and streams over the supplied tables."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from assayer.adapters import CUTOFF, EV, EVC, FIND, PKG, Tables, query
from assayer.functions import text, vocab
from assayer.operators import asof, collection, inventory, replay, retention, surface
from assayer.plans import passes, rollup
from assayer.queries.evidence import _licences, _NORMAL, _RAW, _sql_list, _SWEEP, _AT
from assayer.sources import documents, files
from assayer.streaming import ingest
from assayer.streaming.folders import scratch


def _folder(t: Tables) -> str:
    return f"{scratch(t.spark)}/{uuid.uuid4().hex}"


def _keyed(t: Tables, body):
    return t.part.select(F.col("p_partkey").alias("package_id"), body.alias("body"))


# Histories and cut-offs


@query("histories_of_ids", f"WITH {EVC} SELECT package_id, id, state FROM evc WHERE package_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def histories_of_ids(t: Tables):
    some = t.customer.where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("package_id"))
    return asof.of(t.evidence(), some, t.cutoff).select("package_id", "id", "state")


@query("cutoff_without_purges", f"WITH {EV}, l AS (SELECT observed_at AS s, CASE WHEN id % 97 <> 0 OR observed_at < TIMESTAMP '{CUTOFF}' THEN observed_at + INTERVAL 1 HOUR END AS f, CASE WHEN id % 2 = 0 THEN 'prune' ELSE 'c' END AS c FROM ev), n AS (SELECT * FROM l WHERE c <> 'prune'), b AS (SELECT min(s) FILTER (WHERE f IS NULL) AS bound FROM n) SELECT max(f) AS cutoff FROM n, b WHERE bound IS NULL OR f <= bound")
def cutoff_without_purges(t: Tables):
    unfinished = (F.col("id") % 97 == 0) & (F.col("observed_at") >= t.cutoff)
    ledger = t.evidence().select(F.col("observed_at").alias("started_at"), F.when(~unfinished, F.col("observed_at") + F.expr("INTERVAL 1 HOUR")).alias("finished_at"), F.when(F.col("id") % 2 == 0, "prune").otherwise("c").alias("collector"))
    return rollup.evidence_cutoff(ledger)


@query("replay_cutoffs", "SELECT c_custkey AS id, EXISTS (SELECT 1 FROM orders WHERE o_orderdate = TIMESTAMP '1995-01-01' + INTERVAL 1 DAY * CAST(c_custkey % 4000 AS INTEGER)) AS known FROM customer")
def replay_cutoffs(t: Tables):
    asked = t.customer.select(F.col("c_custkey").alias("id"), (F.lit("1995-01-01").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY") * (F.col("c_custkey") % 4000).cast("int")).alias("evidence_cutoff"))
    return replay.known_cutoffs(asked, t.orders.select(F.col("o_orderdate").alias("evidence_cutoff"))).select("id", "known")


@query("moved_cutoffs", "WITH p AS (SELECT n_nationkey AS run_id, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * CAST(n_nationkey AS INTEGER) AS s, TIMESTAMP '2023-10-01' + INTERVAL 1 DAY * CAST(n_nationkey + CASE WHEN n_nationkey % 5 = 3 THEN 2 ELSE 0 END AS INTEGER) AS c FROM nation), q AS (SELECT *, lag(c) OVER (ORDER BY s) + (s - lag(s) OVER (ORDER BY s)) AS e FROM p) SELECT run_id FROM q WHERE e IS NOT NULL AND (c > e + INTERVAL 1 DAY OR c < e - INTERVAL 1 DAY)")
def moved_cutoffs(t: Tables):
    n = F.col("n_nationkey")
    day = lambda start, k: F.lit(start).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY") * k.cast("int")
    purges = t.nation.select(n.alias("run_id"), day("2024-01-01", n).alias("started_at"), day("2023-10-01", n + F.when(n % 5 == 3, 2).otherwise(0)).alias("cutoff"))
    return retention.moved_cutoffs(purges).select("run_id")


@query("collector_limits", """SELECT n_nationkey, count(s_suppkey) AS packages, CAST(97 * count(s_suppkey) AS DOUBLE) AS worst_seconds, coalesce(max(old), 0) AS past_retention FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey
 LEFT JOIN (SELECT c_nationkey, count(*) AS old FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 90 DAY GROUP BY 1) ON c_nationkey = n_nationkey GROUP BY 1""")
def collector_limits(t: Tables):
    """How long a sweep of each nation's suppliers can take, and how many of its orders a retention of 90 days is over for."""
    from datetime import datetime

    assert not collection.cadence_faults()
    cutoff = F.lit(collection.retention_cutoff(datetime(1998, 1, 1), 90)).cast("timestamp_ntz")
    old = t.orders.where(F.col("o_orderdate") < cutoff).join(t.customer, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("past_retention"))
    own = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("packages"))
    rows = t.nation.select("n_nationkey").join(own, "n_nationkey", "left").join(old, "n_nationkey", "left").fillna(0)
    return rows.select("n_nationkey", "packages", (F.col("packages") * collection.worst_seconds(30.0, 2, 7 / 3)).alias("worst_seconds"), "past_retention")


# Documents


@query("inventory_documents", "SELECT 'k' || s_suppkey AS source_package_key, CASE WHEN s_suppkey % 5 = 0 THEN ' ' ELSE s_name END AS package_name, CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_nationkey AS INTEGER) END AS internal_component_count, CASE WHEN s_suppkey % 5 = 0 THEN 'package_name' WHEN s_suppkey % 3 = 0 THEN 'internal_component_count' END AS fault FROM supplier")
def inventory_documents(t: Tables):
    return _inventory_records(t).select("source_package_key", "package_name", "internal_component_count", "fault")


def _inventory_records(t: Tables):
    k = F.col("s_suppkey")
    record = F.struct(F.concat(F.lit("k"), k.cast("string")).alias("source_package_key"), F.when(k % 5 == 0, " ").otherwise(F.col("s_name")).alias("package_name"), F.when(k % 3 != 0, F.col("s_nationkey").cast("int")).alias("internal_component_count"), F.lit(1).alias("internal_lob_count"))
    docs = t.supplier.groupBy("s_nationkey").agg(F.to_json(F.collect_list(record)).alias("body"))
    return documents.inventory(docs)


@query("sweep_outcome", "WITH r AS (SELECT s_name, s_suppkey % 5 = 0 OR s_suppkey % 3 = 0 AS bad FROM supplier), s AS (SELECT count(*) FILTER (WHERE NOT bad) AS observed, count(*) FILTER (WHERE bad) AS failed FROM r) SELECT observed, failed, (SELECT count(DISTINCT s_name) FROM r WHERE NOT bad) AS shells, CASE WHEN failed = 0 THEN 'succeeded' WHEN observed = 0 THEN 'failed' ELSE 'partial' END AS status, observed > 0 AS derives_absences FROM s")
def sweep_outcome(t: Tables):
    return collection.swept(_inventory_records(t), t.packages())


_STATES = "CASE o_orderkey % 9 WHEN 0 THEN 'not_applicable' WHEN 1 THEN 'error' WHEN 2 THEN 'error' WHEN 3 THEN 'not_found' WHEN 4 THEN 'unmodified' WHEN 5 THEN 'error' WHEN 6 THEN 'error' ELSE 'ok' END"


def _bronze(t: Tables):
    i = F.col("o_orderkey") % 9
    status = F.when(i == 2, None).when(i == 3, 410).when(i == 4, 304).when(i == 5, 503).otherwise(200).cast("int")
    return t.orders.select(F.lit("c").alias("collector"), F.col("o_orderkey").alias("package_id"), (i != 0).alias("applicable"), (i == 1).alias("refused"), status.alias("status_code"), F.when(i == 6, "  ").otherwise("{}").alias("body"), F.col("o_orderdate").alias("observed_at"))


@query("collected_states", f"SELECT o_orderkey AS package_id, {_STATES} AS state FROM orders")
def collected_states(t: Tables):
    return documents.collected(_bronze(t)).select("package_id", "state")


@query("channel_licences", f"""WITH g AS (SELECT p_partkey AS package_id, p_partkey % {len(_RAW) + 3} AS i FROM part)
SELECT package_id, 'main' AS channel, CASE WHEN i = {len(_RAW) + 2} THEN 'error' WHEN i < {len(_RAW)} AND {_sql_list(_NORMAL)}[i + 1] IS NOT NULL THEN 'normalized' ELSE 'unknown' END AS state, CASE WHEN i < {len(_RAW)} THEN {_sql_list(_NORMAL)}[i + 1] END AS normalized_license,
 CASE WHEN i = {len(_RAW)} THEN 'no field' WHEN i = {len(_RAW) + 1} THEN 'control characters' WHEN i = {len(_RAW) + 2} THEN 'no document' WHEN {_sql_list(_RAW)}[i + 1] = '' THEN 'none stated' WHEN {_sql_list(_NORMAL)}[i + 1] IS NULL THEN 'not recognised' ELSE '' END AS detail FROM g""")
def channel_licences(t: Tables):
    i = F.col("p_partkey") % (len(_RAW) + 3)
    stated = F.to_json(F.struct(F.element_at(vocab.strings([*_RAW, "", "", ""]), (i + 1).cast("int")).alias("license")))
    body = F.when(i == len(_RAW), "{}").when(i == len(_RAW) + 1, '{"license": "MIT\\nISC"}').when(i == len(_RAW) + 2, "odd").otherwise(stated)
    return documents.channel_licences(_keyed(t, body), "main").select("package_id", "channel", "state", "normalized_license", "detail")


@query("stated_expressions", f"WITH {FIND}, {_SWEEP}, e AS (SELECT DISTINCT package_id, {_sql_list(_NORMAL)}[id % {len(_RAW)} + 1] AS e FROM sw WHERE id % 5 <> 0) SELECT package_id, string_agg(e, '; ' ORDER BY e) AS expressions FROM e WHERE e IS NOT NULL GROUP BY 1")
def stated_expressions(t: Tables):
    rows = passes.stated_expressions(_licences(t), F.lit(_AT).cast("timestamp_ntz"))
    return rows.select("package_id", F.array_join("expressions", "; ").alias("expressions"))


@query("tag_facts", "SELECT p_partkey AS package_id, CASE WHEN p_partkey % 3 > 0 THEN 'v' || p_size END AS latest_version FROM part")
def tag_facts(t: Tables):
    i, name = F.col("p_partkey") % 3, F.concat(F.lit(" v"), F.col("p_size").cast("string"))
    tag = lambda value: F.struct(value.alias("name"))
    none, blank = tag(F.lit(None).cast("string")), tag(F.lit("  "))
    body = F.to_json(F.when(i == 0, F.array(none, blank)).when(i == 1, F.array(blank, tag(name), tag(F.lit("v0")))).otherwise(F.array(tag(name), none)))
    return documents.tags(_keyed(t, body))


@query("feedstock_index", "SELECT p_partkey AS package_id, CASE p_partkey % 4 WHEN 0 THEN 'a,n' || p_size WHEN 1 THEN '' END AS feedstocks, CASE p_partkey % 4 WHEN 2 THEN 'not a name' WHEN 3 THEN 'not a list' END AS fault FROM part")
def feedstock_index(t: Tables):
    i, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    listed = F.concat(F.lit('{"feedstocks": ["A", " N'), n, F.lit('", "a"]}'))
    body = F.when(i == 0, listed).when(i == 1, '{"feedstocks": []}').when(i == 2, '{"feedstocks": ["a", "b c"]}').otherwise('{"feedstocks": 1}')
    return documents.feedstock_index(_keyed(t, body)).select("package_id", F.array_join("feedstocks", ",").alias("feedstocks"), "fault")


@query("project_urls", "SELECT p_partkey AS package_id, 'Source=https://x/' || p_partkey AS urls FROM part")
def project_urls(t: Tables):
    body = F.concat(F.lit('{"info": {"project_urls": {" Source ": " https://x/'), F.col("p_partkey").cast("string"), F.lit(' ", "": "y", "Blank": "  ", "None": null}}}'))
    rows = documents.project_urls(_keyed(t, body))
    return rows.select("package_id", F.array_join(F.transform(F.map_entries("urls"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("urls"))


@query("catalog_dates", "SELECT 'adv-' || p_partkey AS advisory_id, CASE WHEN p_partkey % 5 = 0 THEN TIMESTAMP '2024-01-02 03:00:00' END AS date_added, CASE p_partkey % 5 WHEN 1 THEN 'no date' WHEN 2 THEN 'unreadable' WHEN 3 THEN 'out of range' WHEN 4 THEN 'out of range' END AS fault FROM part")
def catalog_dates(t: Tables):
    date = F.element_at(vocab.strings(("2024-01-02T03:00:00Z", " ", "2024-01-02", "1998-12-31T23:59:59Z", "2200-01-01T00:00:01Z")), (F.col("p_partkey") % 5 + 1).cast("int"))
    entry = F.struct(F.concat(F.lit("ADV-"), F.col("p_partkey").cast("string")).alias("advisory_id"), date.alias("date_added"))
    return documents.catalog(_keyed(t, F.to_json(F.struct(F.array(entry).alias("entries"))))).withColumn("date_added", F.col("date_added").cast("timestamp_ntz"))


@query("index_release", "SELECT p_partkey AS package_id, '1.' || p_size AS version, CASE WHEN p_partkey % 3 > 0 THEN TIMESTAMP '2024-02-01' + INTERVAL 1 DAY * CAST(p_partkey % 3 AS INTEGER) END AS released_at FROM part")
def index_release(t: Tables):
    k, version = F.col("p_partkey"), F.concat(F.lit("1."), F.col("p_size").cast("string"))
    upload = lambda day: F.struct(F.concat(F.lit("2024-02-0"), day.cast("string"), F.lit("T00:00:00Z")).alias("upload_time_iso_8601"))
    odd = F.struct(F.lit("soon").alias("upload_time_iso_8601"))
    files_ = F.when(k % 3 == 0, F.array(odd)).otherwise(F.array(upload(F.lit(9)), upload(k % 3 + 1), odd))
    body = F.to_json(F.struct(F.struct(version.alias("version")).alias("info"), F.create_map(version, files_, F.lit("0"), F.array(upload(F.lit(1)))).alias("releases")))
    return documents.index_facts(_keyed(t, body)).select("package_id", "version", F.col("released_at").cast("timestamp_ntz").alias("released_at"))


@query("recipe_fields", "SELECT p_partkey AS package_id, CASE p_partkey % 3 WHEN 0 THEN '1.' || p_size WHEN 1 THEN '2.' || p_size END AS version, CASE WHEN p_partkey % 3 < 2 THEN CAST(p_size AS INTEGER) END AS number FROM part")
def recipe_fields(t: Tables):
    i, n = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    template = F.concat(F.lit('{% set version = "1.'), n, F.lit('" %}\npackage:\n  name: x\n  version: {{ version }}\nbuild:\n  skip: true\n  number: '), n, F.lit("\n"))
    plain = F.concat(F.lit("package:\n  name: x # v\n  version: '2."), n, F.lit("'\nbuild:\n  number: "), n, F.lit("  # n\n"))
    body = F.when(i == 0, template).when(i == 1, plain).otherwise("package:\n  name: x\n  version: ${{ version }}\n")
    return t.part.select(F.col("p_partkey").alias("package_id"), text.recipe_version(body).alias("version"), text.build_number(body).alias("number"))


@query("staged_recipes", "SELECT p_partkey AS package_id, CASE WHEN p_partkey % 3 = 1 THEN 'https://pr/' || p_partkey END AS url FROM part")
def staged_recipes(t: Tables):
    k, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    item = lambda title: F.struct(title.alias("title"), F.concat(F.lit("https://pr/"), n).alias("html_url"))
    own, other = item(F.concat(F.lit("Add Pkg_"), n, F.lit(": new"))), item(F.lit("Add something"))
    items = F.when(k % 3 == 0, F.array(other)).when(k % 3 == 1, F.array(other, own)).otherwise(F.array(own, own))
    docs = t.part.select(k.alias("package_id"), F.concat(F.lit("pkg-"), n).alias("name"), F.to_json(F.struct(F.lit(2).alias("total_count"), items.alias("items"))).alias("body"))
    return documents.staged_recipe(docs)


@query("repository_facts", "SELECT p_partkey AS package_id, 'n' || p_partkey AS feedstock_name, 'https://x' AS feedstock_url, TIMESTAMP '2024-01-01 01:00:00' AS last_activity_at FROM part")
def repository_facts(t: Tables):
    body = F.to_json(F.struct(F.concat(F.lit("n"), F.col("p_partkey").cast("string"), F.lit("-feedstock")).alias("name"), F.lit("https://x").alias("html_url"), F.lit("2024-01-01T01:00:00Z").alias("pushed_at")))
    return documents.repository_facts(_keyed(t, body)).withColumn("last_activity_at", F.col("last_activity_at").cast("timestamp_ntz"))


# Text


@query("text_forms", "SELECT p_partkey, lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS label, 'pkg:conda/' || p_name AS purl, sha256('c' || ':' || p_size) AS window_key, CASE WHEN length(p_name) <= 12 THEN p_name ELSE p_name[:12] || ' ...' END AS detail, CASE WHEN p_partkey % 2 = 0 THEN 'pkg:pypi/n' || p_partkey END AS locator FROM part")
def text_forms(t: Tables):
    name, k = F.col("p_name"), F.col("p_partkey")
    purl = F.when(k % 2 == 0, F.concat(F.lit("pkg:pypi/n"), k.cast("string"), F.lit("@1"))).otherwise("odd")
    return t.part.select("p_partkey", text.project_label(name).alias("label"), text.package_url("conda", name).alias("purl"), text.window_key(F.lit("c"), F.col("p_size")).alias("window_key"), text.safe_detail(name, 12, "...").alias("detail"), collection.advisory_locator(purl).alias("locator"))


@query("index_paths", "WITH g AS (SELECT p_partkey, lower(p_name) AS n, rpad(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g'), 3, 'z') AS p FROM part) SELECT p_partkey, p[1] || '/' || p[2] || '/' || p[3] || '/' || n AS path FROM g")
def index_paths(t: Tables):
    return t.part.select("p_partkey", text.index_path(F.col("p_name")).alias("path"))


@query("safe_details", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN left(repeat('x ' || event_id || '  ', 200), 1024) || ' [shortened by this collector]' ELSE 'a b c' || event_id END AS detail FROM events WHERE event_id % 3 <> 0 OR length(repeat('x ' || event_id || '  ', 200)) > 1024 UNION ALL SELECT event_id, repeat('x ' || event_id || '  ', 200) FROM events WHERE event_id % 3 = 0 AND length(repeat('x ' || event_id || '  ', 200)) <= 1024")
def safe_details(t: Tables):
    n = F.col("event_id").cast("string")
    long = F.expr("repeat(concat('x ', event_id, '\t\t'), 200)")
    return t.events.select("event_id", text.safe_detail(F.when(F.col("event_id") % 3 == 0, long).otherwise(F.concat(F.lit("a\tb\x7fc"), n))).alias("detail"))


# Guards


@query("credential_refusals", f"WITH {EV}, c AS (SELECT 'c' || surface AS collector, id, observed_at AS t, id % 6 = 0 AS refused, CAST(floor(epoch(observed_at) / 3600) AS BIGINT) AS w FROM ev), m AS (SELECT *, coalesce(max(CAST(refused AS INTEGER)) OVER (PARTITION BY collector, w ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c) SELECT id, CASE WHEN b = 1 THEN TIMESTAMP '1970-01-01' + INTERVAL 1 HOUR * CAST(w + 1 AS INTEGER) END AS until FROM m")
def credential_refusals(t: Tables):
    calls = t.evidence().select(F.concat(F.lit("c"), F.col("surface").cast("string")).alias("collector"), "id", F.col("observed_at").alias("at"), (F.col("id") % 6 == 0).alias("refused"))
    return inventory.remembered(calls, 3600).select("id", "until")


@query("conditional_cache_lifetime", f"WITH {EVC}, b AS (SELECT package_id, arg_max('b' || id, (observed_at, id)) AS body, max(observed_at) AS at FROM evc WHERE id % 3 = 0 GROUP BY 1) SELECT evc.id, CASE WHEN evc.state = 'unknown' THEN CASE WHEN b.at >= TIMESTAMP '{CUTOFF}' - INTERVAL 2 DAY THEN b.body END ELSE 'own' END AS body FROM evc LEFT JOIN b USING (package_id)")
def conditional_cache_lifetime(t: Tables):
    rows = asof.upto(t.evidence(), t.cutoff)
    answers = rows.select("id", F.col("package_id").alias("key"), F.when(F.col("state") == "unknown", 304).otherwise(200).alias("status_code"), F.lit("own").alias("body"))
    bodies = rows.select("id", F.col("package_id").alias("key"), "observed_at", F.when(F.col("id") % 3 == 0, F.concat(F.lit("b"), F.col("id").cast("string"))).alias("body"))
    return collection.replayed(answers, bodies, t.cutoff, "2 DAYS").select("id", "body")


_TOML = """
[versions."2024.2"]
feedstock_inactivity_days = 90
priority_rules = [{bucket = "p2", when = {currency_status = "behind", license_outcome = "allowed"}}, {bucket = "p9", when = {python_readiness = "inferred_not_ready"}}]
[versions."2024.10"]
feedstock_inactivity_days = 180
priority_rules = [{bucket = "p1", when = {vulnerability_status = "advisories_matched"}}]
"""


@query("parameter_rules", """WITH v AS (SELECT p_partkey AS package_id, CASE WHEN p_partkey % 3 = 0 THEN 'behind' ELSE 'current' END AS c, CASE WHEN p_partkey % 2 = 0 THEN 'allowed' ELSE 'forbidden' END AS l, CASE WHEN p_partkey % 5 = 0 THEN 'inferred_not_ready' ELSE 'unknown' END AS p, CASE WHEN p_partkey % 7 = 0 THEN 'advisories_matched' ELSE 'unknown' END AS a FROM part)
SELECT package_id, '2024.2' AS version, false AS newest, CASE WHEN c = 'behind' AND l = 'allowed' THEN 'p2' WHEN p = 'inferred_not_ready' THEN 'p9' ELSE 'unknown' END AS bucket, CASE WHEN c = 'behind' AND l = 'allowed' THEN 'currency_status=behind,license_outcome=allowed' WHEN p = 'inferred_not_ready' THEN 'python_readiness=inferred_not_ready' END AS conditions FROM v
UNION ALL SELECT package_id, '2024.10', true, CASE WHEN a = 'advisories_matched' THEN 'p1' ELSE 'unknown' END, CASE WHEN a = 'advisories_matched' THEN 'vulnerability_status=advisories_matched' END FROM v""")
def parameter_rules(t: Tables):
    """The rule of each version of the parameters that each package falls under."""
    held, k = files.parameters(_TOML), F.col("p_partkey")
    either = lambda n, a, b, name: F.when(k % n == 0, a).otherwise(b).alias(name)
    verdicts = t.part.select(k.alias("package_id"), either(3, "behind", "current", "currency_status"), either(2, "allowed", "forbidden", "license_outcome"), either(5, "inferred_not_ready", "unknown", "python_readiness"), either(7, "advisories_matched", "unknown", "vulnerability_status"))
    rules = files.rules_of(t.spark, held).withColumn("rule", F.concat(F.lit("rule "), F.col("position").cast("string")))
    out = []
    for version, p in held.items():
        found = passes.priority(verdicts, [(r["bucket"], r["when"]) for r in p.get("priority_rules", ())])
        out.append(verdicts.select("package_id", F.lit(version).alias("version"), F.lit(version == files.newest(held)).alias("newest"), found["bucket"].alias("bucket"), found["rule"].alias("rule")))
    return out[0].unionByName(out[1]).join(F.broadcast(rules.select("version", "rule", "conditions")), ["version", "rule"], "left").drop("rule")  # three rules


# Written tables


@query("evidence_written", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS observed_date, o_orderdate AS observed_at, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS ids FROM orders GROUP BY ALL")
def evidence_written(t: Tables):
    """All orders as batches of evidence, one for each instant."""
    path = _folder(t)
    files.append_batches(t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("observed_at"), F.date_format("o_orderdate", "yyyyMMdd").alias("batch_id")).repartition("batch_id"), path)
    return t.spark.read.parquet(path).groupBy(F.col("observed_date").cast("string").alias("observed_date"), "observed_at").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("derived_rewritten", "SELECT CAST(o_orderkey % 3 AS INTEGER) AS policy_run_id, CASE o_orderkey % 3 WHEN 1 THEN 'new' ELSE 'old' END AS verdict, count(*) AS n FROM orders WHERE NOT (o_orderkey % 3 = 1 AND o_orderkey % 2 = 0) GROUP BY 1, 2")
def derived_rewritten(t: Tables):
    path, k = _folder(t), F.col("o_orderkey")
    files.write_derived(t.orders.select(k.alias("id"), F.lit("old").alias("verdict"), (k % 3).cast("int").alias("policy_run_id")), path)
    files.write_derived(t.orders.where((k % 3 == 1) & (k % 2 != 0)).select(k.alias("id"), F.lit("new").alias("verdict"), (k % 3).cast("int").alias("policy_run_id")), path)
    return t.spark.read.parquet(path).groupBy("policy_run_id", "verdict").agg(F.count("*").alias("n"))


@query("export_lines", """SELECT '# from nation' AS value UNION ALL SELECT 'n_name,half' UNION ALL SELECT '"' || n_name || '","' || CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey // 2 AS VARCHAR) ELSE '' END || '"' FROM nation""")
def export_lines(t: Tables):
    path, k = _folder(t), F.col("n_nationkey")
    files.export_csv(t.nation.select("n_name", F.when(k % 2 == 0, (k / 2).cast("long")).alias("half")), path, "from nation")
    return t.spark.read.text(path)


@query("export_over_cap", f"WITH {PKG} SELECT count(*) > 100 AS over FROM pkg")
def export_over_cap(t: Tables):
    return t.spark.createDataFrame([(surface.over(t.packages(), 100),)], "over boolean")


@query("purge_survivors", "SELECT p_partkey AS id, p_size FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def purge_survivors(t: Tables):
    rows = t.part.select(F.col("p_partkey").alias("id"), "p_size")
    gone = t.lineitem.where(F.col("l_returnflag") == "R").select(F.col("l_partkey").alias("id")).distinct()
    return retention.apply({"parts": gone}, {"parts": rows}, _folder(t))["parts"]


# Streams


def _streamed(t: Tables, rows, write):
    path = _folder(t)
    rows.write.parquet(f"{path}/in")
    write(t.spark.readStream.schema(rows.schema).parquet(f"{path}/in"), f"{path}/out", f"{path}/marks").awaitTermination()
    return t.spark.read.parquet(f"{path}/out")


@query("stream_sweep", f"SELECT {_STATES} AS state, count(*) AS n FROM orders GROUP BY 1")
def stream_sweep(t: Tables):
    return _streamed(t, _bronze(t), ingest.sweep).groupBy("state").agg(F.count("*").alias("n"))


@query("stream_once_in_window", "SELECT DISTINCT 'c' || (event_id % 4) AS collector, user_id AS package_id FROM events")
def stream_once_in_window(t: Tables):
    rows = t.evidence().select(F.concat(F.lit("c"), F.col("surface").cast("string")).alias("collector"), "package_id", "observed_at").coalesce(1)
    longer = timedelta(days=3650) // timedelta(hours=1)  # one window holds the whole log
    return _streamed(t, rows, lambda s, out, marks: ingest.append_new(ingest.once_in_window(s, longer), out, marks)).select("collector", "package_id")


@query("stream_per_window", "WITH w AS (SELECT date_trunc('day', ts) AS day, CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'unknown' WHEN 'purchase' THEN 'not_found' WHEN 'signup' THEN 'not_applicable' ELSE 'error' END AS state, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT max(ts) AS newest FROM events) SELECT day, state, n FROM w, m WHERE day + INTERVAL 1 DAY <= newest - INTERVAL 1 HOUR")
def stream_per_window(t: Tables):
    rows = t.evidence().select("observed_at", "state").coalesce(1)
    out = _streamed(t, rows, lambda s, path, marks: ingest.append_new(ingest.per_window(s, "1 day", "1 hour"), path, marks))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "state", F.col("count").alias("n"))
