"""Retention, replay, inventory, ingestion and text over the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from assayer.adapters import CUTOFF, EV, EVC, FIND, ITEM, PKG, Tables, query
from assayer.functions import specifiers, text
from assayer.functions import vocab
from assayer.operators import asof, inventory, replay, retention
from assayer.queries.evidence import LATEST
from assayer.queries.surface import _LEDGER, ledger
from assayer.sources import documents, files
from assayer.streaming import ingest
from assayer.streaming.folders import scratch

_RUNS = "runs AS (SELECT o_orderkey AS run_id, o_orderdate AS started_at, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 1 DAY END AS finished_at FROM orders)"


def _runs(t: Tables):
    return t.orders.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("finished_at"))


@query("purgeable_runs", f"WITH {_RUNS} SELECT run_id FROM runs WHERE coalesce(finished_at, started_at) < TIMESTAMP '1998-01-01' AND run_id NOT IN (SELECT c_custkey * 10 FROM customer)")
def purgeable_runs(t: Tables):
    shown = t.customer.select((F.col("c_custkey") * 10).alias("policy_run_id"))
    return retention.purgeable_runs(_runs(t), shown, F.lit("1998-01-01").cast("timestamp_ntz")).select("run_id")


_CUTS = "cuts AS (SELECT DISTINCT date_trunc('quarter', o_orderdate) + INTERVAL 41 HOUR AS c FROM orders)"
_FREE = f"""WITH {FIND}, {_CUTS}, i AS (SELECT package_id, t, lead(t) OVER (PARTITION BY package_id ORDER BY t) AS nxt FROM (SELECT DISTINCT package_id, observed_at AS t FROM find)),
free AS (SELECT package_id, t FROM i WHERE nxt IS NOT NULL AND t < TIMESTAMP '2000-01-01' AND NOT EXISTS (SELECT 1 FROM cuts WHERE c >= t AND c < nxt)),
gone AS (SELECT find.* FROM find JOIN free ON free.package_id = find.package_id AND free.t = find.observed_at)"""


def _gone(t: Tables):
    cuts = t.orders.select((F.date_trunc("quarter", "o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL 41 HOURS")).alias("evidence_cutoff")).distinct()
    return retention.removable(t.findings(), ["package_id"], cuts, F.lit("2000-01-01").cast("timestamp_ntz"))


@query("retention_floor", _FREE + " SELECT package_id, id, observed_at FROM gone")
def retention_floor(t: Tables):
    return _gone(t).select("package_id", "id", "observed_at")


@query("retention_citation", _FREE + " SELECT package_id, id FROM gone WHERE id NOT IN (SELECT o_orderkey * 10 + 1 FROM orders WHERE o_orderstatus = 'F') AND id NOT IN (SELECT o_orderkey * 10 + 2 FROM orders)")
def retention_citation(t: Tables):
    citing = [t.orders.where(F.col("o_orderstatus") == "F").select((F.col("o_orderkey") * 10 + 1).alias("cited_id")), t.orders.select((F.col("o_orderkey") * 10 + 2).alias("cited_id"))]
    return retention.uncited(_gone(t), citing).select("package_id", "id")


@query("retention_figures", _FREE + " SELECT (SELECT count(*) FROM find WHERE observed_at < TIMESTAMP '2000-01-01') AS older, (SELECT count(*) FROM gone) AS deleted, (SELECT count(*) FROM find WHERE observed_at < TIMESTAMP '2000-01-01') - (SELECT count(*) FROM gone) AS protected")
def retention_figures(t: Tables):
    return retention.figures(t.findings(), _gone(t), F.lit("2000-01-01").cast("timestamp_ntz"))


@query("ledger_purge_counts", f"WITH {EV}, {_LEDGER} SELECT count(*) FILTER (WHERE finished_at < TIMESTAMP '{CUTOFF}') AS deleted, count(*) FILTER (WHERE finished_at IS NULL AND started_at < TIMESTAMP '{CUTOFF}') AS stale, count(*) FILTER (WHERE NOT coalesce(finished_at < TIMESTAMP '{CUTOFF}', false)) AS kept FROM ledger")
def ledger_purge_counts(t: Tables):
    return retention.ledger_counts(ledger(t), t.cutoff)


@query("replay_diff", f"""WITH {EV}, a AS ({LATEST.format(keys='package_id', ties='', rows="(SELECT * FROM ev WHERE observed_at <= TIMESTAMP '2024-01-02 00:00:00')")}), b AS ({LATEST.format(keys='package_id', ties='', rows="(SELECT * FROM ev WHERE observed_at <= TIMESTAMP '2024-01-03 00:00:00')")}),
j AS (SELECT coalesce(a.package_id, b.package_id) AS package_id, a.id IS NULL OR b.id IS NULL AS lone, a.state AS s1, b.state AS s2, a.version AS v1, b.version AS v2 FROM a FULL JOIN b ON a.package_id = b.package_id)
SELECT package_id, 'state' AS "column", s1 AS before, s2 AS after FROM j WHERE lone OR s1 IS DISTINCT FROM s2 UNION ALL SELECT package_id, 'version', v1, v2 FROM j WHERE lone OR v1 IS DISTINCT FROM v2""")
def replay_diff(t: Tables):
    run = lambda at: asof.latest(t.evidence(), ["package_id"], F.lit(at).cast("timestamp_ntz"))
    return replay.differences(run("2024-01-02 00:00:00"), run("2024-01-03 00:00:00"), ["state", "version"])


_HELD = "held AS (SELECT c_custkey AS k, c_name AS name, c_nationkey AS n, c_custkey % 9 = 0 AS retired FROM customer), ent AS (SELECT s_suppkey * 3 AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'Customer#' || lpad(CAST(s_suppkey * 3 AS VARCHAR), 9, '0') ELSE s_name END AS name, s_nationkey AS n FROM supplier)"


def _merged(t: Tables):
    held = t.customer.select(F.col("c_custkey").alias("source_package_key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("n"), (F.col("c_custkey") % 9 == 0).alias("retired"))
    key = F.col("s_suppkey") * 3
    name = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Customer#"), F.lpad(key.cast("string"), 9, "0"))).otherwise(F.col("s_name"))
    return inventory.merged(held, t.supplier.select(key.alias("source_package_key"), name.alias("name"), F.col("s_nationkey").alias("n")), ["name", "n"], replace=True)


@query("inventory_merge_counts", f"WITH {_HELD}, j AS (SELECT CASE WHEN held.k IS NULL THEN 'added' WHEN ent.k IS NULL THEN CASE WHEN retired THEN 'retired_kept' ELSE 'retired' END WHEN held.name IS NOT DISTINCT FROM ent.name AND held.n IS NOT DISTINCT FROM ent.n AND NOT retired THEN 'unchanged' ELSE 'changed' END AS outcome FROM held FULL JOIN ent ON held.k = ent.k) SELECT outcome, count(*) AS entries FROM j GROUP BY outcome")
def inventory_merge_counts(t: Tables):
    return _merged(t).groupBy("outcome").agg(F.count("*").alias("entries"))


@query("changed_fields_unpivot", f"WITH {_HELD}, j AS (SELECT held.k, held.name AS n1, ent.name AS n2, held.n AS a1, ent.n AS a2 FROM held JOIN ent ON held.k = ent.k) SELECT k AS source_package_key, 'name' AS field, n1 AS prior, n2 AS new FROM j WHERE n1 IS DISTINCT FROM n2 UNION ALL SELECT k, 'n', CAST(a1 AS VARCHAR), CAST(a2 AS VARCHAR) FROM j WHERE a1 IS DISTINCT FROM a2")
def changed_fields_unpivot(t: Tables):
    return inventory.changed_fields(_merged(t), ["name", "n"])


@query("observation_window", f"WITH {EVC}, {_LEDGER.replace('FROM ev)', 'FROM evc)')}, s AS (SELECT DISTINCT collector, package_id FROM ledger) SELECT collector, package_id FROM s WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.collector = s.collector AND l.package_id = s.package_id AND status = 'succeeded' AND finished_at >= TIMESTAMP '{CUTOFF}' - INTERVAL 48 HOUR)")
def observation_window(t: Tables):
    rows = ledger(t).where(F.col("started_at") <= t.cutoff)
    return inventory.due(rows.select("collector", "package_id").distinct(), rows, t.cutoff, 48)


@query("rate_limit_window", f"WITH {EV}, c AS (SELECT 'c' || surface AS collector, id, observed_at AS called, 1 + id % 3 AS cost, CAST(floor(epoch(observed_at) / 3600) AS BIGINT) AS w FROM ev) SELECT collector, id, w AS \"window\", sum(cost) OVER (PARTITION BY collector, w ORDER BY called, id) <= 6 AS admitted FROM c")
def rate_limit_window(t: Tables):
    calls = t.evidence().select(F.concat(F.lit("c"), F.col("surface").cast("string")).alias("collector"), "id", F.col("observed_at").alias("at"), (1 + F.col("id") % 3).alias("cost"))
    return inventory.admitted(calls, 3600, 6).select("collector", "id", "window", "admitted")


@query("alias_catalog_lookup", "WITH f AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'CVE-' WHEN 1 THEN 'ghsa-' ELSE 'OSV-' END || p_size AS advisory_id FROM part), e AS (SELECT unnest(['cve-' || s_nationkey, 'ghsa-' || (s_suppkey % 40)]) AS k FROM supplier) SELECT id, advisory_id, CASE WHEN lower(advisory_id) IN (SELECT k FROM e) THEN 'listed' WHEN split_part(lower(advisory_id), '-', 1) IN (SELECT split_part(k, '-', 1) FROM e) THEN 'not_listed' ELSE 'unknown' END AS answer FROM f")
def alias_catalog_lookup(t: Tables):
    scheme = F.when(F.col("p_partkey") % 3 == 0, "CVE-").when(F.col("p_partkey") % 3 == 1, "ghsa-").otherwise("OSV-")
    findings = t.part.select(F.col("p_partkey").alias("id"), F.concat(scheme, F.col("p_size").cast("string")).alias("advisory_id"))
    entry = F.struct(F.concat(F.lit("CVE-"), F.col("s_nationkey").cast("string")).alias("advisory_id"), F.array(F.concat(F.lit("GHSA-"), (F.col("s_suppkey") % 40).cast("string"))).alias("aliases"), F.lit("2024-01-01T00:00:00Z").alias("date_added"))
    catalog = t.supplier.select(F.to_json(F.struct(F.array(entry).alias("entries"))).alias("body"))
    return documents.listed(findings, documents.catalog(catalog)).select("id", "advisory_id", "answer")


_SPECS = {">=3.{n}": "n <= 14", "<3.{n}": "n > 14", "!=3.{n}.*": "n <> 14", "==3.{n}.*": "n = 14", "~=3.{n}": "n <= 14", ">=3.{n},<4": "n <= 14", ">3.{n}.2, !=3.14.*": "false", "<=3.{n}": "n >= 14", "===3.{n}": "n = 14", ">=3.14,!=3.14.*,<3.15": "false", "~=3.{n}.1": "n = 14", "odd": "NULL"}


@query("specifier_admits", "WITH g AS (SELECT p_partkey, p_size AS n, p_partkey % 12 AS i FROM part) SELECT p_partkey, CASE i " + " ".join(f"WHEN {i} THEN {'CASE WHEN ' + c + chr(32) + 'THEN ' + repr('admitted') + ' ELSE ' + repr('excluded') + ' END' if c != 'NULL' else repr('unreadable')}" for i, c in enumerate(_SPECS.values())) + " END AS reading FROM g")
def specifier_admits(t: Tables):
    form = F.element_at(vocab.strings(_SPECS), (F.col("p_partkey") % 12 + 1).cast("int"))
    spec = F.replace(form, F.lit("{n}"), F.col("p_size").cast("string"))
    return t.part.select("p_partkey", specifiers.admits(spec).alias("reading"))


@query("purl_parse", "WITH g AS (SELECT p_partkey, replace(p_name, ' ', '-') AS n, p_size AS v, p_partkey % 4 AS i FROM part) SELECT p_partkey, CASE WHEN i <> 3 THEN CASE i WHEN 1 THEN 'conda' ELSE 'pypi' END END AS type, CASE WHEN i <> 3 THEN CASE i WHEN 2 THEN n || '+x y' ELSE n END END AS name, CASE i WHEN 0 THEN CAST(v AS VARCHAR) END AS version FROM g")
def purl_parse(t: Tables):
    name, i = F.replace("p_name", F.lit(" "), F.lit("-")), F.col("p_partkey") % 4
    purl = F.when(i == 0, F.concat(F.lit("pkg:pypi/"), name, F.lit("@"), F.col("p_size").cast("string"), F.lit("?q=1"))).when(i == 1, F.concat(F.lit("PKG:Conda/"), name)).when(i == 2, F.concat(F.lit("pkg:pypi/"), name, F.lit("+x%20y#sub"))).otherwise(F.concat(F.lit("pkg:"), name))
    return t.part.select("p_partkey", text.purl_parts(purl).alias("p")).select("p_partkey", "p.type", "p.name", "p.version")


@query("project_name_norm", "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN lower(replace(p_name, ' ', '-')) || '-' || p_size END AS name FROM part")
def project_name_norm(t: Tables):
    raw = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("-"), "p_name")).otherwise(F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit("_.-"))), F.lit("._"), F.col("p_size").cast("string")))
    return t.part.select("p_partkey", text.project_name(raw).alias("name"))


@query("repo_url_norm", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 3 THEN 'https://github.com/own' || s_nationkey || '/repo' || s_suppkey END AS url FROM supplier")
def repo_url_norm(t: Tables):
    i, own, name = F.col("s_suppkey") % 4, F.concat(F.lit("Own"), F.col("s_nationkey").cast("string")), F.concat(F.lit("Repo"), F.col("s_suppkey").cast("string"))
    url = F.when(i == 0, F.concat(F.lit("http://github.com/"), own, F.lit("/"), name, F.lit(".git"))).when(i == 1, F.concat(F.lit(" https://www.GitHub.com/"), own, F.lit("/"), name, F.lit("/tree/main/src?x=1"))).when(i == 2, F.concat(F.lit("https://github.com/"), own, F.lit("/"), name, F.lit("/#readme"))).otherwise(F.concat(F.lit("https://example.org/"), own, F.lit("/"), name))
    return t.supplier.select("s_suppkey", text.repository(url).alias("url"))


@query("version_compare", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '1.' || p_size WHEN 1 THEN 'x' || p_size WHEN 2 THEN '' ELSE '2' END AS version, CASE p_partkey % 4 WHEN 0 THEN 'recorded' WHEN 1 THEN 'not_comparable' WHEN 2 THEN 'unrecorded' ELSE 'not_comparable' END AS kind FROM part")
def version_compare(t: Tables):
    i, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    raw = F.when(i == 0, F.concat(F.lit(" v1."), n)).when(i == 1, F.concat(F.lit("x"), n)).when(i == 2, " V ").otherwise("v2 ")
    fix = F.when(i == 0, F.concat(F.lit("1."), n)).when(i == 1, F.concat(F.lit(">=1."), n)).when(i == 2, "  ").otherwise("1 2")
    return t.part.select("p_partkey", text.comparable_version(raw).alias("version"), text.fix_kind(fix).alias("kind"))


@query("freshness_flags", f"WITH {EVC}, n AS (SELECT package_id, max(observed_at) AS observed_at FROM evc GROUP BY 1), {PKG} SELECT pkg.package_id, coalesce(observed_at < TIMESTAMP '{CUTOFF}' - INTERVAL 12 HOUR, false) AS stale FROM pkg LEFT JOIN n USING (package_id)")
def freshness_flags(t: Tables):
    newest = asof.newest(asof.upto(t.evidence(), t.cutoff), ["package_id"])
    return t.packages().join(newest, "package_id", "left").select("package_id", asof.stale(F.col("observed_at"), t.cutoff, "12 HOURS").alias("stale"))


@query("age_spans", "WITH e AS (SELECT event_id, event_id * 37 % 400000 AS s FROM events) SELECT event_id, CASE WHEN s >= 86400 THEN (s // 86400) || ' day' || CASE WHEN s // 86400 = 1 THEN '' ELSE 's' END WHEN s >= 3600 THEN (s // 3600) || ' hour' || CASE WHEN s // 3600 = 1 THEN '' ELSE 's' END ELSE (s // 60) || ' minute' || CASE WHEN s // 60 = 1 THEN '' ELSE 's' END END AS span FROM e")
def age_spans(t: Tables):
    return t.events.select("event_id", text.span(F.col("event_id") * 37 % 400000).alias("span"))


@query("json_props_parse", "SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k, CAST(props->>'$.k' AS INTEGER) % 10 = 0 AS tenth FROM events")
def json_props_parse(t: Tables):
    k = F.from_json("props", "k int")["k"]
    return t.events.select("event_id", k.alias("k"), (k % 10 == 0).alias("tenth"))


@query("advisory_documents", "SELECT o_custkey AS package_id, 'ADV-' || o_orderkey AS advisory_id, o_orderpriority AS severity FROM orders WHERE o_custkey % 3 <> 0")
def advisory_documents(t: Tables):
    f = F.struct(F.concat(F.lit("ADV-"), F.col("o_orderkey").cast("string")).alias("advisory_id"), F.col("o_orderpriority").alias("severity"))
    docs = t.orders.groupBy(F.col("o_custkey").alias("package_id")).agg(F.collect_list(f).alias("findings"))
    plain, odd = F.to_json(F.struct(F.lit(True).alias("identified"), "findings")), F.to_json(F.struct("findings", F.lit(1).alias("extra")))
    body = docs.select("package_id", F.when(F.col("package_id") % 3 == 0, odd).otherwise(plain).alias("body"))
    return documents.advisories(body).where(F.col("fault").isNull()).select("package_id", "advisory_id", "severity")


@query("release_pick", f"""WITH {ITEM}, r AS (SELECT package_id, item_id, state = 'open' AS draft, state = 'resolved' AS pre, opened_at FROM item)
SELECT package_id, 'v' || arg_max(item_id, (opened_at, item_id)) FILTER (WHERE NOT draft AND NOT pre) AS latest_version, max(opened_at) FILTER (WHERE NOT draft AND NOT pre) AS released_at, max(opened_at) AS last_activity_at,
 CAST(count(*) AS INTEGER) AS releases_seen, CAST(count(*) FILTER (WHERE draft) AS INTEGER) AS draft, CAST(count(*) FILTER (WHERE pre AND NOT draft) AS INTEGER) AS prerelease FROM r GROUP BY package_id""")
def release_pick(t: Tables):
    at = F.concat(F.date_format("opened_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    r = F.struct((-F.col("item_id")).alias("o"), F.struct(F.concat(F.lit("v"), F.col("item_id").cast("string")).alias("tag_name"), at.alias("published_at"), at.alias("created_at"), (F.col("state") == "open").alias("draft"), (F.col("state") == "resolved").alias("prerelease")).alias("r"))
    docs = t.items().groupBy("package_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(r)), lambda x: x["r"])).alias("body"))
    out = documents.releases(docs)
    return out.select("package_id", "latest_version", F.col("released_at").cast("timestamp_ntz").alias("released_at"), F.col("last_activity_at").cast("timestamp_ntz").alias("last_activity_at"), "releases_seen", "draft", "prerelease")


@query("build_pick", "WITH f AS (SELECT l_partkey AS package_id, CASE l_returnflag WHEN 'A' THEN 'linux-64' ELSE 'noarch' END AS platform, CASE WHEN l_linenumber > 1 THEN l_linenumber END AS n, 'b' || l_suppkey AS build FROM lineitem WHERE l_linestatus = 'F') SELECT p_partkey AS package_id, x.platform, CASE WHEN m.b IS NOT NULL THEN '1' END AS version, m.b.build AS build, nullif(m.b.n, -1) AS build_number FROM part CROSS JOIN (SELECT unnest(['linux-64', 'noarch']) AS platform) x LEFT JOIN (SELECT package_id, platform, max({'n': coalesce(n, -1), 'build': build}) AS b FROM f GROUP BY 1, 2) m ON m.package_id = p_partkey AND m.platform = x.platform")
def build_pick(t: Tables):
    file = F.struct(F.when(F.col("l_linestatus") == "F", "1").otherwise("0").alias("version"), F.struct(F.when(F.col("l_returnflag") == "A", "linux-64").otherwise("noarch").alias("subdir"), F.concat(F.lit("b"), F.col("l_suppkey").cast("string")).alias("build"), F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).alias("build_number")).alias("attrs"))
    found = t.lineitem.groupBy(F.col("l_partkey").alias("package_id")).agg(F.collect_list(file).alias("files"))
    docs = t.part.select(F.col("p_partkey").alias("package_id")).join(found, "package_id", "left").select("package_id", F.to_json(F.struct(F.lit("1").alias("latest_version"), "files")).alias("body"))
    return documents.channel_facts(docs, ["linux-64", "noarch"])


@query("index_readiness", "SELECT p_partkey AS package_id, CASE WHEN p_size > 14 THEN 'inferred_not_ready' WHEN p_partkey % 3 = 0 THEN 'inferred_ready' WHEN p_partkey % 3 = 1 THEN 'inferred_not_ready' ELSE 'inferred_ready' END AS readiness, CASE WHEN p_size > 14 THEN 'specifier' WHEN p_partkey % 3 < 2 THEN 'classifier' ELSE 'specifier' END AS deciding_signal, 'https://github.com/o/r' || p_partkey AS repository FROM part")
def index_readiness(t: Tables):
    i, n = F.col("p_partkey") % 3, F.col("p_partkey").cast("string")
    named = F.when(i == 0, F.array(F.lit("Programming Language :: Python :: 3.14"))).when(i == 1, F.array(F.lit("Programming Language :: Python :: 3.12"))).otherwise(F.array().cast("array<string>"))
    info = F.struct(F.lit("1").alias("version"), F.concat(F.lit(">=3."), F.col("p_size").cast("string")).alias("requires_python"), named.alias("classifiers"), F.create_map(F.lit("Source_Code"), F.concat(F.lit("https://github.com/O/R"), n), F.lit("Homepage"), F.lit("https://github.com/x/y")).alias("project_urls"))
    docs = t.part.select("p_partkey", "p_size").repartition("p_partkey").select(F.col("p_partkey").alias("package_id"), F.to_json(F.struct(info.alias("info"))).alias("body"))  # a narrow table has few row groups, its documents cost much
    return documents.index_facts(docs).select("package_id", "readiness", "deciding_signal", "repository")


@query("watchlist_rows", "SELECT 'k' || s_suppkey AS source_package_key, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_name END AS package_name, s_nationkey AS internal_component_count, CASE WHEN s_suppkey % 4 = 0 THEN 'package_name' WHEN s_suppkey % 4 = 1 THEN 'downloads' END AS fault FROM supplier")
def watchlist_rows(t: Tables):
    i = F.col("s_suppkey") % 4
    cells = {"source_package_key": F.concat(F.lit(" k"), F.col("s_suppkey").cast("string")), "package_name": F.when(i == 0, " ").otherwise(F.col("s_name")), "internal_component_count": F.col("s_nationkey").cast("string"), "internal_lob_count": F.lit("1"), "apps": F.lit(""), "platforms": F.lit(None).cast("string"), "downloads": F.when(i == 1, "12x").otherwise("7"), "versions": F.lit(" 3 ")}
    rows = t.supplier.select(*[c.alias(n) for n, c in cells.items()])
    return files.typed(rows).select("source_package_key", "package_name", "internal_component_count", "fault")


@query("stream_append_parity", "SELECT event_type, count(*) AS n, max(ts) AS newest FROM events GROUP BY 1")
def stream_append_parity(t: Tables):
    source = ingest.folder(t.spark, f"{t.folder}/event[s].parquet", "event_id long, ts timestamp_ntz, user_id long, event_type string")
    out = f"{scratch(t.spark)}/stream-{uuid.uuid4().hex}"
    ingest.append_new(source, f"{out}/rows", f"{out}/marks").awaitTermination()
    return t.spark.read.parquet(f"{out}/rows").groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("newest"))
