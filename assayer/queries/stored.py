"""Stored tables over the supplied ones: typed collection, late evidence, kept-up folds, snapshots, buckets, purges and recorded runs."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import functions as F

from assayer.adapters import CUTOFF, EV, EVC, FIND, ORACLE_SQL, PKG, Tables, query
from assayer.operators import asof, crossref, late, presence, retention
from assayer.operators.snapshots import Snapshots
from assayer.plans import passes, run
from assayer.queries.evidence import _FOLD, _INV, _surfaces, inventory
from assayer.queries.runs import _PARAMETERS, _tables
from assayer.sources import files
from assayer.sources.parts import Parts
from assayer.streaming import typed
from assayer.streaming.folders import scratch

_union = lambda tables: reduce(lambda a, b: a.unionByName(b), tables)


def _folder(t: Tables) -> str:
    return f"{scratch(t.spark)}/{uuid.uuid4().hex}"


# Typed collection

_BRONZE = """b AS (SELECT event_id AS id, ts AS observed_at, ['source_release', 'pypi_release', 'license'][1 + event_id % 3] AS collector, user_id AS package_id, event_id % 11 <> 0 AS applicable, event_id % 13 = 0 AS refused,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE CASE event_type WHEN 'click' THEN 404 WHEN 'error' THEN 500 WHEN 'signup' THEN 304 ELSE 200 END END AS code, event_id % 7 = 0 AS torn, event_id % 5 = 0 AS bare, (event_id // 100) % 2 AS half FROM events),
s AS (SELECT *, CASE WHEN NOT applicable THEN 'not_applicable' WHEN refused OR code IS NULL THEN 'error' WHEN code = 404 THEN 'not_found' WHEN code = 304 THEN 'unmodified' WHEN code = 500 THEN 'error' ELSE 'ok' END AS first FROM b),
k AS (SELECT s.id AS asked, arg_max({'id': p.id, 'torn': p.torn, 'bare': p.bare}, (p.observed_at, p.id)) AS kept FROM s JOIN s p ON p.collector = s.collector AND p.package_id = s.package_id AND p.first = 'ok' AND p.half <= s.half WHERE s.first = 'unmodified' GROUP BY 1),
r AS (SELECT s.id, s.collector, s.package_id, s.first, CASE WHEN s.first = 'unmodified' THEN kept.id ELSE s.id END AS own, CASE WHEN s.first = 'unmodified' THEN kept.torn ELSE s.torn END AS torn, CASE WHEN s.first = 'unmodified' THEN kept.bare ELSE s.bare END AS bare, code,
  CASE WHEN s.first IN ('ok', 'unmodified') AND NOT (s.first = 'unmodified' AND kept IS NULL) THEN true ELSE false END AS good FROM s LEFT JOIN k ON k.asked = s.id)"""


@query("typed_evidence", f"""WITH {_BRONZE}
SELECT collector AS source, id, package_id, CASE WHEN NOT good THEN CASE first WHEN 'unmodified' THEN 'error' ELSE first END WHEN torn THEN 'error' WHEN NOT bare THEN CASE collector WHEN 'license' THEN 'normalized' ELSE 'ok' END WHEN collector = 'source_release' THEN 'not_found' WHEN collector = 'license' THEN 'unknown' ELSE 'error' END AS state,
  CASE WHEN first = 'unmodified' AND NOT good THEN 'unmodified, and nothing was kept' WHEN good AND (torn OR bare AND collector = 'pypi_release') THEN 'the document could not be read' WHEN first = 'error' THEN 'status ' || coalesce(CAST(code AS VARCHAR), 'none') ELSE '' END AS detail,
  CASE WHEN good AND NOT torn AND NOT bare THEN CASE collector WHEN 'license' THEN 'MIT' ELSE 'v' || own END END AS fact FROM r""")
def typed_evidence(t: Tables):
    """Documents of three collectors, streamed in two parts into three tables; the first batch is taken twice."""
    e, n = F.col("event_id"), F.col("event_id").cast("string")
    kind = F.col("event_type")
    bare, torn = e % 5 == 0, e % 7 == 0
    release = F.when(bare, F.lit("[]")).otherwise(F.concat(F.lit('[{"tag_name": "v'), n, F.lit('", "published_at": "2024-01-01T00:00:00Z"}]')))
    index = F.when(bare, F.lit("{}")).otherwise(F.concat(F.lit('{"info": {"version": "v'), n, F.lit('"}}')))
    licence = F.when(bare, F.lit("{}")).otherwise(F.lit('{"license": "mit license"}'))
    body = F.when(torn, F.lit("{[")).when(e % 3 == 0, release).when(e % 3 == 1, index).otherwise(licence)
    rows = t.events.select("event_id", "ts", "user_id", "event_type").repartition("event_id")  # a narrow table has few row groups, its documents cost much
    bronze = rows.select(
        e.alias("id"), F.col("ts").alias("observed_at"), F.element_at(F.array(*[F.lit(c) for c in ("source_release", "pypi_release", "license")]), (e % 3 + 1).cast("int")).alias("collector"), F.col("user_id").alias("package_id"),
        (e % 11 != 0).alias("applicable"), (e % 13 == 0).alias("refused"), F.when(e % 17 != 0, F.when(kind == "click", 404).when(kind == "error", 500).when(kind == "signup", 304).otherwise(200)).alias("status_code"), body.alias("body"), (F.floor(e / 100) % 2).alias("half"),
    )
    folder = _folder(t)
    for half in (0, 1):
        bronze.where(F.col("half") == half).drop("half").write.mode("append").parquet(f"{folder}/bronze")
        stream = t.spark.readStream.schema(typed.BRONZE).parquet(f"{folder}/bronze")
        typed.collect(stream, f"{folder}/evidence", f"{folder}/marks").awaitTermination()
        if not half:  # as after a failure between a batch's work and its commit
            typed.batch(t.spark.read.schema(typed.BRONZE).parquet(f"{folder}/bronze"), 0, f"{folder}/evidence")
    fact = {"source_release": "latest_version", "pypi_release": "latest_version", "license": "normalized_license"}
    return _union([typed.table(t.spark, f"{folder}/evidence", typed.COLLECTORS[c][0]).select("source", "id", "package_id", "state", "detail", F.col(fact[c]).alias("fact")) for c in fact])


# Late evidence

_LATE = f"""WITH {EV}, l AS (SELECT *, observed_at + INTERVAL 1 HOUR * CAST(CASE WHEN id % 7 = 0 THEN id % 90 ELSE 0 END AS INTEGER) AS arrived_at, lead(observed_at) OVER (PARTITION BY package_id, surface ORDER BY observed_at, id) AS nxt FROM ev),
runs AS (SELECT DISTINCT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS run_id, date_trunc('day', ts) + INTERVAL 20 HOUR AS cutoff, date_trunc('day', ts) + INTERVAL 21 HOUR AS started_at FROM events),
m AS (SELECT run_id, package_id, surface, id, nxt IS NULL OR cutoff < nxt AS changes FROM l JOIN runs ON observed_at <= cutoff AND arrived_at > started_at)"""


def _late(t: Tables):
    rows = t.evidence().withColumn("arrived_at", F.col("observed_at") + F.expr("INTERVAL 1 HOUR") * F.when(F.col("id") % 7 == 0, F.col("id") % 90).otherwise(0).cast("int"))
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    runs = t.events.select(F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("long").alias("run_id"), (day + F.expr("INTERVAL 20 HOURS")).alias("evidence_cutoff"), (day + F.expr("INTERVAL 21 HOURS")).alias("started_at")).distinct()
    return late.missed(rows, runs, ["package_id", "surface"])


@query("late_evidence", _LATE + " SELECT * FROM m")
def late_evidence(t: Tables):
    return _late(t)


@query("late_runs", _LATE + " SELECT run_id, count(*) AS late_rows, count(*) FILTER (WHERE changes) AS changed_keys FROM m GROUP BY run_id")
def late_runs(t: Tables):
    return late.affected(_late(t))


# Kept-up folds


@query("presence_kept_up", f"WITH {EVC}, {_INV}, {_FOLD} SELECT * FROM fold")
def presence_kept_up(t: Tables):
    """The presence fold from a stored summary that took the log in three parts, out of order, and one of them twice."""
    rows = asof.upto(inventory(t), t.cutoff).select("package_id", "id", "observed_at", "state")
    parts = Parts(t.spark, _folder(t), "slot", "package_id bigint, id bigint, observed_at timestamp_ntz, state string, slot int")
    for i in (2, 0, 2, 1):
        presence.merged(parts, rows.where(F.pmod(F.xxhash64("id"), F.lit(3)) == i), slots=4)
    return presence.presence(parts.read(), t.cutoff)


# Snapshots and buckets


def snapshots(t: Tables) -> Snapshots:
    """The event log by day with stored newest rows at three cut-offs; a tenth of the log came late."""
    rows = t.evidence().select("package_id", "id", "observed_at", "state")
    kept = Snapshots(t.spark, _folder(t), "package_id bigint, id bigint, observed_at timestamp_ntz, state string", ["package_id"])
    kept.append(rows.where(F.col("id") % 10 != 0))
    kept.take(datetime(2024, 1, 5))
    kept.take(datetime(2024, 1, 12))
    kept.append(rows.where(F.col("id") % 10 == 0))
    kept.take(datetime(2024, 1, 4))
    kept.take(datetime(2024, 1, 15))
    return kept


@query("asof_snapshot", ORACLE_SQL["asof_latest"])
def asof_snapshot(t: Tables):
    return snapshots(t).latest(datetime.fromisoformat(CUTOFF)).select("package_id", "id", "observed_at", "state")


def bucketed_currency(t: Tables, buckets: int = 8):
    """The currency pass over packages and evidence in buckets by package."""
    name = uuid.uuid4().hex
    packages = files.bucketed(t.packages(), f"packages_{name}", ["package_id"], buckets)
    evidence = files.bucketed(_surfaces(t).select("package_id", "surface", "id", "observed_at", "state", "version"), f"surfaces_{name}", ["package_id"], buckets, ["observed_at"])
    return passes.currency(packages, evidence, t.cutoff)


@query("currency_bucketed", ORACLE_SQL["currency_pass"])
def currency_bucketed(t: Tables):
    return bucketed_currency(t).drop("error", *[f"{s}_snapshot_id" for s in ("source", "pypi", "feedstock", "conda_package")])


# Purges

_PURGE = f"""WITH {FIND.replace("find AS", "every AS")}, find AS (SELECT id, m.observed_at, m.package_id FROM (SELECT id, min({{'observed_at': observed_at, 'package_id': package_id}}) AS m FROM every GROUP BY id)), r AS (SELECT DISTINCT CAST(year(o_orderdate) * 10 + quarter(o_orderdate) AS BIGINT) AS run_id, date_trunc('quarter', o_orderdate) + INTERVAL 41 HOUR AS c FROM orders),
stay AS (SELECT * FROM r WHERE c + INTERVAL 1 HOUR >= TIMESTAMP '1999-01-01' OR run_id = 19962), e AS (SELECT user_id AS package_id, event_id AS id, ts - INTERVAL 10000 DAY AS observed_at FROM events),
d AS (SELECT CAST(year(o_orderdate) * 10 + quarter(o_orderdate) AS BIGINT) AS run_id, o_orderkey FROM orders), held AS (SELECT o_orderkey FROM d JOIN stay USING (run_id)),
fi AS (SELECT package_id, t, lead(t) OVER (PARTITION BY package_id ORDER BY t) AS nxt FROM (SELECT DISTINCT package_id, observed_at AS t FROM find)), ei AS (SELECT package_id, t, lead(t) OVER (PARTITION BY package_id ORDER BY t) AS nxt FROM (SELECT DISTINCT package_id, observed_at AS t FROM e)),
ff AS (SELECT package_id, t FROM fi WHERE nxt IS NOT NULL AND t < TIMESTAMP '1999-01-01' AND NOT EXISTS (SELECT 1 FROM stay WHERE c >= t AND c < nxt)), ef AS (SELECT package_id, t FROM ei WHERE nxt IS NOT NULL AND t < TIMESTAMP '1999-01-01' AND NOT EXISTS (SELECT 1 FROM stay WHERE c >= t AND c < nxt)),
fs AS (SELECT * FROM find WHERE NOT ((package_id, observed_at) IN (SELECT (package_id, t) FROM ff) AND id NOT IN (SELECT o_orderkey * 10 + 1 FROM held))), es AS (SELECT * FROM e WHERE NOT ((package_id, observed_at) IN (SELECT (package_id, t) FROM ef) AND id NOT IN (SELECT o_orderkey FROM held)))
SELECT 'derived' AS "table", CAST(run_id AS VARCHAR) AS part, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS ids FROM d WHERE run_id IN (SELECT run_id FROM stay) GROUP BY ALL
UNION ALL SELECT 'runs', 'all', count(*), CAST(sum(run_id) AS BIGINT) FROM stay
UNION ALL SELECT 'findings', strftime(observed_at, '%Y-%m'), count(*), CAST(sum(id) AS BIGINT) FROM fs GROUP BY ALL UNION ALL SELECT 'events', strftime(observed_at, '%Y-%m-%d'), count(*), CAST(sum(id) AS BIGINT) FROM es GROUP BY ALL"""


@query("purge_rewritten", _PURGE)
def purge_rewritten(t: Tables):
    """A purge planned and applied to four stored tables: events and findings, and the derived rows and runs that keep some of them."""
    day = F.col("o_orderdate")
    run_id = (F.year(day) * 10 + F.quarter(day)).cast("long").alias("run_id")
    cut = F.date_trunc("quarter", day).cast("timestamp_ntz") + F.expr("INTERVAL 41 HOURS")
    runs = t.orders.select(run_id, cut.alias("started_at"), (cut + F.expr("INTERVAL 1 HOUR")).alias("finished_at"), cut.alias("evidence_cutoff")).distinct()
    derived = t.orders.select(F.col("o_orderkey").alias("id"), run_id)
    found = t.findings().groupBy("id").agg(F.min(F.struct("observed_at", "package_id")).alias("m")).select("m.package_id", "id", "m.observed_at", F.date_format("m.observed_at", "yyyy-MM").alias("month"))  # an id names one row
    seen = t.evidence().select("package_id", "id", (F.col("observed_at") - F.expr("INTERVAL 10000 DAYS")).alias("observed_at"))
    seen = seen.withColumn("day", F.date_format("observed_at", "yyyy-MM-dd"))
    source = {"derived": (derived, "run_id"), "runs": (runs.withColumnRenamed("run_id", "id").withColumn("kind", F.lit("all")), "kind"), "events": (seen, "day"), "findings": (found, "month")}
    stored = {}
    for name, (rows, column) in source.items():
        stored[name] = Parts(t.spark, f"{_folder(t)}/{name}", column, rows.schema)
        stored[name].append(rows)
    cutoff = F.lit("1999-01-01").cast("timestamp_ntz")
    shown = t.spark.createDataFrame([(19962,)], "policy_run_id long")
    held = stored["derived"].read()
    citing = {"events": [held.select("run_id", F.col("id").alias("cited_id"))], "findings": [held.select("run_id", (F.col("id") * 10 + 1).alias("cited_id"))]}
    known = stored["runs"].read().withColumnRenamed("id", "run_id")
    ledger = t.spark.createDataFrame([], "finished_at timestamp_ntz, started_at timestamp_ntz")
    planned = retention.plan({n: stored[n].read() for n in ("events", "findings")}, {"events": ["package_id"], "findings": ["package_id"]}, citing, known, shown, ledger, cutoff)
    gone = planned["runs"].withColumnRenamed("run_id", "id").withColumn("kind", F.lit("all"))
    steps = {"derived": held.join(planned["runs"].select("run_id"), "run_id", "left_semi"), "runs": gone, "events": planned["events"], "findings": planned["findings"]}
    steps = {n: _kept(t, rows.select("id", stored[n].column)) for n, rows in steps.items()}
    retention.purged(steps, stored, ["derived", "runs", "events", "findings"])
    return _union([stored[n].read().groupBy(F.col(c).cast("string").alias("part")).agg(F.count("*").alias("n"), F.sum("id").alias("ids")).select(F.lit(n).alias("table"), "part", "n", "ids") for n, (_, c) in source.items()])


def _kept(t: Tables, rows):
    """The same rows, written: what a purge takes out is settled before it changes what the plan reads."""
    path = _folder(t)
    rows.write.parquet(path)
    return t.spark.read.schema(rows.schema).parquet(path)


# Cross-references

_ASKED = """f AS (SELECT l_partkey AS package_id, l_orderkey * 10 + l_linenumber AS id, l_shipdate AS observed_at, CASE l_returnflag WHEN 'N' THEN 'unknown' ELSE 'matched' END AS state,
  CASE WHEN l_orderkey % 997 = 0 THEN ' ' WHEN l_linenumber % 2 = 0 THEN ' cve-' || (l_orderkey % 9) ELSE 'CVE-' || (l_orderkey % 9) END AS advisory FROM lineitem),
m AS (SELECT *, lower(trim(advisory)) AS name, row_number() OVER (PARTITION BY package_id, lower(trim(advisory)) ORDER BY observed_at DESC, id DESC) AS rn FROM f WHERE state = 'matched' AND observed_at >= TIMESTAMP '1999-01-01' - INTERVAL 900 DAY),
c AS (SELECT package_id, count(*) FILTER (WHERE state = 'matched' AND observed_at < TIMESTAMP '1999-01-01' - INTERVAL 900 DAY) AS excluded, count(*) FILTER (WHERE state = 'matched') > 0 AS matched, count(*) FILTER (WHERE state = 'matched' AND observed_at >= TIMESTAMP '1999-01-01' - INTERVAL 900 DAY AND trim(advisory) = '') > 0 AS nameless FROM f GROUP BY 1),
v AS (SELECT c.package_id, coalesce(n, 0) AS advisories, excluded, true AS observed, matched, CASE WHEN nameless THEN 'a finding names no advisory' WHEN coalesce(n, 0) > 7 THEN 'more than 7 advisories' END AS refused FROM c LEFT JOIN (SELECT package_id, count(*) AS n FROM m WHERE rn = 1 GROUP BY 1) x USING (package_id))"""


def _advised(t: Tables):
    k, n = F.col("l_orderkey"), (F.col("l_orderkey") % 9).cast("string")
    name = F.when(k % 997 == 0, " ").when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" cve-"), n)).otherwise(F.concat(F.lit("CVE-"), n))
    return t.lineitem.select(F.col("l_partkey").alias("package_id"), (k * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("observed_at"), F.when(F.col("l_returnflag") == "N", "unknown").otherwise("matched").alias("state"), name.alias("advisory_id"))


@query("kev_evidence", f"WITH {_ASKED} SELECT * FROM v")
def kev_evidence(t: Tables):
    return crossref.evidence(_advised(t), F.lit("1999-01-01").cast("timestamp_ntz"), "900 DAYS", 7)


@query("kev_current", f"WITH {_ASKED} SELECT m.package_id, id AS finding_id, trim(advisory) AS advisory_id, CASE WHEN name IN ('cve-1', 'cve-2') THEN 'listed' ELSE 'not_listed' END AS answer, CASE WHEN excluded > 0 THEN excluded || ' older than 900 days were left out' ELSE '' END AS detail FROM m JOIN v USING (package_id) WHERE rn = 1 AND refused IS NULL")
def kev_current(t: Tables):
    entries = t.region.where("r_regionkey IN (1, 2)").select(F.concat(F.lit("Cve-"), F.col("r_regionkey").cast("string")).alias("advisory_id"), F.lit(None).cast("timestamp").alias("date_added"))
    out = crossref.answers(_advised(t), entries, F.lit("1999-01-01").cast("timestamp_ntz"), "900 DAYS", 7)
    return out.select("package_id", "finding_id", "advisory_id", "answer", "detail")


# Recorded runs


@query("runs_recorded", f"""WITH {EVC}, {PKG}, c AS (SELECT max(observed_at) AS cutoff FROM evc), n AS (SELECT count(*) AS packages FROM pkg)
SELECT CAST(i AS BIGINT) AS run_id, v AS policy_version, cutoff AS evidence_cutoff, s AS status, CASE WHEN s = 'succeeded' THEN packages END AS packages, CASE WHEN s = 'succeeded' THEN 0 END AS failed, CASE WHEN s = 'succeeded' THEN 0 END AS differs
FROM (VALUES (1, '2024.10', 'succeeded'), (2, '2024.2', 'failed')) x(i, v, s), c, n""")
def runs_recorded(t: Tables):
    """Two runs over events, the second of which breaks off; and a replay of the first."""
    tables = _tables(t)
    tables["ledger"] = asof.upto(t.evidence(), t.cutoff).select(F.col("observed_at").alias("started_at"), F.col("observed_at").alias("finished_at"), F.lit("c").alias("collector"))
    parameters = {"2024.10": _PARAMETERS, "2024.2": {**_PARAMETERS, "priority_score_weights": {"odd": 1}}}
    ticks = iter(datetime(2024, 2, 1) + timedelta(hours=i) for i in range(9))
    held = run.Recorded(t.spark, _folder(t))
    first = held.run(tables, parameters, lambda: next(ticks))
    try:
        held.run(tables, parameters, lambda: next(ticks), "2024.2")
    except ValueError:
        pass  # recorded as failed
    again = held.replay(tables, parameters, first)
    differs = sum(rows.count() for rows in again.values())  # a job for each pass: one plan of all is the largest that the driver would hold
    return held.runs().withColumn("differs", F.when(F.col("run_id") == first, F.lit(differs).cast("long"))).select("run_id", "policy_version", "evidence_cutoff", "status", "packages", "failed", "differs")
