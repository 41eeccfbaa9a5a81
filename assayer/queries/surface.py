"""Listings, queues, reports, coverage, workflow over the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.adapters import CUTOFF, EV, EVC, FIND, ITEM, PKG, Tables, query
from assayer.functions import vocab
from assayer.operators import asof, digest, presence, surface, workflow
from assayer.queries.evidence import _FOLD, _INV, LATEST, inventory

_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_HEALTH = f"""health AS (SELECT pkg.package_id, canonical_name, confidence, CAST(pkg.package_id % 3 AS BIGINT) AS policy_run_id, 'p' || (pkg.package_id % 11) AS bucket, CASE WHEN pkg.package_id % 5 <> 0 THEN pkg.package_id % 97 END AS score FROM pkg),
derived AS (SELECT o_custkey AS package_id, CAST(o_orderkey % 3 AS BIGINT) AS policy_run_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'forbidden' WHEN '2-HIGH' THEN 'restricted' ELSE 'allowed' END AS license_outcome FROM orders)"""


def _health(t: Tables):
    p = F.col("package_id")
    return t.packages().select("package_id", "canonical_name", "confidence", (p % 3).alias("policy_run_id"), F.concat(F.lit("p"), (p % 11).cast("string")).alias("bucket"), F.when(p % 5 != 0, p % 97).alias("score"))


def _derived(t: Tables):
    o = F.col("o_orderpriority")
    return t.orders.select(F.col("o_custkey").alias("package_id"), (F.col("o_orderkey") % 3).alias("policy_run_id"), F.when(o == "1-URGENT", "forbidden").when(o == "2-HIGH", "restricted").otherwise("allowed").alias("license_outcome"))


def _facets(t: Tables):
    return {"confidence": (None, "confidence", vocab.CONFIDENCES), "license": (_derived(t), "license_outcome", vocab.LICENCE)}


@query("listing_faceted", f"WITH {PKG}, {_HEALTH} SELECT package_id, canonical_name, confidence FROM health h WHERE confidence IN ('verified', 'unmapped') AND EXISTS (SELECT 1 FROM derived d WHERE d.package_id = h.package_id AND d.policy_run_id = h.policy_run_id AND license_outcome IN ('forbidden', 'restricted'))")
def listing_faceted(t: Tables):
    chosen = {"confidence": ["verified", "", "unmapped"], "license": ["forbidden", "restricted"], "other": ["x"]}
    return surface.faceted(_health(t), _facets(t), chosen).select("package_id", "canonical_name", "confidence")


@query("listing_search", f"WITH {PKG} SELECT package_id, canonical_name FROM pkg WHERE contains(lower(canonical_name), 'r#00000001')")
def listing_search(t: Tables):
    return surface.named(t.packages(), "  R#00000001 ").select("package_id", "canonical_name")


_RANK = "ORDER BY CASE WHEN bucket IN ('p1','p2','p3','p4','p5','p6','p7','p8','p9','p10') THEN CAST(substr(bucket, 2) AS INTEGER) ELSE 11 END, score DESC NULLS FIRST, package_id"


@query("listing_ranked_topk", f"WITH {PKG}, {_HEALTH} SELECT package_id, bucket, score FROM health {_RANK} LIMIT 50")
def listing_ranked_topk(t: Tables):
    return surface.page(surface.ranked(_health(t))).select("package_id", "bucket", "score")


@query("listing_page2", f"WITH {PKG}, {_HEALTH} SELECT package_id, bucket, score FROM health {_RANK} LIMIT 50 OFFSET 50")
def listing_page2(t: Tables):
    return surface.page(surface.ranked(_health(t)), 2).select("package_id", "bucket", "score")


@query("health_labels", f"WITH {EV}, s AS (SELECT DISTINCT state FROM ev) SELECT state, CASE state WHEN 'ok' THEN 'OK' ELSE upper(state[1]) || replace(state[2:], '_', ' ') END AS label, CASE state WHEN 'ok' THEN 'tone-ok' WHEN 'unknown' THEN 'tone-unknown' WHEN 'not_found' THEN 'tone-notfound' WHEN 'not_applicable' THEN 'tone-na' ELSE 'tone-error' END AS tone FROM s")
def health_labels(t: Tables):
    return t.evidence().select("state").distinct().select("state", vocab.label(F.col("state")).alias("label"), vocab.tone(F.col("state")).alias("tone"))


@query("feedstock_gap_counts", f"WITH {EVC}, {PKG}, {_INV}, {_FOLD} SELECT count(*) FILTER (WHERE absent_since IS NOT NULL) AS left_out, count(*) FILTER (WHERE absent_since IS NULL) AS listed FROM pkg JOIN fold USING (package_id)")
def feedstock_gap_counts(t: Tables):
    rows = t.packages().join(presence.presence(inventory(t), t.cutoff), "package_id")
    return rows.agg(F.count("absent_since").alias("left_out"), F.count_if(F.col("absent_since").isNull()).alias("listed"))


_QUEUES = """q AS (SELECT item_id, 'f' || item_id AS finding_key, package_id, ['identity_review', 'remediation', 'compliance_review'][item_id % 3 + 1] AS queue, state FROM item),
h AS (SELECT package_id, 'p' || (package_id % 12) AS bucket FROM pkg WHERE package_id % 9 <> 0),
n AS (SELECT package_id, score FROM (SELECT package_id, CASE WHEN item_id % 4 <> 0 THEN item_id % 100 END AS score, row_number() OVER (PARTITION BY package_id ORDER BY item_id DESC) AS rn FROM item) WHERE rn = 1),
w AS (SELECT finding_key, q.package_id, q.queue, q.state, h.bucket, n.score, CASE WHEN h.bucket IN ('p1', 'p2', 'p3', 'p4', 'p5', 'p6', 'p7', 'p8', 'p9', 'p10') THEN CAST(substr(h.bucket, 2) AS INTEGER) ELSE 11 END AS r FROM q LEFT JOIN h USING (package_id) LEFT JOIN n USING (package_id) WHERE q.state NOT IN ('resolved', 'accepted'))"""


def _queued(t: Tables):
    i, p = F.col("item_id"), F.col("package_id")
    items = t.items().select(F.concat(F.lit("f"), i.cast("string")).alias("finding_key"), "package_id", F.element_at(vocab.strings(("identity_review", "remediation", "compliance_review")), (i % 3 + 1).cast("int")).alias("queue"), "state")
    health = t.packages().where(p % 9 != 0).select("package_id", F.concat(F.lit("p"), (p % 12).cast("string")).alias("priority_status"))
    scores = t.items().select("package_id", i.alias("policy_run_id"), F.when(i % 4 != 0, i % 100).alias("score"))
    return items, health, scores


@query("queue_listing", f"WITH {ITEM}, {PKG}, {_QUEUES} SELECT finding_key, package_id, state, bucket, score, row_number() OVER (ORDER BY r, score DESC NULLS FIRST, finding_key) AS place FROM w WHERE queue = 'remediation'")
def queue_listing(t: Tables):
    rows = workflow.queue(*_queued(t), "remediation")
    place = F.row_number().over(W.orderBy(vocab.bucket_order(F.col("bucket")), F.desc_nulls_first("score"), "finding_key"))  # the order, as a column to compare
    return rows.withColumn("place", place.cast("long")).select("finding_key", "package_id", "state", "bucket", "score", "place")


@query("queue_listing_all", f"WITH {ITEM}, {PKG}, {_QUEUES} SELECT finding_key, package_id, queue, state, bucket, score FROM w")
def queue_listing_all(t: Tables):
    return workflow.queue(*_queued(t)).select("finding_key", "package_id", "queue", "state", "bucket", "score")


@query("report_distinct", f"WITH {PKG}, {_HEALTH} SELECT DISTINCT health.package_id, canonical_name, license_outcome FROM health JOIN derived USING (package_id) WHERE license_outcome IN ('forbidden', 'restricted')")
def report_distinct(t: Tables):
    return surface.report(_health(t), _derived(t), F.col("license_outcome").isin("forbidden", "restricted"), ["package_id", "canonical_name", "license_outcome"])


@query("report_current_run", f"WITH {PKG}, {_HEALTH} SELECT DISTINCT package_id, canonical_name, license_outcome FROM health JOIN derived USING (package_id, policy_run_id) WHERE license_outcome = 'forbidden'")
def report_current_run(t: Tables):
    return surface.report(_health(t), _derived(t), F.col("license_outcome") == "forbidden", ["package_id", "canonical_name", "license_outcome"], current_run_only=True)


@query("report_excluded_count", f"WITH {PKG}, {_HEALTH} SELECT count(DISTINCT package_id) AS excluded FROM health WHERE NOT coalesce(score > 50, false)")
def report_excluded_count(t: Tables):
    return _health(t).where(surface.excluded(F.col("score") > 50)).agg(F.countDistinct("package_id").alias("excluded"))


@query("report_versions", f"WITH {PKG}, p AS (SELECT DISTINCT unnest(['currency@' || (package_id % 3), 'licence@' || (package_id % 2)]) AS p FROM pkg) SELECT string_agg(p, ', ' ORDER BY p) AS versions FROM p")
def report_versions(t: Tables):
    p = F.col("package_id")
    rows = t.packages().withColumn("policy_versions", F.create_map(F.lit("currency"), (p % 3).cast("string"), F.lit("licence"), (p % 2).cast("string")))
    return surface.versions(rows)


@query("coverage_counts", f"""WITH {EVC}, l AS ({LATEST.format(keys='package_id', ties='', rows='evc')}), {PKG}, h AS (SELECT coalesce(state, 'unknown') AS status, observed_at AS computed_at, observed_at - INTERVAL 1 HOUR AS evidence_cutoff FROM pkg LEFT JOIN l USING (package_id))
SELECT count(*) AS packages, count(*) FILTER (WHERE status IN ('unknown', 'error')) AS status_unknown, count(*) FILTER (WHERE status IN ('not_found', 'not_applicable')) AS status_negative, round(100.0 * count(*) FILTER (WHERE status IN ('unknown', 'error')) / count(*), 1) AS status_share, max(computed_at) AS computed_at, max(evidence_cutoff) AS evidence_cutoff FROM h""")
def coverage_counts(t: Tables):
    newest = asof.latest(t.evidence(), ["package_id"], t.cutoff).select("package_id", F.col("state").alias("status"), F.col("observed_at").alias("computed_at"), (F.col("observed_at") - F.expr("INTERVAL 1 HOUR")).alias("evidence_cutoff"))
    rows = t.packages().select("package_id").join(newest, "package_id", "left").withColumn("status", F.coalesce("status", F.lit("unknown")))
    return surface.coverage(rows, ["status"], ["computed_at", "evidence_cutoff"])


@query("coverage_confidence", f"WITH {PKG} SELECT confidence, count(*) AS packages FROM pkg GROUP BY confidence")
def coverage_confidence(t: Tables):
    return t.packages().groupBy("confidence").agg(F.count("*").alias("packages"))


_NAMES = ("c0", "c1", "c2", "c3", "never")
_LEDGER = "ledger AS (SELECT id, package_id, 'c' || surface AS collector, observed_at AS started_at, CASE WHEN state <> 'unknown' THEN observed_at END AS finished_at, CASE state WHEN 'ok' THEN 'succeeded' WHEN 'error' THEN 'failed' WHEN 'not_found' THEN 'partial' WHEN 'unknown' THEN 'running' ELSE 'skipped' END AS status, CASE WHEN id % 3 = 0 THEN 'hit the rate limit' ELSE 'other' END AS detail FROM ev)"


def ledger(t: Tables):
    s = F.col("state")
    status = F.when(s == "ok", "succeeded").when(s == "error", "failed").when(s == "not_found", "partial").when(s == "unknown", "running").otherwise("skipped")
    return t.evidence().select("id", "package_id", F.concat(F.lit("c"), F.col("surface").cast("string")).alias("collector"), F.col("observed_at").alias("started_at"), F.when(s != "unknown", F.col("observed_at")).alias("finished_at"), status.alias("status"), F.when(F.col("id") % 3 == 0, "hit the rate limit").otherwise("other").alias("detail"))


@query("collector_health", f"""WITH {EV}, {_LEDGER}, g AS (SELECT collector, count(*) AS runs, count(*) FILTER (WHERE status = 'failed') AS failed, max(finished_at) AS newest FROM ledger GROUP BY 1)
SELECT n.collector, coalesce(runs, 0) AS runs, coalesce(failed, 0) AS failed, newest, CASE WHEN runs IS NULL THEN 'never_run' WHEN failed > 0 THEN 'failing' ELSE 'ok' END AS status FROM (SELECT unnest(['c0', 'c1', 'c2', 'c3', 'never']) AS collector) n LEFT JOIN g USING (collector)""")
def collector_health(t: Tables):
    return surface.collector_health(ledger(t), list(_NAMES))


@query("runs_in_flight", f"WITH {EV}, {_LEDGER} SELECT id, collector, package_id FROM ledger WHERE finished_at IS NULL AND started_at >= TIMESTAMP '{CUTOFF}' - INTERVAL 6 HOUR")
def runs_in_flight(t: Tables):
    return ledger(t).where(F.col("finished_at").isNull() & (F.col("started_at") >= t.cutoff - F.expr("INTERVAL 6 HOURS"))).select("id", "collector", "package_id")


@query("detail_last_n", f"WITH {EVC} SELECT package_id, id, state, CAST(rn AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY observed_at DESC, id DESC) AS rn FROM evc) WHERE rn <= 20")
def detail_last_n(t: Tables):
    return asof.last(t.evidence(), ["package_id"], t.cutoff, 20).select("package_id", "id", "state", "place")


@query("detail_cited", f"WITH {EVC}, h AS (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY observed_at DESC, id DESC) AS rn, row_number() OVER (PARTITION BY package_id ORDER BY CASE WHEN state = 'ok' THEN 0 ELSE 1 END, observed_at DESC, id DESC) AS c FROM evc) SELECT package_id, id, c = 1 AS cited FROM h WHERE rn <= 20")
def detail_cited(t: Tables):
    first = F.row_number().over(W.partitionBy("package_id").orderBy(asof.determinate(), F.desc("observed_at"), F.desc("id")))
    cited = asof.upto(t.evidence(), t.cutoff).withColumn("c", first).where(F.col("c") == 1).select("package_id", "id")
    return surface.traced(asof.last(t.evidence(), ["package_id"], t.cutoff, 20).select("package_id", "id"), cited)


@query("transition_history", "WITH m AS (SELECT conv_id AS item_id, conv_id % 40 AS package_id, turn, role AS author, row_number() OVER (PARTITION BY conv_id % 40 ORDER BY turn DESC, conv_id * 1000 + turn DESC) AS place FROM conversations), n AS (SELECT conv_id % 40 AS package_id, 3 * count(DISTINCT conv_id) AS most FROM conversations GROUP BY 1) SELECT package_id, item_id, turn, author FROM m JOIN n USING (package_id) WHERE place <= most")
def transition_history(t: Tables):
    moves = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("item_id"), F.col("turn").alias("occurred_at"), F.col("role").alias("author"))
    items = t.conversations.select(F.col("conv_id").alias("item_id"), (F.col("conv_id") % 40).alias("package_id")).distinct()
    return surface.work_history(moves, items, 3).select("package_id", "item_id", F.col("occurred_at").alias("turn"), "author")


@query("finding_keys", f"WITH {FIND} SELECT package_id, id, 'find:' || package_id || ':' || substr(sha256('7:verdict=' || length(verdict) || ':' || verdict || '2:id=' || length(CAST(id AS VARCHAR)) || ':' || id), 1, 16) AS finding_key FROM find")
def finding_keys(t: Tables):
    from assayer.functions.text import finding_key

    return t.findings().select("package_id", "id", finding_key("find", F.col("package_id"), [("verdict", F.col("verdict")), ("id", F.col("id").cast("string"))]).alias("finding_key"))


def _fact(name: str, value: str) -> str:
    return f"'{len(name)}:{name}=' || length({value}) || ':' || {value}"


_ISO = "strftime(listed_since, '%Y-%m-%dT%H:%M:%S') || CASE WHEN date_part('microsecond', listed_since) % 1000000 = 0 THEN '' ELSE '.' || strftime(listed_since, '%f') END || '+00:00'"
#: SQL of the items of v: package_id, confidence, listed_since, and finding ids fid and lid with their facts, null where there is nothing to do.
ITEMS_OF_V = f"""k AS (SELECT package_id, 'identity_review' AS queue, 'packages' AS tb, {_fact('confidence', 'confidence')} AS facts, listed_since FROM v WHERE confidence = 'unmapped'
 UNION ALL SELECT package_id, 'remediation', 'vulnerability_findings', {_fact('advisory_id', 'advisory_id')} || {_fact('affected_range', 'affected_range')}, listed_since FROM v WHERE confidence <> 'unmapped' AND fid IS NOT NULL
 UNION ALL SELECT package_id, 'compliance_review', 'license_findings', {_fact('normalized_license', 'normalized_license')} || {_fact('channel', 'channel')}, listed_since FROM v WHERE confidence <> 'unmapped' AND lid IS NOT NULL),
e AS (SELECT *, {_ISO} AS iso FROM k),
opened AS (SELECT DISTINCT tb || ':' || package_id || ':' || substr(sha256(facts || coalesce({_fact('listed_since', 'iso')}, '')), 1, 16) AS finding_key, package_id, queue FROM e)"""


@query("open_items", f"""WITH {EVC}, {PKG}, {_INV}, {_FOLD}, v AS (SELECT pkg.package_id, confidence, listed_since, CASE WHEN pkg.package_id % 3 = 0 AND pkg.package_id % 6 <> 0 THEN pkg.package_id END AS fid, 'ADV-' || (pkg.package_id % 7) AS advisory_id, CASE WHEN pkg.package_id % 2 = 0 THEN '<2' ELSE '' END AS affected_range,
 CASE WHEN pkg.package_id % 4 < 2 THEN pkg.package_id END AS lid, CASE WHEN pkg.package_id % 4 = 0 THEN 'GPL-3.0-only' ELSE '' END AS normalized_license, 'main' AS channel FROM pkg LEFT JOIN fold USING (package_id) WHERE absent_since IS NULL), {ITEMS_OF_V}
SELECT finding_key, package_id, queue FROM opened WHERE NOT (queue = 'identity_review' AND package_id % 5 = 0) AND NOT (queue = 'remediation' AND package_id % 5 = 1)""")
def open_items(t: Tables):
    p = F.col("package_id")
    rows = t.packages().join(presence.presence(inventory(t), t.cutoff), "package_id", "left").select(
        "package_id", "confidence", "absent_since", "listed_since", F.when(p % 3 == 0, "advisories_matched").otherwise("unknown").alias("vulnerability_status"), F.when(p % 6 != 0, p).alias("vulnerability_finding_id"), F.concat(F.lit("ADV-"), (p % 7).cast("string")).alias("advisory_id"), F.when(p % 2 == 0, "<2").alias("affected_range"),
        F.when(p % 4 == 0, "forbidden").when(p % 4 == 1, "manual_review").otherwise("allowed").alias("license_outcome"), p.alias("license_finding_id"), F.when(p % 4 == 0, "GPL-3.0-only").alias("normalized_license"), F.lit("main").alias("channel"),
    )
    none = t.spark.createDataFrame([], "finding_key string, package_id long, queue string, state string")
    waiting = t.packages().where(p % 5 == 0).select(F.concat(F.lit("other"), p.cast("string")).alias("finding_key"), "package_id", F.lit("identity_review").alias("queue"), F.lit("open").alias("state"))
    known = workflow.to_open(rows, none).where((F.col("queue") == "remediation") & (p % 5 == 1)).withColumn("state", F.lit("resolved"))
    return workflow.to_open(rows, waiting.unionByName(known))


@query("close_items", f"WITH {EVC}, {_INV}, {_FOLD}, {ITEM} SELECT item_id, package_id, state AS from_state, 'resolved' AS to_state, 'system' AS origin FROM item WHERE state NOT IN ('resolved', 'accepted') AND package_id IN (SELECT package_id FROM fold WHERE absent_since IS NOT NULL)")
def close_items(t: Tables):
    absent = presence.presence(inventory(t), t.cutoff).where(F.col("absent_since").isNotNull())
    return workflow.to_close(t.items(), absent)


@query("transition_validation", f"""WITH {ITEM}, r AS (SELECT conv_id * 1000 + turn AS request_id, (conv_id * 7 + turn) AS item_id, CASE turn % 3 WHEN 0 THEN 'in_progress' WHEN 1 THEN 'open' ELSE 'triaged' END AS expected_state,
  CASE turn % 2 WHEN 0 THEN 'resolved' ELSE 'triaged' END AS to_state, CASE role WHEN 'user' THEN 'leadership' WHEN 'assistant' THEN 'security_reviewer' ELSE 'nobody' END AS role, '' AS justification FROM conversations)
SELECT request_id, r.item_id, expected_state, to_state, role, justification, CASE WHEN item.item_id IS NULL THEN 'no such item' WHEN state <> expected_state THEN 'stale'
  WHEN (state, to_state) NOT IN (('open', 'triaged'), ('triaged', 'routed'), ('triaged', 'in_progress'), ('routed', 'in_progress'), ('in_progress', 'resolved'), ('in_progress', 'triaged'), ('triaged', 'accepted')) THEN 'undeclared'
  WHEN role = 'nobody' THEN 'role' ELSE 'applied' END AS answer FROM r LEFT JOIN item ON item.item_id = r.item_id""")
def transition_validation(t: Tables):
    turn = F.col("turn")
    requests = t.conversations.select(
        (F.col("conv_id") * 1000 + turn).alias("request_id"), (F.col("conv_id") * 7 + turn).alias("item_id"),
        F.when(turn % 3 == 0, "in_progress").when(turn % 3 == 1, "open").otherwise("triaged").alias("expected_state"), F.when(turn % 2 == 0, "resolved").otherwise("triaged").alias("to_state"),
        F.when(F.col("role") == "user", "leadership").when(F.col("role") == "assistant", "security_reviewer").otherwise("nobody").alias("role"), F.lit("").alias("justification"),
    )
    return workflow.judged(requests, t.items())


_W = ("2024-01-19 00:00:00", "2024-01-20 00:00:00")


@query("digest_histogram", f"WITH {EV}, {_LEDGER} SELECT collector, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in vocab.RUN_STATES) + f", count(*) FILTER (WHERE status = 'failed' AND contains(detail, 'rate limit')) AS rate_limited FROM ledger WHERE finished_at >= TIMESTAMP '{_W[0]}' AND finished_at < TIMESTAMP '{_W[1]}' GROUP BY collector")
def digest_histogram(t: Tables):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return digest.histogram(ledger(t), at(_W[0]), at(_W[1]))


@query("digest_freshness", f"WITH {EVC}, {PKG}, n AS (SELECT package_id, max(observed_at) AS newest FROM evc GROUP BY 1) SELECT count(*) AS selected, count(*) FILTER (WHERE newest < TIMESTAMP '{CUTOFF}' - INTERVAL 1 DAY) AS past_target, count(*) FILTER (WHERE newest IS NULL) AS never_observed FROM pkg LEFT JOIN n USING (package_id)")
def digest_freshness(t: Tables):
    return digest.freshness(t.packages(), asof.upto(t.evidence(), t.cutoff), t.cutoff, 1)


@query("digest_change", f"WITH {EV}, d AS (SELECT surface, date_trunc('day', observed_at) AS day, count(*) FILTER (WHERE state = 'error') // 8 AS figure FROM ev GROUP BY 1, 2) SELECT surface, day, CAST(figure AS BIGINT) AS figure, row_number() OVER w = 1 OR figure IS DISTINCT FROM lag(figure) OVER w AS changed FROM d WINDOW w AS (PARTITION BY surface ORDER BY day)")
def digest_change(t: Tables):
    day = F.date_trunc("day", "observed_at").cast("timestamp_ntz").alias("day")
    figures = t.evidence().groupBy("surface", day).agg(F.floor(F.count_if(F.col("state") == "error") / 8).alias("figure"))
    return digest.changes(figures, ["surface"], "day", "figure")


_MOVES = """r AS (SELECT event_id AS request_id, ts AS requested_at, user_id AS item_id, ['open', 'triaged', 'routed', 'in_progress', 'triaged'][1 + (event_id // 2) % 5] AS expected_state, ['triaged', 'routed', 'in_progress', 'resolved', 'accepted'][1 + event_id % 5] AS to_state,
  CASE event_id % 7 WHEN 0 THEN 'visitor' ELSE 'security_reviewer' END AS role, CASE WHEN event_id % 3 = 0 THEN 'as agreed' ELSE ' ' END AS justification FROM events),
tr AS (SELECT * FROM (VALUES ('open', 'triaged'), ('triaged', 'routed'), ('triaged', 'in_progress'), ('routed', 'in_progress'), ('in_progress', 'resolved'), ('in_progress', 'triaged'), ('triaged', 'accepted')) x(a, b)),
o AS (SELECT r.*, row_number() OVER (PARTITION BY item_id ORDER BY requested_at, request_id) AS n, CASE WHEN tr.a IS NULL THEN 'undeclared' WHEN role = 'visitor' THEN 'role' WHEN to_state = 'accepted' AND trim(justification) = '' THEN 'justification' END AS refused FROM r LEFT JOIN tr ON tr.a = expected_state AND tr.b = to_state),
i AS (SELECT c_custkey AS item_id, ['open', 'triaged', 'in_progress', 'resolved'][1 + c_nationkey % 4] AS state FROM customer WHERE c_custkey % 10 <> 0)"""


_JUDGED = "WITH RECURSIVE " + _MOVES + """, f AS (SELECT o.item_id, 0::BIGINT AS n, NULL::BIGINT AS request_id, i.state, NULL::VARCHAR AS answer FROM (SELECT DISTINCT item_id FROM o) o LEFT JOIN i USING (item_id)
 UNION ALL SELECT o.item_id, o.n, o.request_id, CASE WHEN f.state = o.expected_state AND o.refused IS NULL THEN o.to_state ELSE f.state END, CASE WHEN f.state IS NULL THEN 'no such item' WHEN f.state <> o.expected_state THEN 'stale' ELSE coalesce(o.refused, 'applied') END FROM f JOIN o ON o.item_id = f.item_id AND o.n = f.n + 1)"""


def _requests(t: Tables):
    e = F.col("event_id")
    pick = lambda values, n: F.element_at(vocab.strings(values), n.cast("int"))
    requests = t.events.select(
        e.alias("request_id"), F.col("ts").alias("requested_at"), F.col("user_id").alias("item_id"),
        pick(("open", "triaged", "routed", "in_progress", "triaged"), 1 + F.floor(e / 2) % 5).alias("expected_state"),
        pick(("triaged", "routed", "in_progress", "resolved", "accepted"), 1 + e % 5).alias("to_state"),
        F.when(e % 7 == 0, "visitor").otherwise("security_reviewer").alias("role"), F.when(e % 3 == 0, "as agreed").otherwise(" ").alias("justification"),
    )
    items = t.customer.where(F.col("c_custkey") % 10 != 0).select(F.col("c_custkey").alias("item_id"), pick(("open", "triaged", "in_progress", "resolved"), 1 + F.col("c_nationkey") % 4).alias("state"))
    return requests, items


@query("transitions_in_order", _JUDGED + " SELECT request_id, item_id, answer FROM f WHERE n > 0")
def transitions_in_order(t: Tables):
    """Each user's events as requests about one item, judged one after another."""
    return workflow.in_order(*_requests(t), "day").select("request_id", "item_id", "answer")


#: Applied requests: queue as each leaves it; and SQL of items as they were.
_MADE = _JUDGED + """, m AS (SELECT o.*, CASE WHEN o.request_id % 4 = 0 THEN 'q' || o.request_id % 3 ELSE '' END AS q FROM f JOIN o USING (request_id) WHERE answer = 'applied'),
w AS (SELECT *, coalesce(last_value(nullif(q, '') IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY n ROWS UNBOUNDED PRECEDING), 'first') AS stood FROM m)"""


def _applied(t: Tables):
    requests, items = _requests(t)
    e = F.col("request_id")
    done = workflow.in_order(requests, items, "day").where(F.col("answer") == "applied")
    moves = done.select(
        e.alias("move_id"), "item_id", F.col("expected_state").alias("from_state"), "to_state", F.when(e % 4 == 0, F.concat(F.lit("q"), (e % 3).cast("string"))).otherwise("").alias("queue"),
        F.concat(F.lit("u"), (e % 5).cast("string")).alias("author"), "justification", F.col("requested_at").alias("occurred_at"),
    )
    held = items.select("item_id", F.lit("first").alias("queue"), "state", F.when(F.col("state") == "in_progress", "u9").alias("claimed_by"), F.lit("2023-12-31 00:00:00").cast("timestamp_ntz").alias("changed_at"))
    return workflow.applied(moves, held)


@query("transitions_made", _MADE + " SELECT request_id AS move_id, item_id, expected_state AS from_state, to_state, stood AS queue, 'u' || request_id % 5 AS author, justification, requested_at AS occurred_at FROM w")
def transitions_made(t: Tables):
    return _applied(t)[1]


@query("items_moved", _MADE + """, z AS (SELECT item_id, arg_max(to_state, n) AS s, arg_max(request_id, n) AS e, arg_max(stood, n) AS q, max(requested_at) AS moved_at FROM w GROUP BY 1)
SELECT i.item_id, coalesce(q, 'first') AS queue, coalesce(s, i.state) AS state, CASE WHEN s = 'in_progress' THEN 'u' || e % 5 WHEN s IS NULL AND i.state = 'in_progress' THEN 'u9' END AS claimed_by, coalesce(moved_at, TIMESTAMP '2023-12-31 00:00:00') AS changed_at FROM i LEFT JOIN z USING (item_id)""")
def items_moved(t: Tables):
    return _applied(t)[0]
