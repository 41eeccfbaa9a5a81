"""As-of reads, lattices, passes and rollup over the supplied tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from assayer.adapters import CUTOFF, EV, EVC, FIND, ITEM, PKG, Tables, query
from assayer.functions import vocab
from assayer.operators import asof, presence
from assayer.plans import passes, rollup

LATEST = "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY observed_at DESC, {ties} id DESC) AS rn FROM {rows}) WHERE rn = 1"
OK_FIRST = "CASE WHEN state = 'ok' THEN 0 ELSE 1 END,"


def _arr(order) -> str:
    return "[" + ", ".join(f"'{v}'" for v in order) + "]"


@query("asof_latest", f"WITH {EVC} SELECT package_id, id, observed_at, state FROM ({LATEST.format(keys='package_id', ties='', rows='evc')})")
def asof_latest(t: Tables):
    return asof.latest(t.evidence(), ["package_id"], t.cutoff).select("package_id", "id", "observed_at", "state")


@query("asof_latest_tiebreak", f"""WITH {EV}, d AS (SELECT id, date_trunc('day', observed_at) AS observed_at, package_id, surface, state FROM ev)
SELECT package_id, surface, id, state FROM ({LATEST.format(keys='package_id, surface', ties=OK_FIRST, rows="(SELECT * FROM d WHERE observed_at <= TIMESTAMP '" + CUTOFF + "')")})""")
def asof_latest_tiebreak(t: Tables):
    by_day = t.evidence().withColumn("observed_at", F.date_trunc("day", "observed_at").cast("timestamp_ntz"))
    return asof.latest(by_day, ["package_id", "surface"], t.cutoff, [asof.determinate()]).select("package_id", "surface", "id", "state")


@query("asof_left_missing", f"WITH {EVC}, {PKG}, l AS ({LATEST.format(keys='package_id', ties='', rows='evc')}) SELECT pkg.package_id, coalesce(l.state, 'unknown') AS state, l.id IS NULL AS missing FROM pkg LEFT JOIN l USING (package_id)")
def asof_left_missing(t: Tables):
    newest = asof.latest(t.evidence(), ["package_id"], t.cutoff).select("package_id", "state", "id")
    return t.packages().select("package_id").join(newest, "package_id", "left").select("package_id", F.coalesce("state", F.lit("unknown")).alias("state"), F.col("id").isNull().alias("missing"))


@query("latest_sweep", f"WITH {FIND} SELECT package_id, id, observed_at, verdict FROM (SELECT *, rank() OVER (PARTITION BY package_id ORDER BY observed_at DESC) AS r FROM find WHERE observed_at <= TIMESTAMP '2000-01-01') WHERE r = 1")
def latest_sweep(t: Tables):
    return asof.sweep(t.findings(), ["package_id"], F.lit("2000-01-01").cast("timestamp_ntz")).select("package_id", "id", "observed_at", "verdict")


def _worst_sql(order, value: str, rows: str, with_: str, empty: str = "unknown") -> str:
    return f"WITH {with_} SELECT package_id, coalesce({_arr(order)}[min(list_position({_arr(order)}, {value}))], '{empty}') AS worst FROM {rows} GROUP BY package_id"


@query("lattice_worst_outcome", _worst_sql(vocab.OUTCOME, "state", "ev", EV))
def lattice_worst_outcome(t: Tables):
    return t.evidence().groupBy("package_id").agg(vocab.worst(F.col("state"), vocab.OUTCOME).alias("worst"))


_CURRENCY = "CASE id % 7 WHEN 0 THEN 'behind' WHEN 1 THEN 'not_applicable' WHEN 2 THEN 'not_found' ELSE 'current' END"


@query("lattice_currency", f"""WITH {EV}, v AS (SELECT package_id, surface, {_CURRENCY} AS v FROM ev)
SELECT package_id, surface, CASE WHEN count(v) = 0 THEN 'unknown' WHEN count(*) FILTER (WHERE v <> 'not_applicable') = 0 THEN 'not_applicable'
 ELSE {_arr(vocab.CURRENCY)}[min(list_position({_arr(vocab.CURRENCY)}, v)) FILTER (WHERE v <> 'not_applicable')] END AS worst FROM v GROUP BY package_id, surface""")
def lattice_currency(t: Tables):
    rows = t.evidence().withColumn("v", F.expr(_CURRENCY))
    return rows.groupBy("package_id", "surface").agg(vocab.worst_currency(F.col("v")).alias("worst"))


_VULN = "CASE verdict WHEN 'forbidden' THEN 'advisories_matched' WHEN 'allowed' THEN 'no_advisory_matched' ELSE 'unknown' END"
_KEV = "CASE verdict WHEN 'forbidden' THEN 'listed' WHEN 'allowed' THEN 'not_listed' ELSE 'not_established' END"
_READY = "CASE WHEN verdict = 'forbidden' THEN 'awaiting_build' WHEN verdict = 'allowed' THEN 'ready' WHEN id % 2 = 0 THEN 'awaiting_packaging' ELSE 'unknown' END"


def _lattice(name: str, order, value: str, empty: str = "unknown"):
    @query(name, _worst_sql(order, value, "find", FIND, empty))
    def lattice(t: Tables):
        return t.findings().groupBy("package_id").agg(vocab.worst(F.expr(value), order, empty).alias("worst"))


_lattice("lattice_vulnerability", vocab.VULNERABILITY, _VULN)
_lattice("lattice_kev", vocab.KEV, _KEV, "not_established")
_lattice("lattice_license", vocab.LICENCE, "verdict")
_lattice("lattice_readiness", vocab.READINESS, _READY)


@query("supporting_row", f"WITH {FIND}, r AS (SELECT package_id, id, list_position({_arr(vocab.LICENCE)}, verdict) AS p FROM find), w AS (SELECT package_id, min(p) AS p FROM r GROUP BY 1) SELECT package_id, {_arr(vocab.LICENCE)}[p] AS worst, min(id) AS finding_id FROM r JOIN w USING (package_id, p) GROUP BY package_id, p")
def supporting_row(t: Tables):
    mark = F.min(F.struct(vocab.rank(F.col("verdict"), vocab.LICENCE).alias("p"), "id")).alias("m")
    return t.findings().groupBy("package_id").agg(mark).select("package_id", vocab.ranked(F.col("m.p"), vocab.LICENCE).alias("worst"), F.col("m.id").alias("finding_id"))


@query("risk_level", f"WITH {FIND}, r AS (SELECT package_id, list_position({_arr(passes.RISK_ORDER)}, lower(trim(severity))) AS p, state FROM find) SELECT package_id, coalesce({_arr(passes.RISK_ORDER)}[min(p) FILTER (WHERE p > 0 AND state = 'matched')], '') AS risk_level FROM r GROUP BY package_id")
def risk_level(t: Tables):
    p = F.array_position(vocab.strings(passes.RISK_ORDER), F.lower(F.trim("severity")))
    found = F.min(F.when((p > 0) & (F.col("state") == "matched"), p))
    return t.findings().groupBy("package_id").agg(F.coalesce(vocab.ranked(found, passes.RISK_ORDER), F.lit("")).alias("risk_level"))


def _surfaces(t: Tables):
    return t.evidence().withColumn("surface", F.element_at(vocab.strings(vocab.SURFACES), (F.col("surface") + 1).cast("int")))


@query("currency_pass", f"""WITH {EVC}, {PKG}, s AS (SELECT *, {_arr(vocab.SURFACES)}[surface + 1] AS sname FROM evc),
l AS ({LATEST.format(keys='package_id, surface', ties=OK_FIRST, rows='s')}),
a AS (SELECT package_id, min(surface) FILTER (WHERE state = 'ok') AS auth FROM l GROUP BY package_id),
g AS (SELECT pkg.package_id, x.i AS surface, l.state, l.version, l.id, a.auth, h.version AS head
  FROM pkg CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS i) x LEFT JOIN l ON l.package_id = pkg.package_id AND l.surface = x.i
  LEFT JOIN a ON a.package_id = pkg.package_id LEFT JOIN l h ON h.package_id = pkg.package_id AND h.surface = a.auth),
v AS (SELECT *, CASE WHEN state IS NULL THEN 'unknown' WHEN state <> 'ok' THEN state WHEN auth IS NULL THEN 'unknown' WHEN version = head THEN 'current' ELSE 'behind' END AS v FROM g)
SELECT package_id, max(v) FILTER (WHERE surface = 0) AS source_status, max(v) FILTER (WHERE surface = 1) AS pypi_status,
  max(v) FILTER (WHERE surface = 2) AS feedstock_status, max(v) FILTER (WHERE surface = 3) AS conda_package_status,
  CASE WHEN count(*) FILTER (WHERE v <> 'not_applicable') = 0 THEN 'not_applicable' ELSE {_arr(vocab.CURRENCY)}[min(list_position({_arr(vocab.CURRENCY)}, v)) FILTER (WHERE v <> 'not_applicable')] END AS overall_status,
  {_arr(vocab.SURFACES)}[max(auth) + 1] AS chosen_authority,
  coalesce(string_agg(CASE WHEN v = 'behind' THEN {_arr(vocab.SURFACES)}[surface + 1] || ': ' || version || ' is not ' || head END, chr(10) ORDER BY surface), '') AS detail
FROM v GROUP BY package_id""")
def currency_pass(t: Tables):
    out = passes.currency(t.packages(), _surfaces(t), t.cutoff)
    return out.drop("error", *[f"{s}_snapshot_id" for s in vocab.SURFACES])


def _feedstock(t: Tables):
    return t.evidence().where(F.col("surface") == 2).select(
        "package_id", "id", "observed_at", "state",
        F.when(F.col("id") % 5 != 0, F.col("observed_at") - F.expr("INTERVAL 1 DAY") * (F.col("id") % 400).cast("int")).alias("last_activity_at"),
        F.when(F.col("id") % 3 == 0, "https://staged").otherwise("").alias("staged_url"),
        (F.col("id") % 2 == 0).alias("absence_established"),
    )


@query("feedstock_presence_pass", f"""WITH {EVC}, {PKG}, f AS (SELECT package_id, id, observed_at, state,
  CASE WHEN id % 5 <> 0 THEN observed_at - INTERVAL 1 DAY * CAST(id % 400 AS INTEGER) END AS act,
  CASE WHEN id % 3 = 0 THEN 'https://staged' ELSE '' END AS staged, id % 2 = 0 AS est FROM evc WHERE surface = 2),
l AS ({LATEST.format(keys='package_id', ties='', rows='f')}),
a AS (SELECT pkg.package_id, l.*  EXCLUDE (package_id), CAST(floor(epoch(TIMESTAMP '{CUTOFF}')) - floor(epoch(act)) AS BIGINT) AS age FROM pkg LEFT JOIN l USING (package_id))
SELECT package_id, CASE WHEN state IS NULL THEN 'unknown' WHEN state IN ('error', 'unknown', 'not_applicable') THEN state
  WHEN state = 'not_found' AND NOT est THEN 'unknown' WHEN state = 'not_found' AND staged <> '' THEN 'staged_recipe_pending' WHEN state = 'not_found' THEN 'absent'
  WHEN age IS NULL THEN 'unknown' WHEN age <= 180 * 86400 THEN 'present_and_maintained' ELSE 'present_and_inactive' END AS presence_status,
  CASE WHEN state = 'ok' THEN age END AS activity_age, id AS feedstock_snapshot_id,
  CASE WHEN state = 'not_found' AND NOT est THEN 'row ' || id || ' found no feedstock but could not establish its absence' WHEN state = 'not_found' AND staged <> '' THEN 'no feedstock; row ' || id || ' holds an open recipe at ' || staged
    WHEN state = 'ok' AND age IS NULL THEN 'row ' || id || ' states no activity that could be measured against 180 days' ELSE '' END AS detail FROM a""")
def feedstock_presence_pass(t: Tables):
    return passes.feedstock_presence(t.packages(), _feedstock(t), t.cutoff).drop("error")


def _advisories(t: Tables):
    return t.findings().withColumn("nothing_matched", F.col("id") % 2 == 0)


def _kev(t: Tables):
    """Cross-references of findings whose severity is known, some of them about the package alone."""
    rows = t.findings().where(F.col("severity") != "odd")
    state = F.when(F.col("id") % 4 == 0, "listed").when(F.col("id") % 4 == 1, "not_listed").otherwise("unknown")
    return rows.select("package_id", (F.col("id") + 1_000_000_000).alias("id"), "observed_at", state.alias("state"), F.when(F.col("id") % 7 != 0, F.col("id")).alias("finding_id"))


def _parts(t: Tables):
    return t.part.select(F.col("p_partkey").alias("package_id"))


_AT = "2000-01-01 00:00:00"
_SWEEP = f"sw AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY package_id ORDER BY observed_at DESC) AS r FROM find WHERE observed_at <= TIMESTAMP '{_AT}') WHERE r = 1)"


@query("vulnerability_pass", f"""WITH {FIND}, {_SWEEP},
v AS (SELECT *, list_position({_arr(vocab.VULNERABILITY)}, CASE WHEN state = 'matched' THEN 'advisories_matched' WHEN state = 'unknown' AND id % 2 = 0 THEN 'no_advisory_matched' ELSE 'unknown' END) AS p,
  list_position({_arr(passes.RISK_ORDER)}, lower(trim(severity))) AS sev FROM sw),
st AS (SELECT package_id, min(p) AS p, min(sev) FILTER (WHERE sev > 0 AND state = 'matched') AS sev FROM v GROUP BY 1),
sup AS (SELECT v.package_id, min(id) AS fid FROM v JOIN st ON v.package_id = st.package_id AND v.p = st.p GROUP BY 1),
k AS (SELECT package_id, id + 1000000000 AS id, observed_at, CASE id % 4 WHEN 0 THEN 'listed' WHEN 1 THEN 'not_listed' ELSE 'not_established' END AS a, CASE WHEN id % 7 <> 0 THEN id END AS fid FROM find WHERE severity <> 'odd' AND observed_at <= TIMESTAMP '{_AT}'),
ks AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY package_id ORDER BY observed_at DESC) AS r FROM k) WHERE r = 1),
fc AS (SELECT sw.package_id, count(*) FILTER (WHERE sw.state = 'matched') AS matched, count(*) FILTER (WHERE sw.state = 'matched' AND ks.id IS NULL) AS loose, min(sw.id) FILTER (WHERE sw.state = 'matched' AND ks.id IS NULL) AS first_loose,
  count(*) FILTER (WHERE sw.state = 'matched' AND trim(coalesce(severity, '')) <> '') AS sevs FROM sw LEFT JOIN ks ON ks.package_id = sw.package_id AND ks.fid = sw.id GROUP BY 1),
kc AS (SELECT ks.package_id, count(*) AS crossed, count(*) FILTER (WHERE ks.fid IS NOT NULL AND sw.id IS NULL) AS apart, min(ks.id) FILTER (WHERE ks.fid IS NOT NULL AND sw.id IS NULL) AS first_apart FROM ks LEFT JOIN sw ON sw.package_id = ks.package_id AND sw.id = ks.fid GROUP BY 1),
about AS (SELECT ks.* FROM ks LEFT JOIN sw ON sw.package_id = ks.package_id AND sw.id = ks.fid WHERE ks.fid IS NULL OR sw.id IS NOT NULL),
loose AS (SELECT package_id FROM sw WHERE state = 'matched' AND NOT EXISTS (SELECT 1 FROM about WHERE about.package_id = sw.package_id AND about.fid = sw.id)),
m AS (SELECT package_id, list_position({_arr(vocab.KEV)}, a) AS p, id FROM about UNION ALL SELECT package_id, 2, NULL FROM loose),
mk AS (SELECT package_id, min(p) AS p FROM m GROUP BY 1),
ms AS (SELECT m.package_id, CASE WHEN count(*) = count(m.id) THEN min(m.id) END AS kid FROM m JOIN mk ON m.package_id = mk.package_id AND m.p = mk.p GROUP BY 1)
SELECT part.p_partkey AS package_id, coalesce({_arr(vocab.VULNERABILITY)}[st.p], 'unknown') AS vulnerability_status, coalesce({_arr(vocab.KEV)}[mk.p], 'not_established') AS kev_membership,
  coalesce({_arr(passes.RISK_ORDER)}[st.sev], '') AS risk_level, sup.fid AS vulnerability_finding_id, ms.kid AS kev_finding_id,
  concat_ws(' ', CASE WHEN st.p IS NOT NULL AND {_arr(vocab.VULNERABILITY)}[st.p] = 'unknown' THEN CASE sst.state WHEN 'error' THEN 'finding ' || sup.fid || ': the lookup failed' WHEN 'not_found' THEN 'finding ' || sup.fid || ': the source does not know the locator' ELSE 'finding ' || sup.fid || ' establishes nothing' END END,
    CASE WHEN {_arr(vocab.VULNERABILITY)}[st.p] = 'advisories_matched' AND st.sev IS NULL THEN CASE WHEN sevs = 0 THEN 'none of ' || matched || ' matched findings states a severity' ELSE 'no severity of ' || matched || ' matched findings is ranked' END END,
    CASE WHEN crossed > 0 AND (coalesce(loose, 0) > 0 OR apart > 0) THEN 'the two sweeps differ: ' || concat_ws(', ', CASE WHEN loose > 0 THEN loose || ' matched without a cross-reference, the first ' || first_loose END, CASE WHEN apart > 0 THEN apart || ' cross-references about other findings, the first ' || first_apart END) END) AS detail
FROM part LEFT JOIN fc ON fc.package_id = p_partkey LEFT JOIN kc ON kc.package_id = p_partkey LEFT JOIN st ON st.package_id = p_partkey LEFT JOIN sup ON sup.package_id = p_partkey LEFT JOIN sw sst ON sst.package_id = p_partkey AND sst.id = sup.fid LEFT JOIN mk ON mk.package_id = p_partkey LEFT JOIN ms ON ms.package_id = p_partkey""")
def vulnerability_pass(t: Tables):
    return passes.vulnerability(_parts(t), _advisories(t), _kev(t), F.lit(_AT).cast("timestamp_ntz"), passes.RISK_ORDER).drop("error")


_RULES = [("MIT", "allowed"), ("GPL-3.0-only", "forbidden"), ("LGPL-3.0-only", "restricted")]
_RAW = ["MIT", "the mit license", "GPL-3.0-only AND MIT", "MIT OR GPL-3.0-only", "odd", "lgpl-3.0-only  AND mit-license", "", "Apache 2.0 OR MIT", "Apache-2.0 OR MIT", "MIT AND ISC OR Zlib", "MIT and ISC", "(MIT OR ISC)", "ISC AND"]
_NORMAL = ["MIT", "MIT", "GPL-3.0-only AND MIT", "MIT OR GPL-3.0-only", None, "LGPL-3.0-only AND MIT", None, None, "Apache-2.0 OR MIT", None, None, None, None]
_VERDICT = ["allowed", "allowed", "forbidden", "manual_review", "unknown", "restricted", "unknown", "unknown", "manual_review", *["unknown"] * 4]
_RULE = ["MIT", "MIT", "GPL-3.0-only", None, None, "LGPL-3.0-only", *[None] * 7]


def _sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def _licences(t: Tables):
    from assayer.functions import licence_terms

    raw = F.element_at(vocab.strings(_RAW), (F.col("id") % len(_RAW) + 1).cast("int"))
    rows = t.findings().withColumn("read", licence_terms.normalised(raw))
    state = F.when(F.col("id") % 5 == 0, "not_found").when(F.col("read.expression").isNotNull(), "normalized").otherwise("unknown")
    return rows.select("package_id", "id", "observed_at", state.alias("state"), F.col("read.expression").alias("normalized_license"))


@query("licence_pass", f"""WITH {FIND}, {_SWEEP},
v AS (SELECT package_id, id, id % 5 = 0 AS gone, CASE WHEN id % 5 <> 0 THEN {_sql_list(_NORMAL)}[id % {len(_RAW)} + 1] END AS expr, {_sql_list(_VERDICT)}[id % {len(_RAW)} + 1] AS verdict, {_sql_list(_RULE)}[id % {len(_RAW)} + 1] AS rule FROM sw),
b AS (SELECT package_id, min(id) AS any_id, min(list_position({_arr(vocab.LICENCE)}, verdict)) FILTER (WHERE NOT gone) AS p, count(*) FILTER (WHERE NOT gone) AS answered, count(*) FILTER (WHERE gone) AS unserved, min(id) FILTER (WHERE gone) AS first_gone,
  count(*) FILTER (WHERE NOT gone AND expr IS NULL) AS unclear, min(id) FILTER (WHERE NOT gone AND expr IS NULL) AS first_unclear, min(expr) AS one, max(expr) AS other FROM v GROUP BY 1),
s AS (SELECT package_id, id, rule, expr FROM (SELECT v.*, row_number() OVER (PARTITION BY v.package_id ORDER BY id) AS rn FROM v JOIN b ON b.package_id = v.package_id AND NOT gone AND list_position({_arr(vocab.LICENCE)}, verdict) = b.p) WHERE rn = 1)
SELECT p_partkey AS package_id, coalesce({_arr(vocab.LICENCE)}[b.p], 'unknown') AS license_outcome, CASE WHEN {_arr(vocab.LICENCE)}[b.p] <> 'unknown' THEN s.rule END AS matched_rule, coalesce(s.id, b.any_id) AS license_finding_id,
  concat_ws(' ', CASE WHEN {_arr(vocab.LICENCE)}[b.p] = 'manual_review' THEN 'none of 3 rules names ' || s.expr END,
    CASE WHEN coalesce({_arr(vocab.LICENCE)}[b.p], 'unknown') = 'unknown' AND unserved > 0 AND answered = 0 THEN unserved || ' channels do not serve the package, the first ' || first_gone END,
    CASE WHEN coalesce({_arr(vocab.LICENCE)}[b.p], 'unknown') = 'unknown' AND unclear > 0 THEN unclear || ' channels state nothing that could be normalized, the first ' || first_unclear END,
    CASE WHEN {_arr(vocab.LICENCE)}[b.p] IN ('forbidden', 'restricted', 'allowed') AND lower(s.rule) <> lower(s.expr) THEN 'no rule names ' || s.expr || ' whole; its operand ' || s.rule || ' is ' || {_arr(vocab.LICENCE)}[b.p] END,
    CASE WHEN one <> other THEN 'channels state different licences, from ' || one || ' to ' || other WHEN one IS NOT NULL AND s.expr IS NULL THEN 'a channel states ' || one END) AS detail
FROM part LEFT JOIN b ON b.package_id = p_partkey LEFT JOIN s ON s.package_id = p_partkey""")
def licence_pass(t: Tables):
    return passes.licence(_parts(t), _licences(t), F.lit(_AT).cast("timestamp_ntz"), _RULES).drop("error")


@query("licence_normalise", f"WITH g AS (SELECT doc_id, doc_id % {len(_RAW)} + 1 AS i FROM documents) SELECT doc_id, {_sql_list(_RAW)}[i] AS raw, {_sql_list(_NORMAL)}[i] AS expression, {_sql_list(['spdx-identifier', 'recognised-spelling', 'spdx-expression', 'spdx-expression', None, 'spdx-expression', None, None, 'spdx-expression', None, None, None, None])}[i] AS method FROM g")
def licence_normalise(t: Tables):
    from assayer.functions import licence_terms

    raw = F.element_at(vocab.strings(_RAW), (F.col("doc_id") % len(_RAW) + 1).cast("int"))
    read = licence_terms.normalised(F.col("raw"))
    return t.documents.select("doc_id", raw.alias("raw")).select("doc_id", "raw", read["expression"].alias("expression"), read["method"].alias("method"))


_STATED = "SELECT package_id, surface, version, min(id) AS row_id FROM (SELECT *, rank() OVER (PARTITION BY package_id, surface ORDER BY observed_at DESC) AS r FROM evp) WHERE r = 1 AND state = 'ok' AND (surface = 0 OR surface = 2 OR surface = 3 AND observed_at >= TIMESTAMP '2024-01-19 00:00:00') GROUP BY ALL"


@query("remediation_pass", f"""WITH {EVC}, evp AS (SELECT * FROM evc), f AS (SELECT l_partkey % 150 AS package_id, l_orderkey * 10 + l_linenumber AS id,
  TIMESTAMP '2024-01-19 12:00:00' - INTERVAL 1 DAY * CAST(l_partkey % 4 AS INTEGER) AS observed_at, CASE l_returnflag WHEN 'A' THEN 'matched' WHEN 'N' THEN 'unknown' ELSE 'not_found' END AS state,
  CASE WHEN l_linenumber = 7 AND l_partkey % 5 = 0 THEN '>=2' ELSE CAST(l_partkey % 2 AS VARCHAR) END AS fixed FROM lineitem),
sw AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY package_id ORDER BY observed_at DESC) AS r FROM f) WHERE r = 1),
c AS (SELECT package_id, bool_or(observed_at < TIMESTAMP '{CUTOFF}' - INTERVAL 2 DAY) AS stale, count(*) FILTER (WHERE state = 'matched') AS matched, count(*) FILTER (WHERE state <> 'matched' AND id % 2 <> 0) AS open FROM sw GROUP BY 1),
st AS ({_STATED}),
x AS (SELECT sw.package_id, sw.id, CASE WHEN fixed <> '>=2' THEN fixed END AS fixed, min(row_id) FILTER (WHERE st.surface = 0) AS r0, min(row_id) FILTER (WHERE st.surface = 2) AS r2, min(row_id) FILTER (WHERE st.surface = 3) AS r3
  FROM sw LEFT JOIN st ON st.package_id = sw.package_id AND st.version = CASE WHEN fixed <> '>=2' THEN fixed END WHERE sw.state = 'matched' GROUP BY 1, 2, 3),
sf AS (SELECT package_id, bool_or(surface = 3 AND NOT fresh) AS old3, min(id) FILTER (WHERE surface = 0 AND ok) AS h0, min(id) FILTER (WHERE surface = 2 AND ok) AS h2, min(id) FILTER (WHERE surface = 3 AND ok AND fresh) AS h3
  FROM (SELECT *, state = 'ok' AS ok, observed_at >= TIMESTAMP '2024-01-19 00:00:00' AS fresh, rank() OVER (PARTITION BY package_id, surface ORDER BY observed_at DESC) AS r FROM evp) WHERE r = 1 GROUP BY 1),
y AS (SELECT *, CASE WHEN r3 IS NOT NULL THEN 5 WHEN r2 IS NOT NULL THEN 4 WHEN r0 IS NOT NULL THEN 3 ELSE 2 END AS p FROM x),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY p, id) AS rn FROM y) WHERE rn = 1)
SELECT pk.package_id, CASE WHEN c.matched IS NULL OR c.stale THEN 'unknown' WHEN c.matched = 0 AND c.open > 0 THEN 'unknown' WHEN c.matched = 0 THEN 'not_applicable' ELSE {_arr(vocab.READINESS)}[b.p] END AS readiness_status,
  CASE WHEN NOT coalesce(c.stale, false) AND b.r0 IS NOT NULL THEN 'published' ELSE 'not_read' END AS source_fix, 'not_read' AS pypi_fix,
  CASE WHEN NOT coalesce(c.stale, false) AND b.r2 IS NOT NULL THEN 'published' ELSE 'not_read' END AS feedstock_fix, CASE WHEN NOT coalesce(c.stale, false) AND b.r3 IS NOT NULL THEN 'published' ELSE 'not_read' END AS conda_package_fix,
  CASE WHEN NOT c.stale AND b.fixed IS NOT NULL THEN coalesce(b.r0, h0) END AS source_snapshot_id, CAST(NULL AS BIGINT) AS pypi_snapshot_id,
  CASE WHEN NOT c.stale AND b.fixed IS NOT NULL THEN coalesce(b.r2, h2) END AS feedstock_snapshot_id, CASE WHEN NOT c.stale AND b.fixed IS NOT NULL THEN coalesce(b.r3, h3) END AS conda_package_snapshot_id,
  CASE WHEN NOT coalesce(c.stale, false) THEN b.fixed END AS fixed_version, CASE WHEN NOT coalesce(c.stale, false) THEN b.id END AS vulnerability_finding_id, coalesce(c.stale, false) OR coalesce(c.matched > 0 AND old3, false) AS evidence_stale,
  CASE WHEN coalesce(c.stale, false) THEN 'the advisory evidence is older than its target' WHEN b.id IS NULL THEN CASE WHEN c.matched IS NULL THEN 'no advisory evidence at the cut-off' WHEN c.open > 0 THEN 'no advisory matched, and ' || c.open || ' findings establish nothing' ELSE 'no advisory matched' END
   ELSE concat_ws(' ', CASE WHEN c.matched > 1 THEN c.matched || ' findings matched; this is the least ready, ' || b.id END, CASE WHEN b.fixed IS NULL THEN 'finding ' || b.id || ' states a range, not a version' END, CASE WHEN sf.old3 THEN 'old evidence: conda_package' END,
    'no freshness target: pypi', CASE WHEN b.fixed IS NOT NULL AND b.p = 2 THEN 'version ' || b.fixed || ' was not seen on: source, pypi, feedstock, conda_package' END,
    CASE WHEN b.fixed IS NOT NULL AND (h0 IS NOT NULL AND r0 IS NULL OR h2 IS NOT NULL AND r2 IS NULL OR h3 IS NOT NULL AND r3 IS NULL) THEN 'other versions than ' || b.fixed || ' on: ' || concat_ws(', ', CASE WHEN h0 IS NOT NULL AND r0 IS NULL THEN 'source' END, CASE WHEN h2 IS NOT NULL AND r2 IS NULL THEN 'feedstock' END, CASE WHEN h3 IS NOT NULL AND r3 IS NULL THEN 'conda_package' END) END) END AS detail
FROM (SELECT DISTINCT package_id FROM ev) pk LEFT JOIN sf ON sf.package_id = pk.package_id LEFT JOIN c ON c.package_id = pk.package_id LEFT JOIN b ON b.package_id = pk.package_id""")
def remediation_pass(t: Tables):
    findings = t.lineitem.select(
        (F.col("l_partkey") % 150).alias("package_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        (F.lit("2024-01-19 12:00:00").cast("timestamp_ntz") - F.expr("INTERVAL 1 DAY") * (F.col("l_partkey") % 4).cast("int")).alias("observed_at"),
        F.when(F.col("l_returnflag") == "A", "matched").when(F.col("l_returnflag") == "N", "unknown").otherwise("not_found").alias("state"),
        F.when((F.col("l_linenumber") == 7) & (F.col("l_partkey") % 5 == 0), ">=2").otherwise((F.col("l_partkey") % 2).cast("string")).alias("fixed_range"),
    ).withColumn("nothing_matched", F.col("id") % 2 == 0)
    days = {"source": 100, "feedstock": 100, "conda_package": 1}  # pypi has no target
    return passes.remediation(t.evidence().select("package_id").distinct(), findings, _surfaces(t), t.cutoff, days).drop("error")


def _readiness_rows(t: Tables):
    rows = t.evidence()
    a = rows.where(F.col("surface") < 2).withColumn("state", F.when(F.col("state") == "ok", "inferred_ready").when(F.col("state") == "not_found", "inferred_not_ready").otherwise(F.col("state")))
    v = rows.where(F.col("surface") == 3).withColumn("state", F.when(F.col("state") == "ok", "verified_compatible").when(F.col("state") == "not_found", "verification_failed").otherwise(F.col("state")))
    return a, v


@query("py_readiness_pass", f"""WITH {EVC}, {PKG}, a AS ({LATEST.format(keys='package_id', ties='', rows='(SELECT * FROM evc WHERE surface < 2)')}), v AS ({LATEST.format(keys='package_id', ties='', rows='(SELECT * FROM evc WHERE surface = 3)')}),
j AS (SELECT pkg.package_id, a.id AS aid, v.id AS vid, a.state AS a0, v.state AS v0,
  CASE a.state WHEN 'ok' THEN 'inferred_ready' WHEN 'not_found' THEN 'inferred_not_ready' END AS inf, CASE v.state WHEN 'ok' THEN 'verified_ready' WHEN 'not_found' THEN 'verified_not_ready' END AS ver,
  coalesce(a.observed_at < TIMESTAMP '{CUTOFF}' - INTERVAL 6 HOUR, false) AS oa, coalesce(v.observed_at < TIMESTAMP '{CUTOFF}' - INTERVAL 12 HOUR, false) AS ov
  FROM pkg LEFT JOIN a USING (package_id) LEFT JOIN v USING (package_id)),
k AS (SELECT *, coalesce(a0 = 'not_applicable', false) OR coalesce(v0 = 'not_applicable', false) AS na, ver IS NOT NULL AND NOT ov AS uv, inf IS NOT NULL AND NOT oa AS ua FROM j)
SELECT package_id, CASE WHEN na THEN 'not_applicable' WHEN uv THEN ver WHEN ua THEN inf ELSE 'unknown' END AS readiness, CASE WHEN na THEN 'none' WHEN uv THEN 'verified' WHEN ua THEN 'inferred' ELSE 'none' END AS evidence_type,
  CASE WHEN na THEN false WHEN uv THEN oa WHEN ua THEN ov ELSE ov OR oa END AS evidence_stale, CASE WHEN NOT na THEN aid END AS assessment_id, CASE WHEN NOT na THEN vid END AS verification_id,
  CASE WHEN na THEN 'the package has no release ecosystem that declares a Python' WHEN uv AND ua THEN CASE WHEN (ver = 'verified_ready') = (inf = 'inferred_ready') THEN 'assessment and verification agree' ELSE 'assessment and verification disagree; the build decides' END
   WHEN uv OR ua THEN '' WHEN ov OR oa THEN 'evidence is older than its target' WHEN aid IS NULL AND vid IS NULL THEN 'no evidence of either kind' ELSE 'the evidence establishes nothing' END AS detail FROM k""")
def py_readiness_pass(t: Tables):
    a, v = _readiness_rows(t)
    return passes.python_readiness(t.packages(), a, v, t.cutoff, "6 HOURS", "12 HOURS")


_DOMAINS = {
    "vulnerability_status": ("p_partkey % 5 = 0", "advisories_matched"),
    "license_outcome": ("p_partkey % 7 = 0", "forbidden"),
    "feedstock_presence_status": ("p_partkey % 3 = 0", "absent"),
    "python_readiness": ("p_partkey % 2 = 0", "inferred_not_ready"),
    "currency_status": ("p_partkey % 4 <> 0", "behind"),
    "remediation_readiness": ("p_partkey % 10 = 0", "ready"),
}


def _verdicts(t: Tables):
    return t.part.select(F.col("p_partkey").alias("package_id"), *[F.expr(f"CASE WHEN {c} THEN '{v}' END").alias(d) for d, (c, v) in _DOMAINS.items()])


@query("work_type_rules", "SELECT p_partkey AS package_id, CASE WHEN p_partkey % 5 = 0 THEN 'fix_vulnerability' WHEN p_partkey % 7 = 0 THEN 'review_license' WHEN p_partkey % 3 = 0 THEN 'create_recipe' WHEN p_partkey % 2 = 0 THEN 'validate_python_314' WHEN p_partkey % 4 <> 0 THEN 'file_tracking_issue' ELSE 'unknown' END AS work_type FROM part")
def work_type_rules(t: Tables):
    rows = _verdicts(t)
    return rows.select("package_id", passes.work_type(rows).alias("work_type"))


@query("priority_rules", "WITH b AS (SELECT p_partkey AS package_id, CASE WHEN p_partkey % 10 = 0 THEN 1 WHEN p_partkey % 5 = 0 THEN 3 WHEN p_partkey % 7 = 0 THEN 4 WHEN p_partkey % 4 <> 0 AND p_partkey % 3 = 0 THEN 6 WHEN p_partkey % 2 = 0 THEN 9 WHEN p_partkey % 4 <> 0 THEN 10 END AS n FROM part) SELECT package_id, coalesce('p' || n, 'unknown') AS bucket, coalesce('rule ' || n, '') AS matched_rule FROM b")
def priority_rules(t: Tables):
    rows = _verdicts(t)
    found = passes.priority(rows)
    return rows.select("package_id", found["bucket"].alias("bucket"), found["rule"].alias("matched_rule"))


@query("priority_score", "SELECT o_orderkey AS package_id, CASE WHEN o_custkey % 3 <> 0 THEN CAST(1 + (least(5 * (o_custkey % 12) + o_orderkey % 400, 600) * 99) // 600 AS INTEGER) END AS score FROM orders")
def priority_score(t: Tables):
    rows = t.orders.select(F.col("o_orderkey").alias("package_id"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey") % 12).alias("lobs"), (F.col("o_orderkey") % 400).alias("components"))
    return rows.select("package_id", passes.score().alias("score"))


@query("confidence_gate", f"WITH {EVC}, {PKG}, l AS ({LATEST.format(keys='package_id', ties='', rows='evc')}) SELECT package_id, CASE WHEN confidence = 'unmapped' THEN 'unknown' ELSE state END AS status FROM pkg JOIN l USING (package_id)")
def confidence_gate(t: Tables):
    newest = asof.latest(t.evidence(), ["package_id"], t.cutoff).select("package_id", "state")
    return t.packages().join(newest, "package_id").select("package_id", vocab.gated(F.col("state"), F.col("confidence")).alias("status"))


_ROLL = f"""roll AS (SELECT pkg.package_id, confidence, CASE WHEN confidence = 'unmapped' THEN 'unknown' ELSE coalesce(w.worst, 'unknown') END AS currency_status,
  CASE WHEN confidence = 'unmapped' THEN 'unknown' ELSE coalesce(l.state, 'unknown') END AS work_type_status FROM pkg
  LEFT JOIN (SELECT package_id, {_arr(vocab.OUTCOME)}[min(list_position({_arr(vocab.OUTCOME)}, state))] AS worst FROM evc GROUP BY 1) w USING (package_id)
  LEFT JOIN ({LATEST.format(keys='package_id', ties='', rows='evc')}) l USING (package_id))"""


def _rolled(t: Tables):
    worst = asof.upto(t.evidence(), t.cutoff).groupBy("package_id").agg(vocab.worst(F.col("state"), vocab.OUTCOME).alias("currency_status"))
    newest = asof.latest(t.evidence(), ["package_id"], t.cutoff).select("package_id", F.col("state").alias("work_type_status"))
    return rollup.compose(t.packages(), {"currency_status": worst, "work_type_status": newest}, {"policy_run_id": F.lit(7)})


@query("rollup_compose", f"WITH {EVC}, {PKG}, {_ROLL} SELECT package_id, confidence, currency_status, work_type_status, 7 AS policy_run_id FROM roll")
def rollup_compose(t: Tables):
    return _rolled(t)


@query("rollup_upsert", f"WITH {EVC}, {PKG}, {_ROLL} SELECT package_id, CASE WHEN confidence = 'verified' THEN currency_status ELSE 'unknown' END AS currency_status, CASE WHEN confidence = 'verified' THEN 7 ELSE 6 END AS policy_run_id FROM roll")
def rollup_upsert(t: Tables):
    new = _rolled(t).where(F.col("confidence") == "verified").select("package_id", "currency_status", "policy_run_id")
    old = t.packages().select("package_id", F.lit("unknown").alias("currency_status"), F.lit(6).alias("policy_run_id"))
    return rollup.upsert(old, new)


@query("failed_packages_kept_out", f"WITH {EVC}, p AS (SELECT package_id, bool_or(state = 'error' AND id % 50 = 0) AS bad FROM evc GROUP BY 1) SELECT count(*) AS packages, count(*) FILTER (WHERE bad) AS failed, CASE WHEN count(*) FILTER (WHERE bad) = 0 THEN 'succeeded' WHEN count(*) FILTER (WHERE NOT bad) = 0 THEN 'failed' ELSE 'partial' END AS status FROM p")
def failed_packages_kept_out(t: Tables):
    bad = F.max((F.col("state") == "error") & (F.col("id") % 50 == 0))
    rows = asof.upto(t.evidence(), t.cutoff).groupBy("package_id").agg(F.when(bad, "failed").alias("error"))
    return rollup.ending(rows)


@query("choose_cutoff", f"WITH {EV}, b AS (SELECT min(observed_at) FILTER (WHERE state = 'unknown' AND observed_at > TIMESTAMP '2024-01-10') AS bound FROM ev) SELECT max(observed_at) AS cutoff FROM ev, b WHERE state <> 'unknown' AND (bound IS NULL OR observed_at <= bound)")
def choose_cutoff(t: Tables):
    ledger = t.evidence().select(F.col("observed_at").alias("started_at"), F.when((F.col("state") != "unknown") | (F.col("observed_at") <= F.lit("2024-01-10").cast("timestamp_ntz")), F.col("observed_at")).alias("finished_at"), "state")
    ledger = ledger.where((F.col("state") != "unknown") | F.col("finished_at").isNull())
    return rollup.evidence_cutoff(ledger)


_INV = "inv AS (SELECT package_id, id, observed_at, CASE WHEN id % 11 = 0 THEN 'error' WHEN state = 'not_found' OR state = 'unknown' THEN 'not_found' ELSE 'ok' END AS state, id % 400 AS components, CASE WHEN id % 3 <> 0 THEN id % 12 END AS lobs, 'k' || (id % 300) AS source_key FROM evc)"
_FOLD = """m AS (SELECT *, max(CASE WHEN state = 'ok' THEN (observed_at, id) END) OVER (PARTITION BY package_id) AS lo, max(CASE WHEN state = 'not_found' THEN (observed_at, id) END) OVER (PARTITION BY package_id) AS ln FROM inv),
fold AS (SELECT package_id, min(CASE WHEN state = 'not_found' AND (lo IS NULL OR (observed_at, id) > lo) THEN observed_at END) AS absent_since, max(CASE WHEN state = 'ok' THEN observed_at END) AS last_listed,
  min(CASE WHEN state = 'ok' AND ln IS NOT NULL AND (observed_at, id) > ln THEN observed_at END) AS listed_since FROM m GROUP BY package_id)"""


def inventory(t: Tables):
    state = F.when(F.col("id") % 11 == 0, "error").when(F.col("state").isin("not_found", "unknown"), "not_found").otherwise("ok")
    return t.evidence().select("package_id", "id", "observed_at", state.alias("state"), (F.col("id") % 400).alias("components"), F.when(F.col("id") % 3 != 0, F.col("id") % 12).alias("lobs"), F.concat(F.lit("k"), (F.col("id") % 300).cast("string")).alias("source_key"))


@query("presence_fold", f"WITH {EVC}, {_INV}, {_FOLD} SELECT * FROM fold")
def presence_fold(t: Tables):
    return presence.presence(inventory(t), t.cutoff)


@query("presence_breadth", f"WITH {EVC}, {_INV} SELECT package_id, components, lobs FROM ({LATEST.format(keys='package_id', ties='', rows='inv')})")
def presence_breadth(t: Tables):
    return presence.breadth(inventory(t), t.cutoff)


@query("absence_marking", f"WITH {EVC}, {PKG}, {_INV}, {_FOLD} SELECT pkg.package_id, CASE WHEN absent_since IS NOT NULL THEN absent_since END AS inventory_absent_since, CASE WHEN absent_since IS NOT NULL THEN last_listed END AS inventory_last_listed FROM pkg LEFT JOIN fold USING (package_id)")
def absence_marking(t: Tables):
    return presence.stamped(t.packages().select("package_id"), presence.presence(inventory(t), t.cutoff))


@query("absent_detection", f"WITH {EVC}, {_INV}, n AS (SELECT 'k' || i AS source_key FROM range(0, 150) r(i)), l AS ({LATEST.format(keys='package_id', ties='', rows='(SELECT * FROM inv WHERE source_key NOT IN (SELECT source_key FROM n))')}) SELECT package_id, source_key FROM l WHERE state = 'ok'")
def absent_detection(t: Tables):
    named = t.spark.range(150).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("source_key"))
    return presence.unnamed(inventory(t), named, t.cutoff)


@query("unresolved_selection", f"""WITH {EVC}, {PKG}, {_INV}, {_FOLD}, b AS (SELECT package_id, components, lobs FROM ({LATEST.format(keys='package_id', ties='', rows='inv')}))
SELECT pkg.package_id, components, lobs, confidence FROM pkg LEFT JOIN fold USING (package_id) LEFT JOIN b USING (package_id) WHERE confidence IS DISTINCT FROM 'verified' AND absent_since IS NULL""")
def unresolved_selection(t: Tables):
    rows = rollup.unresolved(t.packages(), presence.presence(inventory(t), t.cutoff), presence.breadth(inventory(t), t.cutoff))
    return rows.join(t.packages().select("package_id", "confidence"), "package_id")


@query("unresolved_all", f"""WITH {EVC}, {PKG}, {_INV}, {_FOLD}, b AS (SELECT package_id, components, lobs FROM ({LATEST.format(keys='package_id', ties='', rows='inv')}))
SELECT pkg.package_id, components, lobs FROM pkg LEFT JOIN fold USING (package_id) LEFT JOIN b USING (package_id) WHERE confidence IS DISTINCT FROM 'verified' AND absent_since IS NULL""")
def unresolved_all(t: Tables):
    return rollup.unresolved(t.packages(), presence.presence(inventory(t), t.cutoff), presence.breadth(inventory(t), t.cutoff))


@query("unresolved_left_out", f"WITH {EVC}, {PKG}, {_INV}, {_FOLD} SELECT count(*) AS left_out FROM pkg JOIN fold USING (package_id) WHERE confidence IS DISTINCT FROM 'verified' AND absent_since IS NOT NULL")
def unresolved_left_out(t: Tables):
    return rollup.unresolved_left_out(t.packages(), presence.presence(inventory(t), t.cutoff))


@query("pass_errors", f"""WITH {EVC}, s AS ({LATEST.format(keys='package_id, surface', ties=OK_FIRST, rows="(SELECT * EXCLUDE (state), CASE WHEN state = 'error' AND id % 5 = 0 THEN 'odd' ELSE state END AS state FROM evc)")}),
f AS ({LATEST.format(keys='package_id', ties='', rows='(SELECT * FROM evc WHERE surface = 2)')}), l AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY package_id ORDER BY observed_at DESC) AS r FROM evc) WHERE r = 1)
SELECT 'currency' AS pass, package_id, 'not a state: odd' AS error FROM s WHERE state = 'odd' GROUP BY 2 UNION ALL SELECT 'feedstock_presence', package_id, 'not a state: odd' FROM f WHERE state = 'error' AND id % 5 = 0
UNION ALL SELECT 'licence', package_id, max(CASE WHEN state = 'error' THEN 'not a state: odd' ELSE 'not a state: not_applicable' END) FROM l WHERE state = 'error' AND id % 5 = 0 OR state = 'not_applicable' GROUP BY 2 UNION ALL SELECT unnest(['vulnerability', 'remediation']), package_id, 'not a finding state: odd' FROM (SELECT DISTINCT package_id FROM l WHERE state = 'error' AND id % 5 = 0)""")
def pass_errors(t: Tables):
    """Packages that each pass can't judge, as a state isn't one."""
    odd = lambda ok: F.when((F.col("state") == "error") & (F.col("id") % 5 == 0), "odd").when(F.col("state") == "ok", ok).when(F.col("state") == "not_applicable", "unknown").otherwise(F.col("state"))
    packages, e = t.evidence().select("package_id").distinct(), t.evidence()
    found = e.withColumn("state", odd("matched")).withColumns({"nothing_matched": F.lit(True), "severity": F.lit("high"), "fixed_range": F.col("version")})
    kev = e.where("false").select("package_id", "id", "observed_at", "state", F.col("id").alias("finding_id"))
    rows = {
        "currency": passes.currency(packages, _surfaces(t).withColumn("state", odd("ok")), t.cutoff),
        "feedstock_presence": passes.feedstock_presence(packages, _feedstock(t).withColumn("state", odd("ok")), t.cutoff),
        "vulnerability": passes.vulnerability(packages, found, kev, t.cutoff, passes.RISK_ORDER),
        "licence": passes.licence(packages, e.select("package_id", "id", "observed_at", F.when(F.col("state") == "not_applicable", "not_applicable").otherwise(odd("normalized")).alias("state"), F.lit("MIT").alias("normalized_license")), t.cutoff, _RULES),
        "remediation": passes.remediation(packages, found, _surfaces(t), t.cutoff, {s: 14 for s in vocab.SURFACES}),
    }
    named = [r.where(F.col("error").isNotNull()).select(F.lit(name).alias("pass"), "package_id", "error") for name, r in rows.items()]
    return reduce(lambda a, b: a.unionByName(b), named)
