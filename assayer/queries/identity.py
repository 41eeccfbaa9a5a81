"""What packages are: what documents establish, how it is recorded, and people's corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.adapters import CUTOFF, Tables, query
from assayer.operators import identity

#: customer as packages, most of them looked up in two documents.
_IDS = f"""ids AS (SELECT c_custkey AS k, replace(c_name, '#', '-') AS n, CASE WHEN c_nationkey % 3 = 0 THEN 'verified' ELSE 'unmapped' END AS was, c_custkey % 7 <> 0 AS asked, c_custkey % 7 <> 0 AND c_custkey % 4 = 0 AS found,
  CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 12 = 0 THEN 'https://github.com/o/r' || c_custkey ELSE '' END AS url, c_custkey % 5 = 0 AS listed, c_custkey % 5 = 0 OR c_custkey % 6 = 0 AS builds,
  CASE WHEN c_custkey % 2 = 0 THEN 'pkg:pypi/stored' ELSE '' END AS hp, CASE WHEN c_custkey % 3 = 1 THEN 'https://github.com/s/' || c_custkey ELSE '' END AS hu FROM customer),
res AS (SELECT *, CASE WHEN asked THEN url ELSE hu END AS u, CASE WHEN found THEN 'pkg:pypi/' || lower(n) WHEN asked THEN '' ELSE hp END AS p, CASE WHEN builds THEN 'pkg:conda/' || lower(n) ELSE '' END AS c FROM ids WHERE k % 11 <> 0),
out AS (SELECT *, CASE WHEN u <> '' OR found OR builds THEN 'inventory-derived' ELSE 'unmapped' END AS conf, CASE WHEN u <> '' THEN 'established' WHEN asked THEN 'not_found' ELSE 'error' END AS so,
  CASE WHEN p <> '' THEN 'established' WHEN asked THEN 'not_found' ELSE 'error' END AS ro, CASE WHEN builds THEN 'established' ELSE 'not_found' END AS fo FROM res)"""


def _packages(t: Tables):
    k = F.col("c_custkey")
    return t.customer.select(
        k.alias("package_id"),
        F.replace("c_name", F.lit("#"), F.lit("-")).alias("canonical_name"),
        F.when(F.col("c_nationkey") % 3 == 0, "verified").otherwise("unmapped").alias("confidence"),
        F.when(k % 3 == 1, F.concat(F.lit("https://github.com/s/"), k.cast("string"))).otherwise("").alias("source_repository_url"),
        F.when(k % 2 == 0, "pkg:pypi/stored").otherwise("").alias("primary_purl"),
        F.when(k % 2 == 0, "pypi").otherwise("").alias("primary_type"),
        F.lit("").alias("conda_purl"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("resolved_at"),
    )


def _resolutions(t: Tables):
    k, text = F.col("package_id"), F.col("package_id").cast("string")
    held = lambda there: F.when(there, "established").otherwise("not_found")
    return identity.resolution(
        _packages(t).where(k % 11 != 0).select(
            "package_id", "canonical_name", "source_repository_url", "primary_purl", "primary_type",
            held(k % 3 == 1).alias("source_outcome"), held(k % 2 == 0).alias("release_outcome"), (k % 6 == 0).alias("has_feedstocks"),
            F.when(k % 5 == 0, F.array(F.concat(F.lit("f"), text), F.concat(F.lit("g"), text, F.lit("-feedstock")))).alias("feedstocks"),
            (k % 7 != 0).alias("asked"), (k % 4 == 0).alias("found"),
            F.when(k % 12 == 0, F.concat(F.lit("https://github.com/o/r"), text)).alias("repository_url"),
        )
    )


@query("identity_facts", f"""WITH {_IDS} SELECT k AS package_id, conf AS confidence, so AS source_repository_outcome, ro AS release_ecosystem_outcome, fo AS feedstock_outcome, u AS source_repository_url, p AS primary_purl, c AS conda_purl,
  concat_ws('; ', CASE WHEN NOT asked THEN 'the project index could not be asked' WHEN NOT found THEN 'the project index has no such project' WHEN url = '' THEN 'the project names no repository that can be read' END,
    CASE WHEN NOT asked AND (hu <> '' OR hp <> '') THEN 'what was established before is kept' END, CASE WHEN NOT listed AND builds THEN 'the feedstock index lists none, recorded ones are kept' WHEN NOT listed THEN 'the feedstock index lists none' END) AS detail FROM out""")
def identity_facts(t: Tables):
    return _resolutions(t).select("package_id", "confidence", "source_repository_outcome", "release_ecosystem_outcome", "feedstock_outcome", "source_repository_url", "primary_purl", "conda_purl", "detail")


@query("identity_resolution", f"""WITH {_IDS}, w AS (SELECT ids.k, ids.was, ids.was = 'verified' AND out.k IS NOT NULL AS refused, CASE WHEN out.k IS NULL OR ids.was = 'verified' THEN ids.was ELSE conf END AS confidence,
  ids.hu, ids.hp, CASE WHEN so = 'established' THEN u ELSE ids.hu END AS u, CASE WHEN ro = 'established' THEN p ELSE ids.hp END AS p, CASE WHEN fo = 'established' THEN c ELSE '' END AS c FROM ids LEFT JOIN out ON out.k = ids.k)
SELECT k AS package_id, confidence, u AS source_repository_url, p AS primary_purl, CASE WHEN p <> '' THEN 'pypi' ELSE '' END AS primary_type, c AS conda_purl, refused AS downgrade_refused,
  CASE WHEN confidence <> was OR u <> hu OR p <> hp OR c <> '' THEN TIMESTAMP '{CUTOFF}' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS resolved_at FROM w""")
def identity_resolution(t: Tables):
    return identity.recorded(_packages(t), _resolutions(t), t.cutoff).drop("canonical_name")


@query("identity_mappings", f"""WITH {_IDS} SELECT k AS package_id, unnest(['source_repository', 'release_ecosystem', 'conda_artifact', 'feedstock', 'cross_ecosystem']) AS kind, unnest([so, ro, fo, fo, 'not_found']) AS outcome, TIMESTAMP '{CUTOFF}' AS resolved_at FROM out
UNION ALL SELECT k, 'feedstock', 'unknown', TIMESTAMP '2024-01-01 00:00:00' FROM ids WHERE k % 11 = 0""")
def identity_mappings(t: Tables):
    held = _packages(t).select("package_id", F.lit("feedstock").alias("kind"), F.lit("unknown").alias("outcome"), "resolved_at")
    return identity.mappings(held, _resolutions(t), t.cutoff)


@query("identity_feedstocks", f"""WITH {_IDS}, new AS (SELECT k, unnest(['f' || k || '-feedstock', 'g' || k || '-feedstock']) AS name FROM out WHERE listed)
SELECT k AS package_id, name, 'https://github.com/conda-forge/' || name AS url FROM new UNION ALL SELECT k, 'f' || k || '-feedstock', 'old' FROM ids WHERE k % 6 = 0 AND (k, 'f' || k || '-feedstock') NOT IN (SELECT (k, name) FROM new)""")
def identity_feedstocks(t: Tables):
    k = F.col("package_id")
    held = _packages(t).where(k % 6 == 0).select("package_id", F.concat(F.lit("f"), k.cast("string"), F.lit("-feedstock")).alias("name"), F.lit("old").alias("url"))
    return identity.feedstocks(held, _resolutions(t))


_OVERRIDES = f"""pk AS (SELECT c_custkey AS package_id, c_name AS canonical_name, c_mktsegment AS display_name, CASE WHEN c_nationkey % 3 = 0 THEN 'verified' ELSE 'unmapped' END AS confidence, TIMESTAMP '2024-01-01 00:00:00' AS resolved_at FROM customer),
asked AS (SELECT o_orderkey AS correction_id, CASE WHEN o_orderkey % 13 = 0 THEN -1 ELSE o_custkey END AS package_id, o_orderkey % 9 <> 0 AS permitted, CASE WHEN o_orderkey % 10 = 0 THEN ' ' ELSE 'r' END AS reason,
  CASE o_orderkey % 4 WHEN 0 THEN 'name' || (o_orderkey % 400) WHEN 2 THEN 'Customer#00000000' || (o_orderkey % 10) WHEN 3 THEN 'fresh' || o_orderkey END AS wanted, CASE o_orderkey % 3 WHEN 1 THEN '' WHEN 2 THEN 'shown' || o_orderkey END AS shown, CAST(o_orderdate AS TIMESTAMP) AS decided_at FROM orders),
faults AS (SELECT a.*, CASE WHEN NOT permitted THEN 'not permitted' WHEN trim(reason) = '' THEN 'no reason' WHEN p.package_id IS NULL THEN 'no such package' WHEN h.package_id <> a.package_id THEN 'name taken' END AS fault
  FROM asked a LEFT JOIN pk p ON p.package_id = a.package_id LEFT JOIN pk h ON h.canonical_name = a.wanted),
claims AS (SELECT wanted, arg_min(package_id, (decided_at, correction_id)) AS claimant FROM faults WHERE fault IS NULL AND wanted IS NOT NULL GROUP BY 1),
judged AS (SELECT f.* EXCLUDE (fault), coalesce(fault, CASE WHEN claimant <> f.package_id THEN 'name taken' END) AS refused FROM faults f LEFT JOIN claims c ON c.wanted = f.wanted),
made AS (SELECT j.*, p.canonical_name, p.display_name, p.confidence, coalesce(last_value(wanted IGNORE NULLS) OVER w, p.canonical_name) AS new_name, coalesce(last_value(shown IGNORE NULLS) OVER w, p.display_name) AS new_shown, row_number() OVER w AS turn
  FROM judged j JOIN pk p ON p.package_id = j.package_id WHERE refused IS NULL WINDOW w AS (PARTITION BY j.package_id ORDER BY decided_at, correction_id ROWS UNBOUNDED PRECEDING)),
audit AS (SELECT *, CASE WHEN turn = 1 THEN canonical_name ELSE lag(new_name) OVER v END AS prior_name, CASE WHEN turn = 1 THEN display_name ELSE lag(new_shown) OVER v END AS prior_shown, CASE WHEN turn = 1 THEN confidence ELSE 'verified' END AS prior_confidence
  FROM made WINDOW v AS (PARTITION BY package_id ORDER BY turn))"""


def _corrections(t: Tables):
    k = F.col("c_custkey")
    packages = t.customer.select(k.alias("package_id"), F.col("c_name").alias("canonical_name"), F.col("c_mktsegment").alias("display_name"), F.when(F.col("c_nationkey") % 3 == 0, "verified").otherwise("unmapped").alias("confidence"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("resolved_at"))
    o = F.col("o_orderkey")
    joined = lambda head, n: F.concat(F.lit(head), n.cast("string"))
    corrections = t.orders.select(
        o.alias("correction_id"),
        F.when(o % 13 == 0, -1).otherwise(F.col("o_custkey")).alias("package_id"),
        F.lit("u1").alias("actor"),
        (o % 9 != 0).alias("permitted"),
        F.when(o % 10 == 0, " ").otherwise("r").alias("reason"),
        F.when(o % 4 == 0, joined("name", o % 400)).when(o % 4 == 2, joined("Customer#00000000", o % 10)).when(o % 4 == 3, joined(" fresh", o)).otherwise("").alias("canonical_name"),
        F.when(o % 3 == 1, "").when(o % 3 == 2, joined("shown", o)).alias("display_name"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("decided_at"),
    )
    return identity.corrected(packages, corrections)


@query("identity_override", f"""WITH {_OVERRIDES}, last AS (SELECT package_id, arg_max(new_name, turn) AS n, arg_max(new_shown, turn) AS s, max(decided_at) FILTER (WHERE new_name <> prior_name OR new_shown <> prior_shown OR prior_confidence <> 'verified') AS moved FROM audit GROUP BY 1)
SELECT pk.package_id, coalesce(n, canonical_name) AS canonical_name, CASE WHEN last.package_id IS NULL THEN display_name ELSE s END AS display_name, CASE WHEN last.package_id IS NULL THEN confidence ELSE 'verified' END AS confidence, greatest(resolved_at, moved) AS resolved_at FROM pk LEFT JOIN last USING (package_id)""")
def identity_override(t: Tables):
    return _corrections(t)[0]


@query("identity_override_audit", f"""WITH {_OVERRIDES} SELECT correction_id, package_id, 'u1' AS actor, reason, decided_at AS observed_at, prior_name AS prior_canonical_name, new_name AS new_canonical_name, prior_shown AS prior_display_name, new_shown AS new_display_name, prior_confidence, 'verified' AS new_confidence FROM audit""")
def identity_override_audit(t: Tables):
    return _corrections(t)[1]


@query("identity_override_refused", f"WITH {_OVERRIDES} SELECT correction_id, package_id, refused FROM judged WHERE refused IS NOT NULL")
def identity_override_refused(t: Tables):
    return _corrections(t)[2]
