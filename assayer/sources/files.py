"""Watch lists, policy parameters, evidence tables and exports as files."""

from __future__ import annotations

import re
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.vocab import BUCKETS

WATCHLIST = ("source_package_key", "package_name", "internal_component_count", "internal_lob_count", "apps", "platforms", "downloads", "versions")
REQUIRED = WATCHLIST[:4]


def watchlist(spark: SparkSession, path: str) -> DataFrame:
    """A watch list's rows as text; the header must be exactly the columns, in order."""
    lines = spark.read.text(path)
    head = lines.limit(1).collect()
    if not head or head[0][0].strip() != ",".join(WATCHLIST):
        raise ValueError(f"{path}: the header is not {','.join(WATCHLIST)}")
    schema = ", ".join(f"{c} string" for c in WATCHLIST)
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def count(value: Column) -> Column:
    """A count of ASCII digits that fits 32 bits; null where blank or not one."""
    cut = F.trim(value)
    return F.when(cut.rlike("^[0-9]{1,18}$") & (cut.try_cast("long") <= 2147483647), cut.try_cast("int"))


def typed(rows: DataFrame) -> DataFrame:
    """Watch-list rows with counts, and fault: the first column that can't be taken as it stands."""
    text = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    fault = F
    for c in WATCHLIST:
        missing = text(F.col(c)).isNull()
        bad = F.lit(False) if c in WATCHLIST[:2] else ~missing & count(F.col(c)).isNull()
        fault = fault.when((missing if c in REQUIRED else F.lit(False)) | bad, c)
    return rows.select(*[text(F.col(c)).alias(c) if c in WATCHLIST[:2] else count(F.col(c)).alias(c) for c in WATCHLIST], fault.otherwise(None).alias("fault"))


def parameters(text: str) -> dict[str, dict]:
    """Policy parameters by version from TOML; each rule's position is its place in the file."""
    held = tomllib.loads(text)
    if set(held) != {"versions"} or not isinstance(held["versions"], dict) or not held["versions"]:
        raise ValueError("the only table is versions, and it must hold one at least")
    for version, p in held["versions"].items():
        if fault := _fault(version, p):
            raise ValueError(f"{version}: {fault}")
    return held["versions"]


#: What a version may hold, and what licence rules may say.
PARAMETERS = ("feedstock_inactivity_days", "license_rules", "vulnerability_risk_order", "priority_rules", "priority_score_weights")
DISPOSITIONS = ("allowed", "restricted", "forbidden", "manual_review")
RULE_DOMAINS = ("currency_status", "feedstock_presence_status", "vulnerability_status", "license_outcome", "remediation_readiness", "python_readiness")


def _fault(version: str, p: dict) -> str | None:
    """The first parameter of a version that can't be applied."""
    days, rules = p.get("feedstock_inactivity_days"), p.get("license_rules", [])
    order, ranked, weights = p.get("vulnerability_risk_order", ["high"]), p.get("priority_rules", []), p.get("priority_score_weights", {})
    text = lambda x: isinstance(x, str) and x.strip() == x != ""
    if not text(version):
        return "the version's name"
    if odd := set(p) - set(PARAMETERS):
        return f"no such parameter: {', '.join(sorted(odd))}"
    if type(days) is not int or not 0 < days <= 36_500:
        return "feedstock_inactivity_days"
    if not isinstance(rules, list) or any(not isinstance(r, dict) or set(r) != {"expression", "disposition"} or not text(r["expression"]) or r["disposition"] not in DISPOSITIONS for r in rules):
        return "license_rules"
    if len({r["expression"].lower() for r in rules}) < len(rules):
        return "license_rules: an expression stands twice"
    if not isinstance(order, list) or not order or any(not text(x) or x != x.lower() for x in order) or len(set(order)) < len(order):
        return "vulnerability_risk_order"
    if not isinstance(ranked, list) or any(not isinstance(r, dict) or r.get("bucket") not in BUCKETS or not isinstance(r.get("when"), dict) or not r["when"] or set(r["when"]) - set(RULE_DOMAINS) or not all(text(v) for v in r["when"].values()) for r in ranked):
        return "priority_rules"
    if not isinstance(weights, dict) or set(weights) - {"internal_lob_count", "internal_component_count"} or any(type(w) is not int or w < 0 for w in weights.values()):
        return "priority_score_weights"
    return None


def rules_of(spark: SparkSession, held: dict[str, dict]) -> DataFrame:
    """version, position, bucket, conditions of all priority rules, in their order."""
    rows = [(v, i + 1, r["bucket"], ",".join(f"{k}={r['when'][k]}" for k in sorted(r["when"]))) for v, p in held.items() for i, r in enumerate(p.get("priority_rules", ()))]
    return spark.createDataFrame(rows, "version string, position int, bucket string, conditions string")


def version_key(version: str) -> tuple:
    """Orders versions by their parts, numbers before text."""
    return tuple((0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.split(r"[.\-+_]", version))


def newest(versions) -> str:
    return max(versions, key=version_key)


def append_evidence(rows: DataFrame, path: str) -> None:
    """Appends a batch of evidence of one instant, in a folder for each day observed; never changes what is there."""
    seen = rows.agg(F.min("observed_at").alias("a"), F.max("observed_at").alias("b"), F.count_if(F.col("observed_at").isNull()).alias("none")).first()
    if seen["a"] != seen["b"] or seen["none"]:
        raise ValueError("a batch of evidence has one observed_at")
    rows.withColumn("observed_date", F.to_date("observed_at")).write.mode("append").partitionBy("observed_date").parquet(path)


def append_batches(rows: DataFrame, path: str, batch: str = "batch_id") -> None:
    """Appends many batches in one write, each of one instant, in a folder for each day observed; a batch of several instants is refused, and nothing is written."""
    torn = rows.groupBy(batch).agg(F.min("observed_at").alias("a"), F.max("observed_at").alias("b"), F.count_if(F.col("observed_at").isNull()).alias("none")).where((F.col("a") != F.col("b")) | (F.col("none") > 0))
    if not torn.isEmpty():
        raise ValueError("a batch of evidence has one observed_at")
    rows.drop(batch).withColumn("observed_date", F.to_date("observed_at")).write.mode("append").partitionBy("observed_date").parquet(path)


def bucketed(rows: DataFrame, table: str, keys: list[str], buckets: int, order: list[str] = []) -> DataFrame:  # noqa: B006
    """Writes evidence as a table of buckets by its keys, sorted inside: what reads newest rows or joins by these keys needs no shuffle.

    All tables that are read together have the same number of buckets.
    """
    rows.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys, *order).saveAsTable(table)
    return rows.sparkSession.table(table)


def write_derived(rows: DataFrame, path: str) -> None:
    """Writes a pass's rows, replacing those of the same run."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("policy_run_id").parquet(path)


def export_csv(rows: DataFrame, path: str, provenance: str, cap: int = 5_000) -> int:
    """Writes a report of at most `cap` rows as one CSV file, null as blank, the first line saying where it is from."""
    n = rows.limit(cap + 1).count()
    if n > cap:
        raise ValueError(f"more than {cap} rows: export in the background")
    cells = F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in rows.columns])
    head = rows.sparkSession.createDataFrame([(0, f"# {provenance}"), (1, ",".join(rows.columns))], "at int, value string")
    body = rows.select(F.lit(2).alias("at"), cells.alias("value"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)
    return n
