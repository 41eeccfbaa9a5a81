"""What to collect, what a collection writes, and what it need not ask again."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.text import project_name, purl_parts, repository
from assayer.operators.asof import FRESHNESS_DAYS, latest

# How often each collector is sent out, in days.
CADENCE_DAYS = {"source_release": 1, "pypi_release": 1, "feedstock": 7, "conda_package": 1, "vulnerability": 1, "kev": 1, "license": 1, "python_readiness": 7, "resolve_identity": 1}


def cadence_faults() -> list[str]:
    """Collectors whose freshness target doesn't outlast their cadence: must be empty."""
    return [c for c, days in CADENCE_DAYS.items() if FRESHNESS_DAYS[c] <= days]


COLLECTORS = ("source_release", "pypi_release", "feedstock", "conda_package", "vulnerability", "kev", "license", "python_readiness", "resolve_identity", "py314_verification")


def selections(packages: DataFrame, mappings: DataFrame, kev_declared: bool = True) -> DataFrame:
    """collector, package_id of all collectors."""
    return reduce(DataFrame.unionByName, [selected(packages, mappings, c, kev_declared).select(F.lit(c).alias("collector"), "package_id") for c in COLLECTORS])


def selected(packages: DataFrame, mappings: DataFrame, collector: str, kev_declared: bool = True) -> DataFrame:
    """package_id of what a collector covers; none for one that is only run on demand, or for the catalog's while no source is declared.

    packages: package_id, primary_purl, source_repository_url; for identities also
    confidence, identity_source, associator_key.  mappings: package_id, kind, outcome.
    """
    kinds = {"feedstock": "feedstock", "license": "conda_package", "conda_package": "conda_package"}
    if collector == "py314_verification" or (collector == "kev" and not kev_declared):
        return packages.limit(0).select("package_id")
    if collector in kinds:
        own = mappings.where((F.col("kind") == kinds[collector]) & (F.col("outcome") == "ok"))
        return packages.select("package_id").join(own.select("package_id").distinct(), "package_id", "left_semi")
    part = purl_parts(F.col("primary_purl"))
    conditions = {
        "source_release": repository(F.col("source_repository_url")).isNotNull(),
        "pypi_release": (part["type"] == "pypi") & project_name(part["name"]).isNotNull(),
        "python_readiness": (part["type"] == "pypi") & project_name(part["name"]).isNotNull(),
        "vulnerability": part["name"].isNotNull(),
        "resolve_identity": F.coalesce(F.col("confidence") != "verified", F.lit(True)) & (F.coalesce("identity_source", F.lit("")) != "") & (F.coalesce("associator_key", F.lit("")) != ""),
    }
    return packages.where(F.coalesce(conditions.get(collector, F.lit(True)), F.lit(False))).select("package_id")


def advisory_locator(purl: Column) -> Column:
    """What an advisory source is asked for; null where the purl can't be asked about."""
    p = purl_parts(purl)
    return F.when(p["name"].isNotNull(), F.concat(F.lit("pkg:"), p["type"], F.lit("/"), F.url_encode(p["name"])))


def sentinels(answers: DataFrame, facts: list[str]) -> DataFrame:
    """Evidence rows of answers that weren't read: the state, and none of the facts."""
    return answers.where(F.col("state").isin("error", "unknown", "not_found", "not_applicable")).select(*[F.lit(None).cast("string").alias(c) if c in facts else F.col(c) for c in [*(c for c in answers.columns if c not in facts), *facts]])


def replayed(answers: DataFrame, bodies: DataFrame, cutoff, lifetime: str | None = None) -> DataFrame:
    """Unmodified answers with the body that was last kept for their key, unless that is older than its lifetime."""
    kept = latest(bodies.where(F.col("body").isNotNull()), ["key"], cutoff)
    kept = kept if lifetime is None else kept.where(F.col("observed_at") >= F.lit(cutoff) - F.expr(f"INTERVAL {lifetime}"))
    kept = kept.select("key", F.col("body").alias("kept"))
    return answers.join(kept, "key", "left").withColumn("body", F.when(F.col("status_code") == 304, F.col("kept")).otherwise(F.col("body"))).drop("kept")


def ingested(records: DataFrame, packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names that need a package of their own, and a snapshot row for each sound record."""
    sound = records.where(F.col("fault").isNull())
    shells = sound.select(F.col("package_name").alias("canonical_name")).distinct().join(packages.select("canonical_name"), "canonical_name", "left_anti")
    return shells, sound.withColumn("state", F.lit("ok"))


def swept(records: DataFrame, packages: DataFrame) -> DataFrame:
    """How a sweep of inventory records ends: one row with observed, failed, shells and status; absences are only derived if something was observed."""
    shells, sound = ingested(records, packages)
    counts = records.agg(F.count_if(F.col("fault").isNull()).alias("observed"), F.count("fault").alias("failed")).crossJoin(shells.agg(F.count("*").alias("shells")))  # one row each
    status = F.when(F.col("failed") == 0, "succeeded").when(F.col("observed") == 0, "failed").otherwise("partial")
    return counts.select("observed", "failed", "shells", status.alias("status"), (F.col("observed") > 0).alias("derives_absences"))


def recollected(packages: DataFrame, selected: DataFrame, pending: DataFrame, in_flight: DataFrame, actor: str, at) -> DataFrame:
    """Request rows (package_id, actor, requested_at, collectors) for packages that a person asks for; refused says why one isn't published.

    selected: collector, package_id.  pending: package_id.  in_flight: package_id.
    """
    chosen = selected.groupBy("package_id").agg(F.array_sort(F.collect_set("collector")).alias("collectors"))  # one of each collector
    flag = lambda rows, name: rows.select("package_id").distinct().withColumn(name, F.lit(True))
    rows = packages.select("package_id").join(chosen, "package_id", "left").join(flag(pending, "waits"), "package_id", "left").join(flag(in_flight, "runs"), "package_id", "left")
    refused = F.when(F.col("runs"), "in flight").when(F.col("waits"), "pending").when(F.col("collectors").isNull(), "nothing to collect")
    return rows.select("package_id", F.lit(actor).alias("actor"), F.lit(at).alias("requested_at"), F.when(refused.isNull(), F.col("collectors")).alias("collectors"), refused.alias("refused"))


def pending(requests: DataFrame, ledger: DataFrame, now, hours: int) -> DataFrame:
    """package_id, request_id, waiting: the newest request of the window that still waits for a collector.

    requests: request_id, package_id, requested_at, collectors.
    """
    recent = requests.where(F.col("requested_at") >= F.lit(now) - F.expr(f"INTERVAL {hours} HOURS"))
    asked = recent.select("request_id", "package_id", "requested_at", F.explode("collectors").alias("collector"))
    done = ledger.where(F.col("finished_at").isNotNull()).groupBy("package_id", "collector").agg(F.max("finished_at").alias("done"))
    open_ = asked.join(done, ["package_id", "collector"], "left").where(F.col("done").isNull() | (F.col("done") < F.col("requested_at")))
    waiting = open_.groupBy("package_id", "request_id", "requested_at").agg(F.array_sort(F.collect_set("collector")).alias("w"))  # a request names few collectors
    best = waiting.groupBy("package_id").agg(F.max_by(F.struct("request_id", "w"), F.struct("requested_at", "request_id")).alias("b"))
    return best.select("package_id", "b.request_id", F.array_join("b.w", ",").alias("waiting"))


def retention_cutoff(now, days: int):
    if not 1 <= days <= 3650:
        raise ValueError("retention must be 1 to 3650 days")
    return now - timedelta(days=days)


def authority_fault(order: Column, surfaces=("source", "pypi", "feedstock", "conda_package")) -> Column:
    """What is wrong with an order of surfaces: unknown, repeated, or null."""
    known = F.array(*[F.lit(s) for s in surfaces])
    return F.when(F.size(F.array_except(order, known)) > 0, "unknown").when(F.size(F.array_distinct(order)) < F.size(order), "repeated")


def worst_seconds(timeout: float, retries: int, backoff: float) -> float:
    """The longest that a call with retries can take."""
    return timeout * (retries + 1) + sum(backoff * 2**i for i in range(retries))
