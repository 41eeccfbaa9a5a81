"""A policy run over evidence tables: passes, rollup, absence, work items; and its replay."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import vocab
from assayer.operators import asof, presence, replay, workflow
from assayer.operators.joined import beside
from assayer.plans import passes, rollup
from assayer.plans.registry import Context, Pass, Registry
from assayer.streaming.folders import scratch

#: Columns of the usage signals that weights name.
SIGNALS = {"internal_lob_count": "lobs", "internal_component_count": "components"}
# Days for which a surface's evidence stays fresh.
TARGETS = {"source": 2, "pypi": 2, "feedstock": 14, "conda_package": 2}

Keep = Callable[[str, DataFrame], DataFrame]


def _licence(c: Context) -> DataFrame:
    return passes.licence(c.packages, c.tables["licences"], c.cutoff, [(r["expression"], r["disposition"]) for r in c.parameters.get("license_rules", ())])


def _vulnerability(c: Context) -> DataFrame:
    return passes.vulnerability(c.packages, c.tables["current_findings"], c.tables["kev"], c.cutoff, list(c.parameters.get("vulnerability_risk_order", passes.RISK_ORDER)))


def _priority(c: Context) -> DataFrame:
    weights = dict(c.parameters.get("priority_score_weights") or {})
    if unknown := set(weights) - set(SIGNALS):
        raise ValueError(f"priority_score_weights: no such signal: {', '.join(sorted(unknown))}")
    every = c.verdicts()
    bucket = passes.priority(every, [(r["bucket"], dict(r["when"])) for r in c.parameters.get("priority_rules", ())])
    score = passes.score({SIGNALS[name]: w for name, w in weights.items()})
    broad = presence.breadth(c.tables["inventory"], c.cutoff)
    return beside(every, broad).select("package_id", bucket["bucket"].alias("bucket"), bucket["rule"].alias("matched_rule"), score.alias("score"))


def _work_type(c: Context) -> DataFrame:
    every = c.verdicts()
    return every.select("package_id", passes.work_type(every).alias("work_type"))


_DOMAINS = ("currency", "feedstock_presence", "vulnerability", "licence", "remediation", "python_readiness")
#: The passes of a run, and what follows it (below).
REGISTRY = Registry([
    Pass("currency", "overall_status", lambda c: passes.currency(c.packages, c.tables["current_surfaces"], c.cutoff), ("current_surfaces",), column="currency_status", domain="currency_status"),
    Pass("feedstock_presence", "presence_status", lambda c: passes.feedstock_presence(c.packages, c.tables["feedstock"], c.cutoff, c.parameters.get("feedstock_inactivity_days", 180)), ("feedstock",), column="feedstock_presence_status", domain="feedstock_presence_status"),
    Pass("vulnerability", "vulnerability_status", _vulnerability, ("current_findings", "kev"), domain="vulnerability_status"),
    Pass("licence", "license_outcome", _licence, ("licences",), domain="license_outcome"),
    Pass("remediation", "readiness_status", lambda c: passes.remediation(c.packages, c.tables["current_findings"], c.tables["current_surfaces"], c.cutoff, TARGETS), ("current_findings", "current_surfaces"), domain="remediation_readiness"),
    Pass("python_readiness", "readiness", lambda c: passes.python_readiness(c.packages, c.tables["assessments"], c.tables["verifications"], c.cutoff), ("assessments", "verifications"), domain="python_readiness"),
    Pass("work_type", "work_type", _work_type, needs=_DOMAINS, column="work_type_status"),
    Pass("priority", "bucket", _priority, ("inventory",), needs=_DOMAINS, column="priority_status"),
])


def stored(folder: str, run_id: int) -> Keep:
    """Writes each pass's rows once, under its name, and reads them back for whatever follows."""

    def keep(name: str, rows: DataFrame) -> DataFrame:
        path = f"{folder}/{name}/policy_run_id={run_id}"
        rows.write.mode("overwrite").parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    return keep


def _written_once(t: Mapping[str, DataFrame]) -> Keep:
    """Where no folder is given: each pass is written to the session's scratch folder, so that it is derived once, however many tables are returned."""
    spark = t["packages"].sparkSession
    return stored(f"{scratch(spark)}/run-{uuid.uuid4().hex}", 0)


#: Evidence of which several passes read the newest sweep: its key.
SWEPT = {"findings": ("package_id",), "surfaces": ("package_id", "surface")}


def derive(t: Mapping[str, DataFrame], cutoff, parameters: Mapping, keep: Keep | None = None, registry: Registry = REGISTRY) -> dict[str, DataFrame]:
    """Each registered pass's rows as of the cut-off, after those of the passes that it needs; and `verdicts`, those that later passes read.

    Tables: packages, surfaces (source_release to conda_package evidence in one, by
    surface), feedstock, findings, kev, licences, assessments, verifications, inventory,
    and what other passes read; of findings and surfaces the newest sweeps, which
    several passes read, are written once (current_findings, current_surfaces), and so
    are packages, spread by package_id: each pass judges them over all cores, however
    few row groups their table has.  A version without priority rules gives every package
    the bucket unknown, one without weights no score.
    """
    keep = keep or _written_once(t)
    out: dict[str, DataFrame] = {}
    ordered = registry.ordered()
    t = {**t, "packages": keep("packages", t["packages"].repartition("package_id"))}
    t = {**t, **{f"current_{name}": keep(f"current_{name}", asof.sweep(t[name], keys, cutoff)) for name, keys in SWEPT.items() if name in t and any(f"current_{name}" in p.reads for p in ordered)}}
    for p in ordered:
        if missing := [name for name in p.reads if name not in t]:
            raise ValueError(f"{p.name} reads {', '.join(missing)}")
        read = {n: v for n, v in registry.domains().items() if n in p.needs}
        out[p.name] = keep(p.name, p.derive(Context(t, cutoff, parameters, out, read)))
    out["verdicts"] = Context(t, cutoff, parameters, out, registry.domains()).verdicts()
    return out


def failures(packages: DataFrame, derived: Mapping[str, DataFrame]) -> DataFrame:
    """package_id, error: packages that a pass can't judge, or whose confidence isn't one."""
    odd = packages.select("package_id", F.when(~F.coalesce(F.col("confidence").isin(*vocab.CONFIDENCES), F.lit(False)), F.lit("not a confidence")).alias("error"))
    rows = reduce(DataFrame.unionByName, [odd, *(rows.select("package_id", "error") for rows in derived.values() if "error" in rows.columns)])
    return rows.where(F.col("error").isNotNull()).groupBy("package_id").agg(F.min("error").alias("error"))


def _absence(out: dict[str, DataFrame], t: Mapping[str, DataFrame]) -> DataFrame:
    return presence.stamped(out["health"], out["presence"])


def _new_items(out: dict[str, DataFrame], t: Mapping[str, DataFrame]) -> DataFrame:
    optional = lambda rows, *columns: [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]
    findings = t["findings"].select(F.col("id").alias("vulnerability_finding_id"), *optional(t["findings"], "advisory_id", "affected_range"))
    licences = t["licences"].select(F.col("id").alias("license_finding_id"), *optional(t["licences"], "normalized_license", "channel"))
    rows = beside(beside(t["packages"].select("package_id", "confidence"), out["health"].select("package_id"), how="left_semi"), out["presence"])
    rows = beside(rows, out["vulnerability"].select("package_id", "vulnerability_status"), out["licence"].select("package_id", "license_outcome"), how="inner")
    cited = lambda name, key, facts: beside(out[name].where(F.col(key).isNotNull()).select("package_id", key), facts, on=key)  # noqa: E731  packages that cite nothing would all meet in one task
    rows = beside(rows, cited("vulnerability", "vulnerability_finding_id", findings), cited("licence", "license_finding_id", licences))
    existing = t["items"] if "items" in t else rows.sparkSession.createDataFrame([], "finding_key string, package_id long, queue string, state string")
    return workflow.to_open(rows, existing)


def _closed_items(out: dict[str, DataFrame], t: Mapping[str, DataFrame]) -> DataFrame | None:
    return workflow.to_close(t["items"], out["presence"].where(F.col("absent_since").isNotNull())) if "items" in t else None


for _name, _step in (("health", _absence), ("new_items", _new_items), ("closed_items", _closed_items)):
    REGISTRY.after_run(_name, _step)


def execute(t: Mapping[str, DataFrame], cutoff, parameters: Mapping, run_id: int, version: str, keep: Keep | None = None, registry: Registry = REGISTRY) -> dict[str, DataFrame]:
    """derive's tables; failed (package_id, error) and ending (one row); health, one gated row with absence stamps for each package that didn't fail; rollup, these and the earlier rows of the others (table health); and what the after-run steps make.

    Each step reads what those before it left.
    """
    keep = keep or _written_once(t)
    out = derive(t, cutoff, parameters, keep, registry)
    out["failed"] = failures(t["packages"], out)
    out["ending"] = rollup.ending(beside(t["packages"].select("package_id"), out["failed"]))
    good = beside(t["packages"], out["failed"].select("package_id"), how="left_anti")
    verdicts = {column: out[name].select("package_id", F.col(registry.passes[name].verdict).alias(column)) for column, name in registry.owners().items()}
    out["presence"] = keep("presence", presence.presence(t["inventory"], cutoff))
    out["health"] = rollup.compose(good, verdicts, {"policy_run_id": F.lit(run_id).cast("long"), "policy_version": F.lit(version), "evidence_cutoff": F.lit(cutoff)})
    for name, step in registry.steps.items():
        if (rows := step(out, t)) is not None:
            out[name] = keep(name, rows) if name == "health" else rows  # the steps after it read it
    out["rollup"] = rollup.upsert(t["health"].select(*out["health"].columns), out["health"]) if "health" in t else out["health"]
    return out


def requested(parameters: Mapping[str, Mapping], version: str | None = None) -> tuple[str, Mapping]:
    """The version that a run applies (the newest, if none is asked for) and its parameters."""
    from assayer.sources.files import newest

    if version is not None and version not in parameters:
        raise ValueError(f"nothing is recorded for version {version}: {', '.join(sorted(parameters))}")
    chosen = newest(parameters) if version is None else version
    return chosen, parameters[chosen]


def compare(t: Mapping[str, DataFrame], cutoff, parameters: Mapping, recorded: Mapping[str, DataFrame], runs: DataFrame | None = None, registry: Registry = REGISTRY) -> dict[str, DataFrame]:
    """What a replay at the same cut-off and parameters makes different from the rows recorded; writes nothing.

    runs: recorded runs; a cut-off that none of them read at is refused.
    """
    if runs is not None:
        replay.require_run(runs, cutoff)
    again = derive(t, cutoff, parameters, registry=registry)
    return {name: replay.differences(rows, again[name], [c for c in rows.columns if c not in ("package_id", "id", "policy_run_id", "error")]) for name, rows in recorded.items()}


RUNS = "run_id bigint, policy_version string, evidence_cutoff timestamp_ntz, started_at timestamp_ntz, finished_at timestamp_ntz, status string, packages bigint, failed bigint, detail string"


class Recorded:
    """Policy runs in a folder: a row before the work, and one when it ends; each pass's rows and the health rows under the run.

    A run whose second row is missing was broken off: it counts as unfinished.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _append(self, row: dict) -> None:
        self.spark.createDataFrame([[row.get(c.split(" ")[0]) for c in RUNS.split(", ")]], RUNS).coalesce(1).write.mode("append").parquet(f"{self.folder}/runs")

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/runs")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def runs(self) -> DataFrame:
        """One row a run, running where it hasn't ended."""
        rows = self.spark.read.schema(RUNS).parquet(f"{self.folder}/runs") if self._exists() else self.spark.createDataFrame([], RUNS)
        last = F.max_by(F.struct(*[c.split(" ")[0] for c in RUNS.split(", ")[1:]]), F.col("finished_at").isNotNull())
        return rows.groupBy("run_id").agg(last.alias("r")).select("run_id", "r.*")

    def rows(self, name: str, run_id: int) -> DataFrame:
        """A pass's rows of a run."""
        return self.spark.read.parquet(f"{self.folder}/{name}/policy_run_id={run_id}")

    def run(self, t: Mapping[str, DataFrame], parameters: Mapping[str, Mapping], now: Callable[[], datetime], version: str | None = None, cutoff: datetime | None = None, registry: Registry = REGISTRY) -> int:
        """A policy run of a version (the newest, if none is asked for): its number.

        The cut-off is chosen from t's ledger, or one of a recorded run is given: a
        replay.  Fails before it leaves a row where there is no cut-off; a run that
        breaks off is recorded as failed, and the error goes on.
        """
        version, own = requested(parameters, version)
        if cutoff is None:
            cutoff = rollup.stated_cutoff(t["ledger"])
        run_id = (self.runs().agg(F.max("run_id")).first()[0] or 0) + 1
        row = {"run_id": run_id, "policy_version": version, "evidence_cutoff": cutoff, "started_at": now(), "status": "running"}
        self._append(row)
        try:
            keep = stored(self.folder, run_id)
            out = execute(t, F.lit(cutoff).cast("timestamp_ntz"), own, run_id, version, keep, registry)
            if "health" not in registry.steps:
                keep("health", out["health"])
            for name in registry.steps:
                if name in out and name != "health":
                    keep(name, out[name])
            ending = out["ending"].first()
        except Exception as e:
            self._append({**row, "finished_at": now(), "status": "failed", "detail": f"{type(e).__name__}: {e}"[:1024]})
            raise
        self._append({**row, "finished_at": now(), "status": ending["status"], "packages": ending["packages"], "failed": ending["failed"]})
        return run_id

    def replay(self, t: Mapping[str, DataFrame], parameters: Mapping[str, Mapping], run_id: int, registry: Registry = REGISTRY) -> dict[str, DataFrame]:
        """What a run's passes would write otherwise now, at its own version and cut-off; the rollup stays as it is."""
        held = self.runs().where(F.col("run_id") == run_id).first()
        if held is None or held["status"] == "running":
            raise ValueError(f"no finished run {run_id}")
        _, own = requested(parameters, held["policy_version"])
        recorded = {name: self.rows(name, run_id) for name in registry.passes}
        return compare(t, F.lit(held["evidence_cutoff"]).cast("timestamp_ntz"), own, recorded, self.runs(), registry)
