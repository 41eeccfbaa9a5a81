"""What people read: listings, facets, reports, coverage, traces."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.functions import vocab
from assayer.functions.text import share
from assayer.functions.vocab import bucket_order

PAGE, MOST, REPORT_ROWS, EXPORT_ROWS = 50, 500, 200, 5_000
#: What a listing can be narrowed by: a derived table (none: health itself), its column, and the column's vocabulary.
FACETS = {
    "vuln": ("vulnerability", "vulnerability_status", (*vocab.SENTINELS, "advisories_matched", "no_advisory_matched")),
    "kev": ("vulnerability", "kev_membership", vocab.KEV),
    "confidence": (None, "confidence", vocab.CONFIDENCES),
    "priority": (None, "priority_status", (*vocab.SENTINELS, *vocab.BUCKETS)),
    "work": (None, "work_type_status", (*vocab.SENTINELS, *vocab.WORK)),
    "currency": (None, "currency_status", (*vocab.SENTINELS, "current", "behind")),
    "licence": ("licence", "license_outcome", (*vocab.SENTINELS, "allowed", "restricted", "forbidden", "manual_review")),
    "py314": ("python_readiness", "readiness", (*vocab.SENTINELS, *vocab.PYTHON)),
    "feedstock": (None, "feedstock_presence_status", (*vocab.SENTINELS, *vocab.FEEDSTOCK)),
}
#: Orders of a listing, the default first.
ORDERINGS = ("name", "rank")


def faceted(health: DataFrame, facets: Mapping[str, tuple[DataFrame | None, str, tuple[str, ...]]], chosen: Mapping[str, list[str]]) -> DataFrame:
    """Rows that every chosen facet admits.  A facet is a table (null: health itself), a column and its vocabulary.

    Facets that aren't known and blank values are ignored, but an unknown value
    is an error.  A facet of another table is a semi join on package and run.
    """
    for name, values in chosen.items():
        if name not in facets:
            continue
        table, column, vocabulary = facets[name]
        wanted = [v for v in values if v]
        if unknown := set(wanted) - set(vocabulary):
            raise ValueError(f"{name}: no such value: {', '.join(sorted(unknown))}")
        if not wanted:
            continue
        if table is None:
            health = health.where(F.col(column).isin(*wanted))
        else:
            health = health.join(table.where(F.col(column).isin(*wanted)).select("package_id", "policy_run_id"), ["package_id", "policy_run_id"], "left_semi")
    return health


def named(rows: DataFrame, term: str, column: str = "canonical_name") -> DataFrame:
    """Rows whose name holds the term, whatever its case; blank or overlong terms filter nothing."""
    term = term.strip().replace("_", "-").lower()
    return rows if not term or len(term) > 128 else rows.where(F.lower(column).contains(term))


def asked(health: DataFrame, derived: Mapping[str, DataFrame], params: Mapping[str, list[str]]) -> DataFrame:
    """Health rows that a query's facets and name search (`q`) select, before any exclusion."""
    facets = {name: (derived[table] if table else None, column, values) for name, (table, column, values) in FACETS.items()}
    return named(faceted(health, facets, params), next(iter(params.get("q", ())), ""))


def listing(health: DataFrame, derived: Mapping[str, DataFrame], params: Mapping[str, list[str]], sort: str = "") -> DataFrame:
    """The health listing of a query, in order, with each row's score at its own run.

    Asking for packages without a feedstock leaves out those that the inventory
    doesn't list.  An order that isn't known is the first one.
    """
    rows = asked(health, derived, params)
    if "absent" in params.get("feedstock", ()):
        rows = rows.where(F.col("inventory_absent_since").isNull())
    rows = rows.join(derived["priority"].select("package_id", "policy_run_id", "score"), ["package_id", "policy_run_id"], "left")
    return ranked(rows.withColumn("bucket", F.col("priority_status"))).drop("bucket") if sort == "rank" else rows.orderBy("canonical_name", "package_id")


def feedstock_gap(health: DataFrame, derived: Mapping[str, DataFrame], params: Mapping[str, list[str]]) -> DataFrame | None:
    """One row: what asking for packages without a feedstock left out, and how many unmapped ones the facet can't tell; None for other queries."""
    if "absent" not in params.get("feedstock", ()):
        return None
    gone = asked(health, derived, params).agg(F.count("inventory_absent_since").alias("absent_from_inventory"))
    rest = asked(health, derived, {k: v for k, v in params.items() if k != "feedstock"})
    return gone.crossJoin(rest.agg(F.count_if(F.col("confidence") == "unmapped").alias("unmapped")))  # one row each


def ranked(rows: DataFrame) -> DataFrame:
    """By bucket, then score (none first, as the reports' store sorts), then package."""
    return rows.orderBy(bucket_order(F.col("bucket")), F.desc_nulls_first("score"), "package_id")


def globally_ranked(rows: DataFrame) -> DataFrame:
    """By the bucket's text, then score (none first), then package."""
    return rows.orderBy("bucket", F.desc_nulls_first("score"), "package_id")


def inventory_page(entries: DataFrame, active_only: bool = False, prefix: str = "") -> DataFrame:
    """Inventory entries by key: only those not retired, and only keys that begin with the prefix, case and all."""
    rows = entries.where(F.col("retired_at").isNull()) if active_only else entries
    return (rows.where(F.col("source_package_key").startswith(prefix)) if prefix else rows).orderBy("source_package_key")


def recent(rows: DataFrame, at: str, n: int = 20) -> DataFrame:
    """The newest n rows of all."""
    return rows.orderBy(F.desc(at), F.desc("id")).limit(n)


def work_history(moves: DataFrame, items: DataFrame, n: int = 20) -> DataFrame:
    """Of each package the newest moves of its items: n for each item, counted over all of them together.

    moves: id, item_id, occurred_at.  items: item_id, package_id.
    """
    size = items.groupBy("package_id").agg((F.count("*") * n).alias("most"))
    at = F.row_number().over(W.partitionBy("package_id").orderBy(F.desc("occurred_at"), F.desc("id")))
    rows = moves.join(items.select("item_id", "package_id"), "item_id").withColumn("place", at)
    return rows.join(size, "package_id").where(F.col("place") <= F.col("most")).drop("most")


def identity(packages: DataFrame, overrides: DataFrame, mappings: DataFrame) -> DataFrame:
    """Packages with the newest override that a person made, and all mappings, the newest first.

    overrides: id, package_id, observed_at, actor, reason.  mappings: id, package_id, resolved_at, kind, outcome.
    """
    newest = overrides.groupBy("package_id").agg(F.max_by(F.struct("id", "actor", "reason"), F.struct("observed_at", "id")).alias("override"))
    held = mappings.groupBy("package_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("resolved_at", "id", "kind", "outcome")))).alias("mappings"))  # a package has few
    return packages.join(newest, "package_id", "left").join(held, "package_id", "left")


def page(rows: DataFrame, number: int = 1, size: int = PAGE) -> DataFrame:
    """A page of ordered rows."""
    size = min(size, MOST)
    return rows.offset((max(number, 1) - 1) * size).limit(size)


def placed(rows: DataFrame, folder: str) -> DataFrame:
    """Ordered rows with their place, from 1: each sorted partition counts its own rows, and starts after those before it.

    The rows are written to the folder once, so that counts and rows are of one order.
    """
    marked = rows.withColumn("_at", F.monotonically_increasing_id())  # partition and place in it
    marked.write.parquet(folder)
    held = rows.sparkSession.read.schema(marked.schema).parquet(folder)
    part = F.shiftright("_at", 33)
    before, starts = 0, []
    for r in held.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect():  # a row for each partition
        starts.append((r["_part"], before))
        before += r["n"]
    first = rows.sparkSession.createDataFrame(starts, "_part long, _first long")
    own = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return held.join(F.broadcast(first), F.col("_part") == part).select(*rows.columns, (F.col("_first") + own + 1).alias("place"))


def excluded(cond: Column) -> Column:
    """The negation that keeps rows where the condition is null."""
    return ~F.coalesce(cond, F.lit(False))


def report(health: DataFrame, derived: DataFrame, cond: Column, columns: list[str], current_run_only: bool = False) -> DataFrame:
    """Distinct rows of packages with a derived row that holds; unless told otherwise, of any run."""
    keys = ["package_id", "policy_run_id"] if current_run_only else ["package_id"]
    right = derived.where(cond)
    right = right if current_run_only else right.drop("policy_run_id")
    return health.join(right, keys).select(*columns).distinct()


def versions(health: DataFrame, column: str = "policy_versions") -> DataFrame:
    """One row: the distinct pass@version pairs of all rows, sorted and joined."""
    pair = health.select(F.explode(column).alias("k", "v")).select(F.concat("k", F.lit("@"), "v").alias("p")).distinct()
    return pair.agg(F.array_join(F.array_sort(F.collect_set("p")), ", ").alias("versions"))  # passes times versions: small


#: States that are no verdict, and those that are a negative one.
GAPS, NEGATIVE = ("unknown", "error"), ("not_found", "not_applicable")


def coverage(health: DataFrame, statuses: Sequence[str], stamps: Sequence[str] = ()) -> DataFrame:
    """One row: packages, and for each status how many have no verdict and how many a negative one, with the gap's share; the newest of each stamp."""
    whole = F.count("*")
    out = [whole.alias("packages")]
    for column in statuses:
        gap, bad = F.count_if(F.col(column).isin(*GAPS)), F.count_if(F.col(column).isin(*NEGATIVE))
        out += [gap.alias(f"{column}_unknown"), bad.alias(f"{column}_negative"), share(gap, whole).alias(f"{column}_share")]
    return health.agg(*out, *[F.max(c).alias(c) for c in stamps])


def collector_health(ledger: DataFrame, collectors: list[str]) -> DataFrame:
    """collector, runs, failed, newest, status: a row for each registered one, run or not."""
    spark = ledger.sparkSession
    found = ledger.groupBy("collector").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "failed").alias("failed"), F.max("finished_at").alias("newest"))
    every = spark.createDataFrame([(c,) for c in collectors], "collector string")
    out = every.join(found, "collector", "left").fillna(0, ["runs", "failed"])
    return out.withColumn("status", F.when(F.col("runs") == 0, "never_run").when(F.col("failed") > 0, "failing").otherwise("ok"))


def traced(history: DataFrame, cited: DataFrame) -> DataFrame:
    """History rows (package_id, id) with whether the package's derived row cites them."""
    return history.join(cited.select("package_id", F.col("id"), F.lit(True).alias("c")), ["package_id", "id"], "left").withColumn("cited", F.coalesce("c", F.lit(False))).drop("c")


# What a status says instead of a table where it rests on no observation.
NOT_EVALUATED, NOT_CITED, FROM_VERDICTS = "no evaluation recorded at this run", "no observation cited at this run", "derived from other verdicts, not from an observation"
#: Observations that a trace shows.
HISTORY = 20


def trace(health: DataFrame, derived: DataFrame, status: str, cited: Column | None = None, history: DataFrame | None = None, table: str = "", detail: str | None = None, n: int = HISTORY) -> DataFrame:
    """package_id, status (gated), produced_from, detail, observation_count, observations: one status of each health row and the evidence behind it.

    derived: a pass's rows (package_id, policy_run_id, the status, detail); cited: the id
    of the row that it rests on (None: it rests on other verdicts).  history: that
    row's table (package_id, id, observed_at, state).  The newest n rows come, each
    with whether it is the cited one, and how many there are in all.
    """
    own = derived.select("package_id", "policy_run_id", F.col(status).alias("_status"), (F.lit(None).cast("long") if cited is None else cited).alias("_cited"), (F.lit("") if detail is None else F.coalesce(F.col(detail), F.lit(""))).alias("_detail"), F.lit(True).alias("_there"))
    rows = health.select("package_id", "policy_run_id", "confidence").join(own, ["package_id", "policy_run_id"], "left")
    shown = vocab.gated(F.coalesce("_status", F.lit("unknown")), F.col("confidence"))
    source = F.when(F.col("_there").isNull(), NOT_EVALUATED).when(F.col("_cited").isNotNull(), table).otherwise(FROM_VERDICTS if cited is None else NOT_CITED)
    rows = rows.select("package_id", F.when(F.col("_there").isNull(), "unknown").otherwise(shown).alias("status"), source.alias("produced_from"), F.coalesce("_detail", F.lit("")).alias("detail"), "_cited")
    if history is None or cited is None:
        return rows.select("package_id", "status", "produced_from", "detail", F.lit(0).cast("long").alias("observation_count"), F.array().cast("array<struct<observed_at: timestamp_ntz, id: bigint, state: string, cited: boolean>>").alias("observations"))
    place = F.row_number().over(W.partitionBy("package_id").orderBy(F.desc("observed_at"), F.desc("id")))
    newest = history.select("package_id", "id", "observed_at", "state").withColumn("_place", place).where(F.col("_place") <= n)
    listed = newest.groupBy("package_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("observed_at", "id", "state")))).alias("_rows"))  # n at most
    counts = history.groupBy("package_id").agg(F.count("*").alias("_n"))
    out = rows.join(listed, "package_id", "left").join(counts, "package_id", "left")
    has = F.col("_cited").isNotNull()
    seen = F.transform("_rows", lambda r: F.struct(r["observed_at"].alias("observed_at"), r["id"].alias("id"), r["state"].alias("state"), (r["id"] == F.col("_cited")).alias("cited")))
    none = F.array().cast(newest.select(F.array(F.struct("observed_at", "id", "state", F.lit(True).alias("cited"))).alias("x")).schema["x"].dataType)
    return out.select("package_id", "status", "produced_from", "detail", F.when(has, F.coalesce("_n", F.lit(0))).otherwise(0).cast("long").alias("observation_count"), F.when(has & F.col("_rows").isNotNull(), seen).otherwise(none).alias("observations"))


def over(rows: DataFrame, cap: int = EXPORT_ROWS) -> bool:
    """Whether an export would pass the cap; reads no more than it must."""
    return rows.limit(cap + 1).count() > cap
