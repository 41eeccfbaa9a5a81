"""What may be deleted without breaking the replay of a run that stays."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def purgeable_runs(runs: DataFrame, health: DataFrame, cutoff) -> DataFrame:
    """Runs that ended (or, unfinished, began) before the cut-off and that no health row shows."""
    old = F.coalesce("finished_at", "started_at") < F.lit(cutoff)
    return runs.where(old).join(health.select(F.col("policy_run_id").alias("run_id")).distinct(), "run_id", "left_anti")


def removable(evidence: DataFrame, keys: Sequence[str], surviving: DataFrame, cutoff) -> DataFrame:
    """Rows older than the cut-off, with a newer instant of their key, that no surviving run reads.

    A run reads the instant t if its own cut-off is in [t, the next instant).
    Instants are distinct, so rows at one instant stay or go together.  The runs'
    cut-offs meet each day that an interval spans, as an equality, so that no
    side needs to be broadcast; an interval's inner days only need to have a run.
    """
    keys = list(keys)
    instants = evidence.select(*keys, "observed_at").distinct()
    following = F.lead("observed_at").over(W.partitionBy(*keys).orderBy("observed_at"))
    spans = instants.withColumn("next", following).where(F.col("next").isNotNull() & (F.col("observed_at") < F.lit(cutoff)))
    cuts = surviving.select(F.col("evidence_cutoff").alias("c")).where(F.col("c").isNotNull()).distinct()
    day = lambda c: F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))
    by_day = cuts.groupBy(day(F.col("c")).alias("day")).agg(F.sort_array(F.collect_list("c")).alias("cs"))  # cut-offs of one day
    first, last = day(F.col("observed_at")), day(F.col("next"))
    bound = by_day.agg(F.sort_array(F.collect_list("day")).alias("days"))  # one row; a run a day for a century is 36 500 numbers
    spans = spans.crossJoin(F.broadcast(bound)).where(~F.exists("days", lambda d: (d > first) & (d < last))).drop("days")  # the others are read
    edges = spans.withColumn("day", F.explode(F.array_distinct(F.array(first, last))))
    inside = edges.join(by_day, "day").where(F.exists("cs", lambda c: (c >= F.col("observed_at")) & (c < F.col("next")))).select(*keys, "observed_at")
    free = spans.select(*keys, "observed_at").join(inside, [*keys, "observed_at"], "left_anti")
    return evidence.join(free, [*keys, "observed_at"], "left_semi")


def uncited(rows: DataFrame, citing: Sequence[DataFrame], column: str = "cited_id") -> DataFrame:
    """Rows that none of the citing tables names."""
    for table in citing:
        rows = rows.join(table.select(F.col(column).alias("id")).where(F.col("id").isNotNull()).distinct(), "id", "left_anti")
    return rows


def ledger_counts(ledger: DataFrame, cutoff) -> DataFrame:
    """One row: finished rows to delete, and unfinished ones that are stale."""
    return ledger.agg(
        F.count_if(F.col("finished_at") < F.lit(cutoff)).alias("deleted"),
        F.count_if(F.col("finished_at").isNull() & (F.col("started_at") < F.lit(cutoff))).alias("stale"),
        F.count_if(~F.coalesce(F.col("finished_at") < F.lit(cutoff), F.lit(False))).alias("kept"),
    )


def figures(evidence: DataFrame, gone: DataFrame, cutoff) -> DataFrame:
    """One row: how many rows are older than the cut-off, go, and are protected."""
    old = evidence.where(F.col("observed_at") < F.lit(cutoff)).agg(F.count("*").alias("older"))
    return old.crossJoin(gone.agg(F.count("*").alias("deleted"))).withColumn("protected", F.col("older") - F.col("deleted"))  # one row each


def survivors(evidence: DataFrame, gone: DataFrame) -> DataFrame:
    """The evidence without what goes: what a table is rewritten with."""
    return evidence.join(gone.select("id"), "id", "left_anti")


def apply(planned: Mapping[str, DataFrame], tables: Mapping[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Writes each planned table's survivors to a new folder, in the plan's order, and returns them; whoever asks puts them in the old ones' place."""
    out = {}
    for name, gone in planned.items():
        if name in tables:
            survivors(tables[name], gone).write.parquet(f"{folder}/{name}")
            out[name] = gone.sparkSession.read.schema(tables[name].schema).parquet(f"{folder}/{name}")
    return out


def rewritten(parts, gone: DataFrame) -> int:
    """Takes rows (id and the column that parts go by) out of a table of parts: reads and writes only parts that lose one; how many parts that were."""
    held = gone.select("id", F.col(parts.column).cast("string").alias("_part"))
    touched = [r["_part"] or "" for r in held.select("_part").distinct().collect()]  # a part for each day
    version, _ = parts.manifest()
    if touched:
        parts.rewrite(touched, survivors(parts.read(touched), gone), version)
    return len(touched)


def purged(planned: Mapping[str, DataFrame], stored: Mapping, order: Sequence[str]) -> dict[str, int]:
    """Applies a plan to stored tables of parts in the given order, citing tables first; how many parts of each were written anew.

    Each table's change is one manifest: broken off between two tables, what cites is
    gone before what it cites, and the same plan applied again does the rest.
    """
    return {name: rewritten(stored[name], planned[name]) for name in order if name in planned}


def moved_cutoffs(purges: DataFrame, tolerance: str = "1 DAY") -> DataFrame:
    """Purge runs (run_id, started_at, cutoff) whose cut-off isn't the one before it moved on by the time between them, within the tolerance."""
    order = W.orderBy("started_at", "run_id")  # a run a day: a small table
    rows = purges.withColumns({"was": F.lag("cutoff").over(order), "at": F.lag("started_at").over(order)})
    expected = F.col("was") + (F.col("started_at") - F.col("at"))
    allowed = F.expr(f"INTERVAL {tolerance}")
    return rows.where(F.col("was").isNotNull() & ((F.col("cutoff") > expected + allowed) | (F.col("cutoff") < expected - allowed))).select("run_id", "started_at", "cutoff", "was")


def plan(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], citing: Mapping[str, Sequence[DataFrame]], runs: DataFrame, health: DataFrame, ledger: DataFrame, cutoff) -> dict[str, DataFrame]:
    """What a purge deletes, in the order that it must: derived rows' runs, then evidence tables as given, then the ledger.

    A table's citing tables name rows by cited_id with the citing run's run_id
    (derived rows) or their own id (evidence of an earlier table): a citation
    counts while what makes it stays.
    """
    gone_runs = purgeable_runs(runs, health, cutoff)
    surviving = runs.join(gone_runs.select("run_id"), "run_id", "left_anti")
    out = {"runs": gone_runs}
    for name, rows in tables.items():
        free = removable(rows, keys[name], surviving, cutoff)
        holders = [c.join(surviving.select("run_id"), "run_id", "left_semi") if "run_id" in c.columns else c for c in citing.get(name, ())]
        out[name] = uncited(free, holders)
    out["ledger"] = ledger.where(F.col("finished_at") < F.lit(cutoff))
    return out
