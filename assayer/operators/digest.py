"""Operators' digest: what collectors did in a window, and how fresh evidence is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.functions.text import span
from assayer.functions.vocab import RUN_STATES


def histogram(ledger: DataFrame, start, end, marker: str = "rate limit") -> DataFrame:
    """collector, a count for each state (0 where none), rate_limited: rows finished in [start, end)."""
    inside = ledger.where((F.col("finished_at") >= F.lit(start)) & (F.col("finished_at") < F.lit(end)))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in RUN_STATES]
    return inside.groupBy("collector").agg(*counts, F.count_if((F.col("status") == "failed") & F.col("detail").contains(marker)).alias("rate_limited"))


def freshness(selected: DataFrame, evidence: DataFrame, now, days: int) -> DataFrame:
    """One row: packages selected, past the target, and never observed."""
    newest = evidence.groupBy("package_id").agg(F.max("observed_at").alias("newest"))
    rows = selected.select("package_id").distinct().join(newest, "package_id", "left")
    past = F.col("newest") < F.lit(now) - F.expr(f"INTERVAL {days} DAYS")
    return rows.agg(F.count("*").alias("selected"), F.count_if(past).alias("past_target"), F.count_if(F.col("newest").isNull()).alias("never_observed"))


def changes(figures: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Figures that differ from the key's previous digest; a first one differs."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(order))
    first = F.row_number().over(W.partitionBy(*keys).orderBy(order)) == 1
    return figures.withColumn("changed", first | ~F.col(value).eqNullSafe(before))


def window_start(now, previous_end):
    """Where a digest's window begins: at the previous end if that is at most 48 hours ago, else 24 hours ago."""
    from datetime import timedelta

    return previous_end if previous_end is not None and now - previous_end <= timedelta(hours=48) else now - timedelta(hours=24)


def composed(scopes: DataFrame, counted: DataFrame, fresh: DataFrame) -> DataFrame:
    """collector, line: each registered collector's sentence, in the text that operators get.

    scopes: collector, target_days (null: none).  counted: histogram's rows.
    fresh: collector, past_target, never_observed.
    """
    rows = scopes.join(counted, "collector", "left").join(fresh, "collector", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    states = F.concat_ws(", ", *[F.when(F.coalesce(F.col(s), F.lit(0)) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {s}"))) for s in RUN_STATES])
    late = F.when(F.col("target_days").isNotNull() & F.col("past_target").isNotNull(), F.concat(number("past_target"), F.lit(" past the freshness target of "), span(F.col("target_days") * 86400), F.lit(", "), number("never_observed"), F.lit(" never observed")))
    return rows.select("collector", F.concat_ws("; ", F.concat(F.lit("collections "), F.when(states == "", "none").otherwise(states)), F.concat(number("rate_limited"), F.lit(" rate-limited")), late).alias("line"))


def _words(counts: list[tuple[str, Column]], none: str = "none") -> Column:
    """Counts over zero with their names, apart by commas."""
    said = F.concat_ws(", ", *[F.when(F.coalesce(n, F.lit(0)) > 0, F.concat(n.cast("string"), F.lit(f" {name}"))) for name, n in counts])
    return F.when(said == "", none).otherwise(said)


def standing(scopes: DataFrame, counted: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row, standing: what each collector still fails, is refused or is behind in, in the order of `position`; or that nothing stands."""
    rows = scopes.join(counted.select("collector", "failed", "rate_limited"), "collector", "left").join(fresh, "collector", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    failed = F.when(number("failed") > 0, F.concat(F.col("failed").cast("string"), F.lit(" failed collection"), F.when(F.col("failed") == 1, "").otherwise("s")))
    parts = [failed, *[F.when(number(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {said}"))) for c, said in (("rate_limited", "rate-limited"), ("past_target", "past target"), ("never_observed", "never observed"))]]
    said = rows.select("position", F.concat_ws(", ", *parts).alias("parts"), "collector").where(F.col("parts") != "")
    clause = F.array_sort(F.collect_list(F.struct("position", F.concat("collector", F.lit(" "), "parts").alias("clause"))))  # a collector each
    joined = F.array_join(F.transform(clause, lambda c: c["clause"]), "; ")
    return said.agg(F.when(F.count("*") > 0, joined).otherwise("nothing").alias("standing"))


def full_text(title: str, lines: DataFrame, scopes: DataFrame, overall: DataFrame, now, start, trace_id: str = "") -> DataFrame:
    """One row, text: the whole digest.

    lines: composed's rows.  overall: one row with a column for each state of prune
    runs (prune_*), ingested, absent, a count for each confidence, and of the newest
    finished policy run version, finished_at and status (null: none has finished).
    """
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm'Z'")
    placed = lines.join(scopes.select("collector", "position"), "collector").select(F.struct("position", F.concat(F.lit("  "), "collector", F.lit(": "), "line").alias("text")).alias("l"))
    body = placed.agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda l: l["text"]), "\n").alias("body"))  # a line for each collector
    kinds = ("verified",), ("inventory-derived", "unmapped")
    total = lambda names: sum((F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in names), F.lit(0))
    each = lambda names: F.concat_ws(", ", *[F.concat(F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("string"), F.lit(f" {c}")) for c in sorted(names)])
    packages = F.concat(total(kinds[0]).cast("string"), F.lit(" resolved ("), each(kinds[0]), F.lit("), "), total(kinds[1]).cast("string"), F.lit(" unresolved ("), each(kinds[1]), F.lit(")"))
    age = F.greatest(F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("finished_at").cast("timestamp")), F.lit(0))
    run = F.when(F.col("version").isNull(), "no policy run has finished").otherwise(F.concat(F.lit("version "), "version", F.lit(" finished "), stamp("finished_at"), F.lit(", "), span(age), F.lit(" ago, "), "status"))
    prune = _words([(s, F.col(f"prune_{s}")) for s in RUN_STATES])
    head = F.concat(F.lit(f"{title} "), F.date_format(F.lit(now), "yyyy-MM-dd"), F.lit("\nWindow: "), stamp(F.lit(start)), F.lit(" to "), stamp(F.lit(now)), F.lit(f"\nTrace: {trace_id or 'none'}\n\nCollectors"))
    text = F.concat_ws("\n", head, "body", F.lit("\nOverall"), F.concat(F.lit("  prune runs: "), prune), F.concat(F.lit("  inventory: "), F.col("ingested").cast("string"), F.lit(" ingested, "), F.col("absent").cast("string"), F.lit(" absent")), F.concat(F.lit("  packages: "), packages), F.concat(F.lit("  policy run: "), run))
    return overall.crossJoin(body).select(text.alias("text"))  # one row each


def unchanged_text(title: str, now, since, problems: DataFrame, trace_id: str = "") -> DataFrame:
    """One row, text: the digest of a day on which no figure moved since the digest of `since`, with what still stands."""
    day = lambda c: F.date_format(F.lit(c), "yyyy-MM-dd")
    return problems.select(F.concat(F.lit(f"{title} "), day(now), F.lit(" (unchanged)\nNothing changed since the digest of "), day(since), F.lit(" -- standing: "), "standing", F.lit(f"\nTrace: {trace_id or 'none'}")).alias("text"))


def history(digests: DataFrame, earlier: int = 30) -> DataFrame:
    """The newest digest and those before it, with their place (1: the newest)."""
    rows = digests.orderBy(F.desc("observed_at"), F.desc("id")).limit(earlier + 1)
    return rows.withColumn("place", F.row_number().over(W.orderBy(F.desc("observed_at"), F.desc("id"))))  # a month of rows
