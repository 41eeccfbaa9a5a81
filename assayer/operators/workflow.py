"""Work items: opening, closing, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.functions.text import finding_key, iso
from assayer.functions.vocab import bucket_order
from assayer.operators.joined import beside

TERMINAL = ("resolved", "accepted")
ANY_ROLE = ("security_reviewer", "packaging_engineer", "leadership")
# The moves that a person may make, who may, and whether a reason must be given.
TRANSITIONS = (
    ("open", "triaged", ANY_ROLE, False),
    ("triaged", "routed", ANY_ROLE, False),
    ("triaged", "in_progress", ANY_ROLE, False),
    ("routed", "in_progress", ANY_ROLE, False),
    ("in_progress", "resolved", ANY_ROLE, False),
    ("in_progress", "triaged", ANY_ROLE, False),
    ("triaged", "accepted", ("security_reviewer",), True),
)


def transition_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b, list(r), j) for a, b, r, j in TRANSITIONS], "from_state string, to_state string, roles array<string>, needs_reason boolean")


def judged(requests: DataFrame, items: DataFrame) -> DataFrame:
    """Requests (item_id, expected_state, to_state, role, justification) with the answer: applied, or why not."""
    table = F.broadcast(transition_table(requests.sparkSession))  # seven rows
    rows = requests.join(items.select("item_id", "state"), "item_id", "left").join(table.withColumnRenamed("from_state", "state"), ["state", "to_state"], "left")
    answer = (
        F.when(F.col("state").isNull(), "no such item")
        .when(F.col("state") != F.col("expected_state"), "stale")
        .when(F.col("roles").isNull(), "undeclared")
        .when(~F.array_contains("roles", F.col("role")), "role")
        .when(F.col("needs_reason") & (F.trim(F.coalesce("justification", F.lit(""))) == ""), "justification")
        .otherwise("applied")
    )
    return rows.select(*requests.columns, answer.alias("answer"))


def in_order(requests: DataFrame, items: DataFrame, chunk: str = "minute") -> DataFrame:
    """Requests with the answer that each gets when an item's requests are taken one after another, by requested_at and request_id.

    requests: request_id, requested_at, item_id, expected_state, to_state, role,
    justification.  A request is judged against the state that the ones before it
    left.  What a request does is a function from states to states, and such
    functions compose, so an item's requests are folded in chunks of time: each
    chunk's function first, then the chunks in order, then each chunk from the state
    that it starts at.  No task holds more than a chunk of an item's requests.
    """
    table = F.broadcast(transition_table(requests.sparkSession))  # seven rows
    states = sorted({s for a, b, *_ in TRANSITIONS for s in (a, b)})
    known = F.array(*[F.lit(s) for s in states])
    refused = (
        F.when(F.col("roles").isNull(), "undeclared")
        .when(~F.coalesce(F.array_contains("roles", F.col("role")), F.lit(False)), "role")
        .when(F.col("needs_reason") & (F.trim(F.coalesce("justification", F.lit(""))) == ""), "justification")
    )
    joined = requests.join(table.select(F.col("from_state").alias("expected_state"), "to_state", "roles", "needs_reason"), ["expected_state", "to_state"], "left")
    rows = joined.select("item_id", F.date_trunc(chunk, "requested_at").alias("chunk"), F.struct("requested_at", "request_id", F.col("expected_state").alias("expected"), F.col("to_state").alias("to"), refused.alias("refused")).alias("r"))
    chunks = rows.groupBy("item_id", "chunk").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    step = lambda s, r: F.when(r["refused"].isNull() & (r["expected"] == s), r["to"]).otherwise(s)
    does = F.map_from_arrays(known, F.transform(known, lambda s: F.aggregate("rs", s, step)))
    by_item = chunks.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("chunk", F.struct(*[does[F.lit(s)].alias(s) for s in states]).alias("does")))).alias("cs"))
    held = by_item.join(items.select("item_id", "state"), "item_id", "left")
    after = lambda s, c: F.coalesce(*[F.when(s == x, c["does"][x]) for x in states], s)
    starts = F.aggregate("cs", F.array(F.struct(F.lit(None).cast("timestamp_ntz").alias("chunk"), F.col("state").alias("state"))), lambda acc, c: F.concat(acc, F.array(F.struct(c["chunk"].cast("timestamp_ntz").alias("chunk"), after(F.element_at(acc, -1)["state"], c).alias("state")))))
    placed = held.withColumn("starts", starts).select("item_id", F.posexplode(F.transform("cs", lambda c, i: F.struct(c["chunk"].alias("chunk"), F.get(F.col("starts"), i)["state"].alias("state")))).alias("n", "c"))
    begun = placed.select("item_id", "c.chunk", "c.state")
    whole = chunks.join(begun, ["item_id", "chunk"])
    fold = F.aggregate(
        "rs",
        F.struct(F.col("state").alias("state"), F.array().cast("array<struct<request_id: bigint, answer: string>>").alias("out")),
        lambda acc, r: F.struct(
            step(acc["state"], r).alias("state"),
            F.concat(acc["out"], F.array(F.struct(r["request_id"].cast("long").alias("request_id"), F.when(acc["state"].isNull(), "no such item").when(acc["state"] != r["expected"], "stale").otherwise(F.coalesce(r["refused"], F.lit("applied"))).alias("answer")))).alias("out"),
        ),
    )
    answers = whole.select(F.explode(fold["out"]).alias("a")).select("a.request_id", "a.answer")
    return requests.join(answers, "request_id")


def applied(moves: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items after moves that were judged applicable, and a transition row for each move.

    moves: move_id, item_id, from_state, to_state, queue (null or blank: the item
    stays in its own), author, justification, occurred_at.  items: item_id, queue,
    state, claimed_by, changed_at; other columns stay.  Moves of an item follow one
    another by occurred_at and move_id.  An item in progress is claimed by whoever
    moved it there; in any other state nobody claims it.  Moves of items that aren't
    there make nothing.
    """
    turn = F.struct("occurred_at", "move_id")
    named = F.nullif(F.trim("queue"), F.lit(""))
    rows = moves.withColumns({"_turn": turn, "_queue": named})
    last = rows.groupBy("item_id").agg(
        F.max_by(F.struct("to_state", F.when(F.col("to_state") == "in_progress", F.col("author")).alias("claimed_by"), "occurred_at"), "_turn").alias("_last"),
        F.max_by("_queue", F.when(F.col("_queue").isNotNull(), F.col("_turn"))).alias("_named"),
    )
    written = {"state": "_last.to_state", "claimed_by": "_last.claimed_by", "changed_at": "_last.occurred_at"}
    moved = F.col("_last").isNotNull()
    after = {c: F.when(moved, F.col(v)).otherwise(F.col(c)) for c, v in written.items()} | {"queue": F.coalesce("_named", "queue")}
    so_far = W.partitionBy("item_id").orderBy("_turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    stood = rows.withColumn("_stood", F.last("_queue", ignorenulls=True).over(so_far)).drop("queue").join(items.select("item_id", "queue"), "item_id")
    transitions = stood.select("move_id", "item_id", "from_state", "to_state", F.coalesce("_stood", "queue").alias("queue"), "author", "justification", "occurred_at")
    return items.join(last, "item_id", "left").select(*[after.get(c, F.col(c)).alias(c) for c in items.columns]), transitions


def to_open(verdicts: DataFrame, existing: DataFrame) -> DataFrame:
    """Items to open: finding_key, package_id, queue.

    verdicts: package_id, confidence, absent_since, listed_since, vulnerability_status
    and the finding that it cites (vulnerability_finding_id, advisory_id,
    affected_range), license_outcome and its finding (license_finding_id,
    normalized_license, channel).  existing: finding_key, package_id, queue, state.

    An item is filed under the facts of its finding.  Unmapped packages get an
    identity item only, and none while one is open; absent packages get none; a
    package that was absent and is listed again gets new keys.
    """
    here = verdicts.where(F.col("absent_since").isNull())
    again = [("listed_since", iso(F.col("listed_since")))]
    mapped = F.col("confidence") != "unmapped"
    key = lambda table, facts: finding_key(table, F.col("package_id"), facts, again)
    named = lambda *columns: [(c, F.col(c)) for c in columns]
    kinds = (
        ("identity_review", ~mapped, key("packages", named("confidence"))),
        ("remediation", mapped & (F.col("vulnerability_status") == "advisories_matched") & F.col("vulnerability_finding_id").isNotNull(), key("vulnerability_findings", named("advisory_id", "affected_range"))),
        ("compliance_review", mapped & F.col("license_outcome").isin("manual_review", "restricted", "forbidden") & F.col("license_finding_id").isNotNull(), key("license_findings", named("normalized_license", "channel"))),
    )
    item = F.array(*[F.when(F.coalesce(when, F.lit(False)), F.struct(name.alias("finding_key"), F.lit(queue).alias("queue"))) for queue, when, name in kinds])
    rows = here.select("package_id", F.explode(F.filter(item, lambda x: x.isNotNull())).alias("item")).select("item.finding_key", "package_id", "item.queue")
    waiting = existing.where((F.col("queue") == "identity_review") & ~F.col("state").isin(*TERMINAL)).select("package_id", "queue").distinct()
    rows = beside(rows.dropDuplicates(["finding_key"]), existing.select("finding_key"), on="finding_key", how="left_anti")
    return beside(rows, waiting, on=["package_id", "queue"], how="left_anti").select("finding_key", "package_id", "queue")


def to_close(items: DataFrame, absent: DataFrame) -> DataFrame:
    """Open items of packages that the inventory no longer lists, with the transition to record."""
    live = items.where(~F.col("state").isin(*TERMINAL))
    return beside(live, absent.select("package_id").distinct(), how="left_semi").select("item_id", "package_id", F.col("state").alias("from_state"), F.lit("resolved").alias("to_state"), F.lit("system").alias("origin"))


def queue(items: DataFrame, health: DataFrame, scores: DataFrame, name: str | None = None, finished: bool = False) -> DataFrame:
    """Items of a queue (None: of all) that aren't done, with their package's bucket and newest score, the most pressing first.

    items: finding_key, package_id, queue, state.  health: package_id, priority_status
    (the bucket).  scores: package_id, policy_run_id, score.  No score comes before
    any, as the queues' store sorts.
    """
    newest = scores.groupBy("package_id").agg(F.max_by(F.struct("score"), "policy_run_id").alias("n")).select("package_id", "n.score")
    rows = items if name is None else items.where(F.col("queue") == name)
    rows = rows if finished else rows.where(~F.col("state").isin(*TERMINAL))
    rows = rows.join(health.select("package_id", F.col("priority_status").alias("bucket")), "package_id", "left").join(newest, "package_id", "left")
    return rows.orderBy(bucket_order(F.col("bucket")), F.desc_nulls_first("score"), "finding_key")


def absent_unresolved(health: DataFrame, packages: DataFrame) -> DataFrame:
    """One row: packages that aren't verified and that the inventory doesn't list, by the packages' confidence as it is now."""
    gone = health.where(F.col("inventory_absent_since").isNotNull()).select("package_id")
    open_ = packages.where(F.coalesce(F.col("confidence") != "verified", F.lit(True)))
    return open_.join(gone, "package_id", "left_semi").agg(F.count("*").alias("not_offered"))
