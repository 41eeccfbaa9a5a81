"""Collected documents into typed evidence as they come: one stream, a table for each collector.

Each answer becomes rows of its collector's table.  The order of the checks is that
of a collection: what doesn't apply, refusals and failed calls, unmodified answers
(which take the body that was kept for them), missing documents; then the document
is read, and one that can't be read, or that says nothing, is an error row.  So
every document leaves a row, and none stops the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assayer.operators import asof
from assayer.sources import documents

BRONZE = "id bigint, observed_at timestamp_ntz, collector string, package_id bigint, applicable boolean, refused boolean, status_code int, body string"
_HEADER = ("id", "observed_at", "package_id", "source")


def _releases(rows: DataFrame) -> DataFrame:
    found = documents.releases(rows)
    return found.select("package_id", F.when(F.col("releases_seen") >= 0, F.struct(F.when(F.col("latest_version").isNotNull(), "ok").otherwise("not_found").alias("state"), "latest_version", "released_at", "last_activity_at", "releases_seen")).alias("read"))


def _index(rows: DataFrame) -> DataFrame:
    found = documents.index_facts(rows)
    return found.select("package_id", F.when(F.col("version").isNotNull(), F.struct(F.lit("ok").alias("state"), F.col("version").alias("latest_version"), "released_at", "repository")).alias("read"))


def _licences(rows: DataFrame) -> DataFrame:
    found = documents.channel_licences(rows, "main")
    return found.select("package_id", F.when(F.col("state") != "error", F.struct("state", "channel", F.col("raw").alias("raw_license"), "normalized_license", "detection_method")).alias("read"))


#: Each collector's table, how its documents are read (package_id, body -> package_id, read: null where that fails), and its facts.
COLLECTORS: Mapping[str, tuple[str, Callable[[DataFrame], DataFrame], tuple[str, ...]]] = {
    "source_release": ("source_release_snapshots", _releases, ("latest_version", "released_at", "last_activity_at", "releases_seen")),
    "pypi_release": ("pypi_release_snapshots", _index, ("latest_version", "released_at", "repository")),
    "license": ("license_findings", _licences, ("channel", "raw_license", "normalized_license", "detection_method")),
}


def _replayed(answers: DataFrame, bodies: DataFrame) -> DataFrame:
    """Unmodified answers with the newest body kept for their package, which makes them answers like others."""
    kept = asof.latest(bodies, ["package_id"], F.lit("9999-12-31").cast("timestamp_ntz")).select("package_id", F.col("body").alias("kept"))
    rows = answers.join(kept, "package_id", "left")
    same = F.col("state") == "unmodified"
    return rows.withColumns({"body": F.when(same, F.col("kept")).otherwise(F.col("body")), "state": F.when(same & F.col("kept").isNull(), "error").when(same, "ok").otherwise(F.col("state")), "why": F.when(same & F.col("kept").isNull(), "unmodified, and nothing was kept")}).drop("kept")


def evidence(bronze: DataFrame, collector: str, bodies: DataFrame) -> DataFrame:
    """The evidence rows of one collector's answers: header, state, detail and facts.

    bodies: package_id, id, observed_at, body of documents that were kept before.
    """
    _, read, facts = COLLECTORS[collector]
    answers = documents.collected(bronze.where(F.col("collector") == collector)).withColumn("source", F.col("collector"))
    own = answers.where((F.col("state") == "ok")).select("package_id", "id", "observed_at", "body")
    answers = _replayed(answers, bodies.select("package_id", "id", "observed_at", "body").unionByName(own))
    header = F.struct(*[F.col(c) for c in (*_HEADER, "state", "why", "status_code")])
    found = read(answers.select(header.alias("package_id"), "body"))
    h = F.col("package_id")
    good = h["state"] == "ok"
    state = F.when(~good, h["state"]).otherwise(F.coalesce(F.col("read")["state"], F.lit("error")))
    detail = F.coalesce(h["why"], F.when(good & F.col("read").isNull(), "the document could not be read"), F.when(h["state"] == "error", F.concat(F.lit("status "), F.coalesce(h["status_code"].cast("string"), F.lit("none")))), F.lit(""))
    fact: Callable[[str], Column] = lambda c: F.when(good, F.col("read")[c]).alias(c)
    return found.select(*[h[c].alias(c) for c in _HEADER], state.alias("state"), detail.alias("detail"), *[fact(c) for c in facts])


def batch(rows: DataFrame, number: int, folder: str) -> None:
    """Writes one batch's evidence tables and the bodies to keep, each in a folder of the batch's number: the same batch again replaces itself."""
    spark = rows.sparkSession
    rows.persist()
    try:
        for collector, (table, _, _) in COLLECTORS.items():
            kept = _kept(spark, folder, collector, number)
            evidence(rows, collector, kept).write.mode("overwrite").parquet(f"{folder}/{table}/batch={number}")
        answers = documents.collected(rows).where(F.col("state") == "ok").select("package_id", "id", "observed_at", "body", "collector")
        answers.write.mode("overwrite").partitionBy("collector").parquet(f"{folder}/bodies/batch={number}")
    finally:
        rows.unpersist()


def _kept(spark, folder: str, collector: str, number: int) -> DataFrame:
    """Bodies that batches before this one kept."""
    shape = "package_id bigint, id bigint, observed_at timestamp_ntz, body string, batch int, collector string"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/bodies")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).parquet(f"{folder}/bodies").where((F.col("collector") == collector) & (F.col("batch") < number))


def collect(source: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Takes what a stream of bronze documents holds into the evidence tables of a folder, and ends."""
    return source.writeStream.foreachBatch(lambda rows, number: batch(rows, number, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table(spark, folder: str, name: str) -> DataFrame:
    """One evidence table of all batches."""
    return spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}")
