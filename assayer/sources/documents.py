"""Collected documents (JSON and recipe text) as typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import licence_terms, text
from assayer.functions.specifiers import admits, declares_versions

ADVISORIES = "identified boolean, findings array<struct<advisory_id: string, severity: string, affected_range: string, fixed_range: string, match_confidence: string>>, detail string"
CATALOG = "entries array<struct<advisory_id: string, aliases: array<string>, date_added: string>>"
CHANNEL = "latest_version string, license string, files array<struct<version: string, labels: array<string>, attrs: struct<subdir: string, build: string, build_number: int>>>"
RELEASES = "array<struct<tag_name: string, published_at: string, created_at: string, draft: boolean, prerelease: boolean>>"
INDEX = "info struct<version: string, requires_python: string, classifiers: array<string>, project_urls: map<string, string>>, releases map<string, array<struct<upload_time_iso_8601: string>>>"
INVENTORY = "array<struct<source_package_key: string, package_name: string, internal_component_count: int, internal_lob_count: int, apps: int, platforms: int, downloads: int, versions: int>>"
VERIFICATION = "verified boolean, platform string, architecture string, log_reference string, detail string"
REPOSITORY = "name string, html_url string, pushed_at string"
SEARCH = "total_count int, items array<struct<title: string, html_url: string>>"


def foreign_keys(body: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object that its schema doesn't have; null if it isn't an object."""
    return F.array_except(F.json_object_keys(body), F.array(*[F.lit(k) for k in allowed]))


def advisories(documents: DataFrame, most: int = 1000) -> DataFrame:
    """A row for each finding; a document with foreign keys, too many findings or a repeated id is refused whole: fault says why."""
    parsed = documents.withColumn("d", F.from_json("body", ADVISORIES))
    ids = F.transform("d.findings", lambda f: F.lower(f["advisory_id"]))
    fault = (
        F.when(F.col("d").isNull() | F.coalesce(F.size(foreign_keys(F.col("body"), ["identified", "findings", "detail"])) != 0, F.lit(True)), "malformed")
        .when(F.size("d.findings") > most, "too many")
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "repeated")
    )
    rows = parsed.withColumn("fault", fault)
    return rows.select("package_id", "fault", F.explode_outer(F.when(F.col("fault").isNull(), F.col("d.findings"))).alias("f")).select("package_id", "fault", "f.*")


#: The earliest and latest date that a catalog entry may state.
EARLIEST, LATEST = "1999-01-01T00:00:00Z", "2200-01-01T00:00:00Z"


def catalog(documents: DataFrame) -> DataFrame:
    """advisory_id (lower case, aliases too), date_added and fault: why there is no date (none stated, unreadable, out of range)."""
    entry = documents.select(F.explode(F.from_json("body", CATALOG)["entries"]).alias("e"))
    name = F.explode(F.array_distinct(F.transform(F.concat(F.array("e.advisory_id"), F.coalesce("e.aliases", F.array().cast("array<string>"))), F.lower)))
    at = text.instant(F.col("e.date_added"))
    inside = at.between(F.lit(EARLIEST).cast("timestamp"), F.lit(LATEST).cast("timestamp"))
    fault = F.when(F.trim(F.coalesce("e.date_added", F.lit(""))) == "", "no date").when(at.isNull(), "unreadable").when(~inside, "out of range")
    return entry.select(name.alias("advisory_id"), F.when(inside, at).alias("date_added"), fault.alias("fault"))


def listed(findings: DataFrame, entries: DataFrame) -> DataFrame:
    """Findings with their answer: listed, not_listed where the catalog knows the identifier's scheme, else unknown."""
    known = entries.select(F.lower("advisory_id").alias("key"), "date_added").groupBy("key").agg(F.min("date_added").alias("date_added"))
    schemes = known.select(text.scheme_of(F.col("key")).alias("scheme"), F.lit(True).alias("covered")).distinct()
    rows = findings.withColumn("key", F.lower("advisory_id")).withColumn("scheme", text.scheme_of(F.col("advisory_id")))
    rows = rows.join(known.withColumn("hit", F.lit(True)), "key", "left").join(schemes, "scheme", "left")
    return rows.withColumn("answer", F.when(F.col("hit"), "listed").when(F.col("covered"), "not_listed").otherwise("unknown")).drop("key", "scheme", "hit", "covered")


def channel_facts(documents: DataFrame, platforms: list[str]) -> DataFrame:
    """package_id, platform, version, build, build_number: the best file of the latest version on each platform."""
    rows = documents.select("package_id", F.from_json("body", CHANNEL).alias("d")).withColumn("platform", F.explode(F.array(*[F.lit(p) for p in platforms])))
    own = F.filter("d.files", lambda f: (f["version"] == F.col("d.latest_version")) & (f["attrs"]["subdir"] == F.col("platform")))
    best = F.array_max(F.transform(own, lambda f: F.struct(F.coalesce(f["attrs"]["build_number"], F.lit(-1)).alias("n"), f["attrs"]["build"].alias("build"))))
    return rows.select("package_id", "platform", F.when(best.isNotNull(), F.col("d.latest_version")).alias("version"), best["build"].alias("build"), F.nullif(best["n"], F.lit(-1)).alias("build_number"))


def channel_licences(documents: DataFrame, channel: str) -> DataFrame:
    """package_id, channel, state, raw_license, normalized_license, detection_method, detail (what was missing, in a word) of channel documents."""
    rows = documents.select("package_id", F.from_json("body", CHANNEL)["license"].alias("raw"), F.json_object_keys("body").alias("keys"))
    raw, read = F.trim(F.coalesce("raw", F.lit(""))), licence_terms.normalised(F.col("raw"))
    detail = F.when(F.col("keys").isNull(), "no document").when((raw == "") & ~F.array_contains("keys", "license"), "no field").when(raw == "", "none stated").when(F.col("raw").rlike(r"[\x00-\x1F\x7F]"), "control characters").when(read["expression"].isNull(), "not recognised")
    good = detail.isNull()
    return rows.select("package_id", F.lit(channel).alias("channel"), F.when(F.col("keys").isNull(), "error").when(good, "normalized").otherwise("unknown").alias("state"), "raw", F.when(good, read["expression"]).alias("normalized_license"), F.when(good, read["method"]).alias("detection_method"), F.coalesce(detail, F.lit("")).alias("detail"))


def tags(documents: DataFrame) -> DataFrame:
    """package_id, latest_version of tag lists: the first that has a name; null where none does."""
    names = F.filter(F.transform(F.from_json("body", "array<struct<name: string>>"), lambda t: F.trim(t["name"])), lambda n: n != "")
    return documents.select("package_id", F.get(names, F.lit(0)).alias("latest_version"))


def feedstock_index(documents: DataFrame) -> DataFrame:
    """package_id, feedstocks (lower case, each once, in their order) of index documents; null with a fault where the list, or a name in it, isn't one."""
    names = F.transform(F.from_json("body", "feedstocks array<string>")["feedstocks"], lambda n: F.lower(F.trim(n)))
    fault = F.when(names.isNull(), "not a list").when(F.exists(names, lambda n: ~F.coalesce(n.rlike("^[a-z0-9_.-]+$"), F.lit(False))), "not a name")
    return documents.select("package_id", F.when(fault.isNull(), F.array_distinct(names)).alias("feedstocks"), fault.alias("fault"))


def project_urls(documents: DataFrame) -> DataFrame:
    """package_id, urls: the labelled links of index documents, trimmed, without blank ones."""
    urls = F.from_json("body", INDEX)["info"]["project_urls"]
    kept = F.map_filter(urls, lambda k, v: (F.trim(k) != "") & (F.trim(F.coalesce(v, F.lit(""))) != ""))
    return documents.select("package_id", F.transform_values(F.transform_keys(kept, lambda k, v: F.trim(k)), lambda k, v: F.trim(v)).alias("urls"))


def active_records(entries: DataFrame) -> DataFrame:
    """source_package_key, record: each entry that isn't retired as the JSON that the inventory adapter reads; signals without a value are left out."""
    record = F.to_json(F.struct("source_package_key", "package_name", "internal_component_count", "internal_lob_count", "apps", "platforms", "downloads", "versions"), {"ignoreNullFields": "true"})
    return entries.where(F.col("retired_at").isNull()).select("source_package_key", record.alias("record")).orderBy("source_package_key")


def releases(documents: DataFrame) -> DataFrame:
    """package_id, latest_version, released_at, last_activity_at, releases_seen and how many were left out, by reason."""
    rows = documents.select("package_id", F.from_json("body", RELEASES).alias("d"))
    at = F.transform("d", lambda r, i: F.struct(text.instant(r["published_at"]).alias("published"), (-i).alias("at"), r["tag_name"].alias("tag"), r["draft"].alias("draft"), r["prerelease"].alias("pre"), text.instant(r["created_at"]).alias("created")))
    reason = lambda r: F.when(F.coalesce(r["draft"], F.lit(False)), "draft").when(F.coalesce(r["pre"], F.lit(False)), "prerelease").when(F.coalesce(r["tag"], F.lit("")) == "", "untagged").when(r["published"].isNull(), "undated").otherwise("")
    rows = rows.withColumn("r", at)
    count = lambda name: F.size(F.filter("r", lambda r: reason(r) == name)).alias(name)
    best = F.array_max(F.filter("r", lambda r: reason(r) == ""))
    active = F.array_max(F.transform("r", lambda r: F.greatest(r["published"], r["created"])))
    return rows.select("package_id", best["tag"].alias("latest_version"), best["published"].alias("released_at"), active.alias("last_activity_at"), F.size("r").alias("releases_seen"), *[count(n) for n in ("draft", "prerelease", "untagged", "undated")])


def index_facts(documents: DataFrame, series: tuple[int, ...] = (3, 14)) -> DataFrame:
    """package_id, version, its first upload, repository and readiness for the series, of package-index documents."""
    d = F.col("d")
    rows = documents.select("package_id", F.from_json("body", INDEX).alias("d"))
    uploads = F.transform(d["releases"][d["info"]["version"]], lambda f: text.instant(f["upload_time_iso_8601"]))
    classes = d["info"]["classifiers"]
    named = F.array_contains(classes, f"Programming Language :: Python :: {series[0]}.{series[1]}")
    reading = admits(d["info"]["requires_python"], series)
    judged = F.struct(reading.alias("reading"), named.alias("named"), declares_versions(classes).alias("declared"))
    reading, named, declared = (F.col("judged")[c] for c in ("reading", "named", "declared"))
    ready = F.when(reading == "excluded", "inferred_not_ready").when(named, "inferred_ready").when(declared, "inferred_not_ready").when(reading == "admitted", "inferred_ready").otherwise("unknown")
    signal = F.when(reading == "excluded", "specifier").when(named | declared, "classifier").when(reading == "admitted", "specifier").otherwise("")
    rows = rows.withColumn("judged", text.once(judged, lambda j: j))
    return rows.select("package_id", d["info"]["version"].alias("version"), F.array_min(F.filter(uploads, lambda x: x.isNotNull())).alias("released_at"), text.chosen_repository(d["info"]["project_urls"]).alias("repository"), ready.alias("readiness"), signal.alias("deciding_signal"))


def inventory(documents: DataFrame) -> DataFrame:
    """A row for each record of inventory documents; fault says which required value is missing."""
    rows = documents.select(F.explode(F.from_json("body", INVENTORY)).alias("r")).select("r.*")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    fault = F.when(blank("source_package_key"), "source_package_key").when(blank("package_name"), "package_name").when(F.col("internal_component_count").isNull(), "internal_component_count").when(F.col("internal_lob_count").isNull(), "internal_lob_count")
    return rows.withColumn("fault", fault)


def verifications(documents: DataFrame) -> DataFrame:
    """package_id, state and where it ran; a document that doesn't say whether it verified is an error."""
    d = F.from_json("body", VERIFICATION)
    rows = documents.select("package_id", d.alias("d"))
    state = F.when(F.col("d.verified").isNull(), "error").when(F.col("d.verified"), "verified_compatible").otherwise("verification_failed")
    return rows.select("package_id", state.alias("state"), "d.platform", "d.architecture", "d.log_reference")


def staged_recipe(documents: DataFrame) -> DataFrame:
    """package_id, url of the one open title that names the package; null where none or several do."""
    rows = documents.select("package_id", "name", F.from_json("body", SEARCH)["items"].alias("items"))
    plain = lambda c: F.regexp_replace(F.lower(c), "[-_.]+", "-")
    hits = F.filter("items", lambda i: F.exists(F.split(i["title"], r"[\s,:;()\[\]`'\"/]+"), lambda w: plain(w) == plain(F.col("name"))))
    return rows.select("package_id", F.when(F.size(hits) == 1, F.get(hits, F.lit(0))["html_url"]).alias("url"))


def repository_facts(documents: DataFrame) -> DataFrame:
    """package_id, feedstock_name, feedstock_url, last_activity_at."""
    rows = documents.select("package_id", F.from_json("body", REPOSITORY).alias("d"))
    return rows.select("package_id", F.regexp_replace("d.name", "-feedstock$", "").alias("feedstock_name"), F.col("d.html_url").alias("feedstock_url"), text.instant(F.col("d.pushed_at")).alias("last_activity_at"))


def collected(bronze: DataFrame) -> DataFrame:
    """Bronze rows with the state that their answer gives before any is read: the order of the checks matters.

    bronze: collector, package_id, applicable, refused, status_code, body, observed_at.
    """
    state = (
        F.when(~F.coalesce("applicable", F.lit(True)), "not_applicable")
        .when(F.coalesce("refused", F.lit(False)), "error")
        .when(F.col("status_code").isNull(), "error")
        .when(F.col("status_code").isin(404, 410), "not_found")
        .when(F.col("status_code") == 304, "unmodified")
        .when(~F.col("status_code").between(200, 299), "error")
        .when(F.coalesce(F.trim("body"), F.lit("")) == "", "error")
        .otherwise("ok")
    )
    return bronze.withColumn("state", state)
