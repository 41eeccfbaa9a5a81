"""Writing WARC archives, and reading them back by boundary chains.

Writing: Spark's text writer puts one record after another, with the end of a
record as its line separator.  Of records with equal payloads of at least
`REVISIT_BYTES` bytes the one with the largest page id is the response, the
others are revisits of it.

Reading: Spark's text reader splits archives at every magic, wherever a task's
part of a file begins.  So each chunk is a candidate record, and its header tells
where its successor begins.  Within a part, a task follows these links to the
first place outside of the part.  Pointer jumping over parts, from each file's
start, then tells where the true chain enters every part, and only records on
that chain stay: a magic inside a payload is a candidate that nothing reaches.

Defined results: null html counts as empty; a null page id is written and read as
such and never is what others refer to; rows that share page id and payload are
all responses, and where it has several payloads a revisit takes the one of its own
digest; behind a broken record nothing of the file is read; an empty table
gives no rows.  Payloads of any length count whole; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.llm import tables

MAGIC, END = b"WARC/1.1\r\n", b"\r\n\r\n"
REVISIT_BYTES = 1000
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*([^\r\n]*)$")
_PAGE = re.compile(rb"<urn:page:(-?\d+)>")


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a record for each row (page_id, url, html)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    large = rows.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    repeated = tables.written(large.where((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first"), "repeated")
    rows = rows.join(repeated, "digest", "left")  # Spark broadcasts the table if it is small enough
    revisit = (F.col("bytes") >= REVISIT_BYTES) & F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn("page_id")),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn("first")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.lit(len(_HTTP)) + F.when(revisit, 0).otherwise(F.col("bytes"))).cast("string")),
        F.lit("\r\n" + _HTTP),
    ).cast("binary")
    body = F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload"))
    rows.select(F.concat(head, body).cast("string").alias("value")).write.option("lineSep", END.decode()).text(folder)


def _header(chunk: bytes) -> tuple[int, dict[bytes, bytes]] | None:
    """Bytes of a candidate's header and its fields; None if it isn't one."""
    end = chunk.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for text in chunk[:end].split(b"\r\n"):
        if not (m := _FIELD.match(text)):
            return None
        fields[m[1].lower()] = m[2]
    return (end + 4, fields) if fields.get(b"content-length", b"").isdigit() and b"warc-type" in fields else None


_CANDIDATE = "file string, part long, at long, next long, leaves long, stop long, page_id long, type string, refers_to long, url string, body long, whole boolean, digest string, declared string"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk: where its magic begins, where its successor does, and where following these leaves the part; places count from the part's first byte."""
    names = [c.split(" ")[0] for c in _CANDIDATE.split(", ")]
    held: list[list] = []
    now, at = None, 0

    def done() -> pa.RecordBatch:
        place, succ = np.array([r[2] for r in held], np.int64), np.array([r[3] for r in held], np.int64)
        k = np.minimum(np.searchsorted(place, succ), len(place) - 1)
        inside = place[k] == succ
        to = np.where(inside, k, np.arange(len(place)))
        while True:  # pointer jumping within the part
            again = to[to]
            if (again == to).all():
                break
            to = again
        for r, leaves in zip(held, succ[to].tolist()):
            r[4] = leaves
        columns = list(zip(*held))
        held.clear()
        kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split(" ")[1]]) for c, x in zip(columns, _CANDIDATE.split(", "))], names)

    for batch in batches:
        for file, part, chunk in zip(batch.column("file").to_pylist(), batch.column("part").to_pylist(), batch.column("value")):
            if (file, part) != now:
                if held:
                    yield done()
                now, at = (file, part), 0
            chunk = chunk.as_py()
            place, stop = at - len(MAGIC), at + len(chunk)
            at = stop + len(MAGIC)
            found = _header(chunk)
            row = [file, part, place, -(1 << 60) - len(held), 0, stop, None, None, None, None, None, False, None, None]
            if found:
                head, fields = found
                length = int(fields[b"content-length"])
                http = chunk.find(b"\r\n\r\n", head) + 4
                page, refers = _PAGE.match(fields.get(b"warc-record-id", b"")), _PAGE.match(fields.get(b"warc-refers-to", b""))
                end = place + len(MAGIC) + head + length
                whole = end + len(END) <= stop and http >= 4
                row[3] = end + len(END)
                row[6:9] = [int(page[1]) if page else None, fields[b"warc-type"].decode("ascii", "replace"), int(refers[1]) if refers else None]
                row[9], row[10], row[11] = fields.get(b"warc-target-uri", b"").decode("utf-8", "replace"), head + length - http if http >= 4 else None, whole
                row[12] = hashlib.sha1(chunk[http : head + length]).hexdigest() if whole else None
                row[13] = fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("ascii", "replace")
            held.append(row)
    if held:
        yield done()


def _on_chain(group: pa.Table) -> pa.Table:
    """Of a part's candidates those that the chain from its entry passes."""
    group = group.sort_by("at")
    at, succ = group.column("at").to_numpy(), group.column("next").to_numpy()
    k = np.minimum(np.searchsorted(at, succ), len(at) - 1)
    k = np.where(at[k] == succ, k, -1)
    keep, i = [], int(np.searchsorted(at, group.column("entry")[0].as_py()))
    while i >= 0:
        keep.append(i)
        i = int(k[i])
    return group.take(pa.array(keep)).drop_columns(["entry"])


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives in a folder: file, at, page_id, type, refers_to, url, payload_bytes, payload_digest (of what the record holds), declared_digest (what its header says)."""
    chunks = spark.read.option("lineSep", MAGIC.decode()).text(folder)
    chunks = chunks.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.col("value").cast("binary").alias("value"))
    local = tables.written(chunks.mapInArrow(_candidates, _CANDIDATE), "candidates")
    parts = local.groupBy("file", "part").agg((F.max("stop") + len(MAGIC)).alias("size"))
    before = F.coalesce(F.sum("size").over(W.partitionBy("file").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = tables.kept(parts.select("file", "part", before.alias("base")))  # a row for each part
    moved = local.join(base, ["file", "part"]).withColumns({c: F.col(c) + F.col("base") for c in ("at", "next", "leaves", "stop")})
    every = tables.written(moved.drop("base"), "placed")
    nodes = every.where(F.col("type").isNotNull()).select("file", "at", "leaves")
    targets = nodes.select("file", F.col("leaves").alias("at")).distinct()
    start = F.lit(0).cast("long")
    jump = tables.kept(nodes.join(targets, ["file", "at"], "left_semi").unionByName(nodes.where(F.col("at") == start)).distinct())
    reached, n = jump.where(F.col("at") == start).select("file", "at"), -1
    while True:  # pointer jumping over parts: the reach doubles each time
        more = reached.join(jump, ["file", "at"]).select("file", F.col("leaves").alias("at"))
        reached = tables.kept(reached.unionByName(more).distinct())
        if n == (n := reached.count()):
            break
        far = jump.select("file", F.col("at").alias("leaves"), F.col("leaves").alias("far"))
        jump = tables.kept(jump.join(far, ["file", "leaves"], "left").select("file", "at", F.coalesce("far", "leaves").alias("leaves")))
    entries = every.join(reached, ["file", "at"], "left_semi").where(F.col("type").isNotNull()).groupBy("file", "part").agg(F.min("at").alias("entry"))
    shape = ", ".join(f"{c} {t}" for c, t in every.dtypes)
    records = tables.written(every.join(entries, ["file", "part"]).groupBy("file", "part").applyInArrow(_on_chain, shape), "records")
    return _closed(chunks, every, records).select("file", "at", "page_id", "type", "refers_to", "url", F.col("body").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("declared").alias("declared_digest"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, at = None, 0
    for batch in batches:
        place = []
        for file, part, size in zip(batch.column("file").to_pylist(), batch.column("part").to_pylist(), batch.column("size").to_pylist()):
            at = 0 if (file, part) != now else at
            now = (file, part)
            place.append(at - len(MAGIC))
            at += size + len(MAGIC)
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("part"), pa.array(place, pa.int64()), batch.column("value")], ["file", "part", "local", "value"])


def _assembled(group: pa.Table) -> pa.Table:
    group = group.sort_by("local_at")
    text = MAGIC.join(group.column("value").to_pylist())
    head, fields = _header(text)
    end = head + int(fields[b"content-length"])
    http = text.find(b"\r\n\r\n", head) + 4
    cut = min(http, end) if http >= 4 else head
    return pa.table({"file": group.column("file").slice(0, 1), "at": group.column("at").slice(0, 1), "body2": pa.array([end - cut]), "digest2": pa.array([hashlib.sha1(text[cut:end]).hexdigest()])})


def _closed(chunks: DataFrame, every: DataFrame, records: DataFrame) -> DataFrame:
    """records, with the payloads that hold a magic put together from their chunks."""
    torn = tables.written(records.where(~F.col("whole")).select("file", "at", "next"), "torn")
    if torn.isEmpty():
        return records
    # Records don't overlap, so a piece can only be part of the last torn one that begins before it, in its part or one before.
    begun = every.select("file", "part", F.col("at").alias("piece")).join(torn.select("file", F.col("at").alias("piece"), F.struct("at", "next").alias("torn")), ["file", "piece"], "left")
    ends = begun.groupBy("file", "part").agg(F.max("torn").alias("torn"))  # a row for each part
    before = F.last("torn", ignorenulls=True).over(W.partitionBy("file").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    own = F.last("torn", ignorenulls=True).over(W.partitionBy("file", "part").orderBy("piece").rowsBetween(W.unboundedPreceding, 0))
    near = begun.withColumn("own", own).join(ends.select("file", "part", before.alias("before")), ["file", "part"]).select("file", "piece", F.coalesce("own", "before").alias("torn"))
    near = near.where(F.col("piece") < F.col("torn.next")).select("file", "piece", "torn.at")
    first = every.groupBy("file", "part").agg(F.min("at").alias("base"))
    local = chunks.withColumn("size", F.octet_length("value")).mapInArrow(_pieces, "file string, part long, local long, value binary")
    placed = local.join(first, ["file", "part"]).select("file", (F.col("local") + F.col("base") + len(MAGIC)).alias("piece"), "value")
    whole = placed.join(near, ["file", "piece"]).select("file", "at", F.col("piece").alias("local_at"), "value")
    whole = whole.groupBy("file", "at").applyInArrow(_assembled, "file string, at long, body2 long, digest2 string")
    return records.join(whole, ["file", "at"], "left").withColumns({"body": F.coalesce("body2", "body"), "digest": F.coalesce("digest2", "digest")})


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages to archives and reads these back."""
    folder = f"{tables.shared_folder(spark)}/warc-{tables.fresh()}"
    write_archives(tables.read(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    records = read_archives(spark, folder)
    held = records.where(F.col("type") == "response").select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    seen = records.where(F.col("type") == "revisit").select("page_id", "refers_to", F.col("declared_digest").alias("payload_digest"))
    first = held.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))  # a page id may have several payloads
    revisits = seen.join(first, ["refers_to", "payload_digest"]).select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    return held.unionByName(revisits)


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest,
      max(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM d
"""
