"""Jaccard self-join on word n-grams: a size-aware heavy-light join, exact on full sets.

1. Texts with equal shingle sets are one class.  Each class's shingles get their
   number of classes, over the whole corpus (`exchange`).  A set of s shingles can
   only link where `percent` of s are in other classes too, so all others leave.
2. A set's shingles are put in one order, those of few classes first.  Sets that
   link share c of their first s - ceil(percent * s) + c shingles, for any c.
   Shingles of one class only count as places.
3. A shingle's inverted list is the sets that have it in their prefix.  Shingles
   with the same list stand for one another, so sets keep their distinct lists.
   Lists of one set go.
4. Light sets (of few shingles) enumerate the subsets of two of such a prefix
   (c = 2), and sets that hold a subset meet.  Two shingles of one list are met by
   the whole list, which needs no further subset; of the other lists each two are
   one.  Heavy sets have too many subsets: the lists of their prefix's shingles
   (c = 1) are scanned, in which light sets also stand that a heavy one could link
   with.  The boundary is the size at which subsets and lists together are fewest,
   from sums by size; so rows grow as the prefixes do, however long a list is.
5. Sets that meet in a subset or a list are tied, if their sizes allow a link, to
   the smallest doc_id there; so a hot list adds a row for each of its sets and no
   pairs.  Components of ties are neighbourhoods, in which full sets decide links
   until all pairs that aren't in one group were compared (`near_dedup.confirmed_links`).

Nothing is sampled and no list is capped: each link is found.

Defined results: null texts and texts without words have an empty set and link
with nothing; rows that share a doc_id are one document, which has the links of
all of them; rows with a null doc_id have a null component and link nothing; ties
don't arise, as a component's smallest doc_id names it; an empty table gives no
rows.  Texts of any length count whole, other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import exchange, tables, words
from assayer.llm.graphs import components
from assayer.llm.near_dedup import confirmed_links, shingle_hashes

#: Words of a shingle and the least similarity of a link, in hundredths.
SHINGLE, PERCENT = 4, 85
#: Bytes of text in a block of the count, and shingles for each of its buckets.
BLOCK_BYTES, BUCKET_SHINGLES = 6 << 20, 1 << 20


def _distinct(w: words.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, in order, and where they begin."""
    hashes, first = shingle_hashes(w, size)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.searchsorted(text[new], np.arange(len(first)))


def _base(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in words.slices(batches, "text"):
        hashes, first = _distinct(words.split(batch.column("text"), lower=True), size)
        prints = []
        with np.errstate(over="ignore"):
            for salt in (np.uint64(0), np.uint64(0xD6E8FEB86659FD93)):
                total = np.zeros(len(hashes) + 1, np.uint64)
                np.cumsum(words.mixed(hashes ^ salt), out=total[1:])
                prints.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first)), *map(pa.array, prints)], ["doc_id", "n_shingles", "print", "check"])


_BLOCKS = f"{exchange.SENT}, doc_ids array<long>, sizes array<long>, texts binary, bytes long"


def _blocks(size: int, bits: int, buckets: int):
    """Rows that a block sends, and a row of its texts (with how many keys each bucket got)."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        keys: list[np.ndarray] = []
        number, size_ = TaskContext.get().partitionId() << 24, 0

        def block() -> pa.RecordBatch:
            found, count = np.unique(np.concatenate(keys), return_counts=True)
            rows = exchange.rows(number, found, count, bits, buckets)
            docs = pa.concat_arrays([b.column("doc_id") for b in held])
            data, offsets = words.buffers(pa.concat_arrays([b.column("text").cast(pa.large_binary()) for b in held]))
            texts = pa.Codec("zstd", 3).compress(data.tobytes(), asbytes=True)
            full = [(*r, None, None, None, None) for r in rows]
            full.append((number, None, len(docs), None, None, docs.to_pylist(), np.diff(offsets), texts, len(data)))
            full.append((number, None, 0, None, None, None, [r[2] for r in rows], None, None))
            held.clear()
            keys.clear()
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*full), kinds)], [c.split(" ")[0] for c in _BLOCKS.split(", ")])

        for batch in words.slices(batches, "text"):
            hashes, _ = _distinct(words.split(batch.column("text"), lower=True), size)
            keys.append(hashes >> np.uint64(64 - bits))
            held.append(batch)
            size_ += batch.column("text").nbytes
            if size_ >= BLOCK_BYTES:
                yield block()
                number, size_ = number + 1, 0
        if held:
            yield block()

    return blocks


def least_overlap(size: np.ndarray, percent: int) -> np.ndarray:
    """The fewest shingles that a set of this size shares with any set that it links with."""
    return -(-size * percent // 100)


_PREFIX = "row long, doc_id long, n_shingles long, elements array<long>, single int"


def _prefixes(size: int, bits: int, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefixes of the sets that may link: shingles of several classes, fewest classes first; the first `single` are the prefix for c = 1."""
    number = TaskContext.get().partitionId() << 36
    for row in exchange.in_slices(batches):
        block = row.to_pylist()[0]
        total, _ = exchange.read_answers(block["answers"], block["got"])
        data = pa.Codec("zstd").decompress(block["texts"], block["bytes"], asbytes=True)
        offsets = np.concatenate([[0], np.cumsum(np.asarray(block["sizes"], np.int64))])
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        parts = pa.RecordBatch.from_arrays([texts, pa.array(block["doc_ids"], pa.int64())], ["text", "doc_id"])
        sets = [(p.column("doc_id").to_numpy(), *_distinct(words.split(p.column("text"), lower=True), size)) for p in words.slices(iter([parts]), "text")]
        keys = [h >> np.uint64(64 - bits) for _, h, _ in sets]
        every = np.unique(np.concatenate(keys))
        for (docs, hashes, first), key in zip(sets, keys):
            rank = np.log2(total[np.searchsorted(every, key)]).astype(np.int64)  # 0: of this class alone
            n = np.diff(first)
            shared = np.add.reduceat(np.append(rank > 0, False).astype(np.int64), first[:-1]) if len(n) else n
            shared = np.where(n > 0, shared, 0)
            fits = np.flatnonzero((n > 0) & (shared >= least_overlap(n, percent)))
            out: list[tuple] = []
            for d in fits.tolist():
                own, r = hashes[first[d] : first[d + 1]], rank[first[d] : first[d + 1]]
                order = np.lexsort((own, r))
                one = int(n[d] - least_overlap(n[d], percent) + 1)
                order = order[: one + 1]
                order, single = order[r[order] > 0], int((r[order[:one]] > 0).sum())
                out.append((number, docs[d], n[d], own[order].view(np.int64), single))
                number += 1
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [c.split(" ")[0] for c in _PREFIX.split(", ")])


def _lists(prefixes: DataFrame, scratch: tables.Scratch) -> DataFrame:
    """Each set's distinct lists: those of several of its shingles, those of one, and those of the prefix for c = 1; and how many subsets and lists that makes."""
    elements = prefixes.select("row", "doc_id", "n_shingles", "single", F.posexplode("elements").alias("at", "element"))
    lists = scratch.written(elements.groupBy("element").agg(F.count("*").alias("sets"), F.bit_xor(F.xxhash64("row")).alias("list")).where("sets > 1").drop("sets"), "lists")
    own = elements.join(lists, "element").repartition("row").groupBy("row", "doc_id", "n_shingles", "list").agg((F.count("*") > 1).alias("several"), F.bool_or(F.col("at") < F.col("single")).alias("single"))
    held = lambda c: F.collect_list(F.when(c, F.col("list")))  # noqa: E731  of one set: no more than its prefix
    lone = F.count_if(~F.col("several"))
    subsets = F.count_if("several") + F.floor(lone * (lone - 1) / 2)
    sums = own.groupBy("row", "doc_id", "n_shingles").agg(held(F.col("several")).alias("several"), held(~F.col("several")).alias("lone"), held(F.col("single")).alias("first"), subsets.alias("subsets"), F.count_if("single").alias("scanned"))
    return scratch.written(sums, "held")


def boundary(costs: list[tuple[int, float, float]]) -> int:
    """The largest size of a light set, from (largest size, subsets, scanned lists) of sizes: where both together are fewest."""
    costs = sorted(costs)
    best, at, light, heavy = math.inf, 0, 0.0, sum(c[2] for c in costs)
    for size, subsets, scanned in [(0, 0.0, 0.0), *costs]:
        light, heavy = light + subsets, heavy - scanned
        if light + heavy < best:
            best, at = light + heavy, size
    return at


def _meetings(light: int, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where sets meet: a hash of a subset or a list, and of a level of sizes; sets that can link are on the same level or on neighbouring ones."""
    step = math.log(100 / percent) * 1.0001 if percent < 100 else 1.0
    for batch in batches:
        for doc, n, *lists in zip(*(batch.column(c) for c in ("doc_id", "n_shingles", "several", "lone", "first"))):
            several, lone, first = (np.asarray(x.values).astype(np.int64).view(np.uint64) for x in lists)
            n, found = n.as_py(), []
            with np.errstate(over="ignore"):
                if n <= light:
                    low = np.sort(lone)
                    i, j = np.triu_indices(len(low), 1)
                    i, j = np.concatenate([several, low[i]]), np.concatenate([several, low[j]])
                    found.append(words.mixed(words.mixed(words.mixed(i) + j)))
                if n > light or n * 100 >= light * percent:
                    found.append(first)
                level = np.uint64(int(math.log(n) / step))
                where = np.concatenate([words.mixed(x) + level + np.uint64(up) for x in found for up in (0, 1)])
            yield pa.RecordBatch.from_arrays([pa.array(words.mixed(where).view(np.int64)), pa.array(np.full(len(where), doc.as_py(), np.int64))], ["place", "doc_id"])


def joined(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """Per row of docs: doc_id, n_shingles and component_id (the smallest doc_id that links reach)."""
    spark = docs.sparkSession
    with tables.Scratch(spark) as scratch:
        cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
        base = scratch.written(cut.mapInArrow(partial(_base, shingle), "doc_id long, n_shingles long, print long, check long"), "sets")
        full = base.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
        several = scratch.written(full.groupBy("print", "check", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "several")
        members = scratch.written(full.join(several, ["print", "check", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "members")
        copies = scratch.written(members.groupBy("doc_id").agg(F.max((F.col("rep") == F.col("doc_id")).cast("int")).alias("own")).where("own = 0").select("doc_id"), "copies")
        reps = scratch.written(members.where("rep = doc_id").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles")), "classes")
        singles = cut.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).join(tables.checked(copies), "doc_id", "left_anti")
        shingles = full.agg(F.sum("n_shingles")).first()[0] or 0
        bits = min(64, max(32, (shingles or 1).bit_length() + 8))
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        sent = scratch.written(singles.mapInArrow(_blocks(shingle, bits, max(tasks, shingles // BUCKET_SHINGLES)), _BLOCKS), "blocks")
        texts = sent.where(F.col("texts").isNotNull()).select("block", "doc_ids", "sizes", "texts", "bytes")
        got = sent.where(F.col("n") == 0).select("block", F.col("sizes").alias("got"))
        answers = exchange.answered(sent.where(F.col("bucket").isNotNull()), got.count(), scratch)
        whole = texts.join(got, "block").join(answers, "block", "left")
        prefixes = scratch.written(whole.mapInArrow(partial(_prefixes, shingle, bits, percent), _PREFIX), "prefixes")
        held = _lists(prefixes, scratch)
        by_size = held.groupBy(F.floor(4 * F.log2("n_shingles")).alias("sizes")).agg(F.max("n_shingles").alias("largest"), F.sum("subsets").alias("subsets"), F.sum("scanned").alias("scanned"))
        light = boundary([(r["largest"], float(r["subsets"]), float(r["scanned"])) for r in by_size.collect()])  # four rows for each power of two
        meetings = scratch.written(held.mapInArrow(partial(_meetings, light, percent), "place long, doc_id long"), "meetings")
        least = meetings.groupBy("place").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("place", "a")
        forest = scratch.written(meetings.join(scratch.written(least, "places"), "place").where("a < doc_id").select("a", F.col("doc_id").alias("b")).distinct(), "ties")
        links = confirmed_links(cut, forest, components(forest, scratch), reps, percent, scratch, shingle)
        shared = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("doc_id")
        same = members.join(tables.checked(scratch.written(shared, "shared")), "doc_id").where("rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
        labels = components(links.unionByName(same), scratch)
        own = members.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("label", "rep")).alias("label"))
        out = base.select("doc_id", "n_shingles").join(own, "doc_id", "left")
        return tables.written(out.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id")), "joined")


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents."""
    return joined(tables.read(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, unnest([array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, greatest(len(ws) - 2, 2))]) AS s FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM w UNION SELECT reach.node, link.b FROM reach JOIN link ON link.a = reach.seen)
SELECT w.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(seen) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN reach ON reach.node = w.doc_id GROUP BY w.doc_id
"""
