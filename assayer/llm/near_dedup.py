"""Near-duplicate groups by MinHash and an LSH forest, confirmed on full shingle sets.

1. A map over whole texts finds each document's set of five-word shingles, and of
   it the size, a fingerprint and `TREES` x `DEPTH` minima.
2. Documents with equal fingerprints (128 bits) are one class, named by its
   smallest doc_id.
3. Each tree puts the classes in the order of its own minima: a range partition
   with the doc_id as the last key, so that no key makes a large part.  A task
   reads its stretch of the order and takes each class's longest common prefix
   with its neighbour.  Neighbours that share `shallowest` minima or more make a
   region.  Regions of more than `REGION` classes are cut where neighbours share
   least, deeper and deeper until the pieces are small; each piece keeps the
   neighbour before it.  Depth so adapts to each region.
4. In a region the signatures' agreement gives a spanning forest of what may be
   linked: sets of which one is too small for the other, or that agree too little
   (far under the threshold, by more than chance allows), are left out.  Regions
   that were cut, or that a task's end cuts, are compared further: each member
   that is not in the region's largest tied part meets every other member, block
   against block.
5. Components of all forests are neighbourhoods.  Each brings its members' full
   sets together, and there links are decided exactly until every member is in
   the largest group or was compared with every other.  A neighbourhood of too
   many shingles is first split along its forest, with both ends of every tree
   edge in a part; then members outside its largest confirmed group meet every
   other member, block against block.
6. Components of confirmed links are the groups.

So a link is missed only where its ends share too short a prefix in every tree:
for links at exactly the threshold at most one in fifty thousand (`MISSED`).

Defined results: null texts and texts without words have an empty set, and are
groups of their own; rows that repeat or share a doc_id are one node; rows with a
null doc_id have a null component and are kept; of a group, the smallest doc_id is
kept, so ties don't arise; an empty table gives no rows.  Texts of any length
count whole, other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import tables, words
from assayer.llm.graphs import components

#: Words of a shingle; the least similarity of a link, in hundredths, where none is given.
SHINGLE, PERCENT = 5, 80
TREES, DEPTH = 16, 8
#: The share of links at the threshold that may miss each other in all trees.
MISSED = 2e-5
#: Classes of a region before it is cut, classes of a region that a task holds, and shingles of a neighbourhood that meet in one task.
REGION, HELD, GATHERED = 512, 8192, 6_000_000
#: How far, in standard deviations of the agreement, a pair may fall under the threshold and still be tried.
SLACK = 4.5


def shingle_hashes(w: words.Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each shingle occurrence and each text's offset in these; a text with fewer words is one shingle."""
    h, counts = w.hashes(), w.counts
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(w.first[:-1], n) + np.arange(first[-1]) - np.repeat(first[:-1], n)
    take = np.repeat(np.minimum(counts, size), n)
    padded = np.concatenate([h, np.zeros(size, np.uint64)])
    out = take.astype(np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = np.where(j < take, words.mixed(out * np.uint64(0x9E3779B97F4A7C15) + padded[at + j]), out)
    return out, first


_rng = np.random.default_rng(20)
_FACTORS = (_rng.integers(1, 1 << 31, TREES * DEPTH, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_MASKS = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)


def signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text TREES x DEPTH minima (0 for texts without shingles)."""
    full = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, TREES * DEPTH), np.uint32)
    if len(full):
        small, starts = (hashes >> np.uint64(32)).astype(np.uint32), first[full]
        with np.errstate(over="ignore"):
            for i in range(TREES * DEPTH):
                out[full, i] = np.minimum.reduceat((small ^ _MASKS[i]) * _FACTORS[i], starts)
    return out


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in words.slices(batches, "text"):
        hashes, first = shingle_hashes(words.split(batch.column("text"), lower=True))
        sets = [np.unique(hashes[a:b]) for a, b in zip(first, first[1:])]
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        with np.errstate(over="ignore"):
            prints = [(int(words.mixed(s).sum(dtype=np.uint64)).to_bytes(8, "big") + int(words.mixed(~s).sum(dtype=np.uint64)).to_bytes(8, "big")) for s in sets]
        signature = signatures(hashes, first)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(prints, pa.binary()), pa.array([s.tobytes() for s in signature], pa.binary())], ["doc_id", "n_shingles", "print", "signature"])


def shallowest(percent: int) -> int:
    """The longest prefix that all but `MISSED` of links at the threshold share in some tree."""
    return max(d for d in range(1, DEPTH + 1) if d == 1 or (1 - (percent / 100) ** d) ** TREES <= MISSED)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each class and tree: the tree and its minima, 15 bits of each of the first four and 16 of each of the others, in two numbers."""
    for batch in batches:
        s = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, TREES, DEPTH).astype(np.uint64)
        upper = np.broadcast_to(np.arange(TREES, dtype=np.uint64)[None, :], s.shape[:2]).copy()
        lower = np.zeros(s.shape[:2], np.uint64)
        for d in range(DEPTH):
            if d < 4:
                upper = upper << np.uint64(15) | s[:, :, d] & np.uint64(0x7FFF)
            else:
                lower = lower << np.uint64(16) | s[:, :, d] & np.uint64(0xFFFF)
        doc = np.repeat(batch.column("doc_id").to_numpy(), TREES)
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(upper.view(np.int64).ravel()), pa.array(lower.view(np.int64).ravel())], ["doc_id", "upper", "lower"])


def common_prefix(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """How many minima each row of an order shares with the row before it."""
    out = np.zeros(len(upper), np.int64)
    x, y = upper[1:] ^ upper[:-1], lower[1:] ^ lower[:-1]
    for d in range(1, 5):
        out[1:] += (x >> np.uint64(60 - 15 * d)) == 0
    for d in range(1, DEPTH - 3):
        out[1:] += (x == 0) & ((y >> np.uint64(64 - 16 * d)) == 0)
    return out


def pieces(shared: np.ndarray, low: int) -> list[tuple[int, int]]:
    """Stretches of a region in order, of `REGION` rows at most: cut where neighbours share least; shared[i] is about rows i - 1 and i."""
    out, todo = [], [(0, len(shared), low)]
    while todo:
        a, b, depth = todo.pop()
        if b - a <= REGION:
            out.append((a, b))
        elif depth >= DEPTH:
            out += [(i, min(i + REGION, b)) for i in range(a, b, REGION)]
        else:
            cut = [a, *(a + 1 + np.flatnonzero(shared[a + 1 : b] <= depth)).tolist(), b]
            todo += [(x, y, depth + 1) for x, y in zip(cut, cut[1:])]
    return sorted(out)


_REGIONS = "region long, doc_id long, whole long, part int, torn boolean"


def _regions(least: int):
    """Regions of a task's stretch of the orders; `whole` names the uncut region of those that were cut (torn) or touch an end of the stretch."""

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        first, torn = True, False  # whether the held rows begin with the stretch's first region, and with one that was cut already

        def found(rows: list[np.ndarray], ended: bool) -> pa.RecordBatch:
            nonlocal number, first, torn
            shared = common_prefix(rows[0], rows[1])
            begin = np.flatnonzero(shared < least)
            size = np.diff(np.append(begin, len(shared)))
            name = words.mixed(rows[0][begin] >> np.uint64(60 - 15 * min(least, 4))).view(np.int64)
            edge = np.zeros(len(begin), bool)
            edge[0] |= first or torn
            edge[-1] |= ended
            plain = np.flatnonzero((size > 1) & (size <= REGION))
            at = np.repeat(begin[plain], size[plain]) + np.arange(size[plain].sum()) - np.repeat(np.cumsum(size[plain]) - size[plain], size[plain])
            columns = [[np.repeat(number + np.arange(len(plain)), size[plain])], [rows[2][at]], [np.repeat(name[plain], size[plain])], [np.repeat((torn & (plain == 0)), size[plain])], [np.repeat(edge[plain], size[plain])]]
            number += len(plain)

            def add(region: int | None, doc: np.ndarray, i: int, cut: bool) -> None:
                for column, value in zip(columns, (-1 if region is None else region, doc, name[i], cut, True)):
                    column.append(value if column is columns[1] else np.full(len(doc), value))

            for i in np.flatnonzero((size > REGION) | (edge & (size == 1))).tolist():
                own = slice(begin[i], begin[i] + size[i])
                if size[i] == 1:
                    add(None, rows[2][own], i, torn and i == 0)
                    continue
                doc = rows[2][own]
                for a, b in pieces(shared[own], least):
                    add(number, doc[max(a - 1, 0) : b], i, True)
                    number += 1
            region, doc, name_, cut, edge_ = (np.concatenate(c) for c in columns)
            region = region.astype(np.int64)
            none = region < 0
            first = False
            return pa.RecordBatch.from_arrays([pa.array((np.int64(part) << 36) + region, mask=none), pa.array(doc, pa.int64()), pa.array(name_.astype(np.int64), mask=~edge_.astype(bool)), pa.array(np.full(len(doc), part, np.int32)), pa.array(cut.astype(bool))], [c.split(" ")[0] for c in _REGIONS.split(", ")])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column("upper").to_numpy().view(np.uint64), batch.column("lower").to_numpy().view(np.uint64), batch.column("doc_id").to_numpy()]
            held = [np.concatenate(x) for x in zip(held, new)]
            last = int(np.flatnonzero(common_prefix(held[0], held[1]) < least)[-1])
            if last:  # all regions but the last have ended
                yield found([x[:last] for x in held], False)
                held, torn = [x[last:] for x in held], False
            if len(held[0]) > HELD:  # a region too large to hold: its last row stays, as the next one's neighbour
                yield found(held, True)
                held, torn = [x[-1:] for x in held], True
        if len(held[0]):
            yield found(held, True)

    return regions


def _candidates(reps: DataFrame, least: int, scratch: tables.Scratch) -> tuple[DataFrame, DataFrame]:
    """region, doc_id: regions of at least two classes in the trees' orders; and set, doc_id: the uncut regions of which a piece was cut."""
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = reps.select("doc_id", "signature").mapInArrow(_keys, "doc_id long, upper long, lower long")
    order = rows.repartitionByRange(parts, "upper", "lower", "doc_id").sortWithinPartitions("upper", "lower", "doc_id")
    found = scratch.written(order.mapInArrow(_regions(least), _REGIONS), "regions")
    ends = found.where(F.col("whole").isNotNull())
    cut = ends.groupBy("whole").agg(F.max("torn").alias("torn"), F.min("part").alias("from"), F.max("part").alias("to")).where(F.col("torn") | (F.col("from") < F.col("to")))
    hot = ends.select("whole", "doc_id").distinct().join(cut.select("whole"), "whole")
    return found.where(F.col("region").isNotNull()).select("region", "doc_id"), hot.select(F.col("whole").alias("set"), "doc_id")


def _blocks(held: DataFrame, most: int) -> DataFrame:
    """group, doc_id: blocks in which each member of a set that is not in the set's largest part meets every other member.

    held: set, doc_id, part, weight.  A block has members of about twice the weight
    `most`; pairs inside the largest part, which are linked already, need not meet.
    """
    parts = held.groupBy("set", "part").agg(F.sum("weight").alias("weight"))
    sets = parts.groupBy("set").agg(F.max_by("part", F.struct("weight", "part")).alias("largest"), F.sum("weight").alias("all"), F.max("weight").alias("tied")).where(F.col("all") > F.col("tied"))
    rows = held.join(sets.select("set", "largest", F.ceil(F.col("all") / most).alias("columns"), F.ceil((F.col("all") - F.col("tied")) / most).alias("lines")), "set")
    line, column = (F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col(n)) for salt, n in ((1, "lines"), (2, "columns")))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one = rows.where(F.col("part") != F.col("largest")).select("set", "doc_id", line.alias("line"), every("columns").alias("column"))
    other = rows.select("set", "doc_id", every("lines").alias("line"), column.alias("column"))
    return one.unionByName(other).select(F.xxhash64("set", "line", "column").alias("group"), "doc_id").distinct()


def least_agreement(percent: int) -> float:
    p = percent / 100
    return p - SLACK * (p * (1 - p) / (TREES * DEPTH)) ** 0.5


def _tied(sizes: np.ndarray, s: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs that may be linked, strongest first (Prim)."""
    n = len(sizes)
    best, parent, out = np.full(n, -1.0), np.zeros(n, int), []
    left = np.ones(n, bool)
    at = 0
    for _ in range(n):
        left[at] = False
        rest = np.flatnonzero(left)
        if not len(rest):
            break
        agree = (s[rest] == s[at]).mean(axis=1)
        fits = 100 * np.minimum(sizes[rest], sizes[at]) >= percent * np.maximum(sizes[rest], sizes[at])
        better = fits & (agree > best[rest])
        best[rest[better]], parent[rest[better]] = agree[better], at
        at = int(rest[best[rest].argmax()])
        if best[at] >= least_agreement(percent):
            out.append((int(parent[at]), at))
    return out


def _forest(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of each region's forest; rows come ordered by region."""
    held: list[pa.RecordBatch] = []

    def edges(table: pa.Table) -> pa.RecordBatch:
        region, doc, size = (table.column(c).to_numpy() for c in ("region", "doc_id", "n_shingles"))
        s = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, TREES * DEPTH)
        start = np.flatnonzero(np.append(True, region[1:] != region[:-1]))
        count = np.diff(np.append(start, len(region)))
        two = start[count == 2]
        fits = 100 * np.minimum(size[two], size[two + 1]) >= percent * np.maximum(size[two], size[two + 1])
        two = two[fits]
        two = two[(s[two] == s[two + 1]).mean(axis=1) >= least_agreement(percent)]
        a, b = [doc[two]], [doc[two + 1]]
        for i, n in zip(start[count > 2].tolist(), count[count > 2].tolist()):
            if pairs := _tied(size[i : i + n], s[i : i + n], percent):
                x, y = np.array(pairs).T
                a.append(doc[i + x])
                b.append(doc[i + y])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        region = batch.column("region").to_numpy()
        last = int(np.searchsorted(np.cumsum(np.append(False, region[1:] != region[:-1])), (region[1:] != region[:-1]).sum()))
        if last:  # a region ends in this batch
            yield edges(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        elif held and held[-1].column("region")[0].as_py() != region[0]:
            yield edges(pa.Table.from_batches(held))
            held = []
        held.append(batch.slice(last))
    if held:
        yield edges(pa.Table.from_batches(held))


def _sets(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in words.slices(batches, "text"):
        hashes, first = shingle_hashes(words.split(batch.column("text"), lower=True), size)
        sets = pa.array([np.unique(hashes[a:b]).tobytes() for a, b in zip(first, first[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("group"), batch.column("part"), sets], ["doc_id", "group", "part", "set"])


def linked(ids: np.ndarray, sets: list[np.ndarray], part: np.ndarray | None = None, percent: int = PERCENT) -> np.ndarray:
    """For each of some sets the smallest id that confirmed links reach from it; exact.  Sets of one `part` are linked already."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(size) - size
    group, tried = np.arange(n) if part is None else np.unique(part, return_inverse=True)[1], np.zeros(n, bool)
    while True:
        label, count = np.unique(group, return_counts=True)
        open_ = np.flatnonzero((group != label[count.argmax()]) & ~tried) if len(label) < n else np.flatnonzero(~tried)
        if not len(open_) or len(label) == 1:
            break
        p = int(open_[size[open_].argmax()])
        tried[p] = True
        mark = np.zeros(code.max() + 1, np.int32)
        mark[code[begin[p] : begin[p] + size[p]]] = 1
        common = np.add.reduceat(mark[code], begin)
        hit = 100 * common >= percent * (size + size[p] - common)
        group[np.isin(group, np.unique(group[hit]))] = group[p]
    out = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(out, group, ids)
    return out[group]


def _confirmed(percent: int):
    def confirmed(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        ids = table.column("doc_id").to_numpy()
        least = linked(ids, [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()], table.column("part").to_numpy(), percent)
        return pa.table({"a": pa.array(least), "b": pa.array(ids)})

    return confirmed


def _in_parts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.select(F.col("node").alias("doc_id"), F.col("label").alias("part")), "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id"))


def confirmed_links(cut: DataFrame, forest: DataFrame, near: DataFrame, reps: DataFrame, percent: int, scratch: tables.Scratch, size: int = SHINGLE) -> DataFrame:
    """Links (a, b) inside the components `near` of a forest, decided on full sets of `size`-word shingles of the texts in `cut`: enough of them for the groups that all links make."""

    def confirmed(ends: DataFrame, name: str) -> DataFrame:
        texts = cut.join(tables.checked(ends), "doc_id").select("doc_id", "group", "part", "text")
        links = texts.mapInArrow(partial(_sets, size), "doc_id long, group long, part long, set binary").groupBy("group").applyInArrow(_confirmed(percent), "a long, b long")
        return scratch.written(links.where("a <> b"), name)

    sized = near.join(reps.select(F.col("doc_id").alias("node"), "n_shingles"), "node")
    weight = sized.groupBy("label").agg(F.ceil(F.sum("n_shingles") / GATHERED).alias("parts"))
    split = forest.join(near.withColumnRenamed("node", "a"), "a").join(weight, "label")
    group = F.xxhash64("label", F.pmod(F.xxhash64("a"), F.col("parts")))
    ends = split.select(group.alias("group"), F.explode(F.array("a", "b")).alias("doc_id")).distinct().withColumn("part", F.col("doc_id"))
    links = confirmed(scratch.written(ends, "neighbourhoods"), "links")
    large = scratch.written(sized.join(weight.where(F.col("parts") > 1), "label").select(F.col("label").alias("set"), F.col("node").alias("doc_id"), F.col("n_shingles").alias("weight")), "large")
    if not large.isEmpty():
        held = scratch.written(_in_parts(large, components(links, scratch)), "parts")
        ends = _blocks(held, max(GATHERED // 2, 1)).join(held.select("doc_id", "part"), "doc_id")
        links = links.unionByName(confirmed(scratch.written(ends, "blocks"), "links-blocks"))
    return links


def groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id that links of `percent` similarity or more reach), kept."""
    spark = docs.sparkSession
    with tables.Scratch(spark) as scratch:
        cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
        base = scratch.written(cut.mapInArrow(_base, "doc_id long, n_shingles long, print binary, signature binary"), "signatures")
        full = base.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
        several = full.groupBy("print", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")).where(F.col("rows") > 1)
        several = scratch.written(several.drop("rows"), "several")  # read from a table, so that Spark may split a class with very many rows
        members = full.select("doc_id", "print", "n_shingles").join(several, ["print", "n_shingles"], "left")
        members = scratch.written(members.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "members")
        reps = full.join(members.where(F.col("doc_id") == F.col("rep")).select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
        reps = scratch.written(reps.select("doc_id", "n_shingles", "signature"), "classes")
        regions, hot = _candidates(reps, shallowest(percent), scratch)
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

        def tied(regions: DataFrame, name: str) -> DataFrame:
            gathered = regions.join(reps, "doc_id").repartition(tasks, "region").sortWithinPartitions("region", "doc_id")
            return scratch.written(gathered.select("region", "doc_id", "n_shingles", "signature").mapInArrow(partial(_forest, percent), "a long, b long").distinct(), name)

        forest = tied(regions, "forest")
        near = components(forest, scratch)
        if not hot.isEmpty():
            met = _blocks(_in_parts(hot, near).withColumn("weight", F.lit(1)), max(REGION // 2, 1))
            forest = forest.unionByName(tied(met.withColumnRenamed("group", "region"), "forest-blocks")).distinct()
            near = components(forest, scratch)
        links = confirmed_links(cut, forest, near, reps, percent, scratch)
        labels = components(links, scratch)
        labels = labels.select(F.col("node").alias("rep"), "label")
        found = members.join(labels, "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("label", "rep")).alias("label"))
        out = base.select("doc_id", "n_shingles").join(found, "doc_id", "left")
        component = F.coalesce("label", "doc_id")
        return tables.written(out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")), "groups")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents."""
    return groups(tables.read(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, unnest([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, greatest(len(ws) - 3, 2))]) AS s FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM w UNION SELECT reach.node, link.b FROM reach JOIN link ON link.a = reach.seen)
SELECT w.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(seen) AS component_id, min(seen) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN reach ON reach.node = w.doc_id GROUP BY w.doc_id
"""
