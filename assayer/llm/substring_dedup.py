"""Removal of repeated passages: windows of words, exactly counted by super-k-mers.

A window is `WINDOW` consecutive words of one document.  A window's minimiser is
the run of `MINIMISER` words in it with the smallest hash.  Consecutive windows
that share a minimiser travel as one packed string (a super-k-mer) to the
minimiser's bucket, so that equal windows of all documents meet in one bucket,
where sorting finds them exactly.

Runs that very many windows would choose come last in that order, so a window
takes one only if it holds nothing else, and no bucket gets a large share of the
windows.  One document in `SURVEYED` says which runs those are (as cells that
hashes fall into); that only orders them: equal windows always choose alike, so
what is found doesn't depend on it.

Before the shuffle, equal super-k-mers that a task holds become one, with the
smallest doc_id that has it; the task already knows that its other documents
repeat it.  A task remembers the super-k-mers that several documents shared, so
that a bucket gets a passage once a task, however many documents share it.  A
bucket reads its blocks one after another and holds each distinct super-k-mer
once, so a passage of all tasks takes no more memory than one of two.
Buckets answer with runs of repeated words, which meet their documents again.

Defined results: null texts have no words; rows with a null doc_id lose nothing
and take nothing from others; rows that share a doc_id, repeated rows too, don't
repeat each other; an empty table gives no rows.  Texts of any length count whole;
`remove_repeats` keeps columns of any name, and doc_id's type.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import tables, words

WINDOW, MINIMISER = 13, 3
#: One document in so many is surveyed for frequent runs; cells of runs' hashes, and by how many times the average a cell is frequent.
SURVEYED, CELLS, FREQUENT = 16, 1 << 20, 16
#: Most windows in a packed string; longer runs of a minimiser go as several.
LONGEST = 48
#: Bytes of text for each bucket, of packed strings that a task or a bucket holds before it sends or merges them, and of shared ones that a task remembers.
BUCKET_BYTES, HELD_BYTES, SHARED_BYTES = 3 << 20, 16 << 20, 16 << 20
#: Buckets that a task gets, on average.
BUCKETS = 5

_BLOCK = "bucket long, found boolean, rows int, bytes int, packed binary"
_LAST = np.uint64(1 << 63)
_RUNS = "doc_id long, start int, stop int"


def _run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n consecutive values."""
    out = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)]
        return words.mixed(out)


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each n consecutive values, by doubling."""
    width = 1
    while width * 2 <= n:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[: len(values) - (n - width)], values[n - width :]) if n > width else values


def super_kmers(w: words.Words, window: int = WINDOW, minimiser: int = MINIMISER, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of consecutive windows that share a minimiser: first word, number of words, and the minimiser's hash; `frequent` flags the cells of runs that come last."""
    if len(w) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    runs = _run_hashes(w.hashes(), minimiser) >> np.uint64(1)
    if frequent is not None:
        runs[frequent[(runs & np.uint64(CELLS - 1)).astype(np.int64)]] |= _LAST
    least = _least(runs, window - minimiser + 1)
    n = np.maximum(w.counts - window + 1, 0)  # windows of each text
    first = np.repeat(w.first[:-1], n)
    begin = np.cumsum(n) - n
    at = first + np.arange(len(first)) - np.repeat(begin, n)
    key = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)
    new[begin[n > 0]] = True
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(at)))
    pieces = -(-size // LONGEST)
    inner = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(start, pieces) + inner * LONGEST
    size = np.minimum(np.repeat(size, pieces) - inner * LONGEST, LONGEST)
    return at[start], size + window - 1, key[start]


def _joined(w: words.Words) -> tuple[bytes, np.ndarray]:
    """All words with one space after each, and where each begins."""
    size = w.ends - w.starts
    begin = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size + 1, out=begin[1:])
    out = np.full(begin[-1], 32, np.uint8)
    packed = np.frombuffer(w.array().buffers()[2] or b"", np.uint8)
    out[np.arange(len(packed)) + np.repeat(np.arange(len(size)), size)] = packed
    return out.tobytes(), begin


def _pack(docs: np.ndarray, first: np.ndarray, more: np.ndarray, texts: bytes) -> bytes:
    """Columns of a block, compressed; the documents as differences."""
    plain = np.diff(docs.astype(np.int64), prepend=0).tobytes() + first.astype(np.int32).tobytes() + more.astype(np.int32).tobytes() + texts
    return pa.Codec("zstd", 6).compress(plain, asbytes=True)


def _unpack(rows: int, size: int, packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    plain = pa.Codec("zstd").decompress(packed, 16 * rows + size, asbytes=True)
    return np.cumsum(np.frombuffer(plain, np.int64, rows)), np.frombuffer(plain, np.int32, rows, 8 * rows), np.frombuffer(plain, np.int32, rows, 12 * rows), plain[16 * rows :]


class _Outbox:
    """Holds a task's super-k-mers and sends each bucket a block of them."""

    def __init__(self, buckets: int, turn: int = 0):
        self.buckets, self.turn, self.held, self.texts, self.rows = buckets, turn, 0, [], []
        self.shared, self.least = pa.array([], pa.binary()), np.zeros(0, np.int64)

    def put(self, texts: list[bytes], docs: np.ndarray, first: np.ndarray, count: np.ndarray, bucket: np.ndarray) -> None:
        self.texts += texts
        self.rows.append((docs, first, count, bucket))
        self.held += sum(map(len, texts))

    def _remember(self, unique: pa.Array, code: np.ndarray, docs: np.ndarray, smallest: np.ndarray) -> None:
        """Lowers `smallest` to the documents that shared texts were sent for before, and remembers texts that documents share now."""
        known = pc.index_in(unique, value_set=self.shared)
        old = known.is_valid().to_numpy(zero_copy_only=False)
        at = known.drop_null().to_numpy()
        self.least[at] = smallest[old] = np.minimum(self.least[at], smallest[old])
        repeated = np.zeros(len(unique), bool)
        repeated[code[docs != smallest[code]]] = True
        new = np.flatnonzero(repeated & ~old)
        size = np.cumsum(pc.binary_length(unique).to_numpy()[new], dtype=np.int64)
        new = new[size <= SHARED_BYTES - self.shared.nbytes]
        self.shared, self.least = pa.concat_arrays([self.shared, unique.take(pa.array(new))]), np.append(self.least, smallest[new])

    def blocks(self) -> Iterator[pa.RecordBatch]:
        if not self.texts:
            return
        docs, first, count, bucket = (np.concatenate(x) for x in zip(*self.rows))
        code = pa.array(self.texts, pa.binary()).dictionary_encode()
        unique, code = code.dictionary, code.indices.to_numpy()
        smallest = np.full(len(unique), np.iinfo(np.int64).max)
        np.minimum.at(smallest, code, docs)
        self._remember(unique, code, docs, smallest)
        kept = np.flatnonzero(docs == smallest[code])
        gone = np.flatnonzero(docs != smallest[code])
        order = kept[np.lexsort((first[kept], code[kept], bucket[kept]))]
        cut = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1]))
        columns: list[list] = [[], [], [], [], []]

        def put(*values) -> None:
            for column, value in zip(columns, values):
                column.append(value)

        for at in np.split(order, cut[1:]):
            new = np.append(True, code[at][1:] != code[at][:-1])
            texts = b"\n".join(unique.take(pa.array(code[at][new])).to_pylist())
            put(bucket[at[0]], False, len(at), len(texts), _pack(docs[at], first[at], new, texts))
        step = max(1024, -(-len(gone) // self.buckets))
        for i in range(0, len(gone), step):  # the repeats that this task has found itself, dealt evenly
            at = gone[i : i + step]
            put(self.turn % self.buckets, True, len(at), 0, _pack(docs[at], first[at], first[at] + count[at], b""))
            self.turn += 1
        self.held, self.texts, self.rows = 0, [], []
        kinds = (pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["bucket", "found", "rows", "bytes", "packed"])


def _surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows by their minimiser's cell, where a cell has many; with cell -1 all windows, with -2 the bytes of all texts."""
    n, size = np.zeros(CELLS, np.int64), 0
    for batch in batches:
        size += int(pc.sum(batch.column("bytes")).as_py() or 0)
        for part in words.slices(iter([batch]), "text"):
            _, count, key = super_kmers(words.split(part.column("text")))
            cell, at = np.unique((key & np.uint64(CELLS - 1)).astype(np.int64), return_inverse=True)
            n[cell] += np.bincount(at, count - WINDOW + 1, len(cell)).astype(np.int64)
    many = np.flatnonzero(n > max(1, FREQUENT * n.sum() // (4 * CELLS)))
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], many])), pa.array(np.concatenate([[size, n.sum()], n[many]]))], ["cell", "n"])


def survey(docs: DataFrame, scratch: tables.Scratch) -> tuple[int, np.ndarray]:
    """Bytes of all texts, and the cells of frequent runs (of CELLS / FREQUENT at most)."""
    one = F.pmod(F.xxhash64("doc_id"), F.lit(SURVEYED)) == 0
    cut = docs.select(F.octet_length("text").cast("long").alias("bytes"), F.when(one, F.col("text")).cast("binary").alias("text"))
    cells = scratch.written(cut.mapInArrow(_surveyed, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), "cells")
    held = {r["cell"]: r["n"] for r in cells.where(F.col("cell") < 0).collect()}
    windows = held.get(-1, 0)
    rows = cells.where((F.col("cell") >= 0) & (F.col("n") > F.lit(max(8, FREQUENT * windows // CELLS)))).select("cell").collect()
    return held.get(-2, 0), np.array(sorted(r["cell"] for r in rows), np.int64)


def _send(buckets: int, shipped):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = _Outbox(buckets, TaskContext.get().partitionId() * 7919)
        frequent = np.zeros(CELLS, bool)
        frequent[shipped.value] = True
        for batch in words.slices(batches, "text", 1 << 20):
            w = words.split(batch.column("text"))
            start, count, key = super_kmers(w, frequent=frequent)
            if len(start):
                text, begin = _joined(w)
                of = np.searchsorted(w.first, start, "right") - 1
                found = [text[a:b] for a, b in zip(begin[start].tolist(), (begin[start + count] - 1).tolist())]
                docs = batch.column("doc_id").to_numpy()[of]
                box.put(found, docs, start - w.first[of], count, (key % np.uint64(buckets)).astype(np.int64))
            if box.held > HELD_BYTES:
                yield from box.blocks()
        yield from box.blocks()

    return send


def repeated_windows(code: np.ndarray, at: np.ndarray, docs: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For the windows code[at:at + window] of documents `docs`, whether a smaller document has the same one."""
    h = _run_hashes(code.astype(np.uint64), window)[at]
    order = np.argsort(h, kind="stable")
    new = np.append(True, h[order][1:] != h[order][:-1])
    same = np.flatnonzero(~new)
    for j in range(window):  # equal hashes must be equal windows
        if (code[at[order[same]] + j] != code[at[order[same - 1]] + j]).any():
            rows = code[at[:, None] + np.arange(window)[None, :]]
            order = np.lexsort(rows.T[::-1])
            new = np.append(True, (rows[order][1:] != rows[order][:-1]).any(axis=1))
            break
    group = np.cumsum(new) - 1
    smallest = np.minimum.reduceat(docs[order], np.flatnonzero(new))[group]
    out = np.zeros(len(at), bool)
    out[order] = docs[order] > smallest
    return out


class _Bucket:
    """The distinct super-k-mers of a bucket with the smallest document of each, and the places in it that hold them."""

    def __init__(self):
        self.texts, self.parts, self.docs, self.first = [], [], [], []
        self.added, self.least = 0, 0

    def put(self, docs: np.ndarray, first: np.ndarray, new: np.ndarray, plain: bytes) -> None:
        self.parts.append(np.cumsum(new) - 1 + len(self.texts))
        self.docs.append(docs)
        self.first.append(first)
        self.texts += plain.split(b"\n")
        self.added += len(plain) + 16 * len(docs)

    def full(self) -> bool:
        return self.added > max(HELD_BYTES, self.least)

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Equal texts become one; returns the runs of words that stand there for larger documents."""
        held = pa.array(self.texts, pa.large_binary()).dictionary_encode()
        text = held.indices.to_numpy()[np.concatenate(self.parts)]
        docs, first = np.concatenate(self.docs), np.concatenate(self.first)
        smallest = np.full(len(held.dictionary), np.iinfo(np.int64).max)
        np.minimum.at(smallest, text, docs)
        kept = docs == smallest[text]
        self.texts = held.dictionary.to_pylist()
        self.parts, self.docs, self.first = [text[kept]], [docs[kept]], [first[kept]]
        self.added, self.least = 0, sum(map(len, self.texts)) + 16 * int(kept.sum())
        gone = np.flatnonzero(~kept)
        count = np.array([self.texts[i].count(b" ") + 1 for i in text[gone].tolist()], np.int32)
        return docs[gone], first[gone], first[gone] + count

    def repeats(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of words that repeated windows cover, after `merged`."""
        part, docs, first = self.parts[0], self.docs[0], self.first[0]
        owner = np.zeros(len(self.texts), np.int64)
        owner[part] = docs
        w = words.split(pa.array(self.texts, pa.large_binary()))
        code = w.array().dictionary_encode().indices.to_numpy().astype(np.int64)
        n = w.counts - WINDOW + 1
        of = np.repeat(np.arange(len(n)), n)
        at = np.repeat(w.first[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = np.flatnonzero(repeated_windows(code, at, owner[of]))
        mark = np.zeros(len(w) + 1, np.int32)
        np.add.at(mark, at[hit], 1)
        np.add.at(mark, at[hit] + WINDOW, -1)
        covered = np.cumsum(mark[:-1]) > 0
        before = np.append(False, covered[:-1])
        edge = np.zeros(len(w) + 1, bool)
        edge[w.first] = True
        start = np.flatnonzero(covered & (~before | edge[:-1]))
        stop = np.flatnonzero(covered & (~np.append(covered[1:], False) | edge[1:])) + 1
        text_of = np.searchsorted(w.first, start, "right") - 1
        runs_from = np.searchsorted(text_of, np.arange(len(n) + 1))
        runs = (runs_from[1:] - runs_from[:-1])[part]
        i = np.repeat(np.arange(len(part)), runs)
        k = runs_from[part][i] + np.arange(len(i)) - np.repeat(np.cumsum(runs) - runs, runs)
        base = first[i] - w.first[part[i]]
        return docs[i], base + start[k], base + stop[k]


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of repeated words of the documents in one bucket's blocks."""
    bucket = _Bucket()

    def runs(docs: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], ["doc_id", "start", "stop"])

    for batch in batches:
        for found, rows, size, packed in zip(*(batch.column(c) for c in ("found", "rows", "bytes", "packed"))):
            docs, first, more, plain = _unpack(rows.as_py(), size.as_py(), packed.as_py())
            if found.as_py():
                yield runs(docs, first, more)
                continue
            bucket.put(docs, first, more, plain)
            if bucket.full():
                yield runs(*bucket.merged())
    if bucket.texts:
        yield runs(*bucket.merged())
        yield runs(*bucket.repeats())


def repeated_runs(docs: DataFrame) -> DataFrame:
    """Runs of words (doc_id, start, stop) that windows of a smaller doc_id cover; a word may be in several runs."""
    cut = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    spark = docs.sparkSession
    with tables.Scratch(spark) as scratch:
        size, frequent = survey(docs, scratch)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(tasks, -(-size // BUCKET_BYTES))
    sent = cut.mapInArrow(_send(buckets, spark.sparkContext.broadcast(frequent)), _BLOCK)
    return sent.repartition(max(tasks, buckets // BUCKETS), "bucket").groupBy("bucket").applyInArrow(_answer, _RUNS)


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows with texts compressed, for the shuffle."""
    codec = pa.Codec("zstd", 3)
    for batch in batches:
        at = batch.schema.get_field_index("text")
        packed = [None if x is None else len(x).to_bytes(8, "little") + codec.compress(x, asbytes=True) for x in batch.column(at).to_pylist()]
        yield batch.set_column(at, "text", pa.array(packed, pa.binary()))


def _unzipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd")
    for batch in words.slices(batches, "text", words.SLICE_BYTES // 4):
        at = batch.schema.get_field_index("text")
        texts = [None if x is None else codec.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True) for x in batch.column(at).to_pylist()]
        yield batch.set_column(at, "text", pa.array(texts, pa.binary()))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        total, gone, left = [], [], []
        for text, starts, stops in zip(texts, batch.column("starts"), batch.column("stops")):
            found = (text or b"").split()  # at exactly the ASCII white space of SPACES
            n = len(found)
            if starts.is_valid:
                mark = np.zeros(n + 1, np.int32)
                np.add.at(mark, np.asarray(starts.values), 1)
                np.add.at(mark, np.asarray(stops.values), -1)
                keep = np.flatnonzero(np.cumsum(mark[:-1]) == 0)
                found = [found[i] for i in keep.tolist()]
            total.append(n)
            gone.append(n - len(found))
            left.append(b" ".join(found))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _kept(_unzipped(batches)):
        digest = pa.array([hashlib.sha256(x).hexdigest() for x in batch.column("kept").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), batch.column("n_removed"), digest], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _with_runs(docs: DataFrame, *more) -> DataFrame:
    runs = repeated_runs(docs).groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *more)
    cut = cut.mapInArrow(_zipped, ", ".join(f"{c} {t}" for c, t in cut.dtypes))
    return cut.join(runs, "doc_id", "left")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with all their columns; texts that lose words become the words that stay, joined by one space."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    names = {c: f"kept_{i}" for i, c in enumerate(rest)}
    joined = _with_runs(docs, *(F.col(c).alias(n) for c, n in names.items())).select("doc_id", "text", *names.values(), "starts", "stops")

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _unzipped(batches):
            out = next(_kept(iter([part])))
            lost = out.column("n_removed").to_numpy() > 0
            text = pc.if_else(pa.array(lost), out.column("kept"), part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), text, *(part.column(n) for n in names.values())], ["doc_id", "text", *names.values()])

    types = dict(docs.dtypes)
    out = joined.mapInArrow(replaced, ", ".join(["doc_id long", "text binary", *(f"{n} {types[c]}" for c, n in names.items())]))
    back = {"doc_id": F.col("doc_id").cast(types["doc_id"]).alias("doc_id"), "text": F.col("text").cast("string").alias("text"), **{c: F.col(n).alias(c) for c, n in names.items()}}
    return out.select(*(back[c] for c in docs.columns))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents, as digests."""
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    return _with_runs(docs).select("doc_id", "text", "starts", "stops").mapInArrow(_digested, "doc_id long, n_words long, n_removed long, kept_sha256 string")


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM p),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
hit AS (SELECT doc_id, i FROM win JOIN least USING (s) WHERE doc_id > m),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM hit),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
mark AS (SELECT word.doc_id, word.word, word.j, gone.j IS NOT NULL AS g FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.j = gone.j),
res AS (SELECT doc_id, count(*) FILTER (WHERE g) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT g) AS kept FROM mark GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN res USING (doc_id)
"""
