"""Ranked lexical search over inverted treaps.

1. A map over whole documents writes an inverted index in shards of about
   `SHARD_BYTES` of text: each term's documents, in the order of their ids, and how
   often each holds it.  Nothing is shuffled; every term of every document is in it.
2. Sums over the shards give the corpus's documents, length and, of the terms that
   are asked for, document frequencies.
3. A shard makes a treap of each asked term's postings: a search tree by document,
   and a heap by the impact that the term gives a document's score, so that a
   subtree's root has its largest impact.  A query walks its terms' treaps together.
   A state is a range of documents with each term's root inside it; the sum of these
   roots' impacts bounds every score in the range.  The states with the highest bounds
   go first: the document of the heaviest root is scored, and parts the range in
   two.  A range is dropped where its bound can't enter the k best.
4. The shards' k best meet, first inside tasks, and the k best of these stay.

Queries are worked off in blocks of `BLOCK_TERMS` terms, which are broadcast.

Defined results: null and empty texts hold no term and count nowhere; rows with a
null doc_id aren't documents; rows that share a doc_id, repeated rows too, are
documents of their own, and so are items that share an item_id (each is answered
by itself); items without a term, or with none that a document holds, get no rows;
equal scores come by ascending doc_id; empty tables give no rows.  Texts of any
length count whole; other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.llm import exchange, tables, words

#: Bytes of text in a shard, terms of the queries in a block, and cells (states by terms) that a walk splits at once.
SHARD_BYTES, BLOCK_TERMS, CELLS = 16 << 20, 1 << 18, 1 << 14

_SHARD = "shard long, documents long, length long, terms long, postings long, doc_ids binary, lengths binary, keys binary, sizes binary, places binary, counts binary"


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts the distinct terms of each, as (text, hash, occurrences), by text and hash."""
    w = words.split(column, words.NOT_ALNUM, lower=True)
    h, text = w.hashes(), w.text_of()
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])) if len(h) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return text[first], h[first], np.diff(np.append(first, len(h)))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []
    number, size, rows = TaskContext.get().partitionId() << 24, 0, 0

    def shard() -> pa.RecordBatch:
        doc, text, term, tf = (np.concatenate(x) for x in zip(*held))
        n = np.bincount(text, tf, len(doc)).astype(np.int64)
        order = np.argsort(doc, kind="stable")
        order = order[n[order] > 0]
        place = np.full(len(doc), -1)
        place[order] = np.arange(len(order))
        at = np.lexsort((place[text], term))
        place, term, tf = place[text][at], term[at], tf[at]
        first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
        packed = (doc[order], n[order], np.diff(term[first], prepend=np.uint64(0)), np.diff(np.append(first, len(term))), np.diff(place, prepend=0), tf)
        row = (number, len(order), int(n.sum()), len(first), len(term), *map(exchange.squeezed, (x if x.dtype == np.uint64 else x.astype(np.int64) for x in packed)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for v in row], [c.split(" ")[0] for c in _SHARD.split(", ")])

    for batch in words.slices(batches, "text"):
        text, term, tf = terms_of(batch.column("text"))
        held.append((batch.column("doc_id").to_numpy(), text + rows, term, tf))
        size, rows = size + batch.column("text").nbytes, rows + batch.num_rows
        if size >= SHARD_BYTES:
            yield shard()
            number, size, rows = number + 1, 0, 0
    if held:
        yield shard()


def index(docs: DataFrame) -> DataFrame:
    """The inverted index of all documents: a row for each shard."""
    cut = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return tables.written(cut.mapInArrow(_shards, _SHARD).where("documents > 0"), "shards")


def _frequencies(asked):
    """How many documents of each shard hold the asked terms."""

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked.value), np.int64)
        for batch in exchange.in_slices(batches):
            r = batch.to_pylist()[0]
            keys = np.cumsum(exchange.opened(r["keys"], r["terms"], np.uint64), dtype=np.uint64)
            at = np.minimum(np.searchsorted(keys, asked.value), len(keys) - 1)
            total += np.where(keys[at] == asked.value, exchange.opened(r["sizes"], r["terms"])[at], 0)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(asked.value[held].view(np.int64)), pa.array(total[held])], ["term", "df"])

    return frequencies


def treaps(first: np.ndarray, priority: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and right children (-1: none) of the treaps over postings first[t] to first[t + 1], in order, and their roots."""
    p = priority.tolist()
    left, right, roots = [-1] * len(p), [-1] * len(p), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        path: list[int] = []  # from the root to the right
        for i in range(a, b):
            below, x = -1, p[i]
            while path and p[path[-1]] < x:
                below = path.pop()
            left[i] = below
            if path:
                right[path[-1]] = i
            path.append(i)
        roots.append(path[0])
    return np.array(left, np.int64), np.array(right, np.int64), np.array(roots, np.int64)


class Treaps:
    """Treaps of some terms: place (in the order of ids), impact and children of each node; the last node stands for none."""

    def __init__(self, first: np.ndarray, place: np.ndarray, impact: np.ndarray):
        with np.errstate(over="ignore"):
            even = words.mixed(place.astype(np.uint64)) >> np.uint64(34)  # decides between equal impacts, so that trees stay shallow
        left, right, self.roots = treaps(first, (impact << 30) + even.astype(np.int64))
        none = len(place)
        self.none = none
        self.place, self.impact = np.append(place, -1), np.append(impact, 0)
        self.left, self.right = (np.append(np.where(x < 0, none, x), none) for x in (left, right))

    def _moved(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Each node's first descendant (or itself) that is after place `low` and before `high`."""
        shape, node = node.shape, node.ravel().copy()
        low, high = (np.broadcast_to(x[:, None], shape).ravel() for x in (low, high))
        open_ = np.flatnonzero(node != self.none)
        while len(open_):
            own = node[open_]
            at = self.place[own]
            under, over = at <= low[open_], at >= high[open_]
            step = under | over
            open_, own = open_[step], np.where(under[step], self.right[own[step]], self.left[own[step]])
            node[open_] = own
            open_ = open_[own != self.none]
        return node.reshape(shape)

    def search(self, terms: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best documents (score above 0) for some of the treaps, best first."""
        best_score, best_place = np.zeros(0, np.int64), np.zeros(0, np.int64)
        node = self.roots[terms][None, :]
        low, high = np.array([-1]), np.array([np.iinfo(np.int64).max])
        bound = self.impact[node] @ weight
        at_once = max(1, CELLS // max(len(terms), 1))
        while len(bound):
            take = np.argpartition(-bound, at_once - 1)[:at_once] if len(bound) > at_once else np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[take] = False
            own, lo, hi = node[take], low[take], high[take]
            pivot = self.place[own[np.arange(len(own)), (self.impact[own] * weight).argmax(axis=1)]]
            score = self.impact[self._moved(own, pivot - 1, pivot + 1)] @ weight
            best_score, best_place = np.append(best_score, score[score > 0]), np.append(best_place, pivot[score > 0])
            order = np.lexsort((best_place, -best_score))[:k]
            best_score, best_place = best_score[order], best_place[order]
            parts = [(self._moved(own, a, b), a, b) for a, b in ((lo, pivot), (pivot, hi))]
            node = np.concatenate([node[rest], *(p[0] for p in parts)])
            low = np.concatenate([low[rest], *(p[1] for p in parts)])
            high = np.concatenate([high[rest], *(p[2] for p in parts)])
            bound = np.concatenate([bound[rest], *(self.impact[p[0]] @ weight for p in parts)])
            keep = bound > 0
            if len(best_score) == k:  # a later document needs a higher score, one before the last of the best the same
                keep &= (bound > best_score[-1]) | ((bound == best_score[-1]) & (low < best_place[-1] - 1))
            node, low, high, bound = node[keep], low[keep], high[keep], bound[keep]
        return best_place, best_score


def _searched(asked, corpus: tuple[int, int], k: int):
    """A shard's k best documents of each query: (query, doc_id, score)."""
    documents, length = corpus

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, queries = asked.value
        for batch in exchange.in_slices(batches):
            r = batch.to_pylist()[0]
            keys = np.cumsum(exchange.opened(r["keys"], r["terms"], np.uint64), dtype=np.uint64)
            size = exchange.opened(r["sizes"], r["terms"])
            here = np.flatnonzero(np.isin(keys, known))
            begin = (np.cumsum(size) - size)[here]
            n = size[here]
            first = np.append(0, np.cumsum(n))
            at = np.repeat(begin - first[:-1], n) + np.arange(first[-1])
            place = np.cumsum(exchange.opened(r["places"], r["postings"]))[at]
            tf = exchange.opened(r["counts"], r["postings"])[at]
            m = 100 - 75 + 75 * exchange.opened(r["lengths"], r["documents"]) * documents // length
            held = Treaps(first, place, 1_000_000_000 * tf // (1000 * tf + 8 * m[place]))
            keys, doc_ids = keys[here], exchange.opened(r["doc_ids"], r["documents"])
            out: list[tuple[np.ndarray, ...]] = []
            for number, terms, weight in queries:
                found = np.minimum(np.searchsorted(keys, terms), max(len(keys) - 1, 0))
                own = np.flatnonzero(keys[found] == terms) if len(keys) else np.zeros(0, np.int64)
                if len(own):
                    places, score = held.search(found[own], weight[own], k)
                    out.append((np.full(len(places), number), doc_ids[places], score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], ["query", "doc_id", "score"])

    return searched


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's distinct terms and how often it holds them."""
    for batch in words.slices(batches, "text"):
        text, term, n = terms_of(batch.column("text"))
        offsets = pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.ListArray.from_arrays(offsets, pa.array(term.view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int64)))], ["item_id", "terms", "repeats"])


def _in_blocks(rows: Iterator, most: int) -> Iterator[list]:
    held, size = [], 0
    for row in rows:
        if held and size + len(row["terms"]) > most:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row["terms"])
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, k: int = 10, block: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents that score highest for each item."""
    spark, found = docs.sparkSession, []
    kind = dict(items.dtypes)["item_id"]
    shards = index(docs)
    documents, length = shards.agg(F.sum("documents"), F.sum("length")).first()
    with tables.Scratch(spark) as scratch:
        cut = items.select("item_id", F.col("text").cast("binary").alias("text"))
        asked = scratch.written(cut.mapInArrow(_asked, f"item_id {kind}, terms array<long>, repeats array<long>").where(F.size("terms") > 0), "asked")
        number = 0
        for rows in _in_blocks(asked.toLocalIterator() if documents else (), block):
            known = np.unique(np.concatenate([np.array(r["terms"], np.int64).view(np.uint64) for r in rows]))
            df = {r["term"]: r["df"] for r in shards.select("terms", "keys", "sizes").mapInArrow(_frequencies(spark.sparkContext.broadcast(known)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}  # at most a block's terms
            queries = []
            for i, r in enumerate(rows):
                weight = [n * math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) if t in df else 0 for t, n in zip(r["terms"], r["repeats"])]
                queries.append((number + i, np.array(r["terms"], np.int64).view(np.uint64), np.array(weight, np.int64)))
            scored = shards.mapInArrow(_searched(spark.sparkContext.broadcast((known, queries)), (documents, length), k), "query long, doc_id long, score long")
            names = spark.createDataFrame([(number + i, r["item_id"]) for i, r in enumerate(rows)], f"query long, item_id {kind}")
            rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
            best = scored.withColumn("rank", rank).where(F.col("rank") <= k)
            found.append(tables.written(best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"), "found"))  # names: at most a block's items
            number += len(rows)
    tables.gone(spark, shards.inputFiles()[0].rsplit("/", 1)[0]) if documents else None
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")


def op12_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of all for each benchmark item."""
    return search(tables.read(spark, sf_dir, "documents").select("doc_id", "text"), tables.read(spark, sf_dir, "benchmark").select("item_id", "text"))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM d),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), c),
s AS (SELECT q.item_id, tf.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // l))))) AS BIGINT) AS score
      FROM q JOIN tf USING (term) JOIN w USING (term) JOIN d ON d.doc_id = tf.doc_id, c GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""
