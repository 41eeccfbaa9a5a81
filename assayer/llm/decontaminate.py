"""Benchmark decontamination: CGK embeddings, bit-sampling LSH and exact edit distance.

Texts are words (A-Z lower-cased, runs of letters, digits and non-ASCII; in scripts
that don't part words, as Han, kana or Thai, each character is one).  A document
leaks an item if some stretch of it is within an edit distance, counted
in words, of (100 - PERCENT) % of the item's words.

CGK random-walk embedding: a walk starts at a window's first word and at step j
notes the word it stands on, then moves on or waits as a random function of j and
that word says.  Texts at a small edit distance walk in step again soon after
each edit, so their embeddings differ in few places.  Bit-sampling LSH takes some
places of the embedding as a key, with `WALKS` walks of `SAMPLES` keys each.  Edits
push a walk out of step, so long items are cut into segments of about `SEGMENT`
words, of which one has at most the average share of the edits.  Windows have the
size of the segments: these are put in classes of similar length, and a class
samples only places inside its shortest segment.

A window of which too few words occur in any item can't be within the distance
and isn't walked.  Equal segments of several items are one in the index.  A window
whose key is a segment's is a candidate for those of the segment's items of which
enough rare words (words of few items) stand in the document: an edit takes one word
at most, so a document that lacks more of them than edits are allowed can't leak the
item.  So a head that very many items share costs a document nothing for the items
that it doesn't hold, and no item is left out.  Where enough of an item's words stand
around a candidate, a semi-global alignment decides it exactly.

One map over whole documents, in which the items (at most `BLOCK_WORDS` words of
them; more go in several passes) are broadcast.

Items of fewer than `MIN_WORDS` words, which allow no edit or one, are looked for
word by word.  Chance finds the shortest of them in clean text too: where an item's
words have fewer than `MIN_BYTES` bytes its leaks are flagged `short`, and whoever
drops documents may leave these in.

Defined results: null and empty texts leak nothing, null and empty items are never
leaked; rows that repeat leak each; of an item's stretches that are equally close
the first is given; items with one text are each leaked; empty tables give no
rows.  Texts of any length count whole; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import tables, words

#: Least similarity in hundredths, words of the shortest item, and words of items in one pass.
PERCENT, MIN_WORDS, BLOCK_WORDS = 80, 8, 1 << 20
#: Bytes of an item's words under which a leak of it is flagged as short.
MIN_BYTES = 24
#: Items that a word of a rare one stands in at most.
RARE = 16
#: Walks, keys of each, and embedding places in a key.
WALKS, SAMPLES, PLACES = 4, 8, 3
#: Words of a segment: items of twice as many are cut.
SEGMENT = 15
#: A class's longest segment over its shortest.
SPREAD = 1.25
#: Kinds of words that a walk tells apart when it moves, and cells of an alignment that is worked on at once.
KINDS, CELLS = 256, 1 << 20
_START = 1 << 24


def distance_allowed(n: int) -> int:
    return (100 - PERCENT) * n // 100


class Items:
    """Items as word hashes, with the keys of their segments' embeddings by class and key number; short ones by their first word."""

    def __init__(self, ids: list, texts: list[str | None], seed: int = 5, min_bytes: int = MIN_BYTES):
        w = words.split(pa.array([(t or "").encode() for t in texts], pa.binary()), words.NOT_ALNUM, lower=True, characters=True)
        h = w.hashes()
        letters = words.sums_by_text(w.ends - w.starts, w.first)
        same: dict[bytes, list[int]] = {}  # items of the same words are one
        for i in np.flatnonzero(w.counts).tolist():
            same.setdefault(h[w.first[i] : w.first[i + 1]].tobytes(), []).append(i)
        own = sorted(same.values(), key=lambda x: (w.counts[x[0]] < MIN_WORDS, x))
        self.ids = [[ids[i] for i in x] for x in own]
        self.words = [h[w.first[x[0]] : w.first[x[0] + 1]] for x in own]
        self.brief = np.array([letters[x[0]] < min_bytes for x in own], bool)
        long = sum(len(x) >= MIN_WORDS for x in self.words)
        self.short = sorted((int(self.words[i][0]), i) for i in range(long, len(self.ids)))
        self.heads = np.array([x for x, _ in self.short], np.uint64)
        self.shorts = np.array([i for _, i in self.short], np.int64)
        short_words, self.words = self.words[long:], self.words[:long]
        self.known = np.unique(np.concatenate(self.words)) if long else np.zeros(0, np.uint64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.known >> np.uint64(44)).astype(np.int64)] = True
        self._rare()
        rng = np.random.default_rng(seed)
        cuts = [np.linspace(0, len(x), max(1, len(x) // SEGMENT) + 1).astype(np.int64) for x in self.words]
        self.item = np.repeat(np.arange(long), [len(c) - 1 for c in cuts])
        self.offset = np.concatenate([np.zeros(0, np.int64), *(c[:-1] for c in cuts)])
        kinds: dict[bytes, int] = {}
        self.kind = np.array([kinds.setdefault(x[a:b].tobytes(), len(kinds)) for x, c in zip(self.words, cuts) for a, b in zip(c, c[1:])], np.int64)
        segments = [np.frombuffer(k, np.uint64) for k in kinds]
        self.item_first = np.searchsorted(self.item, np.arange(long + 1))
        lone = np.flatnonzero(self.always[self.item])
        self.lone = lone[np.argsort(self.kind[lone], kind="stable")]
        self.lone_first = np.searchsorted(self.kind[self.lone], np.arange(len(segments) + 1))
        order = sorted(range(len(segments)), key=lambda i: len(segments[i]))
        self.classes = []
        while order:
            least = len(segments[order[0]])
            own = [i for i in order if len(segments[i]) <= least * SPREAD]
            order = order[len(own) :]
            steps = max(int(1.6 * least), PLACES)
            moves = rng.integers(0, 2, (WALKS, steps, KINDS), dtype=np.int8)
            places = [[np.sort(rng.choice(steps, PLACES, replace=False)) for _ in range(SAMPLES)] for _ in range(WALKS)]
            longest = len(segments[own[-1]])
            flat = np.concatenate([np.append(segments[i], np.uint64(0)) for i in own])
            begin = np.cumsum([0, *(len(segments[i]) + 1 for i in own[:-1])])
            stop = begin + [len(segments[i]) for i in own]
            keys = embedded(flat, begin, stop, moves, places)
            index = [(k[o := np.argsort(k, kind="stable")], np.array(own)[o]) for k in keys]
            maybe = np.zeros(1 << 18, bool)
            maybe[(np.concatenate(keys) >> np.uint64(46)).astype(np.int64)] = True
            self.classes.append((least, longest, moves, places, index, maybe))
        self.words += short_words

    def _rare(self) -> None:
        """Words of few items, and how many of an item's a document must hold; `always` are items of which it may hold none."""
        each = [np.unique(x) for x in self.words]
        flat, of = np.concatenate([np.zeros(0, np.uint64), *each]), np.repeat(np.arange(len(each)), [len(x) for x in each])
        word, code, count = np.unique(flat, return_inverse=True, return_counts=True)
        few = count[code] <= RARE
        order = np.argsort(code[few], kind="stable")
        self.rare, self.rare_items = word[count <= RARE], of[few][order]
        self.rare_first = np.append(0, np.cumsum(count[count <= RARE]))
        edits = np.array([distance_allowed(len(x)) for x in self.words], np.int64)
        self.need = np.bincount(of[few], minlength=len(each)) - edits
        self.always = self.need <= 0

    def allowed(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words h in documents `doc` the (document, item) pairs in which enough of the item's rare words stand; without items that need none."""
        k = np.minimum(np.searchsorted(self.rare, h), max(len(self.rare) - 1, 0))
        at = np.flatnonzero(self.rare[k] == h) if len(self.rare) else np.zeros(0, np.int64)
        pair = np.unique(doc[at] * len(self.rare) + k[at])
        doc, word = pair // max(len(self.rare), 1), pair % max(len(self.rare), 1)
        n = self.rare_first[word + 1] - self.rare_first[word]
        item = self.rare_items[np.repeat(self.rare_first[word], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        code, count = np.unique(np.repeat(doc, n) * len(self.need) + item, return_counts=True)
        doc, item = code // max(len(self.need), 1), code % max(len(self.need), 1)
        good = (count >= self.need[item]) & ~self.always[item]
        return doc[good], item[good]

    def spread(self, window: np.ndarray, kind: np.ndarray, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(First word of a window, segment) for each kind of segment that a window meets and each item of it that its document may hold."""
        of = np.searchsorted(first, window, "right") - 1
        own = np.zeros(len(first) - 1, bool)
        own[of] = True
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        some = np.flatnonzero(own[text])
        doc, item = self.allowed(h[some], text[some])
        kinds = len(self.lone_first) - 1
        n = self.item_first[item + 1] - self.item_first[item]
        segment = np.repeat(self.item_first[item], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        key = np.repeat(doc, n) * kinds + self.kind[segment]
        order = np.argsort(key, kind="stable")
        key, segment = key[order], segment[order]
        out = []
        for known, begin, stop in ((segment, *(np.searchsorted(key, of * kinds + kind, side) for side in ("left", "right"))), (self.lone, self.lone_first[kind], self.lone_first[kind + 1])):
            m = stop - begin
            out.append((np.repeat(window, m), known[np.repeat(begin, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]))
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])

    def exact(self, h: np.ndarray, w: words.Words) -> tuple[np.ndarray, np.ndarray]:
        """Where short items stand word by word: first words and items."""
        a, b = np.searchsorted(self.heads, h, "left"), np.searchsorted(self.heads, h, "right")
        n = b - a
        at = np.repeat(np.arange(len(h)), n)
        item = self.shorts[np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] if len(at) else at
        stop = w.first[np.searchsorted(w.first, at, "right")]
        good = [len(self.words[i]) <= e - p and (h[p : p + len(self.words[i])] == self.words[i]).all() for p, i, e in zip(at.tolist(), item.tolist(), stop.tolist())]
        return at[good], item[good]

    def contains(self, h: np.ndarray) -> np.ndarray:
        out = self.maybe[(h >> np.uint64(44)).astype(np.int64)]
        at = np.flatnonzero(out)
        k = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
        out[at] = self.known[k] == h[at]
        return out


def embedded(h: np.ndarray, begin: np.ndarray, stop: np.ndarray, moves: np.ndarray, places: list) -> list[np.ndarray]:
    """For each walk and sample a key of each text h[begin:stop]: hashes of the words noted at the sampled places (0 past the end)."""
    out = []
    steps = moves.shape[1]
    padded = np.concatenate([h, np.zeros(steps + 1, np.uint64)])  # a walk that has left its text notes nothing more
    kind = (padded & np.uint64(KINDS - 1)).astype(np.uint8)
    with np.errstate(over="ignore"):
        for walk, samples in enumerate(places):
            at, keys = begin.astype(np.int64), [np.full(len(begin), walk * SAMPLES + i + 1, np.uint64) for i in range(len(samples))]
            noted = {int(j) for s in samples for j in s}
            for j in range(max(noted) + 1):
                if j in noted:
                    word = np.where(at < stop, padded[at], np.uint64(0))
                    for i, s in enumerate(samples):
                        if j in s:
                            keys[i] = words.mixed(keys[i] * np.uint64(0x9E3779B97F4A7C15) + word)
                at += moves[walk, j][kind[at]]
            out += keys
    return out


def _candidates(h: np.ndarray, w: words.Words, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (first word of a window, kind of segment) whose keys meet."""
    inside = np.append(0, np.cumsum(items.contains(h)))
    end = np.repeat(w.first[1:], w.counts)
    found = [np.zeros((0, 2), np.int64)]
    for least, longest, moves, places, index, maybe in items.classes:
        stop = np.minimum(np.arange(len(h)) + least, end)
        start = np.flatnonzero(inside[stop] - inside[:-1] >= least - distance_allowed(longest))
        if not len(start):
            continue
        for key, (known, segment) in zip(embedded(h, start, end[start], moves, places), index):
            at = np.flatnonzero(maybe[(key >> np.uint64(46)).astype(np.int64)])
            a, b = np.searchsorted(known, key[at], "left"), np.searchsorted(known, key[at], "right")
            n = b - a
            k = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.stack([np.repeat(start[at], n), segment[k]], axis=1))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs[:, 0], pairs[:, 1]


def aligned(item: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The item's least edit distance to a stretch of each row of texts, and that stretch's start and stop."""
    cell = np.broadcast_to(np.arange(texts.shape[1] + 1), (len(texts), texts.shape[1] + 1)).copy()  # distance * _START + start
    ramp = np.arange(texts.shape[1] + 1) * _START
    for word in item:
        new = cell + _START
        new[:, 1:] = np.minimum(new[:, 1:], cell[:, :-1] + np.where(texts == word, 0, _START))
        cell = np.minimum.accumulate(new - ramp, axis=1) + ramp
    best = cell.argmin(axis=1)
    value = cell[np.arange(len(texts)), best]
    return value // _START, value % _START, best


def _leaks(shipped, keep: str):
    def leaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shipped.value
        for batch in words.slices(batches, "text"):
            w = words.split(batch.column("text"), words.NOT_ALNUM, lower=True, characters=True)
            if not len(w) or not items.ids:
                continue
            h = w.hashes()
            window, segment = items.spread(*_candidates(h, w, items), h, w.first)
            found = np.stack([items.item[segment], np.searchsorted(w.first, window, "right") - 1, window - items.offset[segment]], axis=1)
            item, of_doc, start = np.unique(found, axis=0).T
            rows = []
            for i in np.unique(item):
                word = items.words[i]
                n, k = len(word), distance_allowed(len(word))
                every, of = start[item == i], of_doc[item == i]
                far = k if n < 2 * SEGMENT else 2 * k  # edits before a segment shift it
                step = max(1, CELLS // (n + k + far))
                for c in range(0, len(every), step):
                    at, doc = every[c : c + step], of[c : c + step]
                    place = at[:, None] + np.arange(-k, n + far)[None, :]
                    out = (place < w.first[doc][:, None]) | (place >= w.first[doc + 1][:, None])
                    texts = np.where(out, np.uint64(1), h[np.clip(place, 0, len(h) - 1)])
                    own = np.sort(word)
                    held = own[np.minimum(np.searchsorted(own, texts), n - 1)] == texts
                    may = np.flatnonzero(held.sum(axis=1) >= n - k)  # within the distance, n - k of the item's words stand there
                    if not len(may):
                        continue
                    at, doc = at[may], doc[may]
                    d, a, b = aligned(word, texts[may])
                    good = d <= k
                    rows += zip(doc[good], np.full(good.sum(), i), d[good], (at - k + a)[good] - w.first[doc[good]], (b - a)[good])
            if len(items.heads):
                at, exact = items.exact(h, w)
                doc = np.searchsorted(w.first, at, "right") - 1
                rows += zip(doc, exact, np.zeros(len(at), np.int64), at - w.first[doc], np.array([len(items.words[i]) for i in exact], np.int64))
            best: dict[tuple, tuple] = {}
            for doc, i, d, a, n in rows:
                best[doc, i] = min(best.get((doc, i), (d, a, n)), (d, a, n))
            rows = sorted((doc, i, *v) for (doc, i), v in best.items())
            rows = [(*r, i) for r in rows for i in items.ids[r[1]]]
            docs = batch.column(keep).take(pa.array([r[0] for r in rows], pa.int64()))
            size = [len(items.words[r[1]]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [docs, pa.array([r[5] for r in rows], pa.int64()), pa.array([int(r[3]) for r in rows], pa.int64()), pa.array([int(r[4]) for r in rows], pa.int64()), pa.array([int(r[2]) for r in rows], pa.int32()), pa.array([1 - r[2] / n for r, n in zip(rows, size)], pa.float64()), pa.array([bool(items.brief[r[1]]) for r in rows], pa.bool_())],
                [keep, "item_id", "start_word", "n_words", "distance", "similarity", "short"],
            )

    return leaks


def leaks(docs: DataFrame, benchmark: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """A row for each document and item that it leaks: doc_id, item_id, start_word, n_words (the closest stretch), distance, similarity, short (the item has fewer than `min_bytes` bytes of words)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-size // (BLOCK_WORDS * 6)))
    cut = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    found = []
    for b in range(passes):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == b).orderBy("item_id", "text").collect()  # about BLOCK_WORDS words
        shipped = spark.sparkContext.broadcast(Items([r["item_id"] for r in rows], [r["text"] for r in rows], min_bytes=min_bytes))
        found.append(cut.mapInArrow(_leaks(shipped, "doc_id"), f"doc_id {dict(docs.dtypes)['doc_id']}, item_id long, start_word long, n_words long, distance int, similarity double, short boolean"))
    return reduce(DataFrame.unionByName, found)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of all benchmark items in all documents."""
    return leaks(tables.read(spark, sf_dir, "documents").select("doc_id", "text"), tables.read(spark, sf_dir, "benchmark").select("item_id", "text"))
