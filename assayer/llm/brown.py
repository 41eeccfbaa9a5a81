"""Perplexity by a Brown class-based bigram model.

    P(text) = product of P(class of token | class of token before) * P(token | class)

Counting.  A task cuts its documents into blocks, gives each block's distinct
words local numbers, and sends every word bucket one packed list of the block's
words that fall to it, with their training counts.  A bucket adds up its words
over all blocks, exactly, and answers each block with the totals in the order
sent.  So the vocabulary is nowhere held whole, and a frequent word travels once
a block.

Classes.  Exchange clustering begins with the counts, over all training text, of
pairs of the `FREQUENT` most frequent words: each word moves to the class that
raises the likelihood of class bigrams most, until rounds change nothing.  Then
every other word that training holds `LEAST` times or more is exchanged on Spark:
blocks count the classes before and after its tokens, its bucket adds these up
over all blocks and moves it to the class that raises the likelihood most against
the class-by-class counts, which every task holds.  Rarer words, and words that no
class suits better, keep the class of their count's band and their shape; words
that training lacks belong to the lowest band, which keeps a share for them.

Transitions are counted over all training documents and smoothed towards the
classes' own frequency.

Defined results: null texts count as empty and are the end alone; a null doc_id
is trained on; with no training document every token is unseen.  An empty table
gives no rows; rows that repeat count and score each; of classes that suit a word
alike the first is taken; texts of any length count whole; other columns don't
matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import tables, words

#: Words that clustering begins with, classes, most rounds over them, and the least training count of the other words that are clustered.
FREQUENT, CLASSES, ROUNDS, LEAST = 1024, 48, 8, 2
#: Text bytes of a block and of a bucket's share, and entries that an exchange works on at once.
BLOCK_BYTES, BUCKET_BYTES, ENTRIES = 4 << 20, 24 << 20, 1 << 15
#: What unseen events count as, and the weight of the classes' frequency in transitions.
ADDED, PRIOR = 0.1, 5.0
_BANDS = np.array([2, 4, 10, 100])
_SHAPES = 6
_KINDS = (len(_BANDS) + 1) * _SHAPES
_END = CLASSES + _KINDS
_WIDTH = _END + 1
#: What a bucket answers for a word that keeps its class.
_STAYS = 255
_ROWS = 64


def _of_array(array: pa.Array) -> words.Words:
    data, offsets = words.buffers(array)
    return words.Words(data, offsets[:-1], offsets[1:], np.arange(len(offsets)))


def shapes(w: words.Words) -> np.ndarray:
    """0 to 5: whether a word holds a byte over 127, and whether it ends in a full stop, a comma or neither."""
    high = np.append(0, np.cumsum(w.data > 127))
    last = w.data[w.ends - 1] if len(w) else np.zeros(0, np.uint8)
    return ((high[w.ends] > high[w.starts]) * 3 + np.where(last == 46, 1, np.where(last == 44, 2, 0))).astype(np.uint8)


def _squeezed(*arrays: np.ndarray) -> bytes:
    return pa.Codec("zstd", 1).compress(b"".join(a.tobytes() for a in arrays), asbytes=True)


def _opened(data: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(data, size, asbytes=True)


_BLOCKS = "block long, bucket int, n int, bytes long, packed binary, docs array<long>, held array<boolean>, sizes array<int>, tokens binary"


def _named(shape: str) -> list[str]:
    return [c.split(" ")[0] for c in shape.split(", ")]


def _planes(index: np.ndarray) -> np.ndarray:
    """The bytes of numbers, all first ones before all second ones: zeros stand together, for the codec."""
    return np.ascontiguousarray(index.astype("<i4").view(np.uint8).reshape(-1, 4).T).ravel()


def _unplaned(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(4, -1).T).view("<i4").ravel()


def _stretches(sorted_: np.ndarray) -> list[tuple[int, int, int]]:
    """Each value of a sorted array with where it begins and ends."""
    begin = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(sorted_) else np.zeros(0, np.int64)
    return list(zip(sorted_[begin].tolist(), begin.tolist(), np.append(begin[1:], len(sorted_)).tolist()))


def _blocks(buckets: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, pa.RecordBatch, np.ndarray]] = []
        size, number = 0, TaskContext.get().partitionId() << 24

        def block() -> pa.RecordBatch:
            code = pa.concat_arrays([h[0] for h in held]).dictionary_encode()
            docs, out_ = (pa.concat_arrays([h[1].column(c) for h in held]) for c in ("doc_id", "held_out"))
            counts = np.concatenate([h[2] for h in held]).astype(np.int32)
            index, known = code.indices.to_numpy().astype(np.int32), _of_array(code.dictionary)
            train = np.repeat(~out_.to_numpy(zero_copy_only=False).astype(bool), counts)
            n = np.bincount(index[train], minlength=len(known)).astype(np.int32)
            hashes = known.hashes()
            of = (hashes % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            rows: list[list] = [[] for _ in range(9)]
            for b, begin, end in _stretches(of[order]):
                at = order[begin:end]
                text = b"\n".join(code.dictionary.take(pa.array(at)).to_pylist())
                packed = pa.Codec("zstd", 1).compress(n[at].tobytes() + text, asbytes=True)
                for column, value in zip(rows, (number, b, len(at), 4 * len(at) + len(text), packed, None, None, None, None)):
                    column.append(value)
            tokens = _squeezed(_planes(index), hashes, shapes(known))
            for column, value in zip(rows, (number, None, len(known), 4 * len(index) + 9 * len(known), None, docs.to_pylist(), out_.to_pylist(), counts, tokens)):
                column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], _named(_BLOCKS))

        for batch in words.slices(batches, "text"):
            w = words.split(batch.column("text"), lower=True)
            held.append((w.array(), batch.select(["doc_id", "held_out"]), w.counts))
            size += len(w.data)
            if size >= BLOCK_BYTES:
                yield block()
                size, number = 0, number + 1
        if held:
            yield block()

    return blocks


_ANSWERS = "block long, bucket int, n int, totals binary, places binary, state binary, words int, band_n array<long>, band_v array<long>, top array<binary>, top_n array<long>"


def _table(columns: list[list], shape: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<boolean>": pa.list_(pa.bool_()), "array<binary>": pa.list_(pa.binary())}
    fields = [c.split(" ") for c in shape.split(", ")]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _added(group: pa.Table) -> pa.Table:
    """Totals of a bucket's words for each block; and of the bucket its words' totals and bands, its sums and its most frequent words."""
    lists, counts, sizes = [], [], []
    for n, size, packed in zip(*(group.column(c).to_pylist() for c in ("n", "bytes", "packed"))):
        plain = _opened(packed, size)
        counts.append(np.frombuffer(plain, np.int32, n))
        lists.append(pa.array(plain[4 * n :].split(b"\n"), pa.binary()))
        sizes.append(n)
    code = pa.concat_arrays(lists).dictionary_encode()
    index, known = code.indices.to_numpy().astype(np.int32), _of_array(code.dictionary)
    total = np.zeros(len(known), np.int64)
    np.add.at(total, index, np.concatenate(counts).astype(np.int64))
    seen = total > 0
    band = band_of(total) * _SHAPES + shapes(known)
    band_n = np.zeros(_KINDS, np.int64)
    np.add.at(band_n, band, total)
    band_v = np.bincount(band[seen], minlength=_KINDS)
    top = [i for i in np.argsort(-total, kind="stable")[:FREQUENT].tolist() if total[i]]
    bucket = group.column("bucket")[0].as_py()
    columns: list[list] = [[] for _ in _named(_ANSWERS)]
    for block, n, part in zip(group.column("block").to_pylist(), sizes, np.split(index, np.cumsum(sizes)[:-1])):
        for column, value in zip(columns, (block, bucket, n, _squeezed(total[part]), _squeezed(part), *[None] * 6)):
            column.append(value)
    for column, value in zip(columns, (None, bucket, 0, None, None, _squeezed(total, known.hashes(), band.astype(np.uint8)), len(known), band_n, band_v, code.dictionary.take(pa.array(top, pa.int64())).to_pylist(), total[top])):
        column.append(value)
    return _table(columns, _ANSWERS)


def band_of(count: np.ndarray) -> np.ndarray:
    return np.searchsorted(_BANDS, count, "right")


def _pairs(top: list[bytes]):
    """Counts of neighbouring frequent words (others by shape, then the end) of a task's training texts, in blocks of rows."""
    width = len(top) + _SHAPES + 1
    known = _of_array(pa.array(top, pa.binary())).hashes()
    order = np.argsort(known)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width, np.int64)
        for batch in words.slices(batches, "text"):
            w = words.split(batch.column("text"), lower=True)
            h = w.hashes()
            code = len(top) + shapes(w).astype(np.int64)
            if len(top):
                k = np.minimum(np.searchsorted(known[order], h), len(top) - 1)
                code = np.where(known[order][k] == h, order[k], code)
            total += np.bincount(transitions(code, w.first, width - 1, width), minlength=width * width)
        matrix = total.reshape(width, width)
        if total.any():
            starts = range(0, width, _ROWS)
            yield pa.RecordBatch.from_arrays([pa.array([i // _ROWS for i in starts], pa.int32()), pa.array([_squeezed(matrix[i : i + _ROWS]) for i in starts], pa.binary())], ["rows", "counts"])

    return pairs, width


def transitions(code: np.ndarray, first: np.ndarray, end: int, width: int) -> np.ndarray:
    """before * width + after for each token of each text, with `end` before the first and after the last."""
    n = len(first) - 1
    sequence = np.full(len(code) + n + 1, end)
    sequence[np.arange(len(code)) + 1 + np.repeat(np.arange(n), np.diff(first))] = code
    return sequence[:-1] * width + sequence[1:]


def _summed(height: int, width: int):
    def add(group: pa.Table) -> pa.Table:
        row = group.column("rows")[0].as_py()
        n = min(_ROWS, height - row * _ROWS) * width
        total = np.zeros(n, np.int64)
        for x in group.column("counts").to_pylist():
            total += np.frombuffer(_opened(x, 8 * n), np.int64)
        return pa.table({"rows": pa.array([row], pa.int32()), "counts": pa.array([_squeezed(total)], pa.binary())})

    return add


#: Tasks whose rows of a matrix meet in one group; their sums meet after that.
SLOT = 256


def _matrix(parts: DataFrame, width: int) -> np.ndarray:
    """The sum of tasks' square matrices, added up in two levels; width is a model parameter, so it fits the driver."""
    out = np.zeros((width, width), np.int64)
    add, shape = _summed(width, width), "rows int, counts binary"
    some = parts.select("rows", F.floor(F.spark_partition_id() / SLOT).cast("int").alias("slot"), "counts").groupBy("rows", "slot").applyInArrow(add, shape)
    for r in some.groupBy("rows").applyInArrow(add, shape).collect():
        n = min(_ROWS, width - r["rows"] * _ROWS)
        out[r["rows"] * _ROWS :][:n] = np.frombuffer(_opened(r["counts"], 8 * n * width), np.int64).reshape(n, width)
    return out


def exchange(counts: np.ndarray, free: int, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Classes of the first `free` of the words that counts[before, after] is about; each other word is a class of its own.

    A word is taken out of its class and put where sum N(c, d) log N(c, d) -
    sum N(c) log N(c) over left and right totals is largest.
    """
    words_, fixed = len(counts), len(counts) - free
    total = classes + fixed
    group = np.concatenate([np.arange(free) % classes, classes + np.arange(fixed)]).astype(int)
    onehot = np.zeros((words_, total))
    onehot[np.arange(words_), group] = 1
    counts = counts.astype(np.float64)
    pair = onehot.T @ counts @ onehot
    xlogx = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)
    for _ in range(rounds):
        moved = 0
        for w in range(free):
            own = counts[w, w]
            right, left = np.bincount(group, counts[w], total), np.bincount(group, counts[:, w], total)
            g = group[w]
            right[g] -= own
            left[g] -= own
            pair[g] -= right
            pair[:, g] -= left
            pair[g, g] -= own
            a, b = pair[:classes] + right, pair[:, :classes] + left[:, None]  # rows and columns, if w joined
            gain = (xlogx(a) - xlogx(pair[:classes])).sum(axis=1) + (xlogx(b) - xlogx(pair[:, :classes])).sum(axis=0)
            d = np.arange(classes)
            both = pair[d, d]
            gain += xlogx(both + right[d] + left[d] + own) - xlogx(both + right[d]) - xlogx(both + left[d]) + xlogx(both)
            rows, columns = pair.sum(axis=1)[:classes], pair.sum(axis=0)[:classes]
            gain -= xlogx(rows + right.sum() + own) - xlogx(rows) + xlogx(columns + left.sum() + own) - xlogx(columns)
            best = int(gain.argmax()) if gain.max() > gain[g] + 1e-9 else g
            moved += best != g
            group[w] = best
            pair[best] += right
            pair[:, best] += left
            pair[best, best] += own
        if not moved:
            break
    return group[:free]


class _Block:
    """A block's tokens by local word, and its words' totals as buckets answered them."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        n, size, docs, held, counts, tokens = (batch.column(c)[i] for c in ("n", "bytes", "docs", "held", "sizes", "tokens"))
        self.docs, self.held, self.counts = docs.values, held.values, np.asarray(counts.values)
        self.plain, self.n, m = _opened(tokens.as_py(), size.as_py()), n.as_py(), int(self.counts.sum())
        self.index, self.at = _unplaned(np.frombuffer(self.plain, np.uint8, 4 * m)), 4 * m

    def taken(self, kind) -> np.ndarray:
        """The next array of a value for each word."""
        out = np.frombuffer(self.plain, kind, self.n, self.at)
        self.at += out.nbytes
        return out

    @staticmethod
    def answered(out: np.ndarray, of: np.ndarray, answers, column: str) -> list[tuple[int, np.ndarray]]:
        """Puts buckets' answers into `out`; returns each bucket's words."""
        order = np.argsort(of, kind="stable")
        lists = {b: order[begin:end] for b, begin, end in _stretches(of[order])}
        for a in answers or ():
            out[lists[a["bucket"]]] = np.frombuffer(_opened(a[column], out.itemsize * a["n"]), out.dtype)
        return list(lists.items())


_STATE = "block long, bucket int, n int, bytes long, packed binary, docs array<long>, held array<boolean>, sizes array<int>, tokens binary, rows int, counts binary"


def _neighbours(model: dict):
    """Blocks with their words' totals and first classes; what stands beside the words that are to be exchanged; and the task's class transitions."""

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.zeros(_WIDTH * _WIDTH, np.int64)
        for batch in batches:
            columns: list[list] = [[] for _ in _named(_STATE)]

            def put(*values) -> None:
                for column, value in zip(columns, values):
                    column.append(value)

            for i in range(batch.num_rows):
                block, number = _Block(batch, i), batch.column("block")[i].as_py()
                hashes, shape = block.taken(np.uint64), block.taken(np.uint8)
                total, of = np.zeros(block.n, np.int64), (hashes % np.uint64(model["buckets"])).astype(np.int64)
                lists = block.answered(total, of, batch.column("answers")[i].as_py(), "totals")
                group = (CLASSES + band_of(total) * _SHAPES + shape).astype(np.uint8)
                open_ = total >= model["least"]
                if len(model["hashes"]):
                    k = np.minimum(np.searchsorted(model["hashes"], hashes), len(model["hashes"]) - 1)
                    known = model["hashes"][k] == hashes
                    group[known], open_ = model["groups"][k][known], open_ & ~known
                first = np.append(0, np.cumsum(block.counts, dtype=np.int64))
                trained = ~np.asarray(block.held.to_numpy(zero_copy_only=False), bool)
                pair = transitions(group[block.index].astype(np.int64), first, _END, _WIDTH)
                in_text = np.repeat(trained, block.counts + 1)
                matrix += np.bincount(pair[in_text], minlength=_WIDTH * _WIDTH)
                token = np.flatnonzero(np.repeat(trained, block.counts) & open_[block.index])
                place = token + np.searchsorted(first, token, "right") - 1  # of the transition into the token
                word = block.index[token].astype(np.int64) << 8
                key, count = np.unique(np.concatenate([word | pair[place] // _WIDTH, word | 128 | pair[place + 1] % _WIDTH]), return_counts=True)
                size = np.bincount(key >> 8, minlength=block.n)
                begin = np.cumsum(size) - size
                for bucket, at in lists:
                    m = size[at]
                    if m.any():
                        e = np.repeat(begin[at] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                        plain = m.astype(np.int32), (key[e] & 255).astype(np.uint8), count[e].astype(np.int32)
                        put(number, bucket, len(at), sum(x.nbytes for x in plain), _squeezed(*plain), *[None] * 6)
                plain = _planes(block.index), of.astype(np.int32), total, group
                put(number, None, block.n, sum(x.nbytes for x in plain), None, block.docs.to_pylist(), block.held.to_pylist(), block.counts, _squeezed(*plain), None, None)
            if len(columns[0]):
                yield from _table(columns, _STATE).to_batches()
        parts = matrix.reshape(_WIDTH, _WIDTH)
        starts = range(0, _WIDTH, _ROWS)
        nothing = [None] * len(starts)
        yield from _table([*[nothing] * 9, [i // _ROWS for i in starts], [_squeezed(parts[i : i + _ROWS]) for i in starts]], _STATE).to_batches()

    return neighbours


def best_classes(word: np.ndarray, beside: np.ndarray, count: np.ndarray, stay: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """For each word the class whose likelihood gains most if it joins, or `_STAYS` where none gains more than its own.

    Entries, ordered by word: `count` tokens of a word stand after class `beside`,
    or before class `beside` - 128.  stay: each word's own class, which `pairs`
    (class by class) counts it in.
    """
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)
    n, pairs = len(stay), pairs.astype(np.float64)
    gain, own, size = np.zeros((n, CLASSES)), np.zeros(n), np.bincount(word, count, n) / 2
    joined = f(pairs)
    for i in range(0, len(word), ENTRIES):
        w, b, c = word[i : i + ENTRIES], beside[i : i + ENTRIES].astype(np.int64), count[i : i + ENTRIES].astype(np.float64)
        after, d = b < 128, b & 127
        held = np.where(after[:, None], pairs[d, :CLASSES], pairs[:CLASSES, d].T)
        was = np.where(after[:, None], joined[d, :CLASSES], joined[:CLASSES, d].T)
        begin = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        gain[w[begin]] += np.add.reduceat(f(held + c[:, None]) - was, begin, axis=0)
        now = np.where(after, pairs[d, stay[w]], pairs[stay[w], d])
        own += np.bincount(w, f(now) - f(now - c), n)
    for total in (pairs.sum(axis=0), pairs.sum(axis=1)):
        gain -= f(total[None, :CLASSES] + size[:, None]) - f(total[:CLASSES])[None, :]
        own -= f(total[stay]) - f(total[stay] - size)
    best = gain.argmax(axis=1)
    return np.where(gain[np.arange(n), best] > own + 1e-9, best, _STAYS).astype(np.uint8)


_CLASSES = "block long, bucket int, n int, classes binary, class_n array<long>, band_n array<long>, band_v array<long>, learned long"


def _exchanged(pairs: np.ndarray):
    """A bucket's words in their new classes, for each block; and what moved from bands to classes."""

    def exchanged(group: pa.Table) -> pa.Table:
        state, size, bucket = None, 0, group.column("bucket")[0].as_py()
        places, packed = {}, []
        for block, n, held, bytes_, own, known in zip(*(group.column(c).to_pylist() for c in ("block", "n", "places", "bytes", "packed", "words"))):
            if known is not None:
                state, size = held, known
            elif held is not None:
                places[block] = np.frombuffer(_opened(held, 4 * n), np.int32)
            else:
                packed.append((block, n, bytes_, own))
        state = _opened(state, 17 * size)
        total, band = np.frombuffer(state, np.int64, size), np.frombuffer(state, np.uint8, size, 16 * size).astype(np.int64)
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for block, n, bytes_, own in packed:
            plain = _opened(own, bytes_)
            m = np.frombuffer(plain, np.int32, n)
            k = int(m.sum())
            keys.append(np.repeat(places[block].astype(np.int64), m) << 8 | np.frombuffer(plain, np.uint8, k, 4 * n))
            counts.append(np.frombuffer(plain[4 * n + k :], np.int32).astype(np.int64))
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)
        word, local = np.unique(key >> 8, return_inverse=True)
        new = np.full(size, _STAYS, np.uint8)
        new[word] = best_classes(local, key & 255, count, CLASSES + band[word], pairs)
        moved = np.flatnonzero(new != _STAYS)
        columns: list[list] = [[] for _ in _named(_CLASSES)]
        for block, n, *_ in packed:
            for column, value in zip(columns, (block, bucket, n, _squeezed(new[places[block]]), *[None] * 4)):
                column.append(value)
        sums = [np.bincount(x, w, k).astype(np.int64) for x, w, k in ((new[moved], total[moved], CLASSES), (band[moved], total[moved], _KINDS), (band[moved], None, _KINDS))]
        for column, value in zip(columns, (None, bucket, 0, None, *sums, len(moved))):
            column.append(value)
        return _table(columns, _CLASSES)

    return exchanged


_DOCS = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, emitted double, classes binary"


def _classed(model: dict):
    """A row for each document of a block: its base score, what its words' emissions give, and its classes."""

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block(batch, i)
                of, total, group = block.taken(np.int32), block.taken(np.int64), block.taken(np.uint8)
                new = np.full(block.n, _STAYS, np.uint8)
                block.answered(new, of, batch.column("answers")[i].as_py(), "classes")
                group = np.where(new != _STAYS, new, group)
                base = np.log10(total + ADDED) - model["base"]
                emitted = np.log10(total + np.where(group < CLASSES, 0.0, ADDED)) - model["class_log"][group]
                first = np.append(0, np.cumsum(block.counts, dtype=np.int64))
                sums = [words.sums_by_text(x[block.index], first) for x in (total > 0, base, emitted)]
                sequence = group[block.index]
                columns = [block.docs, block.held, pa.array(block.counts.astype(np.int64) + 1), pa.array(sums[0].astype(np.int64) + (model["end_count"] > 0)), pa.array(sums[1] + np.log10(model["end_count"] + ADDED) - model["base"]), pa.array(sums[2])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([sequence[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())], _named(_DOCS))

    return classed


def _sequences(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = words.buffers(batch.column("classes"))
    return transitions(data.astype(np.int64), offsets, _END, _END + 1), offsets + np.arange(len(offsets))


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width, total = _END + 1, np.zeros((_END + 1) ** 2, np.int64)
    for batch in words.slices(batches, "classes"):
        total += np.bincount(_sequences(batch)[0], minlength=width * width)
    matrix = total.reshape(width, width)
    starts = range(0, width, _ROWS)
    yield pa.RecordBatch.from_arrays([pa.array([i // _ROWS for i in starts], pa.int32()), pa.array([_squeezed(matrix[i : i + _ROWS]) for i in starts], pa.binary())], ["rows", "counts"])


def _scored(log: np.ndarray, train_tokens: int):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "classes"):
            pair, first = _sequences(batch)
            total = words.sums_by_text(log[pair], first) + batch.column("emitted").to_numpy()
            keep = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep[:4]), pa.array(np.full(batch.num_rows, train_tokens, np.int64)), batch.column("base_score"), pa.array(total)], [*keep[:4], "train_tokens", "base_score", "score"])

    return scored


def _sums(rows: DataFrame, sizes: dict[str, int]) -> dict[str, np.ndarray]:
    """Sums of array columns of fixed lengths: one row."""
    found = rows.select(*[F.sum(F.col(c)[i]).alias(f"{c}{i}") for c, n in sizes.items() for i in range(n)]).first()
    return {c: np.array([found[f"{c}{i}"] or 0 for i in range(n)], np.int64) for c, n in sizes.items()}


def score(docs: DataFrame) -> DataFrame:
    """Scores documents (doc_id, text, held_out); learns from those that aren't held out."""
    spark = docs.sparkSession
    with tables.Scratch(spark) as scratch:
        cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.coalesce("held_out", F.lit(False)).alias("held_out"))
        sums = cut.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if(~F.col("held_out")).alias("train")).first()
        least, size = int(spark.conf.get("spark.sql.shuffle.partitions")), sums["bytes"] or 0
        buckets, parts = max(least, -(-size // BUCKET_BYTES)), max(least, -(-size // (3 * BLOCK_BYTES)))
        blocks = scratch.written(cut.mapInArrow(_blocks(buckets), _BLOCKS), "blocks")
        lists = blocks.where(F.col("bucket").isNotNull()).select("block", "bucket", "n", "bytes", "packed")
        answers = scratch.written(lists.groupBy("bucket").applyInArrow(_added, _ANSWERS), "totals")
        stats = answers.where(F.col("block").isNull())
        bands = _sums(stats, {"band_n": _KINDS, "band_v": _KINDS})
        found = stats.select(F.explode(F.arrays_zip("top", "top_n")).alias("x")).select("x.top", "x.top_n").orderBy(F.desc("top_n"), "top").limit(FREQUENT).collect()
        top, top_n = [bytes(r["top"]) for r in found], np.array([r["top_n"] for r in found], np.int64)
        train_tokens, distinct = int(bands["band_n"].sum()) + sums["train"], int(bands["band_v"].sum()) + (sums["train"] > 0)

        pairs, width = _pairs(top)
        group = exchange(_matrix(cut.where(~F.col("held_out")).select("text").mapInArrow(pairs, "rows int, counts binary"), width), len(top))
        known = _of_array(pa.array(top, pa.binary()))
        own, hashes = band_of(top_n) * _SHAPES + shapes(known), known.hashes()
        order = np.argsort(hashes)
        model = {"least": LEAST, "buckets": buckets, "hashes": hashes[order], "groups": group[order].astype(np.uint8), "base": np.log10(train_tokens + ADDED * (distinct + 1)), "end_count": sums["train"]}

        def answered(whole: DataFrame, replies: DataFrame, column: str) -> DataFrame:
            """Blocks with what buckets answered them."""
            held = replies.where(F.col("block").isNotNull()).repartition(parts, "block").groupBy("block").agg(F.collect_list(F.struct("bucket", "n", column)).alias("answers"))  # at most a block's words
            return whole.where(F.col("tokens").isNotNull()).select("block", "n", "bytes", "docs", "held", "sizes", "tokens").repartition(parts, "block").join(held, "block", "left")

        state = scratch.written(answered(blocks, answers.select("block", "bucket", "n", "totals"), "totals").mapInArrow(_neighbours(model), _STATE), "state")
        scratch.drop("blocks")
        beside = state.where(F.col("packed").isNotNull()).select("block", "bucket", "n", F.lit(None).cast("binary").alias("places"), "bytes", "packed", F.lit(None).cast("int").alias("words"))
        places = answers.select("block", "bucket", "n", F.coalesce("places", "state").alias("places"), F.lit(None).cast("long").alias("bytes"), F.lit(None).cast("binary").alias("packed"), "words")
        pairs = _matrix(state.where(F.col("rows").isNotNull()).select("rows", "counts"), _WIDTH)
        classes = scratch.written(beside.unionByName(places).groupBy("bucket").applyInArrow(_exchanged(pairs), _CLASSES), "classes")
        moved = _sums(classes.where(F.col("block").isNull()), {"class_n": CLASSES, "band_n": _KINDS, "band_v": _KINDS})
        band_n, band_v = bands["band_n"] - moved["band_n"], bands["band_v"] - moved["band_v"]
        np.subtract.at(band_n, own, top_n)
        np.subtract.at(band_v, own, 1)
        class_n = np.concatenate([np.bincount(group, top_n, CLASSES) + moved["class_n"], band_n + ADDED * (band_v + (np.arange(_KINDS) < _SHAPES)), [1.0]])
        model["class_log"] = np.log10(np.maximum(class_n, 1e-300))
        classed = tables.written(answered(state, classes.select("block", "bucket", "n", "classes"), "classes").drop("block").mapInArrow(_classed(model), _DOCS), "classed")
    n = _matrix(classed.where(~F.col("held_out")).select("classes").mapInArrow(_followed, "rows int, counts binary"), _WIDTH).astype(float)
    share = (n.sum(axis=0) + 0.5) / (n.sum() + 0.5 * len(n))
    log = np.log10((n + PRIOR * share) / (n.sum(axis=1, keepdims=True) + PRIOR)).ravel()
    return classed.mapInArrow(_scored(log, train_tokens), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents; a tenth is held out."""
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs.withColumn("held_out", tables.held_out("doc_id", 10, 0)))
