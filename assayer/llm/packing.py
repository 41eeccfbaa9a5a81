"""Mixture-controlled packing of documents into fixed-length sequences.

Documents are tokenised once, into a written table.  Each source is a queue of
its documents' tokens; sums over the table's parts place every document in its
queue without a task that sees a whole queue.  Pack partitions then take ranges
of all queues, each its target share, with the fractions that rounding leaves
carried from partition to partition; documents are cut where a range ends.  In a
partition deficit round-robin fills every window: each source's deficit grows by
its share of a window, sources whose deficit is worth a piece are served in turn,
what a window couldn't give is carried to the next, and a window that deficits
don't fill takes from the sources that are owed most.

The last window of a partition is cut into sequences of powers of two, so there
is no padding.  With no targets given the shares are those of the corpus, so
that all windows hold the same mixture; given targets hold until a source runs
out, and then the others share its part.

Defined results: null and empty texts are the end token alone; null sources are
one queue; rows that share a doc_id, repeated rows too, are packed each, equal
ones in any order; a null doc_id stays null; texts of any length go whole, cut
where windows end; an empty table gives no rows; other columns of any name don't
matter.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.llm import tables, words

#: Tokens of a sequence, windows of a pack partition, the least deficit that is served, and the token that ends a document.
LENGTH, WINDOWS, PIECE, END = 2048, 256, 64, 1
#: Pack partitions that a task gets, on average.
PACKS = 6
# Fixed value: what the byte-level vocabulary splits texts by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SEQUENCES = 1 << 20


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of whole texts, those of the tokenizers library.

    The vocabulary's pattern never joins what stands before a single space or a
    newline between visible characters with what follows, nor letters with the
    stop that ends them, so a text is cut there and each distinct piece of a
    batch is encoded once.  Plain pieces go to tiktoken, with the same vocabulary,
    as one text in which the same rule keeps them apart; others, and all pieces
    of a vocabulary that isn't in merge order, to tokenizers.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast, self.size = self._merged(path)

    def _merged(self, path: str):
        """A tiktoken encoding of the same vocabulary and each token's bytes; nothing where ranks don't follow from it."""
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model = held["model"]
        if model.get("type") != "BPE" or held.get("normalizer") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or held["pre_tokenizer"].get("type") != "ByteLevel" or held["pre_tokenizer"].get("add_prefix_space"):
            return None, None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}  # the byte alphabet's letters
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if any(model["vocab"][m] != 256 + i for i, m in enumerate(merges)):
            return None, None
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            size[i] = len(token)
        return tiktoken.Encoding("merged", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces, how many each has, and where they begin."""
        data, offsets = words.buffers(pieces)
        n = np.zeros(len(pieces), np.int64)
        spaced = np.zeros(len(pieces), bool)
        plain = np.zeros(len(pieces), bool)
        if self.fast is not None and len(data):
            fine = _CLEAR[data]
            first = data[offsets[:-1]]
            spaced = (first == 0x20) & (np.diff(offsets) > 1)
            fine[offsets[:-1][spaced]] = True
            bad = np.append(0, np.cumsum(~fine))
            plain = bad[offsets[1:]] == bad[offsets[:-1]]
            for s in self.special:
                if s in data.tobytes():
                    plain &= ~np.asarray(pc.match_substring(pieces, s.decode()).to_numpy(zero_copy_only=False), bool)
        parts, order = [], []
        for own, between in ((plain & spaced, b""), (plain & ~spaced, b"\n")):
            at = np.flatnonzero(own)
            if len(at):
                some = pieces.take(pa.array(at)).to_pylist()
                ids = np.asarray(self.fast.encode_ordinary(between.join(some).decode("utf-8")), np.int64)
                length = np.fromiter(map(len, some), np.int64, len(some)) + len(between)
                stop = np.cumsum(length) - len(between)
                edge = np.append(0, np.cumsum(self.size[ids]))
                k0, k1 = np.searchsorted(edge, stop - length + len(between)), np.searchsorted(edge, stop)
                n[at] = k1 - k0
                parts.append(ids if not between else ids[np.repeat(k0 - (np.cumsum(k1 - k0) - (k1 - k0)), k1 - k0) + np.arange((k1 - k0).sum())])
                order.append(at)
        at = np.flatnonzero(~plain)
        if len(at):
            found = self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in pieces.take(pa.array(at)).to_pylist()], add_special_tokens=False)
            ids = [e.ids for e in found]
            n[at] = np.fromiter(map(len, ids), np.int64, len(ids))
            parts.append(np.fromiter(chain.from_iterable(ids), np.int64))
            order.append(at)
        order = np.concatenate(order)
        begin = np.zeros(len(pieces), np.int64)
        begin[order] = np.cumsum(n[order]) - n[order]
        return np.concatenate(parts).astype(self.dtype), n, begin

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and each text's offset in them."""
        data, offsets = words.buffers(column)
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        if len(data) > 2:
            before, after = _known_end(data), _CLEAR[data] & ((data < 0x80) | (data >= 0xC0))
            gap = np.zeros(len(data), bool)
            gap[1:-1] = before[:-2] & after[2:]
            line = gap & (data == 0x0A)
            cut[:-1] |= gap & (data == 0x20) | line
            cut[1:] |= line
            cut[1:-1] |= _STOP[data[1:]] & _letter_end(data)[:-1]
        edges = np.flatnonzero(cut)
        if len(edges) < 2:
            return np.zeros(0, self.dtype), np.zeros(len(offsets), np.int64)
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        code = pieces.dictionary_encode()
        flat, size, begin = self._pieces(code.dictionary)
        code = code.indices.to_numpy()
        n = size[code]
        total = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=total[1:])
        out = flat[np.repeat(begin[code] - total[:-1], n) + np.arange(total[-1])]
        return out, total[np.searchsorted(edges, offsets)]


# Bytes of characters that are visible for certain: ASCII, and those with a lead byte of no white space.
_CLEAR = words.byte_class((0x21, 0x7E), (0x80, 0xBF), (0xC3, 0xDF), (0xE4, 0xED))
_STOP = words.byte_class((0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B))


def _known_end(data: np.ndarray) -> np.ndarray:
    """Whether a byte ends a character that is visible for certain."""
    tail = (data >= 0x80) & (data < 0xC0)
    out = (data > 0x20) & (data < 0x7F)
    out[1:] |= tail[1:] & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
    out[2:] |= tail[2:] & tail[1:-1] & (data[:-2] >= 0xE4) & (data[:-2] < 0xEE)
    return out


def _letter_end(data: np.ndarray) -> np.ndarray:
    """Whether a byte ends an ASCII letter, or an accented one of Latin-1."""
    low = words.LOWER[data]
    out = (low >= 0x61) & (low <= 0x7A)
    out[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    return out


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, source, ids (bytes of unsigned integers, END last), n, and the document's place in its part's queue of its source: a written table."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = Encoder(path), TaskContext.get().partitionId(), {}
        for batch in words.slices(batches, "text", 3 << 20):
            ids, offset = encoder(batch.column("text"))
            end = np.array([END], ids.dtype).tobytes()
            n = np.diff(offset) + 1
            place = []
            for source, k in zip(batch.column("source").to_pylist(), n.tolist()):
                place.append(at.get(source, 0))
                at[source] = place[-1] + k
            packed = [ids[a:b].tobytes() + end for a, b in zip(offset, offset[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(packed, pa.binary()), pa.array(n), pa.array(np.full(len(n), part)), pa.array(place, pa.int64())], ["doc_id", "source", "ids", "n", "part", "place"])

    cut = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text").cast("binary").alias("text"))
    shape = f"doc_id {dict(docs.dtypes)['doc_id']}, source string, ids binary, n long, part long, place long"
    return tables.written(cut.mapInArrow(encode, shape), "tokens")


class Shares:
    """How many tokens of a source go to pack partitions before the g-th."""

    def __init__(self, partitions: int, totals: Mapping[str, int] | None = None, targets: Mapping[str, float] | None = None):
        self.partitions, self.curves = partitions, {}
        if targets is None:
            return
        left, x = {s: float(n) for s, n in totals.items() if n}, 0.0
        whole, weight = sum(left.values()), {s: max(float(targets.get(s, 0.0)), 1e-9) for s in left}
        self.curves = {s: [(0.0, 0.0)] for s in left}
        while left:  # until the next source runs out shares are constant
            share = sum(weight[s] for s in left)
            step = min(left[s] * share / weight[s] for s in left)
            x += step
            for s in list(left):
                left[s] -= step * weight[s] / share
                self.curves[s].append((x / whole, totals[s] - max(left[s], 0.0)))
                if left[s] < 0.5:
                    del left[s]

    def before(self, source: str, total: int, g: int) -> int:
        if g <= 0 or g >= self.partitions:
            return 0 if g <= 0 else total
        if not self.curves:
            return total * g // self.partitions
        curve, x = self.curves[source], g / self.partitions
        k = bisect_right(curve, (x, float("inf")))
        if k >= len(curve):
            return total
        (x0, y0), (x1, y1) = curve[k - 1], curve[k]
        return min(total, int(y0 + (y1 - y0) * (x - x0) / max(x1 - x0, 1e-300)))

    def holding(self, source: str, total: int, token: int) -> int:
        if not self.curves:
            return ((token + 1) * self.partitions - 1) // total
        low, high = 0, self.partitions - 1
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.before(source, total, mid) <= token else (low, mid - 1)
        return low


def _dealt(shares: Shares, width: int):
    """Documents with their place in their source's queue, cut where pack partitions begin."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for doc, source, at, n, total, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source", "at", "n", "total", "ids"))):
                g, start = shares.holding(source, total, at), 0
                while start < n:
                    stop = min(n, shares.before(source, total, g + 1) - at)
                    if stop > start:
                        for column, value in zip(out, (g, source, at + start, doc, start, n, ids[start * width : stop * width])):
                            column.append(value)
                        start = stop
                    g += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.int64(), batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.binary()))], ["pack", "source", "at", "doc_id", "start", "doc_tokens", "ids"])

    return deal


def round_robin(sizes: np.ndarray, length: int = LENGTH, piece: int = PIECE) -> list[list[tuple[int, int]]]:
    """For each window the (source, tokens) that it takes; sizes are the sources' tokens."""
    left, windows, turn = sizes.astype(np.int64).copy(), [], 0
    share = sizes / max(sizes.sum(), 1) * length
    deficit = np.zeros(len(sizes))
    while left.any():
        deficit += share
        room, taken = length, []
        ready = np.flatnonzero((left > 0) & (deficit >= np.minimum(piece, left)))
        for s in np.roll(ready, -int(np.searchsorted(ready, turn))):
            if room:
                take = int(min(deficit[s], left[s], room))
                taken.append((int(s), take))
                left[s], deficit[s], room = left[s] - take, deficit[s] - take, room - take
        while room and left.any():  # those that are owed most lend
            s = int(np.where(left > 0, deficit, -np.inf).argmax())
            take = int(min(left[s], room, max(deficit[s], piece)))
            taken.append((int(s), take))
            left[s], deficit[s], room = left[s] - take, deficit[s] - take, room - take
        windows.append(taken)
        turn = (turn + 1) % len(sizes)
    return windows


def _packed(dtype: str):
    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("source", "ascending"), ("at", "ascending")])
        g = group.column("pack")[0].as_py()
        source = group.column("source").combine_chunks().dictionary_encode()
        code = (source.combine_chunks() if isinstance(source, pa.ChunkedArray) else source).indices.to_numpy()
        held = group.column("ids").to_pylist()
        size = (np.fromiter(map(len, held), np.int64, len(held)) // np.dtype(dtype).itemsize).tolist()
        begin = np.concatenate([[0], np.cumsum(size)]).tolist()
        ids = memoryview(np.frombuffer(b"".join(held), dtype).astype("<u4").tobytes())
        doc, start, tokens = (group.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens"))
        row = np.searchsorted(code, np.arange(code.max() + 1)).tolist()
        inside = [0] * len(row)
        out: list[tuple] = []
        sequence = g * _SEQUENCES
        for taken in round_robin(np.bincount(code, size)):
            whole = sum(n for _, n in taken)
            room = [LENGTH] if whole == LENGTH else [1 << b for b in range(LENGTH.bit_length() - 1, -1, -1) if whole >> b & 1]
            offset, k = 0, 0
            for s, n in taken:
                while n:
                    r, a = row[s], inside[s]
                    m = min(n, size[r] - a, room[k] - offset)
                    at = 4 * (begin[r] + a)
                    out.append((doc[r], start[r] + a, m, zlib.crc32(ids[at : at + 4 * m]), tokens[r], sequence, offset))
                    n, offset, inside[s] = n - m, offset + m, a + m
                    if inside[s] == size[r]:
                        row[s], inside[s] = r + 1, 0
                    if offset == room[k]:
                        offset, k, sequence = 0, k + 1, sequence + 1
        columns = list(zip(*out))
        return pa.table([pa.array(columns[0], group.schema.field("doc_id").type), *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return pack


def pack(docs: DataFrame, path: str | None = None, targets: Mapping[str, float] | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  `targets` gives sources' shares of tokens."""
    spark, path = docs.sparkSession, path or vocabulary_path()
    encoder = Encoder(path)
    table = tokenised(docs, path)
    sums = tables.kept(table.groupBy("part", "source").agg(F.sum("n").alias("n")))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = tables.written(sums.select("part", "source", before.alias("before"), F.sum("n").over(W.partitionBy("source")).alias("total")), "places")  # a row for each part and source
    everything = sums.agg(F.sum("n")).first()[0] or 0
    totals = None
    if targets is not None:
        totals = {r["source"]: r["n"] for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    shares = Shares(max(1, -(-everything // (LENGTH * WINDOWS))), totals, targets)
    width = np.dtype(encoder.dtype).itemsize
    placed = table.join(places, ["part", "source"]).select("doc_id", "source", (F.col("place") + F.col("before")).alias("at"), "n", "total", "ids")
    kind = dict(docs.dtypes)["doc_id"]
    dealt = placed.mapInArrow(_dealt(shares, width), f"pack long, source string, at long, doc_id {kind}, start long, doc_tokens long, ids binary")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shares.partitions // PACKS))
    return dealt.repartition(tasks, "pack").groupBy("pack").applyInArrow(_packed(np.dtype(encoder.dtype).str), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents."""
    return pack(tables.read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
