"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide counts of linked ids.

Byte-owner arrays: each byte of a text belongs to one token of A and one of B
(`np.repeat` of token numbers over token sizes).  Where either owner changes an
overlap of two tokens ends; where both change at once is a cut.  The tokens between
two cuts are a group, and each A token of a group is linked with each B token of it.

1. A map over whole texts encodes them both ways and finds groups and links.  A
   block of texts keeps, of each document, its distinct linked id pairs with how
   many links they are, and sends each of its distinct pairs once, with the number
   of its documents that hold it, to buckets by A id (`exchange`).
2. Buckets add these up and answer with each pair's documents in the corpus, and
   whether that is the A id's highest.
3. Each block sums what its documents' links got.

Distinct pieces of a batch are encoded once: A's pieces as in `packing.Encoder`;
B's vocabulary has no piece that holds a space after another character, so its
texts may be cut where a run of spaces follows something else.

Defined results: null and empty texts, and texts whose A or B bytes differ from a
space and the text, have no tokens: zeros and an empty digest; rows that share a
doc_id count as documents of their own; an empty table gives no rows.  Texts of any
length are aligned whole; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import exchange, tables, words
from assayer.llm.packing import Encoder, vocabulary_path

#: Bytes of text that are aligned at once, of a block, and of text for each bucket; links of a group that are listed one by one.
SLICE, BLOCK_BYTES, BUCKET_BYTES, LISTED = 1 << 20, 6 << 20, 8 << 20, 1 << 12
_BITS = 32
_SPREAD, _BACK = 40503, pow(40503, -1, 1 << 16)


class Bytes(Encoder):
    """A byte-level vocabulary: ids of texts, and how many bytes each id stands for; special tokens' strings are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)  # a letter of the byte alphabet for each byte


class Pieces:
    """A sentencepiece vocabulary: ids of texts (to which it adds a space), how many bytes each stands for, and which texts it gives back as they were."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.bytes_of = np.array([len(p) for p in self.of], np.int64)
        self.space = [self.model.piece_to_id("▁")]
        self.apart = not any(" " in p.lstrip(b" ").decode("utf-8", "ignore") for i, p in enumerate(self.of) if not self.model.is_byte(i))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, which begin with a space, each text's offset in them, and whether each text's bytes are its ids'."""
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        if self.apart and len(data):
            cut[1:-1] |= (data[1:] == 0x20) & (data[:-1] != 0x20)
        edges = np.flatnonzero(cut)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)])
        code = pieces.dictionary_encode()
        plain = code.dictionary.to_pylist()
        found = self.model.encode([x[1:].decode("utf-8", "replace") for x in plain], num_threads=1)
        found = [ids if x != b" " else self.space for ids, x in zip(found, plain)]  # a space that ends a text
        good = np.fromiter((b"".join(map(self.of.__getitem__, ids)) == x for ids, x in zip(found, plain)), bool, len(plain))
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.int64, int(size.sum()))
        at = code.indices.to_numpy()
        n, begin = size[at], (np.cumsum(size) - size)[at]
        total = np.append(0, np.cumsum(n))
        out = flat[np.repeat(begin - total[:-1], n) + np.arange(total[-1])]
        text = np.searchsorted(edges, offsets)
        bad = np.append(0, np.cumsum(~good[at]))
        return out, total[text], bad[text[1:]] == bad[text[:-1]]


def owners(sizes: np.ndarray) -> np.ndarray:
    """The token that each byte belongs to."""
    return np.repeat(np.arange(len(sizes)), sizes)


def _digits(ids: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Each id in decimal with a byte after it (0: nothing), in rows of bytes; zeros stand for nothing."""
    width = len(str(int(ids.max(initial=0))))
    out, rest, some = np.zeros((len(ids), width + 1), np.uint8), ids.copy(), np.ones(len(ids), bool)
    for k in range(width - 1, -1, -1):
        out[:, k] = np.where(some, 48 + rest % 10, 0)
        rest //= 10
        some = rest > 0
    out[:, width] = after
    return out


class Aligned:
    """Groups of some texts' tokens; a and b are ids, first_a and first_b where texts begin in them."""

    def __init__(self, a: np.ndarray, size_a: np.ndarray, first_a: np.ndarray, b: np.ndarray, size_b: np.ndarray, first_b: np.ndarray):
        self.a, self.b, self.first_a, self.first_b = a.astype(np.int64), b.astype(np.int64), first_a, first_b
        self.n_a, self.n_b = np.diff(first_a), np.diff(first_b)
        own_a, own_b = owners(size_a), owners(size_b)
        if len(own_a):
            cut = np.flatnonzero((own_a[1:] != own_a[:-1]) & (own_b[1:] != own_b[:-1])) + 1
            cut = np.append(0, cut)  # the first byte of each group; texts end at cuts too
            self.group_a, self.group_b = np.append(own_a[cut], len(a)), np.append(own_b[cut], len(b))
        else:
            self.group_a = self.group_b = np.zeros(1, np.int64)
        self.text_groups = np.searchsorted(self.group_a[:-1], first_a)
        self.n_groups = np.diff(self.text_groups)
        links = np.append(0, np.cumsum(np.diff(self.group_a) * np.diff(self.group_b)))
        self.n_links = links[self.text_groups[1:]] - links[self.text_groups[:-1]]

    def written(self) -> list[bytes]:
        """`a1,a2|b1;a3|b2,b3` for each text."""
        n_a, n_b = np.diff(self.group_a), np.diff(self.group_b)
        after_a, after_b = np.full(len(self.a), ord(","), np.uint8), np.full(len(self.b), ord(","), np.uint8)
        after_a[self.group_a[1:] - 1] = ord("|")
        after_b[self.group_b[1:] - 1] = ord(";")
        last = self.first_b[1:][self.n_b > 0] - 1
        after_b[last] = 0
        at_a = np.arange(len(self.a)) + np.repeat(self.group_b[:-1], n_a)
        at_b = np.arange(len(self.b)) + np.repeat(self.group_a[1:], n_b)
        ids, after = np.empty(len(at_a) + len(at_b), np.int64), np.empty(len(at_a) + len(at_b), np.uint8)
        ids[at_a], ids[at_b], after[at_a], after[at_b] = self.a, self.b, after_a, after_b
        rows = _digits(ids, after)
        end = np.append(0, np.cumsum((rows != 0).sum(axis=1)))[self.first_a + self.first_b]
        flat = rows[rows != 0].tobytes()
        return [flat[x:y] for x, y in zip(end[:-1].tolist(), end[1:].tolist())]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's distinct linked id pairs: text, pair (as a key) and how many links, by text and pair."""
        n_a, n_b = np.diff(self.group_a), np.diff(self.group_b)
        text = np.repeat(np.arange(len(self.n_groups)), self.n_groups)
        plain = np.flatnonzero(n_a * n_b <= LISTED)
        of = np.repeat(plain, n_a[plain] * n_b[plain])
        inner = np.arange(len(of)) - np.repeat(np.cumsum(n_a[plain] * n_b[plain]) - n_a[plain] * n_b[plain], n_a[plain] * n_b[plain])
        found = [(text[of], self.a[self.group_a[of] + inner // n_b[of]], self.b[self.group_b[of] + inner % n_b[of]], np.ones(len(of), np.int64))]
        for g in np.flatnonzero(n_a * n_b > LISTED).tolist():  # a large group: distinct ids with how often it has them
            (x, nx), (y, ny) = (np.unique(ids[f[g] : f[g + 1]], return_counts=True) for ids, f in ((self.a, self.group_a), (self.b, self.group_b)))
            found.append((np.full(len(x) * len(y), text[g]), np.repeat(x, len(y)), np.tile(y, len(x)), np.outer(nx, ny).ravel()))
        text, x, y, n = (np.concatenate(c) for c in zip(*found))
        key = pair_key(x, y)
        order = np.lexsort((key, text))
        text, key, n = text[order], key[order], n[order]
        new = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        return text[new], key[new], np.add.reduceat(n, new) if len(new) else n


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A pair of ids of 16 bits as one number, with A ids spread evenly over the upper half."""
    return ((a.astype(np.uint64) * np.uint64(_SPREAD) & np.uint64(0xFFFF)) << np.uint64(16)) | b.astype(np.uint64)


def pair_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ((key >> np.uint64(16)) * np.uint64(_BACK) & np.uint64(0xFFFF)).astype(np.int64), (key & np.uint64(0xFFFF)).astype(np.int64)


def align(texts: pa.Array, a: Bytes, b: Pieces) -> Aligned:
    """The alignment of a column of texts; those that a vocabulary doesn't give back have no tokens."""
    data, offsets = words.buffers(texts)
    full = np.diff(offsets) > 0
    spaced, shift = np.full(len(data) + int(full.sum()), 0x20, np.uint8), np.append(0, np.cumsum(full))
    begin = offsets + shift
    spaced[np.arange(len(data)) + np.repeat(shift[1:], np.diff(offsets))] = data
    ids_b, first_b, good = b(spaced, begin)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(spaced)])
    ids_a, first_a = a(column)
    size_a, size_b = a.bytes_of[ids_a], b.bytes_of[ids_b]
    total = np.append(0, np.cumsum(size_a))
    good &= total[first_a[1:]] - total[first_a[:-1]] == np.diff(begin)
    if not good.all():
        keep_a, keep_b = np.repeat(good, np.diff(first_a)), np.repeat(good, np.diff(first_b))
        ids_a, size_a, ids_b, size_b = ids_a[keep_a], size_a[keep_a], ids_b[keep_b], size_b[keep_b]
        first_a, first_b = np.append(0, np.cumsum(np.diff(first_a) * good)), np.append(0, np.cumsum(np.diff(first_b) * good))
    return Aligned(ids_a, size_a, first_a, ids_b, size_b, first_b)


_DOCUMENT = "n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>"


def _aligned(path_a: str, path_b: str, buckets: int, kind: pa.DataType):
    """What a block sends, and a row of its documents with their pairs as places in the block's keys."""

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = Bytes(path_a), Pieces(path_b)
        number, size = TaskContext.get().partitionId() << 24, 0
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            docs = pa.concat_arrays([h[0] for h in held])
            columns = [np.concatenate(c) for c in zip(*(h[1] for h in held))]
            digests = [x for h in held for x in h[2]]
            base = np.cumsum([0, *(len(h[0]) for h in held[:-1])])
            text = np.concatenate([h[3] + k for h, k in zip(held, base.tolist())])
            keys, at, count = np.unique(np.concatenate([h[4] for h in held]), return_inverse=True, return_counts=True)
            rows = [(*r, *[None] * 10) for r in exchange.rows(number, keys, count, _BITS, buckets, 16)]
            own = np.bincount(text, minlength=len(docs))
            packed = exchange.squeezed(np.diff(at.astype(np.int64), prepend=0)), exchange.squeezed(np.concatenate([h[5] for h in held]))
            rows.append((number, None, 0, None, None, docs.to_pylist(), *(c.tolist() for c in columns), digests, own.tolist(), [r[2] for r in rows], *packed))
            held.clear()
            many = pa.list_(pa.int64())
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(kind), many, many, many, many, pa.list_(pa.string()), many, many, pa.binary(), pa.binary())
            names = [c.split(" ")[0] for c in f"{exchange.SENT}, doc_ids x, {_DOCUMENT}, own x, got x, at x, links x".split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in words.slices(batches, "text", SLICE):
            found = align(batch.column("text"), a, b)
            digests = [hashlib.sha256(x).hexdigest() if x else "" for x in found.written()]
            held.append((batch.column("doc_id"), (found.n_a, found.n_b, found.n_groups, found.n_links), digests, *found.links()))
            size += batch.column("text").nbytes
            if size >= BLOCK_BYTES:
                yield block()
                number, size = number + 1, 0
        if held:
            yield block()

    return aligned


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document: its links' counts added up, and how many are their A id's best."""
    for batch in exchange.in_slices(batches):
        r = {c: batch.column(c) for c in batch.schema.names}
        total, best = exchange.read_answers(r["answers"].to_pylist()[0], r["got"].to_pylist()[0])
        own = r["own"].flatten().to_numpy()
        at = np.cumsum(exchange.opened(r["at"][0].as_py(), int(own.sum())))
        links = exchange.opened(r["links"][0].as_py(), int(own.sum()))
        first = np.append(0, np.cumsum(own))
        sums = [np.append(0, np.cumsum(x)) for x in (links * best[at], links * total[at])]
        columns = [r[c].flatten() for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")] + [pa.array(s[first[1:]] - s[first[:-1]], pa.int64()) for s in sums] + [r["digests"].flatten()]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    path_a, path_b = path_a or vocabulary_path(), path_b or vocabulary_path("piece_bpe_32k.model")
    if max(len(Bytes(path_a).bytes_of), len(Pieces(path_b).bytes_of)) > 1 << 16:
        raise ValueError("ids must have 16 bits")
    cut = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    with tables.Scratch(spark) as scratch:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
        shape = f"{exchange.SENT}, doc_ids array<{kind}>, {_DOCUMENT}, own array<long>, got array<long>, at binary, links binary"
        arrow = docs.select("doc_id").limit(0).toArrow().schema.field("doc_id").type
        sent = scratch.written(cut.mapInArrow(_aligned(path_a, path_b, min(buckets, 1 << 16), arrow), shape), "pairs")
        blocks = sent.where(F.col("bucket").isNull())
        answers = exchange.answered(sent.where(F.col("bucket").isNotNull()), blocks.count(), scratch, owner=16)
        whole = blocks.drop("bucket", "n", "keys", "counts").join(answers, "block", "left")
        out = whole.mapInArrow(_summed, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
        return tables.written(out, "aligned")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of the byte-level and the piece vocabulary over all documents."""
    return aligned(tables.read(spark, sf_dir, "documents").select("doc_id", "text"))
