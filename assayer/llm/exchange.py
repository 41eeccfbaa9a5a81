"""Totals of keyed counts over a whole corpus, sent there and back in packed blocks.

A block is a bounded stretch of documents that a task has read.  It sends each of
its distinct keys once, with a count, to buckets that are ranges of keys, and gets
the corpus's totals of the same keys back, in the same order.  So a key that every
document holds costs a block one entry, and what travels is a sorted array of
differences by byte planes, two or three bytes a key.

A bucket's rows meet in groups of `GROUP` blocks at most: with more blocks its
groups are added up first and those sums again, and each group is answered from
the bucket's totals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import tables

#: What a block sends: its number, a bucket, and the keys and counts for it.
SENT = "block long, bucket int, n int, keys binary, counts binary"
_REPLIES = "block long, bucket int, totals binary, best binary"
#: Blocks whose rows for a bucket meet in one group.
GROUP = 2048


def squeezed(x: np.ndarray) -> bytes:
    """An integer array by byte planes, compressed."""
    return pa.Codec("zstd", 1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), asbytes=True)


def opened(packed: bytes, n: int, dtype=np.int64) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    plain = pa.Codec("zstd").decompress(packed, n * width, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(width, n).T).view(dtype).reshape(n)


def rows(block: int, keys: np.ndarray, counts: np.ndarray, bits: int, buckets: int, whole: int = 32) -> list[tuple]:
    """Rows of SENT for sorted distinct keys of `bits` bits.  Keys with equal upper `whole` bits share a bucket."""
    top = min(whole, bits)
    bucket = ((keys >> np.uint64(bits - top)) * np.uint64(buckets) >> np.uint64(top)).astype(np.int64)
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(keys) else np.zeros(0, np.int64)
    out = []
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)]):
        out.append((block, int(bucket[a]), b - a, squeezed(np.diff(keys[a:b], prepend=np.uint64(0))), squeezed(counts[a:b].astype(np.int64))))
    return out


def _read(group: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.cumsum(opened(k, n, np.uint64), dtype=np.uint64), opened(c, n)) for n, k, c in zip(*(group.column(x).to_pylist() for x in ("n", "keys", "counts")))]


def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, of = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, of, np.concatenate([c for _, c in parts]))
    return keys, total


def _added(group: pa.Table) -> pa.Table:
    """One row for a group's rows: their keys with the sums of their counts."""
    keys, total = _sum(_read(group))
    bucket = group.column("bucket")[0].as_py()
    return pa.table({"bucket": pa.array([bucket], pa.int32()), "n": pa.array([len(keys)], pa.int32()), "keys": pa.array([squeezed(np.diff(keys, prepend=np.uint64(0)))], pa.binary()), "counts": pa.array([squeezed(total)], pa.binary())})


def _answers(owner: int | None):
    """Totals of each row's keys; best flags keys whose total is the highest of all keys that agree without their lower `owner` bits."""

    def answers(asked: pa.Table, sums: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
        keys, total = _sum(sums)
        best = np.zeros(len(keys), bool)
        if owner is not None:
            first = np.flatnonzero(np.append(True, (keys[1:] ^ keys[:-1]) >> np.uint64(owner) > 0))
            best = total == np.repeat(np.maximum.reduceat(total, first), np.diff(np.append(first, len(keys))))
        totals, flags = [], []
        for own, _ in _read(asked):
            at = np.searchsorted(keys, own)
            totals.append(squeezed(total[at]))
            flags.append(squeezed(best[at].astype(np.uint8)))
        return pa.table({"block": asked.column("block"), "bucket": asked.column("bucket"), "totals": pa.array(totals, pa.binary()), "best": pa.array(flags, pa.binary())})

    return answers


def answered(sent: DataFrame, blocks: int, scratch: tables.Scratch, owner: int | None = None, group: int = GROUP) -> DataFrame:
    """block, answers: an array of (bucket, totals, best) for each block that sent something."""
    spark, answers = sent.sparkSession, _answers(owner)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = sent.select("block", "bucket", "n", "keys", "counts")
    groups = -(-blocks // group)
    if groups <= 1:
        replies = sent.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(lambda t: answers(t, _read(t)), _REPLIES)
    else:
        own = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("group")
        shape = "bucket int, n int, keys binary, counts binary"
        sums = sent.groupBy("bucket", own).applyInArrow(_added, shape)
        sums = scratch.written(sums.groupBy("bucket").applyInArrow(_added, shape), "sums")
        everywhere = sums.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
        replies = sent.withColumn("group", own).groupBy("bucket", "group").cogroup(everywhere.groupBy("bucket", "group")).applyInArrow(lambda t, s: answers(t, _read(s)), _REPLIES)
    replies = scratch.written(replies, "replies")
    return replies.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "totals", "best"))).alias("answers"))  # a row for each bucket; together as long as the block's keys


def read_answers(answers: list | None, n: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Totals and best flags of a block's keys, in their order; n: how many keys each bucket got."""
    if not answers:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate([opened(x["totals"], k) for x, k in zip(answers, n)]), np.concatenate([opened(x["best"], k, np.uint8) for x, k in zip(answers, n)]).astype(bool)


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block's row at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1)
