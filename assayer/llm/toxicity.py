"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, of pairs of words that
follow each other and of pairs with one word between (A-Z lower-cased, words are
runs of letters, digits and non-ASCII).  FTRL-proximal learns one weight per
hash with a rate per coordinate; its L1 term leaves most weights at zero, so the
model is a short list of (hash, weight) that goes to every task.

Learning uses a documented bounded sample of the labelled rows: of each label
about `SAMPLE_ROWS` rows and about `SAMPLE_BYTES` of text at most (of a text at most
`TEXT_BYTES` count, as its features are a number for each bucket at most).  Tasks
turn its texts into features and only those reach the driver.
Both labels are counted over all training rows, and the base score is put back to
their rates.
Scoring is one pass over whole texts with no shuffle.

Defined results: null and empty texts have no feature and score the learned base
rate; rows with null label aren't learned from; a document labelled twice counts
as toxic if any of its rows says so; an empty training set gives score 0.5.  Empty
tables give no rows; rows that repeat are scored each, alike; texts of any length
count whole; a score of exactly 0.5 is predicted 1; other columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import tables, words

#: Most labelled rows, and bytes of their texts, of each label that are learned from.
SAMPLE_ROWS, SAMPLE_BYTES, TEXT_BYTES = 8_000, 24 << 20, 1 << 18
#: Features are hashed to 2**BITS buckets.
BITS = 18
EPOCHS = 6
ALPHA, BETA, L1, L2 = 3.0, 1.0, 4.0, 0.1


@dataclass(frozen=True)
class Model:
    """Buckets with a weight, ascending, their weights, and the base score."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float


def _buckets(texts: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """For each feature occurrence its text's index and its bucket."""
    h, text = texts.hashes(), texts.text_of()
    shift = np.uint64(64 - BITS)
    with np.errstate(over="ignore"):
        parts = [(text, words.mixed(h) >> shift)]
        for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
            if len(h) > gap:
                same = text[gap:] == text[:-gap]
                pair = words.mixed(h[:-gap] * np.uint64(salt) + h[gap:])[same] >> shift
                parts.append((text[gap:][same], pair))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in words.slices(batches, "text"):
        texts = words.split(batch.column("text"), words.NOT_ALNUM, lower=True)
        of, bucket = _buckets(texts)
        keys = np.unique((of << BITS) | bucket)
        cut = np.searchsorted(keys, np.arange(batch.num_rows + 1) << BITS)
        found = (keys & ((1 << BITS) - 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([found[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], ["label", "features"])


def counted(rows: DataFrame) -> dict[int, int]:
    """Rows of each label."""
    return {int(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}


def train(examples: DataFrame, rows: int = SAMPLE_ROWS, epochs: int = EPOCHS, counts: dict[int, int] | None = None) -> Model:
    """Learns from examples (doc_id, text, label 0/1), from about `rows` rows and `SAMPLE_BYTES` of each label at most.

    `counts` are the rows of each label that the examples stand for, if they are a sample.
    """
    labelled = examples.where(F.col("label").isin(0, 1)).select("doc_id", F.col("text").cast("binary").alias("text"), F.col("label").cast("int").alias("label"))
    size = F.least(F.octet_length("text"), F.lit(TEXT_BYTES))
    held = {r["label"]: r for r in labelled.groupBy("label").agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).collect()}
    share = {v: min(1.0, rows / r["n"], SAMPLE_BYTES / max(r["bytes"], 1)) for v, r in held.items()}
    unit = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = labelled.where(unit < F.when(F.col("label") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0))).select("text", "label")
    got = chosen.mapInArrow(_features, "label int, features binary").toArrow()
    label = got.column("label").to_numpy()
    model = fit(label, [np.frombuffer(x.as_buffer(), np.int32) for x in got.column("features")], epochs)
    del got
    pa.default_memory_pool().release_unused()
    counts, seen = counts or counted(labelled), np.bincount(label, minlength=2)
    if not seen.all() or not counts.get(0) or not counts.get(1):
        return model
    return replace(model, bias=model.bias + float(np.log(counts[1] / counts[0]) - np.log(seen[1] / seen[0])))


def fit(labels: np.ndarray, features: list[np.ndarray], epochs: int = EPOCHS) -> Model:
    """FTRL-proximal over sets of buckets; the last coordinate is the base score."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    order = sorted(range(len(labels)), key=lambda i: (len(features[i]), zlib.crc32(features[i]), labels[i]))
    rng = np.random.default_rng(11)
    weight = lambda i: np.where(np.abs(z[i]) <= l1[i], 0.0, -(z[i] - np.sign(z[i]) * l1[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))
    l1 = np.full(size + 1, L1)
    l1[size] = 0
    for _ in range(epochs):
        for k in rng.permutation(len(order)):
            at = np.append(features[order[k]], size)
            w = weight(at)
            gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[order[k]]
            step = (np.sqrt(n[at] + gradient * gradient) - np.sqrt(n[at])) / ALPHA
            z[at] += gradient - step * w
            n[at] += gradient * gradient
    w = weight(np.arange(size + 1))
    held = np.flatnonzero(w[:size])
    return Model(held, w[held], float(w[size]))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' `keep` columns with score (probability of label 1) and predicted (1 if score >= 0.5)."""
    types = dict(docs.dtypes)
    cut = docs.select(*keep, F.col("text").cast("binary").alias("text"))
    bias, shipped = model.bias, docs.sparkSession.sparkContext.broadcast((model.buckets.astype(np.int32), model.weights))  # those that L1 left, 2**BITS at most

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BITS)
        table[shipped.value[0]] = shipped.value[1]
        for batch in words.slices(batches, "text"):
            of, bucket = _buckets(words.split(batch.column("text"), words.NOT_ALNUM, lower=True))
            hit = np.flatnonzero(table[bucket])
            keys = np.unique((of[hit] << BITS) | bucket[hit])
            total = bias + np.bincount(keys >> BITS, table[keys & ((1 << BITS) - 1)], batch.num_rows)
            p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    return cut.mapInArrow(scores, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", score double, predicted int")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents; learns from labels outside the held-out fifth."""
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = tables.read(spark, sf_dir, "labels").where(~tables.held_out("doc_id", 5, 0) & F.col("toxic").isNotNull())
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("label"))
    chosen = [tables.sampled(labels.where(F.col("label") == v), "doc_id", SAMPLE_ROWS) for v in (0, 1)]
    examples = docs.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")  # bounded by SAMPLE_ROWS
    model = train(examples, counts=counted(docs.select("doc_id").join(labels, "doc_id")))
    return score(docs, model).select("doc_id", tables.held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")
