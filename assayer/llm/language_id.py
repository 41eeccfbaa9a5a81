"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its byte n-grams (2 to 4 bytes after A-Z
are lower-cased; spaces count, so n-grams see word edges), hashed to a fixed
number of buckets.  Stochastic gradient descent in numpy learns embeddings and
softmax from a documented bounded sample: of each language about `SAMPLE_ROWS`
labelled rows at most, and of all together about `SAMPLE_BYTES` of text at most,
shared alike by the languages (of a text at most `TEXT_BYTES` count, as its
features are a row for each bucket at most).  Every language found is learned.  As
mean and softmax are both linear, a model of few languages folds to one score per
bucket and language; with more languages than `SIZE` tasks hold the embeddings and
the softmax instead, so that what is broadcast hardly grows with the languages.

Rejection is calibrated on the part of the sample that isn't learned from: a
temperature makes the probabilities honest, and the cut-off is the largest under
which at most `REJECTED` of that part falls.

Defined results: null texts and texts without a letter are `und` with score 0
and rejected; with no labelled row to learn from, as in an empty table, every text
is `und`.  Rows that repeat are each predicted, alike; of languages with the same
score the first in order is taken.  Texts of any length count whole.  Columns named
like the results' may be kept: `predict` gives them beside, `accepted` keeps docs'
columns only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import tables, words

#: Most labelled rows of each language, and most bytes of text of all languages, that are learned from.
SAMPLE_ROWS, SAMPLE_BYTES, TEXT_BYTES = 1_500, 32 << 20, 1 << 17
BITS, SIZE, EPOCHS, RATE = 16, 16, 4, 0.5
#: Least steps of gradient descent: a small sample is gone over more often.
STEPS = 8_000
#: Share of the calibration part that may fall under the cut-off.
REJECTED = 0.002
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """A text's logits are the mean of its buckets' rows of `table`, times `out` (None: the table is folded), plus bias; the temperature and the rejection cut-off."""

    languages: list[str]
    table: np.ndarray
    out: np.ndarray | None
    bias: np.ndarray
    temperature: float
    cut_off: float


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each n-gram occurrence its bucket, in text order, and the offsets of texts in that."""
    data, offsets = words.buffers(column)
    data = words.LOWER[data].astype(np.uint32)
    data[data < 33] = 32
    n = len(data)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    parts, codes = [], data.copy()
    with np.errstate(over="ignore"):
        for size in (2, 3, 4):
            if n < size:
                break
            codes = (codes[: n - size + 1] << np.uint32(8)) | data[size - 1 :]
            same = text[size - 1 :] == text[: n - size + 1]
            mixed = (codes ^ np.uint32(size * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE35)
            parts.append((mixed >> np.uint32(32 - BITS), same))
    return parts, offsets


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in words.slices(batches, "text", 1 << 20):
        parts, offsets = _grams(batch.column("text"))
        text = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        keys = np.concatenate([(text[: len(b)][same] << BITS) | b[same] for b, same in parts] or [np.zeros(0, np.int64)])
        keys, n = np.unique(keys, return_counts=True)
        cut = np.searchsorted(keys, np.arange(batch.num_rows + 1) << BITS)
        found, n = (keys & ((1 << BITS) - 1)).astype(np.uint16), np.minimum(n, 65535).astype(np.uint16)
        spans = list(zip(cut, cut[1:]))
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([found[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([n[a:b].tobytes() for a, b in spans], pa.binary())], ["lang", "buckets", "counts"])


def _letters(text: str):
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def train(examples: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learns from examples (doc_id, text, lang), from about `rows` rows of each language at most."""
    known = examples.where(F.col("lang").isNotNull() & _letters("text"))
    size = F.least(F.octet_length("text"), F.lit(TEXT_BYTES))
    found = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).collect()  # a row for each language
    if not found:
        return Model([], np.zeros((1 << BITS, 0), np.float32), None, np.zeros(0), 1.0, 1.0)
    shares = [(r["lang"], min(1.0, rows / r["n"], SAMPLE_BYTES / len(found) / max(r["bytes"], 1))) for r in found]
    shares = F.broadcast(examples.sparkSession.createDataFrame(shares, "lang string, share double"))
    unit = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = known.select("doc_id", "text", "lang").join(shares, "lang").where(unit < F.col("share")).select(F.col("text").cast("binary").alias("text"), "lang")
    got = chosen.mapInArrow(_features, "lang string, buckets binary, counts binary").toArrow()
    model = fit([r["lang"] for r in found], got.column("lang").to_pylist(), *([np.frombuffer(x.as_buffer(), np.uint16) for x in got.column(c)] for c in ("buckets", "counts")))
    del got
    pa.default_memory_pool().release_unused()
    return model


def fit(languages: list[str], langs: list[str], buckets: list[np.ndarray], counts: list[np.ndarray]) -> Model:
    """SGD on four fifths of the examples; temperature and cut-off from the rest."""
    rng = np.random.default_rng(7)
    languages = sorted(languages)
    label = {v: i for i, v in enumerate(languages)}
    order = sorted((i for i in range(len(langs)) if len(buckets[i])), key=lambda i: (langs[i], len(buckets[i]), zlib.crc32(buckets[i]), zlib.crc32(counts[i])))
    rest, learn = order[::5] if len(order) >= 50 else order, [x for k, x in enumerate(order) if k % 5] if len(order) >= 50 else order
    e = rng.normal(0, 0.1, (1 << BITS, SIZE)).astype(np.float32)
    w, b = np.zeros((SIZE, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    rounds = max(EPOCHS, -(-STEPS // max(len(learn), 1)))
    steps, done = max(1, rounds * len(learn)), 0
    for _ in range(rounds if learn else 0):
        for k in rng.permutation(len(learn)):
            i = learn[k]
            at, part = buckets[i], _shares(counts[i])
            h = part @ e[at]
            p = _softmax(h @ w + b)
            p[label[langs[i]]] -= 1
            rate = RATE * (1 - done / steps)
            back = w @ p
            w -= rate * np.outer(h, p)
            b -= 0.1 * rate * p
            e[at] -= (rate * 100 * part)[:, None] * back[None, :]
            done += 1
    table, out = (e @ w, None) if len(languages) <= SIZE else (e, w)
    means = np.array([_shares(counts[i]) @ table[buckets[i]] for i in rest]).reshape(len(rest), table.shape[1])
    logits = (means if out is None else means @ out) + b
    truth = np.array([label[langs[i]] for i in rest], int)
    loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() if len(truth) else 0
    temperature = min((float(t) for t in np.geomspace(0.2, 5, 40)), key=loss)
    top = np.sort(_softmax(logits / temperature).max(axis=1)) if len(truth) else np.ones(1)
    return Model(languages, table.astype(np.float32), out, b, temperature, float(min(top[int(REJECTED * len(top))], 0.5)))


def _shares(counts: np.ndarray) -> np.ndarray:
    return (counts / counts.sum(dtype=np.float64)).astype(np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def _predicted(docs: DataFrame, model: Model, keep: tuple[str, ...]) -> tuple[DataFrame, list]:
    """lang_pred, score and rejected beside docs' `keep` columns under names of their own, and what names these again."""
    types = dict(docs.dtypes)
    names = {c: f"kept_{i}" for i, c in enumerate(keep)}
    text = names.get("text", "text")
    own = [] if "text" in names else [F.col("text").cast("binary").alias("text")]
    cut = docs.select(*(F.col(c).alias(n) for c, n in names.items()), *own, _letters("text").alias("letters"))
    shipped = docs.sparkSession.sparkContext.broadcast((model.table, model.out))  # 2**BITS rows of SIZE at most, and SIZE of all languages
    languages, bias, temperature, cut_off = model.languages, model.bias, model.temperature, model.cut_off

    def predictions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, to_logits = shipped.value
        width = table.shape[1]
        for batch in words.slices(batches, text, 1 << 20):
            rows = batch.num_rows
            lettered = np.asarray(batch.column("letters").to_numpy(zero_copy_only=False), bool) & bool(languages)
            total, n = np.zeros((rows, width)), np.zeros(rows)
            if languages:
                parts, offsets = _grams(batch.column(text))
                for bucket, same in parts:
                    ends = np.minimum(offsets, len(bucket))
                    n += words.sums_by_text(same, ends)
                    for c in range(width):
                        total[:, c] += words.sums_by_text(table[:, c][bucket] * same, ends)
                mean = total / np.maximum(n, 1)[:, None]
                p = _softmax(((mean if to_logits is None else mean @ to_logits) + bias) / temperature)
                best, top = p.argmax(axis=1), np.where(lettered, p.max(axis=1), 0.0)
            else:
                best, top = np.zeros(rows, int), np.zeros(rows)
            named = pa.array([languages[i] if ok else UNKNOWN for i, ok in zip(best, lettered)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names.values()), named, pa.array(top), pa.array(~lettered | (top < cut_off))], [*names.values(), "lang_pred", "score", "rejected"])

    out = cut.mapInArrow(predictions, ", ".join(f"{n} {types[c]}" for c, n in names.items()) + ", lang_pred string, score double, rejected boolean")
    return out, [F.col(n).alias(c) for c, n in names.items()]


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' `keep` columns with lang_pred, score (calibrated, of lang_pred) and rejected."""
    out, kept = _predicted(docs, model, keep)
    return out.select(*kept, "lang_pred", "score", "rejected")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns and no others."""
    out, kept = _predicted(docs, model, tuple(docs.columns))
    return out.where(~F.col("rejected")).select(*kept)


def model_of(docs: DataFrame) -> Model:
    """The model learned from docs outside the held-out quarter."""
    return train(docs.where(~tables.held_out("doc_id", 4, 2)).select("doc_id", "text", "lang"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicts the language of all documents."""
    docs = tables.read(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), model_of(docs))
    return out.select("doc_id", tables.held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")
