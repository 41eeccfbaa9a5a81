"""Each operator over tables that hold every odd case, against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from conftest_helpers import lowered, words_of
from pyspark.sql import functions as F

from assayer.llm import brown, decontaminate, language_id, licences, near_dedup, packing, substring_dedup, tables, top_k, toxicity, warc, words
from assayer.llm.queries import QUERIES


def rows(spark, folder, table="documents"):
    return spark.read.parquet(f"{folder}/{table}.parquet").collect()


def crc(doc_id, folds):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % folds


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_empty_results(name, spark, empty):
    assert QUERIES[name](spark, empty).count() == 0


# 1. decontamination


def distance(item, text):
    """Least edit distance of item to any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i] + [0] * len(text)
        for j, b in enumerate(text, 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b))
        row = new
    return min(row)


def alnum(text):
    found = [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", b" ".join(lowered(text)))]
    alone = "\u0e00-\u0eff\u1000-\u10bf\u1780-\u17ff\u3000-\u9fff\U00020000-\U0003ffff"
    return [c.encode() for w in found for c in re.findall(f"[{alone}]|[^{alone}]+", w)]


def test_short_items_and_scripts_without_spaces(spark):
    items = [(1, "antidisestablishmentarianism is wrong"), (2, "too short"), (3, "中文句子没有空格也要找到"), (4, "他说今天天气很好我们去公园"), (5, "รักกันไว้เถิดเราเกิดร่วมแดน")]
    docs = [(1, "x Antidisestablishmentarianism: is wrong! y"), (2, "antidisestablishmentarianism was wrong, too short"), (3, "前面的话。中文句子没有空格也要找到。"), (4, "中文句子没有空各也要找到"), (5, "我们去公园他说今天"), (6, "ก่อนรักกันไว้เถิดเราเกิดร่วมแดน"), (7, None)]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    got = {(r.doc_id, r.item_id): (r.distance, r.start_word, r.short) for r in decontaminate.leaks(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1): (0, 1, False), (2, 2): (0, 3, True), (3, 3): (0, 5, False), (4, 3): (1, 0, False), (6, 5): (0, 4, False)}
    some = decontaminate.leaks(frame(docs[1:2], "doc_id long, text string"), frame(items[1:2], "item_id long, text string"), min_bytes=4)
    assert [(r.doc_id, r.start_word, r.n_words, r.short) for r in some.collect()] == [(2, 3, 2, False)]


def headed(n, seed=4):
    """n items of 60 words that share the first 30, and one of shared words alone."""
    rng = np.random.default_rng(seed)
    head = [f"h{x}" for x in rng.integers(0, 9000, 30)]
    return head, [head + [f"t{x}" for x in rng.integers(0, 200_000, 30)] for _ in range(n)]


def found_in(items, texts):
    shipped = type("Shipped", (), {"value": decontaminate.Items(list(range(len(items))), [" ".join(i) for i in items])})
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([" ".join(t).encode() for t in texts], pa.binary())], ["doc_id", "text"])
    return {(d, i): x for b in decontaminate._leaks(shipped, "doc_id")([batch]) for d, i, x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "item_id", "distance")))}


def test_items_that_share_a_head_are_found_and_the_head_alone_is_none():
    head, items = headed(40)
    items += [list(items[3]), head + head[::-1]]
    rng = np.random.default_rng(6)
    texts = [["x"] * (d % 5) + head + ["y"] * 20 for d in range(10)]
    for d in range(40):
        leak = list(items[d])
        for k in sorted(rng.choice(60, 9, replace=False), reverse=True):
            leak[k : k + 1] = [[], [f"c{k}"], [leak[k], f"c{k}"]][k % 3]
        texts.append(["x"] * (d % 5) + leak + ["y"])
    texts.append(head + head[::-1])
    got = found_in(items, texts)
    assert {(10 + d, d) for d in range(40)} <= set(got) and (13, 40) in got and got[50, 41] == 0
    assert set(got) <= {(10 + d, d) for d in range(40)} | {(13, 40), (50, 41)}


def test_a_shared_head_costs_the_same_for_more_items():
    took = []
    for n in (250, 1000):
        head, items = headed(n)
        texts = [["x"] * (d % 7) + head + ["z"] * 9 for d in range(100)]
        shipped = type("Shipped", (), {"value": decontaminate.Items(list(range(n)), [" ".join(i) for i in items])})
        batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([" ".join(t).encode() for t in texts], pa.binary())], ["doc_id", "text"])
        began = time.process_time()
        assert sum(b.num_rows for b in decontaminate._leaks(shipped, "doc_id")([batch])) == 0
        took.append(time.process_time() - began)
    assert took[1] < 2 and took[1] < 3 * took[0] + 0.2


def test_leaks_are_those_within_the_distance(spark, odd):
    got = {(r.doc_id, r.item_id): r.distance for r in QUERIES["op1_decontaminate"](spark, odd).collect()}
    items = [(r.item_id, alnum(r.text)) for r in rows(spark, odd, "benchmark") if len(alnum(r.text)) >= decontaminate.MIN_WORDS]
    want = {}
    for r in rows(spark, odd):
        text = alnum(r.text)
        if len(text) > 2000:
            continue
        for item_id, item in items:
            if (d := distance(item, text)) <= decontaminate.distance_allowed(len(item)):
                want[r.doc_id, item_id] = d
    assert got == want and (100, 1) in want and (5, None) in want


def test_edited_leaks_are_found(spark, odd):
    rng = np.random.default_rng(3)
    item = rows(spark, odd, "benchmark")
    text = next(r.text for r in item if r.item_id == 1).split()
    docs = []
    for i in range(60):
        leak = list(text)
        for k in sorted(rng.choice(len(leak), 4, replace=False), reverse=True):
            if k % 3 == 0:
                del leak[k]
            elif k % 3 == 1:
                leak[k] = "changed"
            else:
                leak.insert(k, "added")
        docs.append((i, " ".join(["before"] * (i % 7) + leak + ["after"] * 5)))
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.read.parquet(f"{odd}/benchmark.parquet"))
    assert len({r.doc_id for r in got.collect()}) >= 57


@pytest.mark.parametrize("kind", ["substitutions", "deletions", "insertions", "mixed"])
@pytest.mark.parametrize("n", [60, 200, 400])
def test_edited_leaks_of_long_items_are_found(n, kind):
    rng = np.random.default_rng(n)
    item = [f"w{x}" for x in rng.integers(0, 5000, n)]
    texts = []
    for d in range(20):
        leak = list(item)
        for k in sorted(rng.choice(n, decontaminate.distance_allowed(n), replace=False), reverse=True):
            how = ["substitutions", "deletions", "insertions"][k % 3] if kind == "mixed" else kind
            leak[k : k + 1] = {"substitutions": [f"c{d}x{k}"], "deletions": [], "insertions": [leak[k], f"c{d}x{k}"]}[how]
        texts.append(" ".join(["before"] * (d % 7) + leak + ["after"] * 5).encode())
    shipped = type("Shipped", (), {"value": decontaminate.Items([1], [" ".join(item)])})
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array(texts, pa.binary())], ["doc_id", "text"])
    found = {d for b in decontaminate._leaks(shipped, "doc_id")([batch]) for d in b.column("doc_id").to_pylist()}
    assert len(found) >= 19


# 2. language


def test_languages_are_learned_values_and_und_without_letters(spark, odd):
    got = QUERIES["op2_language_id"](spark, odd).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows(spark, odd))
    assert all(by[d].lang_pred == "und" and by[d].score == 0 and by[d].rejected for d in (400, 401, 402))
    assert by[404].lang_pred == "und"
    assert all(r.lang_pred in ("en", "de", "und") and 0 <= r.score <= 1 and r.held_out == (crc(r.doc_id, 4) == 2) for r in got)


def test_held_out_languages_are_told(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in rows(spark, sf_dir)}
    out = [r for r in QUERIES["op2_language_id"](spark, sf_dir).collect() if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in out) >= 0.95 * len(out)
    assert sum(r.rejected for r in out) <= 0.02 * len(out)


def test_language_model_folds_to_the_same_scores(spark):
    rng = np.random.default_rng(8)
    names = [f"l{i}" for i in range(20)]
    e, w, b = rng.normal(size=(1 << language_id.BITS, 5)), rng.normal(size=(5, 20)), rng.normal(size=20)
    docs = spark.createDataFrame([(1, "Some words"), (2, "autre chose é"), (3, None), (4, "12"), (5, "x")], "doc_id long, text string")
    one, other = (language_id.predict(docs, language_id.Model(names, t.astype(np.float32), o, b, 0.7, 0.2)).collect() for t, o in ((e @ w, None), (e, w)))
    for r, s in zip(one, other):
        assert (r.doc_id, r.lang_pred, r.rejected) == (s.doc_id, s.lang_pred, s.rejected) and r.score == pytest.approx(s.score, abs=1e-4)
    assert {r.doc_id: r.lang_pred for r in one if r.doc_id in (3, 4)} == {3: "und", 4: "und"}

    def plain(text):
        data = bytes(32 if c < 33 else c for c in text.encode().lower())
        rows = []
        for n in (2, 3, 4):
            for i in range(len(data) - n + 1):
                code = (int.from_bytes(data[i : i + n], "big") ^ (n * 0x9E3779B1 & 0xFFFFFFFF)) * 0x85EBCA6B & 0xFFFFFFFF
                code = (code ^ code >> 15) * 0xC2B2AE35 & 0xFFFFFFFF
                rows.append(e[code >> 32 - language_id.BITS] @ w)
        z = (np.mean(rows, axis=0) + b) / 0.7 if rows else b / 0.7
        return names[int(z.argmax())], float(np.exp(z - z.max()).max() / np.exp(z - z.max()).sum())

    for r, text in zip(one, ("Some words", "autre chose é")):
        name, p = plain(text)
        assert r.lang_pred == name and r.score == pytest.approx(p, abs=1e-4)


def test_every_language_is_learned(spark):
    docs = [(i, " ".join(f"{'abcdefghijklmnopqrstuvwx'[i % 24]}{(i * k) % 7}{'abcdefghijklmnopqrstuvwx'[i % 24]}" for k in range(12)), f"l{i % 24}") for i in range(480)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language_id.train(frame)
    assert len(model.languages) == 24 and model.out is not None and model.table.shape[1] == language_id.SIZE
    got = language_id.predict(frame, model).collect()
    assert sum(r.lang_pred == f"l{r.doc_id % 24}" for r in got) >= 470


# 3. top-k


@pytest.mark.parametrize("lists", [1, 2, 3])
def test_top_k_equals_brute_force(spark, odd, lists):
    got = defaultdict(list)
    table = spark.read.parquet(f"{odd}/embeddings.parquet").select("vec_id", "embedding")
    for r in sorted(top_k.top_k(table, F.col("vec_id") % 50 == 0, 10, lists, block=3).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    vectors: dict = {}
    for r in table.collect():
        if r.vec_id is not None and r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding):
            v = [math.floor(1024 * x) for x in r.embedding]
            vectors[r.vec_id] = min(vectors.get(r.vec_id, v), v)
    want = {}
    for q in (v for v in vectors if v % 50 == 0):
        found = sorted((-sum(a * b for a, b in zip(vectors[q], x)), i) for i, x in vectors.items() if i != q and len(x) == len(vectors[q]))[:10]
        if found:
            want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(found)]
    assert dict(got) == want and len(want[400]) == 1


# 4. toxicity


def test_scores_lie_between_0_and_1_and_empty_texts_have_the_base_score(spark, odd):
    got = QUERIES["op4_toxicity"](spark, odd).collect()
    assert len(got) == len(rows(spark, odd))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (crc(r.doc_id, 5) == 0) for r in got)
    assert len({r.score for r in got if r.doc_id in (400, 401, 402)}) == 1


def test_planted_words_are_learned(spark):
    plain = [f"the cat number {i} sat on mat {i % 7}" for i in range(300)]
    examples = [(i, t + (" awful insult" if i % 3 == 0 else ""), int(i % 3 == 0)) for i, t in enumerate(plain)]
    model = toxicity.train(spark.createDataFrame(examples, "doc_id long, text string, label int"))
    assert len(model.buckets) < 200
    out = toxicity.score(spark.createDataFrame([(1, "an Awful, insult here"), (2, "the cat sat on a mat")], "doc_id long, text string"), model)
    assert {r.doc_id: r.predicted for r in out.collect()} == {1: 1, 2: 0}


def test_sampled_labels_keep_their_base_rate(spark):
    examples = spark.createDataFrame([(i, f"word{i}", int(i % 10 == 0)) for i in range(2000)], "doc_id long, text string, label int")
    model = toxicity.train(examples, rows=150)
    assert 0.05 < 1 / (1 + math.exp(-model.bias)) < 0.2


def test_weights_equal_a_plain_ftrl():
    rng = np.random.default_rng(5)
    features = [np.unique(rng.integers(0, 40, rng.integers(0, 12))).astype(np.int32) for _ in range(60)]
    labels = np.array([int(3 in f or rng.random() < 0.2) for f in features])
    model = toxicity.fit(labels, features, epochs=3)
    z, n, last = defaultdict(float), defaultdict(float), 1 << toxicity.BITS

    def weight(i):
        l1 = 0 if i == last else toxicity.L1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    order = sorted(range(60), key=lambda i: (len(features[i]), zlib.crc32(features[i]), labels[i]))
    turns = np.random.default_rng(11)
    for _ in range(3):
        for k in turns.permutation(60):
            at = [*features[order[k]].tolist(), last]
            w = [weight(i) for i in at]
            g = 1 / (1 + math.exp(-sum(w))) - labels[order[k]]
            for i, v in zip(at, w):
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * v
                n[i] += g * g
    want = {i: weight(i) for i in range(40) if weight(i)}
    assert model.buckets.tolist() == sorted(want)
    assert model.weights.tolist() == pytest.approx([want[i] for i in sorted(want)]) and model.bias == pytest.approx(weight(last))


# 5. substrings


def removed(docs, n=13):
    least: dict = {}
    for d, text in docs:
        w = words_of(text)
        for i in range(len(w) - n + 1):
            if d is not None:
                k = tuple(w[i : i + n])
                least[k] = min(least.get(k, d), d)
    for d, text in docs:
        w = words_of(text)
        gone = set()
        for i in range(len(w) - n + 1):
            if d is not None and least[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        yield d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()


def test_repeats_equal_brute_force(spark, odd):
    docs = [(r.doc_id, r.text) for r in rows(spark, odd)]
    got = Counter(tuple(r) for r in QUERIES["op5_substring_dedup"](spark, odd).collect())
    assert got == Counter(removed(docs))
    assert any(k[2] for k in got)


def test_repeats_leave_other_columns_and_clean_texts_alone(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = substring_dedup.remove_repeats(docs)
    assert out.columns == docs.columns
    before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
    assert all(after[d] == before[d] for d in (0, 400, 401, 402, 409))
    assert len(after[105].text.split()) < len(before[105].text.split())


def test_a_passage_of_all_documents_goes_to_its_bucket_once_a_task():
    def blocks(box, doc):
        """What is sent of three documents that hold a passage, the first of them `doc`."""
        passage, own = b"a b c d e f g h i j k l m", [b"%d b c d e f g h i j k l m" % (doc + i) for i in range(3)]
        box.put([passage] * 3 + own, np.arange(doc, doc + 3).repeat(2).reshape(3, 2).T.ravel(), np.zeros(6, np.int64), np.full(6, 13), np.array([0] * 3 + [1] * 3))
        sent = [r for b in box.blocks() for r in b.to_pylist()]
        out = [(r["bucket"], r["found"], substring_dedup._unpack(r["rows"], r["bytes"], r["packed"])[0].tolist()) for r in sent]
        return {b: docs for b, found, docs in out if not found}, sorted(d for _, found, docs in out if found for d in docs)

    box = substring_dedup._Outbox(2)
    assert blocks(box, 10) == ({0: [10], 1: [10, 11, 12]}, [11, 12])
    assert blocks(box, 20) == ({1: [20, 21, 22]}, [20, 21, 22])
    assert blocks(box, 5) == ({0: [5], 1: [5, 6, 7]}, [6, 7])  # a smaller document is news to the bucket
    assert blocks(box, 8) == ({1: [8, 9, 10]}, [8, 9, 10])


def test_a_bucket_holds_a_passage_once(monkeypatch):
    monkeypatch.setattr(substring_dedup, "HELD_BYTES", 1000)
    passage = b"a b c d e f g h i j k l m n"
    packed = [substring_dedup._pack(np.array([d, d]), np.array([3, 90]), np.array([1, 0]), passage) for d in range(1, 501)]
    n, most = len(packed), [0]
    batch = pa.RecordBatch.from_pydict({"found": [False] * n, "rows": [2] * n, "bytes": [len(passage)] * n, "packed": packed})
    put = substring_dedup._Bucket.put

    def counted(self, *columns):
        put(self, *columns)
        most[0] = max(most[0], len(self.texts))

    monkeypatch.setattr(substring_dedup._Bucket, "put", counted)
    got = [tuple(r.values()) for out in substring_dedup._answer(iter([batch] * 2)) for r in out.to_pylist()]
    want = [(d, at, at + 14) for d in range(2, 501) for at in (3, 90)]
    assert sorted(set(got)) == want and len(got) == 2 * len(want)
    assert most[0] < 40


@pytest.mark.parametrize("held", [0, 200, 5000])
def test_repeats_equal_brute_force_when_little_is_held(monkeypatch, held):
    """Blocks of any size, with and without room to remember shared passages."""
    rng = np.random.default_rng(held)
    docs = []
    for d in range(60):
        size = int(rng.integers(0, 60))
        at = int(rng.integers(0, 30))
        docs.append((d, " ".join([f"v{i}" for i in rng.integers(0, 4, size)] + [f"p{i}" for i in range(at, at + 20)] + ["own", str(d)])))
    docs = [docs[i] for i in rng.permutation(60)]
    slot = [b.encode() for _, b in docs]
    ids = np.array([d for d, _ in docs])
    monkeypatch.setattr(substring_dedup, "HELD_BYTES", held)
    monkeypatch.setattr(substring_dedup, "SHARED_BYTES", held)
    sent = []
    for task in range(3):
        box = substring_dedup._Outbox(2, task)
        for i in range(task, 60, 3):
            w = words.split(pa.array([slot[i]], pa.binary()))
            start, count, key = substring_dedup.super_kmers(w)
            found = [b" ".join(slot[i].split()[a : a + c]) for a, c in zip(start.tolist(), count.tolist())]
            box.put(found, np.full(len(start), ids[i]), start, count, (key % np.uint64(2)).astype(np.int64))
            if box.held > held:
                sent += list(box.blocks())
        sent += list(box.blocks())
    blocks = pa.Table.from_batches(sent)
    gone: dict = {}
    for b in range(2):
        for out in substring_dedup._answer(iter(blocks.filter(pc.equal(blocks.column("bucket"), b)).to_batches())):
            for r in out.to_pylist():
                gone.setdefault(r["doc_id"], set()).update(range(r["start"], r["stop"]))
    assert {d: len(gone.get(d, ())) for d, _ in docs} == {d: n for d, _, n, _ in removed(docs)}
    assert any(gone.values())


def test_windows_with_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring_dedup, "_run_hashes", lambda h, n: np.zeros(max(len(h) - n + 1, 0), np.uint64))
    code = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3])
    got = substring_dedup.repeated_windows(code, np.array([0, 3, 6]), np.array([5, 6, 7]), 3)
    assert got.tolist() == [False, False, True]


def test_no_minimiser_gets_a_large_share_of_the_windows(spark):
    rng = np.random.default_rng(9)
    share = 1 / np.arange(1, 20_001)
    picked = rng.choice(20_000, 400_000, p=share / share.sum())
    texts = [" ".join(f"w{i}" for i in part) for part in picked.reshape(4000, 100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    with tables.Scratch(spark) as scratch:
        size, cells = substring_dedup.survey(docs, scratch)
    assert size == sum(len(t) for t in texts)
    frequent = np.zeros(substring_dedup.CELLS, bool)
    frequent[cells] = True
    w = words.split(pa.array([t.encode() for t in texts], pa.binary()))
    for flags, most in ((None, 0.01), (frequent, 0.002)):
        _, count, key = substring_dedup.super_kmers(w, frequent=flags)
        n = np.bincount(np.unique(key, return_inverse=True)[1], count - substring_dedup.WINDOW + 1)
        assert n.sum() == 4000 * 88 and n.max() / n.sum() < most


# 6. licences


def test_base_phrases_equal_brute_force(spark, odd):
    want = []
    for r in rows(spark, odd):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
        found, labels = [], set()
        for label, phrase in (("cc-by", b"cc by"), ("gpl", b"general public license"), ("reserved", b"all rights reserved")):
            p = phrase.split()
            own = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            found += own
            labels |= {label} if own else set()
        want.append((r.doc_id, len(w), len(found), min(found, default=None), max(found, default=None), ",".join(sorted(labels))))
    got = QUERIES["op6_licences"](spark, odd).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter(want)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 for r in got)
    assert next(r for r in got if r.doc_id == 407).labels == "cc-by,gpl,reserved"


def test_templates_need_their_key_phrases(spark):
    notice = "Licensed under the Apache License, Version 2.0"
    docs = [(1, f"x {notice} y"), (2, "Licensed under the Apache Foo, Version 2.0"), (3, "Permission is hereby granted, free of charge, to any person holding a copy of this software and associated documentation files"), (4, "filler")]
    got = {r.doc_id: r.labels for r in licences.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: "apache-2.0", 2: "", 3: "mit", 4: ""}


def test_templates_with_drift_are_found_where_a_plain_search_finds_them(spark):
    """Long templates with words put in, left out and changed: what is found holds when each start is tried, and nothing planted is missed."""
    rng = np.random.default_rng(11)
    text = [[f"l{x}" for x in rng.choice(90, 60)] for _ in range(3)]
    templates = tuple(licences.Template(f"t{i}", " ".join(w), (" ".join(w[20:23]),)) for i, w in enumerate(text))
    docs = []
    for d in range(60):
        own, changed = list(text[d % 3]), d % 13
        for k in sorted(rng.choice([*range(18), *range(26, 60)], changed, replace=False), reverse=True):
            own[k : k + 1] = [["x"], [own[k], "y"], []][(k if d % 2 else 0) % 3]
        docs.append((d, " ".join(["l1", "l2"] * (d % 4) + own + ["l3"] * (d % 3) + (text[(d + 1) % 3][:25] if d % 5 == 0 else []))))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: set(r.labels.split(",")) - {""} for r in licences.scan(frame, templates).collect()}

    def holds(t, words_):
        own, drift = t.text.split(), min(8, len(t.text.split()) // 10)
        phrase = t.key_phrases[0].split()
        for start in range(-len(own), len(words_)):
            near = lambda p, w: any(0 <= start + p + x < len(words_) and words_[start + p + x] == w for x in range(-drift, drift + 1))
            keys = any(words_[start + 20 + x : start + 23 + x] == phrase for x in range(-drift, drift + 1) if start + 20 + x >= 0)
            if keys and sum(near(p, w) for p, w in enumerate(own)) >= licences.COVERED * len(own):
                return True
        return False

    for d, doc in docs:
        want = {t.label for t in templates if holds(t, doc.split())}
        assert got[d] <= want
        if d % 13 <= 5:
            assert f"t{d % 3}" in got[d]
    assert sum(f"t{d % 3}" in got[d] for d in range(60)) >= 57


def test_whole_licences_are_found_with_words_put_in_or_left_out(spark):
    full = {t.label: t.text for t in licences.TEMPLATES if len(t.text) > 300}
    assert len(full) >= 10
    docs = []
    for i, (label, text) in enumerate(full.items()):
        w = text.split()
        at = 3 * len(w) // 4 if label in ("bsl-1.0", "unlicense") else 12  # inside no key phrase
        docs += [(10 * i, f"Copyright 2020 A.\n\n{text}\n\nmore"), (10 * i + 1, " ".join([*w[:at], "NOTE", "that", *w[at:]])), (10 * i + 2, " ".join(w[: len(w) // 2]))]
    lone = {label for label in full if sum(t.label == label for t in licences.TEMPLATES) == 1}
    got = {r.doc_id: (set(r.labels.split(",")), r.score) for r in licences.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, label in enumerate(full):
        assert label in got[10 * i][0] and got[10 * i][1] == pytest.approx(1.0), label
        assert label in got[10 * i + 1][0], label
        assert label not in got[10 * i + 2][0] or label not in lone, label
    assert len(lone) >= 5


def test_labels_and_scores_equal_brute_force(spark):
    import random

    rng = random.Random(4)
    templates = (licences.Template("a", "alpha beta gamma delta epsilon zeta eta theta", ("gamma delta",)), licences.Template("b", "alpha beta iota kappa lambda mu"), licences.Template("base", "zeta eta", base=True))
    docs = []
    for i in range(400):
        w = [rng.choice(["x", "y", "the", "alpha", "mu"]) for _ in range(rng.randrange(30))]
        for t in rng.sample(templates, rng.randrange(3)):
            own = t.text.split()
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = rng.choice(["zz", "alpha"])
            at = rng.randrange(len(w) + 1)
            w[at:at] = own
        docs.append((i, " ".join(w)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    known, n, texts = licences.document_frequencies(frame, templates)
    idf = dict(zip(known.tolist(), (np.log((texts + 1) / (n + 1)) + 1e-3).tolist()))
    weigh = lambda w: idf[int(licences._hash(w)[0])]
    want = {}
    for d, text in docs:
        w, labels, best = text.split(), set(), 0.0
        for t in templates:
            own = t.text.split()
            for s in range(-len(own), len(w)):
                same = [0 <= s + i < len(w) and w[s + i] == x for i, x in enumerate(own)]
                keys = all(same[own.index(k.split()[0]) + j] for k in t.key_phrases for j in range(len(k.split())))
                if all(same) if t.base else sum(same) / len(own) >= licences.COVERED and keys:
                    labels.add(t.label)
                    best = max(best, sum(weigh(x) for x, ok in zip(own, same) if ok) / sum(map(weigh, own)))
        want[d] = (",".join(sorted(labels)), best)
    got = {r.doc_id: (r.labels, r.score) for r in licences.scan(frame, templates).collect()}
    assert {d: x[0] for d, x in got.items()} == {d: x[0] for d, x in want.items()}
    assert all(got[d][1] == pytest.approx(want[d][1], abs=1e-9) for d in want)


# 7. near duplicates


def grouped(docs, percent=85):
    sets: dict = defaultdict(set)
    size = []
    for d, text in docs:
        w = lowered(text)
        s = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
        size.append((d, s))
        if d is not None:
            sets[d] |= {frozenset(s)}
    ids = sorted(sets)
    label = {d: d for d in ids}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return [(d, len(s), None if d is None else root(d), d is None or root(d) == d) for d, s in size]


def test_groups_equal_brute_force(spark, odd):
    docs = [(r.doc_id, r.text) for r in rows(spark, odd)]
    got = Counter(tuple(r) for r in QUERIES["op7_near_dedup"](spark, odd).collect())
    assert got == Counter(grouped(docs))


def test_large_regions_go_deeper_and_lose_nothing(spark, odd, monkeypatch):
    monkeypatch.setattr(near_dedup, "REGION", 4)
    monkeypatch.setattr(near_dedup, "HELD", 10)
    monkeypatch.setattr(near_dedup, "GATHERED", 400)
    docs = [(r.doc_id, r.text) for r in rows(spark, odd) if r.doc_id is not None and 200 <= r.doc_id < 400]
    got = Counter(tuple(r) for r in near_dedup.groups(spark.createDataFrame(docs, "doc_id long, text string"), percent=85).collect())
    assert got == Counter(grouped(docs))


def unlinked_documents(own, pairs, seed, first=0):
    """Documents of 400 words that share all but `own` of them (unlinked), and among them `pairs` isolated pairs over the threshold."""
    rng = np.random.default_rng(seed)
    shared = [f"s{i}" for i in range(400 - own)]
    docs = []
    for i in range(4 * pairs):
        words = [*shared, *(f"o{seed}x{i}x{j}" for j in range(own))]
        docs.append((first + len(docs), " ".join(words)))
        if i % 4 == 0:
            for k in rng.choice(len(shared) // 6, 6, replace=False):
                words[6 * k] = f"e{i}x{k}"
            docs.append((first + len(docs), " ".join(words)))
    return docs


def test_isolated_pairs_inside_unlinked_boilerplate_are_found(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "REGION", 1)
    monkeypatch.setattr(near_dedup, "GATHERED", 1000)
    docs = unlinked_documents(36, 8, 2)
    want = grouped(docs)
    assert sum(not k for *_, k in want) == 8
    got = Counter(tuple(r) for r in near_dedup.groups(spark.createDataFrame(docs, "doc_id long, text string"), percent=85).collect())
    assert got == Counter(want)


def test_a_thousand_near_copies_in_small_regions_are_one_group(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "REGION", 16)
    monkeypatch.setattr(near_dedup, "HELD", 64)
    monkeypatch.setattr(near_dedup, "GATHERED", 20_000)
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(1100):
        words = list(base)
        words[int(rng.integers(120))] = f"e{i}"
        docs.append((i, " ".join(words)))
    docs += [(5000 + i, " ".join(f"o{i}x{j % 50}" for j in range(60))) for i in range(40)]
    got = {r.doc_id: r.component_id for r in near_dedup.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: 0 if d < 5000 else d for d, _ in docs}


def test_similarity_is_a_parameter(spark):
    base = [f"w{i}" for i in range(200)]
    docs = [(1, " ".join(base))]
    for d, edits in ((2, 2), (3, 4), (4, 8)):
        words = list(base)
        for k in range(edits):
            words[20 + 20 * k] = f"e{d}x{k}"
        docs.append((d, " ".join(words)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for percent in (70, 80, 90, 95):
        assert Counter(tuple(r) for r in near_dedup.groups(frame, percent).collect()) == Counter(grouped(docs, percent))


def test_orders_are_cut_where_neighbours_share_least(monkeypatch):
    monkeypatch.setattr(near_dedup, "REGION", 3)
    assert near_dedup.pieces(np.array([0, 5, 4, 7, 6, 8, 8, 8, 8]), 4) == [(0, 2), (2, 4), (4, 7), (7, 9)]
    rng = np.random.default_rng(3)
    minima = rng.integers(0, 2, (400, near_dedup.DEPTH))
    upper, lower = np.zeros(400, np.uint64), np.zeros(400, np.uint64)
    for d in range(near_dedup.DEPTH):
        if d < 4:
            upper = upper << np.uint64(15) | minima[:, d].astype(np.uint64)
        else:
            lower = lower << np.uint64(16) | minima[:, d].astype(np.uint64)
    want = [0] + [next((d for d in range(near_dedup.DEPTH) if a[d] != b[d]), near_dedup.DEPTH) for a, b in zip(minima, minima[1:])]
    assert near_dedup.common_prefix(upper, lower).tolist() == want
    assert [near_dedup.shallowest(p) for p in (80, 85, 95)] == [3, 4, 8]


def test_members_of_a_part_are_linked_already():
    sets = [np.arange(i, i + 100, dtype=np.uint64) for i in (0, 2, 500, 502, 900)]
    assert near_dedup.linked(np.array([4, 7, 9, 2, 1]), sets, np.array([5, 5, 6, 7, 5]), percent=85).tolist() == [1, 1, 2, 2, 1]


def test_links_are_decided_on_whole_sets():
    base = np.arange(100, dtype=np.uint64)
    sets = [base, base[:92], np.concatenate([base[:92], np.arange(200, 208, dtype=np.uint64)]), np.arange(500, 600, dtype=np.uint64)]
    assert near_dedup.linked(np.array([4, 7, 9, 2]), sets, percent=85).tolist() == [4, 4, 4, 2]


# 8. archives


def test_archives_come_back_whole(spark, odd):
    for size in ("128m", "700", "100k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = Counter(tuple(r) for r in QUERIES["op8_warc"](spark, odd).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        payloads = [(r.page_id, (r.html or "").encode()) for r in rows(spark, odd, "pages")]
        last = {b: max(i for i, x in payloads if x == b) for _, b in payloads}
        want = Counter((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if len(b) >= 1000 and i != last[b] else "response", last[b] if len(b) >= 1000 and i != last[b] else None) for i, b in payloads)
        assert got == want


def test_records_behind_a_broken_one_are_not_read(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "x" * 50) for i in range(5)], "page_id long, url string, html string")
    warc.write_archives(pages.coalesce(1), f"{tmp_path}/a")
    part = next(p for p in (tmp_path / "a").iterdir() if p.name.startswith("part-"))
    records = part.read_bytes().split(warc.MAGIC)
    records[3] = re.sub(rb"Content-Length: (\d+)", lambda m: b"Content-Length: %d" % (int(m[1]) + 1), records[3])
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "part.txt").write_bytes(warc.MAGIC.join(records))
    assert warc.read_archives(spark, f"{tmp_path}/a").count() == 5
    assert warc.read_archives(spark, f"{tmp_path}/b").count() == 3


def test_revisits_of_a_page_id_with_two_payloads_keep_their_own(spark, tmp_path):
    a, b, c = "A" * 1500, "B" * 2500, "C" * 1200
    rows = [(7, "u", a), (7, "u", b), (5, "u", a), (4, "u", b), (7, "u", c), (7, "u", c)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in QUERIES["op8_warc"](spark, str(tmp_path)).collect())
    sha = lambda x: hashlib.sha1(x.encode()).hexdigest()
    want = [(7, len(x), sha(x), "response", None) for x in (a, b, c, c)] + [(5, 1500, sha(a), "revisit", 7), (4, 2500, sha(b), "revisit", 7)]
    assert got == sorted(want)


# 9. packing


def test_pieces_hold_each_token_once(spark, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    want = Counter()
    for r in rows(spark, odd):
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, packing.END], "<u4")
        want[(r.doc_id, ids.tobytes())] += 1
    pieces = QUERIES["op9_packing"](spark, odd).collect()
    for (doc, ids), n in want.items():
        own = sorted((p for p in pieces if p.doc_id == doc and p.doc_tokens == len(ids) // 4), key=lambda p: p.start)
        if n == 1 and doc != 3:
            at = 0
            for p in own:
                assert p.start == at and p.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + p.length)])
                at += p.length
            assert 4 * at == len(ids)
    assert sum(p.length for p in pieces) == sum(len(i) // 4 * n for (_, i), n in want.items())
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append(p)
    for own in by.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 2048 or at & (at - 1) == 0


def test_columns_that_clash_and_long_and_repeated_texts_are_packed(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    names = ("part", "place", "n", "total", "ids", "before", "pack", "start", "at")
    long = " ".join(f"w{i}" for i in range(30_000))
    docs = [(1, "a", long), (2, None, "short"), (2, None, "short"), (None, "a", None), (3, "b", "")]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string").select("*", *[F.lit("x").alias(n) for n in names])
    got = packing.pack(frame).collect()
    want = Counter((d, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 if t else 1) for d, _, t in docs)
    assert Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == want
    assert sum(r.length for r in got) == sum(n * k for (_, n), k in want.items())
    assert max(r.offset + r.length for r in got) <= 2048 and sum(r.doc_id == 1 for r in got) > 10


def test_windows_meet_the_mixture_and_carry_deficits():
    sizes = np.array([100_000, 50_000, 7_000, 900])
    windows = packing.round_robin(sizes)
    total = np.zeros(4)
    for i, taken in enumerate(windows[:-1]):
        assert sum(n for _, n in taken) == packing.LENGTH
        for s, n in taken:
            total[s] += n
        assert (np.abs(total - sizes / sizes.sum() * packing.LENGTH * (i + 1)) <= 2 * packing.PIECE + len(sizes)).all()


def test_targets_hold_until_a_source_runs_out(spark):
    docs = [(i, "a", "word " * 400) for i in range(60)] + [(100 + i, "b", "other " * 400) for i in range(60)]
    out = packing.pack(spark.createDataFrame(docs, "doc_id long, source string, text string"), targets={"a": 3.0, "b": 1.0})
    own = defaultdict(Counter)
    for r in out.collect():
        own[r.sequence_id]["b" if r.doc_id >= 100 else "a"] += r.length
    pieces = [r for r in out.collect() if r.doc_id < 100]
    assert {r.doc_id for r in pieces} == set(range(60)) and all(sum(p.length for p in pieces if p.doc_id == d) == next(p.doc_tokens for p in pieces if p.doc_id == d) for d in range(60))
    shares = packing.Shares(8, {"a": 600, "b": 600}, {"a": 3.0, "b": 1.0})
    assert shares.before("a", 600, 4) == pytest.approx(450, abs=2) and shares.before("b", 600, 4) == pytest.approx(150, abs=2)
    assert shares.before("a", 600, 8) == 600 and shares.before("b", 600, 8) == 600


def test_distinct_pieces_give_the_tokenizers_ids():
    import random

    rng = random.Random(2)
    parts = ["a", "b", " ", "  ", "\n", "\n\n", "\t", "é", "ß", "'s", "’", "12", "3.", ".", ",", "…", "中", "文", "<|endoftext|>", "😀", "|", "×", "ж", "\x1c", "\x85", " .", ": ", "́"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(1500)]
    encoder = packing.Encoder(packing.vocabulary_path())
    assert encoder.fast is not None
    ids, at = encoder(pa.array([t.encode() for t in texts], pa.binary()))
    for i, e in enumerate(encoder.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == e.ids


# 10. Brown


def test_base_scores_equal_brute_force_and_classes_help(spark, odd):
    docs = [(r.doc_id, [*lowered(r.text), None]) for r in rows(spark, odd)]
    count = Counter()
    for d, t in docs:
        if crc(d, 10) != 0:
            count.update(t)
    n, v = sum(count.values()), len(count)
    want = Counter((d, len(t), sum(count[x] > 0 for x in t), n, round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), 4)) for d, t in docs)
    got = QUERIES["op10_brown"](spark, odd).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_classes_beat_single_words_on_held_out_text(spark, sf_dir):
    out = [r for r in QUERIES["op10_brown"](spark, sf_dir).collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_scores_of_bands_equal_brute_force(spark, odd, monkeypatch):
    monkeypatch.setattr(brown, "FREQUENT", 0)
    monkeypatch.setattr(brown, "LEAST", 1 << 40)
    docs = [(r.doc_id, lowered(r.text)) for r in rows(spark, odd) if r.doc_id is not None and r.doc_id != 3]
    train = [t for d, t in docs if d % 2]
    count = Counter(w for t in train for w in t)
    kind = lambda w: sum(count[w] >= b for b in (2, 4, 10, 100)) * 6 + 3 * any(c > 127 for c in w) + (1 if w.endswith(b".") else 2 if w.endswith(b",") else 0)
    total, distinct = Counter(), Counter()
    for w, n in count.items():
        total[kind(w)] += n
        distinct[kind(w)] += 1
    beside = np.zeros((brown._WIDTH, brown._WIDTH))
    path = lambda t: [brown._END, *(brown.CLASSES + kind(w) for w in t), brown._END]
    for t in train:
        for a, b in zip(path(t), path(t)[1:]):
            beside[a, b] += 1
    share = (beside.sum(axis=0) + 0.5) / (beside.sum() + 0.5 * len(beside))
    log = np.log10((beside + brown.PRIOR * share) / (beside.sum(axis=1, keepdims=True) + brown.PRIOR))
    want = {d: sum(log[a, b] for a, b in zip(path(t), path(t)[1:])) + sum(math.log10((count[w] + 0.1) / (total[kind(w)] + 0.1 * (distinct[kind(w)] + (kind(w) < 6)))) for w in t) for d, t in docs}
    frame = spark.read.parquet(f"{odd}/documents.parquet").where("doc_id IS NOT NULL AND doc_id <> 3").select("doc_id", "text", F.expr("doc_id % 2 = 0").alias("held_out"))
    got = {r.doc_id: r.score for r in brown.score(frame).collect()}
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d], rel=1e-9) for d in want)


def test_scores_of_classes_equal_brute_force(spark, odd, monkeypatch):
    """With clustering on: each word has one class, and scores follow from plain counts over these."""
    monkeypatch.setattr(brown, "FREQUENT", 30)
    frames, plain = {}, tables.written
    monkeypatch.setattr(tables, "written", lambda df, name: frames.setdefault(name, plain(df, name)))
    docs = {r.doc_id: lowered(r.text) for r in rows(spark, odd) if r.doc_id is not None and r.doc_id != 3}
    train = {d: t for d, t in docs.items() if d % 2}
    frame = spark.read.parquet(f"{odd}/documents.parquet").where("doc_id IS NOT NULL AND doc_id <> 3").select("doc_id", "text", F.expr("doc_id % 2 = 0").alias("held_out"))
    got = {r.doc_id: r.score for r in brown.score(frame).collect()}
    group = {}
    for r in frames["classed"].collect():
        assert len(r.classes) == len(docs[r.doc_id])
        for w, c in zip(docs[r.doc_id], r.classes):
            assert group.setdefault(w, c) == c
    count = Counter(w for t in train.values() for w in t)
    frequent = [w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:30]]
    assert all(group[w] < brown.CLASSES for w in frequent)
    assert sum(group[w] < brown.CLASSES for w in count) > 30 and all(group[w] >= brown.CLASSES for w in group if count[w] < brown.LEAST)
    total, distinct = Counter(), Counter()
    for w, n in count.items():
        total[group[w]] += n
        distinct[group[w]] += 1

    def emitted(w):
        c = group[w]
        if c < brown.CLASSES:
            return math.log10(count[w] / total[c])
        return math.log10((count[w] + 0.1) / (total[c] + 0.1 * (distinct[c] + (c - brown.CLASSES < 6))))

    beside = np.zeros((brown._WIDTH, brown._WIDTH))
    path = lambda t: [brown._END, *(group[w] for w in t), brown._END]
    for t in train.values():
        for a, b in zip(path(t), path(t)[1:]):
            beside[a, b] += 1
    share = (beside.sum(axis=0) + 0.5) / (beside.sum() + 0.5 * len(beside))
    log = np.log10((beside + brown.PRIOR * share) / (beside.sum(axis=1, keepdims=True) + brown.PRIOR))
    want = {d: sum(log[a, b] for a, b in zip(path(t), path(t)[1:])) + sum(map(emitted, t)) for d, t in docs.items()}
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d], rel=1e-9) for d in want)


def likelihood(counts, group, classes):
    size = classes + len(counts) - len(group)
    full = np.concatenate([group, np.arange(classes, size)])
    pair = np.zeros((size, size))
    np.add.at(pair, (full[:, None], full[None, :]), counts)
    x = lambda v: (v[v > 0] * np.log(v[v > 0])).sum()
    return x(pair) - x(pair.sum(axis=0)) - x(pair.sum(axis=1))


def test_words_move_to_the_class_that_gains_most(monkeypatch):
    monkeypatch.setattr(brown, "ENTRIES", 7)
    rng = np.random.default_rng(6)
    groups, words_ = brown._WIDTH, 12
    pairs = rng.poisson(rng.random((groups, groups)) ** 6 * 40).astype(np.int64)
    stay = rng.integers(brown.CLASSES, groups, words_)
    before, after = rng.integers(0, groups, (words_, 6)), rng.integers(0, groups, (words_, 6))
    for w in range(words_):
        np.add.at(pairs, (before[w], stay[w]), 1)
        np.add.at(pairs, (stay[w], after[w]), 1)
    keys, count = np.unique(np.concatenate([(np.arange(words_)[:, None] << 8 | before).ravel(), (np.arange(words_)[:, None] << 8 | 128 | after).ravel()]), return_counts=True)
    got = brown.best_classes(keys >> 8, keys & 255, count, stay, pairs)
    x = lambda v: (v[v > 0] * np.log(v[v > 0])).sum()
    value = lambda p: x(p) - x(p.sum(axis=0)) - x(p.sum(axis=1))
    for w in range(words_):
        out = pairs.astype(float)
        np.add.at(out, (before[w], stay[w]), -1)
        np.add.at(out, (stay[w], after[w]), -1)
        best = {}
        for c in (*range(brown.CLASSES), int(stay[w])):
            held = out.copy()
            np.add.at(held, (before[w], c), 1)
            np.add.at(held, (c, after[w]), 1)
            best[c] = value(held)
        chosen = int(stay[w]) if got[w] == brown._STAYS else int(got[w])
        assert best[chosen] == pytest.approx(max(best.values()), abs=1e-6)


def test_exchange_ends_where_no_single_move_helps():
    rng = np.random.default_rng(1)
    counts = rng.poisson(rng.random((18, 18)) ** 4 * 30)
    group = brown.exchange(counts, 16, classes=3, rounds=50)
    best = likelihood(counts, group, 3)
    assert best > likelihood(counts, np.arange(16) % 3, 3)
    for w in range(16):
        for c in range(3):
            other = group.copy()
            other[w] = c
            assert likelihood(counts, other, 3) <= best + 1e-6


# shared


def test_words_are_runs_between_separators():
    texts = [None, "", " a  b\tc\n", "é x", "\x00a"]
    w = words.split(pa.array([None if t is None else t.encode() for t in texts], pa.binary()))
    got = [[w.data[a:b].tobytes() for a, b in zip(w.starts[i:j], w.ends[i:j])] for i, j in zip(w.first, w.first[1:])]
    assert got == [words_of(t) for t in texts]
    assert [x for x in w.array().to_pylist()] == [x for ws in got for x in ws]
    assert len(set(w.hashes().tolist())) == len(set(w.array().to_pylist()))
