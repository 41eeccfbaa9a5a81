"""Alignment, ranked search and the Jaccard join against brute force, on tables with every odd case."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from conftest_helpers import lowered

from assayer.llm import alignment, exchange, jaccard_join, tables, treap_search
from assayer.llm.packing import vocabulary_path


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- 11: alignment


def brute_alignment(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary_path())
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    b = SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    kept = []
    for doc_id, text in rows:
        groups = []
        if text:
            whole = (" " + text).encode()
            found = a.encode(" " + text, add_special_tokens=False)
            bytes_a = [(i, bytes(byte[c] for c in t)) for i, t in zip(found.ids, found.tokens)]
            bytes_b = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
            if b"".join(x for _, x in bytes_a) == whole == b"".join(x for _, x in bytes_b):
                ends = []
                for side in (bytes_a, bytes_b):
                    at, out = 0, []
                    for _, x in side:
                        at += len(x)
                        out.append(at)
                    ends.append(out)
                both, sides = set(ends[0]) & set(ends[1]), ([[]], [[]])
                for out, side, stops in zip(sides, (bytes_a, bytes_b), ends):
                    for (i, _), stop in zip(side, stops):
                        out[-1].append(i)
                        if stop in both:
                            out.append([])
                groups = list(zip(*sides))[:-1]
        kept.append((doc_id, groups))
    count = Counter(p for _, groups in kept for p in {(x, y) for g in groups for x in g[0] for y in g[1]})
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, groups in kept:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


TEXTS = [
    (1, "The quick brown fox, isn't it?  Two  spaces\n\n\tand   tabs "), (2, "<|endoftext|> <s> x</s> <0x41> <unk>"), (3, "a▁b has the mark itself"), (4, "日本語の文章と emoji 😀😀 — ñandú"), (5, ""), (6, None), (7, " "), (8, "  "), (9, "\x00\x01\x7f wide space"),
    (10, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 9), (11, "ก็ได้ ไม่เป็นไร"), (12, "x" * 3000 + "é" * 3000), (13, "12 345 6789 0000000000"), (None, "The quick brown fox"), (1, "The quick brown fox"), (1, "The quick brown fox"),
]


def test_alignment_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(alignment, "LISTED", 6)  # groups of a few links go as products
    docs = spark.createDataFrame(TEXTS, "doc_id int, text string").selectExpr("*", "'x' AS n_a", "1 AS block", "2 AS bucket", "3 AS answers").repartition(3)
    got = alignment.aligned(docs)
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert got.columns == list(names) and dict(got.dtypes)["doc_id"] == "int"
    assert rows_of(got, *names) == brute_alignment(TEXTS)


def test_alignment_query(spark, odd, empty):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{odd}/documents.parquet").collect()]
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert rows_of(alignment.op11_alignment(spark, odd), *names) == brute_alignment(docs)
    assert alignment.op11_alignment(spark, empty).collect() == []


def test_piece_texts_may_be_cut_at_spaces():
    pieces = alignment.Pieces(vocabulary_path("piece_bpe_32k.model"))
    assert pieces.apart
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "the", " ", "  ", "\n", "é", "日", "\t", ".", "ing", "1", "😀", "▁"]) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    data, offsets = alignment.words.buffers(pa.array([(" " + t).encode() for t in texts], pa.binary()))
    ids, first, good = pieces(data, offsets)
    found = [ids[x:y].tolist() for x, y in zip(first, first[1:])]
    assert [f for f, t in zip(found, texts) if "▁" not in t] == [pieces.model.encode(t) for t in texts if "▁" not in t]
    assert good.tolist() == ["▁" not in t for t in texts]


def test_pair_keys_go_back():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 16, 5000), rng.integers(0, 1 << 16, 5000)
    x, y = alignment.pair_of(alignment.pair_key(a, b))
    assert (x == a).all() and (y == b).all()


def test_exchange_in_many_groups(spark):
    rng = np.random.default_rng(2)
    sent, want, best, rows = {}, Counter(), defaultdict(int), []
    for block in range(7):
        keys = np.unique(rng.integers(0, 1 << 12, 300).astype(np.uint64))
        counts = rng.integers(1, 9, len(keys))
        sent[block] = keys, exchange.rows(block, keys, counts, 12, 5, 8)
        rows += sent[block][1]
        for k, n in zip(keys.tolist(), counts.tolist()):
            want[k] += n
    for k, n in want.items():
        best[k >> 4] = max(best[k >> 4], n)
    df = spark.createDataFrame(rows, exchange.SENT)
    for group in (100, 2):
        with tables.Scratch(spark) as scratch:
            answers = {r["block"]: r["answers"] for r in exchange.answered(df, 7, scratch, owner=4, group=group).collect()}
        for block, (keys, own) in sent.items():
            total, flags = exchange.read_answers(answers[block], [r[2] for r in own])
            assert total.tolist() == [want[k] for k in keys.tolist()]
            assert flags.tolist() == [want[k] == best[k >> 4] for k in keys.tolist()]


# --- 12: ranked search


def brute_search(docs, items, k=10):
    def terms(text):
        return [x.decode() if x.isascii() else x for x in re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))]

    held = [(d, Counter(terms(t))) for d, t in docs if d is not None and terms(t)]
    documents, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(x for _, c in held for x in c)
    out = []
    for item, text in items:
        asked = Counter(x for x in terms(text) if x in df)
        scored = []
        for d, c in held:
            m = 100 - 75 + 75 * sum(c.values()) * documents // length
            s = sum(r * math.floor(1000 * math.log((2 * documents + 2) / (2 * df[x] + 1))) * (1_000_000_000 * c[x] // (1000 * c[x] + 8 * m)) for x, r in asked.items() if x in c)
            scored.append((-s, d))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(x for x in scored if x[0] < 0)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard", [4000, 1 << 24])
def test_search_equals_brute_force(spark, odd, monkeypatch, shard):
    monkeypatch.setattr(treap_search, "SHARD_BYTES", shard)
    docs, items = (spark.read.parquet(f"{odd}/{t}.parquet") for t in ("documents", "benchmark"))
    more = [(7, rows[1]) for rows in [(0, "a a a x one")]] + [(8, "CC by the general"), (8, "CC by the general"), (9, "passage nowhere")]
    items = items.select("item_id", "text").unionByName(spark.createDataFrame(more, "item_id long, text string"))
    got = rows_of(treap_search.search(docs, items, block=20), "item_id", "rank", "doc_id", "score")
    assert got == brute_search([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])


def test_search_ties_and_empty(spark, odd, empty):
    docs = [(i, "same words here") for i in range(300, 0, -1)] + [(500, "same here"), (501, None), (None, "same words here")]
    items = [(1, "words"), (2, "SAME, same"), (3, ""), (4, None), (None, "here")]
    got = treap_search.search(spark.createDataFrame(docs, "doc_id int, text string").repartition(4), spark.createDataFrame(items, "item_id string, text string"))
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == brute_search(docs, [(None if i is None else str(i), t) for i, t in items])
    assert treap_search.op12_treap_search(spark, empty).collect() == []


def test_treaps_are_search_trees_and_heaps():
    rng = np.random.default_rng(4)
    first = np.array([0, 1, 50, 400])
    priority = np.concatenate([rng.permutation(n) for n in np.diff(first)])
    left, right, roots = treap_search.treaps(first, priority)
    for root, a, b in zip(roots, first, first[1:]):
        seen, todo = [], [(int(root), a, b)]
        while todo:
            node, low, high = todo.pop()
            assert low <= node < high and priority[node] == priority[low:high].max()
            seen.append(node)
            todo += [(int(c), x, y) for c, x, y in ((left[node], low, node), (right[node], node + 1, high)) if c >= 0]
        assert sorted(seen) == list(range(a, b))


def test_search_leaves_ranges_out(monkeypatch):
    """Few documents of a long list are scored where one term is rare and heavy."""
    rng = np.random.default_rng(5)
    n = 20_000
    rare = np.sort(rng.choice(n, 30, replace=False))
    first, place = np.array([0, n, n + 30]), np.concatenate([np.arange(n), rare])
    impact = np.concatenate([rng.integers(500, 1000, n), rng.integers(900_000, 1_000_000, 30)])
    held = treap_search.Treaps(first, place, impact)
    scored = []
    moved = held._moved
    monkeypatch.setattr(held, "_moved", lambda node, low, high: (scored.append(len(node)), moved(node, low, high))[1])
    places, score = held.search(np.array([0, 1]), np.array([1, 10]), 10)
    whole = np.zeros(n, np.int64)
    whole += impact[:n]
    whole[rare] += 10 * impact[n:]
    order = np.lexsort((np.arange(n), -whole))[:10]
    assert places.tolist() == order.tolist() and score.tolist() == whole[order].tolist()
    assert sum(scored) / 3 < n / 4


# --- 13: Jaccard join


def brute_join(rows, percent, size):
    sets = []
    for _, text in rows:
        w = lowered(text)
        sets.append({tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set())
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            if a is not None and b is not None and sets[i] and sets[j] and Fraction(len(sets[i] & sets[j]), len(sets[i] | sets[j])) >= Fraction(percent, 100):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted(((d, len(s), None if d is None else find(d)) for (d, _), s in zip(rows, sets)), key=repr)


def near_rows():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    shared = [word() for _ in range(70)]
    rows, at = [], 0
    for length in (3, 9, 10, 12, 20, 40, 90, 250):
        base = [word() for _ in range(length)]
        for edits in (0, 0, 1, 1, 2, 3, 4, 6):
            near = list(base)
            for k in rng.sample(range(length), min(edits, length)):
                near[k] = word()
            at += 1
            rows.append((at, " ".join(near + [word()] * (at % 5 == 0))))
    rows += [(1000 + i, " ".join([word() for _ in range(5)] + shared + [word() for _ in range(i % 40)])) for i in range(60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("light", [None, 0, 30])
@pytest.mark.parametrize("percent", [85])
def test_join_equals_brute_force(spark, monkeypatch, light, percent):
    if light is not None:
        monkeypatch.setattr(jaccard_join, "boundary", lambda costs: light)
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 3000)
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(jaccard_join.joined(docs, percent), "doc_id", "n_shingles", "component_id") == brute_join(rows, percent, 4)


def test_join_of_odd_tables(spark, odd, empty):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{odd}/documents.parquet").collect()]
    assert rows_of(jaccard_join.op13_jaccard_join(spark, odd), "doc_id", "n_shingles", "component_id") == brute_join(docs, 85, 4)
    assert jaccard_join.op13_jaccard_join(spark, empty).collect() == []


def test_rows_that_share_an_id_join_what_each_links(spark):
    rng = random.Random(9)
    one, two = (" ".join("".join(rng.choice("abcd") for _ in range(5)) for _ in range(40)) for _ in range(2))
    rows = [(1, one), (5, one), (5, two), (7, two), (9, two + " x"), (None, one), (None, two)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS rep", "'y' AS label")
    assert rows_of(jaccard_join.joined(docs), "doc_id", "n_shingles", "component_id") == brute_join(rows, 85, 4)


@pytest.mark.parametrize("copies", [20, 160])
def test_sets_of_a_large_group_meet_in_few_places(spark, monkeypatch, copies):
    """Near copies send rows as their number, not as the subsets or pairs that they make."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, rows, sent = [word() for _ in range(400)], [], {}
    for i in range(copies):
        near = list(base)
        for k in rng.sample(range(400), 3):
            near[k] = word()
        rows.append((i + 1, " ".join(near)))
    written = tables.Scratch.written
    monkeypatch.setattr(tables.Scratch, "written", lambda self, df, name: (df := written(self, df, name), sent.setdefault(name, df.count()))[0])
    got = rows_of(jaccard_join.joined(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_shingles", "component_id")
    assert got == brute_join(rows, 85, 4)
    assert 0 < sent["meetings"] <= 2 * 62 * copies  # at most two for each shingle of the prefix: 397 - 338 + 2, and one over


def test_boundary_is_where_both_are_fewest():
    assert jaccard_join.boundary([]) == 0
    assert jaccard_join.boundary([(10, 5.0, 50.0), (20, 30.0, 60.0), (40, 900.0, 70.0)]) == 20
    assert jaccard_join.boundary([(10, 5.0, 1.0)]) == 0
