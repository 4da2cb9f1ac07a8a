"""Ranked search, mixing and alignment against plain loops."""

import hashlib
import math
import random
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest

from metadoc.llm import alignment, mixing, ranked

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_search(docs, queries, k):
    """Scores of all documents for all queries, by the formula."""
    docs = [(d, Counter(w := ranked.terms((t or "").encode())), len(w)) for d, t in docs]
    n_docs, total = sum(1 for *_, n in docs if n), sum(n for *_, n in docs)
    df = Counter(t for _, own, _ in docs for t in own)
    out = []
    for item, text in queries:
        scores = []
        for at, (d, own, n) in enumerate(docs):
            m = 25 + 75 * n * n_docs // total if total else 25
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * own[t] // (1000 * own[t] + 8 * m))
                for t in ranked.terms((text or "").encode()) if t in own)
            if score > 0:
                scores.append((-score, d is None, d or 0, at))
        for rank, (score, _, d, at) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, docs[at][0], -score))
    return sorted(out, key=repr)


def test_search_equals_scoring_everything(spark, monkeypatch):
    rnd = random.Random(3)
    words = [f"w{min(int(rnd.expovariate(0.02)), 400)}" for _ in range(4000)] + ["É", "é", "ΑΒ", "日本", "a b", "x-y", "A"]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 60)))) for i in range(700)]
    docs += [(i, docs[7][1]) for i in (900, 850, 20, 899)] + [(None, docs[7][1]), (None, None), (5, ""), (6, "!?"), (7, docs[7][1])]
    docs += [(1000, " ".join(rnd.choices(words, k=60_000))), (1001, "w1 " * 50)]
    asks = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 12)))) for i in range(40)]
    asks += [(40, docs[7][1]), (40, docs[7][1]), (None, "w1 w1 W1"), (41, None), (42, ""), (43, "nowhere"), (44, "a.b É")]
    rnd.shuffle(docs)
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, score int, n int").repartition(3)
    items = spark.createDataFrame([(i, t, 1) for i, t in asks], "item_id long, text string, rank int")
    for k, block in ((10, 7), (3, 4096)):
        monkeypatch.setattr(ranked, "BLOCK_QUERIES", block)
        found = ranked.search(frame, items, k).collect()
        assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in found), key=repr) == plain_search(docs, asks, k)


def test_trees_lose_nothing_and_prune():
    rnd = np.random.default_rng(1)
    rows = [np.unique(rnd.integers(0, 40, rnd.integers(1, 9))) for _ in range(3000)]
    vals = [rnd.integers(1, 9_000_000_000, len(r)) for r in rows]
    vals[:2500] = [np.full(len(r), 1_000) for r in rows[:2500]]
    ptr = np.r_[0, np.cumsum([len(r) for r in rows])]
    tree = ranked.BallTree(np.concatenate(rows), np.concatenate(vals), ptr, 40, leaf=8)
    opened = leaves = 0
    for _ in range(30):
        query, kept = np.zeros(40, np.int64), []
        query[rnd.integers(0, 40, 5)] = rnd.integers(1, 4, 5)
        opened += tree.search(query, 10, np.arange(3000), kept)
        leaves += sum(1 for n in tree.nodes if n[5] < 0)
        scores = sorted(((int(v @ query[r]), -i) for i, (r, v) in enumerate(zip(rows, vals)) if v @ query[r] > 0), reverse=True)
        assert sorted(kept, reverse=True) == scores[:10]
    assert opened < leaves / 2


def test_search_of_nothing(spark):
    docs, none = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert ranked.search(docs, none).collect() == []
    assert ranked.search(docs.limit(0), docs.selectExpr("doc_id AS item_id", "text")).collect() == []


def plain_targets(sizes, weights, cap, total):
    held, targets = set(), {}
    while True:
        rest = total - sum(cap * sizes[s] for s in held)
        share = sum(weights[s] for s in sizes if s not in held)
        now = {s for s in sizes if s not in held and weights[s] * rest > cap * sizes[s] * share}
        if not now:
            return {s: cap * sizes[s] if s in held else (weights[s] * rest / share if share else 0) for s in sizes}
        held |= now


@pytest.mark.parametrize("total", [None, 9000, 10**6])
def test_mixing(spark, total):
    rnd = random.Random(4)
    names = ["b", "a", None, "É", "Z", "", "huge", "z"]
    counts = {"b": 60, "a": 30, None: 12, "É": 5, "Z": 1, "": 80, "huge": 400, "z": 3}
    rows = [(i, s, " \t".join(["w w"] * rnd.choice([0, 1, 5, 9, 30]))) for i, s in enumerate(s for s in names for _ in range(counts[s]))]
    rows += [(5000, "b", None), (5001, "b", "\x0b \r\n"), (None, "b", "one two"), (1, rows[1][1], rows[1][2]), (5002, "all blank", " ")]
    rows += [(6000, "huge", "x " * 20_000)]
    frame = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, source string, text string, size int, target double")
    found = mixing.mix(frame, mixing.cycled(frame, (5, 2, 1)), 3, total).collect()
    again = mixing.mix(frame.repartition(7), mixing.cycled(frame.repartition(5), (5, 2, 1)), 3, total).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again)) and len(found) == len(rows)
    words = lambda t: len((t or "").encode().split())
    assert Counter((r.doc_id, r.source, r.size) for r in found) == Counter((d, s, words(t)) for d, s, t in rows)
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += words(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = plain_targets(sizes, weights, 3, sum(sizes.values()) if total is None else min(total, 3 * sum(sizes.values())))
    taken, largest = Counter(), Counter()
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], abs=1e-6)
        assert r.taken == r.repeats * r.size and r.repeats <= 3
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s, aim in want.items():
        assert abs(taken[s] - aim) <= max(largest[s], 1)
    rebuilt = mixing.repeated(frame, spark.createDataFrame(found)).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in rebuilt} == {s: n for s in sizes if (n := sum(r.repeats for r in found if r.source == s))}


def test_mixing_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(none, mixing.cycled(none, (5, 2, 1))).collect() == []
    one = spark.createDataFrame([(1, "a", None), (2, "b", "")], none.schema)
    assert {r.taken for r in mixing.mix(one, mixing.cycled(one, (1,))).collect()} == {0}
    assert [r.target for r in mixing.mix(spark.createDataFrame([(1, "a", "w")], none.schema), one.selectExpr("'b' AS source", "1 AS weight")).collect()] == [0.0]


@lru_cache
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    left = Tokenizer.from_file(BYTES)
    left.encode_special_tokens = True
    return left, sentencepiece.SentencePieceProcessor(model_file=PIECES), alignment.ByteLevel(BYTES).bytes


def plain_links(texts):
    """Each document's tokens by the libraries, grouped by walking along both."""
    left, right, of_a = libraries()
    of_b = lambda i: bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode()
    docs = []
    for text in texts:
        a, b = (left.encode(" " + text, add_special_tokens=False).ids, right.encode(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        groups, end_a, end_b = [], 0, 0
        if text and b"".join(of_a[i] for i in a) == whole == b"".join(map(of_b, b)):
            a, b = a[::-1], b[::-1]
            while a or b:
                if end_a == end_b:
                    groups.append(([], []))
                if end_a <= end_b:
                    groups[-1][0].append(a.pop())
                    end_a += len(of_a[groups[-1][0][-1]])
                else:
                    groups[-1][1].append(b.pop())
                    end_b += len(of_b(groups[-1][1][-1]))
        docs.append(groups)
    return docs


def plain_link_counts(texts):
    docs = plain_links(texts)
    linked = [[(p, q) for x, y in groups for p in x for q in y] for groups in docs]
    counts = Counter(pair for own in linked for pair in set(own))
    best = {}
    for (p, _), n in counts.items():
        best[p] = max(best.get(p, 0), n)
    for groups, own in zip(docs, linked):
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(own),
               sum(counts[x] == best[x[0]] for x in own), sum(counts[x] for x in own),
               hashlib.sha256(written.encode()).hexdigest() if groups else "")


def odd_texts(n):
    rnd = random.Random(6)
    parts = ["a", "b ", " ", "  ", "\n", "\t", "\r", "é", "▁", "日本", "\x1c", "\x85", "\xa0", "1", "23", "!", "'s", "'S", " '", "<|endoftext|>",
             "<s>", "🎉", "　", "Don't", "ΑΣ", "\x00", "²", "''t", "्", "१", "x" * 60, ".", ", "]
    return ["".join(rnd.choices(parts, k=rnd.randint(0, 25))) for _ in range(n)]


def test_links_equal_plain_loop(spark, monkeypatch):
    texts = [None, "", " ", "a", "a", "▁", " a", "a▁b", "x" * 3000, "The cat's  hat.\n\nOn it\n sat.", "日本語 テスト 🎉🎉" * 300] + odd_texts(300)
    rows = [(i if i % 7 else None, t, 1) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_a int").repartition(3)
    found = alignment.link_counts(frame, BYTES, PIECES).collect()
    want = sorted(((d, *w) for (d, _, _), w in zip(rows, plain_link_counts(texts))), key=repr)
    assert sorted(map(tuple, found), key=repr) == want
    groups = {i: g for i, g in enumerate(plain_links(texts)) if i % 7}
    for r in alignment.alignments(frame, BYTES, PIECES).filter("doc_id is not null").collect():
        begin = (0, 0)
        for (x, y), end in zip(groups[r.doc_id], zip(r.a_cuts, r.b_cuts), strict=True):
            assert (r.a_ids[begin[0]:end[0]], r.b_ids[begin[1]:end[1]]) == (x, y)
            begin = end


def test_parts_are_what_whole_texts_give(monkeypatch):
    texts = odd_texts(3000)
    one = alignment.Aligner(BYTES, PIECES)
    assert one.splits == 2
    monkeypatch.setattr(alignment, "MEMORY", 500)
    for at in range(0, len(texts), 100):
        some = texts[at:at + 100]
        for (digest, numbers, packed), groups in zip(one.texts([t.encode() for t in some]), plain_links(some)):
            assert list(numbers) == [sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups)]
            links = np.frombuffer(packed, np.int64)
            assert ((links >> alignment.PAIR_BITS) + 1).sum() == sum(len(x) * len(y) for x, y in groups)
    assert one.texts([b"\xff", b"a\xc3"]) == [("", (0, 0, 0), b"")] * 2


def test_large_groups_are_counted_by_ids(monkeypatch):
    a, b = np.array([1, 2, 1, 3]), np.array([7, 7, 8])
    cut = np.array([3, 4]), np.array([2, 3])
    flat = lambda found: sorted(Counter({}).__class__(
        {k: sum(t for o, c, t in zip(*map(np.ndarray.tolist, found)) if (o, c) == k) for k in set(zip(*map(np.ndarray.tolist, found[:2])))}).items())
    want = flat(alignment.links(a, b, *cut, np.array([0, 1]), 10))
    monkeypatch.setattr(alignment, "WRITTEN_OUT", 1)
    monkeypatch.setattr(alignment, "MOST_TIMES", 3)
    assert flat(alignment.links(a, b, *cut, np.array([0, 1]), 10)) == want == [((0, 17), 4), ((0, 27), 2), ((1, 38), 1)]


def test_links_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.link_counts(none, BYTES, PIECES).collect() == [] == alignment.alignments(none, BYTES, PIECES).collect()
    blank = spark.createDataFrame([(1, None), (1, "")], none.schema)
    assert [tuple(r) for r in alignment.link_counts(blank, BYTES, PIECES).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2
