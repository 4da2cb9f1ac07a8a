"""Fingerprints, embeddings and components against plain loops."""

import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from metadoc.llm import embeddings, simhash
from metadoc.llm.shared import components


def plain_fingerprint(text, k=4):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").encode().split() if w]
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, seed=42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_and_components_equal_plain_loops(spark):
    rnd = random.Random(5)
    words = ["Ab", "ä", "of", "the", "\u3000", "x" * 50, "É", "İi"]
    base = [rnd.choice(words) + str(rnd.randint(0, 99)) for _ in range(300)]
    texts = [None, "", " \t\n", "one", "one two three", "One Two THREE", "a b c d", "a\x1cb c\x0bd e\r\nf"]
    texts += [" ".join(base[:i] + ["changed"] + base[i + 1:]) for i in range(0, 300, 9)]
    texts += [" ".join(rnd.sample(base, 80)) for _ in range(20)] + [" ".join(base)] * 3
    rows = [(i * 3 % 101, t, i) for i, t in enumerate(texts)] + [(None, "one", 1), (None, "nobody else", 1)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id int")).collect()
    assert len(found) == len(rows)
    prints = {t: plain_fingerprint(t) for _, t, _ in rows}
    links = [(a, b) for a in set(prints.values()) for b in set(prints.values()) if a != b and (a ^ b).bit_count() <= 4]
    assert links
    root = roots(set(prints.values()), links)
    least = {}
    for i, t, _ in rows:
        if i is not None:
            r = root[prints[t]]
            least[r] = min(least.get(r, i), i)
    want = sorted(((i, f"{prints[t]:016x}", least.get(root[prints[t]])) for i, t, _ in rows), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in found), key=repr) == want


def test_long_texts_are_read_whole(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(3000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 64)
    assert simhash.fingerprint(text) == whole == np.uint64(plain_fingerprint(text.decode())).astype(np.int64)


@pytest.mark.parametrize("distance,blocks", [(4, 2), (4, 3), (3, 2), (0, 2)])
def test_anchors_lose_no_link(spark, distance, blocks):
    rnd = random.Random(distance * 10 + blocks)
    values = [rnd.getrandbits(64) for _ in range(60)]
    for v in values[:40]:
        for n in range(distance + 3):
            values.append(v ^ sum(1 << b for b in rnd.sample(range(64), n)))
    values = sorted({v - 2**64 if v >= 2**63 else v for v in values})
    found = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), distance, blocks).collect()
    want = {(a, b) for a in values for b in values if a < b and ((a ^ b) % 2**64).bit_count() <= distance}
    assert len(found) == len(want) and {(r.a, r.b) for r in found} == want


def test_kept_documents(spark):
    rows = [(3, "same text here now", "x"), (1, "same text here now", "y"), (1, "same text here now", "y"), (None, "same text here now", "z"), (7, "another one entirely different", "w")]
    stay = simhash.kept(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted(map(tuple, stay.select("doc_id", "source").collect()), key=repr) == [(1, "y"), (7, "w"), (None, "z")]


def test_kept_loses_no_text_of_a_repeated_id(spark):
    far = ["the first of three quite different texts", "second one that has nothing in common", "and a third, unlike the two before"]
    rows = [(1, far[0], "a"), (1, far[1], "b"), (2, far[2], "c"), (1, far[0].upper(), "d"), (3, far[1], "e"), (1, None, "f"), (1, "", "f"), (4, " ", "g")]
    stay = simhash.kept(spark.createDataFrame(rows, "doc_id long, text string, name string")).collect()
    assert sorted((r.doc_id, (r.text or "").lower()) for r in stay) == sorted([(1, far[0]), (1, far[1]), (2, far[2]), (1, "")])


def test_vectors_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (5, [1.0, 0.01], 0), (4, [0.01, 1.0], 0), (4, [0.02, 1.0], 0), (9, [-1.0, 0.0], 0)]
    found = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(map(tuple, found)) == sorted([(1, 1, 1, True), (1, 2, 1, True), (5, 1, 1, False), (4, 2, 1, False), (4, 2, 1, False), (9, 0, 9, True)])


def test_empty_tables(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_components_of_chains_stars_and_loops(spark):
    rnd = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(200, 200 + i) for i in range(1, 40)] + [(5, 5), (None, 3), (7, 8), (8, 7)]
    links += [(rnd.randint(300, 400), rnd.randint(300, 400)) for _ in range(60)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert found == roots({x for l in real for x in l}, real)


@pytest.mark.parametrize("most_pivots", [4096, 1])
def test_vectors_equal_plain_loops(spark, most_pivots):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(240):
        v = centres[i % 6] + rng.normal(size=8) * [0.02, 0.08, 0.2][i % 3]
        rows.append((i, v.tolist(), i % 2))
    rows += [(300, rows[0][1], 0), (301, (2 * np.array(rows[0][1])).tolist(), 0), (301, rows[0][1], 0)]
    odd = [(400, None, 0), (401, [], 0), (402, [0.0] * 8, 0), (403, [math.nan] * 8, 0), (404, [None] + [1.0] * 7, 0),
           (405, rows[0][1], None), (406, [math.inf] * 8, 0), (None, rows[0][1], 0), (407, [1e200] * 8, 3), (408, [1e-200] * 8, 3), (409, [1.0], 3)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit(1))
    found = embeddings.near_duplicates(df, chunk=16, cell_rows=30, most_pivots=most_pivots).collect()
    n = len(rows)
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    linked = [(a, b) for a in range(n) for b in range(n) if a != b and rows[a][2] == rows[b][2] and cos(rows[a][1], rows[b][1]) >= 0.98]
    root = roots({r[0] for r in rows}, [(rows[a][0], rows[b][0]) for a, b in linked if rows[a][0] != rows[b][0]])
    want = [(rows[a][0], sum(1 for x, _ in linked if x == a), root[rows[a][0]], root[rows[a][0]] == rows[a][0]) for a in range(n)]
    want += [(i, 0, i, True) for i, _, _ in odd if i not in (407, 408)] + [(407, 1, 407, True), (408, 1, 407, False)]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
