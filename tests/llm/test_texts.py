"""Decontamination, personal data, token counts, packing and quality."""

import math
import random
import re
import zlib
from itertools import combinations, product

import numpy as np
import public_tokenizers
import pytest

from metadoc.llm import decontamination, packing, pii, quality, token_counts

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a  b", "a\n\n  b\t", "<s></s> [INST]", "日本語 テスト 🎉🎉", "x" * 5000, "é̂ ▁▁a ▁", "Don't <|endoftext|>a 's ΑΣ ΑΣ.",
       "\x1c\x85 b İi ﬁ", "a\x00b", "१२३ 12345 !!??..", "'s't're 'S", "a " * 3000]


def test_seeds_fit_between_any_two_substitutions():
    window, most = decontamination.WINDOW, decontamination.WINDOW - decontamination.NEEDED
    for n in range(most + 1):
        for changed in combinations(range(window), n):
            assert any(
                all(at + o not in changed for o in mask)
                for mask in decontamination.MASKS for at in range(window - mask[-1]))


def test_overlaps(spark):
    rnd = random.Random(2)
    item = [f"w{i}" for i in range(40)]
    noise = lambda n: [f"n{rnd.randint(0, 10**6)}" for _ in range(n)]
    changed = list(item)
    changed[3] = changed[9] = changed[16] = changed[22] = changed[30] = "z"
    docs = [
        (1, " ".join(noise(50) + item + noise(50))), (2, " ".join(noise(5) + changed)), (3, " ".join(item[10:23])),
        (4, " ".join(item[10:22])), (5, " ".join(noise(300))), (6, None), (7, ""), (8, "Only, FIVE short tokens: here!"),
        (9, "only five short tokens there"), (None, " ".join(item)), (10, " ".join(item[::2])), (1, " ".join(item)),
        (11, " ".join((item + noise(3)) * 50)), (12, "w1"),
    ]
    items = [(1, " ".join(item).upper()), (2, "only five short tokens here"), (3, "w1"), (4, None), (4, ""), (None, " ".join(item)), (1, " ".join(item).upper())]
    have = decontamination.overlaps(
        spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item", "2 AS tokens"),
        spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS at"))
    found = {(r.doc_id, r.item_id): (r.matched, r.item_tokens) for r in have.collect()}
    both = {(d, i): (13, 40) for d in (1, 3, None, 11) for i in (1, None)} | {(2, i): (12, 40) for i in (1, None)}
    # With one token missing only twelve of a window can be equal.
    both |= {(4, i): (12, 40) for i in (1, None)}
    assert found == both | {(8, 2): (5, 5), (12, 3): (1, 1)}


def test_short_seeds_fit_around_any_substitution():
    for n in range(decontamination.TOLERANT, decontamination.WINDOW):
        for changed in range(n):
            assert any(all(at + o != changed for o in mask) for mask in decontamination.SHORT_MASKS for at in range(n - mask[-1]))


def plain_tokens(text):
    spaced = "".join(f" {c} " if "\u4e00" <= c <= "\u9fff" or "\u3040" <= c <= "\u30ff" else c for c in (text or "").lower())
    return re.findall(r"[^\W_]+", spaced)


def plain_overlaps(docs, items):
    """All alignments of all documents with all items."""
    out = {}
    for (doc, text), (item, asked) in product(docs, items):
        t, want = plain_tokens(text), plain_tokens(asked)
        n, best = len(want), 0
        if 0 < n < 5:
            best = n if any(plain_tokens(line) == want for line in re.split(r"[\r\n]+", text or "")) else 0
        elif n:
            for shift in range(-n, len(t) + 1):
                equal = [0 <= shift + i < len(t) and t[shift + i] == want[i] for i in range(n)]
                best = max(best, max(sum(equal[s:s + 13]) for s in range(max(1, n - 12))))
        if best and best >= (11 if n >= 13 else n - 1 if n >= 8 else n):
            out[doc, item] = (max(best, out.get((doc, item), (0,))[0]), n)
    return out


def test_items_of_any_length_equal_plain_search(spark):
    rnd = random.Random(5)
    items = [(n, " ".join(f"i{n}x{j}" for j in range(n))) for n in (1, 2, 4, 5, 6, 7, 8, 9, 10, 12, 13, 14, 20)]
    items += [(30, "今日は天気がいいので散歩に行く"), (31, "犬が好き"), (32, "... !"), (33, None)]
    docs = []
    for n, text in items:
        words = plain_tokens(text)
        for changed in range(4):
            for place in range(6):
                some = list(words)
                for at in rnd.sample(range(len(some)), min(changed, len(some))):
                    some[at] = "zz"
                if changed and place == 5:
                    some = some[rnd.randint(0, 1):]
                ahead, behind = ([f"n{rnd.randint(0, 99)}" for _ in range(rnd.choice([0, 0, 3, 30]))] for _ in range(2))
                glue = rnd.choice([" ", "\n", "\r\n"])
                docs.append((len(docs), glue.join([" ".join(ahead), " ".join(some), " ".join(behind)])))
    docs += [(len(docs), "前置き。今日は天気がよいので散歩に行く。"), (len(docs) + 1, "x " * 200000 + items[8][1] + " y" * 1000), (len(docs) + 2, None)]
    found = decontamination.overlaps(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): (r.matched, r.item_tokens) for r in found.collect()} == plain_overlaps(docs, items)


def test_no_items_and_no_documents(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontamination.overlaps(docs, items).collect() == []
    assert decontamination.clean(docs, items).count() == 1
    assert decontamination.overlaps(docs.limit(0), docs.selectExpr("doc_id AS item_id", "text")).collect() == []


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    found = []
    for n, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]:
                found.append((m.start(), n, kind, m.end(), m[0]))
    return sorted(found)


def test_base_spans_equal_plain_search(spark):
    rnd = random.Random(4)
    texts = ["a@b.c_d@e.f", "x.@y.z.@a-b.c", "1.2.3.4.5.6.7.8", "300.1.1.1 0000255.1.1.01", "4111 1111-1111 1111", "4111  1111", "+1 (017) 555-7713)",
             "😀 +49 30 1234567 😀a@b.co", "a@b", "9" * 30, None, "", "+1+2 3456789 012", "4" * 100000 + "@", "a" * 100000, "1 2 " * 3000]
    texts += ["".join(rnd.choice("12 9.-+@ab()_%é4😀") for _ in range(rnd.randint(0, 90))) for _ in range(400)]
    texts += ["".join(rnd.choice(["4111111111111111", "a@b.c", "1.2.3.4", "+1 234 567 8901", " ", "-", "."]) for _ in range(rnd.randint(0, 300))) for _ in range(6)]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, word int")
    found = {r.doc_id: [tuple(s.asDict().values()) for s in r.base] for r in pii.personal_data(df).select("doc_id", "base").collect()}
    assert found == {i: plain_spans(t or "") for i, t in enumerate(texts)}


def test_trusted_patterns_find_what_no_fixed_pattern_knows(spark):
    rows = [(i, f"addr 10.0.{100 + i}.7 x") for i in range(12)] + [(50, "addr 10.0.999.7 x"), (51, "else 10.0.998.7 x")]
    found = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    spans = {r.doc_id: [tuple(s.asDict().values()) for s in r.spans] for r in found.select("doc_id", "spans").collect()}
    assert spans[50] == [(5, 1, "ip", 15, "10.0.999.7")] and spans[51] == []


def test_spans_stay_with_their_text(spark):
    rows = [(i, f"addr 10.0.{100 + i}.7 x") for i in range(12)] + [(50, "addr 10.0.999.7 x"), (50, "hi"), (None, "addr 10.0.998.7 x"), (None, "ho")]
    found = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text", "spans").collect()
    spans = {r.text: [(s.kind, s.start, s.end) for s in r.spans] for r in found}
    assert spans["hi"] == spans["ho"] == [] and spans["addr 10.0.999.7 x"] == spans["addr 10.0.998.7 x"] == [("ip", 5, 15)]


def spans_of(spark, texts):
    found = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "base", "spans")
    rows = {r.doc_id: r for r in found.collect()}
    for i, r in rows.items():
        assert all(texts[i][s.start:s.end] == s.value for s in r.spans)
    return [{(s.kind, s.value) for s in rows[i].spans} - {(s.kind, s.value) for s in rows[i].base} for i in range(len(texts))]


def test_identifiers_with_spaces_are_seeds_and_found(spark):
    seeds = [f"tel +1 (0{i}) 555-77{i} x" for i in range(10, 30)] + [f"line2 10.0.{i}.7 x" for i in range(100, 120)]
    seeds += [f"far{' ' * 60}10.1.{i}.7 x" for i in range(100, 112)] + [f"tag key=10.2.{i}.7/8 x" for i in range(100, 112)]
    digits = [f"411111111111{i:04}" for i in range(400)]
    seeds += [f"card {d[:4]} {d[4:8]} {d[8:12]} {d[12:]} x" for d in digits if luhn(d)]
    fresh = {
        "tel +1 (17) 55-77 x": {("phone", "+1 (17) 55-77")}, "née TEL: (+1 (017) 555-7713 4111 1111 1111 12)": {("phone", "+1 (017) 555-7713")},
        "line2 10.0.999.7 x": {("ip", "10.0.999.7")}, f"far{' ' * 70}10.0.999.7": {("ip", "10.0.999.7")},
        "line2 10.0.999.7 10.0.0.1": {("ip", "10.0.999.7")}, "card 4111 1111 1111 1112, x": {("card", "4111 1111 1111 1112")},
        "key=10.0.999.7/8 x": {("ip", "10.0.999.7")}, "room +1 (17) 55-78 x": set(), "seats 4111 1111 1111 1113": set()}
    found = spans_of(spark, seeds + list(fresh))
    assert found[:len(seeds)] == [set()] * len(seeds)
    assert dict(zip(fresh, found[len(seeds):])) == fresh


def test_context_is_whole_at_any_number_of_matches(spark):
    text = " ".join(f"a{i} 10.{i % 9}.999.{i}" for i in range(700))
    rows = [r for d in [spark.createDataFrame([(1, text)], "doc_id long, text string")] for r in pii._placed(
        d, {"word": (pii._WORD, "[0-9]")}).select(pii.F.explode("word").alias("w")).select("w.*").collect()]
    assert len(rows) == 1400
    assert all(r.before == text[:r.start][-48:] and r.value == text[r.start:r.end] for r in rows)


def test_rounds_go_on_until_patterns_stay_the_same(spark):
    # Each pattern knows four instances, which are enough for the next one: six rounds to the last.
    known = [(f"p{k}", f"v{k}-{i}", "ip" if k == 0 else None) for k in range(6) for i in range(4)]
    edges = known + [(f"p{k + 1}", f"v{k}-{i}", None) for k in range(5) for i in range(4)]
    found = pii.bootstrap(spark.createDataFrame(edges, "pattern string, value string, kind string"), confidence=0.5)
    assert {r.pattern for r in found.collect()} == {f"p{k}" for k in range(6)}


def test_redaction(spark):
    rows = [(1, "😀 mail a@b.co, now", "x"), (2, None, "y"), (3, "nothing", "z"), (1, "😀 mail a@b.co, now", "x"), (None, "+49 30 1234567", None)]
    clean = pii.redacted(spark.createDataFrame(rows, "doc_id long, text string, base string"))
    assert sorted(map(tuple, clean.collect()), key=repr) == sorted([
        (1, "😀 mail [EMAIL], now", "x"), (1, "😀 mail [EMAIL], now", "x"), (2, None, "y"), (3, "nothing", "z"), (None, "[PHONE]", None)], key=repr)
    assert pii.redacted(spark.createDataFrame(rows[:1], "doc_id long, text string, base string").limit(0)).collect() == []


def random_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("ab  \n\t'<>|.,1é▁Σİ日🎉́") for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_counts_equal_the_library():
    import sentencepiece

    texts = ODD + random_texts(1500, 1)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    own = token_counts.Counter(PIECES)
    assert [own.count(t) for t in texts] == [len(x) for x in library.encode(texts, num_threads=1)]


def test_token_count_rows(spark):
    rows = [(1, "Hello world", 5), (1, "Hello world", 5), (None, None, 1), (3, "", 1), (4, "word " * 5000, 1)]
    found = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PIECES).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens > 0, r.over_limit) for r in found) == [
        (0, 0, False, False), (1, 11, True, False), (1, 11, True, False), (3, 0, False, False), (4, 25000, True, True)]


def test_ids_equal_the_library(monkeypatch):
    from tokenizers import Tokenizer

    texts = ODD + random_texts(1500, 2)
    want = [np.asarray(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]
    own = packing.WordIds(WORDS)
    assert [own(t) for t in texts] == want
    monkeypatch.setattr(packing, "MEMORY", 20)
    own = packing.WordIds(WORDS)
    assert [own(t) for t in texts] == want


def test_packing_places_every_token_once(spark):
    from tokenizers import Tokenizer

    rnd = random.Random(6)
    texts = [None, "", "a"] + [" ".join(rnd.choice(["the", "of", "word", "x1"]) for _ in range(rnd.randint(1, 700))) for _ in range(60)] * 2 + ["the " * 9000]
    rows = [(i // 2 if i else None, t, 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class int")
    found = packing.pack(df, WORDS, size=256, unit=8).collect()
    library = Tokenizer.from_file(WORDS)
    want = sorted((i, library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in ((r[0] if r[0] is not None else -1, r[1]) for r in rows))
    whole, places = [], {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == places.get(r.sequence_id, 0) and r.length == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes())
        places[r.sequence_id] = r.offset + r.length
    assert max(places.values()) <= 256
    assert sum(places.values()) / (256 * len(places)) > 0.9
    # Pieces of documents with the same id cannot be told apart by id: whole documents are counted.
    tokens = sorted((r.doc_id if r.doc_id is not None else -1, t) for r in found for t in r.ids)
    assert tokens == sorted((i, t) for i, ids in want for t in ids)
    unique = [i for i in {w[0] for w in want} if sum(w[0] == i for w in want) == 1]
    for i in unique:
        pieces = sorted((r.start, r.ids, r.doc_tokens) for r in found if (r.doc_id if r.doc_id is not None else -1) == i)
        whole = [t for _, ids, _ in pieces for t in ids]
        assert whole == next(w[1] for w in want if w[0] == i) and {p[2] for p in pieces} == {len(whole)}
    assert packing.pack(df.limit(0), WORDS).collect() == []


@pytest.mark.parametrize("n", [1, 40, 5000])
def test_patterns_hold_every_piece(n):
    rng = np.random.default_rng(n)
    histogram = {}
    for c in rng.integers(1, 65, n):
        histogram[int(c)] = histogram.get(int(c), 0) + 1
    plan, got = packing.solve(histogram, 64), {}
    for times, pattern in plan:
        assert sum(c * k for c, k in pattern.items()) <= 64
        for c, k in pattern.items():
            got[c] = got.get(c, 0) + k * times
    assert got == histogram
    bound = sum(c * k for c, k in histogram.items()) / 64
    assert sum(t for t, _ in plan) <= 1.02 * bound + 40
    assert packing.solve({}, 64) == []


def test_scores_do_not_depend_on_slabs_or_batches(monkeypatch):
    texts = [b"", b" ", b"Some words of prose. " * 40, b"JUNK!! " * 900, "Écrit à la main é".encode() * 30, b"x" * 3000]
    labels = [0, 0, 1, 0, 1, 0]
    bags = [quality.encode([t])[0] for t in texts]
    model = quality.train(bags, labels, steps=150)
    whole = model.scores(texts)
    assert np.allclose(whole, [model.scores([t])[0] for t in texts])
    assert ((whole > 0) & (whole < 1)).all() and whole[2] > 0.5 > whole[3]
    parts = []
    words = texts[3].split()
    for at in range(0, len(words), quality.WORDS):
        parts.append(b" ".join(words[at:at + quality.WORDS]))
    one, _ = quality.encode([texts[3]])
    many, _ = quality.encode(parts)
    assert np.allclose(one, many)
    for y in ([], [1, 1], [0, 0]):
        assert 0 < quality.train(bags[:len(y)], y).scores([b"a"])[0] < 1


def test_quality_of_held_out_documents(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    found = quality.score(docs, model).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.doc_id]).all()
    held = found[found.held_out]
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.95
    rows = spark.createDataFrame([(None, None, "a"), (1, "", "b"), (1, "", "b")], "doc_id long, text string, score string")
    odd = quality.score(rows, model).collect()
    assert [(r.doc_id, r.held_out) for r in odd] == [(None, False), (1, False), (1, False)] and len({r.score for r in odd}) == 1
    assert quality.score(rows.limit(0), model).collect() == []
    no_labels = quality.fit(rows, labels.limit(0))
    assert [r.score for r in quality.score(rows, no_labels).collect()] == [0.5] * 3


def plain_score(k, x):
    """The chance of label 1 of one bag, a passage at a time."""
    codes = [np.tanh(row @ k["w1"] + k["b1"]) for row in x]
    logits = [float((np.tanh(h @ k["v"]) / (1 + np.exp(-(h @ k["u"])))) @ k["w"]) for h in codes]
    weights = [math.exp(v) for v in logits]
    z = sum(w * h for w, h in zip(weights, codes)) / sum(weights)
    return 1 / (1 + math.exp(-float(z @ k["c"] + k["c0"][0])))


def some_weights(rnd, hidden=5, attention=3):
    f = quality.FEATURES
    shapes = {"w1": (f, hidden), "b1": hidden, "v": (hidden, attention), "u": (hidden, attention), "w": attention, "c": hidden, "c0": 1}
    return {n: rnd.normal(0, 0.5, shape) for n, shape in shapes.items()}


def test_score_equals_plain_attention():
    rnd = np.random.default_rng(3)
    model = quality.Model(rnd.normal(0, 1, quality.FEATURES), rnd.uniform(0.5, 2, quality.FEATURES), some_weights(rnd))
    texts = [b"", b"one two", b"Some words, and 12 more. " * 40, b"a" * 500, "é ü 日本 ".encode() * 100]
    want = [plain_score(model.weights, (quality.encode([t])[0] - model.mean) / model.scale) for t in texts]
    assert np.allclose(model.scores(texts), want, atol=1e-9)


def test_gradients_equal_differences():
    rnd = np.random.default_rng(4)
    k, sizes = some_weights(rnd), np.array([1, 4, 2, 7])
    x = rnd.normal(0, 1, (sizes.sum(), quality.FEATURES))
    y, weight = np.array([1.0, 0.0, 1.0, 0.0]), np.array([0.7, 2.0, 0.7, 2.0])
    loss, found = quality.gradients(k, x, sizes, y, weight, 0.0)
    bags = np.split(x, np.cumsum(sizes)[:-1])
    chances = [plain_score(k, bag) for bag in bags]
    assert np.isclose(loss, -sum(w * math.log(p if t else 1 - p) for w, p, t in zip(weight, chances, y)) / 4)
    for name, values in k.items():
        for at in np.ndindex(values.shape):
            ends = []
            for step in (1e-5, -1e-5):
                moved = {n: v.copy() for n, v in k.items()}
                moved[name][at] += step
                ends.append(quality.gradients(moved, x, sizes, y, weight, 0.0)[0])
            assert np.isclose((ends[0] - ends[1]) / 2e-5, found[name][at], atol=1e-6), (name, at)


def test_training_uses_whole_documents_within_its_bound(spark):
    docs = [(i, ("good words here. " if i % 2 else "BUY!!! 99 ") * (40 * (1 + i % 7))) for i in range(60)] + [(60, "x " * 200000), (3, "other")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(61)], "doc_id long, quality int")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for passages in (200_000, 400, 1):
        scores = quality.score(df, quality.fit(df, labels, passages=passages)).collect()
        assert len(scores) == 62 and all(0 <= r.score <= 1 for r in scores)
    assert all((r.score > 0.5) == bool(r.doc_id % 2) for r in quality.score(df, quality.fit(df, labels)).collect() if r.doc_id < 60 and r.doc_id != 3)
