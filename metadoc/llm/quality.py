"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``WORDS`` words. Every passage is encoded (counts and shares of
character kinds, word lengths, repetition; then one hidden layer). Gated attention,
softmax(w . (tanh(V h) * sigmoid(U h))), weighs the passages, and the weighted sum of their codes gives
the document's score; only the documents have labels. Training uses a bounded sample of labelled
documents; scoring streams over all of them, passage sums being kept in a running softmax, so that a
text of any length takes bounded memory.
"""

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from metadoc.llm.shared import materialize

WORDS = 64
#: Texts are looked at in slabs of about so many bytes.
SLAB = 1 << 20

_KIND = np.full(256, 7, np.uint8)  # bytes of characters beyond ASCII
_KIND[:128] = 6  # symbols
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[[ord(c) for c in ".,;:'\"()-?"]] = 4
_KIND[ord("!")] = 5
FEATURES = 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _powers(base, n):
    out = np.empty(n, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


_UP = _powers(_ODD, SLAB + 65536)
_DOWN = _powers(np.uint64(pow(int(_ODD), -1, 1 << 64)), SLAB + 65536)


def encode(texts):
    """Features of the passages of some texts of a slab's size in all, and the text each belongs to.

    A text without words has one passage without words.
    """
    data = np.frombuffer(b" ".join([*texts, b""]) or b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    kind = _KIND[data]
    solid = kind > 0
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    first, last = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    owner = np.searchsorted(ends, first, "right")
    words = np.bincount(owner, minlength=len(texts))
    # Number of each word in its text, and the passage it lies in.
    nth = np.arange(len(first)) - np.repeat(np.cumsum(words) - words, words)
    per = np.maximum(1, -(-words // WORDS))
    base = np.cumsum(per) - per
    passage = base[owner] + nth // WORDS
    n = int(per.sum())
    of = np.repeat(np.arange(len(texts)), per)
    out = np.zeros((n, FEATURES))
    if not len(first):
        out[:, 19] = 1
        return out, of
    count = np.bincount(passage, minlength=n)
    length = (last - first).astype(float)
    size = np.bincount(passage, length, minlength=n)
    safe_n, safe = np.maximum(count, 1), np.maximum(size, 1)
    byte_passage = np.repeat(passage, last - first)
    kinds = np.bincount(byte_passage * 8 + kind[solid], minlength=8 * n).reshape(n, 8)
    out[:, 0] = np.log1p(count)
    out[:, 1] = size / safe_n
    out[:, 2:9] = kinds[:, 1:] / safe[:, None]
    out[:, 9] = kinds[:, 2] / np.maximum(1, kinds[:, 1] + kinds[:, 2])
    ending = kind[last - 1]
    for k, which in enumerate((4, 5, 6)):
        out[:, 10 + k] = np.bincount(passage, ending == which, minlength=n) / safe_n
    out[:, 13] = np.bincount(passage, kind[first] == 6, minlength=n) / safe_n
    starts = np.nonzero(np.diff(passage, prepend=-1))[0]
    out[passage[starts], 14] = np.log1p(np.maximum.reduceat(length, starts))
    out[:, 15] = np.bincount(passage, length <= 2, minlength=n) / safe_n
    # Repetition: a rolling hash of each word, its bytes in lower case.
    lower = np.where(kind == 2, data + 32, data).astype(np.uint64)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(lower * _UP[:len(data)], dtype=np.uint64)])
        word = (total[last] - total[first]) * _DOWN[first]
    order = np.lexsort((word, passage))
    fresh = np.concatenate([[True], (np.diff(passage[order]) != 0) | (word[order][1:] != word[order][:-1])])
    kept = passage[order][fresh]
    runs = np.diff(np.concatenate([np.nonzero(fresh)[0], [len(order)]]))
    out[:, 16] = np.bincount(kept, minlength=n) / safe_n
    most = np.zeros(n)
    np.maximum.at(most, kept, runs)
    out[:, 17] = most / safe_n
    # Pairs of words seen before in the passage: repeated lines.
    if len(word) > 1:
        with np.errstate(over="ignore"):
            pair = word[:-1] * _ODD + word[1:]
        inside = passage[:-1] == passage[1:]
        pair, at = pair[inside], passage[:-1][inside]
        order = np.lexsort((pair, at))
        if len(order):
            fresh = np.concatenate([[True], (np.diff(at[order]) != 0) | (pair[order][1:] != pair[order][:-1])])
            pairs = np.bincount(at, minlength=n)
            out[:, 18] = np.bincount(at[order][fresh], minlength=n) / np.maximum(pairs, 1) * (pairs > 0)
    out[:, 19] = count == 0
    return out, of


def _slabs(datas):
    """``(names of texts, texts)`` a slab at a time; longer texts are cut at white space."""
    names, held, size = [], [], 0
    for name, data in enumerate(datas):
        while len(data) > SLAB:
            cut = max(data.rfind(c, 0, SLAB) for c in (b" ", b"\n", b"\t"))
            cut = cut if cut > 0 else SLAB
            yield [name], [data[:cut]]
            data = data[cut:]
        if size + len(data) + 1 > SLAB and held:
            yield names, held
            names, held, size = [], [], 0
        names.append(name)
        held.append(data)
        size += len(data) + 1
    if held:
        yield names, held


@dataclass
class Model:
    """Weights of the encoder (w1, b1), of the gated attention (v, u, w) and of the score (c, c0)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict

    def codes(self, features):
        """Codes and attention logits of passages."""
        k = self.weights
        h = np.tanh((features - self.mean) / self.scale @ k["w1"] + k["b1"])
        gate = np.tanh(h @ k["v"]) / (1 + np.exp(-np.clip(h @ k["u"], -30, 30)))
        return h, gate @ k["w"]

    def scores(self, datas):
        """A score between 0 and 1 for each text."""
        hidden = len(self.weights["c"])
        top = np.full(len(datas), -np.inf)
        mass, total = np.zeros(len(datas)), np.zeros((len(datas), hidden))
        for names, texts in _slabs(datas):
            features, of = encode(texts)
            h, logit = self.codes(features)
            who = np.asarray(names)[of]
            starts = np.nonzero(np.diff(who, prepend=-1))[0]
            docs = who[starts]
            peak = np.maximum(np.maximum.reduceat(logit, starts), top[docs])
            fade = np.exp(top[docs] - peak)
            weight = np.exp(logit - np.repeat(peak, np.diff(np.append(starts, len(who)))))
            mass[docs] = mass[docs] * fade + np.add.reduceat(weight, starts)
            total[docs] = total[docs] * fade[:, None] + np.add.reduceat(weight[:, None] * h, starts, axis=0)
            top[docs] = peak
        z = total / mass[:, None]
        return 1 / (1 + np.exp(-np.clip(z @ self.weights["c"] + self.weights["c0"], -30, 30)))


def gradients(k, x, sizes, y, weight, decay):
    """The weighted cross-entropy of bags under the weights ``k``, and its gradients with their decay.

    ``x`` has the scaled features of all passages, bag after bag; ``sizes`` the passages of each bag.
    """
    start = np.cumsum(sizes) - sizes
    h = np.tanh(x @ k["w1"] + k["b1"])
    t, s = np.tanh(h @ k["v"]), 1 / (1 + np.exp(-np.clip(h @ k["u"], -30, 30)))
    e = (t * s) @ k["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, start), sizes))
    a = e / np.repeat(np.add.reduceat(e, start), sizes)
    z = np.add.reduceat(a[:, None] * h, start, axis=0)
    p = 1 / (1 + np.exp(-np.clip(z @ k["c"] + k["c0"], -30, 30)))
    loss = -(weight * np.log(np.where(y == 1, p, 1 - p))).sum() / len(y)
    d_out = (p - y) * weight / len(y)
    d_z = np.repeat(d_out[:, None] * k["c"], sizes, axis=0)
    d_a = (d_z * h).sum(axis=1)
    d_e = a * (d_a - np.repeat(np.add.reduceat(a * d_a, start), sizes))
    d_gate = d_e[:, None] * k["w"]
    d_t, d_s = d_gate * s * (1 - t * t), d_gate * t * s * (1 - s)
    d_h = a[:, None] * d_z + d_t @ k["v"].T + d_s @ k["u"].T
    d_pre = d_h * (1 - h * h)
    found = {
        "w1": x.T @ d_pre, "b1": d_pre.sum(axis=0), "v": h.T @ d_t, "u": h.T @ d_s,
        "w": (t * s).T @ d_e, "c": z.T @ d_out, "c0": np.array([d_out.sum()]),
    }
    return loss, {n: g + decay * k[n] for n, g in found.items()}


def train(bags, labels, hidden=16, attention=8, steps=600, batch=512, rate=0.01, decay=1e-4, seed=7):
    """Fits a model to bags of passage features by Adam; the gradients are written out."""
    rng = np.random.default_rng(seed)
    flat = np.concatenate(bags) if bags else np.zeros((1, FEATURES))
    mean, scale = flat.mean(axis=0), flat.std(axis=0) + 1e-3
    k = {
        "w1": rng.normal(0, 0.3, (FEATURES, hidden)), "b1": np.zeros(hidden),
        "v": rng.normal(0, 0.3, (hidden, attention)), "u": rng.normal(0, 0.3, (hidden, attention)),
        "w": rng.normal(0, 0.3, attention), "c": rng.normal(0, 0.3, hidden), "c0": np.zeros(1),
    }
    y = np.asarray(labels, float)
    if len(bags) and 0 < y.mean() < 1:
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        one, two = ({n: np.zeros_like(x) for n, x in k.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(bags), batch)
            sizes = np.array([len(bags[i]) for i in pick])
            x = (np.concatenate([bags[i] for i in pick]) - mean) / scale
            grads = gradients(k, x, sizes, y[pick], weight[pick], decay)[1]
            for n, g in grads.items():
                one[n] = 0.9 * one[n] + 0.1 * g
                two[n] = 0.999 * two[n] + 0.001 * g * g
                k[n] = k[n] - rate * (one[n] / (1 - 0.9**step)) / (np.sqrt(two[n] / (1 - 0.999**step)) + 1e-8)
    # Undo the weighting of the classes: a score is then the chance of label 1.
        k["c0"] = k["c0"] + np.log(y.mean() / (1 - y.mean()))
    elif len(bags):
        k["c"], k["c0"] = np.zeros(hidden), np.array([4.0 if y.mean() == 1 else -4.0])
    else:
        k["c"] = np.zeros(hidden)
    return Model(mean, scale, k)


def held_out(id_col):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def _data(text_col):
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")


def fit(df, labels, id_col="doc_id", text_col="text", label_col="quality", sample=6000, passages=200_000):
    """A model of ``label_col`` (0 or 1), from at most ``sample`` labelled rows that are not held out.

    The sample is the rows whose ids have the smallest hashes, as far as they have no more than ``passages``
    passages together; rows are used with all their passages or not at all, and those with more than a
    sixteenth of ``passages`` (800,000 words) are not. Rows with contradicting labels, null labels or null
    ids are not used. Without any label all scores are one half; with one kind of label only, all scores
    are the same.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter(
        F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).filter("y = other")
    # Only labels of rows that are there count.
    known = known.join(df.select(F.col(id_col).alias("doc_id")).distinct(), "doc_id", "left_semi")
    # Twice the sample at most: the rows under a threshold of the hash, which is then sorted.
    total = known.count()
    order = F.xxhash64("doc_id", F.lit("sample"))
    share = min(1.0, 1.5 * sample / max(1, total))
    near = known.filter(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    chosen = materialize(near.orderBy(order).limit(sample).select("doc_id", "y"), "quality-sample")
    texts = df.select(F.col(id_col).alias("doc_id"), _data(text_col).alias("data")).join(F.broadcast(chosen), "doc_id")
    longest = max(1, passages // 16)

    def features(batches):
        for pdf in batches:
            out = []
            for data in pdf["data"]:
                bag, n = [], 0
                for _, slab in _slabs([data]):
                    bag.append(encode(slab)[0])
                    n += len(bag[-1])
                    if n > longest:
                        break
                out.append((n, np.concatenate(bag).astype("<f4").tobytes() if n <= longest else b""))
            made = pd.DataFrame(out, columns=["n", "bag"])
            yield pd.concat([pdf[["doc_id", "y"]].astype({"doc_id": str}).reset_index(drop=True), made], axis=1)

    bags = materialize(texts.mapInPandas(features, "doc_id string, y int, n long, bag binary"), "quality-bags")
    # Of repeated rows one bag counts. These are at most ``sample`` ids and numbers.
    usable = bags.filter(F.col("n") <= longest).groupBy("doc_id").agg(F.max("n").alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id"))
    usable = usable.withColumn("upto", upto).filter(F.col("upto") <= passages).select("doc_id", "n")
    rows = bags.join(F.broadcast(usable), ["doc_id", "n"]).drop("n")

    # The sample is bounded: one task trains on it. (Not the driver, whose threads of linear algebra may
    # not survive the start of the JVM.)
    def run(batches):
        held = pd.concat([pd.DataFrame({"doc_id": [], "y": [], "bag": []}), *batches])
        held = held.sort_values(["doc_id", "bag"]).drop_duplicates("doc_id")
        bags = [np.frombuffer(b, "<f4").reshape(-1, FEATURES).astype(float) for b in held["bag"]]
        yield pd.DataFrame({"model": [pickle.dumps(train(bags, held["y"].to_numpy(float)))]})

    made = rows.repartition(1).mapInPandas(run, "model binary").first()
    return pickle.loads(made["model"]) if made else train([], [])


def scored(model, text_col="text"):
    """The score of a text as a column. The model, a few thousand numbers, goes along with the code."""

    @F.pandas_udf("double")
    def run(data: pd.Series) -> pd.Series:
        return pd.Series(model.scores(list(data)), dtype="float64")

    return run(_data(text_col))


def score(df, model, id_col="doc_id", text_col="text", threshold=0.7):
    """``(doc_id, held_out, score, predicted)`` per row of ``df``.

    Scores see nothing but the text. Null and empty texts are scored as documents of one passage
    without words. Rows are kept as often as they occur; a row with a null id is not held out. Other
    columns are not looked at; no rows give no rows.
    """
    rows = df.select(
        F.col(id_col).alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"),
        scored(model, text_col).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(df, model, id_col="doc_id", text_col="text", threshold=0.7):
    """The rows of ``df`` that the model does not reject."""
    return df.filter(scored(model, text_col) >= threshold)
