"""Packing documents into sequences: the cutting-stock problem, solved by column generation.

A document is cut into whole sequences and one remainder. Lengths, rounded up to ``unit`` tokens, make a
histogram of a few hundred classes. A linear program chooses how often to use each pattern (a multiset
of classes that fits into a sequence); patterns are priced by a knapsack over the classes until none
improves the program. The histogram is all that one task ever sees. Rounded down, the patterns take most
pieces; what is left goes to the fullest sequence that still has room. Pieces are then ranked within
their class and dealt out to the places that the patterns have for it.
"""

import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from metadoc.llm.shared import materialize

#: Parts of texts a worker remembers before it starts anew.
MEMORY = 400_000
#: Bytes of text whose pieces a worker hands on together.
BATCH_BYTES = 1 << 20
#: Texts of Latin-1 characters, without control characters and special tokens, can be split here.
_ODD = re.compile(r"[^\t-\r -~\xa1-\xff]|<\|")
_LETTERS, _NUMBERS = "a-zª\xb5ºß-öø-ÿ", "0-9²³¹¼-¾"
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")


class WordIds:
    """Token ids of texts, part by part; parts not seen before go to the tokenizer, many at a time.

    A text's ids are those of the parts that the vocabulary's pre-tokenizer makes of it. For plain texts
    these are split off here, after lower-casing, as the tokenizer does: contractions, letters, single
    numbers, and the rest. Others are split at spaces, which never lie inside a part.
    """

    def __init__(self, path):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}

    def _learn(self, parts):
        if len(self.known) > MEMORY:
            self.known = {}
        new = list(set(parts).difference(self.known))
        found = self.tokenizer.encode_batch(new, add_special_tokens=False)
        self.known.update((p, array("I", e.ids).tobytes()) for p, e in zip(new, found))

    def __call__(self, text):
        parts = text.replace("\n", " ").split(" ") if _ODD.search(text) else _PARTS.findall(text.lower())
        try:
            return b"".join(map(self.known.__getitem__, parts))
        except KeyError:
            self._learn(parts)
            return b"".join(map(self.known.__getitem__, parts))


@lru_cache(maxsize=2)
def word_ids(path):
    return WordIds(path)


def pieces(df, tokenizer_path, id_col="doc_id", text_col="text", size=2048, end_id=1, with_ids=True):
    """``(piece, doc_id, start, length, ids_crc32, doc_tokens, ids)``: whole sequences, and one remainder a document.

    ``end_id`` closes every document, so a null or empty text is that one token. The checksum is that of
    the ids as little-endian unsigned 32-bit integers.
    """
    end = np.asarray([end_id], "<u4").tobytes()
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]

    def cut(batches):
        encode = word_ids(tokenizer_path)
        out, held = [], 0
        for pdf in batches:
            for name, data in zip(pdf["doc_id"], pdf["data"]):
                ids = encode(data.decode("utf-8", "replace")) + end
                n = len(ids) // 4
                for at in range(0, n, size):
                    own = ids[4 * at:4 * (at + size)]
                    out.append((name, at, len(own) // 4, zlib.crc32(own), n, *[np.frombuffer(own, "<i4")] * with_ids))
                held += len(data) + 64
                if held >= BATCH_BYTES:
                    yield pd.DataFrame(out, columns=columns)
                    out, held = [], 0
        yield pd.DataFrame(out, columns=columns)

    kind = dict(df.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    # Ids travel as text: among nulls, whole numbers would come back as floating point.
    rows = df.select(F.col(id_col).cast("string").alias("doc_id"), data.alias("data")).mapInPandas(
        cut, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)
    return rows.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumn("piece", F.monotonically_increasing_id())


def _best_pattern(prices, sizes, capacity):
    """The pattern of highest price that fits, by dynamic programming over the capacity."""
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = int(np.searchsorted(sizes, room, "right"))
        value[room] = value[room - 1]
        if fits:
            worth = prices[:fits] + value[room - sizes[:fits]]
            k = int(worth.argmax())
            if worth[k] > value[room] + 1e-12:
                value[room], last[room] = worth[k], k
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            pattern[last[room]] += 1
            room -= int(sizes[last[room]])
    return float(value[capacity]), pattern


def _first_basis(sizes, need, capacity):
    """One pattern per class: the largest pieces first, each pattern used until a class runs out.

    A class does not come up again after the pattern that it ran out with, so the patterns are
    independent of each other and make a first solution of the linear program.
    """
    left, patterns, owners = need.copy(), [], []
    while (open_ := np.nonzero(left > 0)[0]).size:
        pattern, room = np.zeros(len(sizes)), capacity
        for k in open_[::-1]:
            pattern[k] = room // sizes[k]
            room -= int(pattern[k]) * int(sizes[k])
        used = np.nonzero(pattern)[0]
        times = (left[used] / pattern[used]).min()
        left[used] -= times * pattern[used]
        gone = [int(k) for k in used if left[k] <= 1e-9]
        left[gone] = 0
        for n, k in enumerate(gone):
            if n:  # another class ran out with the same pattern
                pattern = np.zeros(len(sizes))
                pattern[k] = capacity // sizes[k]
            patterns.append(pattern)
            owners.append(k)
    basis = np.zeros((len(sizes), len(sizes)))
    for k, pattern in zip(owners, patterns):
        basis[:, k] = pattern
    return basis


def solve(histogram, capacity, close=1e-4, most_rounds=5000):
    """Patterns ``[(count, {class: pieces})]`` that hold every piece of ``histogram`` ``{class: pieces}``.

    The linear program is solved by the revised simplex method: the basis holds one pattern per class,
    its prices go to the knapsack, and the pattern found there enters until none is worth more than
    1 + ``close`` sequences, which bounds the distance from the optimum by that factor. ``most_rounds``
    ends an endless exchange of equal solutions; any basis is a solution.
    """
    sizes = np.array(sorted(c for c, n in histogram.items() if n), dtype=int)
    if not len(sizes):
        return []
    need = np.array([histogram[c] for c in sizes], float)
    basis = _first_basis(sizes, need, capacity)
    inverse = np.linalg.inv(basis)
    amount = np.maximum(inverse @ need, 0)
    for _ in range(most_rounds):
        worth, column = _best_pattern(inverse.sum(axis=0), sizes, capacity)
        if worth <= 1 + close:
            break
        change = inverse @ column
        rising = change > 1e-9
        if not rising.any():
            break
        ratio = np.full(len(sizes), np.inf)
        ratio[rising] = amount[rising] / change[rising]
        out = int(ratio.argmin())
        basis[:, out] = column
        row = inverse[out] / change[out]
        inverse -= np.outer(change, row)
        inverse[out] = row
        amount = np.maximum(inverse @ need, 0)
    left = need.astype(int)
    plan = []
    for k, x in enumerate(amount):
        pattern = basis[:, k].astype(int)
        # Rounding errors must not ask for pieces that are not there.
        times = min([int(x + 1e-6), *(left[i] // n for i, n in enumerate(pattern) if n)])
        if times > 0:
            left = left - times * pattern
            plan.append((int(times), {int(c): int(n) for c, n in zip(sizes, pattern) if n}))
    return plan + _fill(dict(zip(sizes.tolist(), left.tolist())), capacity)


def _fill(left, capacity):
    """Best fit, the largest first, for the few pieces per class that rounding down has left over."""
    room, bins = {}, []
    for size in sorted(left, reverse=True):
        for _ in range(left[size]):
            at = min((free for free in room if free >= size and room[free]), default=None)
            if at is None:
                bins.append({})
                k, free = len(bins) - 1, capacity
            else:
                k, free = room[at].pop(), at
            bins[k][size] = bins[k].get(size, 0) + 1
            room.setdefault(free - size, []).append(k)
    return [(1, b) for b in bins]


def _runs(plan):
    """Which places the ranks of a class go to: ``(class, low, high, per, first, base)``."""
    rows, used, first = [], {}, 0
    for times, pattern in plan:
        base = 0
        for size in sorted(pattern, reverse=True):
            per, low = pattern[size], used.get(size, 0)
            used[size] = low + per * times
            rows.append((size, low, low + per * times, per, first, base))
            base += per
        first += times
    return rows


def place(cut, size=2048, unit=8, per_rank=50_000):
    """``cut`` (see ``pieces``, written to a table) with ``sequence_id`` and ``offset``, without ``ids``."""
    spark = cut.sparkSession
    rows = cut.drop("ids").withColumn("class", F.ceil(F.col("length") / unit).cast("int"))
    histogram = materialize(rows.groupBy("class").agg(F.count("*").alias("n")), "histogram")

    # A few hundred rows, whatever the input: one task solves the program for them.
    def plan(batches):
        found = pd.concat([pd.DataFrame({"class": [], "n": []}), *batches])
        counts = {int(c): int(n) for c, n in zip(found["class"], found["n"])}
        yield pd.DataFrame(
            _runs(solve(counts, size // unit)), columns=["class", "low", "high", "per", "first", "base"])

    runs = materialize(histogram.repartition(1).mapInPandas(
        plan, "class long, low long, high long, per long, first long, base long"), "patterns")
    # A class may hold most pieces: they are ranked in parts, which are then put one after another.
    largest = histogram.agg(F.max("n")).first()[0] or 0
    parts = max(1, -(-largest // per_rank))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("piece"), F.lit(parts)).cast("int"))
    counts = rows.groupBy("class", "part").agg(F.count("*").alias("n"))
    ahead = counts.select("class", "part", (F.sum("n").over(
        Window.partitionBy("class").orderBy("part")) - F.col("n")).alias("ahead"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("class", "part").orderBy("piece")) - 1).join(
        ahead, ["class", "part"]).withColumn("rank", F.col("rank") + F.col("ahead"))
    placed = ranked.join(F.broadcast(runs), "class").filter("rank >= low and rank < high").select(
        *cut.drop("ids").columns, F.expr("first + (rank - low) div per").alias("sequence_id"),
        F.expr("base + (rank - low) % per").alias("slot"))
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("slot")


def pack(df, tokenizer_path, id_col="doc_id", text_col="text", size=2048, end_id=1, unit=8, with_ids=True):
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, and ``ids``.

    Each token of each row of ``df``, its closing ``end_id`` included, lies in exactly one piece, and a
    sequence holds ``size`` tokens at most, without gaps. Null and empty texts are their closing token.
    Repeated rows are packed as often as they occur; null ids stay null. Other columns are not looked
    at; no rows give no rows. ``with_ids=False`` leaves the ids out and so spares a shuffle of them.
    """
    cut = materialize(pieces(df, tokenizer_path, id_col, text_col, size, end_id, with_ids), "pieces")
    placed = place(cut, size, unit)
    if with_ids:
        placed = placed.join(cut.select("piece", "ids"), "piece")
    return placed.drop("piece")
