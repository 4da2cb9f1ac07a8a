"""Token counts by byte-pair merging with a heap and a linked list; no token ids are made.

A text starts as a list of symbols, one per character. The adjacent pair of lowest rank is merged, again
and again; the count is the number of initial symbols minus the number of merges. Characters for which
the vocabulary has no piece count once per UTF-8 byte. Merging never crosses a place where no piece of
the vocabulary has the two characters side by side, so a text falls into short units, which are counted
once per worker and then looked up.
"""

import heapq
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F

SPACE = "▁"
#: Units and words a worker remembers before it starts anew; longer ones are never remembered.
MEMORY, LONGEST = 400_000, 48


def merged(symbols, rank):
    """The symbols that remain when pairs are merged by rank, the leftmost first among equals."""
    symbols = list(symbols)
    n = len(symbols)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(rank[pair], i, pair) for i in range(n - 1) if (pair := symbols[i] + symbols[i + 1]) in rank]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if symbols[i] is None or j < 0 or symbols[i] + symbols[j] != pair:
            continue  # one of the two has been merged meanwhile
        symbols[i], symbols[j] = pair, None
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right >= 0 and (new := symbols[left] + symbols[right]) in rank:
                heapq.heappush(heap, (rank[new], left, new))
    return [s for s in symbols if s is not None]


class Counter(dict):
    """Counts of words, kept as they come up."""

    def __init__(self, model_path):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as file:
            model.ParseFromString(file.read())
        spec, kinds = model.normalizer_spec, model.SentencePiece
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("a byte-pair model that leaves its text as it is, is asked for")
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        self.fallback = model.trainer_spec.byte_fallback
        pieces = [(p.piece, p.score) for p in model.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED, kinds.UNUSED)]
        # Equal scores get equal ranks: the leftmost pair goes first.
        ranks = {score: i for i, score in enumerate(sorted({s for _, s in pieces}, reverse=True))}
        self.rank = {piece: ranks[score] for piece, score in pieces}
        self.joints = {piece[i:i + 2] for piece, _ in pieces for i in range(len(piece) - 1)}
        self.units = {}

    def unit(self, text):
        found = self.units.get(text)
        if found is None:
            left = merged(text, self.rank)
            found = len(left)
            if self.fallback:
                found += sum(len(s.encode()) - 1 for s in left if s not in self.rank)
            if len(text) <= LONGEST:
                if len(self.units) >= MEMORY:
                    self.units.clear()
                self.units[text] = found
        return found

    def pieces(self, text):
        """The count of ``text`` as it is."""
        total, start = 0, 0
        for i in range(1, len(text)):
            if text[i - 1:i + 1] not in self.joints:
                total += self.unit(text[start:i])
                start = i
        return total + self.unit(text[start:]) if text else 0

    def __missing__(self, word):
        found = self.pieces(SPACE + word)
        if len(word) <= LONGEST:
            if len(self) >= MEMORY:
                self.clear()
            self[word] = found
        return found

    def count(self, text):
        """The number of tokens of a text."""
        if not text:
            return 0
        words = text.replace(SPACE, " ").split(" ")
        if self.prefix and "" not in words and SPACE + SPACE not in self.joints:
            return sum(map(self.__getitem__, words))
        if not self.prefix:
            return self.pieces(text.replace(" ", SPACE))
        # Runs of spaces may merge: they belong to the word that follows.
        total, held = 0, 0
        for word in words:
            if word:
                total += self[word] if not held else self.pieces(SPACE * (held + 1) + word)
                held = 0
            else:
                held += 1
        return total + (self.pieces(SPACE * held) if held else 0)


@lru_cache(maxsize=2)
def counter(model_path):
    return Counter(model_path)


def token_counts(df, model_path, id_col="doc_id", text_col="text", limit=4096):
    """``(doc_id, n_bytes, n_tokens, over_limit)`` per row of ``df``.

    ``model_path`` names a byte-pair model with byte fallback at the same place on all executors. Begin
    and end tokens are not counted, special strings in a text are text, and nothing is cut. Null texts
    count as empty: no tokens. Bytes that are not UTF-8 count as replacement characters. Rows are kept
    as often as they occur, null ids included; other columns are not looked at.
    """

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        tokens = counter(model_path)
        return pd.Series([tokens.count(x.decode("utf-8", "replace")) for x in texts], dtype="int64")

    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).alias("doc_id"), F.octet_length(data).cast("long").alias("n_bytes"), count(data).alias("n_tokens"))
    return rows.select("*", (F.col("n_tokens") > limit).alias("over_limit"))
