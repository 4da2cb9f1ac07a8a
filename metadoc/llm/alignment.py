"""Alignment of the tokens of two vocabularies by the byte offsets at which tokens of both end.

Cumulative ends go into a dictionary from end to index, one per side; the keys that both sides have, in
order, slice the two id lists into groups, and links are expanded per slice. Documents are handled in
chunks of a few megabytes of text. A chunk hands on each id pair once, with the number of its documents
that hold it, so that corpus-wide counts cost a row per chunk and pair; they come back to the chunk and
meet its documents there.
"""

import hashlib
import json
import os
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from metadoc.llm.shared import materialize

#: Bytes of text in a chunk, if no single text is longer.
CHUNK_BYTES = 2 << 20
#: Parts of texts a worker remembers before it starts anew; longer ones are never remembered.
MEMORY, LONGEST = 200_000, 48
#: Links of a group that are written out one by one; larger groups are counted by distinct ids.
WRITTEN_OUT = 4096
SPACE = "▁"
#: A remembered link holds its id pair in the lower bits and how often it comes, less one, in the upper ones.
PAIR_BITS, MOST_TIMES = 40, 1 << 22
_PAIR = (1 << PAIR_BITS) - 1
#: Texts of these characters, without runs of spaces, are split into words, numbers and marks.
_ODD = re.compile(r"[^\t\n -~\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-\xff]|  |\A ")
_LETTERS, _NUMBERS = "A-Za-zÀ-ÖØ-öø-ÿ", "0-9"
_PARTS = re.compile(
    rf"'(?:s|t|re|ve|m|ll|d)[{_LETTERS}]*| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+")
#: Other texts are split ahead of a space that follows another character.
_UNITS = re.compile(r"(?<=\S)(?= )")


def _byte_values():
    """The characters that a byte-level vocabulary writes for bytes: printable ones for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level vocabulary (``tokenizers`` file): ids of texts, and the bytes of its tokens."""

    def __init__(self, path):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            added = {t["content"] for t in json.load(file)["added_tokens"]}
        values, vocabulary = _byte_values(), self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.bytes[i] = entry.encode() if entry in added else bytes(values[c] for c in entry)

    def __call__(self, texts):
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A byte-pair piece vocabulary (``sentencepiece`` model): ids of texts as they are, and the bytes of its pieces."""

    def __init__(self, path):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            spec.ParseFromString(file.read())
        if spec.trainer_spec.model_type != 2 or not spec.normalizer_spec.add_dummy_prefix or spec.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("a byte-pair model that puts one space before a text and else leaves it as it is, is asked for")
        # Texts come with their space, so that parts from within a text can be encoded as well.
        spec.normalizer_spec.add_dummy_prefix = False
        self.model = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode()
            for i in range(self.model.get_piece_size()) for p in [self.model.id_to_piece(i)]]
        kinds = (spec.SentencePiece.NORMAL, spec.SentencePiece.USER_DEFINED, spec.SentencePiece.UNUSED)
        merged = [x.piece.replace(SPACE, " ") for x in spec.pieces if x.type in kinds]
        self.joints = {p[i:i + 2] for p in merged for i in range(len(p) - 1)}

    def __call__(self, texts):
        return self.model.encode(texts, num_threads=1)

    def splits(self):
        """How texts may be split so that no piece reaches over a cut: 2 into parts, 1 into units, 0 not at all."""
        if any(pair[1] == " " != pair[0] for pair in self.joints):
            return 0
        plain = [chr(c) for c in range(256) if not _ODD.search("." + chr(c))]
        kind = {c: 0 if re.match(rf"[{_LETTERS}]", c) else 1 if c in "0123456789" else 2 if c.isspace() else 3 for c in plain}
        # Within a run of white space a cut may lie anywhere.
        return 1 if any(
            x + y in self.joints for x in plain for y in plain
            if kind[x] != kind[y] and x != " " or kind[x] == kind[y] == 2 and x + y != "  ") else 2


@lru_cache(maxsize=2)
def byte_level(path):
    return ByteLevel(path)


@lru_cache(maxsize=2)
def piece_model(path):
    return Pieces(path)


def cuts(ends_a, ends_b):
    """How many tokens of either side lie before each end that both have: two lists, in order."""
    index_a = dict(zip(ends_a, range(1, len(ends_a) + 1)))
    index_b = dict(zip(ends_b, range(1, len(ends_b) + 1)))
    common = sorted(index_a.keys() & index_b.keys())
    return list(map(index_a.__getitem__, common)), list(map(index_b.__getitem__, common))


def links(a, b, cuts_a, cuts_b, owner, width):
    """``(owner, code, times)`` of the links, ``code`` being ``a * width + b``, in the order of their owners.

    ``cuts_*`` are the ends of the groups in the id arrays and ``owner`` numbers the documents of the groups.
    """
    starts_a, starts_b = np.r_[0, cuts_a[:-1]], np.r_[0, cuts_b[:-1]]
    n_a, n_b = cuts_a - starts_a, cuts_b - starts_b
    large = np.nonzero(n_a * n_b > WRITTEN_OUT)[0]
    per = n_b.copy()
    per[large] = 0
    each = np.repeat(per, n_a)  # per token of A, the tokens of B in its group
    first = np.cumsum(each) - each
    place = np.arange(int(each.sum())) - np.repeat(first - np.repeat(starts_b, n_a), each)
    codes = np.repeat(a.astype(np.int64), each) * width + b[place]
    owners, times = np.repeat(np.repeat(owner, n_a), each), np.ones(len(codes), np.int64)
    for g in large:
        ids_a, of_a = np.unique(a[starts_a[g]:cuts_a[g]], return_counts=True)
        ids_b, of_b = np.unique(b[starts_b[g]:cuts_b[g]], return_counts=True)
        pairs, often = (ids_a.astype(np.int64)[:, None] * width + ids_b).ravel(), np.outer(of_a, of_b).ravel()
        # A link that comes too often for the bits it has is written several times.
        parts = np.maximum(1, -(-often // MOST_TIMES))
        codes, owners = np.append(codes, np.repeat(pairs, parts)), np.append(owners, np.full(parts.sum(), owner[g]))
        more = np.full(parts.sum(), MOST_TIMES)
        more[np.cumsum(parts) - 1] = often - (parts - 1) * MOST_TIMES
        times = np.append(times, more)
    order = np.argsort(owners, kind="stable")
    return owners[order], codes[order], times[order]


class Aligner:
    """Token ids, groups and links of texts, by two vocabularies."""

    def __init__(self, path_a, path_b):
        self.a, self.b, self.known, self.without = byte_level(path_a), piece_model(path_b), {}, set()
        self.length_a, self.length_b = (np.array(list(map(len, v.bytes))) for v in (self.a, self.b))
        self.width, self.splits = len(self.b.bytes), self.b.splits()
        # What ids look like in a written group, ahead of a comma, or of the mark that ends their side.
        self.written = [
            b"%d%s" % (i, end) for n, ends in ((len(self.a.bytes), (b",", b"|")), (self.width, (b",", b";")))
            for end in ends for i in range(n)]

    def align(self, texts):
        """``(a, b, sizes_a, sizes_b, sizes)``: the ids and the group ends of all texts together, and each text's part of them.

        ``sizes`` has the numbers of A ids, B ids and groups per text. Texts that the tokens of either side do
        not give back byte by byte have none.
        """
        ids_a, ids_b = self.a(texts), self.b(texts)
        # Tokens may give back less than a text, never more, so whole batches can be compared.
        whole = "".join(texts).encode()
        for v, ids in ((self.a, ids_a), (self.b, ids_b)):
            if b"".join(map(v.bytes.__getitem__, chain.from_iterable(ids))) != whole:
                same = [b"".join(map(v.bytes.__getitem__, x)) == t.encode() for t, x in zip(texts, ids)]
                ids_a, ids_b = ([x if ok else [] for x, ok in zip(y, same)] for y in (ids_a, ids_b))
                whole = "".join(t for t, ok in zip(texts, same) if ok).encode()
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(texts)) for ids in (ids_a, ids_b))
        # Both sides of a text have its bytes, so texts may stand one after another: each ends in a common end.
        cuts_a, cuts_b = (np.array(x, np.int64) for x in cuts(
            np.cumsum(self.length_a[a]).tolist(), np.cumsum(self.length_b[b]).tolist()))
        n_groups = np.diff(np.searchsorted(cuts_a, np.cumsum(n_a), "right"), prepend=0)
        return a, b, cuts_a, cuts_b, np.stack([n_a, n_b, n_groups], axis=1)

    def _learn(self, parts):
        """``{part: (written groups, links, numbers)}``, None for one without tokens."""
        a, b, cuts_a, cuts_b, sizes = self.align(parts)
        if not len(a):
            return dict.fromkeys(parts)
        n, last_a, last_b = len(self.a.bytes), np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[cuts_a - 1] = last_b[cuts_b - 1] = 1
        # A group's tokens of A go behind the earlier groups of B, those of B behind the group's of A.
        marks, in_a, in_b = np.zeros(len(a) + len(b), np.int64), np.diff(cuts_a, prepend=0), np.diff(cuts_b, prepend=0)
        marks[np.arange(len(a)) + np.repeat(cuts_b - in_b, in_a)] = a + n * last_a
        marks[np.arange(len(b)) + np.repeat(cuts_a, in_b)] = 2 * n + b + self.width * last_b
        written = list(map(self.written.__getitem__, marks.tolist()))
        owner, codes, times = links(a, b, cuts_a, cuts_b, np.repeat(np.arange(len(parts)), sizes[:, 2]), self.width)
        packed = codes | (times - 1) << PAIR_BITS
        ends, numbers = np.cumsum(sizes[:, 0] + sizes[:, 1]).tolist(), sizes.astype(np.uint32)
        link_ends = np.searchsorted(owner, np.arange(len(parts)), "right").tolist()
        out, begin, link_begin = {}, 0, 0
        for i, (part, end, link_end) in enumerate(zip(parts, ends, link_ends)):
            out[part] = (b"".join(written[begin:end]), packed[link_begin:link_end].tobytes(), numbers[i].tobytes()) if end > begin else None
            begin, link_begin = end, link_end
        return out

    def _cut(self, text):
        if self.splits == 2 and not _ODD.search(text):
            return _PARTS.findall(" " + text)
        return _UNITS.split(" " + text) if self.splits else [" " + text]

    def texts(self, datas):
        """Of each text (UTF-8, or None): digest of its groups, numbers of ids and groups, links (see ``PAIR_BITS``)."""
        cut = []
        for data in datas:
            try:
                cut.append(self._cut(data.decode("utf-8")) if data else [])
            except UnicodeDecodeError:
                cut.append([])
        new = list(set().union(*cut).difference(self.known))
        if new:
            found = self._learn(new)
            self.without |= {x for x in new if not found[x]}
            if len(self.known) + len(new) > MEMORY:
                found, self.known = {x: self.known[x] for parts in cut for x in parts if x in self.known} | found, {}
            self.known |= found
        out = []
        for parts in cut:
            if not parts or not self.without.isdisjoint(parts):
                out.append(("", (0, 0, 0), b""))
                continue
            written, packed, numbers = zip(*map(self.known.__getitem__, parts))
            numbers = np.frombuffer(b"".join(numbers), np.uint32).reshape(-1, 3).sum(axis=0, dtype=np.int64).tolist()
            out.append((hashlib.sha256(b"".join(written)[:-1]).hexdigest(), numbers, b"".join(packed)))
        for part in [x for x in new if len(x) > LONGEST or x in self.without]:
            del self.known[part]
        self.without.clear()
        return out


@lru_cache(maxsize=1)
def aligner(path_a, path_b):
    return Aligner(path_a, path_b)


def _squeezed(values):
    kind = np.dtype(np.min_scalar_type(int(values.max()) if len(values) else 0))
    return kind.str.encode() + b":" + zlib.compress(values.astype(kind).tobytes(), 1)


def _unsqueezed(data):
    kind, _, packed = data.partition(b":")
    return np.frombuffer(zlib.decompress(packed), np.dtype(kind.decode())).astype(np.int64)


def _is_text(data):
    try:
        return data.decode("utf-8") is not None
    except UnicodeDecodeError:
        return False


def _rows(df, id_col, text_col):
    # Ids travel as text: among nulls, whole numbers would come back as floating point.
    return df.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("data"))


def alignments(df, path_a, path_b, id_col="doc_id", text_col="text"):
    """``(doc_id, a_ids, b_ids, a_cuts, b_cuts)`` per row of ``df``: token ids, and where groups end among them.

    Group ``i`` holds the ids from cut ``i - 1`` (0 at first) up to cut ``i``, on either side. For texts
    without tokens (see ``link_counts``) all four are empty.
    """

    def run(batches):
        align = aligner(path_a, path_b).align
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at:at + 64]
                texts = [" " + x.decode("utf-8", "replace") if x and _is_text(x) else "" for x in part["data"]]
                a, b, cuts_a, cuts_b, sizes = align(texts)
                ends = np.cumsum(sizes, axis=0)
                pieces = [np.split(x, ends[:-1, k]) for x, k in ((a, 0), (b, 1), (cuts_a, 2), (cuts_b, 2))]
                begin = ends - sizes
                pieces[2] = [x - y for x, y in zip(pieces[2], begin[:, 0])]
                pieces[3] = [x - y for x, y in zip(pieces[3], begin[:, 1])]
                yield pd.DataFrame({"doc_id": part["doc_id"]} | dict(zip(("a_ids", "b_ids", "a_cuts", "b_cuts"), pieces)))

    kind = dict(df.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]
    found = _rows(df, id_col, text_col).mapInPandas(
        run, "doc_id string, a_ids array<long>, b_ids array<long>, a_cuts array<long>, b_cuts array<long>")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def _chunks(rows, path_a, path_b):
    """One row per chunk: its documents' own columns, its id pairs, and which document links which pair how often."""

    def chunk(number, ids, datas):
        digests, numbers, packed = zip(*aligner(path_a, path_b).texts(datas))
        n_a, n_b, n_groups = zip(*numbers)
        owner = np.repeat(np.arange(len(ids)), [len(x) // 8 for x in packed])
        links_ = np.frombuffer(b"".join(packed), np.int64)
        times, key = (links_ >> PAIR_BITS) + 1, links_ & _PAIR | owner << PAIR_BITS
        order = np.argsort(key)
        key, times = key[order], times[order]
        at = np.nonzero(np.diff(key, prepend=-1))[0]
        owner, codes = key[at] >> PAIR_BITS, key[at] & _PAIR
        times = np.add.reduceat(times, at) if len(at) else times
        pairs, place, holders = np.unique(codes, return_inverse=True, return_counts=True)
        held = np.bincount(owner, minlength=len(ids))
        # Places rise within a document, so steps are written instead; they begin anew with each document.
        steps, begin = np.diff(place, prepend=0), (np.cumsum(held) - held)[held > 0]
        steps[begin] = place[begin]
        n_links = np.zeros(len(ids), np.int64)
        np.add.at(n_links, owner, times)
        return pd.DataFrame({
            "chunk": [number], "ids": [ids], "n_a": [n_a], "n_b": [n_b], "n_groups": [n_groups], "n_links": [n_links],
            "digests": [digests], "pairs": [pairs], "holders": [holders],
            "held": [_squeezed(held)], "steps": [_squeezed(steps)], "times": [_squeezed(times)]})

    def run(batches):
        first = TaskContext.get().partitionId() << 32
        number, ids, datas, size = 0, [], [], 0
        for pdf in batches:
            for name, data in zip(pdf["doc_id"], pdf["data"]):
                if ids and size + len(data or b"") > CHUNK_BYTES:
                    yield chunk(first + number, ids, datas)
                    number, ids, datas, size = number + 1, [], [], 0
                ids.append(name)
                datas.append(data)
                size += len(data or b"") + 64
        if ids:
            yield chunk(first + number, ids, datas)

    return rows.mapInPandas(run, (
        "chunk long, ids array<string>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>,"
        " digests array<string>, pairs array<long>, holders array<long>, held binary, steps binary, times binary"))


def link_counts(df, path_a, path_b, id_col="doc_id", text_col="text"):
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` per row of ``df``.

    ``path_a`` names a byte-level vocabulary for ``tokenizers``, which gets a space and the text, ``path_b`` a
    ``sentencepiece`` model that puts a space before a text itself, at the same place on all executors. All
    token occurrences of a group link with all of the other side. The count of an id pair is the number of
    rows that link it; ``count_sum`` adds it up over the links, and ``n_best`` counts links whose pair has the
    highest count of its A id.

    Texts that are null, empty or no UTF-8, and texts that either side's tokens do not give back byte by
    byte, have no tokens: numbers are 0 and the digest is empty. Special strings in a text are text. Each
    row is a document of its own, repeated and null ids included; other columns are not looked at, and no
    rows give no rows. A task holds a chunk of ``CHUNK_BYTES`` of text, or one longer text.
    """
    kind = dict(df.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]
    chunks = materialize(_chunks(_rows(df, id_col, text_col), path_a, path_b), "chunks")
    used = chunks.select("chunk", F.explode(F.arrays_zip("pairs", "holders")).alias("p")).select(
        "chunk", F.col("p.pairs").alias("pair"), F.col("p.holders").alias("n"))
    # A pair comes once per chunk at most.
    counted = materialize(used.withColumn("count", F.sum("n").over(Window.partitionBy("pair"))).drop("n"), "pair-counts")
    width = F.lit(piece_model(path_b).model.get_piece_size())
    # One row per id of the vocabulary at most.
    best = counted.groupBy(F.floor(F.col("pair") / width).alias("a")).agg(F.max("count").alias("most"))
    counted = counted.withColumn("a", F.floor(F.col("pair") / width)).join(F.broadcast(best), "a").select(
        "chunk", "pair", "count", (F.col("count") == F.col("most")).alias("best"))

    def meet(own, counts):
        if not len(own):
            return pd.DataFrame()
        row, counts = own.iloc[0], counts.sort_values("pair")
        held, steps, times = (_unsqueezed(row[k]) for k in ("held", "steps", "times"))
        ends = np.cumsum(held)
        total = np.cumsum(steps)
        # Steps begin anew with each document.
        begin = (ends - held)[held > 0]
        place = total - np.repeat(total[begin] - steps[begin], held[held > 0]) if len(steps) else total

        def per_document(values):
            sums = np.r_[0, np.cumsum(values[place] * times)] if len(place) else np.zeros(1, np.int64)
            return sums[ends] - sums[ends - held]

        return pd.DataFrame({
            "doc_id": row["ids"], "n_a": row["n_a"], "n_b": row["n_b"], "n_groups": row["n_groups"],
            "n_links": row["n_links"], "n_best": per_document(counts["best"].to_numpy(np.int64)),
            "count_sum": per_document(counts["count"].to_numpy(np.int64)), "groups_sha256": row["digests"]})

    found = chunks.drop("pairs", "holders").groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInPandas(meet, (
        "doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"))
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))
