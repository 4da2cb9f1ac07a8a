"""Near-duplicates by SimHash fingerprints, found around the anchors of a covering code.

A fingerprint has 64 bits. Two of them that differ in at most ``distance`` bits differ in at most
``distance // blocks`` bits of one of ``blocks`` equal blocks. The anchors of a block are the words of a
Hamming code on its first 2**r - 1 bits, the rest being free: no block is farther than the covering
radius 1 from its nearest anchor, its home. So whatever is within the threshold of a fingerprint lies
within 1 + threshold of that fingerprint's home. Every fingerprint is replicated to all anchors within
that distance, and compared there with the fingerprints at home. The replication is a fixed number of
rows per fingerprint (about 171 per block of 32 bits), whatever the data are.
"""

import re
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from metadoc.llm.shared import components, materialize, small

BITS, SEED, RADIUS = 64, 42, 1
BLOCK_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _word_blocks(data):
    """The words of a text, a megabyte at a time."""
    at = 0
    while at < len(data):
        end = at + BLOCK_BYTES
        found = _SPACE.search(data, end) if end < len(data) else None
        end = found.start() if found else len(data)
        yield data[at:end].split()
        at = end


def fingerprint(data, words=4):
    """The fingerprint of one text, given in UTF-8, as a signed 64-bit integer."""
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    ones, total, held = np.zeros(BITS, np.int64), 0, []

    def count(shingles):
        hashes = np.fromiter(map(digest, shingles), np.uint64).astype(">u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        return ones + bits.sum(axis=0, dtype=np.int64), total + len(hashes)

    for block in _word_blocks(data.lower()):
        held += block
        if len(held) >= words:
            ones, total = count(map(b" ".join, zip(*(held[i:] for i in range(words)))))
            held = held[len(held) - words + 1:]
    if not total and held:
        ones, total = count([b" ".join(held)])
    return int(np.packbits(2 * ones > total).view(">i8")[0]) if total else 0


def _fingerprints(words):
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x, words) if x else 0 for x in texts], dtype="int64")

    return run


def fingerprints(df, id_col="doc_id", text_col="text", words=4):
    """``(doc_id, fp, name)`` per row of ``df``; null and blank texts have fingerprint zero.

    A-Z is lower-cased, words are runs without ASCII white space, shingles of ``words`` words count as
    often as they occur, and a text with fewer words is one shingle.
    """
    text = F.col(text_col).cast("string").cast("binary")
    return df.select(F.col(id_col).alias("doc_id"), _fingerprints(words)(text).alias("fp"), _name(text_col).alias("name"))


def _name(text_col):
    """What tells the texts of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _widths(blocks):
    return [BITS // blocks + (i < BITS % blocks) for i in range(blocks)]


def _coded(width):
    """How many bits of a block the Hamming code covers, and the length of its syndrome."""
    r = (width + 1).bit_length() - 1
    return 2**r - 1, r


def _patterns(width, reach):
    """All error patterns of at most ``reach`` bits in a block of ``width``, with their syndromes."""
    coded, _ = _coded(width)
    for weight in range(reach + 1):
        for bits in combinations(range(width), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= b + 1 if b < coded else 0
            yield width, syndrome, sum(1 << b for b in bits)


def _syndrome(block, width):
    coded, r = _coded(width)
    parts = [
        F.bit_count(block.bitwiseAND(F.lit(sum(1 << p for p in range(coded) if (p + 1) >> j & 1)))) % 2 * 2**j
        for j in range(r)
    ]
    return sum(parts[1:], parts[0]).cast("int")


def _in_blocks(fps, blocks):
    """One row per fingerprint and block: the block's bits and their syndrome."""
    rows, shift = [], 0
    for n, width in enumerate(_widths(blocks)):
        part = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        rows.append(F.struct(
            F.lit(n).cast("long").alias("n"), F.lit(width).alias("width"), part.alias("part"),
            _syndrome(part, width).alias("syndrome")))
        shift += width
    return fps.select("fp", F.explode(F.array(*rows)).alias("b")).select("fp", "b.*")


def links(fps, distance=4, blocks=2):
    """Pairs ``(a, b)``, a < b, of different fingerprints that differ in ``distance`` bits at most.

    ``fps`` has one row ``fp`` per fingerprint. Each pair is found once: at the home of ``a``, in the
    first block that differs in no more than ``distance // blocks`` bits.
    """
    spark, near = fps.sparkSession, distance // blocks
    patterns = spark.createDataFrame(
        pd.DataFrame([x for w in set(_widths(blocks)) for x in _patterns(w, RADIUS + near)],
                     columns=["width", "syndrome", "pattern"]).astype(
                         {"width": "int32", "syndrome": "int32", "pattern": "int64"}))
    rows = _in_blocks(fps, blocks)
    # The anchor and the number of its block in one long; at home, the pattern flips the bit that the
    # syndrome names.
    anchor = F.shiftleft("n", 58)
    home = F.when(F.col("syndrome") > 0, F.expr("shiftleft(1L, syndrome - 1)")).otherwise(F.lit(0).cast("long"))
    homes = rows.select(anchor.bitwiseOR(F.col("part").bitwiseXOR(home)).alias("anchor"), F.col("fp").alias("a"))
    guests = rows.join(F.broadcast(patterns), ["width", "syndrome"]).select(
        anchor.bitwiseOR(F.col("part").bitwiseXOR(F.col("pattern"))).alias("anchor"), F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    first, shift = F.lit(blocks), 0
    cuts = []
    for width in _widths(blocks):
        cuts.append(F.bit_count(F.shiftrightunsigned(differ, shift).bitwiseAND(F.lit((1 << width) - 1))))
        shift += width
    for n in reversed(range(blocks)):
        first = F.when(cuts[n] <= near, n).otherwise(first)
    # Homes are under a hundredth of the guests: a hash table of them spares sorting the guests.
    return homes.hint("shuffle_hash").join(guests, "anchor").filter(
        (F.col("a") < F.col("b")) & (F.bit_count(differ) <= distance)
        & (F.shiftrightunsigned("anchor", 58) == first)
    ).select("a", "b")


def near_duplicates(df, id_col="doc_id", text_col="text", words=4, distance=4, blocks=2):
    """``(doc_id, fp, name, fingerprint, component_id, root)`` for each row of ``df``.

    Fingerprints link when they differ in ``distance`` bits at most; ``component_id`` is the smallest id
    that can be reached over links, the row's own included, and ``root`` names the component; ``name`` is a
    hash of the text. Equal fingerprints form one class, which is
    compared once, so copies cost no pairs. Null and empty texts have fingerprint zero and link like any
    other. Rows are kept as often as they occur; a row without an id gets the component of its class
    (null if no row there has an id). Other columns are not looked at. No rows give no rows.
    """
    rows = materialize(fingerprints(df, id_col, text_col, words), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprint-classes")
    found = links(classes.select("fp"), distance, blocks)
    roots = components(found.select(F.col("a").alias("u"), F.col("b").alias("v")), "fingerprint-links")
    linked = classes.join(roots, classes.fp == roots.node)
    firsts = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_linked = linked.select("fp", "root").join(firsts, "root").select("fp", "root", F.col("component_id").alias("joint_id"))
    classes = classes.join(of_linked, "fp", "left").select(
        "fp", F.coalesce("joint_id", "first_id").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return rows.join(classes, "fp").select(
        "doc_id", "fp", "name", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root")


def kept(df, id_col="doc_id", text_col="text", **options):
    """The rows of ``df`` that stay when one document of each component does: the smallest id.

    An id may come with several texts. Each is a document of its own: in a component that holds several
    texts of its smallest id, the one with the smallest fingerprint and hash stays, and of rows equal in
    both, one. Rows without an id cannot be told apart and all stay.
    """
    found = materialize(near_duplicates(df, id_col, text_col, **options), "near-duplicates")
    first = found.filter("doc_id = component_id")
    own = F.struct("fp", "name")
    # Only components whose smallest id has several texts, and rows that are repeated, need a second look.
    several = materialize(first.groupBy(F.col("root").alias("of_root")).agg(
        F.min(own).alias("stays"), F.max(own).alias("last"), F.count("*").alias("n")).filter("n > 1"), "repeated-ids")
    others = first.join(small(several.filter("stays <> last").select("of_root", "stays")), F.col("root") == F.col("of_root")).filter(
        own != F.col("stays"))
    gone = found.filter("doc_id <> component_id").select("doc_id", "name").unionByName(others.select("doc_id", "name")).distinct()
    named = df.withColumn("_name", _name(text_col))
    as_gone = lambda rows: small(rows.select(F.col("doc_id").alias("_id"), F.col("name").alias("_text")))
    on = (F.col(id_col) == F.col("_id")) & (F.col("_name") == F.col("_text"))
    stay = named.join(as_gone(gone), on, "left_anti")
    # Texts are shuffled for repeated rows only.
    twice = first.join(small(several.select("of_root")), F.col("root") == F.col("of_root"), "left_semi").groupBy(
        "doc_id", "name").agg(F.count("*").alias("n")).filter("n > 1")
    twice = as_gone(materialize(twice.select("doc_id", "name"), "repeated-rows"))
    return stay.join(twice, on, "left_anti").unionByName(
        stay.join(twice, on, "left_semi").dropDuplicates([id_col, "_name"])).drop("_name")
