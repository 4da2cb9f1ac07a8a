"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A spaced seed is a fixed mask over neighbouring tokens that looks at some positions and ignores the
others. The masks below are chosen so that, whichever tokens an item may lose, one mask fits somewhere
between the substitutions (``tests/llm`` tries all cases). Test and training positions are hashed under
every mask and joined on the hash; each hit names an alignment of an item with a document, which is then
compared token by token.
"""

from pyspark.sql import functions as F

from metadoc.llm.shared import materialize, small

#: Aligned tokens that are compared, and how many of them have to be equal.
WINDOW, NEEDED = 13, 11
MASKS = ((0, 1, 2, 3, 5, 7), (0, 2, 3, 6, 7, 8))
#: Items of fewer tokens than a window may lose one token if they have this many, and none below.
TOLERANT = 8
SHORT_MASKS = ((0, 1, 3, 4, 6), (0, 2, 3, 5, 6))
#: Items of fewer tokens than this have to make up a whole line.
LEAST_TOKENS = 5
EXACT_MASKS = (tuple(range(LEAST_TOKENS)),)
#: Scripts written without spaces; each of their characters is a token.
SPACELESS = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")
#: All of them lie beyond U+0E00; looking at that first spares other characters the search for their script.
_SPACELESS = "([\\x{0E00}-\\x{10FFFF}&&[" + "".join(f"\\p{{Is{name}}}" for name in SPACELESS) + "]])"


def tokens(text):
    """Lower-cased runs of letters and digits; single characters in scripts that put no spaces."""
    plain = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    return F.filter(F.split(F.regexp_replace(plain, _SPACELESS, " $1 "), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def needed(n):
    """How many tokens of an item of ``n`` have to be equal, in a window or in all of it."""
    return F.when(n >= WINDOW, NEEDED).when(n >= TOLERANT, n - 1).otherwise(n)


def _keys(hashes, at, masks):
    """One key per mask at position ``at`` of an array of token hashes; null beyond its end."""
    keys = []
    for mask in masks:
        parts = [F.get(hashes, at + o) for o in mask]
        keys.append(F.when(at + mask[-1] < F.size(hashes), F.xxhash64(F.lit(str(mask)), *parts)))
    return F.array(*keys)


def _seeds(df, names, masks):
    """``(names, at, key)`` for each position and mask."""
    hashed = df.select(*names, F.transform("tokens", lambda x: F.xxhash64(x)).alias("h"))
    shortest = min(mask[-1] for mask in masks)
    placed = hashed.filter(F.size("h") > shortest).select(
        *names, "h", F.explode(F.sequence(F.lit(0), F.size("h") - 1 - shortest)).alias("at"))
    return placed.select(*names, "at", F.explode(_keys(F.col("h"), F.col("at"), masks)).alias("key")).filter("key is not null")


def _items(benchmark, item_id, text_col):
    """Items with an inner name of their own, as ids may be null or repeated."""
    rows = benchmark.select(F.col(item_id).alias("item_id"), tokens(F.col(text_col)).alias("tokens"))
    return rows.distinct().filter(F.size("tokens") > 0).withColumn("item", F.xxhash64("item_id", "tokens"))


def _as_lines(docs, items, id_col, text_col):
    """``(doc_id, item_id, n, matched)`` of the shortest items: those that are a line of a document."""
    line = F.explode(F.split(F.col(text_col).cast("string"), r"[\r\n]+")).alias("line")
    lines = docs.select(F.col(id_col).alias("doc_id"), line).select("doc_id", tokens(F.col("line")).alias("tokens"))
    lines = lines.filter(F.size("tokens").between(1, LEAST_TOKENS - 1))
    n = F.size("tokens")
    return lines.join(small(items, F.size("tokens")), "tokens").select("doc_id", "item_id", n.alias("n"), n.alias("matched"))


def overlaps(docs, benchmark, id_col="doc_id", text_col="text", item_id="item_id", item_text="text"):
    """``(doc_id, item_id, matched, item_tokens)``: the documents that contain passages of the benchmark.

    A document overlaps an item if in some alignment of the two at least ``NEEDED`` of ``WINDOW``
    successive tokens are equal. Of items of ``TOLERANT`` to ``WINDOW`` - 1 tokens all but one have to be
    equal, of those of ``LEAST_TOKENS`` to ``TOLERANT`` - 1 all; shorter ones have to be a whole line of the
    document. ``matched`` is the largest number of equal tokens in a window. One row per pair of ids,
    however often the passage or the rows repeat. Null and empty texts, and texts without letters and
    digits, overlap nothing; null ids are ids like any other. Other columns are not looked at.
    """
    items = materialize(_items(benchmark, item_id, item_text), "items")
    size = F.size("tokens")
    kinds = (
        (MASKS, size >= WINDOW), (SHORT_MASKS, size.between(TOLERANT, WINDOW - 1)),
        (EXACT_MASKS, size.between(LEAST_TOKENS, TOLERANT - 1)))
    # Masks that no item needs are left out, so that documents are not hashed under them.
    present = items.agg(F.max(size < LEAST_TOKENS).alias("lines"), *[F.max(of).alias(f"k{i}") for i, (_, of) in enumerate(kinds)]).first()
    kinds = [kind for i, kind in enumerate(kinds) if present[f"k{i}"]] or [kinds[0]]
    seeds = None
    for masks, of in kinds:
        made = _seeds(items.filter(of), ["item"], masks)
        seeds = made if seeds is None else seeds.unionByName(made)
    seeds = materialize(seeds.select("key", "item", F.col("at").alias("item_at")), "item-seeds")
    texts = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("tokens"))
    # Hits are few: seeds that no item has end here, before any shuffle (or in the shuffle, if the
    # benchmark is too large to broadcast).
    hits = _seeds(texts, ["doc_id"], [mask for masks, _ in kinds for mask in masks]).join(small(seeds), "key").select(
        "doc_id", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    hits = materialize(hits, "hits").withColumnRenamed("doc_id", "hit_id")
    raw = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = raw.join(small(hits), F.col("doc_id").eqNullSafe(F.col("hit_id"))).select(
        "doc_id", "item", "shift", tokens(F.col("text")).alias("doc_tokens"))
    found = found.join(small(items, size), "item")
    n = F.size("tokens")
    equal = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(
        (F.get("doc_tokens", F.col("shift") + i) == F.get("tokens", i)).cast("int"), F.lit(0)))
    found = found.select("doc_id", "item_id", n.alias("n"), F.least(n, F.lit(WINDOW)).alias("w"), equal.alias("equal"))
    best = F.array_max(F.transform(F.expr("sequence(0, n - w)"), lambda s: F.aggregate(
        F.slice("equal", s + 1, F.col("w")), F.lit(0), lambda a, b: a + b)))
    found = found.select("doc_id", "item_id", "n", best.alias("matched")).filter(F.col("matched") >= needed(F.col("n")))
    if present["lines"]:
        found = found.unionByName(_as_lines(docs, items.filter(size < LEAST_TOKENS), id_col, text_col))
    return found.groupBy("doc_id", "item_id").agg(
        F.max("matched").cast("long").alias("matched"), F.max("n").cast("long").alias("item_tokens"))


def clean(docs, benchmark, id_col="doc_id", text_col="text"):
    """The rows of ``docs`` that overlap no item of the benchmark. Rows without an id stay."""
    named = overlaps(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(small(materialize(named, "overlapping")), id_col, "left_anti")
