"""Which sources go into the context of which object.

An object's score for a source is the source's static score plus a boost when the object's schema
or table name occurs in the source's head. Scoring every object against every source would be
quadratic; this module never does that:

1. names are looked up by equality of hashes: a head has prefix sums, from which the hash of any of its
   stretches follows, so each place gives one number per name length, and no text is copied; where a
   number is that of a name, the stretch itself is compared;
2. per name (and per schema-table pair found in the same head) only the sources that can still fit
   into the budget are kept, in static order; the same for all sources without any name;
3. an object's candidates are the union of those few lists, ranked and packed.

Dropping the rest is exact. Within one list, a source gets the same boost as, or a smaller one
than, the sources ahead of it, so whatever lies past the point where the list alone overflows the
budget also lies past the point where the object's full ranking overflows.
"""

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metadoc import fixed_values as fv
from metadoc.functions.relevance import haystack, source_header, static_score
from metadoc.functions.text import blank_to_null, or_empty
from metadoc.runtime import BROADCAST_ROWS, materialize, spread

SALTS = 32
#: Multiplier of the rolling hashes, odd and so invertible modulo 2**64, and heads hashed together, in characters.
HASH_BASE, HASH_CHARS = 0x9E3779B97F4A7C15, 1 << 18

_ENTRY = ("ord", "static", "header_len", "size")
_PAIR = ["schema_key", "table_key"]

# No header is shorter than the one with the shorter label and no name or description.
SHORTEST_HEADER = min(
    len(fv.SOURCE_HEADER.format(label=label, name="", description=""))
    for label in fv.SOURCE_LABELS.values()
)


def most_entries(max_chars):
    """At most this many entries matter: all that fit, and the first that does not."""
    return max_chars // SHORTEST_HEADER + 1


def source_index(sources, keywords=fv.GENERATOR_KEYWORDS):
    """The narrow form of the sources: sizes, static score and searchable head, no content."""
    name, kind = F.col("name"), F.col("kind")
    description, content = or_empty(F.col("description")), or_empty(F.col("content"))
    header = F.length(source_header(name, description, kind))
    return sources.select(
        "ord",
        static_score(name, description, kind, keywords).alias("static"),
        header.alias("header_len"),
        (header + F.length(content)).alias("size"),
        haystack(name, description, content).alias("haystack"),
    )


def context_keys(objects):
    """Objects with equal lower-case schema and table names have the same context."""
    return objects.select(
        F.lower("schema_name").alias("schema_key"),
        F.lower(F.coalesce("table_name", F.lit(""))).alias("table_key"),
    ).distinct()


def object_names(keys):
    """Distinct names to look for, flagged by the role they play."""
    roles = F.explode(F.array(
        F.struct(F.col("schema_key").alias("name"), F.lit(True).alias("is_schema"),
                 F.lit(False).alias("is_table")),
        F.struct(F.col("table_key").alias("name"), F.lit(False).alias("is_schema"),
                 F.lit(True).alias("is_table")),
    ))
    return (
        keys.select(roles.alias("role")).select("role.*")
        .filter(blank_to_null(F.col("name")).isNotNull())
        .groupBy("name")
        .agg(F.max("is_schema").alias("is_schema"), F.max("is_table").alias("is_table"))
    )


def _powers(base, count):
    powers = np.full(count, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


def stretch_hashes(texts, lengths):
    """``(text, place, length, hash)`` arrays for every stretch of the given lengths in ``texts``.

    With prefix sums ``S`` of ``code * base**i`` the hash of a stretch is ``(S[end] - S[begin]) / base**begin``
    modulo 2**64, which does not depend on where the stretch lies.
    """
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(codes * _powers(HASH_BASE, max(1, len(codes)))[:len(codes)], dtype=np.uint64)]
    back = _powers(pow(HASH_BASE, -1, 1 << 64), max(1, len(codes)))
    for length in lengths:
        begin = np.nonzero(np.arange(len(codes)) + length <= ends[owner])[0]
        yield owner[begin], begin - (ends - sizes)[owner[begin]], length, (sums[begin + length] - sums[begin]) * back[begin]


def _spots(index, lengths, known):
    """``(ord, at, length, hash)``: the stretches of the heads that may be names, without their text.

    ``known`` are the sorted hashes of all names, or None if there are too many to send them around.
    """

    def find(batches):
        for pdf in batches:
            sizes = pdf["haystack"].str.len().cumsum() // HASH_CHARS
            for _, part in pdf.groupby(sizes, sort=False):
                ords = part["ord"].to_numpy()
                for owner, at, length, hashes in stretch_hashes(list(part["haystack"]), lengths):
                    if known is not None and len(known):
                        at_known = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                        hit = known[at_known] == hashes
                        owner, at, hashes = owner[hit], at[hit], hashes[hit]
                    yield pd.DataFrame({"ord": ords[owner], "at": at, "length": length, "hash": hashes.view(np.int64)})

    kind = dict(index.dtypes)["ord"]
    return spread(index).select("ord", "haystack").mapInPandas(find, f"ord {kind}, at long, length int, hash long")


def _hashed(names):
    """Names with the hash that a stretch equal to them has."""

    @F.pandas_udf("long")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([next(stretch_hashes([x], [len(x)]))[3].view(np.int64)[0] for x in column], dtype="int64")

    return names.withColumn("hash", run("name")).withColumn("length", F.length("name"))


def name_hits(index, names):
    """(name, source) pairs where the name occurs in the source's head, without comparing all pairs.

    A head yields one hash per place and name length. The names are counted first: the hashes of few enough
    go to the heads, and only matches leave them; else all meet the names in a shuffle. What matches is
    compared as text, so equal hashes of different texts do no harm.
    """
    hashed = materialize(_hashed(names), "names")
    profile = hashed.agg(F.count("*").alias("names"), F.collect_set("length").alias("lengths")).first()
    if not profile["names"]:
        return index.select(
            F.lit("").alias("name"), F.lit(False).alias("is_schema"), F.lit(False).alias("is_table"),
            *_ENTRY,
        ).limit(0)
    known = None
    if profile["names"] <= BROADCAST_ROWS:
        known = np.array(sorted(r[0] for r in hashed.select("hash").collect()), np.int64).view(np.uint64)
        known.sort()
        hashed = F.broadcast(hashed)
    spots = _spots(index, sorted(profile["lengths"]), known).join(hashed, ["length", "hash"]).select(
        "ord", "at", "length", "name", "is_schema", "is_table")
    same = F.substr("haystack", (F.col("at") + 1).cast("int"), F.col("length")) == F.col("name")
    return index.join(spots, "ord").filter(same).select("name", "is_schema", "is_table", *_ENTRY).dropDuplicates(["name", "ord"])


def _running_before(window):
    total = F.sum("size").over(window.rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(total, F.lit(0))


def fitting_head(rows, keys, max_chars):
    """Per key, the rows up to and including the first that overflows the budget, static order.

    Salted first, so that a key with a large part of all rows is cut down by many tasks; a row past
    the overflow of its salt is past the overflow of its key.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("ord"), F.lit(SALTS)))
    for by in ([*keys, "salt"], [*keys]):
        window = Window.partitionBy(*by).orderBy(F.desc("static"), "ord")
        salted = (
            salted.withColumn("nth", F.row_number().over(window))
            .filter(F.col("nth") <= most_entries(max_chars))
            .withColumn("before", _running_before(window))
            .filter(F.col("before") <= max_chars)
            .drop("nth", "before")
        )
    return salted.drop("salt")


def _unboosted_list(index, max_chars):
    """One row: the best sources by static score, cut at the budget. Bounded by most_entries."""
    best = index.select(*_ENTRY).orderBy(F.desc("static"), "ord").limit(most_entries(max_chars))
    window = Window.orderBy(F.desc("static"), "ord")
    kept = best.withColumn("before", _running_before(window)).filter(F.col("before") <= max_chars)
    return kept.agg(F.collect_list(F.struct(*_ENTRY)).alias("entries"))


def _by_role(hits):
    return (hits.filter("is_schema").select(F.col("name").alias("schema_key"), *_ENTRY),
            hits.filter("is_table").select(F.col("name").alias("table_key"), "ord"))


def pair_ways(hits, keys):
    """(ord, way, rows): how to find the keys of which a source has both names, and the rows that this makes.

    Its schema names can be matched with its table names (``both``), or the keys of its table names (``tables``)
    or of its schema names (``schemas``) with the names of the other kind. Which is least differs from source
    to source: one may hold many names, another a table name that every schema has.
    """
    schemas, tables = _by_role(hits)
    of_schema = keys.groupBy("schema_key").agg(F.count("*").alias("n"))
    of_table = keys.groupBy("table_key").agg(F.count("*").alias("n"))
    left = schemas.join(of_schema, "schema_key").groupBy("ord").agg(F.sum("n").alias("schemas"), F.count("*").alias("s"))
    right = tables.join(of_table, "table_key").groupBy("ord").agg(F.sum("n").alias("tables"), F.count("*").alias("t"))
    rows = F.least(F.col("s") * F.col("t"), F.col("schemas"), F.col("tables"))
    way = F.when(F.col("s") * F.col("t") == rows, "both").when(F.col("tables") == rows, "tables").otherwise("schemas")
    return left.join(right, "ord").select("ord", way.alias("way"), rows.alias("rows"))


def _pairs(hits, keys):
    """(schema_key, table_key, entry) of every key whose two names lie in the head of one source."""
    schemas, tables = _by_role(hits)
    ways = materialize(pair_ways(hits, keys).select("ord", "way"), "pair-ways")
    # Sources without a name of either kind end here.
    here = lambda rows, way: rows.join(ways.filter(F.col("way") == way).select("ord"), "ord", "left_semi")
    keys = keys.select(*_PAIR)
    columns = [*_PAIR, *_ENTRY]
    both = here(schemas, "both").join(tables, "ord").join(keys, _PAIR, "left_semi").select(*columns)
    by_table = here(tables, "tables").join(keys, "table_key").join(schemas, ["ord", "schema_key"]).select(*columns)
    by_schema = here(schemas, "schemas").join(keys, "schema_key").join(tables, ["ord", "table_key"], "left_semi").select(*columns)
    return both.unionByName(by_table).unionByName(by_schema)


def _boosted_lists(hits, keys, max_chars):
    """(first, second, entries): the lists of single names (second is '') and of name pairs."""
    single = hits.select(F.col("name").alias("first"), F.lit("").alias("second"), *_ENTRY)
    pairs = _pairs(hits, keys).select(
        F.col("schema_key").alias("first"), F.col("table_key").alias("second"), *_ENTRY
    )
    kept = fitting_head(single.unionByName(pairs), ["first", "second"], max_chars)
    return kept.groupBy("first", "second").agg(F.collect_list(F.struct(*_ENTRY)).alias("entries"))


def candidates(index, keys, max_chars=fv.MAX_CONTEXT_CHARS):
    """(schema_key, table_key, ord, score, header_len, size) for every source that may be chosen.

    ``index`` and ``keys`` are read several times and should be materialized.
    """
    pair = ["schema_key", "table_key"]
    hits = materialize(name_hits(index, object_names(keys)), "hits")
    lists = _boosted_lists(hits, keys, max_chars)
    schema, table, none = F.col("schema_key"), F.col("table_key"), F.lit("")

    def lookup(present, first, second, points):
        return F.when(present, F.struct(
            first.alias("first"), second.alias("second"), F.lit(points).alias("points")
        ))

    lookups = keys.select(*pair, F.explode(F.array_compact(F.array(
        lookup(schema != "", schema, none, fv.SCORE_SCHEMA),
        lookup(table != "", table, none, fv.SCORE_TABLE),
        lookup((schema != "") & (table != ""), schema, table, fv.SCORE_SCHEMA + fv.SCORE_TABLE),
    ))).alias("lookup")).select(*pair, "lookup.*")
    boosted = lookups.join(lists, ["first", "second"])
    unboosted = keys.withColumn("entries", _unboosted_list(index, max_chars).scalar()).withColumn(
        "points", F.lit(0.0)
    )
    found = (
        boosted.select(*pair, "points", "entries").unionByName(unboosted.select(*pair, "points", "entries"))
        .select(*pair, "points", F.explode("entries").alias("entry"))
        .select(*pair, "entry.ord", (F.col("entry.static") + F.col("points")).alias("score"),
                "entry.header_len", "entry.size")
    )
    # One shuffle on the key serves both this aggregation and the ranking after it.
    return found.repartition(*pair).groupBy(*pair, "ord").agg(
        F.max("score").alias("score"),
        F.first("header_len").alias("header_len"),
        F.first("size").alias("size"),
    )


def rank_and_pack(found, max_chars=fv.MAX_CONTEXT_CHARS):
    """Rank per object and cut at the budget.

    Keeps the entries that fit and the first that does not; ``taken`` is the number of content
    characters to use, null for the whole content, and ``used`` is false for an overflow entry that
    is too short to be worth a cut.
    """
    window = Window.partitionBy("schema_key", "table_key").orderBy(F.desc("score"), "ord")
    ranked = (
        found.withColumn("rank", F.row_number().over(window))
        .withColumn("before", _running_before(window))
        .filter(F.col("before") <= max_chars)
    )
    room = F.lit(max_chars) - F.col("before") - F.col("header_len") - fv.TRUNCATION_RESERVE
    fits = F.col("before") + F.col("size") <= max_chars
    return ranked.select(
        "schema_key", "table_key", "rank", "ord", "score", "before", "size",
        F.when(~fits, room).cast("int").alias("taken"),
        (fits | (room > fv.MIN_TRUNCATED_CHARS)).alias("used"),
    )


def _pick(sources, keys, keywords, max_chars):
    index = materialize(source_index(sources, keywords), "source-index")
    return rank_and_pack(candidates(index, keys, max_chars), max_chars)


def pick_sources(sources, objects, keywords=fv.GENERATOR_KEYWORDS, max_chars=fv.MAX_CONTEXT_CHARS):
    """Ranked and packed sources of every distinct object name pair."""
    keys = materialize(context_keys(objects), "context-keys")
    return _pick(sources, keys, keywords, max_chars)


def _entries_in_use(sources, wanted, max_chars):
    """(ord, header, body) of the wanted sources, bodies cut to the budget.

    Few wanted ones are broadcast and filter the scan; else the cut bodies, never whole contents, are
    shuffled once for this join and the one that follows on the same column.
    """
    name, kind = F.col("name"), F.col("kind")
    entry = [
        "ord", source_header(name, or_empty(F.col("description")), kind).alias("header"),
        F.substring(or_empty(F.col("content")), 1, max_chars).alias("body"),
    ]
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return sources.join(F.broadcast(wanted), "ord", "left_semi").select(*entry)
    return sources.select(*entry).repartition("ord").join(wanted, "ord", "left_semi")


def context_texts(picks, sources, max_chars=fv.MAX_CONTEXT_CHARS):
    """The context of every key in ``picks``, which should be materialized.

    Returns ``(schema_key, table_key, context_id)`` and ``(context_id, context)``: keys that use the
    same cuts of the same sources share one text. Only sources in use are read past their index, and
    never more than the budget of each.
    """
    used = picks.filter("used")
    cut = F.struct("rank", "ord", "taken")
    chosen = used.groupBy("schema_key", "table_key").agg(
        F.sort_array(F.collect_list(cut)).alias("cuts")
    )
    chosen = chosen.withColumn("context_id", F.sha2(F.to_json("cuts"), 256))
    cuts = (
        chosen.select("context_id", "cuts").dropDuplicates(["context_id"])
        .select("context_id", F.explode("cuts").alias("cut")).select("context_id", "cut.*")
    )
    entries = _entries_in_use(sources, used.select("ord").distinct(), max_chars)
    body = F.when(F.col("taken").isNull(), F.col("body")).otherwise(
        F.concat(F.substr("body", F.lit(1), F.col("taken")), F.lit(fv.TRUNCATION_MARK))
    )
    parts = cuts.join(entries, "ord").select(
        "context_id", F.struct("rank", F.concat("header", body).alias("text")).alias("part")
    )
    texts = parts.groupBy("context_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list("part")), lambda part: part["text"]), "\n"
        ).alias("context")
    )
    return chosen.select("schema_key", "table_key", "context_id"), texts


class Contexts(NamedTuple):
    """``keys`` (schema_key, table_key, context_id) and ``texts`` (context_id, context).

    Apart, because many objects share a text: it is stored and shuffled once, not once per object.
    """

    keys: DataFrame
    texts: DataFrame


def contexts(sources, objects, keywords=fv.GENERATOR_KEYWORDS, max_chars=fv.MAX_CONTEXT_CHARS):
    """The contexts of every distinct object name pair; keys without any source have no text."""
    keys = materialize(context_keys(objects), "context-keys")
    picks = materialize(_pick(sources, keys, keywords, max_chars), "picks")
    chosen, texts = context_texts(picks, sources, max_chars)
    return Contexts(keys.join(chosen, _PAIR, "left"), texts)


def stored(found):
    """The same contexts written once, for several readers."""
    return Contexts(materialize(found.keys, "context-ids"), materialize(found.texts, "context-texts"))


def context_rows(found):
    """(schema_key, table_key, context), '' without sources."""
    return found.keys.join(found.texts, "context_id", "left").select(
        *_PAIR, or_empty(F.col("context")).alias("context")
    )


def with_context(objects, found):
    """Attach contexts to rows with ``schema_name`` and ``table_name`` columns.

    The text is joined last. Where very many rows share a context, AQE splits them over tasks.
    """
    keyed = objects.withColumns({
        "schema_key": F.lower("schema_name"), "table_key": F.lower(F.coalesce("table_name", F.lit(""))),
    })
    joined = keyed.join(found.keys, _PAIR, "left").join(found.texts, "context_id", "left")
    return joined.withColumn("context", or_empty(F.col("context"))).drop(*_PAIR, "context_id")
