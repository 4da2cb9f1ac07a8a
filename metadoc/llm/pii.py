"""Personal data: fixed patterns, and bootstrapped contextual extraction; DataFrame operations only.

What the fixed patterns find are the seeds, each as a whole. A lexical pattern is the word to the left of
an identifier together with the identifier's shape (runs of digits as 9, runs of letters as a or A).
Candidates are words with digits or an at sign, and runs of digit groups joined by spaces, stops, hyphens
or brackets. Patterns and the instances they occur with form a bipartite graph over the whole corpus. Each
round scores a pattern by the share of its distinct instances that are known, and takes the instances of
patterns with enough support and confidence as known in turn, until the trusted patterns stay the same; so
confident patterns reach identifiers that no fixed pattern knows. Only aggregates of patterns and instances
are shuffled, never texts.
"""

from functools import reduce
from itertools import count

from pyspark.sql import functions as F

from metadoc.llm.shared import materialize, small

#: The kinds in their order, and what each matches. The possessive forms find the same
#: leftmost matches as the plain ones, without backtracking: time stays in proportion to the text.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
MATCHES = {
    # \G: the local part may begin right where the last match ended.
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    # Only whole chains of digits can match; those with 14 to 19 digits are looked at.
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text in which this is not found is not searched further.
HINTS = {"email": "[A-Za-z0-9._%+-]@", "ip": r"[0-9]\.[0-9]", "card": MATCHES["card"], "phone": r"\+[0-9]"}
#: Words with digits or an at sign are candidates, and so are pieces of digit groups, joined by _GLUE. The
#: context is the last word before, of which the last _NEAR characters count.
_WORD = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
_PIECE = r"\+?[0-9]++(?:[().-]++[0-9]++)*+"
_GLUE = "^[ ().-]+$"
_NEAR = 48
_PART = 256


def _placed(df, searches):
    """``df`` with a column of matches per search ``{name: (pattern, hint)}`` in the column ``text``.

    A match is ``(start, end, value, gap, before)``, places in code points, ``gap`` being what lies between
    it and the match before, if that is short, and ``before`` the end of the text before it, with runs of
    white space as one. Matches and gaps come from two passes over the text, and adding up
    their lengths gives the places: in two levels, so that the work stays small for texts with very
    many matches. Each step is a column of its own, as Spark would otherwise repeat the passes.
    """
    col = lambda name, part: F.col(f"{name}_{part}")
    length = lambda x: F.length(x["gap"]) + F.length(x["value"])
    ints, spans = (F.array().cast(kind) for kind in ("array<int>", "array<struct<start:int,end:int,value:string,gap:string,before:string>>"))

    end_of = lambda *texts: F.right(F.concat(*texts), F.lit(_NEAR))

    def within(part, at, tail):
        step = lambda acc, x: F.struct(
            (acc["at"] + length(x)).alias("at"), end_of(acc["tail"], x["near"], x["value"]).alias("tail"),
            F.concat(acc["found"], F.array(F.struct(
                (acc["at"] + F.length(x["gap"])).alias("start"), (acc["at"] + length(x)).alias("end"), x["value"].alias("value"),
                F.when(F.length(x["gap"]) <= _NEAR, x["gap"]).alias("gap"), end_of(acc["tail"], x["near"]).alias("before")))).alias("found"))
        return F.aggregate(
            part, F.struct(at.alias("at"), tail.alias("tail"), spans.alias("found")), step, lambda acc: acc["found"])

    steps = {
        "text": lambda n, p, h: F.when(F.col("text").rlike(h), F.col("text")),
        "values": lambda n, p, h: F.regexp_extract_all(col(n, "text"), F.lit(p), F.lit(0)),
        "gaps": lambda n, p, h: F.split(col(n, "text"), p, -1),
        "pairs": lambda n, p, h: F.zip_with(
            F.slice(col(n, "gaps"), 1, F.size(col(n, "values"))), col(n, "values"), lambda gap, value: F.struct(
                gap.alias("gap"), value.alias("value"), end_of(F.regexp_replace(gap, r"\s{2,}+", " ")).alias("near"))),
        "parts": lambda n, p, h: F.when(F.size(col(n, "pairs")) > 0, F.transform(
            F.sequence(F.lit(0), F.floor((F.size(col(n, "pairs")) - 1) / _PART).cast("int")),
            lambda k: F.slice(col(n, "pairs"), k * _PART + 1, _PART))),
        "starts": lambda n, p, h: F.aggregate(
            F.transform(col(n, "parts"), lambda part: F.aggregate(part, F.lit(0), lambda at, x: at + length(x))),
            F.struct(F.lit(0).alias("at"), ints.alias("seen")),
            lambda acc, k: F.struct((acc["at"] + k).alias("at"), F.concat(acc["seen"], F.array(acc["at"])).alias("seen")),
            lambda acc: acc["seen"]),
        # All parts but the last are full, and each match has a character at least.
        "tails": lambda n, p, h: F.transform(col(n, "parts"), lambda part: end_of(F.array_join(F.flatten(F.transform(
            F.slice(part, -_NEAR, _NEAR), lambda x: F.array(x["near"], x["value"]))), ""))),
        "found": lambda n, p, h: F.coalesce(F.flatten(F.transform(col(n, "parts"), lambda part, k: within(
            part, F.get(col(n, "starts"), k), F.coalesce(F.get(col(n, "tails"), k - 1), F.lit(""))))), spans),
    }
    kept, made = df.columns, []
    for step, make in steps.items():
        made = [*made, *(make(n, *search).alias(f"{n}_{step}") for n, search in searches.items())]
        df = df.select("*", *made)
        made = []
    return df.select(*kept, *(col(n, "found").alias(n) for n in searches))


def _digits(value):
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value):
    """Every second digit from the right counts double, minus nine if above nine; the sum ends in 0."""
    digits = F.transform(F.split(F.reverse(_digits(value)), ""), lambda d: d.try_cast("int"))
    parts = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(parts, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _valid(kind, value):
    if kind == "ip":
        bare = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(bare, lambda p: (F.length(p) <= 2) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.length(_digits(value)).between(14, 19) & _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _with_seeds(df):
    """``df`` with ``seeds``: all spans of the fixed patterns in the column ``text``, by start, then kind."""
    placed = _placed(df, {kind: (MATCHES[kind], HINTS[kind]) for kind in KINDS})
    return placed.select(*df.columns, *(_checked(kind).alias(kind) for kind in KINDS)).select(*df.columns, F.array_sort(F.concat(*KINDS)).alias("seeds"))


def _checked(kind):
    return F.transform(F.filter(kind, lambda x: _valid(kind, x["value"])), lambda x: F.struct(
        x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("n"), F.lit(kind).alias("kind"),
        x["end"].alias("end"), x["value"].alias("value"), x["before"].alias("before")))


def with_base(df):
    """``df`` with ``base``: the seeds without what is before them."""
    base = F.transform("seeds", lambda s: F.struct(*(s[c].alias(c) for c in ("start", "n", "kind", "end", "value"))))
    return _with_seeds(df).select(*df.columns, base.alias("base"))


def shape(word):
    """Runs of digits as 9, of lower and upper case letters as a and A, of spaces as one."""
    for run, one in (("[0-9]++", "9"), (r"\p{Ll}++", "a"), (r"\p{Lu}++", "A"), (" {2,}+", " ")):
        word = F.regexp_replace(word, run, one)
    return F.left(word, F.lit(_NEAR))


def _left(before):
    """The last word of what is before an identifier, without the marks between the two."""
    return F.lower(F.regexp_extract(before, r"(\S*[\p{L}\p{N}])[^\p{L}\p{N}]*+$", 1))


def _seeds(df):
    """``(pattern, value, kind, shape)``: the distinct seeds in ``df``."""
    found = _with_seeds(df).select(F.explode_outer("seeds").alias("s")).filter("s is not null").select(
        "s.value", "s.kind", _left(F.col("s.before")).alias("left"), shape(F.col("s.value")).alias("shape"))
    return found.filter("left <> ''").select(F.concat_ws(" ", "left", "shape").alias("pattern"), "value", "kind", "shape").distinct()


def _candidates(df, shapes, most):
    """``(doc_id, name, start, end, value, pattern, kind)``: words with digits or an at sign, and runs of pieces, in context.

    ``kind`` is that of the first base span within a word, else null; what a base span touches otherwise is
    no candidate, as base spans are seeds as a whole. Trusted patterns have shapes of seeds, so of the runs
    and short words only those in one of the ``shapes`` are rows, and no run has over ``most`` pieces. Base
    spans are looked through part by part, as most parts lie elsewhere; nothing is copied per word.
    """
    parts = F.transform(
        F.filter(F.sequence(F.lit(0), F.floor(F.size("base") / _PART).cast("int")), lambda k: k * _PART < F.size("base")),
        lambda k: F.slice("base", k * _PART + 1, _PART))
    ranged = F.transform("parts", lambda part: F.struct(
        F.get(part, 0)["start"].alias("low"), F.array_max(F.transform(part, lambda s: s["end"])).alias("high"), part.alias("spans")))

    def touching(c):
        """Kind of the first base span that touches ``c``, and the empty text if that is not within ``c``."""
        touches = lambda s: (s["start"] < c["end"]) & (s["end"] > c["start"])
        name = lambda s: F.when((s["start"] >= c["start"]) & (s["end"] <= c["end"]), s["kind"]).otherwise("")
        near = F.filter("ranged", lambda p: (p["low"] < c["end"]) & (p["high"] > c["start"]))
        return F.get(F.flatten(F.transform(near, lambda p: F.transform(F.filter(p["spans"], touches), name))), 0)

    placed = _placed(df.select("doc_id", "name", "text", "base"), {"word": (_WORD, "[0-9@]"), "piece": (_PIECE, "[0-9]")})
    placed = placed.select("doc_id", "name", "word", "piece", "base", parts.alias("parts")).select("doc_id", "name", "word", "piece", ranged.alias("ranged"))
    words = F.transform("word", lambda c: F.struct(
        c["start"].alias("start"), F.array(c["value"]).alias("values"), c["before"].alias("before"), touching(c).alias("kind"), F.lit(True).alias("word")))
    # A piece is glued to the one before it if there is only glue between them and none belongs to a base span.
    pieces = F.transform("piece", lambda c: F.struct(
        c["start"].alias("start"), c["before"].alias("before"), F.when(touching(c).isNull(), c["value"]).alias("value"),
        F.when(c["gap"].rlike(_GLUE) & ~c["value"].startswith("+"), c["gap"]).alias("glue")))
    longer = lambda acc, x: F.concat(acc["value"], x["glue"], x["value"])
    step = lambda acc, x: F.struct(longer(acc, x).alias("value"), F.when(
        longer(acc, x).isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(longer(acc, x)))).alias("found"))
    ahead = lambda c, i: F.when(F.get("pieces", i + 1)["glue"].isNull(), F.array(c["value"])).otherwise(F.aggregate(
        F.slice("pieces", i + 2, F.lit(max(most - 1, 0))), F.struct(c["value"].alias("value"), F.array(c["value"]).alias("found")), step,
        lambda acc: acc["found"]))
    runs = F.filter(F.transform("pieces", lambda c, i: F.struct(
        c["start"].alias("start"), F.when(c["value"].isNotNull(), ahead(c, i)).alias("values"), c["before"].alias("before"),
        F.lit(None).cast("string").alias("kind"), F.lit(False).alias("word"))), lambda r: r["values"].isNotNull())
    found = placed.select("doc_id", "name", words.alias("words"), pieces.alias("pieces"))
    # With explode, Spark would put a filter under the steps above, and so take them many times over.
    rows = found.select("doc_id", "name", F.explode_outer(F.concat("words", runs)).alias("c")).filter("c is not null").select("doc_id", "name", "c.*")
    rows = rows.filter("kind IS NULL OR kind <> ''").select(
        "doc_id", "name", "kind", "start", "word", _left(F.col("before")).alias("left"), F.explode("values").alias("value")).filter("left <> ''")
    # What surrounds a word, brackets and stops for instance, does not belong to the identifier.
    tail = F.regexp_replace("value", r"^[^\p{L}\p{N}+(]++", "")
    rows = rows.withColumn("tail", tail).select(
        "doc_id", "name", "kind", "left", "word", (F.col("start") + F.length("value") - F.length("tail")).alias("start"),
        F.regexp_replace("tail", r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$", "").alias("value"))
    rows = rows.withColumn("shape", shape(F.col("value"))).join(small(shapes.withColumn("seed", F.lit(True))), "shape", "left")
    return rows.filter("seed OR (word AND length(value) >= 7)").select(
        "doc_id", "name", "start", (F.col("start") + F.length("value")).alias("end"), "value",
        F.concat_ws(" ", "left", "shape").alias("pattern"), "kind")


def bootstrap(candidates, rounds=None, confidence=0.8, support=3):
    """``(pattern, kind)``: the patterns that are trusted once they stay the same, or after ``rounds`` rounds.

    ``candidates`` has ``(pattern, value, kind)``, ``kind`` being that of the seed or null. A pattern is
    trusted if at least ``support`` distinct known instances of one kind occur with it, and these are
    at least ``confidence`` of its distinct instances. The rounds end: instances only become known, or
    known as an earlier kind.
    """
    edges = materialize(
        candidates.groupBy("pattern", "value").agg(F.min("kind").alias("kind")), "pattern-instances")
    known = materialize(
        edges.filter("kind is not null").groupBy("value").agg(F.min("kind").alias("known")), "instances")
    totals = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    trusted, before = None, None
    for _ in count() if rounds is None else range(rounds):
        hits = edges.join(known, "value").groupBy("pattern", "known").agg(F.count("*").alias("k"))
        scores = hits.filter(F.col("k") >= support).join(totals, "pattern")
        trusted = materialize(
            scores.filter(F.col("k") >= confidence * F.col("n")).groupBy("pattern").agg(
                F.max_by("known", "k").alias("trusted")), "patterns")
        if (now := trusted.agg(F.count("*"), F.bit_xor(F.xxhash64("pattern", "trusted"))).first()) == before:
            break
        before = now
        reached = edges.join(trusted, "pattern").groupBy("value").agg(F.min("trusted").alias("known"))
        known = materialize(
            known.unionByName(reached).groupBy("value").agg(F.min("known").alias("known")), "instances")
    return trusted.select("pattern", F.col("trusted").alias("kind"))


def personal_data(df, id_col="doc_id", text_col="text", rounds=None, confidence=0.8, support=3):
    """``(doc_id, text, base, spans, row)`` per row of ``df``: what the fixed patterns find, and all spans.

    Both are arrays of ``(start, n, kind, end, value)`` in code points, end exclusive, by start and then
    kind. Base spans stay as they are; the method adds the words and runs of digit groups that a trusted
    pattern points at and that no base span touches. Null texts count as empty. Rows are kept as often as they occur: equal
    rows have equal spans, and different texts of one id have their own. ``row`` is the row itself; its other columns are not looked at.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # An id may have several texts: spans go by id and text.
    rows = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("name"), text.alias("text"), F.struct("*").alias("row"))
    based = with_base(rows)
    seeds = materialize(_seeds(rows.select("text")), "seeds")
    shapes = seeds.select("shape").distinct()
    most = shapes.agg(F.max(F.size(F.split("shape", "9")) - 1)).first()[0] or 0
    candidates = materialize(_candidates(based, shapes, most), "candidates")
    instances = candidates.select("pattern", "value", "kind").unionByName(seeds.drop("shape"))
    trusted = bootstrap(instances, rounds, confidence, support)
    fresh = candidates.filter("kind is null").drop("kind").join(small(trusted), "pattern")
    number = reduce(lambda acc, k: acc.when(F.col("kind") == k, KINDS.index(k)), KINDS[1:], F.when(F.col("kind") == KINDS[0], 0))
    added = fresh.groupBy(F.col("doc_id").alias("added_id"), F.col("name").alias("added_name")).agg(
        F.collect_set(F.struct("start", number.alias("n"), "kind", "end", "value")).alias("added"))
    added = materialize(added, "added-spans")
    return based.join(small(added, 10 * F.size("added")), F.col("doc_id").eqNullSafe(F.col("added_id")) & (F.col("name") == F.col("added_name")), "left").select(
        "doc_id", "text", "base",
        F.when(F.col("added").isNull(), F.col("base")).otherwise(
            F.array_sort(F.array_union("base", "added"))).alias("spans"), "row")


def joined(spans):
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text, spans):
    """``text`` with each span replaced by its kind in brackets; a span that overlaps one before is part of it."""
    empty = F.array().cast("array<string>")
    step = lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(
        s["end"].alias("at"), F.concat(acc["parts"], F.array(
            F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("parts"),
    )).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts")))
    return F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), empty.alias("parts")), step,
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr(text, acc["at"] + 1, F.length(text))))


def redacted(df, id_col="doc_id", text_col="text", **options):
    """``df`` with personal data replaced in its texts; null texts stay null."""
    found = personal_data(df, id_col, text_col, **options)
    clean = F.when(F.col(f"row.`{text_col}`").isNull(), None).when(F.size("spans") == 0, F.col("text")).otherwise(
        redact(F.col("text"), F.col("spans")))
    return found.select(*(
        clean.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in df.columns))
