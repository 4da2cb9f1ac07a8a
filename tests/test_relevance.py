"""The pruned ranking against a plain loop over all objects and sources."""

import os
import random

import pytest
from pyspark.sql import functions as F

from metadoc import fixed_values as fv
from metadoc.operators import relevance
from metadoc.runtime import materialize

NAMES = ["a", "ab", "abc", "ventas", "ventas_2024", "mart", "fact_pedidos", "dim_cliente", "ñandú",
         "日本", "x", "cli", "2024", "[.*]", "😀"]


def contexts(*args):
    return relevance.context_rows(relevance.contexts(*args))


def plain_score(source, schema, table, words):
    head = f"{source['description']} {source['name']} {source['content'][:500]}".lower()
    score = 1.0 + 10.0 * (schema != "" and schema.lower() in head)
    score += 15.0 * (table != "" and table.lower() in head)
    if source["kind"] == "tabla":
        score += 4.0
    else:
        score += fv.SCORE_EXTENSION.get(os.path.splitext(source["name"])[1].lower(), 0.0)
    return score + sum(word in source["description"].lower() for word in words)


def plain_context(sources, schema, table, words, budget):
    """Rank, then fill the budget; the first source that does not fit ends it, cut if worth it."""
    ranked = sorted(sources, key=lambda s: (-plain_score(s, schema, table, words), s["ord"]))
    parts, left = [], budget
    for source in ranked:
        label = "Tabla" if source["kind"] == "tabla" else "Insumo"
        header = f"\n--- {label}: {source['name']} (Propósito: {source['description']}) ---\n"
        if len(header) + len(source["content"]) <= left:
            parts.append(header + source["content"])
            left -= len(header) + len(source["content"])
            continue
        room = left - len(header) - 50
        if room > 500:
            parts.append(header + source["content"][:room] + "\n[... contenido truncado]")
        break
    return "\n".join(parts)


def random_sources(seed, count):
    rng = random.Random(seed)
    sources = []
    for at in range(count):
        words = rng.choices(NAMES + ["glosario", "texto", "otro"], k=rng.randint(0, 3))
        size = rng.choice([0, 3, 40, 450, 600, 1500])
        filler = "".join(rng.choices("abcxñ日 _24", k=size))
        inside = rng.choice(NAMES)
        cut = rng.randint(0, size)
        kind = rng.choice(["archivo", "archivo", "tabla"])
        sources.append({
            "ord": at * 3 + 1,
            "name": f"s{at}" + rng.choice([".md", ".txt", ".docx", ".TSV", "", ".json"]),
            "description": " ".join(words + rng.choices(["regla", "politica", "campo", "VENTAS"], k=1)),
            "content": filler[:cut] + inside + filler[cut:], "kind": kind,
        })
    return sources


@pytest.mark.parametrize("seed,count,budget,broadcast", [
    (1, 150, 30_000, True), (2, 150, 4_000, True), (3, 40, 1_200, True), (4, 300, 9_000, True),
    (5, 3, 30_000, True), (6, 150, 6_000, False)])
def test_contexts_equal_plain_loop(spark, monkeypatch, seed, count, budget, broadcast):
    if not broadcast:  # nothing is small enough: everything joins by shuffle
        monkeypatch.setattr(relevance, "BROADCAST_ROWS", 0)
    sources = random_sources(seed, count)
    rng = random.Random(seed + 100)
    objects = [("c", s, t) for s in ["", *NAMES] for t in ["", *rng.sample(NAMES, 5)]]
    objects += [("d", "Ventas", "MART"), ("d", "nadie", None)]
    frame = spark.createDataFrame(
        [(s["ord"], s["name"], s["description"], s["content"], s["kind"]) for s in sources],
        "ord long, name string, description string, content string, kind string",
    )
    wanted = spark.createDataFrame(objects, "catalog_name string, schema_name string, table_name string")
    got = {
        (row["schema_key"], row["table_key"]): row["context"]
        for row in contexts(frame, wanted, fv.AUDITOR_KEYWORDS, budget).collect()
    }
    keys = {(s.lower(), (t or "").lower()) for _, s, t in objects}
    assert set(got) == keys
    for schema, table in keys:
        assert got[schema, table] == plain_context(
            sources, schema, table, fv.AUDITOR_KEYWORDS, budget
        ), (schema, table)


HEADER = "\n--- Insumo: a.md (Propósito: b) ---\n"


@pytest.mark.parametrize("size,whole", [
    (29_000, True), (30_000 - len(HEADER), True), (30_000 - len(HEADER) + 1, False),
])
def test_single_source_at_the_edge(spark, size, whole):
    frame = spark.createDataFrame(
        [(1, "a.md", "b", "z" * size, "archivo")],
        "ord long, name string, description string, content string, kind string")
    objects = spark.createDataFrame([("c", "s", "")], "catalog_name string, schema_name string, table_name string")
    text = contexts(frame, objects).first()["context"]
    if whole:
        assert text == HEADER + "z" * size
    else:
        assert text == HEADER + "z" * (30_000 - len(HEADER) - 50) + "\n[... contenido truncado]"


@pytest.mark.parametrize("room,kept", [(501, True), (500, False)])
def test_overflow_entry_needs_more_than_500_characters(spark, room, kept):
    header = HEADER
    used = 30_000 - len(HEADER) - 50 - room
    rows = [(1, "a.md", "b", "y" * (used - len(HEADER)), "archivo"), (2, "b.md", "c", "z" * 5_000, "archivo"),
            (3, "c.md", "d", "tiny", "archivo")]
    frame = spark.createDataFrame(
        rows, "ord long, name string, description string, content string, kind string")
    objects = spark.createDataFrame([("c", "s", "")], "catalog_name string, schema_name string, table_name string")
    text = contexts(frame, objects).first()["context"]
    assert text.startswith(header) and ("zzz" in text) is kept and "tiny" not in text


def test_no_sources_give_the_empty_text(spark):
    empty = spark.createDataFrame(
        [], "ord long, name string, description string, content string, kind string")
    objects = spark.createDataFrame([("c", "s", "t")], "catalog_name string, schema_name string, table_name string")
    assert contexts(empty, objects).collect()[0]["context"] == ""


def test_objects_with_the_same_sources_share_a_text(spark):
    frame = spark.createDataFrame(
        [(1, "a.md", "b", "x", "archivo"), (2, "b.md", "ventas", "y", "archivo")],
        "ord long, name string, description string, content string, kind string")
    objects = spark.createDataFrame(
        [("c", f"s{i}", f"t{i % 7}") for i in range(50)] + [("c", "ventas", "t")],
        "catalog_name string, schema_name string, table_name string")
    found = relevance.contexts(frame, objects)
    assert found.keys.count() == 51 and found.texts.count() == 2
    assert relevance.with_context(objects, found).filter("context = ''").count() == 0


def test_many_names_join_by_shuffle(spark, monkeypatch):
    """With the broadcast bound at zero the same pairs are found."""
    sources = random_sources(9, 80)
    frame = spark.createDataFrame(
        [(s["ord"], s["name"], s["description"], s["content"], s["kind"]) for s in sources],
        "ord long, name string, description string, content string, kind string")
    keys = spark.createDataFrame([(n, "") for n in NAMES], "schema_key string, table_key string")
    index = materialize(relevance.source_index(frame), "test-index")

    def pairs():
        return {tuple(r) for r in relevance.name_hits(index, relevance.object_names(keys))
                .select("name", "ord").collect()}

    few = pairs()
    monkeypatch.setattr(relevance, "BROADCAST_ROWS", 0)
    assert pairs() == few
    assert few == {
        (n, s["ord"]) for n in NAMES for s in sources
        if n in f"{s['description']} {s['name']} {s['content'][:500]}".lower()
    }


def test_hot_name_is_cut_to_the_budget(spark):
    """A name in every source: the list kept for it is a short prefix, not all sources."""
    frame = spark.range(20_000).select(
        F.col("id").alias("ord"), F.format_string("f%d.md", "id").alias("name"),
        F.lit("ventas").alias("description"), F.repeat(F.lit("t"), 200).alias("content"),
        F.lit("archivo").alias("kind"))
    index = materialize(relevance.source_index(frame), "hot-index")
    keys = spark.createDataFrame([("ventas", "")], "schema_key string, table_key string")
    hits = relevance.name_hits(index, relevance.object_names(keys))
    kept = relevance.fitting_head(hits.select("name", "ord", "static", "header_len", "size"), ["name"], 30_000)
    ords = sorted(r["ord"] for r in kept.collect())
    assert ords == list(range(len(ords))) and 100 < len(ords) < 150


def test_no_pairwise_plan(spark, sf_dir):
    """Neither a cross product nor a nested loop, and no global window over sources."""
    from checks.views import view

    index = materialize(relevance.source_index(view(spark, sf_dir, "v_sources")), "plan-index")
    keys = materialize(relevance.context_keys(view(spark, sf_dir, "v_objects")), "plan-keys")
    found = relevance.candidates(index, keys)
    plan = relevance.rank_and_pack(found)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "TakeOrderedAndProject" in plan


def test_names_are_found_wherever_they_lie(spark, monkeypatch):
    rng = random.Random(8)
    heads = ["".join(rng.choices("abñ日😀_", k=rng.randint(0, 60))) for _ in range(200)] + ["", "abc"]
    names = ["a", "ab", "ñ日", "😀", "_ab_", "zz", "a" * 40, "".join(rng.choices("ab", k=5))]
    index = spark.createDataFrame([(i, 1.0, 10, len(h), h) for i, h in enumerate(heads)],
                                  "ord long, static double, header_len int, size int, haystack string")
    frame = spark.createDataFrame([(n, True, False) for n in names], "name string, is_schema boolean, is_table boolean")
    want = sorted((n, i) for i, h in enumerate(heads) for n in names if n in h)
    for most, chars in ((200_000, 1 << 18), (0, 100)):
        monkeypatch.setattr(relevance, "BROADCAST_ROWS", most)
        monkeypatch.setattr(relevance, "HASH_CHARS", chars)
        assert sorted((r.name, r.ord) for r in relevance.name_hits(index, frame).collect()) == want
    assert relevance.name_hits(index, frame.limit(0)).collect() == []


def test_no_text_leaves_the_heads(spark):
    """What the name search shuffles or explodes holds numbers only, until a hash has matched."""
    index = spark.createDataFrame([(1, 1.0, 1, 1, "x")], "ord long, static double, header_len int, size int, haystack string")
    spots = relevance._spots(index, [1, 2], None)
    assert [kind for _, kind in spots.dtypes] == ["bigint", "bigint", "int", "bigint"]


def test_pairs_take_the_shortest_way(spark):
    """A source with many names, a table name that every schema has, a schema with every table."""
    keys = [(f"s{i}", "common") for i in range(200)] + [("big", f"t{i}") for i in range(200)] + [("s1", "t1"), ("s2", "")]
    heads = {1: ["s1", "common", "t1"], 2: [f"s{i}" for i in range(60)] + [f"t{i}" for i in range(60)], 3: ["big", "t5", "t6", "s9"],
             4: ["common"], 5: ["big", *(f"t{i}" for i in range(0, 300, 2))], 6: [*(f"s{i}" for i in range(150)), "common", "t1"]}
    schemas, tables = {s for s, _ in keys}, {t for _, t in keys if t}
    hits = spark.createDataFrame(
        [(n, n in schemas, n in tables, o, 1.0, 10, 20) for o, names in heads.items() for n in names if n in schemas or n in tables],
        "name string, is_schema boolean, is_table boolean, ord long, static double, header_len int, size int")
    frame = spark.createDataFrame(keys, "schema_key string, table_key string")
    found = relevance._pairs(hits, frame).collect()
    want = sorted((s, t, o) for o, names in heads.items() for s, t in keys if t and s in names and t in names)
    assert sorted((r.schema_key, r.table_key, r.ord) for r in found) == want
    ways = {r.ord: (r.way, r.rows) for r in relevance.pair_ways(hits, frame).collect()}
    all_pairs = sum(len([n for n in names if n in schemas]) * len([n for n in names if n in tables]) for names in heads.values())
    assert {w for w, _ in ways.values()} == {"both", "tables", "schemas"} or len({w for w, _ in ways.values()}) >= 2
    assert sum(n for _, n in ways.values()) < all_pairs / 4
