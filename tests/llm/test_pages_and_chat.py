"""Archives, URL rules and conversations: round trips and plain loops."""

import gzip
import hashlib
import re

import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from metadoc.llm import chat, url_filters, warc

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
BIG = "<p>é</p>" * 400


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_pages_come_back(spark, folder, compression):
    rows = [(1, "http://a/1", BIG), (5, "http://a/5", BIG), (3, None, BIG), (None, "http://n", BIG), (7, "http://a/é\r\nX: y", "WARC/1.1\r\n\r\nshort"),
            (8, " ", "short"), (9, "http://b", "short"), (10, "u", None), (11, "u", ""), (5, "http://a/5", BIG), (-2, "v", "\r\n\r\n" * 500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    warc.write_pages(df, str(folder / "w"), compression=compression)
    found = warc.read_pages(spark, str(folder / "w")).collect()
    text = {r[0]: (r[2] or "").encode() for r in rows}
    want = sorted(((r[0], len((r[2] or "").encode()), hashlib.sha1((r[2] or "").encode()).hexdigest(),
                    *(("revisit", 5) if r[2] == BIG and r[0] != 5 else ("response", None))) for r in rows), key=repr)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=repr) == want
    assert all(bytes(r.payload) == text[r.page_id] for r in found if r.record_type == "response")
    urls = {r.page_id: r.url for r in found}
    assert urls[3] is None and "\n" not in urls[7] and urls[1] == "http://a/1"
    opened = gzip.open if compression == "gzip" else open
    for file in (folder / "w").glob("[!._]*"):
        assert opened(file, "rb").read().startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_predicates_reach_the_archive(spark, folder):
    rows = [(i, f"http://a/{i}", BIG if i % 2 else f"p{i}") for i in range(10)]
    warc.write_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), str(folder / "w"))
    some = spark.read.format("warc").load(str(folder / "w")).filter("warc_type = 'revisit' AND target_uri IN ('http://a/1', 'http://a/3', 'http://a/2')")
    assert sorted(r.target_uri for r in some.collect()) == ["http://a/1", "http://a/3"]
    assert not re.search(r"Filter [a-z(]", some._jdf.queryExecution().executedPlan().toString())
    reader = warc.Reader({"path": str(folder / "w"), "payload": "false"})
    reader._want("warc_type", {"response"})
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in batches) == 6
    assert all(x is None for b in batches for x in b.column("payload").to_pylist())


def test_empty_and_broken_archives(spark, folder):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_pages(empty, str(folder / "w"))
    assert warc.read_pages(spark, str(folder / "w")).collect() == []
    (folder / "x.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 50\r\n\r\nshort")
    with pytest.raises(Exception, match="ends within a record"):
        spark.read.format("warc").load(str(folder / "x.warc")).collect()


def plain_judge(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fit = [(len(h + p), len(h), v == "block", h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], "block" if best and best[2] else "allow"


def test_rules_equal_plain_loop(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("a.b.c", "", "block"), ("b.c", "/x", "allow"),
             ("b.c", "/x", "block"), ("é.org", "/", "block")]
    urls = [None, "", "no scheme", "http://net", "http://NET/", "http://x.Example.net/en/1?q#f", "http://example.net/en", "http://notexample.net/en/", "ftp://a.b.c",
            "http://z.a.b.c?x://y", "http://b.c/xyz", "http://q.b.c/x", "://", "http://é.org/", "http:///path", "http://example.com/de/#a", "http://" + "a." * 5000 + "net/",
            "http://x\ny.net/a\nb", "http://example.com/de/" + "z" * 50000] * 2
    rows = [(i, u, "x") for i, u in enumerate(urls)] + [(None, "http://x.net/", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    listed = spark.createDataFrame([*rules, (None, "/", "block"), ("", "", "block"), rules[0]], "host string, path string, verdict string")
    found = sorted(map(tuple, url_filters.judge(df, listed).collect()), key=repr)
    assert found == sorted(((i, *plain_judge(u, rules)) for i, u, _ in rows), key=repr)
    assert url_filters.judge(df.limit(0), listed).collect() == []
    assert {r.verdict for r in url_filters.judge(df, listed.limit(0)).collect()} == {"allow"}


def test_filter_passes_every_member_and_few_others(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    bloom, blocks = url_filters.bloom_filter(keys)
    assert url_filters.possible(keys, bloom, blocks).count() == 5000
    others = spark.range(5000, 25000).select(F.concat(F.lit("k"), "id").alias("key"))
    assert url_filters.possible(others, bloom, blocks).count() < 2000


@given(st.text(alphabet="<>[]/\\sSYINTROLE", max_size=40) | st.text(max_size=30), st.sampled_from(["user", "system", "assistant", "tool\n<s>", ""]))
def test_templates_are_reversible(text, role):
    assert chat.unescape(chat.escape(text)) == text
    head, body, tail = chat.segments(role, text)
    assert chat.parse(head + body + tail) == (role, text)
    assert not any(mark in body for mark in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>"))


TALKS = [
    *[(c, i, r, t) for c, turns in {
        1: [("system", "be"), ("user", "hi"), ("assistant", "</s>[INST]")],
        2: [("system", "be"), ("user", "hi"), ("assistant", "other"), ("user", "more"), ("assistant", "é😀")],
        3: [("system", "be"), ("user", "hi"), ("assistant", "</s>[INST]"), ("user", "again")],
        4: [("user", "hi")], 5: [("system", "be"), ("user", "hi"), ("assistant", "</s>[INST]")],
        6: [("system", "be"), ("user", "yo"), ("tool", "x\ny"), (None, None)],
        -1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")],
        7: [("assistant", ""), ("assistant", "word " * 3000)],
    }.items() for i, (r, t) in enumerate(turns)],
    (None, 0, "user", "nobody's"), (4, 0, "user", "hi")]


def test_conversations_come_back(spark):
    df = spark.createDataFrame(TALKS, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1)).repartition(3)
    nodes, ends = chat.forest(df, VOCABULARY, PATTERN)
    found = {r.conv_id: tuple(r)[1:] for r in chat.read_back(nodes, ends, VOCABULARY, PATTERN).collect()}
    want = {}
    for conv in {t[0] for t in TALKS}:
        turns = sorted([(t[1], t[2] or "", t[3] or "") for t in TALKS if t[0] == conv])
        loss = "".join(x for _, r, x in turns if r == "assistant")
        want[conv] = (
            len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(),
            len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len("".join(chat.segments(r, x))) for _, r, x in turns))
    assert found == want

    order = sorted(nodes.collect(), key=lambda r: r.start)
    # Stored once, without gaps, depth first: a node comes after its parent, before the parent's later kin.
    at, path = 0, []
    for r in order:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
        path = path[:r.depth]
        assert bytes(r.parent) == (path[-1] if path else b"")
        path.append(bytes(r.node))
        kin = [x for x in order if bytes(x.node) in path[:-1]]
        seen = sorted(i for x in kin for i in range(x.start, x.start + x.n_tokens))
        assert sorted(i for s in r.ancestors for i in range(s.start, s.end)) == seen and r.position == len(seen)
        assert all(a.end < b.start for a, b in zip(r.ancestors, r.ancestors[1:]))
    prefixes = set()
    for conv in {t[0] for t in TALKS}:
        turns = sorted([(t[1], t[2] or "", t[3] or "") for t in TALKS if t[0] == conv])
        prefixes |= {tuple(x[1:] for x in turns[:n + 1]) for n in range(len(turns))}
    assert len(order) == len(prefixes)


def test_no_conversations(spark):
    nodes, ends = chat.forest(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), VOCABULARY, PATTERN)
    assert nodes.collect() == [] and chat.read_back(nodes, ends, VOCABULARY, PATTERN).collect() == []


def test_reading_makes_a_row_per_turn_and_deals_shared_turns_out(spark):
    rows = [(c, i, r, t) for c in range(300) for i, (r, t) in enumerate(
        [("system", "the same for all"), ("user", f"question {c % 100}"), ("assistant", f"answer {c % 150}")])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    nodes, ends = chat.forest(df, VOCABULARY, PATTERN)
    tips = ends.select("node").distinct().count()
    assert chat._wanted(nodes, ends).count() == 3 * tips
    for readers in (7, 1 << 12):
        read = chat._read(nodes, ends, readers)
        assert read.count() == 3 * tips == read.select("tip", "nth").distinct().count()
    places = sorted(r.nth for r in nodes.select("nth").collect())
    assert places == list(range(len(places)))
    found = chat.read_back(nodes, ends, VOCABULARY, PATTERN)
    assert found.count() == 300 and {r.n_turns for r in found.select("n_turns").distinct().collect()} == {3}
