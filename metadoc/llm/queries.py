"""The registered queries of the operators, with production parameters, and their SQL."""

import public_tokenizers
from pyspark.sql import functions as F

from metadoc.llm import (
    alignment, chat, decontamination, embeddings, mixing, packing, pii, quality, ranked, simhash, token_counts,
    url_filters, warc)
from metadoc.llm.shared import table

#: Host, beginning of the path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: The weights of sources in turn, and how often a source's documents may be taken.
WEIGHTS, EPOCHS = (5, 2, 1), 3
#: A conversation whose texts consist of control strings.
MARKED = "</s>[INST] ok [/INST]"


def op1_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op2_embeddings(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_decontamination(spark, sf_dir):
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url", "payload")


def op5_chat(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", MARKED), (-1, 1, "assistant", MARKED)], talks.schema)
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    nodes, ends = chat.forest(talks.unionByName(extra), vocabulary, public_tokenizers.PATTERN)
    return chat.read_back(nodes, ends, vocabulary, public_tokenizers.PATTERN)


def op6_personal_data(spark, sf_dir):
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, pii.KINDS), F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"))


def op7_token_counts(spark, sf_dir):
    return token_counts.token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_packing(spark, sf_dir):
    return packing.pack(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op9_url_filters(spark, sf_dir):
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return url_filters.judge(table(spark, sf_dir, "pages"), rules)


def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op11_ranked_search(spark, sf_dir):
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.cycled(docs, WEIGHTS), EPOCHS).select(
        "doc_id", "size", "source_size", "target", "taken")


def op13_alignment(spark, sf_dir):
    return alignment.link_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_embeddings, op3_decontamination, op4_warc, op5_chat, op6_personal_data, op7_token_counts,
    op8_packing, op9_url_filters, op10_quality, op11_ranked_search, op12_mixing, op13_alignment)}

_SPACELESS = "([" + "".join(f"\\p{{{name}}}" for name in decontamination.SPACELESS) + "])"

SQL = {
    "op2_embeddings": """
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (
    SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
        AND len([x FOR x IN e IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
pairs AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
        AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(l.m, v.vec_id)) AS component_id,
    v.vec_id = least(v.vec_id, coalesce(l.m, v.vec_id)) AS kept
FROM v LEFT JOIN degree d ON v.vec_id = d.a LEFT JOIN least l ON v.vec_id = l.a""",
    "op3_decontamination": f"""
WITH d AS (
    SELECT doc_id, [x FOR x IN regexp_split_to_array(
        regexp_replace(lower(coalesce(text, '')), '{_SPACELESS}', ' \\1 ', 'g'), '[^\\p{{L}}\\p{{N}}]+') IF x <> ''] AS t
    FROM documents),
i AS (
    SELECT item_id, [x FOR x IN regexp_split_to_array(
        regexp_replace(lower(coalesce(text, '')), '{_SPACELESS}', ' \\1 ', 'g'), '[^\\p{{L}}\\p{{N}}]+') IF x <> ''] AS t
    FROM benchmark),
dt AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS p FROM d),
it AS (
    SELECT item_id, len(t) AS n, unnest(t) AS w, generate_subscripts(t, 1) AS q,
        CASE WHEN len(t) >= {decontamination.WINDOW} THEN {decontamination.NEEDED}
            WHEN len(t) >= {decontamination.TOLERANT} THEN len(t) - 1 ELSE len(t) END AS needed
    FROM i WHERE len(t) >= {decontamination.LEAST_TOKENS}),
same AS (SELECT doc_id, item_id, n, needed, q, p - q AS shift FROM dt JOIN it USING (w)),
long AS (
    SELECT doc_id, item_id, n, needed, q, shift FROM same
    QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, shift) >= needed),
ends AS (
    SELECT doc_id, item_id, n, needed, count(*) OVER (
        PARTITION BY doc_id, item_id, shift ORDER BY q RANGE BETWEEN least(n, {decontamination.WINDOW}) - 1 PRECEDING AND CURRENT ROW) AS m
    FROM long),
lines AS (
    SELECT doc_id, [x FOR x IN regexp_split_to_array(
        regexp_replace(lower(line), '{_SPACELESS}', ' \\1 ', 'g'), '[^\\p{{L}}\\p{{N}}]+') IF x <> ''] AS t
    FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[\\r\\n]+')) AS line FROM documents)),
found AS (
    SELECT doc_id, item_id, m, n FROM ends WHERE m >= needed
    UNION ALL SELECT doc_id, item_id, len(i.t), len(i.t) FROM lines JOIN i USING (t)
    WHERE len(i.t) BETWEEN 1 AND {decontamination.LEAST_TOKENS - 1})
SELECT doc_id, item_id, max(m)::BIGINT AS matched, max(n)::BIGINT AS item_tokens FROM found GROUP BY doc_id, item_id""",
    "op4_warc": """
WITH p AS (
    SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS m FROM d)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id <> m THEN m END AS refers_to
FROM k""",
    "op5_chat": f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '{MARKED}'), (-1, 1, 'assistant', '{MARKED}')),
e AS (
    SELECT *, regexp_replace(regexp_replace(text, '(<)(\\\\*)(/?s>|</?(?:SYS|ROLE)>>)', '\\1\\\\\\2\\3', 'g'),
        '(\\[)(\\\\*)(/?INST\\])', '\\1\\\\\\2\\3', 'g') AS escaped,
        replace(replace(to_json(role)::VARCHAR, '<<ROLE>>', '<\\<ROLE>>'), '<</ROLE>>', '<\\</ROLE>>') AS named
    FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length(escaped) + CASE role WHEN 'system' THEN 19 WHEN 'user' THEN 15 WHEN 'assistant' THEN 6
        ELSE 18 + length(named) END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op9_url_filters": """
WITH r(host, path, verdict) AS (VALUES """ + ", ".join(str(x) for x in RULES) + """),
p AS (
    SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
    FROM pages),
best AS (
    SELECT p.host, p.path, max({'n': length(r.host || r.path), 'm': length(r.host), 'b': r.verdict = 'block', 'rule': r.host || r.path}) AS b
    FROM (SELECT DISTINCT host, path FROM p) p JOIN r
        ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
    GROUP BY p.host, p.path)
SELECT p.page_id, p.host, p.path, b.rule AS rule,
    CASE WHEN b IS NOT NULL AND b.b THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN best USING (host, path)""",
    "op11_ranked_search": """
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
s AS (SELECT count(*) FILTER (len(t) > 0)::BIGINT AS n_docs, sum(len(t))::BIGINT AS total FROM d),
i AS (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
q AS (SELECT i, item_id, term, count(*) AS times FROM i GROUP BY ALL),
tf AS (
    SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d)
    WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
    FROM tf, s GROUP BY term, n_docs),
scored AS (
    SELECT i, item_id, doc_id, r,
        sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // total))))::BIGINT AS score
    FROM q JOIN tf USING (term) JOIN w USING (term), s GROUP BY ALL),
ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
    FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10""",
    "op12_mixing": f"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
drawn AS (
    SELECT *, ('0x' || substr(md5(concat_ws(':', '42', doc_id::VARCHAR, size::VARCHAR)), 1, 15))::BIGINT AS draw FROM d),
s AS (
    SELECT source, sum(size)::BIGINT AS source_size, {EPOCHS} * sum(size)::BIGINT AS capacity,
        {list(WEIGHTS)}[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INTEGER]::BIGINT AS weight
    FROM d GROUP BY source),
-- The sources that are held come first by capacity per weight.
steps AS (
    SELECT *, sum(weight) OVER (ORDER BY capacity / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS den,
        (SELECT sum(source_size) FROM s) - coalesce(sum(capacity) OVER (
            ORDER BY capacity / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num
    FROM s),
level AS (SELECT num, den FROM steps WHERE capacity * den >= num * weight ORDER BY capacity / weight, source NULLS LAST LIMIT 1),
aims AS (
    SELECT source, source_size, CASE WHEN capacity * den < num * weight THEN capacity::DOUBLE
        ELSE (num * weight)::DOUBLE / den::DOUBLE END AS target FROM s, level),
wanted AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
        target - CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END * source_size AS want
    FROM aims),
placed AS (
    SELECT doc_id, size, draw, w.*, sum(size) OVER (PARTITION BY w.source ORDER BY draw) AS upto
    FROM drawn d JOIN wanted w ON d.source IS NOT DISTINCT FROM w.source),
gaps AS (
    SELECT *, want - coalesce(max(CASE WHEN upto <= want THEN upto END) OVER (PARTITION BY source), 0) AS gap FROM placed),
also AS (
    SELECT source, draw FROM gaps WHERE upto > want AND abs(size - gap) < gap
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(size - gap), draw) = 1)
SELECT g.doc_id, g.size, g.source_size, g.target,
    g.size * (g.whole + CASE WHEN g.upto <= g.want OR g.draw = a.draw THEN 1 ELSE 0 END) AS taken
FROM gaps g LEFT JOIN also a ON g.source IS NOT DISTINCT FROM a.source""",
}
