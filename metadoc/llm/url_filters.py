"""URL rules through a blocked Bloom filter and an exact join.

A rule is a host and the beginning of a path. Every URL gives one key per suffix of its host and
beginning of its path that a rule could have; a key is a canonical URL without scheme, query and
fragment. The keys of the rules fill a Bloom filter whose blocks are rows of a table: a key sets one bit
in each of the four words of one block. Probing is a join on the block; what passes is joined with the
rules themselves, which removes the false positives.
"""

import string
from functools import reduce

from pyspark.sql import functions as F

from metadoc.llm.shared import materialize, small

WORDS, KEYS_PER_BLOCK = 4, 16


def lower(column):
    """A-Z in lower case, nothing else."""
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url):
    """Host and path of a URL as columns; both empty without a scheme."""
    found = lambda n: F.coalesce(F.regexp_extract(url.cast("string"), r"(?s)^.*?://([^/?#]*)([^?#]*)", n), F.lit(""))
    return lower(found(1)), found(2)


def _bits(key):
    code = F.xxhash64(key, F.lit("bits"))
    return [F.shiftrightunsigned(code, 6 * n).bitwiseAND(F.lit(63)).cast("int") for n in range(WORDS)]


def _block(key, blocks):
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks))


def bloom_filter(keys):
    """``(block, word0..word3)`` for a table ``key``, and the number of blocks."""
    blocks = max(1, -(-keys.count() // KEYS_PER_BLOCK))
    marked = keys.select(_block(F.col("key"), blocks).alias("block"), *(
        bit.alias(f"bit{n}") for n, bit in enumerate(_bits(F.col("key")))))
    words = [F.expr(f"bit_or(shiftleft(1L, bit{n}))").alias(f"word{n}") for n in range(WORDS)]
    return marked.groupBy("block").agg(*words), blocks


def possible(rows, bloom, blocks):
    """The rows of ``rows`` whose ``key`` may be in the filter."""
    bits = [f"bit{n}" for n in range(WORDS)]
    probed = rows.select("*", _block(F.col("key"), blocks).alias("block"), *(
        bit.alias(name) for name, bit in zip(bits, _bits(F.col("key"))))).join(bloom, "block")
    hit = reduce(lambda a, b: a & b, [F.expr(f"getbit(word{n}, bit{n}) = 1") for n in range(WORDS)])
    return probed.filter(hit).select(*rows.columns)


def judge(pages, rules, id_col="page_id", url_col="url", default="allow"):
    """``(page_id, host, path, rule, verdict)`` for each row of ``pages``.

    ``rules`` has ``(host, path, verdict)``, verdict being ``allow`` or ``block``. A rule fits its host and
    all subdomains if the URL's path starts with the rule's. Of those that fit the longest decides, then
    the one with the longer host, then ``block``; without any, ``rule`` is null and the verdict is
    ``default``: the list blocks nothing that is not on it. Null URLs and URLs without ``://`` have an empty
    host and path. Rules with a null part, or an empty host, fit nothing. Rows are kept as often as they
    occur; other columns are not looked at.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    named = rules.filter("host is not null and path is not null and verdict is not null and host <> ''").select(
        lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"),
        F.col("verdict").alias("rule_verdict")).distinct()
    named = materialize(named.withColumn("key", F.concat("rule_host", "rule_path")), "url-rules")
    labels = sorted(r[0] for r in named.select(F.size(F.split("rule_host", r"\."))).distinct().collect())
    lengths = sorted(r[0] for r in named.select(F.length("rule_path")).distinct().collect())
    kept = lambda numbers: F.array(*map(F.lit, numbers)) if numbers else F.array().cast("array<int>")
    # Only numbers of labels and lengths of paths that rules have.
    parts = rows.select("host", "path").distinct().select("*", F.split("host", r"\.").alias("labels"))
    suffixes = F.transform(
        F.filter(kept(labels), lambda n: n <= F.size("labels")),
        lambda n: F.array_join(F.slice("labels", F.size("labels") - n + 1, n), "."))
    starts = F.transform(
        F.filter(kept(lengths), lambda n: n <= F.length("path")), lambda n: F.left("path", n))
    keys = parts.select("host", "path", F.explode(suffixes).alias("suffix"), starts.alias("starts")).select(
        "host", "path", "suffix", F.explode("starts").alias("start")).select(
        "host", "path", F.concat("suffix", "start").alias("key"))
    bloom, blocks = bloom_filter(named.select("key").distinct())
    hits = possible(keys, small(bloom), blocks).join(small(named), "key")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(
        F.length("key").alias("n"), F.length("rule_host").alias("m"),
        (F.col("rule_verdict") == "block").alias("block"), F.col("key").alias("rule"))).alias("best"))
    return rows.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.when(F.col("best").isNull(), F.lit(default)).when(F.col("best.block"), "block").otherwise("allow").alias("verdict"))
