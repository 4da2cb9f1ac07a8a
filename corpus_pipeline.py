"""From raw documents to packed training sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before kept. All but the
last return the columns of ``documents``.
"""

import public_tokenizers
from pyspark.sql import functions as F

from metadoc.llm import decontamination, packing, pii, quality, simhash
from metadoc.llm.shared import materialize, table


def classify(spark, docs, sf_dir):
    """Rejects what the classifier scores below 0.7; it learns from the labels of the documents given."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def deduplicate(spark, docs, sf_dir):
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.kept(docs)


def decontaminate(spark, docs, sf_dir):
    """Documents that contain passages of the benchmark go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redact(spark, docs, sf_dir):
    """Personal data in the texts give way to the names of their kinds."""
    found = pii.redacted(docs)
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in found.columns else found


def pack(spark, docs, sf_dir):
    """Token sequences of at most 2048 tokens: one row per piece of a document, with its ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", classify),
    ("SimHash near-dedup", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("PII", redact),
    ("packing", pack),
]

#: Training and tokenizing cannot be expressed in SQL; tests/llm compares with plain loops instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
