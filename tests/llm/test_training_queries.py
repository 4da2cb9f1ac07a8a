"""The registered queries against their SQL; the pipeline against a plain version of its decisions."""

import pytest

import corpus_pipeline
from checks.compare import compare, connect
from metadoc.llm import quality, simhash
from metadoc.llm.queries import QUERIES, SQL
from tests_llm_plain import plain_overlap


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    assert compare(QUERIES[name](spark, sf_dir), connect(sf_dir), SQL[name]) == ""


def test_one_query_per_operator():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    frame = lambda rows: spark.createDataFrame(rows, spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    model = quality.fit(frame(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = {r.doc_id for r in quality.score(frame(docs), model).collect() if r.predicted == 1}
    good = corpus_pipeline.classify(spark, frame(docs), sf_dir).toPandas()
    assert set(good.doc_id) == scored and list(good.columns) == list(docs.columns)

    found = simhash.near_duplicates(frame(good)).toPandas()
    single = corpus_pipeline.deduplicate(spark, frame(good), sf_dir).toPandas()
    assert set(single.doc_id) == set(found.component_id)

    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").toPandas()
    fresh = corpus_pipeline.decontaminate(spark, frame(single), sf_dir).toPandas()
    bad = {d for d, t in zip(single.doc_id, single.text) if any(plain_overlap(t, i) for i in items.text)}
    assert set(fresh.doc_id) == set(single.doc_id) - bad

    clean = corpus_pipeline.redact(spark, frame(fresh), sf_dir).toPandas()
    assert set(clean.doc_id) == set(fresh.doc_id) and not clean.text.str.contains(r"[a-z0-9]@[a-z0-9]+\.[a-z]").any()
    assert (clean.n_chars == clean.text.map(len)).all()

    packed = corpus_pipeline.pack(spark, frame(clean), sf_dir).toPandas()
    assert set(packed.doc_id) == set(clean.doc_id)
    whole = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert sorted(zip(whole.doc_id, whole.start, whole.ids_crc32)) == sorted(zip(packed.doc_id, packed.start, packed.ids_crc32))
