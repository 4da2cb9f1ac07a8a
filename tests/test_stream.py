"""The stream gives what the batch gives, also after a replay and with later corrections."""

from pathlib import Path

from metadoc.runtime import shared_dir
from metadoc.schemas import RESULTS
from metadoc.streaming.audit_stream import current, flagged, result_stream, run_available, write_batches

COLUMNS = [f.name for f in RESULTS]


def rows(spark, ids, comment):
    return spark.createDataFrame([
        (i, "r", None, "c", "s", "t", "__tabla__", comment.format(i), "aprobado", None, None, None) for i in ids
    ], RESULTS)


def test_stream_equals_batch(spark, folder):
    landing, out, checkpoint = (str(folder / n) for n in ("landing", "out", "checkpoint"))
    rows(spark, range(50), "La casa {} de 12345678").write.mode("append").parquet(landing)
    stream = result_stream(spark, landing, RESULTS, maxFilesPerTrigger=1)
    run_available(write_batches(flagged(stream), out), checkpoint)
    rows(spark, range(40, 80), "otro {}").coalesce(1).write.mode("append").parquet(landing)
    run_available(write_batches(flagged(stream), out), checkpoint)
    run_available(write_batches(flagged(stream), out), checkpoint)
    got = {r["id_resultado"]: r for r in current(spark, out).collect()}
    assert set(got) == set(range(80))
    newest = rows(spark, range(40), "La casa {} de 12345678").unionByName(rows(spark, range(40, 80), "otro {}"))
    assert got == {r["id_resultado"]: r for r in flagged(newest).select(*current(spark, out).columns).collect()}


def test_replayed_batch_changes_nothing(spark, folder):
    landing, out = str(folder / "landing"), str(folder / "out")
    rows(spark, range(30), "para {}").write.parquet(landing)
    stream = flagged(result_stream(spark, landing, RESULTS))
    run_available(write_batches(stream, out), str(folder / "first"))
    before = sorted(map(tuple, current(spark, out).collect()))
    run_available(write_batches(stream, out), str(folder / "again"))  # no memory of the first run
    assert sorted(map(tuple, current(spark, out).collect())) == before


def test_verdicts_on_a_stream(spark, folder):
    from metadoc.plans.audit import audit

    def auditor(prompts):
        import pandas as pd

        return pd.DataFrame({"text": ['{"ok": false, "criterio": "GRANULARIDAD"}' if "malo" in p else "" for p in prompts]})

    sources = spark.createDataFrame([(1, "a.md", "Reglas", "texto", "archivo")],
                                    "ord long, name string, description string, content string, kind string")
    landing, out = str(folder / "landing"), str(folder / "out")
    rows(spark, range(5), "bueno {}").write.mode("append").parquet(landing)
    rows(spark, range(5, 9), "malo {}").write.mode("append").parquet(landing)
    stream = result_stream(spark, landing, RESULTS)
    run_available(write_batches(stream, out, lambda batch: audit(spark, batch, sources, auditor, ["a.md"])),
                  str(folder / "checkpoint"))
    got = {r["id_resultado"]: r["criterio"] for r in current(spark, out).collect()}
    assert got == {i: ("GRANULARIDAD" if i > 4 else None) for i in range(9)}


def test_landing_files_follow_the_splits_of_the_table(spark, folder):
    """A fixed number of files made each task read a fixed share of all texts."""
    from checks.queries import QUERIES

    texts = spark.range(4_000).selectExpr("id AS doc_id", "concat_ws(' ', md5(string(id)), md5(string(-id))) AS text")
    texts.coalesce(1).write.parquet(str(folder / "documents.parquet"))
    shared = Path(shared_dir(spark).removeprefix("file:")) / "metadoc"
    seen, before = set(shared.glob("stream-*")), spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        splits = spark.read.parquet(str(folder / "documents.parquet")).rdd.getNumPartitions()
        got = QUERIES["stream_flags"](spark, str(folder)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r["id_resultado"] for r in got) == list(range(4_000))
    written, = set(shared.glob("stream-*")) - seen
    assert splits > 4 and len(list((written / "landing").glob("*.parquet"))) == 4 * splits
    # Three batches in the base, one open.
    assert len(list((written / "flags" / "delta").iterdir())) == 4
    assert [p.name for p in (written / "flags" / "base").iterdir()] == ["0"]
