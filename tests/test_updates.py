"""Updates by key never multiply rows; the stream keeps the newest version whatever the batches."""

import datetime

import pandas as pd

from metadoc.operators.evaluation import metrics_long
from metadoc.operators.responses import ask
from metadoc.operators.quality import rule_violations
from metadoc.operators.results import conflicts, latest_approved, latest_executions, replace_by_key, snapshot_changes
from metadoc.operators.review import apply_review
from metadoc.schemas import RESULTS
from metadoc.sources.tables import table_text
from metadoc.runtime import folders, in_order, reserve_number
from metadoc.sinks.control_tables import RESULTS as RESULTS_TABLE
from metadoc.sinks.control_tables import append_results, create_control_tables, reserve_ids
from metadoc.streaming.audit_stream import current, merge_deltas, result_stream, run_available, write_batches


def test_one_change_per_key(spark):
    rows = spark.createDataFrame([(1, "por revisar", "a"), (2, "por revisar", None)], "id_resultado long, status string, user_comments string")
    decisions = spark.createDataFrame(
        [(1, "aprobado", "x", 2), (1, "rechazado", None, 1), (1, "otro", "z", 9), (3, "aprobado", "y", 1)],
        "id_resultado long, status string, user_comments string, at int")
    assert sorted(map(tuple, apply_review(rows, decisions, ["at"]).collect())) == [(1, "aprobado", "x"), (2, "por revisar", None)]
    assert sorted(map(tuple, apply_review(rows, decisions).collect())) == [(1, "rechazado", "a"), (2, "por revisar", None)]
    assert [r.id_resultado for r in conflicts(decisions.drop("at"), "id_resultado").collect()] == [1]
    changes = spark.createDataFrame([(2, "n"), (2, "m"), (2, "m")], "id_resultado long, user_comments string")
    found = replace_by_key(rows, changes, "id_resultado", ["user_comments"]).collect()
    assert sorted((r.id_resultado, r.user_comments) for r in found) == [(1, "a"), (2, "n")]


def version(spark, day, comment):
    return spark.createDataFrame([(1, "r", datetime.datetime(2024, 1, day), "c", "s", "t", "col", comment, "aprobado", None, None, None)], RESULTS)


def test_newest_version_wins_after_a_replay(spark, folder):
    landing, out = str(folder / "landing"), str(folder / "out")
    for day in (1, 3, 2):
        version(spark, day, f"v{day}").write.mode("append").parquet(landing)
        run_available(write_batches(result_stream(spark, landing, RESULTS), out), str(folder / "first"))
    assert [r.comentario for r in current(spark, out).collect()] == ["v3"]
    version(spark, 9, "v9").write.mode("append").parquet(landing)
    # The checkpoint is lost: all versions come in one batch, beside the folders of the first run.
    run_available(write_batches(result_stream(spark, landing, RESULTS), out), str(folder / "again"))
    assert [r.comentario for r in current(spark, out).collect()] == ["v9"]


def test_answers_that_cannot_be_matched_are_errors(spark):
    objects = spark.createDataFrame([(i, f"p{i}") for i in range(3)], "id long, prompt string").coalesce(1)

    def short(prompts):
        return pd.DataFrame({"text": ["one"] * (1 if len(prompts) > 1 else 2)})

    found = ask(objects, ["id"], lambda part: part, short).collect()
    assert len(found) == 3 and all("answers for 1 prompts" in r.error and r.text is None for r in found)


def test_context_table_with_a_map(spark):
    table = spark.sql("SELECT id, map('k', id) AS m FROM range(3)")
    lines = table_text(table).first().content.split("\n")
    assert len(lines) == 4 and lines[0].startswith("id")


def test_metrics_keep_their_digits(spark):
    means = spark.createDataFrame([("m", 2, 1 / 3)], "model string, n_items long, quality double")
    found = {r.key: (r.value, r.number) for r in metrics_long(means, "e", {"a": 1}).collect()}
    assert found == {"a": ("1", None), "n_items": ("2", None), "quality": (None, 1 / 3)}


def approved(spark, *rows):
    at = lambda day: day and datetime.datetime(2024, 1, day)
    return spark.createDataFrame(
        [(i, "r", at(day), "c", "s", table, "col", text, "aprobado", None, None, None) for i, day, table, text in rows], RESULTS)


def test_one_comment_per_object_whatever_the_ids(spark):
    rows = approved(
        spark, (1, 1, "a", "old"), (1, 2, "a", "new"), (1, 1, "b", "other object"), (None, 1, "d", "no id"), (None, 2, "d", "no id, newer"),
        (7, None, "e", "no date"), (7, None, "e", "no date"), (8, 3, "f", "x"), (8, 3, "f", "y"), (9, 3, "f", "last"), (4, 5, None, "no table"), (3, 5, None, "less"))
    found = [(r.nombre_tabla, r.comentario) for r in latest_approved(rows).collect()]
    assert sorted(found, key=repr) == sorted([
        ("a", "new"), ("b", "other object"), ("d", "no id, newer"), ("e", "no date"), ("f", "last"), (None, "no table")], key=repr)


def test_latest_state_with_equal_and_missing_times(spark):
    events = spark.createDataFrame(
        [("a", None, "x", "1", 1), ("a", None, "y", "2", 2), ("b", None, "z", None, None), ("b", None, "z", None, None)],
        "id_ejecucion string, fecha_ejecucion timestamp_ntz, estado string, resultado string, seq long")
    assert sorted((r.id_ejecucion, r.estado) for r in latest_executions(events).collect()) == [("a", "y"), ("b", "z")]


def test_numbers_are_given_once(spark, folder):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(8) as pool:
        found = list(pool.map(lambda _: reserve_number(spark, str(folder / "numbers"), 5), range(40)))
    assert sorted(found) == list(range(5, 45))


def test_interleaved_appends_get_different_ids(spark):
    schema = f"ids_{abs(hash(str(spark)))}"
    create_control_tables(spark, "spark_catalog", schema)
    table = f"{schema}.{RESULTS_TABLE}"
    rows = approved(spark, *[(None, 1, "a", f"t{i}") for i in range(20)]).drop("id_resultado").repartition(3)
    # Both runs have read the table before either writes.
    first, second = reserve_ids(spark, table), reserve_ids(spark, table)
    append_results(spark, table, rows, second)
    append_results(spark, table, rows, first)
    append_results(spark, table, rows)
    ids = [r[0] for r in spark.table(table).select("id_resultado").collect()]
    assert len(ids) == len(set(ids)) == 60 and min(ids) >= 1
    spark.sql(f"DROP SCHEMA {schema} CASCADE")


def test_deltas_are_merged_and_replays_change_nothing(spark, folder):
    landing, out = str(folder / "landing"), str(folder / "out")
    rows = lambda day, ids: approved(spark, *[(i, day, "a", f"v{day} {i}") for i in ids])
    days = [(1, range(10)), (3, range(5)), (2, range(8)), (5, [9, 20]), (4, range(7, 12)), (None, [0, 30])]
    for day, ids in days:
        rows(day, ids).coalesce(1).write.mode("append").parquet(landing)
        run_available(write_batches(result_stream(spark, landing, RESULTS), out, merge_at=2), str(folder / "first"))
    want = {}
    for day, ids in days:
        for i in ids:
            want[i] = max(want.get(i, (0, "")), (day or 0, f"v{day} {i}"))
    state = lambda: {r.id_resultado: r.comentario for r in current(spark, out).collect()}
    assert state() == {i: text for i, (_, text) in want.items()}
    assert len(folders(spark, f"{out}/base", "covers")) <= 2 and len(folders(spark, f"{out}/delta")) <= 4
    for name in ("again", "and-again"):
        run_available(write_batches(result_stream(spark, landing, RESULTS, maxFilesPerTrigger=1), out, merge_at=3), str(folder / name))
        assert state() == {i: text for i, (_, text) in want.items()}
    # A base without its list of deltas was not finished.
    rows(9, [1]).write.parquet(f"{out}/base/99/rows")
    assert state() == {i: text for i, (_, text) in want.items()}
    merge_deltas(spark, out)
    assert state() == {i: text for i, (_, text) in want.items()}


def test_totals_come_with_the_violations(spark):
    rows = spark.createDataFrame(
        [("a", "table", "x" * 300), (None, None, "d"), ("b", "vista", None), ("c", "y" * 30, "z" * 256)], "object_id string, object_level string, domain string")
    found, totals = rule_violations(rows, "golden", "object_id")
    got = sorted(map(tuple, found.collect()), key=repr)
    assert got == sorted([
        ("a", "length", "domain", "300"), (None, "null", "object_id", None), (None, "null", "object_level", None),
        ("b", "domain", "object_level", "vista"), ("c", "domain", "object_level", "y" * 30), ("c", "length", "object_level", "30"),
        ("c", "length", "domain", "256")], key=repr)
    assert totals.get == {"rows": 4, "null": 2, "length": 3, "domain": 2}


def test_changes_tell_which_values_are_null(spark):
    kind = "id_resultado long, a string, b string"
    old = spark.createDataFrame([(1, None, "x"), (2, "same", None), (3, "gone", None), (4, "", None), (None, "n", "n")], kind)
    new = spark.createDataFrame([(1, "x", None), (2, "same", None), (4, None, ""), (5, "new", None)], kind)
    found = sorted(map(tuple, snapshot_changes(old, new).collect()), key=repr)
    assert found == sorted([(1, "update", "x", None), (4, "update", None, ""), (3, "delete", "gone", None), (5, "insert", "new", None),
                            (None, "delete", "n", "n")], key=repr)


def test_calls_run_side_by_side_and_answer_in_order():
    import threading
    import time

    running, most, by_lane, lock = 0, 0, {}, threading.Lock()

    def call(i):
        nonlocal running, most
        with lock:
            running, most = running + 1, max(most, running + 1)
            by_lane.setdefault(i % 5, []).append(i)
        time.sleep(0.02)
        with lock:
            running -= 1
        return i * i

    began = time.time()
    assert list(in_order(range(100), call, lanes=8)) == [i * i for i in range(100)]
    assert time.time() - began < 100 * 0.02 / 2 and 1 < most <= 8
    by_lane.clear()
    assert list(in_order(iter(range(60)), call, lambda i: i % 5, lanes=8, waiting=10)) == [i * i for i in range(60)]
    assert all(ids == sorted(ids) for ids in by_lane.values())
    begun = []
    stream = in_order(iter(range(1000)), lambda i: begun.append(i), lanes=4, waiting=10)
    next(stream)
    assert len(begun) <= 10
    stream.close()
