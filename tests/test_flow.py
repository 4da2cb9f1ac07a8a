"""A whole pass on a scratch catalog: generate, audit, review, publish."""

import pytest
from pyspark.sql import functions as F

from metadoc import fixed_values as fv
from metadoc.config import AuditConfig, GenerationConfig
from metadoc.operators.kpis import comment_detail, execution_history, kpis
from metadoc.operators.responses import ask
from metadoc.operators.results import filter_results, snapshot_changes
from metadoc.operators.review import apply_review, review_where
from metadoc.plans import audit as audit_plan
from metadoc.plans import generation, publication
from metadoc.sinks.catalog import first_failures
from metadoc.sinks.control_tables import create_control_tables, executions, log_state, update_results

CONTROL = "spark_catalog.control_flow"
RESULTS, EVENTS = f"{CONTROL}.resultados", f"{CONTROL}.ejecuciones_eventos"
SOURCE_TYPE = "ord long, name string, description string, content string, kind string"


def writer(prompts):
    """Answers with the object the prompt asks about, and fails for one column."""
    import re

    import pandas as pd

    rows = []
    for prompt in prompts:
        found = re.search(r"- (Esquema|Columna|Tabla)\s*: (\S+)\n(?:- Columna: (\S+))?", prompt)
        kind, name, column = found.groups()
        if column == "secreto":
            raise ValueError("no permitido")
        rows.append({"text": f"  La definición de {column or name}. It's \\ok ", "latency_ms": 5.0,
                     "tokens_in": len(prompt), "tokens_out": 9, "error": None})
    return pd.DataFrame(rows)


def auditor(prompts):
    import pandas as pd

    def verdict(prompt):
        if "Nivel  : tabla" in prompt:
            return '{"ok": false, "criterio": "GRANULARIDAD", "detalles": "nivel"}'
        return '```json\n{"ok": true}\n```'

    return pd.DataFrame({"text": [verdict(p) for p in prompts]})


@pytest.fixture(scope="module")
def control(spark):
    create_control_tables(spark, "spark_catalog", "control_flow")
    create_control_tables(spark, "spark_catalog", "control_flow")
    for schema in ("ventas", "compras"):
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
        for table in ("facturas", "lineas", "notas"):
            spark.sql(f"CREATE TABLE IF NOT EXISTS {schema}.{table} (id INT, secreto STRING, fecha DATE) "
                      "USING parquet PARTITIONED BY (fecha)")
    spark.sql("COMMENT ON SCHEMA ventas IS 'Esquema comercial'")
    spark.sql("COMMENT ON TABLE ventas.notas IS 'Notas previas'")
    spark.sql("INSERT INTO ventas.facturas VALUES (1, 'x', DATE'2026-01-01'), (2, 'y', DATE'2026-01-02')")
    scope = [("spark_catalog", s, t, 1) for s in ("ventas", " compras ") for t in ("facturas", "lineas", "notas")]
    scope += [("spark_catalog", "ventas", "no_existe", 2), (None, "a", "b", 3), ("spark_catalog", "ventas", " ", 4),
              ("spark_catalog", "ventas", "lineas ", 5), ("spark_catalog", "vacio", "t", 6)]
    spark.createDataFrame(scope, "catalogo string, esquema string, tabla string, prioridad int").write.mode(
        "overwrite").saveAsTable(f"{CONTROL}.alcance")
    return CONTROL


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([
        (1, "reglas.md", "Reglas de negocio", "texto sobre ventas y facturas", "archivo"),
        (2, "a.b.c", "Glosario", "compras", "tabla"),
    ], SOURCE_TYPE)


CONFIG = dict(scope_table=f"{CONTROL}.alcance", catalog_column="catalogo", schema_column="esquema",
              table_column="tabla", sampling=True)


@pytest.fixture(scope="module")
def done(spark, control, sources):
    return generation.run(spark, GenerationConfig(**CONFIG), sources, writer, EVENTS, RESULTS)


def test_results(spark, done):
    rows = spark.table(RESULTS).filter(F.col("id_ejecucion") == done.execution_id)
    names = {(r["nombre_esquema"], r["nombre_tabla"], r["nombre_columna"]) for r in rows.collect()}
    wanted = set()
    for schema in ("ventas", "compras"):
        wanted.add((schema, "__esquema__", "__esquema__"))
        for table in ("facturas", "lineas", "notas"):
            wanted |= {(schema, table, c) for c in ("__tabla__", "id", "fecha")}
    assert names == wanted and rows.count() == len(wanted)
    assert {r["comentario"] for r in rows.filter("nombre_columna = 'id'").collect()} == {
        "La definición de id. It's \\ok"}
    ids = [r["id_resultado"] for r in rows.collect()]
    assert len(set(ids)) == len(ids) and min(ids) >= 1
    assert {tuple(r) for r in rows.select("status", "user_comments", "criterio_fallido").distinct().collect()} == {
        ("aprobado", None, None)}


def test_run_is_logged(spark, done):
    last = executions(spark, EVENTS).filter(F.col("id_ejecucion") == done.execution_id).first()
    assert last["estado"] == "COMPLETADO_CON_ERRORES"
    assert last["resultado"].startswith(
        "Completado con 6 error(es). Esquemas: 2/3. Tablas: 6/8. Columnas: 12. Errores: "
        "spark_catalog.compras.facturas.secreto: no permitido; ")
    assert last["resultado"].count("no permitido") == 5
    view = spark.table(f"{CONTROL}.ejecuciones").filter(F.col("id_ejecucion") == done.execution_id).first()
    assert view["estado"] == last["estado"]


def test_missing_tables_are_reported(done):
    assert {(r["schema_name"], r["table_name"]) for r in done.missing.collect()} == {
        ("ventas", "no_existe"), ("vacio", "t")}


def test_rerun_asks_only_what_failed(spark, control, sources, folder):
    answers = str(folder / "answers")
    objects = spark.createDataFrame([(i,) for i in range(20)], "k int")

    def build(rows):
        return rows.withColumn("prompt", F.concat(F.lit("p"), (F.col("k") % 10).cast("string")))

    def half(prompts):
        import pandas as pd

        return pd.DataFrame({"text": [p if int(p[1:]) < 5 else None for p in prompts],
                             "error": [None if int(p[1:]) < 5 else "x" for p in prompts]})

    def late(prompts):
        import pandas as pd

        return pd.DataFrame({"text": [f"late {p}" for p in prompts]})

    first = ask(objects, ["k"], build, half, answers)
    assert first.filter("error IS NOT NULL").count() == 10 and first.count() == 20
    assert spark.read.parquet(answers).count() == 10
    again = {r["k"]: r["text"] for r in ask(objects, ["k"], build, late, answers).collect()}
    assert again == {k: (f"p{k % 10}" if k % 10 < 5 else f"late p{k % 10}") for k in range(20)}


def test_audit_twice_gives_the_same(spark, done, sources):
    config = AuditConfig(execution_id=done.execution_id)
    before = spark.table(RESULTS).count()
    verdicts, totals, by_criterion = audit_plan.run(spark, RESULTS, sources, auditor, ["general.md"], config)
    assert totals.first()["observed"] == 6 and totals.first()["ok_rows"] == 14
    assert [tuple(r) for r in by_criterion.collect()] == [("GRANULARIDAD", 6)]

    def failed():
        spark.catalog.refreshTable(RESULTS)
        return sorted((r["nombre_esquema"], r["nombre_tabla"], r["nombre_columna"], r["detalles_criterio_fallido"])
                      for r in spark.table(RESULTS).filter("criterio_fallido = 'GRANULARIDAD'").collect())

    once = failed()
    assert len(once) == 6 and all(c == "__tabla__" and d == "nivel" for _, _, c, d in once)
    audit_plan.run(spark, RESULTS, sources, auditor, ["general.md"], config)
    assert failed() == once and spark.table(RESULTS).count() == before

    def lenient(prompts):
        import pandas as pd

        return pd.DataFrame({"text": ["" for _ in prompts]})

    audit_plan.run(spark, RESULTS, sources, lenient, ["general.md"], config)
    assert failed() == []


def test_review_and_publication(spark, done):
    stored = filter_results(spark.table(RESULTS), done.execution_id)
    reviewed = review_where(
        stored, F.col("nombre_tabla") == "lineas", fv.STATUS_REVIEW, "pendiente")
    update_results(spark, RESULTS, reviewed.filter("status <> 'aprobado'"), ("status", "user_comments"))
    stored = filter_results(spark.table(RESULTS), done.execution_id)
    assert stored.filter("status = 'por revisar' AND user_comments = 'pendiente'").count() == 6
    outcomes, counts = publication.run(spark, spark.table(RESULTS), done.execution_id)
    # The built-in catalog refuses comments on partition columns: four rows fail, the others are done.
    assert tuple(counts.first()) == (2, 4, 4, 10, 4)
    described = {r["col_name"]: r for r in spark.sql("DESCRIBE TABLE EXTENDED ventas.facturas").collect()}
    assert described["id"]["comment"] == "La definición de id. It's \\ok"
    assert described["Comment"]["data_type"] == "La definición de facturas. It's \\ok"
    schema = {r[0]: r[1] for r in spark.sql("DESCRIBE SCHEMA EXTENDED ventas").collect()}
    assert schema["Comment"] == "La definición de ventas. It's \\ok"
    line = {r["col_name"]: r for r in spark.sql("DESCRIBE TABLE EXTENDED ventas.lineas").collect()}
    assert line["id"]["comment"] is None


def test_publication_errors_do_not_stop(spark):
    rows = spark.createDataFrame([
        (1, "r", None, None, "s", "t", "c", "x", "aprobado"),
        (2, "r", None, "spark_catalog", "ventas", "no_existe", "__tabla__", "x", "aprobado"),
        (3, "r", None, "spark_catalog", "ventas", "notas", "__tabla__", "nuevo", "aprobado"),
        (4, "r", None, "spark_catalog", "ventas", "notas", "__tabla__", "viejo", "rechazado"),
    ], "id_resultado long, id_ejecucion string, fecha_resultado timestamp_ntz, nombre_catalogo string, "
       "nombre_esquema string, nombre_tabla string, nombre_columna string, comentario string, status string")
    spark.sql("CREATE SCHEMA IF NOT EXISTS ventas")
    spark.sql("CREATE TABLE IF NOT EXISTS ventas.notas (id INT) USING parquet")
    outcomes, counts = publication.run(spark, rows)
    assert tuple(counts.first()) == (0, 1, 0, 1, 2)
    errors = sorted(r["error"] for r in outcomes.filter("error IS NOT NULL").collect())
    assert errors[0] == "Fila sin nombre_catalogo (esquema=s, tabla=t, columna=c): se omite"
    assert errors[1].startswith("tabla spark_catalog.ventas.no_existe: ")
    assert first_failures(outcomes, 1).count() == 1
    assert first_failures(outcomes, fv.PRINTED_ERRORS).count() == 2


def test_failed_run_is_logged(spark, control, sources):
    empty = f"{CONTROL}.alcance_vacio"
    spark.table(f"{CONTROL}.alcance").filter("false").write.mode("overwrite").saveAsTable(empty)
    with pytest.raises(ValueError):
        generation.run(spark, GenerationConfig(**{**CONFIG, "scope_table": empty}), sources, writer, EVENTS, RESULTS)
    assert executions(spark, EVENTS).filter("estado = 'ERROR'").count() >= 1


def test_all_fine_summary(spark, control, sources):
    def fine(prompts):
        import pandas as pd

        return pd.DataFrame({"text": ["La definición" for _ in prompts]})

    config = GenerationConfig(**{**CONFIG, "sampling": False})
    made = generation.generate(spark, config, sources, fine)
    row = made.summary.first()
    assert row["estado"] == "COMPLETADO"
    assert row["resultado"] == ("Exitoso. 2 esquema(s), 6 tabla(s) y 18 columna(s) documentadas desde scope "
                                f"'{CONTROL}.alcance'.")


def test_nothing_accessible(spark, control, sources):
    spark.createDataFrame([("spark_catalog", "nada", "t")], "catalogo string, esquema string, tabla string").write\
        .mode("overwrite").saveAsTable(f"{CONTROL}.alcance_nada")
    config = GenerationConfig(**{**CONFIG, "scope_table": f"{CONTROL}.alcance_nada"})
    done = generation.run(spark, config, sources, writer, EVENTS, RESULTS)
    last = executions(spark, EVENTS).filter(F.col("id_ejecucion") == done.execution_id).first()
    assert (last["estado"], last["resultado"][:50]) == (
        "COMPLETADO", "Exitoso. 0 esquema(s), 0 tabla(s) y 0 columna(s) d")
    states = [r["estado"] for r in spark.table(EVENTS).filter(F.col("id_ejecucion") == done.execution_id)
              .orderBy("seq").collect()]
    assert states == ["INICIADO", "EN_PROCESO", "EN_PROCESO", "EN_PROCESO", "COMPLETADO"]


def test_kpis_and_views(spark, done):
    row = kpis(filter_results(spark.table(RESULTS), done.execution_id)).first()
    assert (row["executions"], row["comments"], row["catalogs"], row["schemas"], row["tables"]) == (1, 20, 1, 2, 6)
    assert comment_detail(spark.table(RESULTS)).columns[0] == "id_resultado"
    assert execution_history(executions(spark, EVENTS)).count() >= 1


def test_changes(spark, done):
    old = filter_results(spark.table(RESULTS), done.execution_id)
    first = old.agg(F.min("id_resultado")).first()[0]
    decisions = spark.createDataFrame(
        [(first, "rechazado", None), (first + 1, "desconocido", "n")], "id_resultado long, status string, user_comments string")
    changes = snapshot_changes(old, apply_review(old, decisions)).collect()
    assert [(c["id_resultado"], c["change"], c["status"]) for c in changes] == [(first, "update", "rechazado")]


def test_log_keeps_the_latest_state(spark, control):
    for seq, state in enumerate(("INICIADO", "EN_PROCESO", "COMPLETADO")):
        log_state(spark, EVENTS, "e-1", state, None, "2026-01-01 00:00:00", seq)
    assert executions(spark, EVENTS).filter("id_ejecucion = 'e-1'").first()["estado"] == "COMPLETADO"
