"""The control tables: creation, appends and updates by rewriting the runs concerned.

Built-in table formats have no keys, checks, identity columns or updates; the rules are the checks of
``operators.quality``, ids come from a number per append and ``operators.results.assign_ids``, and an update writes the new
rows of the runs it touches to a shared table first and then replaces those partitions.
"""

from pyspark.sql import functions as F

from metadoc.operators.results import as_results, assign_ids, latest_executions, replace_by_key
from metadoc.runtime import materialize, reserve_number

# --- fixed values: names and descriptions of the control tables -----------------------------

SCHEMA_COMMENT = "Esquema para generación automática de comentarios usando IA"
EXECUTION_EVENTS = "ejecuciones_eventos"
EXECUTIONS = "ejecuciones"
RESULTS = "resultados"
GOLDEN = "golden_set_comentarios"

TABLES = {
    EXECUTION_EVENTS: (
        "Registro de cada ejecución del proceso de generación",
        (
            ("id_ejecucion", "STRING NOT NULL",
             "GUID de la ejecución — generado con uuid() al insertar"),
            ("fecha_ejecucion", "TIMESTAMP_NTZ", "Fecha y hora del cambio de estado"),
            ("estado", "VARCHAR(50)",
             "INICIADO, EN_PROCESO, COMPLETADO, COMPLETADO_CON_ERRORES, ERROR"),
            ("resultado", "VARCHAR(4000)", "Detalle del resultado final de la ejecución"),
            ("seq", "BIGINT", "Orden de los cambios dentro de la ejecución"),
        ),
        None,
    ),
    RESULTS: (
        "Comentarios generados por IA con flujo de revisión",
        (
            ("id_resultado", "BIGINT", "Identificador autoincrementable del resultado"),
            ("fecha_resultado", "TIMESTAMP_NTZ", "Fecha y hora en que se generó el comentario"),
            ("nombre_catalogo", "VARCHAR(255)", "Nombre del catálogo al que pertenece la tabla"),
            ("nombre_esquema", "VARCHAR(255)", "Nombre del esquema al que pertenece la tabla"),
            ("nombre_tabla", "VARCHAR(255)", "Nombre de la tabla procesada"),
            ("nombre_columna", "VARCHAR(255)",
             "Nombre de la columna para la que se generó el comentario"),
            ("comentario", "VARCHAR(4000)", "Comentario generado por IA para la columna"),
            ("status", "VARCHAR(20) DEFAULT 'aprobado'",
             "Estado de revisión: por revisar, aprobado, rechazado"),
            ("user_comments", "VARCHAR(4000)", "Comentarios del revisor (vacío por defecto)"),
            ("criterio_fallido", "STRING",
             "Identificador del criterio de calidad fallido (NULL si OK)"),
            ("detalles_criterio_fallido", "STRING", "Detalles del criterio fallido (NULL si OK)"),
            ("id_ejecucion", "STRING", "Referencia a la ejecución que generó este resultado"),
        ),
        "id_ejecucion",
    ),
    GOLDEN: (
        "Set de prueba curado para el bake-off de modelos fundacionales",
        (
            ("object_id", "STRING NOT NULL",
             "Identificador único del objeto (ej. catalogo.esquema.tabla.columna)"),
            ("object_level", "VARCHAR(20) NOT NULL", "Nivel del objeto: schema | table | column"),
            ("context_text", "STRING",
             "Contexto provisto al generador (insumos + metadata). Recomendado máx ~30K caracteres"),
            ("gold_comment", "STRING",
             "Comentario de referencia aprobado por experto (NULL si aún no existe; el juez evalúa "
             "contra contexto)"),
            ("domain", "VARCHAR(255)",
             "Dominio de negocio (riesgos, finanzas, clientes, ...) para estratificar el set"),
            ("is_sensitive", "BOOLEAN", "Marca si el objeto involucra datos sensibles (PII)"),
        ),
        None,
    ),
}


def qualified(catalog, schema, table):
    return ".".join("`" + part.replace("`", "``") + "`" for part in (catalog, schema, table))


def _literal(text):
    return "'" + text.replace("\\", "\\\\").replace("'", "''") + "'"


def create_control_tables(spark, catalog, schema, using="parquet"):
    """Create schema, tables and the view of latest execution states; existing ones are kept."""
    place = qualified(catalog, schema, "").removesuffix(".``")
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {place} COMMENT {_literal(SCHEMA_COMMENT)}")
    for table, (comment, columns, partition) in TABLES.items():
        fields = ", ".join(f"{name} {kind} COMMENT {_literal(note)}" for name, kind, note in columns)
        layout = f" PARTITIONED BY ({partition})" if partition else ""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {qualified(catalog, schema, table)} ({fields}) "
            f"USING {using}{layout} COMMENT {_literal(comment)}"
        )
    spark.sql(
        f"CREATE VIEW IF NOT EXISTS {qualified(catalog, schema, EXECUTIONS)} AS "
        "SELECT id_ejecucion, last.* FROM (SELECT id_ejecucion, "
        "max_by(struct(fecha_ejecucion, estado, resultado), struct(fecha_ejecucion, seq)) AS last "
        f"FROM {qualified(catalog, schema, EXECUTION_EVENTS)} GROUP BY id_ejecucion)"
    )


RESULT_CUT = " [...]"


def log_state(spark, events_table, execution_id, state, result, at, seq):
    """Append one state change of a run.

    The column holds 4,000 characters; a longer result ends with ``RESULT_CUT``, so that the cut shows.
    """
    if result is not None and len(result) > 4000:
        result = result[:4000 - len(RESULT_CUT)] + RESULT_CUT
    row = spark.range(1).select(
        F.lit(execution_id).alias("id_ejecucion"), F.lit(at).cast("timestamp_ntz").alias("fecha_ejecucion"),
        F.lit(state).alias("estado"), F.lit(result).cast("string").alias("resultado"),
        F.lit(seq).cast("long").alias("seq"),
    )
    _insert(row, spark, events_table)


def _insert(rows, spark, table, overwrite=False):
    columns = spark.table(table).columns
    rows.select(*columns).write.insertInto(table, overwrite=overwrite)


#: Ids are run number times this, plus position: two appends never meet, however they interleave.
IDS_PER_RUN = 1 << 32


def table_location(spark, table):
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'Location'").select("data_type")
    return rows.first()[0].rstrip("/")


def reserve_ids(spark, table, key="id_resultado"):
    """Where the ids of one append to ``table`` begin; no other append gets an id of this range.

    The numbers of appends lie in a folder beside the table. The highest id in the table is asked for only
    to stay above ids that were given before there was such a folder.
    """
    log = f"{table_location(spark, table)}-appends"
    highest = spark.table(table).agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    return reserve_number(spark, log, highest // IDS_PER_RUN + 1 if highest else 0) * IDS_PER_RUN


def append_results(spark, table, rows, start=None):
    """Give the rows ids of a range of their own (see ``reserve_ids``) and append them in one write."""
    numbered = assign_ids(rows, "id_resultado", start=reserve_ids(spark, table) if start is None else start)
    _insert(as_results(numbered), spark, table)
    return numbered


def update_results(spark, table, changes, columns):
    """Replace ``columns`` by ``id_resultado``; only the partitions of runs concerned are rewritten.

    The new rows are written to a shared table before the partitions are replaced.
    """
    stored = spark.table(table)
    runs = stored.join(changes.select("id_resultado"), "id_resultado", "left_semi").select(
        "id_ejecucion"
    ).distinct()
    rows = stored.join(runs.withColumnRenamed("id_ejecucion", "run"),
                       F.col("id_ejecucion").eqNullSafe(F.col("run")), "left_semi")
    fresh = materialize(replace_by_key(rows, changes, "id_resultado", columns), "results")
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        _insert(fresh, spark, table, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
    spark.catalog.refreshTable(table)


def executions(spark, events_table):
    return latest_executions(spark.table(events_table))
