"""Indicators over results and executions, with the filters of a dashboard."""

from pyspark.sql import functions as F

from metadoc import fixed_values as fv


def filter_for_dashboard(results, executions=None, dates=None, catalog=None, schema=None,
                         tables=None, status=None):
    """Rows for the chosen filters; each is optional. ``dates`` is a (first, last) pair of dates of
    the execution, ``tables`` a list."""
    if dates:
        day = F.to_date("fecha_ejecucion")
        chosen = executions.filter((day >= F.lit(dates[0])) & (day <= F.lit(dates[1])))
        results = results.join(chosen.select("id_ejecucion"), "id_ejecucion", "left_semi")
    if catalog is not None:
        results = results.filter(F.col("nombre_catalogo") == catalog)
    if schema is not None:
        results = results.filter(F.col("nombre_esquema") == schema)
    if tables:
        results = results.filter(F.col("nombre_tabla").isin(*tables))
    if status is not None:
        results = results.filter(F.col("status") == status)
    return results


def kpis(results):
    """One row of totals.

    Rows are first reduced to one per run and table with its counts, so the distinct counts see few
    rows. Schemas and tables are counted within their catalog; the schema sentinel is no table.
    """
    def having(status):
        return F.count(F.when(F.col("status") == status, 1))

    small = results.groupBy(
        "id_ejecucion", "nombre_catalogo", "nombre_esquema", "nombre_tabla"
    ).agg(
        F.count("*").alias("comments"), having(fv.STATUS_APPROVED).alias("approved"),
        having(fv.STATUS_REVIEW).alias("to_review"), having(fv.STATUS_REJECTED).alias("rejected"),
    )
    schema = F.struct("nombre_catalogo", "nombre_esquema")
    table = F.struct("nombre_catalogo", "nombre_esquema", "nombre_tabla")
    named = F.col("nombre_catalogo").isNotNull() & F.col("nombre_esquema").isNotNull()
    is_table = named & (F.col("nombre_tabla") != fv.SCHEMA_SENTINEL)
    return small.agg(
        F.countDistinct("id_ejecucion").alias("executions"),
        F.coalesce(F.sum("comments"), F.lit(0)).alias("comments"),
        F.countDistinct("nombre_catalogo").alias("catalogs"),
        F.countDistinct(F.when(named, schema)).alias("schemas"),
        F.countDistinct(F.when(is_table, table)).alias("tables"),
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name)
          for name in ("approved", "to_review", "rejected")],
    )


def execution_history(executions):
    return executions.orderBy(F.desc("fecha_ejecucion"), "id_ejecucion")


def comment_detail(results):
    return results.select(
        "id_resultado", "id_ejecucion", "fecha_resultado", "nombre_catalogo", "nombre_esquema",
        "nombre_tabla", "nombre_columna", "comentario", "status", "user_comments",
        "criterio_fallido", "detalles_criterio_fallido",
    )
