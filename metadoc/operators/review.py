"""Review decisions and the statements that publish approved comments."""

from pyspark.sql import functions as F

from metadoc import fixed_values as fv
from metadoc.functions.levels import object_level, target_label
from metadoc.functions.text import blank_to_null, or_empty, quote_name, quote_path, sql_string
from metadoc.operators.results import one_per_key

_NAMES = ("nombre_catalogo", "nombre_esquema", "nombre_tabla", "nombre_columna")


def apply_review(results, decisions, order_by=()):
    """Reviewers' decisions by ``id_resultado``: new status and, if given, a note.

    Decisions with a status outside the allowed ones change nothing. Of several decisions on a row the
    last by ``order_by`` counts, else the last in the order of status and note; ``results.conflicts``
    names such rows.
    """
    allowed = one_per_key(decisions.filter(F.col("status").isin(*fv.STATUSES)).select(
        "id_resultado", *dict.fromkeys(["status", "user_comments", *order_by])
    ), "id_resultado", order_by).select(
        "id_resultado", F.col("status").alias("new_status"), F.col("user_comments").alias("note")
    )
    joined = results.join(allowed, "id_resultado", "left")
    return joined.withColumns({
        "status": F.coalesce("new_status", "status"),
        "user_comments": F.coalesce("note", "user_comments"),
    }).select(*results.columns)


def review_where(results, condition, status, note=None):
    """The same status, and optionally note, for all rows that meet ``condition``."""
    if status not in fv.STATUSES:
        raise ValueError(f"unknown status {status!r}")
    changed = {"status": F.when(condition, status).otherwise(F.col("status"))}
    if note is not None:
        changed["user_comments"] = F.when(condition, note).otherwise(F.col("user_comments"))
    return results.withColumns(changed)


def with_level_and_target(rows):
    names = [F.col(name) for name in _NAMES]
    level = object_level(names[2], names[3])
    return rows.withColumns({
        "level": level,
        "target": target_label(level, *[F.coalesce(name, F.lit("None")) for name in names]),
    })


def apply_statements(rows):
    """(…, level, target, statement, error): the DDL that writes each comment to the catalog.

    Rows without a catalog have an error instead of a statement.
    """
    catalog, schema, table, column = (F.col(name) for name in _NAMES)
    text = sql_string(F.col("comentario"))
    level = F.col("level")
    statement = (
        F.when(level == "schema",
               F.concat(F.lit("COMMENT ON SCHEMA "), quote_path(catalog, schema), F.lit(" IS "), text))
        .when(level == "table",
              F.concat(F.lit("COMMENT ON TABLE "), quote_path(catalog, schema, table), F.lit(" IS "),
                       text))
        .otherwise(F.concat(
            F.lit("ALTER TABLE "), quote_path(catalog, schema, table), F.lit(" ALTER COLUMN "),
            quote_name(column), F.lit(" COMMENT "), text))
    )
    absent = blank_to_null(or_empty(catalog)).isNull()
    named = [F.coalesce(name, F.lit("None")) for name in (schema, table, column)]
    problem = F.concat(
        F.lit("Fila sin nombre_catalogo (esquema="), named[0], F.lit(", tabla="), named[1],
        F.lit(", columna="), named[2], F.lit("): se omite"),
    )
    return with_level_and_target(rows).withColumns({
        "statement": F.when(~absent, statement), "error": F.when(absent, problem),
    })


def applied_counts(outcomes):
    """One row: published schemas, tables and columns, and errors.

    ``outcomes`` has ``level`` and ``error`` (null when published).
    """
    fine = F.col("error").isNull()
    return outcomes.agg(
        *[F.count(F.when(fine & (F.col("level") == level), 1)).alias(name)
          for level, name in (("schema", "schemas"), ("table", "tables"), ("column", "columns"))],
        F.count(F.when(fine, 1)).alias("total"), F.count("error").alias("errors"),
    )
