"""Object levels, labels and limits."""

from pyspark.sql import functions as F

from metadoc import fixed_values as fv
from metadoc.functions.text import quote_path


def object_level(table, column):
    """Both sentinels make a schema; then the table sentinel; anything else is a column."""
    return (
        F.when((table == fv.SCHEMA_SENTINEL) & (column == fv.SCHEMA_SENTINEL), "schema")
        .when(column == fv.TABLE_SENTINEL, "table")
        .otherwise("column")
    )


def level_label(level):
    label = level
    for name, text in fv.LEVEL_LABELS.items():
        label = F.when(level == name, text).otherwise(label)
    return label


def level_limit(level, max_chars):
    """Longest comment for a level, never above ``max_chars``; unknown levels get ``max_chars``."""
    limit = F.lit(max_chars)
    for name, chars in fv.LEVEL_MAX_CHARS.items():
        limit = F.when(level == name, F.lit(min(chars, max_chars))).otherwise(limit)
    return limit


def _by_level(level, schema, table, column):
    return F.when(level == "schema", schema).when(level == "table", table).otherwise(column)


def target_label(level, catalog, schema, table, column):
    """``tabla c.s.t`` and the like, for messages."""
    path = _by_level(
        level,
        F.concat_ws(".", catalog, schema),
        F.concat_ws(".", catalog, schema, table),
        F.concat_ws(".", catalog, schema, table, column),
    )
    return F.concat(level_label(level), F.lit(" "), path)


def quoted_target(level, catalog, schema, table, column):
    """``Tabla `c`.`s`.`t``` and the like, for the audit prompt."""
    path = _by_level(
        level,
        quote_path(catalog, schema),
        quote_path(catalog, schema, table),
        quote_path(catalog, schema, table, column),
    )
    return F.concat(F.initcap(level_label(level)), F.lit(" "), path)
