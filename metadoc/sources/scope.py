"""The scope: which tables are to be documented."""

from pyspark.sql import functions as F

from metadoc.functions.text import strip

TARGET = ("catalog_name", "schema_name", "table_name")


def scope_targets(scope, catalog_column=TARGET[0], schema_column=TARGET[1], table_column=TARGET[2]):
    """Distinct trimmed triples without null or blank parts; other columns are ignored.

    Duplicates are dropped after trimming, so padded copies count once.
    """
    given = zip(TARGET, (catalog_column, schema_column, table_column))
    trimmed = scope.select(*[strip(F.col(f"`{column}`")).alias(name) for name, column in given])
    present = trimmed
    for name in TARGET:
        present = present.filter(F.col(name) != "")
    return present.dropDuplicates()


def ordered(targets):
    return targets.orderBy(*TARGET)


def schema_targets(targets):
    """Each schema once: one comment per catalog and schema."""
    return targets.select("catalog_name", "schema_name").distinct()


def scope_totals(targets):
    """One row: catalogs, schemas, tables. Counts level by level instead of three distinct sets."""
    per_schema = targets.groupBy("catalog_name", "schema_name").agg(F.count("*").alias("tables"))
    per_catalog = per_schema.groupBy("catalog_name").agg(
        F.count("*").alias("schemas"), F.sum("tables").alias("tables")
    )
    return per_catalog.agg(
        F.count("*").alias("catalogs"),
        F.coalesce(F.sum("schemas"), F.lit(0)).alias("schemas"),
        F.coalesce(F.sum("tables"), F.lit(0)).alias("tables"),
    )
