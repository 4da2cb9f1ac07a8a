"""What the catalog says about schemas, tables and columns.

Only the driver can ask the catalog, so the reading loops run there: they stream the names, ask for
several at a time, hold one batch of answers and append it to a shared table. Everything after that is a
DataFrame.
"""

import uuid
from itertools import chain

from pyspark.sql import functions as F

from metadoc import schemas
from metadoc.functions.text import or_empty, strip
from metadoc.runtime import in_order, shared_dir
from metadoc.sources.scope import TARGET

BATCH = 1_000


def _quoted(*parts):
    return ".".join("`" + part.replace("`", "``") + "`" for part in parts)


def _append_batches(spark, batches, schema, label):
    path = f"{shared_dir(spark)}/metadoc/{label}-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(path)
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _in_batches(rows, size=BATCH):
    batch = []
    for row in rows:
        batch.append(row)
        if len(batch) >= size:
            yield batch
            batch = []
    if batch:
        yield batch


def read_describe(spark, targets):
    """DESCRIBE rows of every readable table of ``targets``; unreadable tables give no rows."""

    def ask(target):
        try:
            found = spark.sql(f"DESCRIBE TABLE EXTENDED {_quoted(*target)}").collect()
        except Exception:  # not found or not allowed: reported by missing_tables
            return []
        return [(*target, pos, row["col_name"], row["data_type"]) for pos, row in enumerate(found)]

    rows = chain.from_iterable(in_order(targets.select(*TARGET).toLocalIterator(), ask))
    return _append_batches(spark, _in_batches(rows), schemas.DESCRIBE_ROWS, "describe")


def read_schema_comments(spark, schema_names):
    """Current comment of every schema, '' when it has none or cannot be read."""
    schema = "catalog_name string, schema_name string, schema_comment string"

    def ask(target):
        try:
            found = spark.sql(f"DESCRIBE SCHEMA EXTENDED {_quoted(*target)}").collect()
        except Exception:
            found = []
        return (*target, next(((row[1] or "").strip() for row in found if (row[0] or "").strip() == "Comment"), ""))

    rows = in_order(schema_names.select(*TARGET[:2]).toLocalIterator(), ask)
    return _append_batches(spark, _in_batches(rows), schema, "schema-comments")


def described_columns(rows):
    """Columns and table comment out of stacked DESCRIBE rows.

    Columns end at the first blank or ``#`` row; the comment is the last ``Comment`` row after it.
    """
    name, value = strip(or_empty(F.col("col_name"))), strip(or_empty(F.col("data_type")))
    rows = rows.select(*TARGET, "pos", name.alias("col_name"), value.alias("data_type"))
    ends = (F.col("col_name") == "") | F.col("col_name").startswith("#")
    last_comment = F.max(
        F.when(F.col("col_name") == "Comment", F.struct("pos", "data_type"))
    )
    cuts = rows.groupBy(*TARGET).agg(
        F.min(F.when(ends, F.col("pos"))).alias("cut"), last_comment.alias("last")
    )
    comment = F.when(F.col("last.pos") > F.col("cut"), F.col("last.data_type"))
    return (
        rows.join(cuts, [*TARGET])
        .filter(F.col("cut").isNull() | (F.col("pos") < F.col("cut")))
        .select(
            *TARGET, F.col("pos").alias("position"), F.col("col_name").alias("column_name"),
            "data_type", or_empty(comment).alias("table_comment"),
        )
    )


def found_columns(targets, columns):
    """Columns of the tables in scope."""
    return columns.join(targets, [*TARGET], "left_semi")


def missing_tables(targets, columns):
    """Tables in scope that were not found."""
    return targets.join(columns.select(*TARGET).distinct(), [*TARGET], "left_anti")


def columns_per_schema(columns):
    """Tables and columns found per schema; counted per table first."""
    per_table = columns.groupBy(*TARGET).agg(F.count("*").alias("columns"))
    return per_table.groupBy("catalog_name", "schema_name").agg(
        F.count("*").alias("tables"), F.sum("columns").alias("columns")
    )
