"""Writing comments to the catalog: the statements are built by Spark, issued by the driver."""

import uuid

from pyspark.sql import functions as F

from metadoc.operators.review import apply_statements
from metadoc.runtime import in_order, materialize, shared_dir
from metadoc.sources.catalog import _in_batches

_OUTCOME = "level string, target string, error string"


def publish(spark, rows):
    """Issue the statement of every row; (level, target, error) per row, error null when published.

    Rows are streamed to the driver, the only place that can change the catalog, and outcomes are
    appended in batches, in the order of the rows. Several statements run at a time, but those on one table
    one after another, as each rewrites its entry. A statement that fails does not stop the others.
    """
    table = F.xxhash64("nombre_catalogo", "nombre_esquema", "nombre_tabla").alias("lane")
    statements = materialize(
        apply_statements(rows).select("level", "target", "statement", "error", table), "statements"
    )

    def issue(row):
        error = row["error"]
        if error is None:
            try:
                spark.sql(row["statement"])
            except Exception as problem:
                error = f"{row['target']}: {str(problem)[:200]}"
        return row["level"], row["target"], error

    outcomes = in_order(statements.toLocalIterator(), issue, lambda row: row["lane"])

    path = f"{shared_dir(spark)}/metadoc/published-{uuid.uuid4().hex}"
    spark.createDataFrame([], _OUTCOME).write.parquet(path)
    for batch in _in_batches(outcomes):
        spark.createDataFrame(batch, _OUTCOME).write.mode("append").parquet(path)
    return spark.read.schema(_OUTCOME).parquet(path)


def first_failures(outcomes, most):
    return outcomes.filter(F.col("error").isNotNull()).orderBy("target", "error").limit(most)
