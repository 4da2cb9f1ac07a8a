"""Verdicts of an auditor on stored comments."""

from pyspark.sql import functions as F

from metadoc import fixed_values as fv
from metadoc.functions.answers import with_audit_verdict
from metadoc.operators.prompts import audit_prompt
from metadoc.operators.relevance import contexts, with_context
from metadoc.operators.results import level_of


def criteria_frame(spark):
    """The criteria ids as a dimension of a handful of rows."""
    return spark.createDataFrame([(name,) for name, _ in fv.CRITERIA], "criterio string")


def claimed_verdicts(answers, raw="text"):
    """Answers with ``ok``, ``criterio`` and ``detalles`` as the auditor claims them."""
    return with_audit_verdict(answers, raw)


def known_failures(claimed, criteria):
    """Failures whose criterion is in the catalogue."""
    return claimed.filter(~F.col("ok")).join(F.broadcast(criteria), "criterio", "left_semi")


def unknown_failures(claimed, criteria):
    """Failures with a criterion outside the catalogue, or with none: they are not counted."""
    return claimed.filter(~F.col("ok")).join(F.broadcast(criteria), "criterio", "left_anti")


def settled_verdicts(claimed, criteria):
    """A failure stands only with a criterion of the catalogue; everything else is fine."""
    known = F.broadcast(criteria.withColumn("known", F.lit(True)))
    joined = claimed.join(known, "criterio", "left")
    stands = F.coalesce(~F.col("ok") & F.col("known"), F.lit(False))
    kept = [name for name in claimed.columns if name not in ("ok", "criterio", "detalles")]
    return joined.select(
        *kept, (~stands).alias("ok"),
        F.when(stands, F.col("criterio")).alias("criterio"),
        F.when(stands, F.col("detalles")).alias("detalles"),
    )


def as_update(verdicts):
    return verdicts.select(
        "id_resultado", F.col("criterio").alias("criterio_fallido"),
        F.col("detalles").alias("detalles_criterio_fallido"),
    )


def audit_objects(results):
    """Results with their level and the schema and table names their context is built for."""
    rows = level_of(results)
    return rows.withColumns({
        "schema_name": F.coalesce("nombre_esquema", F.lit("")),
        "table_name": F.when(F.col("level") == "schema", "").otherwise(
            F.coalesce("nombre_tabla", F.lit(""))
        ),
    })


def audit_prompts(results, sources, manifests, max_chars=fv.MAX_CONTEXT_CHARS):
    """(id_resultado, prompt): contexts are built once per distinct object, not per row."""
    rows = audit_objects(results)
    packed = contexts(sources, rows, fv.AUDITOR_KEYWORDS, max_chars)
    return with_context(rows, packed).select("id_resultado", audit_prompt(manifests).alias("prompt"))


def audit_totals(verdicts, errors=None):
    """One row: total, ok, observed and errors."""
    failed = F.lit(0).cast("long") if errors is None else F.coalesce(F.sum(errors), F.lit(0))
    fine = F.col("ok") if errors is None else F.col("ok") & (errors == 0)
    seen = ~F.col("ok") if errors is None else ~F.col("ok") & (errors == 0)
    return verdicts.agg(
        F.count("*").alias("total"), F.count(F.when(fine, 1)).alias("ok_rows"),
        F.count(F.when(seen, 1)).alias("observed"), failed.alias("errors"),
    )


def audit_by_criterion(verdicts):
    return (
        verdicts.filter(~F.col("ok")).groupBy("criterio").agg(F.count("*").alias("rows"))
        .orderBy(F.desc("rows"), "criterio")
    )
