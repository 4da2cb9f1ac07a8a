"""Auditing stored comments: one prompt per row, one update for all verdicts."""

from pyspark.sql import functions as F

from metadoc import fixed_values as fv
from metadoc.operators.audit import (
    as_update, audit_by_criterion, audit_objects, audit_totals, claimed_verdicts, criteria_frame,
    settled_verdicts,
)
from metadoc.operators.prompts import audit_prompt
from metadoc.operators.relevance import contexts, stored, with_context
from metadoc.operators.responses import ask
from metadoc.operators.results import filter_results
from metadoc.runtime import materialize
from metadoc.sinks.control_tables import update_results

VERDICT_COLUMNS = ("criterio_fallido", "detalles_criterio_fallido")


def audit(spark, results, sources, responder, manifests, config=None, answers_path=None,
          concurrency=None):
    """Verdict per chosen result row; a failed call counts as fine, as an unreadable answer does."""
    chosen = results if config is None else filter_results(
        results, config.execution_id, config.only_approved
    )
    rows = audit_objects(chosen)
    packed = stored(contexts(sources, rows, fv.AUDITOR_KEYWORDS))

    def build(part):
        return with_context(part, packed).withColumn("prompt", audit_prompt(manifests))

    answers = ask(rows, ["id_resultado"], build, responder, answers_path, concurrency, kind="audit")
    answers = answers.withColumn("text", F.when(F.col("error").isNull(), F.col("text")))
    claimed = claimed_verdicts(answers.select("id_resultado", "text"))
    return materialize(
        settled_verdicts(claimed, criteria_frame(spark)).drop("text"), "verdicts"
    )


def run(spark, results_table, sources, responder, manifests, config=None, answers_path=None,
        concurrency=None):
    """``audit`` plus the update of the results table; (verdicts, totals, by criterion)."""
    stored = spark.table(results_table)
    verdicts = audit(spark, stored, sources, responder, manifests, config, answers_path, concurrency)
    update_results(spark, results_table, as_update(verdicts), VERDICT_COLUMNS)
    return verdicts, audit_totals(verdicts), audit_by_criterion(verdicts)
