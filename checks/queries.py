"""Every registered query: the package's operators on frames derived from the given tables."""

import uuid

from pyspark.sql import functions as F

from checks.views import table, view
from metadoc import fixed_values as fv
from metadoc.functions.levels import level_label, level_limit
from metadoc.functions.relevance import static_score
from metadoc.functions.scorers import (
    deterministic_scores, flag, native_ratio, pii_card, pii_email, pii_long_number, style_flags,
)
from metadoc.functions.answers import with_judge_flags
from metadoc.functions.text import (
    file_extension, hint_columns, hint_tabs, is_three_part, row_text,
)
from metadoc.operators import audit, evaluation, kpis, prompts, quality, relevance, results
from metadoc.operators import responses, review, sampling
from metadoc.runtime import materialize, shared_dir
from metadoc.sinks.text_files import write_texts
from metadoc.sources import catalog, manifests, merge, scope, tables
from metadoc.sources.files import delimited_files, text_files
from metadoc.streaming.audit_stream import (
    current, flagged, result_stream, run_available, write_batches,
)

MODELS = ("click", "error", "purchase", "signup", "view")
PRICES = {"click": (3.0, 15.0), "purchase": (0.5, 2.0), "signup": (1.25, 10.0), "otro": (9.0, 9.0)}
MANIFESTS = ("general.md", "auditoria.md")
PRODUCT = "un catálogo de datos"
MAX_CHARS = 500

QUERIES = {}


def query(function):
    """Register under the function's name, without the ``query_`` that keeps it apart from an import."""
    QUERIES[function.__name__.removeprefix("query_")] = function
    return function


def _rounded(frame, *names, digits=6):
    return frame.withColumns({name: F.round(name, digits) for name in names})


def _digest(name, prefix=None):
    prefix = prefix or name
    return [F.length(name).alias(f"{prefix}_chars"), F.md5(name).alias(f"{prefix}_md5")]


# --- scope and metadata ---------------------------------------------------------------------


def _targets(spark, d):
    return scope.scope_targets(view(spark, d, "v_scope"))


def _columns(spark, d):
    return catalog.described_columns(view(spark, d, "v_described"))


@query
def scope_targets(spark, d):
    return scope.ordered(_targets(spark, d))


@query
def scope_totals(spark, d):
    return scope.scope_totals(_targets(spark, d))


@query
def schema_targets(spark, d):
    return scope.schema_targets(_targets(spark, d))


@query
def describe_cut(spark, d):
    return _columns(spark, d)


@query
def scope_found(spark, d):
    return catalog.found_columns(_targets(spark, d), _columns(spark, d))


@query
def scope_missing(spark, d):
    return catalog.missing_tables(_targets(spark, d), _columns(spark, d))


@query
def columns_per_schema(spark, d):
    return catalog.columns_per_schema(_columns(spark, d))


@query
def tables_per_schema(spark, d):
    return prompts.table_names(_columns(spark, d))


@query
def valid_fqn(spark, d):
    return view(spark, d, "v_sources").select(
        "ord", "name", is_three_part(F.col("name")).alias("three_part")
    )


# --- sources ------------------------------------------------------------------------------------


@query
def source_ext(spark, d):
    return view(spark, d, "v_sources").select("ord", file_extension(F.col("name")).alias("ext"))


@query
def source_hints(spark, d):
    return view(spark, d, "v_sources").select(
        "ord", F.array_join(hint_tabs(F.col("description")), "|").alias("tabs"),
        F.array_join(hint_columns(F.col("description")), "|").alias("columns"),
    )


@query
def manifest_entries(spark, d):
    return manifests.manifest_entries(view(spark, d, "v_manifests")).select(
        "manifest", "position", "kind", "name", F.md5("description").alias("description_md5"),
        F.array_join("hint_tabs", "|").alias("tabs"),
    )


@query
def sources_merged(spark, d):
    return merge.merged_sources(view(spark, d, "v_entries")).select(
        "ord", "name", "description", "manifest", *_digest("content")
    )


@query
def context_table_text(spark, d):
    return tables.table_text(
        table(spark, d, "part"), ["p_partkey", "p_brand", "p_type"], ["p_partkey"]
    )


@query
def delimited_text(spark, d):
    """One CSV file per brand, written by Spark and read back as context files."""
    folder = f"{shared_dir(spark)}/metadoc/csv-{uuid.uuid4().hex}"
    part = table(spark, d, "part")
    fields = part.withColumn("brand", F.col("p_brand"))
    fields.repartition("brand").sortWithinPartitions("brand", "p_partkey").write.partitionBy(
        "brand"
    ).csv(folder, header=True)
    return delimited_files(spark, folder, ".csv").select(
        F.url_decode(F.regexp_extract("name", r"brand=([^/]*)", 1)).alias("brand"), *_digest("content")
    )


@query
def text_file_content(spark, d):
    """One text file per conversation, written by Spark and read back as context files."""
    folder = f"{shared_dir(spark)}/metadoc/texts-{uuid.uuid4().hex}"
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    file = F.concat(F.lit("conv_id="), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit(".txt"))
    write_texts(turns, folder, file, F.col("text"), ["turn"])
    return text_files(spark, folder).select(
        F.regexp_extract("name", r"conv_id=([0-9]+)", 1).cast("long").alias("conv_id"),
        *_digest("content"),
    )


@query
def sample_size(spark, d):
    return sampling.sample_sizes(view(spark, d, "v_rows"), ["schema_name", "table_name"], 10)


_SAMPLE_COLUMNS = ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate"]


def _drawn(spark, d):
    rows = view(spark, d, "v_rows")
    return sampling.stacked_samples(rows, ["schema_name", "table_name"], "o_orderkey", 10)


@query
def table_sample(spark, d):
    return _drawn(spark, d).select(
        "schema_name", "table_name", "row_count", "sample_size", F.col("nth").cast("long").alias("nth"),
        row_text(_SAMPLE_COLUMNS, fv.SAMPLE_CELL_CHARS).alias("line"),
    )


def _samples(spark, d):
    return sampling.samples_as_text(_drawn(spark, d), ["schema_name", "table_name"], _SAMPLE_COLUMNS)


@query
def sample_text(spark, d):
    return _samples(spark, d).select("schema_name", "table_name", *_digest("sample"))


# --- relevance and context ----------------------------------------------------------------------


@query
def source_scores(spark, d):
    args = F.col("name"), F.col("description"), F.col("kind")
    return view(spark, d, "v_sources").select(
        "ord", static_score(*args, fv.GENERATOR_KEYWORDS).alias("generator_score"),
        static_score(*args, fv.AUDITOR_KEYWORDS).alias("auditor_score"),
    )


@query
def relevance_pairs(spark, d):
    names = relevance.object_names(relevance.context_keys(view(spark, d, "v_objects")))
    index = materialize(relevance.source_index(view(spark, d, "v_sources")), "source-index")
    return relevance.name_hits(index, names).select(
        "name", "ord", "is_schema", "is_table", "static", F.col("size").cast("long").alias("size")
    )


def _picks(spark, d, keywords):
    return relevance.pick_sources(view(spark, d, "v_sources"), view(spark, d, "v_objects"), keywords)


@query
def relevance_rank(spark, d):
    return _picks(spark, d, fv.AUDITOR_KEYWORDS).select(
        "schema_key", "table_key", F.col("rank").cast("long").alias("rank"), "ord", "score"
    )


@query
def context_budget(spark, d):
    return _picks(spark, d, fv.GENERATOR_KEYWORDS).select(
        "schema_key", "table_key", F.col("rank").cast("long").alias("rank"), "ord", "score",
        F.col("before").cast("long").alias("before"), F.col("size").cast("long").alias("size"),
        F.col("taken").cast("long").alias("taken"), "used",
    )


def _contexts(spark, d, objects=None, keywords=fv.GENERATOR_KEYWORDS):
    objects = view(spark, d, "v_objects") if objects is None else objects
    return relevance.contexts(view(spark, d, "v_sources"), objects, keywords)


@query
def context_text(spark, d):
    return relevance.context_rows(_contexts(spark, d)).select(
        "schema_key", "table_key", *_digest("context")
    )


# --- prompts ------------------------------------------------------------------------------------


def _schema_comments(spark, d):
    generated = F.concat(F.lit("Definición generada de "), F.col("schema_name"))
    return view(spark, d, "v_schema_comments").select(
        "catalog_name", "schema_name", F.col("schema_comment").alias("existing_schema_comment"),
        F.when(F.col("catalog_name") != "EUROPE", generated).alias("generated_schema_comment"),
    )


def _table_comments(columns):
    """A generated comment for two of the tables; none for the others."""
    generated = F.concat(F.lit("Tabla generada "), F.col("table_name"))
    return columns.select(*scope.TARGET).distinct().select(
        *scope.TARGET,
        F.when(F.col("table_name").isin("BUILDING", "HOUSEHOLD"), generated)
        .alias("generated_table_comment"),
    )


def _children(spark, d):
    columns = materialize(_columns(spark, d), "columns")
    return prompts.child_context(columns, _schema_comments(spark, d), _table_comments(columns))


@query
def child_context(spark, d):
    return _children(spark, d)


@query
def effective_comment(spark, d):
    return _schema_comments(spark, d).select(
        "catalog_name", "schema_name",
        prompts.effective_schema_comment(
            F.col("existing_schema_comment"), F.col("generated_schema_comment")
        ).alias("for_tables"),
        prompts.effective_table_comment(
            F.col("generated_schema_comment"), F.col("existing_schema_comment")
        ).alias("generated_first"),
    )


@query
def prompts_schema(spark, d):
    names = prompts.table_names(_columns(spark, d))
    rows = relevance.with_context(names.withColumn("table_name", F.lit("")), _contexts(spark, d))
    return rows.withColumn("prompt", prompts.schema_prompt()).select(
        "catalog_name", "schema_name", *_digest("prompt")
    )


def _sampled(rows, spark, d):
    """Rows with their table's sample; joined before the much longer context."""
    return rows.join(_samples(spark, d), ["schema_name", "table_name"], "left")


@query
def prompts_table(spark, d):
    rows = _children(spark, d).select(*scope.TARGET, "schema_comment").distinct()
    rows = relevance.with_context(_sampled(rows, spark, d), _contexts(spark, d))
    return rows.withColumn("prompt", prompts.table_prompt()).select(*scope.TARGET, *_digest("prompt"))


@query
def prompts_column(spark, d):
    rows = relevance.with_context(_sampled(_children(spark, d), spark, d), _contexts(spark, d))
    return rows.withColumn("prompt", prompts.column_prompt()).select(
        *scope.TARGET, "column_name", *_digest("prompt")
    )


def _evaluation_prompts(spark, d):
    return view(spark, d, "v_golden").withColumn("prompt", prompts.evaluation_prompt(400))


@query
def prompts_evaluation(spark, d):
    return _evaluation_prompts(spark, d).select("object_id", *_digest("prompt"))


@query
def prompts_judge(spark, d):
    comment = F.coalesce("gold_comment", F.concat(F.lit("Objeto "), F.col("object_id")))
    rows = view(spark, d, "v_golden").withColumn("comment", comment)
    return rows.withColumn("prompt", prompts.judge_prompt(MANIFESTS, PRODUCT)).select(
        "object_id", *_digest("prompt")
    )


@query
def prompts_audit(spark, d):
    return audit.audit_prompts(
        view(spark, d, "v_results"), view(spark, d, "v_sources"), MANIFESTS
    ).select("id_resultado", *_digest("prompt"))


@query
def prompt_response(spark, d):
    asked = _evaluation_prompts(spark, d)
    identity = prompts.prompt_id(F.col("prompt"))
    known = asked.filter(F.col("object_level") == "table").select(identity.alias("prompt_id")).distinct()
    known = known.select(
        "prompt_id", F.concat(F.lit("respuesta "), F.substring("prompt_id", 1, 8)).alias("text"),
        F.lit(1.5).cast("double").alias("latency_ms"), F.lit(7).alias("tokens_in"),
        F.lit(3).alias("tokens_out"), F.lit(None).cast("string").alias("error"),
    )
    return responses.answered(asked, known).select("object_id", "prompt_id", "text", "tokens_in")


@query
def responder_answers(spark, d):
    """Every distinct prompt goes to a responder once; here one that counts words."""

    def count_words(texts):
        import pandas as pd

        return pd.DataFrame({
            "text": [f"{len(t)} caracteres" if len(t) % 11 else "" for t in texts],
            "latency_ms": 1.0, "tokens_in": [len(t) // 4 for t in texts], "tokens_out": 2,
            "error": [None if len(t) % 11 else "sin respuesta" for t in texts],
        })

    def build(rows):
        return rows.withColumn("prompt", prompts.evaluation_prompt(400))

    answers = responses.ask(view(spark, d, "v_golden"), ["object_id"], build, count_words)
    return answers.select("object_id", "prompt_id", "text", "tokens_in", "error")


@query
def responder_settings(spark, d):
    """The settings of a call as its responder sees them, tokens out of usage blocks, and latency by the engine."""

    def describe(texts, settings):
        import json

        import pandas as pd

        return pd.DataFrame({
            "text": [f"{len(t)}:{settings['max_tokens']}:{settings['temperature']}" for t in texts],
            "usage": [json.dumps({"prompt_tokens": len(t), "completion_tokens": 3}) if len(t) % 7 else None for t in texts],
        })

    def build(rows):
        return rows.withColumn("prompt", prompts.evaluation_prompt(400))

    answers = responses.ask(view(spark, d, "v_golden"), ["object_id"], build, describe, kind="judge")
    return answers.select(
        "object_id", "text", "tokens_in", "tokens_out", (F.col("latency_ms") >= 0).alias("timed"))


# --- results ------------------------------------------------------------------------------------


@query
def object_level(spark, d):
    return results.level_of(view(spark, d, "v_results")).select("id_resultado", "level")


@query
def target_label(spark, d):
    return review.with_level_and_target(view(spark, d, "v_results")).select("id_resultado", "target")


@query
def results_rows(spark, d):
    rows = results.result_rows(view(spark, d, "v_results"), "run-1", "2026-02-03 04:05:06")
    return rows.select(
        "id_ejecucion", F.date_format("fecha_resultado", "yyyy-MM-dd HH:mm:ss").alias("fecha"),
        "nombre_catalogo", "nombre_esquema", "nombre_tabla", "nombre_columna",
        *_digest("comentario"), "status", "user_comments", "criterio_fallido",
    )


@query
def assign_ids(spark, d):
    rows = view(spark, d, "v_results").select(F.col("id_resultado").alias("doc_id"), "status")
    return results.assign_ids(rows, "id_resultado", start=1000, order_by=["doc_id"])


@query
def results_filtered(spark, d):
    kept = results.filter_results(view(spark, d, "v_results"), "src1", only_approved=True)
    return results.ordered_results(kept).select("id_resultado", *results.OBJECT_KEYS)


@query
def results_approved(spark, d):
    kept = results.filter_results(view(spark, d, "v_results"), only_approved=True)
    return results.ordered_results(kept).select("id_resultado", *results.OBJECT_KEYS)


@query
def execution_latest(spark, d):
    return results.latest_executions(view(spark, d, "v_exec_events")).select(
        "id_ejecucion", F.date_format("fecha_ejecucion", "yyyy-MM-dd HH:mm:ss").alias("fecha"),
        "estado", "resultado",
    )


@query
def execution_history(spark, d):
    latest = results.latest_executions(view(spark, d, "v_exec_events"))
    return kpis.execution_history(latest).select("id_ejecucion", "estado", "resultado")


@query
def first_errors(spark, d):
    errors = view(spark, d, "v_outcomes").filter("message IS NOT NULL")
    return results.first_errors(errors, ["id_ejecucion"], fv.PRINTED_ERRORS)


@query
def run_summary(spark, d):
    outcomes = view(spark, d, "v_outcomes")
    counts = outcomes.groupBy("id_ejecucion").agg(
        F.count(F.when(F.col("level") == "schema", 1)).alias("scope_schemas"),
        F.count(F.when(F.col("level") == "table", 1)).alias("scope_tables"),
    )
    return results.run_summary(outcomes, "main.control.scope", counts)


@query
def latest_approved(spark, d):
    return results.latest_approved(view(spark, d, "v_results")).select(
        *results.OBJECT_KEYS, "id_resultado", *_digest("comentario")
    )


@query
def results_with_execution(spark, d):
    joined = results.with_execution(view(spark, d, "v_results"), view(spark, d, "v_executions"))
    return joined.select("id_resultado", "id_ejecucion", "estado", "resultado", "status")


# --- audit --------------------------------------------------------------------------------------


def _claimed(spark, d):
    return audit.claimed_verdicts(view(spark, d, "v_audit_answers")).drop("text")


def _settled(spark, d):
    return audit.settled_verdicts(_claimed(spark, d), audit.criteria_frame(spark))


@query
def verdicts(spark, d):
    return _settled(spark, d)


@query
def verdicts_valid(spark, d):
    return audit.known_failures(_claimed(spark, d), audit.criteria_frame(spark))


@query
def verdicts_unknown(spark, d):
    return audit.unknown_failures(_claimed(spark, d), audit.criteria_frame(spark))


@query
def audit_upsert(spark, d):
    rows = view(spark, d, "v_results")
    audited = results.filter_results(rows, only_approved=True).select("id_resultado")
    verdict = _settled(spark, d).join(audited, "id_resultado", "left_semi")
    return results.apply_verdicts(rows, audit.as_update(verdict)).select(
        "id_resultado", "status", "criterio_fallido", "detalles_criterio_fallido"
    )


@query
def audit_totals(spark, d):
    return audit.audit_totals(_settled(spark, d))


@query
def audit_by_criterion(spark, d):
    return audit.audit_by_criterion(_settled(spark, d))


# --- review and publication -----------------------------------------------------------------


@query
def review_apply(spark, d):
    return review.apply_review(view(spark, d, "v_results"), view(spark, d, "v_decisions")).select(
        "id_resultado", "status", "user_comments"
    )


@query
def results_changes(spark, d):
    old, decisions = view(spark, d, "v_results"), view(spark, d, "v_decisions")
    reviewed = review.apply_review(old, decisions)
    rejected = decisions.filter(F.col("status") == fv.STATUS_REJECTED)
    kept = reviewed.join(rejected, "id_resultado", "left_anti")
    again = reviewed.join(decisions.filter(F.col("status") == fv.STATUS_REVIEW), "id_resultado",
                          "left_semi")
    added = again.withColumn("id_resultado", F.col("id_resultado") + 10_000_000_000)
    return results.snapshot_changes(old, kept.unionByName(added)).select(
        "id_resultado", "change", "status", "user_comments"
    )


def _statements(spark, d):
    approved = results.filter_results(view(spark, d, "v_results"), only_approved=True)
    return review.apply_statements(approved)


@query
def apply_statements(spark, d):
    return _statements(spark, d).select("id_resultado", "level", "target", "statement", "error")


@query
def applied_counts(spark, d):
    return review.applied_counts(_statements(spark, d))


# --- rules of the control tables ----------------------------------------------------------------


@query
def dq_not_null(spark, d):
    return quality.null_violations(
        view(spark, d, "v_results"), "id_resultado", quality.NOT_NULL["results"]
    )


@query
def dq_length(spark, d):
    return quality.length_violations(
        view(spark, d, "v_results"), "id_resultado", quality.LENGTHS["results"]
    )


@query
def dq_domain(spark, d):
    return quality.domain_violations(
        view(spark, d, "v_results"), "id_resultado", quality.DOMAINS["results"]
    )


@query
def dq_results(spark, d):
    return quality.rule_violations(view(spark, d, "v_results"), "results", "id_resultado")[0]


@query
def dq_executions(spark, d):
    return quality.rule_violations(view(spark, d, "v_exec_raw"), "executions", "seq")[0]


@query
def dq_golden(spark, d):
    return quality.rule_violations(view(spark, d, "v_golden_raw"), "golden", "object_id")[0]


@query
def dq_golden_keys(spark, d):
    return quality.duplicate_keys(view(spark, d, "v_golden_raw"), ["object_id"])


@query
def dq_unique(spark, d):
    return quality.duplicate_keys(view(spark, d, "v_exec_events"), ["id_ejecucion"])


@query
def dq_orphans(spark, d):
    return results.orphans(view(spark, d, "v_results"), view(spark, d, "v_executions")).select(
        "id_resultado", "id_ejecucion"
    )


# --- evaluation -----------------------------------------------------------------------------


@query
def golden_strata(spark, d):
    return evaluation.golden_strata(view(spark, d, "v_golden"))


@query
def level_limits(spark, d):
    level = F.col("object_level")
    return view(spark, d, "v_golden").select(
        "object_id", level_label(level).alias("label"), level_limit(level, 400).alias("max_chars")
    )


@query
def eval_grid(spark, d):
    return evaluation.evaluation_grid(view(spark, d, "v_golden"), MODELS, 3).select(
        "object_id", "model", "run"
    )


@query
def det_scores(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", *deterministic_scores(F.col("text"), MAX_CHARS)
    )


@query
def det_scores_turns(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", *deterministic_scores(F.col("text"), MAX_CHARS)
    )


@query
def pii_hits(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", flag(pii_long_number(text)).alias("long_number"),
        flag(pii_email(text)).alias("email"), flag(pii_card(text)).alias("card"),
    )


@query
def query_style_flags(spark, d):
    return view(spark, d, "v_golden").select(
        "object_id", *style_flags(F.col("context_text"), F.col("object_level"))
    )


@query
def judge_flags(spark, d):
    return with_judge_flags(view(spark, d, "v_judge_answers"), prompts.judge_keys()).drop("judge_text")


@query
def consistency_native(spark, d):
    return _rounded(evaluation.consistency(view(spark, d, "v_runs"), native_ratio), "consistency")


_METRICS = evaluation.item_metrics()


def _means(spark, d):
    return evaluation.model_means(view(spark, d, "v_items"))


def _costed(spark, d):
    return evaluation.with_cost(_means(spark, d), evaluation.price_frame(spark, PRICES))


@query
def model_means(spark, d):
    return _rounded(_means(spark, d), *_METRICS)


@query
def metrics_long(spark, d):
    params = {"judge": "juez", "temperature": 0.0, "n_consistency_runs": 3}
    return _rounded(evaluation.metrics_long(_means(spark, d), "eval-1", params), "number")


@query
def cost_per_1k(spark, d):
    return _rounded(_costed(spark, d).select("model", "cost_1k", "priced"), "cost_1k")


@query
def normalized(spark, d):
    frame = evaluation.normalized(
        _costed(spark, d), {"cost_1k": True, "latency_ms": True, "consistency": False}
    )
    names = ["cost_1k_norm", "latency_ms_norm", "consistency_norm"]
    return _rounded(frame.select("model", *names), *names)


@query
def scorecard(spark, d):
    return evaluation.scorecard(_costed(spark, d))


@query
def scorecard_alt(spark, d):
    return evaluation.scorecard_by_criterion(
        _costed(spark, d), "judge_fuera_de_contexto", "judge_informacion_faltante",
        "judge_terminologia_incorrecta",
    )


@query
def best_model(spark, d):
    return evaluation.best_model(evaluation.scorecard(_costed(spark, d)))


@query
def latency_percentiles(spark, d):
    return _rounded(evaluation.latency_percentiles(view(spark, d, "v_items")), "p50", "p95")


@query
def pii_by_sensitivity(spark, d):
    return _rounded(evaluation.pii_by_sensitivity(view(spark, d, "v_items")), "leak_rate")


def _rated(spark, d):
    text = F.col("text")
    judged = table(spark, d, "documents").select(
        "doc_id", flag(~pii_email(text) & ~pii_card(text) & (F.length(text) <= 4000)).alias("judge_flag")
    )
    expert = table(spark, d, "labels").select("doc_id", F.col("quality").alias("expert_flag"))
    return judged.join(expert, "doc_id")


@query
def judge_agreement(spark, d):
    return _rounded(evaluation.agreement(_rated(spark, d)), "agreement", "kappa")


@query
def calibration_sample(spark, d):
    return sampling.calibration_sample(_rated(spark, d), "doc_id")


# --- indicators -----------------------------------------------------------------------------


@query
def query_kpis(spark, d):
    return kpis.kpis(view(spark, d, "v_results"))


@query
def kpis_filtered(spark, d):
    chosen = kpis.filter_for_dashboard(
        view(spark, d, "v_results"), view(spark, d, "v_executions"),
        dates=("2026-01-01", "2027-12-31"), catalog="es",
        tables=["tab`1", "tab`2", "tab`3", "__esquema__"], status=fv.STATUS_APPROVED,
    )
    return kpis.kpis(chosen)


# --- stream -------------------------------------------------------------------------------------


STREAM_FILES = 8
STREAM_BATCHES = 4


@query
def stream_flags(spark, d):
    """All documents as result rows of a stream, in two versions each, checked batch by batch until none is left.

    Three batches are merged into a base, the rest stays a delta; the newer version counts."""
    folder = f"{shared_dir(spark)}/metadoc/stream-{uuid.uuid4().hex}"
    part = F.col("doc_id") % 10
    # Every row in two versions, dealt out so that the older one may well come later.
    versions = F.explode(F.array(F.struct(F.lit(1).alias("n"), F.upper("text").alias("text")),
                                 F.struct(F.lit(2).alias("n"), F.col("text").alias("text"))))
    # As many files in each batch as the table has splits, so that what a task reads does not grow with the table.
    splits = spark.read.parquet(f"{d}/documents.parquet").rdd.getNumPartitions()
    files = max(STREAM_FILES, STREAM_BATCHES * splits)
    table(spark, d, "documents").select("doc_id", versions.alias("v")).select(
        F.col("doc_id").alias("id_resultado"), F.expr("timestamp_ntz'2026-01-01 00:00:00'").alias("day"), "v.n",
        F.col("v.text").alias("comentario"),
        F.when(part == 0, fv.SCHEMA_SENTINEL).otherwise("tab").alias("nombre_tabla"),
        F.when(part == 0, fv.SCHEMA_SENTINEL).when(part < 3, fv.TABLE_SENTINEL).otherwise("col")
        .alias("nombre_columna"),
    ).withColumn("fecha_resultado", F.expr("day + make_interval(0, 0, 0, n)")).drop("day", "n").repartition(
        files, F.xxhash64("id_resultado", "fecha_resultado")).write.parquet(f"{folder}/landing")
    landed = spark.read.parquet(f"{folder}/landing")
    # Partitions without rows make no files, so what was written is counted.
    at_once = -(-len(landed.inputFiles()) // STREAM_BATCHES)
    rows = result_stream(spark, f"{folder}/landing", landed.schema, maxFilesPerTrigger=max(1, at_once))
    run_available(write_batches(flagged(rows), f"{folder}/flags", merge_at=3), f"{folder}/checkpoint")
    return current(spark, f"{folder}/flags")
