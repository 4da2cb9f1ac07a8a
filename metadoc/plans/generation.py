"""From scope to result rows: schemas, then tables, then columns, one Spark job per wave.

Tables need the comment of their schema and columns the comment of their table, so every wave is
written before the next one starts.
"""

import uuid
from dataclasses import dataclass
from datetime import datetime, timezone
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metadoc import fixed_values as fv
from metadoc.functions.text import or_empty
from metadoc.operators.prompts import (
    child_context, column_prompt, effective_schema_comment, schema_prompt, table_names, table_prompt,
)
from metadoc.operators.relevance import contexts, stored, with_context
from metadoc.operators.responses import ask, split_answers
from metadoc.operators.results import level_of, result_rows, run_summary
from metadoc.operators.sampling import table_sample_text
from metadoc.runtime import append_each, materialize, shared_dir
from metadoc.sinks.control_tables import append_results, log_state
from metadoc.sources.catalog import (
    described_columns, missing_tables, read_describe, read_schema_comments,
)
from metadoc.sources.scope import TARGET, schema_targets, scope_targets, scope_totals

SCHEMA_KEY = TARGET[:2]


def utc_now():
    return datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


@dataclass
class Generation:
    execution_id: str
    results: DataFrame
    outcomes: DataFrame
    missing: DataFrame
    summary: DataFrame


def table_samples(spark, tables, pct, seed):
    """(catalog_name, schema_name, table_name, sample), one row per table, many tables per job."""
    schema = "catalog_name string, schema_name string, table_name string, sample string"
    path = f"{shared_dir(spark)}/metadoc/samples-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(path)

    def labels(names):
        return [F.lit(value).alias(name) for name, value in zip(TARGET, names)]

    def sample_of(names):
        source = spark.table(".".join(f"`{part.replace('`', '``')}`" for part in names))
        return table_sample_text(source, pct, seed).select(*labels(names), "sample")

    def failed(names, problem):
        text = fv.SAMPLE_FAILED_TEXT.format(str(problem)[:100])
        return spark.range(1).select(*labels(names), F.lit(text).alias("sample"))

    wanted = tables.select(*TARGET).toLocalIterator()
    append_each(spark, path, ((tuple(t), lambda t=t: sample_of(t)) for t in wanted), failed)
    return spark.read.schema(schema).parquet(path)


def _rows(answers, table_name, column_name):
    return answers.select(
        F.col("catalog_name").alias("nombre_catalogo"), F.col("schema_name").alias("nombre_esquema"),
        table_name.alias("nombre_tabla"), column_name.alias("nombre_columna"), "comentario",
    )


def _label(*names):
    return F.concat_ws(".", *names)


def generate(spark, config, sources, responder, answers_path=None, concurrency=None,
             execution_id=None, at=None, progress=lambda text: None):
    """Comments for every schema, table and column in scope, as result rows without id.

    ``progress`` is told which wave begins.
    """
    execution_id = execution_id or str(uuid.uuid4())
    at = at or utc_now()
    targets = materialize(scope_targets(
        spark.table(config.scope_table), config.catalog_column, config.schema_column,
        config.table_column,
    ), "targets")
    if targets.isEmpty():
        raise ValueError(f"{config.scope_table} has no valid rows")
    columns = materialize(described_columns(read_describe(spark, targets)), "columns")
    tables = materialize(columns.select(*TARGET, "table_comment").distinct(), "tables")
    schemas = table_names(tables)
    existing = read_schema_comments(spark, schema_targets(tables)).withColumnRenamed(
        "schema_comment", "existing_schema_comment"
    )
    objects = tables.select(*TARGET).unionByName(
        schemas.select(*SCHEMA_KEY, F.lit("").alias("table_name"))
    )
    packed = stored(contexts(sources, objects, max_chars=config.max_context_chars))
    samples = table_samples(spark, tables, config.sampling_pct, config.seed) if config.sampling else \
        spark.createDataFrame([], "catalog_name string, schema_name string, table_name string, sample string")

    def wave(kind, rows, key, build):
        return split_answers(rows.join(
            ask(rows, key, build, responder, answers_path, concurrency, kind=kind), key, "left"
        ))

    def schema_build(rows):
        return with_context(rows, packed).withColumn("prompt", schema_prompt())

    progress(fv.WAVE_TEXTS["schema"])
    schema_rows = schemas.withColumn("table_name", F.lit(""))
    good_schemas, bad_schemas = wave("schema", schema_rows, list(SCHEMA_KEY), schema_build)
    generated = good_schemas.select(*SCHEMA_KEY, F.col("comentario").alias("generated_schema_comment"))
    schema_notes = materialize(
        existing.join(generated, list(SCHEMA_KEY), "left"), "schema-notes"
    )

    def child_build(prompt):
        def build(rows):
            sampled = rows.join(samples, list(TARGET), "left").withColumn("sample", or_empty(F.col("sample")))
            return with_context(sampled, packed).withColumn("prompt", prompt)
        return build

    table_rows = tables.join(schema_notes, list(SCHEMA_KEY), "left").withColumn(
        "schema_comment",
        effective_schema_comment(F.col("existing_schema_comment"), F.col("generated_schema_comment")),
    ).select(*TARGET, "schema_comment")
    progress(fv.WAVE_TEXTS["table"])
    good_tables, bad_tables = wave("table", table_rows, list(TARGET), child_build(table_prompt()))
    table_notes = materialize(
        good_tables.select(*TARGET, F.col("comentario").alias("generated_table_comment")), "table-notes"
    )

    progress(fv.WAVE_TEXTS["column"])
    column_rows = child_context(columns, schema_notes, table_notes)
    column_key = [*TARGET, "column_name"]
    good_columns, bad_columns = wave("column", column_rows, column_key, child_build(column_prompt()))

    comments = (
        _rows(good_schemas, F.lit(fv.SCHEMA_SENTINEL), F.lit(fv.SCHEMA_SENTINEL))
        .unionByName(_rows(good_tables, F.col("table_name"), F.lit(fv.TABLE_SENTINEL)))
        .unionByName(_rows(good_columns, F.col("table_name"), F.col("column_name")))
    )
    results = materialize(result_rows(comments, execution_id, at), "results")
    outcomes = materialize(_outcomes(
        results, bad_schemas, bad_tables, bad_columns, execution_id
    ), "outcomes")
    totals = scope_totals(targets).select(
        F.lit(execution_id).alias("id_ejecucion"), F.col("schemas").alias("scope_schemas"),
        F.col("tables").alias("scope_tables"),
    )
    return Generation(
        execution_id, results, outcomes, missing_tables(targets, columns),
        run_summary(outcomes, config.scope_table, totals),
    )


def _outcomes(results, bad_schemas, bad_tables, bad_columns, execution_id):
    """(id_ejecucion, level, message, position): the failed objects with reasons, the others without."""
    fine = level_of(results).select(
        "level", F.lit(None).cast("string").alias("message"), F.lit("").alias("position")
    )

    def failed(rows, level, label, mark):
        message = F.concat(label, F.lit(mark), F.col("error"))
        return rows.select(F.lit(level).alias("level"), message.alias("message"), label.alias("position"))

    failures = (
        failed(bad_schemas, "schema", _label(*SCHEMA_KEY), " [esquema]: ")
        .unionByName(failed(bad_tables, "table", _label(*TARGET), " [tabla]: "))
        .unionByName(failed(bad_columns, "column", _label(*TARGET, "column_name"), ": "))
    )
    return fine.unionByName(failures).select(F.lit(execution_id).alias("id_ejecucion"), "*")


def run(spark, config, sources, responder, events_table, results_table, answers_path=None,
        concurrency=None):
    """``generate`` with the execution log and the results table kept up to date."""
    execution_id = str(uuid.uuid4())
    steps = count()

    def log(state, result):
        log_state(spark, events_table, execution_id, state, result, utc_now(), next(steps))

    log(fv.RUN_STARTED, None)
    try:
        done = generate(
            spark, config, sources, responder, answers_path, concurrency, execution_id,
            progress=lambda text: log(fv.RUN_WORKING, text),
        )
        append_results(spark, results_table, done.results)
        summary = done.summary.first()
        log(summary["estado"], summary["resultado"])
    except Exception as problem:
        log(fv.RUN_FAILED, fv.UNEXPECTED_TEXT.format(str(problem)[:500]))
        raise
    return done
