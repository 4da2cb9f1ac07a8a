"""Prompt texts, one row per object."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from metadoc import fixed_values as fv
from metadoc.functions.levels import level_label, level_limit, quoted_target
from metadoc.functions.text import fill, or_empty, when_present
from metadoc.sources.scope import TARGET


def prompt_id(prompt):
    return F.sha2(prompt, 256)


def criteria_ids():
    return [name for name, _ in fv.CRITERIA]


def judge_keys():
    return [name.lower() for name in criteria_ids()]


def criteria_block(manifests):
    """The numbered criteria; ``manifests`` are the manifest names the first one mentions."""
    listed = " / ".join(manifests)
    return "\n".join(
        f"{number}. {name}: {text.format(manifests=listed)}"
        for number, (name, text) in enumerate(fv.CRITERIA, start=1)
    )


def table_names(targets, most=fv.SCHEMA_PROMPT_TABLES):
    """(catalog_name, schema_name, tables): the first table names, in order, as one text.

    The rank limit also runs before the shuffle, so a schema with very many tables stays small.
    """
    window = Window.partitionBy("catalog_name", "schema_name").orderBy("table_name")
    first = (
        targets.select(*TARGET).distinct()
        .withColumn("nth", F.row_number().over(window)).filter(F.col("nth") <= most)
    )
    return first.groupBy("catalog_name", "schema_name").agg(
        F.array_join(F.sort_array(F.collect_list("table_name")), ", ").alias("tables")
    )


def effective_schema_comment(existing, generated):
    """The comment the schema already has, else the generated one."""
    return or_empty(F.coalesce(F.nullif(existing, F.lit("")), generated))


def effective_table_comment(generated, existing):
    """The generated table comment, else the one the table already has."""
    return or_empty(F.coalesce(F.nullif(generated, F.lit("")), existing))


def schema_prompt():
    return fill(
        fv.SCHEMA_PROMPT, context=F.col("context"), schema=F.col("schema_name"),
        tables=F.col("tables"),
    )


def _sample_note(sample):
    cut = F.substring(sample, 1, fv.SAMPLE_PROMPT_CHARS)
    return when_present(sample, fill(fv.SAMPLE_NOTE, sample=cut))


def table_prompt():
    note = fill(
        fv.TABLE_SCHEMA_NOTE, schema=F.col("schema_name"), schema_comment=F.col("schema_comment")
    )
    return fill(
        fv.TABLE_PROMPT, context=F.col("context"),
        schema_note=when_present(F.col("schema_comment"), note),
        sample_note=_sample_note(F.col("sample")), table=F.col("table_name"),
    )


def column_prompt():
    schema_note = when_present(
        F.col("schema_comment"), fill(fv.COLUMN_SCHEMA_NOTE, schema_comment=F.col("schema_comment"))
    )
    table_note = when_present(
        F.col("table_comment"),
        fill(fv.COLUMN_TABLE_NOTE, table=F.col("table_name"), table_comment=F.col("table_comment")),
    )
    notes = F.concat(schema_note, table_note)
    return fill(
        fv.COLUMN_PROMPT, context=F.col("context"),
        parent_notes=F.concat(notes, when_present(notes, F.lit("\n"))),
        sample_note=_sample_note(F.col("sample")), table=F.col("table_name"),
        column=F.col("column_name"), data_type=F.col("data_type"),
    )


def evaluation_prompt(max_chars):
    level = F.col("object_level")
    return fill(
        fv.EVALUATION_PROMPT, context=or_empty(F.col("context_text")),
        level_label=level_label(level), max_chars=level_limit(level, max_chars).cast("string"),
    )


def audit_prompt(manifests):
    """Expects ``level``, the four object name columns, ``comentario`` and ``context``."""
    names = [or_empty(F.col(f"nombre_{part}")) for part in ("catalogo", "esquema", "tabla", "columna")]
    return fill(
        fv.AUDIT_PROMPT, criteria=F.lit(criteria_block(manifests)), context=F.col("context"),
        level_label=level_label(F.col("level")), target=quoted_target(F.col("level"), *names),
        comment=or_empty(F.col("comentario")),
    )


def judge_prompt(manifests, catalog_product):
    """Expects ``object_level``, ``context_text`` and ``comment``."""
    keys = judge_keys()
    return fill(
        fv.JUDGE_PROMPT, catalog_product=F.lit(catalog_product),
        criteria=F.lit(criteria_block(manifests)),
        context=F.substring(or_empty(F.col("context_text")), 1, fv.JUDGE_CONTEXT_CHARS),
        level=F.col("object_level"), comment=F.col("comment"), keys=F.lit(", ".join(keys)),
        example=F.lit(", ".join(f'"{key}": 1' for key in keys)),
    )


def child_context(columns, schema_comments, table_comments):
    """Columns with the comments of their schema and table.

    ``schema_comments`` has ``existing_schema_comment`` and ``generated_schema_comment``,
    ``table_comments`` has ``generated_table_comment``; the columns carry the existing table comment.
    """
    joined = columns.join(schema_comments, list(TARGET[:2]), "left").join(
        table_comments, list(TARGET), "left"
    )
    return joined.withColumns({
        "schema_comment": effective_schema_comment(
            F.col("existing_schema_comment"), F.col("generated_schema_comment")
        ),
        "table_comment": effective_table_comment(
            F.col("generated_table_comment"), F.col("table_comment")
        ),
    }).drop("existing_schema_comment", "generated_schema_comment", "generated_table_comment")
