"""Reading the JSON answers of an auditor and of a judge."""

from pyspark.sql import functions as F

from metadoc.functions.text import blank_to_null, or_empty, strip

# JSON texts of a value that counts as false, and of one that equals the number one.
_FALSY = r'\A(false|null|""|\[\]|-?0+(\.0+)?([eE][+-]?[0-9]+)?)\z'
_ONE = r"\A(true|1(\.0+)?)\z"


def _json_text(data, key):
    return F.to_json(F.try_variant_get(data, f"$.{key}", "variant"))


def with_audit_verdict(rows, raw="text"):
    """Add ``ok``, ``criterio`` and ``detalles`` as the auditor claims them.

    Read is the first brace pair without inner braces. An answer without one holds no JSON object,
    with or without a code fence around it, and whatever cannot be read counts as fine; so does a
    missing ``ok``. The steps are columns of their own so that the answer is parsed once.
    """
    block = F.regexp_extract(or_empty(F.col(raw)), r"\{[^{}]*\}", 0)
    parsed = rows.withColumn("data", F.try_parse_json(block))
    data = F.col("data")
    read = parsed.withColumns({
        "failed": F.coalesce(_json_text(data, "ok").rlike(_FALSY), F.lit(False)),
        "criterio": F.try_variant_get(data, "$.criterio", "string"),
        "detalles": blank_to_null(strip(F.try_variant_get(data, "$.detalles", "string"))),
    })
    return read.select(
        *rows.columns, (~F.col("failed")).alias("ok"),
        F.when(F.col("failed"), F.col("criterio")).alias("criterio"),
        F.when(F.col("failed"), F.col("detalles")).alias("detalles"),
    )


def with_judge_flags(rows, keys, raw="judge_text"):
    """Add a 0/1 column ``judge_<key>`` per key: 1 only for the JSON number one or true."""
    block = F.regexp_extract(or_empty(F.col(raw)), r"(?s)\{.*\}", 0)
    parsed = rows.withColumn("data", F.try_parse_json(block))
    flags = {
        f"judge_{key}": F.coalesce(_json_text(F.col("data"), key).rlike(_ONE), F.lit(False)).cast("int")
        for key in keys
    }
    return parsed.withColumns(flags).drop("data")
