"""Deterministic checks of a comment, and text similarity."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from metadoc import fixed_values as fv
from metadoc.functions.levels import level_limit
from metadoc.functions.text import WHITESPACE

# Looking at the first letter before the word boundary keeps the scan cheap on long texts.
_INITIALS = "".join(sorted({word[0] for word in fv.SPANISH_WORDS}))
_SPANISH = rf"(?U)(?=[{_INITIALS}])\b(" + "|".join(fv.SPANISH_WORDS) + r")\b"
_LINE_MARK = r"(?m)^(#{1,6}|[-*]) "
_PREFIX = r"(?iU)\A\s*(definición|definicion|comentario|descripción|descripcion)\s*:"


def flag(condition):
    return condition.cast("int")


def non_empty(comment):
    return F.btrim(comment, F.lit(WHITESPACE)) != ""


def _four_digits(comment):
    """What both number patterns need; spares them on the many texts that have none."""
    return comment.rlike(r"\p{Nd}{4}")


def pii_long_number(comment):
    return _four_digits(comment) & comment.rlike("(?U)" + fv.PII_LONG_NUMBER)


def pii_email(comment):
    return comment.contains("@") & comment.rlike("(?U)" + fv.PII_EMAIL)


def pii_card(comment):
    return _four_digits(comment) & comment.rlike("(?U)" + fv.PII_CARD)


def has_pii(comment):
    numbers = comment.rlike("(?U)" + fv.PII_LONG_NUMBER) | comment.rlike("(?U)" + fv.PII_CARD)
    return (_four_digits(comment) & numbers) | pii_email(comment)


def is_spanish(comment):
    return F.lower(comment).rlike(_SPANISH)


def deterministic_scores(comment, max_chars):
    """Four 0/1 columns. The length flag uses the run's limit, not the limit of the level."""
    return [
        flag(non_empty(comment)).alias("det_non_empty"),
        flag(F.length(comment) <= max_chars).alias("det_within_len"),
        flag(~has_pii(comment)).alias("det_no_pii"),
        flag(is_spanish(comment)).alias("det_is_spanish"),
    ]


def _has_any(comment, marks):
    found = F.lit(False)
    for mark in marks:
        found = found | comment.contains(mark)
    return found


def style_flags(comment, level, max_chars=500):
    """The part of the style criterion that needs no judgement; 1 marks a fault."""
    return [
        flag(F.length(comment) > level_limit(level, max_chars)).alias("too_long"),
        flag(_has_any(comment, "\"“”«»")).alias("has_quotes"),
        flag(_has_any(comment, ["**", "__", "`"]) | comment.rlike(_LINE_MARK)).alias("has_markdown"),
        flag(comment.rlike(_PREFIX)).alias("has_prefix"),
        flag(~is_spanish(comment)).alias("not_spanish"),
    ]


def exact_ratio():
    """Ratcliff/Obershelp ratio of two text columns, in Arrow batches; equal texts skip the work."""

    def ratio(left, right):
        from difflib import SequenceMatcher

        import pandas as pd

        return pd.Series(
            [
                1.0 if a == b else SequenceMatcher(None, a, b).ratio()
                for a, b in zip(left.fillna(""), right.fillna(""))
            ],
            dtype="float64",
        )

    return F.pandas_udf(ratio, T.DoubleType())


def native_ratio(left, right):
    """1 - edit distance / longer length, inside the JVM."""
    longest = F.greatest(F.length(left), F.length(right))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(left, right) / longest)
