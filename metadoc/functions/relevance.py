"""Parts of a source's relevance that need no object."""

from pyspark.sql import functions as F

from metadoc import fixed_values as fv
from metadoc.functions.text import file_extension, fill


def source_header(name, description, kind):
    label = F.when(kind == fv.KIND_TABLE, fv.SOURCE_LABELS[fv.KIND_TABLE]).otherwise(
        fv.SOURCE_LABELS[fv.KIND_FILE]
    )
    return fill(fv.SOURCE_HEADER, label=label, name=name, description=description)


def haystack(name, description, content):
    """The lower-case text in which object names are looked up."""
    head = F.substring(content, 1, fv.HEAD_CHARS)
    return F.lower(F.concat_ws(" ", description, name, head))


def static_score(name, description, kind, keywords):
    """Score of a source before any object name is found in it."""
    bonus = F.lit(0.0)
    extension = file_extension(name)
    for suffix, points in fv.SCORE_EXTENSION.items():
        bonus = F.when(extension == suffix, points).otherwise(bonus)
    score = F.lit(fv.SCORE_BASE) + F.when(
        kind == fv.KIND_TABLE, fv.SCORE_KIND_TABLE
    ).otherwise(bonus)
    lowered = F.lower(description)
    for word in keywords:
        score = score + F.when(lowered.contains(word), fv.SCORE_KEYWORD).otherwise(0.0)
    return score
