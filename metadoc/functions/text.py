"""Text expressions shared by the operators."""

import re

from pyspark.sql import functions as F

from metadoc import fixed_values as fv

# What Python's str.strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(col, chars=WHITESPACE):
    return F.btrim(col, F.lit(chars))


def or_empty(col):
    return F.coalesce(col, F.lit(""))


def blank_to_null(col):
    return F.nullif(col, F.lit(""))


def file_extension(name):
    """Lower-case extension with its dot; leading dots do not start one."""
    return F.lower(F.regexp_extract(name, r"[^./][^/]*(\.[^./]*)\z", 1))


def is_three_part(name):
    return F.length(name) - F.length(F.replace(name, F.lit("."), F.lit(""))) == 2


def quote_name(name):
    return F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))


def quote_path(*names):
    return F.concat_ws(".", *[quote_name(name) for name in names])


def sql_string(value):
    """A SQL literal; backslashes and quotes survive unchanged, null becomes the empty text."""
    escaped = F.replace(or_empty(value), F.lit("\\"), F.lit("\\\\"))
    return F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("''")), F.lit("'"))


def hint_items(description, pattern):
    """Items of the first ``[label: a, "b"]`` hint in ``description``; no hint gives no items."""
    listed = F.regexp_extract(or_empty(description), "(?iU)" + pattern, 1)
    kept = F.filter(F.split(listed, ","), lambda item: strip(item) != "")
    return F.transform(kept, lambda item: strip(strip(item), "\"'`"))


def hint_tabs(description):
    return hint_items(description, fv.HINT_TABS_PATTERN)


def hint_columns(description):
    return hint_items(description, fv.HINT_COLUMNS_PATTERN)


def fill(template, **columns):
    """Concatenate ``template`` with a column in place of every ``{name}``."""
    parts = []
    for piece in re.split(r"(\{\{|\}\}|\{\w+\})", template):
        if piece in ("{{", "}}"):
            parts.append(F.lit(piece[0]))
        elif piece.startswith("{"):
            parts.append(columns[piece[1:-1]])
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def when_present(value, text):
    """``text`` when ``value`` is neither null nor empty, else the empty text."""
    return F.when(or_empty(value) != "", text).otherwise(F.lit(""))


def cell(value, width):
    """One table cell as text: nulls named, line breaks shown, long values cut to ``width``."""
    text = F.coalesce(value.cast("string"), F.lit("NULL"))
    text = F.replace(F.replace(text, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))
    return F.when(
        F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))
    ).otherwise(text)


def row_text(columns, width):
    return F.concat_ws(" | ", *[cell(F.col(f"`{name}`"), width) for name in columns])


def header_text(columns):
    return " | ".join(columns)
