"""Manifests: lists of context files and tables with their purpose."""

from pyspark.sql import functions as F

from metadoc import fixed_values as fv
from metadoc.functions.text import WHITESPACE, hint_columns, hint_tabs, is_three_part, strip

# A line that starts, after blanks, with a hash opens a section.
_SECTION_START = "(?dm)^(?=[" + WHITESPACE.replace("\n", "") + "]*#)"
_LINES_PER_SECTION = 1 << 26


def manifest_entries(manifests, skip_html_comments=False):
    """Entries of whole manifest texts ``(manifest, text)``.

    Returns (manifest, position, kind, name, description, hint_tabs, hint_columns), ``position``
    rising in the order of the lines. Headings switch the section; other lines are entries when they
    hold a name, a colon and a purpose. HTML comments are no comments here unless asked for:
    commented examples are entries.

    A text is cut at its headings first, so every piece carries its own section and nothing has to
    be ordered or shuffled.
    """
    text = F.col("text")
    if skip_html_comments:
        text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    pieces = manifests.select("manifest", F.posexplode(F.split(text, _SECTION_START)).alias("piece_no", "piece"))
    heading = F.lower(strip(F.substring_index("piece", "\n", 1)))
    kind = F.when(heading.startswith("#"), F.when(heading.contains("archivo"), fv.KIND_FILE)
                  .when(heading.contains("tabla"), fv.KIND_TABLE))
    sections = pieces.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    lines = sections.select(
        "manifest", "kind", "piece_no", F.posexplode(F.split("piece", "\n")).alias("line_no", "line")
    ).filter((F.col("line_no") > 0) & F.col("line").contains(":"))
    colon = F.instr("line", ":")
    name = strip(F.btrim(strip(F.substr("line", F.lit(1), colon - 1)), F.lit("`")))
    # inline keeps the two texts from being worked out again in every condition below
    parsed = lines.select(
        "manifest",
        (F.col("piece_no").cast("long") * _LINES_PER_SECTION + F.col("line_no")).alias("position"),
        "kind",
        F.inline(F.array(F.struct(
            name.alias("name"), strip(F.substr("line", colon + 1)).alias("description")
        ))),
    )
    right = F.when(F.col("kind") == fv.KIND_FILE, F.col("name").contains(".")).otherwise(
        is_three_part(F.col("name"))
    )
    return parsed.filter((F.col("name") != "") & (F.col("description") != "") & right).select(
        "*", hint_tabs(F.col("description")).alias("hint_tabs"),
        hint_columns(F.col("description")).alias("hint_columns"),
    )
