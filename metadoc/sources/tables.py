"""Tables as text."""

from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from metadoc import fixed_values as fv
from metadoc.functions.text import cell, header_text, row_text


def first_rows(table, columns, rows):
    """The first ``rows`` rows of a stored table, with ``_file`` and ``_at``; None if it has no files with row numbers.

    Files go by name. Only as many of the first files are opened as are needed, which their row counts, kept
    in the footers, tell: a large table costs no more than a small one.
    """
    try:
        placed = table.select(
            *[F.col(f"`{name}`") for name in columns], F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.row_index").alias("_at"))
    except AnalysisException:
        return None
    files, some = sorted(table.inputFiles()), 1
    if not files:
        return placed.limit(0)
    # Without a host, paths are written with one slash or with three.
    among = lambda n: F.col("_file").isin([x for f in files[:n] for x in (f, f.replace(":///", ":/"))])
    while some < len(files) and placed.filter(among(some)).count() < rows:
        some *= 4
    return placed.filter(among(some) & (F.col("_at") < rows)).orderBy("_file", "_at").limit(rows)


def table_text(table, columns=(), order_by=(), rows=fv.CONTEXT_TABLE_ROWS,
               width=fv.CONTEXT_CELL_CHARS):
    """One row ``content``: a header line and the first rows, or a fixed text for no rows.

    Without ``order_by`` the rows of a stored table come by file and position (see ``first_rows``). Other
    frames are ordered by the shown columns, so that the text is repeatable; columns that have no order
    (maps and variants) go by their text.
    """
    shown = list(columns) or table.columns
    kinds = dict(table.dtypes)
    if not order_by and (stored := first_rows(table, shown, rows)) is not None:
        first, order = stored, [F.col("_file"), F.col("_at")]
    else:
        order = [
            F.to_json(F.col(f"`{name}`")) if kinds[name].startswith(("map<", "variant")) else F.col(f"`{name}`")
            for name in (list(order_by) or shown)]
        first = table.orderBy(*order).limit(rows)
    first = first.select(
        F.row_number().over(Window.orderBy(*order)).alias("nth"), row_text(shown, width).alias("line")
    )
    body = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("nth", "line"))), lambda r: r["line"]), "\n"
    )
    content = F.when(F.count("*") == 0, fv.EMPTY_TABLE_TEXT).otherwise(
        F.concat(F.lit(header_text(shown) + "\n"), body)
    )
    return first.agg(content.alias("content"))


def rows_text(rows, group, shown=fv.CONTEXT_TABLE_ROWS, width=fv.CONTEXT_CELL_CHARS):
    """Text per group out of rows ``(*group, row_no, cells)`` whose first row is the header.

    Longer groups show their first and last rows around a line of dots. Only rows that will be shown
    are collected, and they are cut down before the shuffle.
    """
    group, half = list(group), shown // 2
    first = Window.partitionBy(*group).orderBy("row_no")
    last = Window.partitionBy(*group).orderBy(F.desc("row_no"))
    counts = rows.groupBy(*group).agg(F.count("*").alias("count"))
    head = rows.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= shown + 1)
    tail = rows.withColumn("nth", F.row_number().over(last)).filter(F.col("nth") <= half)
    long = F.col("count") - 1 > shown
    head = head.join(counts, group).filter(~long | (F.col("nth") <= half + 1))
    tail = tail.join(counts, group).filter(long)
    kept = head.withColumn("part", F.lit(0)).unionByName(tail.withColumn("part", F.lit(1)))
    kept = kept.withColumn(
        "columns", F.max(F.when((F.col("part") == 0) & (F.col("nth") == 1), F.size("cells")))
        .over(Window.partitionBy(*group))
    )
    at = F.sequence(F.lit(0), F.col("columns") - 1)
    line = F.array_join(F.transform(at, lambda i: cell(F.get("cells", i), width)), " | ")
    line = F.when(
        (F.col("part") == 0) & long & (F.col("nth") == half + 1), F.concat(line, F.lit("\n..."))
    ).otherwise(line)
    lines = F.sort_array(F.collect_list(F.struct("row_no", line.alias("line"))))
    text = F.array_join(F.transform(lines, lambda r: r["line"]), "\n")
    return kept.groupBy(*group).agg(
        F.when(F.max("count") == 1, F.lit(fv.EMPTY_TABLE_TEXT)).otherwise(text).alias("content")
    )
