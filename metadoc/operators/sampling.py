"""Row samples of tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from metadoc import fixed_values as fv
from metadoc.functions.text import header_text, row_text


def sample_size(rows, pct):
    """All rows of a small table, else the given percentage, at least one; zero for no rows."""
    share = F.greatest(F.floor(rows * F.lit(pct) / 100), F.lit(1))
    return F.when(rows <= fv.SAMPLE_ALL_UP_TO, rows).otherwise(share).cast("long")


def table_sample_text(table, pct, seed=42, kept=fv.SAMPLE_ROWS_KEPT,
                      columns_kept=fv.SAMPLE_COLUMNS_KEPT, width=fv.SAMPLE_CELL_CHARS):
    """One row ``sample``: a random sample of one table as text.

    Only the rows that will be shown are requested, which is a top-k by random number and not a sort
    of the table. The seed makes runs on the same files repeatable.
    """
    shown = table.columns[:columns_kept]
    size = table.agg(F.least(sample_size(F.count("*"), pct), F.lit(kept)).alias("size"))
    drawn = (
        table.select(*[F.col(f"`{name}`") for name in shown], F.rand(seed).alias("draw"))
        .orderBy("draw").limit(kept)
        .select("draw", row_text(shown, width).alias("line"))
    )
    numbered = drawn.withColumn("nth", F.row_number().over(Window.orderBy("draw")))
    numbered = numbered.filter(F.col("nth") <= size.scalar())
    lines = F.transform(F.sort_array(F.collect_list(F.struct("nth", "line"))), lambda r: r["line"])
    text = F.concat(F.lit(header_text(shown) + "\n"), F.array_join(lines, "\n"))
    return numbered.agg(
        F.when(F.count("*") == 0, fv.EMPTY_TABLE_TEXT).otherwise(text).alias("sample")
    )


def sample_sizes(rows, group, pct):
    """(group, row_count, sample_size) for many tables stacked in one frame."""
    counts = rows.groupBy(*group).agg(F.count("*").alias("row_count"))
    return counts.withColumn("sample_size", sample_size(F.col("row_count"), pct))


def stacked_samples(rows, group, key, pct, seed=42, kept=fv.SAMPLE_ROWS_KEPT):
    """Sampled rows of many stacked tables, ordered by a hash of ``key`` and the seed.

    The rank limit is applied before the shuffle as well, so a large table is cut down in every task.
    """
    draw = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    window = Window.partitionBy(*group).orderBy("draw", key)
    drawn = (
        rows.withColumn("draw", draw)
        .withColumn("nth", F.row_number().over(window)).filter(F.col("nth") <= kept)
    )
    sizes = sample_sizes(rows.select(*group), group, pct)
    return drawn.join(sizes, [*group]).filter(F.col("nth") <= F.col("sample_size")).drop("draw")


def samples_as_text(drawn, group, columns, width=fv.SAMPLE_CELL_CHARS,
                    columns_kept=fv.SAMPLE_COLUMNS_KEPT):
    """(group, sample): the drawn rows of every stacked table as text."""
    shown = list(columns)[:columns_kept]
    lines = drawn.select(*group, F.struct("nth", row_text(shown, width).alias("line")).alias("row"))
    body = F.array_join(
        F.transform(F.sort_array(F.collect_list("row")), lambda r: r["line"]), "\n"
    )
    return lines.groupBy(*group).agg(
        F.concat(F.lit(header_text(shown) + "\n"), body).alias("sample")
    )


def calibration_sample(rows, key, size=30, seed=42):
    """``size`` rows in hash order, for review by an expert."""
    draw = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return rows.withColumn("draw", draw).orderBy("draw", key).limit(size).drop("draw")
