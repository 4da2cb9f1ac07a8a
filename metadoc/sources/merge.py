"""All context sources of one or more manifests."""

import uuid

from pyspark.sql import functions as F

from metadoc import fixed_values as fv
from metadoc.runtime import append_each, materialize, shared_dir
from metadoc.sources.files import load_files, named_texts
from metadoc.sources.manifests import manifest_entries
from metadoc.sources.tables import table_text


def merged_sources(entries):
    """One entry per name: the values of the last, at the position of the first.

    ``ord`` numbers all entries in manifest order. Only names that occur twice are looked at again,
    so contents are not shuffled for this.
    """
    repeated = entries.groupBy("name").agg(
        F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord")
    ).filter("first_ord < last_ord")
    marked = entries.join(repeated, "name", "left")
    return (
        marked.filter(F.col("last_ord").isNull() | (F.col("ord") == F.col("last_ord")))
        .withColumn("ord", F.coalesce("first_ord", "ord"))
        .drop("first_ord", "last_ord")
    )


def with_order(entries, manifest_order):
    """Number entries by manifest, then files before tables, then position."""
    at = F.array_position(F.array(*[F.lit(name) for name in manifest_order]), F.col("manifest")) - 1
    table = F.when(F.col("kind") == fv.KIND_TABLE, 1).otherwise(0)
    return entries.withColumn(
        "ord", (at * 2 + table).cast("long") * F.lit(1 << 52) + F.col("position")
    )


def table_contents(spark, entries):
    """(name, hint_columns, content, error) per entry of kind table.

    The driver streams the names, as only it can resolve them; the texts are built by Spark, one row
    each, and appended to a shared table.
    """
    path = f"{shared_dir(spark)}/metadoc/context-tables-{uuid.uuid4().hex}"
    schema = "name string, hint_columns array<string>, content string, error string"
    spark.createDataFrame([], schema).write.parquet(path)

    def labels(name, hint):
        return [F.lit(name).alias("name"),
                F.lit(list(hint)).cast("array<string>").alias("hint_columns")]

    def text_of(name, hint):
        quoted = ".".join(f"`{part}`" for part in name.split("."))
        return table_text(spark.table(quoted), hint).select(
            *labels(name, hint), "content", F.lit(None).cast("string").alias("error")
        )

    def failed(label, problem):
        return spark.range(1).select(
            *labels(*label), F.lit(None).cast("string").alias("content"),
            F.lit(str(problem)[:200]).alias("error"),
        )

    wanted = entries.select("name", "hint_columns").distinct().toLocalIterator()
    append_each(spark, path, ((tuple(e), lambda e=e: text_of(*e)) for e in wanted), failed)
    return spark.read.schema(schema).parquet(path)


def load_sources(spark, folder, manifests):
    """Sources of the given manifest files below ``folder``, and the entries that failed.

    A missing manifest counts as empty. Returns ``(sources, failed)``; ``failed`` has
    ``(manifest, name, error)``, hinted sheets that a workbook does not have included: it is then read
    without them.
    """
    texts = named_texts(spark, folder, manifests).withColumnRenamed("name", "manifest")
    entries = with_order(manifest_entries(texts), manifests)
    entries = materialize(entries, "manifest-entries")
    files = entries.filter(F.col("kind") == fv.KIND_FILE)
    # With several hints for one workbook the last entry decides, as it does for the values.
    by_name = files.groupBy("name").agg(F.max_by("hint_tabs", "ord").alias("hint_tabs"))
    file_texts, missing = load_files(spark, folder, by_name)
    table_texts = table_contents(spark, entries.filter(F.col("kind") == fv.KIND_TABLE))
    loaded = files.join(file_texts, "name", "left").withColumn(
        "error", F.when(F.col("content").isNull(), "not found or not readable")
    ).unionByName(
        entries.filter(F.col("kind") == fv.KIND_TABLE)
        .join(table_texts, ["name", "hint_columns"], "left")
    )
    loaded = materialize(loaded, "sources")
    failed = loaded.filter(F.col("error").isNotNull()).select("manifest", "name", "error").unionByName(
        files.select("manifest", "name").distinct().join(missing, "name").select(
            "manifest", "name", F.concat(F.lit("sheet not found: "), "sheet").alias("error")))
    merged = merged_sources(loaded.filter(F.col("error").isNull()).drop("error"))
    sources = merged.select(
        "ord", "name", "description", "content", F.length("content").alias("size"), "kind",
        "hint_tabs", "hint_columns", "manifest",
    )
    return sources, failed
