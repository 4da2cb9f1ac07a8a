"""Helpers of several operators: reading tables, dealing rows out, connected components."""

from pyspark.sql import functions as F

from metadoc.runtime import deal, materialize

__all__ = ["components", "dealt", "materialize", "small", "table"]


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A side is broadcast only after counting that it has no more rows than this. Rows of such sides are a
#: few longs wide, so that this is below 20 MB.
BROADCAST_ROWS = 200_000


#: Sides with arrays are broadcast only if these hold no more elements than this in all, some 40 MB of words.
BROADCAST_ELEMENTS = 2_000_000


def small(df, elements=None, rows=BROADCAST_ROWS):
    """``df`` with a broadcast hint if it is counted to be small, else as it is (joined by shuffle).

    ``elements`` is the number of array elements of a row, for rows that are not of one width.
    """
    counted = df.limit(rows + 1).agg(F.count("*"), F.sum(F.lit(0) if elements is None else elements)).first()
    return F.broadcast(df) if counted[0] <= rows and (counted[1] or 0) <= BROADCAST_ELEMENTS else df


def dealt(df, *keys):
    """Rows dealt out anew ahead of a step that costs far more than reading them."""
    return deal(df, *keys)


def _signature(edges):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()


def components(edges, label="components"):
    """Connected components of the links ``(u, v)``: one row ``(node, root)`` per linked node.

    ``root`` is the smallest node of the component. Alternates large-star and small-star steps until
    the links are stars; each round is written to the shared folder, so that lineage stays short and a
    lost executor costs one round at most. Links, nodes and roots never leave the executors. Rows with
    a null end, and links of a node with itself, count as no link. No links give no rows.
    """
    links = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = materialize(links.filter("u <> v").distinct(), label)
    seen = _signature(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = materialize(large, label)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        inner = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(inner.unionByName(least.withColumnRenamed("m", "v")).distinct(), label)
        if (found := _signature(now)) == seen:
            break
        seen = found
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
