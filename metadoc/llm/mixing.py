"""Mixing sources to target weights by capped water-filling.

Every source has a weight and a capacity: its size times the largest number of epochs. The total is dealt
out by weight; a source whose share is above its capacity is held there, and the excess goes to the open
sources by weight, until no share is above. All that a round needs is the water level, a fraction of two
whole numbers: a source is held if its capacity is below level times weight. Then each document of a
source is taken as often as whole epochs fit into the target, and once more if its seeded draw is not
above the source's threshold, or if it fills best what is then missing. Thresholds are found digit by digit, in sums per leading digits of the
draw, so no source is ever sorted or collected.
"""

from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from metadoc.llm.shared import materialize, small

#: A draw has 60 bits; a threshold is looked for in its first 12, then the next 12, then among what is left.
DRAW_BITS, DIGIT_BITS, DIGITS = 60, 12, 2
_SPACE = r"\x20\x09-\x0D"


def word_count(text):
    """The number of runs without ASCII white space, without an array of them; null counts as empty."""
    marked = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), f"[^{_SPACE}]+", "\x01")
    return F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")).cast("long")


def numbered(df, name, *order):
    """``df`` with its rows' positions from 0 in a global order, by ranges: no task sees all rows."""
    parts = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_ahead"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn(name, rank).join(F.broadcast(ahead), "_part").withColumn(
        name, F.col(name) + F.col("_ahead")).drop("_part", "_ahead")


def cycled(docs, weights, source_col="source"):
    """``(source, weight)``: the weights in turn, to the sources by code point, null last."""
    order = F.col("source").asc_nulls_last()
    named = numbered(docs.select(F.col(source_col).alias("source")).distinct(), "n", order)
    turn = F.array(*[F.lit(w).cast("long") for w in weights])
    return named.select("source", F.get(turn, (F.col("n") % len(weights)).cast("int")).alias("weight"))


def _whole(n):
    return F.lit(Decimal(int(n))).cast("decimal(38,0)")


def _held(num, den):
    """Whether a source's capacity is below the level ``num / den`` times its weight; in whole numbers."""
    return F.col("capacity").cast("decimal(38,0)") * _whole(den) < F.col("weight").cast("decimal(38,0)") * _whole(num)


def targets(sources, max_epochs=3, total=None):
    """``sources`` (``source, source_size, weight``) with its ``target``, as close to the weights as capacities allow.

    ``total`` is what the targets add up to, by default all sizes; if the capacities of the sources with a
    weight are less than that, the targets are these capacities.
    """
    sources = sources.withColumn("capacity", F.col("source_size") * max_epochs)
    sums = sources.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
    total = int(sums.t or 0) if total is None else int(total)
    num, den = total, int(sums.w or 0)
    while den:
        row = sources.agg(
            F.sum(F.when(_held(num, den), F.col("capacity"))).alias("held"),
            F.sum(F.when(~_held(num, den), F.col("weight"))).alias("open")).first()
        now = total - int(row.held or 0), int(row.open or 0)
        if now == (num, den):
            break
        # With no source left open all that have a weight are held: any higher level says so.
        num, den = now if now[1] else (total * max(1, den) + 1, 1)
        if not now[1]:
            break
    share = (F.col("weight").cast("decimal(38,0)") * _whole(num)).cast("double") / F.lit(float(den or 1))
    return sources.withColumn("target", F.when(_held(num, den or 1), F.col("capacity").cast("double")).otherwise(share))


def _boundary(sums, wanted):
    """Per source the group of draws in which the wanted size is reached, and the size of all groups below it."""
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("digit"))
    placed = sums.join(small(wanted.select(F.col("source").alias("_s"), "want")), F.col("source").eqNullSafe(F.col("_s")))
    placed = placed.withColumn("upto", upto + F.col("below")).withColumn("below", F.col("upto") - F.col("size"))
    return placed.filter("below <= want and want < upto").select("source", "digit", "below")


def _thresholds(rows, wanted):
    """``(_s, threshold, also)`` per source ``_s``: documents with draws up to the threshold stay below the wanted
    size, and those with the draw ``also`` (-1: none) come nearest to what is then missing."""
    within, shift = rows.withColumn("below", F.lit(0).cast("long")), DRAW_BITS
    for _ in range(DIGITS):
        shift -= DIGIT_BITS
        digit = F.shiftright("draw", shift).alias("digit")
        sums = within.groupBy("source", digit).agg(F.sum("size").alias("size"), F.first("below").alias("below"))
        found = materialize(_boundary(sums, wanted), "boundaries")
        within = rows.withColumn("digit", F.shiftright("draw", shift)).join(
            small(found.select(F.col("source").alias("_s"), F.col("digit").alias("_d"), "below")),
            F.col("source").eqNullSafe(F.col("_s")) & (F.col("digit") == F.col("_d"))).select(*rows.columns, "below")
    # Equal draws go together.
    sums = within.groupBy("source", "draw").agg(F.sum("size").alias("size"), F.first("below").alias("below"))
    upto = (F.sum("size").over(Window.partitionBy("source").orderBy("draw")) + F.col("below")).alias("upto")
    aim = small(wanted.select(F.col("source").alias("_s"), "want"))
    last = sums.select("source", "draw", upto).join(aim, F.col("source").eqNullSafe(F.col("_s"))).filter(
        "upto <= want").groupBy(F.col("source").alias("_s")).agg(F.max(F.struct("draw", "upto")).alias("last"))
    found = found.join(last, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        "source", F.coalesce("last.draw", F.shiftleft("digit", shift) - 1).alias("threshold"),
        F.coalesce("last.upto", "below").alias("reached"))
    found = found.join(aim, F.col("source").eqNullSafe(F.col("_s"))).select(
        F.col("source").alias("_s"), "threshold", (F.col("want") - F.col("reached")).alias("gap"))
    found = materialize(found, "gaps")
    # One more document of each source: the one that comes nearest to what is missing.
    off = F.abs(F.col("size") - F.col("gap"))
    nearest = rows.join(small(found), F.col("source").eqNullSafe(F.col("_s"))).filter(
        (F.col("draw") > F.col("threshold")) & (off < F.col("gap"))).groupBy("source").agg(
            F.min(F.struct(off.alias("off"), "draw")).alias("nearest"))
    return found.join(nearest, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        "_s", "threshold", F.coalesce("nearest.draw", F.lit(-1).cast("long")).alias("also"))


def mix(docs, weights, max_epochs=3, total=None, seed=42, id_col="doc_id", text_col="text", source_col="source"):
    """``(doc_id, source, size, source_size, target, repeats, taken)`` per row of ``docs``.

    ``weights`` has ``(source, weight)``, weights being whole numbers; sources that it does not name get
    nothing. A size is a number of words. ``taken`` is ``repeats`` times ``size``, ``repeats`` being the whole
    epochs of the source's target and, for documents drawn by ``seed``, one more, but never more than
    ``max_epochs``. What a source's documents take differs from its target by less than a document, and as a
    rule by far less, as the last one drawn is the one that fits best.

    Draws come from the id, the size and the seed, so reruns agree however the rows are dealt out. Rows of
    equal id and size share a draw: they are taken together. Null texts have size 0 and are taken with 0
    words. A null source is a source; a null id is an id like any other. Other columns are not looked at,
    and no rows give no rows.
    """
    size = word_count(F.col(text_col))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), size.cast("string")))
    rows = materialize(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"),
        F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("long").alias("draw")), "sizes")
    weighed = weights.groupBy(F.col("source").alias("_s")).agg(F.max("weight").cast("long").alias("weight"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = materialize(sizes.join(weighed, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        "source", "source_size", F.coalesce("weight", F.lit(0).cast("long")).alias("weight")), "sources")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    aims = targets(sources, max_epochs, total).withColumn("whole", epochs.cast("long"))
    aims = materialize(aims.withColumn("want", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    limits = _thresholds(rows.drop("doc_id"), aims)
    none = F.lit(-1).cast("long")
    aims = materialize(aims.join(limits, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        F.col("source").alias("_s"), "source_size", "target", "whole",
        F.when(F.col("want") > 0, F.col("threshold")).otherwise(none).alias("threshold"),
        F.coalesce("also", none).alias("also")), "thresholds")
    drawn = F.coalesce(F.col("draw") <= F.col("threshold"), F.lit(False)) | (F.col("draw") == F.col("also"))
    repeats = F.col("whole") + drawn.cast("long")
    return rows.join(small(aims), F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"),
        (repeats * F.col("size")).alias("taken"))


def repeated(docs, mixed, id_col="doc_id", text_col="text"):
    """The rows of ``docs`` as often as ``mixed`` takes them, with ``repeat`` counting from 0.

    Rows are told apart by id and size, by which they were drawn; rows that are taken 0 times go.
    """
    taken = mixed.select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), "repeats").filter("repeats > 0").distinct()
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (word_count(F.col(text_col)) == F.col("_size"))
    return docs.join(small(taken), same).withColumn(
        "repeat", F.explode(F.sequence(F.lit(0).cast("long"), F.col("repeats") - 1))).drop("_id", "_size", "repeats")
