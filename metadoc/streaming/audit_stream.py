"""Checking comments as they arrive.

Appended result rows are read as a stream; every micro-batch is checked and written to a folder of
its own, a delta, and the newest row per id counts. What is newest is told by the rows themselves (their
date, then the time of their file), so a replay with other batches changes nothing. The id alone decides,
hence no watermark and no state.

Deltas are merged into a base from time to time, so that reading costs the base and the few deltas that
are still open, never the whole history::

    delta/<batch>-<writer>     rows of a batch
    base/<n>/rows              the newest row per id of all deltas up to then
    base/<n>/covers            the names of the deltas in it, written last: without it there is no base n

A delta's name is never used again, so a replay after a merge makes new deltas of old rows, which lose
against equal or newer ones in the base. Deltas and bases are removed one merge after they were replaced,
which gives readers that have begun the time until then. One writer at a time writes and merges.
"""

import uuid

from pyspark.sql import functions as F

from metadoc.functions.levels import object_level
from metadoc.functions.scorers import deterministic_scores, style_flags
from metadoc.operators.results import newest
from metadoc.runtime import BROADCAST_ROWS, folders, remove


#: What orders the versions of a row, as far as rows have it.
ORDER = ("fecha_resultado", "file_time")


def result_stream(spark, path, schema, **options):
    """New files of result rows below ``path``, with the time of their file."""
    rows = spark.readStream.schema(schema).options(**options).parquet(path)
    return rows.select("*", F.col("_metadata.file_modification_time").alias("file_time"))


def _order(rows):
    return [name for name in ORDER if name in rows.columns]


def flagged(rows, key="id_resultado", max_chars=500):
    """(key, flags, order) per result row; the same for a batch and for a stream."""
    comment = F.coalesce("comentario", F.lit(""))
    level = object_level(F.col("nombre_tabla"), F.col("nombre_columna"))
    return rows.select(
        key, *deterministic_scores(comment, max_chars), *style_flags(comment, level, max_chars),
        *_order(rows)
    )


def write_batches(rows, path, check=None, key="id_resultado", merge_at=16):
    """foreachBatch sink. ``check`` turns a batch of rows into what is stored, for instance verdicts
    of ``plans.audit.audit``; by default the rows are stored as they are. Of several versions of a row
    in a batch the newest is checked, and its order is stored along. With ``merge_at`` open deltas these
    are merged."""
    writer = uuid.uuid4().hex

    def write(batch, batch_id):
        spark, order = batch.sparkSession, _order(batch)
        if order:
            batch = newest(batch, [key], order)
        found = batch if check is None else check(batch)
        missing = [name for name in order if name not in found.columns]
        if missing:
            found = found.join(batch.select(key, *missing), key)
        found = found.withColumn("batch", F.lit(batch_id).cast("long"))
        found.write.mode("overwrite").parquet(f"{path}/delta/{batch_id}-{writer}")
        if len(_state(spark, path)[2]) >= merge_at:
            merge_deltas(spark, path, key)

    return rows.writeStream.foreachBatch(write)


def run_available(writer, checkpoint):
    """Process everything that is there and stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _bases(spark, path):
    """Numbers of the finished bases, newest last."""
    return [n for n in sorted(map(int, folders(spark, f"{path}/base", "covers")))
            if "covers" in folders(spark, f"{path}/base/{n}")]


def _state(spark, path):
    """Number of the newest base (or None), names of the deltas in it, names of the open ones."""
    bases = _bases(spark, path)
    covered = set()
    if bases:
        covered = {r.value for r in spark.read.text(f"{path}/base/{bases[-1]}/covers").collect()}
    return bases[-1] if bases else None, covered, [n for n in folders(spark, f"{path}/delta") if n not in covered]


def _latest(spark, path, key):
    """The newest row per id out of the base and the open deltas, with its order."""
    base, _, opened = _state(spark, path)
    held = spark.read.parquet(f"{path}/base/{base}/rows") if base is not None else None
    if not opened:
        return held
    deltas = spark.read.parquet(*[f"{path}/delta/{name}" for name in opened])
    order = [*_order(deltas), "batch"]
    fresh = newest(deltas, [key], order)
    if held is None:
        return fresh
    # The base stays where it is: the few rows that are newer take the places of its own.
    orders = lambda rows, name: rows.select(F.col(key).alias(f"{name}_key"), F.struct(*order).alias(name))
    count = fresh.select(key).limit(BROADCAST_ROWS + 1).count()
    small = F.broadcast if count <= BROADCAST_ROWS else (lambda rows: rows)
    older = held.join(small(orders(fresh, "fresh")), F.col(key).eqNullSafe(F.col("fresh_key")), "left").filter(
        F.col("fresh").isNull() | (F.struct(*order) >= F.col("fresh"))).select(*held.columns)
    stays = held.select(F.col(key).alias("held_key"), F.struct(*order).alias("held"))
    # Only base rows that a delta touches are needed to tell which fresh rows count.
    touched = stays.join(small(fresh.select(F.col(key).alias("of"))), F.col("held_key").eqNullSafe(F.col("of")), "left_semi")
    newer = fresh.join(touched, F.col(key).eqNullSafe(F.col("held_key")), "left").filter(
        F.col("held").isNull() | (F.struct(*order) > F.col("held"))).select(*held.columns)
    return older.unionByName(newer)


def merge_deltas(spark, path, key="id_resultado"):
    """A new base of the last one and the open deltas; what the last one had replaced is removed."""
    base, covered, opened = _state(spark, path)
    if not opened:
        return
    bases = _bases(spark, path)
    number = 0 if base is None else base + 1
    _latest(spark, path, key).write.mode("overwrite").parquet(f"{path}/base/{number}/rows")
    still = [name for name in covered if name in folders(spark, f"{path}/delta")]
    names = spark.createDataFrame([(name,) for name in [*opened, *still]], "value string")
    names.coalesce(1).write.mode("overwrite").text(f"{path}/base/{number}/covers")
    for name in still:
        remove(spark, f"{path}/delta/{name}")
    for old in bases[:-1]:
        remove(spark, f"{path}/base/{old}")


def current(spark, path, key="id_resultado"):
    """The newest row per id out of the base and the open deltas; rows without an order go by their batch."""
    rows = _latest(spark, path, key)
    return rows.select(key, *[name for name in rows.columns if name not in (key, "batch", *ORDER)])
