"""Result rows, the execution log and their derived views."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from metadoc import fixed_values as fv
from metadoc.functions.levels import object_level
from metadoc.functions.text import fill
from metadoc.runtime import materialize
from metadoc.schemas import OBJECT_KEYS, RESULTS

_VERDICT = ("criterio_fallido", "detalles_criterio_fallido")


def level_of(rows):
    return rows.withColumn("level", object_level(F.col("nombre_tabla"), F.col("nombre_columna")))


def result_rows(comments, execution_id, written_at):
    """Result rows without id: status by default approved, reviewer and verdict columns empty.

    ``comments`` has the four object name columns, ``comentario`` and, optionally, ``status``.
    ``execution_id`` and ``written_at`` are columns or values fixed once per run.
    """
    status = F.lit(fv.STATUS_APPROVED)
    if "status" in comments.columns:
        status = F.coalesce(F.col("status"), status)
    constant = [F.lit(None).cast("string").alias(name) for name in ("user_comments", *_VERDICT)]
    return comments.select(
        _as_column(execution_id).alias("id_ejecucion"),
        _as_column(written_at).cast("timestamp_ntz").alias("fecha_resultado"),
        *OBJECT_KEYS, "comentario", status.alias("status"), *constant,
    )


def _as_column(value):
    return F.lit(value) if isinstance(value, str) else value


def assign_ids(rows, key, start=0, order_by=()):
    """Consecutive ids after ``start``, without ordering all rows in one task.

    The rows are written once, partition by partition; ids are the position in the partition plus
    the number of rows in earlier partitions. Only one count per partition is ever ordered globally.
    """
    ordered = rows.orderBy(*order_by) if order_by else rows
    written = materialize(ordered.withColumn("at", F.monotonically_increasing_id()), "ids")
    written = written.withColumn("part", F.shiftright("at", 33))
    counts = written.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("part", F.coalesce(before, F.lit(0)).alias("offset"))
    within = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        written.join(F.broadcast(offsets), "part")  # one row per partition of the written table
        .withColumn(key, F.lit(start) + F.col("offset") + within + 1)
        .drop("part", "at", "offset")
    )


def filter_results(results, execution_id=None, only_approved=False):
    """The rows of one run and/or the approved ones; both conditions are optional."""
    if execution_id:
        results = results.filter(F.col("id_ejecucion") == execution_id)
    if only_approved:
        results = results.filter(F.col("status") == fv.STATUS_APPROVED)
    return results


def ordered_results(results):
    return results.orderBy(*OBJECT_KEYS)


def newest(rows, keys, order):
    """One whole row per key (null keys included): the last by ``order``, then by a hash of the row.

    Keys, order and hash decide; the other columns, long texts for instance, meet the choice in a semi-join.
    Of rows equal in every column one stays, so nothing depends on ids being unique or present.
    """
    named = rows.withColumn("_row", F.xxhash64(*rows.columns, *[F.col(name).isNull() for name in rows.columns]))
    last = named.groupBy(*[F.col(name).alias(f"_{name}") for name in keys]).agg(
        F.max(F.struct(*order, "_row")).alias("_last"))
    same = F.col("_row") == F.col("_last")["_row"]
    for name in keys:
        same &= F.col(name).eqNullSafe(F.col(f"_{name}"))
    for name in order:
        same &= F.col(name).eqNullSafe(F.col("_last")[name])
    return named.join(last, same, "left_semi").drop("_row").dropDuplicates(list(keys))


def latest_executions(events):
    """Last state per execution out of appended state changes ``(…, seq)``; newest time, then seq."""
    return newest(events, ["id_ejecucion"], ["fecha_ejecucion", "seq"]).select(
        "id_ejecucion", "fecha_ejecucion", "estado", "resultado")


def latest_approved(results):
    """The newest approved comment per object, one whatever the ids: by date, id, then the row itself."""
    approved = results.filter(F.col("status") == fv.STATUS_APPROVED).select(
        *OBJECT_KEYS, "id_resultado", "id_ejecucion", "fecha_resultado", "comentario")
    return newest(approved, OBJECT_KEYS, ["fecha_resultado", "id_resultado"])


def one_per_key(changes, key, order_by=()):
    """The last change per key by ``order_by``, then by the changed values themselves."""
    values = [name for name in changes.columns if name != key]
    order = [F.col(name) for name in order_by] + [F.struct(*values)]
    return changes.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("last")).select(
        key, "last.*")


def conflicts(changes, key):
    """The keys with several different changes, and how many."""
    values = [name for name in changes.columns if name != key]
    return changes.groupBy(key).agg(F.count_distinct(F.struct(*values)).alias("changes")).filter("changes > 1")


def replace_by_key(rows, changes, key, columns, order_by=()):
    """``rows`` with ``columns`` taken from ``changes`` where the key is present, null included.

    A key counts once, with its last change (see ``one_per_key``): rows never multiply.
    """
    changes = one_per_key(changes.select(key, *dict.fromkeys([*columns, *order_by])), key, order_by)
    marked = changes.select(
        key, *[F.col(name).alias(f"new_{name}") for name in columns], F.lit(True).alias("changed")
    )
    joined = rows.join(marked, key, "left")
    return joined.select(*[
        F.when(F.col("changed"), F.col(f"new_{name}")).otherwise(F.col(name)).alias(name)
        if name in columns else F.col(name)
        for name in rows.columns
    ])


def apply_verdicts(results, verdicts):
    """Set both verdict columns by ``id_resultado``; a passed row has them reset to null."""
    return replace_by_key(results, verdicts, "id_resultado", _VERDICT)


def _digest(names):
    """128 bits of a row's values. Hashes pass over nulls, so which values are null is a value too."""
    missing = [F.col(name).isNull() for name in names]
    return F.struct(F.xxhash64(*names, *missing).alias("a"), F.xxhash64(F.lit(1), *missing, *names).alias("b"))


def snapshot_changes(old, new, key="id_resultado"):
    """Row changes between two snapshots: insert, update or delete, with the new or last values.

    Keys are compared by digests of their rows; only rows whose digests differ are fetched whole.
    """
    values = [name for name in new.columns if name != key]
    named = lambda rows: rows.select(key, *values, _digest(values).alias("_digest"))
    left = old.select(F.col(key), _digest(values).alias("old"))
    right = new.select(F.col(key), _digest(values).alias("new"))
    kind = (
        F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete")
        .when(F.col("old") != F.col("new"), "update")
    )
    changes = materialize(
        left.join(right, key, "full").withColumn("change", kind).filter(F.col("change").isNotNull())
        .select(F.col(key).alias("_key"), "change", F.coalesce("new", "old").alias("_of")).distinct(), "changes")
    deleted = F.col("change") == "delete"

    def fetched(rows, which):
        same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_digest.a") == F.col("_of.a")) & (F.col("_digest.b") == F.col("_of.b"))
        return named(rows).join(changes.filter(which), same).select(key, "change", *values)

    return fetched(new, ~deleted).unionByName(fetched(old, deleted))


def with_execution(results, executions):
    """Results with state and summary of the run they belong to."""
    return results.join(
        executions.select("id_ejecucion", "fecha_ejecucion", "estado", "resultado"), "id_ejecucion"
    )


def orphans(results, executions):
    return results.join(executions.select("id_ejecucion"), "id_ejecucion", "left_anti")


def first_errors(errors, group, most, order=("position",)):
    """The first error messages per group, joined by ``; ``; cut down before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    first = errors.withColumn("nth", F.row_number().over(window)).filter(F.col("nth") <= most)
    parts = F.sort_array(F.collect_list(F.struct("nth", "message")))
    return first.groupBy(*group).agg(
        F.array_join(F.transform(parts, lambda part: part["message"]), "; ").alias("first_errors")
    )


def run_summary(outcomes, scope_name, scope_counts, group=("id_ejecucion",)):
    """(group, counts, estado, resultado) out of one row per handled object.

    ``outcomes`` has ``level``, ``message`` (null when fine) and ``position``; ``scope_counts`` has
    ``group``, ``scope_schemas`` and ``scope_tables``, one row per run, also for runs without outcomes.
    """
    group = list(group)
    fine = F.col("message").isNull()
    counts = outcomes.groupBy(*group).agg(
        *[F.count(F.when(fine & (F.col("level") == level), 1)).alias(name)
          for level, name in (("schema", "schemas"), ("table", "tables"), ("column", "columns"))],
        F.count("message").alias("errors"),
    )
    messages = first_errors(outcomes.filter(~fine), group, fv.SUMMARY_ERRORS)
    joined = scope_counts.join(counts, group, "left").join(messages, group, "left").fillna(
        0, ["schemas", "tables", "columns", "errors"]
    )
    numbers = {
        name: F.col(name).cast("string")
        for name in ("schemas", "tables", "columns", "errors", "scope_schemas", "scope_tables")
    }
    failed = F.col("errors") > 0
    text = F.when(
        failed, fill(fv.SUMMARY_ERRORS_TEXT, first_errors=F.col("first_errors"), **numbers)
    ).otherwise(fill(fv.SUMMARY_OK, scope=F.lit(scope_name), **numbers))
    return joined.select(
        *group, "schemas", "tables", "columns", "errors",
        F.when(failed, fv.RUN_DONE_WITH_ERRORS).otherwise(fv.RUN_DONE).alias("estado"),
        text.alias("resultado"),
    )


def as_results(rows):
    """Columns in the order of the control table."""
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RESULTS])
