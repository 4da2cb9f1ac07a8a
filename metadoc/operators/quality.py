"""The rules of the control tables, as checks that return the rows in violation."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from metadoc import fixed_values as fv
from metadoc.schemas import EXECUTION_LENGTHS, GOLDEN_LENGTHS, RESULT_LENGTHS

NOT_NULL = {
    "executions": ("id_ejecucion",),
    "results": ("id_ejecucion", "status"),
    "golden": ("object_id", "object_level"),
}
DOMAINS = {
    "results": {"status": fv.STATUSES},
    "golden": {"object_level": fv.LEVELS},
}
LENGTHS = {"executions": EXECUTION_LENGTHS, "results": RESULT_LENGTHS, "golden": GOLDEN_LENGTHS}


def _violations(rows, key, tests):
    """(key, column, …) for every row and every failing test, in one pass."""
    found = [
        F.when(failing, F.struct(F.lit(name).alias("column_name"), detail.alias("detail")))
        for name, failing, detail in tests
    ]
    return (
        rows.select(F.col(key).cast("string").alias("row_key"),
                    F.explode(F.array_compact(F.array(*found))).alias("found"))
        .select("row_key", "found.column_name", "found.detail")
    )


def rule_violations(rows, table, key):
    """All rules of a control table in one scan: its violations, and totals that come with them for free.

    ``table`` is ``executions``, ``results`` or ``golden``. Returns ``(violations, totals)``: rows
    ``(row_key, rule, column_name, detail)``, and an Observation that holds, once the violations have been
    read or written, ``rows`` and the number of violations per rule (``null``, ``length``, ``domain``).
    """
    tests = [("null", name, F.col(name).isNull(), F.lit(None).cast("string")) for name in NOT_NULL[table]]
    tests += [("length", name, F.length(name) > most, F.length(name).cast("string")) for name, most in LENGTHS[table].items()]
    tests += [("domain", name, ~F.col(name).isin(*values), F.col(name)) for name, values in DOMAINS.get(table, {}).items()]
    found = F.array_compact(F.array(*[
        F.when(failing, F.struct(F.lit(rule).alias("rule"), F.lit(name).alias("column_name"), detail.alias("detail")))
        for rule, name, failing, detail in tests]))
    totals = Observation()
    of_rule = lambda rule: F.coalesce(F.sum(F.size(F.filter("found", lambda x: x["rule"] == rule))), F.lit(0))
    checked = rows.select(F.col(key).cast("string").alias("row_key"), found.alias("found")).observe(
        totals, F.count("*").alias("rows"), *[of_rule(rule).alias(rule) for rule in ("null", "length", "domain")])
    violations = checked.select("row_key", F.explode("found").alias("found")).select("row_key", "found.*")
    return violations, totals


def null_violations(rows, key, columns):
    return _violations(
        rows, key, [(name, F.col(name).isNull(), F.lit("null")) for name in columns]
    ).select("row_key", "column_name")


def length_violations(rows, key, limits):
    tests = [
        (name, F.length(name) > most, F.length(name).cast("string")) for name, most in limits.items()
    ]
    return _violations(rows, key, tests)


def domain_violations(rows, key, domains):
    """Values outside their list; null is not a violation of a check."""
    tests = [(name, ~F.col(name).isin(*values), F.col(name)) for name, values in domains.items()]
    return _violations(rows, key, tests)


def duplicate_keys(rows, keys):
    """Keys that occur more than once; counts are combined before the shuffle."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def missing_columns(expected, actual):
    return sorted(set(expected) - set(actual))


def checked_golden(golden):
    """The golden set, if it has the required columns and at least one row."""
    missing = missing_columns(fv.GOLDEN_COLUMNS, golden.columns)
    if missing:
        raise ValueError(f"the golden set lacks columns: {', '.join(missing)}")
    if golden.isEmpty():
        raise ValueError("the golden set is empty")
    return golden
