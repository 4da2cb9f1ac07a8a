"""Run registered queries and their SQL side by side: ``python -m checks.compare [sf_dir] [names]``."""

import datetime
import math
import sys
import time

import duckdb

from checks.oracle import SQL
from checks.queries import QUERIES
from checks.views import TABLES
from metadoc.runtime import session


def connect(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _sorted(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=repr)


TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
         "boolean": "BOOLEAN"}


def compare(frame, db, sql):
    """Empty text if equal, else what differs."""
    found = db.sql(sql)
    want_types = dict(zip(found.columns, map(str, found.types)))
    have_types = {name: TYPES.get(kind, kind) for name, kind in frame.dtypes}
    if sorted(want_types) != sorted(have_types):
        return f"columns {sorted(have_types)} instead of {sorted(want_types)}"
    uneven = {n: (have_types[n], want_types[n]) for n in want_types if have_types[n] != want_types[n]}
    have = _sorted(frame.collect(), frame.columns)
    want = _sorted(found.fetchall(), found.columns)
    if len(have) != len(want):
        return f"{len(have)} rows instead of {len(want)}"
    if have != want:
        at = next(i for i in range(len(have)) if have[i] != want[i])
        return f"row {at}: {str(have[at])[:700]} instead of {str(want[at])[:700]}"
    return f"types {uneven}" if uneven else ""


def main(sf_dir="/root/testdata/sf0.01", names=()):
    spark = session("compare", "local[8]", 8, **{"spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf_dir)
    failed = []
    for name in names or QUERIES:
        started = time.time()
        try:
            frame = QUERIES[name](spark, sf_dir)
            problem = compare(frame, db, SQL[name]) if name in SQL else ""
            note = "" if name in SQL else f" rows only: {frame.count()}"
        except Exception as error:
            problem, note = f"{type(error).__name__}: {str(error)[:1500]}", ""
        print(f"{'FAIL' if problem else 'ok':4} {name:26} {time.time() - started:6.2f}s{note} {problem}")
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(*(sys.argv[1:2] or ["/root/testdata/sf0.01"]), names=sys.argv[2:]) else 0)
