"""Near-duplicates of embeddings: an exact range join in metric cells.

Unit vectors with cosine >= ``threshold`` lie within eps = sqrt(2 - 2 * threshold) of each other. Some
vectors of each label serve as pivots; every vector belongs to the cell of its nearest pivot. By the
triangle inequality a vector y of cell q can only have a neighbour in cell p if
d(y, p) <= d(y, q) + 2 eps; it is replicated to those cells p < q, where a second bound, the distance
to the plane between p and q, spares most of the copies. So every pair meets in exactly one cell, and
cells are joined independently. Large cells are cut into chunks and compared chunk by chunk, so that no
task holds more than two chunks. Out of a comparison come, per vector, the number of its links and one
link that joins it to its local component: never all pairs.
"""

import math
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from metadoc.llm.shared import components, dealt, materialize

_CLASS = "label string, dim int, digest binary, rep long, copies long, unit binary"
_HOMES = f"{_CLASS}, cell int, at int, home boolean"
_FOUND = "a long, b long, n long"


def _units(batches):
    """Unit vectors in double precision, and a digest of each; scaling first avoids overflow."""
    import hashlib

    for pdf in batches:
        out = []
        for vector in pdf["vector"]:
            x = np.asarray(vector, np.float64)
            x = x / np.abs(x).max()
            out.append((x / math.sqrt(float(x @ x)) + 0.0).tobytes())
        pdf = pdf.drop(columns="vector")
        pdf["unit"] = out
        pdf["digest"] = [hashlib.sha256(x).digest()[:16] for x in out]
        yield pdf


def _links_at_all(id_col, vector_col, label_col):
    vector = F.col(vector_col).cast("array<double>")
    return F.coalesce(
        F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.size(vector) > 0)
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vector, lambda x: x != 0), F.lit(False))


def valid_vectors(df, id_col, vector_col, label_col):
    """``(vec_id, label, dim, unit, digest)`` of the rows that can link at all."""
    vector = F.col(vector_col).cast("array<double>")
    rows = df.filter(_links_at_all(id_col, vector_col, label_col)).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
        F.size(vector).alias("dim"), vector.alias("vector"))
    return rows.mapInPandas(_units, "vec_id long, label string, dim int, unit binary, digest binary")


def _pivots(classes, cell_rows, most_pivots):
    """About one class in ``cell_rows`` per label, and at least one, chosen by a hash of its id.

    No more than about ``most_pivots`` in all (a bound on what every task holds); cells then grow, which
    costs time but loses nothing.
    """
    totals = classes.groupBy("label", "dim").agg(F.count("*").alias("n"), F.min("rep").alias("least"))
    sizes = totals.agg(F.sum("n").alias("n"), F.count("*").alias("k")).first()
    per = max(cell_rows, (sizes["n"] or 0) / most_pivots)
    one_in = F.lit(int(per))
    # Labels are as many as they are; each of them needs a first pivot, which is joined, not collected.
    chosen = classes.join(totals.select("label", "dim", "least"), ["label", "dim"]).filter(
        (F.col("rep") == F.col("least")) | (F.pmod(F.xxhash64("rep", F.lit(2)), one_in) == 0))
    return chosen.select("label", "dim", "unit").distinct(), sizes["k"]


def _assigned(pivots, eps, batches):
    """Each class at home in the cell of its nearest pivot, and a guest in others that may hold links."""
    for pdf in batches:
        for (label, dim), part in pdf.groupby(["label", "dim"]):
            first, units = pivots[(label, dim)]
            x = np.frombuffer(b"".join(part["unit"]), np.float64).reshape(len(part), dim)
            near = x @ units.T
            home = near.argmax(axis=1)
            own = near[np.arange(len(x)), home]
            apart = np.sqrt(np.maximum(0, 2 - 2 * units @ units.T))
            gap = np.sqrt(np.maximum(0, 2 - 2 * near)) - np.sqrt(np.maximum(0, 2 - 2 * own))[:, None]
            plane = (own[:, None] - near) - eps * apart[home]
            guest = (gap <= 2 * eps + 1e-9) & (plane <= 1e-9) & (np.arange(len(units)) < home[:, None])
            row, cell = np.nonzero(guest)
            for rows, cells, is_home in ((np.arange(len(x)), home, True), (row, cell, False)):
                if len(rows):
                    yield part.iloc[rows].assign(
                        cell=(first + cells).astype("int32"), home=is_home,
                        at=0)[["label", "dim", "digest", "rep", "copies", "unit", "cell", "at", "home"]]


def _forest(hit, left, right):
    """Links that join what ``hit`` joins, no more than one per row and column."""
    tags = np.concatenate([left, right])
    rows, cols = np.nonzero(hit)
    if not len(rows):
        return []
    cols = cols + len(left)
    # The same vector may stand on both sides: nodes are tags, not places.
    nodes, place = np.unique(tags, return_inverse=True)
    a, b = place[rows], place[cols]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.nonzero(label != np.arange(len(nodes)))[0]
    return [(int(nodes[i]), int(nodes[label[i]])) for i in moved]


def _compare(threshold, pdf):
    left, right = pdf[~pdf["right"]], pdf[pdf["right"]]
    same = right.empty and bool((pdf["i"] == pdf["j"]).all())
    right = left if same else right
    if left.empty or right.empty:
        return pd.DataFrame({"a": [], "b": [], "n": []})
    dim = int(pdf["dim"].iloc[0])
    x, y = (np.frombuffer(b"".join(p["unit"]), np.float64).reshape(len(p), dim) for p in (left, right))
    hit = x @ y.T >= threshold
    if same:
        np.fill_diagonal(hit, False)
    ids, others = left["rep"].to_numpy(), right["rep"].to_numpy()
    counts = [(ids, hit @ right["copies"].to_numpy())]
    if not same:
        counts.append((others, left["copies"].to_numpy() @ hit))
    out = [(int(i), None, int(n)) for who, many in counts for i, n in zip(who, many) if n]
    out += [(a, b, None) for a, b in _forest(hit, ids, others)]
    return pd.DataFrame(out, columns=["a", "b", "n"]).astype({"a": "Int64", "b": "Int64", "n": "Int64"})


def _chunked(members, chunk):
    """Rows of ``members`` copied to each comparison of two chunks that they take part in."""
    sizes = members.groupBy("cell").agg(
        F.ceil(F.count(F.when(F.col("home"), 1)) / chunk).cast("int").alias("h"),
        F.ceil(F.count(F.when(~F.col("home"), 1)) / chunk).cast("int").alias("g"))
    rows = members.join(F.broadcast(sizes), "cell").withColumn(
        "at", F.pmod(F.xxhash64("rep", F.lit(3)), F.when(F.col("home"), F.col("h")).otherwise(F.col("g"))).cast("int"))
    # Comparison (i, j): home chunk i with home chunk j >= i, or with guest chunk j - h.
    seq = lambda lo, hi: F.when(F.expr(f"{lo} <= {hi}"), F.sequence(F.expr(lo), F.expr(hi))).otherwise(
        F.array().cast("array<int>"))
    as_left = F.transform(seq("at", "h + g - 1"), lambda j: F.struct(F.col("at").alias("i"), j.alias("j"), F.lit(False).alias("right")))
    as_right = F.transform(seq("0", "at - 1"), lambda i: F.struct(i.alias("i"), F.col("at").alias("j"), F.lit(True).alias("right")))
    as_guest = F.transform(seq("0", "h - 1"), lambda i: F.struct(i.alias("i"), F.expr("h + at").alias("j"), F.lit(True).alias("right")))
    return rows.select("*", F.explode(F.when(F.col("home"), F.concat(as_left, as_right)).otherwise(as_guest)).alias("c")).select(
        "cell", "c.*", "dim", "rep", "copies", "unit")


def near_duplicates(df, id_col="vec_id", vector_col="embedding", label_col="label", threshold=0.98,
                    chunk=512, cell_rows=4096, most_pivots=4096):
    """``(vec_id, n_links, component_id, kept)`` for each row of ``df``.

    Two vectors link when their labels and lengths are equal and their cosine in double precision is
    at least ``threshold``. ``n_links`` counts the rows linked directly, equal vectors included;
    ``component_id`` is the smallest id reachable, ``kept`` says whether that is the row's own. Vectors
    that are null, empty, zero or hold null or non-finite components, and rows without a label or an id,
    link with nothing: no links, their own component, kept. Repeated rows are vectors like any other.
    Other columns are not looked at; no rows give no rows.
    """
    spark = df.sparkSession
    eps = math.sqrt(max(0.0, 2 - 2 * threshold))
    vectors = materialize(valid_vectors(df, id_col, vector_col, label_col), "vectors")
    classes = materialize(
        vectors.groupBy("label", "dim", "digest").agg(
            F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("unit").alias("unit")).withColumn(
                "rep", F.monotonically_increasing_id()),  # an id may have several vectors, so it names no class
        "vector-classes")
    pivots, n_labels = _pivots(classes, cell_rows, most_pivots)
    per_label = {}
    if n_labels <= most_pivots:
        at = 0
        for (label, dim), part in pivots.toPandas().sort_values(["label", "dim", "unit"]).groupby(["label", "dim"]):
            per_label[(label, int(dim))] = (at, np.frombuffer(b"".join(part["unit"]), np.float64).reshape(-1, dim))
            at += len(part)
        held = spark.sparkContext.broadcast(per_label)

        def assign(batches):
            return _assigned(held.value, eps, batches)

        members = materialize(dealt(classes, "rep").mapInPandas(assign, _HOMES), "vector-cells")
        compared = _chunked(members, chunk).groupBy("cell", "i", "j").applyInPandas(
            partial(_compare, threshold), _FOUND)
    else:
        # More labels than pivots: each label is a cell of its own.
        members = classes.select(
            "*", F.xxhash64("label", "dim").alias("cell"), F.lit(0).alias("at"), F.lit(True).alias("home"))
        compared = _many_labels(members, chunk).groupBy("label", "dim", "i", "j").applyInPandas(
            partial(_compare, threshold), _FOUND)
    found = materialize(compared, "vector-links")
    counts = found.filter("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    roots = components(found.filter("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v")), "vector-components")
    roots = roots.withColumnRenamed("node", "rep")
    firsts = classes.select("rep", "first_id").join(roots, "rep").groupBy("root").agg(F.min("first_id").alias("joint_id"))
    classes = classes.select("label", "dim", "digest", "rep", "first_id", "copies").join(counts, "rep", "left").join(
        roots.join(firsts, "root"), "rep", "left")
    linked = vectors.select("vec_id", "label", "dim", "digest").join(classes, ["label", "dim", "digest"]).select(
        "vec_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        F.coalesce("joint_id", "first_id").alias("component_id"))
    loose = _loose(df, id_col, vector_col, label_col)
    return linked.unionByName(loose).select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _many_labels(members, chunk):
    sizes = members.groupBy("label", "dim").agg(F.ceil(F.count("*") / chunk).cast("int").alias("h"))
    rows = members.join(sizes, ["label", "dim"]).withColumn(
        "at", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("h")).cast("int"))
    as_left = F.transform(F.expr("sequence(at, h - 1)"), lambda j: F.struct(F.col("at").alias("i"), j.alias("j"), F.lit(False).alias("right")))
    as_right = F.when(F.col("at") > 0, F.transform(F.expr("sequence(0, at - 1)"), lambda i: F.struct(
        i.alias("i"), F.col("at").alias("j"), F.lit(True).alias("right")))).otherwise(F.slice(as_left, 1, 0))
    return rows.select("*", F.explode(F.concat(as_left, as_right)).alias("c")).select(
        "label", "dim", "c.*", "rep", "copies", "unit")


def _loose(df, id_col, vector_col, label_col):
    """The rows that link with nothing."""
    own = F.col(id_col).cast("long")
    return df.filter(~_links_at_all(id_col, vector_col, label_col)).select(
        own.alias("vec_id"), F.lit(0).cast("long").alias("n_links"), own.alias("component_id"))
