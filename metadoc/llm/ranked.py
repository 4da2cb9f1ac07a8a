"""Ranked lexical search: exact inner-product search in ball trees over sparse document vectors.

A document's vector has, for each query term, the term's weight times its share of the document; a score
is the inner product with the query's term numbers, all whole numbers. Documents of a task go into ball
trees, one for each group of queries, over the terms of that group. A node has the mean of its documents
and the radius around it, so no document below it scores more than mean . query + radius * |query|, which
is rounded up. Nodes are opened best first until the best bound left is below the lowest score kept;
leaves are scored exactly.
"""

import heapq
import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from metadoc.llm.shared import materialize

#: Queries are handled in blocks of so many, with so many different terms together (one query may have more).
BLOCK_QUERIES, BLOCK_TERMS = 4096, 200_000
#: Documents and vector entries of a set of trees, queries of a tree, documents of a leaf.
TREE_DOCS, TREE_ENTRIES, TREE_QUERIES, LEAF = 20_000, 4_000_000, 16, 128
#: Upper-case letters become lower-case, and what no term holds becomes a space.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(data):
    """The terms of a text in UTF-8: runs of ASCII letters, digits and all characters beyond ASCII."""
    return data.translate(_FOLD).split()


def _gathered(starts, sizes):
    """The places ``starts[i], starts[i] + 1, ...``, ``sizes[i]`` of them for each ``i``."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


class BallTree:
    """Sparse vectors of whole numbers, row ``i`` having ``cols[ptr[i]:ptr[i + 1]]``; no row is empty.

    ``nodes`` are ``(radius, columns of the mean, its values, begin, end, left, right)``; rows lie in the
    order of the leaves, and ``rows`` names them.
    """

    def __init__(self, cols, vals, ptr, width, leaf=LEAF):
        self.width, n = width, len(ptr) - 1
        self.rows, self.nodes = np.arange(n), []
        self._cols, self._vals, self._starts, self._sizes = cols, vals, ptr[:-1], np.diff(ptr)
        self._dense = np.zeros(width)
        if n:
            self._build(0, n, leaf)
        order = _gathered(self._starts[self.rows], self._sizes[self.rows])
        self.cols, self.vals = cols[order], vals[order]
        self.ptr = np.r_[0, np.cumsum(self._sizes[self.rows])]
        del self._cols, self._vals, self._starts, self._sizes, self._dense

    def _times(self, cols, vals, begins, at, values):
        """Inner products of the rows with one sparse vector."""
        self._dense[at] = values
        out = np.add.reduceat(vals * self._dense[cols], begins)
        self._dense[at] = 0
        return out

    def _build(self, begin, end, leaf):
        rows = self.rows[begin:end]
        sizes = self._sizes[rows]
        places = _gathered(self._starts[rows], sizes)
        cols, vals = self._cols[places], self._vals[places].astype(float)
        begins = np.cumsum(sizes) - sizes
        at, of = np.unique(cols, return_inverse=True)
        mean = np.bincount(of, vals) / len(rows)
        squares = np.add.reduceat(vals * vals, begins)
        own = float(mean @ mean)
        apart = squares - 2 * self._times(cols, vals, begins, at, mean) + own
        # Far above what the sums above can be off by rounding.
        slack = 1e-9 * (float(squares.max()) + own)
        node = len(self.nodes)
        self.nodes.append(None)
        left = right = -1
        if len(rows) > leaf:
            sparse = lambda i: slice(begins[i], begins[i] + sizes[i])
            one = sparse(int(apart.argmax()))
            to_one = self._times(cols, vals, begins, cols[one], vals[one])
            two = sparse(int((squares - 2 * to_one).argmax()))
            # Along the line from a far document to the one farthest from it, half of them to each side.
            along = self._times(cols, vals, begins, cols[two], vals[two]) - to_one
            self.rows[begin:end] = rows[np.argsort(along, kind="stable")]
            middle = (begin + end) // 2
            left, right = self._build(begin, middle, leaf), self._build(middle, end, leaf)
        self.nodes[node] = (math.sqrt(max(float(apart.max()), 0.0) + slack), at, mean, begin, end, left, right)
        return node

    def search(self, query, k, places, kept):
        """Keeps the ``k`` best rows in the heap ``kept`` of ``(score, -place)``, equal scores by lower place.

        ``query`` is dense; ``places`` numbers the rows. Only scores above 0 count. Returns the leaves opened.
        """
        norm, opened = math.sqrt(float(query @ query)), 0
        real = query.astype(float)

        def bound(node):
            radius, at, mean = self.nodes[node][:3]
            return (float(mean @ real[at]) + radius * norm) * (1 + 1e-9) + 1

        frontier = [(-bound(0), 0)] if self.nodes else []
        while frontier:
            most, node = heapq.heappop(frontier)
            if len(kept) == k and -most < kept[0][0]:
                break
            _, _, _, begin, end, left, right = self.nodes[node]
            if left >= 0:
                for below in (left, right):
                    if (best := bound(below)) >= (kept[0][0] if len(kept) == k else 1):
                        heapq.heappush(frontier, (-best, below))
                continue
            opened += 1
            ptr = self.ptr[begin:end + 1]
            scores = np.add.reduceat(self.vals[ptr[0]:ptr[-1]] * query[self.cols[ptr[0]:ptr[-1]]], ptr[:-1] - ptr[0])
            for i in np.nonzero(scores >= (kept[0][0] if len(kept) == k else 1))[0]:
                item = int(scores[i]), -int(places[self.rows[begin + i]])
                if len(kept) < k:
                    heapq.heappush(kept, item)
                elif item > kept[0]:
                    heapq.heappushpop(kept, item)
        return opened


def _blocks(queries):
    """Blocks of ``(query, {term: times})``, as many queries as the bounds allow; queries stream through."""
    block, seen = [], set()
    for row in queries.toLocalIterator():
        own = Counter(terms(bytes(row.data)))
        if block and (len(block) >= BLOCK_QUERIES or len(seen) + sum(t not in seen for t in own) > BLOCK_TERMS):
            yield block, seen
            block, seen = [], set()
        block.append((row.query, own))
        seen |= own.keys()
    if block:
        yield block, seen


def _vectors(docs, names):
    """``(doc_id, n, terms, times)`` per document: its number of terms, and those in ``names`` by number."""

    def count(batches):
        get = names.get
        for pdf in batches:
            sizes, found, times = [], [], []
            for data in pdf["data"]:
                words = terms(data)
                own = Counter(map(get, words))
                del own[None]
                sizes.append(len(words))
                found.append(np.fromiter(own.keys(), np.int32, len(own)))
                times.append(np.fromiter(own.values(), np.int32, len(own)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n": sizes, "terms": found, "times": times})

    return docs.mapInPandas(count, "doc_id string, n long, terms array<int>, times array<int>")


def _entries(sizes, terms_, times, n_docs, total, weights):
    """The vector entries of documents: weight times share, in whole numbers."""
    # Whole numbers of any size: the product of three can pass 64 bits.
    lengths = np.array([25 + 75 * int(n) * n_docs // total for n in sizes], np.int64)
    count = np.fromiter(map(len, terms_), np.int64, len(terms_))
    cols = np.concatenate([np.asarray(x, np.int64) for x in terms_])
    tf = np.concatenate([np.asarray(x, np.int64) for x in times])
    return cols, weights[cols] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(lengths, count))), np.r_[0, np.cumsum(count)]


def _search(cols, vals, ptr, first, queries, k, best):
    """Brings the heaps ``best`` of the queries up to date with a set of documents, numbered from ``first``."""
    n = len(ptr) - 1
    owner = np.repeat(np.arange(n), np.diff(ptr))
    own = np.full(max([int(cols.max()) if len(cols) else -1, *(int(q[1].max()) for q in queries)]) + 1, -1)
    for at in range(0, len(queries), TREE_QUERIES):
        group = queries[at:at + TREE_QUERIES]
        names = np.unique(np.concatenate([q[1] for q in group]))
        own[names] = np.arange(len(names))
        here = own[cols] >= 0
        rows, sizes = np.unique(owner[here], return_counts=True)
        tree = BallTree(own[cols[here]], vals[here], np.r_[0, np.cumsum(sizes)], len(names))
        for query, of, times in group:
            dense = np.zeros(len(names), np.int64)
            dense[own[of]] = times
            tree.search(dense, k, rows + first, best[query])
        own[names] = -1


def search(docs, queries, k=10, id_col="doc_id", text_col="text", query_id="item_id", query_text="text"):
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents for each row of ``queries``, by exact scores.

    ``N`` counts the documents with a term, ``L`` all terms; a term that ``df`` documents hold weighs
    ``w = floor(1000 * ln((2N + 2) / (2 df + 1)))``. With ``m = 25 + 75 n N div L`` for a document of ``n`` terms,
    each occurrence of a term in the query adds ``w * (10**9 tf div (1000 tf + 8 m))``. Only scores above 0
    count; ranks go from 1, equal scores by ascending id, null ids last, and rows of equal id and score in
    any order. Terms are as in ``terms``. Null and empty texts have no terms, and a query without terms
    that occur has no rows. Repeated rows count as often as they occur, on both sides. Other columns are not
    looked at, and no rows on either side give no rows.

    Queries pass the driver in blocks of bounded size, and each block reads the documents once.
    """
    spark, kind = docs.sparkSession, dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]
    data = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary").alias("data")
    asked = materialize(queries.select(F.col(query_id).alias("item_id"), data(query_text)).withColumn(
        "query", F.monotonically_increasing_id()), "queries")
    # Ids travel as text: among nulls, whole numbers would come back as floating point.
    texts = docs.select(F.col(id_col).cast("string").alias("doc_id"), data(text_col))
    found = spark.createDataFrame([], f"query long, doc_id {kind}, score long")
    for block, seen in _blocks(asked.select("query", "data")):
        names = {t: i for i, t in enumerate(sorted(seen))}
        vectors = materialize(_vectors(texts, names), "vectors")
        sums = vectors.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
        n_docs, total = int(sums.docs), int(sums.terms or 0)
        # One row per term of the block at most.
        held = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        weights = np.zeros(len(names), np.int64)
        for row in held.toLocalIterator():
            weights[row.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row.df + 1)))
        # A term that no document holds scores nothing.
        ask = []
        for query, own in block:
            of = np.array(sorted(names[t] for t in own if weights[names[t]] > 0), np.int64)
            if len(of):
                times = {names[t]: n for t, n in own.items()}
                ask.append((query, of, np.array([times[i] for i in of.tolist()], np.int64)))
        found = found.unionByName(_best(vectors, kind, ask, n_docs, total, weights, k))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return asked.select("query", "item_id").join(ranked, "query").select("item_id", "rank", "doc_id", "score")


def _best(vectors, kind, ask, n_docs, total, weights, k):
    """The ``k`` best documents of each set of documents for each query: ``(query, doc_id, score)``."""

    def run(batches):
        best, named, first = {query: [] for query, _, _ in ask}, {}, 0
        ids, sizes, terms_, times, entries = [], [], [], [], 0

        def flush():
            if not ask:
                return
            # What earlier sets have found bounds the search from its start.
            _search(*_entries(sizes, terms_, times, n_docs, total, weights), first, ask, k, best)
            places = {-place for kept in best.values() for _, place in kept}
            found = {p: named[p] if p < first else ids[p - first] for p in places}
            named.clear()
            named.update(found)

        for pdf in batches:
            for name, n, of, often in zip(pdf["doc_id"], pdf["n"], pdf["terms"], pdf["times"]):
                if ids and (len(ids) >= TREE_DOCS or entries + len(of) > TREE_ENTRIES):
                    flush()
                    first += len(ids)
                    ids, sizes, terms_, times, entries = [], [], [], [], 0
                ids.append(name)
                sizes.append(n)
                terms_.append(of)
                times.append(often)
                entries += len(of)
        if ids:
            flush()
        rows = [(query, named[-place], score) for query, kept in best.items() for score, place in kept]
        yield pd.DataFrame(rows, columns=["query", "doc_id", "score"])

    # Rows come in the order of their ids, which decides among equal scores.
    rows = vectors.filter(F.size("terms") > 0).withColumn("_id", F.col("doc_id").cast(kind)).sortWithinPartitions(
        F.col("_id").asc_nulls_last()).drop("_id")
    return rows.mapInPandas(run, "query long, doc_id string, score long").select(
        "query", F.col("doc_id").cast(kind).alias("doc_id"), "score")
