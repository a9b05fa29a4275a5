"""Nearest neighbours by largest inner product: probed lists and an adaptive dimension scan.

Vectors get one more component that makes all their lengths equal, so the largest inner product is
the smallest distance; then all are rotated at random, so a prefix of the components tells about
the whole. Lists are the cells of centroids fitted on a bounded sample; every vector is in a list.

A query first scans its nearest list, which gives its bound. In each further probed list, distances
grow by blocks of columns; after a block, a candidate is abandoned when its partial distance,
extrapolated, exceeds the bound by more than chance allows. Those that survive all blocks are scored
exactly on the original vectors.

How many lists to probe comes from the sample: enough to hold ``target`` of its own neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import bounded_batches, materialize
from corvane.llm.vectors import as_double, matrix, sample_matrix, valid

#: Rows that rotation, centroids and probes are fitted on; the only vectors that reach the driver.
SAMPLE_ROWS = 16_384
#: Vectors in a list, on average, and the most lists.
LIST_ROWS, MAX_LISTS = 1_000, 4_096
#: A list of more vectors is scanned in blocks of about this size.
BLOCK_ROWS = 4_096
#: So are a list's queries.
QUERY_ROWS = 16_384
#: Columns in a block, and the width of the test: a wrong abandonment is rarer the larger it is.
COLUMNS, EPSILON = 16, 2.1
#: Share of the sample's neighbours that the probed lists must hold.
TARGET = 0.97
#: Queries scanned together.
_QUERIES = 256


@dataclass
class Fit:
    rotation: np.ndarray
    centroids: np.ndarray  # rotated
    probes: int
    longest: float  # of all vectors

    def rotate(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Rotated vectors with their lengths evened; a query's further component is zero."""
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.longest**2 - (x**2).sum(axis=1)))
        return np.hstack([x, rest[:, None]]) @ self.rotation

    def nearest_lists(self, rotated: np.ndarray, n: int) -> np.ndarray:
        d = (self.centroids**2).sum(axis=1) - 2 * rotated @ self.centroids.T
        n = min(n, d.shape[1])
        some = np.argpartition(d, n - 1, axis=1)[:, :n]
        return np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, axis=1), axis=1, kind="stable"), axis=1)


def fit(sample: np.ndarray, longest: float, rows: int, k: int, target: float = TARGET, seed: int = 11) -> Fit:
    rng = np.random.default_rng(seed)
    size = sample.shape[1] + 1
    rotation = np.linalg.qr(rng.standard_normal((size, size)))[0]
    f = Fit(rotation, np.empty((0, size)), 1, longest)
    x = f.rotate(sample)
    lists = int(min(MAX_LISTS, max(1, rows // LIST_ROWS), max(1, len(x) // 4)))
    centroids = x[rng.permutation(len(x))[:lists]].copy()
    for _ in range(8):
        own = ((centroids**2).sum(axis=1) - 2 * x @ centroids.T).argmin(axis=1)
        n = np.bincount(own, minlength=lists)
        sums = np.stack([np.bincount(own, x[:, j], lists) for j in range(size)], axis=1)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    f.centroids = centroids
    # the share of neighbours by the rank of the list they are in, for some queries of the sample
    own = ((centroids**2).sum(axis=1) - 2 * x @ centroids.T).argmin(axis=1)
    some = rng.permutation(len(x))[:512]
    near = sample[some] @ sample.T
    near[np.arange(len(some)), some] = -np.inf
    k = min(k, max(1, len(x) - 1))
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    rank = np.empty((len(some), lists), np.int64)
    np.put_along_axis(rank, f.nearest_lists(f.rotate(sample[some], True), lists), np.arange(lists)[None, :], axis=1)
    found = np.sort(np.take_along_axis(rank, own[best], axis=1).ravel())
    f.probes = int(found[min(len(found) - 1, int(np.ceil(target * len(found))))]) + 1
    return f


def scan(queries: np.ndarray, bound: np.ndarray, vectors: np.ndarray, columns: int = COLUMNS, epsilon: float = EPSILON) -> np.ndarray:
    """Which (query, vector) pairs outlast the test: rotated rows, and the squared distance that each query wants to beat."""
    size = vectors.shape[1]
    seen = np.zeros((len(queries), len(vectors)))
    alive = np.ones(seen.shape, bool)
    for lo in range(0, size, columns):
        q, x = queries[:, lo : lo + columns], vectors[:, lo : lo + columns]
        d = min(size, lo + columns)
        share = alive.mean()
        if share > 0.1:
            seen += (q**2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None, :] - 2 * q @ x.T
        else:
            a, b = np.nonzero(alive)
            seen[a, b] += ((q[a] - x[b]) ** 2).sum(axis=1)
        slack = (1 + epsilon / np.sqrt(d)) ** 2 if d < size else 1 + 1e-9
        alive &= seen * (size / d) <= (bound * slack)[:, None] + 1e-9
    return alive


def _best(query_ids: np.ndarray, query_vectors: np.ndarray, ids: np.ndarray, vectors: np.ndarray, alive: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of each query's surviving vectors, by exact score."""
    a, b = np.nonzero(alive & (query_ids[:, None] != ids[None, :]))
    score = np.einsum("ij,ij->i", query_vectors[a], vectors[b])
    order = np.lexsort((ids[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    first = np.searchsorted(a, a)
    keep = np.arange(len(a)) - first < k
    return pd.DataFrame({"query_id": query_ids[a[keep]], "vec_id": ids[b[keep]], "score": score[keep]})


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row whose vec_id ``every`` divides.

    Null, empty, zero or non-finite vectors take no part, nor do null ids. Vectors of different
    lengths have no inner product, so each length is searched by itself; there are few. A repeated id
    asks once, with the smallest of its vectors, and is found once per row; rows with the query's own
    id are never found. Ties go to the smaller vec_id. A query without any candidate gives no row, as
    does an empty table. Other columns, whatever their names, are ignored. Long vectors are held whole,
    a block of rows at a time.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = as_double(vectors.select("vec_id", "embedding")).filter(valid() & F.col("vec_id").isNotNull())
    longest = F.max(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v))
    lengths = rows.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n"), longest.alias("top")).orderBy("size").collect()
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if not lengths else None
    for r in lengths:
        same = F.size("embedding") == r["size"]
        found = _of_one_length(rows.filter(same), asked.filter(same), r["n"], float(np.sqrt(r["top"])), k, target)
        out = found if out is None else out.unionByName(found)
    return out


def _of_one_length(rows: DataFrame, asked: DataFrame, n: int, longest: float, k: int, target: float) -> DataFrame:
    fitted = fit(sample_matrix(rows, "vec_id", "embedding", SAMPLE_ROWS), longest, n, k, target)

    def assign(frames):
        for pdf in frames:
            if len(pdf):
                yield pdf.assign(list=fitted.nearest_lists(fitted.rotate(matrix(pdf["embedding"])), 1)[:, 0])

    listed = materialize(rows.mapInPandas(assign, "vec_id long, embedding array<double>, list int"), "lists")
    # at most MAX_LISTS rows
    sizes = listed.groupBy("list").count().select("list", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks"))
    listed = listed.join(F.broadcast(sizes), "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("blocks")

    def probe(frames):
        for pdf in frames:
            if len(pdf):
                yield pdf.assign(probes=list(fitted.nearest_lists(fitted.rotate(matrix(pdf["embedding"]), True), fitted.probes)))

    asked = materialize(asked.mapInPandas(probe, "vec_id long, embedding array<double>, probes array<int>"), "queries")

    def search(key: tuple, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x0, ids = matrix(mine["embedding"]), mine["vec_id"].to_numpy()
        x = fitted.rotate(x0)
        out = []
        for lo in range(0, len(theirs), _QUERIES):
            part = theirs.iloc[lo : lo + _QUERIES]
            q0, qid, floor = matrix(part["embedding"]), part["vec_id"].to_numpy(), part["floor"].to_numpy(dtype=float, na_value=np.nan)
            if np.isnan(floor).any():  # no bound yet: the k-th best of the block's first vectors
                head = q0 @ x0[: 8 * k].T
                head[qid[:, None] == ids[None, : 8 * k]] = -np.inf
                kth = np.sort(head, axis=1)[:, -k] if head.shape[1] >= k else np.full(len(q0), -np.inf)
                floor = np.where(np.isnan(floor), kth, floor)
            bound = np.where(np.isfinite(floor), (q0**2).sum(axis=1) + fitted.longest**2 - 2 * np.where(np.isfinite(floor), floor, 0), np.inf)
            out.append(_best(qid, q0, ids, x0, scan(fitted.rotate(q0, True), np.maximum(bound, 0), x), k))
        return pd.concat(out)

    def ask(queries: DataFrame) -> DataFrame:
        # at most MAX_LISTS rows; every block of a list's queries meets every block of its vectors
        turns = queries.groupBy("list").count().select("list", F.ceil(F.col("count") / QUERY_ROWS).cast("int").alias("turns"))
        queries = queries.join(F.broadcast(turns), "list").withColumn("turn", F.pmod(F.xxhash64("vec_id"), F.col("turns")).cast("int")).drop("turns")
        queries = queries.join(F.broadcast(sizes), "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        held = listed.join(F.broadcast(turns), "list").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("turns")
        return held.groupBy("list", "block", "turn").cogroup(queries.groupBy("list", "block", "turn")).applyInPandas(search, "query_id long, vec_id long, score double")

    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = materialize(ask(asked.select("vec_id", "embedding", F.col("probes")[0].alias("list"), F.lit(None).cast("double").alias("floor"))), "near")
    floors = near.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    further = asked.join(floors, "vec_id", "left").select("vec_id", "embedding", "floor", F.explode(F.slice("probes", 2, max(1, fitted.probes))).alias("list"))
    found = near.unionByName(ask(further)) if fitted.probes > 1 else near
    return found.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
