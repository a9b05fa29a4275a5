"""Near-duplicate vectors through a pivot-permutation index.

Every vector is described by its nearest reference points (pivots), in order. An inverted list per
label and pivot holds the vectors that have the pivot among their first few. Two vectors of a list
become candidates when their prefixes share enough pivots; candidates are verified by their exact
cosine. A pair that shares several lists is counted in the list of its lowest shared pivot only.

Vectors that are exactly equal are one class, so copies cost nothing; a list of very many vectors is
divided into blocks and the pairs of blocks are separate groups, so no task holds a whole hot list.
Links are counted and joined to spanning forests inside a group; pairs themselves are never emitted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import bounded_batches, materialize
from corvane.llm.components import connected_components
from corvane.llm.simhash import _merge
from corvane.llm.vectors import as_double, matrix, sample_matrix, valid

#: Rows that pivots are chosen from; the only vectors that reach the driver.
SAMPLE_ROWS = 8_192
#: Pivots in a vector's prefix, and how many of them a candidate pair shares.
PREFIX, SHARED = 8, 2
#: Vectors in an inverted list, on average in the largest label; sets the number of pivots.
LIST_ROWS = 1_000
MIN_PIVOTS, MAX_PIVOTS = 64, 4_096
#: A list of more vectors is divided into blocks of about this size.
BLOCK_ROWS = 2_048
#: Rows in one task's group of lists, on average.
BUCKET_ROWS = 16_384
_STRIP = 512


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Reference points that stand far apart: each next one is the sample vector farthest from those chosen."""
    unit = np.unique(sample / np.linalg.norm(sample, axis=1, keepdims=True), axis=0)
    nearest = np.full(len(unit), -np.inf)
    at, chosen = 0, []
    for _ in range(min(n, len(unit))):
        chosen.append(at)
        nearest = np.maximum(nearest, unit @ unit[at])
        at = int(nearest.argmin())
    return unit[chosen]


def prefixes(unit: np.ndarray, pivots: np.ndarray, size: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first."""
    near = unit @ pivots.T
    size = min(size, near.shape[1])
    some = np.argpartition(-near, size - 1, axis=1)[:, :size]
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable"), axis=1)


def count_links(x: np.ndarray, sets: np.ndarray, weight: np.ndarray, side: np.ndarray | None, pivot: int, threshold: float, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Within one list: per vector the weight of its links counted here, and its class's first member.

    ``sets`` has a row of sorted pivots per vector; ``side`` tells two blocks apart, only pairs
    across them count then.
    """
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    width = int(sets.max()) + 1
    has = np.zeros((len(x), width), np.float32)
    np.put_along_axis(has, sets, 1, axis=1)
    links, label = np.zeros(len(x), np.int64), np.arange(len(x))
    for lo in range(0, len(x), _STRIP):
        hi = min(lo + _STRIP, len(x))
        together = has[lo:hi] @ has[lo:].T >= shared
        a, b = np.nonzero(together & (unit[lo:hi] @ unit[lo:].T >= threshold))
        a, b = a + lo, b + lo
        ok = b > a if side is None else (b > a) & (side[a] != side[b])
        a, b = a[ok], b[ok]
        # pivots are in ascending order per row: the first of the one's that the other has
        first = sets[a, (has[b[:, None], sets[a]] > 0).argmax(axis=1)] == pivot
        a, b = a[first], b[first]
        links += np.bincount(a, weight[b], len(x)).astype(np.int64) + np.bincount(b, weight[a], len(x)).astype(np.int64)
        _merge(label, a, b)
    return links, label


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, prefix: int = PREFIX, shared: int = SHARED, list_rows: int = LIST_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding, label).

    Rows link when their labels are equal and not null and their cosine is at least ``threshold``.
    Null, empty, zero or non-finite vectors and those of null label link with nothing; vectors of
    different length never link. Repeated rows are vectors of their own that link with each other. An
    empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = as_double(vectors.select("vec_id", "label", "embedding"))
    whole = F.when(valid() & F.col("label").isNotNull(), F.col("embedding"))
    rows = rows.withColumn("embedding", whole).withColumn("_key", F.when(F.col("embedding").isNotNull(), F.md5(F.concat_ws(",", F.transform("embedding", lambda v: (v + 0.0).cast("string"))))))
    classes = rows.filter("_key is not null").groupBy("label", "_key").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    sample = sample_matrix_by_size(classes)
    links, forest = None, None
    for size, points in sample.items():
        n = min(MAX_PIVOTS, max(MIN_PIVOTS, largest * prefix // list_rows))
        pivots = choose_pivots(points, n)
        lists = _lists(classes.filter(F.size("embedding") == size), pivots, prefix, block_rows)
        found = _search(lists, threshold, min(shared, prefix, len(pivots)))
        links = found if links is None else links.unionByName(found)
    if links is None:
        links = spark.createDataFrame([], "cid long, n long, to long")
    links = materialize(links, "found")
    counted = links.groupBy("cid").agg(F.sum("n").alias("n"))
    forest = connected_components(links.filter("to <> cid").select(F.col("cid").alias("a"), F.col("to").alias("b"))).select(F.col("node").alias("cid"), "component")
    full = classes.select("cid", "label", "_key", "copies", "least").join(counted, "cid", "left").join(forest, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = full.groupBy("component").agg(F.min("least").alias("component_id"))
    full = full.join(least, "component").select("label", "_key", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "label", "_key").join(full, ["label", "_key"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("_key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def sample_matrix_by_size(classes: DataFrame) -> dict[int, np.ndarray]:
    """A bounded sample per vector length; tables nearly always have one length."""
    sizes = [r[0] for r in classes.select(F.size("embedding").alias("n")).distinct().orderBy("n").collect()]
    return {n: sample_matrix(classes.filter(F.size("embedding") == n), "cid", "embedding", SAMPLE_ROWS) for n in sizes}


def _lists(classes: DataFrame, pivots: np.ndarray, prefix: int, block_rows: int) -> DataFrame:
    """A row per vector, pivot of its prefix and pair of blocks that the vector takes part in."""
    slim = classes.select("cid", "label", "copies", "embedding")

    def describe(frames):
        for pdf in frames:
            if len(pdf):
                x = matrix(pdf["embedding"])
                pdf["pivots"] = list(prefixes(x / np.linalg.norm(x, axis=1, keepdims=True), pivots, prefix))
                yield pdf

    schema = T.StructType([*slim.schema.fields, T.StructField("pivots", T.ArrayType(T.IntegerType()))])
    rows = materialize(slim.mapInPandas(describe, schema), "prefixes")
    sizes = rows.select("label", F.explode("pivots").alias("pivot")).groupBy("label", "pivot").count()
    sizes = sizes.select("label", "pivot", F.ceil(F.col("count") / block_rows).cast("int").alias("blocks"))
    rows = rows.withColumn("pivot", F.explode("pivots")).join(sizes, ["label", "pivot"])
    own = F.pmod(F.xxhash64("cid", "pivot"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("own", own).withColumn("other", other)
    return rows.select("cid", "label", "copies", "embedding", "pivots", "pivot", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))


def _search(lists: DataFrame, threshold: float, shared: int) -> DataFrame:
    """Per list and vector with links: its links counted there (n) and the vector that stands for its class there (to)."""
    n = lists.count()
    buckets = max(1, -(-n // BUCKET_ROWS))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, pivot, lo, hi), g in pdf.groupby(["label", "pivot", "lo", "hi"], sort=False):
            g = g.sort_values("cid")
            sets = np.sort(np.stack([np.asarray(p) for p in g["pivots"]]), axis=1)
            links, label = count_links(matrix(g["embedding"]), sets, g["copies"].to_numpy(), None if lo == hi else (g["own"] == lo).to_numpy(), pivot, threshold, shared)
            some, ids = np.flatnonzero(links), g["cid"].to_numpy()
            out.append(pd.DataFrame({"cid": ids[some], "n": links[some], "to": ids[label[some]]}))
        return pd.concat(out) if out else pd.DataFrame({"cid": [], "n": [], "to": []})

    bucket = F.pmod(F.xxhash64("label", "pivot", "lo", "hi"), F.lit(buckets)).alias("bucket")
    return lists.groupBy(bucket).applyInPandas(search, "cid long, n long, to long")
