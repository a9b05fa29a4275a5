"""Catalog operators: building, joining metadata and updates, merging shards, resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import text


def build_catalog(files: DataFrame) -> DataFrame:
    """Rows (filename, duration_s, filesize_bytes, ...) with artist and title; rows without a duration go."""
    return files.filter(F.col("duration_s").isNotNull()).withColumns({"artist": text.artist("filename"), "title": text.title("filename")})


def manifest(files: DataFrame, min_duration: float = 30.0) -> DataFrame:
    """Every file with ``reason``: null where accepted. One pass; callers filter either side."""
    reason = F.when(F.col("duration_s").isNull(), "unreadable").when(F.col("duration_s") < min_duration, "too short")
    return files.withColumn("reason", reason)


def merge_metadata(catalog: DataFrame, metadata: DataFrame, unique: bool = False) -> DataFrame:
    """Left join by normalized filename; clashing columns get ``_meta``. Repeated names multiply rows unless ``unique``."""
    meta = metadata.withColumn("_norm", text.normalized_filename("filename")).drop("filename")
    if unique:
        meta = meta.dropDuplicates(["_norm"])
    meta = meta.select("_norm", *(F.col(c).alias(f"{c}_meta" if c in catalog.columns else c) for c in meta.columns if c != "_norm"))
    return catalog.withColumn("_norm", text.normalized_filename("filename")).join(meta, "_norm", "left").drop("_norm")


def update_columns(catalog: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Replace or add the columns of ``updates`` by key; rows without an update get nulls."""
    new = [c for c in updates.columns if c != key]
    return catalog.drop(*new).join(updates, key, "left")


def with_defaults(df: DataFrame, **defaults) -> DataFrame:
    """Fill nulls; columns that are missing are added."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def stride_shard(df: DataFrame, order: str, shard: int, shards: int) -> DataFrame:
    """Every ``shards``-th row by ``order``, starting at ``shard``.

    Ranks come from range partitions and their sizes, so no single task orders the whole table.
    """
    return ranked(df, order).filter(F.col("rank") % shards == shard)


def ranked(df: DataFrame, order: str, buckets: int = 64) -> DataFrame:
    """Add ``rank`` (from 0) in the order of a unique numeric column, by equal-width buckets and their sizes."""
    ends = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    if ends["lo"] is None:
        return df.withColumn("rank", F.lit(0).cast("long"))
    width = max(1, (int(ends["hi"]) - int(ends["lo"])) // buckets + 1)
    rows = df.withColumn("_bucket", F.floor((F.col(order) - int(ends["lo"])) / width).cast("long"))
    # at most ``buckets`` + 1 sizes
    sizes = rows.groupBy("_bucket").count().withColumn("_ahead", F.coalesce(F.sum("count").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(order)) - 1
    return rows.withColumn("rank", within).join(F.broadcast(sizes), "_bucket").withColumn("rank", F.col("rank") + F.col("_ahead")).drop("_bucket", "_ahead")


def coverage(expected: DataFrame, merged: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: ``side`` is missing or extra."""
    missing = expected.select(key).distinct().join(merged.select(key), key, "left_anti").withColumn("side", F.lit("missing"))
    extra = merged.select(key).distinct().join(expected.select(key), key, "left_anti").withColumn("side", F.lit("extra"))
    return missing.unionByName(extra)


def merge_shards(shards: list[DataFrame], dedup: str | None = None) -> DataFrame:
    """All rows of all shards by column name; rows of one key stay repeated unless ``dedup`` names it."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    return out.dropDuplicates([dedup]) if dedup else out


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows still to do: failed ones aren't in ``done`` and so are tried again."""
    return todo.join(done.select(key), key, "left_anti")


def in_list_order(uids: DataFrame, catalog: DataFrame, key: str, keep_missing: bool = False) -> DataFrame:
    """The catalog rows of a numbered list, in its order, repeats kept; ``row_idx`` carries the order.

    Keys that the catalog lacks go, or stay with nulls.
    """
    return uids.join(catalog, key, "left" if keep_missing else "inner").orderBy("row_idx")


def zipped(uids: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of a matrix (row_idx, ...) with the ids (row_idx, ...) of the same places; both must be equally long."""
    n, m = uids.count(), rows.count()
    if n != m:
        raise ValueError(f"{n} ids for {m} rows")
    return uids.join(rows, "row_idx")


def with_manifest(features: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Features with what the manifest says of each; one without an entry is an error."""
    out = features.join(manifest, key)
    n, m = features.count(), out.count()
    if n != m:
        raise ValueError(f"{n} feature rows, {m} of them in the manifest")
    return out


def stable_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The ``n`` rows whose salted md5 comes first: the same on every run and engine."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)
