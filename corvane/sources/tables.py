"""The engine's logical tables, built from the star-schema tables at hand.

Music metadata isn't among them, so tracks come from ``embeddings``, the catalog from ``part`` and the
phase log from ``events``. Each function returns a lazy plan; ``SQL`` has the same as common table
expressions for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text, vectors

#: Spellings that exercise every way of writing a key.
KEYS = ("C minor", "C# minor", "D minor", "Eb minor", "E minor", "F minor", "F# minor", "G minor", "C major", "Db major", "D major", "Eb major", "Cm", "Gm", "Ebm", "G", "Eb", "F#m", "8A", "12B", "Gmaj", "Cmin", "?", "99A")
TEMPO_LOW, TEMPO_STEPS = 118, 25


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label_l1, label_l2, full and perc vectors as doubles; label 9 plays the noise."""
    l1 = F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("label_l1")
    l2 = F.when((F.col("label") == 9) | (F.col("vec_id") % 11 == 0), -1).otherwise((F.col("vec_id") % 3).cast("int")).alias("label_l2")
    full = vectors.doubles("embedding")
    return read(spark, sf_dir, "embeddings").select("vec_id", l1, l2, full.alias("mert_full"), vectors.normalized(F.slice(full, 1, 32)).alias("mert_perc"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, filename, artist, title, duration_s, filesize_bytes, genre."""
    name = F.concat("p_brand", F.lit(" - "), "p_name", F.lit(".mp3"))
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("track_id"),
        name.alias("filename"),
        text.artist(name).alias("artist"),
        text.title(name).alias("title"),
        F.col("p_retailprice").alias("duration_s"),
        (F.col("p_partkey") * 1000).alias("filesize_bytes"),
        F.concat(F.when(F.col("p_partkey") % 3 == 0, "Dance---").otherwise("Electronic---"), "p_type").alias("genre"),  # two raw genres of one simple name
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, bpm and key; only for tracks that the catalog has."""
    keys = F.array(*map(F.lit, KEYS))
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("vec_id"), (F.lit(TEMPO_LOW) + F.col("p_size") % TEMPO_STEPS).cast("double").alias("bpm"))
    key = F.element_at(keys, (F.col("vec_id") % len(KEYS) + 1).cast("int")).alias("key")
    return read(spark, sf_dir, "embeddings").select("vec_id").join(part, "vec_id").select(F.col("vec_id").alias("track_id"), "bpm", key)


_KEY_LIST = ", ".join(f"'{k}'" for k in KEYS)
SQL = f"""
tracks AS (
  SELECT vec_id, CASE WHEN label = 9 THEN -1 ELSE label END AS label_l1,
         CASE WHEN label = 9 OR vec_id % 11 = 0 THEN -1 ELSE CAST(vec_id % 3 AS INTEGER) END AS label_l2,
         CAST(embedding AS DOUBLE[]) AS mert_full
  FROM embeddings),
catalog AS (
  SELECT p_partkey AS track_id, p_brand || ' - ' || p_name || '.mp3' AS filename, trim(p_brand) AS artist, trim(p_name) AS title,
         p_retailprice AS duration_s, p_partkey * 1000 AS filesize_bytes, CASE WHEN p_partkey % 3 = 0 THEN 'Dance---' ELSE 'Electronic---' END || p_type AS genre
  FROM part),
features AS (
  SELECT e.vec_id AS track_id, CAST({TEMPO_LOW} + p_size % {TEMPO_STEPS} AS DOUBLE) AS bpm, [{_KEY_LIST}][CAST(e.vec_id % {len(KEYS)} + 1 AS INTEGER)] AS key
  FROM embeddings e JOIN part ON p_partkey = e.vec_id)
"""


def with_sql(body: str, more: str = "") -> str:
    """An oracle that uses the logical tables."""
    return f"WITH RECURSIVE {SQL.strip()}{', ' + more.strip() if more else ''}\n{body.strip()}"
