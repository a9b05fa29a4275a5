"""Queries over vectors: normalization, neighbours, pooling, clustering, metrics, ordering and export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import keys as K
from corvane.functions import segments as S
from corvane.functions import text, vectors
from corvane.operators import clustering as L
from corvane.operators import export as X
from corvane.operators import metrics as M
from corvane.operators import naming, neighbours
from corvane.operators import ordering as O
from corvane.operators.projection import ProjectionHead
from corvane.operators.projection import contrastive_pairs as mine_pairs
from corvane.plans.catalog_queries import _NAMES
from corvane.plans.registry import query
from corvane.sources.tables import KEYS, catalog, features, read, tracks, with_sql

WINDOWS_DIR = "D:\\Music"


def _rounded(v: F.Column | str, digits: int = 6):
    return F.transform(v, lambda x: F.round(x, digits))


# --- keys -----------------------------------------------------------------------------------------

# Each spelling of KEYS on the wheel.
_HOURS = {"C minor": "5A", "C# minor": "12A", "D minor": "7A", "Eb minor": "2A", "E minor": "9A", "F minor": "4A", "F# minor": "11A", "G minor": "6A", "C major": "8B", "Db major": "3B", "D major": "10B", "Eb major": "5B", "Cm": "5A", "Gm": "6A", "Ebm": "2A", "G": "9B", "Eb": "5B", "F#m": "11A", "8A": "8A", "12B": "12B", "Gmaj": "?", "Cmin": "?", "?": "?", "99A": "99A"}
_HOUR_SQL = "hours AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _HOURS.items()) + ") t(key, camelot))"


@query(with_sql("SELECT vec_id, COALESCE(camelot, '?') AS camelot FROM tracks LEFT JOIN features ON track_id = vec_id LEFT JOIN hours USING (key)", _HOUR_SQL))
def camelot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracks(spark, sf_dir).select("vec_id").join(features(spark, sf_dir).withColumnRenamed("track_id", "vec_id"), "vec_id", "left")
    return rows.select("vec_id", K.camelot("key").alias("camelot"))


def _key_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return f.join(f.select((F.col("track_id") - 1).alias("track_id"), F.col("key").alias("key_b")), "track_id")


@query(with_sql("""SELECT a.track_id, CAST(CASE WHEN ha.camelot = '?' OR hb.camelot = '?' THEN 0.5 ELSE
  CASE WHEN x = y THEN 1.0 WHEN least(abs(x - y), 12 - abs(x - y)) = 1 THEN 0.5 ELSE 0.0 END END AS DOUBLE) AS score
  FROM features a JOIN features b ON b.track_id = a.track_id + 1 JOIN hours ha ON ha.key = a.key JOIN hours hb ON hb.key = b.key,
  LATERAL (SELECT TRY_CAST(ha.camelot[:-2] AS INTEGER) AS x, TRY_CAST(hb.camelot[:-2] AS INTEGER) AS y)""", _HOUR_SQL))
def key_compat_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _key_pairs(spark, sf_dir).select("track_id", O.keys.ordering_compatibility(K.camelot("key"), K.camelot("key_b")).cast("double").alias("score"))


# Each spelling's place on the rings that metrics use, minor first.
_PLACES = {"Am": 0, "Em": 1, "Bm": 2, "F#m": 3, "C#m": 4, "G#m": 5, "D#m": 6, "A#m": 7, "Fm": 8, "Cm": 9, "Gm": 10, "Dm": 11, "C": 12, "G": 13, "D": 14, "A": 15, "E": 16, "B": 17, "F#": 18, "C#": 19, "Ab": 20, "Eb": 21, "Bb": 22, "F": 23, "Abm": 5, "Ebm": 6, "Bbm": 7, "Db": 19, "Gb": 18, "Cb": 17, "1A": 0, "2A": 1, "3A": 2, "4A": 3, "5A": 4, "6A": 5, "7A": 6, "8A": 7, "9A": 8, "10A": 9, "11A": 10, "12A": 11, "1B": 12, "2B": 13, "3B": 14, "4B": 15, "5B": 16, "6B": 17, "7B": 18, "8B": 19, "9B": 20, "10B": 21, "11B": 22, "12B": 23}
_RING_SQL = "ring AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in _PLACES.items()) + ") t(key, place))"


@query(with_sql("""SELECT a.track_id, CAST(CASE WHEN ra.place IS NULL OR rb.place IS NULL THEN 0.0 WHEN d = 0 THEN 1.0 WHEN d = 1 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score
  FROM features a JOIN features b ON b.track_id = a.track_id + 1 LEFT JOIN ring ra ON ra.key = a.key LEFT JOIN ring rb ON rb.key = b.key,
  LATERAL (SELECT least(abs(ra.place % 12 - rb.place % 12), 12 - abs(ra.place % 12 - rb.place % 12)) AS d)""", _RING_SQL))
def key_compat_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _key_pairs(spark, sf_dir).select("track_id", K.metrics_compatibility("key", "key_b").cast("double").alias("score"))


# --- vectors --------------------------------------------------------------------------------------

_UNIT = "list_transform({0}, lambda x: x / CASE WHEN sqrt(list_dot_product({0}, {0})) = 0 THEN 1 ELSE sqrt(list_dot_product({0}, {0})) END)"


@query(with_sql("SELECT vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS sq, round(u[1], 6) AS first, round(u[32], 6) AS last FROM (SELECT vec_id, " + _UNIT.format("mert_full[1:32]") + " AS u FROM tracks)"))
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("mert_perc")
    return tracks(spark, sf_dir).select("vec_id", F.round(vectors.dot(u, u), 6).alias("sq"), F.round(u[0], 6).alias("first"), F.round(u[31], 6).alias("last"))


_COS = "greatest(-1.0, least(1.0, list_dot_product({a}, {b}) / ((sqrt(list_dot_product({a}, {a})) + 1e-8) * (sqrt(list_dot_product({b}, {b})) + 1e-8))))"


@query(with_sql("SELECT a.vec_id AS i, b.vec_id AS j, round(1 - " + _COS.format(a="a.mert_full", b="b.mert_full") + ", 6) AS distance FROM tracks a JOIN tracks b ON a.label_l1 = b.label_l1 AND a.label_l2 = b.label_l2 AND b.vec_id = a.vec_id + 30"))
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).select("vec_id", "label_l1", "label_l2", "mert_full")
    b = t.select((F.col("vec_id") - 30).alias("vec_id"), "label_l1", "label_l2", F.col("vec_id").alias("j"), F.col("mert_full").alias("other"))
    return t.join(b, ["vec_id", "label_l1", "label_l2"]).select(F.col("vec_id").alias("i"), "j", F.round(1 - vectors.cosine("mert_full", "other"), 6).alias("distance"))


@query(with_sql("""SELECT query_id, point_id, round(distance, 6) AS distance, rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS point_id, 1 - """ + _COS.format(a="a.mert_full", b="b.mert_full") + """ AS distance,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY distance, b.vec_id) AS rank FROM tracks a JOIN tracks b ON a.vec_id <> b.vec_id) WHERE rank <= 10"""))
def topk_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = tracks(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("mert_full").alias("vector"))
    return neighbours.nearest(points, points, 10).select("query_id", "point_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(with_sql("""SELECT vec_id, label_l1 AS raw, COALESCE(new, label_l1) AS label FROM tracks LEFT JOIN (
  SELECT a.vec_id, arg_min(b.label_l1, (list_distance(a.mert_full, b.mert_full), b.vec_id)) AS new FROM tracks a JOIN tracks b ON a.label_l1 = -1 AND b.label_l1 <> -1 GROUP BY a.vec_id) USING (vec_id)"""))
def noise_reassign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracks(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("mert_full").alias("vector"), F.col("label_l1").alias("label"))
    return neighbours.reassign_noise(rows).select(F.col("id").alias("vec_id"), "raw", "label")


_CORE = """dist AS (SELECT a.vec_id AS i, b.vec_id AS j, list_distance(a.mert_full, b.mert_full) AS d FROM tracks a JOIN tracks b ON a.label_l1 = b.label_l1),
core AS (SELECT i, d AS core FROM (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM dist) WHERE r = 4)"""


@query(with_sql("SELECT i AS vec_id, round(core, 6) AS core FROM core", _CORE))
def core_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cores(spark, sf_dir).select("vec_id", F.round("core", 6).alias("core"))


def _cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 4th nearest of the own cluster, by one matrix product a cluster."""
    import numpy as np
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["mert_full"]])
        d = neighbours.distances(x, x, neighbours.EUCLIDEAN)
        np.fill_diagonal(d, 0.0)
        return pdf[["vec_id", "label_l1"]].assign(core=np.sort(d, axis=1)[:, 3])

    return tracks(spark, sf_dir).select("vec_id", "label_l1", "mert_full").groupBy("label_l1").applyInPandas(one, "vec_id long, label_l1 int, core double")


@query(with_sql("SELECT i, j, round(greatest(a.core, b.core, d), 6) AS reach FROM dist JOIN core a USING (i) JOIN core b ON b.i = j WHERE j = i + 20", _CORE))
def mutual_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracks(spark, sf_dir).select("vec_id", "mert_full").join(_cores(spark, sf_dir), "vec_id")
    other = rows.select((F.col("vec_id") - 20).alias("vec_id"), "label_l1", F.col("vec_id").alias("j"), F.col("core").alias("core_j"), F.col("mert_full").alias("v_j"))
    gap = vectors.norm(F.zip_with("mert_full", "v_j", lambda a, b: a - b))
    return rows.join(other, ["vec_id", "label_l1"]).select(F.col("vec_id").alias("i"), "j", F.round(F.greatest("core", "core_j", gap), 6).alias("reach"))


@query("SELECT label AS grp, idx - 1 AS dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS idx FROM embeddings) GROUP BY ALL")
def mean_std_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = read(spark, sf_dir, "embeddings").select(F.col("label").alias("grp"), F.posexplode(vectors.doubles("embedding")).alias("dim", "x"))
    return flat.groupBy("grp", F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"))


@query(with_sql("SELECT vec_id, len(pair) AS width, round(list_dot_product(pair, pair), 6) AS sq, round(pair[1], 6) AS first, round(pair[65], 6) AS second FROM (SELECT vec_id, list_concat(" + _UNIT.format("mert_full") + ", " + _UNIT.format("mert_full[1:32]") + ") AS pair FROM tracks)"))
def combine_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = tracks(spark, sf_dir).select("vec_id", F.concat(vectors.normalized("mert_full", 1e-10), "mert_perc").alias("both"))
    return both.select("vec_id", F.size("both").cast("long").alias("width"), F.round(vectors.dot("both", "both"), 6).alias("sq"), F.round(F.col("both")[0], 6).alias("first"), F.round(F.col("both")[64], 6).alias("second"))


@query(with_sql("SELECT round(avg(1 - " + _COS.format(a="mert_full[1:32]", b="mert_full[33:64]") + "), 6) AS mean_distance, count(*) AS n, bool_and(list_bool_and(list_transform(mert_full, lambda x: isfinite(x)))) AS finite FROM tracks"))
def embedding_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = 1 - vectors.cosine(F.slice("mert_full", 1, 32), F.slice("mert_full", 33, 32))
    return tracks(spark, sf_dir).agg(F.round(F.avg(far), 6).alias("mean_distance"), F.count("*").alias("n"), F.bool_and(vectors.finite("mert_full")).alias("finite"))


@query("SELECT vec_id, place - 1 AS place, idx - 1 AS dim FROM (SELECT vec_id, idx, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, idx) AS place FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS idx FROM embeddings)) WHERE place <= 3")
def top_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.slice(F.array_sort(F.transform("embedding", lambda x, i: F.struct((-x).alias("x"), i.alias("i")))), 1, 3)
    return read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(best).alias("place", "b")).select("vec_id", F.col("place").cast("long").alias("place"), F.col("b.i").cast("long").alias("dim"))


# --- segments -------------------------------------------------------------------------------------

_ZONE = "greatest(0, least({0}, n - 1))"


@query("SELECT doc_id, " + ", ".join(f"CAST({_ZONE.format(x)} AS BIGINT) AS s{i}" for i, x in enumerate(("0 + (floor(0.15e0 * n) - 0) // 2 - 110250", "floor(0.35e0 * n)", "floor(0.35e0 * n) + (floor(0.65e0 * n) - floor(0.35e0 * n) - 220500)", "floor(0.85e0 * n) + (n - floor(0.85e0 * n)) // 2 - 110250"))) + " FROM (SELECT doc_id, n_chars * 1000 AS n FROM documents)")
def segment_starts_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = S.zone_starts(F.col("n_chars") * 1000, 44100)
    return read(spark, sf_dir, "documents").select("doc_id", starts.alias("s")).select("doc_id", *(F.col("s")[i].alias(f"s{i}") for i in range(4)))


@query("""SELECT doc_id, bar, CAST(0 AS BIGINT) AS s0, CAST(greatest(0, least(greatest(0, (n // bar // 2 - 1) * bar), n - 1)) AS BIGINT) AS s1, CAST(greatest(0, least(greatest(0, n // bar // 2 * bar), n - 1)) AS BIGINT) AS s2,
  CAST(greatest(0, least(greatest(0, (n // bar - 1) * bar), n - 1)) AS BIGINT) AS s3 FROM (SELECT doc_id, n_chars * 1000 AS n, 4 * (20000 + doc_id % 97) AS bar FROM documents)""")
def segment_starts_beat(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = 20000 + F.col("doc_id") % 97
    ticks = F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: i * gap + F.when(i % 2 == 0, 0).otherwise(0))
    rows = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * 1000).alias("n"), S.bar_samples(ticks).alias("bar"))
    return rows.select("doc_id", "bar", S.bar_starts(F.col("n"), F.col("bar")).alias("s")).select("doc_id", "bar", *(F.col("s")[i].alias(f"s{i}") for i in range(4)))


@query("""SELECT doc_id, len(starts) AS n_segments, starts[1] AS first_start, starts[-1] AS last_start, CAST(list_sum(starts) AS BIGINT) AS total FROM (
  SELECT doc_id, CASE WHEN n - 2160000 < 120000 THEN [greatest(0, n // 2 - 60000)] WHEN k = 1 THEN [1080000] ELSE list_transform(range(k), lambda i: CASE WHEN i = k - 1 THEN n - 1200000 ELSE CAST(floor(1080000 + i * ((n - 1200000 - 1080000) / (k - 1))) AS BIGINT) END) END AS starts
  FROM (SELECT doc_id, n_chars * 1000 AS n, greatest(1, least(8, (n_chars * 1000 - 2160000) // 120000)) AS k FROM documents))""")
def segment_starts_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", S.spread_starts(F.col("n_chars") * 1000, 24000).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n_segments"), F.col("s")[0].alias("first_start"), F.element_at("s", -1).alias("last_start"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


# --- metrics --------------------------------------------------------------------------------------

_PAIR = "(label_l2 + CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END)"
_TABLE = f"""cells AS (SELECT label_l2 AS a, {_PAIR} % 3 AS b, count(*) AS n FROM tracks WHERE label_l2 <> -1 GROUP BY ALL),
sa AS (SELECT a, sum(n) AS n FROM cells GROUP BY a), sb AS (SELECT b, sum(n) AS n FROM cells GROUP BY b), tot AS (SELECT sum(n) AS t FROM cells)"""


def _label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = (F.col("label_l2") + F.when(F.col("vec_id") % 5 == 0, 1).otherwise(0)) % 3
    return tracks(spark, sf_dir).select("vec_id", F.col("label_l2").alias("label_pred"), F.when(F.col("label_l2") == -1, -1).otherwise(shifted).alias("label_true"))


@query(with_sql("SELECT round((nij - ea) / ((pa + pb) / 2 - ea), 6) AS ari FROM (SELECT *, pa * pb / (t * (t - 1) / 2) AS ea FROM (SELECT (SELECT sum(n * (n - 1) / 2) FROM cells) AS nij, (SELECT sum(n * (n - 1) / 2) FROM sa) AS pa, (SELECT sum(n * (n - 1) / 2) FROM sb) AS pb, t FROM tot))", _TABLE))
def ari(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.adjusted_rand(_label_pairs(spark, sf_dir)).select(F.round("ari", 6).alias("ari"))


@query(with_sql("SELECT round((SELECT sum(c.n / t * ln(c.n * t / (sa.n * sb.n))) FROM cells c JOIN sa USING (a) JOIN sb USING (b), tot) / (((SELECT -sum(n / t * ln(n / t)) FROM sa, tot) + (SELECT -sum(n / t * ln(n / t)) FROM sb, tot)) / 2), 6) AS nmi", _TABLE))
def nmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mutual_information(_label_pairs(spark, sf_dir)).select(F.round("nmi", 6).alias("nmi"))


_RANKS = """pairs AS (SELECT vec_id AS i, vec_id + 1 AS j FROM embeddings),
d AS (SELECT p.i, p.j, x.vec_id AS k, 1 - """ + _COS.format(a="q.mert_full", b="x.mert_full") + """ AS d FROM pairs p JOIN tracks q ON q.vec_id = p.i JOIN tracks x ON x.vec_id <> p.i),
own AS (SELECT i, j, d AS dj FROM d WHERE k = j),
ranks AS (SELECT i, j, count(*) FILTER (d <= dj) AS worst, 1 + count(*) FILTER (d < dj OR (d = dj AND k < j)) AS place, count(*) FILTER (d > dj) / (SELECT count(*) - 2 FROM tracks) AS auc FROM d JOIN own USING (i, j) GROUP BY i, j)"""


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = tracks(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("mert_full").alias("vector"))
    pairs = points.select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"))
    return M.positive_ranks(pairs, points)


@query(with_sql("SELECT " + ", ".join(f"round(avg(CAST(place <= {k} AS INTEGER)), 6) AS recall_{k}, round(avg(CASE WHEN place <= {k} THEN 1 / log2(place + 1) ELSE 0 END), 6) AS ndcg_{k}" for k in (5, 10, 20)) + ", round(avg(1 / worst), 6) AS mrr, round(avg(auc), 6) AS auc FROM ranks", _RANKS))
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.retrieval(_ranks(spark, sf_dir))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query(with_sql("SELECT i, j, worst AS worst_rank, place, round(auc, 6) AS auc FROM ranks", _RANKS))
def positive_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(spark, sf_dir).select("i", "j", "worst_rank", "place", F.round("auc", 6).alias("auc"))


_STEPS = """base AS (SELECT label_l1, label_l2, vec_id, mert_full AS v, COALESCE(bpm, 128.0) AS bpm, COALESCE(key, '?') AS key FROM tracks LEFT JOIN features ON track_id = vec_id),
seq AS (SELECT *, lag(v) OVER w AS pv, lag(bpm) OVER w AS pb, lag(key) OVER w AS pk, max(bpm) OVER g - min(bpm) OVER g AS rng FROM base WINDOW w AS (PARTITION BY label_l1, label_l2 ORDER BY vec_id), g AS (PARTITION BY label_l1, label_l2)),
scored AS (SELECT s.*, x.place AS px, y.place AS py, least(abs(x.place % 12 - y.place % 12), 12 - abs(x.place % 12 - y.place % 12)) AS kd FROM seq s LEFT JOIN ring x ON x.key = s.key LEFT JOIN ring y ON y.key = s.pk)"""


def _sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracks(spark, sf_dir).join(features(spark, sf_dir).withColumnRenamed("track_id", "vec_id"), "vec_id", "left")
    return rows.select("vec_id", "label_l1", "label_l2", F.col("mert_full").alias("vector"), F.coalesce("bpm", F.lit(O.DEFAULT_BPM)).alias("bpm"), F.coalesce("key", F.lit(O.DEFAULT_KEY)).alias("key"))


@query(with_sql("""SELECT label_l1, label_l2, count(*) AS n, CASE WHEN count(*) < 2 THEN 1.0 ELSE round(greatest(0, least(1, 0.5 * avg((""" + _COS.format(a="v", b="pv") + """ + 1) / 2) FILTER (pv IS NOT NULL)
  + 0.3 * COALESCE(avg(CASE WHEN rng = 0 THEN 1.0 ELSE greatest(0.0, 1 - abs(bpm - pb) / rng) END) FILTER (pv IS NOT NULL), 1.0)
  + 0.2 * avg(CASE WHEN px IS NULL OR py IS NULL THEN 0.0 WHEN kd = 0 THEN 1.0 WHEN kd = 1 THEN 0.5 ELSE 0.0 END) FILTER (pv IS NOT NULL))), 6) END AS transition FROM scored GROUP BY ALL""", _RING_SQL + ", " + _STEPS))
def transition_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.transition_score(_sequence(spark, sf_dir), ["label_l1", "label_l2"], "vec_id")
    return out.select("label_l1", "label_l2", "n", F.round("transition", 6).alias("transition"))


@query(with_sql("SELECT count(*) AS n_tracks, count(DISTINCT label_l1) FILTER (label_l1 >= 0) AS n_clusters, round(avg(CAST(label_l1 = -1 AS INTEGER)), 6) AS noise_rate_l1 FROM tracks"))
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cluster_stats(tracks(spark, sf_dir)).withColumn("noise_rate_l1", F.round("noise_rate_l1", 6))


@query(with_sql("SELECT label_l1, count(*) AS n_tracks, greatest(count(DISTINCT label_l2) FILTER (label_l2 >= 0), 1) AS n_subclusters, round(avg(CAST(label_l2 = -1 AS INTEGER)), 6) AS noise_rate_l2 FROM tracks WHERE label_l1 <> -1 GROUP BY 1"))
def subcluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.subcluster_stats(tracks(spark, sf_dir)).withColumn("noise_rate_l2", F.round("noise_rate_l2", 6)).withColumn("n_subclusters", F.col("n_subclusters").cast("long"))


@query(with_sql("SELECT label_l1, count(*) AS n FROM tracks WHERE label_l1 >= 0 GROUP BY 1"))
def l1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).filter("label_l1 >= 0").groupBy("label_l1").agg(F.count("*").alias("n"))


@query(with_sql("SELECT COALESCE(avg(CAST(label_l2 = -1 AS INTEGER)), 0) AS noise_rate FROM tracks"))
def noise_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.noise_rate(tracks(spark, sf_dir), "label_l2")


@query(with_sql("SELECT round(avg(value), 6) AS composite, round(sum(value * w) / sum(w), 6) AS weighted FROM (SELECT 'noise' AS metric, avg(CAST(label_l1 = -1 AS INTEGER)) AS value, 2.0 AS w FROM tracks UNION ALL SELECT 'noise_l2', avg(CAST(label_l2 = -1 AS INTEGER)), 1.0 FROM tracks)"))
def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir)
    rows = M.noise_rate(t, "label_l1").select(F.lit("noise").alias("metric"), F.col("noise_rate").alias("value")).unionByName(M.noise_rate(t, "label_l2").select(F.lit("noise_l2").alias("metric"), F.col("noise_rate").alias("value")))
    plain, weighted = M.composite(rows), M.composite(rows, {"noise": 2.0, "noise_l2": 1.0})
    return plain.crossJoin(weighted.withColumnRenamed("composite", "weighted")).select(F.round("composite", 6).alias("composite"), F.round("weighted", 6).alias("weighted"))  # one row each


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("label_l1").alias("label"), F.col("mert_full").alias("vector"))


_FLAT = """flat AS (SELECT label_l1 AS label, vec_id, unnest(mert_full) AS x, generate_subscripts(mert_full, 1) AS dim FROM tracks WHERE label_l1 <> -1),
cent AS (SELECT label, dim, avg(x) AS m, count(*) AS n FROM flat GROUP BY label, dim)"""


@query(with_sql("SELECT round(((SELECT sum(n * (c.m - g.m) ** 2) FROM cent c JOIN (SELECT dim, avg(x) AS m FROM flat GROUP BY dim) g USING (dim)) / (k - 1)) / ((SELECT sum((x - m) ** 2) FROM flat JOIN cent USING (label, dim)) / (n - k)), 6) AS calinski_harabasz FROM (SELECT count(*) AS n, count(DISTINCT label_l1) AS k FROM tracks WHERE label_l1 <> -1)", _FLAT))
def calinski_harabasz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.calinski_harabasz(_labelled(spark, sf_dir))


@query(with_sql("SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT a.label, max((a.s + b.s) / (SELECT sqrt(sum((x.m - y.m) ** 2)) FROM cent x JOIN cent y USING (dim) WHERE x.label = a.label AND y.label = b.label)) AS r FROM spread a JOIN spread b ON a.label <> b.label GROUP BY a.label)", _FLAT + ", spread AS (SELECT label, avg(d) AS s FROM (SELECT label, vec_id, sqrt(sum((x - m) ** 2)) AS d FROM flat JOIN cent USING (label, dim) GROUP BY label, vec_id) GROUP BY label)"))
def davies_bouldin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.davies_bouldin(_labelled(spark, sf_dir))


@query(with_sql("""SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM (SELECT i, max(d) FILTER (own) AS a, min(d) FILTER (NOT own) AS b FROM (
  SELECT p.vec_id AS i, p.label_l1 = q.label_l1 AS own, q.label_l1, sum(list_distance(p.mert_full, q.mert_full)) / CASE WHEN p.label_l1 = q.label_l1 THEN count(*) - 1 ELSE count(*) END AS d
  FROM tracks p JOIN tracks q ON p.label_l1 <> -1 AND q.label_l1 <> -1 GROUP BY p.vec_id, p.label_l1, q.label_l1) GROUP BY i)"""))
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.silhouette(_labelled(spark, sf_dir))


@query(with_sql("SELECT CAST(least(floor((bpm - lo) / ((hi - lo) / 40)), 39) AS BIGINT) AS bin, count(*) AS n FROM features, (SELECT min(bpm) AS lo, max(bpm) AS hi FROM features) GROUP BY 1"))
def bpm_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    ends = f.agg(F.min("bpm").alias("lo"), F.max("bpm").alias("hi"))
    place = F.least(F.floor((F.col("bpm") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 40)), F.lit(39)).cast("long")
    return f.crossJoin(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))  # one row


@query(with_sql("SELECT count(*) AS n, count(DISTINCT label_l1) FILTER (label_l1 >= 0) AS clusters, count(*) FILTER (label_l1 = -1) / count(*) AS noise_rate, count(*) FILTER (label_l1 = -1 OR vec_id % 7 = 0) / count(*) AS raw_noise_rate, median(bpm) AS bpm_median FROM tracks LEFT JOIN features ON track_id = vec_id"))
def dashboard_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("vec_id") % 7 == 0, -1).otherwise(F.col("label_l1")).alias("label_l1_raw")
    rows = tracks(spark, sf_dir).select("vec_id", "label_l1", raw).join(features(spark, sf_dir).withColumnRenamed("track_id", "vec_id"), "vec_id", "left")
    return M.dashboard_kpis(rows)


@query(with_sql("SELECT label_l1, label_l2, dense_rank() OVER (PARTITION BY label_l1 ORDER BY label_l2) AS colour, row_number() OVER (PARTITION BY label_l1 ORDER BY vec_id) = 1 AS first_trace, vec_id FROM tracks WHERE label_l1 >= 0"))
def trace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("label_l1")
    rows = tracks(spark, sf_dir).filter("label_l1 >= 0")
    return rows.select("label_l1", "label_l2", F.dense_rank().over(w.orderBy("label_l2")).cast("long").alias("colour"), (F.row_number().over(w.orderBy("vec_id")) == 1).alias("first_trace"), "vec_id")


@query(with_sql("SELECT t.vec_id, c.title, c.genre, f.bpm, t.label_l1 = 3 AS selected FROM tracks t LEFT JOIN catalog c ON c.track_id = t.vec_id LEFT JOIN features f ON f.track_id = t.vec_id WHERE t.label_l1 <> -1 AND t.label_l1 = 3"))
def dashboard_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracks(spark, sf_dir).filter("label_l1 <> -1 and label_l1 = 3").select(F.col("vec_id").alias("track_id"), "label_l1")
    joined = rows.join(catalog(spark, sf_dir).select("track_id", "title", "genre"), "track_id", "left").join(features(spark, sf_dir).select("track_id", "bpm"), "track_id", "left")
    return joined.select(F.col("track_id").alias("vec_id"), "title", "genre", "bpm", (F.col("label_l1") == 3).alias("selected"))


# --- ordering and export --------------------------------------------------------------------------

_GREEDY = _HOUR_SQL + """, gb AS (SELECT label_l1 * 1000 + label_l2 AS grp, label_l1, label_l2, vec_id AS id, """ + _UNIT.format("mert_full") + """ AS v, COALESCE(bpm, 128.0) AS bpm, TRY_CAST(COALESCE(camelot, '?')[:-2] AS INTEGER) AS hour
  FROM tracks LEFT JOIN features ON track_id = vec_id LEFT JOIN hours USING (key) WHERE label_l1 >= 0),
spans AS (SELECT grp, CASE WHEN max(bpm) = min(bpm) THEN 1.0 ELSE max(bpm) - min(bpm) END AS rng FROM gb GROUP BY grp),
s AS (SELECT a.grp, a.id AS i, b.id AS j, 0.5 * (list_dot_product(a.v, b.v) + 1) / 2 + 0.3 * greatest(0.0, 1 - abs(a.bpm - b.bpm) / rng)
  + 0.2 * CASE WHEN a.hour IS NULL OR b.hour IS NULL THEN 0.5 WHEN least(abs(a.hour - b.hour), 12 - abs(a.hour - b.hour)) = 0 THEN 1.0 WHEN least(abs(a.hour - b.hour), 12 - abs(a.hour - b.hour)) = 1 THEN 0.5 ELSE 0.0 END AS sc
  FROM gb a JOIN gb b ON a.grp = b.grp AND a.id <> b.id JOIN spans sp ON sp.grp = a.grp),
g AS (SELECT grp, [arg_min(id, bpm * 1000000 + id)] AS path FROM gb GROUP BY grp
  UNION ALL SELECT g.grp, list_append(any_value(g.path), arg_max(s.j, (round(s.sc, 12), -s.j))) FROM g JOIN s ON s.grp = g.grp AND s.i = g.path[-1] WHERE NOT list_contains(g.path, s.j) GROUP BY g.grp),
ordered AS (SELECT gb.label_l1, gb.label_l2, gb.id AS vec_id, CAST(list_position(p.path, gb.id) - 1 AS INTEGER) AS position FROM (SELECT grp, max_by(path, len(path)) AS path FROM g GROUP BY grp) p JOIN gb ON gb.grp = p.grp
  UNION ALL SELECT label_l1, label_l2, vec_id, -1 FROM tracks WHERE label_l1 = -1)"""


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tracks; noise of level 1 has no place."""
    rows = _sequence(spark, sf_dir)
    placed = O.order_clusters(O.with_camelot(rows.filter("label_l1 <> -1")), ["label_l1", "label_l2"], "vec_id")
    return placed.unionByName(rows.filter("label_l1 = -1").select("label_l1", "label_l2", "vec_id", F.lit(-1).alias("position")))


@query(with_sql("SELECT label_l1, label_l2, vec_id, position FROM ordered", _GREEDY))
def greedy_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered(spark, sf_dir)


_EXPORT = _GREEDY + ", " + _NAMES + """,
files AS (SELECT o.*, c.artist || ' - ' || c.title AS label, c.filename,
  CASE WHEN o.label_l1 = -1 THEN '' ELSE 'L1_' || chr(65 + o.label_l1) || '_' || trim(regexp_replace(n1.name, '[\\\\/:*?"<>|]', '_', 'g'))[1:50] END AS folder,
  CASE WHEN o.label_l1 = -1 THEN 'All_Noise.m3u' WHEN o.label_l2 = -1 THEN 'L2_' || chr(65 + o.label_l1) || '_Noise.m3u' ELSE 'L2_' || trim(regexp_replace(n2.name, '[\\\\/:*?"<>|]', '_', 'g'))[1:50] || '.m3u' END AS file
  FROM ordered o JOIN catalog c ON c.track_id = o.vec_id LEFT JOIN names n1 ON n1.key = 'l1_' || o.label_l1 LEFT JOIN names n2 ON n2.key = 'l1_' || o.label_l1 || '_l2_' || o.label_l2),
placed_files AS (SELECT *, row_number() OVER (PARTITION BY folder, file ORDER BY CASE WHEN label_l1 = -1 THEN 0 ELSE position END, vec_id) AS place FROM files)"""


def _playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = naming.cluster_names(tracks(spark, sf_dir).select("vec_id", "label_l1", "label_l2"), catalog(spark, sf_dir).withColumnRenamed("track_id", "vec_id"), "vec_id")
    rows = _ordered(spark, sf_dir).join(catalog(spark, sf_dir).withColumnRenamed("track_id", "vec_id").select("vec_id", "filename", "artist", "title"), "vec_id")
    return X.playlists(rows.withColumn("order", F.col("vec_id")), names)


@query(with_sql("SELECT DISTINCT folder, file, 0 AS seq, '#EXTM3U' AS line FROM files UNION ALL SELECT folder, file, place * 2 - 1, '#EXTINF:-1,' || label FROM placed_files UNION ALL SELECT folder, file, place * 2, 'D:\\Music\\' || filename FROM placed_files", _EXPORT))
def m3u_lines_v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.m3u_lines(_playlists(spark, sf_dir), WINDOWS_DIR)


@query(with_sql("SELECT file, count(*) AS n FROM files GROUP BY folder, file", _EXPORT))
def export_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.summary(_playlists(spark, sf_dir)).select("file", "n")


@query(with_sql("""SELECT playlist, 0 AS seq, '#EXTM3U' AS line FROM (SELECT DISTINCT playlist FROM lists) UNION ALL SELECT playlist, 1, '#PLAYLIST:' || playlist FROM (SELECT DISTINCT playlist FROM lists) UNION ALL SELECT playlist, 2, '' FROM (SELECT DISTINCT playlist FROM lists)
  UNION ALL SELECT playlist, place * 3 + part, CASE part WHEN 0 THEN '#EXTINF:-1,' || replace(track, '.mp3', '') WHEN 1 THEN 'D:\\Music\\' || track ELSE '' END FROM (SELECT *, row_number() OVER (PARTITION BY playlist ORDER BY track) AS place FROM lists), (SELECT unnest([0, 1, 2]) AS part)""",
  "lists AS (SELECT CASE WHEN label_l1 = -1 THEN 'Noise' ELSE 'Cluster_' || lpad(CAST(label_l1 AS VARCHAR), 2, '0') END AS playlist, vec_id || ' ' || filename AS track FROM tracks JOIN catalog ON track_id = vec_id)"))
def m3u_lines_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracks(spark, sf_dir).join(catalog(spark, sf_dir).select(F.col("track_id").alias("vec_id"), "filename"), "vec_id")
    return X.m3u_lines_named(rows.select(text.cluster_name("label_l1").alias("playlist"), F.concat(F.col("vec_id").cast("string"), F.lit(" "), "filename").alias("track")), WINDOWS_DIR)


@query(with_sql("""SELECT id AS anchor, other, 'positive' AS kind FROM (SELECT vec_id AS id, lead(vec_id) OVER (PARTITION BY label_l1, label_l2 ORDER BY vec_id) AS other FROM tracks WHERE label_l1 <> -1 AND label_l2 <> -1) WHERE other IS NOT NULL
  UNION ALL SELECT a.vec_id, b.vec_id, 'negative' FROM pl a JOIN pl b ON b.label_l1 = a.label_l1 + 1 AND a.place = b.place""", "pl AS (SELECT vec_id, label_l1, row_number() OVER (PARTITION BY label_l1 ORDER BY vec_id) AS place FROM tracks WHERE label_l1 <> -1 AND label_l2 <> -1)"))
def contrastive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_pairs(tracks(spark, sf_dir).select(F.col("vec_id").alias("id"), "label_l1", "label_l2"))


# --- models: rows only ----------------------------------------------------------------------------


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("mert_full").alias("vector"))


@query()
def pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.project_2d(_points(spark, sf_dir))


@query()
def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.create("kmeans", n_clusters=5, starts=2, max_iter=20).fit_predict(_points(spark, sf_dir))


@query()
def agglomerative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.create("agglomerative", n_clusters=5).fit_predict(_points(spark, sf_dir))


@query()
def two_level_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracks(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("mert_perc").alias("perc"), F.col("mert_full").alias("full"))
    return L.two_levels(rows, L.HDBSCAN(6, 1), L.HDBSCAN(4, 2), pca=16)


@query()
def hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.hierarchical(_points(spark, sf_dir), L.create("kmeans", n_clusters=5, starts=1, max_iter=20), lambda x: L.agglomerate(x, 3))


@query()
def projection_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ProjectionHead.random(64, 32, 16).apply(_points(spark, sf_dir))
    return out.select("id", F.round(vectors.norm("vector"), 6).alias("length"), F.size("vector").alias("width"))


# --- properties and signal preparation --------------------------------------------------------------

@query(with_sql("SELECT vec_id, CAST(80 AS BIGINT) AS padded, round(list_sum(mert_full), 6) AS total, round(list_sum(mert_full[1:40]), 6) AS cut, round((mert_full[1] + mert_full[33]) / 2, 6) AS mono_first, round((mert_full[32] + mert_full[64]) / 2, 6) AS mono_last, round((mert_full[17] + mert_full[33] + mert_full[49]) / 3, 6) AS layer FROM tracks"))
def signal_preparation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as signals: filled up, cut, brought from two channels to one; the last three of four layers pooled."""
    v = tracks(spark, sf_dir).select("vec_id", "mert_full")

    def total(x):
        return F.round(F.aggregate(x, F.lit(0.0), lambda s, y: s + y), 6)

    padded, mono = vectors.cropped("mert_full", 80), vectors.mono(F.array(F.slice("mert_full", 1, 32), F.slice("mert_full", 33, 32)))
    layers = vectors.last_layers(F.array(*(F.slice("mert_full", 1 + 16 * i, 16) for i in range(4))), 3)
    return v.select("vec_id", F.size(padded).cast("long").alias("padded"), total(padded).alias("total"), total(vectors.cropped("mert_full", 40)).alias("cut"), F.round(mono[0], 6).alias("mono_first"), F.round(mono[31], 6).alias("mono_last"), F.round(layers[0], 6).alias("layer"))


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS noise, CAST(0 AS BIGINT) AS moved, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS undivided FROM embeddings")
def two_level_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of two levels with noise assigned: none is left, only noise moved, labels have no gaps, small parents have one subcluster."""
    rows = two_level_clusters(spark, sf_dir)
    moved = ((F.col("label_l1_raw") != -1) & (F.col("label_l1_raw") != F.col("label_l1"))) | ((F.col("label_l2_raw") != -1) & (F.col("label_l2_raw") != F.col("label_l2")))
    of = Window.partitionBy("label_l1")
    rows = rows.withColumns({"_n": F.count("*").over(of), "_top": F.max("label_l2_raw").over(of), "_kinds": F.size(F.collect_set(F.when(F.col("label_l2_raw") >= 0, F.col("label_l2_raw"))).over(of))})
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("label_l1") == -1).alias("noise"), F.count_if(moved).alias("moved"), F.count_if(F.col("_top") + 1 != F.col("_kinds")).alias("gaps"), F.count_if((F.col("_n") < 8) & (F.col("label_l2") != 0)).alias("undivided"))


@query(with_sql("SELECT count(*) AS n_tracks, true AS complete FROM files", _EXPORT))
def export_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the playlists hold every track that the catalog has."""
    n = tracks(spark, sf_dir).join(catalog(spark, sf_dir), F.col("vec_id") == F.col("track_id"), "left_semi").count()
    return spark.createDataFrame([(n, X.check_total(_playlists(spark, sf_dir), n))], "n_tracks long, complete boolean")
