"""Queries over the catalog, its metadata, shards, artifacts, names and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import text
from corvane.operators import catalog as C
from corvane.operators import export as X
from corvane.operators import naming as N
from corvane.plans.registry import query
from corvane.sources import files
from corvane.sources.tables import catalog, features, read, tracks, with_sql

STEM = "regexp_replace({0}, '\\.[^.]+$', '')"


@query(with_sql("SELECT track_id, filename, artist, title, duration_s, filesize_bytes FROM catalog WHERE duration_s IS NOT NULL AND duration_s >= 905"))
def catalog_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = catalog(spark, sf_dir).select("track_id", "filename", "duration_s", "filesize_bytes")
    return C.build_catalog(raw).filter("duration_s >= 905").select("track_id", "filename", "artist", "title", "duration_s", "filesize_bytes")


@query(with_sql("SELECT track_id, duration_s, CASE WHEN duration_s < 950 THEN 'too short' END AS reason FROM catalog"))
def manifest_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.manifest(catalog(spark, sf_dir), 950.0).select("track_id", "duration_s", "reason")


@query(with_sql("""SELECT c.track_id, c.filename, c.genre, m.genre_meta, m.rating FROM catalog c LEFT JOIN (
  SELECT lower(artist || ' - ' || title) AS norm, upper(genre) AS genre_meta, track_id % 5 AS rating FROM catalog WHERE track_id % 40 = 0) m
  ON lower(c.artist || ' - ' || c.title) = m.norm"""))
def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = catalog(spark, sf_dir)
    shouted = F.upper(F.regexp_replace(text.stem("filename"), " ", "  "))
    meta = base.filter("track_id % 40 = 0").select(F.concat(F.lit(" "), shouted, F.lit(".MP3")).alias("filename"), F.upper("genre").alias("genre"), (F.col("track_id") % 5).alias("rating"))
    return C.merge_metadata(base.select("track_id", "filename", "genre"), meta)


@query(with_sql("SELECT c.track_id, c.title, f.bpm AS bpm, f.key AS key FROM catalog c LEFT JOIN features f USING (track_id)"))
def catalog_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    stale = catalog(spark, sf_dir).select("track_id", "title", F.lit(0.0).alias("bpm"))
    return C.update_columns(stale, features(spark, sf_dir), "track_id").select("track_id", "title", "bpm", "key")


@query(with_sql("SELECT vec_id, COALESCE(bpm, 128.0) AS bpm, COALESCE(key, '?') AS key FROM tracks LEFT JOIN features ON track_id = vec_id"))
def feature_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracks(spark, sf_dir).select("vec_id").join(features(spark, sf_dir).withColumnRenamed("track_id", "vec_id"), "vec_id", "left")
    return C.with_defaults(rows, bpm=128.0, key="?")


@query("SELECT vec_id FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM embeddings) WHERE r % 4 = 1")
def shard_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stride_shard(read(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 1, 4).select("vec_id")


@query("SELECT vec_id % 4 AS shard, count(*) AS n, min(vec_id) AS first_id, max(len(embedding)) AS width, bool_and(list_bool_and(list_transform(embedding, lambda x: isfinite(x)))) AS finite FROM embeddings WHERE vec_id % 4 <> 3 GROUP BY 1")
def shard_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.functions import vectors

    all_rows = read(spark, sf_dir, "embeddings")
    merged = C.merge_shards([all_rows.filter(F.col("vec_id") % 4 == s).withColumn("shard", F.lit(s).cast("long")) for s in range(3)])
    return merged.groupBy("shard").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"), F.max(F.size("embedding")).cast("long").alias("width"), F.bool_and(vectors.finite("embedding")).alias("finite"))


@query("SELECT vec_id, 'missing' AS side FROM embeddings WHERE vec_id % 4 = 3 UNION ALL SELECT vec_id + 1000000, 'extra' FROM embeddings WHERE vec_id % 50 = 0 AND vec_id % 4 <> 3")
def shard_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "embeddings").select("vec_id")
    kept = ids.filter("vec_id % 4 <> 3")
    return C.coverage(ids, kept.unionByName(kept.filter("vec_id % 50 = 0").select((F.col("vec_id") + 1000000).alias("vec_id"))), "vec_id")


@query(with_sql("SELECT u.row_idx, u.track_id, c.title FROM (SELECT vec_id AS track_id, 1000000 - vec_id AS row_idx FROM tracks WHERE vec_id % 4 <> 3 UNION ALL SELECT vec_id, 2000000 + vec_id FROM tracks WHERE vec_id % 100 = 0) u JOIN catalog c USING (track_id)"))
def catalog_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = tracks(spark, sf_dir).select(F.col("vec_id").alias("track_id"))
    uids = ids.filter("track_id % 4 <> 3").withColumn("row_idx", 1000000 - F.col("track_id")).unionByName(ids.filter("track_id % 100 = 0").withColumn("row_idx", 2000000 + F.col("track_id")))
    return C.in_list_order(uids, catalog(spark, sf_dir).select("track_id", "title"), "track_id").select("row_idx", "track_id", "title")


@query("SELECT vec_id FROM embeddings WHERE vec_id % 7 <> 0 OR vec_id % 21 = 0")
def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "embeddings").select("vec_id")
    return C.remaining(ids, ids.filter("vec_id % 7 = 0 and vec_id % 21 <> 0"), "vec_id")


@query("SELECT vec_id FROM embeddings ORDER BY md5(vec_id::VARCHAR || ':42'), vec_id LIMIT 25")
def stable_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stable_sample(read(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 25)


@query("SELECT doc_id, sha256(text) AS track_uid, sha256(encode(text)[1:64] || encode(CAST(strlen(text) AS VARCHAR))) AS fast_uid, sha1(source || '/' || doc_id) AS track_id, substr(md5(text), 1, 8) AS config_hash FROM documents")
def track_uids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _uids(read(spark, sf_dir, "documents"))


def _uids(docs: DataFrame) -> DataFrame:
    from corvane.functions import hashing as H

    body = F.col("text").cast("binary")
    return docs.select("doc_id", H.track_uid(body).alias("track_uid"), H.fast_track_uid(body, 64).alias("fast_uid"), H.track_id(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))).alias("track_id"), F.substring(F.md5("text"), 1, 8).alias("config_hash"))


@query(with_sql("SELECT track_id, regexp_replace(filename, '\\.[^.]+$', '') AS stem, '.mp3' AS ext, lower(regexp_replace(filename, '\\.[^.]+$', '')) AS norm, p.artist || ' - ' || p.title AS label, 'D:\\Music\\' || filename AS path, CAST(floor(duration_s / 60) AS BIGINT) || ':' || lpad(CAST(CAST(floor(duration_s) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS clock FROM catalog p"))
def track_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).select("track_id", text.stem("filename").alias("stem"), text.extension("filename").alias("ext"), text.normalized_filename("filename").alias("norm"), text.track_label("artist", "title", "filename").alias("label"), text.windows_path("D:\\Music\\", "filename").alias("path"), text.clock("duration_s").alias("clock"))


@query(with_sql("""SELECT l1 AS label, CASE WHEN l1 < 26 THEN chr(CAST(65 + l1 AS INTEGER)) WHEN l1 < 702 THEN chr(CAST(64 + l1 // 26 AS INTEGER)) || chr(CAST(65 + l1 % 26 AS INTEGER))
  ELSE chr(CAST(65 + (l1 - 702) // 676 AS INTEGER)) || chr(CAST(65 + (l1 - 702) // 26 % 26 AS INTEGER)) || chr(CAST(65 + (l1 - 702) % 26 AS INTEGER)) END AS letters,
  'Cluster_' || CASE WHEN l1 < 10 THEN '0' ELSE '' END || l1 AS display, trim(regexp_replace('a:' || l1 || '?b  ', '[:?]', '_', 'g'))[1:6] AS safe
  FROM (SELECT vec_id AS l1 FROM embeddings WHERE vec_id < 499 UNION ALL SELECT vec_id + 600 FROM embeddings WHERE vec_id < 400)"""))
def cluster_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("label"))
    rows = ids.filter("label < 499").unionByName(ids.filter("label < 400").select((F.col("label") + 600).alias("label")))
    safe = F.substring(text.safe_dirname(F.concat(F.lit("a:"), F.col("label").cast("string"), F.lit("?b  "))), 1, 6)
    return rows.select("label", text.letters("label").alias("letters"), text.cluster_name("label").alias("display"), safe.alias("safe"))


_VOTE = """votes AS (
  SELECT label_l1, split_part(genre, '---', 2) AS genre, count(*) AS n FROM tracks JOIN catalog ON track_id = vec_id GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY label_l1 ORDER BY n DESC, genre) AS place FROM votes),
tops AS (SELECT label_l1, string_agg(genre, ' / ' ORDER BY place) AS genres FROM placed WHERE place <= 2 GROUP BY label_l1)"""


@query(with_sql("SELECT * FROM tops", _VOTE))
def genre_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = tracks(spark, sf_dir).select("vec_id", "label_l1").join(catalog(spark, sf_dir).select(F.col("track_id").alias("vec_id"), "genre"), "vec_id")
    return N.top_genres(members, ["label_l1"])


_NAMES = _VOTE + """,
votes2 AS (SELECT label_l1, label_l2, split_part(genre, '---', 2) AS genre, count(*) AS n FROM tracks JOIN catalog ON track_id = vec_id WHERE label_l1 >= 0 AND label_l2 >= 0 GROUP BY ALL),
placed2 AS (SELECT *, row_number() OVER (PARTITION BY label_l1, label_l2 ORDER BY n DESC, genre) AS place FROM votes2),
tops2 AS (SELECT label_l1, label_l2, string_agg(genre, ' / ' ORDER BY place) AS genres FROM placed2 WHERE place <= 2 GROUP BY label_l1, label_l2),
l1 AS (SELECT label_l1, max(label_l2) >= 0 AS divided, min(label_l2) = -1 AS noisy, chr(65 + label_l1) AS letter FROM tracks WHERE label_l1 >= 0 GROUP BY label_l1),
names AS (
  SELECT 'l1_-1' AS key, 'Noise' AS name
  UNION ALL SELECT 'l1_' || label_l1, COALESCE(genres, 'Group ' || letter) FROM l1 LEFT JOIN tops USING (label_l1)
  UNION ALL SELECT 'l1_' || label_l1 || '_l2_0', letter || '1' FROM l1 WHERE NOT divided
  UNION ALL SELECT 'l1_' || label_l1 || '_l2_-1', letter || '_Noise' FROM l1 WHERE divided AND noisy
  UNION ALL SELECT 'l1_' || d.label_l1 || '_l2_' || d.label_l2, letter || (d.label_l2 + 1) || CASE WHEN t2.genres IS NOT NULL AND t2.genres <> COALESCE(t1.genres, 'Group ' || letter) THEN ' ' || t2.genres ELSE '' END
  FROM (SELECT DISTINCT label_l1, label_l2 FROM tracks WHERE label_l1 >= 0 AND label_l2 >= 0) d JOIN l1 USING (label_l1)
  LEFT JOIN tops t1 ON t1.label_l1 = d.label_l1 LEFT JOIN tops2 t2 ON t2.label_l1 = d.label_l1 AND t2.label_l2 = d.label_l2)"""


@query(with_sql("SELECT key, name FROM names", _NAMES))
def cluster_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.cluster_names(tracks(spark, sf_dir).select("vec_id", "label_l1", "label_l2"), catalog(spark, sf_dir).withColumnRenamed("track_id", "vec_id"), "vec_id")


_FOLDERS = """members AS (SELECT CASE WHEN label_l1 = -1 THEN 'Noise' ELSE chr(65 + label_l1) END AS letter, CASE WHEN vec_id % 13 = 0 THEN 'unknown' ELSE genre END AS genre_1 FROM tracks JOIN catalog ON track_id = vec_id),
fvotes AS (SELECT letter, genre_1, count(*) AS n FROM members WHERE genre_1 NOT IN ('unknown', 'error') GROUP BY ALL),
fplaced AS (SELECT *, row_number() OVER (PARTITION BY letter ORDER BY n DESC, genre_1) AS place FROM fvotes),
folders AS (SELECT letter, CASE WHEN letter = 'Noise' THEN 'Noise' ELSE max(CASE WHEN place = 1 THEN split_part(genre_1, '---', 2) END) || '_[' || string_agg(split_part(genre_1, '---', 2), '_' ORDER BY place) || ']' END AS folder FROM fplaced WHERE place <= 2 GROUP BY letter)"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = tracks(spark, sf_dir).join(catalog(spark, sf_dir).select(F.col("track_id").alias("vec_id"), "genre", "filename"), "vec_id")
    return named.select("vec_id", "filename", text.letters("label_l1").alias("letter"), F.when(F.col("vec_id") % 13 == 0, "unknown").otherwise(F.col("genre")).alias("genre_1"))


@query(with_sql("SELECT letter, folder FROM folders", _FOLDERS))
def folder_names_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.genre_folders(_members(spark, sf_dir), "letter", "genre_1")


@query(with_sql("SELECT letter, split_part(genre_1, '---', 2) AS genre FROM fplaced WHERE place = 1", _FOLDERS))
def genre_map_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _members(spark, sf_dir).filter("genre_1 not in ('unknown', 'error')")
    return N.majority(known, "letter", "genre_1").select("letter", text.simple_genre("genre_1").alias("genre"))


@query(with_sql("""SELECT label, CASE WHEN label = 'Noise' OR label LIKE '%!_noise' ESCAPE '!' THEN label ELSE COALESCE((SELECT split_part(v.genre, '---', 2) FROM svotes v WHERE v.label = s.label ORDER BY n DESC, v.genre LIMIT 1), label) END AS folder
  FROM (SELECT DISTINCT label FROM subs) s""", """subs AS (SELECT CASE WHEN label_l1 = -1 THEN 'Noise' WHEN label_l2 = -1 THEN chr(65 + label_l1) || '_noise' ELSE chr(65 + label_l1) || (label_l2 + 1) END AS label, CASE WHEN vec_id % 13 = 0 OR label_l1 = 2 THEN 'unknown' ELSE genre END AS genre FROM tracks JOIN catalog ON track_id = vec_id),
svotes AS (SELECT label, genre, count(*) AS n FROM subs WHERE genre NOT IN ('unknown', 'error') GROUP BY ALL)"""))
def subcluster_folders_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.operators.clustering import composite_labels

    rows = tracks(spark, sf_dir).join(catalog(spark, sf_dir).select(F.col("track_id").alias("vec_id"), "genre"), "vec_id")
    genre = F.when((F.col("vec_id") % 13 == 0) | (F.col("label_l1") == 2), "unknown").otherwise(F.col("genre"))
    return N.subcluster_folders(composite_labels(rows).select(F.col("composite").alias("label"), genre.alias("genre")), "label", "genre")


@query(with_sql("SELECT letter, split_part(folder, '_[', 1) AS folder, split_part(folder, '_[', 1) || CASE WHEN count(*) OVER (PARTITION BY split_part(folder, '_[', 1)) > 1 THEN ' (' || letter || ')' ELSE '' END AS label FROM folders", _FOLDERS))
def genre_disambiguate(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = N.genre_folders(_members(spark, sf_dir), "letter", "genre_1").select("letter", text.base_genre("folder").alias("folder"))
    return N.disambiguated(folders, "folder", "letter")


@query(with_sql("""SELECT line FROM (
  SELECT *, row_number() OVER () FROM (
  SELECT CASE WHEN la THEN '└── ' ELSE '├── ' END || a || ' (' || n || ' tracks)' AS line FROM tops
  UNION ALL SELECT CASE WHEN la THEN '    ' ELSE '│   ' END || CASE WHEN lb THEN '└── ' ELSE '├── ' END || b || ' (' || g.n || ' tracks)' FROM groups g JOIN tops USING (a)
  UNION ALL SELECT CASE WHEN la THEN '    ' ELSE '│   ' END || CASE WHEN lb THEN '    ' ELSE '│   ' END || CASE WHEN lt THEN '└── ' ELSE '├── ' END || t FROM leaves JOIN groups g USING (a, b) JOIN tops USING (a)))""",
  """rows_ AS (SELECT CASE WHEN label_l1 = -1 THEN 'Noise' ELSE 'L' || label_l1 END AS a, CASE WHEN label_l2 = -1 THEN 'Noise' ELSE 'S' || label_l2 END AS b, 'track ' || vec_id AS t FROM tracks),
  tops AS (SELECT a, count(*) AS n, lead(a) OVER (ORDER BY a = 'Noise', a) IS NULL AS la FROM rows_ GROUP BY a),
  groups AS (SELECT a, b, count(*) AS n, lead(b) OVER (PARTITION BY a ORDER BY b = 'Noise', b) IS NULL AS lb FROM rows_ GROUP BY a, b),
  leaves AS (SELECT a, b, t, lead(t) OVER (PARTITION BY a, b ORDER BY t) IS NULL AS lt FROM rows_)"""))
def tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    l1 = F.when(F.col("label_l1") == -1, F.lit("Noise")).otherwise(F.concat(F.lit("L"), F.col("label_l1").cast("string")))
    l2 = F.when(F.col("label_l2") == -1, F.lit("Noise")).otherwise(F.concat(F.lit("S"), F.col("label_l2").cast("string")))
    rows = tracks(spark, sf_dir).select(l1.alias("folder_l1"), l2.alias("folder_l2"), F.concat(F.lit("track "), F.col("vec_id").cast("string")).alias("track"))
    return N.tree_lines(rows).orderBy("noise_1", "folder_1", "noise_2", "folder_2", "depth", "leaf").select("line")


@query("SELECT event_type AS artifact, arg_max(event_id, (ts, event_id)) AS latest, COALESCE(arg_max(event_id, (ts, event_id)) FILTER (user_id % 7 = 0), arg_max(event_id, (ts, event_id))) AS latest_mapped FROM events GROUP BY event_type")
def latest_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select(F.col("event_type").alias("artifact"), F.col("event_id").alias("path"), F.col("ts").alias("mtime"), F.when(F.col("user_id") % 7 == 0, 1.5).otherwise(0.0).alias("umap_x"))
    newest = files.latest(events, "path", "mtime", ("artifact",)).withColumnRenamed("path", "latest")
    return newest.join(files.latest_with_map(events, ("artifact",)).withColumnRenamed("path", "latest_mapped"), "artifact")


@query("SELECT COALESCE(max(CAST(regexp_extract(name, '^V4_([0-9]+)$', 1) AS INTEGER)), 0) + 1 AS next_version FROM (SELECT 'V4_' || n_nationkey AS name FROM nation UNION ALL SELECT 'V4_x' || n_nationkey FROM nation UNION ALL SELECT n_name FROM nation) WHERE regexp_matches(name, '^V4_[0-9]+$')")
def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    names = n.select(F.concat(F.lit("V4_"), F.col("n_nationkey").cast("string")).alias("name")).unionByName(n.select(F.concat(F.lit("V4_x"), F.col("n_nationkey").cast("string")).alias("name"))).unionByName(n.select(F.col("n_name").alias("name")))
    return spark.createDataFrame([(X.next_version(names),)], "next_version int")


@query("SELECT event_type, strftime(ts, '%Y-%m-%d %H') AS hour, count(*) AS n, round(avg(value), 6) AS mean_ms, max(CAST(json_extract(props, '$.k') AS INTEGER)) AS max_k FROM events GROUP BY ALL")
def event_log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_ms"), F.max(k).alias("max_k"))


@query("SELECT count(*) AS n_found, count(*) FILTER (n_chars > 500) AS n_valid, count(*) FILTER (n_chars <= 500) AS n_failed, count(DISTINCT source) AS n_sources, min(n_chars) AS shortest, max(n_chars) AS longest, median(n_chars) AS middle FROM documents")
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("n_chars") > 500
    return read(spark, sf_dir, "documents").agg(F.count("*").alias("n_found"), F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_failed"), F.count_distinct("source").alias("n_sources"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"), F.percentile("n_chars", 0.5).alias("middle"))


@query("SELECT user_id, event_id, checkpoint, last_value(checkpoint IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS last_checkpoint FROM (SELECT user_id, event_id, CASE WHEN (event_id + 1) % 25 = 0 THEN event_id END AS checkpoint FROM events)")
def checkpoint_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last checkpoint at every event."""
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", F.when((F.col("event_id") + 1) % 25 == 0, F.col("event_id")).alias("checkpoint"))
    return rows.withColumn("last_checkpoint", F.last("checkpoint", ignorenulls=True).over(Window.partitionBy("user_id").orderBy("event_id")))


@query(with_sql("""SELECT t.vec_id, 'L' || label_l1 AS cluster_l1, COALESCE(NULLIF(CASE WHEN t.vec_id % 3 = 0 THEN NULL WHEN t.vec_id % 5 = 0 THEN '' ELSE 'L' || label_l1 || 'S' || label_l2 END, ''), 'L' || label_l1) AS cluster_l2,
  CASE WHEN t.vec_id % 4 = 0 THEN 'Unknown' ELSE COALESCE(c.genre, 'Unknown') END AS folder FROM tracks t LEFT JOIN catalog c ON c.track_id = t.vec_id"""))
def three_way_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir)
    l1 = t.select("vec_id", F.concat(F.lit("L"), F.col("label_l1").cast("string")).alias("cluster_l1"))
    name = F.concat(F.lit("L"), F.col("label_l1").cast("string"), F.lit("S"), F.col("label_l2").cast("string"))
    l2 = t.filter("vec_id % 3 <> 0").select("vec_id", F.when(F.col("vec_id") % 5 == 0, "").otherwise(name).alias("l2"))
    final = catalog(spark, sf_dir).filter("track_id % 4 <> 0").select(F.col("track_id").alias("vec_id"), "genre")
    joined = l1.join(l2, "vec_id", "left").join(final, "vec_id", "left")
    return joined.select("vec_id", "cluster_l1", F.coalesce(F.nullif("l2", F.lit("")), "cluster_l1").alias("cluster_l2"), F.coalesce("genre", F.lit("Unknown")).alias("folder"))


@query("""SELECT label, row_number() OVER (ORDER BY CASE WHEN label IN ('-1', 'Noise') THEN 2 WHEN TRY_CAST(label AS INTEGER) IS NOT NULL THEN 0 ELSE 1 END,
  CASE WHEN label NOT IN ('-1', 'Noise') AND TRY_CAST(label AS INTEGER) IS NOT NULL THEN lpad(label, 6, '0') ELSE label END) AS place
  FROM (SELECT DISTINCT CASE WHEN event_id % 7 = 0 THEN 'Noise' WHEN event_id % 3 = 0 THEN event_type ELSE CAST(event_id % 23 - 1 AS VARCHAR) END AS label FROM events)""")
def cluster_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every event."""
    return _sorted_labels(read(spark, sf_dir, "events"))


def _sorted_labels(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    label = F.when(e % 7 == 0, F.lit("Noise")).when(e % 3 == 0, F.col("event_type")).otherwise((e % 23 - 1).cast("string")).alias("label")
    return events.select(label).distinct().withColumn("place", F.row_number().over(Window.orderBy(*text.cluster_order("label"))).cast("long"))


@query()
def cluster_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.functions.colours import palette

    letter = text.letters("label_l1")
    rows = tracks(spark, sf_dir).select(letter.alias("cluster_l1"), F.concat(letter, F.col("label_l2").cast("string")).alias("cluster_l2"))
    return palette(rows)


@query("SELECT event_type, time_bucket(INTERVAL 6 HOURS, ts) AS start, count(*) AS n, round(avg(value), 6) AS mean_ms FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.window("ts", "6 hours")
    return read(spark, sf_dir, "events").groupBy("event_type", w).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_ms")).select("event_type", F.col("window.start").alias("start"), "n", "mean_ms")


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
  FROM (SELECT *, COALESCE(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 4 HOURS, true) AS new FROM events)) GROUP BY user_id, s""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.session_window("ts", "4 hours")
    return read(spark, sf_dir, "events").groupBy("user_id", w).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


@query(with_sql("SELECT vec_id, label_l1 AS label FROM tracks"))
def letter_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters read back as labels."""
    return tracks(spark, sf_dir).select("vec_id", text.letter_label(text.letters("label_l1")).alias("label"))


@query(with_sql("SELECT row_idx, uid, title FROM (SELECT vec_id * 2 AS row_idx, vec_id * 3 AS uid FROM embeddings UNION ALL SELECT vec_id * 2 + 1, vec_id FROM embeddings) LEFT JOIN catalog ON track_id = uid"))
def list_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "embeddings")
    listed = ids.select((F.col("vec_id") * 2).alias("row_idx"), (F.col("vec_id") * 3).alias("uid")).unionByName(ids.select((F.col("vec_id") * 2 + 1).alias("row_idx"), F.col("vec_id").alias("uid")))
    return C.in_list_order(listed, catalog(spark, sf_dir).select(F.col("track_id").alias("uid"), "title"), "uid", keep_missing=True).select("row_idx", "uid", "title")


@query("SELECT e.vec_id AS row_idx, 'u' || (e.vec_id * 7) AS uid, round(CAST(e.embedding[1] AS DOUBLE), 6) AS head, e.label AS shard FROM embeddings e")
def shard_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and matrix rows by place, then the manifest of each."""
    e = read(spark, sf_dir, "embeddings")
    ids = e.select(F.col("vec_id").alias("row_idx"), F.concat(F.lit("u"), (F.col("vec_id") * 7).cast("string")).alias("uid"))
    rows = C.zipped(ids, e.select(F.col("vec_id").alias("row_idx"), F.round(F.col("embedding")[0].cast("double"), 6).alias("head")))
    manifest = e.select(F.concat(F.lit("u"), (F.col("vec_id") * 7).cast("string")).alias("uid"), F.col("label").alias("shard"))
    return C.with_manifest(rows, manifest, "uid").select("row_idx", "uid", "head", "shard")
