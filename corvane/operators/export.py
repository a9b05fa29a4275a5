"""Playlist export: the lines of every file, the summary, and version folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import text


def next_version(names: DataFrame, prefix: str = "V4_") -> int:
    """One more than the highest version among folder ``name``s."""
    found = names.select(F.regexp_extract("name", rf"^{prefix}(\d+)$", 1).alias("v")).filter("v <> ''")
    return int(found.agg(F.coalesce(F.max(F.col("v").cast("int")), F.lit(0)).alias("v")).first()["v"]) + 1


def playlists(ordered: DataFrame, names: DataFrame) -> DataFrame:
    """``ordered`` (label_l1, label_l2, position, ...) with the ``folder``, ``file`` and ``kind`` of each row's playlist.

    Level-1 noise is one file. A cluster without any real subcluster is exported whole; elsewhere
    level-2 noise has a file of its own.
    """
    letter = text.letters("label_l1")
    key1 = F.concat(F.lit("l1_"), F.col("label_l1").cast("string"))
    real = F.max(F.when(F.col("label_l2") >= 0, 1).otherwise(0)).over(Window.partitionBy("label_l1"))
    rows = ordered.withColumns({"_real": real, "_key1": key1})
    l2 = F.when(F.col("_real") == 0, 0).otherwise(F.col("label_l2"))
    rows = rows.withColumn("_key2", F.concat("_key1", F.lit("_l2_"), l2.cast("string")))
    rows = rows.join(names.select(F.col("key").alias("_key1"), F.col("name").alias("_n1")), "_key1", "left").join(names.select(F.col("key").alias("_key2"), F.col("name").alias("_n2")), "_key2", "left")
    noise1, whole, noise2 = F.col("label_l1") == -1, F.col("_real") == 0, F.col("label_l2") == -1
    n1 = F.coalesce("_n1", F.concat(F.lit("Group_"), F.col("label_l1").cast("string")))
    n2 = F.coalesce("_n2", F.when(whole, F.concat(letter, F.lit("1"))).otherwise(text.subcluster_label(letter, "label_l2")))
    folder = F.when(noise1, F.lit("")).otherwise(F.concat(F.lit("L1_"), letter, F.lit("_"), text.safe_dirname(n1)))
    file = F.when(noise1, F.lit("All_Noise.m3u")).when(~whole & noise2, F.concat(F.lit("L2_"), letter, F.lit("_Noise.m3u"))).otherwise(F.concat(F.lit("L2_"), text.safe_dirname(n2), F.lit(".m3u")))
    kind = F.when(noise1, F.lit("Noise")).when(whole, F.concat(F.lit("L1_"), letter, F.lit(" (all)"))).when(noise2, F.concat(F.lit("L1_"), letter, F.lit(" Noise"))).otherwise(F.concat(F.lit("L1_"), letter))
    return rows.withColumns({"folder": folder, "file": file, "kind": kind}).drop("_real", "_key1", "_key2", "_n1", "_n2")


def m3u_lines(rows: DataFrame, windows_dir: str) -> DataFrame:
    """folder, file, seq, line of every playlist of ``playlists`` rows (filename, artist, title, position).

    Noise of level 1 keeps its order by key ``order``; others go by position.
    """
    label, path = text.track_label("artist", "title", "filename"), text.windows_path(windows_dir, "filename")
    place = F.row_number().over(Window.partitionBy("folder", "file").orderBy(F.when(F.col("label_l1") == -1, F.lit(0)).otherwise(F.col("position")), "order"))
    lines = F.array(F.concat(F.lit("#EXTINF:-1,"), label), path)
    body = rows.withColumn("_place", place).select("folder", "file", "_place", F.posexplode(lines).alias("part", "line"))
    body = body.select("folder", "file", (F.col("_place") * 2 - 1 + F.col("part")).alias("seq"), "line")
    head = rows.select("folder", "file").distinct().select("folder", "file", F.lit(0).alias("seq"), F.lit("#EXTM3U").alias("line"))
    return head.unionByName(body)


def m3u_lines_named(rows: DataFrame, windows_dir: str) -> DataFrame:
    """playlist, seq, line of the older format: names sorted, blank lines between, audio extensions taken out of labels."""
    place = F.row_number().over(Window.partitionBy("playlist").orderBy("track"))
    lines = F.array(F.concat(F.lit("#EXTINF:-1,"), text.without_audio_extension("track")), text.windows_path(windows_dir, "track"), F.lit(""))
    body = rows.withColumn("_place", place).select("playlist", "_place", F.posexplode(lines).alias("part", "line"))
    body = body.select("playlist", (F.col("_place") * 3 + F.col("part")).alias("seq"), "line")
    head = rows.select("playlist").distinct().select("playlist", F.posexplode(F.array(F.lit("#EXTM3U"), F.concat(F.lit("#PLAYLIST:"), F.col("playlist")), F.lit(""))).alias("seq", "line"))
    return head.unionByName(body)


def _padded(value: Column, width: int) -> Column:
    """Filled with spaces on the right, never cut."""
    return F.concat(value, F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.length(value))))


def summary(rows: DataFrame) -> DataFrame:
    """kind, file, n and the printed ``line`` of every playlist."""
    counts = rows.groupBy("folder", "kind", "file").agg(F.count("*").alias("n"))
    return counts.withColumn("line", F.concat(_padded(F.col("kind"), 12), F.lit(" | "), _padded(F.col("file"), 35), F.lit(" | "), F.lpad(F.col("n").cast("string"), 4, " "), F.lit(" tracks")))


def check_total(rows: DataFrame, expected: int) -> bool:
    """Whether as many rows are exported as there are tracks."""
    return rows.count() == expected
