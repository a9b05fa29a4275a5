"""Names of clusters by genre vote, folder names, and the tree report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import text


def ranked_genres(members: DataFrame, groups: list[str], genre: str, n: int) -> DataFrame:
    """The ``n`` most frequent values of each group that aren't blank, with their ``place``; ties by name."""
    counts = members.filter(F.col(genre).isNotNull() & (F.trim(genre) != "")).groupBy(*groups, genre).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("n"), F.col(genre)))
    return counts.withColumn("place", place).filter(F.col("place") <= n)


def _listed(best: DataFrame, groups: list[str], genre: str) -> DataFrame:
    # at most n rows a group reach the list
    names = F.transform(F.sort_array(F.collect_list(F.struct("place", F.col(genre).alias("g")))), lambda x: x["g"])
    return best.groupBy(*groups).agg(names.alias("names"))


def top_genres(members: DataFrame, groups: list[str], genre: str = "genre", n: int = 2, joined: str = " / ") -> DataFrame:
    """The ``n`` most frequent simple genres of each group, joined. Genres of one simple name count as one."""
    simple = members.select(*groups, text.simple_genre(genre).alias("_simple"))
    return _listed(ranked_genres(simple, groups, "_simple", n), groups, "_simple").select(*groups, F.array_join("names", joined).alias("genres"))


def cluster_names(results: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """Rows (key, name) for clusters of both levels and their noise."""
    members = results.join(catalog.select(key, "genre"), key, "left")
    letter = text.letters("label_l1")
    l1 = results.filter("label_l1 <> -1").groupBy("label_l1").agg(F.max(F.when(F.col("label_l2") >= 0, 1).otherwise(0)).alias("divided"), F.max(F.when(F.col("label_l2") == -1, 1).otherwise(0)).alias("noisy"))
    named = l1.join(top_genres(members, ["label_l1"]), "label_l1", "left").withColumn("l1_name", F.when(F.coalesce("genres", F.lit("")) != "", F.col("genres")).otherwise(F.concat(F.lit("Group "), letter))).drop("genres")
    one = F.concat(F.lit("l1_"), F.col("label_l1").cast("string"))
    out = named.select(one.alias("key"), F.col("l1_name").alias("name"))
    out = out.unionByName(named.filter("divided = 0").select(F.concat(one, F.lit("_l2_0")).alias("key"), F.concat(letter, F.lit("1")).alias("name")))
    out = out.unionByName(named.filter("divided = 1 and noisy = 1").select(F.concat(one, F.lit("_l2_-1")).alias("key"), F.concat(letter, F.lit("_Noise")).alias("name")))
    l2 = results.filter("label_l1 <> -1 and label_l2 <> -1").select("label_l1", "label_l2").distinct()
    l2 = l2.join(top_genres(members, ["label_l1", "label_l2"]), ["label_l1", "label_l2"], "left").join(named.select("label_l1", "l1_name"), "label_l1")
    short = text.subcluster_label(letter, "label_l2")
    full = F.when((F.coalesce("genres", F.lit("")) != "") & (F.col("genres") != F.col("l1_name")), F.concat(short, F.lit(" "), F.col("genres"))).otherwise(short)
    out = out.unionByName(l2.select(F.concat(one, F.lit("_l2_"), F.col("label_l2").cast("string")).alias("key"), full.alias("name")))
    spark = results.sparkSession
    return out.unionByName(spark.createDataFrame([("l1_-1", "Noise")], "key string, name string"))


def genre_folders(members: DataFrame, group: str, genre: str, n: int = 2) -> DataFrame:
    """Folder of each group: first genre and the list of its top ones, ``unknown`` and ``error`` not counted. Genres are counted as they are and then simplified."""
    known = members.filter(~F.col(genre).isin("unknown", "error"))
    best = ranked_genres(known, [group], genre, n).withColumn("_simple", text.simple_genre(genre))
    names = _listed(best, [group], "_simple")
    groups = members.select(group).distinct()
    folder = F.when(F.col("names").isNull(), F.concat(F.lit("Group_"), F.col(group))).otherwise(F.concat(F.col("names")[0], F.lit("_["), F.array_join("names", "_"), F.lit("]")))
    return groups.join(names, group, "left").select(group, F.when(F.col(group) == "Noise", F.lit("Noise")).otherwise(folder).alias("folder"))


def subcluster_folders(members: DataFrame, group: str, genre: str) -> DataFrame:
    """Folder of each subcluster: its most frequent genre, simplified, or its own label; noise keeps its label."""
    noise = (F.col(group) == "Noise") | F.contains(group, F.lit("_noise"))
    known = members.filter(~F.col(genre).isin("unknown", "error"))
    first = ranked_genres(known, [group], genre, 1).select(group, text.simple_genre(genre).alias("_simple"))
    return members.select(group).distinct().join(first, group, "left").select(group, F.when(noise, F.col(group)).otherwise(F.coalesce("_simple", group)).alias("folder"))


def majority(members: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group, nulls and blanks left out; ties by name."""
    return ranked_genres(members, [group], value, 1).select(group, value)


def disambiguated(names: DataFrame, name: str, letter: str) -> DataFrame:
    """Names that several rows share get their letter."""
    many = F.count("*").over(Window.partitionBy(name)) > 1
    return names.withColumn("label", F.when(many, F.concat(F.col(name), F.lit(" ("), F.col(letter), F.lit(")"))).otherwise(F.col(name)))


def noise_last(column: str) -> list[Column]:
    return [F.col(column) == "Noise", F.col(column)]


def tree_lines(rows: DataFrame, l1: str = "folder_l1", l2: str = "folder_l2", track: str = "track") -> DataFrame:
    """Lines (path keys and ``line``) of a directory tree; sort by the keys to print it.

    Keys: noise_1, folder_1, depth, noise_2, folder_2, leaf. Every line needs only its own group's
    windows, so the tree is never gathered.
    """
    groups = rows.groupBy(F.col(l1).alias("a"), F.col(l2).alias("b")).agg(F.count("*").alias("n"))
    tops = groups.groupBy("a").agg(F.sum("n").alias("n"))
    # the number of folders is small; one row each
    last_a = F.lead("a").over(Window.orderBy(*noise_last("a"))).isNull()
    tops = tops.withColumn("last_a", last_a)
    groups = groups.withColumn("last_b", F.lead("b").over(Window.partitionBy("a").orderBy(*noise_last("b"))).isNull())
    leaves = rows.select(F.col(l1).alias("a"), F.col(l2).alias("b"), F.col(track).alias("t")).withColumn("last_t", F.lead("t").over(Window.partitionBy("a", "b").orderBy("t")).isNull())

    def branch(last: str) -> Column:
        return F.when(F.col(last), F.lit("└── ")).otherwise(F.lit("├── "))

    def indent(last: str) -> Column:
        return F.when(F.col(last), F.lit("    ")).otherwise(F.lit("│   "))

    def counted(name: str) -> Column:
        return F.concat(F.col(name), F.lit(" ("), F.col("n").cast("string"), F.lit(" tracks)"))

    def keys(depth: int, b: Column, t: Column) -> list[Column]:
        return [(F.col("a") == "Noise").cast("int").alias("noise_1"), F.col("a").alias("folder_1"), (b == "Noise").cast("int").alias("noise_2"), b.alias("folder_2"), F.lit(depth).alias("depth"), t.alias("leaf")]

    marks = tops.select("a", "last_a")
    out = tops.select(*keys(1, F.lit(""), F.lit("")), F.concat(branch("last_a"), counted("a")).alias("line"))
    mid = groups.join(F.broadcast(marks), "a")  # one row per top folder
    out = out.unionByName(mid.select(*keys(2, F.col("b"), F.lit("")), F.concat(indent("last_a"), branch("last_b"), counted("b")).alias("line")))
    low = leaves.join(mid.select("a", "b", "last_a", "last_b"), ["a", "b"])
    return out.unionByName(low.select(*keys(3, F.col("b"), F.col("t")), F.concat(indent("last_a"), indent("last_b"), branch("last_t"), F.col("t")).alias("line")))
