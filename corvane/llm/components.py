"""Connected components of a graph given as rows, without gathering it anywhere.

Alternates the large-star and the small-star step until every node points at the smallest node of
its component. All steps are joins and minima by node; a node of very many links is aggregated
before it is shuffled, and its join is one that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """Links (a, b) of any ordered type to rows (node, component): the smallest node reachable.

    Nodes without links to others don't appear. Repeated links, links in both directions and loops
    are fine; links with a null end are ignored. No links give no rows.
    """
    e = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, "links")
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = materialize(small.distinct(), "small")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(e: DataFrame) -> bool:
    """Whether each node either points at one other or is pointed at."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("in").alias("in")).filter("out > 1 or (out = 1 and `in` = 1)").isEmpty()
