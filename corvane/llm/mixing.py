"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a fixed pseudo-random order, form blocks of equal size. Block j of a
source of weight w is released at slot floor((j - 1) / w) and due by ceil(j / w). Earliest deadline
first gives every slot to one released block; each source is then never a whole block ahead of or
behind its weight. With weights in whole parts of a period the schedule repeats, so one period is
computed on the driver, whatever the size of the corpus, and every block's slot follows in closed form.

A source that runs out leaves its slots empty and the others keep their relative weights; no row
is dropped or repeated.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows in one rank bucket of a source, at most on average; small, so that a hot source spreads over all tasks.
ROWS_PER_BUCKET = 512


def pfair_period(parts: Mapping[str, int]) -> list[str]:
    """One period of the schedule: slot t belongs to the t-th name; each name has as many slots as parts."""
    total = sum(parts.values())
    waiting = sorted(((j * total) // n, -(-(j + 1) * total // n), name) for name, n in parts.items() for j in range(n))
    ready: list[tuple[int, str, int]] = []
    out: list[str] = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            release, due, name = waiting.pop(0)
            heapq.heappush(ready, (due, name, release))
        out.append(heapq.heappop(ready)[1])
    return out


def schedule(parts: Mapping[str, int], sources: list[str | None], default: int) -> list[tuple]:
    """(source, slots of the source in a period, its slots, blocks of it before each slot, period)."""
    named = {("n" if s is None else f"s{s}"): (s, int(parts.get(s, default))) for s in sources}
    if any(n < 1 for _, n in named.values()):
        raise ValueError("weights are positive whole parts")
    order = pfair_period({k: n for k, (_, n) in named.items()})
    return [(s, n, [t for t, k in enumerate(order) if k == key], [order[:t].count(key) for t in range(len(order))], len(order)) for key, (s, n) in named.items()]


def mix(docs: DataFrame, parts: Mapping[str, int], default: int = 1, block: int = 64, rows_per_bucket: int = ROWS_PER_BUCKET, names: tuple[str, str, str] = ("block", "slot", "position")) -> DataFrame:
    """Add block, slot and position (from 0, gapless) to every row of ``docs``, under ``names``.

    ``parts`` holds whole weights by source; ``default`` is that of others, a null source included.
    The number of sources is small by nature; their names and row counts are gathered, no rows.
    Within a source, rows go by the md5 of doc_id, then by doc_id; null ids come last. Repeated rows
    keep their own places. Columns named like the three new ones are replaced; others pass through.
    """
    spark = docs.sparkSession
    docs = docs.drop(*names)
    counts = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return docs.select("*", *(F.lit(0).cast("long").alias(c) for c in names))
    bits = max(0, min(28, (max(counts.values()) // rows_per_bucket).bit_length()))
    plan = schedule(parts, sorted(counts, key=lambda s: (s is not None, s or "")), default)
    period = plan[0][-1]
    sources = spark.createDataFrame([(s, n, slots) for s, n, slots, _, _ in plan], "__s string, __n int, __slots array<int>")

    key = F.md5(F.col("doc_id").cast("string"))
    rows = docs.withColumn("__key", key).withColumn("__bucket", F.coalesce(F.conv(F.substring("__key", 1, 7), 16, 10).cast("long") / F.lit(1 << (28 - bits)), F.lit(1 << bits)).cast("long"))
    sizes = rows.groupBy(F.col("source").alias("__s"), F.col("__bucket").alias("__b")).agg(F.count("*").alias("__size"))
    ahead = sizes.select("__s", "__b", F.coalesce(F.sum("__size").over(Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))
    within = F.row_number().over(Window.partitionBy("source", "__bucket").orderBy(F.col("__key").asc_nulls_last(), "doc_id")) - 1
    ranked = rows.withColumn("__within", within).join(ahead, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b"))).withColumn("__rank", F.col("__within") + F.col("__ahead")).drop("__s")
    placed = ranked.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("__s")))  # one row per source
    placed = placed.withColumn("__block", F.floor(F.col("__rank") / block).cast("long"))
    turn, step = F.floor(F.col("__block") / F.col("__n")), F.col("__block") % F.col("__n")
    placed = placed.withColumn("__slot", (turn * period + F.element_at("__slots", (step + 1).cast("int"))).cast("long"))
    # Rows before this slot: whole blocks of each source, its last block being shorter.
    before = F.lit(0).cast("long")
    for s, n, _, seen, _ in plan:
        had = F.floor(F.col("__slot") / period) * n + F.element_at(F.array(*map(F.lit, seen)), (F.col("__slot") % period + 1).cast("int"))
        before = before + F.least(had * block, F.lit(counts[s])).cast("long")
    position = (before + F.col("__rank") % block).cast("long")
    return placed.select(*docs.columns, F.col("__block").alias(names[0]), F.col("__slot").alias(names[1]), position.alias(names[2]))
