"""Colours of clusters and of their subclusters, as Columns over "#rrggbb" text."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The colour of each first-level cluster.
BASE = {"Noise": "#808080", "A": "#ab63fa", "B": "#FFA15A", "C": "#EF553B", "D": "#FF6692", "E": "#19d3f3", "F": "#FF97FF", "G": "#ab63fa", "H": "#EF553B", "I": "#636efa", "J": "#00cc96", "K": "#19d3f3", "L": "#FECB52", "M": "#FFA15A", "N": "#00cc96", "O": "#FF6692", "P": "#B6E880"}
OTHER = "#888888"
HUE_STEP, LIGHT_STEP, DARKEST, LIGHTEST = 0.05, 0.08, 0.2, 0.8


def _mod1(x: Column) -> Column:
    return x - F.floor(x)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def hex_to_hsl(colour: Column) -> Column:
    """A struct of hue, saturation and light, each from 0 to 1."""
    raw = F.ltrim(colour, F.lit("#"))
    rgb = F.struct(*((F.conv(F.substring(raw, i, 2), 16, 10).cast("double") / 255.0).alias(n) for i, n in ((1, "r"), (3, "g"), (5, "b"))))

    def ends(c: Column) -> Column:
        r, g, b = c["r"], c["g"], c["b"]
        return F.struct(r.alias("r"), g.alias("g"), b.alias("b"), F.greatest(r, g, b).alias("high"), F.least(r, g, b).alias("low"))

    def hsl(c: Column) -> Column:
        high, low = c["high"], c["low"]
        gap, light = high - low, (high + low) / 2.0
        saturation = F.when(gap == 0, 0.0).when(light <= 0.5, gap / (high + low)).otherwise(gap / (2.0 - high - low))
        rc, gc, bc = ((high - c[n]) / F.nullif(gap, F.lit(0.0)) for n in "rgb")
        turn = F.when(gap == 0, 0.0).when(c["r"] == high, (bc - gc) / 6.0).when(c["g"] == high, (2.0 + rc - bc) / 6.0).otherwise((4.0 + gc - rc) / 6.0)
        return F.struct(turn.alias("turn"), saturation.alias("saturation"), light.alias("light"))

    return _let(_let(_let(rgb, ends), hsl), lambda c: F.struct(_mod1(c["turn"]).alias("hue"), c["saturation"].alias("saturation"), c["light"].alias("light")))


def hsl_to_hex(colour: Column) -> Column:
    """Takes a struct of hue, saturation and light."""

    def ends(c: Column) -> Column:
        light, saturation = c["light"], c["saturation"]
        top = F.when(light <= 0.5, light * (1.0 + saturation)).otherwise(light + saturation - light * saturation)
        return F.struct(top.alias("top"), (2.0 * light - top).alias("base"), *(c[n].alias(n) for n in ("hue", "saturation", "light")))

    def channel(c: Column, shift: float) -> Column:
        top, base = c["top"], c["base"]

        def value(h: Column) -> Column:
            x = F.when(h < 1 / 6, base + (top - base) * h * 6.0).when(h < 0.5, top).when(h < 2 / 3, base + (top - base) * (2 / 3 - h) * 6.0).otherwise(base)
            return F.floor(F.when(c["saturation"] == 0, c["light"]).otherwise(x) * 255).cast("long")

        return F.lower(F.lpad(F.hex(_let(_let(c["hue"] + shift, _mod1), value)), 2, "0"))

    return _let(_let(colour, ends), lambda c: F.concat(F.lit("#"), channel(c, 1 / 3), channel(c, 0.0), channel(c, -1 / 3)))


def base_colour(letter: Column) -> Column:
    return F.coalesce(F.create_map(*map(F.lit, chain.from_iterable(BASE.items())))[letter], F.lit(OTHER))


def shaded(base: Column, index: Column, total: Column) -> Column:
    """The colour of a parent's ``index``-th subcluster (from 1): hue moves on, lightness swings."""
    swing = (index - 1) * LIGHT_STEP * F.when(index % 2 == 0, 1).otherwise(-1)

    def moved(c: Column) -> Column:
        light = F.greatest(F.lit(DARKEST), F.least(F.lit(LIGHTEST), c["light"] + swing))
        return F.struct(_mod1(c["hue"] + (index - 1) * HUE_STEP).alias("hue"), c["saturation"].alias("saturation"), light.alias("light"))

    return F.when(total <= 1, base).otherwise(hsl_to_hex(_let(hex_to_hsl(base), moved)))


def palette(rows: DataFrame, l1: str = "cluster_l1", l2: str = "cluster_l2") -> DataFrame:
    """One row per subcluster with its ``colour``; subclusters are numbered by name within their parent."""
    groups = rows.select(l1, l2).distinct()
    index = F.row_number().over(Window.partitionBy(l1).orderBy(l2))
    total = F.count("*").over(Window.partitionBy(l1))
    placed = groups.withColumns({"_index": index, "_total": total, "_base": base_colour(F.col(l1))})
    return placed.select(l1, l2, shaded(F.col("_base"), F.col("_index"), F.col("_total")).alias("colour"))
