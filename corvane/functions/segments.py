"""Where segments of a recording start, as integer arithmetic over its length in samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clamp(starts: list[Column], total: Column) -> Column:
    return F.array(*(F.greatest(F.lit(0).cast("long"), F.least(s.cast("long"), total - 1)) for s in starts))


def zone_starts(total: Column, sample_rate: int, seconds: float = 5.0, counts: tuple[int, int, int] = (1, 2, 1), zones=((0.0, 0.15), (0.35, 0.65), (0.85, 1.0))) -> Column:
    """Starts within the first, middle and last zone: one is centred, several are spread."""
    seg = int(seconds * sample_rate)
    out = []
    for (lo, hi), n in zip(zones, counts, strict=True):
        begin, end = F.floor(lo * total), F.floor(hi * total)
        room = end - begin
        if n == 1:
            out.append(begin + F.floor(room / 2) - seg // 2)
        else:
            step = F.floor((room - seg) / max(1, n - 1))
            out += [begin + i * step for i in range(n)]
    return _clamp(out, total)


def bar_samples(ticks: Column) -> Column:
    """Samples of a bar of four beats: by the median gap between ticks."""
    gaps = F.array_sort(F.zip_with(F.slice(ticks, 2, F.greatest(F.size(ticks) - 1, F.lit(1))), F.slice(ticks, 1, F.greatest(F.size(ticks) - 1, F.lit(1))), lambda b, a: b - a))
    n = F.size(gaps)
    median = (F.element_at(gaps, (F.floor((n - 1) / 2) + 1).cast("int")) + F.element_at(gaps, (F.floor(n / 2) + 1).cast("int"))) / 2
    return (4 * F.floor(median)).cast("long")


def bar_starts(total: Column, bar: Column, counts: tuple[int, int, int] = (1, 2, 1)) -> Column:
    """Starts at whole bars: the first ones, those around the middle, the last ones."""
    intro, mid, outro = counts
    bars = F.floor(total / bar)
    out = [i * bar for i in range(intro)]
    out += [F.greatest(F.lit(0), (F.floor(bars / 2) - mid // 2 + i) * bar) for i in range(mid)]
    out += [F.greatest(F.lit(0), (bars - (outro - i)) * bar) for i in range(outro)]
    return _clamp(out, total)


def beat_mode(ticks: Column, bpm: Column, confidence: Column, threshold: float = 0.5) -> Column:
    """Whether beats are good enough: 32 ticks, a tempo, and confidence unknown or high."""
    return (F.size(ticks) >= 32) & bpm.isNotNull() & (confidence.isNull() | (confidence >= threshold))


def spread_starts(total: Column, sample_rate: int, seconds: float = 5.0, padding: float = 45.0, most: int = 8) -> Column:
    """Evenly spread starts between both paddings; one centred start where that room is too short."""
    pad, seg = int(padding * sample_rate), int(seconds * sample_rate)
    room = total - 2 * pad
    n = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(room / seg))).cast("int")
    last = total - pad - seg
    step = (last - pad) / F.greatest(n - 1, F.lit(1))
    spread = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i == n - 1, F.when(n == 1, F.lit(pad)).otherwise(last)).otherwise(F.floor(pad + i * step)).cast("long"))
    centre = F.array(F.greatest(F.lit(0), F.floor(total / 2) - seg // 2).cast("long"))
    return F.when(room < seg, centre).otherwise(spread)
