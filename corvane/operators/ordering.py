"""Greedy ordering of a cluster's members: each next one fits the last best by vector, tempo and key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import keys

WEIGHTS = {"embedding": 0.5, "bpm": 0.3, "key": 0.2}
DEFAULT_BPM, DEFAULT_KEY = 128.0, "?"
#: A group must fit one task, as the greedy walk needs all its members at every step.
MAX_GROUP = 100_000


def hours(camelot: pd.Series) -> np.ndarray:
    """The hour of each key, 0 where unknown."""
    return pd.to_numeric(camelot.str.extract(r"^(\d+).$")[0], errors="coerce").fillna(0).to_numpy(dtype=np.int64)


def key_scores(hour: np.ndarray, at: int) -> np.ndarray:
    gap = np.abs(hour - hour[at])
    gap = np.minimum(gap, 12 - gap)
    known = np.where(gap == 0, 1.0, np.where(gap == 1, 0.5, 0.0))
    return np.where((hour == 0) | (hour[at] == 0), 0.5, known)


def greedy(vectors: np.ndarray, bpm: np.ndarray, hour: np.ndarray, weights: dict[str, float]) -> list[int]:
    """Start at the lowest tempo; then always the best-scoring member left, the first one on ties."""
    n = len(bpm)
    if not (np.isfinite(vectors).all() and np.isfinite(bpm).all()):
        raise ValueError("ordering needs finite vectors and tempos")
    if not n:
        return []
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(length == 0, 1.0, length)
    spread = float(np.ptp(bpm)) or 1.0
    left = np.ones(n, bool)
    path = [int(bpm.argmin())]
    for _ in range(n - 1):
        at = path[-1]
        left[at] = False
        score = weights["embedding"] * (unit @ unit[at] + 1) / 2 + weights["bpm"] * np.maximum(0.0, 1 - np.abs(bpm - bpm[at]) / spread) + weights["key"] * key_scores(hour, at)
        path.append(int(np.where(left, score, -np.inf).argmax()))
    return path


def order_clusters(rows: DataFrame, group: list[str], key: str, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Add ``position`` (from 0) within each group of rows (key, vector, bpm, camelot); groups run in parallel.

    Members are numbered by ``key``, which settles ties. Missing tempo and key take the defaults.
    """
    filled = rows.select(*group, key, "vector", F.coalesce("bpm", F.lit(DEFAULT_BPM)).alias("bpm"), F.coalesce("camelot", F.lit(DEFAULT_KEY)).alias("camelot"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MAX_GROUP:
            raise ValueError(f"a group of {len(pdf)} members is over {MAX_GROUP}; divide it first")
        pdf = pdf.sort_values(key).reset_index(drop=True)
        path = greedy(np.stack([np.asarray(v, dtype=np.float64) for v in pdf["vector"]]), pdf["bpm"].to_numpy(dtype=np.float64), hours(pdf["camelot"]), weights)
        out = pdf.loc[path, [*group, key]]
        return out.assign(position=np.arange(len(out), dtype=np.int32))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in filled.schema.fields if f.name in (*group, key))
    kinds = ", ".join(sorted(kinds.split(", "), key=lambda x: [*group, key].index(x.split(" ")[0])))
    return filled.groupBy(*group).applyInPandas(walk, kinds + ", position int")


def with_camelot(rows: DataFrame) -> DataFrame:
    return rows.withColumn("camelot", keys.camelot("key"))
