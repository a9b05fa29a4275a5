"""Feature extraction over audio rows: a pluggable model per Python worker, errors kept as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = "track_uid string, mert_perc array<float>, mert_full array<float>, bpm double, bpm_confidence double, beat_confidence double, key string, key_confidence double, error string"


class Extractor(Protocol):
    def __call__(self, samples: np.ndarray) -> dict: ...


class SpectralStub:
    """A stand-in without model weights: band energies of the spectrum. Deterministic, unit length."""

    def __init__(self, size: int = 64):
        self.size = size

    def _bands(self, x: np.ndarray) -> np.ndarray:
        power = np.abs(np.fft.rfft(x)) ** 2 if len(x) else np.zeros(1)
        bands = np.array([b.sum() for b in np.array_split(power, self.size)])
        return (np.log1p(bands) / max(1e-12, np.linalg.norm(np.log1p(bands)))).astype(np.float32)

    def __call__(self, samples: np.ndarray) -> dict:
        rough = np.diff(samples, prepend=0.0) if len(samples) else samples
        return {"mert_perc": self._bands(rough), "mert_full": self._bands(samples), "bpm": 128.0, "bpm_confidence": 0.0, "beat_confidence": 0.0, "key": "?", "key_confidence": 0.0}


def extract(audio: DataFrame, make: Callable[[], Extractor]) -> DataFrame:
    """Features of rows (track_uid, samples). ``make`` runs once per partition's worker; a row that fails carries its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        columns = [c.split(" ")[0] for c in FEATURES.split(", ")]
        blank = dict.fromkeys(columns)
        for pdf in frames:
            out = []
            for uid, samples in zip(pdf["track_uid"], pdf["samples"], strict=True):
                try:
                    out.append(blank | {"track_uid": uid, **model(np.asarray(samples, dtype=np.float32))})
                except Exception as e:  # a bad track must not end the job; it is reported in its row
                    out.append(blank | {"track_uid": uid, "error": str(e) or type(e).__name__})
            yield pd.DataFrame(out, columns=columns)

    return audio.select("track_uid", "samples").mapInPandas(run, FEATURES)


def split_errors(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows without the error column, and the rows to look into."""
    return features.filter("error is null").drop("error"), features.filter("error is not null").select("track_uid", "error")


def pooled(segments: DataFrame, method: str = "mean") -> DataFrame:
    """track_uid and vector over segment rows (track_uid, vector): the mean, or mean and deviation side by side."""
    cells = segments.select("track_uid", F.posexplode("vector").alias("dim", "x")).groupBy("track_uid", "dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))

    def column(c: str):
        return F.transform(F.sort_array(F.collect_list(F.struct("dim", c))), lambda v: v[c])

    if method == "mean":
        vector = column("m")
    elif method == "mean_std":
        vector = F.concat(column("m"), column("s"))
    else:
        raise ValueError(f"unknown method {method!r}")
    return cells.groupBy("track_uid").agg(vector.alias("vector"))
