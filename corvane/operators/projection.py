"""Projection head for adapting embeddings: two linear layers, applied in Arrow batches; and its training pairs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class ProjectionHead:
    """Linear, rectifier, linear, unit length. Dropout is training only, so it isn't here."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @classmethod
    def random(cls, size: int = 1024, hidden: int = 512, out: int = 256, seed: int = 0) -> ProjectionHead:
        rng = np.random.default_rng(seed)
        a, b = 1 / np.sqrt(size), 1 / np.sqrt(hidden)
        return cls(rng.uniform(-a, a, (size, hidden)), rng.uniform(-a, a, hidden), rng.uniform(-b, b, (hidden, out)), rng.uniform(-b, b, out))

    def forward(self, x: np.ndarray) -> np.ndarray:
        y = np.maximum(0.0, x @ self.w1 + self.b1) @ self.w2 + self.b2
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)

    def apply(self, rows: DataFrame, vector: str = "vector") -> DataFrame:
        """Replace the vector column by its projection."""

        @F.pandas_udf("array<double>")
        def project(v: pd.Series) -> pd.Series:
            return pd.Series(list(self.forward(np.stack([np.asarray(x, dtype=np.float64) for x in v])))) if len(v) else pd.Series([], dtype=object)

        return rows.withColumn(vector, project(vector))


class ContrastiveTrainer:
    """Training isn't offered, as in the source of the semantics; ``contrastive_pairs`` mines its pairs."""

    def __init__(self, head: ProjectionHead):
        self.head = head

    def train_epoch(self, *_: object) -> None:
        raise NotImplementedError("training of the projection head is out of scope")

    def evaluate(self, *_: object) -> None:
        raise NotImplementedError("training of the projection head is out of scope")


def contrastive_pairs(rows: DataFrame, negatives: int = 1) -> DataFrame:
    """anchor, other, kind: consecutive members of a subcluster are positive; each anchor meets members of the next cluster at its own place as negative.

    Pairs grow with the rows: no group is joined with itself in full.
    """
    from pyspark.sql.window import Window

    real = rows.filter("label_l1 <> -1 and label_l2 <> -1")
    next_one = F.lead("id").over(Window.partitionBy("label_l1", "label_l2").orderBy("id"))
    positive = real.select(F.col("id").alias("anchor"), next_one.alias("other"), F.lit("positive").alias("kind")).filter("other is not null")
    placed = real.withColumn("place", F.row_number().over(Window.partitionBy("label_l1").orderBy("id")))
    out = positive
    for step in range(1, negatives + 1):
        other = placed.select(F.col("id").alias("other"), (F.col("label_l1") - step).alias("label_l1"), "place")
        out = out.unionByName(placed.join(other, ["label_l1", "place"]).select(F.col("id").alias("anchor"), "other", F.lit("negative").alias("kind")))
    return out
