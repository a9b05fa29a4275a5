"""Document quality by supervised subword embeddings.

A text is the mean of learned vectors of its hashed features: its words, the character n-grams of
its words with their boundaries, and a mark for every word that repeats the one before it. A
softmax layer over that mean gives the score. Vectors and layer are trained by stochastic gradient
descent in numpy, on a bounded sample of labelled rows.

Scoring needs only one number per hashed feature, its vector's product with the layer, so a worker
holds a small table and adds up its entries over whole texts.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import bounded_batches, spread

#: Most labelled rows that are learned from; texts of the sample go to the driver.
SAMPLE_ROWS = 3_000
#: Hashed features.
BUCKETS = 1 << 17
DIMENSIONS = 16
EPOCHS = 6
RATE = 1.0
NGRAMS = (3, 4, 5)
THRESHOLD = 0.7
#: Bytes featurized at once.
_CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_REPEAT = 0  # the bucket of the mark for a repeated word; shared with whatever else hashes to it
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = h * _ODD
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (place, bucket): the hashed features of all texts and the text's number that each is in.

    Texts over the chunk are taken in several blocks, cut at white space; each block knows the last
    word of the one before, so a text's features don't depend on where it is cut.
    """
    block: list[tuple[int, bytes]] = []
    size, last = 0, (-1, 0)
    for k, text in enumerate(texts):
        for piece in _cut(text):
            if size + len(piece) > _CHUNK and block:
                last = yield from _block(block, last)
                block, size = [], 0
            block.append((k, piece))
            size += len(piece) + 1
    if block:
        yield from _block(block, last)


def _cut(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > _CHUNK:
        to = max(text.rfind(c, at, at + _CHUNK) for c in (b" ", b"\n", b"\t", b"\r"))
        if to <= at:  # a word longer than the chunk stays whole
            to = min((i for i in (text.find(c, at + _CHUNK) for c in (b" ", b"\n", b"\t", b"\r")) if i >= 0), default=len(text))
        yield text[at:to]
        at = to
    yield text[at:]


def _block(block: list[tuple[int, bytes]], last: tuple[int, int]) -> Generator[tuple[np.ndarray, np.ndarray], None, tuple[int, int]]:
    """Yields the features of one block; takes and returns the last word so far, as its text's number and its hash."""
    a = np.frombuffer(b"\n" + b"\n".join(t for _, t in block) + b"\n", np.uint8)
    doc = np.repeat([k for k, _ in block], [len(t) + 1 for _, t in block])
    doc = np.concatenate([doc[:1], doc])  # of each byte; the leading boundary goes with the first text
    space = _SPACE[a]
    x = np.where(space, np.uint64(0), a.astype(np.uint64))
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if not len(starts):
        return last
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    at = np.arange(len(a)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(a)]])))
    power = np.cumprod(np.full(int((ends - starts).max()) + 1, 0x100000001B3, np.uint64))
    coded = np.where(space, np.uint64(0), (x + np.uint64(0x51ED)) * power[np.minimum(at, len(power) - 1)])
    word = np.add.reduceat(coded, starts) + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    own = doc[starts]
    yield own, _bucket(word)
    again = np.flatnonzero((word == np.append(np.uint64(last[1]), word[:-1])) & (own == np.append(last[0], own[:-1])))
    yield own[again], np.full(len(again), _REPEAT)
    inner = ~space
    gram = x[:-1] << np.uint64(8) | x[1:]
    clear = np.ones(len(a) - 1, bool)  # whether the bytes strictly inside hold no boundary
    for n in range(3, max(NGRAMS) + 1):
        gram = gram[:-1] << np.uint64(8) | x[n - 1 :]
        clear = clear[:-1] & inner[n - 2 : len(a) - 1]
        if n in NGRAMS:
            here = np.flatnonzero(clear)
            yield doc[here + 1], _bucket(gram[here] + np.uint64(n << 56))
    return int(own[-1]), int(word[-1])


@dataclass
class Model:
    table: np.ndarray  # per bucket, how far it moves the log odds of label 1
    bias: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        for place, bucket in features(texts):
            total += np.bincount(place, self.table[bucket], len(texts))
            n += np.bincount(place, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(self.bias + total / np.maximum(n, 1), -60, 60)))


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Model:
    """Fit on texts labelled 0 or 1; the same input gives the same model."""
    rng = np.random.default_rng(seed)
    bags = []
    for at in range(0, len(texts), 16):  # few at once: features take far more memory than their texts
        some = texts[at : at + 16]
        pairs = [np.empty(0, np.int64), *(place * BUCKETS + bucket for place, bucket in features(some))]
        pair, n = np.unique(np.concatenate(pairs), return_counts=True)
        cuts = np.searchsorted(pair, np.arange(len(some) + 1) * BUCKETS)
        bags += [((pair[a:b] % BUCKETS).astype(np.int32), (n[a:b] / max(1, n[a:b].sum())).astype(np.float32)) for a, b in zip(cuts, cuts[1:], strict=False)]
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer, bias = rng.uniform(-0.5, 0.5, (2, DIMENSIONS)).astype(np.float32), np.zeros(2, np.float32)
    step, steps = 0, EPOCHS * len(bags)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            rate = RATE * (1 - step / steps)
            step += 1
            idx, weight = bags[i]
            mean = weight @ vectors[idx]
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(labels[i])] -= 1  # the gradient by z
            down = layer.T @ p
            layer -= rate * np.outer(p, mean)
            bias -= 0.1 * rate * p
            # a feature's share of the mean is small; scaled so that the mean moves by rate * gradient
            vectors[idx] -= np.outer(weight * (rate / max(1e-9, float(weight @ weight))), down)
    gap = (layer[1] - layer[0]).astype(np.float64)
    return Model(vectors.astype(np.float64) @ gap, float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most ``rows`` labelled documents, chosen by a hash of their ids.

    Labels other than 0 and 1, contradictory ones and held-out rows are passed over. Without any
    label the model is neutral: every score is one half.
    """
    clear = labels.select("doc_id", "quality").filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    clear = clear.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("_most")).filter("label = _most").drop("_most")
    chosen = clear.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most ``rows`` rows of ids are broadcast
    sample = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows).collect()
    if not sample:
        return Model(np.zeros(BUCKETS), 0.0)
    return train([bytes(r["text"] or b"") for r in sample], np.array([r["label"] for r in sample]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; null text counts as empty, repeated rows keep their own rows."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(model.score([x or b"" for x in batch.column(2).to_pylist()]))], ["doc_id", "held_out", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text"))
    out = spread(slim, "doc_id").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Learn from ``labels`` (doc_id, quality) and score every document (doc_id, text).

    One row per row of ``docs``, repeated and null ids included; other columns are ignored. Null and
    empty texts have no features and get the model's bias. Long texts are scored whole, in blocks.
    An empty table gives no rows; without usable labels every score is one half.
    """
    return score(docs, learn(docs, labels), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, all columns as they are.

    Rows are judged one by one as by ``classify``: repeated rows stay or go together, null and empty
    texts by the model's bias, long texts whole; an empty table stays empty.
    """
    model = learn(docs, labels)
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score([x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]) >= threshold))

    return docs.mapInArrow(run, docs.schema)
