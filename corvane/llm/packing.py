"""Best-fit packing by the sum-of-squares rule.

Documents become token ids with an end id; a document longer than a sequence is cut into pieces
of the full length, its first piece taking the remainder. A piece that fills a sequence is one.
All others are dealt at random over packers of a bounded number of pieces. A packer keeps, per
residual gap g, the number N(g) of its open sequences with that gap, and places each piece,
longest first, where the sum of N(g)^2 becomes smallest. Pieces of sequences that weren't filled
are placed anew while that saves sequences.

Every packer leaves at most a few sequences open, so the number of sequences stays within a
small fraction of the least possible at any input size, and packers need no shared state.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import tokens
from corvane.llm.common import bounded_batches, materialize, spread

#: Pieces dealt to one packer, on average; bounds a packer's memory.
PIECES_PER_PACKER = 50_000
#: Documents of one stretch, where packing keeps to their order: many periods of a schedule, few sequences unfilled.
STRETCH = 4_096

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Place pieces in the order given; returns each piece's bin and its offset there.

    Of equally good places, the fullest open bin wins, then a new bin. Bins with the same gap are
    interchangeable; the latest opened or changed one is taken.
    """
    open_ = np.zeros(capacity + 1, dtype=np.int64)  # N(g); a bin with gap 0 is closed and doesn't count
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        left = open_[: capacity + 1 - size]  # gaps after placing: 0 .. capacity - size
        # sum changes by 2 N(g - size) + 1 (nothing where the bin closes) and by 1 - 2 N(g)
        change = 2 * (left - open_[size:]) + 2
        change[0] = 1 - 2 * open_[size]
        change[open_[size:] == 0] = np.iinfo(np.int64).max
        fresh = 2 * open_[capacity - size] + 1 if size < capacity else 0
        at = int(change.argmin())
        if change[at] <= fresh:
            gap = at + size
            b = stacks[gap].pop()
            open_[gap] -= 1
        else:
            gap, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > size:
            open_[gap - size] += 1
            stacks[gap - size].append(b)
    return bins, offsets


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece: sum-of-squares passes, longest piece first.

    Filled bins stay; the pieces of all others are placed anew, until a pass saves no bin.
    """
    bins, offsets = np.full(len(lengths), -1, np.int64), np.zeros(len(lengths), np.int64)
    rest, closed, best = np.argsort(-lengths, kind="stable"), 0, None
    while len(rest):
        b, o = sum_of_squares(lengths[rest], capacity)
        made = int(b.max()) + 1
        if best is not None and closed + made >= best:
            break
        best = closed + made
        full = np.bincount(b, lengths[rest], made) >= capacity
        number = np.where(full, closed + np.cumsum(full) - 1, closed + full.sum() + np.cumsum(~full) - 1)
        bins[rest], offsets[rest] = number[b], o
        closed += int(full.sum())
        rest = rest[~full[b]]
    return bins, offsets


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of a document of ``n`` ids."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, position: str | None = None) -> DataFrame:
    """One row per piece of each document; null text counts as empty, a repeated row as its own document.

    With ``position``, that column follows as ``position``.
    """
    bounded_batches(docs.sparkSession)
    more = ["position"] if position else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for row, (doc, ids) in enumerate(zip(batch.column(0).to_pylist(), tokens.encode(tokenizer, batch.column(1)), strict=True)):
                for k, (at, n) in enumerate(cut(len(ids), capacity)):
                    for col, v in zip(out, (doc, k, at, n, zlib.crc32(ids[at : at + n]), row), strict=True):
                        col.append(v)
            kept = [c.take(pa.array(out[5], pa.int64())) for c in batch.columns[2:]]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(out[:5], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)), *kept], ["doc_id", "piece", "start", "length", "ids_crc32", *more])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.col(position).cast("long").alias("position")] if position else []))
    return spread(slim, "doc_id").mapInArrow(run, _PIECES + ", position long" * bool(position))


def pack(pieces: DataFrame, capacity: int, per_packer: int = PIECES_PER_PACKER) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``."""
    rows = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    part = F.col("length") < capacity
    n = rows.filter(part).count()
    packers = max(1, -(-n // per_packer))
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name in names)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row")
        bins, offsets = pack_lengths(pdf["length"].to_numpy(), capacity)
        return pdf[names].assign(sequence_id=bins + (int(key[0]) << 40), offset=offsets)

    packed = rows.filter(part).withColumn("_packer", F.pmod(F.xxhash64("_row"), F.lit(packers))).groupBy("_packer").applyInPandas(one, f"{schema}, sequence_id long, offset long")
    full = rows.filter(~part).select(*names, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def pack_in_order(pieces: DataFrame, capacity: int, stretch: int = STRETCH) -> DataFrame:
    """Like ``pack``, for pieces with a ``position``: sequences hold pieces of one stretch of positions, and their ids ascend with the stretches."""
    names = [c for c in pieces.columns if c not in ("position", "sequence_id", "offset")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name in names)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["position", "piece"])
        length, number, offset = pdf["length"].to_numpy(), np.arange(len(pdf)), np.zeros(len(pdf), np.int64)
        part = np.flatnonzero(length < capacity)
        bins, offset[part] = pack_lengths(length[part], capacity)
        first = np.full(int(bins.max(initial=-1)) + 1, len(pdf))
        np.minimum.at(first, bins, part)
        number[part] = first[bins]  # a sequence goes by the first of its pieces
        return pdf[names].assign(sequence_id=(int(key[0]) << 32) + number, offset=offset)

    rows = pieces.withColumn("_stretch", F.floor(F.col("position") / stretch).cast("long"))
    return rows.groupBy("_stretch").applyInPandas(one, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = 1024, position: str | None = None) -> DataFrame:
    """Pack documents (``doc_id``, ``text``) into sequences of at most ``capacity`` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null or
    empty text is the end id alone; a null doc_id stays null; an empty table gives no rows; further
    columns of ``docs`` are ignored. With ``position``, a column of gapless places, sequences follow
    that order, stretch by stretch.
    """
    tokenizer = tokenizer or tokens.default_tokenizer()
    if position:
        return pack_in_order(token_pieces(docs, tokenizer, capacity, position), capacity)
    return pack(token_pieces(docs, tokenizer, capacity), capacity)
