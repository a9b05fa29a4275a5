"""Byte-wise substring dedup by longest-previous-factor arrays.

Regions that may repeat are found by anchors over the whole corpus and gathered by anchor (see
``repeats``); a task lays the regions of its anchors one after another, in the order of the corpus,
and sorts the suffixes that start a window. In suffix order, the nearest neighbours of smaller
position are the best earlier matches of a suffix: the longer of the two matches is its longest
previous factor. A window goes as a later copy if its previous factor is a full window long. If no copy
is to stay, the earlier matches of such a window go as well.

Regions that are equal throughout are one region with its copies. For each copy, the region before it
is a previous factor as long as itself, so the copies go whole, and with them the region if none is to
stay; only regions that are alone at their anchor aren't compared further. All others are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.anchors import Ranges, bytes_units
from corvane.llm.repeats import NULL_ID, Kind, Units, covered, documents, judged, occurrences, regions_of, stretches, with_spans

WINDOW, GRAM, SEED = 200, 32, 2
KEEP_FIRST, KEEP_NONE = "first", "none"


def previous_smaller(x: np.ndarray) -> np.ndarray:
    """For each place, the nearest place before it with a smaller value, or -1."""
    p = np.arange(-1, len(x) - 1)
    bad = np.arange(len(x))
    while len(bad):
        q = p[bad]
        more = (q >= 0) & (x[np.maximum(q, 0)] > x[bad])
        bad = bad[more]
        p[bad] = p[q[more]]
    return p


class Suffixes:
    """The suffixes of a text that start at ``at`` (ascending; all, if not given), sorted as far as ``depth``, equal ones by position.

    Suffixes are numbered by position. Those at ``at`` are at least as long as the depth; if all are
    taken, the units are above zero, and beyond the end counts as smallest.
    """

    def __init__(self, data: np.ndarray, depth: int, at: np.ndarray | None = None):
        self.depth, self.data, self.at = depth, data, at
        if at is None:
            self.data, self.at = np.concatenate([data, np.zeros(depth, data.dtype)]), np.arange(len(data))
        text = self._of(self.at).view(f"S{depth * data.itemsize}").ravel()  # compared as bytes, all of them
        self.order = np.argsort(text, kind="stable")
        text = text[self.order]
        self.rank = np.empty(len(text), np.int64)
        self.rank[self.order] = np.cumsum(np.concatenate([[1], text[1:] != text[:-1]])) if len(text) else 0

    def _of(self, at: np.ndarray) -> np.ndarray:
        """The units from each position as far as the depth."""
        if not len(at):
            return np.empty((0, self.depth), self.data.dtype)
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.data, self.depth)[at])

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix, its nearest neighbours of smaller position before and after it in suffix order, or -1."""
        order, n = self.order, len(self.order)
        before, after = previous_smaller(order), n - 1 - previous_smaller(order[::-1])[::-1]
        out = np.full((2, n), -1, np.int64)
        for row, at in zip(out, (before, after), strict=True):
            some = (at >= 0) & (at < n)
            row[order[some]] = order[at[some]]
        return out[0], out[1]

    def longest_previous_factor(self) -> np.ndarray:
        """Per suffix, the longest match that starts earlier, up to the depth."""
        factor = np.zeros(len(self.order), np.int64)
        for at in self.neighbours():
            some = np.flatnonzero(at >= 0)
            same = self._of(self.at[some]) == self._of(self.at[at[some]])
            factor[some] = np.maximum(factor[some], np.where(same.all(axis=1), self.depth, same.argmin(axis=1)))
        return factor

    def copies(self, keep: str) -> np.ndarray:
        """Suffixes whose longest previous factor is as long as the depth; if no copy is kept, their earlier matches as well.

        A match is as long as the depth just where the ranks agree. Of suffixes that agree, each but the
        first has the one before it as previous smaller position, so the first is someone's match.
        """
        hit = np.zeros(len(self.order), bool)
        for at in self.neighbours():
            some = np.flatnonzero(at >= 0)
            some = some[self.rank[some] == self.rank[at[some]]]
            hit[some] = True
            if keep == KEEP_NONE:
                hit[at[some]] = True
        return hit


def judge_regions(regions: list[bytes], copied: np.ndarray, window: int, keep: str) -> tuple[np.ndarray, np.ndarray]:
    """Which windows go of each region, and where each region's windows begin. Regions come in the order of the corpus.

    Only windows whose hash others share are sorted; whether they are equal the sorting tells. A region
    that is ``copied`` is its copies' previous factor throughout, so without keeping any copy it goes.
    """
    sizes = np.fromiter(map(len, regions), np.int64, len(regions))
    data = np.frombuffer(b"".join(regions), np.uint8)
    n = sizes - window + 1
    begin = np.concatenate([[0], np.cumsum(n)])
    own = np.repeat(np.arange(len(n)), n)
    starts = np.arange(len(own)) - begin[own] + (np.cumsum(sizes) - sizes)[own]
    hashes = Ranges(bytes_units(data)).hash(starts, starts + window)
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    several = np.zeros(len(own), bool)
    several[order[1:]] = same
    several[order[:-1]] |= same
    del hashes, order, same
    several = np.flatnonzero(several)
    hit = copied[own] if keep == KEEP_NONE else np.zeros(len(own), bool)
    hit[several] |= Suffixes(data, window, starts[several]).copies(keep)
    return hit, begin


def _judge(window: int, keep: str):
    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        gone = stretches(*judge_regions(pdf["region"].tolist(), pdf["copied"].to_numpy(bool), window, keep))
        some = [i for i, x in enumerate(gone) if x]
        return pd.DataFrame({**{c: pdf[c].to_numpy()[some] for c in ("doc", "version", "first")}, "gone": [gone[i] for i in some]})

    return judge


def _split(texts: list[bytes]) -> Units:
    stream = b"".join(texts)
    return Units(bytes_units(stream), np.fromiter(map(len, texts), np.int64, len(texts)), stream)


def marked(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep: str = KEEP_FIRST) -> tuple[DataFrame, DataFrame]:
    """The dealt documents, and for each run with windows that go: doc, version, first, and those windows (``gone``)."""
    kind = Kind(_split, window, gram, SEED)
    texts, found = occurrences(docs, kind)
    leads = found.filter("lead and several")
    sorted_ = judged(regions_of(texts, leads, kind), leads.count(), _judge(window, keep), "doc long, version long, first long, gone array<int>")
    settled = found.filter("not lead" if keep == KEEP_FIRST else "not lead or (copied and not several)")
    whole = F.array(F.lit(0), (F.col("last") - F.col("first")).cast("int")).alias("gone")
    return texts, sorted_.unionByName(settled.select("doc", "version", "first", whole))


def dedup(docs: DataFrame, window: int = WINDOW, keep: str = KEEP_FIRST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes) of every row.

    Removed is each byte covered by a ``window``-byte string that also starts earlier (``keep`` first:
    a smaller doc_id, or before in the same document) or anywhere else (``keep`` none). Matches never
    cross documents; strings are judged on the input. Null text is empty. Rows of one id and text are
    one document and fare alike; texts of one id come in the order of their hashes; a null id sorts
    first and stays null. Texts shorter than a window lose nothing. An empty table gives no rows;
    further columns are ignored.
    """
    texts, spans = marked(documents(docs), window, keep=keep)
    joined = with_spans(texts, spans, "left").select("doc", "version", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                kept, removed, runs = text, 0, 0
                if found:
                    gone = covered(len(text), found, window)
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    removed, runs = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((len(text), removed, runs, hashlib.sha256(kept).hexdigest(), kept))
            n, removed, runs, digest, kept = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = joined.mapInArrow(run, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.select(F.when(F.col("doc") != F.lit(NULL_ID), F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
