"""Repeated windows of a corpus: the stages that byte-wise and word-wise substring dedup share.

1. ``runs_of``: each text's runs of windows with one anchor (see ``anchors``), and for each the SHA-256
   of the region that its windows cover. Equal regions that one batch of texts holds many times are
   counted there: the first stands for all (``n``), the others are ``later``.
2. ``recurring``: runs, without the later ones, grouped by anchor; an anchor of one run has no
   repetition. Of equal regions the first is the ``lead``.
3. ``divided``: an anchor of very many different regions is divided by what is next to it. Windows at
   like distances from their anchor share the units around it; windows that differ there can't be
   equal. So the runs are cut by distance, and a part's anchor is the hash of the units that all its
   windows must share. What is still too much is divided down to single windows.
4. ``regions_of`` and ``judged`` gather the leads' regions by anchor, where an operator's kernel compares
   them unit by unit and judges which windows go.

Hashes gather candidates only; the kernels decide. Regions of one SHA-256 (128 bits of it are kept)
count as equal and are compared once.

So a line that a third of all texts hold, or that fills long texts, reaches the grouping as a few rows
per batch. An anchor that very many runs share is dealt over several tasks by region. Which run is a
later one depends on the batch, so all stages read the runs from one written table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.anchors import runs
from corvane.llm.common import bounded_batches, discard, materialize, splitmix, spread

RUN = "doc long, version long, first long, last long, anchor long, place long, c1 long, c2 long, n long, later boolean"
NULL_ID = -(1 << 63)
#: Equal regions of one batch from which on they are counted there.
COUNTED = 8
#: An anchor of more than one in so many runs is dealt by region, to so many tasks; there are fewer such anchors than that.
HOT_SHARE, HOT_TASKS = 2_000, 64
#: One in so many documents tells which anchors are hot. This deals rows out and changes no result.
HOT_SAMPLE = 16
#: Documents whose ids are broadcast at most, to shuffle only the texts that are divided: 4 MB of ids.
BROADCAST_IDS = 1 << 18
#: Regions gathered in one task's kernel, on average, and those of one anchor from which on it is divided.
REGIONS, DIVIDED = 4_000, 2_000


@dataclass(frozen=True)
class Units:
    """Texts one after another: a hash per unit, the units of each text, and the bytes they are read from."""

    hashes: np.ndarray
    sizes: np.ndarray
    stream: bytes
    begin: np.ndarray | None = None  # of each unit in the stream, and behind the last one; None if a unit is a byte

    def bounds(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the units from lo up to hi stand in the stream; units that aren't bytes have one byte between them."""
        return (lo, hi) if self.begin is None else (self.begin[lo], self.begin[hi] - 1)

    def digests(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """128 bits of the SHA-256 of each range of units, as two columns."""
        view, sha = memoryview(self.stream), hashlib.sha256
        raw = b"".join([sha(view[a:b]).digest() for a, b in zip(*(x.tolist() for x in self.bounds(lo, hi)), strict=True)])
        return np.frombuffer(raw, "<i8").reshape(-1, 4)[:, :2]


@dataclass(frozen=True)
class Kind:
    """How texts are read: their units, the number of units in a window and in a k-gram, and a seed."""

    split: Callable[[list[bytes]], Units]
    window: int
    gram: int
    seed: int

    def divisions(self) -> tuple[int, ...]:
        """Distances from the anchor that parts of a divided run span: the root of all, then one."""
        return max(1, math.isqrt(self.window - self.gram + 1)), 1


def documents(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc (the id; null as the smallest), version, text as bytes, and carried columns with a leading mark.

    Rows of one id and text are one document. Texts of one id are told apart by ``version``, a hash of
    the text; it is 0 where ids are unique, which costs no space. (No literal, and never
    null, so that the optimizer gives all uses of the texts one partitioning and one exchange.)
    """
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    repeated = docs.select(doc.alias("doc")).groupBy("doc").count().filter("count > 1").limit(1)
    version = F.coalesce(F.pmod(doc, F.lit(1).cast("long")) if repeated.isEmpty() else F.xxhash64("text"), F.lit(0))
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    out = docs.select(doc.alias("doc"), version.alias("version"), text.alias("text"), *(F.col(f"`{c}`").alias(f"_{c}") for c in carry))
    bounded_batches(docs.sparkSession)
    return out


def _sources(docs: DataFrame) -> DataFrame:
    slim = docs.select("doc", "version", "text")
    if slim.filter("version <> 0").limit(1).count():
        slim = slim.dropDuplicates(["doc", "version"])
    return spread(slim, "doc", "version")


def _counted(doc: np.ndarray, version: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, place: np.ndarray, digest: np.ndarray, counted: int) -> pa.RecordBatch:
    """The rows of one batch; equal regions that it holds ``counted`` times are counted at the first, the others marked."""
    order = np.lexsort((first, version, doc, digest[:, 1], digest[:, 0], anchor))
    doc, version, first, last, anchor, place, digest = (x[order] for x in (doc, version, first, last, anchor, place, digest))
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (digest[1:] != digest[:-1]).any(axis=1)])) if len(order) else order
    n = np.diff(np.append(new, len(order)))
    count, later = np.ones(len(order), np.int64), np.zeros(len(order), bool)
    many = n >= counted
    count[new[many]] = n[many]
    later[np.repeat(many, n)] = True
    later[new] = False
    return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x)) for x in (doc, version, first, last, anchor, place, digest[:, 0], digest[:, 1], count)), pa.array(later)], ["doc", "version", "first", "last", "anchor", "place", "c1", "c2", "n", "later"])


def runs_of(docs: DataFrame, kind: Kind) -> DataFrame:
    """All runs of all documents, written out: batches, and with them ``later``, may differ when made again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = kind.split([x or b"" for x in batch.column(2).to_pylist()])
            r = runs(units.hashes, units.sizes, kind.window, kind.gram, kind.seed)
            doc, version = (batch.column(i).to_numpy()[r.text] for i in (0, 1))
            base = (np.cumsum(units.sizes) - units.sizes)[r.text]
            yield _counted(doc, version, r.first, r.last, r.anchor.view(np.int64), r.place, units.digests(base + r.first, base + r.last + kind.window), COUNTED)

    return materialize(_sources(docs).mapInArrow(run, RUN), "runs")


def hot_anchors(every: DataFrame) -> list[int]:
    """Anchors with a large share of a sample's runs; fewer than ``HOT_SHARE``."""
    sample = every.filter(~F.col("later") & (F.pmod(F.xxhash64("doc"), F.lit(HOT_SAMPLE)) == 0))
    share = max(1, sample.count() // HOT_SHARE)
    return [r["anchor"] for r in sample.groupBy("anchor").count().filter(F.col("count") > share).collect()]


def recurring(every: DataFrame) -> DataFrame:
    """Of ``every`` run those whose anchor has others, written out; ``every``, which nothing else reads, is removed.

    Adds ``lead``, whether this is the first of its region, and ``several``, whether its anchor has
    other regions; to leads also ``copied``, whether there are others of their region.
    """
    hot = hot_anchors(every)
    is_hot = F.col("anchor").isin(hot) if hot else F.lit(False)
    found = every.filter("not later").drop("later").withColumn("_task", F.when(is_hot, F.pmod("c1", F.lit(HOT_TASKS))).otherwise(F.lit(0)))
    order = Window.partitionBy("anchor", "_task").orderBy("c1", "c2", "doc", "version", "first")
    out = found.withColumns({f"_{side}{c}": f(c).over(order) for side, f in (("before", F.lag), ("after", F.lead)) for c in ("c1", "c2")})
    out = out.filter(F.col("_beforec1").isNotNull() | F.col("_afterc1").isNotNull() | (F.col("n") > 1) | is_hot)
    same = {side: F.coalesce((F.col(f"_{side}c1") == F.col("c1")) & (F.col(f"_{side}c2") == F.col("c2")), F.lit(False)) for side in ("before", "after")}
    whole = Window.partitionBy("anchor", "_task")
    out = out.withColumns({"lead": ~same["before"], "copied": same["after"] | (F.col("n") > 1)})
    out = out.withColumn("several", is_hot | (F.min(F.struct("c1", "c2")).over(whole) != F.max(F.struct("c1", "c2")).over(whole)))
    later = every.filter("later").withColumns({c: F.lit(False) for c in ("lead", "copied", "several")})
    out = materialize(out.select(*_OCCURRENCE).unionByName(later.select(*_OCCURRENCE)), "recurring")
    discard(every)
    return out


_OCCURRENCE = ("doc", "version", "first", "last", "anchor", "place", "c1", "c2", "lead", "copied", "several")


def divided(docs: DataFrame, kind: Kind, found: DataFrame, width: int) -> DataFrame:
    """Occurrences cut into parts whose windows lie within ``width`` distances from their anchor, as runs of anchors of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in range(7)]
            for doc, version, text, spans in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                units = kind.split([text])
                first, last, anchor, place = (np.array([s[c] for s in spans], np.int64) for c in ("first", "last", "anchor", "place"))
                low = (place - last) // width
                n = (place - first) // width - low + 1
                of = np.repeat(np.arange(len(n)), n)
                part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[of]
                end = place[of] - part * width  # the last window that the part may have
                a, b = np.maximum(first[of], end - width + 1), np.minimum(last[of], end)
                shared = units.digests(end, end - width + 1 + kind.window)[:, 0]
                own = splitmix(anchor[of].view(np.uint64) ^ splitmix(shared.view(np.uint64) + part.astype(np.uint64))).view(np.int64)
                for col, x in zip(columns, (np.full(len(of), doc), np.full(len(of), version), a, b, own, place[of], units.digests(a, b + kind.window)), strict=True):
                    col.append(x)
            if columns[0]:
                yield _counted(*map(np.concatenate, columns), COUNTED)

    found = materialize(found.select("doc", "version", "first", "last", "anchor", "place"), "large")
    own = found.select("doc", "version").distinct()
    slim = docs.select("doc", "version", "text")
    if own.count() <= BROADCAST_IDS:
        slim = slim.join(F.broadcast(own), ["doc", "version"], "left_semi")
    joined = with_spans(slim, found, "inner").select("doc", "version", "text", "spans")
    return materialize(joined.mapInArrow(run, RUN), "divided")


def occurrences(docs: DataFrame, kind: Kind) -> tuple[DataFrame, DataFrame]:
    """The dealt documents, and all occurrences of regions whose anchor recurs."""
    found = recurring(runs_of(docs, kind))
    texts, done = dealt(docs), None
    for width in (*kind.divisions(), 0):
        sizes = found.filter("lead").groupBy("anchor").count()
        large = sizes.filter(F.col("count") > DIVIDED).select("anchor")
        few = found
        again = bool(width) and not large.isEmpty()
        if again:
            large = materialize(large, "large")
            few = found.join(large, "anchor", "left_anti").select(*_OCCURRENCE)
            found = recurring(divided(docs, kind, found.join(large, "anchor", "left_semi"), width))
        done = few if done is None else done.unionByName(few)
        if not again:
            return texts, done
    raise AssertionError


def regions_of(texts: DataFrame, leads: DataFrame, kind: Kind) -> DataFrame:
    """The leads with the bytes of their regions."""
    carried = ("anchor", "c1", "c2", "copied")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = tuple([] for _ in range(8))
            for doc, version, text, spans in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                units = kind.split([text])
                first, last = (np.array([s[c] for s in spans], np.int64) for c in ("first", "last"))
                for s, a, b in zip(spans, *(x.tolist() for x in units.bounds(first, last + kind.window)), strict=True):
                    for col, v in zip(out, (doc, version, s["first"], s["anchor"], s["c1"], s["c2"], s["copied"], units.stream[a:b]), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:6]), pa.array(out[6], pa.bool_()), pa.array(out[7], pa.binary())], ["doc", "version", "first", "anchor", "c1", "c2", "copied", "region"])

    joined = with_spans(texts, leads.select("doc", "version", "first", "last", *carried), "inner").select("doc", "version", "text", "spans")
    return joined.mapInArrow(run, "doc long, version long, first long, anchor long, c1 long, c2 long, copied boolean, region binary")


def judged(regions: DataFrame, leads: int, judge: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``judge`` gets regions (doc, version, first, anchor, c1, c2, copied, region) with all of each anchor, in the order of the corpus."""
    buckets = max(1, -(-leads // REGIONS))

    def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
        return judge(pdf.sort_values(["doc", "version", "first"], kind="stable", ignore_index=True))

    return regions.groupBy(F.pmod("anchor", F.lit(buckets)).alias("bucket")).applyInPandas(ordered, schema)


def stretches(hit: np.ndarray, begin: np.ndarray) -> list[list[int]]:
    """For each region, first and last of each stretch of its windows that are marked; ``begin`` has each region's first window, and behind the last."""
    out: list[list[int]] = [[] for _ in range(len(begin) - 1)]
    at = np.flatnonzero(hit)
    if len(at):
        own = np.searchsorted(begin, at, "right") - 1
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1])]))
        end = np.append(new[1:], len(at)) - 1
        for i, a, b in zip(own[new].tolist(), (at[new] - begin[own[new]]).tolist(), (at[end] - begin[own[new]]).tolist(), strict=True):
            out[i] += (a, b)
    return out


def covered(units: int, spans: list[dict] | None, window: int) -> np.ndarray:
    """Which units of a text lie in a window that goes."""
    edge = np.zeros(units + 1, np.int64)
    if spans:
        n = np.fromiter((len(s["gone"]) // 2 for s in spans), np.int64, len(spans))
        first = np.repeat(np.fromiter((s["first"] for s in spans), np.int64, len(spans)), n)
        ends = np.concatenate([s["gone"] for s in spans]).astype(np.int64).reshape(-1, 2)
        np.add.at(edge, first + ends[:, 0], 1)
        np.add.at(edge, first + ends[:, 1] + window, -1)
    return np.cumsum(edge)[:-1] > 0


def dealt(docs: DataFrame) -> DataFrame:
    """Texts dealt by document; plans that use it twice read one exchange."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.repartition(n, "doc", "version")


def with_spans(docs: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """Documents with their spans gathered: the list grows with the document, never with the corpus."""
    fields = [c for c in spans.columns if c not in ("doc", "version")]
    lists = spans.groupBy("doc", "version").agg(F.collect_list(F.struct(*fields)).alias("spans"))
    return docs.join(lists, ["doc", "version"], how)
