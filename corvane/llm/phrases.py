"""Word-wise substring dedup by repeated-phrase automata.

A window is a number of consecutive words. Regions that may repeat are found by anchors over the whole
corpus and gathered by anchor (see ``repeats``); each gathering is a shard. In a shard, the passages
that recur are confirmed and compiled into Aho-Corasick automata over words, and the regions that all
documents have there stream through them. A match is an occurrence, word for word; nothing else is
one. Of each passage the first occurrence in the corpus stays, and the words of the others go.

A document reaches just the shards of its own anchors: equal windows have equal anchors, so no other
shard has a passage that could match. Regions that are equal throughout stream once; the matches are
those of all their occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.anchors import Ranges, word_units
from corvane.llm.common import splitmix
from corvane.llm.repeats import NULL_ID, Kind, Units, covered, documents, judged, regions_of, stretches, with_spans
from corvane.llm.repeats import occurrences as occurrences_of

WINDOW, GRAM, SEED = 20, 4, 1
#: Words of the passages of one automaton; bounds its memory.
SHARD_WORDS = 200_000


def _split(texts: list[bytes]) -> Units:
    words = [t.split() for t in texts]
    every = [w for ws in words for w in ws]
    size = np.fromiter(map(len, every), np.int64, len(every))
    return Units(word_units(every), np.fromiter(map(len, words), np.int64, len(words)), b" ".join(every), np.concatenate([[0], np.cumsum(size + 1)]))


def passages(ids: np.ndarray, own: np.ndarray, starts: np.ndarray, copied: np.ndarray, window: int) -> Iterator[tuple[int, int]]:
    """Passages that recur, as ranges of ``ids``: the words of all regions, one region after another.

    Windows begin at ``starts``, in regions ``own``; ``copied`` tells which regions occur elsewhere as
    they are. Stretches of windows that no other region has are one passage; a window that several
    regions have is one, taken from the first. Windows are told apart by a hash of their words, so a
    passage may turn out not to recur when the automaton looks for it.
    """
    if not len(starts):
        return
    ranges = Ranges(splitmix(ids.astype(np.uint64)))
    _, kind, n = np.unique(splitmix(ranges.hash(starts, starts + window)), return_inverse=True, return_counts=True)
    first = np.full(len(n), len(starts))
    np.minimum.at(first, kind, np.arange(len(starts)))
    shared = n[kind] > 1
    for at in starts[shared & (first[kind] == np.arange(len(starts)))].tolist():
        yield at, at + window
    alone = np.flatnonzero(~shared & copied[own])
    if len(alone):
        new = np.flatnonzero(np.concatenate([[True], (starts[alone[1:]] != starts[alone[:-1]] + 1)]))
        for a, b in zip(starts[alone[new]].tolist(), starts[alone[np.append(new[1:], len(alone)) - 1]].tolist(), strict=True):
            yield a, b + window


def occurrences(ids: np.ndarray, found: Iterator[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per automaton the matches of its passages in ``ids``: number of the passage, first word, and end."""
    text = tuple(ids.tolist())
    shard, size = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), 0

    def matches() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shard.make_automaton()
        hits = [(number, end - words + 1, end + 1) for end, (number, words) in shard.iter(text)]
        return tuple(np.array(hits, np.int64).reshape(-1, 3).T)

    for number, (a, b) in enumerate(found):
        shard.add_word(text[a:b], (number, b - a))
        size += b - a
        if size >= SHARD_WORDS:
            yield matches()
            shard, size = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), 0
    if size:
        yield matches()


def judge_regions(regions: list[bytes], copied: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which windows go of each region and of its copies, and where each region's windows begin. Regions come in the order of the corpus."""
    words = [r.split() for r in regions]
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers) + 1) for ws in words for w in (*ws, b"")], np.int64)  # no word is empty: it divides regions
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n = sizes - window + 1
    begin = np.concatenate([[0], np.cumsum(n)])
    own = np.repeat(np.arange(len(n)), n)
    base = np.cumsum(sizes + 1) - sizes - 1
    starts = np.arange(len(own)) - begin[own] + base[own]
    mine, others = (np.zeros(len(starts) + 1, np.int64) for _ in range(2))
    for number, first, end in occurrences(ids, passages(ids, own, starts, copied, window)):
        if not len(first):
            continue
        region = np.searchsorted(base, first, "right") - 1
        a = begin[region] + first - base[region]  # the first window that the match covers
        b = a + (end - first) - window + 1
        again = np.ones(len(first), bool)
        order = np.lexsort((first, number))
        again[order[np.concatenate([[True], number[order[1:]] != number[order[:-1]]])]] = False  # the first of each passage
        copies = copied[region]
        for edge, some in ((mine, again), (others, copies)):
            np.add.at(edge, a[some], 1)
            np.add.at(edge, b[some], -1)
    return np.cumsum(mine)[:-1] > 0, np.cumsum(others)[:-1] > 0, begin


def _judge(window: int):
    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        mine, others, begin = judge_regions(pdf["region"].tolist(), pdf["copied"].to_numpy(bool), window)
        mine, others = stretches(mine, begin), stretches(others, begin)
        some = [i for i, (a, b) in enumerate(zip(mine, others, strict=True)) if a or b]
        return pd.DataFrame({**{c: pdf[c].to_numpy()[some] for c in ("anchor", "c1", "c2")}, "mine": [mine[i] for i in some], "others": [others[i] for i in some]})

    return judge


def marked(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """The dealt documents, and for each run with windows that go: doc, version, first, and those windows (``gone``).

    Every occurrence of a region, in whatever document, gets the matches that the automata found in it.
    """
    kind = Kind(_split, window, gram, SEED)
    texts, found = occurrences_of(docs, kind)
    leads = found.filter("lead")
    verdicts = judged(regions_of(texts, leads, kind), leads.count(), _judge(window), "anchor long, c1 long, c2 long, mine array<int>, others array<int>")
    spans = found.join(verdicts, ["anchor", "c1", "c2"]).select("doc", "version", "first", F.when(F.col("lead"), F.col("mine")).otherwise(F.col("others")).alias("gone"))
    return texts, spans.filter(F.size("gone") > 0)


def dedup(docs: DataFrame, window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words left, by one space) and carried columns, of every row.

    Words are runs free of ASCII white space, unchanged. A word goes if a window over it also starts
    earlier: in a document of smaller id, or before in the same one. Windows are judged on the input.
    Null text has no words. Rows of one id and text are one document and fare alike; texts of one id
    come in the order of their hashes; a null id sorts first and stays null. Texts shorter than a
    window lose nothing. An empty table gives no rows.
    """
    source = documents(docs, carry)
    texts, spans = marked(source, window)
    joined = with_spans(texts, spans, "left")
    names = [f"_{c}" for c in carry]
    joined = joined.select("doc", "version", "text", "spans", *names)
    extra = [joined.schema[n] for n in names]
    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.StringType()), *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [text.split() for text in batch.column(2).to_pylist()]
            gone = [covered(len(w), spans, window) for w, spans in zip(words, batch.column(3).to_pylist(), strict=True)]
            kept = [b" ".join([w for w, x in zip(ws, g.tolist(), strict=True) if not x] if g.any() else ws) for ws, g in zip(words, gone, strict=True)]
            columns = [batch.column(0), pa.array([len(g) for g in gone], pa.int64()), pa.array([int(g.sum()) for g in gone], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[4:]], schema.names)

    out = joined.mapInArrow(run, schema)
    doc_id = F.when(F.col("doc") != F.lit(NULL_ID), F.col("doc")).alias("doc_id")
    return out.select(doc_id, "n_words", "n_removed", "kept_sha256", "kept", *(F.col(n).alias(c) for n, c in zip(names, carry, strict=True)))


def remove_from(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``; ``n_chars`` follows. Texts without any stay as they are.

    A text that loses words keeps the others by one space each. No row goes; other columns stay.
    """
    safe = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # so that no column can clash with the operator's own
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(f"`{c}`").alias(n) for c, n in safe.items()))
    out = dedup(plain, window, tuple(safe.values()))
    lost = F.col("n_removed") > 0
    columns = []
    for field in docs.schema.fields:
        own = F.col(safe[field.name])
        if field.name == "text":
            own = F.when(lost, F.col("kept")).otherwise(own)
        elif field.name == "n_chars":
            own = F.when(lost, F.length("kept").cast(field.dataType)).otherwise(own)
        columns.append(own.alias(field.name))
    return out.select(*columns)
