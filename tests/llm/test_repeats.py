from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from messy_tables import with_clashes

from corvane.llm import phrases, repeats, suffixes
from corvane.llm.anchors import bytes_units, runs


def slow_words(rows: list[tuple[int, str]], window: int) -> list[tuple]:
    """``rows`` in the order that counts."""
    first, out = {}, []
    docs = [(k, t.encode().split()) for k, t in rows]
    for k, w in docs:
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), (k, s))
    for k, w in docs:
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (k, s):
                gone[s : s + window] = True
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((k, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return out


def slow_bytes(rows: list[tuple[int, bytes]], window: int, keep: str) -> list[tuple]:
    seen, out = {}, []
    for k, t in rows:
        for s in range(len(t) - window + 1):
            seen.setdefault(t[s : s + window], []).append((k, s))
    for k, t in rows:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - window + 1):
            places = seen[t[s : s + window]]
            if len(places) > 1 and (keep == suffixes.KEEP_NONE or places[0] != (k, s)):
                gone[s : s + window] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]).astype(int)) == 1)
        out.append((k, len(t), int(gone.sum()), len(edges), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def order(rows):
    """Documents once each: by id, null first; the messy table has one text per id but for null."""
    return sorted({(r["doc_id"], r["text"] or "") for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_words_against_brute_force(spark, messy):
    rows = [r for r in messy.collect() if r["doc_id"] is not None]
    docs = order(rows)
    expected = {k: v for k, *v in slow_words(docs, 20)}
    out = phrases.dedup(with_clashes(messy.filter("doc_id is not null"))).collect()
    assert len(out) == len(rows)
    assert all([r["n_words"], r["n_removed"], r["kept_sha256"]] == expected[r["doc_id"]] for r in out)
    assert sum(r["n_removed"] for r in out) > 300


def test_null_ids_come_first(spark, messy):
    out = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in phrases.dedup(messy).collect()}
    assert out[None, 120] == 0 and out[1, 120] == 120 and out[None, 2] == 0


def crowded(monkeypatch):
    """Count equal runs from two on, and take every repeated anchor for a hot one."""
    monkeypatch.setattr(repeats, "COUNTED", 2)
    monkeypatch.setattr(repeats, "HOT_SAMPLE", 1)
    monkeypatch.setattr(repeats, "HOT_SHARE", 10**6)
    monkeypatch.setattr(repeats, "HOT_TASKS", 5)


@pytest.mark.parametrize("seed", range(4))
def test_words_of_few_kinds(spark, seed, monkeypatch):
    """Periodic and overlapping repetitions, where runs are cut differently in every copy."""
    if seed % 2:
        crowded(monkeypatch)
    if seed > 1:
        monkeypatch.setattr(repeats, "DIVIDED", seed - 1)
    rng = random.Random(seed)
    blocks = [[rng.choice("abc") for _ in range(rng.randrange(3, 40))] for _ in range(6)]
    rows = [(i, " ".join(w for _ in range(rng.randrange(1, 6)) for w in rng.choice(blocks))) for i in range(40)]
    expected = slow_words(rows, 20)
    out = phrases.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out) == sorted(expected)


@pytest.mark.parametrize("operator", ["words", "bytes"])
def test_counted_runs_survive_other_batches(spark, operator, monkeypatch):
    """Texts that share a batch when they are first read, and not when they are read again."""
    calls = []

    def otherwise(df, *keys):
        calls.append(keys)
        return df.coalesce(1) if len(calls) == 1 else df.repartition(40, *keys)

    monkeypatch.setattr(repeats, "spread", otherwise)
    rng = random.Random(5)
    line = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"{' '.join(f'w{rng.randrange(10**6)}' for _ in range(15))} {line} {' '.join(f'w{rng.randrange(10**6)}' for _ in range(15))}") for i in range(14)] + [(20 + i, line) for i in range(14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if operator == "words":
        expected = {k: n for k, _, n, _ in slow_words(rows, 20)}
        out = phrases.dedup(docs).collect()
    else:
        expected = {k: n for k, _, n, _, _ in slow_bytes([(k, t.encode()) for k, t in rows], 50, suffixes.KEEP_NONE)}
        out = suffixes.dedup(docs, window=50, keep=suffixes.KEEP_NONE).collect()
    assert {r["doc_id"]: r["n_removed"] for r in out} == expected


@pytest.mark.parametrize("shard", [1, 50, 10**6])
def test_automata_find_the_occurrences(monkeypatch, shard):
    """Of four regions the second has copies as it is, the third shares windows with the second, the fourth is like the first."""
    monkeypatch.setattr(phrases, "SHARD_WORDS", shard)
    w = [b"w%d" % i for i in range(90)]
    regions = [w[:8], w[10:24], w[14:20] + w[50:60], w[:8]]
    mine, others, begin = phrases.judge_regions([b" ".join(r) for r in regions], np.array([False, True, False, False]), 5)
    assert begin.tolist() == [0, 4, 14, 26, 30]
    assert np.flatnonzero(mine).tolist() == [14, 15, 26, 27, 28, 29]
    assert np.flatnonzero(others).tolist() == list(range(4, 14))


def test_nothing_goes_without_the_automata(monkeypatch):
    monkeypatch.setattr(phrases, "occurrences", lambda ids, found: iter(()))
    text = b" ".join(b"w%d" % i for i in range(60))
    mine, others, _ = phrases.judge_regions([text, text], np.array([True, True]), 20)
    assert not mine.any() and not others.any()


def test_equal_hashes_are_no_proof(monkeypatch):
    """Windows that a hash takes for one aren't removed, as the automaton finds no second occurrence."""
    monkeypatch.setattr(phrases, "splitmix", lambda x: np.zeros_like(x))
    mine, others, _ = phrases.judge_regions([b" ".join(b"a%d" % i for i in range(25)), b" ".join(b"b%d" % i for i in range(25))], np.array([False, False]), 20)
    assert not mine.any() and not others.any()


def test_rows_and_columns_stay(spark, messy):
    docs = with_clashes(messy)
    out = phrases.remove_from(docs)
    assert out.schema.names == docs.schema.names and out.count() == docs.count()
    before = {r["doc_id"]: r for r in docs.collect()}
    for r in out.collect():
        if r["doc_id"] in (7, 8, 11):  # 9 and 10 repeat themselves
            assert r == before[r["doc_id"]]
    assert out.filter("doc_id = 3").first()["text"] == "tail of its own"


@pytest.mark.parametrize("keep", [suffixes.KEEP_NONE, suffixes.KEEP_FIRST])
def test_bytes_against_brute_force(spark, messy, keep):
    rows = [r for r in messy.collect() if r["doc_id"] is not None]
    expected = {k: v for k, *v in slow_bytes([(k, t.encode()) for k, t in order(rows)], 50, keep)}
    out = suffixes.dedup(with_clashes(messy.filter("doc_id is not null")), window=50, keep=keep).collect()
    assert len(out) == len(rows)
    for r in out:
        assert [r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]] == expected[r["doc_id"]], r["doc_id"]


def test_bytes_of_null_ids(spark, messy):
    """A null id comes first and stays null; its rows count as documents like all others."""
    rows = [r for r in messy.collect() if r["doc_id"] != 11]
    expected = sorted(v for _, *v in slow_bytes([(k, t.encode()) for k, t in order(rows)], 50, suffixes.KEEP_NONE) for _ in range(2 if _ == 2 else 1))
    out = suffixes.dedup(messy.filter("doc_id is null or doc_id <> 11"), window=50, keep=suffixes.KEEP_NONE).collect()
    assert sorted([r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]] for r in out) == expected
    assert {r["n_bytes"]: r["n_removed"] for r in suffixes.dedup(messy, window=50).collect() if r["doc_id"] is None}.popitem()[1] == 0


@pytest.mark.parametrize(("seed", "limit"), [(0, 10**9), (1, 10**9), (2, 1), (3, 3)])
def test_bytes_of_few_kinds(spark, seed, limit, monkeypatch):
    """Also with anchors of a few regions counted as too large, so that they are divided."""
    monkeypatch.setattr(repeats, "DIVIDED", limit)
    if seed % 2:
        crowded(monkeypatch)
    rng = random.Random(seed)
    blocks = ["".join(rng.choice("ab") for _ in range(rng.randrange(20, 300))) for _ in range(5)]
    rows = [(i, "".join(rng.choice(blocks) for _ in range(rng.randrange(1, 5)))) for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for keep in (suffixes.KEEP_FIRST, suffixes.KEEP_NONE):
        expected = slow_bytes([(k, t.encode()) for k, t in rows], 60, keep)
        texts, spans = suffixes.marked(suffixes.documents(docs), 60, keep=keep)
        gone = {k: np.zeros(len(t), bool) for k, t in rows}
        for s in spans.collect():
            for a, b in zip(s["gone"][::2], s["gone"][1::2], strict=True):
                gone[s["doc"]][s["first"] + a : s["first"] + b + 60] = True
        assert {k: int(g.sum()) for k, g in gone.items()} == {k: n for k, _, n, _, _ in expected}


@pytest.mark.parametrize("depth", [1, 3, 7, 30])
def test_longest_previous_factor(depth):
    rng = np.random.default_rng(depth)
    data = rng.integers(0, 2, 120)
    data = np.concatenate([data, data[30:80]])

    def common(i, j):
        k = 0
        while k < depth and max(i, j) + k < len(data) and data[i + k] == data[j + k]:
            k += 1
        return k

    s = suffixes.Suffixes(data.astype(np.uint16) + 1, depth)
    assert s.longest_previous_factor().tolist() == [max((common(i, j) for j in range(i)), default=0) for i in range(len(data))]


@pytest.mark.parametrize("keep", [suffixes.KEEP_FIRST, suffixes.KEEP_NONE])
def test_previous_smaller_positions_decide(keep, monkeypatch):
    data = np.frombuffer(b"abc\0bcabc--abc\0bd\0\0\0\0", np.uint8)
    at = np.arange(len(data) - 2)
    expected = [any(data[i : i + 3].tolist() == data[j : j + 3].tolist() for j in at if (j < i or keep == suffixes.KEEP_NONE) and j != i) for i in at]
    assert suffixes.Suffixes(data, 3, at).copies(keep).tolist() == expected
    monkeypatch.setattr(suffixes, "previous_smaller", lambda x: np.full(len(x), -1))
    assert not suffixes.Suffixes(data, 3, at).copies(keep).any()


def test_runs_cover_every_window_once(monkeypatch):
    from corvane.llm import anchors

    monkeypatch.setattr(anchors, "CHUNK", 100)
    rng = random.Random(0)
    texts = [bytes(rng.choices(b"ab", k=n)) for n in (0, 5, 30, 31, 400, 99, 100, 101)]
    r = runs(bytes_units(b"".join(texts)), np.array([len(t) for t in texts]), 30, 8, 1)
    covered = sorted((t, s) for t, a, b in zip(r.text, r.first, r.last, strict=True) for s in range(a, b + 1))
    assert covered == [(i, s) for i, t in enumerate(texts) for s in range(len(t) - 29)]
    of = {}
    for t, a, b, h in zip(r.text, r.first, r.last, r.anchor, strict=True):
        for s in range(a, b + 1):
            assert of.setdefault(texts[t][s : s + 30], h) == h  # equal windows have equal anchors


def test_nothing(spark, nothing):
    assert phrases.dedup(nothing).count() == 0 and suffixes.dedup(nothing).count() == 0
    assert phrases.remove_from(nothing).count() == 0
