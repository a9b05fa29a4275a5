from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from messy_tables import with_clashes
from pyspark.sql import functions as F

from corvane.llm import pivots, simhash
from corvane.llm.components import connected_components


def classes(n: int, links) -> list[int]:
    label = list(range(n))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def slow_fingerprint(text: str | None) -> int:
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(110)] + [(7, 7), (3, 2), (2, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*links, (None, 4)], "a long, b long")).collect()}
    expected = classes(400, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: expected[x] for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_against_brute_force(spark, messy):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    fps = [slow_fingerprint(t) for _, t in rows]
    label = classes(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {c: min((rows[i][0] for i in range(len(rows)) if label[i] == c and rows[i][0] is not None), default=None) for c in set(label)}
    expected = sorted(((d, f, least[label[i]]) for i, ((d, _), f) in enumerate(zip(rows, fps, strict=True))), key=str)
    got = simhash.near_duplicates(with_clashes(messy)).collect()
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got), key=str) == expected


def test_simhash_links_of_hot_groups(spark):
    """Dense balls of fingerprints, with groups divided again and again: no pair within 4 bits is lost."""
    rng = np.random.default_rng(2)
    ball = np.unique(rng.integers(0, 1 << 12, 500).astype(np.uint64) << np.uint64(20))
    fps = np.unique(np.concatenate([ball, rng.integers(0, 1 << 63, 300, dtype=np.uint64)]))
    far = fps[::40] ^ np.uint64(0b1111 << 40)
    fps = np.unique(np.concatenate([fps, far]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = simhash.links(df, 4, bucket=300, group=20).collect()
    place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    assert classes(len(fps), [(place[r["a"]], place[r["b"]]) for r in found]) == classes(len(fps), np.argwhere(near).tolist())


def test_wide_index_equals_brute_force():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, (30, 4), dtype=np.uint64)
    copies = base[rng.integers(0, 30, 400)].copy()
    for c in copies:
        for b in rng.integers(0, 256, rng.integers(0, 60)):
            c[b // 64] ^= np.uint64(1 << int(b) % 64)
    group = rng.integers(0, 3, 400)
    out = simhash.GrayIndex(group, copies).forest(44)
    near = (np.bitwise_count(copies[:, None] ^ copies[None]).sum(axis=2) <= 44) & (group[:, None] == group[None])
    expected = classes(400, np.argwhere(near).tolist())
    assert len(set(zip(out.tolist(), expected, strict=True))) == len(set(out.tolist())) == len(set(expected))


def test_one_of_each_group_stays(spark, messy):
    out = simhash.keep_one(with_clashes(messy))
    assert out.columns == with_clashes(messy).columns
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert ids.count(1) == 1 and not {2, 3} & set(ids)  # copies and a near copy go
    assert ids.count(4) + ids.count(5) + ids.count(6) == 1  # texts without words are one group
    assert {7, 8, 9, 10, 11} <= set(ids)
    assert [r["doc_id"] for r in out.filter("text = 'only here'").collect()] == [None]


def test_near_copies_of_long_texts_go_and_others_stay(spark):
    rng = random.Random(9)
    rows = []
    for i in range(40):
        text = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows.append((10 * i, " ".join(text)))
        changed = list(text)
        for k in rng.sample(range(300), 5):
            changed[k] = "other"
        rows.append((10 * i + 1, " ".join(changed)))
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    ids = {r["doc_id"] for r in out.collect()}
    assert {10 * i for i in range(40)} <= ids and len(ids & {10 * i + 1 for i in range(40)}) <= 2


def shingle_set(text: str) -> frozenset:
    words = text.split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def test_near_copies_are_those_of_exact_similarity(spark):
    """Pairs at Jaccard 0.8 go, those just below stay; a line that both repeat counts once."""
    rng = random.Random(6)
    rows, expected = [], set()
    for i in range(240):
        size = (40, 90, 200)[i % 3]
        text = [f"w{rng.randrange(50000)}" for _ in range(size + 4)]  # size distinct shingles
        line = ["again", "and", "again", f"l{i}"] * 50 if i % 4 == 3 else []
        n = len(shingle_set(" ".join(text + line)))
        most = (n // 9 if i % 2 else n // 7 + 1)  # x of n differ at one end: (n - x) / (n + x) is 0.8 at n / 9, 0.75 at n / 7
        other = [f"o{rng.randrange(50000)}" for _ in range(most)] + text[most:]
        rows += [(2 * i, " ".join(text + line)), (2 * i + 1, " ".join(other + line))]
        a, b = shingle_set(rows[-2][1]), shingle_set(rows[-1][1])
        expected |= {2 * i} if len(a & b) * 5 >= len(a | b) * 4 else {2 * i, 2 * i + 1}
    assert 300 < len(expected) < 420
    ids = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert expected <= ids and len(ids - expected) <= 1


def test_divided_candidates_are_all_compared():
    """One unit gives the classes of brute force over exact similarity."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, (4, 60), dtype=np.uint64)
    sets = []
    for i in range(80):
        x = base[i % 4].copy()
        x[rng.choice(60, rng.integers(0, 14), replace=False)] = rng.integers(0, 1 << 63, dtype=np.uint64)
        sets.append(np.unique(x))
    links = [(i, j) for i in range(80) for j in range(i) if 5 * len(set(sets[i].tolist()) & set(sets[j].tolist())) >= 4 * len(set(sets[i].tolist()) | set(sets[j].tolist()))]
    assert simhash.similar_forest(sets, np.zeros((80, 4), np.uint64), 0).tolist() == classes(80, links)


def test_empty_tables(spark, nothing):
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0
    assert pivots.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def vectors_table(spark):
    rng = np.random.default_rng(8)
    rows, hot = [], rng.standard_normal(16)
    for i in range(400):
        base = hot if i % 3 == 0 else rng.standard_normal(16)
        v = base + rng.standard_normal(16) * (0.12 if i % 3 == 0 else 0)
        rows.append((i, [float(np.float32(x)) for x in v], 0 if i % 3 == 0 else i % 4))
    rows += [(400, rows[0][1], 0), (401, rows[0][1], 0), (401, rows[0][1], 0), (402, rows[0][1], None), (403, None, 0), (404, [0.0] * 16, 0), (405, [float("nan")] + [1.0] * 15, 0), (406, [float("inf")] + [1.0] * 15, 0), (407, [1.0, None, *[0.0] * 14], 0), (408, [], 0), (409, [1.0, 2.0], 0), (410, [2.0, 4.0], 0), (None, rows[3][1], 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def usable(v) -> bool:
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_pivots_of_one_direction_link(spark):
    """With the query's own parameters: where all vectors point one way there is one pivot to share."""
    rows = [(1, [1.0, 2.0], 0), (2, [2.0, 4.0], 0), (3, [0.5, 1.0], 1), *((10 + i, [float(i == k) for k in range(6)], 0) for i in range(6))]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), threshold=0.93).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3)} | {10 + i: (0, 10 + i) for i in range(6)}


@pytest.mark.parametrize("setting", [{}, {"block_rows": 32, "shared": 1}])
def test_pivots_against_brute_force(spark, setting):
    """The query's own parameters, and small blocks."""
    rows, df = vectors_table(spark)
    n = len(rows)
    links = []
    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if la is not None and la == lb and usable(a) and usable(b) and len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                links.append((i, j))
    label = classes(n, links)
    count = np.bincount(np.array(links).ravel(), minlength=n)
    least = {c: min((rows[i][0] for i in range(n) if label[i] == c and rows[i][0] is not None), default=None) for c in set(label)}
    expected = sorted(((rows[i][0], int(count[i]), least[label[i]]) for i in range(n)), key=str)
    out = pivots.near_duplicates(df.withColumns({c: F.lit(1) for c in ("cid", "n", "to", "pivot", "copies", "n_links")}), **setting).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=str) == expected
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)
