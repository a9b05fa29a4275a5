from __future__ import annotations

import itertools
import time

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from corvane.operators import catalog as C
from corvane.operators import clustering as L
from corvane.operators import export as X
from corvane.operators import metrics as M
from corvane.operators import naming as N
from corvane.operators import neighbours
from corvane.operators import ordering as O
from corvane.operators.projection import ContrastiveTrainer, ProjectionHead


def blobs(k=4, n=15, size=6, gap=20.0, seed=0):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.standard_normal((n, size)) + gap * rng.standard_normal(size) for _ in range(k)])
    return x, np.repeat(np.arange(k), n)


def table(spark, x, **more):
    names = list(more)
    rows = [(i, v.tolist(), *(more[c][i] for c in names)) for i, v in enumerate(x)]
    kinds = {int: "int", float: "double", str: "string"}
    schema = "id long, vector array<double>" + "".join(f", {c} {kinds[type(more[c][0])]}" for c in names)
    return spark.createDataFrame(rows, schema)


def same_partition(a, b):
    return len(set(a)) == len(set(b)) == len(set(zip(a, b, strict=True)))


def labels(df):
    return [r["label"] for r in df.orderBy("id").collect()]


def test_clusterers_find_blobs(spark):
    x, truth = blobs()
    df = table(spark, x)
    assert same_partition(labels(L.create("kmeans", n_clusters=4, starts=5).fit_predict(df)), truth)
    for linkage in ("ward", "average", "complete", "single"):
        assert same_partition(L.agglomerate(x, 4, linkage), truth)
    assert same_partition(labels(L.create("agglomerative", n_clusters=4).fit_predict(df)), truth)
    assert same_partition(labels(L.create("hdbscan", min_cluster_size=5, min_samples=2).fit_predict(df)), truth)
    with pytest.raises(ValueError, match="unknown algorithm"):
        L.create("spectral")
    with pytest.raises(ValueError, match="unknown linkage"):
        L.agglomerate(x, 4, "median")


def test_hdbscan_noise_and_limits():
    x, truth = blobs(3, 20)
    far = np.array([[500.0] * 6, [-700.0] * 6])
    out = L.hdbscan(np.vstack([x, far]), 5, 2)
    assert (out[-2:] == -1).all() and same_partition(out[:-2][out[:-2] >= 0], truth[out[:-2] >= 0]) and (out[:-2] >= 0).mean() > 0.9
    assert (L.hdbscan(x[:3], 5, 2) == -1).all()  # too few
    assert (L.hdbscan(np.ones((10, 2)), 3, 2) == -1).all()  # the whole is never a cluster


def test_ward_of_many_rows_and_copies():
    x, truth = blobs(5, 1_000, 8)
    x = np.vstack([x, np.repeat(x[::1_000], 300, axis=0)])
    truth = np.concatenate([truth, np.repeat(np.arange(5), 300)])
    began = time.process_time()
    assert same_partition(L.agglomerate(x, 5), truth)
    assert time.process_time() - began < 60  # a search of the whole matrix for each merge takes several minutes
    few = np.random.default_rng(2).standard_normal((60, 3))
    for linkage, far in (("ward", None), ("average", np.mean), ("complete", np.max), ("single", np.min)):
        groups = [[i] for i in range(60)]
        while len(groups) > 7:  # by definition
            def gap(a, b):
                d = np.sqrt(((few[a][:, None] - few[b][None]) ** 2).sum(axis=2))
                return far(d) if far else len(a) * len(b) / (len(a) + len(b)) * ((few[a].mean(axis=0) - few[b].mean(axis=0)) ** 2).sum()

            a, b = min(itertools.combinations(range(len(groups)), 2), key=lambda p: gap(groups[p[0]], groups[p[1]]))
            groups[a] += groups.pop(b)
        assert L.agglomerate(few, 7, linkage).tolist() == [k for i in range(60) for k, g in enumerate(sorted(groups, key=min)) if i in g], linkage


def test_groups_of_any_size(spark):
    """A group of more rows than a distance matrix could hold, inside clusters and as a whole."""
    rows = spark.range(20_500).select("id", F.array(F.col("id") % 2 * 1e3 + F.rand(7), F.rand(8)).alias("vector"))

    class One:
        def fit_predict(self, points):
            return points.select("id", F.lit(0).alias("label"))

    out = L.hierarchical(rows, One(), lambda x: L.agglomerate(x, 2)).groupBy("label_l1", "label_l2", "composite").agg(F.count("*").alias("n"), F.count_distinct(F.col("id") % 2).alias("kinds"))
    assert sorted(tuple(r) for r in out.collect()) == [(0, 0, "A1", 10_250, 1), (0, 1, "A2", 10_250, 1)]


def test_clusters_have_tasks_of_their_own(spark):
    """Small partitions aren't joined before a kernel of quadratic time."""
    rows = spark.range(100).select("id", F.array(F.col("id").cast("double")).alias("vector"))

    class Five:
        def fit_predict(self, points):
            return points.select("id", (F.col("id") % 5).cast("int").alias("label"))

    def task(x):
        return np.full(len(x), TaskContext.get().partitionId())

    found = L.hierarchical(rows, Five(), task).select("label_l1", "label_l2").distinct().collect()
    assert len(found) == len({r["label_l2"] for r in found}) == 5


def test_core_distances(spark):
    x, _ = blobs(2, 10)
    got = {r["id"]: r["core"] for r in L.core_distances(table(spark, x), 3).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert [got[i] for i in range(len(x))] == pytest.approx(np.sort(d, axis=1)[:, 2], abs=1e-6)


def test_pca_keeps_distances(spark):
    x, _ = blobs(2, 12, 3)
    wide = x @ np.random.default_rng(1).standard_normal((3, 8))
    df = table(spark, wide)
    flat = np.array([r["vector"] for r in L.reduce(df, 3).orderBy("id").collect()])
    def gaps(m):
        return np.sqrt(((m[:, None] - m[None]) ** 2).sum(axis=2))

    assert np.allclose(gaps(flat), gaps(wide), atol=1e-6)
    assert L.reduce(df, 0) is df and L.reduce(df, 8) is df
    assert sum(L.explained_variance(df, 3)) == pytest.approx(1.0)


def test_two_levels_contract(spark):
    x, truth = blobs(3, 24)
    inner = np.random.default_rng(3).standard_normal((72, 4)) + 9.0 * np.where((np.arange(72) % 2)[:, None], 1, [1, -1, 1, -1])  # apart by direction
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, inner, strict=True))], "id long, perc array<double>, full array<double>")
    out = L.two_levels(df, L.HDBSCAN(6, 1), L.HDBSCAN(4, 2), pca=0).orderBy("id").collect()
    assert [r["id"] for r in out] == list(range(72)) and same_partition([r["label_l1"] for r in out], truth)
    assert all((r["label_l1"] != -1) and (r["label_l1_raw"] in (-1, r["label_l1"])) for r in out)
    for k in range(3):
        some = [(r["label_l2"], r["id"] % 2) for r in out if truth[r["id"]] == k]
        assert len({a for a, _ in some}) >= 2 and len(set(some)) == len({a for a, _ in some})
    raw = L.two_levels(df, L.HDBSCAN(6, 1), L.HDBSCAN(4, 2), pca=0, assign_noise=False).collect()
    assert all(r["label_l2"] == -1 for r in raw if r["label_l1"] == -1)


def test_small_parents_are_one_subcluster(spark):
    x, _ = blobs(2, 7)
    df = spark.createDataFrame([(i, v.tolist(), v.tolist()) for i, v in enumerate(x)], "id long, perc array<double>, full array<double>")
    assert {r["label_l2"] for r in L.two_levels(df, L.HDBSCAN(5, 1), L.HDBSCAN(4, 2), pca=0).collect()} == {0}


def test_composite_labels(spark):
    rows = spark.createDataFrame([(-1, -1), (0, -1), (0, 0), (27, 2)], "label_l1 int, label_l2 int")
    assert [r["composite"] for r in L.composite_labels(rows).collect()] == ["Noise", "A_noise", "A1", "AB3"]


def test_reassignment(spark):
    x, truth = blobs(3, 8)
    given = [int(t) if i % 4 else -1 for i, t in enumerate(truth)]
    out = neighbours.reassign_noise(table(spark, x, label=given)).orderBy("id").collect()
    assert [r["label"] for r in out] == truth.tolist() and [r["raw"] for r in out] == given
    for same in ([-1] * 24, truth.tolist()):
        assert labels(neighbours.reassign_noise(table(spark, x, label=same))) == same


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 7)
    monkeypatch.setattr(neighbours, "POINT_BLOCK", 9)
    x, _ = blobs(2, 15)
    df = table(spark, x)
    out = neighbours.nearest(df, df, 4, neighbours.EUCLIDEAN).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    assert {(r["query_id"], r["rank"]): r["point_id"] for r in out} == {(i, k + 1): int(np.argsort(d[i], kind="stable")[k]) for i in range(30) for k in range(4)}


def score(spark, rows, f, *more):
    return f(spark.createDataFrame(rows, "label_pred int, label_true int"), *more).first()[0]


def test_ari_and_nmi(spark):
    same = [(a, a) for a in (0, 0, 1, 1, 2, 2, 3)]
    assert score(spark, same, M.adjusted_rand) == pytest.approx(1.0) and score(spark, same, M.mutual_information) == pytest.approx(1.0)
    assert score(spark, [*same, (-1, 2), (5, -1)], M.adjusted_rand) == pytest.approx(1.0)
    assert score(spark, [(0, 0)], M.adjusted_rand) == 0.0 and score(spark, [(-1, -1)] * 3, M.mutual_information) == 0.0
    assert score(spark, [(0, 0)] * 4, M.adjusted_rand) == 1.0 and score(spark, [(0, 0)] * 4, M.mutual_information) == 1.0
    assert score(spark, [(0, 0), (0, 1), (1, 0), (1, 1)], M.adjusted_rand) == pytest.approx(-0.5)
    assert score(spark, [(0, 0), (0, 1), (1, 0), (1, 1)], M.mutual_information) == pytest.approx(0.0, abs=1e-12)


def test_noise_rate(spark):
    def rate(x):
        return M.noise_rate(spark.createDataFrame([(i,) for i in x], "l int"), "l").first()[0]

    assert (rate([0, 0, 1, -1, -1]), rate([0, 1, 2, 0, 1]), rate([])) == (pytest.approx(0.4), 0.0, 0.0)


def test_composite(spark):
    rows = spark.createDataFrame([("ari", 0.8), ("nmi", 0.6)], "metric string, value double")
    assert M.composite(rows).first()[0] == pytest.approx(0.7)
    assert M.composite(rows, {"ari": 3.0, "nmi": 1.0}).first()[0] == pytest.approx(0.75)
    assert M.composite(rows, {"other": 1.0}).first()[0] == 0.0 and M.composite(rows.limit(0)).first()[0] == 0.0


def test_retrieval(spark):
    x, _ = blobs(3, 8)
    df = table(spark, x)
    pairs = [(0, 1), (3, 20), (9, 10)]
    got = M.positive_ranks(spark.createDataFrame(pairs, "i long, j long"), df, block=5).collect()
    unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    d = 1 - np.clip(unit @ unit.T, -1, 1)
    for r in got:
        i, j = r["i"], r["j"]
        others = [k for k in range(24) if k != i]
        assert r["worst_rank"] == max(1, sum(d[i, k] <= d[i, j] + 1e-12 for k in others))
        assert r["auc"] == pytest.approx(sum(d[i, k] > d[i, j] + 1e-12 for k in others if k != j) / 22)
    assert M.retrieval(spark.createDataFrame([], "i long, j long, distance double, worst_rank long, place long, auc double")).first().asDict() | {} == {"recall_5": 0.0, "ndcg_5": 0.0, "recall_10": 0.0, "ndcg_10": 0.0, "recall_20": 0.0, "ndcg_20": 0.0, "mrr": 0.0, "auc": 0.5}


def test_ranks_of_copies_and_block_sizes(spark):
    """Copies of a point are exactly as near as itself, however blocks are cut."""
    rng = np.random.default_rng(8)
    some = rng.standard_normal((7, 6))
    x = np.vstack([some, some, some[:3] * 2, rng.standard_normal((20, 6))])
    df, n = table(spark, x), len(x)
    pairs = spark.createDataFrame([(i, i + 1) for i in range(n)], "i long, j long")
    dot = [[(p * q).cumsum()[-1] for q in x] for p in x]
    size = [dot[k][k] ** 0.5 + 1e-8 for k in range(n)]
    d = [[1 - max(-1.0, min(1.0, dot[p][q] / (size[p] * size[q]))) for q in range(n)] for p in range(n)]
    want = set()
    for i in range(n - 1):
        j, others = i + 1, [k for k in range(n) if k != i]
        want.add((i, j, sum(d[i][k] <= d[i][j] for k in others), 1 + sum(d[i][k] < d[i][j] or (d[i][k] == d[i][j] and k < j) for k in others), sum(d[i][k] > d[i][j] for k in others) / (n - 2)))
    for block in (3, 8, 1000):
        assert {(r["i"], r["j"], r["worst_rank"], r["place"], r["auc"]) for r in M.positive_ranks(pairs, df, block).collect()} == want


def test_blocks_travel_in_short_rows(spark):
    """No packed row is long, floats travel as floats, and vectors come back exactly."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((2_000, 96)).astype(np.float32).astype(np.float64)
    for wide, size in ((x, 4), (x + 1e-12, 8)):
        rows = M._blocks(table(spark, wide), F.lit(0), {"id": "<i8", "vector": "<f8"}, 1, "p").collect()
        assert max(len(r["p_vector"]) for r in rows) < 1 << 19 and sum(len(r["p_vector"]) for r in rows) < (size + 0.1) * x.size
        ids = np.concatenate([np.frombuffer(r["p_id"], "<i8") for r in rows])
        back = M._unpacked([r["p_vector"] for r in rows], [len(r["p_id"]) // 8 for r in rows])
        assert back.dtype == np.float64 and (back == wide[ids]).all() and sorted(ids) == list(range(len(x)))


def test_ranks_over_pieces(spark):
    """Blocks of several pieces, some of floats and some of doubles, give the counts of brute force."""
    rng = np.random.default_rng(10)
    x = np.vstack([rng.standard_normal((700, 5)).astype(np.float32).astype(np.float64), rng.standard_normal((700, 5))])
    n = len(x)
    pairs = spark.createDataFrame([(i, (7 * i + 1) % n) for i in range(n)], "i long, j long")
    unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    s = unit @ unit.T
    got = M.positive_ranks(pairs, table(spark, x), block=1_000).collect()
    assert len(got) == n
    for r in got:
        i, j = r["i"], r["j"]
        nearer = sum(s[i] > s[i, j] + 1e-12) - 1  # without the row itself
        assert r["worst_rank"] == r["place"] == nearer + 1 and r["distance"] == pytest.approx(1 - s[i, j], abs=1e-12)


def test_cluster_quality(spark):
    x, truth = blobs(3, 9)
    df = table(spark, np.vstack([x, x[:1] + 500]), label=[*truth.tolist(), -1])
    own = [x[truth == k] for k in range(3)]
    mu = [m.mean(axis=0) for m in own]
    between, within = sum(9 * ((m - x.mean(axis=0)) ** 2).sum() for m in mu), sum(((o - m) ** 2).sum() for o, m in zip(own, mu, strict=True))
    assert M.calinski_harabasz(df).first()[0] == pytest.approx((between / 2) / (within / 24), rel=1e-6)
    s = [np.linalg.norm(o - m, axis=1).mean() for o, m in zip(own, mu, strict=True)]
    worst = [max((s[a] + s[b]) / np.linalg.norm(mu[a] - mu[b]) for b in range(3) if b != a) for a in range(3)]
    assert M.davies_bouldin(df).first()[0] == pytest.approx(np.mean(worst), abs=1e-6)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    per = []
    for i in range(27):
        a = d[i, truth == truth[i]].sum() / 8
        b = min(d[i, truth == k].mean() for k in range(3) if k != truth[i])
        per.append((b - a) / max(a, b))
    assert M.silhouette(df, block=6).first()[0] == pytest.approx(np.mean(per), abs=1e-6)
    one = df.filter("label = 0")
    assert M.silhouette(one).first()[0] is None and M.calinski_harabasz(one).first()[0] is None and M.davies_bouldin(one).first()[0] is None


def sequence(spark, n=12, seed=0):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.standard_normal((n // 3, 8)) + 10 * np.eye(8)[i] for i in range(3)])
    keys = [["Cm", "Gm", "Eb", "F#m", "?"][i % 5] for i in range(n)]
    bpm = rng.uniform(120, 140, n).round(1).tolist()
    return x, bpm, keys, spark.createDataFrame([(i, 0, v.tolist(), b, k) for i, (v, b, k) in enumerate(zip(x, bpm, keys, strict=True))], "id long, grp int, vector array<double>, bpm double, key string")


def test_greedy_beats_random_orders(spark):
    x, bpm, keys, df = sequence(spark)
    placed = O.order_clusters(O.with_camelot(df), ["grp"], "id").join(df, ["id", "grp"])
    assert sorted(r["position"] for r in placed.collect()) == list(range(12))
    assert placed.orderBy("position").first()["bpm"] == min(bpm)
    real = M.transition_score(placed, ["grp"]).first()["transition"]
    rng = np.random.default_rng(0)
    shuffled = spark.createDataFrame([(t, int(i), int(p)) for t in range(25) for i, p in enumerate(rng.permutation(12))], "grp int, id long, position int").join(df.drop("grp"), "id")
    random = M.transition_score(shuffled, ["grp"]).agg(F.avg("transition")).first()[0]
    assert 0 <= random <= 1 and real >= random - 1e-3


def test_greedy_ties_and_limits(spark):
    ones = np.ones((4, 3))
    assert O.greedy(ones, np.array([130.0, 120.0, 120.0, 130.0]), np.array([0, 0, 0, 0]), O.WEIGHTS) == [1, 2, 0, 3]
    assert O.greedy(ones[:0], np.array([]), np.array([], int), O.WEIGHTS) == []
    with pytest.raises(ValueError, match="finite"):
        O.greedy(ones * np.nan, np.ones(4), np.zeros(4, int), O.WEIGHTS)
    single = spark.createDataFrame([(1, 0, [1.0], 120.0, "Cm")], "id long, grp int, vector array<double>, bpm double, key string")
    assert M.transition_score(single.withColumn("position", F.lit(0)), ["grp"]).first()["transition"] == 1.0


def test_catalog_operators(spark):
    base = spark.createDataFrame([(1, "A - B.mp3", 10.0), (2, "C.mp3", None), (3, "D  e.MP3", 40.0)], "track_uid long, filename string, duration_s double")
    assert [(r["track_uid"], r["artist"], r["title"]) for r in C.build_catalog(base).collect()] == [(1, "A", "B"), (3, "", "D  e")]
    assert [r["reason"] for r in C.manifest(base).orderBy("track_uid").collect()] == ["too short", "unreadable", None]
    meta = spark.createDataFrame([(" d E.wav", 1.0, "x"), ("d e", 2.0, "y")], "filename string, duration_s double, tag string")
    joined = C.merge_metadata(base, meta)
    assert joined.columns == [*base.columns, "duration_s_meta", "tag"] and joined.filter("track_uid = 3").count() == 2
    assert C.merge_metadata(base, meta, unique=True).count() == 3
    assert C.update_columns(base, spark.createDataFrame([(1, 99.0)], "track_uid long, duration_s double"), "track_uid").orderBy("track_uid").first()["duration_s"] == 99.0
    ids = spark.range(100).withColumnRenamed("id", "track_uid")
    shards = [sorted(r[0] for r in C.stride_shard(ids, "track_uid", s, 4).select("track_uid").collect()) for s in range(4)]
    assert shards == [list(range(s, 100, 4)) for s in range(4)] and C.stride_shard(ids.limit(0), "track_uid", 0, 4).count() == 0
    twice = C.merge_shards([ids.limit(3), ids.limit(3)])
    assert twice.count() == 6 and C.merge_shards([ids.limit(3), ids.limit(3)], "track_uid").count() == 3


def test_names_of_clusters(spark):
    results = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (3, 0, -1), (4, 1, -1), (5, -1, -1), (6, 0, 1)], "track_uid long, label_l1 int, label_l2 int")
    catalog = spark.createDataFrame([(1, "E---House"), (2, "E---House"), (3, "Techno"), (6, "Techno"), (4, " ")], "track_uid long, genre string")
    names = {r["key"]: r["name"] for r in N.cluster_names(results, catalog, "track_uid").collect()}
    assert names == {"l1_-1": "Noise", "l1_0": "House / Techno", "l1_0_l2_-1": "A_Noise", "l1_0_l2_0": "A1 House", "l1_0_l2_1": "A2 Techno", "l1_1": "Group B", "l1_1_l2_0": "B1"}


def test_export_holds_every_track(spark):
    ordered = spark.createDataFrame([(i, a, b, p, f"a{i} - t{i}.mp3", f"a{i}", f"t{i}", i) for i, (a, b, p) in enumerate([(0, 0, 1), (0, 0, 0), (0, -1, 0), (1, -1, 1), (1, -1, 0), (-1, -1, 1), (-1, -1, 0)])], "track_uid long, label_l1 int, label_l2 int, position int, filename string, artist string, title string, order long")
    names = spark.createDataFrame([("l1_0", "House / Techno"), ("l1_0_l2_0", "A1 House"), ("l1_1_l2_0", "B1")], "key string, name string")
    lists = X.playlists(ordered, names)
    summary = {(r["folder"], r["file"]): (r["n"], r["line"]) for r in X.summary(lists).collect()}
    assert {k: v[0] for k, v in summary.items()} == {("", "All_Noise.m3u"): 2, ("L1_A_House _ Techno", "L2_A1 House.m3u"): 1 + 1, ("L1_A_House _ Techno", "L2_A_Noise.m3u"): 1, ("L1_B_Group_1", "L2_B1.m3u"): 2}
    assert summary["L1_B_Group_1", "L2_B1.m3u"][1] == "L1_B (all)   | L2_B1.m3u                           |    2 tracks"
    lines = X.m3u_lines(lists, "D:\\M\\")
    by = {k: [r["line"] for r in sorted(g, key=lambda r: r["seq"])] for k, g in itertools.groupby(sorted(lines.collect(), key=lambda r: (r["folder"], r["file"])), key=lambda r: (r["folder"], r["file"]))}
    assert all(x[0] == "#EXTM3U" for x in by.values()) and sum(len(x) // 2 for x in by.values()) == 7
    assert by["L1_A_House _ Techno", "L2_A1 House.m3u"] == ["#EXTM3U", "#EXTINF:-1,a1 - t1", "D:\\M\\a1 - t1.mp3", "#EXTINF:-1,a0 - t0", "D:\\M\\a0 - t0.mp3"]
    assert by["", "All_Noise.m3u"][1] == "#EXTINF:-1,a5 - t5"  # noise keeps its order
    assert X.check_total(lists, 7) and X.next_version(spark.createDataFrame([("V4_2",), ("V4_10",), ("V4_x",)], "name string")) == 11


def test_tree(spark):
    rows = spark.createDataFrame([("B", "b2", "t1"), ("B", "b1", "t3"), ("B", "b1", "t2"), ("Noise", "Noise", "z"), ("C", "Noise", "q"), ("C", "x", "r")], "folder_l1 string, folder_l2 string, track string")
    lines = [r["line"] for r in N.tree_lines(rows).orderBy("noise_1", "folder_1", "noise_2", "folder_2", "depth", "leaf").collect()]
    assert lines == ["├── B (3 tracks)", "│   ├── b1 (2 tracks)", "│   │   ├── t2", "│   │   └── t3", "│   └── b2 (1 tracks)", "│       └── t1", "├── C (2 tracks)", "│   ├── x (1 tracks)", "│   │   └── r", "│   └── Noise (1 tracks)", "│       └── q", "└── Noise (1 tracks)", "    └── Noise (1 tracks)", "        └── z"]


def test_projection_head(spark):
    head = ProjectionHead.random(1024, 512, 256)
    y = head.forward(np.random.default_rng(0).standard_normal((16, 1024)))
    assert y.shape == (16, 256) and np.allclose(np.linalg.norm(y, axis=1), 1, atol=1e-5)
    small = ProjectionHead.random(6, 5, 4)
    x, _ = blobs(2, 3)
    assert np.allclose([r["vector"] for r in small.apply(table(spark, x)).orderBy("id").collect()], small.forward(x))
    with pytest.raises(NotImplementedError):
        ContrastiveTrainer(head).train_epoch()


def test_older_generations(spark):
    x, truth = blobs(3, 14)
    df = table(spark, x, label_l1=[int(t) for t in truth])
    plane = L.level1_on_plane(df.select("id", "vector"), 4, 2).collect()
    assert len(plane) == 42 and {"id", "label", "x", "y"} == set(plane[0].asDict())
    out = L.level2_in_clusters(df.union(spark.createDataFrame([(99, [0.0] * 6, -1)], df.schema))).collect()
    assert {r["composite"] for r in out if r["id"] == 99} == {"Noise"} and len(out) == 43
    assert all(r["composite"][0] == "ABC"[truth[r["id"]]] for r in out if r["id"] != 99)
    assert L.small_hdbscan(x[:2]).tolist() == [0, 0]


def test_every_document_has_its_uids(spark):
    import hashlib

    from corvane.plans.catalog_queries import track_uids

    root = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text", "source").collect()
    expected = {}
    for doc, text, source in rows:
        b = text.encode()
        expected[doc] = (hashlib.sha256(b).hexdigest(), hashlib.sha256(b[:64] + str(len(b)).encode()).hexdigest(), hashlib.sha1(f"{source}/{doc}".encode()).hexdigest(), hashlib.md5(b).hexdigest()[:8])
    assert any(not r["text"][:64].isascii() for r in rows)
    assert {r["doc_id"]: tuple(r)[1:] for r in track_uids(spark, root).collect()} == expected


def test_marks_and_labels_come_from_all_events(spark, tmp_path):
    from datetime import datetime

    from corvane.plans.catalog_queries import checkpoint_marks, cluster_sort

    rows = [(i, i % 3 + 6, "late" if i > 900 else "early", datetime(2024, 1, 1)) for i in range(990)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    last, expected = {}, set()
    for event, user, *_ in rows:
        mark = event if (event + 1) % 25 == 0 else None
        last[user] = event if mark is not None else last.get(user)
        expected.add((user, event, mark, last[user]))
    assert {tuple(r) for r in checkpoint_marks(spark, str(tmp_path)).collect()} == expected
    labels = [r["label"] for r in cluster_sort(spark, str(tmp_path)).orderBy("place").collect()]
    assert {"early", "late", "Noise"} < set(labels) and len(labels) == len(set(labels)) == 26


def test_genres_are_voted_by_their_simple_names(spark):
    raw = ["X---House"] * 3 + ["Y---House"] * 2 + ["X---Techno", "Z--- ", "", None]
    df = spark.createDataFrame([(0, g) for g in raw], "label_l1 int, genre string")
    from corvane.operators import naming as N

    assert N.top_genres(df, ["label_l1"]).first()["genres"] == "House / Techno"
    named = spark.createDataFrame([("A", "X---Drum_n_Bass"), ("A", "X---Drum_n_Bass"), ("A", "Y---Dub")], "letter string, genre string")
    assert N.genre_folders(named, "letter", "genre").first()["folder"] == "Drum_n_Bass_[Drum_n_Bass_Dub]"


def test_majority_takes_the_smaller_name_on_ties(spark):
    from corvane.operators import naming as N

    df = spark.createDataFrame([(1, "abc"), (1, "ab"), (2, "b"), (2, "b"), (2, "a"), (3, None)], "g int, v string")
    assert {r["g"]: r["v"] for r in N.majority(df, "g", "v").collect()} == {1: "ab", 2: "b"}


def test_two_levels_cluster_directions(spark):
    """Lengths don't matter, and large clusters are reduced by components of their own."""
    rng = np.random.default_rng(5)
    axes = np.linalg.qr(rng.standard_normal((12, 12)))[0]
    rows = []
    for i in range(60):
        top, sub = i % 2, i // 2 % 2
        scale = 10.0 ** rng.integers(-2, 3)
        perc = axes[top] + 0.02 * rng.standard_normal(12)
        full = axes[2 + top] + 0.8 * axes[4 + sub] + 0.02 * rng.standard_normal(12)
        rows.append((f"t{i:02}", (scale * perc).tolist(), (scale * full).tolist()))
    out = L.two_levels(spark.createDataFrame(rows, "id string, perc array<double>, full array<double>"), L.HDBSCAN(6, 1), L.HDBSCAN(4, 2), pca=3).orderBy("id").collect()
    assert same_partition([r["label_l1"] for r in out], [i % 2 for i in range(60)])
    for top in (0, 1):
        some = [i for i in range(60) if i % 2 == top]
        assert same_partition([out[i]["label_l2"] for i in some], [i // 2 % 2 for i in some])


def test_places_and_manifests_must_match(spark):
    ids = spark.createDataFrame([(0, "a"), (1, "b")], "row_idx long, uid string")
    rows = spark.createDataFrame([(0, 0.5), (1, 1.5)], "row_idx long, x double")
    assert sorted((r["uid"], r["x"]) for r in C.zipped(ids, rows).collect()) == [("a", 0.5), ("b", 1.5)]
    with pytest.raises(ValueError, match="2 ids for 1 rows"):
        C.zipped(ids, rows.limit(1))
    with pytest.raises(ValueError, match="1 of them"):
        C.with_manifest(ids, ids.filter("uid = 'a'").select("uid"), "uid")
    kept = C.in_list_order(ids, ids.filter("uid = 'a'").select("uid", F.lit(7).alias("n")), "uid", keep_missing=True).collect()
    assert [(r["uid"], r["n"]) for r in kept] == [("a", 7), ("b", None)]


def test_report_of_an_evaluation():
    scores = {"n_tracks": 12, "n_clusters": 2, "noise_rate_l1": 0.25, "cluster_sizes": {"10": 4, "2": 5}, "per_cluster": {"10": {"n_subclusters": 3, "noise_rate_l2": 0.5}}, "ari": 0.5, "composite": 0.5}
    assert M.report(scores).splitlines() == ["12 tracks in 2 clusters, 25.0% noise", "cluster 2: 5 tracks, 1 subclusters, 0% noise within", "cluster 10: 4 tracks, 3 subclusters, 50% noise within", "ari: 0.5000", "composite: 0.5000"]
    assert M.report({"n_tracks": 0, "n_clusters": 0, "noise_rate_l1": None, "cluster_sizes": {}, "per_cluster": {}}) == "0 tracks in 0 clusters, 0.0% noise"
