from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
from messy_tables import with_clashes
from pyspark.sql import functions as F

from corvane.llm import ann, mixing, quality
from corvane.llm.queries import url_rules
from corvane.llm.url_filter import ALLOW, BLOCK, HostRule, ShiftAnd, judge


def slow_glob(glob: str, s: str) -> bool:
    out = "".join("(?s:.*)" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in re.split(r"(\*\*|\*)", glob))
    return re.fullmatch(out, s) is not None


def test_automaton_against_patterns():
    rng = random.Random(1)
    globs = ["".join(rng.choices(["a", "b", "/", ".", "*", "**"], k=rng.randint(1, 12))) for _ in range(60)] + ["", "*", "**", "a" * 70 + "**"]
    globs = [g.replace("***", "**").replace("***", "**") for g in globs]
    strings = ["".join(rng.choices("ab/.", k=rng.randint(0, 14))) for _ in range(300)] + ["a" * 71, "a" * 70]
    got = ShiftAnd(globs).match([s.encode() for s in strings])
    for j, g in enumerate(globs):
        if "***" in g:
            continue
        assert got[:, j].tolist() == [slow_glob(g, s) for s in strings], g


def test_urls(spark):
    cases = [
        (1, "https://www.Example.com/en/7?x", "www.example.com", "/en/7", "example.com/en/7", ALLOW),
        (2, "http://x.com/en/", "x.com", "/en/", "com/en/", BLOCK),
        (3, "http://com/en/1", "com", "/en/1", "com/en/", BLOCK),
        (4, "http://telecom/en/1", "telecom", "/en/1", None, ALLOW),
        (5, "http://a.example.net/de/81", "a.example.net", "/de/81", "example.net/de/8", BLOCK),
        (6, "http://a.net/de/9#f", "a.net", "/de/9", "net/de/", ALLOW),
        (7, "http://evil.org/x.com/en/", "evil.org", "/x.com/en/", None, ALLOW),
        (8, None, "", "", None, ALLOW),
        (9, "no scheme/en/", "", "", None, ALLOW),
        (10, "http://a.com", "a.com", "", None, ALLOW),
        (11, "http://a.com?q=/en/", "a.com", "", None, ALLOW),
        (12, "x://big.casino-win.org/es/1", "big.casino-win.org", "/es/1", "org/es/", BLOCK),
        (13, "x://big.casino-win.org", "big.casino-win.org", "", None, BLOCK),
        (14, "x://y://z.org/es/", "y:", "//z.org/es/", None, ALLOW),
        (15, "http://a.com/en/" + "long" * 5000, "a.com", "/en/" + "long" * 5000, "com/en/", BLOCK),
        (16, "", "", "", None, ALLOW),
        (None, "HTTP://ÀB.NET/de/8\nx", "ÀB.NET".replace("B.NET", "b.net"), "/de/8\nx", "net/de/", ALLOW),
    ]
    pages = spark.createDataFrame([c[:2] for c in cases] + [cases[0][:2]], "page_id long, url string").withColumns({c: F.lit(0) for c in ("host", "path", "rule", "verdict", "html")})
    out = judge(pages, url_rules()).collect()
    assert sorted(map(tuple, out), key=str) == sorted([(c[0], *c[2:]) for c in [*cases, cases[0]]], key=str)
    assert judge(pages.limit(0), url_rules()).count() == 0


def test_first_of_equal_rules_wins(spark):
    pages = spark.createDataFrame([(1, "x://a.b/c")], "page_id long, url string")
    assert judge(pages, [HostRule(BLOCK, "b", "/c"), HostRule(ALLOW, "b", "/c")]).first()["verdict"] == BLOCK


def test_schedule_keeps_within_one_block():
    for parts in ({"a": 5, "b": 3, "c": 1, "d": 1}, {"a": 1}, {f"s{i}": i % 7 + 1 for i in range(20)}, {"a": 97, "b": 1, "c": 2}):
        order, total = mixing.pfair_period(parts), sum(parts.values())
        assert {k: order.count(k) for k in parts} == parts
        for k, n in parts.items():
            had = np.cumsum([x == k for x in order])
            assert (np.abs(had - n * np.arange(1, total + 1) / total) < 1).all()


def slow_mix(rows, parts, default, block):
    import hashlib

    groups = {}
    for doc, source in rows:
        groups.setdefault(source, []).append(doc)
    names = sorted(groups, key=lambda s: (s is not None, s or ""))
    order = mixing.pfair_period({("n" if s is None else f"s{s}"): parts.get(s, default) for s in names})
    key = {("n" if s is None else f"s{s}"): s for s in names}
    left = {s: sorted(d, key=lambda x: (x is None, hashlib.md5(str(x).encode()).hexdigest(), x or 0)) for s, d in groups.items()}
    out, t = [], 0
    while any(left.values()):
        s = key[order[t % len(order)]]
        out += [(d, s, t) for d in left[s][:block]]
        left[s] = left[s][block:]
        t += 1
    return out


def test_mixing_against_the_schedule(spark, messy):
    docs = with_clashes(messy)
    out = mixing.mix(docs, {"hot": 3, "a": 2}, block=4, rows_per_bucket=5).orderBy("position").collect()
    rows = [(r["doc_id"], r["source"]) for r in messy.collect()]
    assert [(r["doc_id"], r["source"], r["slot"]) for r in out] == slow_mix(rows, {"hot": 3, "a": 2}, 1, 4)
    assert [r["position"] for r in out] == list(range(len(rows)))
    assert set(out[0].asDict()) == set(docs.columns)
    other = mixing.mix(docs, {"hot": 3, "a": 2}, block=4, names=("p", "q", "r"))
    assert other.columns == [*docs.columns, "p", "q", "r"] and other.first()["position"] == "extra position"


def test_mixing_nothing(spark, nothing):
    assert mixing.mix(nothing, {"a": 1}).count() == 0
    with pytest.raises(ValueError, match="positive"):
        mixing.schedule({"a": 0}, ["a"], 1)


def slow_features(text: bytes) -> list[int]:
    """The buckets of a text's features, one at a time in plain integers."""
    mask = (1 << 64) - 1

    def bucket(h: int) -> int:
        h = h * 0x9E3779B97F4A7C15 & mask
        h ^= h >> 29
        return (h * 0xBF58476D1CE4E5B9 & mask) >> 47

    words = re.findall(rb"[^\x20\x09-\x0D]+", text)
    out = [0 for a, b in zip(words, words[1:], strict=False) if a == b]
    for w in words:
        out.append(bucket((sum((c + 0x51ED) * pow(0x100000001B3, i + 1, 1 << 64) for i, c in enumerate(w)) + len(w) * 0xC2B2AE3D27D4EB4F) & mask))
        bounded = b"\0" + w + b"\0"
        out += [bucket(int.from_bytes(bounded[i : i + n], "big") + (n << 56) & mask) for n in (3, 4, 5) for i in range(len(bounded) - n + 1)]
    return out


def test_features_cover_whole_texts(monkeypatch):
    texts = [b"ab abc ab ab", b"", b" x", "é日 é日".encode(), b"a" * 50, b"one  two\n\nthree"]
    for chunk in (1 << 20, 12):
        monkeypatch.setattr(quality, "_CHUNK", chunk)
        got = [[] for _ in texts]
        for place, bucket in quality.features(texts):
            for k, b in zip(place.tolist(), bucket.tolist(), strict=True):
                got[k].append(b)
        assert [sorted(x) for x in got] == [sorted(slow_features(t)) for t in texts]


def test_scores_against_slow_features(spark):
    """Every score is the logistic of the bias and the mean of the table over the slow features."""
    rows, docs, labels = labelled(spark)
    model = quality.learn(docs, labels)
    assert model.table.any()
    some = [(i, t) for i, t in rows if len(t or "") < 5000]
    got = quality.score(spark.createDataFrame(some, "doc_id long, text string"), model).collect()
    expected = []
    for i, t in some:
        found = [float(model.table[b]) for b in slow_features((t or "").encode())]
        expected.append((i, 1 / (1 + np.exp(-(model.bias + sum(found) / max(1, len(found)))))))
    got, expected = (sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1])) for x in ([(r["doc_id"], r["score"]) for r in got], expected))
    assert [r[0] for r in got] == [r[0] for r in expected]
    assert np.allclose([r[1] for r in got], [r[1] for r in expected], rtol=0, atol=1e-9)


def labelled(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        words = [f"{rng.choice('bdg')}{rng.choice('aeiou')}{rng.choice('lnr')}" for _ in range(rng.randrange(5, 60))]
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((i, int(good)))
    rows += [(1000, None), (1001, ""), (None, "bal bel"), (1002, "bal " * 200000), (0, rows[0][1])]
    labels += [(None, 1), (5, None), (7, 9), (9, 0), (9, 1), (88888, 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy(spark):
    rows, docs, labels = labelled(spark)
    out = quality.classify(docs.withColumns({c: F.lit(1) for c in ("score", "predicted", "held_out", "quality", "label")}), labels).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    truth = {i: not t.isupper() for i, t in ((i, t or "") for i, t in rows) if i is not None and i < 600}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 100 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.98


def test_labels_of_held_out_rows_change_nothing(spark):
    _, docs, labels = labelled(spark)
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.learn(docs, labels), quality.learn(docs, flipped)
    assert (a.table == b.table).all() and a.bias == b.bias


def test_no_labels_and_no_rows(spark, nothing, messy):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.classify(messy, empty).collect()} == {0.5}
    assert quality.classify(nothing, empty).count() == 0
    assert quality.keep_good(with_clashes(messy), empty, 0.5).columns == with_clashes(messy).columns


def test_neighbours_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2000, 24)) * rng.uniform(0.2, 2, (2000, 1))
    x[1000:1400] = x[0]  # a hot group of copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(20, x[20].tolist()), (None, x[1].tolist()), (4000, None), (4020, [0.0] * 24), (4040, [float("nan")] * 24), (4060, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("list", "block", "rank", "probes", "label")}).repartition(3)
    out = ann.nearest(df).collect()
    every = np.vstack([x, x[20:21]])
    ids = np.append(np.arange(2000), 20)
    hits = total = 0
    by = {}
    for r in out:
        by.setdefault(r["query_id"], []).append(r)
    assert sorted(by) == list(range(0, 2000, 20))
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21)) and q not in {r["vec_id"] for r in found}
        assert [(-r["score"], r["vec_id"]) for r in found] == sorted((-r["score"], r["vec_id"]) for r in found)
        assert all(abs(r["score"] - every[r["vec_id"]] @ x[q]) < 1e-9 for r in found)
        score = np.where(ids == q, -np.inf, every @ x[q])
        kth = np.sort(score)[-20]
        hits += sum(r["score"] >= kth - 1e-9 for r in found)
        total += 20
    assert hits / total >= 0.9


def test_neighbours_over_many_lists(spark, monkeypatch):
    """Some 40 lists, of which not all are probed; a hot list whose vectors and queries go in blocks."""
    for name, value in (("LIST_ROWS", 50), ("BLOCK_ROWS", 64), ("QUERY_ROWS", 16)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 16)) * 3
    x = centres[np.where(rng.random(2000) < 0.3, 0, rng.integers(0, 40, 2000))] + 0.6 * rng.standard_normal((2000, 16))
    fitted = ann.fit(x, float(np.sqrt((x**2).sum(axis=1).max())), len(x), 20)
    assert len(fitted.centroids) >= 32 and fitted.probes < len(fitted.centroids)
    out = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    kth = np.sort(score, axis=1)[:, -20]
    assert len(out) == 2000
    assert sum(r["score"] >= kth[r["query_id"]] - 1e-9 for r in out) / 2000 >= 0.9


def test_every_length_is_searched(spark):
    rows = [(0, [1.0, 0.0]), (1, [3.0, 1.0]), (20, [1.0, 0.0, 0.0]), (21, [2.0, 0.0, 0.0]), (22, [0.5, 0.0, 1.0]), (40, [5.0]), (0, [0.5, 9.0])]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out) == [(0, 1, 1, 10.5), (20, 1, 21, 2.0), (20, 2, 22, 0.5)]


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r["vec_id"]) for r in ann.nearest(df).collect()] == [(1, 2), (2, 3), (3, 1)]
    assert ann.nearest(df.limit(0)).count() == 0 and ann.nearest(df.filter("vec_id = 0")).count() == 0
