from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from corvane.functions import colours, hashing, keys, segments, text, vectors


def values(spark, rows, schema, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_names(spark):
    names = [("Artist - Title - Mix.mp3",), ("Only Title.wav",), (".hidden",), ("a.b.c",), ("  Two   Words .MP3",), ("x -y.flac",)]
    assert values(spark, names, "n string", text.stem("n")) == ["Artist - Title - Mix", "Only Title", ".hidden", "a.b", "  Two   Words ", "x -y"]
    assert values(spark, names, "n string", text.artist("n"), text.title("n"))[:2] == [("Artist", "Title - Mix"), ("", "Only Title")]
    assert values(spark, names, "n string", text.normalized_filename("n"))[4] == "two words"
    assert values(spark, names, "n string", text.extension("n")) == [".mp3", ".wav", "", ".c", ".MP3", ".flac"]


def test_letters(spark):
    expected = {-1: "Noise", 0: "A", 25: "Z", 26: "AA", 51: "AZ", 52: "BA", 701: "ZZ", 702: "AAA", 728: "ABA", 18277: "ZZZ"}
    assert values(spark, [(k,) for k in expected], "n int", text.letters("n")) == list(expected.values())
    assert values(spark, [("A",), ("Z",), ("Noise",)], "n string", text.letter_label("n")) == [0, 25, -1]
    assert values(spark, [("A", 0)], "a string, n int", text.subcluster_label("a", "n")) == ["A1"]


def test_labels_and_paths(spark):
    rows = [("A", "T", "f.mp3"), (" ", "T", "f.mp3"), (None, None, "x.y.mp3"), (None, "T", None)]
    assert values(spark, rows, "a string, t string, f string", text.track_label("a", "t", "f")) == ["A - T", "f", "x.y", "Unknown"]
    assert values(spark, rows[:1], "a string, t string, f string", text.windows_path("D:\\M\\/", "f")) == ["D:\\M\\f.mp3"]
    assert values(spark, [('a/b:c*"d" ' + "x" * 60,), ("  ",)], "n string", text.safe_dirname("n")) == ['a_b_c__d_ ' + "x" * 40, ""]
    assert values(spark, [("Electronic---House",), ("Jazz",), ("",), (None,)], "g string", text.simple_genre("g")) == ["House", "Jazz", "", ""]
    assert values(spark, [(0.0,), (59.9,), (3725.0,)], "s double", text.clock("s")) == ["0:00", "0:59", "62:05"]
    assert values(spark, [("a.mp3.wav",)], "n string", text.without_audio_extension("n")) == ["a"]
    assert values(spark, [(-1,), (7,), (123,)], "n int", text.cluster_name("n")) == ["Noise", "Cluster_07", "Cluster_123"]


def test_camelot(spark):
    # each spelling with its hour; what isn't understood is "?"
    expected = {"C minor": "5A", "F# minor": "11A", "G major": "9B", "Cm": "5A", "Ebm": "2A", "G": "9B", "5A": "5A", "12B": "12B", "99A": "99A", "Gmaj": "?", "Cmin": "?", "?": "?", "": "?", "nan": "?", "H minor": "?", " C minor ": "5A", "C MINOR": "5A", "Am": "8A", "am": "?"}
    assert dict(zip(expected, values(spark, [(k,) for k in expected], "k string", keys.camelot("k")), strict=True)) == expected
    assert values(spark, [(None,)], "k string", keys.camelot("k")) == ["?"]


@pytest.mark.parametrize(("a", "b", "score"), [("Cm", "Cm", 1.0), ("Cm", "Eb", 1.0), ("Cm", "Gm", 0.5), ("Cm", "F#m", 0.0), ("8A", "8A", 1.0), ("C minor", "Cm", 0.0), ("D#", "D#", 0.0), ("Abm", "G#m", 1.0), ("Am", "Dm", 0.5)])
def test_metrics_flavour(spark, a, b, score):
    assert values(spark, [(a, b)], "a string, b string", keys.metrics_compatibility("a", "b")) == [score]


@pytest.mark.parametrize(("a", "b", "score"), [("5A", "5B", 1.0), ("12A", "1B", 0.5), ("5A", "7A", 0.0), ("?", "5A", 0.5), (None, "5A", 0.5), ("", "", 0.5)])
def test_ordering_flavour(spark, a, b, score):
    assert values(spark, [(a, b)], "a string, b string", keys.ordering_compatibility("a", "b")) == [score]


def test_vectors(spark):
    rows = [([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])]
    schema = "a array<double>, b array<double>"
    assert values(spark, rows, schema, vectors.normalized("a")) == [[0.6, 0.8], [0.0, 0.0]]
    assert values(spark, rows, schema, vectors.cosine("a", "b"))[0] == pytest.approx(0.96)
    assert values(spark, [(None, [1.0])], schema, vectors.cosine("a", "b")) == [None]
    assert values(spark, rows, schema, vectors.finite("a")) == [True, True]
    assert values(spark, [([1.0, float("nan")], [])], schema, vectors.finite("a")) == [False]
    assert values(spark, rows[:1], schema, vectors.cropped("a", 3)) == [[3.0, 4.0, 0.0]]
    assert values(spark, [([[1.0, 3.0], [3.0, 5.0]],)], "c array<array<double>>", vectors.mono("c")) == [[2.0, 4.0]]
    layers = [[9.0, 9.0], [1.0, 3.0], [3.0, 5.0]]
    assert values(spark, [(layers,), (layers[:1],)], "c array<array<double>>", vectors.last_layers("c", 2)) == [[2.0, 4.0], [9.0, 9.0]]


def test_hashes(spark):
    body = F.col("t").cast("binary")
    got = values(spark, [("héllo world",)], "t string", hashing.track_uid(body), hashing.fast_track_uid(body, 4), hashing.track_id(F.col("t")))
    raw = "héllo world".encode()
    assert got == [(hashlib.sha256(raw).hexdigest(), hashlib.sha256(raw[:4] + str(len(raw)).encode()).hexdigest(), hashlib.sha1(raw).hexdigest())]
    a, b = {"x": 1, "config_tag": "a"}, {"config_tag": "b", "x": 1}
    assert len(hashing.clustering_hash(a)) == 8 and hashing.clustering_hash(a) != hashing.clustering_hash(b)
    assert hashing.manifest_hash(a) != hashing.clustering_hash(a)


def starts(total, zones=((0.0, 0.15, 1), (0.35, 0.65, 2), (0.85, 1.0, 1)), seg=5 * 100):
    out = []
    for lo, hi, n in zones:
        a, b = int(lo * total), int(hi * total)
        out += [a + (b - a) // 2 - seg // 2] if n == 1 else [a + i * ((b - a - seg) // (n - 1)) for i in range(n)]
    return [max(0, min(s, total - 1)) for s in out]


def test_segment_starts(spark):
    totals = [(10,), (501,), (4000,), (123457,)]
    assert values(spark, totals, "n long", segments.zone_starts(F.col("n"), 100)) == [starts(n) for (n,) in totals]
    ticks = [float(20 * i) for i in range(40)]
    assert values(spark, [(ticks,)], "t array<double>", segments.bar_samples(F.col("t"))) == [80]
    assert values(spark, [(1000, 80)], "n long, b long", segments.bar_starts(F.col("n"), F.col("b"))) == [[0, 5 * 80, 6 * 80, 11 * 80]]
    mode = segments.beat_mode(F.col("t"), F.col("b"), F.col("c"))
    assert values(spark, [(ticks, 120.0, None), (ticks, 120.0, 0.4), (ticks[:31], 120.0, 0.9), (ticks, None, 0.9)], "t array<double>, b double, c double", mode) == [True, False, False, False]


def test_colours(spark):
    import colorsys

    def shade(base, index, total):
        if total <= 1:
            return base
        r, g, b = (int(base[i : i + 2], 16) / 255 for i in (1, 3, 5))
        h, light, s = colorsys.rgb_to_hls(r, g, b)
        light = max(0.2, min(0.8, light + (index - 1) * 0.08 * (1 if index % 2 == 0 else -1)))
        return "#" + "".join(f"{int(c * 255):02x}" for c in colorsys.hls_to_rgb((h + (index - 1) * 0.05) % 1.0, light, s))

    cases = [(b, i, n) for b in (*colours.BASE.values(), colours.OTHER, "#000000", "#ffffff") for i, n in ((1, 1), (1, 3), (2, 3), (3, 3), (9, 9))]
    got = values(spark, cases, "b string, i int, n int", colours.shaded(F.col("b"), F.col("i"), F.col("n")))
    close = [sum(abs(int(a[k : k + 2], 16) - int(b[k : k + 2], 16)) for k in (1, 3, 5)) for a, b in zip(got, (shade(*c) for c in cases), strict=True)]
    assert max(close) <= 1  # a channel right on a boundary may round the other way
    assert values(spark, [("A",), ("ZZ",)], "l string", colours.base_colour(F.col("l"))) == ["#ab63fa", "#888888"]
