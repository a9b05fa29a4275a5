from __future__ import annotations

import json
import math
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import extract as E
from corvane.plans import settings
from corvane.plans.pipeline import Engine
from corvane.sources import files
from corvane.streaming import events as S


def tone(path, hertz, seconds=1.0, rate=8000, channels=1):
    n = int(seconds * rate)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"".join(struct.pack("<h", int(12000 * math.sin(2 * math.pi * hertz * i / rate))) * channels for i in range(n)))


@pytest.fixture(scope="module")
def audio(tmp_path_factory):
    folder = tmp_path_factory.mktemp("audio")
    for i in range(24):
        tone(folder / f"Artist {i % 3} - Song {i}.{'WAV' if i % 2 else 'wav'}", (150, 900, 2500)[i % 3] * (1 + i / 400))
    (folder / "broken.wav").write_bytes(b"not audio")
    (folder / "empty.wav").write_bytes(b"")
    (folder / "notes.txt").write_text("no")
    return str(folder)


def test_scan_and_probe(spark, audio):
    assert files.scan_audio(spark, audio).count() == 25  # Spark itself passes over files without bytes
    catalog = files.catalog_from_audio(spark, audio).collect()
    assert len(catalog) == 24 == len({r["track_uid"] for r in catalog}) and all(len(r["track_uid"]) == 64 and r["duration_s"] == 1.0 for r in catalog)
    assert {r["artist"] for r in catalog} == {"Artist 0", "Artist 1", "Artist 2"}
    assert files.catalog_from_audio(spark, audio, fast=True).first()["track_uid"] != catalog[0]["track_uid"]


def test_decode_keeps_errors(spark, audio):
    rows = files.decode(files.scan_audio(spark, audio, content=True), 4000).collect()
    good = [r for r in rows if r["error"] is None]
    assert len(good) == 24 and all(len(r["samples"]) == 4000 and max(r["samples"]) <= 1 for r in good) and len(rows) == 25


def test_phases_end_to_end(spark, audio, tmp_path):
    engine = Engine(spark, "demo", settings.merged(settings.DEFAULTS, {"clustering": {"pca_dim": 0, "l1_min_cluster_size": 4}}), str(tmp_path))
    with pytest.raises(files.MissingArtifact, match="run ingest"):
        engine.extract()
    assert engine.ingest(audio).count() == 24
    assert engine.extract().count() == 24 and engine.extract().count() == 24  # nothing left on the second run
    report = engine.merge()
    assert (report["n_tracks_merged"], report["missing"], report["extra"]) == (24, 0, 0)
    results = engine.cluster()
    assert results.count() == 24 and results.filter("label_l1 = -1").isEmpty()
    assert engine.name().filter("trim(name) = ''").isEmpty()
    ordered = engine.order()
    assert ordered.filter("position is null or position < 0").isEmpty()
    summary = engine.export("D:\\Music")
    assert summary.agg(F.sum("n")).first()[0] == 24
    lists = list((tmp_path / "demo" / "playlists" / "V4_1").rglob("*.m3u"))
    assert lists and all(p.read_text(encoding="utf-8").startswith("#EXTM3U\n") for p in lists)
    assert sum((len(p.read_text(encoding="utf-8").splitlines()) - 1) // 2 for p in lists) == 24
    scores = engine.evaluate()
    assert scores["n_tracks"] == 24 and scores["composite"] == 0.0 and json.loads((tmp_path / "demo" / f"scores_{engine.tag()}.json").read_text())["n_clusters"] >= 1
    assert engine.tag("a") != engine.tag("b")


def test_extract_reports_bad_tracks(spark):
    class Picky:
        def __call__(self, samples):
            if len(samples) == 0:
                raise ValueError("no samples")
            return E.SpectralStub(8)(samples)

    rows = spark.createDataFrame([("a", [0.1, 0.2]), ("b", [])], "track_uid string, samples array<float>")
    good, bad = E.split_errors(E.extract(rows, Picky))
    assert [r["track_uid"] for r in good.collect()] == ["a"] and bad.first()["error"] == "no samples"


def test_pooling(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 6.0]), ("b", [1.0, 1.0])], "track_uid string, vector array<double>")
    got = {r["track_uid"]: r["vector"] for r in E.pooled(rows, "mean_std").collect()}
    assert got == {"a": [2.0, 4.0, 1.0, 2.0], "b": [1.0, 1.0, 0.0, 0.0]}
    assert {r["track_uid"]: r["vector"] for r in E.pooled(rows).collect()}["a"] == [2.0, 4.0]
    with pytest.raises(ValueError, match="unknown method"):
        E.pooled(rows, "max")


def test_numpy_source(spark, tmp_path):
    m = np.arange(30, dtype=np.float32).reshape(10, 3)
    np.save(tmp_path / "m.npy", m)
    spark.dataSource.register(files.NumpySource)
    df = spark.read.format("npy").option("rows", 4).load(str(tmp_path / "m.npy"))
    assert [r["vector"] for r in df.orderBy("row_idx").collect()] == m.tolist()
    assert files.check_matrix(df, "vector", 3).first().asDict() == {"n": 10, "shaped": True, "finite": True}


def test_csv(spark, tmp_path):
    rows = spark.createDataFrame([('a, "b".mp3', 1)], "track string, cluster int")
    files.write_csv(rows, str(tmp_path / "csv"))
    assert files.read_csv(spark, str(tmp_path / "csv"), ("track", "cluster"), "track string, cluster int").collect() == rows.collect()
    with pytest.raises(ValueError, match="lacks columns: genre"):
        files.read_csv(spark, str(tmp_path / "csv"), ("genre",))


def test_latest(spark):
    rows = spark.createDataFrame([("a", 1, 0.0), ("a", 1, 0.5), ("b", 9, 0.0)], "path string, mtime int, umap_x double")
    assert files.latest_with_map(rows).first()[0] == "a" and files.latest_with_map(rows.filter("path = 'b'")).first()[0] == "b"
    assert files.latest(rows, time="mtime").first()[0] == "b"


def test_discovery(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name / "features").mkdir(parents=True)
        (tmp_path / name / "features" / "part.parquet").write_bytes(b"x")
    (tmp_path / "three").mkdir()
    assert sorted(r[0] for r in files.discover_datasets(spark, str(tmp_path)).collect()) == ["one", "two"]


def test_settings(monkeypatch):
    monkeypatch.setenv("PLACE", "/x")
    assert settings.expand({"a": ["${PLACE}/y", "${NOT_SET_ANYWHERE}"], "b": 3}) == {"a": ["/x/y", "${NOT_SET_ANYWHERE}"], "b": 3}
    assert settings.first_set(None, 0, 5) == 0
    assert settings.artifact_root({}, "given") == "given"
    monkeypatch.setenv("CORVANE_ARTIFACTS", "env")
    assert settings.artifact_root({"paths": {"artifacts_root": "yaml"}}) == "env"
    assert settings.merged(settings.DEFAULTS, {"clustering": {"pca_dim": 3}})["clustering"]["l1_min_samples"] == 1


def log(spark, minutes, status="ok"):
    rows = [(f"2024-01-01T00:{m:02d}:00Z", "P1", "d", "track", f"t{m % 4}", status, float(m)) for m in minutes]
    return spark.createDataFrame(rows, "timestamp_utc string, phase string, dataset_name string, event_type string, track_uid string, status string, duration_ms double")


def test_event_log(spark, tmp_path):
    folder = str(tmp_path / "log")
    S.append_events(log(spark, [1, 2]).coalesce(1), folder)
    S.append_events(log(spark, [7]).coalesce(1), folder)
    assert S.read_events(spark, folder).count() == 3
    query = S.upsert(S.stream_events(spark, folder, 1), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    S.append_events(log(spark, [9]).coalesce(1), folder)
    query = S.upsert(S.stream_events(spark, folder, 1), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    query = S.incremental_catalog(S.stream_events(spark, folder)).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["track_uid"] for r in spark.sql("select * from once").collect()} == {"t1", "t2", "t3"} and spark.sql("select * from once").count() == 3


def test_windows_and_retries(spark):
    rows = S.with_time(log(spark, [0, 1, 2, 6, 30]))
    assert sorted((r["window"]["start"].minute, r["n"]) for r in S.rates(rows).collect()) == [(0, 3), (5, 1), (30, 1)]
    assert sorted(r["n"] for r in S.sessions(rows).collect()) == [1, 4]
    todo = spark.createDataFrame([("t0",), ("t1",), ("t3",)], "track_uid string")
    assert {r[0] for r in S.failed_to_retry(todo, log(spark, [0]).unionByName(log(spark, [1], "failed"))).collect()} == {"t1", "t3"}
