"""Readers and writers: audio folders, artifacts, CSV with checks, NumPy matrices, playlists and documents."""

from __future__ import annotations

import io
import json
import os
import re
import wave
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corvane.functions import hashing, text

AUDIO = (".mp3", ".wav", ".flac")


class MissingArtifact(FileNotFoundError):
    """An earlier phase hasn't written what is asked for."""


def scan_audio(spark: SparkSession, folder: str, extensions: tuple[str, ...] = AUDIO, recursive: bool = False, content: bool = False) -> DataFrame:
    """path, length, modificationTime (and content) of audio files, extensions in any case."""
    glob = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e.lstrip(".")) for e in extensions) + "}"
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    files = (reader.option("recursiveFileLookup", "true") if recursive else reader).load(folder)
    return files if content else files.drop("content")


def probe(files: DataFrame) -> DataFrame:
    """Add duration_s and sample_rate from the header of each file's content; null where unreadable."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            seconds, rates = [], []
            for raw in pdf["content"]:
                try:
                    with wave.open(io.BytesIO(raw)) as w:
                        seconds.append(w.getnframes() / w.getframerate())
                        rates.append(w.getframerate())
                except (wave.Error, EOFError, ZeroDivisionError):
                    seconds.append(None)
                    rates.append(None)
            yield pdf[["path", "length", "content"]].assign(duration_s=pd.Series(seconds, dtype="Float64"), sample_rate=pd.Series(rates, dtype="Int32"))

    return files.select("path", "length", "content").mapInPandas(read, "path string, length long, content binary, duration_s double, sample_rate int")


def decode(files: DataFrame, sample_rate: int | None = None) -> DataFrame:
    """path and samples (mono, -1 to 1) of WAV content, resampled linearly if asked; ``error`` where unreadable."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with wave.open(io.BytesIO(raw)) as w:
                        kind = {1: "u1", 2: "<i2", 4: "<i4"}[w.getsampwidth()]
                        x = np.frombuffer(w.readframes(w.getnframes()), kind).astype(np.float64).reshape(-1, w.getnchannels()).mean(axis=1)
                        x = (x - 128) / 128 if kind == "u1" else x / (1 << 8 * w.getsampwidth() - 1)
                        if sample_rate and sample_rate != w.getframerate():
                            n = int(len(x) * sample_rate / w.getframerate())
                            x = np.interp(np.arange(n) * w.getframerate() / sample_rate, np.arange(len(x)), x)
                        out.append((path, x.astype(np.float32), None))
                except (wave.Error, EOFError, KeyError) as e:
                    out.append((path, None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "samples", "error"])

    return files.select("path", "content").mapInPandas(read, "path string, samples array<float>, error string")


def catalog_from_audio(spark: SparkSession, folder: str, fast: bool = False, recursive: bool = False) -> DataFrame:
    """The catalog of a folder: ids by content, names, durations. Files without a duration go."""
    files = probe(scan_audio(spark, folder, recursive=recursive, content=True).filter("length > 0"))
    uid = hashing.fast_track_uid(F.col("content")) if fast else hashing.track_uid(F.col("content"))
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.filter("duration_s is not null").withColumns({"track_uid": uid, "filename": name})
    return rows.select("track_uid", "filename", F.col("path").alias("source_path"), "duration_s", F.col("length").alias("filesize_bytes"), text.artist("filename").alias("artist"), text.title("filename").alias("title"))


def load_parquet(spark: SparkSession, path: str, phase: str, schema: str | None = None) -> DataFrame:
    """A table of an earlier phase, or an error that names the phase to run."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
        raise MissingArtifact(f"{path} is missing: run {phase} first")
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_csv(spark: SparkSession, path: str, required: tuple[str, ...] = (), schema: str | None = None) -> DataFrame:
    """A CSV file with a header; quoted names may hold commas. Missing columns are an error."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    df = (reader.schema(schema) if schema else reader).csv(path)
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise ValueError(f"{path} lacks columns: {', '.join(lacking)}")
    return df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def discover_datasets(spark: SparkSession, root: str, marker: str = "*.parquet") -> DataFrame:
    """One column, ``dataset``: folders directly below ``root`` that hold a file like ``marker``, at any depth."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", marker).load(root).select("path")
    base = root.removeprefix("file://").rstrip("/") + "/"
    rest = F.substring_index("path", base, -1)
    return files.select(F.substring_index(rest, "/", 1).alias("dataset")).distinct()


def latest(files: DataFrame, name: str = "path", time: str = "modificationTime", by: tuple[str, ...] = ()) -> DataFrame:
    """The newest file of a listing, or of each group; of equally new ones the last by name."""
    return files.groupBy(*by).agg(F.max_by(name, F.struct(time, name)).alias(name))


def latest_with_map(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The newest of results files (path, mtime, umap_x), or of each group's, that has a real map, else the newest."""
    per = rows.groupBy(*by, "path").agg(F.max("mtime").alias("mtime"), (F.sum(F.abs("umap_x")) > 0).alias("mapped"))
    return per.groupBy(*by).agg(F.max_by("path", F.struct("mapped", "mtime", "path")).alias("path"))


def check_matrix(rows: DataFrame, vector: str, size: int) -> DataFrame:
    """One row: number of rows, whether all vectors have ``size`` components and all are finite."""
    from corvane.functions.vectors import finite

    return rows.agg(F.count("*").alias("n"), F.coalesce(F.bool_and(F.size(vector) == size), F.lit(True)).alias("shaped"), F.coalesce(F.bool_and(finite(vector)), F.lit(True)).alias("finite"))


class NumpySource(DataSource):
    """``.npy`` matrices: a row per matrix row, read in ranges of a memory map. Option ``path``, and ``rows`` per partition."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "row_idx long, vector array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _NumpyReader(self.options["path"], int(self.options.get("rows", 65536)))


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        super().__init__((lo, hi))
        self.lo, self.hi = lo, hi


class _NumpyReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path.removeprefix("file://"), rows

    def partitions(self) -> list[InputPartition]:
        n = len(np.load(self.path, mmap_mode="r"))
        return [_Range(lo, min(lo + self.rows, n)) for lo in range(0, max(n, 1), self.rows)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        matrix = np.load(self.path, mmap_mode="r")
        for i in range(partition.lo, partition.hi):
            yield i, [float(x) for x in matrix[i]]


def write_playlists(lines: DataFrame, folder: str) -> DataFrame:
    """Write lines (folder, file, seq, line) to one exactly named file each; returns folder, file and the lines written.

    A playlist fits a task. Files are written by the tasks, to a path that all of them see.
    """

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        at = Path(folder.removeprefix("file://")) / pdf["folder"].iloc[0]
        at.mkdir(parents=True, exist_ok=True)
        part = at / f".{pdf['file'].iloc[0]}.part"
        part.write_text("\n".join(pdf["line"]) + "\n", encoding="utf-8", newline="\n")
        os.replace(part, at / pdf["file"].iloc[0])
        return pd.DataFrame({"folder": [pdf["folder"].iloc[0]], "file": [pdf["file"].iloc[0]], "lines": [len(pdf)]})

    return lines.groupBy("folder", "file").applyInPandas(write, "folder string, file string, lines long")


def write_document(path: str, value: dict) -> None:
    """One small JSON document, indented, replaced as a whole."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_suffix(target.suffix + ".part")
    part.write_text(json.dumps(value, indent=2, ensure_ascii=False), encoding="utf-8")
    os.replace(part, target)


def next_version_dir(base: str, prefix: str = "V4_") -> Path:
    """The first unused version folder below ``base``."""
    root = Path(base)
    found = [int(m[1]) for p in (root.iterdir() if root.exists() else ()) if (m := re.fullmatch(rf"{re.escape(prefix)}(\d+)", p.name))]
    return root / f"{prefix}{max(found, default=0) + 1}"
