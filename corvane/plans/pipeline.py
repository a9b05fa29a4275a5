"""The phases from audio to playlists as one facade; tables pass between them as Parquet below a root.

``python -m corvane <phase> --dataset-name D`` runs one phase; see ``main``.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import hashing
from corvane.operators import catalog as C
from corvane.operators import clustering as L
from corvane.operators import export as X
from corvane.operators import extract as E
from corvane.operators import metrics as M
from corvane.operators import naming as N
from corvane.operators import ordering as O
from corvane.plans import settings as S
from corvane.sources import files


@dataclass
class Engine:
    spark: SparkSession
    dataset: str
    settings: dict = field(default_factory=S.load)
    root: str | None = None

    def path(self, name: str) -> str:
        return f"{S.artifact_root(self.settings, self.root)}/{self.dataset}/{name}"

    def _load(self, name: str, phase: str) -> DataFrame:
        return files.load_parquet(self.spark, self.path(name), phase)

    def _save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.parquet(self.path(name))

    def ingest(self, audio: str | None = None, metadata_csv: str | None = None) -> DataFrame:
        """Catalog of the audio folder, joined with optional metadata by file name."""
        folder = S.audio_root(self.settings, self.dataset, audio)
        if folder is None:
            raise ValueError("no audio folder: give one or set it for the dataset")
        out = files.catalog_from_audio(self.spark, folder, self.settings["hashing"]["mode"] == "fast")
        if metadata_csv:
            out = C.merge_metadata(out, files.read_csv(self.spark, metadata_csv, ("filename",)))
        return self._save(out, "catalog")

    def extract(self, make=E.SpectralStub) -> DataFrame:
        """Features of every track not done yet; failed ones are tried again on the next run."""
        todo = self._load("catalog", "ingest").select("track_uid", "source_path")
        try:
            todo = C.remaining(todo, self._load("features", "extract"), "track_uid")
        except files.MissingArtifact:
            pass
        raw = self.spark.read.format("binaryFile").load([r[0] for r in todo.select("source_path").collect()]) if not todo.isEmpty() else None
        if raw is None:
            return self._load("features", "extract")
        audio = files.decode(raw, 24000).join(todo.withColumnRenamed("source_path", "path"), "path").filter("error is null")
        good, bad = E.split_errors(E.extract(audio.select("track_uid", "samples"), make))
        good.write.mode("append").parquet(self.path("features"))
        bad.write.mode("append").json(self.path("failed"))
        return self._load("features", "extract")

    def merge(self) -> dict:
        """Which tracks have features; the manifest says so."""
        catalog, done = self._load("catalog", "ingest"), self._load("features", "extract")
        sides = {r["side"]: r["count"] for r in C.coverage(catalog, done, "track_uid").groupBy("side").count().collect()}
        self._save(catalog.join(done.select("track_uid"), "track_uid", "left_semi"), "catalog_success")
        self._save(C.update_columns(catalog, done.select("track_uid", "bpm", "bpm_confidence", "beat_confidence", "key", "key_confidence"), "track_uid"), "catalog_features")
        doc = {"n_tracks_merged": done.count(), "missing": sides.get("missing", 0), "extra": sides.get("extra", 0), **S.provenance()}
        files.write_document(self.path("run_manifest.json"), doc)
        return doc

    def tag(self, config_tag: str = "baseline") -> str:
        return hashing.clustering_hash(self.settings["clustering"] | {"config_tag": config_tag})

    def cluster(self, config_tag: str = "baseline", **over) -> DataFrame:
        c = self.settings["clustering"] | {k: v for k, v in over.items() if v is not None}
        rows = self._load("features", "extract").select(F.col("track_uid").alias("id"), F.col("mert_perc").cast("array<double>").alias("perc"), F.col("mert_full").cast("array<double>").alias("full"))
        labels = L.two_levels(rows, L.HDBSCAN(c["l1_min_cluster_size"], c["l1_min_samples"]), L.HDBSCAN(c["l2_min_cluster_size"], c["l2_min_samples"]), c["pca_dim"], c["assign_noise"])
        plane = L.project_2d(rows.select("id", F.col("full").alias("vector")))
        out = labels.join(plane, "id").select(F.col("id").alias("track_uid"), "label_l1", "label_l1_raw", "label_l2", "label_l2_raw", F.col("x").alias("umap_x"), F.col("y").alias("umap_y"))
        return self._save(out, f"results_{self.tag(config_tag)}")

    def name(self, config_tag: str = "baseline") -> DataFrame:
        catalog = self._load("catalog", "ingest")
        genre = F.col("beatport_genre_norm") if "beatport_genre_norm" in catalog.columns else F.lit(None).cast("string")
        names = N.cluster_names(self._load(f"results_{self.tag(config_tag)}", "cluster"), catalog.withColumn("genre", genre), "track_uid")
        return self._save(names, f"names_{self.tag(config_tag)}")

    def order(self, config_tag: str = "baseline", weights: dict | None = None) -> DataFrame:
        results = self._load(f"results_{self.tag(config_tag)}", "cluster")
        features = self._load("features", "extract").select("track_uid", F.col("mert_full").cast("array<double>").alias("vector"), "bpm", "key")
        rows = O.with_camelot(results.filter("label_l1 <> -1").join(features, "track_uid", "left"))  # noise has no place
        placed = O.order_clusters(rows, ["label_l1", "label_l2"], "track_uid", weights or self.settings["ordering"]["weights"]).select("track_uid", "position")
        return self._save(C.with_defaults(results.join(placed, "track_uid", "left"), position=-1), f"ordered_{self.tag(config_tag)}")

    def export(self, windows_dir: str = "", config_tag: str = "baseline") -> DataFrame:
        ordered, names = self._load(f"ordered_{self.tag(config_tag)}", "order"), self._load(f"names_{self.tag(config_tag)}", "name")
        catalog = self._load("catalog", "ingest").select("track_uid", "filename", "artist", "title")
        lists = X.playlists(ordered.join(catalog, "track_uid", "left").withColumn("order", F.col("track_uid")), names)
        target = files.next_version_dir(self.path("playlists"))
        written = files.write_playlists(X.m3u_lines(lists, windows_dir), str(target))
        written.collect()
        return X.summary(lists)

    def evaluate(self, config_tag: str = "baseline", dev_set_csv: str | None = None) -> dict:
        results = self._load(f"results_{self.tag(config_tag)}", "cluster")
        out = M.cluster_stats(results).first().asDict()
        # one row per cluster
        out["cluster_sizes"] = {str(r["label_l1"]): r["n_tracks"] for r in M.cluster_sizes(results).collect()}
        out["per_cluster"] = {str(r["label_l1"]): {k: r[k] for k in ("n_tracks", "n_subclusters", "noise_rate_l2")} for r in M.subcluster_stats(results).collect()}
        scores = {}
        if dev_set_csv:
            dev = files.read_csv(self.spark, dev_set_csv, ("track_uid", "label_true"), "track_uid string, label_true int")
            both = results.join(dev, "track_uid").withColumnRenamed("label_l1", "label_pred")
            scores = {"ari": M.adjusted_rand(both).first()[0], "nmi": M.mutual_information(both).first()[0]}
        out |= scores | {"composite": sum(scores.values()) / len(scores) if scores else 0.0}
        files.write_document(self.path(f"scores_{self.tag(config_tag)}.json"), out)
        return out


def main(args: list[str] | None = None) -> None:
    from corvane.session import session

    parser = argparse.ArgumentParser(prog="corvane")
    parser.add_argument("phase", choices=("ingest", "extract", "merge", "cluster", "name", "order", "export", "evaluate"))
    parser.add_argument("--dataset-name", required=True)
    parser.add_argument("--config")
    parser.add_argument("--root")
    parser.add_argument("--config-tag", default="baseline")
    parser.add_argument("--audio-root")
    parser.add_argument("--metadata-csv")
    parser.add_argument("--dev-set")
    parser.add_argument("--windows-audio-dir", default="")
    for name, kind in (("pca-dim", int), ("l1-min-cluster-size", int), ("l1-min-samples", int), ("l2-min-cluster-size", int), ("l2-min-samples", int), ("weights-embedding", float), ("weights-bpm", float), ("weights-key", float)):
        parser.add_argument(f"--{name}", type=kind)
    parser.add_argument("--assign-noise", action=argparse.BooleanOptionalAction)
    a = parser.parse_args(args)
    engine = Engine(session(), a.dataset_name, S.load(a.config), a.root)
    given = {"embedding": a.weights_embedding, "bpm": a.weights_bpm, "key": a.weights_key}
    weights = {k: S.first_set(v, O.WEIGHTS[k]) for k, v in given.items()} if any(v is not None for v in given.values()) else None
    phase = {
        "ingest": lambda: engine.ingest(a.audio_root, a.metadata_csv),
        "extract": engine.extract,
        "merge": engine.merge,
        "cluster": lambda: engine.cluster(a.config_tag, pca_dim=a.pca_dim, l1_min_cluster_size=a.l1_min_cluster_size, l1_min_samples=a.l1_min_samples, l2_min_cluster_size=a.l2_min_cluster_size, l2_min_samples=a.l2_min_samples, assign_noise=a.assign_noise),
        "name": lambda: engine.name(a.config_tag),
        "order": lambda: engine.order(a.config_tag, weights),
        "export": lambda: engine.export(a.windows_audio_dir, a.config_tag),
        "evaluate": lambda: engine.evaluate(a.config_tag, a.dev_set),
    }[a.phase]()
    print(M.report(phase) if isinstance(phase, dict) else f"{a.phase}: {phase.count()} rows")
