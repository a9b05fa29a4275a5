"""Schemas of the logical tables. Readers apply them, so nothing is inferred at scale."""

from __future__ import annotations

CATALOG = "track_uid string, filename string, source_path string, duration_s double, filesize_bytes long, artist string, title string"
FEATURES = "track_uid string, bpm double, bpm_confidence double, beat_confidence double, key string, key_confidence double"
EMBEDDINGS = "track_uid string, row_idx long, mert_perc array<float>, mert_full array<float>"
RESULTS = "track_uid string, label_l1 int, label_l1_raw int, label_l2 int, label_l2_raw int, umap_x double, umap_y double"
ORDERED = RESULTS + ", position int"
NAMES = "key string, name string"
DEV_SET = "track_uid string, label_true int"
PAIRS = "track_uid_a string, track_uid_b string"
PHASE_LOG = "timestamp_utc string, phase string, dataset_name string, event_type string, track_uid string, filepath string, status string, duration_ms double, error string"
MANIFEST = "track_id string, file_path string, relative_path string, duration double, sample_rate int"
V1_RESULTS = "track string, cluster int, umap_x double, umap_y double"
V2_LEVEL1 = "track string, cluster_l1 string, umap_x double, umap_y double"
V2_LEVEL2 = "track string, cluster_l1 string, cluster_l2 string"
V2_FINAL = "track string, cluster_l1 string, cluster_l2 string, folder_l1 string, folder_l2 string"
V2_GENRES = "track string, genre_1 string, genre_2 string, genre_3 string, conf_1 double, conf_2 double, conf_3 double"

#: Labels: -1 is noise on level 1; on level 2 it is noise or no parent, and 0 a parent too small to divide.
NOISE = -1
MIN_PARENT = 8
