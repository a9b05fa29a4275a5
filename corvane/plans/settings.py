"""Run settings: YAML with environment variables, and where each path comes from."""

from __future__ import annotations

import os
import platform
import re
import subprocess
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

import yaml

DEFAULTS: dict[str, Any] = {
    "hashing": {"mode": "full", "fast_bytes_to_read": 1 << 20},
    "segmentation": {"mode": "auto", "beat_conf_threshold": 0.5, "segment_duration_s": 5.0, "segment_duration_bars": 16, "n_intro": 1, "n_mid": 2, "n_outro": 1},
    "clustering": {"pca_dim": 50, "l1_min_cluster_size": 6, "l1_min_samples": 1, "l2_min_cluster_size": 4, "l2_min_samples": 2, "assign_noise": True},
    "ordering": {"weights": {"embedding": 0.5, "bpm": 0.3, "key": 0.2}},
}
_VARIABLE = re.compile(r"\$\{(\w+)\}")


def expand(value: Any) -> Any:
    """Replace ``${NAME}`` by the environment, at any depth; unknown names stay."""
    if isinstance(value, str):
        return _VARIABLE.sub(lambda m: os.environ.get(m[1], m[0]), value)
    if isinstance(value, dict):
        return {k: expand(v) for k, v in value.items()}
    return [expand(v) for v in value] if isinstance(value, list) else value


def merged(base: dict, over: dict) -> dict:
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def load(path: str | None = None) -> dict:
    """Settings of a YAML file over the defaults."""
    found = yaml.safe_load(Path(path).read_text(encoding="utf-8")) if path else {}
    return merged(DEFAULTS, expand(found or {}))


def first_set(*choices: Any) -> Any:
    """The first choice that isn't None; zero and empty text count as set."""
    return next((c for c in choices if c is not None), None)


def artifact_root(settings: dict, given: str | None = None) -> str:
    """Command line, then environment, then settings, then ./artifacts."""
    return first_set(given, os.environ.get("CORVANE_ARTIFACTS"), settings.get("paths", {}).get("artifacts_root"), "artifacts")


def audio_root(settings: dict, dataset: str, given: str | None = None) -> str | None:
    return first_set(given, settings.get("datasets", {}).get(dataset, {}).get("audio_root"), os.environ.get("CORVANE_AUDIO"), *(settings.get("paths", {}).get("audio_roots") or ()))


def timestamp() -> str:
    return datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")


def provenance() -> dict:
    """Commit, job, host and time of a run."""
    try:
        commit = subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True, timeout=5).stdout.strip() or None
    except (OSError, subprocess.TimeoutExpired):
        commit = None
    return {"git_commit": commit, "job_id": os.environ.get("SLURM_JOB_ID"), "host": platform.node(), "timestamp_utc": timestamp()}
