"""Helpers of these tests."""

from __future__ import annotations

#: Columns that a table may have besides, named like what operators add.
CLASHES = ("score", "component_id", "kept", "n_removed", "spans", "bucket", "hash", "position", "block", "slot", "fp", "list", "rank", "least", "version", "c0")


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"extra {c}") for c in CLASHES})
