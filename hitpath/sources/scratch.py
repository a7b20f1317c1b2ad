"""Folders for what is written between the steps of a query."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError(f"name a folder for the {purpose}, or set spark.checkpoint.dir to one all executors share")
    return os.path.join(base, f"{purpose}-{uuid.uuid4().hex}")
