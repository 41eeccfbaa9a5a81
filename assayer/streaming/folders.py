"""Folders that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import warnings

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one where it is unset in a local session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not folder:
        folder = tempfile.mkdtemp(prefix="assayer-")
        warnings.warn(f"spark.checkpoint.dir is not set: tables of this local session go to {folder}", stacklevel=2)
    return folder
