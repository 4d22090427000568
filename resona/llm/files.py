"""Small files of bounded size that the driver reads for all tasks."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
MAX_BYTES = 64 * 1024 * 1024


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """Content of one file of at most MAX_BYTES, through Spark's file systems; a plain path is the driver's disk."""
    if "://" not in path and os.path.exists(path):
        if os.path.getsize(path) > MAX_BYTES:
            raise ValueError(f"{path} is larger than {MAX_BYTES} bytes")
        with open(path, "rb") as f:
            return f.read()
    rows = spark.read.format("binaryFile").load(path).where(f"length <= {MAX_BYTES}").select("content").take(1)
    if not rows:
        raise ValueError(f"{path} is missing or larger than {MAX_BYTES} bytes")
    return bytes(rows[0].content)
