"""Runs that can be taken up again: finished stages are reused, and changed inputs refused.

A run folder holds the fingerprint of the input tables, the parameters, and per stage its rows and, written after them, an entry with
their schema and number. A stage without an entry was cut off and is built anew; one whose rows do not agree with its entry as well.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sampling import ChangedDataset, fingerprint, require_unchanged


class ChangedParameters(ValueError):
    """The run folder was made with other parameters."""


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class Run:
    """A run over named tables below a folder; raises ChangedDataset or ChangedParameters if the folder is of another one."""

    def __init__(self, folder: str, tables: dict[str, DataFrame], parameters: dict | None = None):
        self.spark = next(iter(tables.values())).sparkSession
        self.folder = folder.rstrip("/")
        self.outcomes: dict[str, str] = {}
        given = json.dumps(parameters or {}, sort_keys=True, ensure_ascii=False)
        if self._has("parameters"):
            if self._read("parameters") != given:
                raise ChangedParameters(f"{self.folder} was made with other parameters: {self._read('parameters')}")
            require_unchanged(tables, self.spark.read.parquet(f"{self.folder}/inputs"))
        else:
            fingerprint(tables).write.mode("overwrite").parquet(f"{self.folder}/inputs")
            self._write("parameters", given)

    def _has(self, entry: str) -> bool:
        # Spark writes the mark when all files of the entry are in place.
        return _exists(self.spark, f"{self.folder}/entries/{entry}/_SUCCESS")

    def _read(self, entry: str) -> str:
        return self.spark.read.option("wholetext", True).text(f"{self.folder}/entries/{entry}").first()[0].rstrip("\n")

    def _write(self, entry: str, text: str) -> None:
        self.spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(f"{self.folder}/entries/{entry}")

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The stored rows of a stage; built and stored first where they are not there in whole."""
        entry = f"stage-{name}"
        if self._has(entry):
            known = json.loads(self._read(entry))
            if _exists(self.spark, f"{known['path']}/_SUCCESS"):
                rows = self.spark.read.schema(T.StructType.fromJson(known["schema"])).parquet(known["path"])
                if rows.count() == known["rows"]:
                    self.outcomes[name] = "reused"
                    return rows
        df = build()
        # A path of its own: whoever still reads the rows of an earlier build isn't disturbed.
        path = f"{self.folder}/stages/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        rows = self.spark.read.schema(df.schema).parquet(path)
        self._write(entry, json.dumps({"path": path, "schema": df.schema.jsonValue(), "rows": rows.count()}, ensure_ascii=False))
        self.outcomes[name] = "built"
        return rows


def forget(spark, folder: str, name: str) -> None:
    """Take back the entry of a stage, so that the next run builds it anew."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/entries/stage-{name}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


__all__ = ["ChangedDataset", "ChangedParameters", "Run", "forget"]
