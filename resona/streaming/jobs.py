"""Incremental forms of import, de-duplication, daily counts and review merging.

Sources are files that arrive in a folder; checkpoints belong in the shared folder. Each batch
is written under its own batch id, so a batch replayed after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest, review


def read_folder(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


#: Keyed state on disk, of which only changes are uploaded with each batch.
DISK_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _conf(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings for queries that start inside; a started query keeps the ones it has seen."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _start(writer, checkpoint: str) -> StreamingQuery:
    """Process everything that is there, then stop; a later start goes on from the checkpoint."""
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def import_posts(rows: DataFrame, out: str, checkpoint: str, salt: bytes | None = None) -> StreamingQuery:
    """Validate canonical import rows into the tables out/accepted and out/rejected."""
    def write(batch: DataFrame, batch_id: int) -> None:
        # Checked once for both tables.
        checked = ingest.validate(batch, salt=salt).persist(StorageLevel.DISK_ONLY)
        try:
            for name, part in (("accepted", ingest.accepted(checked)), ("rejected", ingest.rejected(checked))):
                part.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
        finally:
            checked.unpersist()

    return _start(rows.writeStream.foreachBatch(write), checkpoint)


def first_seen(posts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the posts whose (study_id, post_id) no earlier batch has, however late they come.

    The keys seen are keyed state that never expires. It lies in RocksDB on the executors' disks, with the changes of each batch
    in the checkpoint folder, so a batch looks up its own keys only, whatever the history. Of copies in one batch any one is taken.
    The output is not read; a batch that is replayed starts from the state before it and replaces its own folder.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    with _conf(posts.sparkSession, DISK_STATE):
        return _start(posts.dropDuplicates(["study_id", "post_id"]).writeStream.foreachBatch(write), checkpoint)


def daily_counts(labelled: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Posts per (study, topic, day): every batch adds its own counts, so late posts are counted and nothing is rewritten."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("study_id", F.to_date("published_at").alias("day"), F.explode("topics").alias("topic"))
        rows.groupBy("study_id", "topic", "day").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _start(labelled.writeStream.foreachBatch(write), checkpoint)


def daily_totals(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("study_id", "topic", "day").agg(F.sum("n").alias("n"))


def latest_reviews(reviews: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Every batch adds the latest value per (post, field) it holds; current_reviews takes the latest of all batches."""
    def write(batch: DataFrame, batch_id: int) -> None:
        _latest(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _start(reviews.writeStream.foreachBatch(write), checkpoint)


def _latest(rows: DataFrame) -> DataFrame:
    names = [c for c in rows.columns if c not in ("study_id", "post_id", "field")]
    return (rows.where(F.col("field").isin(*review.VALUE_FIELDS)).groupBy("study_id", "post_id", "field")
            .agg(F.max_by(F.struct(*names), F.struct("reviewed_at", "review_seq")).alias("r")).select("study_id", "post_id", "field", "r.*"))


def current_reviews(spark: SparkSession, out: str) -> DataFrame:
    return _latest(spark.read.parquet(out).drop("batch"))
