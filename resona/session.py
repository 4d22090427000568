"""Session settings and the shared folder used for checkpoints and stage tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "resona", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Rows that a Python worker gets at once; documents are long, so Spark's 10,000 make batches of tens of megabytes on both sides.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows, if they are larger."""
    now = int(spark.conf.get(_BATCH))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach; a local one only when the session runs locally."""
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    base = tempfile.mkdtemp(prefix="resona-")
    spark.conf.set(CHECKPOINT_CONF, base)
    return base


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the reliable checkpoint folder and cut its lineage."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


#: Folders that this session has made for stage tables, in order.
_STAGES: list[str] = []


def stage_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/stages/{name}-{uuid.uuid4().hex}"
    _STAGES.append(path)
    return path


def stage_mark() -> int:
    """A point in time for drop_stages."""
    return len(_STAGES)


def drop_stages(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete the stage folders made after a mark, but for the last `keep`; returns how many.

    For the end of a run or of one of its steps, when everything that reads those tables has been written.
    """
    end = len(_STAGES) - keep
    gone, _STAGES[since:end] = _STAGES[since:end], []
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(gone)


def stage_table(df: DataFrame, name: str, *partition_cols: str) -> DataFrame:
    """Write df as a parquet stage table in the shared folder and read it back."""
    path = stage_path(df.sparkSession, name)
    writer = df.write.mode("errorifexists")
    if partition_cols:
        writer = writer.partitionBy(*partition_cols)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
