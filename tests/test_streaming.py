"""First-seen filter: keyed state, not the history, decides."""

import shutil


from resona.session import stage_path
from resona.streaming import jobs

SCHEMA = "study_id string, post_id string, n int"


def land(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, out):
    query = jobs.first_seen(jobs.read_folder(spark, path, spark.read.parquet(path).schema, max_files=1), out, f"{out}-cp")
    query.awaitTermination()
    return query


def test_earlier_output_is_not_needed(spark):
    path, out = stage_path(spark, "land"), stage_path(spark, "seen")
    land(spark, path, [("a", "1", 0), ("a", "2", 0), ("b", "1", 0), ("a", "1", 1), (None, "1", 0), (None, "1", 1)])
    run(spark, path, out)
    first = {(r.study_id, r.post_id) for r in spark.read.parquet(out).collect()}
    assert first == {("a", "1"), ("a", "2"), ("b", "1"), (None, "1")}
    # The written rows are archived elsewhere; what was seen stays known, also to a query started anew.
    kept = spark.read.parquet(out).count()
    shutil.copytree(f"{out}/batch=0", f"{out}-archive")
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(f"{out}/batch=0")
    land(spark, path, [("a", "1", 2), ("c", "1", 2), (None, "1", 2)])
    land(spark, path, [("c", "1", 3), ("b", "2", 3)])
    query = run(spark, path, out)
    assert kept == 4 and sorted((r.study_id, r.post_id, r.n) for r in spark.read.parquet(out).collect() if r.n is not None) == [("b", "2", 3), ("c", "1", 2)]
    state = query.recentProgress[-1]["stateOperators"][0]
    assert state["numRowsTotal"] == 6 and "rocksdbBytesCopied" in state["customMetrics"]


def test_settings_are_restored(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    path, out = stage_path(spark, "land"), stage_path(spark, "seen")
    land(spark, path, [("a", "1", 0)])
    run(spark, path, out)
    assert spark.conf.get(key, None) == before
