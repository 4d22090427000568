"""What used to be capped or lost: long windows, many topics, wrong types, late rows, short batches, run lists."""

import pytest
from pyspark.sql import functions as F

from resona.operators import labels, metrics, runs
from resona.session import stage_path
from resona.sources import files
from resona.streaming import jobs


def test_windows_of_any_length_and_many_topics(spark):
    rows = [("s", 1, "v", 0, 0, "支持", 1, True, d, d, 400, [f"t{k}" for k in range(20)] if d == 0 else ["t0"]) for d in (0, 59, 60, 199, 399, 399)]
    schema = ("study_id string, post_seq long, video_id string, likes long, reply_count long, stance string, intensity long, in_window boolean, "
              "day_index int, day_offset int, window_days int, topics array<string>")
    out = {r.topic: r for r in metrics.topic_rollup(spark.createDataFrame(rows, schema), spark.createDataFrame(
        [("s", "v", "official")], "study_id string, video_id string, category string")).collect()}
    assert out["t0"].active_days == 5 and out["t0"]["count"] == 6
    order = sorted((r for r in out.values() if r.topic), key=lambda r: tuple(r.topic_seq))
    assert [r.topic for r in order] == [f"t{k}" for k in range(20)]


def test_wrong_types_keep_their_rows(spark):
    path = stage_path(spark, "lines") + ".jsonl"
    lines = ['{"rpid": "abc", "text": "y"}', '{"rpid": 1, "text": "x"}', '{"rpid": 2', "[1]", "", '{"text": "z"}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    got = [(r.rpid, r.text) for r in files.read_json_lines(spark, path, "rpid long, text string").collect()]
    assert got == [(None, "y"), (1, "x"), (None, "z")]
    assert [r.line for r in files.type_conflicts(spark, path, "rpid long, text string").collect()] == [lines[0]]
    assert files.bad_lines(spark, path).count() == 2


def test_late_rows_are_not_lost(spark):
    land, out, seen = (stage_path(spark, n) for n in ("late", "late-out", "late-seen"))
    schema = "study_id string, post_id string, published_at timestamp, topics array<string>"
    rows = [("s", "1", "2026-06-01 00:00:00"), ("s", "2", "2026-06-02 00:00:00"), ("s", "1", "2026-06-01 00:00:00"), ("s", "3", "2020-01-01 00:00:00")]
    for r in rows:
        spark.createDataFrame([r], "study_id string, post_id string, at string").select(
            "study_id", "post_id", F.to_timestamp("at").alias("published_at"), F.array(F.lit("t")).alias("topics")).coalesce(1).write.mode("append").parquet(land)
        stream = jobs.read_folder(spark, land, spark.read.parquet(land).schema, max_files=1)
        jobs.first_seen(stream, out, f"{out}-cp").awaitTermination()
        jobs.daily_counts(stream, seen, f"{seen}-cp").awaitTermination()
    assert sorted(r.post_id for r in spark.read.schema(schema).parquet(out).collect()) == ["1", "2", "3"]
    assert {str(r.day): r.n for r in jobs.daily_totals(spark, seen).collect()} == {"2026-06-01": 2, "2026-06-02": 1, "2020-01-01": 1}


def test_batches_are_placed_in_their_study_and_checked(spark):
    todo = [(s, f"{s}{i}", "t", False, 0, f"2026-06-{i + 1:02d}", i) for s in "ab" for i in range(5)]
    rows = labels.number_todo(spark.createDataFrame(
        todo, "study_id string, post_id string, text string, is_sub boolean, day int, published_at string, post_seq long"))
    given = [("a", b, k, f"a{b}{k}") for b, n in ((1, 2), (2, 1), (3, 1)) for k in range(1, n + 1)]
    given += [("b", 1, 1, "x"), ("b", 1, 1, "y"), ("b", 2, 1, "b21"), ("b", 2, 2, "b22"), ("b", 3, 1, "b31"), ("b", 4, 1, "none")]
    batches = spark.createDataFrame(given, "study_id string, batch long, k long, label string")
    sizes = {(r.study_id, r.batch): (r.expected, r.given, r.ok) for r in labels.batch_sizes(rows, batches, 2).collect()}
    assert sizes == {("a", 1): (2, 2, True), ("a", 2): (2, 1, False), ("a", 3): (1, 1, True),
                     ("b", 1): (2, 2, False), ("b", 2): (2, 2, True), ("b", 3): (1, 1, True), ("b", 4): (0, 1, False)}
    merged = {r.post_id: r.label for r in labels.merge_batches(rows, batches, 2).collect()}
    assert merged == {"a0": "a11", "a1": "a12", "a4": "a31", "b2": "b21", "b3": "b22", "b4": "b31"}


def test_run_views(spark):
    models = "array<struct<stage:string,model:string>>"
    rows = [(f"r{i:03d}", "s", "completed", f"2026-06-{i % 28 + 1:02d}", [("label", "m"), ("embed", "e")] if i else None, i, 0, 10 ** 6, 0, 30.0 * (i > 1))
            for i in range(150)]
    table = spark.createDataFrame(rows, f"run_id string, study_id string, status string, created_at string, models {models}, calls long, "
                                        "cache_hits long, tokens long, retries long, duration_s double")
    prices = spark.createDataFrame([("m", 2.5)], "model string, price double")
    listed = runs.run_list(table, prices).orderBy("place").collect()
    assert [r.place for r in listed] == list(range(1, 151))
    assert [(r.created_at, r.run_id) for r in listed] == sorted(((r[3], r[0]) for r in rows), reverse=True)
    assert {r.cost for r in listed} == {0.0, 2.5} and listed[0].models_used == "label:m,embed:e"
    assert runs.summaries(table, prices).first().cost == pytest.approx(149 * 2.5)
    use = {r.run_id: r.per_minute for r in runs.usage(table).collect()}
    assert use["r001"] is None and use["r010"] == 20
