"""Clusters of many groups at once against the clusters of each group alone; replies with nested objects."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from resona.operators import study_clusters, topics
from resona.operators.labels import balanced, check_reply


def _vectors(spark, sizes, seed=3):
    rng, rows = np.random.default_rng(seed), []
    for g, n in sizes.items():
        for i in range(n):
            v = rng.normal(0, 1, 6) + 3 * np.eye(6)[rng.integers(0, 6)]
            rows.append((g, int(i * 7 % (n * 7) + 1), [float(x) for x in v]))
    return spark.createDataFrame(rows, "g string, seq long, vector array<double>")


def test_equals_every_group_alone(spark):
    sizes = {"a": 1, "b": 2, "c": 3, "d": 40, "e": 1300}
    df = _vectors(spark, sizes).unionAll(spark.createDataFrame([("a", None, [1.0] * 6), (None, 4, [1.0] * 6), ("z", 5, None)], "g string, seq long, vector array<double>"))
    got = {(r.g, r.seq): r.cluster for r in study_clusters.kmeans_by(df, "g", "seq", min_size=5).collect()}
    assert len(got) == sum(sizes.values())
    for g, n in sizes.items():
        own = df.where((F.col("g") == g) & F.col("seq").isNotNull()).select("seq", "vector")
        labelled, _ = topics.kmeans(own, "seq", topics.cluster_count(n, 5))
        assert {(g, r.seq): r.cluster for r in labelled.collect()} == {k: c for k, c in got.items() if k[0] == g}


def test_an_empty_table(spark):
    assert study_clusters.kmeans_by(_vectors(spark, {"a": 1}).limit(0), "g", "seq").collect() == []


def test_jobs_do_not_grow_with_groups(spark):
    def jobs(n):
        name = f"groups-{n}"
        spark.sparkContext.setJobGroup(name, name)
        try:
            # The same vectors in each group, so that the rounds are the same too.
            one = _vectors(spark, {"x": 30}).drop("g")
            df = one.crossJoin(spark.range(n).select(F.col("id").cast("string").alias("g")))
            study_clusters.kmeans_by(df, "g", "seq", min_size=5).count()
            return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    few, many = jobs(2), jobs(200)
    # Spark adds a job per broadcast where tables are small enough.
    assert abs(many - few) <= 0.25 * few


def test_priors_equal_every_study_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(160)
    texts = docs.select((F.col("doc_id") % 3).cast("string").alias("study_id"), F.col("doc_id").alias("seq"), "text")
    rows, new = study_clusters.priors_by(texts, "study_id", "seq", threshold=0.12, min_size=5)
    rows, new = rows.collect(), new.collect()
    assert len(rows) == texts.count()
    for study in "012":
        own = texts.where(F.col("study_id") == study).drop("study_id")
        r, c = topics.priors(own, "seq", threshold=0.12, min_size=5)
        key = lambda x: x.seq
        assert [(x.seq, x.topics, x.new_topic) for x in sorted(r.collect(), key=key)] == [
            (x.seq, x.topics, x.new_topic) for x in sorted((y for y in rows if y.study_id == study), key=key)]
        assert sorted(tuple(x) for x in c.select("new_topic_id", "size", "sample_texts").collect()) == sorted(
            (x.new_topic_id, x.size, x.sample_texts) for x in new if x.study_id == study)


@pytest.mark.parametrize("text, found", [
    (None, None), ("", None), ("none", None), ("{}", "{}"), ("x {\"a\": {\"b\": {\"c\": [{}, {\"d\": {}}]}}} {}", "{\"a\": {\"b\": {\"c\": [{}, {\"d\": {}}]}}}"),
    ("{\"a\": \"}{\\\"}\"}", "{\"a\": \"}{\\\"}\"}"), ("{ {", None), ("{\"a", None), ("} {\"k\": 1}", "{\"k\": 1}"), ("{" * 5000 + "}" * 5000, "{" * 5000 + "}" * 5000)])
def test_first_balanced_object(text, found):
    assert balanced(text) == found


def test_deep_nesting_is_an_object(spark):
    out = check_reply(spark.createDataFrame([("{\"extra\": {\"a\": {\"b\": {\"c\": 1}}}}",), ("no object",), (None,)], "reply string"))
    problems = {r.reply: r.problem for r in out.select("reply", "p.problem").collect()}
    assert problems == {"{\"extra\": {\"a\": {\"b\": {\"c\": 1}}}}": "unknown key", "no object": "no object", None: "no object"}
