"""Sampling, vectors and clusters: stated properties and values worked out by hand."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from resona.functions.similarity import reaches
from resona.operators import evaluate, normalize, order_stats, sampling, skew, topics


def posts(spark, n=600, seed=3):
    rng = random.Random(seed)
    rows = [("s", str(i), f"v{int(rng.random() ** 3 * 20)}", f"u{rng.randrange(90)}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "study_id string, post_id string, video_id string, anon_user_id string")


@pytest.mark.parametrize("n,front", [(40, 16), (150, 16), (400, 16), (150, 1)])
def test_capped_sample_equals_one_sequential_pass(spark, n, front, monkeypatch):
    monkeypatch.setattr(sampling, "FRONT", front)
    rows, df = posts(spark)
    order = sorted(rows, key=lambda r: hashlib.md5(f"42|{r[0]}|{r[1]}".encode()).hexdigest())
    picked, videos, authors = [], {}, {}
    for cap in (10, 12):
        for r in order:
            if len(picked) >= n or r in picked or videos.get(r[2], 0) >= cap or authors.get(r[3], 0) >= 3:
                continue
            picked.append(r)
            videos[r[2]] = videos.get(r[2], 0) + 1
            authors[r[3]] = authors.get(r[3], 0) + 1
    got = {r.post_id for r in sampling.stratified_sample(df, n).collect()}
    assert got == {r[1] for r in picked}


def test_split_keeps_groups_together(spark):
    _, df = posts(spark)
    parts = sampling.grouped_split(df, "video_id").collect()
    videos = {r.video_id for r in parts}
    assert len(parts) == len(videos)
    assert sum(r.part == "test" for r in parts) == max(1, round(len(videos) * 0.3))


def test_positions_of_sorted_values(spark):
    df = spark.createDataFrame([("s", i) for i in range(1, 21)], "study_id string, likes long")
    out = order_stats.order_statistics(df, "likes", {"p95": order_stats.at_fraction(0.95), "p50": lambda n: F.floor(n / 2)})
    row = out.first()
    assert (row.p95, row.p50) == (20, 11)


def test_fingerprint_ignores_row_order_and_sees_changes(spark):
    _, df = posts(spark)
    one = sampling.fingerprint({"posts": df}).first().digest
    assert sampling.fingerprint({"posts": df.orderBy(F.rand(1))}).first().digest == one
    changed = df.withColumn("video_id", F.when(F.col("post_id") == "5", F.lit("x")).otherwise(F.col("video_id")))
    assert sampling.fingerprint({"posts": changed}).first().digest != one
    stored = sampling.fingerprint({"posts": df})
    assert sampling.require_unchanged({"posts": df.orderBy(F.rand(2))}, stored) is stored
    with pytest.raises(sampling.ChangedDataset, match="posts"):
        sampling.require_unchanged({"posts": changed}, stored)
    with pytest.raises(sampling.ChangedDataset, match="videos"):
        sampling.require_unchanged({"posts": df, "videos": df}, stored)


def test_join_with_hot_groups_keeps_all_rows(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 2)
    out = skew.join_groups(rows, groups, ["k"], "n", "id")
    assert out.count() == 60_000 and out.where("v <> k * 2 or v is null").count() == 0


def _cluster(spark, vectors, k):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, vector array<double>")
    labelled, centroids = topics.kmeans(df, "id", k)
    rows = sorted((r.id, r.cluster) for r in labelled.collect())
    return np.array([c for _, c in rows]), np.array(centroids)


def test_kmeans_by_hand(spark):
    """Rows 0 and 2 start. In the first case they point the same way: all rows go to cluster 0, where all labels begin, and it ends."""
    labels, _ = _cluster(spark, [(1, 0), (0, 2), (3, 0), (0, 1)], 2)
    assert labels.tolist() == [0, 0, 0, 0]
    labels, centroids = _cluster(spark, [(2, 0), (5, 1), (0, 3), (1, 9)], 2)
    assert labels.tolist() == [0, 0, 1, 1]
    assert centroids == pytest.approx(np.array([[7, 1], [1, 12]]) / np.sqrt([[50], [145]]))


def test_kmeans_ends_at_a_fixed_point(spark):
    rng = np.random.default_rng(4)
    data = np.concatenate([rng.normal(c, 0.3, (40, 6)) for c in np.eye(6)[:4] * 3])
    rng.shuffle(data)
    labels, centroids = _cluster(spark, data, 4)
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    near = unit @ (centroids / np.linalg.norm(centroids, axis=1, keepdims=True)).T
    assert (near.max(axis=1) - near[np.arange(len(data)), labels] < 1e-9).all()
    for c in range(4):
        mean = data[labels == c].sum(axis=0)
        assert centroids[c] == pytest.approx(mean / np.linalg.norm(mean))
    # Equal centroids: the lowest number wins.
    assert set(_cluster(spark, np.ones((6, 3)), 3)[0].tolist()) == {0}


@pytest.mark.parametrize("text,want", [
    # md5 of the only gram begins with 187ef443: dimension 0x43, highest bit 0.
    ("ab", {0x43: -1.0}), (" A B ", {0x43: -1.0}),
    # The empty gram: d41d8cd9, highest bit 1.
    ("", {0xD9: 1.0}),
    # "abc" 90015098 and "bcd" d4b7c284: two grams of equal weight.
    ("abcd", {0x98: 0.5 ** 0.5, 0x84: 0.5 ** 0.5}),
])
def test_embedding_of_short_texts(spark, text, want):
    df = spark.createDataFrame([(1, text)], "id long, text string")
    assert {r.dim: r.value for r in topics.hash_vectors(df, ["id"]).collect()} == pytest.approx(want)


@pytest.mark.parametrize("text,want", [
    ("", 0), ("a", 0x0CC175B9C0F1B6A8), ("ab", 0x187EF4436122D1CC), ("A b", 0x187EF4436122D1CC),
    # "ab" twice and "ba" once: the majority has the bits of "ab".
    ("abab", 0x187EF4436122D1CC),
    # "ab" and "ba" once each: only bits that both have.
    ("aba", 0x187EF4436122D1CC & 0x07159C47EE1B19AE),
])
def test_simhash_of_short_texts(spark, text, want):
    df = spark.createDataFrame([(1, text)], "id long, text string")
    assert normalize.simhash(df, ["id"]).first().simhash == want


def test_every_text_gets_a_score_for_every_topic(spark):
    texts = ["好", "啊啊", "ok", "", "地图设计真不错"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", topics.hash_embedding(F.col("text")).alias("vector"))
    sims = topics.dense_similarity(df, topics.topic_centroids(spark), ["id"])
    assert sims.count() == 5 * topics.topic_centroids(spark).count()
    assert topics.assign(sims, ["id"]).count() == 5


def test_priors_name_every_text(spark):
    known = ["地图与探索 " + w for w in ("真好", "不错")]
    apple = [f"apple pie number {i}" for i in range(7)]
    stone = [f"zzz qqq xxx {i}" for i in range(6)]
    texts = [*known, *apple, *stone]
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, text string")
    centroids = spark.createDataFrame([("地图与探索", "地图与探索")], "topic string, text string").select(
        "topic", topics.hash_embedding(F.col("text")).alias("centroid"))
    rows, new = topics.priors(df, "seq", centroids, threshold=0.5, min_size=5)
    got = {r.seq: (r.topics, r.new_topic) for r in rows.collect()}
    assert len(got) == len(texts) and got[0] == got[1] == (["地图与探索"], None)
    clusters = {got[i][1] for i in range(2, len(texts))}
    sizes = {r.new_topic_id: (r.size, r.sample_texts) for r in new.collect()}
    assert clusters == set(sizes) == {"new:c0", "new:c1"} and {s for s, _ in sizes.values()} == {7, 6}
    for name, (size, samples) in sizes.items():
        members = [texts[i] for i in sorted(got) if got[i][1] == name]
        assert len(members) == size and samples == members[:5]
    assert topics.priors(df.limit(0), "seq", centroids)[0].count() == 0


def test_agreement_scores(spark):
    def frame(a, b):
        return spark.createDataFrame([("s", x, y) for x, y in zip(a, b)], "study_id string, y_true string, y_pred string")

    f1 = evaluate.macro_f1(frame("SSOO", "SOSO"), ["S", "O"], ["study_id"]).first()
    assert f1.macro_f1 == pytest.approx(0.5)
    a, b = ["yes"] * 6 + ["no"] * 4, ["yes"] * 5 + ["no"] * 4 + ["yes"]
    assert evaluate.cohen_kappa(frame(a, b), ["study_id"]).first().kappa == pytest.approx((0.8 - 0.52) / 0.48)
    conf = spark.createDataFrame([("s", 1.0, i < 2) for i in range(4)], "study_id string, confidence double, correct boolean")
    assert evaluate.calibration_error(conf, ["study_id"]).first().ece == pytest.approx(0.5)


def test_pair_check():
    assert reaches("地图设计真不错探索感拉满", "地图设计真好探索感拉满")
    assert not reaches("地图设计真不错", "角色很好看")
