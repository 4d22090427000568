"""Metrics under corrections: every batch leaves what a computation over all posts gives."""

import random

import pytest

from resona import vocab
from resona.operators import effective, incremental, metrics
from resona.session import stage_path

DATED = ("study_id string, post_id string, post_seq long, parent_id string, video_id string, likes long, reply_count long, flags array<string>, "
         "day_offset int, day_index int, in_window boolean, window_days int")
LABELS = "study_id string, post_id string, ann_seq long, relevant boolean, stance string, intensity long, topics array<string>"
VIDEOS = "study_id string, video_id string, category string"


def tables(spark, rng, n=60):
    posts, labels = [], {}
    for s in "ab":
        for i in range(n):
            day = rng.randint(-3, 80)
            parent = str(rng.randrange(n)) if rng.random() < 0.5 else None
            posts.append((s, str(i), i, parent, f"v{rng.randrange(3)}", rng.randrange(50), 0, ["spam"] if i % 13 == 0 else [], day - 10, day, 0 <= day < 70, 70))
            labels[s, str(i)] = label(rng)
    return spark.createDataFrame(posts, DATED), labels, spark.createDataFrame([(s, f"v{k}", "official") for s in "ab" for k in range(2)], VIDEOS)


def label(rng):
    topics = rng.sample(["t1", "t2", "t3", f"rare{rng.randrange(8)}"], rng.randint(0, 3))
    return rng.random() < 0.7, rng.choice([vocab.SUPPORT, vocab.OPPOSE, vocab.NEUTRAL, vocab.MIXED]), rng.randint(1, 3), topics


def annotations(spark, labels):
    return spark.createDataFrame([(*k, 1, *v) for k, v in labels.items()], LABELS)


def rows(df):
    return {(r.study_id, r.topic): {k: round(v, 9) if isinstance(v, float) else v for k, v in r.asDict(True).items()} for r in df.collect()}


def same(spark, out, dated, labels, videos):
    relevant = effective.relevant_posts(dated, annotations(spark, labels))
    whole = metrics.topic_metrics(metrics.topic_rollup(relevant, videos), videos, metrics.reply_conflict(relevant))
    got, want = rows(incremental.topic_metrics(spark, out, videos)), rows(whole)
    assert got == want


def test_batches_equal_a_full_recompute(spark):
    rng = random.Random(3)
    dated, labels, videos = tables(spark, rng)
    out = stage_path(spark, "store")
    incremental.start(effective.relevant_posts(dated, annotations(spark, labels)), out)
    same(spark, out, dated, labels, videos)
    for batch in (1, 2):
        old = dict(labels)
        keys = rng.sample(sorted(labels), 12) + [("a", str(batch)), ("a", "1")]  # early posts hold first mentions
        for k in keys:
            labels[k] = label(rng)
        keys = [*keys, keys[0], ("a", "unknown")]
        for _ in range(batch):  # a batch done again replaces itself
            incremental.correct(dated, annotations(spark, old), annotations(spark, labels), spark.createDataFrame(keys, "study_id string, post_id string"), out, batch)
        same(spark, out, dated, labels, videos)


def test_a_topic_goes_and_comes_back(spark):
    dated, labels, videos = tables(spark, random.Random(5), 8)
    for k in labels:
        labels[k] = (True, vocab.SUPPORT, 1, ["only"] if k == ("a", "3") else ["t1"])
    out = stage_path(spark, "store")
    incremental.start(effective.relevant_posts(dated, annotations(spark, labels)), out)
    for batch, topics in enumerate((["t1"], ["only"], []), 1):
        old, labels = labels, {**labels, ("a", "3"): (True, vocab.OPPOSE, 2, topics)}
        incremental.correct(dated, annotations(spark, old), annotations(spark, labels), spark.createDataFrame([("a", "3")], "study_id string, post_id string"), out, batch)
        topics_now = {r.topic for r in incremental.topic_metrics(spark, out, videos).where("study_id = 'a'").collect()}
        assert ("only" in topics_now) == ("only" in topics)
    same(spark, out, dated, labels, videos)
    with pytest.raises(ValueError):
        incremental.correct(dated, annotations(spark, old), annotations(spark, labels), dated, out, 0)
