"""Embeddings and similarities in whole batches against the plain rules, one text and one pair at a time."""

import math
import random
from collections import Counter
from hashlib import md5

import numpy as np
from pyspark.sql import functions as F

from resona.functions import vectors as V
from resona.operators import topics


def _plain(squeezed, dim=256):
    grams = Counter(squeezed[i:i + 3] for i in range(max(1, len(squeezed) - 2)))
    out = [0.0] * dim
    for g, n in grams.items():
        head = int.from_bytes(md5(g.encode()).digest()[:4], "big")
        out[head % dim] += n if head >= 2 ** 31 else -n
    size = math.sqrt(sum(x * x for x in out))
    return [x / size for x in out] if size else out


def test_embeddings_equal_the_plain_rule():
    rng = random.Random(5)
    texts = ["", "a", "ab", "abc", "\0", "\0\0a", "😀!", "音乐剧情" * 9, "aaaaaa"]
    texts += ["".join(rng.choice("abcde é😀\0") for _ in range(rng.randrange(60))) for _ in range(300)]
    assert topics._hashed(texts, 256).tolist() == [_plain(t) for t in texts]
    assert topics._hashed(["x" * (topics.EMBED_CHARS + 9), "abc"], 64).tolist() == [_plain("x" * 9, 64), _plain("abc", 64)]


def test_a_trigram_is_hashed_once_for_all_texts(monkeypatch):
    calls = []
    topics._head.cache_clear()
    monkeypatch.setattr(topics, "md5", lambda raw: calls.append(raw) or md5(raw))
    topics._hashed(["abcabcabc", "bcabca"] * 500, 256)
    topics._hashed(["abcab"] * 10, 256)
    assert sorted(calls) == [b"abc", b"bca", b"cab"]


def test_similarities_equal_the_expression(spark):
    rng = random.Random(6)
    nan, gap = float("nan"), None
    rows = [[rng.uniform(-1, 1) for _ in range(3)] for _ in range(50)] + [[0.0, 0.0, 0.0], [1.0, gap, 2.0], [1.0, nan, 2.0], None, [], [1.0], [1.0, 2.0, 3.0, 4.0]]
    few = [("a", [1.0, 2.0, 2.0]), ("b", [0.0, 0.0, 0.0]), ("c", [1.0, None, 0.5]), ("d", [2.0]), (None, [0.3, 0.1, -2.0]), ("e", []), ("f", None)]
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "id long, vector array<double>").repartition(3)
    centroids = spark.createDataFrame(few, "topic string, centroid array<double>")
    got = topics.dense_similarity(vectors, centroids, ["id"])
    want = vectors.crossJoin(centroids).select("id", "topic", V.cosine(F.col("vector"), F.col("centroid")).alias("similarity"))
    # To the last bit; repr tells null and NaN apart.
    assert Counter(map(repr, got.collect())) == Counter(map(repr, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "zip_with" not in plan and "zipwith" not in plan


def test_assign_from_lists_moves_one_row_per_text(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [-1.0, -1.0]), (None, [1.0, 1.0])], "id long, vector array<double>")
    centroids = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0]), ("z", [1.0, 1.0])], "topic string, centroid array<double>")
    lists = topics.similarity_lists(vectors, centroids, ["id"])
    assert lists.count() == 5
    a, b = (sorted(topics.assign(x, ["id"], 0.5).collect(), key=str) for x in (lists, topics.dense_similarity(vectors, centroids, ["id"])))
    assert a == b and {r.id: r.topics for r in a} == {1: ["x", "z"], 2: ["y", "y", "z", "z"], 3: [], None: ["z", "y", "x"]}


def test_a_round_gives_one_row_per_cluster_and_task():
    import pandas as pd

    batches = [pd.DataFrame({"vector": [np.array([1.0, 0.0]), np.array([0.0, 1.0])]}) for _ in range(50)]
    out = pd.concat(topics._round(np.eye(2), None)(iter(batches)))
    assert len(out) == 4 and out.groupby("pos").moved.sum()[0] == 50 and out.x.sum() == 100
