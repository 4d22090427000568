"""Rules given as a table, and runs that are taken up again."""

import json

import pytest
from pyspark.sql import functions as F

from resona import rules, vocab
from resona.functions import privacy as P
from resona.functions import text as X
from resona.operators import evidence, labels, privacy_scan, topics
from resona.plans import bindings, resume, study

SCHEMA = "kind string, name string, value string"
SF = "/root/testdata/sf0.001"


def given(spark, *rows):
    return rules.from_table(spark.createDataFrame(list(rows), SCHEMA))


def test_an_empty_table_gives_the_defaults(spark):
    assert given(spark) == rules.DEFAULT


def test_flags_leaks_and_fields_follow_the_table(spark):
    r = given(spark, ("flag", "b", "two"), ("flag", "a", "on+e"), ("flag", "a", "uno"), ("flag", "a", "uno"), ("leak", "plate", "[A-Z]{2}-[0-9]+"),
              ("forbidden", "Plate", None))
    texts = spark.createDataFrame([(0, "uno two"), (1, "onne"), (2, "转发抽奖"), (3, "!!"), (4, None), (5, "")], "i int, t string")
    got = {x.i: x.f for x in texts.select("i", X.detect_flags(F.col("t"), r).alias("f")).collect()}
    assert got == {0: ["a", "b"], 1: ["a"], 2: [], 3: ["spam"], 4: [], 5: []}
    df = spark.createDataFrame([("AB-12 QQ:1234567", "x")], "note string, plate string")
    assert {(x.path, x.kind) for x in privacy_scan.leaks(df, "t", r).collect()} == {("note", "plate"), ("plate", "forbidden_field")}
    assert {(x.path, x.kind) for x in privacy_scan.leaks(df, "t").collect()} == {("note", "contact")}
    assert df.select(P.leak_kinds(F.col("note"), r)).first()[0] == ["plate"]


def test_labels_topics_and_claims_follow_the_table(spark):
    r = given(spark, ("topic", "it's music", "songs"), ("stance", "yes", None), ("stance", "no", None), ("overreach", None, "everyone"))
    assert [x.topic for x in topics.topic_centroids(spark, rules=r).collect()] == ["it's music"]
    assert topics.topic_centroids(spark).count() == len(vocab.TOPICS)
    reply = '{"relevant": true, "topics": ["%s"], "stance": "%s"}'
    replies = spark.createDataFrame([(reply % p,) for p in (
        ("it's music", "yes"), (vocab.TOPICS[0], "yes"), ("new:x", vocab.SUPPORT))], "reply string")
    assert [x.p.problem for x in labels.check_reply(replies, r).collect()] == [None, "topics: unknown", "stance"]
    claims = spark.createDataFrame([("s", "c", "everyone 所有玩家 导致", ["m"], ["e"], 99)],
                                   "study_id string, claim_id string, text string, metric_ids array<string>, evidence_ids array<string>, topic_sample_size int")
    assert {(x.rule, x.detail) for x in evidence.verify_claims(claims, r).collect()} == {("overreach", "everyone"), ("causal", "导致")}


@pytest.mark.parametrize("row,message", [
    (("flagg", "a", "x"), "unknown kind"), (("flag", "a", "(x"), "no pattern"), (("flag", None, "x"), "no name"), (("leak", "a", None), "no pattern")])
def test_bad_rows_are_named(spark, row, message):
    with pytest.raises(rules.RuleError, match=message):
        given(spark, ("flag", "ok", "x"), row)


def test_two_descriptions_and_too_many_entries(spark, monkeypatch):
    with pytest.raises(rules.RuleError, match="two descriptions"):
        given(spark, ("topic", "a", "x"), ("topic", "a", "y"))
    monkeypatch.setattr(rules, "MAX_ENTRIES", 2)
    with pytest.raises(rules.RuleError, match="more than 2"):
        given(spark, *[("stance", str(i), None) for i in range(3)])


def test_stages_are_reused_rebuilt_or_refused(spark, tmp_path):
    folder, built = str(tmp_path / "run"), []
    table = spark.createDataFrame([(1, "a"), (2, None)], "i int, t string")

    def go(tables, parameters=None):
        run = resume.Run(folder, tables, parameters)

        def build():
            built.append(1)
            return tables["t"].withColumn("double", F.col("i") * 2)
        return run, run.stage("s", build)

    run, rows = go({"t": table})
    assert run.outcomes == {"s": "built"} and sorted(r.double for r in rows.collect()) == [2, 4]
    run, rows = go({"t": table.orderBy(F.desc("i"))})
    assert run.outcomes == {"s": "reused"} and sorted(r.double for r in rows.collect()) == [2, 4] and len(built) == 1
    # Cut off before the entry was written, and rows lost after it.
    resume.forget(spark, folder, "s")
    assert go({"t": table})[0].outcomes == {"s": "built"}
    stored = json.loads(run._read("stage-s"))["path"]
    table.limit(1).withColumn("double", F.lit(0)).write.mode("overwrite").parquet(stored)
    run, rows = go({"t": table})
    assert run.outcomes == {"s": "built"} and rows.count() == 2
    for other in ({"t": table.withColumn("i", F.col("i") + 1)}, {"t": table.unionByName(table)}, {"u": table}, {"t": table.limit(0)}):
        with pytest.raises(resume.ChangedDataset):
            go(other)
    with pytest.raises(resume.ChangedParameters):
        go({"t": table}, {"near": False})


def test_a_study_run_is_taken_up_again(spark, tmp_path):
    t = bindings.Tables(spark, SF)
    folder = str(tmp_path / "study")
    tables = {"posts": t.posts, "annotations": t.annotations, "videos": t.videos, "studies": t.studies}
    plain = study.metric_tables(t.posts, t.annotations, t.videos, t.studies)
    for want in ("built", "reused"):
        run = resume.Run(folder, tables)
        got = study.metric_tables(t.posts, t.annotations, t.videos, t.studies, run)
        assert run.outcomes == {"relevant": want, "rollup": want, "topics": want}
        assert sorted(got["topics"].select("study_id", "topic", "count").collect()) == sorted(plain["topics"].select("study_id", "topic", "count").collect())
