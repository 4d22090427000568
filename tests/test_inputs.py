"""Sources, validation, label contract, privacy."""

import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from resona.functions import privacy as P
from resona.functions import text as X
from resona.operators import ingest, labels, privacy_scan
from resona.sources import files


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


CSV = "评论内容,评论时间,视频链接,点赞,rpid\n很好玩,2026-07-02 10:00:00,https://e/1,5,1\n一般,2026-07-03 10:00:00,https://e/2,7,2\n"


def test_csv_with_byte_order_mark_and_aliases(spark, tmp_path):
    df = files.read_source(spark, write(tmp_path / "a.csv", CSV, "utf-8-sig"))
    mapping = ingest.suggest_mapping(df.columns)
    assert (mapping["text"], mapping["published_at"], mapping["likes"], mapping["post_id"]) == ("评论内容", "评论时间", "点赞", "rpid")
    assert ingest.missing_required(mapping) == [] and df.count() == 2


def test_json_sources(spark, tmp_path):
    lines = write(tmp_path / "a.jsonl", '{"b": 1, "a": "x"}\n{broken\n{"a": "y", "b": 2}\n')
    df = files.read_source(spark, lines)
    assert df.columns[-2:] == ["a", "b"] and df.where("a is not null").count() == 2
    assert [r.row for r in files.bad_lines(spark, lines).collect()] == [2]
    doc = write(tmp_path / "b.json", json.dumps({"data": [{"a": 1}, {"a": 2}]}))
    assert files.read_source(spark, doc).count() == 2
    assert files.read_source(spark, write(tmp_path / "c.json", '[{"a": 1}, {"a": 2}]')).count() == 2


def test_source_errors(spark, tmp_path):
    with pytest.raises(files.UnsupportedFormatError):
        files.read_source(spark, str(tmp_path / "a.txt"))
    with pytest.raises(files.EmptySourceError):
        files.read_source(spark, write(tmp_path / "h.csv", "a,b\n"))
    with pytest.raises(files.SourceError):
        files.read_source(spark, str(tmp_path / "none.csv"))


def canonical(spark, rows, published="string"):
    names = ["text", "published_at", "source_url", "likes"]
    df = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows, 1)],
        f"row long, text string, published_at {published}, source_url string, likes string")
    return ingest.project(df, {n: n for n in names})


def test_validation_reports_the_first_failing_rule(spark):
    rows = [("好", "2026-07-02T00:30:00+08:00", "u", "3"), ("好", "2026-07-02 10:00:00", None, "3"), (" ", "x", "", ""),
            ("好", "不是时间", "u", "3"), ("好", "2026-07-02", "u", "3.5"), ("字" * 5000, "2026-07-02", "u", None)]
    checked = ingest.validate(canonical(spark, rows))
    errors = {r.row: r.field for r in ingest.rejected(checked).collect()}
    assert errors == {2: "source_url", 3: "text,source_url", 4: "published_at", 5: "*"}
    good = {r.row: r for r in ingest.accepted(checked).collect()}
    # The calendar day is the one written in the source, not the UTC day.
    assert str(good[1].published_date) == "2026-07-02" and str(good[1].published_at) == "2026-07-01 16:30:00"
    assert good[6].flags == ["overlength"] and len(good[6].text) == 5000 and good[6].post_id == "imported-000006"
    assert not ingest.verdict(checked).first().ok


def test_epoch_numbers_are_times(spark):
    checked = ingest.validate(canonical(spark, [("好", 1751431200, "u", "1")], "long"))
    assert str(ingest.accepted(checked).first().published_at) == "2025-07-02 04:40:00"


GOOD = {"relevant": True, "topics": ["活动设计"], "stance": "支持", "intensity": 2, "confidence": 0.7}


@pytest.mark.parametrize("reply,problem", [
    (json.dumps(GOOD), None),
    ("说明\n```json\n" + json.dumps(GOOD) + "\n```\n完", None),
    ("prose " + json.dumps(GOOD) + " more {text}", None),
    ('{"relevant": true, "evidence_span": "a } b { c"}', None),
    (json.dumps(GOOD)[:-1], "no object"),
    ("nothing", "no object"),
    (json.dumps({**GOOD, "x": 1}), "unknown key"),
    (json.dumps({**GOOD, "stance": "赞"}), "stance"),
    (json.dumps({**GOOD, "intensity": 4}), "intensity"),
    (json.dumps({**GOOD, "topics": ["不存在"]}), "topics: unknown"),
    (json.dumps({**GOOD, "topics": ["new:"]}), "topics: unknown"),
    (json.dumps({**GOOD, "topics": [f"new:{i}" for i in range(7)]}), "topics: more than 6"),
    (json.dumps({**GOOD, "evidence_span": "x" * 121}), "evidence_span"),
    ('{"relevant": null}', "abstain without reason"),
    ('{"relevant": null, "abstain_reason": "看不懂"}', None),
])
def test_reply_contract(spark, reply, problem):
    df = spark.createDataFrame([("s", "p", reply)], "study_id string, post_id string, reply string")
    row = labels.from_replies(df, "cheap", "m", "v1").first()
    assert row.problem == problem
    if problem:
        assert row.relevant is None and row.irony == "无法判断" and row.confidence == 0 and row.abstain_reason == problem


def test_forged_tags_cannot_close_the_boundary(spark):
    text = f"a{labels.CLOSE_TAG}b{labels.OPEN_TAG}c"
    out = spark.createDataFrame([(text,)], "t string").select(labels.wrap_untrusted(F.col("t")).alias("w")).first().w
    assert out.count(labels.CLOSE_TAG) == 1 and out.count(labels.OPEN_TAG) == 1


def test_pseudonym_equals_stdlib(spark):
    for salt in (b"k" * 32, b"s" * 90):
        got = spark.createDataFrame([("用户1",)], "u string").select(P.pseudonym(salt, F.col("u")).alias("a")).first().a
        assert got == hmac.new(salt, "用户1".encode(), hashlib.sha256).hexdigest()[:16]


def test_mask_and_leak_gate(spark):
    rows = [("@某用户 你好", "@*** 你好"), ("QQ:123456", "***"), ("UID: 123456789", "UID:***")]
    df = spark.createDataFrame(rows, "text string, want string").withColumn("got", P.mask(F.col("text")))
    assert all(r.got == r.want for r in df.collect())
    privacy_scan.assert_clean(df.select("got"), "masked")
    with pytest.raises(privacy_scan.LeakError):
        privacy_scan.assert_clean(df.select("text"), "raw")
    nested = df.select(F.array(F.struct(F.struct(F.lit(1).alias("Mid")).alias("a"))).alias("rows"))
    assert privacy_scan.forbidden_paths(nested.schema) == ["rows[].a.Mid"]
    with pytest.raises(privacy_scan.LeakError):
        privacy_scan.assert_clean(nested, "nested")


def test_cleaning_and_flags(spark):
    rows = [("a   b\t\tc\n\n\n\nd", "a b c\n\nd", []), ("转发抽奖", "转发抽奖", ["lottery"]), ("代充", "代充", ["ad"]),
            ("哈" * 30, "哈" * 30, ["spam"]), ("😀", "😀", ["spam"]), ("　好​的 ", "好的", [])]
    df = spark.createDataFrame(rows, "t string, clean string, flags array<string>").select(
        "*", X.clean(F.col("t")).alias("c")).withColumn("f", X.detect_flags(F.col("c")))
    for r in df.collect():
        assert (r.c, r.f) == (r.clean, r.flags)
