"""Steps that read or compute their rows once where they did so several times."""

import datetime as dt

from pyspark.sql import functions as F

from resona.functions import text as X
from resona.operators import ingest
from resona.plans import bindings, catalog_text
from resona.sources import csv_split, files
from resona.streaming import jobs


def _count(spark, value):
    """A counter and a column that adds one to it for every row it is computed for."""
    n = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        n.add(1)
        return x

    return n, seen(value)


def test_flags_clean_a_text_once(spark, monkeypatch, tmp_path):
    texts = ["转发抽奖", "  代充 加微信 ", "a" * 30, "😀!", None, "plain"]
    spark.createDataFrame([(i, "s", 5, t) for i, t in enumerate(texts, 100)], "doc_id long, source string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    clean, n = X.clean, []

    def counted(value):
        c, out = _count(spark, clean(value))
        n.append(c)
        return out

    want = [r.f for r in bindings.Tables(spark, str(tmp_path)).text_posts.orderBy("post_seq").select(X.detect_flags(clean(F.col("text"))).alias("f")).collect()]
    monkeypatch.setattr(catalog_text.X, "clean", counted)
    out = catalog_text._flagged(bindings.Tables(spark, str(tmp_path))).collect()
    assert [r.found for r in sorted(out, key=lambda r: r.post_id)] == want and n[0].value == len(texts)


def test_import_checks_a_row_once(spark, monkeypatch, tmp_path):
    names = ["text", "published_at", "source_url", "post_id", "video_id", "parent_id", "likes", "reply_count", "user_key", "dedup_group"]
    rows = [(i, "t", "2024-01-01 10:00:00" if i % 3 else "never", "u", *[None] * 7) for i in range(60)]
    schema = "row long, " + ", ".join(f"{n} string" for n in names)
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{tmp_path}/in")
    clean, n = ingest.parse_time, []

    def counted(value, dtype):
        c, out = _count(spark, value)
        n.append(c)
        return clean(out, dtype)

    monkeypatch.setattr(ingest, "parse_time", counted)
    stream = jobs.read_folder(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    jobs.import_posts(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {p: sorted(r.row for r in spark.read.parquet(f"{tmp_path}/out/{p}").select("row").collect()) for p in ("accepted", "rejected")}
    assert got == {"accepted": [i for i in range(60) if i % 3], "rejected": [i for i in range(60) if not i % 3]}
    first = n[0].value
    assert first % 60 == 0 and first // 60 == _evaluations(spark, clean)


def _evaluations(spark, parse):
    """How often one reading of a row evaluates the column of times (formats may repeat it)."""
    n, value = _count(spark, F.col("t"))
    rows = spark.createDataFrame([("2024-01-01 10:00:00" if i % 3 else "never",) for i in range(60)], "t string")
    X.once(rows, x=parse(value, rows.schema["t"].dataType)).select("x").collect()
    return n.value // 60


def test_only_likely_formats_are_tried_and_none_is_missed(spark):
    moment = dt.datetime(2024, 3, 5, 7, 8, 9, 123456)
    stamp = spark.createDataFrame([(moment,)], "ts timestamp")
    for fmt in ingest.TIME_FORMATS:
        text = stamp.select(F.date_format("ts", fmt).alias("t"))
        texts = text.unionByName(text.select(F.lower("t").alias("t")))
        row = texts.select(ingest._may_be(F.col("t"), fmt).alias("ok"), F.try_to_timestamp("t", F.lit(fmt)).isNotNull().alias("reads"))
        assert all(r.ok and r.reads for r in row.collect()), fmt
    odd = ["", " ", "never", "2024-1-5", "2024/03/05 07:08", "2024-03-05t07:08:09Z", "+12024-03-05", "2024-03-05 07:08:09+08:00", "2024-03-05T07:08:09.5", "2024年3月5日",
           "2024年03月05日 07:08", "2024-03-05  07:08", "07:08", "2024-03-05 07:08:09 PM", "05/03/2024", "2024-03-05 07:08:09Z", "2024-03-05T07:08:09.123456-05:30", None]
    for fmt in ingest.TIME_FORMATS:
        read = spark.createDataFrame([(x,) for x in odd], "t string").where(F.try_to_timestamp("t", F.lit(fmt)).isNotNull())
        assert read.where(~ingest._may_be(F.col("t"), fmt)).isEmpty(), fmt
    one = spark.createDataFrame([("2024/03/05 07:08",)], "t string").select(*[ingest._may_be(F.col("t"), f).alias(f"f{i}") for i, f in enumerate(ingest.TIME_FORMATS)]).first()
    assert sum(one) == 1


def test_csv_windows_hold_few_lines(spark, tmp_path, monkeypatch):
    rows = [(str(i), f'text "{i}",\nnext' if i % 3 else "one\n\nend", "x" if i % 5 else "") for i in range(500)]
    spark.createDataFrame(rows, "a string, b string, c string").coalesce(1).write.option("header", True).option("escape", '"').csv(f"{tmp_path}/t.csv")
    monkeypatch.setattr(csv_split, "CHUNK_BITS", 4)
    calls = []
    whole = csv_split.records
    monkeypatch.setattr(csv_split, "records", lambda *a: calls.append(_groups(whole, *a)) or whole(*a))
    got = files.read_csv(spark, f"{tmp_path}/t.csv", split=True)
    assert sorted(tuple(r) for r in got.collect()) == sorted((a, b, c or None) for a, b, c in rows) and len(calls) == 1 and calls[0]
    # Stored records are read; the lines are not looked at again.
    assert "csv-records" in got._jdf.queryExecution().executedPlan().toString()


def _groups(records, spark, path):
    return "chunk" in records(spark, path)._jdf.queryExecution().analyzed().toString()
