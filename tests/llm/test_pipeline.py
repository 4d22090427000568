"""The pipeline's stages, one after the other, on the small tables and on odd rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from resona.llm import near_dedup, quality, substrings
from resona.session import stage_table

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage_table(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0] and docs.columns[:len(columns)] == columns
        kept[name] = (before.count(), docs.count())
        if name == "quality":
            assert docs.join(before, [*columns], "left_anti").count() == 0
        if name == "near_duplicates":
            left = near_dedup.near_duplicates(docs, near_dedup.PIPELINE)
            assert left.where(~F.col("kept")).count() == 0
        if name == "repeated_passages":
            # Every run of words that several documents share is left whole in one, and a second pass finds only what a document kept as its own.
            runs = lambda d: [set(zip(*(w[i:] for i in range(substrings.RUN_WORDS)))) for r in d.select("text").collect() for w in [(r.text or "").split()]]
            first, seen, shared = substrings.repeated_paragraphs(before), set(), set()
            for own in runs(before):
                shared |= own & seen
                seen |= own
            assert shared and shared <= set().union(*runs(docs))
            keepers = {r.doc_id for r in first.where("kept").collect()}
            again = substrings.repeated_paragraphs(docs).where(~F.col("kept")).collect()
            assert len(again) <= 0.01 * first.count() and all(r.doc_id in keepers for r in again)
            assert docs.where("n_chars <> length(text)").count() == 0
        if name == "source_mix":
            words = lambda d: sum(len((r.text or "").encode().split()) for r in d.select("text").collect())
            assert words(docs) <= words(before) and words(docs) > 0.9 * words(before)
            assert docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
        if name == "sentencepiece":
            assert docs.where(F.col("decoded_sha256") != F.sha2(F.col("text").cast("binary"), 256)).count() == 0
    assert kept["quality"][1] < kept["quality"][0] and kept["near_duplicates"][1] < kept["near_duplicates"][0]


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "a b", "en", None, 3), (2, "a b", "en", None, 3)]])
def test_odd_rows(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).withColumn("rating", F.lit("x")).withColumn("ids", F.lit(1)).withColumn("_starts", F.lit(2))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage_table(stage(spark, docs, SF), "test-odd")
    assert "decoded_sha256" in docs.columns


def test_labels_make_grades(spark):
    rows = [(1, 0), (1, 1), (0, 0), (None, 1), (None, 0), (None, None)]
    got = [r.g for r in spark.createDataFrame(rows, "quality int, toxic int").select(quality.grade(F.col("quality"), F.col("toxic")).alias("g")).collect()]
    assert got == [2, 0, 1, 0, None, None]
