"""Token counts: totals by source, language and tokenizer version, kept up to date by signed deltas."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import join_groups
from ..session import stage_path, stage_table
from .files import TOKENIZERS, read_bytes
from .mixing import word_count
from .registry import query, table

#: Fixed value: the pre-tokenization pattern that belongs to the byte_bpe_50k vocabulary.
BPE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORDS, BPE = "words", "byte_bpe_50k"
ENTRY = ["doc_id", "version", "source", "lang", "docs", "tokens"]
KEYS = ["source", "lang", "version"]


def bpe_count(docs: DataFrame, path: str, text: str, name: str) -> DataFrame:
    """Adds the number of byte-level BPE tokens of whole texts; null counts as empty."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_bytes(spark, path))  # a vocabulary, at most files.MAX_BYTES
    cache: dict = {}

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        if "enc" not in cache:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines())}
            cache["enc"] = tiktoken.Encoding("bpe", pat_str=BPE_PATTERN, mergeable_ranks=table, special_tokens={})
        for texts in batches:
            yield pd.Series([len(cache["enc"].encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return docs.withColumn(name, count(F.col(text)))


class TokenRollup:
    """An append-only ledger in a shared folder.

    Every batch writes its signed rows per document (entries) and their sums per source, language and version
    (deltas), each in a folder named by the batch. The deltas come last, and Spark marks them with _SUCCESS when all tasks are done:
    that mark is the commit. A batch without it is written again from its start; one that has it is not applied again.
    Totals are sums of deltas, so they never need the documents.

    Changes have doc_id, op, source, lang, version, tokens. "insert" and "revise" replace what the ledger holds for
    (doc_id, version); "delete" takes it out, for all versions where version is null. Of several changes to one
    (doc_id, version) in a batch, a delete wins, then the largest (tokens, source, lang). Null tokens count as 0; null sources
    and languages are groups of their own; rows without doc_id, or without version unless deleted, change nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def committed(self) -> list[str]:
        """Ids of committed batches."""
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/deltas")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        return sorted(name for s in fs.listStatus(top) if self._exists(f"{self.path}/deltas/{(name := s.getPath().getName())}/_SUCCESS"))

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{kind}/{b}" for b in self.committed()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def entries(self) -> DataFrame:
        return self._read("entries", "doc_id long, version string, source string, lang string, docs long, tokens long")

    def deltas(self) -> DataFrame:
        return self._read("deltas", "source string, lang string, version string, docs long, tokens long")

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch once; False if it was committed before."""
        if batch in self.committed():
            return False
        wanted = changes.where(F.col("doc_id").isNotNull() & (F.col("version").isNotNull() | (F.col("op") == "delete"))).select(
            "doc_id", "version", "op", "source", "lang", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
        one = wanted.groupBy("doc_id", "version").agg(
            F.max(F.struct((F.col("op") == "delete").alias("gone"), "tokens", "source", "lang")).alias("new"))
        one = stage_table(one.select("doc_id", "version", "new.*"), "token-changes")
        gone = one.where("version is null").select("doc_id")
        prior = self._prior(self.entries(), one)
        added = one.where(~F.col("gone")).join(gone, "doc_id", "left_anti").select(
            "doc_id", "version", "source", "lang", F.lit(1).cast("long").alias("docs"), "tokens")
        signed = prior.unionByName(added)
        entries = f"{self.path}/entries/{batch}"
        signed.write.mode("overwrite").parquet(entries)
        written = self.spark.read.schema(signed.schema).parquet(entries)
        (written.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
         .write.mode("overwrite").parquet(f"{self.path}/deltas/{batch}"))
        return True

    @staticmethod
    def _prior(old: DataFrame, one: DataFrame) -> DataFrame:
        """What the ledger holds now for the changed documents, with the opposite sign."""
        some = one.where(F.col("version").isNotNull()).select("doc_id", "version")
        every = one.where(F.col("version").isNull()).select("doc_id")
        hit = old.join(every, "doc_id", "left_semi").unionByName(
            old.join(some, ["doc_id", "version"], "left_semi").join(every, "doc_id", "left_anti"))
        net = hit.groupBy("doc_id", "version", "source", "lang").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return net.where((F.col("docs") != 0) | (F.col("tokens") != 0)).select(
            "doc_id", "version", "source", "lang", (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))

    def totals(self) -> DataFrame:
        return (self.deltas().groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
                .where((F.col("docs") != 0) | (F.col("tokens") != 0)))


def _changes(counted: DataFrame, op: str, versions: dict[str, str]) -> DataFrame:
    """One change per document and tokenizer version; versions: column -> version."""
    pairs = F.array(*[F.struct(F.lit(v).alias("version"), F.col(c).alias("tokens")) for c, v in versions.items()])
    return counted.withColumn("_v", F.explode(pairs)).select(
        "doc_id", F.lit(op).alias("op"), "source", "lang", F.col("_v.version").alias("version"), F.col("_v.tokens").alias("tokens"))


def single_lines(text: str) -> F.Column:
    """The text with repeated lines left out."""
    return F.array_join(F.array_distinct(F.split(F.col(text), "\n")), "\n")


@query("op3_token_rollup")
def op3(spark, sf_dir):
    """Three batches over all documents: load; recount of those whose lines repeat; removal of exact copies.

    The first two are sent a second time, as after a lost answer, and change nothing.
    """
    path = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    versions = {"n_words": WORDS, "n_bpe": BPE}
    first = bpe_count(docs.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256)), path, "text", "n_bpe")
    first = stage_table(first.withColumn("n_words", word_count(F.col("text"))).drop("text"), "token-load")
    revised = docs.withColumn("_short", single_lines("text")).where(F.length("_short") < F.length("text"))
    revised = bpe_count(revised.select("doc_id", "source", "lang", "_short"), path, "_short", "n_bpe")
    revised = stage_table(revised.withColumn("n_words", word_count(F.col("_short"))).drop("_short"), "token-revised")
    groups = first.groupBy("digest").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # One text may have very many copies.
    copies = join_groups(first, groups, ["digest"], "_n", "doc_id", "inner").where("doc_id > _first").select(
        "doc_id", F.lit("delete").alias("op"), "source", "lang", F.lit(None).cast("string").alias("version"), F.lit(0).cast("long").alias("tokens"))
    rollup = TokenRollup(spark, stage_path(spark, "token-rollup"))
    batches = {"1-load": _changes(first, "insert", versions), "2-recount": _changes(revised, "revise", versions), "3-copies": copies}
    for batch in ("1-load", "2-recount", "1-load", "2-recount", "3-copies"):
        rollup.apply(batch, batches[batch])
    return rollup.totals()
