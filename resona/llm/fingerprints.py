"""Document fingerprints: bottom-k sketches of hashed word shingles."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import query, table
from .shingles import shingle_hashes, words

K, WORDS = 128, 5
#: Bytes of output that a task collects before it hands them on.
FLUSH_ROWS = 500


class BottomK:
    """The k smallest of the distinct shingle hashes of a text, in order.

    A sketch with fewer than k hashes holds the whole set, so its answers are exact. Sketches of parts merge to that of their union
    (shingles that cross from one part to the next belong to none). No words: an empty sketch, which is like another empty one and unlike all others.
    """

    __slots__ = ("hashes", "k")

    def __init__(self, hashes: np.ndarray, k: int = K):
        self.hashes, self.k = np.unique(hashes)[:k], k

    @classmethod
    def of(cls, text: str | None, k: int = K, size: int = WORDS) -> BottomK:
        found = shingle_hashes(words(text), size)
        if len(found) > 8 * k:
            # Repeats may fill the first part; then the whole is sorted.
            least = np.unique(np.partition(found, 4 * k)[:4 * k])
            if len(least) >= k:
                found = least
        return cls(found, k)

    @classmethod
    def parse(cls, text: str, k: int = K) -> BottomK:
        return cls(np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64), k)

    def __str__(self) -> str:
        return base64.b64encode(self.hashes.astype(">u8").tobytes()).decode()

    def merge(self, other: BottomK) -> BottomK:
        return BottomK(np.concatenate([self.hashes, other.hashes]), min(self.k, other.k))

    def distinct(self) -> float:
        """Estimated number of distinct shingles; exact below k."""
        n = len(self.hashes)
        return float(n) if n < self.k else (self.k - 1) / ((float(self.hashes[-1]) + 1.0) / 2.0 ** 64)

    def _shared(self, other: BottomK) -> tuple[int, BottomK]:
        union = self.merge(other)
        both = np.intersect1d(self.hashes, other.hashes, assume_unique=True)
        return int(np.isin(union.hashes, both, assume_unique=True).sum()), union

    def resemblance(self, other: BottomK) -> float:
        """Estimated intersection over union."""
        shared, union = self._shared(other)
        return shared / len(union.hashes) if len(union.hashes) else 1.0

    def containment(self, other: BottomK) -> float:
        """Estimated part of this text's shingles that the other has."""
        shared, union = self._shared(other)
        own = self.distinct()
        return min(1.0, shared / len(union.hashes) * union.distinct() / own) if own else 1.0


def merge_parts(parts: DataFrame, key: str, sketch: str, k: int = K) -> DataFrame:
    """One sketch per key from those of its parts. Tasks merge what they have before the shuffle, so a key has one row per task at most a flush."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield merged(rows)

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        whole: dict = {}
        for at, s in zip(rows[key], rows[sketch]):
            one = BottomK.parse(s or "", k)
            whole[at] = whole[at].merge(one) if at in whole else one
        return pd.DataFrame({key: pd.Series(list(whole), dtype=rows[key].dtype), sketch: [str(x) for x in whole.values()]})

    schema = parts.select(key, sketch).schema
    first = parts.select(key, sketch).mapInPandas(partial, schema)
    salted = first.groupBy(key, F.pmod(F.monotonically_increasing_id(), F.lit(64)).alias("_salt"))
    second = salted.applyInPandas(lambda rows: merged(rows), schema)
    return second.groupBy(key).applyInPandas(lambda rows: merged(rows), schema)


LEAST = -(2 ** 63)
NEXT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
        "n_shingles double, edited_contains double")
_NEXT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                   ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
                   ("n_shingles", pa.float64()), ("edited_contains", pa.float64())])


def _ranges(docs: DataFrame, n: int) -> list[int]:
    """Largest id of each of about n ranges, descending; from the ids alone, so no text is read."""
    ids = docs.select(F.coalesce("doc_id", F.lit(LEAST)).alias("id")).repartitionByRange(n, F.desc("id"))
    return [r.top for r in ids.groupBy(F.spark_partition_id()).agg(F.max("id").alias("top")).orderBy(F.desc("top")).collect()]


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """docs (doc_id, text) in ranges of descending doc_id, each followed by the first document of the range below.

    Every text moves once; only the first of each range moves twice. A range is sorted and read as a stream, so two texts are in
    memory at a time. Rows: range, edge (true for the borrowed document, which comes last), doc_id, text.
    """
    n = parts or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.select("doc_id").rdd.getNumPartitions())
    tops = _ranges(docs, 4 * n)
    if not tops:
        return docs.select(F.lit(0).alias("range"), F.lit(False).alias("edge"), "doc_id", "text", F.lit(0).alias("tie")).limit(0)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(len(tops) - np.searchsorted(np.array(tops[::-1]), ids.to_numpy(), side="left") - 1, dtype="int32")

    order = F.coalesce("doc_id", F.lit(LEAST))
    first = order == F.element_at(F.array(*map(F.lit, tops)), F.col("range") + 1)
    above = F.pmod(F.col("range") - 1, F.lit(len(tops)))
    slots = F.when(first, F.array(F.struct(F.col("range"), F.lit(False).alias("edge")), F.struct(above.alias("range"), F.lit(True).alias("edge")))
                   ).otherwise(F.array(F.struct(F.col("range"), F.lit(False).alias("edge"))))
    placed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("range", place(order))
    return (placed.withColumn("_slot", F.explode(slots)).select("_slot.range", "_slot.edge", "doc_id", "text", F.xxhash64("text").alias("tie"))
            .repartition(n, "range").sortWithinPartitions("range", "edge", F.desc_nulls_last("doc_id"), F.desc("tie")))


def fingerprints(docs: DataFrame, k: int = K, size: int = WORDS) -> DataFrame:
    """Fingerprints of documents and of their edited texts, whose last third is replaced by the start of the next document.

    The next document is that with the next smaller doc_id; after the last comes the first. Null texts count as empty; a null doc_id is the
    smallest; rows with one doc_id are ordered by a hash of their text. A document alone is its own next. An empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out = None, []
        for batch in batches:
            for at, edge, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("range", "edge", "doc_id", "text"))):
                own = (at, edge, doc_id, text, BottomK.of(text, k, size))
                if last is not None and last[0] == at and not last[1]:
                    out.append(edited(last, own))
                    if len(out) == FLUSH_ROWS:
                        yield pa.RecordBatch.from_pylist(out, schema=_NEXT)
                        out = []
                last = own
        yield pa.RecordBatch.from_pylist(out, schema=_NEXT)

    def edited(own: tuple, after: tuple) -> dict:
        _, _, doc_id, text, sketch = own
        third = len(text) // 3
        new = text[:len(text) - third] + after[3][:third]
        changed = BottomK.of(new, k, size)
        return {"doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
                "fingerprint": str(sketch), "edited_fingerprint": str(changed), "near_edited": sketch.resemblance(changed),
                "near_next": sketch.resemblance(after[4]), "n_shingles": sketch.distinct(), "edited_contains": sketch.containment(changed)}

    return with_next(docs).select("range", "edge", "doc_id", "text").mapInArrow(run, NEXT)


@query("op4_bottom_k")
def op4(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))
