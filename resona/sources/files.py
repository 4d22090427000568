"""File sources of raw import tables, study folders, gold labels and journals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..session import stage_table
from . import csv_split, json_split


class SourceError(ValueError):
    """A source that cannot be read; the message says why."""


class EmptySourceError(SourceError):
    pass


class UnsupportedFormatError(SourceError):
    pass


def _require_rows(df: DataFrame, path: str) -> DataFrame:
    if not df.columns:
        raise EmptySourceError(f"no columns in {path}")
    if df.isEmpty():
        raise EmptySourceError(f"no rows in {path}")
    return df


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", multi_line: bool = True, split: bool | None = None) -> DataFrame:
    """CSV with a header, every column a string.

    split reads line breaks inside fields in many tasks (see csv_split); by default for UTF-8 sources that are larger than one
    of Spark's splits. Files whose quotes are not strictly placed, where parity says nothing, go through the serial reader.
    encoding "auto" takes UTF-8 (with or without a byte order mark) where all lines are valid in it, else GBK. GBK files need
    spark.sql.legacy.javaCharsets=true. multi_line=False is for files whose fields hold no line breaks.
    """
    if encoding == "auto":
        encoding = detect_encoding(spark, path)
    utf8 = encoding.upper().replace("_", "-") in ("UTF-8", "UTF8", "UTF-8-SIG")
    if split is None:
        split = multi_line and utf8 and _bytes(spark, path) > _split_bytes(spark)
    if split:
        if not utf8:
            raise SourceError(f"only UTF-8 can be split at its lines, not {encoding}")
        # Stored, as the header, the check and the rows each read it.
        found = stage_table(csv_split.records(spark, path), "csv-records")
        names = csv_split.header(found)
        if names and len(set(names)) == len(names) and all(names) and csv_split.is_strict(found):
            return _require_rows(csv_split.rows(found, names), path)
    df = (spark.read.option("header", True).option("encoding", encoding).option("multiLine", multi_line)
          .option("escape", '"').csv(path))
    return _require_rows(df, path)


_CHARSETS = "spark.sql.legacy.javaCharsets"


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 if all lines of the source are valid in it, else GBK; lines are looked at as the bytes they are, in all splits."""
    valid = spark.read.option("lineSep", "\n").text(path).where(~F.is_valid_utf8("value")).isEmpty()
    if not valid and spark.conf.get(_CHARSETS, "false").lower() != "true":
        raise SourceError(f"{path} is not UTF-8; reading it as GBK needs {_CHARSETS}=true")
    return "UTF-8" if valid else "GBK"


def _bytes(spark: SparkSession, path: str) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sum(s.getLen() for s in fs.globStatus(at) or []) if not fs.exists(at) else fs.getContentSummary(at).getLength()


def _split_bytes(spark: SparkSession) -> int:
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))


_LINE = "_line"


def _typed_objects(spark: SparkSession, path: str, schema) -> DataFrame:
    """Every line that is a JSON object; a field of another type than the schema's is null, and the line is kept in _LINE."""
    parsed = F.from_json("value", _with_line(schema), {"columnNameOfCorruptRecord": _LINE})
    rows = spark.read.text(path).select("value", parsed.alias("_row"))
    return rows.where(F.col(f"_row.{_LINE}").isNull() | _is_object(F.col("value"))).where(F.trim("value") != "").select("_row.*")


def _with_line(schema) -> T.StructType:
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return T.StructType([*wanted.fields, T.StructField(_LINE, T.StringType())])


def _is_object(line) -> F.Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(line)).startswith("OBJECT"), F.lit(False))


def read_json_lines(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """One object per line, columns in sorted order; lines that are no object are left out (see bad_lines).

    With a schema, a field of another type is null in its row; type_conflicts lists such lines.
    """
    if schema is not None:
        df = _typed_objects(spark, path, schema).drop(_LINE)
    else:
        df = spark.read.option("mode", "DROPMALFORMED").json(path)
    return _require_rows(df.select(*[F.col(f"`{c}`") for c in sorted(df.columns)]), path)


def type_conflicts(spark: SparkSession, path: str, schema) -> DataFrame:
    """The lines (line) that are objects but have a field of another type than the schema's."""
    return _typed_objects(spark, path, schema).where(F.col(_LINE).isNotNull()).select(F.col(_LINE).alias("line"))


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are not a JSON object, blank lines aside, with their line number."""
    lines = number_rows(spark.read.text(path))
    return lines.where((F.trim("value") != "") & ~_is_object(F.col("value")))


def read_json_document(spark: SparkSession, path: str, split: bool | None = None) -> DataFrame:
    """An array of objects, an object with a data array of objects, or a single object; columns in sorted order.

    split reads the elements of one document in many tasks (see json_split); by default for sources larger than one of Spark's splits.
    Documents of another form, or with an element that does not parse, go through the serial reader.
    """
    if split is None:
        split = _bytes(spark, path) > _split_bytes(spark)
    found = json_split.elements(spark, path) if split else None
    df = json_split.as_lines(found) if found is not None else None
    if df is None or CORRUPT in df.columns:
        df = _serial_document(spark, path)
    return _require_rows(df.select(*[F.col(f"`{c}`") for c in sorted(df.columns)]), path)


CORRUPT = "_corrupt_record"


def _serial_document(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("multiLine", True).json(path)
    data = df.schema["data"].dataType if "data" in df.columns else None
    if not isinstance(data, T.ArrayType):
        return df
    # The rows of an array may have a field named data themselves.
    if spark.read.option("wholetext", True).text(path).where(F.col("value").rlike(r"\A\x{feff}?\s*\{")).isEmpty():
        return df
    if not isinstance(data.elementType, T.StructType):
        raise EmptySourceError(f"no rows in {path}")
    return df.select(F.explode("data").alias("d")).where("d is not null").select("d.*")


READERS = {
    ".csv": read_csv,
    ".jsonl": read_json_lines,
    ".ndjson": read_json_lines,
    ".json": read_json_document,
}


def read_source(spark: SparkSession, path: str, **options) -> DataFrame:
    """Choose the reader by suffix."""
    suffix = "." + path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()
    if suffix not in READERS:
        raise UnsupportedFormatError(f"unsupported format {suffix}; known: {', '.join(READERS)}")
    try:
        return READERS[suffix](spark, path, **options)
    except SourceError:
        raise
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise SourceError(f"file not found: {path}") from e
        if "UNABLE_TO_INFER_SCHEMA" in str(e):
            raise EmptySourceError(f"no rows in {path}") from e
        raise


def preview(df: DataFrame, n: int = 20, order_by: str | None = None) -> DataFrame:
    return (df.orderBy(order_by) if order_by else df).limit(n)


def number_rows(df: DataFrame, name: str = "row") -> DataFrame:
    """Consecutive row numbers from 1 in read order, without sorting or moving the rows.

    Each task numbers its own rows; the rows of the tasks before it come from a table with one
    line per task, so only that table is windowed and broadcast.
    """
    local = df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_task", F.expr("shiftright(_id, 33)"))
    sizes = local.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(
        "_task", (F.sum("_n").over(W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1))).alias("_before"))
    return (local.join(F.broadcast(before), "_task")
            .withColumn(name, F.coalesce("_before", F.lit(0)) + (F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))) + 1)
            .drop("_id", "_task", "_before"))


def load_label_map(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the form {post_id: labels} as one row per post."""
    lines = spark.read.text(path)
    parsed = F.from_json("value", T.MapType(T.StringType(), schemas.LABEL_FIELDS))
    return lines.select(F.explode(parsed).alias("post_id", "labels")).select("post_id", "labels.*")


def load_study(spark: SparkSession, folder: str, gold_only: bool = False) -> dict[str, DataFrame]:
    """posts, videos and labels of a study folder; gold_only keeps posts that have a label."""
    posts = spark.read.schema(schemas.POST).json(f"{folder}/posts")
    videos = spark.read.schema(schemas.VIDEO).json(f"{folder}/videos")
    labels = load_label_map(spark, f"{folder}/labels")
    if gold_only:
        posts = posts.join(labels.select("post_id"), "post_id", "left_semi")
    return {"posts": posts, "videos": videos, "labels": labels}


def load_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.GOLD).json(path)


def save_gold(gold: DataFrame, path: str) -> None:
    gold.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def load_journal(spark: SparkSession, path: str) -> DataFrame:
    """Append-only journal; a line cut off by a crash is ignored, one with a field of another type has it null."""
    return _typed_objects(spark, path, schemas.JOURNAL).drop(_LINE)
