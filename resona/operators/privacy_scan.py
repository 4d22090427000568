"""Public export: whitelist, masking and the leak scan that gates the write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import privacy as P
from ..rules import DEFAULT, Rules


class LeakError(ValueError):
    pass


def _field_paths(dtype: T.DataType, path: str) -> list[str]:
    if isinstance(dtype, T.StructType):
        return [p for f in dtype for p in [f"{path}.{f.name}".lstrip("."),
                                           *_field_paths(f.dataType, f"{path}.{f.name}".lstrip("."))]]
    if isinstance(dtype, T.ArrayType):
        return _field_paths(dtype.elementType, path + "[]")
    if isinstance(dtype, T.MapType):
        return _field_paths(dtype.valueType, path + ".*")
    return []


def forbidden_paths(schema: T.StructType, rules: Rules = DEFAULT) -> list[str]:
    """Field paths whose last name is forbidden, anywhere in the schema."""
    names = set(rules.forbidden)
    return [p for p in _field_paths(schema, "") if p.split(".")[-1].split("[")[0].lower() in names]


def _nth(walk, dtype: T.DataType, path: str, i: int):
    """The i-th column a walk finds below an array or map element."""
    return lambda x: walk(dtype, x, path)[i][1]


def _leak(path: str):
    return lambda kind: F.struct(F.lit(path).alias("path"), kind.alias("kind"))


def _forbidden_key(path: str):
    return lambda key: F.struct(F.concat(F.lit(path + "."), key).alias("path"), F.lit("forbidden_field").alias("kind"))


def _maps(dtype: T.DataType, col: Column, path: str) -> list[tuple[str, Column]]:
    """(path, array of keys) of every string-keyed map reachable through structs."""
    if isinstance(dtype, T.StructType):
        return [m for f in dtype for m in _maps(f.dataType, col[f.name], f"{path}.{f.name}".lstrip("."))]
    if isinstance(dtype, T.ArrayType):
        return [(p, F.flatten(F.transform(col, _nth(_maps, dtype.elementType, path + "[]", i))))
                for i, (p, _) in enumerate(_maps(dtype.elementType, F.lit(None), path + "[]"))]
    if isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
        values = F.map_values(col)
        inner = [(p, F.flatten(F.transform(values, _nth(_maps, dtype.valueType, path + ".*", i))))
            for i, (p, _) in enumerate(_maps(dtype.valueType, F.lit(None), path + ".*"))]
        return [(path, F.map_keys(col)), *inner]
    return []


def _strings(dtype: T.DataType, col: Column, path: str) -> list[tuple[str, Column]]:
    """(path, array of values) of every string leaf."""
    if isinstance(dtype, T.StringType):
        return [(path, F.array(col))]
    if isinstance(dtype, T.StructType):
        return [s for f in dtype for s in _strings(f.dataType, col[f.name], f"{path}.{f.name}".lstrip("."))]
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        element = dtype.elementType if isinstance(dtype, T.ArrayType) else dtype.valueType
        values = col if isinstance(dtype, T.ArrayType) else F.map_values(col)
        suffix = "[]" if isinstance(dtype, T.ArrayType) else ".*"
        return [(p, F.flatten(F.transform(values, _nth(_strings, element, path + suffix, i))))
                for i, (p, _) in enumerate(_strings(element, F.lit(None), path + suffix))]
    return []


def leaks(df: DataFrame, table: str, rules: Rules = DEFAULT) -> DataFrame:
    """(table, path, kind, n): forbidden names and personal data left in string values, one pass."""
    found = []
    for f in df.schema:
        for path, values in _strings(f.dataType, F.col(f"`{f.name}`"), f.name):
            kinds = F.flatten(F.transform(values, lambda v: P.leak_kinds(v, rules)))
            found.append(F.transform(kinds, _leak(path)))
        for path, keys in _maps(f.dataType, F.col(f"`{f.name}`"), f.name):
            bad = F.filter(keys, lambda k: F.lower(k).isin(*rules.forbidden))
            found.append(F.transform(bad, _forbidden_key(path)))
    # Forbidden column names are reported once per row holding them, like any other leak.
    for path in forbidden_paths(df.schema, rules):
        found.append(F.array(F.struct(F.lit(path).alias("path"), F.lit("forbidden_field").alias("kind"))))
    if not found:
        return df.sparkSession.createDataFrame([], "table string, path string, kind string, n long")
    non_null = [F.coalesce(x, F.array().cast("array<struct<path:string,kind:string>>")) for x in found]
    return (df.select(F.inline(F.concat(*non_null))).groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(table).alias("table"), "path", "kind", "n"))


def assert_clean(df: DataFrame, table: str, rules: Rules = DEFAULT) -> None:
    first = leaks(df, table, rules).limit(20).collect()
    if first:
        raise LeakError("leak scan failed: " + "; ".join(f"{r.table}.{r.path}: {r.kind} x{r.n}" for r in first))


def public_posts(posts: DataFrame) -> DataFrame:
    """The whitelisted post columns with masked text and defaults for missing values."""
    def col(name: str, default: Column) -> Column:
        return (F.coalesce(F.col(name), default) if name in posts.columns else default).alias(name)

    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    return posts.select(
        "study_id", "post_id", "video_id", col("parent_id", none), P.mask(F.col("text")).alias("text"),
        F.col("published_at"), col("likes", F.lit(0).cast("long")), col("reply_count", F.lit(0).cast("long")),
        col("anon_user_id", F.lit("x" * 16)), col("dedup_group", none), col("flags", empty), "source_url",
        col("synthetic", F.lit(False)))


def public_videos(videos: DataFrame) -> DataFrame:
    stats = [F.coalesce(F.col(f"stats_snapshot.{n}"), F.lit(0).cast("long")).alias(n)
             for n in ("view", "like", "coin", "favorite", "share", "comment")]
    return videos.select("study_id", "video_id", "title", "url", "published_at", "category", "author_type",
                         F.struct(*stats).alias("stats_snapshot"))


def public_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence rows with the excerpt masked once more."""
    return evidence.withColumn("text_excerpt", P.mask(F.col("text_excerpt")))


def public_tables(posts: DataFrame, videos: DataFrame, evidence: DataFrame, topics: DataFrame) -> dict[str, DataFrame]:
    """Everything that leaves the house, for export: whitelisted posts and videos, masked evidence, topic metrics."""
    return {"posts": public_posts(posts), "videos": public_videos(videos), "evidence": public_evidence(evidence), "metrics": topics}


def export(tables: dict[str, DataFrame], path: str, rules: Rules = DEFAULT) -> dict[str, str]:
    """Scan every table, and only when all are clean write each one below path."""
    for name, df in tables.items():
        assert_clean(df, name, rules)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    return {name: f"{path}/{name}" for name in tables}
