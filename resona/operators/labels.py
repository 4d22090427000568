"""Label rows: the output contract, replay, merging of batches, request rows and their keys."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as X
from ..rules import DEFAULT, Rules
from ..schemas import LABEL_FIELDS
from ..session import checkpointed
from ..sources.files import number_rows
from .skew import join_groups

OPEN_TAG, CLOSE_TAG = "<untrusted_community_text>", "</untrusted_community_text>"
_FENCE = r"(?s)```(?:json)?\s*(.*?)```"
#: What matters for nesting: whole strings, braces, and a quote that no string closes.
_MARKS = re.compile(r'"(?:[^"\\]++|\\.)*+"|[{}"]', re.S)
FIELDS = LABEL_FIELDS.fieldNames()


def is_valid_topic(topic: Column, rules: Rules = DEFAULT) -> Column:
    return topic.isin(*rules.topics) | topic.rlike(vocab.NEW_TOPIC_PATTERN)


def balanced(text: str | None) -> str | None:
    """From the first opening brace to the one that closes it, whatever the depth; None where nothing closes it."""
    start, depth = text.find("{") if text else -1, 0
    if start < 0:
        return None
    for m in _MARKS.finditer(text, start):
        mark = m[0]
        if mark == '"':
            return None
        depth += (mark == "{") - (mark == "}")
        if depth == 0:
            return text[start:m.end()]
    return None


def first_object(reply: Column) -> Column:
    """The first balanced JSON object of a model reply, inside a code fence if there is one. A depth counter walks every reply once."""
    fenced = F.regexp_extract(reply, _FENCE, 1)
    body = F.when(fenced != "", fenced).otherwise(reply)

    @F.pandas_udf("string")
    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series([balanced(t) for t in texts], dtype=object)

    return F.when(F.contains(body, F.lit("{")), scan(body))


def check_reply(replies: DataFrame, labels: Rules = DEFAULT) -> DataFrame:
    """Add p: every label field of the reply column with defaults, and `problem`, null when valid."""
    text_fields = ", ".join(f"{f} string" for f in FIELDS)
    found = X.once(replies, _block=first_object(F.col("reply")))
    parsed = X.once(found, _raw=F.from_json("_block", text_fields), _keys=F.json_object_keys("_block"))
    typed = X.once(
        parsed, _topics=F.from_json("_raw.topics", "array<string>"), _relevant=F.col("_raw.relevant").try_cast("boolean"),
        _intensity=F.col("_raw.intensity").try_cast("double"), _confidence=F.col("_raw.confidence").try_cast("double"))
    block, keys, topics, relevant = (F.col(c) for c in ("_block", "_keys", "_topics", "_relevant"))
    raw = {f: F.col(f"_raw.{f}") for f in FIELDS}
    number = {f: F.col(f"_{f}") for f in ("intensity", "confidence")}

    def outside(f: str, values: list[str]) -> Column:
        return raw[f].isNotNull() & ~raw[f].isin(*values)

    def null_given(f: str) -> Column:
        return F.array_contains(keys, f) & raw[f].isNull()

    rules = [
        (block.isNull(), "no object"),
        (keys.isNull(), "not json"),
        (F.size(F.array_except(keys, F.array(*[F.lit(f) for f in FIELDS]))) > 0, "unknown key"),
        (raw["relevant"].isNotNull() & relevant.isNull(), "relevant"),
        (null_given("topics") | (raw["topics"].isNotNull() & topics.isNull()), "topics"),
        (F.size(topics) > 6, "topics: more than 6"),
        (F.exists(topics, lambda t: ~F.coalesce(is_valid_topic(t, labels), F.lit(False))), "topics: unknown"),
        (F.size(F.array_distinct(topics)) < F.size(topics), "topics: repeated"),
        (outside("stance", labels.stances), "stance"),
        (outside("emotion", labels.emotions), "emotion"),
        (null_given("irony") | outside("irony", labels.irony), "irony"),
        (outside("intent", labels.intents), "intent"),
        (outside("issue_type", labels.issue_types), "issue_type"),
        (null_given("intensity") | (raw["intensity"].isNotNull() & ~F.coalesce(
            number["intensity"].isin(0.0, 1.0, 2.0, 3.0), F.lit(False))), "intensity"),
        (null_given("confidence") | (raw["confidence"].isNotNull() & ~F.coalesce(
            number["confidence"].between(0.0, 1.0), F.lit(False))), "confidence"),
        (null_given("evidence_span") | (F.length(raw["evidence_span"]) > 120), "evidence_span"),
        (raw["relevant"].isNull() & (F.coalesce(raw["abstain_reason"], F.lit("")) == ""), "abstain without reason"),
    ]
    problem = F.coalesce(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for cond, name in rules])
    fields = {
        "problem": problem,
        "relevant": relevant,
        "topics": F.coalesce(topics, F.array().cast("array<string>")),
        "stance": raw["stance"], "emotion": raw["emotion"],
        "intensity": F.coalesce(number["intensity"].cast("long"), F.lit(0).cast("long")),
        "irony": F.coalesce(raw["irony"], F.lit("无")),
        "intent": raw["intent"], "issue_type": raw["issue_type"],
        "confidence": F.coalesce(number["confidence"], F.lit(0.5)),
        "evidence_span": F.coalesce(raw["evidence_span"], F.lit("")),
        "abstain_reason": raw["abstain_reason"],
    }
    return X.once(typed, p=F.struct(*[c.alias(n) for n, c in fields.items()])).select(*replies.columns, "p")


def abstain_values(reason: Column) -> dict[str, Column]:
    """The label fields of a row that could not be labelled."""
    none = F.lit(None).cast("string")
    return {
        "relevant": F.lit(None).cast("boolean"), "topics": F.array().cast("array<string>"), "stance": none,
        "emotion": none, "intensity": F.lit(0).cast("long"), "irony": F.lit("无法判断"), "intent": none,
        "issue_type": none, "confidence": F.lit(0.0), "evidence_span": F.lit(""),
        "abstain_reason": F.substring(reason, 1, 120),
    }


def from_replies(replies: DataFrame, stage: str, model: str, prompt_version: str, labels: Rules = DEFAULT) -> DataFrame:
    """Annotations of model replies; an invalid reply becomes an abstain row naming the problem."""
    checked = check_reply(replies, labels)
    bad = F.col("p.problem").isNotNull()
    abstain = abstain_values(F.col("p.problem"))
    return checked.select(
        "study_id", "post_id", F.col("p.problem").alias("problem"),
        *[F.when(bad, abstain[f]).otherwise(F.col(f"p.{f}")).alias(f) for f in FIELDS],
        F.lit(model).alias("model"), F.lit(prompt_version).alias("prompt_version"), F.lit(stage).alias("stage"))


def replay(requests: DataFrame, labels: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Label requests from a table of known labels; a post without one abstains ("scripted miss")."""
    key = key or ["study_id", "post_id"]
    known = labels.select(*key, *FIELDS, F.lit(True).alias("_hit"))
    out = requests.select(*key).join(known, key, "left")
    # The stand-in reply carries only relevant and abstain_reason, so other fields take their defaults.
    miss = {**abstain_values(F.lit("scripted miss")), "irony": F.lit("无"), "confidence": F.lit(0.5)}
    return out.select(*key, *[F.when(F.col("_hit"), F.col(f)).otherwise(miss[f]).alias(f) for f in FIELDS])


def label_with(requests: DataFrame, provider, model: str, stage: str, prompt_version: str) -> DataFrame:
    """Label request rows with a user function pandas -> iterable of reply texts, in Arrow batches."""
    def run(batches):
        for pdf in batches:
            yield pdf[["study_id", "post_id"]].assign(reply=list(provider(pdf)))

    replies = requests.mapInPandas(run, "study_id string, post_id string, reply string")
    return from_replies(replies, stage, model, prompt_version)


def wrap_untrusted(text: Column) -> Column:
    """Text between boundary tags; tags inside the text are broken so that they cannot end it early."""
    safe = F.replace(text, F.lit(CLOSE_TAG), F.lit("</untrusted_community_text/>"))
    safe = F.replace(safe, F.lit(OPEN_TAG), F.lit("<untrusted_community_text/"))
    return F.concat(F.lit(OPEN_TAG + "\n"), safe, F.lit("\n" + CLOSE_TAG))


def request_rows(posts: DataFrame, videos: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """One request per post: title or id of its video, the first part of its text, topic priors."""
    titled = posts.join(videos.select("study_id", "video_id", "title"), ["study_id", "video_id"], "left")
    if priors is not None:
        titled = titled.join(priors.select("study_id", "post_id", "priors"), ["study_id", "post_id"], "left")
    else:
        titled = titled.withColumn("priors", F.array().cast("array<string>"))
    return titled.select(
        "study_id", "post_id", F.coalesce("title", "video_id").alias("video_title"),
        wrap_untrusted(X.excerpt(F.col("text"), vocab.REQUEST_CHARS)).alias("content"),
        F.coalesce("priors", F.array().cast("array<string>")).alias("priors"))


def request_key(requests: DataFrame, model: str, prompt_version: str) -> DataFrame:
    body = F.to_json(F.struct(
        F.lit(model).alias("model"), F.lit(prompt_version).alias("pv"), "post_id", "video_title", "content", "priors"))
    return requests.withColumn("request_key", F.sha2(body, 256))


def expand_short_keys(batch: DataFrame) -> DataFrame:
    """Rename r,t,s,... to label fields and fill the defaults."""
    have = set(batch.columns)
    defaults = {"topics": F.array().cast("array<string>"), "intensity": F.lit(0).cast("long"),
                "confidence": F.lit(0.5), "irony": F.lit("无")}
    out = [F.col(c) for c in batch.columns if c not in vocab.BATCH_KEYS]
    for short, name in vocab.BATCH_KEYS.items():
        dtype = LABEL_FIELDS[name].dataType
        value = F.col(short).cast(dtype) if short in have else F.lit(None).cast(dtype)
        out.append((F.coalesce(value, defaults[name]) if name in defaults else value).alias(name))
    return batch.select(*out)


def upsert(layers: list[DataFrame], key: list[str], seq: str | None = None) -> DataFrame:
    """Union of keyed layers where a later layer, then a later row, replaces an earlier one."""
    ranked = [d.withColumn("_layer", F.lit(i)) for i, d in enumerate(layers)]
    union = ranked[0]
    for d in ranked[1:]:
        union = union.unionByName(d)
    order = [F.col("_layer").desc()] + ([F.col(seq).desc()] if seq else [])
    w = W.partitionBy(*key).orderBy(*order)
    return union.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_layer")


def todo(posts: DataFrame, labelled: DataFrame) -> DataFrame:
    """Posts without a label: post_id, one-line text, is_sub and day; replies come first, then by time."""
    return posts.join(labelled.select("study_id", "post_id"), ["study_id", "post_id"], "left_anti").select(
        "study_id", "post_id", X.one_line(F.col("text")).alias("text"),
        F.coalesce(F.col("parent_id") != "", F.lit(False)).alias("is_sub"), F.col("day_offset").alias("day"),
        "published_at", "post_seq")


def number_todo(todo_rows: DataFrame) -> DataFrame:
    """To-do rows with their place in their study's list (a range sort; the number comes from task offsets)."""
    # Stored once, so that counting and numbering see the same ranges.
    ordered = checkpointed(todo_rows.orderBy("study_id", F.col("is_sub").desc(), "published_at", "post_seq"))
    numbered = number_rows(ordered, "_row")
    first = numbered.groupBy("study_id").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    return join_groups(numbered, first, ["study_id"], "_n", "post_seq", how="inner").withColumn(
        "place", F.col("_row") - F.col("_first") + 1).drop("_row", "_first")


def batch_sizes(numbered: DataFrame, batches: DataFrame, size: int) -> DataFrame:
    """study_id, batch, expected, given, ok: whether a batch has one label for each of its to-do rows, k = 1, 2, ..."""
    want = numbered.groupBy("study_id", (F.floor((F.col("place") - 1) / size) + 1).alias("batch")).agg(F.count(F.lit(1)).alias("expected"))
    have = batches.groupBy("study_id", "batch").agg(
        F.count(F.lit(1)).alias("given"), F.min("k").alias("_lo"), F.max("k").alias("_hi"), F.count_distinct("k").alias("_k"))
    given, expected = F.coalesce("given", F.lit(0)), F.coalesce("expected", F.lit(0))
    whole = (given == expected) & (F.col("_lo") == 1) & (F.col("_hi") == expected) & (F.col("_k") == expected)
    return have.join(want, ["study_id", "batch"], "left").select(
        "study_id", "batch", expected.alias("expected"), given.alias("given"), F.coalesce(whole, F.lit(False)).alias("ok"))


def merge_batches(numbered: DataFrame, batches: DataFrame, size: int) -> DataFrame:
    """Join the k-th label of batch b of a study with its to-do row (b-1)*size + k.

    A batch whose labels don't match its to-do rows one to one is refused whole (see batch_sizes).
    """
    ok = batch_sizes(numbered, batches, size).where("ok").select("study_id", "batch")
    placed = batches.join(ok, ["study_id", "batch"], "left_semi").withColumn("place", (F.col("batch") - 1) * size + F.col("k"))
    return numbered.join(placed.drop("batch", "k"), ["study_id", "place"])


def gold_as_labels(gold: DataFrame) -> DataFrame:
    """Gold rows in label form; the abstain reason is kept only for an abstained row."""
    return gold.select(
        "study_id", "post_id",
        *[F.when(F.col("relevant").isNull(), F.col(f)).alias(f) if f == "abstain_reason" else F.col(f)
          for f in FIELDS])


def prefer_strong(cheap: DataFrame, strong: DataFrame) -> DataFrame:
    """The strong label of a post where there is one, else the cheap label."""
    cols = [c for c in cheap.columns if c not in ("study_id", "post_id")]
    right = strong.select("study_id", "post_id", F.struct(*cols).alias("_s"))
    return cheap.join(right, ["study_id", "post_id"], "left").select(
        "study_id", "post_id", *[F.when(F.col("_s").isNotNull(), F.col(f"_s.{c}")).otherwise(F.col(c)).alias(c)
                                 for c in cols])
