"""Queries over normalisation, text functions, de-duplication and privacy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules, vocab
from ..functions import privacy as P
from ..functions import text as X
from ..operators import effective, normalize, privacy_scan
from ..session import stage_table
from .bindings import Tables
from .registry import query

SALT = bytes(range(32))
_S = X.SPACE_CLASS


def q_strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^[{_S}]+', ''), '[{_S}]+$', '')"


def q_clean(c: str) -> str:
    ctrl = r"[\x{200b}\x{200c}\x{feff}\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
    t = f"regexp_replace({c}, '{ctrl}', '', 'g')"
    t = f"regexp_replace({t}, '[ \\t\\r]+', ' ', 'g')"
    t = f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return q_strip(t)


def q_flags(c: str) -> str:
    run = (f"len(list_filter(list_distinct(string_split({c}, '')), "
           f"lambda x: x <> chr(10) AND contains({c}, repeat(x, 20)))) > 0")
    symbols = rf"(length({c}) <= 4 AND regexp_matches({c}, '^(?:[^\p{{L}}\p{{N}}_]|[\x{{1F000}}-\x{{1FAFF}}])+$'))"
    return (f"list_filter([CASE WHEN regexp_matches({c}, '{vocab.LOTTERY_PATTERN}') THEN 'lottery' END, "
            f"CASE WHEN regexp_matches({c}, '{vocab.AD_PATTERN}') THEN 'ad' END, "
            f"CASE WHEN {run} OR {symbols} THEN 'spam' END], lambda f: f IS NOT NULL)")


def q_squeeze(c: str) -> str:
    return f"regexp_replace({c}, '[{_S}]+', '', 'g')"


def q_mask(c: str) -> str:
    t = f"regexp_replace({c}, '{P.MENTION}', '@***', 'g')"
    t = f"regexp_replace({t}, '{P.CONTACT}', '***', 'g')"
    return f"regexp_replace({t}, '{P.UID}', 'UID:***', 'g')"


TEXT_CTES = {
    "cleaned": f"SELECT * REPLACE ({q_clean('text')} AS text) FROM text_posts",
    "staged": f"""
SELECT c.*, {q_flags('text')} AS new_flags, date_diff('day', t0_date, published_date) AS day_offset,
  CASE WHEN date_diff('day', t0_date, published_date) NOT BETWEEN preheat_lo AND ferment_hi THEN 'out_of_window'
       WHEN text = '' THEN 'blank' WHEN list_contains({q_flags('text')}, 'spam') THEN 'spam' ELSE 'kept' END AS stage
FROM cleaned c JOIN studies s USING (study_id)""",
    "hashed": f"SELECT *, substr(sha1({q_squeeze('text')}), 1, 16) AS exact_hash FROM staged WHERE stage = 'kept'",
    "copies": "SELECT *, min(post_seq) OVER (PARTITION BY study_id, exact_hash) = post_seq AS is_first FROM hashed",
}


@query("sc1_clean_text", f"SELECT post_id, md5({q_clean('text')}) AS digest, length({q_clean('text')}) AS n FROM text_posts")
def sc1(t: Tables) -> DataFrame:
    c = X.clean(F.col("text"))
    return t.text_posts.select("post_id", F.md5(c).alias("digest"), F.length(c).cast("long").alias("n"))


@query("sc2_cjk_ratio", r"""
SELECT post_id, round(length(regexp_replace(text, '[^\x{4e00}-\x{9fff}]', '', 'g')) / length(text), 6) AS cjk_ratio
FROM text_posts""")
def sc2(t: Tables) -> DataFrame:
    return t.text_posts.select("post_id", F.round(X.cjk_ratio(F.col("text")), 6).alias("cjk_ratio"))


def _flagged(t: Tables) -> DataFrame:
    """post_id and the flags found in its cleaned text, which is cleaned once for all patterns."""
    cleaned = X.once(t.text_posts.select("post_id", "text"), text=X.clean(F.col("text")))
    return X.once(cleaned, found=X.detect_flags(F.col("text")))


@query("sc3_flags", "SELECT post_id, array_to_string(new_flags, ',') AS flags FROM staged", **TEXT_CTES)
def sc3(t: Tables) -> DataFrame:
    return _flagged(t).select("post_id", F.array_join("found", ",").alias("flags"))


@query("sc4_day_offset", "SELECT post_id, CAST(day_offset AS INTEGER) AS day_offset FROM dated")
def sc4(t: Tables) -> DataFrame:
    return t.dated_posts.select("post_id", "day_offset")


_HMAC = f"""substr(sha256(unhex('{bytes(b ^ 0x5c for b in SALT.ljust(64, bytes(1))).hex()}')
  || unhex(sha256(unhex('{bytes(b ^ 0x36 for b in SALT.ljust(64, bytes(1))).hex()}') || encode(anon_user_id)))), 1, 16)"""


@query("sc6_pseudonym", f"SELECT post_id, {_HMAC} AS anon_id FROM posts")
def sc6(t: Tables) -> DataFrame:
    return t.posts.select("post_id", P.pseudonym(SALT, F.col("anon_user_id")).alias("anon_id"))


@query("sc7_fallback_pseudonym",
       "SELECT post_id, substr(sha256('fallback:' || anon_user_id), 1, 16) AS anon_id FROM posts")
def sc7(t: Tables) -> DataFrame:
    return t.posts.select("post_id", P.unsalted_pseudonym(F.col("anon_user_id")).alias("anon_id"))


@query("sc8_mask_text", f"SELECT post_id, md5({q_mask('text')}) AS digest, contains({q_mask('text')}, '***') AS masked FROM text_posts")
def sc8(t: Tables) -> DataFrame:
    m = P.mask(F.col("text"))
    return t.text_posts.select("post_id", F.md5(m).alias("digest"), F.contains(m, F.lit("***")).alias("masked"))


@query("sc9_strip_tags", f"""
SELECT page_id, md5({q_strip("regexp_replace(html, '<[^>]+>', '', 'g')")}) AS digest FROM pages""")
def sc9(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", F.md5(X.strip_tags(F.col("html"))).alias("digest"))


@query("sc10_excerpts", """
SELECT post_id, substr(text, 1, 80) AS evidence, md5(substr(text, 1, 300)) AS review,
  md5(substr(text, 1, 1200)) AS request, md5(replace(text, chr(10), ' ')) AS one_line FROM text_posts""")
def sc10(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.text_posts.select(
        "post_id", X.excerpt(c, vocab.EXCERPT_CHARS).alias("evidence"),
        F.md5(X.excerpt(c, vocab.REVIEW_CHARS)).alias("review"),
        F.md5(X.excerpt(c, vocab.REQUEST_CHARS)).alias("request"), F.md5(X.one_line(c)).alias("one_line"))


@query("sc11_math", """
SELECT study_id, round(sum(ln(1 + likes)), 4) AS s_log1p, round(sum(sqrt(likes)), 4) AS s_sqrt,
  round(sum(greatest(0, least(1, (likes - 50) / 100))), 4) AS s_clip, min(likes) AS lo, max(likes) AS hi
FROM posts GROUP BY 1""")
def sc11(t: Tables) -> DataFrame:
    from ..functions import measures as M

    likes = F.col("likes")
    return t.posts.groupBy("study_id").agg(
        F.round(F.sum(F.log1p(likes)), 4).alias("s_log1p"), F.round(F.sum(F.sqrt(likes)), 4).alias("s_sqrt"),
        F.round(F.sum(M.clip01((likes - 50) / 100)), 4).alias("s_clip"),
        F.min(likes).alias("lo"), F.max(likes).alias("hi"))


@query("sc12_arrays", """
SELECT post_id, array_to_string(list_sort(list_distinct(list_concat(topics, CASE WHEN stance IS NULL THEN [] ELSE [stance, stance] END)))[1:4], ',') AS first4,
  list_contains(topics, '活动设计') AS has_topic, list_has_any(topics, ['活动设计', '地图与探索']) AS overlaps
FROM labels_last""")
def sc12(t: Tables) -> DataFrame:
    both = F.concat("topics", F.array_compact(F.array("stance", "stance")))
    return effective.last_annotation(t.annotations).select(
        "post_id", F.array_join(F.slice(F.array_sort(F.array_distinct(both)), 1, 4), ",").alias("first4"),
        F.array_contains("topics", "活动设计").alias("has_topic"),
        F.arrays_overlap("topics", F.array(F.lit("活动设计"), F.lit("地图与探索"))).alias("overlaps"))


@query("sc14_digests", "SELECT post_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM text_posts")
def sc14(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.text_posts.select("post_id", F.md5(c).alias("md5"), F.sha1(c).alias("sha1"),
                               F.sha2(c, 256).alias("sha256"))


# ---------- filters ----------

@query("flt1_study_window", """
SELECT study_id, count(*) FILTER (in_window) AS kept, count(*) FILTER (NOT in_window) AS dropped FROM dated GROUP BY 1""")
def flt1(t: Tables) -> DataFrame:
    return t.dated_posts.groupBy("study_id").agg(
        F.count_if("in_window").alias("kept"), F.count_if(~F.col("in_window")).alias("dropped"))


@query("flt2_phase", "SELECT post_id, phase FROM dated")
def flt2(t: Tables) -> DataFrame:
    return t.dated_posts.select("post_id", "phase")


@query("flt3_blank_and_spam", "SELECT post_id, stage FROM staged WHERE stage <> 'out_of_window'", **TEXT_CTES)
def flt3(t: Tables) -> DataFrame:
    return normalize.staged(t.text_posts, t.studies).where("stage <> 'out_of_window'").select("post_id", "stage")


@query("flt4_effective_posts", "SELECT study_id, post_id FROM effective")
def flt4(t: Tables) -> DataFrame:
    return effective.effective_posts(t.posts).select("study_id", "post_id")


@query("flt5_trade_filter", f"""
SELECT count(*) FILTER (NOT regexp_matches(text, '{vocab.TRADE_PATTERN}')) AS candidates,
  count(*) FILTER (regexp_matches(text, '{vocab.TRADE_PATTERN}')) AS rule_excluded FROM text_posts""")
def flt5(t: Tables) -> DataFrame:
    excluded = F.col("text").rlike(vocab.TRADE_PATTERN)
    return t.text_posts.agg(F.count_if(~excluded).alias("candidates"), F.count_if(excluded).alias("rule_excluded"))


@query("flt6_candidates", """
SELECT study_id, post_id, 'listed' AS run FROM posts WHERE likes > 100 UNION ALL
SELECT study_id, post_id, 'empty' AS run FROM posts""")
def flt6(t: Tables) -> DataFrame:
    listed = effective.restrict_to(t.posts, t.posts.where("likes > 100"))
    unlisted = effective.restrict_to(t.posts, t.posts.where("likes < 0"))
    return listed.select("study_id", "post_id", F.lit("listed").alias("run")).unionByName(
        unlisted.select("study_id", "post_id", F.lit("empty").alias("run")))


@query("flt8_topic_validity", f"""
SELECT post_id, topic, topic IN ({', '.join(f"'{x}'" for x in vocab.TOPICS)})
  OR (starts_with(topic, 'new:') AND length(topic) > 4) AS valid
FROM (SELECT post_id, unnest(list_concat(topics, CASE WHEN stance IS NULL THEN ['new:'] ELSE ['new:', stance] END)) AS topic FROM labels_last)""")
def flt8(t: Tables) -> DataFrame:
    from ..operators.labels import is_valid_topic

    rows = effective.last_annotation(t.annotations).select(
        "post_id", F.explode(F.concat("topics", F.array_compact(F.array(F.lit("new:"), F.col("stance"))))).alias("topic"))
    return rows.select("post_id", "topic", is_valid_topic(F.col("topic")).alias("valid"))


_RULES = [
    ("flag", "greeting", "(?i)hello|danke"), ("flag", "article", "(?:^| )the "), ("flag", "article", "(?:^| )das "), ("flag", "number", "[0-9]{4}"),
    ("leak", "account", "QQ:[0-9]+"), ("leak", "promotion", "抽奖$"),
    ("topic", vocab.TOPICS[0], "立绘"), ("topic", "音乐", "配乐 音乐"),
]


def _rules(t: Tables) -> rules.Rules:
    entries = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name"), F.lit(v).alias("value")) for k, n, v in _RULES])
    return rules.from_table(t.spark.range(1).select(F.inline(entries)))


@query("udf4_rules_table", r"""
SELECT post_id, array_to_string(list_filter([
    CASE WHEN regexp_matches(text, '(?:^| )the |(?:^| )das ') THEN 'article' END, CASE WHEN regexp_matches(text, '(?i)hello|danke') THEN 'greeting' END,
    CASE WHEN regexp_matches(text, '[0-9]{4}') THEN 'number' END, CASE WHEN list_contains(new_flags, 'spam') THEN 'spam' END],
    lambda f: f IS NOT NULL), ',') AS flags,
  array_to_string(list_filter([CASE WHEN regexp_matches(text, 'QQ:[0-9]+') THEN 'account' END,
    CASE WHEN regexp_matches(text, '抽奖$') THEN 'promotion' END], lambda f: f IS NOT NULL), ',') AS leaks FROM staged""", **TEXT_CTES)
def udf4_rules(t: Tables) -> DataFrame:
    """Flags and kinds of leaks by a table of patterns."""
    given = _rules(t)
    cleaned = X.once(t.text_posts, text=X.clean(F.col("text")))
    return cleaned.select(
        "post_id", F.array_join(X.detect_flags(F.col("text"), given), ",").alias("flags"),
        F.array_join(P.leak_kinds(F.col("text"), given), ",").alias("leaks"))


@query("udf4_rules_topics", f"""
SELECT post_id, topic, topic IN ('{vocab.TOPICS[0]}', '音乐') OR (starts_with(topic, 'new:') AND length(topic) > 4) AS valid
FROM (SELECT post_id, unnest(list_concat(topics, ['new:x', '音乐'])) AS topic FROM labels_last)""")
def udf4_topics(t: Tables) -> DataFrame:
    """Validity of topics by a table of topics."""
    from ..operators.labels import is_valid_topic

    rows = effective.last_annotation(t.annotations).select(
        "post_id", F.explode(F.concat("topics", F.array(F.lit("new:x"), F.lit("音乐")))).alias("topic"))
    return rows.select("post_id", "topic", is_valid_topic(F.col("topic"), _rules(t)).alias("valid"))


@query("set5_flag_union", f"""
SELECT post_id, array_to_string(list_concat(['ad'], list_filter(new_flags, lambda f: f <> 'ad')), ',') AS flags
FROM staged""", **TEXT_CTES)
def set5(t: Tables) -> DataFrame:
    return _flagged(t).select("post_id", F.array_join(F.array_union(F.array(F.lit("ad")), "found"), ",").alias("flags"))


# ---------- de-duplication ----------

@query("dd1_exact_hash", f"SELECT post_id, substr(sha1({q_squeeze('text')}), 1, 16) AS exact_hash FROM text_posts")
def dd1(t: Tables) -> DataFrame:
    return t.text_posts.select("post_id", X.exact_hash(F.col("text")).alias("exact_hash"))


@query("dd2_exact_duplicates", """
SELECT post_id, 'dg-' || substr(exact_hash, 1, 8) AS dedup_group, NOT is_first AS duplicate FROM copies""", **TEXT_CTES)
def dd2(t: Tables) -> DataFrame:
    out = normalize.normalise(t.text_posts, t.studies, near=False)
    return out.select("post_id", "dedup_group", F.array_contains("flags", "duplicate").alias("duplicate"))


@query("dd3_near_duplicates")
def dd3(t: Tables) -> DataFrame:
    """Greedy near-duplicate groups over whole texts (checked against a sequential loop in the tests)."""
    out = normalize.normalise(t.text_posts, t.studies, near=True)
    return out.select("post_id", "dedup_group", F.array_contains("flags", "duplicate").alias("duplicate"))


_SIMHASH = {
    "grams": f"""
SELECT post_id, ('0x' || substr(md5(g), 1, 16))::UBIGINT AS h FROM (
  SELECT post_id, unnest(CASE WHEN len(c) <= 2 THEN [s] ELSE
    list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1]) END) AS g
  FROM (SELECT post_id, s, string_split(s, '') AS c FROM (SELECT post_id, {q_squeeze('lower(text)')} AS s FROM text_posts)))
WHERE g <> ''""",
    "simhashes": "SELECT post_id, " + " + ".join(
        f"CASE WHEN sum(CASE WHEN (h >> {i}) & 1 = 1 THEN 1 ELSE -1 END) > 0 THEN {1 << i}::UBIGINT ELSE 0::UBIGINT END"
        for i in range(64)) + " AS simhash FROM grams GROUP BY 1",
}


@query("dd4_simhash", "SELECT post_id, format('{:X}', simhash) AS simhash FROM simhashes", **_SIMHASH)
def dd4(t: Tables) -> DataFrame:
    return normalize.simhash(t.text_posts, ["post_id"]).select("post_id", F.hex("simhash").alias("simhash"))


@query("dd5_hamming", """
SELECT a.post_id, CAST(bit_count(xor(a.simhash, b.simhash)) AS INTEGER) AS distance
FROM simhashes a JOIN simhashes b ON CAST(a.post_id AS BIGINT) + 1 = CAST(b.post_id AS BIGINT)""", **_SIMHASH)
def dd5(t: Tables) -> DataFrame:
    """Distance of each document to the next one."""
    h = normalize.simhash(t.text_posts, ["post_seq"])
    after = h.select((F.col("post_seq") - 1).alias("post_seq"), F.col("simhash").alias("next_hash"))
    return h.join(after, "post_seq").select(
        F.col("post_seq").cast("string").alias("post_id"),
        normalize.hamming(F.col("simhash"), F.col("next_hash")).alias("distance"))


@query("dd6_normalise_report")
def dd6(t: Tables) -> DataFrame:
    """Counts with near copies, which follow a sequential rule (held to it per text in the tests)."""
    stages = stage_table(normalize.staged(t.text_posts, t.studies), "stages")  # cleaned once for both counts
    return normalize.report(stages, normalize.deduplicated(stages.where("kept")))


@query("dd7_id_dedup", """
SELECT author, post_seq FROM (SELECT user_id % 40 AS author, event_type, min(event_id) AS post_seq FROM events
  GROUP BY user_id % 40, event_type)""")
def dd7(t: Tables) -> DataFrame:
    rows = t.raw("events").select((F.col("user_id") % 40).alias("author"), "event_type",
                                  F.col("event_id").alias("post_seq"))
    return normalize.keep_first_id(rows, ["author", "event_type"], "post_seq").select("author", "post_seq")


# ---------- privacy ----------

@query("prj7_overlength", "SELECT post_id, length(text) > 2000 AS overlength FROM text_posts")
def prj7(t: Tables) -> DataFrame:
    from ..operators.ingest import overlength_flags

    return t.text_posts.select("post_id", F.array_contains(overlength_flags(F.col("text")), "overlength").alias("overlength"))


def _leaky(t: Tables) -> DataFrame:
    d = F.col("post_seq")
    return t.text_posts.select(
        "post_id", "text",
        F.struct((d % 7).alias("Level"), F.concat(F.lit("https://space.bilibili.com/"), F.col("post_id")).alias("home"))
        .alias("author"),
        F.when(d % 3 == 0, F.create_map(F.lit("UID"), F.col("anon_user_id"))).alias("extra"),
        F.array(F.col("source_url"), F.concat(F.lit("see @name"), F.col("anon_user_id"))).alias("links"))


@query("pii1_forbidden_fields", """
SELECT 'author.Level' AS path, count(*) AS n FROM documents UNION ALL
SELECT 'extra.UID', count(*) FROM documents WHERE doc_id % 3 = 0""")
def pii1(t: Tables) -> DataFrame:
    found = privacy_scan.leaks(_leaky(t), "rows")
    return found.where("kind = 'forbidden_field'").select("path", "n")


_PII2 = f"""
SELECT * FROM (
SELECT 'text' AS path, 'uid' AS kind, count(*) AS n FROM text_posts WHERE regexp_matches(text, '{P.UID}') UNION ALL
SELECT 'text', 'contact', count(*) FROM text_posts WHERE regexp_matches(text, '{P.CONTACT}') UNION ALL
SELECT 'text', 'profile_url', count(*) FROM text_posts WHERE regexp_matches(text, '{P.PROFILE}') UNION ALL
SELECT 'text', 'mention', count(*) FROM text_posts
  WHERE regexp_matches(text, '{P.MENTION}') AND NOT contains(text, '***') UNION ALL
SELECT 'author.home', 'profile_url', count(*) FROM text_posts UNION ALL
SELECT 'links[]', 'mention', count(*) FROM text_posts) WHERE n > 0"""


@query("pii2_string_leaks", _PII2)
def pii2(t: Tables) -> DataFrame:
    return privacy_scan.leaks(_leaky(t), "rows").where("kind <> 'forbidden_field'").select("path", "kind", "n")


_PII3 = f"""
SELECT 'raw' AS table_name, count(*) > 0 AS refused FROM ({_PII2}) UNION ALL
SELECT 'masked', count(*) > 0 FROM (SELECT {q_mask('text')} AS m FROM text_posts)
WHERE regexp_matches(m, '{P.UID}') OR regexp_matches(m, '{P.CONTACT}') OR regexp_matches(m, '{P.PROFILE}')
  OR (regexp_matches(m, '{P.MENTION}') AND NOT contains(m, '***'))"""


@query("pii3_leak_gate", _PII3)
def pii3(t: Tables) -> DataFrame:
    raw = privacy_scan.leaks(_leaky(t), "raw")
    masked = privacy_scan.leaks(t.text_posts.select("post_id", P.mask(F.col("text")).alias("text")), "masked")

    def verdict(df: DataFrame, name: str) -> DataFrame:
        return df.agg((F.count(F.lit(1)) > 0).alias("refused")).select(F.lit(name).alias("table_name"), "refused")

    return verdict(raw, "raw").unionByName(verdict(masked, "masked"))


_PUBLIC_SQL = f"""
SELECT study_id, post_id, video_id, md5({q_mask('text')}) AS text_digest, likes, anon_user_id, source_url,
  false AS synthetic FROM text_posts"""


def _public(t: Tables) -> DataFrame:
    return privacy_scan.public_posts(t.text_posts.withColumn("published_at", F.col("published_date").cast("string")))


@query("prj16_public_posts", _PUBLIC_SQL)
def prj16(t: Tables) -> DataFrame:
    return _public(t).select("study_id", "post_id", "video_id", F.md5("text").alias("text_digest"), "likes",
                             "anon_user_id", "source_url", "synthetic")


@query("pii4_public_export", _PUBLIC_SQL)
def pii4(t: Tables) -> DataFrame:
    """Mask, scan, write, and read the written table back."""
    from ..session import stage_path

    paths = privacy_scan.export({"posts": _public(t)}, stage_path(t.spark, "public"))
    back = t.spark.read.parquet(paths["posts"])
    return back.select("study_id", "post_id", "video_id", F.md5("text").alias("text_digest"), "likes",
                       "anon_user_id", "source_url", "synthetic")


@query("pii4_public_tables", f"""
SELECT 'posts' AS table_name, study_id, post_id AS id, md5({q_mask('text')}) AS digest FROM text_posts
UNION ALL SELECT 'videos', study_id, video_id, md5(title || plays) FROM vids
UNION ALL SELECT 'evidence', study_id, post_id, md5(coalesce(stance, '') || likes) FROM relevant
UNION ALL SELECT 'metrics', study_id, topic, md5(CAST(count AS VARCHAR)) FROM topics""")
def pii4_tables(t: Tables) -> DataFrame:
    """All four tables through the gate, written and read back."""
    from ..operators import evidence
    from ..session import stage_path

    stats = F.struct(F.col("plays").alias("view"), *[F.lit(None).cast("long").alias(c) for c in ("like", "coin", "favorite", "share", "comment")])
    videos = t.videos.withColumn("published_at", F.col("published_date").cast("string")).withColumn("stats_snapshot", stats)
    posts = t.text_posts.withColumn("published_at", F.col("published_date").cast("string"))
    items = evidence.evidence_items(t.relevant, t.videos)
    metrics = t.stored["topics"].drop("topic_seq")
    paths = privacy_scan.export(privacy_scan.public_tables(posts, videos, items, metrics), stage_path(t.spark, "public"))
    back = {n: t.spark.read.parquet(p) for n, p in paths.items()}
    digest = {"posts": F.md5("text"), "videos": F.md5(F.concat("title", F.col("stats_snapshot.view").cast("string"))),
              "evidence": F.md5(F.concat(F.coalesce("stance", F.lit("")), F.col("likes").cast("string"))), "metrics": F.md5(F.col("count").cast("string"))}
    ids = {"posts": "post_id", "videos": "video_id", "evidence": "evidence_id", "metrics": "topic"}
    parts = [back[n].select(F.lit(n).alias("table_name"), "study_id", F.col(ids[n]).alias("id"), digest[n].alias("digest")) for n in back]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
