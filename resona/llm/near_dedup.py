"""Near-duplicate documents: SetSketch registers in bands, estimates by likelihood, exact checks, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_groups
from ..session import stage_table
from .linkage import Rule, link, sketches, with_ids
from .registry import query, table

#: The rule of the registered query; in the pipeline five words and 0.8.
CONTRACT = Rule(words=3, lower=True, num=85, den=100)
PIPELINE = Rule(words=5, lower=False, num=80, den=100)


def near_duplicates(docs: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs (doc_id, text).

    Documents with one and the same set form a class; only the class's least doc_id goes on to the bands, so exact copies cost one row
    of a combined minimum. A document without words has n_shingles 0 and stands alone. Null texts count as empty. A null doc_id links nothing and
    is its own component (null), kept. Rows that share a doc_id are one document in the links. An empty table gives no rows.
    """
    items = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    sig = stage_table(sketches(items, rule), "near-sketches")
    own = sig.select("id", "n", "digest")
    classes = stage_table(own.where(F.col("digest").isNotNull() & F.col("id").isNotNull()).groupBy("digest").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "near-classes")
    named = sig.where("digest is not null and id is not null")
    # Most documents are alone in their class, so the others are the shorter list to leave out.
    shared = classes.where("copies > 1").select("digest", "rep", "copies")
    copies = join_groups(named.select("digest", "id"), shared, ["digest"], "copies", "id", how="inner").where("id <> rep")
    reps = stage_table(named.join(copies.select("digest", "id").distinct(), ["digest", "id"], "left_anti"), "near-reps")
    comps = link(reps.select("id", "n", "keys", "regs"), lambda ids: with_ids(items, ids, "id"), rule)
    grouped = join_groups(own, shared.select("digest", "rep", "copies"), ["digest"], "copies", "id").select(
        "id", "n", F.coalesce("rep", "id").alias("rep"))
    if comps is None:
        joined = grouped.withColumn("component", F.col("rep"))
    else:
        named_comps = comps.select(F.col("id").alias("rep"), "component")
        joined = grouped.join(named_comps, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    return joined.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"),
                         F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def first_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The documents that groups (result of near_duplicates) keeps; of rows that repeat a kept doc_id and its text one stays, unlike texts all do."""
    gone = stage_table(groups.where(~F.col("kept")).select("doc_id").distinct(), "near-gone")
    rest = with_ids(docs, gone, "doc_id", "left_anti")
    twice = stage_table(groups.where(F.col("kept") & F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id"), "near-twice")
    if twice.isEmpty():
        return rest
    again = with_ids(rest, twice, "doc_id").dropDuplicates(["doc_id", "text"])
    return with_ids(rest, twice, "doc_id", "left_anti").unionByName(again)


ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s from w),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
r as (select x, y from l union select y, x from l union select r.x, e.y from r join (select x, y from l union select y, x from l) e on r.y = e.x)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(w.doc_id, coalesce(m.m, w.doc_id)) as component_id,
  w.doc_id <= coalesce(m.m, w.doc_id) as kept
from w left join n on n.doc_id = w.doc_id left join (select x, min(y) as m from r group by x) m on m.x = w.doc_id
"""


@query("op9_setsketch_dedup", ORACLE)
def op9(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
