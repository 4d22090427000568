"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import join_groups
from ..session import stage_table
from .manifest import running
from .names import fresh
from .registry import query, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
#: Rows that one window group holds on average.
ROWS_A_RANGE = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, text: Column, seed: str = "mix") -> Column:
    """Place of a row in its source's shuffled order; equal rows get equal keys, so reruns agree."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")),
                             F.md5(F.coalesce(text, F.lit("")))))


def _hex_digits(ranges: float) -> int:
    """Hexadecimal digits that tell so many ranges apart."""
    digits = 1
    while 16 ** digits < ranges:
        digits += 1
    return digits


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: source_size, weight, source_rank, target.

    All sizes together are shared by weight. A source gets at most max_epochs times its size; what it can't use
    is shared among the others by weight until none is above. Sorted by cap over weight, the capped sources come
    first, so the common level of the others follows from running sums.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sums.withColumn("source_rank", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("source_rank") - 1, F.lit(len(weights))) + 1)))
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    order = Window.orderBy(cap / F.col("weight"), "source_rank")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    leveled = ranked.withColumn("_level", level)
    # The level of the first source in order that does not reach its cap holds for all that follow it.
    free = F.min(F.when(cap >= F.col("weight") * F.col("_level"),
                        F.struct(cap / F.col("weight"), F.col("source_rank"), F.col("_level").alias("level")))).over(everything)
    return leveled.withColumn("_free", free["level"]).select(
        "source", "source_size", "source_rank", "weight",
        F.when(F.col("_free").isNull(), cap).otherwise(F.least(cap, F.col("weight") * F.col("_free"))).alias("target"))


@dataclass
class Mix:
    """rows: source, doc_id, size, key, source_size, target, copies, taken. cuts: what decides copies, one row per source.

    repeats: the keys that several equal rows had before each got its own; None where there are none.
    """

    rows: DataFrame
    cuts: DataFrame
    repeats: DataFrame | None = None


def own_key(source: Column, key: Column) -> Column:
    """Names a source and a shuffle key."""
    return F.concat(F.coalesce(F.concat(F.lit("+"), source), F.lit("")), F.lit("|"), key)


def _spread(rows: DataFrame, repeats: DataFrame | None, name: str, key: str, source: str) -> DataFrame:
    """rows with a key of its own for each of several equal rows: the first keeps theirs, the m-th gets the hash of it and m - 1.

    Equal rows are interchangeable, so whichever is which gives the same result. They are numbered over ranges, not in one group.
    """
    if repeats is None:
        return rows
    own, at, nth = fresh(rows, "_own_key", "_own_row", "_own_nth")
    named = rows.withColumn(own, own_key(F.col(source), F.col(key))).withColumn(at, F.monotonically_increasing_id())
    named = stage_table(named, f"{name}-named")
    groups = repeats.select(F.col("own").alias(own), "m")
    again = join_groups(named, groups, [own], "m", at, how="left_semi")
    marked = fresh(rows, "_own_again")[0]
    rest = join_groups(named, groups.withColumn(marked, F.lit(True)), [own], "m", at).where(F.col(marked).isNull())
    numbers = running(again.select(F.col(own).alias("own"), F.col(at).alias("at"), F.lit(1).cast("long").alias("one")), ["own"], ["at"], "one", f"{name}-numbered")
    placed = again.join(numbers.select(F.col("at").alias(at), F.col("_before").alias(nth)), at).withColumn(
        key, F.when(F.col(nth) > 0, F.md5(F.concat(F.col(key), F.lit("|"), F.col(nth).cast("string")).cast("binary"))).otherwise(F.col(key)))
    return rest.select(*rows.columns).unionByName(placed.select(*rows.columns))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix",
        weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> Mix:
    """Weighted fair queueing over the shuffled documents of every source.

    Copy e of a document finishes at virtual time (e * source_size + words of its source up to it) / target. All
    copies are sorted by finish time (ties: source, then shuffle key) and the order is cut at the total budget, the
    sum of all sizes. Running sums are made in two steps, by ranges of shuffle keys or times and inside a range, so
    that a source with most of the rows is spread over as many groups as it needs.

    Null or empty texts have size 0. A null source is a source of its own, the last. Of rows equal in source, id and text every one has its own
    place in the order (see _spread), so any number of them comes near the target. An empty table gives an empty mix. Only the named columns are read.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(source).alias("source"), F.col(doc_id).alias("doc_id"), word_count(F.col(text)).alias("size"),
                        shuffle_key(F.col(doc_id), F.col(text), seed).alias("key"))
    sized = stage_table(sized, "mix-sized")
    repeats = stage_table(sized.groupBy(own_key(F.col("source"), F.col("key")).alias("own")).agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "mix-repeats")
    repeats = None if repeats.isEmpty() else repeats
    sized = _spread(sized, repeats, "mix", "key", "source")
    per_source = stage_table(targets(sized, weights, max_epochs), "mix-targets")
    total = per_source.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("budget")).first()
    n = sized.count()
    digits = _hex_digits(n / ROWS_A_RANGE)

    ranged = sized.withColumn("_range", F.substring("key", 1, digits))
    in_range = Window.partitionBy("source", "_range").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
               .withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
               .select(F.col("source").alias("_source"), F.col("_range").alias("_r"), "_before"))
    placed = (ranged.withColumn("_in", F.sum("size").over(in_range))
              .join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_r")))
              .withColumn("_upto", F.col("_before") + F.col("_in"))
              .select("source", "doc_id", "size", "key", "_upto"))
    names = per_source.select(F.col("source").alias("_source"), "source_size", "source_rank", "target")
    placed = stage_table(placed.join(names, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), "mix-placed")

    def finish(e: Column | int) -> Column:
        words = F.lit(e) * F.col("source_size") + F.col("_upto")
        return F.when(F.col("target") > 0, words.cast("double") / F.col("target")).when(words > 0, F.lit(float("inf"))).otherwise(0.0)

    slots = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))).select(
        finish(F.col("epoch")).alias("time"), "source_rank", "key", "epoch", "size")
    # Copies that finish long after time 1 can't be reached: by then every source has its target.
    ranges = max(16, int(max_epochs * n / ROWS_A_RANGE))
    slots = slots.withColumn("_range", F.floor(F.least(F.col("time"), F.lit(4.0)) * ranges))
    sums = slots.groupBy("_range").agg(F.sum("size").alias("_sum")).withColumn(
        "_upto", F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)))
    crossing = sums.where(F.col("_upto") > total.budget).orderBy("_range").select(
        "_range", (F.col("_upto") - F.col("_sum")).alias("_before")).first()
    if crossing is None:
        inside = slots.groupBy().agg(F.max(F.struct("time", "source_rank", "key", "epoch")).alias("cut"))
    else:
        order = Window.orderBy("time", "source_rank", "key", "epoch").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        last = slots.where(F.col("_range") == crossing._range).withColumn("_run", F.sum("size").over(order)).where(
            F.col("_run") <= total.budget - crossing._before)
        before = slots.where(F.col("_range") < crossing._range)
        cut = F.max(F.struct("time", "source_rank", "key", "epoch")).alias("cut")
        inside = last.groupBy().agg(cut).unionAll(before.groupBy().agg(cut)).groupBy().agg(F.max("cut").alias("cut"))
    cut = inside.first()
    end = cut.cut if cut is not None else None

    def taken(e: int) -> Column:
        if end is None:
            return F.lit(0)
        slot = F.struct(finish(e).alias("time"), F.col("source_rank"), F.col("key"), F.lit(e).alias("epoch"))
        limit = F.struct(F.lit(end.time).alias("time"), F.lit(end.source_rank).alias("source_rank"),
                         F.lit(end.key).alias("key"), F.lit(end.epoch).alias("epoch"))
        return (slot <= limit).cast("int")

    copies = sum((taken(e) for e in range(max_epochs)), F.lit(0))
    rows = placed.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).select(
        "source", "doc_id", "size", "key", "source_size", "target", "copies", "taken")
    whole = rows.groupBy("source").agg(F.min("copies").alias("full"), F.max("copies").alias("most"),
                                       F.max(F.struct("copies", "key")).alias("last"))
    cuts = whole.select("source", "full", F.when(F.col("most") > F.col("full"), F.col("last")["key"]).alias("cut_key"))
    return Mix(rows, stage_table(cuts, "mix-cuts"), repeats)


def repeated(docs: DataFrame, mixed: Mix, doc_id: str = "doc_id", text: str = "text", source: str = "source",
             seed: str = "mix") -> DataFrame:
    """The documents as often as the mix takes them: whole rounds of the source, then those up to its last key."""
    own, full, cut, copy, key = fresh(docs, "_mix_source", "_mix_full", "_mix_cut", "_mix_copy", "_mix_key")
    keyed = _spread(docs.withColumn(key, shuffle_key(F.col(doc_id), F.col(text), seed)), mixed.repeats, "mix-docs", key, source)
    cuts = mixed.cuts.select(F.col("source").alias(own), F.col("full").alias(full), F.col("cut_key").alias(cut))
    more = (F.col(key) <= F.col(cut)).cast("int")
    times = F.col(full) + F.coalesce(more, F.lit(0))
    return (keyed.join(cuts, F.col(source).eqNullSafe(F.col(own))).withColumn(copy, F.explode(F.sequence(F.lit(0), times)))
            .where(F.col(copy) > 0).select(*docs.columns))


ORACLE = r"""
with keyed as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    md5('mix|' || coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))) as key from documents),
sized as (
  select doc_id, source, size, case when c = 0 then key else md5(key || '|' || c) end as key
  from (select *, row_number() over (partition by source, key) - 1 as c from keyed)),
sums as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source is null, source) as source_rank
  from sized group by source),
weighed as (select *, [5.0::double, 2.0, 1.0][(source_rank - 1) % 3 + 1] as weight, 3.0::double * source_size as cap from sums),
leveled as (
  select *, ((sum(source_size) over ())::double - coalesce(sum(cap) over w, 0)) / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as level
  from weighed window w as (order by cap / weight, source_rank rows between unbounded preceding and 1 preceding)),
goals as (
  select *, least(cap, weight * (select arg_min(level, (cap / weight, source_rank)) from leveled where cap >= weight * level)) as target
  from leveled),
placed as (
  select z.*, g.source_size, g.source_rank, g.target,
    sum(z.size) over (partition by z.source order by z.key range between unbounded preceding and current row) as upto
  from sized z join goals g on z.source is not distinct from g.source),
slots as (
  select *, (e * source_size + upto)::double / target as time from placed, (select unnest([0, 1, 2]) as e) x),
run as (
  select *, sum(size) over (order by time, source_rank, key, e range between unbounded preceding and current row) as total
  from (select *, row_number() over () as n from slots))
select doc_id, size, source_size, target,
  (sum(case when total <= (select sum(source_size) from sums) then size else 0 end))::bigint as taken
from run group by doc_id, source, key, size, source_size, target
"""


@query("op2_weighted_mix", ORACLE)
def op2(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).rows.select("doc_id", "size", "source_size", "target", "taken")
