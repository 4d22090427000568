"""Merkle manifest of a dataset: leaf places by bitmap rank, levels by keyed slot arrays, proofs for every leaf."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import join_groups
from ..session import stage_table
from .registry import query, table

#: A slot array holds 2**SLOT_BITS nodes and reduces as many levels at once.
SLOT_BITS = 8
#: Bits of a word and words of a container; a container covers 4,096 ids.
WORD_BITS = 6
#: The container of rows without an id: below that of every long.
NO_ID = -(1 << 60)
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(*digests: str) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def depth(n: int) -> int:
    """Levels above n nodes."""
    return max(n - 1, 0).bit_length()


def leaf(n_chars: F.Column) -> F.Column:
    """Digest of a row of documents with this n_chars: '-' for a null, else byte count, ':' and value."""
    def framed(name: str) -> F.Column:
        value = (n_chars if name == "n_chars" else F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(framed, FIELDS)).cast("binary"), 256)


def tampered(doc_id: str = "doc_id") -> F.Column:
    """Whether 7 divides the crc32 of the decimal id; false without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 0, F.lit(False))


def running(df: DataFrame, group: list[str], order: list[str], n: str, name: str) -> DataFrame:
    """df with _before, the sum of n over the rows of the same group that come earlier in this order.

    Rows are dealt by ranges of (group, order) and written; sums inside a range are windows of bounded size, and the sums of whole ranges are one
    row per range and group. Rows that are equal in group and order must be equal in all.
    """
    ranged = stage_table(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), name)
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*group, "_part").agg(F.sum(n).alias("_sum")).select(
        *group, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    return ranged.withColumn("_inside", F.coalesce(F.sum(n).over(inside), F.lit(0))).join(offsets, [*group, "_part"]).withColumn(
        "_before", F.col("_inside") + F.col("_offset")).drop("_part", "_inside", "_offset")


def ranked(rows: DataFrame, group: str, id_: str, tie: str) -> DataFrame:
    """rows (a stored table, ids as longs) with _index, the place of each among the rows of its group by id, and _total, their number.

    Every group's ids become a bitmap, merged from the tasks' parts by OR: words of 64 ids, of which a container of 64 words stores those that
    are not empty, with the popcounts before each (its directory) and the number of rows before the container. A row's place is the sum of
    these and the popcount below its bit; the rows themselves are not sorted. Rows without an id come first. Repeated ids
    are counted beside the bitmap and take their places by `tie`; rows equal in that too are interchangeable.
    """
    places = rows.withColumn("_word", F.coalesce(F.shiftright(id_, WORD_BITS), F.lit(NO_ID))).withColumn(
        "_bit", F.coalesce(F.col(id_).bitwiseAND((1 << WORD_BITS) - 1), F.lit(0)).cast("int")).withColumn(
        "_container", F.shiftright("_word", WORD_BITS))
    words = stage_table(places.groupBy(group, "_container", "_word").agg(
        F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("bits"), F.count(F.lit(1)).alias("n")), "manifest-words")
    crowded = words.where(F.col("n") > F.bit_count("bits")).select(group, "_word", "n")
    repeats = None if crowded.isEmpty() else stage_table(
        join_groups(places, crowded, [group, "_word"], "n", id_, how="left_semi").groupBy(group, "_container", "_word", "_bit").agg(
            F.count(F.lit(1)).alias("m")).where("m > 1"), "manifest-repeats")
    if repeats is None:
        words = words.withColumn("more", F.expr("cast(array() as array<struct<bit:int,extra:bigint>>)"))
    else:
        more = repeats.groupBy(group, "_word").agg(F.collect_list(F.struct(F.col("_bit").alias("bit"), (F.col("m") - 1).alias("extra"))).alias("more"))
        words = words.join(more, [group, "_word"], "left").withColumn(
            "more", F.coalesce("more", F.expr("cast(array() as array<struct<bit:int,extra:bigint>>)")))
    containers = words.groupBy(group, "_container").agg(
        F.array_sort(F.collect_list(F.struct("_word", "bits", "n", "more"))).alias("words"), F.sum("n").alias("n"))
    # _top tells which words are there; _ranks counts the rows before each of them.
    containers = containers.select(
        group, "_container", "n",
        F.expr("aggregate(words, 0L, (t, w) -> t | shiftleft(1L, cast(w._word & 63 as int)))").alias("_top"),
        F.expr("transform(words, w -> w.bits)").alias("_bits"),
        F.expr("transform(words, w -> w.more)").alias("_more"),
        F.expr("transform(sequence(0, size(words) - 1), i -> aggregate(slice(words, 1, i), 0L, (t, w) -> t + w.n))").alias("_ranks"))
    directory = running(containers, [group], ["_container"], "n", "manifest-containers")
    totals = directory.groupBy(group).agg(F.sum("n").alias("_total"), F.count(F.lit(1)).alias("containers"))
    directory = stage_table(join_groups(directory, totals, [group], "containers", "_container", how="inner"), "manifest-directory")

    found = join_groups(places, directory, [group, "_container"], "n", tie, how="inner")
    below = "~shiftleft(-1L, {})"
    at = f"bit_count(_top & {below.format('cast(_word & 63 as int)')})"
    index = F.expr(f"_before + _ranks[{at}] + bit_count(_bits[{at}] & {below.format('_bit')})"
                   f" + aggregate(filter(_more[{at}], m -> m.bit < _bit), 0L, (t, m) -> t + m.extra)")
    if repeats is None:
        return found.select(*rows.columns, index.alias("_index"), "_total")
    keys = [group, "_word", "_bit"]
    named = stage_table(found.select(*rows.columns, "_word", "_bit", index.alias("_index"), "_total").withColumn(
        "_row", F.monotonically_increasing_id()), "manifest-ranks")
    again = join_groups(named, repeats.select(*keys, "m"), keys, "m", "_row", how="left_semi")
    once = join_groups(named, repeats.select(*keys, "m", F.lit(True).alias("_again")), keys, "m", "_row").where("_again is null").drop("_again")
    placed = running(again.withColumn("_one", F.lit(1).cast("long")), keys, [tie, "_row"], "_one", "manifest-ties").withColumn(
        "_index", F.col("_index") + F.col("_before"))
    return once.select(*rows.columns, "_index", "_total").unionByName(placed.select(*rows.columns, "_index", "_total"))


def reduce_slots(nodes: list[str], levels: int) -> tuple[str, list[list[str]]]:
    """Digest above a slot array after so many levels, and the nodes of every level below that.

    Two neighbours become their digest, a last one alone its own.
    """
    tiers = []
    for _ in range(levels):
        tiers.append(nodes)
        nodes = [hashed(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], tiers


def path_of(tiers: list[list[str]], slot: int) -> tuple[list[str], str]:
    """Siblings of a slot level by level, and for each level their side: l, r, or - where there is none."""
    siblings, sides = [], []
    for tier in tiers:
        other = slot ^ 1
        if other < len(tier):
            siblings.append(tier[other])
        sides.append("-" if other >= len(tier) else "l" if slot & 1 else "r")
        slot >>= 1
    return siblings, "".join(sides)


def fold(digest: str, siblings: list[str], sides: str) -> str:
    """The root that a digest and its siblings lead to."""
    left = iter(siblings)
    for side in sides:
        digest = hashed(next(left), digest) if side == "l" else hashed(digest, next(left)) if side == "r" else hashed(digest)
    return digest


def _blocks(nodes: DataFrame, group: str, columns: list[str], bits: int) -> DataFrame:
    """group, block, total, slots: nodes (group, _index, _total, digest, ...) as slot arrays of 2**bits places."""
    return nodes.groupBy(group, F.shiftright("_index", bits).alias("block")).agg(
        F.first("_total").alias("total"),
        F.array_sort(F.collect_list(F.struct(F.col("_index").bitwiseAND((1 << bits) - 1).cast("int").alias("slot"), *columns))).alias("slots"))


def _reduced(blocks: DataFrame, group: str, bits: int) -> DataFrame:
    """The node above every slot array: group, _index, _total, digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            totals = b.column("total").to_pylist()
            digests = [reduce_slots([s["digest"] for s in slots], min(bits, depth(total)))[0]
                       for slots, total in zip(b.column("slots").to_pylist(), totals)]
            yield pa.RecordBatch.from_arrays(
                [b.column(group), b.column("block"), pa.array([((t - 1) >> bits) + 1 for t in totals], pa.int64()), pa.array(digests, pa.string())],
                names=[group, "_index", "_total", "digest"])

    return blocks.select(group, "block", "total", F.expr("transform(slots, s -> named_struct('digest', s.digest))").alias("slots")).mapInArrow(
        run, f"{group} string, _index long, _total long, digest string")


_PATH = "siblings array<string>, sides string"


def _paths(blocks: DataFrame, above: DataFrame, group: str, bits: int) -> DataFrame:
    """Paths of the nodes in slot arrays: group, _index, siblings, sides, top; above: the same of the slot arrays' own nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for key, block, total, slots, siblings, sides, top in zip(*(b.column(c).to_pylist() for c in (
                    group, "block", "total", "slots", "siblings", "sides", "top"))):
                _, tiers = reduce_slots([s["digest"] for s in slots], min(bits, depth(total)))
                for slot in range(len(slots)):
                    own, side = path_of(tiers, slot)
                    for column, value in zip(out, (key, (block << bits) + slot, own + siblings, side + sides, top)):
                        column.append(value)
            kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[group, "_index", "siblings", "sides", "top"])

    joined = blocks.select(group, "block", "total", F.expr("transform(slots, s -> named_struct('digest', s.digest))").alias("slots")).join(
        above.withColumnRenamed("_index", "block"), [group, "block"])
    return joined.mapInArrow(run, f"{group} string, _index long, {_PATH}, top string")


def tree(blocks: DataFrame, group: str, bits: int, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """Roots (group, _total = 1, digest) of all groups' trees over slot arrays, and the stored slot arrays of the upper levels, lowest first.

    A round reduces `bits` levels of every group; there are as many as the largest group needs. Groups that are done keep their node.
    """
    nodes, rounds = stage_table(_reduced(blocks, group, bits), f"{name}-nodes"), []
    while not nodes.where("_total > 1").isEmpty():
        rounds.append(stage_table(_blocks(nodes, group, ["digest"], bits), f"{name}-slots"))
        nodes = stage_table(_reduced(rounds[-1], group, bits), f"{name}-nodes")
    return nodes, rounds


def paths(rounds: list[DataFrame], above: DataFrame, group: str, bits: int, name: str) -> DataFrame:
    """Paths of the lowest slot arrays' own nodes, from those of the roots (group, _index = 0, siblings, sides, top) down."""
    for blocks in reversed(rounds):
        above = stage_table(_paths(blocks, above, group, bits), f"{name}-paths")
    return above


def manifest(docs: DataFrame, bits: int = SLOT_BITS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per row of docs (doc_id, source, lang, n_chars, text).

    A tree per lang over its leaves by doc_id, and one tree over the langs' roots (null first, then by bytes). proof_sha256 is the digest of all siblings on
    the way from the leaf to the root, and folded_root what the leaf and they lead to; where `tampered` holds the leaf is taken of
    n_chars + 1. Null fields are hashed as '-'; a null lang is a group of its own; rows without doc_id stand first in their group and are never tampered with;
    rows that share a doc_id are ordered by their leaf. A tampered row without n_chars stays as it was and is verified. Other columns are ignored, an
    empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"), "text")
    # An own name for the null group, before all others in byte order.
    key = F.coalesce(F.concat(F.lit("+"), F.col("lang")), F.lit(""))
    forged = F.when(tampered() & F.col("n_chars").isNotNull(), leaf(F.col("n_chars").cast("decimal(20,0)") + 1))
    leaves = stage_table(docs.select(key.alias("part"), "doc_id", leaf(F.col("n_chars")).alias("digest"), forged.alias("forged")), "manifest-leaves")
    blocks = stage_table(_blocks(ranked(leaves, "part", "doc_id", "digest"), "part", ["digest", "doc_id", "forged"], bits), "manifest-slots")
    subroots, rounds = tree(blocks, "part", bits, "manifest")

    # The tree over the groups' roots, whose places are running counts.
    count = subroots.agg(F.count(F.lit(1)).alias("_total"))
    one = subroots.select("part", "digest", F.lit("").alias("whole"), F.lit(1).cast("long").alias("one"))
    tops = running(one, ["whole"], ["part"], "one", "manifest-parts").select(
        "whole", "part", "digest", F.col("_before").alias("_index")).crossJoin(F.broadcast(count))
    tops = stage_table(tops, "manifest-tops")
    top_blocks = stage_table(_blocks(tops, "whole", ["digest"], bits), "manifest-top-slots")
    roots, top_rounds = tree(top_blocks, "whole", bits, "manifest-top")
    start = roots.select("whole", F.lit(0).cast("long").alias("_index"), F.expr("cast(array() as array<string>)").alias("siblings"),
                         F.lit("").alias("sides"), F.col("digest").alias("top"))
    top_paths = _paths(top_blocks, paths(top_rounds, start, "whole", bits, "manifest-top"), "whole", bits)
    part_paths = stage_table(tops.select("whole", "part", "_index", F.col("digest").alias("subroot")).join(top_paths, ["whole", "_index"]).select(
        "part", F.lit(0).cast("long").alias("_index"), "siblings", "sides", F.concat_ws(" ", "subroot", "top").alias("top")), "manifest-part-paths")
    above = paths(rounds, part_paths, "part", bits, "manifest").withColumnRenamed("_index", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for total, slots, siblings, sides, top in zip(*(b.column(c).to_pylist() for c in ("total", "slots", "siblings", "sides", "top"))):
                subroot, root = top.split(" ")
                _, tiers = reduce_slots([s["digest"] for s in slots], min(bits, depth(total)))
                for i, s in enumerate(slots):
                    own, side = path_of(tiers, i)
                    folded = fold(s["forged"] or s["digest"], own + siblings, side + sides)
                    out.append((s["doc_id"], s["digest"], subroot, root, hashed(*own, *siblings), folded, folded == root))
            columns = list(zip(*out)) if out else [()] * len(kind)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kind.types)], schema=kind)

    kind = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])
    return blocks.join(above, ["part", "block"]).mapInArrow(
        run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


#: crc32 is spelled out, as the comparison engine has none; proofs are lists of side and sibling.
ORACLE = """
with recursive d as (
  select doc_id, source, lang, n_chars, text,
    list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(coalesce(doc_id::varchar, ''), ''), lambda c: ord(c)::bigint)),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) as crc
  from documents),
f as (
  select doc_id, lang, n_chars, doc_id is not null and n_chars is not null and xor(crc, 4294967295) % 7 = 0 as bad,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as head,
    coalesce(strlen(text) || ':' || text, '-') as tail from d),
l as (
  select doc_id, lang, sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) as leaf,
    case when bad then sha256(head || strlen((n_chars::hugeint + 1)::varchar) || ':' || (n_chars::hugeint + 1) || tail) end as forged from f),
p as materialized (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from l),
t as (
  select lang, 0 as level, i, leaf as h, n from p
  union all
  select lang, any_value(level) + 1, i // 2, sha256(string_agg(h, '' order by i)), any_value((n + 1) // 2) from t where n > 1 group by lang, i // 2),
s as (select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as i, count(*) over () as n from t where n = 1),
u as (
  select 0 as level, i, subroot as h, n from s
  union all
  select any_value(level) + 1, i // 2, sha256(string_agg(h, '' order by i)), any_value((n + 1) // 2) from u where n > 1 group by i // 2),
lower_path as (
  select p.doc_id, p.lang, p.leaf, p.i, list(case when o.h is null then '-' when o.i < t.i then 'l' || o.h else 'r' || o.h end order by t.level) as path
  from p join t on t.lang is not distinct from p.lang and t.n > 1 and t.i = p.i >> t.level
  left join t o on o.lang is not distinct from t.lang and o.level = t.level and o.i = xor(t.i, 1) group by all),
upper_path as (
  select s.lang, list(case when o.h is null then '-' when o.i < u.i then 'l' || o.h else 'r' || o.h end order by u.level) as path
  from s join u on u.n > 1 and u.i = s.i >> u.level left join u o on o.level = u.level and o.i = xor(u.i, 1) group by all),
r as (
  select p.doc_id, p.leaf, s.subroot, (select h from u where n = 1) as root, coalesce(p.forged, p.leaf) as given,
    list_concat(coalesce(a.path, []), coalesce(b.path, [])) as path
  from p join s on s.lang is not distinct from p.lang
  left join lower_path a on a.lang is not distinct from p.lang and a.i = p.i left join upper_path b on b.lang is not distinct from p.lang),
g as (
  select *, sha256(array_to_string(list_transform(path, lambda x: substr(x, 2)), '')) as proof_sha256,
    list_reduce(list_prepend(given, path), lambda a, x:
      case x[1] when 'l' then sha256(substr(x, 2) || a) when 'r' then sha256(a || substr(x, 2)) else sha256(a) end) as folded_root
  from r)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from g
"""


@query("op11_merkle_manifest", ORACLE)
def op11(spark, sf_dir):
    return manifest(table(spark, sf_dir, "documents"))
