"""Personal data in texts: fixed shapes as seeds, and contextual patterns bootstrapped from them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_groups
from ..session import stage_table
from .registry import query, table

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: A pattern counts with so many different known identifiers of one kind, as this share of all that stand in it.
MIN_KNOWN, MIN_CONFIDENCE = 4.0, 0.7
ROUNDS = 3
#: Words of a context are looked for in so many characters beside a span.
REACH = 100

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
#: A word with a digit or an at sign; possessive, from the word's start only, so that a text is walked once.
_MARKED = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
_GROUP = re.compile(r"[0-9().+-]+")
_EDGE = "\"'`.,;:!?()[]{}<>|*#&%$=~"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses, from their at signs: the local part is the run of its characters before, down to the last match."""
    floor = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            floor = found.end()
            yield start, floor
        at = text.find("@", max(at + 1, floor))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed shapes, by start, then kind. A match that fails its check is dropped and not tried again."""
    out = [(s, EMAIL, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
                out.append((m.start(), IP, m.end()))
        for m in _CARD.finditer(text):
            digits = _NO_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), CARD, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), PHONE, m.end()))
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Spans that could be identifiers: words with digits or an at sign, without punctuation around them, groups of numbers behind single blanks as
    one, none of which touch a base span."""
    merged: list[list[int]] = []
    for m in _MARKED.finditer(text):
        numeric = _GROUP.fullmatch(m[0]) is not None
        if merged and numeric and merged[-1][2] and m.start() == merged[-1][1] + 1 and text[m.start() - 1] == " ":
            merged[-1][1] = m.end()
        else:
            merged.append([m.start(), m.end(), numeric])
    ends, i = sorted((s, e) for s, _, e in taken), 0
    covered = 0
    for start, end, _ in merged:
        while start < end and text[start] in _EDGE:
            start += 1
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        while i < len(ends) and ends[i][0] < end:
            covered = max(covered, ends[i][1])
            i += 1
        if end > start and covered <= start:
            yield start, end


def plausible(value: str) -> int:
    """Kinds (as bits) that an unknown identifier can be, by a loose look at its characters."""
    digits, plain = len(_NO_DIGIT.sub("", value)), _GROUP.fullmatch(value.replace(" ", "")) is not None
    return (("@" in value.strip("@")) << EMAIL | (digits >= 3 and ("." in value or value.count(":") > 1)) << IP
            | (digits >= 8 and not value.count("@")) << CARD | (plain and 5 <= digits <= 15) << PHONE)


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: the two words before it, and the words on both sides. Digits in them are alike."""
    before = text[max(0, start - REACH):start].lower().split()
    after = text[end:end + REACH].lower().split()
    left = before[-1] if before else "^"
    out = [f"{before[-2] if len(before) > 1 else '^'} {left} _", f"{left} _ {after[0] if after else '$'}"]
    return [_DIGIT.sub("0", x) for x in out]


ITEM = "struct<start:int,end:int,kind:int,could:int,instance:bigint,patterns:array<string>>"


def _found(docs: DataFrame) -> DataFrame:
    """row, doc_id, items: base spans (kind from 0) and unknown candidates (kind -1) of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                base = base_spans(text) if text else []
                items = [(s, e, kind, 1 << kind) for s, kind, e in base]
                if text:
                    items += [(s, e, -1, could) for s, e in candidates(text, base) if (could := plausible(text[s:e]))]
                rows.append([(s, e, kind, could, xxhash.xxh3_64_intdigest(text[s:e].lower().encode("utf-8", "surrogatepass")) - 2 ** 63, contexts(text, s, e))
                             for s, e, kind, could in items])
            made = pa.array([[dict(zip(names, x)) for x in r] for r in rows], kind_)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), made], names=["row", "doc_id", "items"])

    names = ("start", "end", "kind", "could", "instance", "patterns")
    kind_ = pa.list_(pa.struct([*[(c, pa.int32()) for c in names[:4]], ("instance", pa.int64()), ("patterns", pa.list_(pa.string()))]))
    return docs.mapInArrow(run, f"row long, doc_id long, items array<{ITEM}>")


def graph(items: DataFrame) -> DataFrame:
    """Edges pattern, instance, kind, could, n, uses of patterns with enough different instances to count.

    kind is that of a base span, null for unknown instances; n is the number of the pattern's instances, uses that of its occurrences.
    """
    every = items.select(F.explode("items").alias("i")).select(F.explode("i.patterns").alias("pattern"), "i.instance", "i.kind", "i.could")
    edges = stage_table(every.groupBy("pattern", "instance").agg(
        F.max("kind").alias("kind"), F.bit_or("could").alias("could"), F.count(F.lit(1)).alias("times")), "pii-edges")
    counted = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.sum("times").alias("uses")).where(F.col("n") >= MIN_KNOWN)
    counted = stage_table(counted.withColumn("rows", F.col("n")), "pii-patterns")
    return stage_table(join_groups(edges, counted, ["pattern"], "rows", "instance", how="inner").select(
        "pattern", "instance", F.when(F.col("kind") >= 0, F.col("kind")).alias("kind"), "could", "n", "uses"), "pii-graph")


def _possible(kind: str, could: str) -> F.Column:
    return F.expr(f"shiftright({could}, {kind}) & 1 = 1")


def bootstrap(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, kind, confidence, n, uses of the patterns that are accepted in the end; none where no pattern is good enough.

    A round scores patterns by their known instances: the sum of the instances' confidence over the number of all its instances. Those with
    MIN_KNOWN or more in sum and MIN_CONFIDENCE or more in share are accepted, and the unknown instances in them become known with the confidence that at least one of
    their patterns is right. Base spans have confidence 1 throughout. Sums by pattern and by instance are combined before they move.
    """
    seeds = edges.where("kind is not null").select("pattern", "n", "uses", "kind", F.lit(1.0).alias("conf"))
    open_ = edges.where("kind is null").drop("kind")
    known, accepted = seeds, None
    for i in range(rounds):
        scored = known.groupBy("pattern", "kind").agg(F.sum("conf").alias("known"), F.max("n").alias("n"), F.max("uses").alias("uses")).withColumn(
            "confidence", F.col("known") / F.col("n")).where((F.col("known") >= MIN_KNOWN) & (F.col("confidence") >= MIN_CONFIDENCE))
        # At 0.7 or more a pattern has one kind only.
        accepted = stage_table(scored.select("pattern", "kind", "confidence", "n", "uses"), "pii-accepted")
        if i == rounds - 1 or accepted.isEmpty():
            break
        hits = join_groups(open_, accepted.select("pattern", "kind", "confidence", F.col("n").alias("rows")), ["pattern"], "rows", "instance", how="inner").where(
            _possible("kind", "could"))
        conf = stage_table(hits.groupBy("instance", "kind").agg(
            (1 - F.exp(F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(0.999)))))).alias("conf")), "pii-instances")
        known = seeds.unionByName(open_.join(conf, "instance").select("pattern", "n", "uses", "kind", "conf"))
    return accepted


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: one row per row of docs (doc_id, text).

    Base spans are the four fixed shapes (base_spans) over the whole text, counted by kind and digested as kind:start:end by start. They are the seeds of a
    bootstrapping over all documents: their contexts become patterns, patterns that hold enough of them and little else are accepted, and unknown
    candidates in accepted patterns are added under the pattern's kind, if their characters allow it. An added span never touches a base span, and a candidate in several
    patterns takes the most confident one's kind. spans lists both. Null texts are empty; a row without spans has empty lists; a null doc_id stays null; rows that
    share a doc_id are told apart. Copies of a text add nothing to a pattern's support, as different identifiers are counted. Long texts are walked a fixed number of times.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.monotonically_increasing_id())
    found = stage_table(_found(named), "pii-found")
    patterns = bootstrap(graph(found))
    unknown = found.select("row", F.explode(F.expr("filter(items, i -> i.kind < 0)")).alias("i")).select(
        "row", "i.start", "i.end", "i.could", F.explode("i.patterns").alias("pattern"))
    hits = join_groups(unknown, patterns.select("pattern", "kind", "confidence", "uses"), ["pattern"], "uses", "row", how="inner").where(
        _possible("kind", "could"))
    best = hits.groupBy("row", "start", "end").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("b"))
    added = best.groupBy("row").agg(F.collect_list(F.struct("start", (-F.col("b.k")).alias("kind"), "end")).alias("added"))
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    base = F.expr("array_sort(transform(filter(items, i -> i.kind >= 0), i -> named_struct('start', i.start, 'kind', i.kind, 'end', i.end)))")
    rows = found.select("row", "doc_id", base.alias("base")).join(added, "row", "left").withColumn("added", F.coalesce("added", empty))

    def listed(spans: F.Column) -> F.Column:
        kinds = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")

    counts = [F.size(F.expr(f"filter(base, s -> s.kind = {k})")).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                       listed(F.array_sort(F.concat("base", "added"))).alias("spans"))


@query("op12_contextual_pii")
def op12(spark, sf_dir):
    return personal_data(table(spark, sf_dir, "documents"))
