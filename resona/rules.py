"""Vocabularies and patterns of a job, given as a table; what a table leaves out is as in vocab.

The table has the columns kind, name, value, one row per entry, in any order; entries of a kind are ordered by name.

  flag       name: the flag, value: pattern of a cleaned text; several rows of a name are alternatives
  leak       name: kind of personal data, value: pattern of a string value
  topic      name: topic, value: description that its centroid is made of
  stance, emotion, irony, intent, issue_type    name: allowed label
  forbidden  name: field that may not leave the house
  overreach, causal    value: pattern that a claim may not hold

Rows of a kind replace all defaults of this kind. Patterns are regular expressions of Spark's rlike.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab

#: Entries a table may have: they become expressions of the plan.
MAX_ENTRIES = 5_000
LABELS = {"stance": "stances", "emotion": "emotions", "irony": "irony", "intent": "intents", "issue_type": "issue_types"}
PATTERNS = ("flag", "leak", "overreach", "causal")


class RuleError(ValueError):
    """A table of rules that cannot be used; the message says which row."""


@dataclass(frozen=True)
class Rules:
    topics: dict[str, str]
    stances: list[str]
    emotions: list[str]
    irony: list[str]
    intents: list[str]
    issue_types: list[str]
    forbidden: list[str]
    overreach: list[str]
    causal: list[str]
    #: (name, pattern) in order; None: the built-in ones, which are searched behind a test for literals.
    flags: list[tuple[str, str]] | None = None
    leaks: list[tuple[str, str]] | None = None


DEFAULT = Rules(
    vocab.TOPIC_TEXT, vocab.STANCES, vocab.EMOTIONS, vocab.IRONY, vocab.INTENTS, vocab.ISSUE_TYPES, vocab.FORBIDDEN_FIELDS,
    vocab.OVERREACH_PATTERNS, vocab.CAUSAL_PATTERNS)


def _check(table: DataFrame, found: dict[str, list[tuple[str, str]]]) -> None:
    known = {"topic", "forbidden", *LABELS, *PATTERNS}
    for kind, rows in found.items():
        if kind not in known:
            raise RuleError(f"unknown kind {kind}; known: {', '.join(sorted(known))}")
        needs = [kind not in ("overreach", "causal"), kind in PATTERNS]
        for name, value in rows:
            if (needs[0] and not name) or (needs[1] and not value):
                raise RuleError(f"kind {kind}, name {name}: no {'name' if needs[0] and not name else 'pattern'}")
    patterns = [(kind, *row) for kind in PATTERNS for row in found.get(kind, [])]
    one = table.sparkSession.range(1)
    try:
        one.select(*[F.lit("").rlike(p) for _, _, p in patterns]).first()
    except PySparkException:
        for kind, name, p in patterns:
            try:
                one.select(F.lit("").rlike(p)).first()
            except PySparkException as e:
                raise RuleError(f"kind {kind}, name {name}: {p} is no pattern") from e
        raise


def from_table(table: DataFrame) -> Rules:
    """The rules of a table (kind, name, value); repeated rows count once, and more than MAX_ENTRIES are refused."""
    rows = table.select("kind", "name", "value").distinct().orderBy("kind", "name", "value").limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise RuleError(f"more than {MAX_ENTRIES} entries")
    found: dict[str, list[tuple[str, str]]] = {}
    for r in rows:
        found.setdefault(r.kind, []).append((r.name, r.value))
    _check(table, found)
    changed = {}
    for kind, entries in found.items():
        names = list(dict.fromkeys(name for name, _ in entries))
        if kind in ("flag", "leak"):
            changed[kind + "s"] = [(n, "|".join(f"(?:{v})" for m, v in entries if m == n)) for n in names]
        elif kind == "topic":
            if len(names) < len(entries):
                raise RuleError("kind topic: two descriptions of one topic")
            changed["topics"] = {n: v or "" for n, v in entries}
        elif kind in LABELS:
            changed[LABELS[kind]] = names
        elif kind == "forbidden":
            changed["forbidden"] = [n.lower() for n in names]
        else:
            changed[kind] = [v for _, v in entries]
    return replace(DEFAULT, **changed)
