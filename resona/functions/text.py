"""Text expressions: cleaning, flags, hashes, excerpts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..rules import DEFAULT, Rules

# Unicode white space as one character class, the set the cleaning rules treat as blank.
SPACE_CLASS = r"\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


# The same characters one by one, for trimming and deleting without a pattern.
SPACES = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
    0x3000]))
# Zero-width and control characters; \t, \n and \r stay.
_CONTROLS = "".join(map(chr, [0x200B, 0x200C, 0xFEFF, *range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F]))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    A plain projection of an expensive expression is copied into every later filter and
    expression that uses it. The output of a generator is not.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def drop_spaces(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def clean(text: Column) -> Column:
    """Remove control and zero-width characters, fold blanks, keep at most one empty line."""
    t = F.translate(text, _CONTROLS, "")
    t = F.regexp_replace(t, r"[ \t\r]+", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return strip(t)


def cjk_ratio(text: Column) -> Column:
    han = F.length(F.regexp_replace(text, r"[^\x{4e00}-\x{9fff}]", ""))
    return F.when(F.length(text) > 0, han / F.length(text)).otherwise(F.lit(0.0))


def has_repeat_run(text: Column) -> Column:
    return text.rlike(r"(?d)(.)\1{19,}")


def is_symbol_only(text: Column) -> Column:
    return (F.length(text) <= 4) & text.rlike(r"^(?:[^\p{L}\p{N}_]|[\x{1F000}-\x{1FAFF}])+$")


def _matches(text: Column, literals: list[str], pattern: str) -> Column:
    # (?d): only \n ends a line for ".", as in the rule set.
    return reduce(or_, [F.contains(text, F.lit(x)) for x in literals]) & text.rlike("(?d)" + pattern)


def detect_flags(text: Column, rules: Rules = DEFAULT) -> Column:
    """Flags of a cleaned text, in the fixed order lottery, ad (or those of the rules by name), spam."""
    if rules.flags is None:
        found = [F.when(_matches(text, vocab.LOTTERY_LITERALS, vocab.LOTTERY_PATTERN), F.lit("lottery")),
                 F.when(_matches(text, vocab.AD_LITERALS, vocab.AD_PATTERN), F.lit("ad"))]
    else:
        found = [F.when(text.rlike("(?d)" + p), F.lit(name)) for name, p in rules.flags]
    return F.array_compact(F.array(
        *found,
        F.when(has_repeat_run(text) | is_symbol_only(text), F.lit("spam")),
    ))


def exact_hash(text: Column) -> Column:
    return F.substring(F.sha1(drop_spaces(text)), 1, 16)


def excerpt(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)


def one_line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def strip_tags(text: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", ""))


def hash_fraction(seed: str, *keys: Column, scale: int = 10_000) -> Column:
    """Deterministic draw in 0..scale-1 from an md5 of seed and keys; independent of row order."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *keys))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.lit(scale)


def char_ngrams(text: Column, n: int) -> Column:
    """All n-character windows of a text, or the text itself when it has at most n characters.

    The look-ahead captures the window and consumes one character, so the scan is linear.
    """
    windows = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))
    return F.when(F.length(text) > n, windows).otherwise(F.array(text))


def md5_long(text: Column, hex_digits: int) -> Column:
    """The leading hex digits of the md5 digest as a (signed for 16 digits) long."""
    return F.conv(F.substring(F.md5(text), 1, hex_digits), 16, -10).cast("long")
