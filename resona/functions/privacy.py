"""Pseudonyms, masking and leak tests as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from ..rules import DEFAULT, Rules
from .text import SPACE_CLASS

_BLOCK = 64

# \s and \d are Unicode-wide in the rule set, so \s is spelled out and \d becomes \p{Nd}.
MENTION = vocab.MENTION_PATTERN.replace(r"\s", SPACE_CLASS)
CONTACT = vocab.CONTACT_PATTERN.replace(r"\s", SPACE_CLASS)
UID = vocab.UID_PATTERN.replace(r"\s", SPACE_CLASS).replace(r"\d", r"\p{Nd}")
PROFILE = vocab.PROFILE_PATTERN.replace(r"\d", r"\p{Nd}")


def _pad(salt: bytes, byte: int) -> Column:
    import hashlib

    key = hashlib.sha256(salt).digest() if len(salt) > _BLOCK else salt
    return F.unhex(F.lit(bytes(b ^ byte for b in key.ljust(_BLOCK, b"\0")).hex()))


def pseudonym(salt: bytes, user_key: Column) -> Column:
    """First 16 hex digits of HMAC-SHA256(salt, user_key)."""
    inner = F.unhex(F.sha2(F.concat(_pad(salt, 0x36), F.encode(user_key, "UTF-8")), 256))
    return F.substring(F.sha2(F.concat(_pad(salt, 0x5C), inner), 256), 1, 16)


def unsalted_pseudonym(user_key: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit("fallback:"), user_key), 256), 1, 16)


def mask(text: Column) -> Column:
    t = F.regexp_replace(text, MENTION, "@***")
    t = F.regexp_replace(t, CONTACT, "***")
    return F.regexp_replace(t, UID, "UID:***")


def leak_kinds(value: Column, rules: Rules = DEFAULT) -> Column:
    """Kinds of personal data left in a string value."""
    if rules.leaks is not None:
        return F.array_compact(F.array(*[F.when(value.rlike(p), F.lit(kind)) for kind, p in rules.leaks]))
    return F.array_compact(F.array(
        F.when(value.rlike(UID), F.lit("uid")),
        F.when(value.rlike(CONTACT), F.lit("contact")),
        F.when(value.rlike(PROFILE), F.lit("profile_url")),
        F.when(value.rlike(MENTION) & ~F.contains(value, F.lit("***")), F.lit("mention")),
    ))
