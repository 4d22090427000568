"""Personal data: base shapes against plain patterns, and identifiers that only their context tells."""

import random
import re
import time
from hashlib import sha256

from resona.llm import pii

PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    total = sum(int(x) for x in d[-1::-2])
    return (total + sum(sum(divmod(2 * int(x), 10)) for x in d[-2::-2])) % 10 == 0


def fits(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in value.split(".")),
            "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def plain(text):
    found = [(m.start(), i, m.end()) for i, (kind, p) in enumerate(PLAIN) for m in re.finditer(p, text or "") if fits(kind, m[0])]
    return sorted(found)


def listed(spans):
    return ",".join(f"{PLAIN[k][0]}:{s}:{e}" for s, k, e in spans)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, row int, items string")
    return [tuple(r) for r in pii.personal_data(df).collect()]


TEXTS = [
    None, "", "   ", "clean words only", "mail a@b.com, x.y+z@mail-1.example.co.uk.", "a@b@c.com @d.com e@ f@g h@i..j k@l.m.", "a@b.c@d.e",
    "1.2.3.4 and 256.1.1.1 and 1.2.3.4.5.6.7.8 and 0001.002.03.4 and 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 and 4111111111111111",
    "+1 (555) 123-4567. +49 30 1234 +0( ( 1 +12 ++44 20 7946 0958 00 +1-555.", "ü +33 1 23 45 67 89 é x@ü.de x@y.de", "+1.2.3.4 5.6.7.8 4111 1111 1111 1111+1 555 123 4567",
    "𝒳 a@b.de 𝒳𝒳 1.1.1.1", "tab\t9.9.9.9\n8.8.8.8", "-@-.- %@1.1.1.1"]


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(3)
    noise = ["".join(rng.choice("0123456789.+-@ (ab)") for _ in range(200)) for _ in range(300)]
    rows = list(enumerate(TEXTS + noise))
    got = {r[0]: r for r in run(spark, rows)}
    assert len(got) == len(rows)
    for doc, text in rows:
        spans = plain(text)
        assert pii.base_spans(text or "") == spans
        assert got[doc][1:5] == tuple(sum(k == i for _, k, _ in spans) for i in range(4))
        assert got[doc][5] == sha256(listed(spans).encode()).hexdigest()
        assert set(listed(spans).split(",")) <= set(got[doc][6].split(","))


def test_unseen_identifiers_are_found_by_context(spark):
    rows = [(i, f"Some text {'w' * (i % 5 + 1)} here. Please write to: user{i}@mail{i}.example.com for more of it.") for i in range(12)]
    rows += [(100 + i, f"the box listens on port of {10 + i}.0.0.{i + 1} since monday, or so they say") for i in range(10)]
    unseen = "Ordinary words. Please write to: jo@localhost for more of it."
    rows += [(200, unseen), (201, "Please write to: 2019 for more"), (202, "nothing follows the words 12345 in here"), (203, "the box listens on port of fe80:1:2::77 since monday")]
    got = {r[0]: r[6] for r in run(spark, rows)}
    at = unseen.index("jo@")
    assert got[200] == f"email:{at}:{at + len('jo@localhost')}"
    # The characters don't allow an address.
    assert got[201] == "" and got[202] == ""
    assert got[203].startswith("ip:27:")
    for i in range(12):
        assert got[i].count(":") == 2


def test_discoveries_lead_to_further_patterns(spark):
    # An unseen name stands in a pattern of seeds, and with its like in a second pattern that has no seed.
    rows = [(i, f"please write to: a{i}@b.com today") for i in range(20)]
    rows += [(100 + i, f"please write to: host{i}@internal today") for i in range(6)]
    rows += [(200 + i, f"the owner is host{i}@internal as ever") for i in range(6)]
    rows += [(300, "the owner is other@place as ever")]
    got = {r[0]: r[6] for r in run(spark, rows)}
    assert got[100] and got[200] and got[300] == "email:13:24"


def test_copies_and_clean_numbers_are_no_evidence(spark):
    copies = [(i, "the shared line says 10.0.0.1 and then 77.5 goes on") for i in range(50)]
    numbers = [(100 + i, f"in the year {1900 + i} there were {i}{i}{i}{i}{i} people and 3.14.{i} parts") for i in range(50)]
    got = run(spark, copies + numbers)
    assert all(r[6] == "ip:21:29" for r in got if r[0] < 100) and all(r[6] == "" for r in got if r[0] >= 100)


def test_repeated_rows_missing_ids_and_empty_table(spark):
    got = run(spark, [(1, "a@b.de"), (1, "a@b.de"), (1, "1.1.1.1"), (None, "x a@b.de")])
    assert sorted(r[6] for r in got) == ["email:0:6", "email:0:6", "email:2:8", "ip:0:7"]
    assert run(spark, []) == []


def test_long_texts_take_linear_time():
    for text in ("a" * 2_000_000, "1" * 2_000_000, "1." * 1_000_000, "+" * 1_000_000, "+1 " * 500_000, "@" * 1_000_000, "a.b" * 500_000 + "@"):
        start = time.time()
        base = pii.base_spans(text)
        list(pii.candidates(text, base))
        assert time.time() - start < 20
