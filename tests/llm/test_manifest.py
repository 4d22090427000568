"""Merkle manifest against a plain tree."""

import zlib
from hashlib import sha256

import pytest

from resona.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string, part int, _index long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def way(levels, i):
    out = []
    for level in levels[:-1]:
        out.append((i & 1, level[i ^ 1] if (i ^ 1) < len(level) else None))
        i >>= 1
    return out


def plain(rows):
    framed = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    groups = {}
    for doc, source, lang, n, text in rows:
        forged = None
        if doc is not None and n is not None and zlib.crc32(str(doc).encode()) % 7 == 0:
            forged = h(*map(framed, (doc, source, lang, n + 1, text)))
        groups.setdefault(lang, []).append((doc is not None, doc or 0, h(*map(framed, (doc, source, lang, n, text))), forged))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: levels_of([x[2] for x in sorted(groups[lang], key=lambda x: x[:3])]) for lang in order}
    top = levels_of([trees[lang][-1][0] for lang in order])
    out = []
    for at, lang in enumerate(order):
        for i, (there, doc, leaf, forged) in enumerate(sorted(groups[lang], key=lambda x: x[:3])):
            path = way(trees[lang], i) + way(top, at)
            folded = forged or leaf
            for right, other in path:
                folded = h(folded) if other is None else h(other, folded) if right else h(folded, other)
            out.append((doc if there else None, leaf, trees[lang][-1][0], top[-1][0], h(*[o for _, o in path if o]), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in manifest.manifest(df, **how).collect()), key=str)


def docs(n, langs=("en", "de", None), step=1):
    return [(i * step, "s" if i % 3 else None, langs[i % len(langs)], i if i % 5 else None, f"text {i}" if i % 4 else None) for i in range(n)]


@pytest.mark.parametrize("n", [1, 7, 900])
def test_equals_plain_tree(spark, n):
    assert run(spark, docs(n)) == plain(docs(n))


def test_several_rounds_of_slots(spark):
    # One large group, many groups of one or two, and groups of sizes around a slot array's.
    sizes = {"a": 150, "b": 17, "c": 16, "d": 4, "e": 5}
    rows = [(1000 * j + i, "s", lang, i, "t") for j, (lang, n) in enumerate(sizes.items()) for i in range(n)]
    rows += [(10_000 + i, "s", f"l{i % 40}", i, "t") for i in range(60)]
    assert run(spark, rows, bits=2) == plain(rows)


def test_sparse_negative_and_missing_ids(spark):
    far = [(x, "s", "en", 5, "t") for x in (-2 ** 63, -2 ** 63 + 1, -4097, -1, 0, 63, 64, 4095, 4096, 2 ** 40, 2 ** 63 - 1)]
    rows = [*far, (None, "s", "en", 5, "a"), (None, "s", "en", 5, "b"), (None, None, None, None, None), (7, "s", "", 2 ** 63 - 1, "")]
    assert run(spark, rows) == plain(rows)


def test_repeated_rows_and_ids(spark):
    rows = docs(50) + docs(20) + [(3, "s", "en", 1, f"other {i}") for i in range(40)] + [(3, "s", "en", 1, "same")] * 9 + [(None, "s", "en", 1, "none")] * 5
    assert run(spark, rows) == plain(rows)


def test_long_text_and_empty_table(spark):
    rows = [(1, "s", "en", 3_000_000, "ü " * 1_500_000), (2, "s", "en", 0, "")]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == []


def test_tampering_is_found(spark):
    got = run(spark, [(i, "s", "en", 1, "t") for i in range(300)])
    bad = {i for i in range(300) if zlib.crc32(str(i).encode()) % 7 == 0}
    assert bad and {r[0] for r in got if not r[6]} == bad
