"""Sketches, links, components, near duplicates and repeated paragraphs against plain versions."""

import random

import numpy as np
import pytest

from resona.llm import linkage, near_dedup, substrings
from resona.llm.components import components
from resona.llm.shingles import overlap, shingle_set, words


def test_words_and_sets():
    assert words("A b\tc\n\x0b\x0c\rd e\x1cf") == [b"A", b"b", b"c", "d e\x1cf".encode()]
    assert words("ÄBC", lower=True) == ["Äbc".encode()]
    assert words(None) == words("") == []
    a, b = shingle_set("a b c d", 3), shingle_set("a b c e", 3)
    assert len(a) == 2 and overlap(a, b) == 1
    assert len(shingle_set("a b", 3)) == 1 and len(shingle_set("a a a a a", 3)) == 1
    assert overlap(shingle_set("a b", 3), shingle_set("a b b", 3)) == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    for j in (0.0, 0.5, 0.85, 1.0):
        errors = []
        for _ in range(30):
            n = 600
            shared = int(round(2 * n * j / (1 + j)))
            pool = rng.integers(0, 2 ** 63, 2 * n, dtype=np.uint64)
            a, b = pool[:n], pool[n - shared:2 * n - shared]
            ra, rb = linkage.registers(a, 128), linkage.registers(b, 128)
            assert (linkage.registers(np.concatenate([a, b]), 128) == np.maximum(ra, rb)).all()
            errors.append(linkage.estimate(ra[None], rb[None], np.array([n]), np.array([n]))[0] - j)
        assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < linkage.MARGIN


def test_bands_are_tuned():
    for rule in (near_dedup.CONTRACT, near_dedup.PIPELINE, substrings.RULE):
        t = rule.num / rule.den
        assert 1 - (1 - t ** rule.rows) ** rule.bands >= rule.recall


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 240)] + [(7, 7), (None, 3), (300, 301), (300, 301)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _plain(docs, rule):
    """component per id: all pairs, exact sets."""
    sets = [(i, rule.shingles(t)) for i, t in docs]
    label = {i: i for i, _ in docs}
    changed = True
    links = [(a, b) for k, (a, sa) in enumerate(sets) for b, sb in sets[:k] if rule.linked(sa, sb)]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def _corpus(seed=3):
    """Copies, chains of edits, a large group of near copies round a base, unrelated texts, shorts and empties."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    docs = []
    for _ in range(25):
        docs.append(text(rng.randrange(5, 150)))
    base = text(200)
    for _ in range(60):
        near = list(base)
        for _ in range(rng.randrange(0, 12)):
            near[rng.randrange(len(near))] = rng.choice(vocab)
        docs.append(near)
    step = text(120)
    for _ in range(20):
        step = list(step)
        step[rng.randrange(len(step))] = rng.choice(vocab)
        docs.append(step)
    docs += [docs[0]] * 5 + [["x"], ["x"], ["x", "y"], [], []]
    rng.shuffle(docs)
    return [(i * 3, " ".join(d)) for i, d in enumerate(docs)]


@pytest.mark.parametrize("rule", [near_dedup.CONTRACT, near_dedup.PIPELINE])
def test_near_duplicates_equal_all_pairs(spark, rule):
    docs = _corpus()
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), rule).collect()
    want = _plain(docs, rule)
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(rule.shingles(t)) for i, t in docs}


def test_near_duplicates_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(50_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (5, "A B c D"), (6, long), (7, long + " end")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 2, None, True), (4, 2, 4, True), (4, 2, 4, True),
                          (5, 2, 4, False), (6, 49_998, 6, True), (7, 49_999, 6, False)], key=str)
    kept = near_dedup.first_of_each(df, near_dedup.near_duplicates(df))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, None, 4, 6], key=str)
    empty = df.limit(0)
    assert near_dedup.near_duplicates(empty).count() == 0
    # Unlike texts under one doc_id all stay, equal ones once.
    twins = spark.createDataFrame([(1, "a b c d e"), (1, "v w x y z"), (1, "a b c d e"), (2, "k l m n o")], "doc_id long, text string")
    kept = near_dedup.first_of_each(twins, near_dedup.near_duplicates(twins))
    assert sorted(tuple(r) for r in kept.collect()) == [(1, "a b c d e"), (1, "v w x y z"), (2, "k l m n o")]


def _passages(seed=9):
    rng = random.Random(seed)
    line = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(n))
    shared, short, once = line(60), line(12), line(70)
    edited = shared.split()
    edited[20] = "changed"
    huge = line(900)
    docs = [(i, "\n".join([line(55), *([shared] if i % 3 == 0 else []), short, line(45)])) for i in range(30)]
    docs.append((100, " ".join(edited) + "\n" + line(50)))
    docs.append((101, once + "\n" + once))
    docs += [(102, line(80) + " " + huge + " " + line(80)), (103, line(33) + " " + huge)]
    return docs, {i for i in range(0, 30, 3)} | {100}, shared


def test_repeated_paragraphs(spark):
    docs, sharing, shared = _passages()
    df = spark.createDataFrame([(*d, "c", 1) for d in docs], "doc_id long, text string, component string, n_chars long")
    found = substrings.repeated_paragraphs(df)
    rows = found.collect()
    texts = dict(docs)
    lines = [r for r in rows if r.doc_id < 102 and r.paragraph < substrings.RUN_BASE]
    assert {r.doc_id for r in rows if r.doc_id < 102} == sharing
    assert {r.doc_id for r in lines} == sharing and len(lines) == len(sharing)
    assert all(r.component_doc == 0 and r.kept == (r.doc_id == 0) for r in lines)
    assert all(texts[r.doc_id][r.start:r.start + r.chars] == shared for r in lines if r.doc_id != 100)
    # The long shared run is found in pieces, whatever stands before it.
    pieces = [r for r in rows if r.doc_id == 103 and not r.kept]
    assert sum(r.words for r in pieces) > 500 and all(r.component_doc == 102 for r in pieces)
    after = {r.doc_id: r for r in substrings.without_repeats(df, found).collect()}
    assert sum(shared in r.text for r in after.values()) == 1
    assert all(after[i].text == texts[i] for i in texts if i not in sharing and i < 102)
    assert all(r.n_chars == (len(r.text) if i in sharing and i or i == 103 else 1) for i, r in after.items())


def test_passages_inside_lines(spark):
    """A passage of 60 words in the middle of unlike lines, and once as a line of its own."""
    rng = random.Random(12)
    line = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(9000)}" for _ in range(n))
    passage = line(60)
    docs = [(i, f"{line(20)}\n{line(15 + i)} {passage} {line(30)}\n{line(9)}") for i in range(8)]
    docs += [(20, passage), (21, line(90)), (22, " ".join(passage.split()[:20]) + " " + line(50))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = substrings.repeated_paragraphs(df)
    rows = found.collect()
    assert {r.doc_id for r in rows} == {*range(8), 20}
    texts = dict(docs)
    for r in rows:
        part = texts[r.doc_id][r.start:r.start + r.chars]
        assert part in passage and len(part.split()) == r.words >= substrings.RUN_WORDS and r.kept == (r.doc_id == 0)
    left = {r.doc_id: r.text for r in substrings.without_repeats(df, found).collect()}
    assert left[0] == texts[0] and left[21] == texts[21] and left[22] == texts[22]
    cut = rows[0].words
    assert all(len(left[i].split()) == len(texts[i].split()) - cut and left[i].count("\n") == 2 for i in range(1, 8))


def test_repeated_paragraphs_odd_rows(spark):
    line = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, None), (2, ""), (None, line), (3, line), (3, line), (4, line), (5, "\n\n")], "doc_id long, text string")
    found = substrings.repeated_paragraphs(df)
    assert {(r.doc_id, r.component_doc, r.kept) for r in found.collect()} == {(3, 3, True), (4, 3, False)}
    left = substrings.without_repeats(df, found)
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted([1, 2, None, 3, 3, 5], key=str)
    assert substrings.repeated_paragraphs(df.limit(0)).count() == 0


def _removed(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = substrings.repeated_paragraphs(df)
    return {r.doc_id: (r.text or "").split() for r in substrings.without_repeats(df, found).collect()}


def test_passages_over_short_lines(spark):
    """A passage of 60 words wrapped after 12 or 15 words, and a line of 36 words: only the first document keeps them."""
    rng = random.Random(21)
    words = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(9000)}" for _ in range(n)]
    wrap = lambda w, n: "\n".join(" ".join(w[i:i + n]) for i in range(0, len(w), n))
    passage, line, own = words(60), words(36), [words(30) for _ in range(6)]
    docs = [(i, wrap(own[i], 10) + "\n" + wrap(passage, 12 + 3 * i)) for i in range(2)]
    docs += [(i, wrap(own[i], 10) + "\n" + " ".join(line) + "\n" + wrap(own[i][::-1], 9)) for i in range(2, 5)]
    left = _removed(spark, docs)
    assert left[0] == own[0] + passage and left[1] == own[1]
    assert left[2] == own[2] + line + own[2][::-1] and all(left[i] == own[i] + own[i][::-1] for i in (3, 4))


def test_passages_side_by_side(spark):
    """Two passages in one line of the first document, each of them alone in a later one."""
    rng = random.Random(22)
    words = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(9000)}" for _ in range(n)]
    p, q, own = words(60), words(60), [words(30) for _ in range(4)]
    docs = [(i, " ".join(w)) for i, w in enumerate([own[0] + p + q, own[1] + p + own[1][::-1], q + own[2], own[3] + q[:40] + p])]
    left = _removed(spark, docs)
    assert left[0] == own[0] + p + q and left[1] == own[1] + own[1][::-1] and left[2] == own[2] and left[3] == own[3]


def test_every_shared_run_has_a_pick():
    rng = random.Random(23)
    words = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(9000)}" for _ in range(n)]
    for _ in range(200):
        shared, before = words(substrings.RUN_WORDS), [rng.randrange(60), rng.randrange(60)]
        texts = [" ".join(words(n) + shared + words(40)) for n in before]
        picks = [{(p - n, h) for p, h in zip(*(x.tolist() for x in substrings._places(text))) if 0 <= p - n <= substrings.RUN_WORDS - substrings.PICK_WORDS}
                 for text, n in zip(texts, before)]
        assert picks[0] & picks[1]


def test_sketches_of_many_sets_equal_single_ones():
    rng, rule = random.Random(4), substrings.RULE
    sets = [rule.shingles(" ".join(f"w{rng.randrange(500)}" for _ in range(n))) for n in (0, 1, 3, 700, 0, 50, 2000, 0)]
    assert list(zip(*linkage.sketch_all(sets, rule))) == [linkage.sketch(x, rule)[:3] for x in sets]
    assert linkage.sketch_all([], rule) == ([], [], [])


def test_ids_with_different_texts_are_left_alone(spark):
    words = [f"a{i}" for i in range(60)]
    text, own = " ".join(words), " ".join(f"b{i}" for i in range(80)) + " "
    docs = [(1, text), (2, text), (2, "another text"), (3, own + text), (3, own + text), (None, text)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = substrings.repeated_paragraphs(df)
    assert {(r.doc_id, r.kept) for r in found.collect()} == {(1, True), (3, False)}
    left = sorted(((r.doc_id, r.text) for r in substrings.without_repeats(df, found).collect()), key=str)
    assert left == sorted([*docs[:3], (3, own), (3, own), (None, text)], key=str)


def _passage_corpus(rng):
    """Documents with a group of copies, a group of near copies, passages inside lines, over lines and next to each other, and hard-wrapped paragraphs."""
    words = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(5000)}" for _ in range(n)]
    wrap = lambda w, n: "\n".join(" ".join(w[i:i + n]) for i in range(0, len(w), n))

    def edited(w):
        w = list(w)
        for _ in range(4):
            w[rng.randrange(len(w))] = words(1)[0]
        return w

    copied, near, block = words(180), words(160), words(70)
    pool = [words(rng.randrange(26, 90)) for _ in range(12)]
    docs = [" ".join(copied)] * 6 + [" ".join(words(20)) + "\n" + " ".join(edited(near)) for _ in range(25)]
    docs += [wrap(words(25), 9) + "\n\n" + wrap(edited(block), 8 + i % 5) + "\n\n" + wrap(words(25), 11) for i in range(10)]
    for _ in range(40):
        parts = [rng.choice(pool) if rng.random() < 0.5 else words(rng.randrange(5, 40)) for _ in range(rng.randrange(1, 6))]
        docs.append((" " if rng.random() < 0.5 else "\n").join(" ".join(p) for p in parts))
    # A passage of the second document's line, which is a near copy of the first's, and that a third document has elsewhere.
    line, inner = words(160), words(30)
    docs += [" ".join(line), " ".join(line[:80] + inner + line[110:]), " ".join(words(30) + inner + words(30))]
    rng.shuffle(docs)
    return list(enumerate(docs))


def _runs(text, n=substrings.RUN_WORDS):
    w = text.split()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_against_plain_counting(spark, seed):
    docs = _passage_corpus(random.Random(seed))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = substrings.repeated_paragraphs(df)
    rows = found.collect()
    left = {r.doc_id: r.text for r in substrings.without_repeats(df, found).collect()}
    texts, firsts, holders = dict(docs), {}, {}
    for doc, text in docs:
        firsts.setdefault(text, doc)
        for run in _runs(text):
            holders.setdefault(run, []).append(doc)
    # Nothing shared is lost: every run that several documents have is whole in its first one.
    shared = {run: min(ds) for run, ds in holders.items() if len(ds) > 1}
    assert all(run in _runs(left[owner]) for run, owner in shared.items())
    # Word by word, what is left: no later copy, no word of a run that another document owns, no word of a paragraph that is to go, but for the document's own runs.
    several = {run: ds[0] for run, ds in holders.items() if len({firsts[texts[d]] for d in ds}) > 1}
    n = substrings.RUN_WORDS
    for doc, text in docs:
        w = text.split()
        gone, own = [firsts[text] != doc] * len(w), [False] * len(w)
        for i in range(len(w) - n + 1):
            owner = several.get(tuple(w[i:i + n]))
            for k in range(i, i + n) if owner is not None else ():
                gone[k], own[k] = gone[k] or owner != doc, own[k] or owner == doc
        going = {r.paragraph for r in rows if r.doc_id == doc and r.paragraph < substrings.RUN_BASE and not r.kept}
        for number, start, chars, _ in substrings.paragraphs(text):
            first = len(text[:start].split())
            for k in range(first, first + len(text[start:start + chars].split())) if number in going else ():
                gone[k] = True
        assert left.get(doc, "").split() == [x for x, g, o in zip(w, gone, own) if not g or o and firsts[text] == doc]
    # Paragraphs go with the first one that they resemble, directly or over others.
    paras = {(doc, number): substrings.RULE.shingles_of(text[s:s + c].encode().split()) for doc, text in docs for number, s, c, _ in substrings.paragraphs(text)}
    linked = {}
    for a in paras:
        for b in paras:
            if a[0] != b[0] and substrings.RULE.linked(paras[a], paras[b]):
                linked.setdefault(a, set()).add(b)

    def reach(a):
        seen, todo = {a}, [a]
        while todo:
            todo += (new := linked.get(todo.pop(), set()) - seen)
            seen |= new
        return min(seen)

    whole = {d for d, t in docs if sum(t == x for x in texts.values()) > 1}
    for r in rows:
        part = texts[r.doc_id][r.start:r.start + r.chars]
        assert len(part.split()) == r.words
        if r.paragraph < substrings.RUN_BASE:
            assert reach((r.doc_id, r.paragraph)) == (r.component_doc, r.component_paragraph) and r.kept == (r.doc_id == r.component_doc)
    # Every paragraph that a paragraph of another text resembles is reported.
    got = {(r.doc_id, r.paragraph) for r in rows}
    assert {a for a in linked if a[0] not in whole} <= got


def test_near_copies_give_rows_in_proportion(spark):
    rng = random.Random(5)
    words = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(5000)}" for _ in range(n)]
    base = words(400)

    def group(n):
        out = []
        for i in range(n):
            w = list(base)
            for _ in range(8):
                w[rng.randrange(len(w))] = words(1)[0]
            out.append((i, " ".join(w)))
        return spark.createDataFrame(out, "doc_id long, text string")

    few, many = (substrings.shared_runs(group(n)).count() for n in (200, 2000))
    assert many < 14 * few and many < 2000 * 60


def test_paragraph_spans_cover_words():
    text = " ".join(f"k{i}" for i in range(1000)) + "\n" + "a b\n" + " ".join(["z"] * 50)
    spans = list(substrings.paragraphs(text))
    assert [n for n, *_ in spans] == sorted({n for n, *_ in spans})
    assert all(len(text[s:s + c].split()) == w for _, s, c, w in spans)
    assert spans[-1][3] == 50 and list(substrings.paragraphs(None)) == []
