"""Near-duplicate groups against the rule stated for each text on its own, over small fixtures."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from resona.functions import similarity
from resona.operators import near_duplicates, normalize
from resona.plans import catalog
from resona.plans.bindings import Tables


def matches(text, head):
    """The rule for a text and an earlier head: lengths near each other, in touching buckets of six, and a ratio of 0.85."""
    gap, long = abs(len(text) - len(head)), max(len(text), len(head))
    near = abs(len(text) // 6 - len(head) // 6) <= 1 and gap <= max(3, 0.15 * long)
    return near and SequenceMatcher(None, text, head, autojunk=False).ratio() >= 0.85


def assert_heads(texts, head):
    """head[i] is what the rule says for texts in their order.

    A text without a matching earlier head is a head itself; any other belongs to the one in the lowest bucket, then the oldest.
    """
    heads = [i for i in range(len(texts)) if head[i] == i]
    for i, text in enumerate(texts):
        fitting = [h for h in heads if h < i and matches(text, texts[h])]
        assert head[i] == min(fitting, key=lambda h: (len(texts[h]) // 6, h), default=i)


def variants(rng, n, alphabet, length, edits):
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(*length))) for _ in range(max(3, n // 12))]
    out, seen = [], set()
    while len(out) < n:
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(t))
            t[at:at + rng.randint(0, 1)] = [rng.choice(alphabet)]
        s = "".join(t)
        if s not in seen and s.strip() == s and s:
            seen.add(s)
            out.append(s)
    return out


@pytest.mark.parametrize("seed,alphabet,length,edits", [
    (1, "的一是不了人我在有他这中大来上国", (4, 30), 5),
    (2, "abcde ", (8, 40), 6),
    (3, "角色设计真好探索感拉满地图不错剧情", (10, 26), 4),
])
def test_groups_follow_the_rule(spark, seed, alphabet, length, edits):
    texts = variants(random.Random(seed), 110, alphabet, length, edits)
    rows = [("s", i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "study_id string, post_seq long, text string")
    got = {r.post_seq: r.head_seq for r in near_duplicates.head_of(df).collect()}
    assert_heads(texts, got)


def test_similar_pairs_are_all_pairs(spark):
    rng = random.Random(11)
    texts = variants(rng, 80, "的一是不了人我在有他这中大来上国", (4, 30), 4)
    long = "".join(rng.choice("abcde ") for _ in range(196))
    texts += [long[:k] + "x" + long[k:] for k in (5, 60, 150)] + [long, long[:190], long[:188]]  # on both sides of the last bigram bucket
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "study_id string, post_seq long, text string")
    got = {(r.p, r.w) for r in near_duplicates.similar_pairs(df).collect()}
    assert got == {(p, w) for w in range(len(texts)) for p in range(w) if matches(texts[w], texts[p])}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab的", min_size=1, max_size=24), st.data())
def test_similar_texts_share_a_rare_bigram(text, data):
    other = list(text)
    for _ in range(data.draw(st.integers(0, 3))):
        at = data.draw(st.integers(0, len(other)))
        other[at:at + data.draw(st.integers(0, 1))] = data.draw(st.sampled_from(["", "a", "的b"]))
    other = "".join(other)
    if other and other != text and matches(text, other):
        spread = np.zeros(near_duplicates.SLOTS, np.int64)
        spread[[near_duplicates._slot(g) for g in ("ab", "的的")]] = 9
        assert set(near_duplicates.rare_bigrams(text, spread)) & set(near_duplicates.rare_bigrams(other, spread))


def test_studies_do_not_mix_and_copies_share_a_group(spark):
    text = "地图设计真好探索感拉满"
    rows = [("a", 1, text), ("a", 2, "地图设计真不错探索感拉满"), ("a", 3, text), ("b", 4, text)]
    kept = spark.createDataFrame(rows, "study_id string, post_seq long, text string").withColumn(
        "flags", F.array().cast("array<string>"))
    out = {r.post_seq: r for r in near_duplicates.mark_duplicates(kept).collect()}
    assert out[1].dedup_group == out[2].dedup_group == out[3].dedup_group
    assert [("duplicate" in out[i].flags) for i in (1, 2, 3, 4)] == [False, True, True, False]


def test_long_texts_use_the_same_measure():
    rng = random.Random(5)
    for _ in range(25):
        a = "".join(rng.choice("abcdefgh .") for _ in range(rng.randint(250, 400)))
        b = list(a)
        for _ in range(rng.randint(10, 90)):
            b[rng.randrange(len(b))] = rng.choice("abcdefgh .")
        b = "".join(b)
        assert similarity.reaches(a, b) == (SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.85)


def test_documents_follow_the_rule(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    kept = normalize.staged(t.text_posts, t.studies).where("kept").select("study_id", "post_seq", "text", "flags")
    out = {r.post_seq: r for r in near_duplicates.mark_duplicates(kept).collect()}
    rows = sorted((r.post_seq, r.text) for r in kept.collect())
    first = {}
    for seq, text in rows:
        first.setdefault("".join(text.split()), seq)
    owners = {r.post_seq: r.head_seq for r in near_duplicates.head_of(
        kept.where(F.col("post_seq").isin(list(first.values()))).select("study_id", "post_seq", "text")).collect()}
    order = [(seq, text) for seq, text in rows if first["".join(text.split())] == seq]
    place = {seq: i for i, (seq, _) in enumerate(order)}
    assert_heads([text for _, text in order], [place[owners[seq]] for seq, _ in order])
    for seq, text in rows:
        head = owners[first["".join(text.split())]]
        assert out[seq].dedup_group == out[head].dedup_group
        assert ("duplicate" in out[seq].flags) == (seq != head)


def test_report_counts_near_copies(spark):
    """dd6: a group for every text that no earlier head matches, all other texts flagged; exact copies alone give more groups."""
    sf = "/root/testdata/sf0.001"
    t = Tables(spark, sf)
    heads, rows, exact = {}, {}, {}
    for r in normalize.staged(t.text_posts, t.studies).where("kept").orderBy("post_seq").collect():
        own, seen = heads.setdefault(r.study_id, []), exact.setdefault(r.study_id, set())
        rows[r.study_id] = rows.get(r.study_id, 0) + 1
        squeezed = "".join(r.text.split())
        if squeezed not in seen and not any(matches(r.text, h) for h in own):
            own.append(r.text)
        seen.add(squeezed)
    got = {r.study_id: r for r in catalog.QUERIES["dd6_normalise_report"](spark, sf).collect() if r.kept}
    assert {s: (r.duplicate_groups, r.duplicates_flagged) for s, r in got.items()} == {s: (len(h), rows[s] - len(h)) for s, h in heads.items()}
    assert sum(map(len, heads.values())) < sum(map(len, exact.values()))
