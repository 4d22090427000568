"""Long texts in blocks: all pairs and groups as the rule says, whatever the cells, and no row for each pair on the way."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from resona.functions import similarity
from resona.operators import long_pairs, near_duplicates

from .test_near_duplicates import assert_heads, matches


def long_texts(seed, families=9, copies=3, lengths=(200, 232), alphabet="abcdefgh "):
    """Families of near copies with some edits, of which a few are rotated, so that their blocks lie off the diagonal."""
    rng, out = random.Random(seed), []
    for _ in range(families):
        base = "".join(rng.choice(alphabet) for _ in range(rng.randint(*lengths)))
        out.append(base)
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randint(0, 40)):
                at = rng.randrange(len(t))
                t[at:at + rng.randint(0, 1)] = [rng.choice(alphabet + "的")]
            if rng.random() < 0.2:
                t = t[50:] + t[:50]
            out.append("".join(t))
    out = [t for t in dict.fromkeys(out) if len(t) >= 192 and t.strip() == t]
    rng.shuffle(out)
    return out


def block(texts):
    n = len(texts)
    return long_pairs.Block(texts, np.arange(n), np.array([len(t) // 6 for t in texts]), np.full(n, 2), np.ones(n, bool), np.ones(n, bool))


def frame(spark, texts):
    return spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "study_id string, post_seq long, text string")


@pytest.mark.parametrize("seed,alphabet", [(1, "abcdefgh "), (2, "ab"), (3, "的一是不了人我在有他这中大来上国"), (4, "aaaaaaaab ")])
def test_a_block_gives_every_pair_with_the_rule(monkeypatch, seed, alphabet):
    monkeypatch.setattr(long_pairs, "PAYS", 0)
    texts = long_texts(seed, alphabet=alphabet)
    b = block(texts)
    got = {(int(b.seq[p]), int(b.seq[w])): bool(f) for ps, w, near in long_pairs.compare(b, "every") for p, f in zip(ps, near)}
    touch = [(p, w) for w in range(len(texts)) for p in range(w) if abs(len(texts[p]) // 6 - len(texts[w]) // 6) <= 1]
    assert got == {(p, w): matches(texts[w], texts[p]) for p, w in touch}


def test_most_unlike_pairs_are_ruled_out_by_their_first_blocks(monkeypatch):
    monkeypatch.setattr(long_pairs, "PAYS", 0)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    b = block([" ".join(rng.choice(words) for _ in range(200))[:700] for _ in range(60)])
    before = int(b.open.sum())
    b.rule_out_by_runs()
    assert before > 1_000 and int(b.open.sum()) < before / 20


@pytest.mark.parametrize("texts_of_a_cell", [2_500, 4])
def test_cells_of_any_size_give_all_pairs_and_the_groups_of_the_rule(spark, monkeypatch, texts_of_a_cell):
    monkeypatch.setattr(long_pairs, "CELL_TEXTS", texts_of_a_cell)
    texts = long_texts(5, lengths=(185, 215))
    df = frame(spark, texts)
    want = {(p, w): matches(texts[w], texts[p]) for w in range(len(texts)) for p in range(w)}
    assert {(r.p, r.w) for r in near_duplicates.similar_pairs(df).collect()} == {k for k, near in want.items() if near}
    checked = near_duplicates.checked_pairs(df).collect()
    assert len({(r.p, r.w) for r in checked}) == len(checked) and all(want[r.p, r.w] == r.near for r in checked)
    assert_heads(texts, {r.post_seq: r.head_seq for r in near_duplicates.head_of(df).collect()})


def test_pairs_of_long_texts_form_no_rows(spark):
    """Each pair of long texts of touching buckets was a row that was joined to both texts."""
    texts = long_texts(6)
    assert near_duplicates.candidate_pairs(frame(spark, texts))[0].count() == 0


def test_the_check_of_long_parts_finds_the_same_blocks():
    rng = random.Random(8)
    for alphabet in ("ab", "abcdefgh ", "的一是不了人我"):
        a = "".join(rng.choice(alphabet) for _ in range(700))
        b = list(a)
        for _ in range(60):
            b[rng.randrange(len(b))] = rng.choice(alphabet)
        b = "".join(b)[3:]
        x, y = similarity._codes(a)[5:690], similarity._codes(b)[7:680]
        assert similarity._longest_by_hash(a, b, (5, 690, 7, 680)) == similarity._longest_block(x, y)
        assert similarity.reaches(a, b) == (SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.85)
