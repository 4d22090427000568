"""Mixing, token totals, fingerprints, archives, search and grading against plain versions."""

import base64
import gzip
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from resona.llm import fingerprints, knn, mixing, quality, token_counts, warc
from resona.session import stage_path
from tests.check_oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_voronoi_knn", "op2_weighted_mix", "op7_chat_format", "op8_warc", "op9_setsketch_dedup"])
def test_query_equals_sql(spark, name):
    assert compare(spark, duck(SF), E.queries()[name], E.oracle_sql()[name], SF) is None


# Mixing

def _targets(sizes):
    """Targets by handing on the excess round after round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    free, left, out = set(names), float(sum(sizes.values())), {}
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * sizes[s]} if free else set()
        if not over:
            return {**out, **{s: left * weight[s] / total for s in free}}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= over


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        source = rng.choice(["a"] * 12 + ["b", "c", "tiny", None, "é"])
        rows.append((i, " ".join(["w"] * rng.randrange(0, 60)) if rng.random() > 0.05 else None, source))
    rows += [rows[5], rows[5]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix(df)
    out = got.rows.collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = _targets(sizes)
    assert len(out) == len(rows)
    for s, size in sizes.items():
        own = [r for r in out if r.source == s]
        assert {r.source_size for r in own} == {size} and math.isclose(own[0].target, want[s])
        assert abs(sum(r.taken for r in own) - want[s]) <= 120
    assert all(0 <= r.copies <= 3 and r.taken == r.copies * r.size for r in out)
    assert sum(r.taken for r in out) <= sum(sizes.values())
    again = mixing.mix(df.repartition(5)).rows.collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    copies = mixing.repeated(df, got).groupBy("doc_id").count().collect()
    named = {}
    for r in out:
        named[r.doc_id] = named.get(r.doc_id, 0) + r.copies
    assert {r.doc_id: r["count"] for r in copies} == {k: v for k, v in named.items() if v}


def test_mix_of_equal_rows(spark):
    """Very many equal rows are taken one by one, so their source comes near its target, in the comparison SQL too."""
    rows = [(1, "w " * 100, "a", 7)] * 300 + [(i, "w " * 20, "b", 7) for i in range(200)] + [(None, "x y", None, 7)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _before int")
    mixed = mixing.mix(df)
    got = mixed.rows.collect()
    assert len(got) == len(rows)
    for source in ("a", "b", None):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 200 and max(r.taken for r in own) <= 3 * own[0].size
    again = mixing.mix(df.repartition(7)).rows
    listed = lambda d: sorted(d.select("doc_id", "source", "size", "taken").collect(), key=str)
    assert listed(again) == listed(mixed.rows)
    out = mixing.repeated(df, mixed)
    assert out.columns == df.columns
    words = {r.source: r.n for r in out.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert all(words.get(s, 0) == sum(r.taken for r in got if r.source == s) for s in ("a", "b", None))
    import duckdb

    con = duckdb.connect()
    documents = df.toArrow()  # noqa: F841
    sql = con.sql(mixing.ORACLE).fetchall()
    assert sorted(sql, key=str) == sorted([(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got], key=str)


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix(df).rows.collect()] == [(0, 0.0, 0)] * 2
    empty = mixing.mix(df.limit(0))
    assert empty.rows.count() == 0 and mixing.repeated(df.limit(0), empty).count() == 0


# Token totals

def test_rollup_follows_changes(spark):
    schema = "doc_id long, op string, source string, lang string, version string, tokens long"
    path = stage_path(spark, "test-rollup")
    rollup = token_counts.TokenRollup(spark, path)
    assert rollup.totals().count() == 0
    batches = [
        ("b1", [(1, "insert", "s", "en", "v1", 10), (2, "insert", "s", "en", "v1", 5), (2, "insert", "s", "en", "v2", 7), (3, "insert", None, None, "v1", None),
                (1, "insert", "s", "en", "v1", 10), (None, "insert", "s", "en", "v1", 99), (4, "insert", "s", "en", None, 99)]),
        ("b2", [(1, "revise", "s", "fr", "v1", 12), (2, "delete", None, None, "v1", None), (9, "delete", None, None, None, None)]),
        ("b3", [(2, "delete", None, None, None, None), (2, "insert", "s", "en", "v1", 1), (3, "revise", None, None, "v1", 4)]),
    ]
    states = [{("s", "en", "v1"): (2, 15), ("s", "en", "v2"): (1, 7), (None, None, "v1"): (1, 0)},
              {("s", "fr", "v1"): (1, 12), ("s", "en", "v2"): (1, 7), (None, None, "v1"): (1, 0)},
              {("s", "fr", "v1"): (1, 12), (None, None, "v1"): (1, 4)}]
    for (name, rows), want in zip(batches, states):
        df = spark.createDataFrame(rows, schema)
        assert rollup.apply(name, df) and not rollup.apply(name, df)
        # A fresh reader sees the same totals.
        got = {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in token_counts.TokenRollup(spark, path).totals().collect()}
        assert got == want


def test_batch_without_mark_is_written_again(spark):
    path = stage_path(spark, "test-rollup")
    rollup = token_counts.TokenRollup(spark, path)
    rows = spark.createDataFrame([(1, "insert", "s", "en", "v1", 10)], "doc_id long, op string, source string, lang string, version string, tokens long")
    rollup.apply("b1", rows)
    jvm = spark._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/deltas/b1/_SUCCESS")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).delete(mark, False)
    assert rollup.committed() == [] and rollup.totals().count() == 0
    assert rollup.apply("b1", rows)
    assert [(r.docs, r.tokens) for r in rollup.totals().collect()] == [(1, 10)]


def test_token_query_equals_plain_counts(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{token_counts.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb"))}
    enc = tiktoken.Encoding("t", pat_str=token_counts.BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = duck(SF).execute("select doc_id, source, lang, coalesce(text, '') from documents order by doc_id").fetchall()
    seen, want = set(), {}
    for doc_id, source, lang, text in docs:
        if text in seen:
            continue
        seen.add(text)
        short = "\n".join(dict.fromkeys(text.split("\n")))
        for version, n in (("words", len(short.encode().split())), ("byte_bpe_50k", len(enc.encode_ordinary(short)))):
            at = want.setdefault((source, lang, version), [0, 0])
            at[0] += 1
            at[1] += n
    got = {(r.source, r.lang, r.version): [r.docs, r.tokens] for r in E.queries()["op3_token_rollup"](spark, SF).collect()}
    assert got == want


# Fingerprints

def test_sketch_answers():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2 ** 63, 4000, dtype=np.uint64) * np.uint64(2)
    a, b = fingerprints.BottomK(pool[:2000]), fingerprints.BottomK(pool[1000:3000])
    assert abs(a.resemblance(b) - 1 / 3) < 0.13 and abs(a.containment(b) - 0.5) < 0.2 and abs(a.distinct() / 2000 - 1) < 0.3
    assert str(a.merge(b)) == str(fingerprints.BottomK(pool[:3000])) and str(fingerprints.BottomK.parse(str(a))) == str(a)
    small, other = fingerprints.BottomK.of("a b c d e f"), fingerprints.BottomK.of("a b c d e g")
    assert small.distinct() == 2 and small.resemblance(other) == 1 / 3 and small.containment(other) == 0.5
    none = fingerprints.BottomK.of(None)
    assert none.resemblance(fingerprints.BottomK.of(" ")) == 1 and none.resemblance(small) == 0 and str(none) == ""
    text = "r r r r r r r r " * 3000 + " ".join(f"w{i}" for i in range(3000))
    assert str(fingerprints.BottomK.of(text)) == str(fingerprints.BottomK(fingerprints.shingle_hashes(fingerprints.words(text), 5)))


def test_fingerprints_of_edited_texts(spark):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(rng.randrange(0, 80)))) for i in range(0, 400, 3)]
    texts += [(-5, None), (1000, ""), (1001, "é" * 10_001), (1002, "one")]
    df = spark.createDataFrame([(*t, 0) for t in texts], "doc_id long, text string, range int").repartition(7)
    got = {r.doc_id: r for r in fingerprints.fingerprints(df).collect()}
    order = sorted(((i, t or "") for i, t in texts), reverse=True)
    assert len(got) == len(texts)
    for at, (i, t) in enumerate(order):
        after = order[(at + 1) % len(order)][1]
        new = t[:len(t) - len(t) // 3] + after[:len(t) // 3]
        own, changed, nxt = (fingerprints.BottomK.of(x) for x in (t, new, after))
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (str(own), str(changed))
        assert (r.near_edited, r.near_next) == (own.resemblance(changed), own.resemblance(nxt))
    one = fingerprints.fingerprints(spark.createDataFrame([(1, "abc d")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abc a").hexdigest() and one[0].near_next == 1
    twice = fingerprints.fingerprints(spark.createDataFrame([(1, "b"), (1, "b"), (None, "x")], "doc_id long, text string")).collect()
    assert len(twice) == 3
    assert fingerprints.fingerprints(df.limit(0)).count() == 0


def test_parts_merge(spark):
    parts = [(k, str(fingerprints.BottomK.of(" ".join(f"{k}{i}" for i in range(j, j + 200))))) for k in "ab" for j in range(0, 2000, 150)]
    got = {r.k: r.s for r in fingerprints.merge_parts(spark.createDataFrame(parts, "k string, s string").repartition(5), "k", "s").collect()}
    for k in "ab":
        whole = fingerprints.BottomK.of("")
        for at, s in parts:
            whole = whole.merge(fingerprints.BottomK.parse(s)) if at == k else whole
        assert got[k] == str(whole)


# Archives

def test_archives(spark):
    big, bigger = "ä" * 600, "<p>" + "x" * 3_000_000
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, big), (4, "http://c\r\nX: y", "small"), (5, "http://d", "small"), (6, "u", ""), (7, "u", bigger),
            (8, "u", "a\r\n\r\nWARC/1.1\r\n\r\n"), (None, "u", big)]
    top = stage_path(spark, "test-warc")
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, payload string, digest_ string").repartition(2)
    warc.write_streams(warc.revisits(df.select("page_id", "url", "payload")), f"{top}/streams")
    index = warc.normalise(spark, warc.files_of(spark, f"{top}/streams", ".gz"), f"{top}/archives").collect()
    files = warc.files_of(spark, f"{top}/archives", ".warc.gz")
    back = {r.record_id: r for r in warc.read_archives(spark, files).collect()}
    assert len(index) == len(rows) and len(back) == len(rows)
    for r in index:
        path = r.file.removeprefix("file:")
        with open(path, "rb") as f:
            f.seek(r.offset)
            member = gzip.decompress(f.read(r.length))
        assert member.startswith(b"WARC/1.1\r\n") and member.endswith(b"\r\n\r\n")
    kinds = {i: back[f"<urn:page:{i}>"] for i in range(1, 9)}
    assert [kinds[i].record_type for i in range(1, 9)] == ["revisit", "revisit"] + ["response"] * 6
    assert kinds[1].refers_to == kinds[2].refers_to == "<urn:page:3>" and kinds[1].content_bytes == 0 and kinds[1].payload_bytes == 1200
    for i, _, text in rows[2:8]:
        assert kinds[i].content_sha1 == kinds[i].digest == hashlib.sha1(text.encode()).hexdigest()
    assert back[None].record_type == "response"
    # A second run of the normaliser replaces its files by equal ones.
    assert sorted(map(str, warc.normalise(spark, warc.files_of(spark, f"{top}/streams", ".gz"), f"{top}/archives").collect())) == sorted(map(str, index))


def test_no_pages(spark):
    top = stage_path(spark, "test-warc")
    none = spark.createDataFrame([], "page_id long, url string, payload string")
    warc.write_streams(warc.revisits(none), f"{top}/streams")
    assert warc.normalise(spark, warc.files_of(spark, f"{top}/streams", ".gz"), f"{top}/archives").count() == 0


# Search

def _brute(rows, k=10):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v in ok), default=0)
    ok = [(i, v + [0] * (width - len(v))) for i, v in ok]
    asks = {}
    for i, v in ok:
        if i % 100 == 0:
            asks[i] = max(asks.get(i, v), v)
    out = set()
    for q, qv in asks.items():
        best = sorted((-max(-2 ** 63, min(2 ** 63 - 1, sum(a * b for a, b in zip(qv, v)))), i) for i, v in ok if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("sizes", [dict(pivots=4, block=2, slice_rows=50), dict()])
def test_top_k_is_exact(spark, sizes):
    rng = np.random.default_rng(8)
    centre = rng.normal(0, 3, (5, 6))
    rows = [(i, (centre[i % 5] + rng.normal(0, 0.2, 6)).tolist()) for i in range(0, 2000, 4)]
    rows += [(i, [1.0] * 6) for i in range(2001, 2300)]  # one vector with a third of the rows
    rows += [(7, None), (None, [1.0] * 6), (8, [1.0, None, 0.0]), (9, [float("nan")] * 6), (10, [float("inf")] * 6), (11, [2.0]), (12, []), (2400, [0.0] * 6)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, cell int")
    got = {tuple(r) for r in knn.top_k(df, F.col("vec_id") % 100 == 0, **sizes).collect()}
    assert got == _brute(rows)


def test_top_k_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    ask = F.col("vec_id") % 100 == 0
    assert knn.top_k(spark.createDataFrame([], schema), ask).count() == 0
    assert knn.top_k(spark.createDataFrame([(1, [1.0])], schema), ask).count() == 0
    assert knn.top_k(spark.createDataFrame([(0, [1.0])], schema), ask).count() == 0
    huge = [(0, [1e9, -3.0]), (1, [2e9, 5.0]), (2, [1e9, 7.0]), (3, [1e9, 7.0])]
    got = {tuple(r) for r in knn.top_k(spark.createDataFrame(huge, schema), ask).collect()}
    assert got == _brute(huge)


# Grading

def test_ordinal_fit():
    rng = np.random.default_rng(6)
    names = np.unique(rng.integers(0, 2 ** 63, 60, dtype=np.uint64))
    strength = rng.normal(0, 1.5, len(names))
    docs = [np.sort(rng.choice(names, 12, replace=False)) for _ in range(3000)]
    score = np.array([strength[np.searchsorted(names, d)].sum() for d in docs]) + rng.logistic(0, 0.5, len(docs))
    y = np.digitize(score, [-3.0, 2.0])
    model = quality.fit(docs[:2000], y[:2000])
    assert model.thresholds[0] < model.thresholds[1]
    tails = np.array([model.tails(model.score(d)) for d in docs[2000:]])
    assert (tails[:, 0] >= tails[:, 1]).all()
    assert ((tails >= 0.5).sum(1) == y[2000:]).mean() > 0.8
    again = quality.fit(docs[:2000], y[:2000])
    assert (again.weights == model.weights).all()
    for none in (quality.fit([], np.empty(0)), quality.fit(docs[:5], np.full(5, 2))):
        assert none.score(docs[0]) == 0 and len(none.tails(0.0)) == 2


def test_grades_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", quality.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = quality.train(docs, labels.where(~held))
    rows = quality.graded(docs.select("doc_id", "text"), model, "r").join(labels.where(held), "doc_id").select(
        "grade", quality.accepted("r").alias("ok")).collect()
    good = [r.ok for r in rows if r.grade == 2]
    bad = [not r.ok for r in rows if r.grade < 2]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) > 0.7


def test_grades_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "a b", "x"), (None, "c " * 30_000, "x")], "doc_id long, text string, rating string")
    labels = spark.createDataFrame([(1, 2), (2, 0), (2, 1), (None, 1), (3, None)], "doc_id long, grade int")
    model = quality.train(docs, labels)
    out = quality.graded(docs, model, "r").select("doc_id", "rating", "r.*").collect()
    assert len(out) == 4 and all(0 <= r.p_good <= r.p_fair <= 1 for r in out)
    assert quality.train(docs, labels.limit(0)).keys.size == 0 and quality.graded(docs.limit(0), model, "r").count() == 0
    assert quality.features(None).size == quality.features("").size == 1


def test_top_k_with_many_rows_of_the_asked_id(spark):
    """Forty rows with the query's id stand nearest to it; the true neighbours are in other cells."""
    rng = np.random.Generator(np.random.PCG64(8))
    rows = [(0, [10.0 + i / 64, 0.0, 0.0]) for i in range(40)]
    rows += [(i + 1, [float(x) for x in v]) for i, v in enumerate(rng.integers(-300, 300, (200, 3)) / 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in knn.top_k(df, F.col("vec_id") == 0, k=5).orderBy("rank").collect()]
    query = max(v for i, v in rows if i == 0)
    score = {i: int(sum(int(1024 * a) * int(np.floor(1024 * b)) for a, b in zip(query, v))) for i, v in rows if i}
    assert got == sorted(score.items(), key=lambda x: (-x[1], x[0]))[:5]
