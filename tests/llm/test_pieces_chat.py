"""SentencePiece against the library, chat formatting as a round trip."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from resona.llm import chat, pieces
from resona.llm.files import TOKENIZERS

RAW = open(f"{TOKENIZERS}/piece_bpe_32k.model", "rb").read()
MODEL = pieces.Model(RAW)
TEXTS = ["", " ", "  x", "Hello  world\n a b\tc é 𝄞 ", "a" * 50, "日本語 text ééé", "\n\n", "x\n y", " " * 100, "ab" * 3000,
         "def f(x):\n        return   x+1 # 123 \r\n\t\tfoo", "The quick brown fox's 1234567 http://foo.bar/baz?q=1&r=%20 "]


def ids(text, model=MODEL, cache=None):
    return np.frombuffer(next(model.encode_batch([text], {} if cache is None else cache)), np.int32).tolist()


def test_ids_equal_the_library():
    import duckdb
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=RAW)
    real = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' limit 100").fetchall()]
    texts = TEXTS + real
    got = [np.frombuffer(x, np.int32).tolist() for x in MODEL.encode_batch(texts, {})]
    assert got == [sp.encode(t) for t in texts]
    assert [MODEL.decode(np.array(x, np.int32)) for x in got] == texts


def test_unigram_scores_equal_the_library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto.FromString(RAW)
    spec.trainer_spec.model_type = sentencepiece_model_pb2.TrainerSpec.UNIGRAM
    for p in spec.pieces:
        p.score = max(p.score, -40_000.0)  # the library adds in single precision
    raw = spec.SerializeToString()
    sp, model = sentencepiece.SentencePieceProcessor(model_proto=raw), pieces.Model(raw)
    for word in "the theater thing reading unbelievable antidisestablishment naïve x1y2".split():
        assert ids(word, model) == sp.encode(word)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text_comes_back(text):
    assert MODEL.decode(np.array(ids(text), np.int32)) == text


def test_marks_and_long_words_come_back():
    for text in ("▁", "a ▁b ▁▁ c", "x" * 5000 + "▁é" * 100, "  ▁  "):
        assert MODEL.decode(np.array(ids(text), np.int32)) == text


def test_encode_rows(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "a ▁ b", 7), (3, "a ▁ b", 7), (4, "word " * 20_000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = pieces.encode(df, f"{TOKENIZERS}/piece_bpe_32k.model").collect()
    for r in got:
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        assert r.ids == ids(r.text) if r.text else r.ids == []
    assert pieces.encode(df.limit(0), f"{TOKENIZERS}/piece_bpe_32k.model").count() == 0


HARD = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "<<SYS>> a <</SYS>>", "[[INST]", "<image> <audio>", "a\\", "\n\n", "<", "</s", ""]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.sampled_from(["user", "assistant", "system", "", "a\nb", "a\\"]), st.text(max_size=5)),
       st.lists(st.one_of(st.sampled_from(HARD), st.text(alphabet="<>/s[]INST\\ \nimage", max_size=30)), max_size=4))
def test_turns_come_back(role, texts):
    t = chat.Template()
    segment, start, end, _ = chat.format_turn(t, role, [{"type": "text", "text": x} for x in texts])
    got_role, parts = chat.parse_turn(t, segment)
    whole = "".join(texts)
    assert (got_role, "".join(p["text"] for p in parts)) == (role, whole)
    assert t.unescape(segment[start:end]) == (whole if role == "assistant" else "")
    body = segment[len(t.begin):-len(t.end)]
    assert all(c not in body for c in t.controls)


def test_typed_parts():
    t = chat.Template()
    parts = [{"type": "text", "text": "see <image>"}, {"type": "image", "ref": "a.png", "width": 28, "height": 15}, {"type": "audio", "ref": "b", "seconds": 1.5},
             {"type": "document", "ref": "c", "pages": 2}, {"type": "image"}, {"type": None, "text": "end"}]
    segment, _, _, v = chat.format_turn(t, "user", parts)
    assert [(a["place"], a["type"], a["ref"], a["tokens"]) for a in v.attachments] == [
        (0, "image", "a.png", 4), (1, "audio", "b", 38), (2, "document", "c", 512), (3, "image", None, 1)]
    assert v.tokens == 4 + 38 + 512 + 1
    assert chat.parse_turn(t, segment)[1] == [
        {"type": "text", "text": "see <image>"}, {"type": "image"}, {"type": "audio"}, {"type": "document"}, {"type": "image"}, {"type": "text", "text": "end"}]
    with pytest.raises(ValueError):
        chat.parse_turn(t, "x")


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", None), (1, 1, "assistant", "b</s>"), (2, None, None, "x"), (None, 0, "user", "n"),
            (3, 0, "assistant", "long " * 30_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, segment int")
    from pyspark.sql import functions as F

    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(
        df.select("conv_id", "turn", "role", chat.text_parts("text").alias("parts")))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256) == (3, sha("user\n\nassistant\nb</s>\nassistant\nb</s>\n"))
    assert (got[1].loss_chars, got[1].loss_sha256) == (10, sha("b</s>b</s>"))
    assert (got[2].turns_sha256, got[2].loss_chars, got[2].loss_sha256) == (sha("\nx\n"), 0, sha(""))
    assert got[None].n_turns == 1 and got[3].loss_chars == 150_000
    none = df.limit(0).select("conv_id", "turn", "role", F.lit(None).alias("parts"))
    assert chat.read_back(chat.format_conversations(none)).count() == 0
