"""SentencePiece encoding and decoding by a Viterbi search that shares work between words with a common prefix."""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import TOKENIZERS, read_bytes
from .registry import query, table

MARK = "▁"
#: Stands for a literal MARK in a text while it is encoded; a lone surrogate is in no text and in no vocabulary.
LITERAL = "\ud800"
#: Fixed value: how far an unknown character scores below the lowest piece.
UNKNOWN_PENALTY = 10.0
#: Words kept between batches of a task, and characters encoded at once.
CACHE_WORDS, CACHE_PAIRS, CHUNK_CHARS = 150_000, 200_000, 2_000_000
#: Longer words of a merging vocabulary are merged one by one.
LONG_WORD = 2_000


class Model:
    """Pieces and scores of a SentencePiece vocabulary with byte fallback.

    unigram: each word takes the pieces with the highest sum of scores; of equal sums, the one with the longer last piece.
    bpe: each word takes the pieces that merging by score yields. A sequence of pieces is that result exactly if merging gives every
    two neighbours back unchanged, so the search admits a piece only behind one that it fits; then one path per prefix is left.
    Scores that tie (runs of blanks) and very long words break or strain that rule; such words are merged one by one.
    Characters that no piece covers become their UTF-8 bytes.
    """

    def __init__(self, proto: bytes):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto.FromString(proto)
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.merging = spec.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE
        self.trie: dict = {}
        self.byte_ids = [0] * 256
        self.surface: list[bytes] = [b""] * len(spec.pieces)
        self.text: list[str] = [p.piece for p in spec.pieces]
        self.ids: dict[str, tuple[int, float]] = {}
        self.fits: dict[int, bool] = {}
        for i, p in enumerate(spec.pieces):
            if p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.surface[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type in (kinds.NORMAL, kinds.USER_DEFINED):
                self.ids[p.piece] = (i, p.score)
                self.surface[i] = p.piece.replace(MARK, " ").encode()
                if MARK in p.piece.lstrip(MARK):
                    raise ValueError(f"piece {p.piece!r} spans words")
        for piece, hit in self.ids.items():
            if not self.merging or self.merged(piece) == [hit[0]]:
                node = self.trie
                for ch in piece:
                    node = node.setdefault(ch, {})
                node[None] = hit
        self.unknown = min((x for _, x in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        # Where no piece holds a line end, lines can be cut there without changing the result.
        lines = any("\n" in piece for piece in self.ids)
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if lines else f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")

    def split(self, text: str) -> list[str]:
        """Marked words: runs of marks with the characters that follow; the text begins with a mark of its own."""
        return self.words.findall(MARK + text.replace(MARK, LITERAL).replace(" ", MARK))

    def _fallback(self, ch: str) -> list[int]:
        return [self.byte_ids[b] for b in (MARK if ch == LITERAL else ch).encode("utf-8", "surrogatepass")]

    def merged(self, word: str) -> list[int]:
        """Ids after joining, again and again, the neighbours whose join scores highest; the leftmost of equal ones."""
        part, n, ids = list(word), len(word), self.ids
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        def join(i: int, j: int) -> list[tuple]:
            hit = ids.get(part[i] + part[j])
            return [(-hit[1], i, j, len(part[i]), len(part[j]))] if hit else []

        heap = [x for i in range(n - 1) for x in join(i, i + 1)]
        heapq.heapify(heap)
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if len(part[i]) != a or len(part[j]) != b or right[i] != j:
                continue
            part[i] += part[j]
            part[j] = ""
            right[i], joins = right[j], []
            if right[j] >= 0:
                left[right[j]] = i
                joins = join(i, right[i])
            if left[i] >= 0:
                joins += join(left[i], i)
            for x in joins:
                heapq.heappush(heap, x)
        out: list[int] = []
        for p in part:
            if p:
                out.extend([ids[p][0]] if p in ids else self._fallback(p))
        return out

    def _admits(self, before: int, after: int) -> bool:
        """Whether merging leaves the two pieces as they are."""
        key = before << 32 | after
        ok = self.fits.get(key)
        if ok is None:
            if len(self.fits) > CACHE_PAIRS:
                self.fits.clear()
            ok = self.fits[key] = self.merged(self.text[before] + self.text[after]) == [before, after]
        return ok

    def _trace(self, word: str, start: list[int], piece: list[int]) -> bytes:
        ids: list[int] = []
        at = len(word)
        while at:
            if piece[at] < 0:
                ids.extend(reversed(self._fallback(word[at - 1])))
            else:
                ids.append(piece[at])
            at = start[at]
        ids.reverse()
        return array("i", ids).tobytes()

    def encode_sorted(self, ordered: list[str]) -> Iterator[bytes]:
        """Ids (int32) of sorted distinct words: a depth-first walk of their trie.

        The stacks hold, for every prefix of the last word, its forward score, the last piece of its path and the open pieces.
        The next word keeps the entries of the common prefix.
        """
        best, start, piece, live = [0.0], [0], [-1], [[]]
        last, root, unknown, merging, fits = "", self.trie, self.unknown, self.merging, self.fits
        twice = MARK + MARK
        for word in ordered:
            if merging and (len(word) > LONG_WORD or twice in word):
                yield array("i", self.merged(word)).tobytes()
                continue
            n, shared = min(len(word), len(last)), 0
            while shared < n and word[shared] == last[shared]:
                shared += 1
            del best[shared + 1:], start[shared + 1:], piece[shared + 1:], live[shared + 1:]
            active = live[shared]
            for d in range(shared, len(word)):
                ch = word[d]
                still, high, s0, p0 = [], None, d, -1
                for at in active:
                    node = at[1].get(ch)
                    if node:
                        s = at[0]
                        still.append((s, node))
                        if None in node and (not merging or high is None):
                            hit = node[None]
                            if merging and piece[s] >= 0:
                                ok = fits.get(piece[s] << 32 | hit[0])
                                if not (self._admits(piece[s], hit[0]) if ok is None else ok):
                                    continue
                            x = best[s] + hit[1]
                            if high is None or x > high:
                                high, s0, p0 = x, s, hit[0]
                node = root.get(ch)
                hit = None
                if node:
                    still.append((d, node))
                    hit = node.get(None)
                if high is None or not merging:
                    x = best[d] + (hit[1] if hit else unknown)
                    if high is None or x > high:
                        high, s0, p0 = x, d, hit[0] if hit else -1
                best.append(high)
                start.append(s0)
                piece.append(p0)
                live.append(still)
                active = still
            last = word
            yield self._trace(word, start, piece)

    def encode_batch(self, texts: list[str | None], cache: dict[str, bytes]) -> Iterator[bytes]:
        """Ids of whole texts as int32 bytes; null and empty texts have none."""
        at = 0
        while at < len(texts):
            upto, chars = at, 0
            while upto < len(texts) and (upto == at or chars + len(texts[upto] or "") <= CHUNK_CHARS):
                chars += len(texts[upto] or "")
                upto += 1
            split = [self.split(t) if t else [] for t in texts[at:upto]]
            used = {w for ws in split for w in ws}
            if len(cache) > CACHE_WORDS:
                # The words of this chunk stay; the common ones are among them.
                kept = {w: cache[w] for w in used if w in cache}
                cache.clear()
                cache.update(kept)
            fresh = sorted(w for w in used if w not in cache)
            cache.update(zip(fresh, self.encode_sorted(fresh)))
            for ws in split:
                yield b"".join(map(cache.__getitem__, ws))
            at = upto

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the space in front that encoding added is left out."""
        raw = b"".join(map(self.surface.__getitem__, ids.tolist()))
        return (raw[1:] if raw.startswith(b" ") else raw).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def _worker(proto: bytes) -> Model:
    """The model, which a Python worker keeps from task to task."""
    return Model(proto)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded_sha256") -> DataFrame:
    """docs with the piece ids of whole texts, and the SHA-256 of what they decode to, as further columns (in place of such that have their names).

    Null and empty texts get no ids and the digest of the empty text. Every text decodes to itself, marks and line ends
    included. Words are shared inside a batch and kept in a bounded cache between batches; nothing is shuffled.
    """
    spark = docs.sparkSession
    proto = spark.sparkContext.broadcast(read_bytes(spark, path))  # a vocabulary, at most files.MAX_BYTES
    docs = docs.drop(ids, decoded)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = _worker(proto.value), {}
        for batch in batches:
            texts = batch.column(names.index(text)).to_pylist()
            done, digests, size = [], [], 0
            for raw in model.encode_batch(texts, cache):
                done.append(raw)
                digests.append(hashlib.sha256(model.decode(np.frombuffer(raw, np.int32)).encode("utf-8", "surrogatepass")).hexdigest())
                size += len(raw)
            offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in done])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(done), np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(digests, pa.string())], names=[*names, ids, decoded])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{ids}` array<int>, `{decoded}` string")


@query("op5_sentencepiece")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode(docs, f"{TOKENIZERS}/piece_bpe_32k.model")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return encoded.select("doc_id", F.size("ids").alias("n_pieces"), "ids", "decoded_sha256",
                          (F.col("decoded_sha256") == digest).alias("round_trip"))
