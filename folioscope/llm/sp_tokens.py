"""SentencePiece models run by the tokenizers library.

The model file's protobuf is parsed here; normaliser, metaspace marker, pieces with their scores, user-defined
pieces and byte fallback are rebuilt as a tokenizers pipeline. Unigram models keep their scores; for BPE models
every pair of pieces that makes a third is a merge, in falling order of the third's score. Where no piece of a BPE
model has the marker after another character, no merge crosses words, so texts are cut at words into stretches of some
512 characters, whose merges cost less than one long text's; other models encode whole texts. A worker encodes with
one thread, as each core has a task of its own. Every text is encoded by the sentencepiece library too, copies within a chunk once. Where the two
differ (ties of scores, which the libraries sum in different precision, or characters that their normalisers take
differently), `parity` is false and the ids are those of sentencepiece, so ids are always the model's own. Every text
is decoded again and held against its normalised form.

Texts go through in chunks of some 200,000 bytes, whose lists are dropped before the next, and the tokenizer
keeps no cache of texts, so a worker's memory follows the longest text.

Defined results: a null or empty text has no tokens; rows with equal doc_id are encoded on their own; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Characters that a stretch of a text has at least, if it isn't the last.
STRETCH = 512
#: Score of pieces that no text is cut into.
LEAST_SCORE = -1e9
#: Numbers of the format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message; fixed-size values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        out = cls()
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                out.pieces.append((piece, score, kind))
            elif number == 2:
                for n, v in _fields(value):
                    if n == 3:
                        out.kind = v
                    elif n == 35:
                        out.byte_fallback = bool(v)
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        out.charsmap = v
                    elif n in (3, 4, 5):
                        setattr(out, ("dummy_prefix", "squeeze", "escape")[n - 3], bool(v))
        return out

    def merges(self) -> list[tuple[str, str]]:
        ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        out = []
        for piece in ids:
            for cut_at in range(1, len(piece)):
                left, right = piece[:cut_at], piece[cut_at:]
                if left in ids and right in ids:
                    out.append((-self.pieces[ids[piece]][1], ids[left], ids[right], left, right))
        out.sort(key=lambda m: m[:3])
        return [m[3:] for m in out]

    def at_words(self) -> bool:
        """Whether texts may be cut before words: no piece has a marker after another character, and the marker alone is a piece."""
        if self.kind != BPE or not self.escape or any(kind == USER for *_, kind in self.pieces):
            return False
        own = {p for p, _, kind in self.pieces if kind == NORMAL}
        return MARK in own and not any(MARK in p.lstrip(MARK) for p in own)

    def normalizer(self):
        """None if texts stay as they are, but for the marker."""
        from tokenizers import Regex, normalizers

        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        return normalizers.Sequence(steps) if steps else None

    def build(self):
        """The tokenizer of normalised texts."""
        from tokenizers import AddedToken, Tokenizer, decoders, models

        unknown = next((i for i, (*_, kind) in enumerate(self.pieces) if kind == UNKNOWN), None)
        if self.kind == UNIGRAM:
            core = models.Unigram([(p, s if kind in (NORMAL, USER, BYTE) else LEAST_SCORE) for p, s, kind in self.pieces], unknown, self.byte_fallback)
        elif self.kind == BPE:
            vocabulary = {p: i for i, (p, *_) in enumerate(self.pieces)}
            core = models.BPE(vocabulary, self.merges(), cache_capacity=0, unk_token=None if unknown is None else self.pieces[unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            raise ValueError(f"model type {self.kind}")
        if hasattr(core, "_resize_cache"):
            core._resize_cache(0)
        out = Tokenizer(core)
        if own := [AddedToken(p, normalized=True, special=False) for p, _, kind in self.pieces if kind == USER]:
            out.add_tokens(own)
        tail = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        if self.dummy_prefix:
            tail.append(decoders.Strip(" ", 1, 0))
        out.decoder = decoders.Sequence(tail)
        return out


class Backend:
    """The rebuilt tokenizer of one worker, and the library that it is held against."""

    def __init__(self, data: bytes):
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Model.parse(data)
        self.normalizer = self.model.normalizer()
        self.fast = self.model.build()
        self.slow = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.mark = MARK if self.model.escape else " "
        self.at_words = self.model.at_words()
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in self.model.pieces]

    def normalise(self, text: str) -> str:
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        prefix = self.mark if text and self.model.dummy_prefix else ""
        return prefix + (text.replace(" ", MARK) if self.model.escape else text)

    def stretches(self, normal: str) -> list[str]:
        """A normalised text cut where its pieces can't cross, before the markers of words."""
        out, at = [], 0
        if self.at_words:
            k = normal.find(MARK, STRETCH)
            while 0 < k < len(normal) - 1:  # a marker alone would be no text to sentencepiece
                if normal[k - 1] == MARK:
                    k = normal.find(MARK, k + 1)
                    continue
                out.append(normal[at:k])
                at, k = k, normal.find(MARK, k + STRETCH)
        return [*out, normal[at:]]

    def encode(self, normal: list[str]) -> list[list[int]]:
        """The rebuilt tokenizer's tokens of normalised texts. They go in by stretches: merging these with a heap is faster than whole texts or single words."""
        cut = [self.stretches(t) for t in normal]
        made = (e.ids for e in self.fast.encode_batch_fast(list(chain.from_iterable(cut)), add_special_tokens=False))
        return [list(chain.from_iterable(islice(made, len(some)))) for some in cut]

    def exact(self, text: str, normal: str) -> list[int]:
        """sentencepiece's tokens of a text that is normalised to `normal`."""
        # Only where its normaliser does no more than mark words is a stretch alone what it is in its text.
        if len(normal) <= STRETCH or self.normalizer is not None or not self.model.dummy_prefix:
            return self.slow.encode(text)
        # A stretch begins with a marker, which sentencepiece puts there itself.
        return list(chain.from_iterable(self.slow.encode(t[1:]) for t in self.stretches(normal)))

    def pieces(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def unmarked(self, text: bytes) -> bytes:
        return text[1:] if self.model.dummy_prefix and text[:1] == b" " else text

    def decode(self, ids: list[int]) -> bytes:
        return self.unmarked(self.pieces(ids))

    def plain(self, normal: str) -> bytes:
        """What a normalised text is decoded to."""
        begin = int(self.model.dummy_prefix and normal.startswith(self.mark))
        return normal[begin:].replace(MARK, " ").encode()


@lru_cache(1)
def _loaded(data: bytes) -> Backend:
    return Backend(data)


_OUT = "ids array<int>, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean, parity boolean"
MADE = ("ids", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip", "parity")
_CHUNK = 200_000


#: Ids as 32-bit bytes, the decoded text, round trip and parity of a text.
Made = tuple[bytes, bytes, bool, bool]


def encoded(backend: Backend, texts: list[str]) -> list[Made]:
    """Every different text of a chunk goes through both libraries."""
    out = {}
    normal = {t: backend.normalise(t) for t in texts}
    for (text, plain), ids in zip(normal.items(), backend.encode(list(normal.values())), strict=True):
        exact = backend.exact(text, plain)
        back = backend.decode(exact)
        out[text] = np.array(exact, np.int32).tobytes(), back, back == backend.plain(plain), ids == exact
    return [out[t] for t in texts]


def _encode(data: bytes, kept: list[str]):
    def run(batches):
        backend = _loaded(data)
        for batch in pieces(batches, size=_CHUNK):
            ids, backs, trips, parity = zip(*encoded(backend, [t or "" for t in batch.column("text").to_pylist()]), strict=True)
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            columns = [
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32))),
                pa.array(sizes),
                pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in backs]),
                pa.array(trips),
                pa.array(parity),
            ]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, *columns], [*kept, *MADE])

    return run


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """The columns of docs but text, with ids, n_tokens, ids_crc32 (of 32-bit little-endian ids), decoded_sha256,
    round_trip (decoding gave the normalised text) and parity (the rebuilt tokenizer gave what sentencepiece gives)."""
    with open(model, "rb") as f:
        data = f.read()
    kept = [f for f in docs.schema if f.name != "text" and f.name.lower() not in MADE]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), _OUT])
    return docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col("text").cast("string").alias("text")).mapInArrow(_encode(data, [f.name for f in kept]), schema)


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """The columns of tokens with text, decoded from ids."""
    with open(model, "rb") as f:
        data = f.read()

    def run(batches):
        fast = _loaded(data).fast
        for batch in batches:
            text = fast.decode_batch([x or [] for x in batch.column("ids").to_pylist()], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*batch.schema.names, "text"])

    tokens = tokens.drop("text")
    return tokens.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema), "text string"]))
