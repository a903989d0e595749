"""SentencePiece encoding and decoding with the tokenizers library as backend.

The model file is parsed here (protobuf wire format, only the fields that encoding needs) and rebuilt: the
compiled normaliser map (read here, as the library's own reader goes by grapheme clusters and so differs from
SentencePiece), the dummy prefix and white-space rules, the metaspace marker, unigram scores or BPE merges (a
merge for every split of a piece into two pieces, by the piece's score), user-defined pieces, byte fallback and
the decoder. Batches are encoded with the library's threads. Every row of ``encode`` is verified: the decoded
ids must give the normalised text again, and the SentencePiece library itself must give the same ids (``parity``).

Where no piece has a metaspace after another character, no merge crosses the start of a word: words are then
encoded apart, which changes nothing in the result, and a word that comes again in a task is looked up. Both
verifications are then done for each distinct word when it is first met, and for a stated share of rows on the
whole text as well; for other models, on every row's whole text.

Defined cases: a null or empty text has no ids; without byte fallback an unknown character decodes to the unknown
piece's name and ``round_trip`` is false; lone surrogates are replaced as the decoder of UTF-8 would;
extra columns are ignored by ``encode``.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import merged, modest_batches, text_of, tidy

META = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of one protobuf message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind} at {at}")
        yield tag >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)  # piece, score, type
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unknown: int = 0
    treat_whitespace_as_suffix: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True


def parse(data: bytes) -> Model:
    model = Model()
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            if kind == UNKNOWN:
                model.unknown = len(model.pieces)
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    model.kind = v
                elif n == 35:
                    model.byte_fallback = bool(v)
                elif n == 24:
                    model.treat_whitespace_as_suffix = bool(v)
        elif number == 3:
            for n, v in fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.dummy_prefix = bool(v)
                elif n == 4:
                    model.remove_extra_whitespaces = bool(v)
                elif n == 5:
                    model.escape_whitespaces = bool(v)
    if model.kind not in (UNIGRAM, BPE) or model.treat_whitespace_as_suffix:
        raise ValueError("only unigram and BPE models with a white-space prefix are supported")
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """Pairs in the order in which SentencePiece prefers them: by the joined piece's score, then as they come."""
    score = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for piece, s in score.items():
        splits = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in score and piece[i:] in score]
        found += [(-s, pair) for pair in splits]
    found.sort(key=lambda x: x[0])
    return [pair for _, pair in found]


def charsmap_keys(charsmap: bytes) -> dict[str, str]:
    """All keys of a compiled normaliser map and what they become. The map is a trie in a double array of 32-bit
    units (its size in bytes comes first), then the null-terminated results that the trie's values are offsets of."""
    size = struct.unpack("<I", charsmap[:4])[0]
    units, results = np.frombuffer(charsmap, "<u4", size // 4, 4).astype(np.int64), charsmap[4 + size :]
    below = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
    label = units & 0x800000FF
    found, todo, every = {}, [(b"", int(below(units[0])))], np.arange(1, 256)
    while todo:
        prefix, node = todo.pop()
        at = node ^ every
        at = at[at < len(units)]
        for child in at[label[at] == (at ^ node)].tolist():
            unit, key = int(units[child]), prefix + bytes([child ^ node])
            onward = child ^ below(unit)
            if unit >> 8 & 1:
                start = int(units[onward]) & 0x7FFFFFFF
                found[key] = results[start : results.index(b"\0", start)]
            todo.append((key, onward))
    return {k.decode("utf-8"): v.decode("utf-8") for k, v in found.items()}


class Normaliser:
    """A model's normalisation: from left to right the longest key of the compiled map is replaced, user-defined
    pieces stay as they are; then white space is collapsed, the prefix put before and spaces become the marker."""

    def __init__(self, model: Model):
        self.model = model
        self.keys = charsmap_keys(model.charsmap) if model.charsmap else {}
        own = sorted((p for p, _, kind in model.pieces if kind == USER_DEFINED and p), key=len, reverse=True)
        self.longest = max(map(len, self.keys), default=0)
        members = lambda chars: "[" + "".join(map(re.escape, sorted(chars))) + "]"
        alone = {k for k in self.keys if len(k) == 1}
        longer = [k for k in self.keys if len(k) > 1]
        steps = [f"({'|'.join(map(re.escape, own))})"] if own else []
        steps += [members(alone)] if alone else []
        steps += [members({k[0] for k in longer}) + f"(?={members({k[1] for k in longer})})"] if longer else []
        self.step = re.compile("|".join(steps)) if steps else None
        self.own = bool(own)

    def _mapped(self, text: str) -> str:
        out, at = [], 0
        while found := self.step.search(text, at):
            start = found.start()
            out.append(text[at:start])
            if self.own and found[1]:
                out.append(found[1])
                at = found.end()
                continue
            for n in range(min(self.longest, len(text) - start), 0, -1):
                if (key := text[start : start + n]) in self.keys:
                    out.append(self.keys[key])
                    break
            else:
                out.append(text[start])
            at = start + n
        return "".join(out) + text[at:]

    def __call__(self, text: str) -> str:
        m = self.model
        text = self._mapped(text) if self.step else text
        if m.remove_extra_whitespaces:
            text = re.sub(" {2,}", " ", text.lstrip(" "))
        if not text:
            return ""
        text = " " * m.dummy_prefix + text
        text = text.replace(" ", META) if m.escape_whitespaces else text
        return text.rstrip(META if m.escape_whitespaces else " ") if m.remove_extra_whitespaces else text


def backend(model: Model):
    """The model in the tokenizers library, for texts that are normalised already."""
    from tokenizers import AddedToken, Tokenizer, decoders, models

    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unknown, byte_fallback=model.byte_fallback)
    else:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, merges(model), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    out = Tokenizer(core)
    own = [AddedToken(p, normalized=False, special=False) for p, _, kind in model.pieces if kind == USER_DEFINED]
    if own:
        out.add_tokens(own)
    strip = [decoders.Strip(" ", 1 << 30 if model.remove_extra_whitespaces else 1, 0)] if model.dummy_prefix or model.remove_extra_whitespaces else []
    out.decoder = decoders.Sequence([decoders.Replace(META, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return out


_WORD = re.compile(" +[^ ]*|[^ ]+")
MOST_WORDS = 250_000  # looked-up words in each half of what a task keeps; beyond, the older half goes


def _packed(ids: list[int]) -> bytes:
    out = array("i", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def unpacked(data: bytes | None) -> list[int]:
    return np.frombuffer(data or b"", "<i4").tolist()


class Codec:
    """Encoder and decoder of one model file's bytes."""

    def __init__(self, data: bytes, threads: int = 2):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))  # a worker has a share of the machine, not all of it
        from tokenizers import decoders

        self.model = parse(data)
        self.tokenizer = backend(self.model)
        self.normaliser = Normaliser(self.model)
        self.data = data
        self._reference = None
        m = self.model
        self.identity = not m.charsmap and not m.remove_extra_whitespaces and m.escape_whitespaces
        special = any(kind == USER_DEFINED for _, _, kind in m.pieces)
        fuses = not m.byte_fallback and not any(p == META for p, _, _ in m.pieces)  # unknown characters of two words
        self.by_word = self.identity and not special and not fuses and not any(META in p.lstrip(META) for p, _, _ in m.pieces)
        self._words: dict[str, bytes] = {}  # packed ids
        self._older: dict[str, bytes] = {}
        if self.by_word:
            self._bare = backend(m)
            self._bare.decoder = decoders.Sequence([decoders.Replace(META, " "), decoders.ByteFallback(), decoders.Fuse()])
            self._astray: set[str] = set()  # words that their ids don't give again
            self._differ: set[str] = set()  # words whose ids aren't the SentencePiece library's

    def _split(self, text: str) -> list[str]:
        prefix = " " if self.model.dummy_prefix else ""
        return _WORD.findall(prefix + text.replace(META, " ")) if text else []

    def round_trips(self, texts: list[str], packed: list[bytes]) -> list[bool]:
        """Whether decoding gives each normalised text again. Word by word where words are encoded apart: their
        bytes never join over a space, so a text's decoding is that of its words end to end."""
        if not self.by_word:
            return [b == self.normalised(t) for b, t in zip(self.decode([unpacked(p) for p in packed]), texts)]
        return [not self._astray or self._astray.isdisjoint(self._split(t)) for t in texts]

    def parities(self, texts: list[str], packed: list[bytes]) -> list[bool]:
        """Whether the SentencePiece library gives each text the same ids. Word by word where words are encoded
        apart: neither library joins anything over a word's start, so a text's ids are those of its words."""
        if not self.by_word:
            return [unpacked(p) == r for p, r in zip(packed, self.reference(texts))]
        return [not self._differ or self._differ.isdisjoint(self._split(t)) for t in texts]

    def _by_library(self, words: list[str]) -> list[list[int]]:
        """The SentencePiece library's ids of words as ``_split`` gives them."""
        if not self.model.dummy_prefix:
            return self.reference(words)
        out = self.reference([w[1:] for w in words])  # the library puts the space before
        if " " in words:  # but not before nothing: a lone space is what it makes of one at a text's end
            a, end = self.reference(["a", "a "])
            out[words.index(" ")] = end[len(a) :]
        return out

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        if not self.by_word:
            got = self.tokenizer.encode_batch_fast(list(map(self.normaliser, texts)), add_special_tokens=False) if texts else []
            return [_packed(e.ids) for e in got]
        parts = [self._split(t) for t in texts]
        if len(self._words) > MOST_WORDS:
            self._words, self._older = {}, self._words
        known, older = self._words, self._older
        new = set().union(*parts).difference(known)
        if older:  # words that come again stay; the others go with the older half
            again = new.intersection(older)
            known.update((w, older[w]) for w in again)
            new -= again
        new = list(new)
        for at in range(0, len(new), 10_000):
            some = new[at : at + 10_000]
            ids = [e.ids for e in self._bare.encode_batch_fast([w.replace(" ", META) for w in some], add_special_tokens=False)]
            known.update(zip(some, map(_packed, ids)))
            self._astray.update(w for w, b in zip(some, self._bare.decode_batch(ids, skip_special_tokens=False)) if w != b)
            self._differ.update(w for w, i, r in zip(some, ids, self._by_library(some)) if i != r)
        return [b"".join(map(known.__getitem__, words)) for words in parts]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [unpacked(p) for p in self.packed(texts)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def normalised(self, text: str) -> str:
        """What decoding must give: the normalised text without the marker and the prefix."""
        if self.identity:
            return text.replace(META, " ")
        text = self.normaliser(text).replace(META, " ")
        return text.lstrip(" ") if self.model.remove_extra_whitespaces else text[1:] if self.model.dummy_prefix else text

    def _library(self):
        if self._reference is None:
            import sentencepiece

            self._reference = sentencepiece.SentencePieceProcessor(model_proto=self.data)
        return self._reference

    def reference(self, texts: list[str]) -> list[list[int]]:
        """The ids that the SentencePiece library gives."""
        return self._library().encode(texts, num_threads=1)

    def decode_by_library(self, ids: list[list[int]]) -> list[str]:
        return self._library().decode(ids, num_threads=1)


_codecs: dict[str, Codec] = {}


def _codec(data: bytes) -> Codec:
    key = hashlib.sha256(data).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(data)
    return _codecs[key]


ENCODED = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("ids_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType()), T.StructField("parity", T.BooleanType())])


def encode(docs: DataFrame, model: str | bytes, *, parity_every: int = 16, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian int32), ids_sha256, round_trip, parity of every row's whole text.

    ``model`` is the file's path on the driver or its bytes (broadcast; a model file has a fixed size).
    ``parity`` says whether a row's ids are those of the SentencePiece library, and is never null. Where words are
    apart, rows whose id's hash is divisible by ``parity_every`` are also encoded and decoded as a whole by that library.
    """
    if isinstance(model, str):
        with open(model, "rb") as f:
            model = f.read()
    modest_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in merged(batches, "text", 1 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            packed = codec.packed(texts)
            ok = codec.round_trips(texts, packed)
            parity = codec.parities(texts, packed)
            probe = [i for i, c in enumerate(batch.column("check").to_pylist()) if c] if codec.by_word else []
            if probe:
                some = [texts[i] for i in probe]
                for i, t, r, b in zip(probe, some, codec.reference(some), codec.decode_by_library([unpacked(packed[i]) for i in probe])):
                    parity[i] = parity[i] and unpacked(packed[i]) == r
                    ok[i] = ok[i] and b == codec.normalised(t)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(packed if with_ids else [None] * len(packed), pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()), pa.array(ok, pa.bool_()), pa.array(parity, pa.bool_())],
                names=["doc_id", "n_tokens", "ids", "ids_sha256", "round_trip", "parity"],
            )
        del codec
        _codecs.clear()  # the worker may go on to other steps
        tidy()

    rows = docs.select("doc_id", text_of("text").alias("text"), (F.pmod(F.xxhash64("doc_id"), F.lit(parity_every)) == 0).alias("check"))
    return rows.mapInArrow(run, T.StructType([docs.schema["doc_id"], *ENCODED.fields]))


def decode(encoded: DataFrame, model: str | bytes) -> DataFrame:
    """doc_id and text of rows with ``ids`` as ``encode`` gives them; null ids are the empty text."""
    if isinstance(model, str):
        with open(model, "rb") as f:
            model = f.read()
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            texts = codec.decode([unpacked(x) for x in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, T.StructType([encoded.schema["doc_id"], T.StructField("text", T.StringType())]))
