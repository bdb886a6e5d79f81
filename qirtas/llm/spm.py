"""SentencePiece encoding and decoding, exact for merge-type (BPE) models.

Merging by priority gives one segmentation per text; it is found without merging the text. A pair of adjacent
tokens is compatible if merging their joined spelling gives back just these two; a segmentation all of whose
neighbours are compatible is the one that merging gives. So tokens are laid down greedily: an Aho-Corasick
automaton has all vocabulary matches of a word, the longest at each position is tried first, then its shorter
prefixes; where none is compatible with the token before, the position is marked in a bitfield as failed, the
last token is taken back and its next shorter prefix tried. Every position fails at most once.

Since no piece has the white-space mark after another character (checked when a model is read), no merge crosses
the start of a word, and words are encoded apart and remembered per worker.

Cases: null gives null ids and null text; the empty text has no ids. Characters without a piece become their
bytes' pieces if the model has byte fallback, else the unknown piece (which decodes to `` ⁇ ``). Texts of any
length are processed whole; repeated rows get equal results; other columns are left alone. Models with a
normalisation table, with suffix white space or of unigram type are refused with ValueError.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table

#: Where the public vocabulary files are.
TOKENIZERS = os.environ.get("QIRTAS_TOKENIZERS", "/opt/tokenizers")
MODEL = "piece_bpe_32k.model"
SPACE = "▁"
LONG, REMEMBERED = 64, 300_000
_SLICE = 1 << 20  # characters in work at once


def _fields(raw: bytes) -> Iterator[tuple[int, int, object]]:
    """(field, wire type, value) of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        v = s = 0
        while True:
            b = raw[i]
            i += 1
            v |= (b & 127) << s
            s += 7
            if b < 128:
                return v

    while i < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, kind, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, kind, raw[i : i + n]
            i += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, kind, raw[i : i + n]
            i += n


@dataclass
class Vocabulary:
    """A merge-type model: pieces with their ids and merge priorities."""

    pieces: list[str]
    scores: np.ndarray
    types: list[int]  # 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
    dummy_prefix: bool = True
    squeeze: bool = False
    byte_fallback: bool = True
    ids: dict[str, int] = field(init=False)

    def __post_init__(self) -> None:
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] == 1}
        self.unknown = self.types.index(2) if 2 in self.types else 0
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == 6}
        self.byte_fallback &= len(self.bytes) == 256
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has the white-space mark inside: words can't be encoded apart")
        self._compatible: dict[tuple[str, str], bool] = {}
        self._memory: dict[str, int] = {}
        self._flat, self._at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.spelled = [bytes([int(p[3:5], 16)]) if t == 6 else b"" if t == 3 else " ⁇ ".encode() if t == 2 else p.replace(SPACE, " ").encode() for p, t in zip(self.pieces, self.types)]
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) > 1 and self.merge(p) == [p]:  # pieces that merging never makes are no candidates
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            raw = f.read()
        pieces, scores, types, spec = [], [], [], {"dummy_prefix": True, "squeeze": True, "byte_fallback": False}
        for tag, _, value in _fields(raw):
            if tag == 1:
                piece, score, kind = "", 0.0, 1
                for t, _, v in _fields(value):
                    if t == 1:
                        piece = v.decode()
                    elif t == 2:
                        score = float(np.frombuffer(v, np.float32)[0])
                    elif t == 3:
                        kind = v
                pieces.append(piece)
                scores.append(score)
                types.append(kind)
            elif tag == 2:
                got = {t: v for t, k, v in _fields(value) if k == 0}
                if got.get(3, 1) != 2 or got.get(24):
                    raise ValueError("not a merge-type model with prefix white space")
                spec["byte_fallback"] = bool(got.get(35))
            elif tag == 3:
                got = {t: v for t, _, v in _fields(value)}
                if got.get(2):
                    raise ValueError("models with a normalisation table aren't supported")
                spec["dummy_prefix"], spec["squeeze"] = bool(got.get(3, 1)), bool(got.get(4, 1))
        if any(t in (4, 5) for t in types):
            raise ValueError("user-defined and unused pieces aren't supported")
        return cls(pieces, np.array(scores), types, **spec)

    def merge(self, text: str) -> list[str]:
        """Merging as it is defined: again and again the best-scored adjacent pair, of equals the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        got = self._compatible.get((a, b))
        if got is None:
            if len(self._compatible) > 1_000_000:
                self._compatible.clear()
            got = self._compatible[a, b] = self.merge(a + b) == [a, b]
        return got

    def split(self, word: str) -> list[str]:
        """The segmentation of a word, by backtracking."""
        n = len(word)
        fits: list[list[str]] = [[c] for c in word]  # the tokens at each position, shortest first
        for end, piece in self.automaton.iter(word) if len(self.automaton) else ():
            fits[end + 1 - len(piece)].append(piece)
        known = self._compatible
        failed = bytearray(n // 8 + 1)  # the bitfield: a set bit is a position from which nothing was found
        out: list[str] = []
        choice: list[int] = []  # index into fits of each laid token
        at, last = 0, ""
        k = len(fits[0]) - 1 if n else -1
        while at < n:
            here = fits[at]
            while k >= 0:
                token = here[k]
                end = at + len(token)
                if not failed[end >> 3] >> (end & 7) & 1:
                    if not last:
                        break
                    ok = known.get((last, token))
                    if self.compatible(last, token) if ok is None else ok:
                        break
                k -= 1
            if k >= 0:
                out.append(token)
                choice.append(k)
                at, last = end, token
                k = len(fits[at]) - 1 if at < n else -1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                if not out:
                    return self.merge(word)  # can't happen for a proper model; merging is right for any
                at -= len(out.pop())
                last = out[-1] if out else ""
                k = choice.pop() - 1
        return out

    def word(self, word: str) -> list[int]:
        k = self.ids.get(word)
        if k is not None and len(word) == 1:
            return [k]
        out: list[int] = []
        for t in self.split(word):
            k = self.ids.get(t)
            if k is not None:
                out.append(k)
            elif self.byte_fallback:
                out += [self.bytes[b] for b in t.encode("utf-8", "replace")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def words(self, text: str) -> list[str]:
        """The text with marks for spaces, cut before every run of marks."""
        text = text.replace(SPACE, " ")  # a literal mark is encoded, and decoded, as a space
        if self.squeeze:
            text = " ".join(text.split(" ")).strip(" ")
            while "  " in text:
                text = text.replace("  ", " ")
        if not text:
            return []
        if self.dummy_prefix:
            text = " " + text
        parts = text.split(" ")
        # "a  b" has an empty part: a run of spaces is one start of a word, with all its marks.
        if "" not in parts[1:]:
            return [parts[0]] * bool(parts[0]) + [SPACE + p for p in parts[1:]]
        out, marks = [], 0
        for i, p in enumerate(parts):
            marks += i > 0
            if p:
                out.append(SPACE * marks + p)
                marks = 0
        if marks:
            out.append(SPACE * marks)
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of each text; words are looked up in a bounded memory that fills as it goes."""
        out: list[np.ndarray | None] = [None] * len(texts)
        lo = 0
        while lo < len(texts):
            hi, room = lo, _SLICE
            while hi < len(texts) and (hi == lo or room > 0):
                room -= len(texts[hi] or "")
                hi += 1
            words = [[] if t is None else self.words(t) for t in texts[lo:hi]]
            flat = list(itertools.chain.from_iterable(words))
            if len(self._memory) > REMEMBERED:
                self._memory.clear()
                self._flat, self._at = np.zeros(0, np.int32), np.zeros(1, np.int64)
            known = self._memory
            fresh = [w for w in dict.fromkeys(flat) if w not in known]
            if fresh:
                ids = [self.word(w) for w in fresh]
                base = len(self._at) - 1
                known.update(zip(fresh, range(base, base + len(fresh))))
                size = np.fromiter(map(len, ids), np.int64, len(ids))
                self._at = np.concatenate([self._at, self._at[-1] + np.cumsum(size)])
                self._flat = np.concatenate([self._flat, np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(size.sum()))])
            w = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
            for x in fresh:
                if len(x) > LONG:
                    del known[x]
            start, size = self._at[w], self._at[w + 1] - self._at[w]
            ends = np.cumsum(size)
            every = self._flat[np.arange(int(size.sum())) + np.repeat(start - (ends - size), size)] if len(w) else np.zeros(0, np.int32)
            cut = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])]
            for i in range(lo, hi):
                if texts[i] is not None:
                    out[i] = every[cut[i - lo] : cut[i - lo + 1]]
            lo = hi
        return out

    def decode(self, ids: np.ndarray | None) -> str | None:
        if ids is None:
            return None
        spelled = self.spelled
        text = b"".join([spelled[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary.read(path)
    return _VOCABULARIES[path]


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, decoded: every text's ids, and the text that they decode to. ``path`` is read on the executors."""
    path = path or os.path.join(TOKENIZERS, MODEL)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in sliced(batches):
            ids = v.encode(batch.column("text").to_pylist())
            size = np.array([0 if x is None else len(x) for x in ids], np.int64)
            flat = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)])
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), mask=np.array([*(x is None for x in ids), False], bool))
            lists = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array([v.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(both, f"doc_id {id_type}, ids array<int>, decoded string")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
