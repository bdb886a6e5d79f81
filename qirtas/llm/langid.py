"""Language identification by interpolated Kneser-Ney character models, one per language.

The models are of order four over the characters of ``^^^word$``, lower-cased, so a word's cross-entropy
doesn't depend on its neighbours. Counts of n-grams are taken
over all documents that carry a language; only distinct n-grams with their counts are shuffled. A model is a set of sorted arrays of n-gram hashes with one probability column per
language, and for the order-four n-grams that it has seen the bits that come of them: each character of a text is one look-up
of its n-gram there, and only other n-grams go through all orders. A text belongs to the language with the least cross-entropy per
character; it is rejected where that exceeds what texts of that language and length have. Those limits come from all documents that
carry a language too: texts are halved by their hash, and each half is scored with a model of the other half's counts.

Cases: a null, empty or blank text has no language, no cross-entropy and is rejected. Rows with a null ``lang``
teach nothing but are classified. Ties go to the language first in order. Without any labelled row nothing is
known, so every text with a word is accepted without a language. Repeated rows get equal results. Other columns
are left alone.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROWS_AT_ONCE, begin, cache_of, discard, free_name, give_back, sliced, table, written

ORDER = 4
#: With fewer documents that carry a language nothing is rejected.
LEAST_ROWS = 10
QUANTILE, MARGIN = 0.999, 0.75
#: A length class with fewer rows is pooled with its neighbours.
POOL_ROWS = 20
#: Bits more for each halving of the length below what the labelled texts have.
EASE = 0.5
_START, _END = 2, 3
_POSITIONS = 1 << 16
_SLICE = 1 << 20  # characters in work at once
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def _hash(grams: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of code points; rows of different widths hash apart."""
    h = np.full(len(grams), grams.shape[1] + 1, np.uint64)
    for k in range(grams.shape[1]):
        h = _mix(h, grams[:, k])
    return h


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The order-four n-grams of words, and how many each word has (its length and one for its end)."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    pad = ORDER - 1
    joined = (chr(_END) + chr(_START) * pad).join(words)
    cp = np.frombuffer((chr(_START) * pad + joined + chr(_END)).encode("utf-32-le", "replace"), np.uint32)
    first = np.cumsum(size + pad) - (size + pad)
    at = np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)
    return np.stack([cp[at + k] for k in range(ORDER)], axis=1), size


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with ``_SLICE`` characters at most, where they are several."""
    lo = 0
    while lo < len(texts):
        hi, room = lo, _SLICE
        while hi < len(texts) and (hi == lo or room > 0):
            room -= len(texts[hi] or "")
            hi += 1
        yield lo, hi
        lo = hi


def columns_of(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """The order-four n-grams of texts, the same as ``grams_of`` their words, column by column, and how many each text has."""
    lines = ["\n".join([*words, ""]) for words in map(_words, texts)]  # no word has a line break
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    joined = "".join(lines)
    if joined.isascii():
        cp = np.frombuffer(joined.encode("ascii"), np.uint8).astype(np.uint32)
    else:
        cp = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).copy()
    end = cp == ord("\n")
    cp[end] = _END
    out, before = [cp], np.zeros(len(cp), bool)  # whether an earlier word ends among the characters that a column goes back
    for k in range(1, ORDER):
        before[:k] = True
        before[k:] |= end[:-k]
        c = np.empty_like(cp)
        c[k:] = cp[:-k]
        c[before] = _START
        out.append(c)
    return out[::-1], size


def _keys(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of order-four n-grams: a sum, so that it takes few steps."""
    h = columns[0] * _WEIGHTS[0]
    for c, w in zip(columns[1:], _WEIGHTS[1:]):
        h += c * w
    return h


class _Index:
    """Where hashes stand among sorted ones, by their upper bits and some steps from there."""

    def __init__(self, hashes: np.ndarray):
        bits = len(hashes).bit_length() + 2
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift)
        self.hashes = np.r_[hashes, np.uint64(2**64 - 1)]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each hash, and whether it is there."""
        at = self.start[h >> self.shift]
        there = self.hashes[at]
        less = np.flatnonzero(there < h)
        while len(less):
            at[less] += 1
            there[less] = self.hashes[at[less]]
            less = less[there[less] < h[less]]
        return at, (there == h) & (at < len(self.hashes) - 1)


@dataclass
class Model:
    langs: list[str]
    alphabet: np.ndarray  # sorted code points
    unigram: np.ndarray  # (alphabet + 1, languages); the last row is for unknown characters
    grams: list[tuple[np.ndarray, np.ndarray]]  # for order 2, 3, 4: sorted hashes, discounted probabilities
    contexts: list[tuple[np.ndarray, np.ndarray]]  # for order 2, 3, 4: sorted hashes of contexts, back-off masses
    seen: tuple[np.ndarray, np.ndarray] | None = None  # sorted ``_keys`` of the order-four n-grams, bits by language and n-gram
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def gram_bits(self, grams: np.ndarray) -> np.ndarray:
        """Bits of each n-gram's last character in each language."""
        out = np.empty((len(grams), len(self.langs)), np.float32)
        for lo in range(0, len(grams), _POSITIONS):
            g = grams[lo : lo + _POSITIONS]
            last = g[:, -1]
            at = np.minimum(np.searchsorted(self.alphabet, last), len(self.alphabet) - 1)
            p = self.unigram[np.where(self.alphabet[at] == last, at, len(self.alphabet))]
            for n, (hashes, alpha), (seen, gamma) in zip(range(2, ORDER + 1), self.grams, self.contexts):
                ctx = _hash(g[:, ORDER - n : ORDER - 1])
                c = np.minimum(np.searchsorted(seen, ctx), len(seen) - 1)
                known = seen[c] == ctx
                full = _mix(ctx ^ np.uint64(n), last)
                f = np.minimum(np.searchsorted(hashes, full), len(hashes) - 1)
                hit = hashes[f] == full
                p = np.where(known[:, None], gamma[c], 1) * p + np.where(hit[:, None], alpha[f], 0)
            out[lo : lo + len(g)] = -np.log2(np.maximum(p, 1e-12))
        return out

    def bits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each word in each language, and the number of characters that they are for."""
        grams, size = grams_of(words)
        out = self.gram_bits(grams)
        return np.add.reduceat(out, np.cumsum(size) - size, axis=0) if len(words) else np.zeros((0, len(self.langs))), size


def _types(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows, at = np.unique(grams, axis=0, return_inverse=True)
    return rows, np.bincount(at.ravel(), weights=counts, minlength=len(rows))


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Models from each language's distinct order-four n-grams and their counts.

    Lower orders use continuation counts; discounts are D = n1 / (n1 + 2 n2) for each order and language.
    """
    langs = sorted(counts)
    levels: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    for lang in langs:
        rows, c = counts[lang]
        levels[lang] = {ORDER: (rows, c.astype(float))}
        for n in range(ORDER - 1, 0, -1):
            rows = rows[:, 1:]
            rows, c = _types(rows, np.ones(len(rows)))
            levels[lang][n] = (rows, c)
    alphabet = np.unique(np.concatenate([levels[x][1][0][:, 0] for x in langs]))
    unigram = np.zeros((len(alphabet) + 1, len(langs)), np.float32)
    for k, lang in enumerate(langs):
        rows, c = levels[lang][1]
        d = 0.75
        unigram[:, k] = d * len(rows) / c.sum() / (len(alphabet) + 1)
        unigram[np.searchsorted(alphabet, rows[:, 0]), k] += np.maximum(c - d, 0) / c.sum()
    grams, contexts = [], []
    for n in range(2, ORDER + 1):
        per = []
        for lang in langs:
            rows, c = levels[lang][n]
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            d = float(np.clip(n1 / (n1 + 2 * n2), 0.1, 0.95)) if n1 and n2 else 0.5
            ctx, at = np.unique(_hash(rows[:, :-1]), return_inverse=True)
            total, kinds = np.bincount(at, weights=c), np.bincount(at)
            per.append((_mix(_hash(rows[:, :-1]) ^ np.uint64(n), rows[:, -1]), (c - np.minimum(c, d)) / total[at], ctx, np.minimum(d, 1) * kinds / total))
        for what, (h, v), rest in ((grams, (0, 1), 0.0), (contexts, (2, 3), 1.0)):
            every = np.unique(np.concatenate([p[h] for p in per]))
            m = np.full((len(every), len(langs)), rest, np.float32)
            for k, p in enumerate(per):
                m[np.searchsorted(every, p[h]), k] = p[v]
            what.append((every, m))
    model = Model(langs, alphabet, unigram, grams, contexts)
    rows = np.concatenate([levels[x][ORDER][0] for x in langs]).astype(np.uint32)
    keys, at = np.unique(_keys([*rows.T]), return_index=True)
    model.seen = keys, np.ascontiguousarray(model.gram_bits(rows[at]).T)
    return model


#: Of the model in use: the index of the n-grams that it has seen.
_MEMORY: dict[str, _Index] = {}
cache_of("langid", _MEMORY.clear)


def _words(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def entropies(model: Model, texts: list[str | None], own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy in bits per character (texts by languages; NaN without words) and the characters of each text.

    With ``own``, the number of each text's language, only in that one (in the first column).
    """
    if model.key not in _MEMORY:
        _MEMORY.clear()  # one model at a time, so that a worker that lives on doesn't fill up
        begin("langid")
        _MEMORY[model.key] = _Index(model.seen[0])
    index = _MEMORY[model.key]
    out, chars = np.full((len(texts), len(model.langs) if own is None else 1), np.nan), np.zeros(len(texts))
    for lo, hi in _slices(texts):
        columns, size = columns_of(texts[lo:hi])
        some = np.flatnonzero(size)
        if not len(some):
            continue
        at, bits, new = np.empty(len(columns[0]), np.int64), model.seen[1], []
        for a in range(0, len(at), _POSITIONS):
            h = _keys([c[a : a + _POSITIONS] for c in columns])
            at[a : a + _POSITIONS], known = index.find(h)
            if not known.all():
                k = np.flatnonzero(~known)
                new.append((k + a, h[k]))
        if new:
            k, h = map(np.concatenate, zip(*new))
            _, first, place = np.unique(h, return_index=True, return_inverse=True)
            more = model.gram_bits(np.stack([c[k[first]] for c in columns], axis=1))
            at[k] = place + bits.shape[1]
            bits = np.concatenate([bits, more.T], axis=1)
        begins = (np.cumsum(size) - size)[some]
        chars[lo + some] = size[some]
        # Sums of one dimension, so that equal texts get equal ones wherever they stand.
        if own is None:
            sums = np.stack([np.add.reduceat(b[at].astype(np.float64), begins) for b in bits], axis=1)
        else:
            at += np.repeat(own[lo:hi] * bits.shape[1], size)
            sums = np.add.reduceat(bits.ravel()[at].astype(np.float64), begins)[:, None]
        out[lo + some] = sums / size[some][:, None]
    return out, chars


def _bucket(chars: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(np.maximum(chars, 1)).astype(int), 3, 12)


def _distinct(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows of two numbers, and the sums of what they count."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    keys, n = keys[order], n[order]
    new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
    return keys[new], np.add.reduceat(n, new)


def counted(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams, two characters to a number, and how often each occurs."""
    chars = np.flatnonzero(np.bincount(columns[-1]))
    chars = np.union1d(chars, [_START])
    if len(chars) > 1 << 16:
        a, b = (columns[k].astype(np.uint64) << np.uint64(32) | columns[k + 1] for k in (0, 2))
        return _distinct(np.stack([a, b], axis=1), np.ones(len(a), np.int64))
    number = np.zeros(int(chars[-1]) + 1, np.uint64)
    number[chars] = np.arange(len(chars))
    key = number[columns[0]]
    for c in columns[1:]:
        key <<= np.uint64(16)
        key |= number[c]
    key.sort()
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    n, key, chars = np.diff(np.r_[new, len(key)]), key[new], chars.astype(np.uint64)
    c = [chars[key >> np.uint64(s) & np.uint64(0xFFFF)] for s in (48, 32, 16, 0)]
    return np.stack([c[0] << np.uint64(32) | c[1], c[2] << np.uint64(32) | c[3]], axis=1), n


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct n-grams of a partition, by language and half, with their counts."""
    begin("langid")
    types: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] = {}
    fresh: dict[tuple[int, bool], list[tuple[np.ndarray, np.ndarray]]] = {}

    def fold(group: tuple[int, bool]) -> None:
        keys, n = map(np.concatenate, zip(*([types[group]] if group in types else []), *fresh.pop(group)))
        types[group] = _distinct(keys, n)

    for batch in batches:
        of: dict[tuple[int, bool], list[int]] = {}
        for i, group in enumerate(zip(batch.column("lang").to_pylist(), batch.column("half").to_pylist())):
            of.setdefault(group, []).append(i)
        for group, rows in of.items():
            for part in range(0, len(rows), ROWS_AT_ONCE):
                texts = batch.column("text").take(pa.array(rows[part : part + ROWS_AT_ONCE])).to_pylist()
                for lo, hi in _slices(texts):
                    columns, _ = columns_of(texts[lo:hi])
                    if len(columns[0]):
                        fresh.setdefault(group, []).append(counted(columns))
            # As many as there are, or more: each fold sorts both.
            if sum(len(n) for _, n in fresh.get(group, ())) > max(200_000, len(types[group][1]) if group in types else 0):
                fold(group)
    for group in list(fresh):
        fold(group)
    for (lang, half), (keys, n) in types.items():
        for lo in range(0, len(n), 100_000):
            k = keys[lo : lo + 100_000].astype(np.int64)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(k), pa.int32()), "half": pa.array([half] * len(k)), "a": pa.array(k[:, 0]), "b": pa.array(k[:, 1]), "n": pa.array(n[lo : lo + 100_000])})
    types.clear()
    give_back()


@dataclass
class Identifier:
    model: Model | None
    limits: np.ndarray  # by language and length class

    def judge(self, texts: list[str | None]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """Language, cross-entropy (NaN without words) and acceptance of each text."""
        if self.model is None:
            some = np.array([bool(_words(t)) for t in texts], bool)
            return [None] * len(texts), np.full(len(texts), np.nan), some
        e, chars = entropies(self.model, texts)
        none = np.isnan(e[:, 0])
        best = np.argmin(np.where(none[:, None], 0, e), axis=1) if len(e) else np.zeros(0, int)
        h = e[np.arange(len(e)), best]
        with np.errstate(invalid="ignore"):
            ok = ~none & (h <= self.limits[best, _bucket(chars)])
        return [None if x else self.model.langs[b] for x, b in zip(none, best)], h, ok


def limits_of(k: np.ndarray, m: np.ndarray, e: np.ndarray, langs: int, quantile: float, margin: float) -> np.ndarray:
    """Limits by language and length class, from language, class and cross-entropy of the labelled rows."""
    sizes = np.bincount(k * 13 + m, minlength=langs * 13).reshape(langs, 13)
    return limits_from(sizes, k, m, e, quantile, margin)


def tail_of(rows: int, quantile: float) -> int:
    """How many of the greatest values, at most, decide a quantile over at most so many rows."""
    return int(rows * (1 - quantile)) + 3


def limits_from(sizes: np.ndarray, k: np.ndarray, m: np.ndarray, e: np.ndarray, quantile: float, margin: float) -> np.ndarray:
    """The same from the number of rows of each language and class and, of each, the ``tail_of`` greatest values."""
    limits = np.full(sizes.shape, np.inf)
    for x, size in enumerate(sizes):
        own, h = m[k == x], e[k == x]
        some, every = np.flatnonzero(size), np.arange(13)
        for c in some:
            # A class with few rows is pooled with its neighbours, as far on both sides as needed.
            far = next((r for r in range(13) if size[abs(every - c) <= r].sum() >= POOL_ROWS), 13)
            n, top = int(size[abs(every - c) <= far].sum()), np.sort(h[abs(own - c) <= far])[::-1]
            at = (n - 1) * (1 - quantile) if n * (1 - quantile) >= 1 else 0.0  # from above, between two values
            low = int(at)
            limits[x, c] = top[low] + (top[min(low + 1, len(top) - 1)] - top[low]) * (at - low) + margin
        # A class of lengths without rows takes the limit of the next shorter one that has some; where all that have rows
        # are longer it takes the next longer one's, eased for every class between, since short texts vary more.
        for c in np.setdiff1d(every, some) if len(some) else ():
            shorter = some[some < c]
            limits[x, c] = limits[x, shorter[-1]] if len(shorter) else limits[x, some[0]] + EASE * (some[0] - c)
    return limits


def _scores(shared, langs: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        place = np.array([model.langs.index(x) if x in model.langs else -1 for x in langs], int)
        for batch in sliced(batches):
            lang = batch.column("lang").to_numpy()
            own = place[lang]
            e, chars = entropies(model, batch.column("text").to_pylist(), np.maximum(own, 0))
            ok = (own >= 0) & (chars > 0)
            yield pa.RecordBatch.from_pydict({"k": pa.array(lang[ok], pa.int32()), "m": pa.array(_bucket(chars[ok]), pa.int32()), "e": pa.array(e[ok, 0])})

    return score


def train(docs: DataFrame, *, quantile: float = QUANTILE, margin: float = MARGIN) -> Identifier:
    labelled = docs.where("lang is not null and text is not null").select("lang", "text")
    rows = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not rows:
        return Identifier(None, np.zeros((0, 13)))
    langs = sorted(rows)
    number = F.create_map(*itertools.chain.from_iterable((F.lit(x), F.lit(i)) for i, x in enumerate(langs)))
    # Equal texts are in one half; a bit that no other part of a pipeline selects by.
    labelled = labelled.select(number[F.col("lang")].alias("lang"), (F.shiftrightunsigned(F.xxhash64("text"), 37) % 2 == 1).alias("half"), "text")
    per_part = labelled.mapInArrow(_count_grams, "lang int, half boolean, a long, b long, n long")
    halves = [F.sum(F.when(F.col("half") == h, F.col("n")).otherwise(0)).alias(f"n{int(h)}") for h in (False, True)]
    got = per_part.groupBy("lang", "a", "b").agg(*halves).toArrow()
    lang, a, b, *n = (got.column(x).to_numpy() for x in ("lang", "a", "b", "n0", "n1"))

    def model_of(c: np.ndarray) -> Model | None:
        counts = {}
        for i, x in enumerate(langs):
            k = (lang == i) & (c > 0)
            if k.any():
                counts[x] = np.stack([a[k] >> 32, a[k] & 0xFFFFFFFF, b[k] >> 32, b[k] & 0xFFFFFFFF], axis=1).astype(np.uint32), c[k]
        return build(counts) if counts else None

    model = model_of(n[0] + n[1])
    if model is None:
        return Identifier(None, np.zeros((0, 13)))
    limits = np.full((len(model.langs), 13), np.inf)
    if sum(rows.values()) < LEAST_ROWS:
        return Identifier(model, limits)
    parts = []
    for half in (0, 1):
        other = model_of(n[1 - half])
        if other is not None:
            shared = docs.sparkSession.sparkContext.broadcast(other)
            parts.append(written(labelled.where(F.col("half") == bool(half)).mapInArrow(_scores(shared, langs), "k int, m int, e double"), "entropies"))
            shared.destroy()
    if not parts:
        return Identifier(model, limits)
    scored = parts[0].union(parts[1]) if len(parts) > 1 else parts[0]
    sizes = np.zeros((len(langs), 13), np.int64)
    for r in scored.groupBy("k", "m").agg(F.count("*").alias("n")).collect():  # at most 13 rows a language
        sizes[r.k, r.m] = r.n
    most = Window.partitionBy("k", "m").orderBy(F.desc("e"))
    tail = scored.withColumn("r", F.row_number().over(most)).where(F.col("r") <= tail_of(int(sizes.sum(axis=1).max()), quantile)).select("k", "m", "e")
    got = tail.toArrow()  # a thousandth of the rows
    discard(*parts)
    limits = limits_from(sizes, *(got.column(x).to_numpy() for x in ("k", "m", "e")), quantile, margin)
    limits = limits[[langs.index(x) for x in model.langs]]
    known = np.isfinite(limits).all(axis=1)
    if known.any():  # a language with all texts in one half takes the most lenient limits of the others
        limits[~known] = limits[known].max(axis=0)
    return Identifier(model, limits)


def _udf(who: Identifier, spark: SparkSession):
    shared = spark.sparkContext.broadcast(who)

    @F.arrow_udf("struct<lang:string,cross_entropy:double,accepted:boolean>")
    def identify(text: pa.Array) -> pa.Array:
        parts = []
        for lo in range(0, max(1, len(text)), ROWS_AT_ONCE):
            lang, h, ok = shared.value.judge(text.slice(lo, ROWS_AT_ONCE).to_pylist())
            parts.append(pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(h, mask=np.isnan(h)), pa.array(ok, pa.bool_())], names=["lang", "cross_entropy", "accepted"]))
        return pa.concat_arrays(parts)

    return identify


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, detected language, bits per character and acceptance for every row of ``docs``."""
    found = _udf(train(docs, **options), docs.sparkSession)
    return docs.select("doc_id", found("text").alias("v")).select("doc_id", F.col("v.lang").alias("detected"), "v.cross_entropy", "v.accepted")


def kept(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose language is recognised, with all their columns."""
    found = _udf(train(docs, **options), docs.sparkSession)
    name = free_name(docs, "found")
    return docs.withColumn(name, found(F.col("text"))).where(F.col(name)["accepted"]).drop(name)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
