"""Line dedup by winnowing over word hashes.

A passage is a run of words, wherever in its lines it begins and ends. A word that lies in ``min_words`` consecutive
words that stand earlier too, in another document or the same one, goes; the first stays.

Of every window of ``min_words`` words the least hash of its runs of ``min_words // 2`` words is its fingerprint
(winnowing). Neighbouring windows mostly have the same one, so a document is cut into ranges of windows with one
fingerprint: some eight for every hundred words, and equal windows have equal fingerprints. Two steps of joins follow:

1. Ranges meet by fingerprint. Where all ranges of a fingerprint hold the same words, the later ones are repeated as a
   whole, and nothing else need be looked at: this is the inside of every repeated run.
2. Where a fingerprint has ranges that differ, as at both ends of a run, each different range is given out window by
   window, and windows meet by a hash of all their words. So each match is extended word by word both ways, whichever
   earlier document a word came from (pairwise extension from the first partner alone would stop short where that
   partner's run is shorter). Which ranges these are is told to the tasks as a bitmap of bounded size: a
   bit set by another range costs some windows more in the join and changes no result.

Both joins are of what a batch of documents has left after looking in itself: a fingerprint or window that very many
documents share is one row a batch. No line, run or group of copies is too long or too frequent to be looked at.

Order: "first" is by (doc_id, hash of the text, word); null ids come first. Words are compared without the white space
between them. A line all of whose words go is deleted, with the blank lines inside a run; of other lines the words that
stay are kept with their spacing. Short boilerplate alone stays. Where copies of a window overlap within one document
(a line or word over and over), what stays is the first copy up to the end of the line in which it ends; so a single
line that repeats itself at a distance under ``min_words`` stays. Rows that repeat both id and text are one document
and are edited alike. Null and empty texts come back as they are. A document all of whose lines go keeps its row
with an empty text (``deduped`` leaves it out on request). Extra columns are kept; ``n_chars`` is set anew if
there is one.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROWS_AT_ONCE, begin, bitmap, cache_of, discard, free_name, give_back, holds, table, written

MIN_WORDS = 50
_BASE = 0x9E3779B97F4A7C15
_NEVER = 2**31 - 1
#: Characters of text that are in work at once, unless one text has more.
_CHARS = 1 << 21
#: Kinds of rows: a range, a fingerprint whose ranges differ, a window, words that go.
_RANGE, _DIFFERS, _WINDOW, _GONE = range(4)


def _powers(n: int, base: int) -> np.ndarray:
    """base ** (0 .. n - 1) modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_KNOWN: dict[int, np.ndarray] = {}


def _upto(n: int, base: int) -> np.ndarray:
    """The first ``n`` powers of ``base``, at least; kept for the next batch."""
    if base not in _KNOWN or len(_KNOWN[base]) < n:
        _KNOWN[base] = _powers(max(n, 1 << 18), base)
    return _KNOWN[base]


cache_of("linededup", _KNOWN.clear)


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(29))


#: A number for each of the first bytes of a word and each value that it may have; a word's hash is their sum.
_FIRST = 64
_NUMBERS = _mixed(_mixed(np.arange(1, (_FIRST << 8) + 1, dtype=np.uint64) * np.uint64(_BASE)))
_WORDS_AT_ONCE = 1 << 13


def word_hashes(words: list[list[str]]) -> np.ndarray:
    """Hashes of the words of some texts, one after the other. No Python step a word but for those of over ``_FIRST`` bytes."""
    raw = "".join("\n".join([*w, ""]) for w in words).encode()  # no word has a line break
    if not raw:
        return np.zeros(0, np.uint64)
    byte = np.frombuffer(raw, np.uint8)
    end = np.flatnonzero(byte == ord("\n"))
    begin = np.r_[0, end[:-1] + 1]
    out = np.empty(len(end), np.uint64)
    for lo in range(0, len(end), _WORDS_AT_ONCE):
        first = begin[lo : lo + _WORDS_AT_ONCE]
        n = np.minimum(end[lo : lo + _WORDS_AT_ONCE] - first, _FIRST)
        upto = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(upto, n)
        value = byte[place + np.repeat(first, n)]
        out[lo : lo + len(n)] = np.add.reduceat(_NUMBERS[place << 8 | value], upto)
    for i in np.flatnonzero(end - begin > _FIRST).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[begin[i] : end[i]])
    return out


def _together(key: np.ndarray) -> np.ndarray:
    """An order in which equal numbers are neighbours and stay in order: the upper bits are sorted along with the places,
    and only where different ones share those are whole numbers sorted."""
    low = np.uint64(len(key).bit_length())
    z = key.view(np.uint64) >> low << low
    z |= np.arange(len(key), dtype=np.uint64)
    z.sort()
    order = (z & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    z >>= low
    own = key[order]
    return np.argsort(key, kind="stable") if ((z[1:] == z[:-1]) & (own[1:] != own[:-1])).any() else order


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, done = len(x) - width + 1, 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[:n], x[width - done : width - done + n])


class Batch:
    """The windows of some texts, one after the other: for each its text, first word, fingerprint and content hash,
    and the ranges of windows with one fingerprint."""

    def __init__(self, texts: list[str], min_words: int):
        words = [t.split() for t in texts]
        size = np.fromiter(map(len, words), np.int64, len(words))
        self.texts, self.min_words, self.begin = texts, min_words, np.cumsum(size) - size
        total = int(size.sum())
        owner = np.repeat(np.arange(len(texts)), size)
        whole = owner[: max(0, total - min_words + 1)] == owner[min_words - 1 :]
        self.at = np.flatnonzero(whole)
        if not len(self.at):
            self.first = self.at
            return
        self.owner = owner[self.at]
        upto = np.zeros(total + 1, np.uint64)
        np.cumsum(word_hashes(words) * _upto(total, _BASE)[:total], out=upto[1:])
        self.upto, self.inverse = upto, _upto(total, pow(_BASE, -1, 1 << 64))
        short = max(1, min_words // 2)
        least = _sliding_min(self.hash_of(slice(None, -short), slice(short, None)), min_words - short + 1)
        self.least, self.content = least[self.at], self.hash_of(self.at, self.at + min_words)
        new = np.r_[True, (np.diff(self.at) > 1) | (self.owner[1:] != self.owner[:-1]) | (self.least[1:] != self.least[:-1])]
        self.first = np.flatnonzero(new)  # of each range, as an index of windows
        self.count = np.diff(np.r_[self.first, len(self.at)])

    def hash_of(self, lo, hi) -> np.ndarray:
        """A hash of the words from ``lo`` to ``hi``."""
        z = self.upto[hi] - self.upto[lo]
        return _mixed(z * (self.inverse[: len(z)] if isinstance(lo, slice) else self.inverse[lo])).view(np.int64)

    def ranges(self) -> np.ndarray:
        lo = self.at[self.first]
        return self.hash_of(lo, lo + self.count + self.min_words - 1) ^ _mixed(self.count.astype(np.uint64)).view(np.int64)

    def free(self) -> tuple[np.ndarray, np.ndarray]:
        """For every window the first word that may go where its document has later copies of it, and whether copies overlap."""
        own = self.at - self.begin[self.owner]
        free, lap = own + self.min_words, np.zeros(len(own), bool)
        key = self.content ^ _mixed(self.owner.astype(np.uint64) + np.uint64(1)).view(np.int64)
        order = _together(key)
        key = key[order]
        near = (key[1:] == key[:-1]) & (np.diff(order) < self.min_words)
        lap[order[1:][near]] = lap[order[:-1][near]] = True
        for d in np.unique(self.owner[lap]).tolist():
            k = slice(*np.searchsorted(self.owner, [d, d + 1]))
            free[k] = _free_from(self.texts[d], self.content[k], self.min_words)
        return free, lap


def _first(*keys: np.ndarray) -> np.ndarray:
    """Where a row of sorted keys differs from the one before it."""
    return np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])] if len(keys[0]) else np.zeros(0, bool)


def _any(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each row whether any of its group has ``x``."""
    at = np.flatnonzero(new)
    return np.repeat(np.logical_or.reduceat(x, at), np.diff(np.r_[at, len(x)])) if len(x) else x


def _united(owner: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals without those that touch: owner, first and last."""
    order = np.lexsort((lo, owner))
    owner, lo, hi = owner[order], lo[order], hi[order]
    far = int(hi.max()) + 2 if len(hi) else 1
    last = np.maximum.accumulate(owner * far + hi)
    new = np.flatnonzero(np.r_[True, owner[1:] * far + lo[1:] > last[:-1] + 1] | _first(owner)) if len(lo) else np.zeros(0, int)
    return owner[new], lo[new], last[np.r_[new[1:] - 1, len(lo) - 1]] - owner[new] * far if len(new) else lo[:0]


_ROW = ["kind", "a", "b", "s", "x"]


class _Rows:
    """Collects rows of (kind, a, b, s, x) of texts."""

    def __init__(self):
        self.parts: list[tuple] = []

    def add(self, kind: int, owner, a, b, s, x) -> None:
        if len(owner):
            n = len(owner)
            self.parts.append((owner, np.full(n, kind, np.int8), *(np.broadcast_to(np.asarray(v), n) for v in (a, b, s, x))))

    def batch(self, doc_id: pa.Array, h: pa.Array) -> pa.RecordBatch:
        owner, kind, a, b, s, x = map(np.concatenate, zip(*self.parts))
        who = pa.array(owner)
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(s.astype(np.int32)), pa.array(x.astype(np.int32)), doc_id.take(who), h.take(who)], names=[*_ROW, "doc_id", "h"])


def _looked_in(b: Batch, free: np.ndarray, windows: np.ndarray, rows: _Rows, gone: list[tuple]) -> None:
    """Windows that are to meet those of other batches; those that another text of this one has earlier go at once."""
    order = windows[_together(b.content[windows])]
    new = _first(b.content[order])
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    stay = b.owner[order] == b.owner[order][first]
    own = order[stay]
    rows.add(_WINDOW, b.owner[own], b.content[own], 0, b.at[own] - b.begin[b.owner[own]], free[own])
    gone.append((b.owner[order[~stay]], b.at[order[~stay]], b.at[order[~stay]] + b.min_words - 1))


def _spans(b: Batch, ranges: np.ndarray) -> np.ndarray:
    """The windows of some ranges, in order."""
    n = b.count[ranges]
    return np.repeat(b.first[ranges] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _gone(b: Batch, gone: list[tuple], rows: _Rows) -> None:
    owner, lo, hi = _united(*map(np.concatenate, zip(*gone))) if gone else (np.zeros(0, np.int64),) * 3
    rows.add(_GONE, owner, 0, 0, lo - b.begin[owner], hi - b.begin[owner])


def _grouped(batches: Iterator[pa.RecordBatch], wanted=None) -> Iterator[tuple[list[str], pa.RecordBatch]]:
    """Texts of some rows, in the order in which words come first, each (doc_id, h) once."""
    begin("linededup")
    for batch in batches:
        sizes = np.array([0 if x is None else x for x in batch.column("size").to_pylist()], np.int64)
        some = np.flatnonzero(sizes > 0 if wanted is None else (sizes > 0) & wanted(batch.column("k").to_numpy(), -1))
        lo = 0
        while lo < len(some):
            n = max(1, int(np.searchsorted(np.cumsum(sizes[some[lo : lo + ROWS_AT_ONCE]]), _CHARS, side="right")))
            at, lo = some[lo : lo + n], lo + n
            keys = [(d is not None, 0 if d is None else d, h) for d, h in zip(*(batch.column(x).take(pa.array(at)).to_pylist() for x in ("doc_id", "h")))]
            order = [i for _, g in itertools.groupby(sorted(range(len(at)), key=keys.__getitem__), key=keys.__getitem__) for i in itertools.islice(g, 1)]
            part = batch.take(pa.array(at[order]))
            yield part.column("text").to_pylist(), part
    give_back()


def _ranges(min_words: int):
    """First step: what each batch has to say about ranges."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, part in _grouped(batches):
            b = Batch(texts, min_words)
            if not len(b.first):
                continue
            free, lap = b.free()
            rows, gone = _Rows(), []
            content, least = b.ranges(), b.least[b.first]
            order = _together(content)  # of equal ones the first comes first
            order = order[_together(least[order])]
            least, content = least[order], content[order]
            laps = np.logical_or.reduceat(lap, b.first)[order]
            of, alike = _first(least), _first(least, content)
            apart = _any(laps, of)  # copies that overlap meet window by window
            differ = _any(alike & ~of, of) | apart
            own, start, last = b.owner[b.first[order]], b.at[b.first[order]], b.at[b.first[order]] + b.count[order] + min_words - 2
            k = of & ~differ
            rows.add(_RANGE, own[k], least[k], content[k], start[k] - b.begin[own[k]], b.count[order[k]])
            k = of & differ
            rows.add(_DIFFERS, own[k], least[k], 0, 0, 0)
            k = ~alike & ~apart
            gone.append((own[k], start[k], last[k]))
            _looked_in(b, free, _spans(b, np.sort(order[differ & (alike | apart)])), rows, gone)
            _gone(b, gone, rows)
            yield rows.batch(part.column("doc_id"), part.column("h"))

    return find


def _bit(k: np.ndarray, s) -> np.ndarray:
    """What stands for a range that starts at word ``s`` of a text (-1: for the text) in the bitmap."""
    return _mixed(k.view(np.uint64) + _mixed((np.zeros(len(k), np.int64) + s).view(np.uint64))).view(np.int64)


def _bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k = batch.column("k").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[_bit(k, batch.column("s").to_numpy()), np.unique(_bit(k, -1))])], names=["bit"])


def _windows(min_words: int, marked):
    """Second step: the windows of the ranges that are marked."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = marked.value

        def wanted(k: np.ndarray, s) -> np.ndarray:
            return holds(bits, _bit(k, s))

        for texts, part in _grouped(batches, wanted):
            b = Batch(texts, min_words)
            if not len(b.first):
                continue
            own = b.owner[b.first]
            some = np.flatnonzero(wanted(part.column("k").to_numpy()[own], b.at[b.first] - b.begin[own]))
            if len(some):
                rows, gone = _Rows(), []
                _looked_in(b, b.free()[0], _spans(b, some), rows, gone)
                _gone(b, gone, rows)
                yield rows.batch(part.column("doc_id"), part.column("h"))

    return find


def _free_from(text: str, content: np.ndarray, min_words: int) -> np.ndarray:
    """For every window the first word that may go where its document has later copies of it."""
    n = len(content)
    out = np.arange(min_words, min_words + n)
    order = np.argsort(content, kind="stable")
    near = (content[order[1:]] == content[order[:-1]]) & (np.diff(order) < min_words)
    if near.any():
        lap = np.union1d(order[1:][near], order[:-1][near])
        starts = np.r_[np.cumsum([len(x.split()) for x in text.split("\n")]), _NEVER]
        out[lap] = starts[np.searchsorted(starts[:-1], lap + min_words)]
        out[out >= n + min_words - 1] = _NEVER
    return out


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, h (hash of the text) and the ranges of words that go, for each document that has some, as a table of its own."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"kind byte, a long, b long, s int, x int, doc_id {id_type}, h long"
    rows = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("h"), "text", F.length("text").alias("size")).withColumn("k", F.xxhash64("doc_id", "h"))
    found = written(rows.mapInArrow(_ranges(min_words), schema), "ranges")

    # Ranges meet by fingerprint: one shuffle, of a row a batch for one that all have.
    of, alike = Window.partitionBy("a"), Window.partitionBy("a", "b").orderBy(F.asc_nulls_first("doc_id"), "h", "s")
    met = found.where(F.col("kind").isin(_RANGE, _DIFFERS)).withColumn("differ", (F.max("kind").over(of) == _DIFFERS) | (F.min("b").over(of) != F.max("b").over(of)))
    met = met.where(F.col("kind") == _RANGE).withColumn("later", F.dense_rank().over(alike) > 1).where("differ or later")
    met = written(met.select("doc_id", "h", "s", "x", "later"), "met")
    marked = docs.sparkSession.sparkContext.broadcast(bitmap(met.where("not later").select(F.xxhash64("doc_id", "h").alias("k"), "s").mapInArrow(_bits_of, "bit long")))
    more = written(rows.mapInArrow(_windows(min_words, marked), schema), "windows")

    # Windows meet by content.
    windows = found.where(F.col("kind") == _WINDOW).union(more.where(F.col("kind") == _WINDOW)).select("a", "doc_id", "h", "s", "x")
    place = F.struct("doc_id", "h", "s", "x")
    # A partial aggregate before the shuffle; what occurs at one place only is out.
    first = windows.groupBy("a").agg(F.min(place).alias("f"), F.max(place).alias("l")).where("f < l").select("a", "f")
    same = F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("h") == F.col("f.h"))
    later = windows.join(first, "a").where(~(same & (F.col("s") == F.col("f.s"))))
    later = later.select("doc_id", "h", F.when(same, F.greatest("s", "f.x")).otherwise(F.col("s")).alias("s"), (F.col("s") + (min_words - 1)).alias("e")).where("s <= e")

    whole = met.where("later").select("doc_id", "h", "s", (F.col("s") + F.col("x") + (min_words - 2)).alias("e"))
    at_once = [x.where(F.col("kind") == _GONE).select("doc_id", "h", "s", F.col("x").alias("e")) for x in (found, more)]
    runs = later.union(whole).union(at_once[0]).union(at_once[1])
    out = written(runs.groupBy("doc_id", "h").agg(F.collect_set(F.struct("s", "e")).alias("runs")), "runs")
    discard(found, met, more)
    marked.destroy()
    return out


def _edited(text: str, runs: np.ndarray) -> tuple[str, int, int]:
    """``text`` without the words of ``runs`` (first, last), its lines, and how many of them went."""
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    last = np.maximum.accumulate(runs[:, 1])
    new = np.flatnonzero(np.r_[True, runs[1:, 0] > last[:-1]])
    first, last = runs[new, 0].tolist(), last[np.r_[new[1:] - 1, len(runs) - 1]].tolist()
    lines = text.split("\n")
    kept, at, k = [], 0, 0
    for line in lines:
        n = len(line.split())
        while k < len(first) and last[k] < at:
            k += 1
        if k == len(first) or first[k] >= at + n:
            # A blank line goes with the run on both sides of it.
            if n or k == len(first) or not first[k] < at <= last[k]:
                kept.append(line)
        else:
            words = list(re.finditer(r"\S+", line))
            stay = np.ones(n, bool)
            j = k
            while j < len(first) and first[j] < at + n:
                stay[max(0, first[j] - at) : last[j] + 1 - at] = False
                j += 1
            if stay.any():
                # Every word that stays, with the space after it; what came before the first word stays before it.
                ends = [w.start() for w in words[1:]] + [len(line)]
                cut = line[: words[0].start()] + "".join(line[w.start() : e] for w, e, x in zip(words, ends, stay) if x)
                kept.append(cut if stay[-1] else cut.rstrip())
        at += n
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def _without(text: pa.Array, runs: pa.Array) -> pa.Array:
    out = []
    spans = np.stack([runs.values.field(x).to_numpy() for x in ("s", "e")], axis=1)
    at, some = runs.offsets.to_numpy(), runs.is_valid().to_numpy(zero_copy_only=False)
    for i, t in enumerate(text.to_pylist()):
        if t is None or not some[i] or at[i] == at[i + 1]:
            out.append((t, 0 if t is None else t.count("\n") + 1, 0))
        else:
            out.append(_edited(t, spans[at[i] : at[i + 1]]))
    columns = zip(*out) if out else ((), (), ())
    return pa.StructArray.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.string(), pa.int32(), pa.int32()))], names=["text", "n_lines", "n_deleted"])


def deduped(docs: DataFrame, min_words: int = MIN_WORDS, *, counts: bool = False, drop_emptied: bool = False) -> DataFrame:
    """``docs`` without repeated runs, with the same columns; with ``counts`` also ``n_lines`` and ``n_deleted``.

    Which documents have something to delete is told to the tasks as a bitmap; the texts of the others aren't shuffled
    and don't reach Python a second time.
    """
    spark = docs.sparkSession
    runs = repeated_runs(docs, min_words)
    bits = spark.sparkContext.broadcast(bitmap(runs.select(F.xxhash64("doc_id", "h").alias("bit"))))
    d, h, r, v = (free_name(docs, x) for x in ("run_doc", "text_hash", "runs", "edited"))
    some = F.arrow_udf(lambda k: pa.array(holds(bits.value, k.to_numpy())), "boolean")(F.xxhash64("doc_id", F.xxhash64("text")))
    runs = runs.select(F.col("doc_id").alias(d), F.col("h").alias(h), F.col("runs").alias(r))
    without = F.arrow_udf(_without, "struct<text:string,n_lines:int,n_deleted:int>")
    touched = docs.where(some).join(runs, docs["doc_id"].eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"]) == F.col(h)), "left")
    touched = touched.withColumn(v, F.when(F.col(h).isNotNull(), without(F.when(F.col(h).isNotNull(), F.col("text")), F.col(r))))
    edited = touched.withColumn("text", F.when(F.col(h).isNotNull(), F.col(f"{v}.text")).otherwise(F.col("text")))
    if drop_emptied:
        edited = edited.where(F.col(h).isNull() | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        edited = edited.withColumn("n_chars", F.when(F.col(h).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    lines, none = F.size(F.split("text", "\n")), F.lit(0)
    left = docs.where(~some).select(*docs.columns, *([lines.alias("n_lines"), none.alias("n_deleted")] if counts else []))
    extra = [F.coalesce(F.col(f"{v}.n_lines"), lines).alias("n_lines"), F.coalesce(F.col(f"{v}.n_deleted"), none).alias("n_deleted")]
    return left.union(edited.select(*docs.columns, *(extra if counts else [])))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return deduped(docs.select("doc_id", "text"), counts=True)
