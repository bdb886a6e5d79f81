"""SimHash near-dedup by a self-join of blocks of bits.

A text's fingerprint has 256 bits: the signs of the sum, over its distinct lower-cased words, of a pseudo-random
+1/-1 vector per word. Two texts are linked if at most ``max_bits`` of the bits differ. The fingerprint is cut into
blocks of 32 bits (for large ``max_bits`` a little narrower than the logarithm of the number of fingerprints), and block k has an error budget t(k) with
sum(t(k) + 1) = max_bits + 1: were every block over its budget, more than ``max_bits`` bits would differ. So no link
is missed if each block's values are joined within its budget. For that a block has a cover, 63 masks for five bits of 32:
whichever five differ, some mask has none of them, so values are sorted under each mask in turn and equal ones are compared.
Few fingerprints, or a budget that would take too many masks, are joined by binary tries instead: pairs of nodes are traversed
together, differing bits add up, and a pair of nodes is dropped once it exceeds the block's budget. What meets is checked on
all 256 bits; a link counts in the first block, and under the first mask, that finds it.

For the cluster a block is taken as a binary trie too. It is spread over the cluster by its upper nodes: a node with more than ``group`` fingerprints is split into its
children, and (behind ``_DEEPEST`` levels, as where a third of all share a block's value) by a hash; pairs of such nodes
that are within the budget are one task each. Their number comes from counts of the upper nodes alone. Texts with equal
fingerprints are one node. There is no cap on partners; only a spanning forest and the sums of each task's links are
shuffled. Classes are connected components; the least id of a class names it and stays.

Cases: null texts and texts without a word have no links and are a class of their own. Rows with the same id and text are
one document and stay or go together. A null id loses against any other; a class of null ids only stays whole and has
no name. Empty tables give empty results. Other columns are left alone.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import begin, discard, free_name, give_back, sliced, table, written

BITS = 256
MAX_BITS = 44
#: Fingerprints of an upper node of a trie, of which a task holds two.
GROUP = 1 << 20
_DEEPEST = 12
_SELF = 2  # the side of a part that is joined with itself
_SIG = ["s0", "s1", "s2", "s3"]
_WORDS_AT_ONCE = 1 << 14
_CELLS, _LEAF = 1 << 15, 16
#: Positions of one key above which it is compared by itself; error budget of a block up to which it is joined by a cover, and
#: the fingerprints of a cell from which on that pays.
_WIDE, _COVERED, _FEW = 256, 5, 2048


def _vectors(hashes: np.ndarray) -> np.ndarray:
    """256 pseudo-random bits for each 64-bit hash (splitmix64 of it in four streams)."""
    out = np.empty((len(hashes), 4), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(4):
            z = hashes + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1))
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out[:, k] = z ^ (z >> np.uint64(31))
    return out


def fingerprint(text: str) -> np.ndarray | None:
    """Four 64-bit words, or None for a text without words."""
    words = set(text.lower().split())
    if not words:
        return None
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), _WORDS_AT_ONCE):
        ones += np.unpackbits(_vectors(hashes[lo : lo + _WORDS_AT_ONCE]).view(np.uint8), axis=1).sum(axis=0, dtype=np.uint16 if len(hashes) < 60_000 else np.int64)
    return np.packbits(2 * ones > len(hashes)).view(np.uint64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints, null for texts without words."""
    begin("neardup")
    for batch in sliced(batches):
        sigs = [None if t is None else fingerprint(t) for t in batch.column("text").to_pylist()]
        none = np.array([s is None for s in sigs], bool)
        got = np.array([np.zeros(4, np.uint64) if s is None else s for s in sigs], np.uint64).reshape(-1, 4).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), *(pa.array(got[:, k], mask=none) for k in range(4))], names=["doc_id", "h", *_SIG])


def blocks_of(n: int, max_bits: int) -> list[tuple[int, int, int]]:
    """First bit, width and error budget of each block for ``n`` fingerprints."""
    least = math.ceil(BITS / 32)
    narrow = min(32, max(10, math.log2(max(n, 2)) - 2.5))
    count = least if max_bits < least * (_COVERED + 1) else max(least, min(max_bits + 1, round(BITS / narrow)))
    edges = [round(BITS * k / count) for k in range(count + 1)]
    budget, more = divmod(max_bits + 1, count)
    return [(a, b - a, budget - (k >= more)) for k, (a, b) in enumerate(zip(edges, edges[1:])) if budget - (k >= more) >= 0]


def _values(sig: np.ndarray, first: int, width: int) -> np.ndarray:
    """``width`` bits of each fingerprint from bit ``first`` on, as a number."""
    words = sig.view(np.uint64)
    w, at = divmod(first, 64)
    out = words[:, w] >> np.uint64(at)
    if at + width > 64:
        out = out | words[:, w + 1] << np.uint64(64 - at)
    return (out & np.uint64((1 << width) - 1)).astype(np.uint32)


def _sigs(batch: pa.RecordBatch) -> np.ndarray:
    return np.ascontiguousarray(np.stack([batch.column(x).to_numpy() for x in _SIG], axis=1)).view(np.uint64)


def _upper(blocks: list[tuple[int, int, int]]):
    """Counts of each block's upper nodes in a partition."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(1 << min(w, _DEEPEST), np.int64) for _, w, _ in blocks]
        for batch in batches:
            sig = _sigs(batch)
            for k, (first, w, _) in enumerate(blocks):
                deep = min(w, _DEEPEST)
                total[k] += np.bincount(_values(sig, first, w) >> np.uint32(w - deep), minlength=1 << deep)
        for k, n in enumerate(total):
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"block": pa.array([k] * len(some), pa.int32()), "top": pa.array(some, pa.int32()), "n": pa.array(n[some])})

    return count


def cells_of(counts: np.ndarray, width: int, budget: int, group: int) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int]]]]:
    """How a block's trie is spread, from the counts of its nodes ``_DEEPEST`` levels down (or as deep as it is).

    Gives for each such node its first cell part, the number of parts that a hash deals it to, and for each part the
    (cell, side) that it takes part in; a cell is a pair of parts within the budget, or one part with itself.
    """
    deep = len(counts).bit_length() - 1
    upto = np.r_[0, np.cumsum(counts)]
    tops, todo = [], [(0, 0)]
    while todo:  # depth first, so nodes come in order
        prefix, length = todo.pop()
        lo, hi = prefix << (deep - length), (prefix + 1) << (deep - length)
        n = int(upto[hi] - upto[lo])
        if n > group and length < deep:
            todo += [(prefix * 2 + 1, length + 1), (prefix * 2, length + 1)]
        elif n:
            tops.append((prefix, length, lo, hi, max(1, -(-n // group))))
    part, parts = np.zeros(1 << deep, np.int64), np.ones(1 << deep, np.int64)
    nodes = []
    for prefix, length, lo, hi, s in tops:
        part[lo:hi], parts[lo:hi] = len(nodes), s
        nodes += [(prefix, length)] * s
    prefix, length = (np.array([x[k] for x in nodes], np.int64).reshape(-1) for k in (0, 1))
    takes: list[list[tuple[int, int]]] = [[] for _ in nodes]
    cell = 0
    for i in range(len(nodes)):
        common = np.minimum(length[i], length[i:])
        far = np.bitwise_count((prefix[i] >> (length[i] - common)) ^ (prefix[i:] >> (length[i:] - common)))
        for j in (i + np.flatnonzero(far <= budget)).tolist():
            takes[i].append((cell, 0 if j != i else _SELF))
            if j != i:
                takes[j].append((cell, 1))
            cell += 1
    return part, parts, takes


def _spread(blocks: list[tuple[int, int, int]], cells):
    """Every fingerprint to the cells of its upper nodes; a cell's key has the block above 2 ** 40."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, node = _sigs(batch), batch.column("node").to_numpy()
            for k, (first, w, _) in enumerate(blocks):
                part, parts, takes = cells.value[k]
                top = _values(sig, first, w) >> np.uint32(w - min(w, _DEEPEST))
                mine = part[top] + (node.view(np.uint64) >> np.uint64(8)).astype(np.int64) % parts[top]
                for p in np.unique(mine).tolist():
                    own = batch.filter(pa.array(mine == p))
                    for cell, side in takes[p]:
                        n = own.num_rows
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k << 40 | cell)), pa.array(np.full(n, side, np.int8)), *own.columns], names=["key", "side", *own.schema.names])

    return spread


def _runs(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of at least one element whose sizes sum up to ``most`` at most, where there are several."""
    upto = np.r_[0, np.cumsum(size)]
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


def _batched(leaves: Iterator[tuple[np.ndarray, ...]], most: int = 1 << 16) -> Iterator[tuple[np.ndarray, ...]]:
    held, n = [], 0
    for x in leaves:
        held.append(x)
        n += len(x[0])
        if n >= most:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def trie_pairs(value: np.ndarray, width: int, budget: int, cut: int | None = None, leaf: int = _LEAF) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of leaves that hold all pairs of positions whose values (of ``width`` bits) differ in at most ``budget`` bits.

    ``value`` is sorted, or sorted up to ``cut`` and from there on: then pairs are of one from each side. Both are the
    roots of binary tries whose nodes are ranges of positions; leaves are those of at most ``leaf`` positions, cut up
    where equal values make them longer. Gives begin and end of the first and of the second leaf of each pair.
    """
    n = len(value)
    a, b = ((0, n), (0, n)) if cut is None else ((0, cut), (cut, n))
    one = lambda x: np.array([x], np.int64)
    todo = [(width, one(a[0]), one(a[1]), one(b[0]), one(b[1]), np.zeros(1, np.int8))] if a[1] > a[0] and b[1] > b[0] else []
    ones: dict[int, np.ndarray] = {}
    while todo:
        d, alo, ahi, blo, bhi, err = todo.pop()
        if not len(alo):
            continue
        if len(alo) > 1 << 17:  # the frontier stays bounded: depth first over halves
            m = len(alo) // 2
            todo += [(d, *(x[:m] for x in (alo, ahi, blo, bhi, err))), (d, *(x[m:] for x in (alo, ahi, blo, bhi, err)))]
            continue
        small = np.maximum(ahi - alo, bhi - blo) <= leaf
        if small.any():
            yield alo[small], ahi[small], blo[small], bhi[small]
            alo, ahi, blo, bhi, err = (x[~small] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        if not d:
            na, nb = -((alo - ahi) // leaf), -((blo - bhi) // leaf)
            for lo, hi in _runs(na * nb, 1 << 17):
                if hi == lo + 1 and na[lo] * nb[lo] > 1 << 17:  # a value that very many share: its leaves row by row
                    right = np.arange(blo[lo], bhi[lo], leaf)
                    for i in range(int(alo[lo]), int(ahi[lo]), leaf):
                        r = right[right >= i] if alo[lo] == blo[lo] else right
                        yield np.full(len(r), i), np.full(len(r), min(i + leaf, ahi[lo])), r, np.minimum(r + leaf, bhi[lo])
                    continue
                n = (na * nb)[lo:hi]
                at = np.repeat(np.arange(lo, hi), n)
                k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                x, y = alo[at] + k // nb[at] * leaf, blo[at] + k % nb[at] * leaf
                ok = (alo[at] != blo[at]) | (x <= y)
                yield x[ok], np.minimum(x + leaf, ahi[at])[ok], y[ok], np.minimum(y + leaf, bhi[at])[ok]
            continue
        if d not in ones:
            ones[d] = np.r_[0, np.cumsum(value >> np.uint32(d - 1) & np.uint32(1), dtype=np.int64)]
        c = ones[d]
        am, bm = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        same, more = alo == blo, err + np.int8(1)
        cross = more <= budget
        kids = [(alo, am, blo, bm, err), (am, ahi, bm, bhi, err), tuple(x[cross] for x in (alo, am, bm, bhi, more)), tuple(x[cross & ~same] for x in (am, ahi, blo, bm, more))]
        k = [np.concatenate(x) for x in zip(*kids)]
        some = (k[1] > k[0]) & (k[3] > k[2]) & ~((k[0] == k[2]) & (k[1] - k[0] < 2))
        todo.append((d - 1, *(x[some] for x in k)))


def _near(words: list[np.ndarray], alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of positions, one from each of two leaves, that differ in at most ``max_bits`` bits; leaves are
    compared as square tiles, and most pairs are out after half of the bits."""
    size, last = np.maximum(ahi - alo, bhi - blo), len(words[0]) - 1
    differ, bits, more = (np.empty(_CELLS, x) for x in (np.uint64, np.uint8, np.uint8))  # fresh memory would cost more than the work
    for low, t in ((0, 4), (4, 8), (8, _LEAF)):
        own = np.flatnonzero((size > low) & (size <= t))
        step = _CELLS // (t * t)
        for lo in range(0, len(own), step):
            k = own[lo : lo + step]
            i, j = (np.minimum(x[k][:, None] + np.arange(t), last) for x in (alo, blo))
            n, shape = len(k) * t * t, (len(k), t, t)
            for w, to in ((words[0], bits), (words[1], more)):
                np.bitwise_xor(w[i][:, :, None], w[j][:, None, :], out=differ[:n].reshape(shape))
                np.bitwise_count(differ[:n], out=to[:n])
            np.add(bits[:n], more[:n], out=bits[:n])
            at = np.flatnonzero(bits[:n] <= max_bits)
            p, u, v = k[at // (t * t)], at // t % t, at % t
            x, y = alo[p] + u, blo[p] + v
            ok = (x < ahi[p]) & (y < bhi[p]) & ((alo[p] != blo[p]) | (u < v))
            x, y = x[ok], y[ok]
            total = sum(np.bitwise_count(w[x] ^ w[y]).astype(np.int16) for w in words)
            ok = total <= max_bits
            yield x[ok], y[ok]


class Forest:
    """Connected components over positions; labels are least members."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            a, b = self.label[x], self.label[y]
            ok = a != b
            x, y, a, b = x[ok], y[ok], a[ok], b[ok]
            m = np.minimum(a, b)
            np.minimum.at(self.label, a, m)
            np.minimum.at(self.label, b, m)
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]


def cover(width: int, budget: int) -> np.ndarray:
    """Masks of a block, number 0 unused: whatever ``budget`` bits differ, at least one mask has none of them.

    Each bit gets a vector of ``budget`` + 1 dimensions, and mask v the bits whose vector has an odd product with v: some v is
    orthogonal to any ``budget`` vectors. Of 32 bits with five errors all masks but one have 16 (a first-order Reed-Muller code).
    """
    half, full = 1 << budget, (2 << budget) - 1
    at = np.arange(width, dtype=np.uint32)
    vector = half | at if width <= half else at % full + 1
    odd = np.bitwise_count(np.arange(full + 1, dtype=np.uint32)[:, None] & vector) & 1
    return (odd.astype(np.uint32) << at).sum(axis=1, dtype=np.uint32)


def _clean(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the low and the high 16 bits of a difference, a bit for each mask that has none of them."""
    one = np.uint64(1) << np.arange(len(masks), dtype=np.uint64)
    at, tables = np.arange(1 << 16), np.full((2, 1 << 16), 2**64 - 1, np.uint64)
    for bit in range(32):
        tables[bit // 16, at >> bit % 16 & 1 == 1] &= one[masks >> np.uint32(bit) & np.uint32(1) == 0].sum(dtype=np.uint64)
    return tables[0], tables[1]


def _same(key: np.ndarray, words: tuple[np.ndarray, np.ndarray], max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions with one key (``key`` is sorted) that differ in at most ``max_bits`` bits of two words."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    differ, bits, more = (np.empty(_CELLS, x) for x in (np.uint64, np.uint8, np.uint8))

    def near(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        shape = np.broadcast_shapes(left[0].shape, right[0].shape)
        n = math.prod(shape)
        for x, y, to in zip(left, right, (bits, more)):
            np.bitwise_xor(x, y, out=differ[:n].reshape(shape))
            np.bitwise_count(differ[:n], out=to[:n])
        np.add(bits[:n], more[:n], out=bits[:n])
        at = np.flatnonzero(bits[:n] <= max_bits)
        row = at // shape[1]
        return row, at - row * shape[1]

    low, wide = 1, [np.flatnonzero(size > _WIDE)]
    while low < _WIDE:
        # Keys of one size class, the most frequent first: row r has the r-th position of each, as far as they go.
        own = np.flatnonzero((size > low) & (size <= 2 * low))
        if len(own) < low:  # too few to go through side by side
            wide.append(own)
            own = own[:0]
        for lo in range(0, len(own), _CELLS // 2):
            k = own[lo : lo + _CELLS // 2]
            k = k[np.argsort(-size[k], kind="stable")]
            start, n = first[k], size[k]
            rows = [w[start + np.minimum(np.arange(2 * low)[:, None], n - 1)] for w in words]
            upto = np.searchsorted(-n, -np.arange(2 * low)).tolist()
            for s in range(1, 2 * low):
                many = upto[s]
                step = _CELLS // s
                for c in range(0, many, step):
                    d = min(c + step, many)
                    r, at = near([w[:s, c:d] for w in rows], [w[s : s + 1, c:d] for w in rows])
                    if len(r):
                        yield start[c + at] + r, start[c + at] + s
        low *= 2
    for k in np.concatenate(wide).tolist():
        lo, hi = int(first[k]), int(first[k] + size[k])
        for c in range(lo, hi, _WIDE):  # columns, and the rows above and beside them
            d = min(c + _WIDE, hi)
            for r in range(lo, d, _CELLS // _WIDE):
                e = min(r + _CELLS // _WIDE, d)
                x, y = near([w[r:e, None] for w in words], [w[None, c:d] for w in words])
                ok = x + r < y + c
                yield x[ok] + r, y[ok] + c


def _apart(value: np.ndarray, side: np.ndarray) -> np.uint32:
    """The bits in which all values of one side differ from all of the other, as those of two upper nodes do."""
    a, b = value[side == 0], value[side != 0]
    if not len(a) or not len(b):
        return np.uint32(0)
    varied = (np.bitwise_or.reduce(a) ^ np.bitwise_and.reduce(a)) | (np.bitwise_or.reduce(b) ^ np.bitwise_and.reduce(b))
    return (a[0] ^ b[0]) & ~varied


def _covered(sig: np.ndarray, value: np.ndarray, width: int, budget: int, side: np.ndarray | None, first: int, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions that differ in at most ``budget`` bits of a block and (for certain only in the first half looked at)
    ``max_bits`` of all, each once: in the first mask of the block's cover under which both are equal. With ``side``, masks
    under which no two of different sides can be equal are left out."""
    masks = cover(width, budget)
    apart = np.uint32(0) if side is None else _apart(value, side)
    low, high = _clean(masks)
    words = [np.ascontiguousarray(sig[:, (first // 64 + k) % 4]) for k in (1, 2)]  # not the block's own, in which bits are alike
    place = np.arange(len(value), dtype=np.uint64)
    for v in range(1, len(masks)):
        if masks[v] & apart:
            continue
        both = (value & masks[v]).astype(np.uint64)
        both <<= np.uint64(32)
        both |= place
        both.sort()
        at = (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        both >>= np.uint64(32)
        own, earlier = value[at], np.uint64((1 << v) - 2)
        for x, y in _batched(_same(both.astype(np.uint32), (words[0][at], words[1][at]), max_bits)):
            d = own[x] ^ own[y]
            ok = np.flatnonzero((low[d & np.uint32(0xFFFF)] & high[d >> np.uint32(16)] & earlier) == 0)
            ok = ok[np.bitwise_count(d[ok]) <= budget]
            yield at[x[ok]], at[y[ok]]


def _by_trie(sig: np.ndarray, value: np.ndarray, width: int, budget: int, side: np.ndarray | None, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same by a join of tries."""
    order = np.argsort(value, kind="stable") if side is None else np.lexsort((value, side))
    value, words = value[order], [np.ascontiguousarray(sig[order, i]) for i in range(4)]
    leaves = trie_pairs(value, width, budget, None if side is None else int((side == 0).sum()))
    for x, y in itertools.chain.from_iterable(_near(words, *pairs, max_bits) for pairs in _batched(leaves)):
        ok = np.bitwise_count(value[x] ^ value[y]) <= budget
        yield order[x[ok]], order[y[ok]]


def matches(sig: np.ndarray, weight: np.ndarray, blocks: list[tuple[int, int, int]], k: int, max_bits: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the links that block ``k`` is the first to find: a spanning forest (pairs of positions), and for each position
    the sum of its partners' weights. With ``side`` (0 or 1) links are between the sides only."""
    first, width, budget = blocks[k]
    value = _values(sig, first, width)
    forest, links = Forest(len(sig)), np.zeros(len(sig), np.int64)
    by_cover = budget <= _COVERED and len(sig) >= _FEW
    found = _covered(sig, value, width, budget, side, first, max_bits) if by_cover else _by_trie(sig, value, width, budget, side, max_bits)

    def linked() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for x, y in found:
            ok = np.ones(len(x), bool) if side is None else side[x] != side[y]
            differ = sig[x] ^ sig[y]
            ok &= np.bitwise_count(differ).sum(axis=1, dtype=np.int16) <= max_bits
            for f, w, t in blocks[:k]:
                ok &= np.bitwise_count(_values(differ, f, w)) > t
            if ok.any():
                yield x[ok], y[ok]

    for x, y in _batched(linked(), 1 << 18):  # each batch costs a pass over all positions
        links += np.bincount(x, weight[y], len(links)).astype(np.int64) + np.bincount(y, weight[x], len(links)).astype(np.int64)
        forest.add(x, y)
    child = np.flatnonzero(forest.label != np.arange(len(sig)))
    return child, forest.label[child], links


def _joined(blocks: list[tuple[int, int, int]], max_bits: int):
    names = ["side", "node", "weight"]

    def cell(key: int, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side, node, weight = (np.concatenate([b.column(x).to_numpy() for b in batches]) for x in names)
        sig = np.concatenate([_sigs(b) for b in batches])
        batches.clear()
        x, y, links = matches(sig, weight, blocks, key >> 40, max_bits, None if side[0] == _SELF else side)
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y]), pa.array(np.zeros(len(x), np.int64))], names=["a", "b", "links"])
        yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[some]), pa.array(links[some])], names=["a", "b", "links"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by key; memory holds one cell, which is bounded.
        begin("neardup")
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            keys = batch.column("key").to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    if held and keys[lo] != at:
                        yield from cell(int(at), held)
                    at = keys[lo]
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield from cell(int(at), held)
        give_back()

    return join


def components(edges: DataFrame, made: list[DataFrame]) -> DataFrame:
    """node, root (least node of its component) for every node of ``edges`` (a, b): alternating large and small stars.

    The table that the result reads is added to ``made``.
    """
    edges = written(edges.where("a <> b").distinct(), "edges")
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: larger neighbours join the least one.
        star = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # Small star: smaller neighbours and the node itself join the least one.
        low2 = star.groupBy("b").agg(F.min("a").alias("m"))
        small = star.join(low2, "b").selectExpr("m as a", "inline(array(named_struct('b', a), named_struct('b', b)))")
        new = written(small.where("a <> b").distinct(), "edges")
        same = new.agg(F.count("*").alias("n"), F.countDistinct("b").alias("k")).first()
        roots = new.select("a").distinct().join(new.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()
        discard(edges)
        if same["n"] == same["k"] and not roots:  # every node has one parent, and parents are roots
            made.append(new)
            return new.select(F.col("b").alias("node"), F.col("a").alias("root"))
        edges = new


def classes(docs: DataFrame, *, max_bits: int = MAX_BITS, group: int = GROUP, made: list[DataFrame] | None = None) -> DataFrame:
    """doc_id, h (hash of the text), class_id and n_links, the number of other texts linked, for every row of ``docs``.

    The tables that the result reads are added to ``made``, if that is given.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    sigs = rows.mapInArrow(_fingerprints, f"doc_id {id_type}, h long, s0 long, s1 long, s2 long, s3 long")
    sigs = written(sigs.withColumn("node", F.when(F.col("s0").isNotNull(), F.xxhash64(*_SIG))), "simhash")
    # A node weighs as much as it has different texts.
    texts = sigs.where("node is not null").select("node", *_SIG, "h").distinct()
    nodes = written(texts.groupBy("node").agg(*[F.min(x).alias(x) for x in _SIG], F.count("*").alias("weight")), "nodes")
    blocks = blocks_of(nodes.count(), max_bits)
    counts = nodes.mapInArrow(_upper(blocks), "block int, top int, n long").groupBy("block", "top").agg(F.sum("n").alias("n")).toArrow()  # at most 2 ** 12 rows a block
    block, top, n = (counts.column(x).to_numpy() for x in ("block", "top", "n"))
    cells = []
    for k, (_, w, t) in enumerate(blocks):
        own = np.zeros(1 << min(w, _DEEPEST), np.int64)
        own[top[block == k]] = n[block == k]
        cells.append(cells_of(own, w, t, group))
    shared = spark.sparkContext.broadcast(cells)
    spread = nodes.mapInArrow(_spread(blocks, shared), "key long, side byte, node long, s0 long, s1 long, s2 long, s3 long, weight long")
    # Cells are few and each is work for a core: they are dealt to more tasks than there are cells, so that few tasks get two.
    size = sum(len({c for x in takes for c, _ in x}) for _, _, takes in cells)
    apart = spread.repartition(max(1, min(3 * size, 100_000)), "key").sortWithinPartitions("key")
    found = written(apart.mapInArrow(_joined(blocks, max_bits), "a long, b long, links long"), "links")
    inner = [nodes, found]
    shared.destroy()
    twins = nodes.where("weight > 1").select("node", (F.col("weight") - 1).alias("links"))
    links = found.where("a = b").select(F.col("a").alias("node"), "links").union(twins).groupBy("node").agg(F.sum("links").alias("n_links"))
    linked = links.join(components(found.where("a <> b").select("a", "b"), inner), "node", "left").select("node", "n_links", F.coalesce("root", "node").alias("root"))
    some = sigs.where("node is not null").select("doc_id", "h", "node").join(linked, "node", "left")
    some = written(some.select("doc_id", "h", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "linked")
    discard(*inner)
    if made is not None:
        made += [some, sigs]
    named = some.join(some.groupBy("root").agg(F.min("doc_id").alias("class_id")), "root").select("doc_id", "h", "class_id", "n_links")
    return named.union(sigs.where("node is null").select("doc_id", "h", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def copies(docs: DataFrame, **options) -> DataFrame:
    """doc_id, h (hash of the text), duplicate_of (the id that stays) for every document that is a later copy."""
    later = classes(docs, **options).where("class_id is not null and not (doc_id <=> class_id)")
    return later.select("doc_id", "h", F.col("class_id").alias("duplicate_of")).distinct()


def kept(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that aren't later copies, with all their columns."""
    d, h = free_name(docs, "copy_id"), free_name(docs, "copy_hash")
    made: list[DataFrame] = []
    gone = written(copies(docs, made=made, **options).select(F.col("doc_id").alias(d), F.col("h").alias(h)).distinct(), "copies")
    discard(*made)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone[d]) & (F.xxhash64(docs["text"]) == gone[h]), "left_anti")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
