"""Packing, SimHash near-dedup, language ID, quality classifier, line dedup and the pipeline."""

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from qirtas.llm import langid, linededup, neardup, packing, quality
from qirtas.llm.common import table


def read(spark, sf):
    return table(spark, sf, "documents")


# Packing


@settings(deadline=None, max_examples=30)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=9))
def test_pricing_is_the_best_pattern(values):
    n = len(values)
    best = [0.0] * (n + 1)
    for c in range(1, n + 1):
        best[c] = max([best[c - 1]] + [best[c - i - 1] + values[i] for i in range(c)])
    value, pattern = packing.price(np.array(values), n)
    assert value == pytest.approx(best[n]) and value == pytest.approx(pattern @ np.array(values)) and pattern @ np.arange(1, n + 1) <= n


@settings(deadline=None, max_examples=30)
@given(st.lists(st.integers(0, 500), min_size=4, max_size=24))
def test_plans_hold_all_and_are_near_the_bound(demand):
    demand = np.array(demand)
    n = len(demand)
    intervals, windows, bound = packing.plan(demand)
    load, seen = Counter(), [[] for _ in demand]
    for cls, lo, hi, base, per in intervals:
        seen[cls - 1].append((lo, hi))
        for r in range(hi - lo):
            load[base + r // per] += cls
    for d, s in zip(demand, seen):
        ends = sorted(s)
        assert [x for x, _ in ends] == [0, *(y for _, y in ends[:-1])][: len(ends)] and (ends[-1][1] if ends else 0) == d
    assert all(v <= n for v in load.values()) and len(load) <= windows
    assert bound - 1e-6 <= windows <= bound * (1 + 1e-3) + np.count_nonzero(demand) + 1


def test_packing_operator(spark, docs_of, awkward):
    got = packing.packed(docs_of(awkward), capacity=256, bins=64).collect()
    size = Counter()
    for r in got:
        size[r.doc_id] += r.length
    assert size == {3: 1, 4: 75_000, 5: 50_000, None: 3, 7: 8}
    for _, rows in itertools.groupby(sorted(got, key=lambda r: (r.pack_id, r.offset)), key=lambda r: r.pack_id):
        at = 0
        for r in rows:
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert len({(r.doc_id, r.piece) for r in got}) == len(got) - 1 and packing.packed(docs_of(awkward).limit(0)).count() == 0
    assert len({r.pack_id for r in got}) <= sum(size.values()) / 256 * 1.02 + 2
    with pytest.raises(ValueError):
        packing.packed(docs_of(awkward), capacity=100, bins=64)


# SimHash


def groups_of(rows, max_bits=neardup.MAX_BITS):
    """Brute force: (id, text) to the least id of its group, over all pairs of fingerprints."""
    rows = sorted({r for r in rows if r[1] is not None and r[1].split()}, key=str)
    sigs = np.array([neardup.fingerprint(t) for _, t in rows], np.uint64).reshape(-1, 4)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        near = np.bitwise_count(sigs[i + 1 :] ^ sigs[i]).sum(axis=1) <= max_bits
        for j in np.flatnonzero(near) + i + 1:
            root[find(int(j))] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return {r: least.get(find(i)) for i, r in enumerate(rows)}


def classes_of(rows):
    """Brute force: (id, text) to (least id of its class, number of other texts linked)."""
    texts = sorted({t for _, t in rows if t is not None and t.split()})
    sigs = np.array([neardup.fingerprint(t) for t in texts], np.uint64).reshape(-1, 4)
    links = [int((np.bitwise_count(sigs ^ s).sum(axis=1) <= neardup.MAX_BITS).sum()) - 1 for s in sigs]
    group, n = groups_of(rows), dict(zip(texts, links))
    return {r: (group.get(r, r[0]), n.get(r[1], 0)) for r in rows}


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 255), max_size=40), st.lists(st.integers(0, 255), max_size=40), st.integers(0, 3), st.integers(1, 3), st.booleans())
def test_the_trie_misses_no_pair(left, right, budget, leaf, apart):
    value = np.array(sorted(left) + sorted(right) if apart else sorted(left + right), np.uint32)
    n, cut = len(value), len(left)
    leaves = neardup.trie_pairs(value, 8, budget, cut if apart else None, leaf)
    got = [(i, j) for pairs in leaves for a, b, c, d in zip(*(x.tolist() for x in pairs)) for i in range(a, b) for j in range(c, d) if a != c or i < j]
    want = {(i, j) for i, j in itertools.combinations(range(n), 2) if int(value[i] ^ value[j]).bit_count() <= budget and (not apart or i < cut <= j)}
    assert len(got) == len(set(got)) and want <= set(got)


@pytest.mark.parametrize("n", [1, 2, 300, 10**6, 10**9, 10**12])
@pytest.mark.parametrize("max_bits", [0, 3, 23, 44])
def test_blocks_cover_the_budget(n, max_bits):
    blocks = neardup.blocks_of(n, max_bits)
    # Were all blocks over their budgets, more than max_bits bits would differ.
    assert sum(t + 1 for *_, t in blocks) == max_bits + 1 and all(t >= 0 and 0 < w <= 32 for _, w, t in blocks)
    assert all(a + w <= b for (a, w, _), (b, *_) in zip(blocks, blocks[1:])) and blocks[-1][0] + blocks[-1][1] <= neardup.BITS


def test_near_copies_against_all_pairs(spark, sf):
    rows = [(r.doc_id, r.text) for r in read(spark, sf).collect()]
    want = {(d, *c) for (d, _), c in classes_of(rows).items()}
    got = [tuple(r) for r in neardup.op4_simhash(spark, sf).select("doc_id", "class_id", "n_links").collect()]
    assert len(got) == len(rows) and set(got) == want and any(n for *_, n in want)


@pytest.mark.parametrize("group", [16, 40, 1000])
def test_no_near_copy_is_missed_at_any_distance(group):
    """With pairs at every distance, and a third of all fingerprints that share a block; nodes split as far as a hash."""
    rng = np.random.default_rng(3)
    for distance in (1, 20, 33, 36, 40, 44, 45):
        sig = rng.integers(0, 2, (300, neardup.BITS), dtype=np.uint8)
        sig[::3, :40] = 1
        for i in range(0, 300, 2):
            sig[i + 1] = sig[i]
            sig[i + 1, rng.permutation(neardup.BITS)[:distance]] ^= 1
        sig = np.packbits(sig, axis=1).view(np.uint64)
        blocks = neardup.blocks_of(len(sig), neardup.MAX_BITS)
        weight = rng.integers(1, 4, 300)
        names = ["node", *neardup._SIG, "weight"]
        batch = pa.RecordBatch.from_arrays([pa.array(np.arange(300)), *(pa.array(sig[:, k].view(np.int64)) for k in range(4)), pa.array(weight)], names=names)
        counts = pa.Table.from_batches(neardup._upper(blocks)([batch])).to_pylist()
        cells = []
        for k, (_, w, t) in enumerate(blocks):
            own = np.zeros(1 << min(w, neardup._DEEPEST), np.int64)
            for r in counts:
                if r["block"] == k:
                    own[r["top"]] = r["n"]
            cells.append(neardup.cells_of(own, w, t, group))

        class Shared:
            value = cells

        spread = pa.Table.from_batches(neardup._spread(blocks, Shared)([batch])).sort_by("key").to_batches()
        found = pa.concat_tables([pa.Table.from_batches([b]) for b in neardup._joined(blocks, neardup.MAX_BITS)(spread)]).to_pylist()
        near = np.bitwise_count(sig[:, None] ^ sig[None]).sum(axis=2) <= neardup.MAX_BITS
        np.fill_diagonal(near, False)
        assert near.sum() == (300 if distance <= 44 else 0)
        assert {tuple(sorted((r["a"], r["b"]))) for r in found if r["a"] != r["b"]} == {(i, int(j)) for i in range(300) for j in np.flatnonzero(near[i]) if i < j}
        links = Counter()
        for r in found:
            links[r["a"]] += r["links"]
        assert all(links[i] == weight[near[i]].sum() for i in range(300)), distance


@pytest.mark.parametrize(("width", "budget"), [(32, 5), (32, 4), (31, 5), (7, 2), (9, 0), (1, 0)])
def test_a_cover_has_a_mask_without_any_of_the_bits(width, budget):
    masks = neardup.cover(width, budget)
    low, high = neardup._clean(masks)
    for bits in itertools.islice(itertools.combinations(range(width), min(budget, width)), 0, 20_000):
        d = sum(1 << b for b in bits)
        clean = [v for v, m in enumerate(masks.tolist()) if not m & d]
        assert len(clean) > 1 and int(low[d & 0xFFFF] & high[d >> 16]) % (1 << len(masks)) == sum(1 << v for v in clean)
    assert all(int(m).bit_count() >= 16 for m in masks[1:]) or width < 32


@pytest.mark.parametrize("apart", [False, True])
def test_a_cover_finds_each_link_once(apart, monkeypatch):
    """With near copies at every distance, large classes, and values that very many share; compared with all pairs."""
    monkeypatch.setattr(neardup, "_FEW", 0)
    rng = np.random.default_rng(4)
    sig = rng.integers(0, 2, (1500, neardup.BITS), dtype=np.uint8)
    sig[::3, 32:64] = 1  # a third share a block
    for i in range(900):
        sig[i] = sig[i // 300 * 300]
        sig[i, rng.permutation(neardup.BITS)[: i % 46]] ^= 1
    sig = np.packbits(sig[rng.permutation(1500)], axis=1).view(np.uint64)
    weight, side = rng.integers(1, 4, 1500), rng.integers(0, 2, 1500).astype(np.int8) if apart else None
    near = np.bitwise_count(sig[:, None] ^ sig[None]).sum(axis=2) <= neardup.MAX_BITS
    np.fill_diagonal(near, False)
    if apart:
        near &= side[:, None] != side[None]
    blocks = neardup.blocks_of(1500, neardup.MAX_BITS)
    parts = [neardup.matches(sig, weight, blocks, k, neardup.MAX_BITS, side) for k in range(len(blocks))]
    assert (sum(links for *_, links in parts) == near @ weight).all() and near.sum() > 50_000
    got, want = neardup.Forest(1500), neardup.Forest(1500)
    for x, y, _ in parts:
        got.add(x, y)
    want.add(*np.nonzero(near))
    assert (got.label == want.label).all()


def test_few_of_all_pairs_are_compared(monkeypatch):
    """Of random fingerprints a block's join compares its share of all pairs, which for all blocks is 0.6 % (tries: 3 % and more)."""
    rng = np.random.default_rng(5)
    sig = rng.integers(0, 2**63, (20_000, 4)).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, (20_000, 4)).astype(np.uint64)
    seen = []

    def counted(a, b, out=None, real=np.bitwise_xor):
        seen.append(max(a.size, b.size, np.broadcast(a, b).size))
        return real(a, b, out=out)

    monkeypatch.setattr(neardup.np, "bitwise_xor", counted)
    blocks = neardup.blocks_of(len(sig), neardup.MAX_BITS)
    for k in range(len(blocks)):
        neardup.matches(sig, np.ones(len(sig), np.int64), blocks, k, neardup.MAX_BITS)
    assert sum(seen) / 2 < 0.01 * len(sig) ** 2 / 2  # two words of each pair


@pytest.mark.parametrize(("bits", "share"), [((31,), 0.6), ((31, 30), 0.35)])
def test_nodes_are_compared_under_masks_that_they_can_share(bits, share, monkeypatch):
    """Two upper nodes that differ in some bits: under a mask with one of these only pairs within a node would meet."""
    rng = np.random.default_rng(6)
    sig = rng.integers(0, 2, (20_000, neardup.BITS), dtype=np.uint8)
    side = np.repeat([0, 1], 10_000).astype(np.int8)
    for i in range(1000):
        sig[i + 10_000] = sig[i]
        sig[i + 10_000, rng.permutation(neardup.BITS)[: i % 46]] ^= 1
    sig = np.packbits(sig, axis=1, bitorder="little").view(np.uint64)
    for b in bits:
        sig[:, 0] = sig[:, 0] & ~np.uint64(1 << b) | side.astype(np.uint64) << np.uint64(b)
    near = np.array([(np.bitwise_count(s ^ sig[10_000:]).sum(axis=1) <= neardup.MAX_BITS) for s in sig[:10_000]])
    seen = []

    def counted(a, b, out=None, real=np.bitwise_xor):
        seen.append(np.broadcast(a, b).size)
        return real(a, b, out=out)

    blocks = neardup.blocks_of(len(sig), neardup.MAX_BITS)
    one = np.ones(len(sig), np.int64)
    links = sum(neardup.matches(sig, one, blocks, k, neardup.MAX_BITS, side)[2] for k in range(len(blocks)))
    assert (links == np.r_[near.sum(axis=1), near.sum(axis=0)]).all() and near.sum() > 900
    monkeypatch.setattr(neardup.np, "bitwise_xor", counted)
    compared = []
    for s in (None, side):
        seen.clear()
        neardup.matches(sig, one, blocks, 0, neardup.MAX_BITS, s)
        compared.append(sum(seen))
    assert compared[1] < share * compared[0]


def test_near_dedup_awkward(spark, docs_of, awkward):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [*awkward, (20, base), (21, base + " more"), (22, base), (None, base), (23, " ".join(f"v{i}" for i in range(300)))]
    kept = neardup.kept(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 5, None, 7, 7, 8, 20, 23])
    assert neardup.copies(docs_of(rows).limit(0)).count() == 0
    many = docs_of([(i, base + f" x{i % 3}") for i in range(2500)])
    assert neardup.copies(many).count() == 2499
    got = neardup.classes(docs_of(rows)).select("doc_id", "class_id", "n_links").collect()
    assert Counter(map(tuple, got)) == Counter({(d, *classes_of([(d, t)])[d, t]): 1 for d, t, *_ in awkward} | {(7, 7, 0): 2, (8, 8, 0): 1, (20, 20, 1): 1, (21, 20, 1): 1, (22, 20, 1): 1, (None, 20, 1): 1, (None, None, 0): 1, (23, 23, 0): 1})
    few = {tuple(r) for r in neardup.classes(many).select("class_id", "n_links").distinct().collect()}
    assert few == {(0, 2)} and neardup.classes(docs_of(rows).limit(0)).count() == 0


# Language ID


def test_probabilities_sum_to_one():
    def counts(words):
        grams, _ = langid.grams_of(words)
        rows, n = np.unique(grams, axis=0, return_counts=True)
        return rows, n

    model = langid.build({"a": counts(["banana", "bandana", "nab"]), "b": counts(["zorro", "orzo"])})
    for word in ("", "ba", "zo", "qq"):
        total = np.zeros(2)
        for c in [*map(int, model.alphabet), 0x1F600]:
            # The last character of a word is scored before its end mark.
            whole, _ = model.bits([word + chr(c)]) if c != langid._END else model.bits([word])
            grams, size = langid.grams_of([word + chr(c)] if c != langid._END else [word])
            parts = np.array([model_bits(model, g) for g in grams])
            total += 2.0 ** -parts[len(word)]
            assert whole[0] == pytest.approx(parts.sum(axis=0), rel=1e-3)
        assert total == pytest.approx(np.ones(2), abs=1e-3), word


def model_bits(model, gram):
    """Bits of one n-gram in each language, by looking up each order in turn."""
    last = gram[-1]
    at = np.flatnonzero(model.alphabet == last)
    p = model.unigram[at[0] if len(at) else len(model.alphabet)].astype(float)
    for n, (hashes, alpha), (seen, gamma) in zip(range(2, langid.ORDER + 1), model.grams, model.contexts):
        ctx = langid._hash(gram[None, langid.ORDER - n : langid.ORDER - 1])
        c = np.flatnonzero(seen == ctx[0])
        f = np.flatnonzero(hashes == langid._mix(ctx ^ np.uint64(n), np.array([last]))[0])
        p = p * (gamma[c[0]] if len(c) else 1) + (alpha[f[0]] if len(f) else 0)
    return -np.log2(p)


def kneser_ney(words):
    """Brute force: a function from (context, character) to its probability, from a list of words; plain dictionaries only."""
    pad = chr(langid._START) * (langid.ORDER - 1)
    counts = {langid.ORDER: Counter()}
    for w in words:
        x = pad + w + chr(langid._END)
        counts[langid.ORDER].update(x[i : i + langid.ORDER] for i in range(len(x) - langid.ORDER + 1))
    for n in range(langid.ORDER - 1, 0, -1):  # how many different characters stand before
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def discount(n):
        one, two = (sum(c == k for c in counts[n].values()) for k in (1, 2))
        return min(max(one / (one + 2 * two), 0.1), 0.95) if one and two else 0.5

    def p(context, c, alphabet):
        total = sum(counts[1].values())
        out = max(counts[1][c] - 0.75, 0) / total + 0.75 * len(counts[1]) / total / (len(alphabet) + 1)
        for n in range(2, langid.ORDER + 1):
            h = context[len(context) - n + 1 :]
            after = [v for g, v in counts[n].items() if g[:-1] == h]
            if after:
                d = discount(n)
                out = max(counts[n][h + c] - d, 0) / sum(after) + d * len(after) / sum(after) * out
        return out

    return p, set(counts[1])


def test_models_against_brute_force(spark, docs_of):
    """Counts over partitions, continuation counts, discounts and interpolation, by independent code."""
    texts = {"en": ["The cat sat on the mat and the dog", "a cat and a rat sat", "that hat"], "fr": ["le chat est sur le tapis et le chien", "un chat et un rat", "ce chapeau le chat"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((k, t) for k, v in texts.items() for t in v)]
    model = langid.train(docs_of(rows).repartition(3)).model
    brute = {lang: kneser_ney(" ".join(v).lower().split()) for lang, v in texts.items()}
    alphabet = set().union(*(a for _, a in brute.values()))
    assert model.langs == ["en", "fr"] and set(map(chr, model.alphabet.tolist())) == alphabet
    for word in ["the", "chat", "cat", "unseen", "z", "", "émat", "tapis"]:
        bits, size = model.bits([word])
        x = chr(langid._START) * 3 + word + chr(langid._END)
        for k, lang in enumerate(model.langs):
            want = -sum(np.log2(brute[lang][0](x[i : i + 3], x[i + 3], alphabet)) for i in range(len(word) + 1))
            assert bits[0, k] == pytest.approx(want, rel=1e-5), (word, lang)
        assert size[0] == len(word) + 1


def test_characters_are_looked_up_at_once(monkeypatch):
    """Counts and entropies of whole texts equal those of their words; n-grams that the model has seen don't go through all orders."""
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9))) for _ in range(400)) for _ in range(60)]
    odd = ["Ein \x02Wort\x03 mehr", "Stra\u00dfe\u0130x\u3000\u6f22\u5b57\x0b\u6f22", "", None, " \n ", "y" * 5000, "a", "".join(map(chr, range(0x10000, 0x21000)))]
    by_word: Counter = Counter()
    for t in texts + odd:
        by_word.update(map(tuple, langid.grams_of((t or "").lower().split())[0].tolist() if t and t.split() else []))
    columns, size = langid.columns_of(texts + odd)
    assert Counter(zip(*(c.tolist() for c in columns))) == by_word and size.tolist() == [sum(len(w) + 1 for w in (t or "").lower().split()) for t in texts + odd]
    for some in (columns, [c[: int(size[:60].sum())] for c in columns]):  # with more characters than 16 bits number, and fewer
        keys, n = langid.counted(some)
        got = {(int(a) >> 32, int(a) & 0xFFFFFFFF, int(b) >> 32, int(b) & 0xFFFFFFFF): int(c) for (a, b), c in zip(keys.tolist(), n)}
        assert got == Counter(zip(*(c.tolist() for c in some))) and len(got) == len(keys)

    def counts(words):
        rows, n = np.unique(langid.grams_of(words)[0], axis=0, return_counts=True)
        return rows, n

    model = langid.build({"a": counts(" ".join(texts[:50]).split()), "b": counts(["bad", "face", "cafe"])})
    e, chars = langid.entropies(model, texts + odd)
    for t, own, c in zip(texts + odd, e, chars):
        bits, n = model.bits((t or "").lower().split() or [""])
        if t and t.split():
            assert own == pytest.approx(bits.sum(axis=0) / n.sum(), rel=1e-5) and c == n.sum()
        else:
            assert np.isnan(own).all() and c == 0
    rows = np.arange(len(texts + odd)) % 2
    assert np.array_equal(langid.entropies(model, texts + odd, rows)[0][:, 0], e[np.arange(len(e)), rows], equal_nan=True)
    hashed = []
    monkeypatch.setattr(langid, "_hash", lambda g, real=langid._hash: (hashed.append(len(g)), real(g))[1])
    langid.entropies(model, texts)
    assert sum(hashed) < 0.05 * chars[:60].sum()


def test_languages_that_tie(spark, docs_of):
    rows = [(i, "same words here", lang) for i, lang in enumerate(("b", "a", "b", "a"))]
    got = langid.identify(docs_of(rows)).collect()
    assert {r.detected for r in got} == {"a"} and len({r.cross_entropy for r in got}) == 1 and all(r.accepted for r in got)


def test_language_accuracy_and_rejection(spark):
    """Accuracy on documents whose texts the model never saw."""
    docs = read(spark, "/root/testdata/sf0.1")
    train = docs.where("pmod(xxhash64(text), 4) <> 0")
    truth = {r.doc_id: (r.lang, r.text) for r in docs.where("pmod(xxhash64(text), 4) = 0").collect()}
    who = langid.train(train)
    held = [(lang, text) for lang, text in truth.values() if lang and text.split()]
    detected, _, accepted = who.judge([t for _, t in held])
    right = [d == lang for d, (lang, _) in zip(detected, held)]
    assert len(held) > 1000 and sum(right) / len(right) > 0.97 and np.mean(accepted) > 0.97
    rng = random.Random(1)
    noise = [" ".join("".join(rng.choice("qxzjkwvq#%~") for _ in range(rng.randint(3, 9))) for _ in range(60)) for _ in range(40)]
    assert sum(who.judge(noise)[2]) <= 2
    some = docs.limit(50)
    assert langid.identify(some).count() == 50


def test_a_length_class_with_one_row_limits_no_other():
    # One short row of low entropy, forty long ones above it; a class between and one beyond have no rows.
    m = np.r_[4, np.full(40, 6), np.full(40, 7)]
    e = np.r_[1.8, np.linspace(2.2, 2.6, 40), np.linspace(2.1, 2.5, 40)]
    limits = langid.limits_of(np.zeros(81, int), m, e, 1, langid.QUANTILE, langid.MARGIN)[0]
    assert limits[6] == pytest.approx(2.6 + langid.MARGIN) and limits[7] == pytest.approx(2.5 + langid.MARGIN)
    assert limits[4] == limits[5] == limits[6] and limits[8] == limits[12] == limits[7] and limits[3] == limits[4] + langid.EASE


def test_counts_and_limits_come_from_all_labelled_rows(spark, docs_of):
    """The model has every labelled text's n-grams, and each text has its part in the limits, by a model without it."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["house", "river", "stone", "green", "cloud"]) for _ in range(8)) + f" {i}", "en") for i in range(300)]
    plain = langid.train(docs_of(rows))
    for odd in range(0, 300, 60):  # wherever its hash puts it
        own = "\u0416\u0429\u042e" * 12 + f" {odd}"
        who = langid.train(docs_of([*rows[:odd], (odd, own, "en"), *rows[odd + 1 :]]))
        assert set("\u0436\u0449\u044e") <= set(map(chr, who.model.alphabet.tolist()))
        assert who.limits.max() > plain.limits.max() + 1


@pytest.mark.parametrize("n", [1, 19, 400, 5000])
def test_limits_from_the_greatest_values(n):
    rng = np.random.default_rng(n)
    k, m, e = rng.integers(0, 2, n), rng.choice([3, 4, 7, 8], n, p=[0.01, 0.2, 0.29, 0.5]), rng.normal(3, 1, n)
    sizes = np.bincount(k * 13 + m, minlength=26).reshape(2, 13)
    keep = np.concatenate([own[np.argsort(-e[own])][: langid.tail_of(int(sizes.sum(axis=1).max()), 0.99)] for own in (np.flatnonzero((k == x) & (m == c)) for x in (0, 1) for c in range(13))])
    got = langid.limits_from(sizes, k[keep], m[keep], e[keep], 0.99, 0.5)
    assert (got == langid.limits_of(k, m, e, 2, 0.99, 0.5)).all()
    for x, c in zip(*np.nonzero(sizes >= 100)):
        assert got[x, c] == pytest.approx(np.quantile(e[(k == x) & (m == c)], 0.99) + 0.5)


def test_language_awkward(spark, docs_of, awkward):
    docs = docs_of([*awkward, *((100 + i, f"these are english words number {i}", "en") for i in range(30)), *((200 + i, f"dies sind deutsche wörter nummer {i}", "de") for i in range(30))])
    got = langid.identify(docs).collect()
    none = [r for r in got if r.doc_id in (1, 2, 3, 8)]
    assert len(got) == len(awkward) + 60 and all(r.detected is None and r.cross_entropy is None and not r.accepted for r in none)
    assert {r.detected for r in got if (r.doc_id or 0) >= 200} == {"de"} and langid.kept(docs).columns == docs.columns
    blank = docs_of([(1, "some words", None), (2, "", None)])
    assert [(r.doc_id, r.detected) for r in langid.identify(blank).where("accepted").collect()] == [(1, None)] and langid.identify(docs.limit(0)).count() == 0


# Quality


@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 3)), min_size=1, max_size=7))
def test_isotonic_is_the_least_squares_fit(rows):
    y, w = (np.array(v, float) for v in zip(*rows))
    fit = quality.isotonic(np.arange(len(y)), y, w)
    # The minimax formula.
    want = [max(min(np.average(y[i : j + 1], weights=w[i : j + 1]) for j in range(k, len(y))) for i in range(k + 1)) for k in range(len(y))]
    assert fit == pytest.approx(want)


def test_quality_weights_solve_the_ridge_equations(spark, sf):
    docs, labels = read(spark, sf), table(spark, sf, "labels")
    model = quality.fit(docs, labels, features=32)
    rows = docs.join(quality.labelled(labels, 0), "doc_id").select("text", "y", "h").collect()
    x = quality.statistics([r.text for r in rows])
    ok = ~np.isnan(x[:, -1])
    held = np.abs(np.array([r.h for r in rows]) >> 7) % 5 == 0
    z, y = model.features(x[ok & ~held]), np.array([r.y for r in rows])[ok & ~held]
    reg = np.full(33, quality.RIDGE * len(y))
    reg[-1] = 1e-9
    assert model.weights == pytest.approx(np.linalg.solve(z.T @ z + np.diag(reg), z.T @ y), abs=1e-5)


def test_quality_on_held_out_labels(spark):
    docs, labels = read(spark, "/root/testdata/sf0.1"), table(spark, "/root/testdata/sf0.1", "labels")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    fit, test = (labels.where(f"pmod(hash(doc_id), 4) {op} 0") for op in ("<>", "="))
    left = {r.doc_id for r in test.collect()}
    got = [r for r in quality.classify(docs, fit).collect() if r.doc_id in left and r.score is not None]
    right = [r.keep == bool(truth[r.doc_id]) for r in got]
    base = max(np.mean([truth[r.doc_id] for r in got]), 1 - np.mean([truth[r.doc_id] for r in got]))
    assert np.mean(right) > max(0.85, base), (np.mean(right), base)


def test_quality_awkward(spark, docs_of, awkward):
    labels = spark.createDataFrame([(7, 1), (7, 0), (None, 1), (4, None)], "doc_id long, quality int")
    docs = docs_of(awkward)
    got = {r.doc_id: r for r in quality.classify(docs, labels.limit(0)).collect()}
    assert [got[k].keep for k in (1, 2, 3, 4, 5, None, 7, 8)] == [False, False, False, True, True, True, True, False] and got[7].score is None
    assert quality.kept(docs, labels).columns == docs.columns and quality.classify(docs.limit(0), labels).count() == 0


# Line dedup


def lines_left(rows, min_words):
    """Brute force for documents without repeats inside: every run of lines that stood in an earlier one goes."""
    seen, out = set(), {}
    for doc, text in rows:
        lines = text.split("\n")
        at = [i for i, x in enumerate(lines) if x.split()]
        gone, own = set(), set()
        for s in range(len(at)):
            for e in range(s, len(at)):
                run = tuple(lines[i].strip() for i in at[s : e + 1])
                if sum(len(x.split()) for x in run) >= min_words:
                    own.add(run)
                    if run in seen:
                        gone.update(range(at[s], at[e] + 1))
        seen |= own
        out[doc] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_line_dedup_against_all_runs(spark, docs_of):
    rng = random.Random(8)
    pool = [f"line {i} " + "w " * rng.randint(0, 3) for i in range(40)]
    rows = []
    for d in range(60):
        start = rng.randint(0, 30)
        lines = pool[start : start + rng.randint(1, 9)] if rng.random() < 0.7 else rng.sample(pool, rng.randint(1, 8))
        rows.append((d, "\n".join(x for y in lines for x in ([y, " "] if rng.random() < 0.2 else [y]))))
    docs = docs_of(rows)
    got = linededup.deduped(docs, 12)
    assert got.columns == docs.columns
    want = lines_left(rows, 12)
    res = {r.doc_id: r for r in got.collect()}
    assert {k: r.text for k, r in res.items()} == want and want != dict(rows)
    assert all(r.n_chars == len(r.text) for r in res.values())


def test_word_hashes_go_by_content():
    """Hashes of words wherever they stand, with no Python step for each; words of any length, and numbers that share upper bits."""
    rng = random.Random(5)
    words = ["a", "b", "ab", "ba", "\u0639\u0631\u0628", "\u00e9" * 32, "x" * 64, "x" * 65, "x" * 66, "x" * 64 + "y", "x" * 5000, "w\x02"]
    words += ["".join(rng.choice("abc") for _ in range(rng.randint(1, 90))) for _ in range(20_000)]
    texts = [rng.sample(words, 3000) for _ in range(4)] + [[], words]
    hashes = linededup.word_hashes(texts)
    of = {}
    for w, h in zip(itertools.chain.from_iterable(texts), hashes.tolist(), strict=True):
        assert of.setdefault(w, h) == h
    assert len(set(of.values())) == len(of) == len(set(words)) and len(linededup.word_hashes([[]])) == 0
    key = np.random.default_rng(6).integers(0, 50, 5000) - 20  # none differ in their upper bits
    for k in (key, key << 50, key[:1], key[:0]):
        order = linededup._together(k)
        assert sorted(order.tolist()) == list(range(len(k)))
        runs = [[*g] for _, g in itertools.groupby(order.tolist(), key=k.__getitem__)]
        assert len(runs) == len(set(k.tolist())) and all(g == sorted(g) for g in runs)
    odd = pa.array([None, [], [{"s": 0, "e": 1}], [{"s": 1, "e": 1}], None], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))
    text = pa.array(["skip", None, "a\nb", "one two three", "one two", "x"])
    for lo in (0, 2):
        want = [(None, 0, 0), ("a\nb", 2, 0), ("three", 1, 0), ("one", 1, 0), ("x", 1, 0)][lo:]
        got = linededup._without(text.slice(lo + 1), odd.slice(lo)).to_pylist()
        assert [tuple(r.values()) for r in got] == want
    assert len(linededup._without(text[:0], odd[:0])) == 0


def test_line_dedup_awkward(spark, docs_of, awkward):
    run = "\n".join(f"this is line {i} of a long passage" for i in range(10))
    rows = [*awkward, (30, run), (31, "before\n" + run + "\n\nafter"), (32, run + "\nbetween\n" + run), (33, run), (None, run)]
    got = {}
    for r in linededup.deduped(docs_of(rows), counts=True).collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert run in got[None] and got[30] == [""] and got[31] == ["before\n\nafter"] and got[32] == ["between"] and got[33] == [""]
    assert got[1] == [None] and got[2] == [""] and got[4] == ["word " * 60_000] and got[7] == ["twice the same"] * 2
    twice = linededup.deduped(docs_of([(1, run + "\nx\n" + run)])).first()
    assert twice.text == run + "\nx" and linededup.deduped(docs_of(rows).limit(0)).count() == 0
    same = linededup.deduped(docs_of([(1, run), (1, run), (2, run)])).collect()
    assert sorted((r.doc_id, r.text) for r in same) == [(1, run), (1, run), (2, "")]
    assert {r.doc_id for r in linededup.deduped(docs_of([(1, run), (2, run)]), drop_emptied=True).collect()} == {1}


def words_left(rows, min_words):
    """Brute force by words: every word of a run of ``min_words`` words that stands in an earlier document goes."""
    seen, out = set(), {}
    for doc, text in rows:
        words = text.split()
        own = [tuple(words[i : i + min_words]) for i in range(len(words) - min_words + 1)]
        gone = {j for i, w in enumerate(own) if w in seen for j in range(i, i + min_words)}
        seen |= set(own)
        out[doc] = [w for j, w in enumerate(words) if j not in gone]
    return out


def test_line_dedup_inside_and_across_lines(spark, docs_of):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = [(0, "before on the line " + " ".join(passage) + " and after"), (1, "other words " + " ".join(passage) + " follow\nlast line")]
    rows += [(2, "intro " + " ".join(passage[:25]) + "\n" + " ".join(passage[25:55]) + " end"), (3, "x " + " ".join(passage[:49]) + " y")]
    for d in range(4, 40):
        words = [f"{d}w{i}" for i in range(rng.randint(0, 40))]
        a = rng.randint(0, 20)
        words += passage[a : a + rng.randint(20, 60)] + [f"{d}v{i}" for i in range(rng.randint(0, 40))]
        rows.append((d, "".join(w + rng.choice(" \n" if rng.random() < 0.1 else " ") for w in words)))
    got = {r.doc_id: r.text for r in linededup.deduped(docs_of(rows)).collect()}
    assert got[0] == rows[0][1] and got[1] == "other words follow\nlast line" and got[2] == "intro\nend" and got[3] == rows[3][1]
    assert {k: t.split() for k, t in got.items()} == words_left(rows, 50)
    # A passage again further on in its own line, and a line that only repeats itself.
    own = " ".join(passage) + " between " + " ".join(passage) + " end"
    left = {r.doc_id: r.text for r in linededup.deduped(docs_of([(1, own), (2, "a b c " * 100), (3, "d e f " * 100 + "\n" + "d e f " * 100)])).collect()}
    assert left == {1: " ".join(passage) + " between end", 2: "a b c " * 100, 3: "d e f " * 100}


@pytest.mark.parametrize("at_once", [1, 7, 1000])
def test_line_dedup_in_batches_of_any_size(spark, docs_of, at_once):
    """What a batch finds in itself and what batches find in each other add up to the same."""
    rng = random.Random(at_once)
    passages = [[f"{k}p{i}" for i in range(70)] for k in range(4)]
    rows = []
    for d in range(80):
        words = []
        for _ in range(rng.randint(0, 3)):
            p, a = rng.choice(passages), rng.randint(0, 30)
            words += [f"{d}x{rng.randint(0, 9**9)}"] + p[a : a + rng.randint(5, 70)]
        rows.append((d, " ".join(words)))
    rows += [(100 + i, rows[i][1]) for i in range(0, 80, 3)] + [(200, None), (201, "")]
    keep = [r for r in rows if r[1] and len(set(own := [tuple(r[1].split()[i : i + 20]) for i in range(len(r[1].split()) - 19)])) == len(own)]
    assert len(keep) > 20
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", at_once)
    try:
        got = {r.doc_id: (r.text or "").split() for r in linededup.deduped(docs_of(keep).repartition(4), 20).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == words_left(keep, 20)


# Pipeline


def test_pipeline_against_brute_force(spark, sf):
    docs = read(spark, sf)
    at = docs
    left = []
    for name, stage in corpus_pipeline.STAGES:
        at = corpus_pipeline.written(stage(spark, at, sf), name)
        left.append(at)
        if name != "packing":
            assert at.columns == docs.columns
    rows = [{r.doc_id: r.text for r in x.collect()} for x in left[:4]]
    first = {r.doc_id: r.text for r in docs.collect()}
    assert all(first[k] == v for k, v in rows[0].items()) and all(rows[0][k] == v for k, v in rows[1].items())
    # Line dedup: what stands earlier went, and nothing else.
    seen, exact = set(), 0
    for k in sorted(rows[1]):
        words, n = rows[1][k].split(), linededup.MIN_WORDS
        own = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        gone = {j for i, w in enumerate(own) if w in seen for j in range(i, i + n)}
        stay, after = [w for j, w in enumerate(words) if j not in gone], rows[2].get(k, "").split()
        if len(set(own)) == len(own):
            assert stay == after
            exact += bool(gone)
        else:  # repeats inside go too
            assert not Counter(after) - Counter(stay)
        seen |= set(own)
    assert exact
    groups = groups_of(rows[2].items())
    keep = {k for k in rows[2] if groups.get((k, rows[2][k]), k) == k}
    assert set(rows[3]) == keep
    size = Counter()
    for r in left[4].collect():
        size[r.doc_id] += r.length
    assert size == {k: -(-len(t.encode()) // 4) for k, t in rows[3].items()}
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "piece", "length").collect()} == {tuple(r) for r in left[4].select("doc_id", "piece", "length").collect()}
