import os
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from qirtas.llm import spm

PATH = os.path.join(spm.TOKENIZERS, spm.MODEL)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary file")


@pytest.fixture(scope="module")
def own():
    return spm.vocabulary(PATH)


@pytest.fixture(scope="module")
def public():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


ALPHABET = "aeioustnhr  ▁Th\n\té½梦日本語🙂ﬁ  ا0123.,"


@given(st.one_of(st.text(max_size=60), st.text(alphabet=ALPHABET, max_size=80)))
def test_same_ids_and_text_as_the_public_library(own, public, text):
    text = text.encode("utf-8", "replace").decode()
    ids = own.encode([text])[0]
    assert ids.tolist() == public.encode(text)
    assert own.decode(ids) == public.decode(ids.tolist())


def test_long_runs(own, public):
    for text in ("a" * 5000, " " * 700, "the" * 900, "🙂" * 300, "word " * 3000, "=" * 999):
        assert own.encode([text])[0].tolist() == public.encode(text)


def test_backtracking_equals_merging():
    rng = random.Random(5)
    for trial in range(60):
        chars = "abc"
        pieces = {"".join(rng.choice(chars) for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(2, 14))}
        pieces = [*chars, *sorted(pieces)]
        v = spm.Vocabulary(["<unk>", *pieces], __import__("numpy").array([0, *(-rng.random() for _ in pieces)]), [2] + [1] * len(pieces), byte_fallback=False)
        for _ in range(60):
            w = "".join(rng.choice(chars) for _ in range(rng.randint(1, 14)))
            assert v.split(w) == v.merge(w), (pieces, w)


def test_unknown_without_byte_fallback():
    np = __import__("numpy")
    v = spm.Vocabulary(["<unk>", "a", "▁"], np.array([0.0, -1, -2]), [2, 1, 1], byte_fallback=False)
    assert v.encode(["azza"])[0].tolist() == [2, 1, 0, 1] and v.decode(np.array([1, 0])) == "a ⁇ "
    with pytest.raises(ValueError):
        spm.Vocabulary(["<unk>", "a▁b"], np.array([0.0, -1]), [2, 1])


def test_operator(spark, docs_of, awkward, public, sf):
    got = spm.encoded(docs_of(awkward)).collect()
    texts = sorted((r[0] or 0, r[1] or "") for r in awkward)
    assert sorted((r.doc_id or 0, r.decoded or "") for r in got) == texts
    assert {r.doc_id for r in got if r.ids is None} == {1, 8} and [r.ids for r in got if r.doc_id == 2] == [[]]
    assert spm.encoded(docs_of(awkward).limit(0)).count() == 0
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in spm.op2_sentencepiece(spark, sf).collect():
        assert r.decoded == docs[r.doc_id] and r.ids == public.encode(docs[r.doc_id])
