import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stagelight.llm import pieces as P
from stagelight.llm.queries import PIECES

from .helpers import odd_rows, prose

pytestmark = pytest.mark.skipif(not os.path.exists(PIECES), reason="no vocabulary file")


@pytest.fixture(scope="module")
def v():
    return P.load(PIECES)


@pytest.fixture(scope="module")
def library():
    """The library's lattice over the same pieces and scores, with the model's type set to unigram."""
    sp = pytest.importorskip("sentencepiece")
    with open(PIECES, "rb") as f:
        raw = f.read()
    at = raw.index(b"\x12\x06tok_v0\x18\x02")
    return sp.SentencePieceProcessor(model_proto=raw[:at] + raw[at:].replace(b"\x18\x02", b"\x18\x01", 1))


@pytest.fixture(scope="module")
def ids_of(v):
    return {v.pieces[i].replace(b" ", bytes([P.BLANK])): i for i in v.of_key.tolist()}


def plain(text, v, ids):
    """Viterbi over one text, character by character."""
    s = P.marked(text.encode())
    best, back = [0.0] + [-1e18] * len(s), [None] * (len(s) + 1)
    for a in range(len(s)):
        if best[a] == -1e18:
            continue
        n = 1 if s[a] < 0x80 or s[a] >= 0xF8 else 2 if s[a] < 0xE0 else 3 if s[a] < 0xF0 else 4
        for z in range(a + 1, min(len(s), a + 26) + 1):
            i = ids.get(s[a:z])
            score = v.scores[i] if i is not None else v.unknown if z - a == n else None
            if score is not None and best[a] + score > best[z]:
                best[z], back[z] = best[a] + score, (a, i)
    out, z = [], len(s)
    while z:
        a, i = back[z]
        out[:0] = [i] if i is not None else [int(v.byte_id[c]) for b in s[a:z] for c in (P.META if b == P.MARK else bytes([b]))]
        z = a
    return out


def test_equals_the_library_lattice(v, library):
    e = P.Encoder(v)
    for w in sorted({w for t in prose(12, 5) for w in t.split()} | {"the", "theatre", "naïve", "日本語", "disgusting", "aaaaaaaaaaaaaaaaaaaaaaa"}):
        assert e.encode([w.encode()])[0].tolist() == library.nbest_encode(w, nbest_size=2)[0], w


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abthe né\n▁日𝒳\t", max_size=24), min_size=1, max_size=4))
def test_equals_plain_viterbi_and_comes_back(v, ids_of, texts):
    raw = [t.encode() for t in texts]
    ids, counts = P.Encoder(v).encode(raw)
    assert ids.tolist() == [i for t in texts for i in plain(t, v, ids_of)]
    assert P.Decoder(v).decode(ids, counts) == raw


def test_odd_rows(spark, odd, empty):
    got = P.encode(odd, PIECES)
    rows = got.collect()
    assert len(rows) == odd.count() and all(r.lossless and r.n_tokens == len(r.ids) for r in rows) and P.encode(empty, PIECES).count() == 0
    back = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in P.decode(got, PIECES).collect())
    assert back == sorted((r[0] if r[0] is not None else -1, r[1] or "") for r in odd_rows())
