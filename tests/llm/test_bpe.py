import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm.bpe import PATTERN, VOCABULARIES, Encoder, RankQueue, encoder, merge
from weftgraph.llm.encode import count_tokens, encode

pytestmark = pytest.mark.skipif(not os.path.isdir(VOCABULARIES), reason="no vocabulary files")


@pytest.fixture(scope="module")
def enc():
    return encoder()


def slow_merge(word, ranks):
    parts = [bytes([b]) for b in word]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=40) | st.text(alphabet="abth e", max_size=60).map(str.encode))
def test_merge_is_plain_bpe(word):
    ranks = encoder().ranks
    assert (merge(word, ranks) if word else []) == (slow_merge(word, ranks) if word else [])


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=12).map(lambda b: bytes(x % 3 + 97 for x in b)), st.permutations([b"ab", b"bc", b"abc", b"aa", b"cab", b"bcb", b"aaa", b"ca", b"cc"]))
def test_ranks_in_any_order(word, order):
    """Vocabularies where a longer token ranks below its parts, so that ranks come up out of order."""
    ranks = {b"a": 100, b"b": 101, b"c": 102} | {t: i for i, t in enumerate(order)}
    if word and word not in ranks:
        assert merge(word, ranks) == slow_merge(word, ranks)


@given(st.lists(st.tuples(st.integers(0, 70_000), st.integers(0, 50))))
def test_queue(items):
    q, out = RankQueue(), []
    for r, p in items:
        q.push(r, p)
    while (x := q.pop()) is not None:
        out += [(x[0], p) for p in x[1]]
    assert out == sorted(items)


TEXTS = ["", " ", "Hello, world's end\n\n  x", "<|endoftext|> a", "a" * 20_000, "ab" * 9_000, "é́ß漢字🙂" * 50, "-" * 5_000 + "\t\r\n", "don't I'LL 123 456", "­‐ \x00"]


def test_against_public_libraries(enc):
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("tokenizers")
    tik = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    tok = tokenizers.Tokenizer.from_file(f"{VOCABULARIES}/byte_bpe_50k.json")
    tok.encode_special_tokens = True
    for t in TEXTS:
        ids = list(enc.encode(t))
        assert ids == tik.encode_ordinary(t) == tok.encode(t, add_special_tokens=False).ids
        assert enc.decode(ids) == t.encode()


def test_remembering_little_changes_nothing(enc):
    small = Encoder(f"{VOCABULARIES}/byte_bpe_50k.tiktoken", remembered=2, longest=3)
    for t in TEXTS:
        assert small.encode(t) == enc.encode(t)


def test_frames(spark, enc):
    rows = [(1, "Hello", 5), (1, "Hello", 5), (2, None, 0), (3, "", 0), (4, " \n", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in encode(docs).collect())
    assert got == [(1, [15496]), (1, [15496]), (2, []), (3, []), (4, list(enc.encode(" \n")))]
    assert encode(docs.where("false")).count() == 0
    assert sorted(r.n_tokens for r in count_tokens(docs, ["doc_id"]).collect()) == [0, 0, 1, 1, 2]
