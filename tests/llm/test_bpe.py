"""Byte-level BPE against the tiktoken library, and exact round trips."""

import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from curvetrail.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD_TEXTS = [None, "", " ", "a", "x" * 3000, "é" * 700, "\x00\n\t", "word " * 900, "-" * 5000, "日本語" * 800, "ab" * 2000, " \n \n  ", "it's 'LL don't", "𝄞 mañana"]


@pytest.fixture(scope="module")
def library():
    tokens = bpe.read_ranks(RANKS)
    return tokens, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


@pytest.fixture(scope="module")
def own(library):
    return bpe.Coder(library[0])


def ids_of(own, text):
    return np.frombuffer(own.encode([regex.findall(public_tokenizers.PATTERN, text)])[0], np.int32).tolist()


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_any_text(library, own, text):
    assert ids_of(own, text) == library[1].encode_ordinary(text)


def test_long_pieces(library, own):
    """Pieces without white space: random letters, which merge in an order that lower ranks upset, and repeated ones."""
    rng = random.Random(1)
    for letters, n in (("abcdefghijklmnop", 900), ("ab", 900), ("thein", 700), ("éàñ", 300)):
        text = "".join(rng.choice(letters) for _ in range(n))
        assert ids_of(own, text) == library[1].encode_ordinary(text)


def test_merges_go_by_rank_not_by_length():
    """A vocabulary in which a longer token has a lower rank than its parts: only the leftmost is contracted then."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bc", b"ab", b"cd", b"abcd", b"aa", b"aaaa"]
    library = tiktoken.Encoding("small", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    own = bpe.Coder(tokens)
    rng = random.Random(2)
    for n in (*range(1, 12), 60, 200):
        for _ in range(8):
            text = "".join(rng.choice("abcd") for _ in range(n))
            assert ids_of(own, text) == library.encode_ordinary(text)


def test_documents(spark, library, monkeypatch):
    tokens, enc = library
    rows = list(enumerate(ODD_TEXTS)) + [(3, "a"), (None, "null id"), (99, "word " * 200_000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, id string, ids int").repartition(3)
    got = bpe.decode(bpe.encode(df, tokens, public_tokenizers.PATTERN), tokens).collect()
    assert len(got) == len(rows)
    want = sorted((-1 if i is None else i, tuple(enc.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    assert sorted((-1 if r.id is None else r.id, tuple(r.ids), bytes(r.decoded)) for r in got) == want
    assert bpe.encode(df.where("false"), tokens, public_tokenizers.PATTERN).count() == 0


def test_unknown_ids(spark, library):
    df = spark.createDataFrame([(1, [64, None]), (2, [64, 10**9]), (3, None), (4, []), (5, [64, 65])], "id long, ids array<int>")
    got = {r.id: r.decoded for r in bpe.decode(df, library[0]).collect()}
    assert got == {1: None, 2: None, 3: None, 4: b"", 5: library[0][64] + library[0][65]}


def test_vocabulary_without_all_bytes(tmp_path):
    path = tmp_path / "few"
    path.write_text("YQ== 0\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(str(path))
