import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from rookery.llm import bpe
from tests.llm.helpers import docs_of

PATH, PATTERN = bpe.production_vocabulary()
RANKS = bpe.read_ranks(PATH)
WANT = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER, DECODER = bpe.Encoder(RANKS, PATTERN), bpe.Decoder(RANKS)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeinrst  hoTHE\n.,'"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_encodes_as_tiktoken(text):
    ids = ENCODER(text)
    assert ids == WANT.encode_ordinary(text) and DECODER(ids) == text


@pytest.mark.parametrize("text", ["a" * 5_000, " " * 3_000, "=" * 2_000, "ab" * 2_000, "😀" * 1_000, "don't we're I'll", "\x1c\x1d  x"])
def test_long_and_odd(text):
    assert ENCODER(text) == WANT.encode_ordinary(text)


def test_small_caches_change_nothing():
    small = bpe.Encoder(RANKS, PATTERN)
    small.pieces = bpe.Pieces(bpe.Transducer(RANKS, max_states=50), most=5)
    rng = random.Random(4)
    for _ in range(200):
        text = " ".join("".join(rng.choice("abcdehinorst") for _ in range(rng.randint(1, 14))) for _ in range(8))
        assert small(text) == WANT.encode_ordinary(text)


def test_decoder_joins_split_characters():
    ids = WANT.encode_ordinary("é😀中" * 50)
    assert "".join(DECODER.stream([i] for i in ids)) == "é😀中" * 50


def test_round_trip_and_tables(spark):
    rows = [(1, "Hello  wörld"), (2, None), (3, ""), (None, "x"), (1, "Hello  wörld"), (4, "long " * 40_000)]
    docs = docs_of(spark, rows)
    got = sorted(map(tuple, bpe.round_trip(docs, PATH, PATTERN).collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = {t: WANT.encode_ordinary(t or "") for _, t in rows}
    assert got == sorted(((i, len(ids[t]), sha(",".join(map(str, ids[t])).encode()), sha((t or "").encode())) for i, t in rows), key=str)
    encoded = bpe.encode(docs, PATH, PATTERN)
    assert sorted(map(tuple, bpe.decode(encoded, PATH).collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert bpe.round_trip(docs_of(spark, []), PATH, PATTERN).count() == 0
    assert public_tokenizers.PATTERN == PATTERN
