import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skein.llm import bpe

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", " ", "  ", " a  b ", "x\n  y <|endoftext|>  z", "<|endoftext|>", " lead", "tab\t\tx \n", "日本語 テスト 🎉👨‍👩‍👧", "a" * 3000, "'s it's  don't  x", "x <|endoftext|> y", "word, word. word! 12 3four $$$ ***\n\nnext\r\nline\u00a0here", "\x00\x01 \x00"]


@pytest.fixture(scope="module")
def counter():
    return bpe.TokenCounter(JSON, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def codec():
    return bpe.ByteBPE(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def tik():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'abtheingß漢"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(counter, codec, library, tik, text):
    assert counter(text) == len(library.encode(text, add_special_tokens=False).ids)
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == tik.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_merge_is_leftmost_and_lowest_first():
    pairs = {1 * 10 + 1: 2, 1 * 10 + 2: 0}

    def merged(symbols):
        made = bpe.merge(symbols, pairs, 10, 0)
        assert made == symbols.count(-1)
        return [s for s in symbols if s >= 0]

    assert merged([1, 1, 1]) == [2, 1] and merged([1, 1, 2]) == [1, 0]
    assert merged([]) == [] and merged([5]) == [5]


@pytest.mark.parametrize("pattern", [r"\S+|\s+", r"\p{L}+| ?[^\s\p{L}]+|\s", r".{1,7}|\n"])
def test_other_patterns(tik, pattern):
    codec = bpe.ByteBPE(RANKS, pattern)
    other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=tik._mergeable_ranks, special_tokens={})
    for text in TEXTS:
        ids = np.frombuffer(codec.encode(text), "<u4").tolist()
        assert ids == other.encode_ordinary(text or ""), (pattern, text)


def test_perfect_hash_is_minimal_and_exact():
    r = random.Random(2)
    keys = list({r.randbytes(r.randint(1, 12)) for _ in range(3000)})
    table = bpe.PerfectHash(keys, list(range(len(keys))))
    assert sorted(table.values) == list(range(len(keys)))
    assert all(table.get(k) == i for i, k in enumerate(keys))
    assert all(table.get(k + b"!" * 13) is None for k in keys[:500])
    assert bpe.PerfectHash([], []).get(b"x") is None


def test_operators(spark, library, tik):
    rows = [(i, t, "clash", i) for i, t in enumerate(TEXTS)] + [(None, "no id", "clash", 0), (1, "again", "clash", 0), (1, "again", "clash", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, n_tokens int")
    counts = bpe.token_counts(df, JSON, public_tokenizers.PATTERN, limit=100).collect()
    expected = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 100) for i, t, *_ in rows]
    assert [tuple(r) for r in counts] == expected
    coded = bpe.bpe_encode(df, RANKS, public_tokenizers.PATTERN)
    for r, (i, t, *_) in zip(coded.collect(), rows, strict=True):
        ids = tik.encode_ordinary(t or "")
        assert (r["doc_id"], r["ids"], r["n_tokens"]) == (i, ids, len(ids))
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.bpe_decode(coded, RANKS, public_tokenizers.PATTERN).collect()
    assert [r["text"] for r in back] == [t or "" for _, t, *_ in rows]
    assert bpe.token_counts(df.limit(0), JSON, public_tokenizers.PATTERN).count() == 0
    assert bpe.bpe_encode(df.limit(0), RANKS, public_tokenizers.PATTERN, keep_ids=False).count() == 0
