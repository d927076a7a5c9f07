import math
import random
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pytest

from skein.llm import langid

LANGS = {"aa": "ab ba abba baab ", "bb": "cd dc cddc ", "cc": "éf fé éffé x"}


def sample(r, lang, n):
    return "".join(r.choice(LANGS[lang].split()) + " " for _ in range(n))


def brute_bits(texts, text, order=langid.ORDER):
    """Code length by the definition, from plain counts with all contexts kept."""
    counts = Counter()
    for t in texts:
        data = bytes(order) + t.encode()
        for i in range(order, len(data)):
            for k in range(order + 1):
                counts[data[i - k : i], data[i]] += 1

    @lru_cache(None)
    def probability(context, byte):
        own = {b: counts[context, b] for b in range(256) if counts[context, b]}
        if not context:
            below = lambda b: 1 / 256
        else:
            below = lambda b: probability(context[1:], b)
        if not own:
            return below(byte)
        total, kinds = sum(own.values()), len(own)
        if byte in own:
            return own[byte] / (total + kinds)
        rest = sum(below(b) for b in range(256) if b not in own)
        return kinds / (total + kinds) * below(byte) / rest

    data = bytes(order) + text.encode()
    return -sum(math.log2(probability(data[i - order : i], data[i])) for i in range(order, len(data)))


def trees_of(per_lang, max_contexts=10**6):
    grams = []
    for lang, texts in per_lang.items():
        codes = np.concatenate([langid._grams(np.frombuffer(bytes(langid.ORDER) + t.encode(), np.uint8)) for t in texts])
        g, n = np.unique(codes, return_counts=True)
        grams.append(pd.DataFrame({"lang": lang, "gram": g, "n": n}))
    grams = pd.concat(grams)
    contexts = set()
    for g in grams["gram"].tolist():
        length = (g >> langid._LENGTH_SHIFT) - 1
        if length:
            contexts.add((g & (1 << langid._LENGTH_SHIFT) - 1) >> 8 | length << langid._LENGTH_SHIFT)
    return langid.ContextTrees(sorted(per_lang), sorted(contexts), grams)


def test_code_lengths_follow_the_definition():
    texts = {"aa": ["abab", "abc"], "bb": ["bca"]}
    trees = trees_of(texts)
    for text in ("abca", "x", "ababab"):
        got = trees.code_lengths([text.encode()])[0] / langid.UNITS
        assert got == pytest.approx([brute_bits(texts["aa"], text), brute_bits(texts["bb"], text)], abs=0.001 * len(text) + 1e-3)


def test_slices_do_not_matter(monkeypatch):
    trees = trees_of({"aa": ["abab" * 5, "abc"], "bb": ["bca" * 4]})
    texts = [b"", b"abcabc" * 40, b"b", b"", b"cab" * 3]
    whole = trees.code_lengths(texts)
    monkeypatch.setattr(langid, "SLICE", 7)
    assert (trees.code_lengths(texts) == whole).all() and (whole[0] == 0).all()


def test_learn_and_predict(spark):
    r = random.Random(1)
    rows = [(i, sample(r, lang := r.choice(list(LANGS)), r.randint(3, 40)), lang, "x", 0.5) for i in range(300)]
    odd = [(1000, None, "aa", "x", 0.5), (1001, "", None, "x", 0.5), (1002, "123 !?", "bb", "x", 0.5), (None, "abba ba", None, "x", 0.5), (1003, "cd dc " * 20000, None, "x", 0.5)]
    df = spark.createDataFrame(rows + odd + rows[:2], "doc_id long, text string, lang string, lang_pred string, score double")
    trees = langid.learn(df.where(~langid.held_out()))
    got = langid.predict(df, trees).collect()
    assert len(got) == len(rows) + len(odd) + 2
    assert np.mean([g["lang_pred"] == row[2] for g, row in zip(got, rows, strict=False)]) > 0.99
    assert [g["lang_pred"] for g in got[300:305]] == ["und", "und", "und", "aa", "bb"]
    assert all(0 <= g["score"] <= 1 for g in got)
    assert langid.learn(df.limit(0)) == []
    assert {g["lang_pred"] for g in langid.predict(df, []).collect()} == {"und"} and langid.predict(df.limit(0), trees).count() == 0


def test_every_language_is_learnt_in_blocks(spark):
    """Eighty languages, one of them with very short texts; the blocks make no difference."""
    r = random.Random(2)
    rows = []
    for k in range(80):
        words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(12)]
        rows += [(100 * k + i, " ".join(r.choice(words) for _ in range(3 if k == 7 else 40)), f"l{k}") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {}
    for block in (16, 80):
        trees = langid.learn(df, block=block)
        assert len(trees) == 80 // block and sum(len(t.languages) for t in trees) == 80
        found[block] = {x["doc_id"]: (x["lang_pred"], round(x["score"], 9), x["bits"]) for x in langid.predict(df, trees).collect()}
    assert found[16] == found[80]
    assert np.mean([found[16][i][0] == lang for i, _, lang in rows]) > 0.99
