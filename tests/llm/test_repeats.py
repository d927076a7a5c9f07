import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import repeats
from skein.llm.suffix_array import common_prefixes, suffix_array


@settings(max_examples=400, deadline=None)
@given(s=st.lists(st.integers(0, 3), min_size=1, max_size=60), big=st.booleans())
def test_suffix_array(s, big):
    expected = sorted(range(len(s)), key=lambda i: s[i:])
    assert suffix_array(np.array(s), 2000 if big else 4).tolist() == expected


@settings(max_examples=200, deadline=None)
@given(s=st.lists(st.integers(0, 2), min_size=1, max_size=80), cap=st.integers(1, 20), step=st.sampled_from([1, 4, 32]))
def test_common_prefixes(s, cap, step):
    n = len(s)
    length, before = common_prefixes(np.array(s), suffix_array(np.array(s), 3), np.arange(n, 0, -1), cap, step)
    for i in range(n):
        j = before[i]
        true = 0 if j < 0 else next((k for k in range(n) if max(i, j) + k >= n or s[i + k] != s[j + k]), n)
        assert (length[i] >= cap) == (true >= cap) and length[i] <= true


def brute(texts, length):
    count = Counter()
    for t in texts:
        count.update(hash(t[i : i + length]) for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[hash(t[i : i + length])] > 1:
                covered[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if covered[i] and (i == 0 or not covered[i - 1]))
        out.append((len(t), sum(covered), spans, hashlib.sha256(bytes(x for x, c in zip(t, covered, strict=True) if not c)).hexdigest()))
    return out


def test_every_window_is_in_one_run(monkeypatch):
    r = random.Random(6)
    for data in (b"", b"a" * 399, b"a" * 1000, r.randbytes(3000), (r.randbytes(300) * 8)[:2100]):
        for slice_ in (1 << 19, 333):
            monkeypatch.setattr(repeats, "SLICE", slice_)
            _, low, high = repeats.window_runs(data, 400)
            assert sorted(i for a, b in zip(low, high, strict=True) for i in range(a, b + 1)) == list(range(max(0, len(data) - 399)))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(9)
    prose = lambda n: "".join(r.choice("abcdefgh éß\n") for _ in range(n))
    passage, other = prose(900), prose(450)
    out = [prose(r.randint(0, 1500)) for _ in range(20)]
    out += [prose(300) + passage + prose(200), passage[100:], prose(10) + passage[:500] + other + prose(5), other + prose(700) + other]
    base = prose(3000)
    for _ in range(12):
        copy = list(base)
        for _ in range(4):
            copy[r.randrange(len(copy))] = "X"
        out.append("".join(copy))
    out += [base, base, base[:399], base[:400], "z" * 399, "z" * 900, "\0" * 450, "x\0" * 300, None, "", passage]
    return out


@pytest.mark.parametrize("chunk", [2000, 3])
def test_against_brute_force(spark, texts, chunk):
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (0, texts[0]), (0, texts[0])]
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], "doc_id long, text string, `key` string, anchor int")
    got = repeats.remove_repeats(df, chunk=chunk, keep_text=True).collect()
    expected = brute([(t or "").encode() for _, t in rows], 400)
    assert sorted(str((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in got) == sorted(str((i, *e)) for (i, _), e in zip(rows, expected, strict=True))
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)


def test_passages_by_words(spark):
    """Passages of 51 words tell wherever they stand, also where they are under 400 bytes; 31 common words do not."""
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghijklmno", k=r.randint(2, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for k in range(40):
        passage = prose(51)
        rows += [(10 * k + i, prose(r.randint(0, 90)) + " " + passage + "\n" + prose(r.randint(0, 90))) for i in range(2)]
        rows += [(10 * k + 2, prose(100)), (10 * k + 3, " ".join(passage.split()[10:41]) + prose(60))]
    twice = prose(51)
    rows += [(1000, f"{prose(70)} {twice} {prose(70)} {twice}"), (1001, prose(50)), (1002, twice[::-1]), (1003, None)]
    rows += [(1010, prose(80))] * 2
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    told = {x["doc_id"]: x["n_shared_runs"] for x in got}
    assert len(got) == len(rows)
    assert all((told[i] > 0) == (i % 10 < 2) for i in range(400) if i in told)
    assert told[1000] > 0 and told[1010] > 0 and not any(told[i] for i in (1001, 1002, 1003))
    assert any(0 < x["n_shared_runs"] and not x["n_removed"] for x in got)


def test_empty(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_longer_than_a_slice(spark):
    """Passages across the bounds of slices, repeated in the same text, in another long one and in a short one."""
    r = random.Random(12)
    prose = lambda n: "".join(r.choices("abcdefghijklmnop \n", k=n))
    passage = prose(2500)
    at = repeats.SLICE - 1200
    rows = [(0, prose(at) + passage + prose(3000) + passage[:500] + "é" * 10), (1, prose(at + 700) + passage[900:] + prose(100)), (2, passage[2000:]), (3, prose(800)), (4, prose(30) + passage[:399])]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = brute([t.encode() for _, t in rows], 400)
    assert sorted((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in got) == [(i, *e) for (i, _), e in zip(rows, expected, strict=True)]


def test_halves_of_a_window_hash_differ():
    data = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    first, second = (repeats.window_hashes(data, 400, half) for half in (0, 1))
    assert len(set(first.tolist())) == len(set(second.tolist())) == 4601 and not (first == second).any()
    again = repeats.window_hashes(data[100:900], 400, 1)
    assert (again == second[100:501]).all()
