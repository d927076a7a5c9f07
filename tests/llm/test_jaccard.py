import random
import re
from collections import defaultdict

import numpy as np
import pytest

from skein.llm import jaccard
from skein.llm.components import components


def brute(rows, words, num, den):
    def shingled(text):
        w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])

    sets = [(i, shingled(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for b in range(a):
            j, t = sets[b]
            if i is not None and j is not None and s and t and len(s & t) * den >= len(s | t) * num:
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(sets):
        least[find(a)].append(i)
    return sorted(str((i, len(s), None if i is None else min(x for x in least[find(a)] if x is not None))) for a, (i, s) in enumerate(sets))


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghijklmnop") + r.choice("aeiou") + r.choice("xyz")
    common = [word() for _ in range(30)]
    texts = []
    for n in [1, 2, 3, 4, 6, 9, 12, 14, 17, 21, 24, 30, 45, 80, 150, 400]:
        for _ in range(4):
            base = [word() for _ in range(n)]
            if r.random() < 0.4:
                base = common + base
            texts.append(base)
            for _ in range(r.randint(0, 6)):
                copy = list(base)
                for _ in range(r.choice([0, 1, 1, 2, 3, max(1, n // 25)])):
                    at = r.randrange(len(copy))
                    copy[at : at + r.randint(0, 1)] = r.choice([[], [word()]])
                    copy = copy or [word()]
                texts.append(copy)
    chain = [word() for _ in range(200)]  # neighbours link, ends don't
    for i in range(12):
        texts.append([*chain[: 12 * 0], *chain[i:], *[f"t{j}" for j in range(i)]])
    rows = [(i, " ".join(t) if i % 5 else " ".join(t).upper() + " \t\n") for i, t in enumerate(texts)]
    r.shuffle(rows)
    return [*rows, (9000, None), (9001, ""), (9002, " \n"), (None, rows[0][1]), (None, None), rows[1], (9003, rows[2][1])]


@pytest.mark.parametrize(("words", "num", "seed"), [(3, 90, 1), (5, 80, 2)])
def test_against_brute_force(spark, words, num, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*x, 1, "c", 2) for x in rows], "doc_id long, text string, id int, `list` string, n int")
    got = jaccard.jaccard_components(df, words=words, num=num, den=100).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows, words, num, 100)
    assert len({r["component_id"] for r in got}) < len(rows) - 30


def test_empty(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("t", [jaccard.Similarity(90, 100), jaccard.Similarity(80, 100)])
def test_linked_light_sets_share_a_subset(t):
    r = np.random.default_rng(3)
    for boundary in (6, 12, 20):
        for _ in range(300):
            n = int(r.integers(1, boundary))
            base = r.integers(0, 2**63, n + 8).astype(np.uint64)
            a, b = np.unique(base[:n]), np.unique(base[int(r.integers(0, 2)) : n + int(r.integers(0, 3))])
            common = len(np.intersect1d(a, b))
            if len(b) and max(len(a), len(b)) < boundary and common * t.den >= (len(a) + len(b) - common) * t.num:
                (x, p), (y, q) = (jaccard.light_entries(s, t, boundary) for s in (a, b))
                less = {k for k, kind in [*zip(x.tolist(), p.tolist(), strict=True), *zip(y.tolist(), q.tolist(), strict=True)] if kind == jaccard.LIGHT_LESS}
                assert set(x.tolist()) & set(y.tolist()) & less


def test_boundary_follows_measured_lists():
    t = jaccard.Similarity(90, 100)
    short = jaccard.choose_boundary({n: (100, 300) for n in range(64)}, t)
    long = jaccard.choose_boundary({n: (100, 3_000_000) for n in range(64)}, t)
    assert 2 <= short < long < 64
    assert jaccard.choose_boundary({}, t) == 2


def test_sets_with_one_hash_are_told_apart(spark):
    rows = [(1, 3, 7, 7, 50), (2, 3, 7, 7, 50), (3, 3, 7, 7, 60), (4, 3, 8, 8, 50)]
    got = jaccard._apart(spark.createDataFrame(rows, "id long, n long, class long, key long, check long"))
    classes = {r["id"]: r["class"] for r in got.collect()}
    assert classes[1] == classes[2] == 7 and classes[4] == 8 and classes[3] not in (7, 8)


def test_a_hot_group_and_very_long_texts(spark):
    """Copies and near copies of one text, whose shingles are in most sets, and texts of 30,000 words."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(120)]
    rows = [(i, " ".join(base)) for i in range(30)]
    for i in range(30, 90):
        near = list(base)
        near[r.randrange(120)] = word()
        rows.append((i, " ".join(near)))
    long = [word() for _ in range(30_000)]
    rows += [(100, " ".join(long)), (101, " ".join([*long[:15_000], "other", *long[15_001:]])), (102, " ".join(long[10_000:]))]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=3, num=90, den=100).collect()
    assert sorted(str(tuple(x)) for x in got) == brute(rows, 3, 90, 100)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
