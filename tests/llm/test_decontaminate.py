import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import decontaminate as d


def brute_distances(item, text, anchored=False):
    """Distance of the item to the best substring of ``text`` for each end."""
    previous = list(range(len(item) + 1))
    out = [(previous[-1], 0)]
    for j, c in enumerate(text):
        now = [j + 1 if anchored else 0]
        for i in range(1, len(item) + 1):
            now.append(min(previous[i] + 1, now[i - 1] + 1, previous[i - 1] + (item[i - 1] != c)))
        previous = now
        out.append((now[-1], j + 1))
    return out


@settings(max_examples=500, deadline=None)
@given(item=st.text("ab c", min_size=1, max_size=12), text=st.text("ab c", max_size=30), anchored=st.booleans())
def test_bit_parallel_distance(item, text, anchored):
    assert d.best_match(d.character_masks(item), len(item), text, anchored) == min(brute_distances(item, text, anchored), key=lambda x: (x[0], x[1]))


@given(item=st.text("abc", min_size=1, max_size=40), budget=st.integers(0, 10))
def test_pieces_cover(item, budget):
    parts = d.pieces(item, budget)
    assert "".join(p for _, p in parts) == item and all(item[o : o + len(p)] == p for o, p in parts) and len(parts) <= budget + 1


def edited(r, text, edits):
    for _ in range(edits):
        i = r.randrange(len(text))
        text = r.choice([text[:i] + text[i + 1 :], text[:i] + "q" + text[i:], text[:i] + "q" + text[i + 1 :]])
    return text


@pytest.fixture(scope="module")
def case(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(r.randint(8, 40))) for i in range(12)]
    docs = []
    for i in range(150):
        text = prose(60)
        if i % 3 == 0:
            item = r.choice(items)[1]
            inner = edited(r, item, r.randint(0, int(0.1 * len(item))))
            inner = inner.upper() if i % 2 else inner.replace(" ", "  \n", 2)
            text = f"{text} {inner} {prose(30)}"
        docs.append((i, text))
    docs += [(500, None), (501, ""), (None, items[0][1]), (502, items[1][1]), (502, items[1][1]), (503, prose(20000) + " " + items[2][1])]
    items += [(50, None), (51, "tiny"), (None, prose(20)), (3, items[3][1])]
    return docs, items


def test_against_brute_force(spark, case):
    docs, items = case
    df = spark.createDataFrame([(*x, 1, "x") for x in docs], "doc_id long, text string, id int, item string")
    bench = spark.createDataFrame([(*x, 2) for x in items], "item_id long, text string, doc_id int")
    expected = []
    for i, text in docs:
        plain = d.normalised(text or "")
        for k, item in items:
            item = d.normalised(item or "").strip()
            if len(item) >= 24:
                if len(plain) > 20000:
                    best = 0 if item in plain else 99
                else:
                    best = min(brute_distances(item, plain))[0]
                if best <= int(0.08 * len(item)):
                    expected.append((i, k, best))
    got = d.find_leaks(df, bench).collect()
    assert sorted(map(str, ((r["doc_id"], r["item_id"], r["distance"]) for r in got))) == sorted(map(str, expected)) and len(expected) > 20
    texts, names = {}, {}
    for i, t in docs:
        texts[i] = t
    for k, t in items:
        names[k] = t
    for r in got:
        piece = d.normalised(texts[r["doc_id"]][r["begin"] : r["end"]])
        assert brute_distances(d.normalised(names[r["item_id"]]).strip(), piece, anchored=True)[-1][0] == r["distance"]
    assert d.find_leaks(df, bench, block_chars=200).count() == len(got)
    leaking = {r["doc_id"] for r in got}
    kept = d.drop_leaks(df, bench)
    assert kept.columns == df.columns and kept.count() == sum(i not in leaking for i, _ in docs)
    assert d.find_leaks(df, bench.limit(0)).count() == 0 == d.find_leaks(df.limit(0), bench).count()


def test_short_items(spark):
    texts = ["Who  WROTE it?", "and who wrote it? said", "xwho wrote it?", "who wrote at?", "the cat sat", "concatenate", "cat", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Who wrote it?"), (2, "cat"), (3, " "), (4, None)], "item_id long, text string")
    got = d.find_leaks(df, bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["distance"], r["begin"], r["end"]) for r in got) == [(0, 1, 0, 0, 14), (1, 1, 0, 4, 17), (4, 2, 0, 4, 7), (6, 2, 0, 0, 3)]
    assert sorted(r["doc_id"] for r in d.drop_leaks(df, bench).collect()) == [2, 3, 5, 7]
