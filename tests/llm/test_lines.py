from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import lines

SCHEMA = "doc_id long, text string, source string, n_lines string, line string, id int, __key string, __id long, __marks int, row string"


def documents():
    rows = []
    for i in range(60):
        rows.append((i, f"own {i}\n  Subscribe now! \nmore {i}", f"s{i % 15}"))
    for i in range(60, 90):  # one site only
        rows.append((i, f"own {i}\nlocal notice\nmore {i}", "s1"))
    for i in range(90, 130):  # a block of three lines in the middle and another at the end
        rows.append((i, f"own {i}\nCopyright notice\nAll rights reserved\nContact us\n\nmore {i}\nA\nB\nC", f"s{i}"))
    for i in range(130, 142):  # close to the threshold
        rows.append((i, f"q {i}\nnear line\nr {i}", f"s{i % 10}"))
    for i in range(142, 153):
        rows.append((i, f"q {i}\nbelow line\nr {i}", f"s{i % 9}"))
    rows += [(300 + i, "Only line", f"s{i}") for i in range(40)]
    rows += [(200, None, "s1"), (201, "", "s2"), (202, "\n\n", "s3"), (None, "own x\nSubscribe now!\ny", None), (203, "Subscribe now!", "s4"), (203, "Subscribe now!", "s4"), (203, "another text", "s4")]
    rows.append((400, "\n".join(f"line {k}" if k % 3 else "Contact us" for k in range(60_000)), "s1"))
    return [(*r, "clash", "clash", 1, "clash", 2, 3, "clash") for r in rows]


def brute(rows, min_sites=10):
    """The definition: lines on so many distinct sites go."""
    sites = defaultdict(set)
    for _, text, site, *_ in rows:
        if text is not None and site is not None:
            for x in text.split("\n"):
                sites[x.strip(" \t\r")].add(site)
    gone = {x for x, on in sites.items() if x and len(on) >= min_sites}
    out = []
    for i, text, *_ in rows:
        parts = text.split("\n") if text is not None else []
        kept = [x for x in parts if x.strip(" \t\r") not in gone]
        out.append((i, text and "\n".join(kept), len(parts), len(parts) - len(kept)))
    return sorted(map(str, out)), gone


def test_against_brute_force(spark):
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA)
    got = lines.dedup_lines(df)
    expected, gone = brute(rows)
    assert gone == {"Subscribe now!", "near line", "Copyright notice", "All rights reserved", "Contact us", "A", "B", "C", "Only line"}
    assert sorted(str(tuple(r)) for r in got.select("doc_id", "text", "n_lines", "n_removed").collect()) == expected
    assert got.columns == [*[c for c in df.columns if c != "n_lines"], "n_lines", "n_removed"]
    assert {tuple(r) for r in got.select("line", "id", "__key", "__id", "__marks", "row").collect()} == {("clash", 1, "clash", 2, 3, "clash")}
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_many_sites_by_estimate(spark):
    """A threshold at which the sketches estimate, with lines on both sides of it and close to it."""
    rows = [(s, f"t{n} of all", f"site {s}") for n in (900, 980, 999, 1000, 1020, 1500) for s in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = lines.dedup_lines(df, min_sites=1000).where("n_removed > 0").groupBy("n_lines").count().collect()
    assert [tuple(r) for r in got] == [(1, 1000 + 1020 + 1500)]


def test_native(spark):
    df = spark.createDataFrame([(1, "a\nb", "s")], "doc_id long, text string, source string")
    plan = lines.dedup_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert lines.dedup_lines(df.withColumn("source", F.lit(None).cast("string"))).first()["text"] == "a\nb"


def whole(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, df, "").collect()}


def body(i):
    return "\n".join(" ".join(f"w{i}x{k}" for k in range(at, at + 12)) for at in (0, 12))


def test_blocks_go_whole(spark):
    rows = [(i, f"head 1\nhead 2\nhead 3\n{body(i)}\nfoot 1\nfoot 2\nfoot 3", f"s{i % 12}") for i in range(24)]
    assert whole(spark, rows) == {i: body(i) for i in range(24)}


def test_copies_keep_their_lines_and_have_no_veto(spark):
    rows = [(i, f"Subscribe now!\n{body(i)}", f"s{i % 12}") for i in range(24)]
    rows += [(100 + i, f"Subscribe now!\n{body('copied')}", f"s{i % 12}") for i in range(400)]
    near = [[f"n{line}w{k}" for k in range(12)] for line in range(12)]
    for i in range(200):  # most lines are edited in some copy, the short one in none
        text = [" ".join(x) if (i + k) % 3 else " ".join([*x[:6], f"edit{i}", *x[7:]]) for k, x in enumerate(near)]
        rows.append((1000 + i, "\n".join([*text[:4], "short line", *text[4:]]), f"s{i % 12}"))
    got = whole(spark, rows)
    assert all(got[i] == body(i) for i in range(24))
    assert all(got[100 + i] == body("copied") for i in range(400))
    assert all(got[i] == text for i, text, _ in rows if i >= 1000)


def test_all_sites_count(spark):
    rows = []
    for i in range(24):  # the hot site "a" has the same neighbours as each other site
        rows += [(2 * i + k, f"before {i}\nAnd with.\nafter {i}\n{body(f'{i}y{k}')}", f"s{i % 9}" if k else "a") for k in (0, 1)]
    assert all("And with." not in text for text in whole(spark, rows).values())
    rows = [(i, f"And with.\n{body(i)}", f"s{i % 9}") for i in range(48)]
    assert all("And with." in text for text in whole(spark, rows).values())
