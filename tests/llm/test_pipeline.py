"""The pipeline against plain versions of what each stage decides, which use nothing of the library, on the smallest
tables and on a fixture of nulls, repeated rows, long texts and clashing columns."""

import base64
import os
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import quality

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def plain_words(text):
    return [w.lower() for w in re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())]


def plain_lines(rows, min_sites=10):
    """Texts without the lines that stand on enough sites and in as many texts of which at least half of the three-word
    runs stand in no other text."""
    runs_of, owners = {}, defaultdict(set)
    for _, text, site in rows:
        if text is not None and site is not None:
            words = [w for w in re.split(r"\s+", text) if w]
            runs_of[text] = {tuple(words[i : i + 3]) for i in range(len(words))}
            for run in runs_of[text]:
                owners[run].add(text)
    sites, texts = defaultdict(set), defaultdict(set)
    for _, text, site in rows:
        if text is not None and site is not None:
            for line in (x.strip(" \t\r") for x in text.split("\n")):
                sites[line].add(site)
                runs = runs_of[text]
                if runs and 2 * sum(len(owners[r]) == 1 for r in runs) >= len(runs):
                    texts[line].add(text)
    gone = {x for x in sites if x and len(sites[x]) >= min_sites and len(texts[x]) >= min_sites}
    return [text and "\n".join(x for x in text.split("\n") if x.strip(" \t\r") not in gone) for _, text, _ in rows], gone


def plain_groups(rows, size=5, share=0.8):
    """Of each group of similar texts the least id, every distinct (id, text) once; a row without an id comes last."""
    def grams(text):
        w = plain_words(text)
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}

    rows = list(dict.fromkeys(rows))
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for a, (i, t) in enumerate(rows):
        groups[find(a)].append((i is None, i or 0, t))
    return sorted((min(g)[:2]) for g in groups.values())


def plain_leaks(texts, items, rate=0.08):
    """Whether an item stands in a text with at most floor(rate * length) edits: the full table, item by item."""
    plain = lambda t: re.sub(r"\s+", " ", "".join(c.lower() if len(c.lower()) == 1 else c for c in t))
    items = [plain(t).strip() for t in items]
    width = max(map(len, items))
    codes = np.array([[ord(c) for c in t] + [-1] * (width - len(t)) for t in items])
    ends, budget = np.array([len(t) for t in items]), np.array([int(rate * len(t)) for t in items])
    steps = np.arange(width + 1)
    found = []
    for text in texts:
        row = np.tile(steps, (len(items), 1))
        hit = False
        for c in plain(text or ""):
            new = np.empty_like(row)
            new[:, 0] = 0
            new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (codes != ord(c)))
            row = np.minimum.accumulate(new - steps, axis=1) + steps
            hit |= bool((row[np.arange(len(items)), ends] <= budget).any())
        found.append(hit)
    return found


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held = docs.collect()
    model = quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet").where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))
    good = [r.asDict() for r in held if model.score(r["text"]) >= 0.3]
    kept = corpus_pipeline.classify_quality(spark, docs, DATA).cache()
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in good) and len(good) < len(held)

    rows = [(r["doc_id"], r["text"], r["source"]) for r in kept.collect()]
    expected, gone = plain_lines(rows)
    cut = corpus_pipeline.dedup_lines(spark, kept, DATA).cache()
    assert cut.columns == docs.columns and gone
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {i: t for (i, _, _), t in zip(rows, expected, strict=True)}
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect() if r["text"] not in {t for _, t, _ in rows})

    single = corpus_pipeline.dedup_documents(spark, cut, DATA).cache()
    assert sorted((False, r["doc_id"]) for r in single.collect()) == plain_groups([(r["doc_id"], r["text"]) for r in cut.collect()])

    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    left = single.collect()
    leaks = plain_leaks([r["text"] for r in left], items)
    clean = corpus_pipeline.decontaminate_documents(spark, single, DATA).cache()
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r["doc_id"] for r, leak in zip(left, leaks, strict=True) if not leak)
    assert 0 < sum(leaks) < len(leaks)

    out = corpus_pipeline.encode(spark, clean, DATA).collect()
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert {r["doc_id"]: list(r["ids"]) for r in out} == {i: codec.encode_ordinary(t) for i, t in texts.items()}
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, DATA).collect()) == sorted(texts)


def test_empty(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_repeated_rows_and_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a, "en"), (1, a, "en"), (1, a, "de"), (None, a, "en"), (None, b, "en"), (None, b, "en"), (5, c, "en"), (5, a, "en"), (6, f"{c} more", "en"), (8, None, "en"), (9, "", "en"), (9, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = corpus_pipeline.dedup_documents(spark, docs, DATA)
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, a), (None, b), (5, c), (8, None), (9, "")]))


def test_every_stage_takes_odd_rows(spark):
    """Nulls in every column, a very long text, repeated rows, and columns whose names the operators use themselves."""
    text = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) > 500").orderBy("doc_id").first()["text"]
    long = " ".join(f"word{k % 997}x{k}" for k in range(60_000))
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (None, text, None, None, None), (2, None, None, None, None), (3, "", "en", "b", 0), (4, long, "en", "c", len(long)), (5, "odd", None, None, None)]
    clashing = ["id", "key", "class", "row", "marks", "list", "n", "score", "__key", "component_id"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit("clash").alias(c) for c in clashing])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert {r[c] for r in kept for c in clashing} <= {"clash"}, name
        assert all(n <= Counter(rows)[x] for x, n in Counter(tuple(r)[:5] for r in kept).items()), name
        if name == "line dedup":
            assert len(kept) == len(rows)
        if name == "n-gram Jaccard join":
            assert sorted((r["doc_id"] for r in kept), key=str) == [1, 2, 3, 4, 5]
    encoded = corpus_pipeline.encode(spark, docs, DATA).collect()
    assert len(encoded) == len(rows) and max(r["n_tokens"] for r in encoded) > 60_000
