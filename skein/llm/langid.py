"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts up to ``ORDER`` bytes long with the counts of the bytes that followed. A
byte's probability in a context is count / (total + kinds), the rest of the mass, kinds / (total + kinds), is the
escape to the context one byte shorter, where the bytes already seen are excluded; below the empty context all bytes
are equal. After learning the statistics are frozen: every context's code lengths are worked out once, for all 256
bytes and all languages, in 1/1024 bit, so that a text's code length is an exact integer sum of table entries, one
for each byte. The language with the shortest code is the prediction.

Learning reads a bounded sample: about ``docs_per_language`` documents (whole texts) of every language, picked by a hash
of the id. It keeps ``max_contexts`` contexts, those with the greatest share of some language's, so that a language with
short documents has its own among them. Scoring reads every byte of every text. Languages are scored in blocks of
``BLOCK``, a pass for each, which bounds the tables that a worker holds however many languages there are; the driver
holds a row for each language and the contexts with their followers.

Defined results: ``und`` with score 0 for a null text or one without a letter, and for every text when there is
nothing to learn from; equal code lengths go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, discard, materialise, narrow

ORDER = 4
UNKNOWN = "und"
#: Units of a code length in a bit.
UNITS = 1024
#: Bytes that are scored at once.
SLICE = 1 << 20
#: Languages that are scored in a pass, each with a table of about 2 MB at 4,096 contexts.
BLOCK = 16
#: The score is the posterior that this many bytes at the text's mean code lengths would give.
SCORE_BYTES = 64
_LENGTH_SHIFT = 8 * (ORDER + 1)
_START = bytes(ORDER)


def _grams(data: np.ndarray) -> np.ndarray:
    """The codes of all 1- to (ORDER + 1)-byte strings that end inside the text, which follows ORDER zero bytes."""
    wide = data.astype(np.int64)
    n = len(wide) - ORDER
    parts = []
    for length in range(1, ORDER + 2):
        code = np.zeros(n, np.int64)
        for i in range(length):
            code = code << 8 | wide[ORDER - length + 1 + i : ORDER - length + 1 + i + n]
        parts.append(code | length << _LENGTH_SHIFT)
    return np.concatenate(parts)


def count_grams(sample: DataFrame) -> DataFrame:
    """(lang, gram, n) of a DataFrame (text, lang), pre-aggregated in each task."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush():
            for lang, parts in held.items():
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": grams, "n": n})
            held.clear()

        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                data = text.encode()
                for at in range(0, len(data), SLICE):
                    before = (_START + data[max(0, at - ORDER) : at])[-ORDER:]
                    held.setdefault(lang, []).append(_grams(np.frombuffer(before + data[at : at + SLICE], np.uint8)))
                    size += len(data)
                    if size > 2 * SLICE:
                        yield from flush()
                        size = 0
        yield from flush()

    return sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class ContextTrees:
    """The frozen statistics of all languages: children of each context, and code lengths."""

    def __init__(self, languages: list[str], contexts: list[int], grams: pd.DataFrame):
        """``contexts``: codes, closed under dropping the first byte; ``grams``: lang, gram, n of their followers."""
        self.languages = languages
        order = sorted(contexts, key=lambda c: (c >> _LENGTH_SHIFT, c))
        index = {0: 0} | {c: i + 1 for i, c in enumerate(order)}
        n, kinds = len(index), len(languages)
        self.n = n
        counts = np.zeros((n, 256, kinds), np.float64)
        mask = (1 << _LENGTH_SHIFT) - 1
        for lang, gram, times in zip(grams["lang"], grams["gram"].tolist(), grams["n"].tolist(), strict=True):
            length = (gram >> _LENGTH_SHIFT) - 1
            context = (gram & mask) >> 8 | length << _LENGTH_SHIFT if length else 0
            if context in index:
                counts[index[context], gram & 255, languages.index(lang)] = times
        child = np.empty((2 * n, 256), np.int32)
        child[:n] = np.arange(n, 2 * n)[:, None]  # without a child: the twin, which has none
        child[n:] = np.arange(n, 2 * n)[:, None]
        parent = np.zeros(n, np.int64)
        for code, i in index.items():
            if code:
                length = code >> _LENGTH_SHIFT
                text = code & mask
                rest = text & (1 << 8 * (length - 1)) - 1
                parent[i] = index[rest | (length - 1) << _LENGTH_SHIFT if length > 1 else 0]
                child[parent[i], text >> 8 * (length - 1)] = i
        cost = np.empty((n, 256, kinds), np.uint16)
        probability = np.empty((n, 256, kinds), np.float32)
        for i in range(n):
            below = probability[parent[i]].astype(np.float64) if i else np.full((256, kinds), 1 / 256)
            own = counts[i]
            seen = own > 0
            total, distinct = own.sum(0), seen.sum(0)
            left = np.where(seen, 0, below).sum(0)
            whole = np.maximum(total + distinct, 1)
            escape = np.where(distinct == 0, 1.0, np.where(left > 0, distinct / whole, 0.0)) / np.maximum(left, 1e-300)
            p = np.where(seen, own / np.where(left > 0, whole, np.maximum(total, 1)), below * escape)
            probability[i] = p
            cost[i] = np.minimum(np.round(-np.log2(np.maximum(p, 2.0**-62)) * UNITS), 65535)
        self.child = child.reshape(-1)
        self.cost = np.ascontiguousarray(cost.reshape(n * 256, kinds))

    def _lengths(self, data: np.ndarray) -> np.ndarray:
        """Code lengths (bytes x languages) of the bytes after the first ORDER ones."""
        n = len(data) - ORDER
        wide = data.astype(np.int32)
        node = self.child.take(wide[ORDER - 1 : ORDER - 1 + n])
        for back in range(2, ORDER + 1):
            node = self.child.take((node << 8) + wide[ORDER - back : ORDER - back + n])
        node -= np.where(node >= self.n, self.n, 0).astype(np.int32)
        return self.cost.take((node << 8) + wide[ORDER:], axis=0)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Exact code lengths in 1/UNITS bit: an integer for each text and language."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        group: list[int] = []
        size = 0

        def close() -> None:
            data = np.frombuffer(b"".join(_START + texts[i] for i in group), np.uint8)
            lengths = self._lengths(data)
            starts = np.cumsum([0] + [ORDER + len(texts[i]) for i in group])[:-1]
            ends = starts + [len(texts[i]) for i in group]
            bounds = np.column_stack([starts, ends]).reshape(-1)
            bounds = bounds[:-1] if bounds[-1] >= len(lengths) else bounds
            for k in range(out.shape[1]):
                out[group, k] = np.add.reduceat(lengths[:, k], bounds, dtype=np.int64)[::2]

        for i, text in enumerate(texts):
            if len(text) > SLICE:
                for at in range(0, len(text), SLICE):
                    before = (_START + text[max(0, at - ORDER) : at])[-ORDER:]
                    out[i] += self._lengths(np.frombuffer(before + text[at : at + SLICE], np.uint8)).sum(0, dtype=np.int64)
            elif text:
                group.append(i)
                size += len(text)
                if size > SLICE:
                    close()
                    group, size = [], 0
        if group:
            close()
        return out


def learn(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 400, max_contexts: int = 4096, block: int = BLOCK) -> list[ContextTrees]:
    """Context trees, for each block of languages, from the rows of ``df`` with a text and a language; none where there
    are none. All blocks have the same contexts, so that their code lengths compare."""
    spark = df.sparkSession
    rows = narrow(df, id=id_col, text=text_col, lang=lang_col).where("text is not null and lang is not null")
    sizes = sorted(map(tuple, rows.groupBy("lang").agg(F.count("*").alias("n")).collect()))
    if not sizes:
        return []
    shares = spark.createDataFrame([(lang, min(1.0, docs_per_language / n) * (1 << 30)) for lang, n in sizes], "lang string, share double")
    drawn = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.col("share"))
    grams = materialise(count_grams(drawn.select("text", "lang")), "grams")
    length = F.shiftright("gram", _LENGTH_SHIFT)
    context = F.when(length > 1, F.shiftright(F.col("gram").bitwiseAND(F.lit((1 << _LENGTH_SHIFT) - 1)), 8) + (length - 1) * F.lit(1 << _LENGTH_SHIFT)).otherwise(F.lit(0))
    grams = grams.withColumn("context", context.cast("long"))
    totals = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    each = grams.where("context > 0").groupBy("lang", "context").agg(F.sum("n").alias("n")).join(F.broadcast(totals), "lang")
    top = each.groupBy("context").agg(F.max(F.col("n") / F.col("total")).alias("weight")).orderBy(F.desc("weight"), "context").limit(max_contexts).select("context")
    contexts = _closed([r[0] for r in top.collect()])
    known = F.broadcast(spark.createDataFrame([(c,) for c in [0, *contexts]], "context long"))
    languages = [lang for lang, _ in sizes]
    trees = []
    for at in range(0, len(languages), block):
        some = languages[at : at + block]
        kept = grams.where(F.col("lang").isin(some)).join(known, "context").select("lang", "gram", "n").toPandas()
        trees.append(ContextTrees(some, contexts, kept))
    discard(grams)
    return trees


def _closed(contexts: list[int]) -> list[int]:
    """With the contexts that are left when first bytes are dropped, of which there are ORDER - 1 for each at most."""
    found = set(contexts)
    for code in contexts:
        for length in range((code >> _LENGTH_SHIFT) - 1, 0, -1):
            found.add(code & (1 << 8 * length) - 1 | length << _LENGTH_SHIFT)
    return sorted(found)


def predict(df: DataFrame, trees: list[ContextTrees], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``lang_pred``, ``score`` (0 to 1) and ``bits`` (the code length of the prediction)."""
    source = narrow(df, id=id_col, text=text_col)
    id_type = source.schema["id"].dataType.simpleString()
    state = f"id {id_type}, text string, lang string, least long, mass double"
    source = source.select("id", "text", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("long").alias("least"), F.lit(0.0).alias("mass"))
    for number, block in enumerate(trees):
        shared = df.sparkSession.sparkContext.broadcast(block)
        last = number + 1 == len(trees)

        def score(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for batch in batches:
                texts = [x.as_py() for x in batch.column("text")]
                at = np.flatnonzero([t is not None and any(map(str.isalpha, t)) for t in texts])
                langs = batch.column("lang").to_pylist()
                least = batch.column("least").fill_null(-1).to_numpy(zero_copy_only=False).copy()
                mass = batch.column("mass").to_numpy(zero_copy_only=False).copy()
                if len(at):
                    data = [texts[i].encode() for i in at]
                    unit = UNITS * np.array([max(1.0, len(d) / SCORE_BYTES) for d in data])
                    lengths = model.code_lengths(data)
                    best = lengths.argmin(1)
                    own = lengths[np.arange(len(at)), best]
                    before = np.where(least[at] < 0, own, least[at])
                    for i, k in zip(at[(least[at] < 0) | (own < least[at])], best[(least[at] < 0) | (own < least[at])], strict=True):
                        langs[i] = model.languages[k]
                    least[at] = np.minimum(before, own)
                    # the others' shares, as seen from the shortest code so far
                    mass[at] = mass[at] * np.exp2((least[at] - before) / unit) + np.exp2((least[at][:, None] - lengths) / unit[:, None]).sum(1)
                kept = pa.nulls(len(texts), pa.string()) if last else batch.column("text")
                yield pa.RecordBatch.from_arrays([batch.column("id"), kept, pa.array(langs, pa.string()), pa.array(least, mask=least < 0), pa.array(mass)], ["id", "text", "lang", "least", "mass"])

        source = source.mapInArrow(score, state)
        if not last:
            source = materialise(source, "languages")  # a worker holds one block's tables at a time
    found = F.col("lang").isNotNull()
    return source.select(
        F.col("id").alias(id_col),
        F.when(found, F.col("lang")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(found, 1 / F.col("mass")).otherwise(0.0).alias("score"),
        F.when(found, F.col("least") / UNITS).otherwise(0.0).alias("bits"),
    )


def held_out(id_col: str = "doc_id"):
    return crc_bucket(id_col, 3) == 1
