"""Benchmark decontamination: pigeonhole edit matching with Myers' bit-parallel verification.

A test item of m characters may differ by k = floor(``error_rate`` * m) edits. Split into k + 1 pieces, at least one
piece occurs unchanged in every such passage, so an automaton over all pieces finds all candidates; the stretch
around each hit is verified by Myers' bit-parallel distance, the item's characters being the bits of one integer.
Letters are compared in lower case and any white space as one space.

The documents are read in one narrow pass for each block of items (``block_chars`` bounds what a block broadcasts;
a larger benchmark takes more passes). Texts are whole, hits are never capped.

Items shorter than ``min_chars`` after normalising have no error budget and match at word boundaries only: where the
item begins or ends with a letter or digit, the text has none right before or after.

Defined results: null or empty texts match nothing; items that are null or empty after normalising are left out;
repeated rows and repeated items give a result each; a pair that matches in several places has one row, the place with
the least distance, the first of equals.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import narrow

_SPACE = re.compile(r"\s+")


def lowered(text: str) -> str:
    """Lower case, one character for each, so that positions stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def normalised(text: str) -> str:
    return _SPACE.sub(" ", lowered(text))


def raw_span(text: str, begin: int, end: int) -> tuple[int, int]:
    """Where characters [begin, end) of the normalised text lie in the text itself."""
    shift, bounds = 0, [(0, 0)]
    for m in _SPACE.finditer(lowered(text)):
        if m.end() - m.start() > 1:
            shift += m.end() - m.start() - 1
            bounds.append((m.end() - shift, shift))
    raw = lambda at: at + next(s for b, s in reversed(bounds) if b <= at)
    return raw(begin), raw(end - 1) + 1


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget`` + 1 pieces that cover the item, with their offsets; sizes differ by one at most."""
    n, size = len(item), budget + 1
    cuts = [i * n // size for i in range(size + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def character_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def best_match(masks: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """(distance, end) of the substring of ``text`` nearest to the item, the first of equals; the substring may begin
    anywhere, or only at 0 if ``anchored``."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, now = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | x
        up = minus | (full & ~(d | plus))
        down = plus & d
        if up & top:
            now += 1
        elif down & top:
            now -= 1
        up = (up << 1 | anchored) & full
        plus = (down << 1 | ~(d | up)) & full
        minus = up & d
        if now < best:
            best, end = now, j + 1
    return best, end


def at_boundaries(item: str, text: str, begin: int) -> bool:
    """Whether the item, which stands at ``begin``, is not part of a longer word there."""
    end = begin + len(item)
    inner = begin > 0 and item[0].isalnum() and text[begin - 1].isalnum()
    return not inner and not (end < len(text) and item[-1].isalnum() and text[end].isalnum())


class Items:
    """An automaton over the pieces of a block of items, and what verification needs of each."""

    def __init__(self, items: list[tuple[object, str]], error_rate: float, min_chars: int):
        self.items = []
        self.min_chars = min_chars
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            budget = int(error_rate * len(text)) if len(text) >= min_chars else 0
            for offset, piece in pieces(text, budget):
                found.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((item_id, text, budget, character_masks(text), character_masks(text[::-1])))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[object, int, int, int]]:
        """(item id, distance, begin, end) in the text itself."""
        plain = normalised(text)
        windows: dict[int, list[list[int]]] = {}
        for last, (size, places) in self.automaton.iter(plain):
            for i, offset in places:
                _, item, budget, _, _ = self.items[i]
                begin = last + 1 - size - offset
                if len(item) < self.min_chars and not at_boundaries(item, plain, begin):
                    continue
                a, b = max(0, begin - budget), min(len(plain), begin + len(item) + budget)
                known = windows.setdefault(i, [])
                if known and a <= known[-1][1] and a >= known[-1][0]:
                    known[-1][1] = max(known[-1][1], b)
                else:
                    known.append([a, b])
        for i, known in windows.items():
            item_id, item, budget, masks, reverse = self.items[i]
            best = None
            for a, b in known:
                distance, end = best_match(masks, len(item), plain[a:b])
                if distance <= budget and (best is None or distance < best[0]):
                    best = (distance, a, a + end)
            if best:
                distance, a, end = best
                _, back = best_match(reverse, len(item), plain[max(0, end - len(item) - budget) : end][::-1], anchored=True)
                yield (item_id, distance, *raw_span(text, max(0, end - back), end))


_built: dict[int, Items] = {}


def _items(shared, error_rate: float, min_chars: int) -> Items:
    """The block's automaton, built once by a worker and held until it meets another block."""
    key = hash((shared.value["name"], error_rate, min_chars))
    if key not in _built:
        _built.clear()
        _built[key] = Items(shared.value["items"], error_rate, min_chars)
    return _built[key]


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, block_chars: int) -> Iterator[list[tuple[object, str]]]:
    items = narrow(benchmark, id=item_id, text=item_text).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).head()[0] or 0
    n = -(-total // block_chars)
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        block = [(r[0], normalised(r[1]).strip()) for r in part.collect()]
        block = [x for x in block if x[1]]
        if block:
            yield block


def find_leaks(df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", error_rate: float = 0.08, min_chars: int = 24, block_chars: int = 8_000_000) -> DataFrame:
    """A row for each pair of a document and an item found in it: both ids, ``distance`` in edits and the characters
    [``begin``, ``end``) of the text that it holds."""
    spark = df.sparkSession
    source = narrow(df, id=id_col, text=text_col)
    id_type = source.schema["id"].dataType.simpleString()
    item_type = benchmark.schema[item_id].dataType.simpleString()
    item_arrow = to_arrow_type(benchmark.schema[item_id].dataType)
    out = None
    for block in _blocks(benchmark, item_id, item_text, block_chars):
        shared = spark.sparkContext.broadcast({"name": uuid.uuid4().hex, "items": block})  # at most about block_chars characters

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = _items(shared, error_rate, min_chars)
            for batch in batches:
                rows, hits = [], []
                for i, value in enumerate(batch.column("text")):
                    for hit in items.matches(value.as_py() or ""):
                        rows.append(i)
                        hits.append(hit)
                ids = batch.column("id").take(pa.array(rows, pa.int64()))
                columns = [ids, pa.array([h[0] for h in hits], item_arrow)] + [pa.array([h[k] for h in hits], pa.int32()) for k in (1, 2, 3)]
                if hits:
                    yield pa.RecordBatch.from_arrays(columns, ["id", "item", "distance", "begin", "end"])

        found = source.mapInArrow(find, f"id {id_type}, item {item_type}, distance int, begin int, end int")
        out = found if out is None else out.unionAll(found)
    if out is None:
        out = spark.createDataFrame([], f"id {id_type}, item {item_type}, distance int, begin int, end int")
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_id), "distance", "begin", "end")


def drop_leaks(df: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", error_rate: float = 0.08, min_chars: int = 24, block_chars: int = 8_000_000) -> DataFrame:
    """The rows of ``df``, all columns as they are, in whose text no item is found."""
    for block in _blocks(benchmark, item_id, item_text, block_chars):
        shared = df.sparkSession.sparkContext.broadcast({"name": uuid.uuid4().hex, "items": block})

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = _items(shared, error_rate, min_chars)
            for batch in batches:
                yield batch.filter(pa.array([next(items.matches(x.as_py() or ""), None) is None for x in batch.column(text_col)], pa.bool_()))

        df = df.mapInArrow(clean, df.schema)
    return df
