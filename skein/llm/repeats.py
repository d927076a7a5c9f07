"""Suffix-array dedup: removal of every byte that a string of ``length`` bytes covers which starts anywhere else, too.

What can repeat is found first. Each window of ``length`` bytes has an anchor, the least hash of the ``GRAM``-byte
strings in it (the leftmost of equals), so equal windows have equal anchors. Neighbouring windows with the same
anchor occurrence form a run. An anchor hash that occurs once in the corpus leads nowhere; the runs of the others are
routed by their anchor, so that all windows that could be equal meet. There the runs' bytes form shards, whose suffix
arrays are made by induced sorting; a window is repeated if it has ``length`` bytes in common with its neighbour in
the array, which the permuted common prefixes tell.

Texts that are equal as a whole are brought down to one first and are removed entirely. An anchor with more than
``chunk`` runs, say in a passage that a third of the corpus has, is dealt out over several shards by a salt. What a
shard then finds repeated is settled; the other windows of such an anchor meet once more by a hash of the whole
window (128 bits), together with one of each repeated kind, spread over all tasks. No run or window is dropped, and a
shard's size does not depend on the input.

Passages of few long or many short words are told beside this, and nothing is removed for them: of every ``PASSAGE``
words in a row one run of ``RUN`` words is chosen, that whose first word sorts first, so that the same run is chosen
wherever a passage of so many words stands. ``n_shared_runs`` counts a text's chosen runs that are chosen in
another text, or at two places in this one.

Defined results: a null text is empty; texts under ``length`` bytes lose nothing; a repeated row is another document;
matches never cross documents; strings are judged on the input, not on what is left.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, narrow
from .jaccard import mixed
from .suffix_array import common_prefixes, suffix_array

#: Bytes of an anchor string.
GRAM = 128
#: Window starts that are handled at once.
SLICE = 1 << 19
#: Bytes of a shard's text, about.
SHARD = 1 << 20

#: Words of a passage that is told, and of the runs that tell it.
PASSAGE, RUN = 51, 32

#: Odd, so that they have inverses; the second is for the other half of a window's hash.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = max(n, SLICE + 4096)
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        held = _powers[base] = np.multiply.accumulate(factors)
    return held[:n]


def window_hashes(data: np.ndarray, size: int, half: int = 0) -> np.ndarray:
    """Either 64-bit half of a hash of every window of ``size`` bytes; equal windows have equal hashes."""
    n = len(data) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    base = _BASES[half]
    np.cumsum(_VALUES[data] * _power(base, len(data)), out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * _power(pow(base, -1, 1 << 64), n))


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least or greatest of every ``width`` values in a row."""
    n = len(values)
    pick = np.minimum if least else np.maximum
    fill = np.uint64(0xFFFFFFFFFFFFFFFF) if least else np.uint64(0)
    padded = np.full(-(-n // width) * width, fill, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).reshape(-1)
    back = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return pick(back[: n - width + 1], ahead[width - 1 : n])


def window_runs(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first start, last start) of the runs of windows; every window of the text is in one."""
    anchors: list[int] = []
    lows: list[int] = []
    highs: list[int] = []
    width = length - GRAM + 1
    for at in range(0, len(data) - length + 1, SLICE):
        part = np.frombuffer(data[at : at + SLICE + length - 1], np.uint8)
        hashes = window_hashes(part, GRAM)
        windows = len(part) - length + 1
        least = _sliding(hashes, width, True)
        # a position is some window's least if the greatest of the windows' minima over it is its own hash
        over = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
        chosen = np.flatnonzero(_sliding(over, width, False) == hashes)
        values = hashes[chosen].tolist()
        places = chosen.tolist()
        count = len(places)
        left, right = [-1] * count, [len(hashes)] * count
        stack: list[int] = []
        for i in range(count):
            while stack and values[stack[-1]] > values[i]:
                right[stack.pop()] = places[i]
            if stack:
                left[i] = places[stack[-1]]
            stack.append(i)
        for i in range(count):
            low = max(left[i] + 1, places[i] - width + 1, 0)
            high = min(places[i], right[i] - width, windows - 1)
            if low <= high:
                anchors.append(values[i])
                lows.append(at + low)
                highs.append(at + high)
    return np.array(anchors, np.uint64), np.array(lows, np.int32), np.array(highs, np.int32)


def by_anchor(anchors: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[list[int], list[list[int]], list[list[int]]]:
    """The runs of a text under its distinct anchors; a text that repeats itself has few of these."""
    found: dict[int, tuple[list[int], list[int]]] = {}
    for a, low, high in zip(anchors.view(np.int64).tolist(), lows.tolist(), highs.tolist(), strict=True):
        held = found.setdefault(a, ([], []))
        held[0].append(low)
        held[1].append(high)
    return list(found), [x for x, _ in found.values()], [x for _, x in found.values()]


def chosen_runs(data: bytes, passage: int = PASSAGE, run: int = RUN) -> tuple[np.ndarray, int]:
    """Hashes (the first 8 bytes of MD5) of the runs of words that are chosen at one place of the text, and how many
    others are chosen. Words are divided by ASCII white space."""
    words = data.split()
    n, width = len(words), passage - run + 1
    if n < passage:
        return np.empty(0, np.uint64), 0
    # of the places of a passage that a run can begin at, the one with the least word, the first of equals
    places: list[int] = []
    least: deque[int] = deque()
    for i in range(n - run + 1):
        word = words[i]
        while least and words[least[-1]] > word:
            least.pop()
        least.append(i)
        if least[0] <= i - width:
            least.popleft()
        if i >= width - 1 and (not places or places[-1] != least[0]):
            places.append(least[0])
    heads = b"".join([hashlib.md5(b" ".join(words[p : p + run])).digest()[:8] for p in places])
    values, times = np.unique(np.frombuffer(heads, ">u8").astype(np.uint64), return_counts=True)
    return values[times == 1], int((times > 1).sum())


def _stretches(flags: np.ndarray) -> list[tuple[int, int]]:
    """[first, last] of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def repeated_windows(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment, which of its window starts have an equal window elsewhere in the segments."""
    sizes = np.array([len(s) for s in segments])
    text = np.frombuffer(b"\0".join(segments), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    room = np.zeros(len(text), np.int64)
    symbols = text.astype(np.int64) + 1
    for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        room[a : a + n] = np.arange(n, 0, -1)
    symbols[starts[1:] - 1] = 0  # between segments; differs from every byte
    prefix, before = common_prefixes(text, suffix_array(symbols, 257), room, length)
    same = prefix >= length
    same[before[same]] = True
    return [same[a : a + n - length + 1] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


class _Shard:
    """Segments of whole groups (anchor, salt) up to about SHARD bytes, then solved together."""

    def __init__(self, length: int):
        self.length = length
        self.segments: list[bytes] = []
        self.owners: list[list[tuple[bytes, int]]] = []
        self.salted: list[bool] = []
        self.size = 0

    def add(self, group: dict[bytes, list[tuple[bytes, int]]], salted: bool) -> None:
        if len(group) == 1 and not salted and len(next(iter(group.values()))) == 1:
            return
        for segment, owners in group.items():
            self.segments.append(segment)
            self.owners.append(owners)
            self.salted.append(salted)
            self.size += len(segment)

    def solve(self) -> Iterator[tuple[bytes | None, int, int, int | None, int | None]]:
        """(text, begin, end, None, None) of what is covered; (text or None, start, 0, two halves of the hash) of windows
        left to settle."""
        if not self.segments:
            return
        length = self.length
        for segment, owners, salted, same in zip(self.segments, self.owners, self.salted, repeated_windows(self.segments, length), strict=True):
            if len(owners) > 1:
                same = np.ones(len(same), bool)
            for a, b in _stretches(same):
                for text, at in owners:
                    yield text, at + a, at + b + length, None, None
            if salted:
                halves = (window_hashes(np.frombuffer(segment, np.uint8), length, half).view(np.int64).tolist() for half in (0, 1))
                text, at = owners[0]
                for i, (h, g, settled) in enumerate(zip(*halves, same.tolist(), strict=True)):
                    yield None if settled else text, at + i, 0, h, g


def _settle(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            told: set[tuple[int, int]] = set()  # of settled windows one of each kind is enough
            kept = []
            for r in rows:
                if r[0] is None:
                    if r[3:] in told:
                        continue
                    told.add(r[3:])
                kept.append(r)
            columns = list(zip(*kept, strict=True)) if kept else [[], [], [], [], []]
            types = (pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["key", "begin", "end", "window", "other"])

        shard, group, current, salted = _Shard(length), {}, None, False
        for batch in batches:
            columns = [batch.column(n) for n in ("anchor", "salt", "salts", "segment", "key", "starts")]
            for anchor, salt, salts, segment, key, starts in zip(*[c.to_pylist() for c in columns], strict=True):
                if (anchor, salt) != current:
                    shard.add(group, salted)
                    if shard.size > SHARD:
                        yield out(shard.solve())
                        shard = _Shard(length)
                    group, current, salted = {}, (anchor, salt), salts > 1
                group.setdefault(segment, []).extend((key, s) for s in starts)
        shard.add(group, salted)
        yield out(shard.solve())

    return run


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, chunk: int = 2000, keep_text: bool = False) -> DataFrame:
    """Per row: ``id_col``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256``,
    ``n_shared_runs`` and, with ``keep_text``, ``kept`` (binary: the remaining bytes)."""
    source = narrow(df, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    id_type = source.schema["id"].dataType.simpleString()

    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, digests, anchors, lows, highs, runs, twice = [], [], [], [], [], [], [], []
            for value in batch.column("text"):
                data = value.as_py().encode()
                a, b, c = by_anchor(*window_runs(data, length))
                n.append(len(data))
                keys.append(hashlib.md5(data).digest())
                digests.append(hashlib.sha256(data).hexdigest())
                anchors.append(a)
                lows.append(b)
                highs.append(c)
                once, again = chosen_runs(data)
                runs.append(once.view(np.int64))
                twice.append(again)
            places = pa.list_(pa.list_(pa.int32()))
            arrays = [batch.column("id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(digests), pa.array(anchors, pa.list_(pa.int64())), pa.array(lows, places), pa.array(highs, places), pa.array(runs, pa.list_(pa.int64())), pa.array(twice, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "key", "digest", "anchor", "low", "high", "runs", "twice"])

    told = materialise(source.mapInArrow(anchor, f"id {id_type}, n long, key binary, digest string, anchor array<long>, low array<array<int>>, high array<array<int>>, runs array<long>, twice int"), "runs")
    copies = materialise(told.groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("one")), "copies")

    # the chosen runs that one text alone has; a text goes by a hash here, and by its key and that where it is told
    text = F.xxhash64("key")
    owned = told.select(text.alias("text"), F.explode("runs").alias("run")).groupBy("run").agg(F.min("text").alias("text"), F.max("text").alias("last")).where("text = last")
    owned = materialise(owned.groupBy("text").agg(F.count("*").alias("owned")), "owned")

    # the runs of windows of one of each text, and the anchors that occur more than once
    single = told.select("id", "key", "anchor", "low", "high").join(copies, "key").where(F.col("id").eqNullSafe(F.col("one"))).dropDuplicates(["key"])
    runs = single.select("key", "id", F.inline(F.arrays_zip("anchor", "low", "high")))
    often = runs.groupBy("anchor").agg(F.sum(F.size("low")).alias("times")).where("times > 1")
    salts = often.select("anchor", F.ceil(F.col("times") / chunk).cast("int").alias("salts"))
    hits = runs.join(salts, "anchor").groupBy("key", "id").agg(F.collect_list(F.struct("anchor", "low", "high", "salts")).alias("hits"))
    texts = source.withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    joined = texts.join(hits.select(F.col("key"), F.col("id").alias("one"), "hits"), "key").where(F.col("id").eqNullSafe(F.col("one")))
    texts = materialise(joined.select("key", "text", "hits"), "texts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, hits in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("hits"), strict=True):
                data = text.as_py().encode()
                found: dict[tuple, list[int]] = {}
                for h in hits.as_py():
                    for low, high in zip(h["low"], h["high"], strict=True):
                        found.setdefault((h["anchor"], h["salts"], data[low : high + length]), []).append(low)
                salt = xxhash.xxh3_64_intdigest(key)
                anchors, salts, segments = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors, pa.int64()), pa.array([salt % s for s in salts], pa.int32()), pa.array(salts, pa.int32()), pa.array(segments, pa.binary()), pa.array([key] * len(segments), pa.binary()), pa.array(list(found.values()), pa.list_(pa.int32()))],
                    ["anchor", "salt", "salts", "segment", "key", "starts"],
                )

    # a row that stands twice, id and all, would give its runs twice; only then the texts are dealt once more
    if told.groupBy("key", "id").count().where("count > 1").limit(1).count():
        texts = materialise(texts.dropDuplicates(["key"]), "texts")
    segments = texts.mapInArrow(cut, "anchor long, salt int, salts int, segment binary, key binary, starts array<int>")
    settled = segments.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(_settle(length), "key binary, begin int, end int, window long, other long")
    settled = materialise(settled, "settled")
    open_ = settled.where("window is not null").select("key", "begin", "window", "other")
    again = open_.groupBy("window", "other").agg(F.count("*").alias("times")).where("times > 1").select("window", "other")
    later = open_.where("key is not null").join(again, ["window", "other"], "left_semi").select("key", "begin", (F.col("begin") + length).alias("end"))
    spans = settled.where("window is null").select("key", "begin", "end").unionAll(later)
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, counts, digests, kept = [], [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                data, rest, at, gone, count = text.as_py().encode(), [], 0, 0, 0
                begin = end = -1
                for s in [*sorted((x["begin"], x["end"]) for x in spans.as_py()), (len(data) + 1, 0)]:
                    if begin >= 0 and s[0] <= end:
                        end = max(end, s[1])
                        continue
                    if begin >= 0:
                        rest.append(data[at:begin])
                        at, gone, count = end, gone + end - begin, count + 1
                    begin, end = s
                rest.append(data[at:])
                left = b"".join(rest)
                removed.append(gone)
                counts.append(count)
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left if keep_text else None)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests), pa.array(kept, pa.binary())], ["key", "removed", "count", "left", "kept"])

    cuts = texts.select("key", "text").join(spans, "key").mapInArrow(take, "key binary, removed long, count long, left string, kept binary")
    out = told.select("id", "n", "key", "digest", F.size("runs").alias("chosen"), "twice", text.alias("text")).join(copies.where("copies > 1").select("key", "copies"), "key", "left").join(cuts, "key", "left")
    out = out.join(owned, "text", "left")
    if keep_text:
        out = out.join(source.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), F.col("text").cast("binary").alias("whole")).dropDuplicates(["key"]), "key", "left")
    copied = F.coalesce((F.col("copies") > 1) & (F.col("n") >= length), F.lit(False))
    columns = [
        F.col("id").alias(id_col),
        F.col("n").alias("n_bytes"),
        F.when(copied, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, 1).otherwise(F.coalesce("count", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("left", "digest")).alias("kept_sha256"),
    ]
    columns.append((F.col("twice") + F.col("chosen") - F.when(F.col("copies") > 1, 0).otherwise(F.coalesce("owned", F.lit(0)))).cast("long").alias("n_shared_runs"))
    if keep_text:
        columns.append(F.when(copied, F.lit(b"")).otherwise(F.coalesce("kept", "whole")).alias("kept"))
    return out.select(*columns)
