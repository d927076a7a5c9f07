"""Byte-pair encoding: token counts by heap merging, and encoding and decoding by a two-tier lookup.

Both operators work on whole texts in Arrow batches. With ``KNOWN``, the pattern of the public tokenizers, a white-space
chunk's result does not depend on its neighbours when single spaces divide the text, so a bounded memo keeps the result
of the method for each chunk; a text with longer runs of white space, and every text under any other pattern, goes
through the splitting pattern as one piece.

Defined results: a null text counts as the empty text (0 tokens, hash of no bytes); rows are never dropped, so
repeated rows and null ids give one result each; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from public_tokenizers import PATTERN as KNOWN
from pyspark.sql import DataFrame

from .common import narrow

#: Entries of a memo; bounds a worker's memory.
MEMO_ENTRIES = 400_000
#: Chunks longer than this are not kept in a memo.
MEMO_CHUNK = 64

_TOUCHING_SPACE = re.compile(r" \s|\s ")


def merge(symbols: list[int], pairs: dict[int, int], base: int, first: int) -> int:
    """Merge adjacent symbols, lowest rank first and leftmost among equals, with a heap over a linked list.

    ``pairs`` has the rank of a mergeable pair under ``left * base + right``; the merged symbol is the rank plus
    ``first`` and stands in the place of the left one, the right one's place gets -1. Returns how many merges were made.
    A merge costs O(log n), whatever the length.
    """
    n, made = len(symbols), 0
    look = pairs.get
    heap = []
    for i in range(n - 1):
        rank = look(symbols[i] * base + symbols[i + 1])
        if rank is not None:
            heap.append(rank << 40 | i)
    if not heap:
        return 0
    heapq.heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        entry = heapq.heappop(heap)
        rank, i = entry >> 40, entry & 0xFFFFFFFFFF
        left = symbols[i]
        j = after[i]
        if left < 0 or j >= n or look(left * base + symbols[j]) != rank:
            continue
        symbols[i] = merged = rank + first
        symbols[j] = -1
        made += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rank = look(merged * base + symbols[k])
            if rank is not None:
                heapq.heappush(heap, rank << 40 | i)
        h = before[i]
        if h >= 0:
            rank = look(symbols[h] * base + merged)
            if rank is not None:
                heapq.heappush(heap, rank << 40 | h)
    return made


class _Memo(dict):
    """Results of ``resolve`` by white-space chunk; a chunk stands for itself with the space before it.

    Full, it keeps what it has, which holds the frequent chunks, and starts anew after as many misses again.
    """

    def __init__(self, resolve: Callable[[str], object]):
        super().__init__()
        self.resolve = resolve
        self.missed = 0

    def __missing__(self, chunk: str):
        value = self.resolve(" " + chunk)
        if len(chunk) <= MEMO_CHUNK:
            if len(self) < MEMO_ENTRIES:
                self[chunk] = value
            else:
                self.missed += 1
                if self.missed > 8 * MEMO_ENTRIES:
                    self.clear()
                    self.missed = 0
        return value


@lru_cache(maxsize=1)
def _same_letters() -> bool:
    """Whether Python and the pattern library, whose tables may be of different Unicode versions, know the same letters."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    return regex.findall(r"\p{L}", every) == [c for c in every if c.isalpha()]


def _split(text: str, pattern) -> list[str] | Iterator[str]:
    """The pre-tokens; under ``KNOWN`` the common shape of a space, letters and at most one ASCII mark needs no
    pattern."""
    if len(text) > 1 and text[0] == " " and pattern.pattern == KNOWN and (text.isascii() or _same_letters()):
        if text[1:].isalpha():
            return [text]
        if text[-1] in ".,;:!?" and text[1:-1].isalpha():
            return [text[:-1], text[-1]]
    return (m.group() for m in pattern.finditer(text))


def _chunks(text: str) -> tuple[str, list[str]]:
    """The head to resolve as it stands, and the chunks that each follow a space."""
    if _TOUCHING_SPACE.search(text) or text[:1] == " " or text[-1:] == " ":
        return text, []
    first, *rest = text.split(" ")
    return first, rest


# ---------------------------------------------------------------- token counts


class TokenCounter:
    """Counts tokens as a byte-level BPE file of the ``tokenizers`` library gives them.

    The count of a pre-token is its initial symbols minus the merges made; no identifiers are produced. Added
    special tokens inside a text count one each, as is that library's default.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        printed = byte_alphabet()
        vocabulary = model["vocab"]
        self.base = 1 + max(vocabulary.values())
        self.initial = [vocabulary[printed[b]] for b in range(256)]
        self.pairs, joined = {}, []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocabulary[left] * self.base + vocabulary[right]] = rank
            joined.append(vocabulary[left + right])
        self.first = joined[0] if joined else 0
        if joined != list(range(self.first, self.first + len(joined))):
            raise ValueError("the merged symbols are not numbered in the order of their ranks")
        special = sorted((t["content"] for t in spec.get("added_tokens", []) if t["content"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.split = regex.compile(pattern)
        self.memo = _Memo(self._pieces)

    def _pieces(self, text: str) -> int:
        return sum(self.of_piece(piece.encode()) for piece in _split(text, self.split))

    def of_piece(self, piece: bytes) -> int:
        """Initial symbols minus merges."""
        initial = self.initial
        return len(piece) - merge([initial[b] for b in piece], self.pairs, self.base, self.first)

    def _plain(self, text: str) -> int:
        head, rest = _chunks(text) if self.split.pattern == KNOWN else (text, [])
        return (self._pieces(head) if head else 0) + sum(map(self.memo.__getitem__, rest))

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or self.special.search(text) is None:
            return self._plain(text)
        total, at = 0, 0
        for m in self.special.finditer(text):
            total += self._plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self._plain(text[at:])


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level BPE file: printable Latin-1 stands for
    itself, the other bytes follow from U+0100 on."""
    # fixed values of the file format
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def _counter(path: str, pattern: str) -> TokenCounter:
    return TokenCounter(path, pattern)


def token_counts(df: DataFrame, tokenizer_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Per row: ``id_col``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more tokens than ``limit``).

    Narrow: one pass over the two columns, no shuffle. The vocabulary file is read on each worker from
    ``tokenizer_path``, once per process.
    """
    source = narrow(df, id=id_col, text=text_col)
    id_type = source.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _counter(tokenizer_path, pattern)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for value in batch.column("text"):
                text = value.as_py()
                n_bytes.append(len(text.encode()) if text else 0)
                n_tokens.append(of(text))
            tokens = pa.array(n_tokens, pa.int64())
            over = pa.array([x > limit for x in n_tokens], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_bytes, pa.int64()), tokens, over], ["id", "n_bytes", "n_tokens", "over_limit"])

    return source.mapInArrow(count, f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


# ------------------------------------------------------- encoding and decoding


class PerfectHash:
    """A minimal perfect hash over byte strings: hash and displace.

    Keys fall into buckets; buckets are placed from the largest, each with the first displacement that puts its
    keys into free slots. Buckets of one key take a free slot directly, stored as a negative displacement. There
    are exactly as many slots as keys; a slot's key is compared, so that strings outside the set are refused.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        n = self.n = len(keys)
        self.n_buckets = max(1, n // 3)
        buckets: dict[int, list[int]] = {}
        hashes = [xxhash.xxh3_128_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            buckets.setdefault((h >> 64) % self.n_buckets, []).append(i)
        self.displacement = np.zeros(self.n_buckets, np.int64)
        slots = np.full(n, -1, np.int64)
        order = sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0]))
        at = 0
        for at, (bucket, members) in enumerate(order):
            if len(members) == 1:
                break
            d = 0
            while True:
                places = {self._place(hashes[i], d) for i in members}
                if len(places) == len(members) and all(slots[p] < 0 for p in places):
                    break
                d += 1
            for i in members:
                slots[self._place(hashes[i], d)] = i
            self.displacement[bucket] = d
        free = iter(np.flatnonzero(slots < 0).tolist())
        for bucket, members in order[at:]:
            if len(members) == 1:
                p = next(free)
                slots[p] = members[0]
                self.displacement[bucket] = -p - 1
        self.keys = [keys[i] for i in slots]
        self.values = [values[i] for i in slots]
        self.displacement = self.displacement.tolist()

    def _place(self, h: int, d: int) -> int:
        low, high = h & 0xFFFFFFFF, h >> 32 & 0xFFFFFFFF
        return (low + d * (high | 1)) % self.n

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        h = xxhash.xxh3_128_intdigest(key)
        d = self.displacement[(h >> 64) % self.n_buckets]
        p = -d - 1 if d < 0 else self._place(h, d)
        return self.values[p] if self.keys[p] == key else None


class ByteBPE:
    """Encodes and decodes by a rank file: base64 of the token's bytes and its rank on each line."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        tokens = [base64.b64decode(a) for a, _ in pairs]
        ids = [int(b) for _, b in pairs]
        self.whole = PerfectHash(tokens, ids)
        self.bytes_of = dict(zip(ids, tokens, strict=True))
        self.base = 1 + max(ids)
        id_of = dict(zip(tokens, ids, strict=True))
        self.initial = [id_of[bytes([b])] for b in range(256)]
        self.pairs = {}
        for token, rank in id_of.items():
            for cut in range(1, len(token)):
                left, right = id_of.get(token[:cut]), id_of.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left * self.base + right] = rank
        self.split = regex.compile(pattern)
        self.memo = _Memo(self._pieces)

    def of_piece(self, piece: bytes) -> list[int]:
        """First tier: the piece is a token. Second tier: heap merging over its linked bytes."""
        whole = self.whole.get(piece)
        if whole is not None:
            return [whole]
        initial = self.initial
        symbols = [initial[b] for b in piece]
        merge(symbols, self.pairs, self.base, 0)
        return [s for s in symbols if s >= 0]

    def _pieces(self, text: str) -> bytes:
        ids: list[int] = []
        for piece in _split(text, self.split):
            ids.extend(self.of_piece(piece.encode()))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        head, rest = _chunks(text) if self.split.pattern == KNOWN else (text, [])
        return (self._pieces(head) if head else b"") + b"".join(map(self.memo.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def _codec(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def bpe_encode(df: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Per row: ``id_col``, ``ids`` (array of int, unless ``keep_ids`` is false), ``n_tokens``, ``ids_sha256`` and
    ``decoded_sha256``: the decoded bytes come from the ids, not from the text.

    Narrow: one pass, no shuffle. Digests are lowercase hex of the ids as little-endian unsigned 32-bit integers and
    of the decoded bytes.
    """
    source = narrow(df, id=id_col, text=text_col)
    id_type = source.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, " + "ids array<int>, " * keep_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path, pattern)
        for batch in batches:
            ids, counts, first, second = [], [], [], []
            for value in batch.column("text"):
                coded = codec.encode(value.as_py())
                counts.append(len(coded) // 4)
                first.append(hashlib.sha256(coded).hexdigest())
                second.append(hashlib.sha256(codec.decode(coded)).hexdigest())
                if keep_ids:
                    ids.append(np.frombuffer(coded, "<u4").astype(np.int32))
            columns = [batch.column("id"), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.insert(1, pa.array(ids, pa.list_(pa.int32())))
                names.insert(1, "ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(encode, schema).withColumnRenamed("id", id_col)


def bpe_decode(df: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: ``id_col`` and ``text``, the decoded ids; null ids give null, bytes that are not UTF-8 are replaced."""
    source = narrow(df, id=id_col, ids=ids_col)
    id_type = source.schema["id"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path, pattern)
        for batch in batches:
            texts = []
            for value in batch.column("ids"):
                ids = value.as_py()
                texts.append(None if ids is None else b"".join(codec.bytes_of[i] for i in ids).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    return source.mapInArrow(decode, f"id {id_type}, text string").withColumnRenamed("id", id_col)
