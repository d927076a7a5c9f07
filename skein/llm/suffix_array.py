"""Suffix arrays by induced sorting, and permuted common prefixes.

The suffix array of bytes is made in linear time: suffixes are classified as smaller (S) or larger (L) than the next
one, the leftmost-smaller (LMS) substrings are named in their order, the string of names is sorted recursively where
names repeat, and all other suffixes are induced from the sorted LMS suffixes. The byte level works on whole buckets
with numpy, one pass per symbol; on the shorter strings of names, whose alphabets are large, the scans are plain loops.
"""

from __future__ import annotations

import numpy as np


def classify(s: np.ndarray) -> np.ndarray:
    """True where a suffix is of type S. The last suffix is followed by an end smaller than all, so it is of type L."""
    n = len(s)
    step = np.empty(n, np.int8)
    step[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1])
    step[-1] = -1
    source = np.where(step != 0, np.arange(n), n)
    source = np.minimum.accumulate(source[::-1])[::-1]  # the next place where the symbol changes
    return step[source] > 0


def lms_positions(smaller: np.ndarray) -> np.ndarray:
    return np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1


def name_lms(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """The rank of each LMS substring among them (equal ones share it), and how many ranks there are.

    A symbol counts with its type, L before S; a substring ends with the symbol that begins the next, so none is a
    proper prefix of another. Symbols are packed into words and ranked word by word, only where that leaves ties.
    """
    n = len(s)
    symbols = (s.astype(np.int64) + 1) << 1 | smaller
    bits = int(symbols.max()).bit_length()
    per = max(1, 62 // bits)
    ends = np.append(lms[1:] + 1, n)  # exclusive
    padded = np.concatenate([symbols, np.zeros(per, np.int64)])
    ranks = np.zeros(len(lms), np.int64)
    open_ = np.arange(len(lms))
    at = 0
    while len(open_):
        word = np.zeros(len(open_), np.int64)
        begin, stop = lms[open_] + at, ends[open_]
        for i in range(per):
            place = np.minimum(begin + i, n)
            word = word << bits | np.where(begin + i < stop, padded[place], 0)
        order = np.lexsort((word, ranks[open_]))
        r, w = ranks[open_][order], word[order]
        new = np.empty(len(order), bool)
        new[0] = True
        new[1:] = (r[1:] != r[:-1]) | (w[1:] != w[:-1])
        first = np.flatnonzero(new)
        group_of_rank = np.append(True, r[1:] != r[:-1])
        base = np.maximum.accumulate(np.where(group_of_rank, np.arange(len(r)), 0))
        # a rank is the number of substrings before it, so that ties can be split later without moving the others
        split = np.repeat(first, np.diff(np.append(first, len(order)))) - base
        ranks[open_[order]] = r + split
        sizes = np.repeat(np.diff(np.append(first, len(order))), np.diff(np.append(first, len(order))))
        at += per
        tied = open_[order[sizes > 1]]
        open_ = np.sort(tied[lms[tied] + at < ends[tied]])
    distinct, names = np.unique(ranks, return_inverse=True)
    return names, len(distinct)


def _induce_bytes(s: np.ndarray, smaller: np.ndarray, sorted_lms: np.ndarray, kinds: int) -> np.ndarray:
    """All suffixes in order, from the LMS suffixes in order; whole buckets at a time."""
    n = len(s)
    seeds_at = s[sorted_lms]
    cuts = np.searchsorted(seeds_at, np.arange(kinds + 1))  # sorted suffixes have sorted first symbols
    larger: list[list[np.ndarray]] = [[] for _ in range(kinds)]

    def deal(out: list[list[np.ndarray]], places: np.ndarray, own: int) -> np.ndarray:
        """Put places into the buckets of their symbols, in their order; returns those of bucket ``own``."""
        symbol = s[places]
        order = np.argsort(symbol, kind="stable")
        places, symbol = places[order], symbol[order]
        bounds = np.append(np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1])), len(symbol)) if len(symbol) else [0]
        mine = places[:0]
        for a, b in zip(bounds[:-1], bounds[1:], strict=False):
            c = int(symbol[a])
            if c == own:
                mine = places[a:b]
            else:
                out[c].append(places[a:b])
        return mine

    empty = np.empty(0, np.int64)
    larger[int(s[n - 1])].append(np.array([n - 1]))  # induced by the end
    l_part: list[np.ndarray] = [empty] * kinds
    for c in range(kinds):
        batch = np.concatenate(larger[c]) if larger[c] else empty
        parts = []
        while len(batch):
            parts.append(batch)
            before = batch[batch > 0] - 1
            batch = deal(larger, before[~smaller[before]], c)
        l_part[c] = np.concatenate(parts) if parts else empty
        seeds = sorted_lms[cuts[c] : cuts[c + 1]]
        before = seeds[seeds > 0] - 1
        deal(larger, before[~smaller[before]], -1)
    # S suffixes from the right, buckets filled from their ends
    less: list[list[np.ndarray]] = [[] for _ in range(kinds)]
    out: list[np.ndarray] = []
    for c in range(kinds - 1, -1, -1):
        batch = np.concatenate(less[c]) if less[c] else empty  # in descending order
        parts = []
        while len(batch):
            parts.append(batch)
            before = batch[batch > 0] - 1
            batch = deal(less, before[smaller[before]], c)
        s_part = np.concatenate(parts) if parts else empty
        down = l_part[c][::-1]
        before = down[down > 0] - 1
        deal(less, before[smaller[before]], -1)
        out.append(s_part)
        out.append(down)
    return np.concatenate(out)[::-1]


def _induce_names(s: list[int], smaller: list[bool], sorted_lms: list[int], kinds: int) -> list[int]:
    """The same by plain scans, for strings of names."""
    n = len(s)
    counts = [0] * (kinds + 1)
    for c in s:
        counts[c + 1] += 1
    for c in range(kinds):
        counts[c + 1] += counts[c]
    heads, tails = counts[:-1], counts[1:]
    sa = [-1] * n
    tail = tails[:]
    for p in reversed(sorted_lms):
        c = s[p]
        tail[c] -= 1
        sa[tail[c]] = p
    c = s[n - 1]
    head = heads[:]
    sa[head[c]] = n - 1
    head[c] += 1
    for i in range(n):
        j = sa[i]
        if j > 0 and not smaller[j - 1]:
            c = s[j - 1]
            sa[head[c]] = j - 1
            head[c] += 1
    tail = tails[:]
    for i in range(n - 1, -1, -1):
        j = sa[i]
        if j > 0 and smaller[j - 1]:
            c = s[j - 1]
            tail[c] -= 1
            sa[tail[c]] = j - 1
    return sa


def suffix_array(s: np.ndarray, kinds: int) -> np.ndarray:
    """The suffix array of integers 0 <= s < kinds."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    smaller = classify(s)
    lms = lms_positions(smaller)
    if len(lms):
        names, distinct = name_lms(s, smaller, lms)
        if distinct < len(lms):
            sorted_lms = lms[suffix_array(names, distinct)]
        else:
            sorted_lms = np.empty_like(lms)
            sorted_lms[names] = lms
    else:
        sorted_lms = lms
    if kinds <= 1024:
        return _induce_bytes(s, smaller, sorted_lms, kinds)
    return np.array(_induce_names(s.tolist(), smaller.tolist(), sorted_lms.tolist(), kinds), np.int64)


def common_prefixes(s: np.ndarray, sa: np.ndarray, room: np.ndarray, cap: int, step: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """The permuted common prefixes, in text order: for each position the length, up to ``cap``, that it has in common
    with the suffix before it in the array, and that suffix's position (-1 at the first).

    ``room`` bounds a comparison at each position. A position has at least its left neighbour's length less one: every
    ``step``-th is compared from nothing, up to ``cap`` + ``step``, the others from what that leaves them.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    limit = np.where(before >= 0, np.minimum(room, room[np.maximum(before, 0)]), 0)
    words = np.frombuffer(s.astype(np.uint8).tobytes() + bytes(16), np.uint8)
    eight = np.lib.stride_tricks.as_strided(words[: n + 8].view(), (n + 1, 8), (1, 1))
    packed = np.ascontiguousarray(eight).view(np.uint64).reshape(-1)
    length = np.zeros(n, np.int64)

    def extend(places: np.ndarray, most: int) -> None:
        at = places
        while len(at):
            have = length[at]
            a, b = np.minimum(at + have, n), np.minimum(before[at] + have, n)
            differ = packed[a] ^ packed[b]
            same = np.where(differ == 0, 8, 0)
            unequal = differ != 0
            low = differ[unequal]
            same[unequal] = (np.log2((low & (~low + np.uint64(1))).astype(np.float64)).astype(np.int64)) >> 3
            length[at] = np.minimum(have + same, np.minimum(limit[at], most))
            at = at[(same == 8) & (length[at] < np.minimum(limit[at], most))]

    sampled = np.arange(0, n, step)
    extend(sampled[before[sampled] >= 0], cap + step)
    rest = np.arange(n)
    length = np.maximum(length, np.repeat(length[sampled], step)[:n] - rest % step)
    length = np.where(before >= 0, np.minimum(length, limit), 0)
    rest = rest[(rest % step != 0) & (length < cap) & (before >= 0) & (limit >= cap)]
    extend(rest, cap)
    return np.minimum(length, cap), before
