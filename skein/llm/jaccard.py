"""N-gram Jaccard join: a size-aware heavy-light join over the word shingles of whole texts.

A document's set has its distinct n-word shingles (64-bit hashes). Equal sets form one class first; the join is
between classes, whose ids are told apart by 128 bits.

Inverted lists, one for each shingle, are made in ranges of the hash. The first range is listed for all classes. What
of it only one class has cannot be in an overlap, and a class with more of that than a link may lack, n - ceil(t n)
shingles, links with nothing and is through. The other ranges are listed for the remaining classes only, mostly those
that do have near copies. There the lists' lengths are known, the same test is made once more over all ranges, and each
set is put in order, its shingles of the shortest lists first.

Heavy: linked sets share one at least of their first n - ceil(t n) + 1 shingles in that order. Hence a set scans the
lists of those only, and of those the lists of shingles that it has alone are not even there.

Light: of two small sets with sizes a <= b that link, the overlap is at least o(a, b), so they share a subset of
exactly that size. All such subsets are enumerated under the key (a, b, subset). Sets of either size that meet there
overlap enough by themselves, so a bucket's links are a star around a member of size a, with none left out.

The boundary between the two is the size from which on scanning lists, by the measured lengths of the lists that the
sets of each size are in, costs less than the enumeration of subsets.

Lists become edges to a pivot of each list, which are verified on the whole sets. Pairs of a list that are not in one
component afterwards are found through their differences from that pivot, which are small, and verified in turn, so a
group of n near copies costs about n verifications and no link is lost. Nothing is capped or sampled. Hot keys: lengths
and pivots of lists are aggregated partially before their shuffle, the joins are plain equi-joins, whose long lists
adaptive execution splits; the driver holds 64 rows of sizes and nothing is broadcast by name.

Defined results: a text with fewer words than n has one shingle, all its words; a null text or one without words has
the empty set and no links; a null id takes no part and has no component; repeated rows are one class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, narrow
from .components import components

#: Sizes that can be light; far above where enumeration still pays.
LIGHT_LIMIT = 64
#: Orders in which the pivot of a list is picked, so that a set meets several pivots.
ORDERS = 4
MEMO_ENTRIES = 300_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose output bits depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO_ENTRIES and len(word) <= 64:
            self[word] = h
        return h


_hashes = _WordHashes()


def shingles(text: str | None, words: int) -> np.ndarray:
    """The set, sorted; A-Z are lower-cased, words are divided by ASCII white space."""
    parts = text.encode().lower().split() if text else []
    n = len(parts)
    if not n:
        return np.empty(0, np.uint64)
    if n < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(parts))], np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, parts), np.uint64, n)
    total = np.zeros(n - words + 1, np.uint64)
    for i in range(words):
        total = mixed(total + h[i : n - words + 1 + i])
    return np.unique(total)


@dataclass(frozen=True)
class Similarity:
    """J >= num / den, in integers."""

    num: int
    den: int

    def difference(self, total: int) -> int:
        """The largest symmetric difference of two linked sets with ``total`` elements together."""
        return total * (self.den - self.num) // (self.den + self.num)

    def overlap(self, total: int) -> int:
        """The least overlap of two linked sets with ``total`` elements together."""
        return -(-total * self.num // (self.den + self.num))

    def least(self, size: int) -> int:
        return -(-size * self.num // self.den)

    def most(self, size: int) -> int:
        return size * self.den // self.num


def subset_keys(size: int, t: Similarity, boundary: int) -> list[tuple[int, int, int]]:
    """(a, b, subset size) for each pair of light sizes a <= b that a set of this size is in."""
    out = []
    for other in range(t.least(size), min(t.most(size), boundary - 1) + 1):
        a, b = min(size, other), max(size, other)
        o = t.overlap(a + b)
        if o <= a:
            out.append((a, b, o))
    return out


def choose_boundary(sizes: dict[int, tuple[int, int]], t: Similarity) -> int:
    """The size from which on sets are heavy, by ``sizes``: size -> (sets, entries of the lists that these scan). The
    least sum of subsets enumerated below it and of list entries above."""

    def light(a: int) -> int:
        return sum(comb(a, o) for _, _, o in subset_keys(a, t, LIGHT_LIMIT))

    best, at, below, above = math.inf, 2, 0, sum(scanned for _, scanned in sizes.values())
    for x in range(2, LIGHT_LIMIT + 1):
        if below + above < best:
            best, at = below + above, x
        sets, scanned = sizes.get(x, (0, 0))
        below += sets * light(x)
        above -= scanned
    return at


def class_of(found: np.ndarray) -> tuple[int, int]:
    """Two hashes of the whole set, of 64 bits each."""
    h = xxhash.xxh3_128_intdigest(found.tobytes(), seed=len(found))
    return (h & (1 << 64) - 1) - (1 << 63), (h >> 64) - (1 << 63)


def first_range(t: Similarity) -> np.uint64:
    """The upper end of the first range of shingle hashes. Sets whose own shingles are a share f of all are through
    after it if f times the range's share is over 1 - t."""
    share = min(1.0, 0.2 + 0.5 * (t.den - t.num) / t.den)
    return np.uint64(int(share * ((1 << 64) - 1)))


#: Kinds of a list entry: of a shingle's list; of a subset's, of a set with the pair's smaller size, or with its larger.
HEAVY, LIGHT_LESS, LIGHT_MORE = 0, 1, 2


def light_entries(found: np.ndarray, t: Similarity, boundary: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the subsets that a light set is enumerated under, and their kinds."""
    n = len(found)
    keys, kinds = [np.empty(0, np.uint64)], [np.empty(0, np.int8)]
    values = mixed(found)
    for a, b, o in subset_keys(n, t, boundary):
        chosen = np.fromiter((i for c in combinations(range(n), o) for i in c), np.int64).reshape(-1, o)
        salt = np.uint64(a << 40 | b << 20 | o)
        keys.append(mixed(values[chosen].sum(1, dtype=np.uint64) ^ mixed(np.array([salt]))))
        kinds.append(np.full(len(chosen), LIGHT_LESS if n == a else LIGHT_MORE, np.int8))
    return np.concatenate(keys), np.concatenate(kinds)


def _per_text(df: DataFrame, schema: str, rows_of) -> DataFrame:
    """mapInArrow with ``rows_of(ids, texts, told)`` -> RecordBatch for stretches of a batch, to bound memory; ``told``
    is a set of the task's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            for at in range(0, len(ids), 1024):
                yield rows_of(ids.slice(at, 1024), [x.as_py() for x in texts.slice(at, 1024)], told)

    return df.mapInArrow(run, schema)


def _apart(told: DataFrame) -> DataFrame:
    """``told`` with another ``class`` for rows that share theirs with other sets, which ``check`` tells. At 64 bits
    this concerns a few hundred classes of 10^11."""
    shared = told.groupBy("class").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high").select("class", "low")
    if not shared.limit(1).count():
        return told
    other = F.col("low").isNotNull() & (F.col("check") != F.col("low"))
    moved = told.join(shared, "class", "left").withColumn("class", F.when(other, F.xxhash64("class", "check")).otherwise(F.col("class")))
    moved = materialise(moved.select(told.columns), "sizes")
    discard(told)
    return _apart(moved)


def _linked(edges: DataFrame, sets: DataFrame, t: Similarity) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are similar enough."""
    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("of_b"))
    pairs = edges.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - F.col("common")
    return pairs.withColumn("common", common).where(F.col("common") * t.den >= union * t.num).select("a", "b")


def jaccard_components(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per row: ``id_col``, ``n_shingles`` and ``component_id``, the smallest id reachable by links J >= num / den."""
    t = Similarity(num, den)
    source = narrow(df, id=id_col, text=text_col)
    id_type = source.schema["id"].dataType.simpleString()
    limit = first_range(t)

    def sized(ids, texts, told):
        found = [shingles(x, words) for x in texts]
        hashes = [class_of(f) for f in found]
        parts = []
        for f, h, sound in zip(found, hashes, ids.is_valid().to_pylist(), strict=True):
            once = sound and len(f) and h not in told  # a class posts once in a task
            if once:
                told.add(h)
            parts.append(f[: np.searchsorted(f, limit, side="right")].view(np.int64) if once else None)
        keys = pa.array([h for h, _ in hashes], pa.int64())
        return pa.RecordBatch.from_arrays([ids, pa.array([len(f) for f in found], pa.int64()), keys, keys, pa.array([h for _, h in hashes], pa.int64()), pa.array(parts, pa.list_(pa.int64()))], ["id", "n", "class", "key", "check", "part"])

    wide = _apart(materialise(_per_text(source, f"id {id_type}, n long, class long, key long, check long, part array<long>", sized), "sizes"))
    least = F.expr(f"cast((n * {num} + {den - 1}) div {den} as int)")  # of an overlap, whatever the other set's size
    open_ = _open(wide, least)
    told = materialise(wide.select("id", "n", "class"), "told")
    discard(wide)
    sets = _whole_sets(open_, source, words)
    discard(open_)
    lists = _lists(sets, least)

    lengths = lists.groupBy("list").agg(F.count("*").alias("length"))
    small = lists.where(F.col("n") < LIGHT_LIMIT).join(lengths, "list").groupBy("n").agg(F.countDistinct("class").alias("sets"), F.sum("length").alias("scanned"))
    boundary = choose_boundary({r["n"]: (r["sets"], r["scanned"]) for r in small.collect()}, t)  # 64 rows at most

    def enumerated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [light_entries(np.array(x.as_py(), np.int64).view(np.uint64), t, boundary) for x in part.column("shingles")]
                owners = np.repeat(part.column("class").to_numpy(), [len(k) for k, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k for k, _ in found]).view(np.int64)), pa.array(owners), pa.array(np.concatenate([k for _, k in found]))], ["list", "class", "kind"])

    open_light = lists.where(F.col("n") < boundary).select("class").distinct()
    light = sets.where(F.col("n") < boundary).join(open_light, "class", "left_semi").select("class", "shingles").mapInArrow(enumerated, "list long, class long, kind byte")
    heavy = lists.where(F.col("n") * den >= boundary * num).select("list", "class", F.lit(HEAVY).cast("byte").alias("kind"))
    # the kind sets subsets apart from shingles with the same hash
    entries = materialise(heavy.unionAll(light).select(F.when(F.col("kind") == HEAVY, F.col("list")).otherwise(F.xxhash64("list")).alias("list"), "class", "kind"), "entries")
    order = F.xxhash64(F.pmod("list", F.lit(ORDERS)))
    placed = entries.withColumn("at", F.col("class").bitwiseXOR(order))
    ends = placed.groupBy("list").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.min(F.when(F.col("kind") != LIGHT_MORE, F.col("at"))).alias("pivot"))
    shared = ends.where("first <> last and pivot is not null").select("list", F.col("pivot").bitwiseXOR(order).alias("pivot"))
    members = entries.join(shared, "list").where("pivot <> class")
    members = materialise(members.groupBy("pivot", "class").agg(F.count("*").alias("times"), F.max(F.col("kind") == HEAVY).alias("heavy")), "members")
    edges = members.groupBy(F.least("pivot", "class").alias("a"), F.greatest("pivot", "class").alias("b")).agg(F.sum("times").alias("times"))
    edges = materialise(edges, "edges")

    # first each class against the pivot that it shares most lists with, then what that has not joined
    ends_of = edges.select(F.col("a").alias("class"), F.col("b").alias("to"), "times").unionAll(edges.select(F.col("b").alias("class"), F.col("a").alias("to"), "times"))
    best = ends_of.groupBy("class").agg(F.max_by("to", F.struct("times", F.col("to"))).alias("to"))
    first = best.select(F.least("class", "to").alias("a"), F.greatest("class", "to").alias("b")).distinct()
    first_links = links = materialise(_linked(first, sets, t), "links")
    joined = components(links)
    rest = _across(edges.select("a", "b").join(first, ["a", "b"], "left_anti"), joined)
    more = materialise(_linked(rest, sets, t), "links")
    links = links.unionAll(more)
    joined = components(links) if more.limit(1).count() else joined

    # pairs of a list that are in different components yet, neither being its pivot
    star = members.where("heavy").select("pivot", "class")
    meeting, used = _meeting(star, joined, sets, t)
    # those that share a difference first go against one of them, so that groups do not meet in all pairs
    centres = meeting.groupBy("pivot", "shingle").agg(F.min("class").alias("centre"))
    near = meeting.join(centres, ["pivot", "shingle"]).where("class <> centre").select(F.least("class", "centre").alias("a"), F.greatest("class", "centre").alias("b")).distinct()
    around = materialise(_linked(_across(near.join(edges.select("a", "b"), ["a", "b"], "left_anti"), joined), sets, t), "links")
    if around.limit(1).count():
        links = links.unionAll(around)
        joined = components(links)
    left = _pairs(meeting.drop("component").join(joined.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class")), t)
    last = materialise(_linked(left.join(edges.select("a", "b"), ["a", "b"], "left_anti"), sets, t), "links")
    if last.limit(1).count():
        joined = components(links.unionAll(last))

    for consumed in (sets, lists, entries, members, edges, first_links, more, around, last, *used):
        discard(consumed)
    # a row for each class, then for each group; both are tables by the time that they are joined by keys which many
    # classes of a group and many rows of a class share, so that those joins can be split
    named = told.where("id is not null and n > 0").groupBy("class").agg(F.min("id").alias("id")).join(joined.withColumnRenamed("node", "class"), "class", "left")
    named = materialise(named.select("class", "id", F.coalesce("component", "class").alias("group")), "named")
    firsts = materialise(named.groupBy("group").agg(F.min("id").alias("component_id")), "firsts")
    of_class = materialise(named.join(firsts, "group").select("class", "component_id"), "classes")
    discard(named)
    discard(firsts)
    linked = told.where("n > 0").select("id", "n", "class").join(of_class, "class", "left").select("id", "n", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
    alone = told.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return linked.unionAll(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _open(told: DataFrame, least: Column) -> DataFrame:
    """(class, id, n, key, check) of the classes that may have a link by the first range of lists."""
    classes = told.where("id is not null and n > 0").groupBy("class").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.max("key").alias("key"), F.max("check").alias("check"))
    # a class may post from several tasks: a list with one class is its own, however often that has posted
    first = told.where("part is not null").select("class", F.explode("part").alias("list"))
    own = first.groupBy("list").agg(F.min("class").alias("class"), F.max("class").alias("last")).where("class = last").groupBy("class").agg(F.count("*").alias("own"))
    return materialise(classes.join(own, "class", "left").where(F.coalesce("own", F.lit(0)) <= F.col("n") - least).drop("own"), "open")


def _whole_sets(open_: DataFrame, source: DataFrame, words: int) -> DataFrame:
    """(class, n, shingles) of these classes, from one document each."""

    def whole(ids, texts, _):
        found = [shingles(x, words) for x in texts]
        hashes = [class_of(f) for f in found]
        return pa.RecordBatch.from_arrays([pa.array([h for h, _ in hashes], pa.int64()), pa.array([h for _, h in hashes], pa.int64()), pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))], ["key", "check", "shingles"])

    texts = source.join(open_.select("id").distinct(), "id", "left_semi")
    sets = _per_text(texts, "key long, check long, shingles array<long>", whole)
    return materialise(sets.join(open_.select("key", "check", "class", "n"), ["key", "check"]).dropDuplicates(["key", "check"]).select("class", "n", "shingles"), "sets")


def _lists(sets: DataFrame, least: Column) -> DataFrame:
    """(list, class, n): the prefix that each set scans, in the order of the lists' lengths, if it may still link."""
    each = sets.select("class", "n", F.explode("shingles").alias("list"))
    lengths = each.groupBy("list").agg(F.count("*").alias("length")).where("length > 1")
    ranked = each.join(lengths, "list").groupBy("class", "n").agg(F.array_sort(F.collect_list(F.struct("length", "list"))).alias("ranked"))
    # the first shingles of the order are the set's own, which have no list: n - size of them
    prefix = F.slice("ranked", F.lit(1), F.size("ranked") - least + 1)
    ranked = ranked.where(F.size("ranked") >= least).select("class", "n", F.explode(prefix).alias("at")).select(F.col("at.list").alias("list"), "class", "n")
    return materialise(ranked, "lists")


def _meeting(star: DataFrame, joined: DataFrame, sets: DataFrame, t: Similarity) -> tuple[DataFrame, list[DataFrame]]:
    """Where members around a pivot meet that may link and are in different components: a row for each difference by
    which they can; none that links is left out. With the tables to discard once they are read.

    A member x differs from its pivot in d(x) shingles. Two members' symmetric difference is d(a) + d(b) less twice
    what their differences have in common, so a link needs a common part of at least (d(a) + d(b) - D) / 2; if that is
    nothing, both link with the pivot and are settled. What only one member around the pivot has in its difference,
    u(x) shingles, is in no common part. Hence a link has u(a) + u(b) <= D, and one of the two has u <= D / 2; and as
    many rarest shingles of the other common ones as leave less than the least overlap suffice to meet.
    """
    labels = joined.withColumnRenamed("node", "class")
    at_pivot = joined.select(F.col("node").alias("pivot"), F.col("component").alias("of_pivot"))
    told = star.join(labels, "class", "left").join(at_pivot, "pivot", "left").withColumn("component", F.coalesce("component", "class")).withColumn("of_pivot", F.coalesce("of_pivot", "pivot"))
    ends = told.groupBy("pivot").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    told = told.join(ends.where("low <> high").select("pivot"), "pivot", "left_semi")
    centre = sets.select(F.col("class").alias("pivot"), F.col("shingles").alias("of_centre"))
    own = told.join(sets, "class").join(centre, "pivot")
    diff = F.concat(F.array_except("shingles", "of_centre"), F.array_except("of_centre", "shingles"))
    every = own = materialise(own.select("pivot", "class", "component", F.size("shingles").alias("n"), diff.alias("diff")), "differences")
    most = F.floor((F.col("n") + F.floor(F.col("n") * t.den / t.num)) * (t.den - t.num) / (t.den + t.num))
    own = own.withColumn("d", F.size("diff")).withColumn("most", most)
    # members whose differences are their own already in one half of the hashes need no look at the other half
    half = _common_part(own.withColumn("diff", F.filter("diff", lambda x: x.bitwiseAND(F.lit(1)) == 0)))
    half = own.select("pivot", "class", "most", F.size(F.filter("diff", lambda x: x.bitwiseAND(F.lit(1)) == 0)).alias("all")).join(half, ["pivot", "class"], "left")
    near = half.where(F.col("all") - F.coalesce(F.size("common"), F.lit(0)) <= F.col("most")).select("pivot", "class")
    near_own = own = materialise(own.join(near, ["pivot", "class"], "left_semi"), "differences")
    counts = _common_part(own)
    least = F.greatest(F.lit(1), F.col("d") - F.col("most"))
    held = own.drop("diff").join(counts, ["pivot", "class"]).withColumn("u", F.col("d") - F.size("common")).where("u <= most")
    held = held.withColumn("shared", F.size("common")).withColumn("meet", F.slice("common", F.lit(1), F.greatest(F.lit(0), F.size("common") - least + 1).cast("int"))).drop("common")
    held = materialise(held.select("pivot", "class", "component", "n", "d", "u", (F.col("u") * 2 <= F.col("most")).alias("light"), "shared", F.posexplode("meet.shingle").alias("at", "shingle")).withColumn("left", F.col("shared") - F.col("at")), "meeting")
    return held, [every, near_own, held]


def _pairs(held: DataFrame, t: Similarity) -> DataFrame:
    """The pairs (a, b) that meet in ``_meeting`` and may link, in different components."""
    a = held.where("light").select("pivot", "shingle", F.col("class").alias("a"), F.col("component").alias("of_a"), F.col("n").alias("na"), F.col("d").alias("da"), F.col("u").alias("ua"), F.col("left").alias("la"))
    b = held.select("pivot", "shingle", F.col("class").alias("b"), F.col("component").alias("of_b"), F.col("n").alias("nb"), F.col("d").alias("db"), F.col("u").alias("ub"), F.col("left").alias("lb"), "light")
    limit = F.floor((F.col("na") + F.col("nb")) * (t.den - t.num) / (t.den + t.num))
    may = (F.col("of_a") != F.col("of_b")) & (~F.col("light") | (F.col("a") < F.col("b")))
    may &= (F.col("ua") + F.col("ub") <= limit) & (F.col("da") + 2 * F.col("ub") - F.col("db") <= limit) & (F.col("db") + 2 * F.col("ua") - F.col("da") <= limit)
    # at the first shingle that two have in common, what is left of either has to hold the whole least overlap
    may &= 2 * F.least("la", "lb") >= F.col("da") + F.col("db") - limit
    on = (F.col("pivot") == F.col("centre")) & (F.col("shingle") == F.col("other"))
    met = a.join(b.withColumnRenamed("pivot", "centre").withColumnRenamed("shingle", "other"), on & may)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _common_part(own: DataFrame) -> DataFrame:
    """(pivot, class, common): what a member's difference has in common with other members', rarest first."""
    each = own.select("pivot", "class", F.explode("diff").alias("shingle"))
    often = each.groupBy("pivot", "shingle").agg(F.count("*").alias("times")).where("times > 1")
    return each.join(often, ["pivot", "shingle"]).groupBy("pivot", "class").agg(F.array_sort(F.collect_list(F.struct("times", "shingle"))).alias("common"))


def _across(edges: DataFrame, joined: DataFrame) -> DataFrame:
    """The edges between different components; a class without a component is its own."""
    a = joined.select(F.col("node").alias("a"), F.col("component").alias("of_a"))
    b = joined.select(F.col("node").alias("b"), F.col("component").alias("of_b"))
    both = edges.join(a, "a", "left").join(b, "b", "left")
    return both.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
