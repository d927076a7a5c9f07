"""Exact top-k search by inner product with a pivot-distance index.

Components become integers, floor(``scale`` * x). A vector x is given one more coordinate, sqrt(R^2 - |x|^2) with R
the greatest norm, a query q gets 0; then |q - x|^2 = |q|^2 + R^2 - 2 <q, x>, so the highest products are the nearest
points. The index keys each vector by its nearest pivot and its distance to it. A query that has a k-th best score t
needs to look within the radius r = sqrt(|q|^2 + R^2 - 2t) only, and by the triangle inequality only at those annuli
whose distance to the pivot is within r of the query's own.

The index is cut into parts: annuli of a pivot, of up to ``part_bytes`` of vectors; one that has more (a vector that is
very common) is dealt out by a salt. A search sends each query to the parts that it needs, by one exchange in which a
part's rows come first, sorted by distance, then its queries, sorted by theirs. A part is expanded from each query's own
distance outwards and stops, on either side, where the bound does. Every part gives the k best of each query at most,
and these meet once more. A first search visits the annuli around each query's own distance to its own pivot only, which
gives it a t that holds everywhere; the second visits all parts within that bound. Nothing but the pivots, the extents
of the annuli (pivots x ``annuli`` rows at most) and the bounded sample that pivots are chosen from (``sample``) reaches
the driver; all rows are indexed.

Scores are exact: products that 53 bits hold are made in floating point, those that 63 bits hold in integers, others in
Python's. The bounds carry a slack against rounding, so that ties are never lost.

Defined results: vectors that are null, hold a null or a non-finite component, or have no id take no part; shorter
vectors are filled up with zeros; components beyond a long count as its nearest end, and so do scores, which rank by
that; rows with the query's id are not its candidates; repeated rows are candidates each; of several rows with a query's
id the least vector asks; a query with fewer than k candidates gets all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, narrow

#: Rows of a part that are compared at once, and queries.
ROWS, QUERIES = 1024, 1024
_LONG = np.iinfo(np.int64)


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> tuple[DataFrame, int]:
    """(id, vec array<long>) of the rows that take part, all of one length, and that length."""
    source = narrow(df, id=id_col, vec=vec_col).where("id is not null and vec is not null")
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform("vec", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = source.where(F.coalesce(sound, F.lit(False))).select(F.col("id").cast("long").alias("id"), whole.alias("vec"))
    width = rows.agg(F.max(F.size("vec"))).head()[0] or 0
    return rows.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("vec")))), width


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(np.int64, copy=False)


def _augmented(x: np.ndarray, square: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(square - (x * x).sum(1), 0))])


def choose_pivots(sample: np.ndarray, n: int, rounds: int = 5, seed: int = 3) -> np.ndarray:
    """Centres of a few rounds of k-means over the sample."""
    r = np.random.default_rng(seed)
    centres = sample[r.choice(len(sample), min(n, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        nearest = _distances(sample, centres).argmin(1)
        for i in range(len(centres)):
            if (nearest == i).any():
                centres[i] = sample[nearest == i].mean(0)
    return centres


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T), 0))


def products(x: np.ndarray, y: np.ndarray, greatest: int) -> np.ndarray:
    """The inner products of integer rows as longs, exact; ``greatest``: no component is beyond. Past a long: its end."""
    most = max(1, x.shape[1]) * greatest * greatest
    if most < 1 << 53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    if most <= _LONG.max:
        return x @ y.T
    exact = x.astype(object) @ y.astype(object).T
    return np.clip(exact, _LONG.min, _LONG.max).astype(np.int64)


class Part:
    """The rows of a part in the order of their distance to its pivot."""

    def __init__(self, distance: np.ndarray, ids: np.ndarray, vectors: np.ndarray, square: float, greatest: int):
        self.distance, self.ids, self.vectors, self.square, self.greatest = distance, ids, vectors, square, greatest
        self.stretches = -(-len(ids) // ROWS)

    def best(self, qid: np.ndarray, query: np.ndarray, distance: np.ndarray, bound: np.ndarray, bounded: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
        """(query id, id, score) of the k best at most for queries sorted by their distance to the pivot; ``bound`` is
        a score that k rows reach, where ``bounded``."""
        held: list[list[tuple[int, int]]] = [[] for _ in qid]
        norms = (query.astype(np.float64) ** 2).sum(1)
        reach = norms + self.square + 1e-6 * (1 + norms + self.square)
        bound, bounded = bound.copy(), bounded.copy()

        def open_(at: np.ndarray, gap: np.ndarray) -> np.ndarray:
            """Which of the queries ``at`` may find something beyond a distance ``gap`` of their own."""
            return ~bounded[at] | (reach[at] - gap * gap >= 2.0 * bound[at])

        def compare(stretch: int, at: np.ndarray) -> None:
            rows = slice(stretch * ROWS, (stretch + 1) * ROWS)
            ids = self.ids[rows]
            score = products(query[at], self.vectors[rows], self.greatest)
            good = (ids != qid[at][:, None]) & (~bounded[at][:, None] | (score >= bound[at][:, None]))
            for row in np.flatnonzero(good.any(1)):
                i, some = at[row], good[row]
                found, names = score[row][some], ids[some]
                order = np.lexsort((names, -1 - found))[:k]  # -1 - x is its own order reversed, without overflow
                held[i] = sorted([*held[i], *zip((-1 - found[order]).tolist(), names[order].tolist(), strict=True)])[:k]
                if len(held[i]) == k:
                    last = -1 - held[i][-1][0]
                    bound[i], bounded[i] = (max(bound[i], last) if bounded[i] else last), True

        first = np.minimum(np.searchsorted(self.distance, distance) // ROWS, self.stretches - 1)
        for start in np.unique(first):
            group = np.flatnonzero(first == start)
            compare(start, group)
            low, high = int(start) - 1, int(start) + 1
            while low >= 0 or high < self.stretches:
                # beyond an end that no query of the group is open to, the gaps only grow
                below = distance[group] - self.distance[(low + 1) * ROWS - 1] if low >= 0 else np.full(len(group), np.inf)
                above = self.distance[high * ROWS] - distance[group] if high < self.stretches else np.full(len(group), np.inf)
                down = low >= 0 and (high >= self.stretches or below.min() <= above.min())
                gap = np.maximum(below if down else above, 0)
                wanted = group[open_(group, gap)]
                if len(wanted):
                    compare(low if down else high, wanted)
                    low, high = (low - 1, high) if down else (low, high + 1)
                elif down:
                    low = -1
                else:
                    high = self.stretches
        for i, found in enumerate(held):
            for score, name in found:
                yield int(qid[i]), name, -1 - score


class PivotIndex:
    """The index: a table (part, distance, id, vec) and what a search needs to know."""

    def __init__(self, rows: DataFrame, width: int, *, pivots: int = 64, sample: int = 4096, part_bytes: int = 1 << 25, annuli: int = 32, least_part: int = 1024):
        self.width = width
        square = F.aggregate("vec", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))
        greatest = F.greatest(F.array_max("vec"), -1 - F.array_min("vec"))
        n, square, greatest = rows.agg(F.count("*"), F.max(square), F.max(greatest)).head()
        self.n, self.square, self.greatest = n, float(square or 0.0), (greatest or 0) + 1
        if not n:
            return
        share = min(1.0, sample / n)
        drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= share * (1 << 30)).orderBy(F.xxhash64("id"), "id").limit(sample).collect()
        drawn = drawn or rows.limit(1).collect()
        self.pivots = choose_pivots(_augmented(np.array([r["vec"] for r in drawn], np.float64).reshape(len(drawn), width), self.square), pivots)
        square, centres = self.square, self.pivots

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = _distances(_augmented(_matrix(batch.column("vec"), width).astype(np.float64), square), centres)
                at = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(at)), at]), batch.column("id"), batch.column("vec")], ["pivot", "distance", "id", "vec"])

        keyed = rows.mapInArrow(key, "pivot int, distance double, id long, vec array<long>")
        ring = F.floor(F.col("distance") / F.lit(2 * float(np.sqrt(self.square)) / annuli + 1e-9)).cast("int")
        self.table = materialise(keyed.withColumn("ring", ring), "pivot_index")
        extents = self.table.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high"))
        self._cut(sorted(map(tuple, extents.collect())), max(least_part, min(part_bytes // (8 * max(1, width)), n // 64)))

    def _cut(self, extents: list[tuple[int, int, int, float, float]], rows: int) -> None:
        """Neighbouring annuli of a pivot become parts of about ``rows``; larger ones are divided by salts."""
        self.parts: list[list] = []  # pivot, rows, low, high, first number, salts
        self.rings: dict[tuple[int, int], int] = {}
        for pivot, ring, n, low, high in extents:
            last = self.parts[-1] if self.parts else None
            if last is None or last[0] != pivot or last[1] + n > rows:
                self.parts.append([pivot, 0, low, high])
                last = self.parts[-1]
            last[1], last[3] = last[1] + n, high
            self.rings[pivot, ring] = len(self.parts) - 1
        number = 0
        for part in self.parts:
            salts = -(-part[1] // rows)
            part += [number, salts]
            number += salts
        self.numbers = number

    def dealt(self) -> DataFrame:
        """The table with the number of each row's part."""
        places = [(p, r, self.parts[i][4], self.parts[i][5]) for (p, r), i in self.rings.items()]  # pivots x annuli rows at most
        known = self.table.sparkSession.createDataFrame(places, "pivot int, ring int, first int, salts int")
        return self.table.join(F.broadcast(known), ["pivot", "ring"]).select((F.col("first") + F.pmod(F.xxhash64("id", "distance"), F.col("salts"))).cast("int").alias("part"), "distance", "id", "vec")


def _search(index: PivotIndex, queries: DataFrame, k: int, own: bool) -> DataFrame:
    """(query, id, score, rank): the k best rows for each of ``queries`` (id, vec, bound), among the annuli around its
    own distance to its own pivot, or among all that are within its bound."""
    width, square, pivots, greatest = index.width, index.square, index.pivots, index.greatest
    pivot_of, count, low, high, first, salts = (np.array(c) for c in zip(*index.parts, strict=True))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                some = batch.slice(at, QUERIES)
                vec = _matrix(some.column("vec"), width).astype(np.float64)
                to_pivot = _distances(np.column_stack([vec, np.zeros(len(vec))]), pivots)
                away = to_pivot[:, pivot_of]
                gap = np.maximum(np.maximum(low - away, away - high), 0)
                if own:
                    gap = np.where(pivot_of == to_pivot.argmin(1)[:, None], gap, np.inf)
                    order = np.argsort(gap, axis=1, kind="stable")
                    before = np.cumsum(count[order], axis=1) - count[order]  # rows of nearer parts
                    wanted = np.zeros(gap.shape, bool)
                    np.put_along_axis(wanted, order, before < 32 * k, axis=1)
                    wanted &= np.isfinite(gap)
                else:
                    norms = (vec * vec).sum(1)
                    bound = some.column("bound")
                    least = np.where(bound.is_valid().to_numpy(zero_copy_only=False), bound.fill_null(0).to_numpy().astype(np.float64), -np.inf)
                    wanted = (norms + square)[:, None] - gap * gap + 1e-6 * (1 + norms + square)[:, None] >= 2 * least[:, None]
                which, part = np.nonzero(wanted)
                times = salts[part]
                which, part = np.repeat(which, times), np.repeat(part, times)
                salt = np.arange(len(part)) - np.repeat(np.cumsum(times) - times, times)
                for begin in range(0, len(which), 8 * ROWS):
                    w, p, s = (x[begin : begin + 8 * ROWS] for x in (which, part, salt))
                    taken = some.take(pa.array(w))
                    yield pa.RecordBatch.from_arrays([pa.array((first[p] + s).astype(np.int32)), pa.array(away[w, p]), taken.column("id"), taken.column("vec"), taken.column("bound")], ["part", "distance", "id", "vec", "bound"])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pieces, ready = None, [], None
        for batch in batches:
            number, asks = batch.column("part").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(number) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(number)], strict=True):
                if a == b:
                    continue
                if number[a] != current:
                    current, pieces, ready = number[a], [], None
                some = batch.slice(a, b - a)
                distance, ids = some.column("distance").to_numpy(), some.column("id").to_numpy()
                vectors = _matrix(some.column("vec"), width)
                if not asks[a]:
                    pieces.append((distance, ids, vectors))
                    continue
                if ready is None and pieces:
                    ready, pieces = Part(*(np.concatenate(x) for x in zip(*pieces, strict=True)), square, greatest), []
                if ready is None:
                    continue  # a salt that no row was dealt to
                bounded = some.column("bound").is_valid().to_numpy(zero_copy_only=False)
                bound = some.column("bound").fill_null(0).to_numpy()
                for at in range(0, b - a, QUERIES):
                    part = slice(at, at + QUERIES)
                    found = list(ready.best(ids[part], vectors[part], distance[part], bound[part], bounded[part], k))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["query", "id", "score"])

    columns = "part int, distance double, id long, vec array<long>, bound long"
    sent = queries.select("id", "vec", "bound").mapInArrow(send, columns).withColumn("asks", F.lit(True))
    rows = index.dealt().select("part", "distance", "id", "vec", F.lit(None).cast("long").alias("bound"), F.lit(False).alias("asks"))
    met = rows.unionByName(sent).repartition("part").sortWithinPartitions("part", "asks", "distance")
    found = met.mapInArrow(expand, "query long, id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(df: DataFrame, queries: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, scale: int = 1024, **index_options) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``id_col`` and ``score`` of the k best rows for each row where ``queries``
    holds (an expression on ``id_col``); equal scores go to the smaller id. Ids are integers."""
    spark = df.sparkSession
    rows, width = integer_vectors(df, id_col, vec_col, scale)
    index = PivotIndex(rows, width, **index_options)
    if not index.n:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score long")
    stored = index.table.select(F.col("id").alias(id_col), "vec")
    asked = stored.where(queries).select(F.col(f"`{id_col}`").alias("id"), "vec").groupBy("id").agg(F.min("vec").alias("vec"))
    asked = materialise(asked.withColumn("bound", F.lit(None).cast("long")), "queries")
    bounds = _search(index, asked, k, own=True).where(F.col("rank") == k).select(F.col("query").alias("id"), F.col("score").alias("bound"))
    found = _search(index, asked.drop("bound").join(bounds, "id", "left"), k, own=False)
    return found.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
