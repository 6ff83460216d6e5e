"""Centroid clustering in integers: rounds of nearest centroids, found by Shallot search.

Every vector remembers its nearest and its second-nearest centroid, an upper bound of its
distance to the nearest and a lower bound of that to all others; bounds are moved along
with the centroids. A vector whose bounds, or half the way to the nearest other centroid,
prove that nothing changes is left alone. For all others the search starts from the closer
of the two remembered centroids and scans that centroid's neighbours by rising distance.
A neighbour further away than the vector's distance to the start plus that to the second
best found so far can be neither; this ball shrinks whenever a better second is found.
What survives is compared by exact integer distances, ties by the smaller number. Bounds
are double precision with a margin, so that rounding can only cause a comparison more.

A component x is the integer floor(scale * x). Rows of a task become blocks of BLOCK
vectors with their remembered values; each round reads a table of blocks and writes the
next one, with the block's sums by cluster, in the folder that all executors share. Only
sums of k centroids are shuffled, in parts of 30 bits that can't overflow, and only they
reach the driver. Tables of earlier rounds are deleted as soon as the next is whole.

Defined results: vectors that are null, of another length, or hold null or non-finite
components are left out. Rows are vectors of their own, also with equal or null ids. First
centroids are the k vectors with the smallest hashes of their ids, null ids last, equal
ones by their components. Fewer vectors than k make fewer centroids; an empty table gives
no rows. Components whose squared distances might exceed 62 bits are compared without
bounds, in integers of any length; a distance or sum that is no long is null. Other
columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.frames import col, discard, scratch, sent

#: Vectors of a block.
BLOCK = 4096
#: Centroids and the distances between them go to every worker: at most about 150 MB.
MOST_CENTROIDS = 4096
#: Relative margin of bounds, far above double precision's rounding.
MARGIN = 1e-9
_LIMB = 30
_SCHEMA = "ids array<{}>, width int, body binary, near binary, second binary, upper binary, lower binary, sums binary"


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has ``dims`` finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def integers(rows: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of every component: int64, or Python's integers where that is too small."""
    if rows.size == 0 or np.abs(rows).max() < 2**50 / scale:
        return np.floor(rows * scale).astype(np.int64)
    exact = [math.floor(x * scale) if abs(x) < 2**50 / scale else math.floor(scale * Fraction(x)) for x in rows.ravel().tolist()]
    return np.array(exact, object).reshape(rows.shape)


class Centroids:
    """Centroids of a round, what separates them, and how far they came since the last one."""

    def __init__(self, places: np.ndarray, before: np.ndarray | None = None):
        self.places, self.k, dims = places, len(places), places.shape[1]
        #: Components up to here give squared distances of 62 bits at most.
        self.most = math.isqrt(2**62 // max(dims, 1)) // 2
        self.small = int(max(abs(places).max(initial=0), 0 if before is None else abs(before).max(initial=0))) <= self.most
        if not self.small:
            return
        self.places = places.astype(np.int64)
        between = np.stack([np.sqrt(squares(self.places, p).astype(np.float64)) for p in self.places])
        np.fill_diagonal(between, np.inf)
        self.order = np.argsort(between, 1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(between, self.order, 1)
        self.half = self.sorted[:, 0] / 2 * (1 - MARGIN)
        moved = np.zeros(self.k)
        if before is not None:
            moved = np.sqrt(((self.places - before.astype(np.int64)) ** 2).sum(1).astype(np.float64)) * (1 + MARGIN)
        self.moved = moved
        # The greatest move of all others, for each centroid.
        top = np.sort(moved)[-2:] if self.k > 1 else np.zeros(2)
        self.others = np.where(moved == top[-1], top[0] if (moved == top[-1]).sum() == 1 else top[-1], top[-1])


def squares(rows: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one place, or to one each."""
    apart = rows - places
    return (apart * apart).sum(-1)


class Block:
    """Vectors with what they remember: nearest and second centroid, and the two bounds."""

    def __init__(self, rows: np.ndarray, state: tuple[np.ndarray, ...] | None = None):
        many = len(rows)
        self.rows = rows
        fresh = np.zeros(many, np.int32), np.ones(many, np.int32), np.full(many, np.inf), np.zeros(many)
        self.near, self.second, self.upper, self.lower = state or fresh
        self.small = rows.dtype != object

    def assign(self, to: Centroids) -> int:
        """Remember the nearest centroids; gives the number of vectors that were searched for."""
        if not (self.small and to.small and int(np.abs(self.rows).max(initial=0)) <= to.most):
            return self._compare_all(to)
        if to.k == 1:
            self.near[:] = 0
            return 0
        self.upper += to.moved[self.near]
        self.lower -= to.others[self.near]
        proof = np.maximum(self.lower, to.half[self.near])
        left = np.flatnonzero(self.upper >= proof)
        rows = self.rows[left].astype(np.int64)
        exact = squares(rows, to.places[self.near[left]])
        self.upper[left] = np.sqrt(exact.astype(np.float64)) * (1 + MARGIN)
        again = self.upper[left] >= proof[left]
        self._search(to, left[again], rows[again], exact[again])
        return int(again.sum())

    def _search(self, to: Centroids, left: np.ndarray, rows: np.ndarray, first_square: np.ndarray) -> None:
        best, best_square = self.near[left].astype(np.int64), first_square
        next_, next_square = self.second[left].astype(np.int64), squares(rows, to.places[self.second[left]])

        def swapped(where: np.ndarray) -> None:
            best[where], next_[where] = next_[where], best[where]
            best_square[where], next_square[where] = next_square[where], best_square[where]

        swapped((next_square < best_square) | ((next_square == best_square) & (next_ < best)))
        start, other = best.copy(), next_.copy()
        reach = np.sqrt(best_square.astype(np.float64))
        ball = reach + np.sqrt(next_square.astype(np.float64))
        active = np.arange(len(left))
        for step in range(to.k - 1):
            active = active[to.sorted[start[active], step] * (1 - MARGIN) <= ball[active] * (1 + MARGIN)]
            if not len(active):
                break
            neighbour = to.order[start[active], step].astype(np.int64)
            known = neighbour == other[active]
            at, neighbour = active[~known], neighbour[~known]
            square = squares(rows[at], to.places[neighbour])
            nearer = (square < next_square[at]) | ((square == next_square[at]) & (neighbour < next_[at]))
            at = at[nearer]
            next_[at], next_square[at] = neighbour[nearer], square[nearer]
            swapped(at[(next_square[at] < best_square[at]) | ((next_square[at] == best_square[at]) & (next_[at] < best[at]))])
            ball[at] = reach[at] + np.sqrt(next_square[at].astype(np.float64))
        self.near[left], self.second[left] = best, next_
        self.upper[left] = np.sqrt(best_square.astype(np.float64)) * (1 + MARGIN)
        self.lower[left] = np.sqrt(next_square.astype(np.float64)) * (1 - MARGIN)

    def _compare_all(self, to: Centroids) -> int:
        rows, places = self.rows.astype(object), to.places.astype(object)
        best = [None] * len(rows)
        for number, place in enumerate(places):
            for i, square in enumerate(squares(rows, place)):
                if best[i] is None or square < best[i]:
                    best[i], self.near[i] = square, number
        self.second[:] = (self.near + 1) % to.k
        self.upper[:], self.lower[:] = np.inf, 0
        return len(rows)

    def distances(self, to: Centroids) -> list[int]:
        """Exact squared distances to the nearest centroids."""
        large = not (self.small and to.small and int(np.abs(self.rows).max(initial=0)) <= to.most)
        kind = object if large else np.int64
        return squares(self.rows.astype(kind), to.places.astype(kind)[self.near]).tolist()

    def sums(self) -> dict[int, list[int]]:
        """For each cluster of the block: its number of vectors and the sums of their components."""
        out = {}
        for cluster in np.unique(self.near).tolist():
            mine = self.rows[self.near == cluster]
            out[cluster] = [len(mine), *map(int, mine.astype(np.int64 if self.small else object).sum(0))]
        return out


def _stored(ids: pa.Array, block: Block) -> pa.RecordBatch:
    """A block as a row of the table; components as narrow as they can be, large ones as text."""
    width = 0
    if block.small:
        most = int(np.abs(block.rows).max(initial=0))
        width = 2 if most < 2**15 else 4 if most < 2**31 else 8
    body = block.rows.astype(f"<i{width}").tobytes() if width else json.dumps(block.rows.tolist()).encode()
    state = [x.tobytes() for x in (block.near, block.second, block.upper, block.lower)]
    sums = json.dumps(list(block.sums().items())).encode()
    columns = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([width], pa.int32())]
    columns += [pa.array([x], pa.binary()) for x in (body, *state, sums)]
    return pa.record_batch(columns, ["ids", "width", "body", "near", "second", "upper", "lower", "sums"])


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, Block]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names if name != "ids"}
            if row["width"]:
                rows = np.frombuffer(row["body"], f"<i{row['width']}").reshape(-1, dims)
            else:
                rows = np.array(json.loads(row["body"]), object).reshape(-1, dims)
            kinds = {"near": np.int32, "second": np.int32, "upper": np.float64, "lower": np.float64}
            state = tuple(np.frombuffer(row[name], kind).copy() for name, kind in kinds.items())
            yield batch.column("ids").slice(i, 1).flatten(), Block(rows, state)


def _new_blocks(batches: Iterator[pa.RecordBatch], dims: int, scale: int) -> Iterator[tuple[pa.Array, Block]]:
    held: list[pa.RecordBatch] = []

    def made() -> Iterator[tuple[pa.Array, Block]]:
        table = pa.Table.from_batches(held).combine_chunks()
        for at in range(0, table.num_rows, BLOCK):
            part = table.slice(at, BLOCK).combine_chunks()
            rows = part.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            yield part.column("id").combine_chunks(), Block(integers(rows, scale))

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK:
            yield from made()
            held = []
    if sum(b.num_rows for b in held):
        yield from made()


def _moved(table: DataFrame, places: np.ndarray) -> np.ndarray:
    """New places: the exact floor of the mean of each cluster; an empty one stays."""
    k, dims = places.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for text in batch.column("sums").to_pylist():
                for cluster, sums in json.loads(text):
                    total[cluster] = total.get(cluster, 0) + np.array(sums, object)
        found: list[tuple[int, int, int, int]] = []
        for cluster, sums in total.items():
            for axis, value in enumerate(sums.tolist()):
                sign, value, limb = (-1 if value < 0 else 1), abs(value), 0
                while value:
                    found.append((cluster, axis, limb, sign * (value % (1 << _LIMB))))
                    value, limb = value >> _LIMB, limb + 1
        columns = list(zip(*found, strict=True)) or [()] * 4
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["cluster", "axis", "limb", "part"])

    parts = table.select("sums").mapInArrow(work, "cluster long, axis long, limb long, part long")
    total = np.zeros((k, dims + 1), object)
    for row in parts.groupBy("cluster", "axis", "limb").agg(F.sum("part").alias("part")).collect():
        total[row.cluster, row.axis] += row.part << (_LIMB * row.limb)
    means = [[s // n for s in sums] if n else old for (n, *sums), old in zip(total.tolist(), places.tolist(), strict=True)]
    return np.array(means, object).reshape(k, dims)


def cluster(
    frame: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64,
    scale: int = 1024, seed: int = 3,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each usable vector.

    ``rounds`` times vectors go to their nearest centroid and centroids to the floor of
    their vectors' mean; then vectors are assigned once more.
    """
    if not 1 <= k <= MOST_CENTROIDS:
        raise ValueError(f"k is a number from 1 to {MOST_CENTROIDS}")
    spark, kind = frame.sparkSession, frame.schema[vec_id].dataType.simpleString()
    vectors = sent(frame).select(col(vec_id).alias("id"), col(vector).cast("array<double>").alias("vector")).where(usable(F.col("vector"), dims))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = vectors.orderBy(digest.asc_nulls_last(), "vector").limit(k).collect()
    result = f"id {kind}, cluster int, distance long"
    places = integers(np.array([r.vector for r in first]).reshape(-1, dims), scale).astype(object)
    table = rows = before = path = None
    for number in range(rounds + 1 if first else 0):
        shared = spark.sparkContext.broadcast(Centroids(places, before))
        fresh = table is None

        def work(batches: Iterator[pa.RecordBatch], shared=shared, fresh=fresh) -> Iterator[pa.RecordBatch]:
            for ids, block in _new_blocks(batches, dims, scale) if fresh else _blocks(batches, dims):
                block.assign(shared.value)
                yield _stored(ids, block)

        schema, old, path = _SCHEMA.format(kind), path, scratch(spark, "clusters")
        (vectors if fresh else table).mapInArrow(work, schema).write.parquet(path)
        table = spark.read.schema(schema).parquet(path)
        if old:
            discard(spark, old)
        if number < rounds:
            before, places = places, _moved(table, places)
    if first:
        last = spark.sparkContext.broadcast(Centroids(places))

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, block in _blocks(batches, dims):
                away = [d if d < 2**63 else None for d in block.distances(last.value)]
                columns = [ids, pa.array(block.near, pa.int32()), pa.array(away, pa.int64())]
                yield pa.record_batch(columns, ["id", "cluster", "distance"])

        rows = table.mapInArrow(told, result)
    else:
        rows = spark.createDataFrame([], result)
    return _told(spark, rows, places).select(F.col("id").alias(vec_id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _told(spark, rows: DataFrame, places: np.ndarray) -> DataFrame:
    """Rows with the figures of their clusters, of which there are k."""
    large = F.sum(F.when(F.col("distance").isNull(), 1).otherwise(0)) > 0
    total = F.when(~large, F.sum(F.col("distance").cast("decimal(38,0)")))
    by_cluster = {r.cluster: r.total for r in rows.groupBy("cluster").agg(total.alias("total")).collect()}

    def as_long(value) -> int | None:
        return int(value) if value is not None and value < 2**63 else None

    whole = None if None in by_cluster.values() else sum(by_cluster.values())
    told = [
        (c, as_long(by_cluster.get(c, 0)), as_long(whole), hashlib.sha256(",".join(map(str, place)).encode()).hexdigest())
        for c, place in enumerate(places.tolist())
    ]
    figures = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(figures), "cluster")
