"""Packing into few sequences: a grouping genetic algorithm on islands.

Items are dealt at random to districts of bounded size. In a district an individual is a
whole packing, and its genes are bins. Crossover puts whole well-filled bins of one parent
into the other, removes the bins there that hold a second copy of an item, and fits the
displaced items best-fit, the longest first; mutation does the same with the emptiest bins.
Fewer bins win, then the greater sum of squared fillings, which drives room together.

Each district is evolved by several islands, tasks' rows of their own. After each epoch an
island's elite goes to the next island, by a join. A district whose best packing reaches
the lower bound (of long items and of room) can't get better and is left alone; best-fit
alone reaches it for most. At the end every district releases its emptiest bins, and what
they held is dealt to districts anew, so that the room that each district had to leave
comes together; the last level is one district.

Defined results of ``cut``: a null or empty text has the end id only; every row is a
document of its own, also with an equal or null id. Only documents longer than the
capacity are cut. Of ``place``: every row is an item, a null size counts as 0, an item of
the capacity or more is a sequence of its own; columns are kept, but for those named like
a result column. An empty table gives no rows. sequence_id is unique in a result, and may
differ if rows are dealt to tasks differently.

Scale: only keys and sizes are shuffled, and the rows once for their places. A district has
a few thousand items at most in expectation, whatever the table; islands, epochs and levels are
fixed numbers. The work for a district doesn't depend on how many there are.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.frames import col, few_at_once, reliable, sent, slices, unused, without
from tallyline.llm.tokenizing import Encoder, packed

CAPACITY = 4096
#: A district's bins (by size alone) and items, about.
DISTRICT_BINS = 256
DISTRICT_ITEMS = 8192
ISLANDS = 3
EPOCHS = 3
#: Individuals of an island and children of an epoch.
POPULATION = 6
CHILDREN = 24
#: Of so many bins the emptiest is released for the next level.
RELEASED = 16
LEVELS = 5
_LEVEL, _DISTRICT = 1 << 58, 1 << 20


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """A lower bound: room, and items of over half a bin, beside which only short ones fit."""
    if not len(sizes):
        return 0
    up = np.sort(sizes)
    sums = np.r_[0, np.cumsum(up)]
    half = np.searchsorted(up, capacity // 2, "right")
    shortest = np.r_[0, np.unique(up[:half])]
    alone = len(up) - np.searchsorted(up, capacity - shortest, "right")
    to = len(up) - alone
    beside, room = to - half, (to - half) * capacity - (sums[to] - sums[half])
    rest = sums[half] - sums[np.searchsorted(up[:half], shortest)]
    return int((alone + beside + np.maximum(0, -(-(rest - room) // capacity))).max())


class Packing:
    """A packing of items: lists of items and the sum of each."""

    def __init__(self, capacity: int, sizes: list[int], bins: list[list[int]], fills: list[int]):
        self.capacity, self.sizes, self.bins, self.fills = capacity, sizes, bins, fills

    def fit(self, items: list[int]) -> Packing:
        """Add items in the given order, each to the fullest bin that has room for it."""
        room = sorted((self.capacity - fill, at) for at, fill in enumerate(self.fills) if fill < self.capacity)
        for item in items:
            size = self.sizes[item]
            place = bisect_left(room, (size, -1))
            if place < len(room):
                left, at = room.pop(place)
                self.bins[at].append(item)
                self.fills[at] += size
            else:
                left, at = self.capacity, len(self.bins)
                self.bins.append([item])
                self.fills.append(size)
            if left > size:
                insort(room, (left - size, at))
        return self

    @property
    def fitness(self) -> tuple[int, int]:
        """Less is better."""
        return len(self.bins), -sum(f * f for f in self.fills)

    def without(self, gone: set[int]) -> Packing:
        kept = [i for i in range(len(self.bins)) if i not in gone]
        return Packing(self.capacity, self.sizes, [list(self.bins[i]) for i in kept], [self.fills[i] for i in kept])

    def longest_first(self, items: list[int]) -> list[int]:
        return sorted(items, key=lambda i: -self.sizes[i])

    def crossed(self, donor: Packing, rng: np.random.Generator) -> Packing:
        """A child: this packing with some of the donor's best-filled bins."""
        best = sorted(range(len(donor.bins)), key=lambda i: -donor.fills[i])
        best = best[: max(1, round(len(best) * rng.uniform(0.2, 0.8)))]
        taken = [best[i] for i in np.flatnonzero(rng.random(len(best)) < 0.5)] or best[:1]
        held = {item for i in taken for item in donor.bins[i]}
        twice = {i for i, items in enumerate(self.bins) if not held.isdisjoint(items)}
        child = self.without(twice)
        child.bins += [list(donor.bins[i]) for i in taken]
        child.fills += [donor.fills[i] for i in taken]
        return child.fit(self.longest_first([x for i in twice for x in self.bins[i] if x not in held]))

    def mutated(self, rng: np.random.Generator) -> Packing:
        """A child: the emptiest bins and some others dissolved and fitted anew."""
        order = sorted(range(len(self.bins)), key=lambda i: self.fills[i])
        gone = {*order[: int(rng.integers(1, 4))], *rng.integers(0, len(order), 2 + len(order) // 20).tolist()}
        freed = [x for i in gone for x in self.bins[i]]
        return self.without(gone).fit(_noisy(self.sizes, freed, 0.2, rng))

    def assignment(self) -> np.ndarray:
        out = np.zeros(len(self.sizes), np.int32)
        for number, items in enumerate(self.bins):
            out[items] = number
        return out

    @staticmethod
    def of(capacity: int, sizes: list[int], assignment: np.ndarray) -> Packing:
        order = np.argsort(assignment, kind="stable")
        cuts = np.flatnonzero(np.diff(assignment[order])) + 1
        bins = [part.tolist() for part in np.split(order, cuts)]
        return Packing(capacity, sizes, bins, [sum(sizes[i] for i in items) for items in bins])


def _noisy(sizes: list[int], items: list[int], noise: float, rng: np.random.Generator) -> list[int]:
    """Items by falling size, more or less."""
    weight = np.array([sizes[i] for i in items]) * rng.uniform(1 - noise, 1 + noise, len(items))
    return [items[i] for i in np.argsort(-weight, kind="stable")]


def greedy(sizes: list[int], capacity: int, rng: np.random.Generator | None = None) -> Packing:
    """Best-fit, the longest first, or nearly so."""
    new = Packing(capacity, sizes, [], [])
    items = list(range(len(sizes)))
    return new.fit(new.longest_first(items) if rng is None else _noisy(sizes, items, 0.1, rng))


def evolved(population: list[Packing], target: int, rng: np.random.Generator, children: int = CHILDREN) -> list[Packing]:
    """The population after so many children, best first; ends early at the target."""
    population = sorted(population, key=lambda p: p.fitness)
    for _ in range(children):
        if len(population[0].bins) <= target:
            break
        a, b = (int(min(rng.integers(0, len(population), 2))) for _ in range(2))
        if a == b or rng.random() < 0.3:
            child = population[a].mutated(rng)
        else:
            child = population[a].crossed(population[b], rng)
        if all(child.fitness != p.fitness for p in population):
            population = sorted([*population, child], key=lambda p: p.fitness)[:POPULATION]
    return population


# --- documents to pieces


def cut(
    frame: DataFrame, tokenizer_file: str | Path, doc_id: str = "doc_id", text: str = "text", end: int | None = 1,
    capacity: int = CAPACITY,
) -> DataFrame:
    """(doc_id, piece, start, length, ids) of all documents; ids are four bytes each, little-endian."""
    kind = frame.schema[doc_id].dataType.simpleString()
    shared = frame.sparkSession.sparkContext.broadcast(Path(tokenizer_file).read_text(encoding="utf-8"))
    last, step = packed([end]) if end is not None else b"", 4 * capacity

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in slices(batches, "text"):
            rows, pieces = [], []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for row, ids in enumerate(encoder.encode(texts)):
                ids += last
                for piece, at in enumerate(range(0, max(len(ids), 1), step)):
                    rows.append(row)
                    pieces.append((piece, at // 4, len(ids[at : at + step]) // 4, ids[at : at + step]))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*pieces, strict=True), kinds, strict=True)]
            columns = [batch.column("doc_id").take(pa.array(rows, pa.int64())), *columns]
            yield pa.record_batch(columns, ["doc_id", "piece", "start", "length", "ids"])

    texts = sent(frame).select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text"))
    return texts.mapInArrow(work, f"doc_id {kind}, piece int, start long, length long, ids binary")


# --- items to sequences

_ISLAND = "district long, island int, ks array<long>, sizes array<long>, target int, people binary, many int, squares long"


def _row(district: int, island: int, keys: list[int], sizes: list[int], target: int, people: list[Packing]) -> dict:
    many, squares = people[0].fitness
    genes = np.stack([p.assignment() for p in people]).tobytes()
    return {
        "district": district, "island": island, "ks": keys, "sizes": sizes, "target": target, "people": genes,
        "many": many, "squares": squares,
    }


def _people(row: dict, capacity: int, column: str = "people") -> list[Packing]:
    genes = np.frombuffer(row[column] or b"", np.int32).reshape(-1, len(row["sizes"]))
    return [Packing.of(capacity, row["sizes"], g) for g in genes]


def _settled(districts: DataFrame, capacity: int, level: int) -> DataFrame:
    """The best packing of every district (the first of ``people``)."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                keys = [x["key"] for x in row["items"]]
                sizes = [x["size"] for x in row["items"]]
                out.append(_row(row["district"], 0, keys, sizes, least_bins(np.array(sizes), capacity), [greedy(sizes, capacity)]))
            yield pa.RecordBatch.from_pylist(out, schema)

    def live(epoch: int):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    rng = np.random.default_rng((level, row["district"], row["island"], epoch))
                    people = _people(row, capacity) + (_people(row, capacity, "elite") if epoch else [])
                    while len(people) < POPULATION:
                        people.append(greedy(row["sizes"], capacity, rng))
                    people = evolved(people, row["target"], rng)
                    out.append(_row(*(row[c] for c in ("district", "island", "ks", "sizes", "target")), people))
                yield pa.RecordBatch.from_pylist(out, schema)

        return work

    numbers, genes = pa.list_(pa.int64()), pa.binary()
    schema = pa.schema([
        ("district", pa.int64()), ("island", pa.int32()), ("ks", numbers), ("sizes", numbers), ("target", pa.int32()),
        ("people", genes), ("many", pa.int32()), ("squares", pa.int64()),
    ])
    first = reliable(districts.mapInArrow(settle, _ISLAND))
    done, open_ = [first.where("many <= target")], first.where("many > target")
    elite = F.expr("substring(people, 1, 4 * size(sizes))")
    for epoch in range(EPOCHS):
        if open_.isEmpty():
            break
        if epoch == 0:
            islands = open_.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
        else:
            onward = open_.select("district", F.expr(f"(island + 1) % {ISLANDS}").alias("island"), elite.alias("elite"))
            islands = open_.join(onward, ["district", "island"])
        # Many small tasks, as a row takes seconds.
        spread = islands.repartition("district", "island")
        after = reliable(spread.mapInArrow(live(epoch), _ISLAND))
        reached = after.where("many <= target").select("district").distinct()
        if epoch + 1 < EPOCHS:
            done.append(after.join(reached, "district", "left_semi"))
            open_ = after.join(reached, "district", "left_anti")
        else:
            done.append(after)
    else:
        open_ = None
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    best = F.min_by(F.struct("ks", "sizes", elite.alias("genes")), F.struct("many", "squares", "island"))
    return rows.groupBy("district").agg(best.alias("b")).select("district", "b.*")


def _split(level: int, capacity: int, last: bool):
    """Rows of a district's best packing as items: with a sequence and a place, or released."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (best,) = _people(row, capacity, "genes")
                order = sorted(range(len(best.bins)), key=lambda i: best.fills[i])
                free = set() if last else set(order[: -(-len(order) // RELEASED)])
                out = []
                for number, items in enumerate(best.bins):
                    at, sequence = 0, level * _LEVEL + row["district"] * _DISTRICT + number
                    for item in items:
                        size = row["sizes"][item]
                        out.append((row["ks"][item], size, None if number in free else sequence, at))
                        at += size
                yield pa.record_batch(
                    [pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["key", "size", "sequence_id", "offset"]
                )

    return work


def place(items: DataFrame, size: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """The rows with sequence_id and offset: sequences of at most ``capacity``, as few as can be found."""
    (name,) = unused(items, "key")
    rows = reliable(sent(items).select(*without(items, "sequence_id", "offset"), F.monotonically_increasing_id().alias(name)))
    sizes = rows.select(F.col(name).alias("key"), F.coalesce(col(size), F.lit(0)).cast("long").alias("size"))
    whole = sizes.where(F.col("size") >= capacity).select("key", (-F.col("key") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed, left = [whole], sizes.where(F.col("size") < capacity)
    for level in range(LEVELS):
        many, total = left.agg(F.count("*"), F.sum("size")).first()
        if not many:
            break
        districts = max(1, -(-many // DISTRICT_ITEMS), round(total / (capacity * DISTRICT_BINS)))
        dealt = F.pmod(F.xxhash64(F.lit(level), "key"), F.lit(districts)).alias("district")
        listed = F.array_sort(F.collect_list(F.struct("key", "size"))).alias("items")
        with few_at_once(rows.sparkSession, 8):
            best = _settled(left.groupBy(dealt).agg(listed), capacity, level)
            last = districts == 1 or level + 1 == LEVELS
            told = reliable(best.mapInArrow(_split(level, capacity, last), "key long, size long, sequence_id long, offset long"))
        placed.append(told.where("sequence_id IS NOT NULL").drop("size"))
        left = told.where("sequence_id IS NULL").select("key", "size")
        if last:
            break
    found = placed[0]
    for more in placed[1:]:
        found = found.unionByName(more)
    return rows.join(found.withColumnRenamed("key", name), name).drop(name)
