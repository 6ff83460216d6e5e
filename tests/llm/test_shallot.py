"""Centroid clustering against plain rounds over all pairs, in Python's integers."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from tallyline.llm import shallot
from tallyline.llm.shallot import Block, Centroids, cluster, integers


def brute_force(rows, k, rounds, dims, scale=1024, seed=3):
    """(id, components) -> sorted list of (id, cluster, distance, cluster_inertia, inertia, digest)."""
    kept = [
        (i, [math.floor(scale * Fraction(x)) for x in v], v)
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    digest = {i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() for i, _, _ in kept}
    first = sorted(kept, key=lambda r: (r[0] is None, digest[r[0]], r[2]))[:k]
    places = [x for _, x, _ in first]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, p, strict=True)), c) for c, p in enumerate(places))

    for _ in range(rounds):
        own = [nearest(x)[1] for _, x, _ in kept]
        for c in range(len(places)):
            mine = [x for (_, x, _), o in zip(kept, own, strict=True) if o == c]
            if mine:
                places[c] = [sum(v) // len(mine) for v in zip(*mine, strict=True)]
    found = [(i, *nearest(x)[::-1]) for i, x, _ in kept]
    sums = {c: sum(d for _, o, d in found if o == c) for c in range(len(places))}
    told = {c: hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for c, p in enumerate(places)}

    def as_long(x):
        return x if x < 2**63 else None

    return [(i, c, as_long(d), as_long(sums[c]), as_long(sum(sums.values())), told[c]) for i, c, d in found]


def key(row):
    return tuple((x is None, x or 0) for x in row[:3])


def result(frame):
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=key)


def test_integers_are_exact():
    values = [0.0, -0.0, 1e-30, -1e-30, 0.5, -1 / 3, 1e15, -123456789.123, 1e300, -5e-324, 2.0**49, 3.4e38]
    got = integers(np.array([values]), 1024)[0].tolist()
    assert got == [math.floor(1024 * Fraction(x)) for x in values]


@pytest.mark.parametrize("k", [1, 2, 3, 9, 40])
def test_search_finds_the_nearest_two_and_leaves_many_alone(k):
    rng = np.random.default_rng(k)
    middles = rng.integers(-400, 400, (12, 6))
    rows = (middles[rng.integers(0, 12, 900)] + rng.integers(-30, 30, (900, 6))).astype(np.int16)
    places = rows[rng.choice(900, k, False)].astype(object)
    places[-1] = places[0]  # two in one place: the smaller number wins
    block, before, searched = Block(rows), None, []
    for _ in range(8):
        to = Centroids(places, before)
        searched.append(block.assign(to))
        squares = ((rows.astype(np.int64)[:, None] - places.astype(np.int64)[None]) ** 2).sum(2)
        assert (block.near == squares.argmin(1)).all()
        assert block.distances(to) == squares.min(1).tolist()
        if k > 1:
            others = np.where(np.arange(k) == block.near[:, None], 2**62, squares).min(1)
            assert (block.upper >= np.sqrt(squares.min(1))).all() and (block.lower <= np.sqrt(others)).all()
        sums = block.sums()
        before = places
        places = np.array([[s // sums[c][0] for s in sums[c][1:]] if c in sums else p for c, p in enumerate(places.tolist())], object)
    assert k < 3 or searched[-1] < searched[0] / 2


def test_clusters(spark, monkeypatch):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(5, 4))
    rows = [(i, (middles[i % 5] + rng.normal(size=4) * 0.3).tolist()) for i in range(700)]
    rows += [(7, rows[7][1])] * 200 + [(None, [0.0] * 4), (None, [0.0] * 4), (1001, [-0.0, 1.0, 1.0, 1.0])]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 3), (2003, [1.0] * 5), (2004, [1.0, None, 1.0, 1.0]), (2005, [math.nan] * 4)]
    rows += [(2006, [math.inf, 0.0, 0.0, 0.0])]
    monkeypatch.setattr(shallot, "BLOCK", 50)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, cluster string, id int").repartition(5)
    for k, rounds in ((1, 1), (6, 4), (8, 0)):
        assert result(cluster(frame, k=k, rounds=rounds, dims=4)) == sorted(brute_force(rows, k, rounds, 4), key=key)


def test_large_numbers_few_rows_and_none(spark):
    rows = [(i, [float(i), 1e300 if i % 3 == 0 else -2.5e9 * i]) for i in range(1, 12)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert result(cluster(frame, k=4, rounds=3, dims=2)) == sorted(brute_force(rows, 4, 3, 2), key=key)
    few = spark.createDataFrame([(1, [1.5]), (2, [-1.5])], "vec_id int, embedding array<float>")
    assert result(cluster(few, k=8, rounds=2, dims=1)) == sorted(brute_force([(1, [1.5]), (2, [-1.5])], 8, 2, 1), key=key)
    assert cluster(few.where("false"), dims=1).collect() == []
    with pytest.raises(ValueError, match="k is"):
        cluster(few, k=0)
