"""Packing into few sequences: the genetic steps, bounds, and the pieces of documents."""

import zlib
from itertools import combinations

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallyline.llm import grouping_genetic as module
from tallyline.llm.grouping_genetic import Packing, cut, evolved, greedy, least_bins, place
from tallyline.llm.queries import tokenizer

from .test_tokens import TEXTS

FILE = "word_bpe_49k.json"


def fewest(sizes, capacity):
    """The least number of bins, by trying all."""
    if not sizes:
        return 0
    first, rest = sizes[0], sizes[1:]
    best = len(sizes)
    for n in range(len(rest) + 1):
        for some in combinations(range(len(rest)), n):
            if first + sum(rest[i] for i in some) <= capacity:
                best = min(best, 1 + fewest([x for i, x in enumerate(rest) if i not in some], capacity))
    return best


def whole(packing, sizes, capacity):
    """Every item is in one bin, and no bin is too full."""
    assert sorted(x for items in packing.bins for x in items) == list(range(len(sizes)))
    assert packing.fills == [sum(sizes[i] for i in items) for items in packing.bins]
    assert max(packing.fills) <= capacity and all(packing.bins)


def test_bounds_and_small_cases():
    rng = np.random.default_rng(1)
    assert least_bins(np.array([], int), 10) == 0 and least_bins(np.array([6] * 5), 10) == 5
    for _ in range(60):
        sizes = rng.integers(1, 10, rng.integers(1, 8)).tolist()
        best = fewest(sizes, 10)
        assert least_bins(np.array(sizes), 10) <= best
        found = evolved([greedy(sizes, 10, rng) for _ in range(6)], least_bins(np.array(sizes), 10), rng, 60)[0]
        whole(found, sizes, 10)
        assert len(found.bins) == best


def test_children_are_whole_packings():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 70, 400).tolist()
    a, b = greedy(sizes, 100, rng), greedy(sizes, 100, rng)
    for _ in range(50):
        child = a.crossed(b, rng)
        whole(child, sizes, 100)
        whole(child.mutated(rng), sizes, 100)
        again = Packing.of(100, sizes, child.assignment())
        whole(again, sizes, 100)
        assert again.fitness == child.fitness
    # Bins of the donor come over whole.
    assert any({*map(tuple, map(sorted, a.crossed(b, rng).bins))} & {*map(tuple, map(sorted, b.bins))} for _ in range(5))


def test_evolution_beats_best_fit():
    # Triplets that fill bins exactly, where the longest first is a bad order.
    rng, sizes = np.random.default_rng(3), []
    for _ in range(30):
        x = int(rng.integers(380, 490))
        y = int(rng.integers(260, (1000 - x) - 250))
        sizes += [x, y, 1000 - x - y]
    start = greedy(sizes, 1000)
    found = evolved([start, *[greedy(sizes, 1000, rng) for _ in range(5)]], 30, rng, 1500)[0]
    whole(found, sizes, 1000)
    assert len(found.bins) < len(start.bins)


def sequences(rows, size="length"):
    """Sums by sequence; places have to be gapless."""
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset, r[size])):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r[size]
    return filled


@pytest.mark.parametrize("partitions", [1, 64])
def test_few_sequences_however_rows_are_dealt(spark, monkeypatch, partitions):
    monkeypatch.setattr(module, "DISTRICT_BINS", 20)
    rng = np.random.default_rng(4)
    sizes = np.minimum(rng.lognormal(5.5, 1.2, 3000).astype(int) + 1, 4096).tolist()
    frame = spark.createDataFrame([(i, s, 0) for i, s in enumerate(sizes)], "id long, length int, key int").repartition(partitions)
    rows = place(frame).collect()
    assert sorted((r.id, r.length, r.key) for r in rows) == [(i, s, 0) for i, s in enumerate(sizes)]
    filled = sequences(rows)
    assert max(filled.values()) <= 4096
    assert len(filled) <= least_bins(np.array(sizes), 4096) + 1


def test_hard_districts_go_through_islands(spark, monkeypatch):
    monkeypatch.setattr(module, "DISTRICT_BINS", 40)
    monkeypatch.setattr(module, "CHILDREN", 10)
    rng = np.random.default_rng(5)
    sizes = []
    for n, m in zip(rng.integers(0, 90, 60).tolist(), rng.integers(0, 40, 60).tolist(), strict=True):
        sizes += [2000 + n, 1100 - n + m, 996 - m]
    rows = place(spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "id long, length long")).collect()
    filled = sequences(rows)
    assert sorted(r.id for r in rows) == list(range(180)) and max(filled.values()) <= 4096
    assert 60 <= len(filled) <= len(greedy(sizes, 4096).bins) + 1


def test_items_of_any_size(spark):
    rows = [(1, None), (2, 0), (3, 0), (4, 4096), (5, 9999), (6, 4095), (7, 1), (8, 1), (8, 1), (None, 5)]
    frame = spark.createDataFrame(rows, "id long, length long").selectExpr("*", "1 AS Offset", "2 AS sequence_id", "3 AS `a.b`", "4 AS key")
    got = place(frame).collect()
    assert sorted((r.id or 0, r.length or 0) for r in got) == sorted((a or 0, b or 0) for a, b in rows)
    assert len({r.sequence_id for r in got}) == 4 and got[0]["a.b"] == 3
    assert place(frame.where("false")).collect() == []


def test_pieces_are_the_documents_ids(spark, odd, none):
    library = Tokenizer.from_file(tokenizer(FILE))
    texts = [*TEXTS, None, "many words " * 5000, "word " * 4095, "word " * 4096] + [f"text number {i} " * (i % 90) for i in range(300)]
    ids = [e.ids + [1] for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    rows = place(cut(frame, tokenizer(FILE))).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        before = found.setdefault(r.doc_id, [])
        assert (r.piece, r.start) == (len(before), sum(map(len, before)))
        part = np.frombuffer(r.ids, "<u4").tolist()
        assert r.length == len(part) and zlib.crc32(r.ids) == zlib.crc32(np.array(part, "<u4").tobytes())
        before.append(part)
    assert [sum(found[i], []) for i in range(len(texts))] == ids
    assert all(len(p) == 4096 for parts in found.values() for p in parts[:-1])
    assert len(sequences(rows)) == least_bins(np.array([len(p) for parts in found.values() for p in parts]), 4096)
    many = sum(len(library.encode(r.text or "").ids) + 1 for r in odd.collect())
    assert sum(r.length for r in place(cut(odd, tokenizer(FILE))).collect()) == many
    assert place(cut(none, tokenizer(FILE))).collect() == []
