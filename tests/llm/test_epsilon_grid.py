import os
import threading
from contextlib import suppress

import numpy as np
import pytest

from tallyline.llm.epsilon_grid import _edges, near_vectors
from .conftest import union_find


def brute_force(rows, cosine):
    dims = max((len(v) for _, v in rows if v), default=1)
    unit = {}
    for i, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.zeros(dims)
            x[: len(v)] = np.array(v, np.float32)
            unit[i] = x / np.linalg.norm(x)
    edges = [(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= cosine]
    label = union_find(range(len(rows)), edges)
    ids = {}
    for i, (key, _) in enumerate(rows):
        ids.setdefault(label[i], []).append(key)
    out = []
    for i, (key, _) in enumerate(rows):
        least = min((k for k in ids[label[i]] if k is not None), default=None)
        out.append((key, sum(i in e for e in edges), least, key == least))
    return sorted(out, key=repr)


def told(spark, rows, kind="float", **settings):
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], f"vec_id long, embedding array<{kind}>, n long, first int")
    got = near_vectors(frame, **settings).collect()
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=repr)


@pytest.mark.parametrize(("dims", "size", "cosine"), [(3, 16, 0.95), (40, 7, 0.95), (2, 64, 0.9999)])
def test_against_brute_force(spark, dims, size, cosine):
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(40, dims))
    vectors = [centres[i % 40] + rng.normal(size=dims) * rng.choice([0, 0.05, 0.2]) for i in range(600)]
    vectors += [vectors[0]] * 50 + [vectors[1] * 3] + [-vectors[2]]
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(vectors)]
    want = brute_force(rows, cosine)
    assert told(spark, rows, size=size, cosine=cosine) == want
    assert sum(w[1] > 0 for w in want) > 200


def test_odd_rows(spark):
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
        (7, [1.0, 2.0]), (7, [1.0, 2.0]), (None, [1.0, 2.0]), (8, [1.0, 2.0, 0.0]), (9, [2.0, 1.0]), (None, [5.0, -1.0]),
        (None, None), (None, [-1.0, 0.0]), (1, [1.0, 2.0, 0.0001]),
    ]
    assert told(spark, rows) == brute_force(rows, 0.95)
    assert told(spark, [], kind="double") == []
    assert told(spark, rows[:6], kind="double") == brute_force(rows[:6], 0.95)


def test_bytes_on_disk_do_not_grow_with_the_pairs_of_blocks(spark):
    """Vectors spread alike in all axes leave nearly all pairs of blocks to compare."""
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(4000, 64))
    vectors[:800] = vectors[0] + rng.normal(size=(800, 64)) * 0.05
    vectors[800:1000] = vectors[1000:1200] + rng.normal(size=(200, 64)) * 0.1
    vectors = np.float32(vectors)
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    label = union_find(range(4000), zip(*map(np.ndarray.tolist, np.nonzero(np.triu(near))), strict=True))

    folders = [f.getPath() for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    seen, over = [], threading.Event()

    def watch():
        while not seen or not over.wait(0.05):
            files = [os.path.join(at, f) for folder in folders for at, _, names in os.walk(folder) for f in names if f.startswith("shuffle_")]
            with suppress(FileNotFoundError):  # Spark deletes some meanwhile
                seen.append(sum(map(os.path.getsize, files)))

    watcher = threading.Thread(target=watch)
    name = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(name, "-1")
    try:
        frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(4)
        watcher.start()
        rows = sorted(near_vectors(frame, size=64).collect())
    finally:
        over.set()
        spark.conf.unset(name)
    watcher.join()
    assert max(seen) - seen[0] < 8 * vectors.nbytes
    assert [(r.vec_id, r.n_links, r.component_id) for r in rows] == [(i, near[i].sum(), label[i]) for i in range(4000)]


@pytest.mark.parametrize("share", [0.02, 0.3, 0.6, 1])
def test_edges_connect_what_the_mask_does(share):
    rng = np.random.default_rng(1)
    mask = np.zeros((40, 60), bool)
    mask[:30, :45] = rng.random((30, 45)) < share
    mask[30:, 50:] = rng.random((10, 10)) < share
    rows, columns = np.arange(40), np.arange(100, 160)
    want = union_find([*rows, *columns], zip(*(x.tolist() for x in (rows[np.nonzero(mask)[0]], columns[np.nonzero(mask)[1]])), strict=True))
    assert union_find([*rows, *columns], zip(*map(np.ndarray.tolist, _edges(mask, rows, columns)), strict=True)) == want
