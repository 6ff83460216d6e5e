import random
import re

import numpy as np
import pytest

from tallyline.llm import hyperminhash
from tallyline.llm import words as W
from tallyline.llm.hyperminhash import (
    BAND,
    BANDS,
    BUCKETS,
    distinct_shingles,
    keep_one,
    linked_nodes,
    near_duplicates,
    registers,
)
from .conftest import union_find

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4) if own else 0))


def brute_force(docs, percent):
    """{id: (set size, component)} for documents with distinct ids."""
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    edges = []
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                edges.append((a, b))
    label = union_find(ids, edges)
    return {i: (len(sets[i]), label[i]) for i in ids}


def corpus(seed):
    """Copies, chains of near copies, a passage in most documents, and texts around the threshold."""
    rng = random.Random(seed)

    def prose(n):
        return [f"w{rng.randint(0, 5000)}" for _ in range(n)]

    def edited(base, times):
        out = list(base)
        for _ in range(times):
            out[rng.randrange(len(out))] = f"e{rng.randint(0, 10**6)}"
        return out

    passage, texts = prose(120), []
    for _ in range(40):
        texts.append(prose(rng.randint(1, 200)))
        texts.append(prose(rng.randint(20, 120)) + passage)
    base = prose(200)
    texts += [edited(base, rng.randint(0, 9)) for _ in range(60)]
    for size in (5, 12, 40, 300):
        chain = prose(size)
        for _ in range(8):
            chain = edited(chain, max(1, size // 60))
            texts.append(chain)
            texts.append(list(chain))
    for _ in range(30):
        one = prose(rng.randint(20, 150))
        texts += [one, edited(one, 1), edited(one, 2), one + prose(rng.randint(1, 12))]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "percent"), [(1, 85), (2, 80)])
def test_against_brute_force(spark, seed, percent):
    docs = corpus(seed)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame, percent=percent).collect()}
    want = brute_force(docs, percent)
    assert got == want
    assert len({c for _, c in want.values()}) < len(docs) - 60


def test_registers_hold_the_least_hash_of_a_bucket():
    text = np.frombuffer(b"a b c d e f g h i j k l m n o p q r s t u v w x y z", np.uint8)
    found = W.words(text, np.array([0, len(text)]), W.UNSPACED)
    hashes, first = distinct_shingles(found)
    held = registers(hashes, first)[0]
    for bucket in range(BUCKETS):
        own = [int(h) for h in hashes if int(h) >> 57 == bucket]
        if not own:
            assert held[bucket] == 0
            continue
        rest = f"{min(own) & ((1 << 57) - 1):057b}"
        zeros = len(rest) - len(rest.lstrip("0"))
        bits = (rest[zeros + 1 :] + "0" * 20)[:10]
        assert held[bucket] == ((zeros + 1) << 10) | int(bits, 2)


def test_odd_rows(odd, none):
    rows = near_duplicates(odd).collect()
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in rows}
    assert len(rows) == odd.count()
    assert got[1, 0] == (1, True) and got[2, 0] == (2, True) and got[3, 0] == (3, True)
    assert got[6, 6] == (6, True) and got[7, 6] == (6, False)
    assert got[None, 4] == (None, True) and got[8, 1] == (8, True)
    assert near_duplicates(none).collect() == []
    left = keep_one(odd)
    assert left.columns == odd.columns
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted([1, 2, 3, 4, None, 6, 8, 8], key=repr)


def test_a_large_group_of_copies_keeps_one(spark):
    near = "concat('the one text that all of them have in common, with many words so that', repeat(' a few more', 1), "
    frame = spark.range(2000).selectExpr(
        "id AS doc_id", near + "' of them that differ in nothing but their last word, which is ', id % 5) AS text"
    )
    assert [r.doc_id for r in keep_one(frame).collect()] == [0]


@pytest.mark.parametrize("shingles", [1024, 8])
def test_all_pairs_of_a_large_bucket_are_compared(spark, monkeypatch, shingles):
    """All 600 nodes share one bucket; each is linked to one other, which it meets in no other bucket.

    With 8 shingles a node, these are long texts: seven times as many blocks.
    """
    monkeypatch.setattr(hyperminhash, "SHINGLES", shingles)
    rng = np.random.default_rng(3)
    nodes, texts = [], []
    for pair in range(300):
        held = rng.integers(1, 1 << 16, BUCKETS).astype(np.uint16)
        held[:BAND] = range(1, BAND + 1)
        words = [f"p{pair}x{i}" for i in range(60)]
        for half in range(2):
            node, own = 2 * pair + half, held.copy()
            if half:
                own[np.arange(1, BANDS) * BAND + rng.integers(0, BAND, BANDS - 1)] ^= 1
            nodes.append((node, node, 0, 56, own.tobytes()))
            texts.append((node, 0, " ".join(words[:59] + [f"last{half}"])))
    frame = spark.createDataFrame(nodes, "node long, k1 long, k2 long, n_shingles long, registers binary")
    labels = linked_nodes(frame, spark.createDataFrame(texts, "k1 long, k2 long, text string"), 80)
    got = {}
    for row in labels.collect():
        got.setdefault(row.label, set()).add(row.node)
    assert sorted(map(sorted, got.values())) == [[2 * i, 2 * i + 1] for i in range(300)]
