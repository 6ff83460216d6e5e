"""Near duplicates by HyperMinHash: documents whose sets of word shingles are alike.

Words are lower case and cut at white space; a document's set has its distinct shingles of
five words (one of all its words if it has fewer). Documents are linked if
``100 * intersection >= percent * union``; groups are connected components of links.

1. Documents with equal sets are one node. A node has 128 registers of 16 bits: the least
   hash in a bucket, as its count of leading zeros and its next ten bits.
2. Banding: five registers make a key, 25 keys a node. Two nodes that are just linked share
   none with a chance of 4 * 10^-7 at 85 percent and 5 * 10^-5 at 80. In a bucket of up to
   eight nodes all pairs are compared, in a larger one every node with one pivot at first.
   The Jaccard estimate from the registers, corrected for chance collisions, drops what lies
   five standard deviations below the threshold; the rest is verified on full sets.
3. Components are found. In larger buckets that still hold several, the registers of all
   pairs are compared, block by block, but for pairs that are connected already or whose sets
   differ too much in size. A pair counts in the first bucket that it shares only.
4. Nodes that have a pair above the estimate's floor are compared in full inside tasks, block
   by block; only edges leave the task.

So every pair that shares a bucket is compared or connected already, however large the
bucket: two linked nodes are only missed by banding or by the estimate's floor. The work of
step 3 grows with the square of a bucket that holds strangers, that of step 4 with the square
of a group whose members are neither linked nor far from each other.

A group of copies is never expanded into pairs: equal sets are one node, and near copies
cost a pair with each of their pivots.

Defined results: a document without words, or a null text, has an empty set and is a
component of its own. Rows with equal sets share a component, also with equal or null ids.
A component's id is its least non-null doc_id, null if it has none; the row with that id
stands for it (of several, that with the least hash). Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm import words as W
from tallyline.llm.bloom import bloom_filter, maybe
from tallyline.llm.components import components
from tallyline.llm.frames import col, few_at_once, identity, reliable, scratch, sent, slices, text_bytes, unused

SHINGLE = 5
PERCENT = 80
BUCKETS = 128
MANTISSA = 10
BAND = 5
BANDS = BUCKETS // BAND
#: Buckets of at most so many nodes are compared in full at once; a node of a larger one with its pivot.
SMALL = 8
#: Nodes of a block: where registers are compared, and where full sets are; there, a block has
#: SHINGLES shingles at most for each node that it may have, so that long texts make small blocks.
NEAR, BLOCK, SHINGLES = 1024, 1024, 1024
#: Chance collisions of registers, at most: 0.17 * 2^(p - r) for 2^p buckets and r bits.
COLLISIONS = 0.17 * BUCKETS / (1 << MANTISSA)
#: Up to so many nodes (24 bytes each) a list of nodes is broadcast; beyond, it is shuffled.
BROADCAST_NODES = 200_000


def distinct_shingles(found: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the number of the first one of each."""
    hashes, first = W.shingles(found, SHINGLE)
    for begin, end in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        hashes[begin:end].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[first[:-1][np.diff(first) > 0]] = True
    return hashes[new], np.concatenate([[0], np.cumsum(new)])[first]


def registers(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """BUCKETS registers of 16 bits for each text; 0 where a bucket has no shingle.

    The first bits of a hash name its bucket. Of the least of the rest in a bucket, a
    register has the number of leading zeros (6 bits) and the MANTISSA bits after the
    first one.
    """
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = doc * BUCKETS + (hashes >> np.uint64(57)).astype(np.int64)
    least = np.ones(len(place), bool)
    least[1:] = place[1:] != place[:-1]
    rest = hashes[least] << np.uint64(7)
    zeros = np.minimum(53 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1], 53).astype(np.uint64)
    bits = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out = np.zeros((len(first) - 1) * BUCKETS, np.uint16)
    out[place[least]] = ((zeros + np.uint64(1)) << np.uint64(MANTISSA)) | bits
    return out.reshape(-1, BUCKETS)


def _registers_of(column: pa.Array | pd.Series) -> np.ndarray:
    rows = column.to_pylist() if isinstance(column, pa.Array) else column
    return np.frombuffer(b"".join(rows), np.uint16).reshape(-1, BUCKETS)


def signatures(texts: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, s1, s2, n_shingles, registers) for each row of (doc_id, k1, k2, text).

    s1 and s2 stand for the set: sums of two hashes of its shingles; null if it is empty.
    """
    kind = texts.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, first = distinct_shingles(W.words(*text_bytes(batch.column("text")), W.UNSPACED))
            many = np.diff(first)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(W.mixed(hashes ^ np.uint64(s)))])[first] for s in (1, 2)]
            held = registers(hashes, first)
            yield pa.record_batch(
                [
                    *(batch.column(c) for c in ("doc_id", "k1", "k2")),
                    *(pa.array(np.diff(s).view(np.int64), mask=many == 0) for s in sums),
                    pa.array(many.astype(np.int64)),
                    pa.array([r.tobytes() if m else None for r, m in zip(held, many, strict=True)], pa.binary()),
                ],
                ["doc_id", "k1", "k2", "s1", "s2", "n_shingles", "registers"],
            )

    schema = f"doc_id {kind}, k1 long, k2 long, s1 long, s2 long, n_shingles long, registers binary"
    return texts.select("doc_id", "k1", "k2", "text").mapInArrow(sign, schema)


def _keyed(nodes: pa.Array, keys: np.ndarray, held: np.ndarray) -> pa.RecordBatch:
    """(key, node) for each place of ``keys``, a row for each node, where ``held`` says so."""
    row, _ = np.nonzero(held)
    return pa.record_batch([pa.array(keys[held].view(np.int64)), nodes.take(pa.array(row))], ["key", "node"])


def _bands(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each row and band, and whether the band has a register that is not empty."""
    held = held[:, : BANDS * BAND].reshape(-1, BANDS, BAND)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), held.shape[:2])
    for i in range(BAND):
        keys = W.mixed(keys ^ held[:, :, i])
    return keys, held.any(axis=2)


def band_keys(nodes: DataFrame, among: np.ndarray | None = None) -> DataFrame:
    """(key, node): a key for each band that is not empty; only those that pass a filter, if given."""
    shared = None if among is None else nodes.sparkSession.sparkContext.broadcast(among)

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, told = _bands(_registers_of(batch.column("registers")))
            if shared is not None:
                told &= maybe(shared.value, keys.ravel()).reshape(keys.shape)
            yield _keyed(batch.column("node"), keys, told)

    return nodes.select("node", "registers").mapInArrow(band, "key long, node long")


def _likely(percent: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether registers (rows) may be those of linked nodes: five standard deviations."""
    link = percent / 100

    def likely(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        occupied = np.maximum(((x > 0) | (y > 0)).sum(1), 1)
        same = ((x == y) & (x > 0)).sum(1)
        estimate = (same - COLLISIONS) / occupied
        return estimate >= link - 5 * np.sqrt(link * (1 - link) / occupied) - COLLISIONS / occupied

    return likely


def estimated(pairs: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose estimated similarity can be that of a link."""
    held = live.select("node", "registers")
    joined = pairs.join(held.toDF("b", "rb"), "b").join(held.toDF("a", "ra"), "a")
    likely = _likely(percent)

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(likely(_registers_of(x), _registers_of(y)))

    return joined.where(alike("ra", "rb")).select("a", "b")


def _few(frame: DataFrame) -> DataFrame:
    """A frame of ids, to be broadcast if it is small."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_NODES else frame


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are linked, by the full sets of their whole texts; computed once."""
    wanted = reliable(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    known = texts.join(_few(wanted), "node").select("node", "text")
    joined = pairs.join(known.toDF("b", "y"), "b").join(known.toDF("a", "x"), "a").select("a", "b", "x", "y")

    def sets(column: pa.Array) -> list[np.ndarray]:
        hashes, first = distinct_shingles(W.words(*text_bytes(column), W.UNSPACED))
        return [hashes[i:j] for i, j in zip(first[:-1], first[1:], strict=True)]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "y"):
            _, at, of_row = np.unique(batch.column("a").to_numpy(), return_index=True, return_inverse=True)
            xs, ys = sets(batch.column("x").take(pa.array(at))), sets(batch.column("y"))
            linked = []
            for x, y in zip((xs[i] for i in of_row), ys, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    with few_at_once(pairs.sparkSession):
        return reliable(joined.mapInArrow(compare, "a long, b long"))


def linked_nodes(nodes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(node, label) of the nodes that have links; a label stands for a component."""
    spark = nodes.sparkSession
    shared = reliable(band_keys(nodes).groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1"))
    rows = reliable(band_keys(nodes, bloom_filter(shared, "key")).join(shared, "key"))
    # Nodes that share a key with another one; their texts are written once.
    live = reliable(nodes.select("node", "k1", "k2", "n_shingles", "registers").join(rows.select("node").distinct(), "node", "left_semi"))
    place = scratch(spark, "near-duplicates")
    once = texts.join(_few(live.select("node", "k1", "k2")), ["k1", "k2"]).select("node", "text").dropDuplicates(["node"])
    once.write.parquet(place)
    texts = spark.read.schema("node long, text string").parquet(place)
    edges = verified(reliable(estimated(_pairs(rows), live, percent)), texts, percent)
    labels = components(edges)
    rows = reliable(_unsettled(rows.where(f"n > {SMALL}"), labels))
    if rows.isEmpty():
        return labels
    near = reliable(near_nodes(rows, live, percent))
    return components(reliable(edges.union(compared(near, live, texts, percent))))


def _unsettled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components, with each node's label."""
    told = reliable(_labelled(rows, labels))
    several = told.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return told.join(several.select("key"), "key", "left_semi")


def _in_blocks(rows: DataFrame, size: int) -> DataFrame:
    """(key, node, label, low, high): each row of (key, node, label, n) with each block of its bucket.

    Blocks have about ``size`` nodes; (low, high) names two of them, or one twice.
    """
    blocks = F.ceil(F.col("n") / size)
    dealt = rows.withColumn("mine", F.pmod(F.xxhash64("node"), blocks)).withColumn(
        "other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int")))
    )
    return dealt.select("key", "node", "label", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))


def _earlier(held: np.ndarray, key: int) -> np.ndarray:
    """Each row's keys of the bands before that of ``key``; an empty band's differ from row to row."""
    keys, told = _bands(held)
    band = int(np.flatnonzero(told[0] & (keys[0].view(np.int64) == key))[0])
    return np.where(told, keys, np.arange(len(keys), dtype=np.uint64)[:, None])[:, :band]


def near_nodes(rows: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """(key, node, label, n) of the nodes of (key, node, label, n) that have a pair to compare in full.

    The pair's estimate and sizes can be those of a link, it isn't connected, and the bucket is
    the first one that it shares. n counts the nodes that are left in a bucket, more if they
    have more than SHINGLES shingles each.
    """
    joined = _in_blocks(rows, NEAR).join(live.select("node", "n_shingles", "registers"), "node")
    likely = _likely(percent)

    def near(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        label, many = group.column("label").to_numpy(), group.column("n_shingles").to_numpy()
        held = _registers_of(group.column("registers").chunk(0))
        earlier = _earlier(held, group.column("key")[0].as_py())
        chosen = np.zeros(len(label), bool)
        for i in range(1, len(label)):
            small, large = np.minimum(many[:i], many[i]), np.maximum(many[:i], many[i])
            others = np.flatnonzero((label[:i] != label[i]) & (100 * small >= percent * large))
            others = others[likely(held[others], held[i])]
            others = others[~(earlier[others] == earlier[i]).any(1)]
            chosen[others] = True
            chosen[i] |= len(others) > 0
        return group.select(["key", "node", "label", "n_shingles"]).filter(pa.array(chosen))

    found = joined.groupBy("key", "low", "high").applyInArrow(near, "key long, node long, label long, n_shingles long")
    found = reliable(found.distinct())
    size = F.greatest(F.count("*"), F.ceil(F.sum("n_shingles") / SHINGLES)).alias("n")
    return found.drop("n_shingles").join(found.groupBy("key").agg(size), "key")


def compared(rows: DataFrame, live: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect what is linked in each bucket of (key, node, label, n); computed once.

    Nodes of a bucket are compared with each other inside a task, blocks of about BLOCK at
    a time; pairs that are connected already, or meet in an earlier bucket too, are left
    out. Only edges leave the task.
    """
    joined = _in_blocks(rows, BLOCK).join(live.select("node", "registers"), "node").join(texts, "node")
    likely = _likely(percent)

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        nodes, label = group.column("node").to_numpy(), group.column("label").to_numpy().copy()
        hashes, first = distinct_shingles(W.words(*text_bytes(group.column("text").chunk(0)), W.UNSPACED))
        held = _registers_of(group.column("registers").chunk(0))
        earlier = _earlier(held, group.column("key")[0].as_py())
        edges = []
        for i in range(len(nodes)):
            others = np.flatnonzero(label[:i] != label[i])
            x = hashes[first[i] : first[i + 1]]
            others = others[~(earlier[others] == earlier[i]).any(1)]
            for j in others[likely(held[others], held[i])]:
                if label[j] != label[i]:
                    y = hashes[first[j] : first[j + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        edges.append((nodes[j], nodes[i]))
                        label[label == label[j]] = label[i]
        a, b = zip(*edges, strict=True) if edges else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return reliable(joined.groupBy("key", "low", "high").applyInArrow(compare, "a long, b long"))


def _labelled(frame: DataFrame, labels: DataFrame) -> DataFrame:
    """The frame with the component of a node, which is the node itself where it has no link."""
    return frame.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) to compare at first.

    In a small bucket that is all pairs, in a larger one each node with the pivot.
    """
    first = rows.where(f"n <= {SMALL}").select("key", F.col("node").alias("a"))
    small = rows.join(first, "key").where("a < node")
    large = rows.where(f"n > {SMALL} AND pivot <> node")
    pairs = large.select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    return pairs.union(small.select("a", F.col("node").alias("b"))).distinct()


def near_duplicates(frame: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, k1, k2, n_shingles, component_id, kept) for each row of the frame.

    k1 and k2 are the hash of the row's id and text (see frames.identity). kept is true for
    the rows, equal in both, that stand for their group.
    """
    k1, k2 = identity(col(doc_id), col(text))
    texts = sent(frame).select(
        col(doc_id).alias("doc_id"), k1.alias("k1"), k2.alias("k2"), col(text).cast("string").alias("text")
    )
    with few_at_once(frame.sparkSession):
        signed = reliable(signatures(texts))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")
    nodes = reliable(
        signed.where("s1 IS NOT NULL")
        .groupBy("s1", "s2")
        .agg(F.min(place).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
        .select("s1", "s2", "first", "first.k1", "first.k2", "n_shingles", "registers")
        .withColumn("node", F.monotonically_increasing_id())
    )
    labels = linked_nodes(nodes, texts, percent)
    firsts = labels.join(nodes.select("node", "first"), "node").groupBy("label").agg(F.min("first").alias("of_group"))
    linked = labels.join(firsts, "label").select("node", "of_group")
    of_set = nodes.select("node", "s1", "s2", "first").join(linked, "node", "left").select(
        "s1", "s2", F.coalesce("of_group", "first").alias("of_group")
    )
    # Rows without words have keys of their own, so that they don't meet in one task.
    rows = signed.select("doc_id", "k1", "k2", "n_shingles", F.coalesce("s1", "k1").alias("s1"), F.coalesce("s2", "k2").alias("s2"))
    alone = F.col("n_shingles") == 0
    return rows.join(of_set, ["s1", "s2"], "left").select(
        "doc_id",
        "k1",
        "k2",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("of_group.doc_id")).alias("component_id"),
        (alone | ((F.col("k1") == F.col("of_group.k1")) & (F.col("k2") == F.col("of_group.k2")))).alias("kept"),
    )


def keep_one(frame: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row of each group of near duplicates: that with the least id (then the least hash).

    Rows equal in id and text are one document, of which one row stays, also without words.
    """
    k1, k2 = unused(frame, "k1", "k2")
    kept = near_duplicates(frame, doc_id, text, percent).where("kept").select("k1", "k2").distinct()
    keys = dict(zip((k1, k2), identity(col(doc_id), col(text)), strict=True))
    joined = frame.withColumns(keys).join(kept.toDF(k1, k2), [k1, k2], "left_semi")
    return joined.dropDuplicates([k1, k2]).drop(k1, k2)
