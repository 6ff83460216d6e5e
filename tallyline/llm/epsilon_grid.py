"""Near duplicates among vectors: an epsilon grid order join on cosine similarity.

Vectors of length 1 with a cosine of t or more lie within eps = sqrt(2 - 2t), an angle of
acos(t). A random few of them are reference vectors, which are turned to the principal axes
of all (that keeps distances) and sorted by the cells of a grid of width eps on the leading
axes. Each vector goes to its nearest reference vector, those nearest to it first, and
runs of them are blocks, with the box that holds them in the leading axes. Runs of
reference vectors are stripes, a file each in the folder that executors share.

A task holds one stripe and reads others in its turn. Pairs of vectors are left out only
where it is proved that they don't link: where the boxes of two blocks are further apart
than eps; or where a vector's angle to a block's reference vector is greater than that of
any vector of the block by more than acos(t). They are linked unseen only where the sum of
these angles is acos(t) at most. All others are compared, in single precision with a bound
on its rounding, and what isn't ruled out by that in double precision, on the vectors as
given. Of two vectors, the one nearer to its own reference vector is on the block's side.

Vectors are dealt to their stripe once, whatever the number of pairs. Equal vectors are one
class and are compared once. Only counts of links and a spanning forest leave a task, never
the links themselves.

Defined results: vectors that are null, empty, zero, or hold null or non-finite numbers
link with nothing. A shorter vector counts as one with zeros behind it. Rows with equal
vectors link with each other, also with equal or null ids; a component's id is its least
non-null id. Other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.components import components
from tallyline.llm.frames import col, evenly_joined, identity, reliable, sent

COSINE = 0.95
#: Vectors of a block at most, leading axes with cells, and those with boxes.
BLOCK = 256
CELLS = 8
AXES = 16
#: Added to eps where boxes are compared, for rounding.
MARGIN = 1e-9
#: Vectors of a block that have a bound on their angle to the reference vector in common.
SHELL = 48
#: Reference vectors at most, and their bytes; below, this power of the number of vectors.
REFERENCES = 32_768
REFERENCE_BYTES = 16_000_000
POWER = 0.62
#: Bytes of a stripe in single precision (beyond, there are more stripes), and stripes of fewer vectors.
STRIPE_BYTES = 64_000_000
STRIPES = 8
#: Vectors that a task holds against its stripe at once, and dots with reference vectors.
AT_ONCE = 32_768
DOTS = 2**23
#: Edges that a task gathers before it makes a forest of them.
EDGES = 500_000


def valid(vector: Column) -> Column:
    """Whether a vector has a direction."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column, with zeros behind shorter ones."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return values.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), values.dtype)
    out[np.arange(dims) < sizes[:, None]] = values
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def principal_axes(classes: DataFrame, dims: int) -> np.ndarray:
    """Orthonormal axes (columns), those of greatest variance first, over all vectors."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1))
        for batch in batches:
            rows = _unit(_matrix(batch.column("vector"), dims))
            rows = np.hstack([rows, np.ones((len(rows), 1))])
            total += rows.T @ rows
        yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "x"])

    told = classes.select("vector").mapInArrow(moments, "at long, x double").groupBy("at").agg(F.sum("x").alias("x"))
    total = np.zeros((dims + 1) ** 2)
    for row in told.toLocalIterator():
        total[row["at"]] = row["x"]
    total = total.reshape(dims + 1, dims + 1)
    many = max(total[-1, -1], 1)
    mean = total[-1, :-1] / many
    _, axes = np.linalg.eigh(total[:-1, :-1] / many - np.outer(mean, mean))
    return np.ascontiguousarray(axes[:, ::-1])


def references(classes: DataFrame, dims: int, count: int, axes: np.ndarray, eps: float) -> np.ndarray:
    """Some classes' vectors (rows, length 1), chosen by their hash, in grid order."""
    most = max(1, min(REFERENCES, REFERENCE_BYTES // (4 * dims)))
    share = min(most, max(64, count**POWER)) / count
    some = classes if share >= 1 else classes.where(F.col("c1") < int(share * 2**64) - 2**63)
    told = some.select("c1", "c2", "vector").toArrow()
    if not told.num_rows:
        told = classes.select("c1", "c2", "vector").limit(1).toArrow()
    rows = _unit(_matrix(told.column("vector").combine_chunks(), dims))
    rows = rows[np.lexsort([told.column(c).to_numpy() for c in ("c2", "c1")])]
    cell = np.floor(rows @ axes[:, :CELLS] / eps)
    return rows[np.lexsort(cell.T[::-1])].astype(np.float32)


def blocks(classes: DataFrame, dims: int, count: int, axes: np.ndarray, near: np.ndarray, size: int) -> DataFrame:
    """(task, start, reference, n, lowest, highest, homes, weights, keys, vectors): stored blocks, a file for each stripe.

    ``classes`` has c1, c2, n and vector, ``near`` the reference vectors. A vector's number is
    2^32 times its block's task, plus its block's start, plus its place in the block.
    """
    shared = classes.sparkSession.sparkContext.broadcast((axes[:, : max(AXES, CELLS)], near))
    stripes = max(math.ceil(count * dims * 4 / STRIPE_BYTES), min(STRIPES, math.ceil(count / (4 * size))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = shared.value[1]
        step = max(64, DOTS // len(near))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                dots = _unit(_matrix(part.column("vector"), dims)).astype(np.float32) @ near.T
                best = dots.argmax(1)
                told = [best * stripes // len(near), best, dots[np.arange(len(best)), best]]
                added = [pa.array(x, k) for x, k in zip(told, (pa.int32(), pa.int32(), pa.float32()), strict=True)]
                yield pa.record_batch([*part.columns, *added], [*batch.schema.names, "stripe", "reference", "home"])

    kind = classes.schema["vector"].dataType.simpleString()
    placed = classes.select("c1", "c2", "n", "vector").mapInArrow(
        place, f"c1 long, c2 long, n long, vector {kind}, stripe int, reference int, home float"
    )
    # A stripe has as many reference vectors as any other, which are a random few of all vectors.
    dealt = placed.repartitionById(stripes, F.col("stripe"))
    ordered = dealt.sortWithinPartitions("reference", F.col("home").desc(), "c1", "c2")
    is_float = kind == "array<float>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, start, held, many, last = TaskContext.get().partitionId(), 0, [], 0, -1

        def block(table: pa.Table) -> pa.RecordBatch:
            rows = _matrix(table.column("vector").combine_chunks(), dims)
            points = _unit(rows) @ shared.value[0]
            columns = [
                [task], [start], [last], [len(rows)], [points.min(0).tolist()], [points.max(0).tolist()],
                [table.column("home").to_numpy().astype("<f4").tobytes()],
                [table.column("n").to_numpy().astype("<i8").tobytes()],
                [np.stack([table.column(c).to_numpy() for c in ("c1", "c2")], 1).astype("<i8").tobytes()],
                [rows.astype("<f4" if is_float else "<f8").tobytes()],
            ]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.list_(pa.float64())] * 2, *[pa.binary()] * 4]
            names = ["task", "start", "reference", "n", "lowest", "highest", "homes", "weights", "keys", "vectors"]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            of = batch.column("reference").to_numpy()
            at = 0
            while at < batch.num_rows:
                if many and (many == size or of[at] != last):
                    yield block(pa.Table.from_batches(held))
                    start, held, many = start + many, [], 0
                last = int(of[at])
                part = batch.slice(at, min(size - many, int(np.searchsorted(of, last, "right")) - at))
                held, many, at = [*held, part], many + part.num_rows, at + part.num_rows
        if many:
            yield block(pa.Table.from_batches(held))

    schema = (
        "task int, start long, reference int, n int, lowest array<double>, highest array<double>,"
        " homes binary, weights binary, keys binary, vectors binary"
    )
    return reliable(ordered.mapInArrow(cut, schema))


def _forest(rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the nodes of the edges."""
    nodes, at = np.unique(np.concatenate([rows, columns]), return_inverse=True)
    a, b = at[: len(rows)], at[len(rows) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _edges(mask: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows and columns at the trues of a mask, or if these are many, others that connect the same."""
    if np.count_nonzero(mask) <= 4 * sum(mask.shape):
        r, c = np.nonzero(mask)
        return rows[r], columns[c]
    none = np.int32(len(columns))
    label = np.arange(none, dtype=np.int32)
    while True:
        least = np.where(mask, label, none).min(1)
        new = np.minimum(label, np.where(mask, least[:, None], none).min(0))
        new = new[new]
        if (new == label).all():
            break
        label = new
    some = least < none
    return np.concatenate([rows[some], columns]), np.concatenate([columns[least[some]], columns[label]])


def _read(file: str, columns: list[str]) -> pa.Table:
    """Columns of a stored file, in the order of its rows."""
    system, path = pafs.FileSystem.from_uri(file)
    with system.open_input_file(path) as source:
        return pq.ParquetFile(source).read(columns, use_threads=False)


class _Stripe:
    """The blocks of a stored file."""

    def __init__(self, file: str, dims: int, dtype: str) -> None:
        self.file, self.dims, self.dtype = file, dims, dtype
        table = _read(file, ["task", "start", "reference", "n", "lowest", "highest"])
        task, start, self.reference, self.n = (table.column(c).to_numpy().astype(np.int64) for c in table.column_names[:4])
        self.lowest, self.highest = (np.array(table.column(c).to_pylist()) for c in ("lowest", "highest"))
        self.begin = np.concatenate([[0], np.cumsum(self.n)])
        place = np.arange(self.begin[-1]) - np.repeat(self.begin[:-1], self.n)
        self.node = np.repeat((task << 32) + start, self.n) + place

    def load(self) -> _Stripe:
        table = _read(self.file, ["homes", "weights", "vectors"])
        homes, weights, vectors = (b"".join(x.as_buffer() for x in table.column(c)) for c in table.column_names)
        self.home, self.weight = np.frombuffer(homes, "<f4"), np.frombuffer(weights, "<i8").astype(np.float64)
        self.vectors = np.frombuffer(vectors, self.dtype).reshape(-1, self.dims)
        self.single = np.empty(self.vectors.shape, np.float32)
        for at in range(0, len(self.vectors), 4096):
            self.single[at : at + 4096] = _unit(self.vectors[at : at + 4096])
        return self

    def parts(self, most: int) -> Iterator[_Stripe]:
        """Runs of blocks of about so many vectors."""
        to = 0
        while to < len(self.n):
            at = to
            to = max(at + 1, int(np.searchsorted(self.begin, self.begin[at] + most, "right")) - 1)
            part = copy(self)
            part.reference, part.n, part.lowest, part.highest = (x[at:to] for x in (self.reference, self.n, self.lowest, self.highest))
            rows = slice(self.begin[at], self.begin[to])
            part.begin = self.begin[at : to + 1] - self.begin[at]
            part.node, part.home, part.weight = self.node[rows], self.home[rows], self.weight[rows]
            part.vectors, part.single = self.vectors[rows], self.single[rows]
            yield part


def _near(a: _Stripe, b: _Stripe, eps: float) -> np.ndarray:
    """Whether boxes of blocks of ``a`` (rows) and of ``b`` are not further apart than eps."""
    square = np.zeros((len(a.n), len(b.n)))
    for axis in range(a.lowest.shape[1]):
        gap = np.maximum(a.lowest[:, axis, None] - b.highest[:, axis], b.lowest[:, axis] - a.highest[:, axis, None])
        square += np.maximum(gap, 0) ** 2
    return square <= (eps + MARGIN) ** 2


def _compared(file: str, others: list[str], near: np.ndarray, dims: int, cosine: float, eps: float, dtype: str) -> Iterator[pa.RecordBatch]:
    """(node, links, other) of the pairs with a vector of the file's blocks and one of the others'."""
    x = _Stripe(file, dims, dtype).load()
    # Shells of a block: where they begin, and all end.
    of_block = [np.arange(i, j, SHELL) for i, j in zip(x.begin[:-1], x.begin[1:], strict=True)]
    shells = np.concatenate([*of_block, x.begin[-1:]])
    first_of = np.concatenate([[0], np.cumsum([len(told) for told in of_block])])
    weight = np.add.reduceat(x.weight, shells[:-1])
    # What single precision may be wrong by, in a dot of vectors of length 1.
    slack = (dims + 16) * 2.0**-23
    highest, lowest = x.home[shells[:-1]], x.home[shells[1:] - 1]
    wide, most = np.arccos(np.clip(lowest.astype(np.float64) - slack, -1, 1)), math.acos(cosine)
    reach = (np.cos(np.minimum(wide + most, np.pi)) - slack).astype(np.float32) - np.float32(1e-7)
    # From here on (a cosine above 1 is none) a vector links with all of the shell.
    sure = np.where(wide < most, np.cos(np.maximum(most - wide, 0)) + slack, 2).astype(np.float32) + np.float32(1e-7)
    links, edges, gathered, kept = np.zeros(len(x.node)), [], 0, 0

    def told(nodes: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(links)
        columns = [pa.array(nodes[some]), pa.array(links[some].astype(np.int64)), pa.nulls(len(some), pa.int64())]
        return pa.record_batch(columns, ["node", "links", "other"])

    def pairs() -> Iterator[tuple[_Stripe, np.ndarray]]:
        for other in others:
            y = x if other == file else _Stripe(other, dims, dtype)
            if _near(x, y, eps).any():
                for part in (y if y is x else y.load()).parts(AT_ONCE):
                    yield part, _near(x, part, eps)

    for y, close in pairs():
        counts, held, window = np.zeros(len(y.node)), 0, max(1, DOTS // len(y.node))
        dots = np.zeros((0, len(y.node)), np.float32)
        for b in np.flatnonzero(close.any(1)):
            if not held <= x.reference[b] < held + len(dots):
                held = int(x.reference[b])
                dots = near[held : held + window] @ y.single.T
            to_reference = dots[x.reference[b] - held]
            own = slice(first_of[b], first_of[b + 1])
            may = (to_reference >= reach[own].min()) & (y.home <= highest[own].max())
            if not close[b].all():
                may &= np.repeat(close[b], y.n)
            may = np.flatnonzero(may)
            to_reference, home = to_reference[may], y.home[may]
            for shell in range(first_of[b], first_of[b + 1]):
                i, j = shells[shell], shells[shell + 1]
                here = np.flatnonzero((to_reference >= reach[shell]) & (home <= highest[shell]))
                if not len(here):
                    continue
                at = may[here]
                all_linked = (to_reference[here] >= sure[shell]) & (home[here] < lowest[shell])
                if all_linked.any():
                    linked, at = at[all_linked], at[~all_linked]
                    links[i:j] += y.weight[linked].sum()
                    counts[linked] += weight[shell]
                    joined = np.concatenate([x.node[i + 1 : j], y.node[linked]])
                    edges.append((joined, np.full(len(joined), x.node[i])))
                    gathered += len(joined)
                    if not len(at):
                        continue
                similar = y.single.take(at, 0) @ x.single[i:j].T
                if similar.max() < cosine - slack:
                    continue
                similar = similar >= cosine - slack
                r, c = i + np.flatnonzero(similar.any(0)), at[similar.any(1)]
                mask = _unit(x.vectors[r]) @ _unit(y.vectors[c]).T >= cosine
                ours, theirs = x.home[r, None], y.home[None, c]
                mask &= (ours > theirs) | ((ours == theirs) & (x.node[r, None] < y.node[None, c]))
                if mask.any():
                    links[r] += mask @ y.weight[c]
                    counts[c] += x.weight[r] @ mask
                    edges.append(_edges(mask, x.node[r], y.node[c]))
                    gathered += len(edges[-1][0])
            if gathered > EDGES + 2 * kept:
                edges = [_forest(*map(np.concatenate, zip(*edges, strict=True)))]
                gathered = kept = len(edges[0][0])
        yield told(y.node, counts)
    yield told(x.node, links)
    if edges:
        nodes, least = _forest(*map(np.concatenate, zip(*edges, strict=True)))
        yield pa.record_batch([pa.array(nodes), pa.array(np.zeros(len(nodes), np.int64)), pa.array(least)], ["node", "links", "other"])


def compare(stored: DataFrame, near: np.ndarray, dims: int, cosine: float, eps: float, dtype: str) -> DataFrame:
    """(node, links, other): rows with links to add to a node's count, and edges of spanning forests."""
    spark = stored.sparkSession
    files = sorted(stored.inputFiles())
    shared = spark.sparkContext.broadcast((files, near))
    # A task has a stripe and a run of the others.
    run = max(1, len(files) // STRIPES)
    runs = math.ceil(len(files) / run)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, near = shared.value
        for batch in batches:
            for task in batch.column("id").to_pylist():
                mine, at = files[task // runs], task % runs * run
                yield from _compared(mine, files[at : at + run], near, dims, cosine, eps, dtype)

    tasks = len(files) * runs
    return spark.range(0, tasks, 1, tasks).mapInArrow(work, "node long, links long, other long")


def near_vectors(
    frame: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, size: int = BLOCK
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of the frame."""
    if not 0 < cosine <= 1:
        raise ValueError("a cosine above 0, 1 at most, is asked for")
    c1, c2 = identity(F.col("vector"))
    held = sent(frame).select(col(vec_id).alias("vec_id"), col(vector).alias("vector"))
    keyed = held.withColumns({"c1": c1, "c2": c2, "valid": valid(F.col("vector"))})
    classes = reliable(
        keyed.where("valid").groupBy("c1", "c2")
        .agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    )
    stats = classes.agg(F.max(F.size("vector")).alias("dims"), F.count("*").alias("n")).first()
    dims, count = stats["dims"] or 1, stats["n"]
    eps = math.sqrt(2 - 2 * cosine) or MARGIN
    dtype = "<f4" if classes.schema["vector"].dataType.simpleString() == "array<float>" else "<f8"
    axes = principal_axes(classes, dims)
    if count:
        chosen = references(classes, dims, count, axes, eps)
        stored = blocks(classes, dims, count, axes, chosen, size)
        found = reliable(compare(stored, chosen, dims, cosine, eps, dtype))
    else:
        stored = frame.sparkSession.createDataFrame([], "task int, start long, keys binary")
        found = frame.sparkSession.createDataFrame([], "node long, links long, other long")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task, start, keys in zip(*(batch.column(c).to_pylist() for c in ("task", "start", "keys")), strict=True):
                told = np.frombuffer(keys, "<i8").reshape(-1, 2)
                node = (task << 32) + start + np.arange(len(told))
                yield pa.record_batch([pa.array(told[:, 0].copy()), pa.array(told[:, 1].copy()), pa.array(node)], ["c1", "c2", "node"])

    nodes = stored.select("task", "start", "keys").mapInArrow(keys_of, "c1 long, c2 long, node long")
    linked = (
        nodes.join(links, "node").join(labels, "node")
        .join(classes.select("c1", "c2", "first"), ["c1", "c2"])
    )
    of_label = reliable(linked.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("n")))
    told = evenly_joined(linked.drop("first"), of_label, ["label"], "n").select("c1", "c2", "links", "component_id")
    of_class = classes.select("c1", "c2", "first", "n").join(told, ["c1", "c2"], "left").select(
        "c1", "c2", "n",
        (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component_id", "first").alias("component_id"),
    )
    # Vectors that can't link have no class.
    ids = keyed.select("vec_id", F.when(F.col("valid"), F.col("c1")).otherwise(F.xxhash64("vec_id")).alias("c1"), "c2", "valid")
    return evenly_joined(ids, reliable(of_class), ["c1", "c2"], "n").select(
        "vec_id",
        F.when(F.col("valid"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"),
        F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
