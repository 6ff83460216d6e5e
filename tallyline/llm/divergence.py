"""Source divergence audit: how far apart the sources of a language are in their words.

Every language keeps the terms that stand in at least ``least`` of its documents. Each
(language, source) group has a price for each of them, in billionths of its occurrences
and smoothed. Two groups differ by the sum of the differences of their prices.

One-hot level products: a group's price depends on a term's count only, so that counts are
levels. Kept terms are dealt to blocks; in a block every (group, level) is an indicator
column over the terms, with level 0 for terms that the group doesn't have. The columns'
matrix multiplied by its transpose, tile by tile, is every joint table of two groups at
once: how many terms have one level here and another there. Each cell is priced once, by
the distance of its two levels. Terms of a block are taken in the order of their
frequency, and halved as long as that saves cells, so that the many rare terms, which have
few levels, go into one product. Sums of 0 and 1 are exact in double precision,
prices are integers, and blocks are added up as integers.

Defined results: null texts, languages and sources are empty ones. Every row counts as a
document of its own, also with an equal id. A group without terms is a group all the same.
A language without kept terms has distances of 0. Input columns other than text, language
and source are left out. An empty table gives no rows.

Texts are read twice: for the terms' documents, and for the counts of the terms that are
kept, told by a Bloom filter of bounded size and an exact join. Counting combines in each
task, so that a source or term with a third of all words is one row per task. A block has about ENTRIES counts, whatever the vocabulary, and the groups of
its language. Group totals are joined with SALTS copies each, so that no group's counts
meet in one task. The result has a row for each pair of sources of a language.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm import words as W
from tallyline.llm.bloom import bloom_filter, maybe
from tallyline.llm.frames import col, few_at_once, reliable, sent, slices, text_bytes

LEAST = 30
TOP = 50
SCALE = 1_000_000_000
#: Added to each count.
MORE = 5
#: Counts of a block, columns of a tile.
ENTRIES = 65_536
TILE = 2048
SALTS = 16
#: What a product costs besides its cells, in cells.
PRODUCT = 20_000
#: A task hands its counts on beyond so many, and reads a longer text in parts of so many bytes.
HELD = 400_000
PART = 1 << 22

#: Letters of ASCII in lower case and bytes of other characters; everything else parts terms.
_LETTERS = np.array(
    [b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)], np.uint8
)


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Texts data[offsets[i]:offsets[i + 1]] as they are cut into terms."""
    low, high = int(offsets[0]), int(offsets[-1])
    held = [None, pa.py_buffer(offsets - low), pa.py_buffer(_LETTERS[data[low:high]])]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, held)


def _distinct(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, row, term, n): the distinct terms of each text with their occurrences."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten().dictionary_encode()
    terms, code = words.dictionary, words.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
    many = max(len(terms), 1)
    # White space at either end leaves empty strings.
    key, n = np.unique((row * many + code)[pc.utf8_length(terms).to_numpy()[code] > 0] if len(code) else code, return_counts=True)
    return terms, key // many, key % many, n


def _merged(terms: pa.Array, group: np.ndarray, *values: np.ndarray) -> tuple:
    """(terms, group, values...): sums of the values by group and term."""
    encoded = terms.dictionary_encode()
    many = max(len(encoded.dictionary), 1)
    key, place = np.unique(group * many + encoded.indices.to_numpy(), return_inverse=True)
    sums = [np.bincount(place, v, len(key)).astype(np.int64) for v in values]
    return encoded.dictionary.take(pa.array(key % many)), key // many, *sums


def _of_slice(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """As ``_distinct``; a long text in parts, which never cut a term."""
    data, offsets = text_bytes(batch.column("text"))
    if batch.num_rows > 1 or offsets[-1] - offsets[0] <= PART:
        return _distinct(_strings(data, offsets))
    parted, at, found = np.flatnonzero(_LETTERS[data[offsets[0] : offsets[-1]]] == 0x20) + offsets[0], int(offsets[0]), None
    while at < offsets[-1]:
        to = int(np.searchsorted(parted, at + PART))
        to = int(parted[to]) if to < len(parted) else int(offsets[-1])
        terms, _, code, n = _distinct(_strings(data, np.array([at, to], np.int64)))
        terms = terms.take(pa.array(code))
        if found is not None:
            terms, n = pa.concat_arrays([found[0], terms]), np.concatenate([found[1], n])
        terms, _, n = _merged(terms, np.zeros(len(n), np.int64), n)
        found, at = (terms, n), to
    terms, n = found
    return terms, np.zeros(len(n), np.int64), np.arange(len(n)), n


def _hashed(terms: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(terms)
    return W.hashes(data, offsets[:-1], offsets[1:]) if len(terms) else np.zeros(0, np.uint64)


def count_terms(documents: DataFrame, by: Sequence[str], among: np.ndarray | None = None) -> DataFrame:
    """(by..., term, h, n, docs) of (text, by...): occurrences and documents; h is a hash of the term.

    With a Bloom filter, only terms that pass it. A null term stands for each group.
    """
    shared = None if among is None else documents.sparkSession.sparkContext.broadcast(among)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, ...], int] = {}
        held: list[tuple] = []

        def told(found: tuple) -> pa.RecordBatch:
            terms, group, n, docs = found
            names = zip(*groups, strict=True) if groups else [()] * len(by)
            columns = [pa.array(x, pa.string()).take(pa.array(np.append(group, np.arange(len(groups))))) for x in names]
            bare = np.zeros(len(groups), np.int64)
            columns += [pa.concat_arrays([terms.cast(pa.string()), pa.nulls(len(groups), pa.string())])]
            columns += [pa.array(np.append(x, bare)) for x in (_hashed(terms).view(np.int64), n, docs)]
            groups.clear()
            held.clear()
            return pa.record_batch(columns, [*by, "term", "h", "n", "docs"])

        def together() -> tuple:
            terms, *rest = zip(*held, strict=True)
            return _merged(pa.concat_arrays(terms), *map(np.concatenate, rest))

        for batch in slices(batches, "text"):
            terms, row, code, n = _of_slice(batch)
            names = zip(*(batch.column(c).to_pylist() for c in by), strict=True)
            group = np.array([groups.setdefault(x, len(groups)) for x in names], np.int64)
            if shared is not None:
                kept = maybe(shared.value, _hashed(terms))[code]
                row, code, n = row[kept], code[kept], n[kept]
            held.append(_merged(terms.take(pa.array(code)), group[row], n, np.ones(len(n), np.int64)))
            if sum(len(x[1]) for x in held) > HELD:
                found = together()
                held[:] = [found]
                if len(found[1]) > HELD // 2:
                    yield told(found)
        if held:
            yield told(together())

    schema = f"{', '.join(f'{c} string' for c in by)}, term string, h long, n long, docs long"
    return sent(documents).select("text", *by).mapInArrow(work, schema)


def price(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + MORE) / (total + MORE * kept)), in exact integers."""
    above = F.lit(SCALE).cast("decimal(12,0)") * (count + F.lit(MORE)).cast("decimal(20,0)")
    below = F.nullif((total + F.lit(MORE) * kept).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return F.lit(1).cast("long") + F.call_function("div", above, below)


def joint_values(level: np.ndarray, cost: np.ndarray, tile: int = TILE) -> np.ndarray:
    """Sums of differences of all pairs of groups, from levels and costs (terms by groups).

    Terms should be in the order of their frequency.
    """
    groups = level.shape[1]
    out = np.zeros((groups, groups), np.int64)
    _, rank = np.unique(level, return_inverse=True)
    key = np.arange(groups) * (int(rank.max()) + 1) + rank.reshape(level.shape)
    parts = [(slice(0, len(level)), np.unique(key))]
    while parts:
        part, columns = parts.pop()
        many = part.stop - part.start
        if many > 1:
            middle = part.start + many // 2
            halves = [(half, np.unique(key[half])) for half in (slice(part.start, middle), slice(middle, part.stop))]
            if PRODUCT + len(columns) ** 2 > sum(PRODUCT + len(found) ** 2 for _, found in halves):
                parts += halves
                continue
        first = np.full(len(columns), -1)
        place = np.searchsorted(columns, key[part].ravel())
        first[place] = np.arange(len(place))
        hot = np.zeros((many, len(columns)))
        hot[np.arange(many)[:, None], place.reshape(many, groups)] = 1
        of_column, group = cost[part].ravel()[first], first % groups
        for i in range(0, len(columns), tile):
            rows = slice(i, i + tile)
            starts = np.flatnonzero(np.r_[True, np.diff(group[rows]) > 0])
            for j in range(i, len(columns), tile):
                cols = slice(j, j + tile)
                ends = np.flatnonzero(np.r_[True, np.diff(group[cols]) > 0])
                joint = (hot[:, rows].T @ hot[:, cols]).astype(np.int64)
                joint *= np.abs(of_column[rows, None] - of_column[None, cols])
                summed = np.add.reduceat(np.add.reduceat(joint, starts, 0), ends, 1)
                out[np.ix_(group[rows][starts], group[cols][ends])] += summed
    # Columns are in the order of groups: tiles on and above the diagonal have each pair once.
    return np.triu(out, 1)


def _price_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            counted, known = row.column("counts").flatten(), row.column("groups").flatten()
            term = counted.field("term").dictionary_encode().indices.to_numpy()
            names = known.field("source")
            place = pc.index_in(counted.field("source"), value_set=names).to_numpy()
            n, p = counted.field("n").to_numpy(), counted.field("p").to_numpy()
            often = np.bincount(term, n)
            line = np.empty(len(often), np.int64)
            line[np.argsort(often, kind="stable")] = np.arange(len(often))
            level = np.zeros((len(often), len(names)), np.int64)
            cost = np.tile(known.field("p").to_numpy(), (len(often), 1))
            level[line[term], place], cost[line[term], place] = n, p
            value = joint_values(level, cost)
            a, b = np.triu_indices(len(names), 1)
            for at in range(0, len(a), 50_000):
                x, y = a[at : at + 50_000], b[at : at + 50_000]
                langs = row.column("lang").take(pa.array(np.zeros(len(x), np.int64)))
                parts = [langs, names.take(pa.array(x)), names.take(pa.array(y)), pa.array(value[x, y])]
                yield pa.record_batch(parts, ["lang", "source", "item", "value"])


def divergence(
    documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP
) -> DataFrame:
    """(lang, source, part, item, value, rank) of each group.

    Part ``pair``: each other source of the language with the distance to it, farthest
    first. Part ``term``: the ``top`` terms that the group has above the language's price.
    """
    named = [F.coalesce(col(c).cast("string"), F.lit("")).alias(a) for a, c in (("text", text), ("lang", lang), ("source", source))]
    texts = documents.select(*named)
    with few_at_once(documents.sparkSession):
        of_term = count_terms(texts, ["lang"]).where("term IS NOT NULL").groupBy("lang", "term")
        sums = [F.sum("docs").alias("docs"), F.sum("n").alias("all"), F.first("h").alias("h")]
        of_term = reliable(of_term.agg(*sums).where(F.col("docs") >= least).drop("docs"))
        counts = count_terms(texts, ["lang", "source"], bloom_filter(of_term, "h")).groupBy("lang", "source", "term")
        counts = reliable(counts.agg(F.sum("n").alias("n")))
    groups, counts = counts.where("term IS NULL").select("lang", "source"), counts.where("term IS NOT NULL")
    kept = reliable(counts.join(of_term.drop("h"), ["lang", "term"]))
    sizes = of_term.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("all_n"))
    sizes = sizes.join(kept.groupBy("lang").agg(F.count("*").alias("entries")), "lang")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = reliable(
        groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "v", "all_n", "entries")])
        .withColumn("p0", price(zero, F.col("total"), F.col("v")))
    )
    salt = F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int").alias("salt")
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    priced = kept.select("*", salt).join(groups.drop("entries").select("*", copies), ["lang", "source", "salt"])
    priced = priced.withColumn("p", price(F.col("n"), F.col("total"), F.col("v")))

    largest = groups.agg(F.max("entries")).first()[0] or 0
    block = F.pmod(F.xxhash64(F.lit(3), "term"), F.lit(-(-largest // ENTRIES) or 1)).alias("block")
    blocks = priced.groupBy("lang", block).agg(F.collect_list(F.struct("term", "source", "n", "p")).alias("counts"))
    known = groups.where("v > 0").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.col("p0").alias("p")))).alias("groups"))
    blocks = blocks.withColumn("salt", F.pmod("block", F.lit(SALTS)).cast("int")).join(known.select("*", copies), ["lang", "salt"])
    values = blocks.select("lang", "counts", "groups").mapInArrow(_price_blocks, "lang string, source string, item string, value long")

    bare = groups.where("v = 0").select("lang", "source")
    bare = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source < item").select("*", zero.alias("value"))
    values = values.unionByName(bare).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = values.select("lang", both.alias("x"), "value").select("lang", "x.source", "x.item", "value")

    above = F.col("p") - price(F.col("all"), F.col("all_n"), F.col("v"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    found = priced.select("lang", "source", F.col("term").alias("item"), above.alias("value")).where("value > 0")
    return (
        pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
        .unionByName(
            found.select("lang", "source", F.lit("term").alias("part"), "item", "value", rank.alias("rank")).where(F.col("rank") <= top)
        )
    )
