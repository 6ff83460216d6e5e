"""Benchmark decontamination: which documents hold passages of benchmark items.

A window is ``window`` consecutive words of an item (an item of fewer words, but not
none, is one window). A document's words inside any occurrence of a window are hit.

Prefix-filtered join: a window is the list of its shingles of five words (one of all its
words if it is shorter). It occurs only where all of them do, so that a prefix of one
shingle is enough if shingles are ordered by rarity: only its rarest one is joined.

1. Count the benchmark's shingles in all documents. A window with a shingle that never
   occurs is out; of each other window the rarest shingle is its anchor.
2. Find anchors in the documents, each with the few words around it.
3. Join them on the anchor's hash; the window has to lie inside the document (length and
   place), and its words have to be the document's.

Both passes over the texts run without a shuffle: tasks ask a Bloom filter of bounded
size first, so that only anchors, and rare false alarms, are shuffled.

Defined results: null and empty texts have no words and are not contaminated. Items
without an id or words are left out; rows with one item id are one item. Rows equal in id
and text are one document and get the same result, each; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm import words as W
from tallyline.llm.bloom import bloom_filter, maybe
from tallyline.llm.frames import col, identity, reliable, sent, slices, text_bytes, unused

WINDOW = 10
SHINGLE = 5


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(item, words, hashes) of every window; hashes are those of its shingles, in order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = W.words(*text_bytes(batch.column("text")), W.ALPHANUMERIC)
            hashes, first = W.shingles(found, SHINGLE)
            hashes = hashes.view(np.int64)
            rows = []
            for i, item in enumerate(batch.column("item").to_pylist()):
                many = int(found.first[i + 1] - found.first[i])
                text_words = found.text(found.first[i], found.first[i + 1])
                of_item = hashes[first[i] : first[i + 1]].tolist()
                for start in range(max(1, many - window + 1) if many else 0):
                    part = text_words[start : start + window]
                    rows.append((item, part, of_item[start : start + max(1, len(part) - SHINGLE + 1)]))
            yield pa.record_batch(
                [
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.list_(pa.string())),
                    pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                ],
                ["item", "words", "hashes"],
            )

    named = items.select(col(item_id).cast("string").alias("item"), col(text).cast("string").alias("text"))
    return named.where("item IS NOT NULL").mapInArrow(cut, "item string, words array<string>, hashes array<long>")


def _document_shingles(found: W.Words, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for size in sizes:
        hashes, first = W.shingles(found, size, short=False)
        yield size, hashes, first


def shingle_counts(texts: DataFrame, bitmap: np.ndarray, sizes: list[int]) -> DataFrame:
    """(h, n): how often the shingles that pass the filter occur in all texts."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = W.words(*text_bytes(batch.column("text")), W.ALPHANUMERIC)
            for _, hashes, _ in _document_shingles(found, sizes):
                kinds, times = np.unique(hashes[maybe(shared.value, hashes)], return_counts=True)
                yield pa.record_batch([pa.array(kinds.view(np.int64)), pa.array(times)], ["h", "n"])

    return texts.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def find_anchors(texts: DataFrame, bitmap: np.ndarray, sizes: list[int], window: int) -> DataFrame:
    """A row with n_words for each document, and one for each anchor in it with the words around."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"k1 long, k2 long, doc_id {kind}, n_words long, h long, size int, pos int, at int, around array<string>"
    names = ["k1", "k2", "doc_id", "n_words", "h", "size", "pos", "at", "around"]
    of_hits = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string())]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = W.words(*text_bytes(batch.column("text")), W.ALPHANUMERIC)
            counts = found.counts()
            k1, k2 = (batch.column(k).to_numpy() for k in ("k1", "k2"))
            ids = batch.column("doc_id")
            none = [pa.nulls(len(counts), kind) for kind in of_hits]
            yield pa.record_batch([pa.array(k1), pa.array(k2), ids, pa.array(counts.astype(np.int64)), *none], names)
            for size, hashes, first in _document_shingles(found, sizes):
                hits = np.flatnonzero(maybe(shared.value, hashes))
                doc = np.searchsorted(first, hits, "right") - 1
                pos = hits - first[doc]
                # A shorter window is its only shingle; a whole one reaches as far as its length.
                reach = window - size if size == SHINGLE else 0
                low = np.maximum(pos - reach, 0)
                high = np.minimum(pos + size + reach, counts[doc])
                begin = found.first[doc]
                for at in range(0, len(hits), 10_000):
                    part = slice(at, at + 10_000)
                    around = [found.text(b + x, b + y) for b, x, y in zip(begin[part], low[part], high[part], strict=True)]
                    many = len(around)
                    yield pa.record_batch(
                        [
                            pa.array(k1[doc[part]]),
                            pa.array(k2[doc[part]]),
                            pa.nulls(many, ids.type),
                            pa.nulls(many, pa.int64()),
                            pa.array(hashes[hits[part]].view(np.int64)),
                            pa.array(np.full(many, size, np.int32)),
                            pa.array(pos[part].astype(np.int32)),
                            pa.array((pos - low)[part].astype(np.int32)),
                            pa.array(around, pa.list_(pa.string())),
                        ],
                        names,
                    )

    return texts.select("k1", "k2", "doc_id", "text").mapInArrow(find, schema)


def occurrences(keyed: DataFrame, items: DataFrame, item_id: str, text: str, window: int) -> tuple[DataFrame, ...]:
    """(documents with n_words, spans of windows in documents, items of windows).

    ``keyed`` has k1, k2 and text. Spans are (k1, k2, w1, w2, start, length).
    """
    if window < SHINGLE:
        raise ValueError(f"a window has {SHINGLE} words or more")
    cut = reliable(
        item_windows(items, item_id, text, window).withColumns(dict(zip(("w1", "w2"), identity(F.col("words")), strict=True)))
    )
    kinds = cut.dropDuplicates(["w1", "w2"]).select("w1", "w2", "words", "hashes")
    shingled = kinds.select("w1", "w2", "words", F.posexplode("hashes").alias("offset", "h"))
    # A shorter window is one shingle, and has its own length.
    sizes = sorted(
        r.size for r in kinds.select(F.least(F.size("words"), F.lit(SHINGLE)).alias("size")).distinct().collect()
    )
    counts = shingle_counts(keyed, bloom_filter(shingled.select("h").distinct(), "h"), sizes)
    rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "offset")
    anchors = reliable(
        shingled.join(counts, "h", "left")
        .groupBy("w1", "w2")
        .agg(F.min(rarity).alias("rarest"), F.first("words").alias("words"))
        .where("rarest.n > 0")
        .select("w1", "w2", "words", "rarest.h", "rarest.offset")
    )
    found = reliable(find_anchors(keyed, bloom_filter(anchors.select("h").distinct(), "h"), sizes, window))
    start, length = F.col("at") - F.col("offset"), F.size("words")
    spans = (
        found.where("h IS NOT NULL")
        .join(anchors, "h")
        .where((start >= 0) & (start + length <= F.size("around")) & (F.col("size") == F.least(length, F.lit(SHINGLE))))
        .where(F.slice("around", start + 1, length) == F.col("words"))
        .select("k1", "k2", "w1", "w2", (F.col("pos") - F.col("offset")).alias("start"), length.alias("length"))
        .distinct()
    )
    documents = found.where("h IS NULL").select("k1", "k2", "doc_id", "n_words")
    return documents, spans, cut.select("w1", "w2", "item").distinct()


def covered(spans: str) -> F.Column:
    """How many words the (start, length) spans of an array cover together."""

    def step(so_far: F.Column, span: F.Column) -> F.Column:
        end = span["start"] + span["length"]
        more = F.greatest(end - F.greatest(so_far["end"], span["start"]), F.lit(0))
        return F.struct((so_far["words"] + more).alias("words"), F.greatest(so_far["end"], end).alias("end"))

    zero = F.struct(F.lit(0).alias("words"), F.lit(0).alias("end"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda x: x["words"].cast("long"))


def contamination(
    frame: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """(doc_id, k1, k2, n_words, n_hit, spans, items) for each row of the frame.

    spans are the (start, length) of the windows found, in words; items their sorted ids.
    """
    k1, k2 = identity(col(doc_id), col(text))
    keyed = sent(frame).select(
        k1.alias("k1"), k2.alias("k2"), col(doc_id).alias("doc_id"), col(text).cast("string").alias("text")
    )
    documents, spans, of_windows = occurrences(keyed, items, item_id, item_text, window)
    spans = reliable(spans)
    hit = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "length")).alias("spans"))
    named = (
        spans.select("k1", "k2", "w1", "w2").distinct().join(of_windows, ["w1", "w2"])
        .groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    found = hit.join(named, ["k1", "k2"]).withColumn("n_hit", covered("spans"))
    return documents.join(found, ["k1", "k2"], "left").withColumns(
        {
            "n_hit": F.coalesce("n_hit", F.lit(0)),
            "items": F.coalesce("items", F.array().cast("array<string>")),
            "spans": F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>")),
        }
    )


def remove_contaminated(
    frame: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **names: str | int
) -> DataFrame:
    """The rows of the frame that hold no window of an item."""
    k1, k2 = unused(frame, "k1", "k2")
    found = contamination(frame, items, doc_id, text, **names).where("n_hit > 0").select("k1", "k2").distinct()
    keys = dict(zip((k1, k2), identity(col(doc_id), col(text)), strict=True))
    return frame.withColumns(keys).join(found.toDF(k1, k2), [k1, k2], "left_anti").drop(k1, k2)
