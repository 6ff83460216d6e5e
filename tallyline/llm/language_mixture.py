"""Language ID of documents that may mix languages.

Learning: each language's distribution of byte trigrams inside words (with the word's
ends), from all labelled texts, in a hashed table with a fixed number of places.

Inference: a document is a mixture. Each word comes from one of the languages, with the
likelihood of its trigrams. Expectation-maximisation estimates the proportions. Sets of
languages are then compared by penalised likelihood: the document's single best language,
then the languages of greatest proportion, two, three and so on up to all, where each
further language has to gain ``PENALTY / 2 * ln(words)``; sizes end where even all languages
together could not pay for one more. The prediction is the language with the
greatest proportion in the chosen set, its proportion is the score.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and no
languages; so is every text if nothing was learned. Ties go to the language that sorts
first. Rows stay as they are, repeated ones too; a row is judged by its text alone. Input
columns named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm import words as W
from tallyline.llm.frames import col, sent, slices, text_bytes, unused

UNDETERMINED = "und"
PLACES = 1 << 16
SMOOTHING = 0.5
PENALTY = 8.0
ROUNDS = 15
#: Bytes of text that are judged at once; each takes some hundred bytes of a worker's memory.
JUDGED_BYTES = 200_000
#: The model has PLACES numbers of four bytes for each language.
MOST_LANGUAGES = 500

_LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])


def _places(data: np.ndarray) -> np.ndarray:
    """The table's place of the trigram around each byte; other bytes than letters are blanks."""
    shown = np.where(_LETTER[data], W.LOWERED[data], np.uint8(32)).astype(np.uint32)
    padded = np.concatenate([[np.uint32(32)], shown, [np.uint32(32)]]).astype(np.uint32)
    code = (padded[:-2] << np.uint32(16)) | (padded[1:-1] << np.uint32(8)) | padded[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


@dataclass
class Model:
    """Languages in order, and the log-probability of each place (rows) in each of them."""

    languages: list[str]
    table: np.ndarray


def learn(frame: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model from all rows with a text and a language."""
    rows = sent(frame).select(col(text).cast("string").alias("text"), col(lang).cast("string").alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
            places, letters = _places(data), _LETTER[data]
            coded = batch.column("lang").dictionary_encode()
            kinds, of_row = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            of_byte = np.repeat(of_row, np.diff(offsets))
            for i, kind in enumerate(kinds):
                seen = np.bincount(places[(of_byte == i) & letters], minlength=PLACES)
                found[kind] = found[kind] + seen if kind in found else seen
        for kind, seen in found.items():
            held = np.flatnonzero(seen)
            yield pa.record_batch(
                [pa.array([kind] * len(held), pa.string()), pa.array(held.astype(np.int32)), pa.array(seen[held].astype(np.int64))],
                ["lang", "place", "n"],
            )

    labelled = rows.where("text IS NOT NULL AND lang IS NOT NULL")
    counts = labelled.mapInArrow(count, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    tables = (
        counts.groupBy("lang").agg(F.collect_list("place").alias("places"), F.collect_list("n").alias("times"))
        .orderBy("lang").limit(MOST_LANGUAGES + 1)
    )
    languages, columns = [], []
    for row in tables.toLocalIterator():
        if len(languages) == MOST_LANGUAGES:
            raise ValueError(f"there are more than {MOST_LANGUAGES} languages to learn")
        seen = np.zeros(PLACES)
        seen[row.places] = row.times
        languages.append(row.lang)
        columns.append(np.log((seen + SMOOTHING) / (seen.sum() + SMOOTHING * PLACES)).astype(np.float32))
    return Model(languages, np.stack(columns, 1) if columns else np.zeros((PLACES, 0), np.float32))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over the rows first[i]:first[i + 1], none of which is empty."""
    return np.add.reduceat(values, first[:-1], axis=0)


def mixture(likely: np.ndarray, first: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shares, log-likelihood) of each document after expectation-maximisation.

    ``likely`` has each word's likelihood in each language, and first the number of each
    document's first word; a share of 0 stays 0.
    """
    many = np.diff(first)
    of_word = np.repeat(np.arange(len(many)), many)
    for _ in range(ROUNDS):
        joint = likely * shares[of_word]
        joint /= np.maximum(joint.sum(1, keepdims=True), 1e-300)
        shares = _sums(joint, first) / many[:, None]
    whole = (likely * shares[of_word]).sum(1)
    return shares, _sums(np.log(np.maximum(whole, 1e-300)), first)


def _kept(words: np.ndarray, first: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the chosen documents, and their new first numbers."""
    many = np.diff(first)
    return words[np.repeat(chosen, many)], np.concatenate([[0], np.cumsum(many[chosen])])


def judge(logs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Shares of the chosen set's languages, from log-likelihoods of words; no document is empty."""
    logs = logs.astype(np.float64)
    top = logs.max(1, keepdims=True)
    likely = np.exp(logs - top)
    many, kinds = np.diff(first), logs.shape[1]
    alone = _sums(logs - top, first)
    best = alone.argmax(1)
    out = np.zeros((len(many), kinds))
    out[np.arange(len(many)), best] = 1
    step = PENALTY / 2 * np.log(np.maximum(many, 2))
    full, most = mixture(likely, first, np.full((len(many), kinds), 1 / kinds))
    value = alone.max(1)
    # No set does better than all languages together; who can't gain from a second one is done.
    open_ = most - step > value
    for size in range(2, kinds + 1):
        if not open_.any():
            break
        at = np.flatnonzero(open_)
        part, starts = _kept(likely, first, open_)
        order = np.argsort(-full[at], axis=1, kind="stable")[:, :size]
        shares = np.zeros((len(at), kinds))
        np.put_along_axis(shares, order, np.maximum(np.take_along_axis(full[at], order, 1), 1e-6), 1)
        shares, found = mixture(part, starts, shares / shares.sum(1, keepdims=True))
        found -= (size - 1) * step[at]
        better = found > value[at]
        out[at[better]], value[at[better]] = shares[better], found[better]
        open_ &= most - size * step > value
    return out


def _shares(batch: pa.RecordBatch, model: Model) -> np.ndarray:
    """Each row's shares; all 0 where nothing can be said."""
    data, offsets = text_bytes(batch.column("text"))
    out = np.zeros((batch.num_rows, len(model.languages)))
    if not model.languages:
        return out
    found = W.words(data, offsets, _LETTER)
    held = found.counts() > 0
    plain = (found.data >= 65) & (found.data < 128) & _LETTER[found.data]
    sure = np.zeros(len(plain) + 1, np.int64)
    np.cumsum(plain, out=sure[1:])
    bounds = offsets - offsets[0]
    for i in np.flatnonzero(held & (sure[bounds[1:]] == sure[bounds[:-1]])):
        held[i] = any(c.isalpha() for c in batch.column("text")[int(i)].as_py())
    if not held.any():
        return out
    # All letters of a word, one after another: word i has those from before[i] on.
    letters = np.flatnonzero(_LETTER[found.data])
    before = np.searchsorted(letters, found.starts)
    logs = np.add.reduceat(model.table[_places(found.data)[letters]], before, axis=0)
    logs, first = _kept(logs, found.first, held)
    out[held] = judge(logs, first)
    return out


_RESULT = pa.struct([
    ("lang_pred", pa.string()), ("score", pa.float64()),
    ("languages", pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))),
])


def prediction(frame: DataFrame, model: Model, text: str) -> Column:
    """A struct column of lang_pred, score and languages for a text column of the frame."""
    shared = sent(frame).sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double, languages: array<struct<lang: string, share: double>>>")
    def predicted(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = shared.value.languages
        for part in parts:
            rows = []
            for batch in slices(iter([pa.RecordBatch.from_arrays([part], ["text"])]), "text", JUDGED_BYTES):
                for shares in _shares(batch, shared.value):
                    order = [int(i) for i in np.argsort(-shares, kind="stable") if shares[i] > 0]
                    held = [{"lang": names[i], "share": float(shares[i])} for i in order]
                    first = held[0] if held else {"lang": UNDETERMINED, "share": 0.0}
                    rows.append({"lang_pred": first["lang"], "score": min(first["share"], 1.0), "languages": held})
            yield pa.array(rows, _RESULT)

    return predicted(col(text).cast("string"))


def identify(frame: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The frame with lang_pred, score and languages (those of the chosen set, largest share first)."""
    (found,) = unused(frame, "found")
    named = frame.withColumn(found, prediction(frame, model, text))
    return named.withColumns({c: col(found)[c] for c in ("lang_pred", "score", "languages")}).drop(found)


def keep_identified(frame: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose text has a language with at least ``least`` of its words.

    If nothing was learned, every text with a letter stays.
    """
    if not model.languages:
        return frame.where(col(text).rlike(r"\p{L}"))
    (found,) = unused(frame, "found")
    judged = frame.withColumn(found, prediction(frame, model, text))
    return judged.where((col(found)["lang_pred"] != UNDETERMINED) & (col(found)["score"] >= least)).drop(found)


def held_out(doc_id: str = "doc_id") -> Column:
    """Every fifth document by the CRC-32 of its id as text (empty if null)."""
    return F.crc32(F.coalesce(col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0
