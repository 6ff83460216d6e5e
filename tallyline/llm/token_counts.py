"""Token counts of whole texts by a two-tier lookup, without shuffling pre-tokens.

First tier: lengths, in tokens, of frequent pre-tokens, in a table of bounded size that every
worker gets. The tokenizer's own vocabulary says which these are: its entries are what was
most frequent where it was trained, and those that are whole pre-tokens make the table, so
that no pass over the corpus is needed. Another table can be given instead, for a corpus of
another kind. Second tier: a worker's own cache; what is in neither is encoded once by the
library. No pre-token leaves its task. The table decides how often the library is asked,
never a result.

Defined results: a null or empty text has 0 bytes and 0 tokens. Special tokens' strings
count as the library counts them. Rows stay as they are, repeated ones too; input columns
named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.frames import col, sent, slices
from tallyline.llm.tokenizing import Encoder

#: Entries of the broadcast table (about 100 bytes each).
FREQUENT = 65_536
LIMIT = 512


def frequent_lengths(tokenizer: str, size: int = FREQUENT) -> dict[str, int]:
    """Lengths of at most ``size`` pre-tokens of a tokenizer's vocabulary, those with the least ids."""
    encoder, found = Encoder(tokenizer, value=len, join=sum), {}
    for piece in encoder.vocabulary():
        if len(found) < size and encoder.pieces(piece) == [piece]:
            found[piece] = encoder.of_piece(piece)
    return found


def count_tokens(
    frame: DataFrame, tokenizer_file: str | Path, text: str = "text", limit: int = LIMIT, known: dict[str, int] | None = None
) -> DataFrame:
    """The frame with n_bytes, n_tokens and over_limit.

    ``tokenizer_file`` is a tokenizer in JSON that the driver can read; workers get its content.
    """
    tokenizer = Path(tokenizer_file).read_text(encoding="utf-8")
    table = frequent_lengths(tokenizer) if known is None else known
    shared = sent(frame).sparkSession.sparkContext.broadcast((tokenizer, table))

    @F.pandas_udf("long")
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(shared.value[0], known=shared.value[1], value=len, join=sum)
        for part in parts:
            out = []
            batch = pa.RecordBatch.from_arrays([pa.Array.from_pandas(part, type=pa.string())], ["text"])
            for piece in slices(iter([batch]), "text"):
                out += encoder.encode([t or "" for t in piece.column("text").to_pylist()])
            yield pd.Series(out, dtype="int64")

    told = F.coalesce(col(text).cast("string"), F.lit(""))
    named = frame.withColumn("n_bytes", F.octet_length(told).cast("long")).withColumn("n_tokens", counted(told))
    return named.withColumn("over_limit", F.col("n_tokens") > limit)
