"""Token counts: batch encoding in Arrow functions that return lengths only.

Rows are regrouped into batches of about equal bytes. Texts are cut before single spaces (see pieces.py), which
never changes the tokens, so a text of any length costs no more memory than its distinct parts; each distinct part
of a batch is encoded once and the lengths are summed by row.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each; other columns are
not looked at, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labframe.llm.common import by_bytes, guarded
from labframe.llm.pieces import distinct_parts

#: Bytes of text in a batch.
BATCH_BYTES = 16_000_000


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from a list of strings to their token counts; the library goes by the file's ending."""
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        return lambda parts: [len(x) for x in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
    raise ValueError(f"{path}: only byte-level .json vocabularies may be cut before spaces")


def token_counts(df: DataFrame, vocabulary: str, id_column: str = "doc_id", text: str = "text", limit: int = 512, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of df. vocabulary: a byte-level .json file that all executors have."""
    guarded(df.columns, [id_column, text], "token_counts")

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(vocabulary)
        for batch in by_bytes(batches, "text", batch_bytes):
            sizes = pc.binary_length(batch.column("text")).fill_null(0).cast(pa.int64())
            tokens = np.zeros(batch.num_rows, np.int64)
            for rows, index, offsets, parts in distinct_parts(batch.column("text")):
                sums = np.concatenate([[0], np.cumsum(np.array(count(parts), np.int64)[index])]) if parts else np.zeros(1, np.int64)
                tokens[rows] = sums[offsets[1:]] - sums[offsets[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column("id"), sizes, pa.array(tokens)], ["id", "n_bytes", "n_tokens"])

    kind = df.schema[id_column].dataType.simpleString()
    out = df.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(lengths, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
