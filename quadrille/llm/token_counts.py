"""Token counts by the whole-token shortcut.

Offline, every string of the vocabulary is encoded alone; those that are a
single pre-token and come out as a single token are proven to count one
wherever they stand as a pre-token.  Texts are cut into pre-tokens, proven
ones are counted directly and only the others are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import counter, whole_tokens
from .session import ship
from .textkernel import chunks


def count_tokens(docs: DataFrame, tokenizer_file: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 1024) -> DataFrame:
    """Bytes, tokens and the verdict ``n_tokens > limit`` for every row.

    A null text counts as empty and gives 0 bytes and 0 tokens; ids may be
    null or repeated, each row gives one row; an empty table gives none.  Other
    columns are not read.  Counts are the tokenizer's own, without added
    begin or end tokens; the string of a special token inside a text counts as
    the tokenizer counts it.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_file, encoding="utf-8") as file:
        source = file.read()
    shared = spark.sparkContext.broadcast((source, tuple(whole_tokens(source))))
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count_one = counter(*shared.value)
        for batch in batches:
            for part, _, offsets in chunks(batch, limit=4 << 20):
                n = np.array([count_one(t) if t else 0 for t in part.column(1).to_pylist()], dtype=np.int64)
                yield pa.record_batch({"doc_id": part.column(0), "n_bytes": np.diff(offsets), "n_tokens": n, "over_limit": n > limit})

    return rows.mapInArrow(count, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
