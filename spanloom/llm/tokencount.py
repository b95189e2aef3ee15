"""Token counts of whole texts; very long ones are encoded in overlapping chunks (``bpe.encode_long``).

Defined cases: null text is empty and has no tokens; special strings inside texts are handled as the tokenizer does by
default; repeated rows are counted alike; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.bpe import encode_all, tokenizer
from spanloom.llm.words import docs_table, restore_id, source, text_pieces


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 512, chunk: int = 1 << 16) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs`` (doc_id, text).

    ``path`` names the tokenizer's ``.json`` file on the executors; without it, the installed vocabulary is used.
    """
    def run(batches):
        tok = tokenizer(path)
        for rows, _, off in text_pieces(batches):
            texts = [t or "" for t in rows.column(1).to_pylist()]
            n = np.fromiter((len(x) for x in encode_all(texts, tok, chunk)), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(off)), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    return restore_id(count_tokens(source(docs_table(spark, sf_dir))))
