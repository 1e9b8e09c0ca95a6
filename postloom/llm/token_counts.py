"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from postloom.llm.common import balanced, field, map_texts
from postloom.llm.word_encoder import encoder


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 2048, batch_bytes: int = 4 << 20, piece_bytes: int = 1 << 20) -> DataFrame:
    """Count each text's tokens: the ``keep`` columns, n_bytes, n_tokens, over_limit.

    Texts are dealt into batches balanced by bytes; a text longer than
    ``piece_bytes`` is cut at white space where no token of the tokenizer crosses that
    (else it stays whole), and its counts are added up.  ``tokenizer`` is a .json file of
    tokenizers or a .model file of sentencepiece.  Each batch's words are encoded together; ids never leave the function.

    Null and empty texts have no bytes and no tokens.  Repeated rows each give a row.
    Columns not in ``keep`` are not read, so clashing names do no harm.  An empty table
    gives an empty table.
    """
    schema = T.StructType([*(field(docs, c) for c in keep), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    names = list(schema.names)

    def run(batches):
        words_of = encoder(tokenizer, len)
        for batch in batches:
            texts = batch.column(len(keep)).cast(pa.large_binary()).to_pylist()
            tokens = np.zeros(len(texts), np.int64)
            for rows, pieces in balanced(texts, batch_bytes, words_of.piece_bytes(piece_bytes)):
                words = [words_of.units(p) for p in pieces]
                size = words_of.table(set().union(*words)).__getitem__
                for row, w in zip(rows, words, strict=True):
                    tokens[row] += sum(map(size, w))
            sizes = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)], names)
        words_of.forget()

    return map_texts(docs.select(*keep, text), run, schema)
