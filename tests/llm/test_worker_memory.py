"""A Python worker that lives on holds no words of a task that is over."""

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from postloom.llm import packing, token_counts
from postloom.llm.queries import tokenizer_file
from postloom.llm.word_encoder import encoder, ids_bytes


@pytest.mark.parametrize(("module", "make", "form"), [(packing, packing.cut_documents, ids_bytes), (token_counts, token_counts.count_tokens, len)])
def test_words_go(spark, monkeypatch, module, make, form):
    runs = []
    monkeypatch.setattr(module, "map_texts", lambda rows, run, schema: runs.append(run))
    if module is packing:
        monkeypatch.setattr(packing, "TaskContext", type("C", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": lambda self: 0})())}))
    make(spark.createDataFrame([], T._parse_datatype_string("doc_id long, text string")), tokenizer_file())
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words, and others"])], ["doc_id", "text"])
    held = encoder(tokenizer_file(), form)
    for _ in runs[0](iter([batch])):
        assert held.known
    assert not (held.known or held.old or held.pieces)
