"""Encoding a whole corpus with a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftgraph.llm.bpe import VOCABULARIES, encoder


def encode(docs: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(doc_id, ids): one row per row of ``docs``, repeated rows too, without special tokens; an empty list where the text is null or empty.

    No shuffle: each task encodes its rows. ``folder`` must hold the rank file on every executor. Other columns of ``docs`` aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for batch in batches:
            parts = [enc.encode(t) for t in batch.column("text").to_pylist()]
            offsets = np.zeros(len(parts) + 1, np.int32)
            np.cumsum([len(p) for p in parts], out=offsets[1:])
            values = np.frombuffer(b"".join(p.tobytes() for p in parts), np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def count_tokens(docs: DataFrame, keep: list[str], tokenizer: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``keep`` columns and n_tokens of every row; 0 where the text is null or empty."""
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for batch in batches:
            sizes = pa.array([len(enc.encode(t)) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), sizes], names=[*keep, "n_tokens"])

    return docs.select(*keep, "text").mapInArrow(run, schema)
