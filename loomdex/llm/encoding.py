"""Encoding of a corpus with a public tokenizer, and the sizes of its texts in tokens."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .bpe import decode, encoder

#: Vocabulary file of the byte-level tokenizer with some 50,000 tokens.
BYTE_BPE = "byte_bpe_50k.json"
#: Ids of one batch that leaves a Python worker, so that very long texts don't add up.
IDS_HELD = 1_000_000


def _encode(batches: Iterator[pa.RecordBatch], file: str) -> Iterator[pa.RecordBatch]:
    encode = encoder(file).encode
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        ids: list[np.ndarray] = []
        first, held = 0, 0
        for at, text in enumerate(texts):
            ids.append(np.array(encode(text.as_py()), np.int32))
            held += len(ids[-1])
            if held >= IDS_HELD or at == len(texts) - 1:
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([keys.slice(first, len(ids)), lists], [batch.schema.names[0], "ids"])
                ids, first, held = [], at + 1, 0


def encode_texts(documents: DataFrame, key: str = "doc_id", text: str = "text", file: str = BYTE_BPE) -> DataFrame:
    """(key, ids) of every row of ``documents``: ids ARRAY<INT> without special tokens.

    The ids of a null and of an empty text are an empty array; the string of a special
    token is ordinary text. Null keys and repeated rows stay as they are. Rows are
    encoded where they are read; nothing is shuffled. Whole texts are encoded, of any
    length.
    """
    ship(documents.sparkSession)
    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(partial(_encode, file=file), f"`{key}` {kind}, ids array<int>")


def _decode(batches: Iterator[pa.RecordBatch], file: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.array([decode(file, ids.as_py() or ()) for ids in batch.column(1)], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), texts], [batch.schema.names[0], "text"])


def decode_ids(encoded: DataFrame, key: str = "doc_id", file: str = BYTE_BPE) -> DataFrame:
    """(key, text) of encoded rows; null and empty arrays give an empty text."""
    ship(encoded.sparkSession)
    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(partial(_decode, file=file), f"`{key}` {kind}, text string")


def _count(batches: Iterator[pa.RecordBatch], file: str) -> Iterator[pa.RecordBatch]:
    count = encoder(file).count
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        sizes = pa.array([count(text.as_py()) for text in texts], pa.int64())
        rest = [i for i, name in enumerate(batch.schema.names) if name != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), sizes], [*(batch.schema.names[i] for i in rest), "tokens"])


def count_tokens(documents: DataFrame, file: str = BYTE_BPE) -> DataFrame:
    """The columns of ``documents`` with ``text`` replaced by ``tokens``, its number of ids (0 for null).

    A column that is already named ``tokens`` is dropped.
    """
    ship(documents.sparkSession)
    rest = [f for f in documents.schema.fields if f.name not in ("text", "tokens")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    ordered = documents.select(*[F.col(f.name) for f in rest], "text")
    return ordered.mapInArrow(partial(_count, file=file), f"{schema}, tokens bigint")
