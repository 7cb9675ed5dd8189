"""Encoding of a whole corpus, and decoding it again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe import Encoder, Merges, decode_stream, read_ranks

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BYTES_PER_STEP = 4_000_000

_merges: dict[str, Merges] = {}
_encoders: dict[str, Encoder] = {}


def _encoder(name: str, merges: Merges) -> Encoder:
    """One encoder for each vocabulary and Python worker, with what it has learnt so far."""
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(merges)
    return _encoders[name]


def _steps(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.StringArray]]:
    """Keys and texts of a batch in slices of about BYTES_PER_STEP, never less than one text."""
    keys, texts = batch.column(0), batch.column(1).cast(pa.string())
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset + 1 : texts.offset + len(texts) + 1] if len(texts) else np.empty(0)
    begin = 0
    while begin < len(texts):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + BYTES_PER_STEP, "right")))
        yield keys[begin:end], texts[begin:end]
        begin = end


def _vocabulary(spark: SparkSession, path: str):
    """The name of a vocabulary and its tables, made once by the driver and sent to the workers: of a fixed size, under 10 MB."""
    with open(path, "rb") as file:
        raw = file.read()
    name = hashlib.sha256(raw).hexdigest()
    if name not in _merges:
        _merges.clear()
        _merges[name] = Merges(read_ranks(raw))
    return name, spark.sparkContext.broadcast(_merges[name])


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` (ARRAY<INT>) of every row, without special tokens.

    Text that looks like a special token is ordinary text. Null and empty texts
    give an empty list, never null. Each row is encoded by itself, so repeated
    rows stay repeated, and there is no shuffle. Other columns are not read.
    """
    name, merges = _vocabulary(documents.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, merges.value)
        for batch in batches:
            for keys, texts in _steps(batch):
                ids, offsets = encoder.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys, lists], names=[key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decoded_digest(encoded: DataFrame, key: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    """``key``, ``n_bytes`` and ``md5`` of the text that the ids decode to."""
    _, merges = _vocabulary(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = merges.value.bytes_of
        for batch in batches:
            sizes, digests = [], []
            for ids in batch.column(1):
                digest, size = hashlib.md5(usedforsecurity=False), 0
                for part in decode_stream(ids.values.to_pylist() if ids.is_valid else (), bytes_of):
                    written = part.encode()
                    digest.update(written)
                    size += len(written)
                sizes.append(size)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests)], names=[key, "n_bytes", "md5"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, md5 string")
