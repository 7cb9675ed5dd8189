"""Passages of held-out test items inside a training corpus.

Each task cuts its documents into shards of a bounded number of words, numbers
the words of each and builds an FM-index of it, over all of its words, which is
kept in the shared folder. An index knows nothing of the items, so any number of
them, now or later, is searched for without reading the corpus again: all runs
of ``WORDS`` words of the passages, backwards, in every shard.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.fmindex import SEPARATOR, FMIndex
from tidemark.operators.intervals import periods
from tidemark.session import scratch_path

WORDS = 12
SHARD_WORDS = 1_500_000
#: Of passages, what is sent to the workers at once.
BLOCK_BYTES = 4 << 20
LOCATE_AT_ONCE = 1_000_000
#: A shard takes about 4 MB, and readers may take a whole file at once.
SHARDS_PER_FILE = 4

_ASCII_WORD = re.compile(r"[a-z0-9]+")
_WORD = re.compile(r"[^\W_]+")
_MARKS = regex.compile(r"\p{M}+")


def words(text: str) -> list[str]:
    """Runs of letters and digits after NFKD, removal of combining marks and lower-casing."""
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return _WORD.findall(_MARKS.sub("", unicodedata.normalize("NFKD", text)).lower())


class Passages:
    """Test passages as one sequence of numbered words, each passage followed by a gap, in which no run may lie."""

    def __init__(self, items: list[tuple[int, str]]):
        number: dict[str, int] = {}
        parts, owners = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for item, passage in items:
            found = words(passage)
            parts += [np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found)), np.array([-1], np.int32)]
            owners.append(np.full(len(found) + 1, item, np.int64))
        self.words, self.sequence, self.owner = list(number), np.concatenate(parts), np.concatenate(owners)

    def runs(self, known: dict[str, int], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Runs of ``size`` words in the numbers of a shard, without those that have a word it lacks, and the items they are from."""
        if len(self.sequence) < size:
            return np.empty((0, size), np.int64), self.owner[:0]
        symbol = np.array([*map(known.get, self.words, repeat(-1)), -1], np.int64)
        sequence = symbol[self.sequence]
        here = np.concatenate([[0], np.cumsum(sequence >= 0)])
        at = np.flatnonzero(here[size:] - here[:-size] == size)
        return np.lib.stride_tricks.sliding_window_view(sequence, size)[at], self.owner[at]


class Shard:
    """Documents gathered until their words fill an index."""

    def __init__(self, limit: int, overlap: int):
        self.limit, self.overlap = limit, overlap
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.keys: list = []
        self.skipped: list[int] = []
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, key, text: str) -> Iterator[dict]:
        """Take in a document; yields what is full. A text longer than a shard is cut, with an overlap that no run exceeds."""
        found = words(text)
        step = max(1, self.limit - self.overlap)
        for begin in range(0, max(1, len(found) - self.overlap), step):
            part = found[begin : begin + self.limit]
            if self.size and self.size + len(part) > self.limit:
                yield self.done()
            number = self.number
            self.keys.append(key)
            self.skipped.append(begin)
            self.parts += [np.fromiter((number.setdefault(w, len(number) + 1) for w in part), np.int32, len(part)), np.array([SEPARATOR], np.int32)]
            self.size += len(part) + 1

    def done(self) -> dict:
        """A row of the index."""
        starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in self.parts[::2]])])[:-1]
        index = FMIndex(np.concatenate(self.parts), len(self.number) + 1)
        row = {"keys": self.keys, "starts": starts, "skipped": self.skipped, "vocabulary": " ".join(self.number), "index": index.to_bytes()}
        self._clear()
        return row


def index_corpus(
    documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS, shard_words: int = SHARD_WORDS, path: str | None = None
) -> DataFrame:
    """An index of all texts for runs of up to ``size`` words, written to ``path`` (by default a folder that is deleted at the end) and read from there.

    One row a shard: keys and first places of its texts, its words, and the
    FM-index of these. Rows with a null key or text are left out. One scan of
    the corpus, no shuffle.
    """
    path = path or scratch_path(documents.sparkSession, "fmindex")
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, key_type = Shard(shard_words, size - 1), None

        def as_batch(row: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({**{k: [v] for k, v in row.items()}, "keys": pa.array([row["keys"]], pa.list_(key_type))})

        for batch in batches:
            key_type = batch.column(0).type
            for row_key, row_text in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from map(as_batch, shard.add(row_key, row_text.as_py()))
        if shard.size:
            yield as_batch(shard.done())

    usable = documents.select(key, text).where(F.col(key).isNotNull() & (F.col(text) != ""))
    columns = f"keys array<{kind}>, starts array<bigint>, skipped array<bigint>, vocabulary string, index binary"
    usable.mapInArrow(run, columns).write.option("maxRecordsPerFile", SHARDS_PER_FILE).parquet(path)
    return documents.sparkSession.read.schema(columns).parquet(path)


def _hits(row: dict, passages: Passages, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Where runs of the passages stand in a shard, as (text, first word, item), some at a time."""
    runs, items = passages.runs({w: i + 1 for i, w in enumerate(row["vocabulary"].split(" "))}, size)
    if not len(runs):
        return
    index = FMIndex.from_bytes(row["index"])
    starts, skipped = np.array(row["starts"]), np.array(row["skipped"])
    low, high = index.ranges(runs)
    counts = high - low
    for lines in _blocks(counts, LOCATE_AT_ONCE):
        many = counts[lines]
        run = np.repeat(np.arange(lines.start, lines.stop), many)
        at = index.locate(np.repeat(low[lines] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()))
        document = np.searchsorted(starts, at, "right") - 1
        yield document, at - starts[document] + skipped[document], items[run]


def _blocks(counts: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of lines with about ``most`` hits together, at least one line each; without hits none."""
    total, begin = np.cumsum(counts), 0
    while begin < len(counts) and total[-1] > (total[begin - 1] if begin else 0):
        done = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + most, "right")))
        yield slice(begin, end)
        begin = end


def _item_blocks(items: DataFrame, item: str, passage: str) -> Iterator[Passages]:
    """Passages in blocks of about BLOCK_BYTES, so that what the driver holds and sends is bounded."""
    block, held = [], 0
    for row in items.select(item, passage).where(F.col(item).isNotNull() & F.col(passage).isNotNull()).distinct().toLocalIterator():
        block.append((row[0], row[1]))
        held += len(row[1].encode())
        if held >= BLOCK_BYTES:
            yield Passages(block)
            block, held = [], 0
    if block:
        yield Passages(block)


def _search(index: DataFrame, items: DataFrame, item: str, passage: str, size: int, spans: bool, key: str) -> DataFrame:
    """(key, item_id), or (key, begin, end) for ``spans``, of every hit; each shard is read once, whatever the number of blocks."""
    context = index.sparkSession.sparkContext
    blocks = [context.broadcast(block) for block in _item_blocks(items, item, passage)]
    kind = index.schema["keys"].dataType.elementType.simpleString()

    def found(row: dict, keys: pa.Array, passages: Passages) -> Iterator[pa.RecordBatch]:
        for document, at, owner in _hits(row, passages, size):
            if spans:
                pairs = np.unique(np.stack([document, at], axis=1), axis=0)
                columns, names = [pa.array(pairs[:, 1]), pa.array(pairs[:, 1] + size)], [key, "begin", "end"]
            else:
                pairs = np.unique(np.stack([document, owner], axis=1), axis=0)
                columns, names = [pa.array(pairs[:, 1])], [key, "item_id"]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(pairs[:, 0])), *columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks:
                passages = block.value
                for i in range(batch.num_rows):
                    row = {name: batch.column(name)[i].as_py() for name in ("starts", "skipped", "vocabulary", "index")}
                    yield from found(row, batch.column("keys")[i].values, passages)
                if len(blocks) > 1:  # the worker keeps one block at a time
                    vars(block).pop("_value", None)

    return index.mapInArrow(run, f"`{key}` {kind}, " + ("`begin` bigint, `end` bigint" if spans else "item_id bigint"))


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    passage: str = "passage",
    size: int = WORDS,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """Distinct (key, item_id) where text and passage share at least ``size`` consecutive words.

    Rows with a null key, text, item or passage, and texts or passages of fewer
    words, share nothing. Items with one passage are all reported. Whole texts
    are searched; a text longer than a shard is cut with an overlap of size - 1
    words, so no run is lost. Empty tables give no rows.
    """
    return search_items(index_corpus(documents, key, text, size, shard_words), items, key, item, passage, size)


def leaked_spans(
    documents: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    passage: str = "passage",
    size: int = WORDS,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """What to remove: key, span_no, first_word, end_word; overlapping and touching runs are one span.

    Words are counted from 0 and ``end_word`` is the first after the span. Rows
    are treated as in :func:`leaked_items`; repeated rows of a key are one text.
    """
    return search_spans(index_corpus(documents, key, text, size, shard_words), items, key, item, passage, size)


def search_items(index: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", passage: str = "passage", size: int = WORDS) -> DataFrame:
    """As :func:`leaked_items`, in an index of the corpus for runs of at least ``size`` words."""
    return _search(index, items, item, passage, size, False, key).distinct()


def search_spans(index: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", passage: str = "passage", size: int = WORDS) -> DataFrame:
    """As :func:`leaked_spans`, in an index of the corpus for runs of at least ``size`` words."""
    merged = periods(_search(index, items, item, passage, size, True, key), [key], F.col("begin"), F.col("end"))
    return merged.select(
        key, F.col("period_no").alias("span_no"), F.col("start_us").alias("first_word"), F.col("end_us").alias("end_word")
    )
