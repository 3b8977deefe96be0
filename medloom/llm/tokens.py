"""Encoding, decoding and counting with a byte-level BPE vocabulary.

The merges of one pretoken are carried out with a priority queue of merge ranks over a doubly linked list of symbols;
entries whose symbols have changed since they were queued are stale and skipped. Pretokens repeat, so a worker keeps the
ids of those it has met (a bounded table that is emptied when full, which never changes a result).

The vocabulary file is a parameter. It is read on the driver and broadcast: its size is that of a vocabulary (under a
megabyte for 50,000 entries), whatever the corpus.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the published pattern that splits text before the merges of byte_bpe_50k.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Entries of a worker's table of known chunks.
MEMO = 150_000
#: A longer chunk is encoded but not remembered.
MEMO_CHARS = 64


def vocabulary_path(name: str = VOCABULARY, folder: str | None = None) -> str:
    """Where the vocabulary files lie: ``folder``, else $MEDLOOM_TOKENIZERS, else the installed package's folder."""
    return os.path.join(folder or os.environ.get("MEDLOOM_TOKENIZERS", "/opt/tokenizers"), name)


class BytePairs:
    """A vocabulary of byte strings with their merge ranks."""

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line)}
        self.strings = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(PATTERN)
        # a blank between two white-space characters belongs to a longer run, so the text can't be cut there
        self.unsafe = re.compile(r"\s \s")
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pretoken."""
        ranks, n = self.ranks, len(piece)
        symbols = [piece[i : i + 1] for i in range(n)]
        if n == 1:
            return [ranks[piece]]
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(rank, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (rank := ranks.get(symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if j < 0 or symbols[i] is None or symbols[i] != left or symbols[j] != right:
                continue  # stale
            symbols[i], symbols[j] = left + right, None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (rank := ranks.get(symbols[i] + symbols[k])) is not None:
                    heapq.heappush(queue, (rank, i, symbols[i], symbols[k]))
            if (h := before[i]) >= 0 and (rank := ranks.get(symbols[h] + symbols[i])) is not None:
                heapq.heappush(queue, (rank, h, symbols[h], symbols[i]))
        return [ranks[s] for s in symbols if s is not None]

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        ids: list[int] = []
        for word in self.pattern.findall(chunk):
            ids += self.merge(word.encode("utf-8", "replace"))
        return tuple(ids)

    def _missing(self, chunk: str) -> tuple[int, ...]:
        ids = self._chunk(chunk)
        if len(chunk) <= MEMO_CHARS:
            if len(self.known) >= MEMO:
                self.known.clear()
            self.known[chunk] = ids
        return ids

    def _chunks(self, text: str) -> Iterator[tuple[int, ...]]:
        """Ids of the stretches between blanks. A blank with a visible character on one side starts a pretoken, so the
        stretches can be encoded apart, each with the blank before it; other texts are cut by the pattern itself."""
        known, missing = self.known.get, self._missing
        if self.unsafe.search(text):
            for word in self.pattern.findall(text):
                yield known(word) or missing(word)
            return
        first, *rest = text.split(" ")
        if first:
            yield known(first) or missing(first)
        for stretch in rest:
            chunk = " " + stretch
            yield known(chunk) or missing(chunk)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; of a null or empty text an empty list. Strings of special tokens are ordinary text."""
        return list(chain.from_iterable(self._chunks(text))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, self._chunks(text))) if text else 0

    def decode(self, ids) -> str:
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "replace")


_LOADED: dict[str, BytePairs] = {}


def _loaded(lines: bytes) -> BytePairs:
    """One vocabulary a worker, kept between tasks."""
    key = hashlib.md5(lines).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = BytePairs(lines)
    return _LOADED[key]


def _shared(df: DataFrame, path: str | None):
    with open(path or vocabulary_path(), "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids array<int>) of every row; null and empty texts have an empty list, blank ones the ids of their blanks.

    One pass without a shuffle; other columns play no part.
    """
    lines = _shared(df, vocabulary)
    column = df.select(f"`{key}`", f"`{text}`")

    def run(batches):
        pairs = _loaded(lines.value)
        for batch in batches:
            ids, ends = array("i"), array("i", [0])
            for value in batch.column(1).to_pylist():
                if value:
                    ids.extend(chain.from_iterable(pairs._chunks(value)))
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(ends), [None, pa.py_buffer(ends)]), pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    return column.mapInArrow(run, f"`{key}` {column.dtypes[0][1]}, ids array<int>")


def count_tokens(df: DataFrame, text: str = "text", vocabulary: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row and its exact number of tokens, n_tokens (0 for null and empty texts)."""
    lines = _shared(df, vocabulary)
    columns = df.select(*[f"`{c}`" for c in keep], df[f"`{text}`"].alias("_counted"))

    def run(batches):
        pairs = _loaded(lines.value)
        for batch in batches:
            counts = pa.array([pairs.count(v) for v in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], counts], names=[*keep, "n_tokens"])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in columns.dtypes[:-1])
    return columns.mapInArrow(run, f"{schema}, n_tokens bigint")


def decode_ids(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(key, text) from lists of ids; a null list gives a null text."""
    lines = _shared(df, vocabulary)
    columns = df.select(f"`{key}`", f"`{ids}`")

    def run(batches):
        pairs = _loaded(lines.value)
        for batch in batches:
            texts = [None if v is None else pairs.decode(v) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return columns.mapInArrow(run, f"`{key}` {columns.dtypes[0][1]}, text string")
