"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of the passages.

The benchmark is the query set: it is processed in blocks of bounded size, each against all
documents. Every n-gram of an item is a seed, as any of them may be the only one that an edited copy
has kept. Where a seed occurs in a document, the passage around it is aligned with the item word by
word, so edited copies are found too. There is no upper limit on how common a seed may be.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlens.llm.common import table
from pitchlens.staging import stage

#: Words of benchmark items that are broadcast at once.
BLOCK_WORDS = 500_000
#: Items are matched window by window: this many words, each window half a window after the last.
PART_WORDS = 64
#: Raw words that a task remembers; a bound on its memory only.
WORDS_AT_ONCE = 50_000
EDGES = string.punctuation + "«»“”„‘’¿¡…"
MATCHES = "doc_id long, item_id long, score double, first_word long, last_word long"


class _Ids(dict):
    """Word ids of raw words, -1 for words that no item has."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        if len(self) > WORDS_AT_ONCE:
            self.clear()
        found = self[word] = self.vocabulary.get(word.strip(EDGES), -1)
        return found

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


@dataclass
class Block:
    """Items of one block: word ids of their windows (``parts``), and n-grams with their places.

    N-grams are numbered in 64 bits. Where there are more, some share a number; they are seeds for one
    another, and the alignment tells them apart.
    """

    items: list[int]
    parts: list[np.ndarray]
    vocabulary: dict[str, int]
    n: int

    def grams(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and positions of the n-grams of ``ids`` that hold known words only."""
        m = len(ids) - self.n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = np.ones(m, bool)
        value = np.zeros(m, np.int64)
        for k in range(self.n):
            known &= ids[k : k + m] >= 0
            value = value * len(self.vocabulary) + ids[k : k + m]
        at = np.flatnonzero(known)
        return value[at], at


def window_starts(words: int) -> list[int]:
    """Where the windows of an item start: all have ``PART_WORDS`` words, or there is one, the whole item."""
    last = max(0, words - PART_WORDS)
    return [*range(0, last, PART_WORDS // 2), last]


def make_block(rows: list[tuple[int, str]], n: int) -> Block:
    vocabulary: dict[str, int] = {}
    items, parts = [], []
    for item, text in rows:
        words = [w.strip(EDGES) for w in (text or "").lower().split()]
        ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int64)
        for start in window_starts(len(ids)):
            items.append(item)
            parts.append(ids[start : start + PART_WORDS])
    return Block(items, parts, vocabulary, n)


def _blocks(benchmark: DataFrame, n: int) -> Iterator[Block]:
    rows, words = [], 0
    for row in benchmark.toLocalIterator():
        rows.append((row[0], row[1]))
        words += len((row[1] or "").split())
        if words >= BLOCK_WORDS:
            yield make_block(rows, n)
            rows, words = [], 0
    if rows:
        yield make_block(rows, n)


def all_seeds(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of all parts (sorted numbers), with the part and the offset of each."""
    grams = [block.grams(ids) for ids in block.parts]
    seeds = np.concatenate([value for value, _ in grams])
    part_of = np.repeat(np.arange(len(grams)), [len(value) for value, _ in grams])
    order = np.argsort(seeds, kind="stable")
    return seeds[order], part_of[order], np.concatenate([at for _, at in grams])[order]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score (match 1, mismatch -1, gap -1) and the end of it in the passage."""
    steps = np.arange(len(passage))
    above = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        row = np.maximum(above[:-1] + np.where(passage == word, 1, -1), above[1:] - 1)
        row = np.maximum(row, 0)
        row = np.maximum.accumulate(row + steps) - steps  # gaps in the item, any length
        above = np.concatenate([[0], row])
        top = int(row.argmax()) if len(row) else 0
        if len(row) and row[top] > best:
            best, end = int(row[top]), top + 1
    return best, end


def _finder(block: Block, seeds: np.ndarray, part_of: np.ndarray, offsets: np.ndarray, least: float):
    """Finds the items that a text (as word ids) holds: item, score, first and last word."""

    def found_in(ids: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
        value, at = block.grams(ids)
        first, last = np.searchsorted(seeds, value), np.searchsorted(seeds, value, "right")
        hit = last > first
        if not hit.any():
            return
        first, last, at = first[hit], last[hit], at[hit]
        n = last - first
        which = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        part, start = part_of[which], np.repeat(at, n) - offsets[which]
        order = np.lexsort([start, part])
        part, start = part[order], start[order]
        best: dict[int, tuple[float, int, int]] = {}
        size = np.array([len(block.parts[p]) for p in part])
        slack = 8 + size // 2
        cut = np.flatnonzero((np.diff(part) != 0) | (np.diff(start) > slack[1:])) + 1
        for i, j in zip([0, *cut], [*cut, len(part)]):
            item, room = block.parts[part[i]], int(slack[i])
            low = max(0, int(start[i]) - room)
            passage = ids[low : int(start[j - 1]) + len(item) + room]
            # No alignment scores more than the item's words that the passage has at all.
            if np.isin(item, passage).sum() < least * len(item):
                continue
            score, end = align(item, passage)
            if score < least * len(item):
                continue
            back, length = align(item[::-1], passage[:end][::-1])
            name = block.items[part[i]]
            now = (score / len(item), low + end - length, low + end - 1)
            if name not in best or now[0] > best[name][0]:
                best[name] = now
        for name, (score, a, b) in best.items():
            yield name, score, a, b

    return found_in


def _match(block: Block, found_in):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Ids(block.vocabulary)
        for batch in batches:
            rows = [
                {"doc_id": d, "item_id": i, "score": s, "first_word": a, "last_word": b}
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for i, s, a, b in found_in(known.of(t))
            ]
            if rows:
                yield pa.RecordBatch.from_pylist(
                    rows,
                    schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()),
                                      ("first_word", pa.int64()), ("last_word", pa.int64())]),
                )

    return run


def _finders(benchmark: DataFrame, n: int, least: float) -> Iterator[tuple[Block, object]]:
    """Each block of the benchmark that has n-grams, with its finder."""
    for block in _blocks(benchmark, n):
        seeds, part_of, offsets = all_seeds(block)
        if len(seeds):
            yield block, _finder(block, seeds, part_of, offsets, least)


def leaks(
    docs: DataFrame, benchmark: DataFrame, least: float = 0.4, n: int = 3, id_col: str = "doc_id",
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Documents that hold a copy of a benchmark item, possibly edited.

    Returns ``doc_id``, ``item_id``, ``score`` (alignment score divided by the item's words: 1 for
    an exact copy; of items longer than ``PART_WORDS``, the best window of so many words), and the first
    and last word of the passage. Words are compared in lower case and without punctuation at their
    edges. Whole texts count. Null or blank texts match nothing, nor do items with fewer than ``n``
    words, and items of any length and number of different words are matched; rows without an id are reported with null; repeated rows give repeated results; an empty
    table on either side gives none. Further columns are not read.
    """
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    words = words.filter("text is not null")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    out = docs.sparkSession.createDataFrame([], MATCHES)
    for block, found_in in _finders(items, n, least):
        out = out.unionByName(stage(words.mapInArrow(_match(block, found_in), MATCHES), "leaks"))
    return out


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, least: float = 0.4, n: int = 3, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that hold no copy of a benchmark item, with all their columns.

    Same matches as in ``leaks``. Rows are filtered where they are, without a join, so rows without
    an id and repeated rows are each judged by their own text.
    """
    at = docs.columns.index(text_col)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))

    def clean(block: Block, found_in):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _Ids(block.vocabulary)
            for batch in batches:
                keep = [next(found_in(known.of(t)), None) is None for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return run

    for block, found_in in _finders(items, n, least):
        docs = docs.mapInArrow(clean(block, found_in), docs.schema)
    return docs


def leaks_query(spark, folder: str) -> DataFrame:
    """op5: all documents against all items of the benchmark."""
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
