"""Periodic runs of words by a dictionary of basic factors (operator 11).

A run is a stretch of words with smallest period q, at least ``max(min_length, 2 * q)`` long, that no neighbouring word
extends. Level k of the dictionary names the factors of 2^k words: equal factors of a document share a name. A run with
2^k <= q < 2^(k+1) repeats a factor of level k at distance q, so periods are proposed by the occurrences that follow a
factor within twice its length. Those at distances 2^k to 2^(k+1) - 1 form an arithmetic progression, whose first or last
member gives q at some place of every run: at the run's start, or where the factor's own periodic stretch starts or ends.
Each proposal is extended both ways by comparing names from the highest level down, and equal stretches are put together
under their smallest period (which divides the others, as they are twice as long at least).

Factors that occur once get no name and no place in the next level, so prose stops after a few levels. Names are worked out
for many texts at once; they hold the text's number, so texts never match each other. Memory: ``WORDS`` words, or one
text's if it has more, times the levels up to the longest repeat.

Words are parted by ASCII white space. A null or empty text has no words and no runs. Rows are worked on one by one, so
null and repeated ids and repeated rows do no harm; an empty table gives no rows. Only the id and the text column are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import batches_of, named, schema_with

MIN_LENGTH = 12
WORDS = 200_000  # that are named together
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Factors:
    """Names of the factors of 1, 2, 4, ... words at each place; a factor that occurs once has a negative name of its own."""

    def __init__(self, words: np.ndarray):
        self.size = len(words)
        self.levels: list[np.ndarray] = []
        self.places: list[np.ndarray] = []  # where a level's repeated factors are
        at, keys = np.arange(self.size), words.astype(np.int64)
        while len(at):
            _, names, counts = np.unique(keys, return_inverse=True, return_counts=True)
            again = counts[names] > 1
            at, names = at[again], names[again]
            if not len(at):
                break
            level = -1 - np.arange(self.size)
            level[at] = names
            width = 1 << len(self.levels)
            self.levels.append(level)
            self.places.append(at)
            at = at[at + width < self.size]
            at = at[level[at + width] >= 0]
            keys = level[at] * np.int64(self.size + 1) + level[at + width]

    def proposals(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, period) from the first and the last occurrence at a distance of ``2**k`` to ``2**(k+1) - 1``."""
        width, stride = 1 << k, self.size + 1
        own = self.levels[k][self.places[k]] * np.int64(2 * stride) + self.places[k]
        own.sort()
        low = np.searchsorted(own, own + width)
        high = np.searchsorted(own, own + 2 * width)
        some = high > low
        first, last = own[low[some]] - own[some], own[high[some] - 1] - own[some]
        place = own[some] % (2 * stride)
        place, period = np.concatenate([place, place]), np.concatenate([first, last])
        keys = np.unique(period * np.int64(stride) + place)
        # The same period proposed at the next place belongs to the same stretch.
        keys = keys[np.diff(keys, prepend=-2) != 1]
        return keys % stride, keys // stride

    def agreement(self, left: np.ndarray, right: np.ndarray, forward: bool) -> np.ndarray:
        """How many words from ``left`` and ``right`` on (or before them) are equal."""
        total = np.zeros(len(left), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            width = 1 << k
            a = left + total if forward else left - total - width
            b = right + total if forward else right - total - width
            inside = (a >= 0) & (b < self.size)
            level = self.levels[k]
            total += width * (inside & (level[np.where(inside, a, 0)] == level[np.where(inside, b, 0)]))
        return total


def runs_in(words: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows (start, length, period) of the runs in a row of word numbers, by start, then period."""
    factors = Factors(words)
    found = []
    for k in range(len(factors.levels)):
        place, period = factors.proposals(k)
        after = factors.agreement(place, place + period, True)
        before = factors.agreement(place, place + period, False)
        length = before + after + period
        whole = length >= np.maximum(min_length, 2 * period)
        found.append(np.stack([(place - before)[whole], length[whole], period[whole]], axis=1))
    rows = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
    # Rows are in order of start, length, period: the first of a stretch has its smallest period.
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[fresh]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _of_texts(texts: list[list[bytes]], min_length: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """For each text, as its words: its runs, and the words that stay."""
    numbers: dict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    flat = np.array([numbers[w] for t in texts for w in t], np.int64)
    flat += np.repeat(np.arange(len(texts)), sizes) * max(1, len(numbers))
    rows = runs_in(flat, min_length)
    # The words of a run beyond its first period go.
    change = np.zeros(len(flat) + 1, np.int64)
    np.add.at(change, rows[:, 0] + rows[:, 2], 1)
    np.add.at(change, rows[:, 0] + rows[:, 1], -1)
    stays = np.cumsum(change[:-1]) == 0
    cuts = np.searchsorted(rows[:, 0], ends)
    for text, low, high, end in zip(texts, [0, *cuts[:-1]], cuts, ends.tolist(), strict=True):
        start = end - len(text)
        own = rows[low:high] - np.array([start, 0, 0])
        yield own, [text[i] for i in np.flatnonzero(stays[start:end])] if low < high else text


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """Per row: the id, ``n_words``, ``runs`` (structs of start, length and period, in words, by start, then period) and
    ``collapsed`` (the words that stay when each run is cut to its first period, joined by a space, as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, lists, kept = [], [], []
            split = ((t.as_py() or b"").split() for t in b.column(1))
            for group in batches_of(split, len, WORDS):
                for rows, words in _of_texts(group, min_length):
                    lists.append(rows)
                    kept.append(b" ".join(words))
                sizes += map(len, group)
            flat = np.concatenate([*lists, np.zeros((0, 3), np.int64)])
            offsets = np.cumsum([0, *map(len, lists)], dtype=np.int32)
            structs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(RUN))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), structs), pa.array(kept, pa.binary())],
                [id_col, "n_words", "runs", "collapsed"],
            )

    schema = schema_with(docs, id_col, "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary")
    return docs.select(named(id_col), named(text_col).cast("binary")).mapInArrow(run, schema)
