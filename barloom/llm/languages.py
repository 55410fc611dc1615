"""Languages of a document as a mixture, inferred by expectation-maximisation (operator 13).

Training counts, over all rows that may be learned from, how often each language has each character n-gram of its words
(hashed into ``BUCKETS``): tasks count into arrays and hand over sums, so the model is languages times buckets in size,
whatever the corpus. Words are runs of letters in lower case, long ones cut into parts of ``PART`` letters.

A document's words are drawn from a mixture of languages. A word's likelihood under each comes from its n-grams, relative
to the best one and ``FLOOR`` at least, which bounds what one odd word can claim. EM estimates the proportions. The log
likelihood is concave, so the largest gradient less the number of words bounds what is left to gain; a document is done
when that is under ``GAP``, or when no further language could pay its penalty. Languages are then removed, the smallest
proportion first, as long as the penalised log likelihood does not fall. A language costs ``penalty`` times the logarithm
of one more than the number of words.

Documents are taken many at once; each is worked on until it is done. A text that is null or has no letter is ``und``
with a score of 0. The prediction is the language with the largest proportion (ties: the first by name), the score its
proportion, drawn towards equal parts as by one more word. Without anything to learn from all rows are ``und``.

Rows with a null id belong to neither side of a split: they are not learned from and are marked as held out. Rows that
share an id are on the same side; repeated rows count as often as they occur. Null languages are not learned from. An
empty table gives no rows. Predictions read the text only.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import batches_of, named, schema_with

BUCKETS = 1 << 15
ORDERS = (2, 3, 4)  # letters of an n-gram, the marks of a word's ends included
PART = 24
SMOOTHING = 0.5
FLOOR = 1e-4
PENALTY = 2.0
GAP = 0.05  # of the log likelihood
ROUNDS = 200
CACHE = 300_000  # words that a Python worker remembers
WORDS = 100_000  # that are worked on together
UNDETERMINED = "und"


def words_of(text: str) -> list[str]:
    import regex

    found = regex.findall(r"\p{L}+", text.lower())
    if max(map(len, found), default=0) > PART:
        found = [w[i : i + PART] for w in found for i in range(0, len(w), PART)]
    return found


def buckets_of(word: str) -> list[int]:
    marked = f"<{word}>"
    return [zlib.crc32(marked[i : i + n].encode()) % BUCKETS for n in ORDERS for i in range(len(marked) - n + 1)]


def of_training(id_col: str = "doc_id", parts: int = 3, held: int = 1) -> Column:
    """True for rows that may be learned from: those whose id has another remainder than ``held``."""
    return F.coalesce(F.crc32(named(id_col).cast("string")) % parts != held, F.lit(False))


@dataclass
class Model:
    names: list[str]
    log_p: np.ndarray  # buckets x languages

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """A row for each word: its likelihood under each language, relative to the best and floored."""
        lists = [buckets_of(w) for w in words]
        if not lists:
            return np.zeros((0, len(self.names)))
        sizes = np.array([len(x) for x in lists])
        flat = self.log_p[np.array([b for x in lists for b in x])]
        # A letter is part of an n-gram of each order.
        logs = np.add.reduceat(flat, np.concatenate([[0], np.cumsum(sizes)[:-1]])) / len(ORDERS)
        return np.maximum(np.exp(logs - logs.max(axis=1, keepdims=True)), FLOOR)


def gram_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(``lang``, ``bucket``, ``n``): how often the words of a language have an n-gram of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS, np.int64))
        for b in batches:
            seen: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                seen[lang].update(words_of(text.as_py()))
            for lang, words in seen.items():
                lists = [buckets_of(w) for w in words]
                flat = np.array([x for own in lists for x in own], np.int64)
                times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), [len(x) for x in lists])
                sums[lang] += np.bincount(flat, times, BUCKETS).astype(np.int64)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], ["lang", "bucket", "n"])

    rows = docs.select(named(lang_col).cast("string").alias("lang"), named(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    made = rows.mapInArrow(run, "lang string, bucket int, n bigint")
    return made.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """A model of all languages that rows of ``docs`` name."""
    found = gram_counts(docs, lang_col, text_col).toArrow()  # languages x BUCKETS rows at most
    langs = found["lang"].to_pylist()
    names = sorted(set(langs))
    counts = np.zeros((BUCKETS, len(names)))
    counts[found["bucket"].to_numpy(), np.searchsorted(np.array(names), np.array(langs))] = found["n"].to_numpy()
    counts += SMOOTHING
    return Model(names, np.log(counts / counts.sum(axis=0)) if names else counts)


class Mixtures:
    """Documents that are worked on together: per document and word a row of likelihoods and how often it occurs."""

    def __init__(self, rows: np.ndarray, times: np.ndarray, starts: np.ndarray):
        self.rows, self.times, self.starts = rows, times, starts
        self.sizes = np.diff(np.append(starts, len(times)))
        self.total = np.add.reduceat(times, starts)

    def of(self, which: np.ndarray) -> Mixtures:
        """Some of the documents, by number."""
        take = np.repeat(self.starts[which] - np.cumsum(self.sizes[which]) + self.sizes[which], self.sizes[which]) + np.arange(self.sizes[which].sum())
        sizes = self.sizes[which]
        return Mixtures(self.rows[take], self.times[take], np.cumsum(sizes) - sizes)

    def single(self) -> np.ndarray:
        """Log likelihood of each document under each language alone."""
        return np.add.reduceat(np.log(self.rows) * self.times[:, None], self.starts)

    def step(self, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods, and their gradients by the shares."""
        mixed = np.einsum("ij,ij->i", self.rows, np.repeat(share, self.sizes, axis=0))
        mixed = np.maximum(mixed, 1e-300)
        slope = np.add.reduceat(self.rows * (self.times / mixed)[:, None], self.starts)
        return np.add.reduceat(np.log(mixed) * self.times, self.starts), slope

    def fit(self, allowed: np.ndarray, enough: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Shares over the allowed languages, and their log likelihoods. A document whose likelihood is sure to stay under
        ``enough`` is left early."""
        share = allowed / allowed.sum(axis=1, keepdims=True)
        likely = np.zeros(len(share))
        todo, part = np.arange(len(share)), self
        for _ in range(ROUNDS):
            value, slope = part.step(share[todo])
            likely[todo] = value
            left = np.where(allowed[todo], slope, 0).max(axis=1) - part.total
            share[todo] *= slope / part.total[:, None]
            going = left > GAP
            if enough is not None:
                going &= value + left >= enough[todo]
            if not going.any():
                break
            if not going.all():
                todo, part = todo[going], part.of(np.flatnonzero(going))
        return share, likely

    def select(self, penalty: float = PENALTY) -> np.ndarray:
        """Per document the shares of its selected languages; the others are 0."""
        alone = self.single()
        best = alone.argmax(axis=1)
        n, count = alone.shape
        result = np.eye(count)[best]
        if count == 1:
            return result
        cost = penalty * np.log1p(self.total)
        everything, likely = self.fit(np.ones((n, count)), alone.max(axis=1) + cost)
        # Penalised likelihoods of the best set so far; one language alone is the first.
        top = alone.max(axis=1) - cost
        open_ = np.flatnonzero(likely - 2 * cost > top)
        share, likely = everything[open_], likely[open_]
        part = self.of(open_) if len(open_) else self
        while len(open_):
            size = (share > 0).sum(axis=1)
            smallest = np.where(share > 0, share, np.inf).argmin(axis=1)
            fewer = (share > 0).astype(float)
            fewer[np.arange(len(open_)), smallest] = 0
            next_share, next_likely = part.fit(fewer)
            worse = next_likely + cost[open_] < likely  # without it, the penalised likelihood falls
            done = worse | (size <= 2)
            gain = likely - size * cost[open_]
            better = worse & (gain > top[open_])
            result[open_[better]] = share[better]
            go = np.flatnonzero(~done)
            open_, share, likely = open_[go], next_share[go], next_likely[go]
            part = part.of(go) if len(go) else part
        return result


class Guesser:
    """A worker's model with the words that it remembers."""

    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty = model, penalty
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(model.names)))

    def shares(self, texts: list[list[str]]) -> np.ndarray:
        """A row of shares for each text, given as its words; zeros if it has none."""
        out = np.zeros((len(texts), len(self.model.names)))
        counts = [Counter(t) for t in texts]
        some = [i for i, c in enumerate(counts) if c]
        if not some or not self.model.names:
            return out
        if len(self.known) > CACHE:
            self.known, self.table = {}, self.table[:0]
        fresh = [w for w in set().union(*counts) if w not in self.known]
        self.known |= zip(fresh, range(len(self.table), len(self.table) + len(fresh)), strict=True)
        self.table = np.concatenate([self.table, self.model.likelihoods(fresh)])
        at = np.array([self.known[w] for i in some for w in counts[i]])
        times = np.array([n for i in some for n in counts[i].values()], float)
        sizes = np.array([len(counts[i]) for i in some])
        out[some] = Mixtures(self.table[at], times, np.cumsum(sizes) - sizes).select(self.penalty)
        return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """Per row: the id, ``lang_pred``, ``score`` and ``languages`` (the selected ones with their shares, largest first)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesser = Guesser(shared.value, penalty)
        names = guesser.model.names
        for b in batches:
            guessed, scores, lists = [], [], []
            for group in batches_of((words_of(t.as_py() or "") for t in b.column(1)), len, WORDS):
                for words, share in zip(group, guesser.shares(group), strict=True):
                    order = sorted(np.flatnonzero(share).tolist(), key=lambda i: (-share[i], i))
                    lists.append([{"lang": names[i], "share": float(share[i])} for i in order])
                    guessed.append(names[order[0]] if order else UNDETERMINED)
                    n = len(words)
                    scores.append((n * float(share[order[0]]) + 1 / len(names)) / (n + 1) if order else 0.0)
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(guessed, pa.string()), pa.array(scores, pa.float64()), pa.array(lists, kind)], [id_col, "lang_pred", "score", "languages"]
            )

    schema = schema_with(docs, id_col, "lang_pred string, score double, languages array<struct<lang:string,share:double>>")
    return docs.select(named(id_col), named(text_col).cast("string")).mapInArrow(run, schema)
