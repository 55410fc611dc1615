"""Toxicity by averaged subword embeddings and a linear softmax (operator 3), trained in numpy.

A word is the average of the embeddings of its pieces: itself with its edges marked, and its byte n-grams, hashed into
``BUCKETS`` rows; so a misspelling that was never seen shares most of its pieces with the word it stands for. A window of
words is the average of its words, each counted once however often it repeats, and a linear softmax over it gives two classes; embeddings and softmax are trained
jointly. A text is cut into equal windows of ``WINDOW`` words and more, which cover all of it, and has the score of its
worst window. Training starts with every window under its document's label; then the toxic documents are represented by
their worst windows only, since their other windows need not be toxic.

It learns from at most ``SAMPLE`` ids of each label, those with the smallest hashes, and never from rows of the held-out
fold. Of repeated rows of an id one is learnt from, that with the smallest text. The sample is all that goes to the driver. Everything else covers all rows.

Null and empty texts have no words and get the score of the bias alone. A row with a null id belongs to the fold of an
empty id. Repeated rows are scored each. Labels that are null, or whose id has no document, are passed over; ids with
several labels count as toxic if one says so. Without rows of both labels every score is their smoothed share, below a
half unless most are toxic. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
DIM = 8
GRAMS = (3, 4, 5)
WINDOW = 25
SAMPLE = 2000  # labelled rows of each class that the classifier is fitted on, at most
FOLDS = 5
DAMPING = 1.0
CACHE = 500_000  # words that a Python worker remembers

words_of = re.compile(r"\w+").findall


def pieces(word: str) -> list[int]:
    """Rows of the embedding table that make up a word."""
    edged = b"<" + word.encode() + b">"
    found = [crc32(edged) % BUCKETS]
    for n in GRAMS:
        found += [crc32(edged[i : i + n]) % BUCKETS for i in range(len(edged) - n + 1)]
    return found


def windows(n: int) -> np.ndarray:
    """Starts of the windows of a text of n words."""
    return np.linspace(0, n, max(1, n // WINDOW), endpoint=False).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """What scoring needs: each piece's share of the logit, and the bias."""

    weights: np.ndarray
    bias: float

    def scorer(self):
        """A function from texts to scores, with a cache of words."""
        weights, seen = self.weights.tolist(), {}

        def value(word: str) -> float:
            ids = pieces(word)
            return sum([weights[i] for i in ids]) / len(ids)

        def score(text: str) -> float:
            words = words_of(text.lower())
            if len(seen) > CACHE:
                seen.clear()
            for w in set(words):
                if w not in seen:
                    seen[w] = value(w)
            worst = self.bias
            if words:
                cuts = [*windows(len(words)).tolist(), len(words)]
                worst += max(sum([seen[w] for w in set(words[a:b])]) / (b - a) for a, b in zip(cuts, cuts[1:]))  # noqa: B905
            return 1.0 / (1.0 + np.exp(-np.clip(worst, -30.0, 30.0)))

        return score


def _mean(rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.add.reduceat(rows, starts, axis=0) / sizes[:, None]


def _spread(grads: np.ndarray, to: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(to, grads[:, k], size) for k in range(grads.shape[1])], axis=1)


def fit(texts: list[str], toxic: np.ndarray, epochs: int = 15, rate: float = 0.05, batch: int = 2048, steps: int = 400, seed: int = 0) -> Model:
    """Trains embeddings and softmax by Adam on minibatches of windows, for ``epochs`` rounds and ``steps`` minibatches at least."""
    share = (toxic.sum() + 0.5) / (len(toxic) + 2)
    if toxic.sum() in (0, len(toxic)):
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    vocabulary: dict[str, int] = {}
    index, starts, bags, sizes, owner = [], [], [], [], []
    for doc, text in enumerate(texts):
        words = words_of(text.lower())
        if words:
            cuts = [*windows(len(words)).tolist(), len(words)]
            for a, b in zip(cuts, cuts[1:]):  # noqa: B905
                bag = [vocabulary.setdefault(w, len(vocabulary)) for w in dict.fromkeys(words[a:b])]
                index += bag
                starts.append(len(index) - len(bag))
                bags.append(len(bag))
                sizes.append(b - a)
                owner.append(doc)
    index, starts, bags, sizes, owner = (np.array(x, np.int64) for x in (index, starts, bags, sizes, owner))
    spelled = [np.array(pieces(w), np.int64) for w in vocabulary]
    piece_size = np.array([len(x) for x in spelled])
    piece_start = np.concatenate([[0], np.cumsum(piece_size)[:-1]])
    piece = np.concatenate(spelled)

    rng = np.random.default_rng(seed)
    # Embeddings start at zero, so a piece that training never met weighs nothing.
    params = [np.zeros((BUCKETS, DIM)), rng.normal(0, 1.0, (DIM, 2)), np.zeros(2)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    label = toxic[owner].astype(np.int64)
    # Each document weighs the same, and so does each class.
    per_doc = 1.0 / np.bincount(owner, minlength=len(texts))[owner]
    per_class = np.where(label == 1, 0.5 / per_doc[label == 1].sum(), 0.5 / per_doc[label == 0].sum())
    weight = per_doc * per_class * len(label)

    def gather(which: np.ndarray, of_start: np.ndarray, of_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the members of some segments, and where each segment then starts."""
        size = of_size[which]
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        return np.arange(size.sum()) + np.repeat(of_start[which] - first, size), first

    def forward(chosen: np.ndarray):
        members, first = gather(chosen, starts, bags)
        words, back = np.unique(index[members], return_inverse=True)
        parts, word_first = gather(words, piece_start, piece_size)
        vectors = _mean(params[0][piece[parts]], word_first, piece_size[words])
        x = _mean(vectors[back], first, sizes[chosen])
        logits = x @ params[1] + params[2]
        return x, logits, words, back, piece[parts]

    step, epochs = 0, max(epochs, -(-steps // -(-len(label) // batch)))
    for epoch in range(epochs):
        if epoch >= epochs // 3:  # toxic documents by their worst windows
            margin = np.concatenate([(lambda g: g[:, 1] - g[:, 0])(forward(np.arange(i, min(i + 8 * batch, len(label))))[1]) for i in range(0, len(label), 8 * batch)])
            order = np.lexsort((-margin, owner))
            best = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])]
            positive, negative = best[label[best] == 1], np.flatnonzero(label == 0)
            used = np.concatenate([positive, negative])
            mass = np.concatenate([np.full(len(positive), 0.5 / len(positive)), np.full(len(negative), 0.5 / len(negative))]) * len(used)
        else:
            used, mass = np.arange(len(label)), weight
        shuffle = rng.permutation(len(used))
        for i in range(0, len(used), batch):
            pick = shuffle[i : i + batch]
            chosen, m = used[pick], mass[pick]
            x, logits, words, back, ids = forward(chosen)
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(chosen)), label[chosen]] -= 1
            d = p * (m / len(chosen))[:, None]
            dx = (d @ params[1].T) / sizes[chosen][:, None]
            dw = _spread(np.repeat(dx, bags[chosen], axis=0), back, len(words)) / piece_size[words][:, None]
            grads = [_spread(np.repeat(dw, piece_size[words], axis=0), ids, BUCKETS), x.T @ d, d.sum(axis=0)]
            step += 1
            for p_, g, (a, b) in zip(params, grads, moments, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                # A damping of the usual size of a gradient keeps rare pieces from moving as far as frequent ones.
                typical = np.sqrt(b[b > 0].mean()) if b.any() else 0.0
                p_ -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + DAMPING * typical + 1e-12)
    direction = params[1][:, 1] - params[1][:, 0]
    return Model(params[0] @ direction, float(params[2][1] - params[2][0]))


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on the bounded sample of the rows outside the held-out fold."""
    usable = labels.where(fold(id_col) != 0).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("y")).where("y is not null")
    rank = F.xxhash64(F.col(id_col).cast("string"))
    chosen = usable.where("y = 1").orderBy(rank, id_col).limit(sample).union(usable.where("y = 0").orderBy(rank, id_col).limit(sample))
    rows = docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), id_col)
    # One row of each id, however often it is repeated; so the bound on the ids is the bound on the rows.
    single = rows.groupBy(id_col, "y").agg(F.min("text").alias("text"))
    found = single.select(rank.alias("rank"), "text", "y").orderBy("rank", "text").toArrow()
    return fit(found.column("text").to_pylist(), np.asarray(found.column("y").to_pylist(), np.int64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``held_out``, ``score`` and ``predicted``. The model (a table of fixed size) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer()
        for b in batches:
            found = pa.array([of(t.as_py() or "") for t in b.column(2)], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), found], [id_col, "held_out", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, (fold(id_col) == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
