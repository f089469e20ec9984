"""Toxicity by a chain of linear classifiers.

The chain predicts the categories in order; each link is a logistic regression on the presence of
words and word stems, and sees the probabilities of all earlier links. In training those come from
out-of-fold predictions, so that a later link never learns from an earlier one's over-fitted output.

Categories of the default chain: ``low_quality`` (labels.quality = 0), ``toxic`` (labels.toxic = 1),
``severe_toxic`` (toxic with at least three distinct terms that mark toxic texts).
The first is no toxicity: junk and abuse share words, so the chain predicts it first for the later links to
discount. The tables label no degree of toxicity, so the third is derived from the training rows themselves.
A null or empty text has no features and gets each link's prior. Repeated rows get equal results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Chunk, cut, labelled_sample, map_texts, prefix_hash, release, sigmoid, span_hash

CATEGORIES = ("low_quality", "toxic", "severe_toxic")
#: Training rows at most; the model does not need more as the corpus grows.
SAMPLE = 5000
#: Distinct terms of the training texts together, at most: what the driver holds.
MOST_TERMS = 8_000_000
#: Terms that a link may use.
TERMS = 384
STEMS = (4, 5, 6, 7)
THRESHOLD = 0.5
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True


def term_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, 32-bit term) of every word and word stem, repeats included; words are runs of letters and digits."""
    c = Chunk([(t or "").lower() for t in texts])
    solid = np.zeros(len(c.data) + 2, np.int8)
    solid[1:-1] = _LETTER[c.data]
    step = np.diff(solid)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    row = np.searchsorted(c.start, start, "right") - 1
    prefix = prefix_hash(c.data)
    rows, terms = [row], [span_hash(prefix, start, end) | np.uint64(1)]
    for n in STEMS:
        keep = end - start > n
        rows.append(row[keep])
        terms.append(span_hash(prefix, start[keep], start[keep] + n) & ~np.uint64(1))
    return np.concatenate(rows), (np.concatenate(terms) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


@dataclass
class Link:
    terms: np.ndarray
    weights: np.ndarray
    feed: np.ndarray
    bias: float


def _solve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the unpenalised bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w, pull = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pull[-1] = 1e-3
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


class Terms:
    """Which texts have which terms, of the training texts: ``row`` and ``term`` (a place in the sorted ``names``) of each pair, in 32 bits."""

    def __init__(self, n: int, row: np.ndarray, terms: np.ndarray):
        self.n, self.row, self.names = n, row.astype(np.int32), np.unique(terms)
        self.term = np.searchsorted(self.names, terms).astype(np.int32)

    @classmethod
    def of(cls, features: list[np.ndarray]) -> Terms:
        row = np.repeat(np.arange(len(features), dtype=np.int32), [len(f) for f in features]) if features else np.empty(0, np.int32)
        return cls(len(features), row, np.concatenate(features) if features else np.empty(0, np.uint32))

    def count(self, of: np.ndarray | None = None) -> np.ndarray:
        """For each term the texts that have it, or the sum of ``of`` over them."""
        return np.bincount(self.term, weights=None if of is None else of[self.row], minlength=len(self.names))

    def choose(self, y: np.ndarray, most: int, train: np.ndarray) -> np.ndarray:
        """The places of the terms that separate the classes of the training rows best, by the signed root of the likelihood ratio; ties by term."""
        pos, neg = max(1, y[train].sum()), max(1, (1 - y[train]).sum())
        a, every = self.count(np.where(train, y, 0.0)), self.count(train.astype(float))
        b = every - a
        gain = np.abs(np.sqrt(a / pos) - np.sqrt(b / neg)) * np.sqrt(every)
        seen = np.flatnonzero(every >= 3)
        return np.sort(seen[np.lexsort((seen, -gain[seen]))][:most])

    def matrix(self, chosen: np.ndarray) -> np.ndarray:
        """Texts x chosen terms, 1 where a text has the term."""
        at = np.full(len(self.names), -1, np.int32)
        at[chosen] = np.arange(len(chosen), dtype=np.int32)
        column = at[self.term]
        hit = column >= 0
        x = np.zeros((self.n, len(chosen)), np.float32)
        x[self.row[hit], column[hit]] = 1
        return x


def _choose(rows: np.ndarray, terms: np.ndarray, y: np.ndarray, most: int, train: np.ndarray) -> np.ndarray:
    """``Terms.choose`` for (row, term) pairs; the terms themselves, ascending."""
    held = Terms(len(y), rows, terms)
    return held.names[held.choose(y, most, train)]


def fit_chain(features: list[np.ndarray], labels: np.ndarray, folds: int = 5, terms: int = TERMS) -> list[Link]:
    """features: each row's distinct terms; labels: rows x categories, 0 or 1. Rows are dealt to folds by position."""
    return fit_terms(Terms.of(features), labels, folds, terms)


def fit_terms(held: Terms, labels: np.ndarray, folds: int = 5, terms: int = TERMS) -> list[Link]:
    n = held.n
    fold, fed, chain = np.arange(n) % folds, np.zeros((n, 0)), []
    for y in labels.T.astype(float):
        none = np.empty(0, np.uint32)
        if n == 0 or y.min() == y.max():
            chain.append(Link(none, np.empty(0), np.zeros(fed.shape[1]), -8.0 if n == 0 or y.max() == 0 else 8.0))
            fed = np.hstack([fed, np.full((n, 1), 0.0 if n == 0 or y.max() == 0 else 1.0)])
            continue
        out = np.zeros(n)
        for k in range(folds):
            train = fold != k
            x = np.hstack([held.matrix(held.choose(y, terms, train)), fed])
            w = _solve(x[train], y[train])
            out[~train] = sigmoid(x[~train] @ w[:-1] + w[-1])
        chosen = held.choose(y, terms, np.ones(n, bool))
        w = _solve(np.hstack([held.matrix(chosen), fed]), y)
        chain.append(Link(held.names[chosen], w[: len(chosen)], w[len(chosen) : -1], float(w[-1])))
        fed = np.hstack([fed, out[:, None]])
    return chain


def score_texts(chain: list[Link], texts: list[str | None]) -> np.ndarray:
    """Rows x categories of probabilities."""
    rows, terms = term_hashes(texts)
    every = np.unique(np.concatenate([k.terms for k in chain]))
    table = np.zeros(1 << 20, bool)
    table[every & np.uint32(0xFFFFF)] = True
    maybe = table[terms & np.uint32(0xFFFFF)]
    rows, terms = rows[maybe], terms[maybe]
    both = np.unique((rows.astype(np.uint64) << np.uint64(32)) | terms)
    rows, terms = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = np.zeros((len(texts), 0))
    for k in chain:
        z = np.full(len(texts), k.bias)
        if len(k.terms):
            at = np.minimum(np.searchsorted(k.terms, terms), len(k.terms) - 1)
            hit = k.terms[at] == terms
            z += np.bincount(rows[hit], weights=k.weights[at[hit]], minlength=len(texts))
        out = np.hstack([out, sigmoid(z + out @ k.feed)[:, None]])
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Link]:
    """Fits the default chain on at most ``sample`` labelled texts and MOST_TERMS of their terms; only term hashes reach the driver."""
    chosen = labelled_sample(labels.withColumn("both", F.col("quality") * 2 + F.col("toxic")), "both", sample)

    def make():
        def kernel(cols):
            rows, terms = term_hashes(cols["text"])
            both = np.unique((rows.astype(np.uint64) << np.uint64(32)) | terms)
            cuts = np.searchsorted(both >> np.uint64(32), np.arange(1, len(cols["text"]), dtype=np.uint64))
            return {"doc_id": cols["doc_id"], "both": cols["both"], "terms": [p.astype(np.uint32).tobytes() for p in np.split(both & np.uint64(0xFFFFFFFF), cuts)]}

        return kernel

    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    made = cut(map_texts(joined, make, "doc_id long, both int, terms binary"))
    if (made.agg(F.sum(F.length("terms"))).first()[0] or 0) > 4 * MOST_TERMS:
        made = made.join(F.broadcast(_within(made)), "doc_id")
    got = sorted(made.collect(), key=lambda r: (r.doc_id, r.terms))
    release(made)
    quality, toxic = np.array([r.both // 2 for r in got], int), np.array([r.both % 2 for r in got], int)
    held = Terms.of([np.frombuffer(r.terms, np.uint32) for r in got])
    del got  # as large as the terms, which are copied
    if not toxic.any():
        severe = toxic
    else:
        a = held.count(toxic.astype(float))
        marks = (a >= max(3, 0.02 * toxic.sum())) & (a >= 0.9 * held.count())
        severe = toxic * (np.bincount(held.row, weights=marks[held.term], minlength=held.n) >= 3)
    return fit_terms(held, np.column_stack([1 - quality, toxic, severe]) if len(toxic) else np.zeros((0, 3)))


def _within(made: DataFrame) -> DataFrame:
    """doc_id of the training texts that are taken, whole, in hash order of their ids while their terms together are no more than MOST_TERMS."""
    sizes = made.groupBy("doc_id").agg(F.sum(F.length("terms") / 4).cast("long").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    total, ids = 0, []
    for r in sizes:
        if total + r.n <= MOST_TERMS:
            total += r.n
            ids.append((r.doc_id,))
    return made.sparkSession.createDataFrame(ids, "doc_id long")


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, a probability for each category, and rejected (toxic >= THRESHOLD); one row per document."""
    chain = train(docs, labels, sample)

    def make():
        def kernel(cols):
            p = score_texts(chain, cols["text"])
            return {"doc_id": cols["doc_id"], **{c: p[:, i] for i, c in enumerate(CATEGORIES)}, "rejected": p[:, 1] >= THRESHOLD}

        return kernel

    return map_texts(docs.select("doc_id", "text"), make, f"doc_id long, {', '.join(f'{c} double' for c in CATEGORIES)}, rejected boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the chain does not reject, all columns kept; scoring needs no shuffle."""
    chain = train(docs, labels, sample)
    schema = docs.schema

    def run(batches):
        import pyarrow as pa

        from .common import pieces

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            keep = np.concatenate([score_texts(chain, texts[a:b])[:, 1] < THRESHOLD for a, b in pieces(texts)] or [np.empty(0, bool)])
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)
