"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad; its features are counts of the line and of its two neighbours. Labels exist
for documents only, so training starts with every line labelled as its document, then frees the lines
of bad documents that the model itself takes for good, and refits. A document's quality is the
length-weighted mean of its lines' marginals from forward-backward, calibrated on the training rows.
A null or empty text is one empty line.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import Chunk, Lines, byte_set, count_in, first_of, held_out, labelled_sample, map_texts, paired, repeated_words, sigmoid, training_rows

#: Training rows at most.
SAMPLE = 3000
#: Lines of the training rows together at most: their features (49 floats a line, so 20 MB) meet on the driver.
MOST_LINES = 100_000
KEEP_AT = 0.3
#: Lines of a training sequence; longer documents are cut into several sequences for training only.
SEGMENT = 64
_SYMBOL, _UPPER, _DIGIT = byte_set(b"#*$%&<>"), byte_set(bytes(range(65, 91))), byte_set(b"0123456789")
_LETTER = byte_set(bytes(range(65, 91)) + bytes(range(97, 123)))
OWN = 15


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of features, document, length) of every line, in order."""
    c = Chunk(texts)
    c.words()
    li = Lines(c)
    size = (li.end - li.start).astype(float)
    per = lambda mask: count_in(c, mask, li.start, li.end) / np.maximum(size, 1)
    letters = np.maximum(count_in(c, _LETTER[c.data], li.start, li.end), 1)
    some = np.maximum(li.words, 1)
    line_of_word = np.repeat(np.arange(len(li.end)), li.words)
    order, fresh = first_of(paired(c.w_hash, line_of_word))
    distinct = np.bincount(line_of_word[order[fresh]], minlength=len(li.end))
    again = np.bincount(line_of_word[repeated_words(c)], minlength=len(li.end))
    last = c.data[np.maximum(li.end - 1, 0)]
    upper = count_in(c, _UPPER[c.data], li.start, li.end) / letters
    symbol, bang, bar = per(_SYMBOL[c.data]), per(c.data == 33), per(c.data == 124)
    own = np.column_stack([
        np.log1p(size) / 8, np.minimum(li.words, 100) / 100, upper, upper > 0.5, np.minimum(symbol * 5, 1), symbol > 0.05,
        np.minimum(bang * 10, 1), np.minimum(bar * 5, 1), bar > 0.02, np.minimum(per(_DIGIT[c.data]) * 5, 1), np.minimum(size / some / 20, 2),
        (last == 46) | (last == 33) | (last == 63), li.repeated, 1 - distinct / some * (li.words > 0), again / some,
    ]).astype(np.float32)
    first = np.concatenate([[True], li.doc[1:] != li.doc[:-1]])
    final = np.concatenate([first[1:], [True]])
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first], after[final] = 0, 0
    edge = np.column_stack([np.ones(len(own)), first, final]).astype(np.float32)
    return np.hstack([own, before, after, edge]), li.doc, size


WIDTH = 3 * OWN + 3


@dataclass
class Crf:
    weights: np.ndarray
    trans: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def marginals(self, x: np.ndarray, seq: np.ndarray) -> np.ndarray:
        return _forward_backward(x @ self.weights, self.trans, seq)[0]

    def quality(self, x: np.ndarray, doc: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
        """Share of bad length of each document, as log-odds of good."""
        p, weight = self.marginals(x, doc), size + 1
        bad = np.bincount(doc, p * weight, n) / np.maximum(np.bincount(doc, weight, n), 1e-9)
        bad = np.clip(bad, 1e-4, 1 - 1e-4)
        return np.log((1 - bad) / bad)

    def score(self, x, doc, size, n) -> np.ndarray:
        return sigmoid(self.slope * self.quality(x, doc, size, n) + self.shift)


def _layout(seq: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Starts of the sequences, longest first, and how many sequences have a t-th line."""
    starts = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]])) if len(seq) else np.empty(0, int)
    lengths = np.diff(np.concatenate([starts, [len(seq)]]))
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    alive = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")
    return starts[order], alive.tolist()


def _forward_backward(e: np.ndarray, trans: np.ndarray, seq: np.ndarray):
    """Marginals of bad, the sums of pairwise marginals, and the log partition; all sequences advance together."""
    starts, alive = _layout(seq)
    pot = np.column_stack([np.ones(len(e)), np.exp(np.clip(e, -30, 30))])
    move = np.exp(np.clip(trans, -20, 20))
    alpha, beta, scale = np.empty_like(pot), np.ones_like(pot), np.ones(len(e))
    for t, k in enumerate(alive):
        at = starts[:k] + t
        a = pot[at] if t == 0 else (alpha[at - 1] @ move) * pot[at]
        scale[at] = s = a.sum(1)
        alpha[at] = a / s[:, None]
    pair = np.zeros((2, 2))
    for t in range(len(alive) - 1, 0, -1):
        at = starts[: alive[t]] + t
        down = pot[at] * beta[at] / scale[at][:, None]
        beta[at - 1] = down @ move.T
        pair += alpha[at - 1].T @ down
    return alpha[:, 1] * beta[:, 1], pair * move, float(np.log(scale).sum())


def _fit(x: np.ndarray, seq: np.ndarray, y: np.ndarray, start: Crf, rounds: int, ridge: float = 1.0) -> Crf:
    """Maximum likelihood by Adam with an L2 penalty."""
    same = seq[1:] == seq[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][same], y[1:][same]), 1)
    theta = np.concatenate([start.weights, start.trans.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n = max(1, len(y))
    for i in range(1, rounds + 1):
        w, trans = theta[:-4], theta[-4:].reshape(2, 2)
        p, pair, _ = _forward_backward(x @ w, trans, seq)
        grad = np.concatenate([x.T @ (y - p), (seen - pair).ravel()]) - ridge * theta
        grad /= n
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return Crf(theta[:-4], theta[-4:].reshape(2, 2))


def fit_crf(x: np.ndarray, doc: np.ndarray, size: np.ndarray, quality: np.ndarray, rounds: int = 60) -> Crf:
    """x, doc, size: lines in order; quality: each document's label."""
    n = len(quality)
    blank = Crf(np.zeros(WIDTH), np.zeros((2, 2)))
    if n == 0 or quality.min() == quality.max():
        return Crf(np.zeros(WIDTH), np.zeros((2, 2)), 1.0, 0.0 if n == 0 else (4.0 if quality[0] else -4.0))
    place = np.arange(len(doc)) - np.searchsorted(doc, doc)
    seq = doc * (1 + (place.max() if len(place) else 0) // SEGMENT) + place // SEGMENT
    bad = quality[doc] == 0
    model = _fit(x, seq, bad.astype(int), blank, rounds)
    for _ in range(2):
        p = model.marginals(x, seq)
        most = np.zeros(n)
        np.maximum.at(most, doc, p)
        y = (bad & ((p >= 0.5) | (p >= most[doc]))).astype(int)
        model = _fit(x, seq, y, model, rounds)
    q = model.quality(x, doc, size, n)
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(slope * q + shift)
        g, h = p - quality, p * (1 - p) + 1e-6
        hess = np.array([[(h * q * q).sum() + 1, (h * q).sum()], [(h * q).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, np.array([(g * q).sum() + slope - 1, g.sum()]))
        slope, shift = slope - step[0], shift - step[1]
    model.slope, model.shift = max(float(slope), 0.05), float(shift)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_lines: int = MOST_LINES) -> Crf:
    """Fits on labelled documents, whole ones, within both bounds."""
    chosen = labelled_sample(labels, "quality", sample)

    def make():
        def kernel(cols):
            x, doc, size = line_features(cols["text"])
            cuts = np.searchsorted(doc, np.arange(1, len(cols["text"])))
            return {"doc_id": cols["doc_id"], "quality": cols["quality"], "features": [np.hstack([a, b[:, None]]).astype(np.float32).tobytes() for a, b in zip(np.split(x, cuts), np.split(size, cuts))]}

        return kernel

    got = training_rows(docs, chosen, make, "doc_id long, quality int, features binary", most_lines)
    lines = [np.frombuffer(r.features, np.float32).reshape(-1, WIDTH + 1) for r in got]
    every = np.vstack(lines) if lines else np.zeros((0, WIDTH + 1), np.float32)
    doc = np.repeat(np.arange(len(lines)), [len(x) for x in lines]) if lines else np.empty(0, int)
    return fit_crf(every[:, :-1], doc, every[:, -1].astype(float), np.array([r.quality for r in got], int))


def line_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, line_no (from 0), bad (the line's marginal): the labels of every line."""
    model = train(docs, labels, sample)

    def make():
        def kernel(cols):
            x, doc, _ = line_features(cols["text"])
            ids = np.array(cols["doc_id"], object)
            return {"doc_id": ids[doc].tolist(), "line_no": np.arange(len(doc)) - np.searchsorted(doc, doc), "bad": model.marginals(x, doc)}

        return kernel

    return map_texts(docs.select("doc_id", "text"), make, "doc_id long, line_no long, bad double")


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: better), predicted (score >= KEEP_AT); one row per document."""
    model = train(docs, labels, sample)

    def make():
        def kernel(cols):
            score = model.score(*line_features(cols["text"]), len(cols["text"]))
            return {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "score": score, "predicted": (score >= KEEP_AT).astype(np.int32)}

        return kernel

    return map_texts(docs.select("doc_id", "text", held_out().alias("held_out")), make, "doc_id long, held_out boolean, score double, predicted int")
