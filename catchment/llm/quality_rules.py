"""Quality rules: base rules on counts of a text, then gradient-boosted trees with monotonic constraints.

The trees are grown here on a bounded sample of labelled rows, flattened into numpy node arrays, and
scored level by level over whole chunks of rows. A null text has no words; a text without words fails
the base rules. Rows are scored on their own, so repeated rows get equal results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import SPACE, Chunk, Lines, byte_set, count_in, first_of, labelled_sample, map_texts, paired, repeated_words, sigmoid, training_rows

#: Training rows at most.
SAMPLE = 4000
KEEP_AT = 0.3
MIN_WORDS = 10
MOST_REPEATED_PERCENT = 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the trees, and the direction in which each may move the score (0: free).
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_word_share": -1, "upper_share": -1,
    "digit_share": 0, "exclamation_per_word": -1, "bar_per_word": -1, "distinct_word_share": 0, "words_per_line": 0, "stop_share": 0,
}
_SYMBOL, _UPPER, _DIGIT = byte_set(b"#*$%&|<>"), byte_set(bytes(range(65, 91))), byte_set(b"0123456789")
_LETTER = byte_set(bytes(range(65, 91)) + bytes(range(97, 123)))


def counts(texts: list[str | None]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The exact counts of each text, and its row of FEATURES."""
    c = Chunk(texts)
    c.words()
    lines, n = Lines(c), len(texts)
    solid = ~SPACE[c.data]
    per = lambda mask: count_in(c, mask, c.start, c.end).astype(float)
    words = (c.w_hi - c.w_lo).astype(np.int64)
    out = {
        "n_words": words,
        "word_chars": count_in(c, solid & ((c.data & 0xC0) != 0x80), c.start, c.end),
        "n_symbols": count_in(c, _SYMBOL[c.data], c.start, c.end),
        "n_dup_lines": np.bincount(lines.doc[lines.repeated], minlength=n),
        "n_repeat_words": np.bincount(c.w_doc[repeated_words(c)], minlength=n),
    }
    some, letters = np.maximum(words, 1), np.maximum(per(_LETTER[c.data]), 1)
    order, fresh = first_of(paired(c.w_hash, c.w_doc))
    distinct = np.bincount(c.w_doc[order[fresh]], minlength=n)
    full = np.maximum(np.bincount(lines.doc[lines.words > 0], minlength=n), 1)
    ends = np.bincount(c.w_doc[np.isin(c.data[np.maximum(c.w_end - 1, 0)], np.frombuffer(b".!?", np.uint8))], minlength=n)
    x = np.column_stack([
        np.log1p(words), out["word_chars"] / some, out["n_symbols"] / some, out["n_dup_lines"] / full, out["n_repeat_words"] / some,
        per(_UPPER[c.data]) / letters, per(_DIGIT[c.data]) / some, per(c.data == 33) / some, per(c.data == 124) / some,
        distinct / some, words / full, ends / some,
    ])
    return out, x


@dataclass
class Forest:
    """Node arrays of all trees: children of node i are left[i] and left[i] + 1; a leaf points to itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    root: np.ndarray
    depth: int
    bias: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.root:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                down = self.left[node]
                node = np.where(down < 0, node, down + (x[rows, self.feature[node]] > self.cut[node]))
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x))


def _best(hist_g, hist_h, total_g, total_h, signs, low, high, ridge):
    """(gain, feature, bin) of the best split whose leaf values keep their order on constrained features."""
    gl, hl = np.cumsum(hist_g, 1)[:, :-1], np.cumsum(hist_h, 1)[:, :-1]
    gr, hr = total_g - gl, total_h - hl
    vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
    gain = -(gl * vl + 0.5 * (hl + ridge) * vl**2) - (gr * vr + 0.5 * (hr + ridge) * vr**2)
    v = np.clip(-total_g / (total_h + ridge), low, high)
    gain += total_g * v + 0.5 * (total_h + ridge) * v**2
    bad = (hl < 1) | (hr < 1) | (signs[:, None] * (vr - vl) < 0)
    gain = np.where(bad, -np.inf, gain)
    at = int(np.argmax(gain))
    f, b = divmod(at, gain.shape[1])
    return gain[f, b], f, b, vl[f, b], vr[f, b]


def fit_forest(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 2.0) -> Forest:
    """Newton boosting on logistic loss over quantile histograms; bounds pass to children so that constraints hold over whole trees."""
    n, k = x.shape
    feature, cut, left, value, roots = [], [], [], [], []
    if n == 0 or y.min() == y.max():
        bias = 0.0 if n == 0 else (4.0 if y[0] else -4.0)
        zero = np.zeros(0)
        return Forest(zero.astype(int), zero, zero.astype(int), zero, zero.astype(int), 0, bias)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(k)]
    code = np.column_stack([np.searchsorted(edges[f], x[:, f]) for f in range(k)])
    bias = float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(n, bias)
    for _ in range(trees):
        p = sigmoid(raw)
        g, h = p - y, p * (1 - p) + 1e-6

        def new(v):
            for a, b in ((feature, 0), (cut, 0.0), (left, -1), (value, v)):
                a.append(b)
            return len(value) - 1

        root = new(0.0)
        roots.append(root)
        todo = [(root, np.arange(n), -np.inf, np.inf, 0)]
        while todo:
            node, rows, low, high, level = todo.pop()
            tg, th = g[rows].sum(), h[rows].sum()
            v = float(np.clip(-tg / (th + ridge), low, high))
            value[node] = rate * v
            if level < depth and len(rows) > 10:
                hg = np.stack([np.bincount(code[rows, f], g[rows], bins) for f in range(k)])
                hh = np.stack([np.bincount(code[rows, f], h[rows], bins) for f in range(k)])
                gain, f, b, vl, vr = _best(hg, hh, tg, th, signs, low, high, ridge)
                if gain > 1e-3 and b < len(edges[f]):
                    mid = (vl + vr) / 2
                    lo_l, hi_l, lo_r, hi_r = low, high, low, high
                    if signs[f] > 0:
                        hi_l, lo_r = min(high, mid), max(low, mid)
                    elif signs[f] < 0:
                        lo_l, hi_r = max(low, mid), min(high, mid)
                    a = new(0.0)
                    new(0.0)
                    feature[node], cut[node], left[node] = f, float(edges[f][b]), a
                    right = code[rows, f] > b
                    todo += [(a, rows[~right], lo_l, hi_l, level + 1), (a + 1, rows[right], lo_r, hi_r, level + 1)]
                    continue
            raw[rows] += value[node]
    return Forest(np.array(feature), np.array(cut), np.array(left), np.array(value), np.array(roots), depth, bias)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    chosen = labelled_sample(labels, "quality", sample)

    def make():
        def kernel(cols):
            _, x = counts(cols["text"])
            return {"doc_id": cols["doc_id"], "quality": cols["quality"], "features": [row.tobytes() for row in x]}

        return kernel

    got = training_rows(docs, chosen, make, "doc_id long, quality int, features binary")
    x = np.array([np.frombuffer(r.features) for r in got]).reshape(len(got), len(FEATURES))
    return fit_forest(x, np.array([r.quality for r in got], float), np.array(list(FEATURES.values())))


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the trees' score; one row per document."""
    forest = train(docs, labels, sample)

    def make():
        def kernel(cols):
            out, x = counts(cols["text"])
            failed = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED_PERCENT * out["n_words"])
            score = forest.score(x)
            return {"doc_id": cols["doc_id"], **out, "base_failed": failed, "score": score, "kept": ~failed & (score >= KEEP_AT)}

        return kernel

    return map_texts(docs.select("doc_id", "text"), make, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, score double")
