"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, materialize
from .labelled import sample

FEATURES = (
    "log_chars", "log_words", "word_length", "word_length_spread", "upper", "digit", "space", "symbol", "stop", "shout",
    "other_mark", "not_ascii", "lines", "line_words", "repeated_lines", "different_words", "top_word", "same_as_previous",
    "repeated_triples", "packed",
)
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>@^~=_\\/+{}[]"])
_STOP = np.isin(np.arange(256), [ord(c) for c in ".,;:"])
_SHOUT = np.isin(np.arange(256), [ord(c) for c in "!?"])
_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _DIGIT[48:58] = True, True
_MARK = np.array([33 <= b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 127 for b in range(256)]) & ~(_SYMBOL | _STOP | _SHOUT)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_PACK = 1 << 20


def statistics(text: str | None) -> list[float]:
    """``FEATURES`` of one whole text; a null text counts as empty, and shares of nothing are 0."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = text.split()
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, w = max(1, len(raw)), max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(words)
    triples = set(zip(words, words[1:], words[2:]))
    packed = zlib.compressobj(1)
    size = sum(len(packed.compress(raw[k : k + _PACK])) for k in range(0, len(raw), _PACK)) + len(packed.flush())
    return [
        np.log1p(len(text)), np.log1p(len(words)), lengths.mean(), lengths.std(),
        hist[_UPPER].sum() / n, hist[_DIGIT].sum() / n, hist[_SPACE].sum() / n, hist[_SYMBOL].sum() / n, hist[_STOP].sum() / n,
        hist[_SHOUT].sum() / n, hist[_MARK].sum() / n, hist[128:].sum() / n,
        np.log1p(len(lines)), len(words) / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
        len(counts) / w, max(counts.values(), default=0) / w, sum(a == b for a, b in zip(words, words[1:])) / w,
        1 - len(triples) / max(1, len(words) - 2) if len(words) > 2 else 0.0, size / n,
    ]


class Trees:
    """Boosted trees of one depth as arrays: node k has children 2k+1 and 2k+2."""

    def __init__(self, base: float, depth: int, feature: np.ndarray, cut: np.ndarray, value: np.ndarray):
        self.base, self.depth, self.feature, self.cut, self.value = base, depth, feature, cut, value

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1; all rows go down all trees one level at a time."""
        trees, rows = np.arange(len(self.feature)), np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(trees)), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
        z = self.base + self.value[trees, node - (2**self.depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64,
              l2: float = 1.0, least: int = 8) -> Trees:
    """Second-order boosting of the logistic loss on per-feature histograms.

    With one class, or no rows, every score is that class's smoothed share (a half without rows).
    """
    n, n_feat = x.shape
    share = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    feature, cut, value = np.zeros((n_trees, inner), np.int64), np.full((n_trees, inner), np.inf), np.zeros((n_trees, leaves))
    if n == 0 or y.min() == y.max():
        return Trees(base, depth, feature, cut, value)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(n_feat)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    slot = binned + np.arange(n_feat) * bins
    z = np.full(n, base)
    for t in range(n_trees):
        p = 1 / (1 + np.exp(-z))
        grad, hess = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            width = 2**level
            key = (at[:, None] * (n_feat * bins) + slot).ravel()
            shape = (width, n_feat, bins)
            g, h, c = (np.bincount(key, np.repeat(v, n_feat), width * n_feat * bins).reshape(shape).cumsum(2) for v in (grad, hess, np.ones(n)))
            all_g, all_h, all_c = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + l2) + (all_g - g) ** 2 / (all_h - h + l2) - all_g**2 / (all_h + l2)
            gain[(c < least) | (all_c - c < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            f, b = best // bins, best % bins
            split = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            for k in np.flatnonzero(split):
                feature[t, width - 1 + k] = f[k]
                cut[t, width - 1 + k] = edges[f[k]][b[k]]
            right = split[at] & (binned[np.arange(n), f[at]] > b[at])
            at = 2 * at + right
        g, h = np.bincount(at, grad, leaves), np.bincount(at, hess, leaves)
        value[t] = -rate * g / (h + l2)
        z += value[t][at]
    return Trees(base, depth, feature, cut, value)


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = 4_000, folds: int = 4, held: int = 2, seed: int = 5) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Statistics of every whole text are computed once; the trees are fitted on at most
    ``per_class`` labelled documents of each class outside the held-out fold (crc32 of the id
    modulo ``folds`` is ``held``), never on id, source or language. Ids with contradicting or
    null labels teach nothing; an id that stands for several rows teaches with its first by
    text statistics. Null and empty texts score as a text of no words; repeated rows score
    alike; without usable labels every score is a half. Other columns are ignored.
    """
    schema = "doc_id long, x array<double>"

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "x": [statistics(t if isinstance(t, str) else "") for t in b["text"]]})

    stats = materialize(docs.select("doc_id", "text").mapInPandas(measure, schema), "quality-stats")
    chosen = sample(labels, "quality", crc_mod(F.col("doc_id"), folds) != held, per_class, seed)
    rows = stats.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.min("y").alias("y")).orderBy("doc_id").collect()
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES))
    trees = fit_trees(x, np.array([r["y"] for r in rows], float))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = trees.score(np.stack(b["x"].to_numpy())) if len(b) else np.zeros(0)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": s, "predicted": (s >= 0.7).astype(np.int32)})

    out = stats.mapInPandas(score, "doc_id long, score double, predicted int")
    return out.select("doc_id", (crc_mod(F.col("doc_id"), folds) == held).alias("held_out"), "score", "predicted")
