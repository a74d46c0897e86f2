"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Every word enters as an embedding of the word, if it is in the learnt vocabulary, beside the mean
embedding of its character pairs. Texts are scored in overlapping windows of words; a text's score
is that of its worst window.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from sys import intern

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod
from .labelled import sample

LENGTH, STRIDE = 40, 20
WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 10, 8, 8, 8
PAIRS = 1024
_EDGES = ".,;:!?\"'()[]{}*#$%&<>|-_"


def normal_words(text: str | None) -> list[str]:
    """Lower-cased words of the whole text; a null text has none."""
    return (text or "").lower().split()


def window_starts(n: int) -> range:
    """Starts of the overlapping windows that cover ``n`` words; one window even for no words."""
    return range(0, max(1, n - LENGTH + STRIDE), STRIDE)


class Words:
    """Word ids and character-pair codes of distinct words."""

    def __init__(self, vocab: dict[str, int]):
        self.vocab = vocab

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vocabulary ids (0: unknown), the pair codes of all words on end, and where each word's begin."""
        bare = [w.strip(_EDGES) or w for w in words]
        ids = np.fromiter((self.vocab.get(w, 0) for w in bare), np.int64, len(bare))
        raw = [b"\x02" + w.encode("utf-8", "replace") + b"\x03" for w in bare]
        flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        pairs = np.empty(len(flat), np.int64)
        pairs[:-1] = (flat[:-1] * 259 + flat[1:] * 31) % PAIRS
        ends = np.cumsum([len(r) for r in raw])
        keep = np.ones(len(flat), bool)
        keep[ends - 1] = False  # a pair does not span two words
        starts = np.concatenate([[0], ends[:-1]]) - np.arange(len(raw))
        return ids, pairs[keep], starts


class Network:
    """Parameters and passes; index 0 of the word table is the unknown word, the last word id is padding."""

    def __init__(self, n_words: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, s=0.3: rng.normal(0, s, shape).astype(np.float32)
        self.p = {
            "Ew": draw(n_words, WORD_DIM, s=0.1), "Ec": draw(PAIRS, CHAR_DIM, s=0.2),
            "Wa": draw(2 * HIDDEN, ATTEND), "ba": np.zeros(ATTEND, np.float32), "va": draw(ATTEND),
            "wo": draw(2 * HIDDEN), "bo": np.full(1, -1.0, np.float32),
        }
        for d in "fb":
            self.p |= {f"W{d}": draw(WORD_DIM + CHAR_DIM, 3 * HIDDEN), f"U{d}": draw(HIDDEN, 3 * HIDDEN),
                       f"b{d}": np.zeros(3 * HIDDEN, np.float32)}

    def inputs(self, ids: np.ndarray, pairs: np.ndarray, starts: np.ndarray) -> np.ndarray:
        p = self.p
        n = np.diff(np.append(starts, len(pairs)))[:, None].astype(np.float32)
        return np.concatenate([p["Ew"][ids], np.add.reduceat(p["Ec"][pairs], starts, axis=0) / n], axis=1)

    def _steps(self, gates: np.ndarray, at: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States (step, window, hidden) of one direction; a masked step leaves the state as it is."""
        u, k = self.p[f"U{d}"], HIDDEN
        h = np.zeros((len(at), k), np.float32)
        out = np.empty((at.shape[1], len(at), k), np.float32)
        for t in range(at.shape[1]) if d == "f" else range(at.shape[1] - 1, -1, -1):
            g, hu = gates[at[:, t]], h @ u
            zr = np.tanh((g[:, : 2 * k] + hu[:, : 2 * k]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
            z, r = zr[:, :k] * mask[:, t, None], zr[:, k:]
            c = np.tanh(g[:, 2 * k :] + r * hu[:, 2 * k :])
            if keep is not None:
                keep.append((t, h, z, r, c, hu[:, 2 * k :], zr[:, :k]))
            h = h + z * (c - h)
            out[t] = h
        return out

    def forward(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; ``at`` (window, step) points into the words' inputs ``x``."""
        p, states = self.p, []
        for d in "fb":
            steps = [] if keep is not None else None
            states.append(self._steps(x @ p[f"W{d}"] + p[f"b{d}"], at, mask, d, steps))
            if keep is not None:
                keep[d] = steps
        h = np.concatenate(states, axis=2)  # step, window, both directions
        a = np.tanh(h @ p["Wa"] + p["ba"])
        s = a @ p["va"] + (mask.T - 1) * np.float32(1e4)
        e = np.exp(s - s.max(0))
        w = e / e.sum(0)
        pooled = (w[:, :, None] * h).sum(0)
        if keep is not None:
            keep |= {"h": h, "a": a, "w": w, "pooled": pooled}
        return pooled @ p["wo"] + p["bo"]

    def gradients(self, words: tuple, at: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Mean logistic loss's gradients by back-propagation through time."""
        p, k, kept = self.p, HIDDEN, {}
        ids, pairs, starts = words
        x = self.inputs(ids, pairs, starts)
        logit = self.forward(x, at, mask, kept)
        h, a, w = kept["h"], kept["a"], kept["w"]
        dl = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(np.float32)
        g = {"wo": kept["pooled"].T @ dl, "bo": dl.sum(keepdims=True)}
        dp = dl[:, None] * p["wo"]
        dw = (h * dp).sum(2)
        ds = w * (dw - (w * dw).sum(0))
        da = ds[:, :, None] * p["va"] * (1 - a * a)
        g |= {"va": np.tensordot(ds, a, ([0, 1], [0, 1])), "Wa": np.tensordot(h, da, ([0, 1], [0, 1])), "ba": da.sum((0, 1))}
        dh = w[:, :, None] * dp + da @ p["Wa"].T
        dx = np.zeros_like(x)
        for d, part in (("f", slice(0, k)), ("b", slice(k, 2 * k))):
            u, dgates, du = p[f"U{d}"], np.zeros((len(x), 3 * k), np.float32), np.zeros((k, 3 * k), np.float32)
            carry = np.zeros((len(at), k), np.float32)
            for t, before, z, r, c, huc, z_open in reversed(kept[d]):
                carry = carry + dh[t][:, part]
                dc = carry * z * (1 - c * c)
                dz = carry * (c - before) * mask[:, t, None] * z_open * (1 - z_open)
                dr = dc * huc * r * (1 - r)
                dg = np.concatenate([dz, dr, dc], axis=1)
                du_in = np.concatenate([dz, dr, dc * r], axis=1)
                np.add.at(dgates, at[:, t], dg)
                du += before.T @ du_in
                carry = carry * (1 - z) + du_in @ u.T
            g |= {f"U{d}": du, f"W{d}": x.T @ dgates, f"b{d}": dgates.sum(0)}
            dx += dgates @ p[f"W{d}"].T
        g["Ew"] = np.zeros_like(p["Ew"])
        np.add.at(g["Ew"], ids, dx[:, :WORD_DIM])
        n = np.diff(np.append(starts, len(pairs)))
        g["Ec"] = np.zeros_like(p["Ec"])
        np.add.at(g["Ec"], pairs, np.repeat(dx[:, WORD_DIM:] / n[:, None].astype(np.float32), n, axis=0))
        return g


class Scorer:
    """A trained network with its vocabulary."""

    def __init__(self, net: Network, words: Words):
        self.net, self.words = net, words

    def windows(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of distinct words; positions and mask of all windows; each window's text."""
        sizes = [len(t) for t in texts]
        codes, distinct = pd.factorize(np.array([w for t in texts for w in t] + [" "], dtype=object))
        x = self.net.inputs(*self.words.codes(list(distinct)))
        starts, owner, at = [], [], 0
        for k, n in enumerate(sizes):
            own = window_starts(n)
            starts += [(at + s, min(LENGTH, n - s)) for s in own]
            owner += [k] * len(own)
            at += n
        first, length = np.array(starts).T
        pos = np.minimum(first[:, None] + np.arange(LENGTH), len(codes) - 1)
        mask = np.arange(LENGTH) < np.maximum(length, 1)[:, None]
        at_word = np.where(np.arange(LENGTH) < length[:, None], codes[pos], codes[-1])
        return x, at_word, mask.astype(np.float32), np.array(owner)

    def scores(self, texts: list[list[str]], block: int = 2048) -> np.ndarray:
        """Each text's largest window probability; windows are scored a block at a time."""
        x, at, mask, owner = self.windows(texts)
        logits = np.concatenate([self.net.forward(x, at[k : k + block], mask[k : k + block]) for k in range(0, len(at), block)])
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, owner, logits)
        return 1 / (1 + np.exp(-np.clip(worst, -30, 30)))


def train(windows: list[tuple[int, int, list[str]]], n_vocab: int = 4_000, epochs: int = 5, batch: int = 128, least_steps: int = 200, seed: int = 3) -> Scorer:
    """Fit on (text, label, words) windows of a bounded sample.

    The label belongs to a text, not to a window. A toxic text teaches with the window that
    looks worst: first by the words' log odds, later by the network itself. Other texts teach
    with their worst windows and with some at random.
    """
    rng = np.random.default_rng(seed)
    windows = sorted(windows, key=lambda x: x[0])
    # texts in which a word stands, counted one text at a time; equal words are one object
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    texts: tuple[set, set] = (set(), set())
    for (doc, y), group in groupby(windows, key=lambda x: x[:2]):
        texts[y].add(doc)
        counts[y].update({intern(w.strip(_EDGES) or w) for _, _, ws in group for w in ws})
    n0, n1 = len(texts[0]) + 1.0, len(texts[1]) + 1.0
    odds = {w: float(np.log((counts[1][w] + 0.5) / n1 / ((counts[0][w] + 0.5) / n0)))
            for w in counts[0].keys() | counts[1].keys() if counts[0][w] + counts[1][w] >= 3}
    del counts
    common = sorted(odds, key=lambda w: (-abs(odds[w]), w))[:n_vocab]
    vocab = {w: k + 1 for k, w in enumerate(common)}
    net = Network(len(vocab) + 1, seed)
    for w, k in vocab.items():
        net.p["Ew"][k, 0] = odds[w] / 3
    scorer = Scorer(net, Words(vocab))
    if not texts[0] or not texts[1]:
        net.p["bo"][:] = 3.0 if texts[1] else -3.0
        net.p["wo"][:] = 0
        return scorer

    doc = np.array([i for i, _, _ in windows])
    y = np.array([label for _, label, _ in windows], np.float32)
    words = [ws for _, _, ws in windows]
    worst_by = np.array([max((odds[v] for v in (w.strip(_EDGES) or w for w in ws) if v in vocab), default=0.0) for ws in words])
    codes, distinct = pd.factorize(np.array([w for ws in words for w in ws] + [" "], dtype=object))
    ids, pairs, starts = scorer.words.codes(list(distinct))
    ends = np.cumsum([len(ws) for ws in words])
    at = np.full((len(words), LENGTH), codes[-1])
    mask = np.zeros((len(words), LENGTH), np.float32)
    for k, e in enumerate(ends):
        n = len(words[k])
        at[k, :n], mask[k, : max(1, n)] = codes[e - n : e], 1.0

    def worst(score: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The window of highest score of each text among ``of``."""
        by = of[np.lexsort((-score[of], doc[of]))]
        return by[np.r_[True, doc[by][1:] != doc[by][:-1]]]

    def part(rows: np.ndarray) -> tuple:
        """The words that the rows use, numbered anew."""
        used, now = np.unique(at[rows], return_inverse=True)
        n = np.diff(np.append(starts, len(pairs)))[used]
        index = np.repeat(starts[used] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return (ids[used], pairs[index], np.r_[0, np.cumsum(n)[:-1]]), now.reshape(at[rows].shape)

    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    good, bad = np.flatnonzero(y == 0), np.flatnonzero(y == 1)
    per_epoch = -(-(len(texts[0]) + 3 * len(texts[1])) // batch)
    for epoch in range(max(epochs, -(-least_steps // per_epoch))):
        if epoch >= 2:
            x = net.inputs(ids, pairs, starts)
            worst_by = np.concatenate([net.forward(x, at[k : k + 2048], mask[k : k + 2048]) for k in range(0, len(at), 2048)])
        rows = np.concatenate([worst(worst_by, bad), worst(worst_by, good), rng.choice(good, min(len(good), 2 * len(texts[1])), replace=False)])
        rng.shuffle(rows)
        for k in range(0, len(rows), batch):
            now = rows[k : k + batch]
            own, where = part(now)
            grads = net.gradients(own, where, mask[now], y[now])
            step += 1
            rate = 0.02 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for name, gr in grads.items():
                mean[name] += 0.1 * (gr - mean[name])
                square[name] += 0.001 * (gr * gr - square[name])
                net.p[name] -= (rate * mean[name] / (np.sqrt(square[name]) + 1e-8)).astype(np.float32)
    return scorer


def fit_toxicity(docs: DataFrame, labels: DataFrame, may_learn: F.Column, per_class: int = 1_200, windows_each: int = 60, seed: int = 3) -> Scorer:
    """Train on at most ``per_class`` labelled texts of each class and ``windows_each`` windows of each, spread over the whole text."""
    chosen = sample(labels, "toxic", may_learn, per_class, seed)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t, y in zip(b["doc_id"], b["text"], b["y"]):
                words = normal_words(t if isinstance(t, str) else "")
                starts = window_starts(len(words))
                some = starts if len(starts) <= windows_each else [starts[k * len(starts) // windows_each] for k in range(windows_each)]
                out += [(i, int(y), s, " ".join(words[s : s + LENGTH])) for s in some]
            yield pd.DataFrame(out, columns=["doc_id", "y", "at", "words"])

    found = rows.mapInPandas(cut, "doc_id long, y int, at long, words string").distinct().toPandas()
    found = found.sort_values(["doc_id", "at", "words"], kind="stable")
    return train([(int(i), int(y), [*map(intern, w.split())]) for i, y, w in zip(found["doc_id"], found["y"], found["words"])], seed=seed)


def toxicity_of(scorer: Scorer, words_at_once: int = 200_000):
    """A column function: the score of a whole text, over all its windows."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out, held, n = [], [], 0
            for t in texts:
                held.append(normal_words(t if isinstance(t, str) else ""))
                n += len(held[-1])
                if n >= words_at_once:
                    out.append(scorer.scores(held))
                    held, n = [], 0
            if held:
                out.append(scorer.scores(held))
            yield pd.Series(np.concatenate(out).astype(np.float64) if out else np.zeros(0))

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Learns only from ids outside the held-out fold (crc32 of the id modulo ``folds`` is
    ``held``) with agreeing labels. Scores come from the texts alone; null and empty texts
    are scored as one empty window; repeated rows score alike; with labels of one class, or
    none, all texts get the same score. Other columns are ignored.
    """
    scorer = fit_toxicity(docs, labels, crc_mod(F.col("doc_id"), folds) != held)
    return docs.select("doc_id", toxicity_of(scorer)("text").alias("score")).select(
        "doc_id", (crc_mod(F.col("doc_id"), folds) == held).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
