"""Classifiers on held-out rows, the language model's sums, and the tokenizer's round trip."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from stavelake.llm import bpe, language_model, quality, toxicity

from .conftest import make_docs, sentence


@pytest.fixture(scope="module")
def labelled(spark):
    """Half junk, half insults, independent of each other; some labels are missing or contradict."""
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(400):
        t = sentence(rng, rng.randrange(15, 90), 500)
        good, toxic = rng.random() < 0.6, rng.random() < 0.4
        words = t.split()
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["idiot,", "moron", "Scum"])
        docs.append((i, " ".join(words if good else [w + rng.choice(["$$", "***"]) for w in words]), "s"))
        labels.append((i, int(good), int(toxic), "z"))
    docs += [(900, None, "s"), (901, "", "s"), (5, docs[5][1], "s"), (None, "some text", "s")]
    labels += [(6, 0, 0, "z"), (6, 1, 1, "z"), (7, None, None, "z"), (None, 1, 1, "z"), (9999, 1, 0, "z"), (8, *labels[8][1:])]
    return make_docs(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"), docs, labels


@pytest.mark.parametrize("score,column,folds,held", [
    (quality.score_quality, "quality", 4, 2), (toxicity.score_toxicity, "toxic", 3, 1)])
def test_held_out_accuracy(labelled, score, column, folds, held):
    df, labels, docs, truth = labelled
    out = score(df, labels).collect()
    assert len(out) == len(docs)
    y = {r[0]: r[1 if column == "quality" else 2] for r in truth[:400]}
    right = total = 0
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held)
        if r.held_out and r.doc_id in y and r.doc_id not in (6, 7):
            total += 1
            right += r.predicted == y[r.doc_id]
    assert total > 50 and right / total >= 0.93


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_without_labels_or_documents(spark, docs, no_docs, labelled, score):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = score(docs, none).collect()
    assert len({r.score for r in out}) == 1
    assert score(no_docs, labelled[1]).count() == 0


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    net = toxicity.Network(6)
    words = toxicity.Words({"one": 1, "two": 2, "three": 3}).codes(["one", "two", "three", "other", " "])
    at = rng.integers(0, 5, (4, toxicity.LENGTH))
    mask = (np.arange(toxicity.LENGTH) < np.array([40, 3, 17, 1])[:, None]).astype(np.float32)
    y = np.array([0, 1, 1, 0], np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        z = net.forward(net.inputs(*words), at, mask)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    grads = net.gradients(words, at, mask, y)
    for name, p in net.p.items():
        flat, g = p.reshape(-1), np.asarray(grads[name]).reshape(-1)
        for k in np.argsort(-np.abs(g))[:3]:
            keep = flat[k]
            flat[k] = keep + 1e-3
            up = loss()
            flat[k] = keep - 1e-3
            down = loss()
            flat[k] = keep
            assert abs((up - down) / 2e-3 - g[k]) <= 2e-2 * abs(g[k]) + 2e-4, name


def test_windows_overlap_and_cover():
    for n in (0, 1, 39, 40, 41, 60, 61, 500):
        starts = list(toxicity.window_starts(n))
        assert starts[0] == 0 and starts[-1] + toxicity.LENGTH >= n
        assert all(b - a == toxicity.STRIDE for a, b in zip(starts, starts[1:]))


def test_trees_fit_what_they_see():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 1] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    trees = quality.fit_trees(x, y)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.97
    one = quality.fit_trees(x, np.ones(600))
    assert len(set(one.score(x).round(9))) == 1


def test_language_model_sums(spark, docs, rows, no_docs):
    out = language_model.score_texts(docs).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    c = Counter(w for i, t, _ in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, _ in rows:
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))
        want[(i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(base, 4))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out) == want
    assert all(r.score < 0 for r in out)
    assert language_model.score_texts(no_docs).count() == 0


def test_language_model_is_a_distribution_and_beats_the_base(spark):
    rng = random.Random(3)
    chain = {w: rng.sample(range(60), 4) for w in range(60)}

    def text(n):
        w, out = 0, []
        for _ in range(n):
            w = rng.choice(chain[w])
            out.append(f"t{w}")
        return " ".join(out)

    df = make_docs(spark, [(i, text(80), "s") for i in range(150)])
    out = [r for r in language_model.score_texts(df).collect() if r.held_out]
    assert sum(r.score for r in out) > 0.85 * sum(r.base_score for r in out)


def test_predictive_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    v, u = 50, 4
    cs = rng.integers(0, 9, (u, v))
    ts = np.minimum(cs, rng.integers(1, 4, (u, v)))
    c0 = ts.sum(0)
    t0 = np.minimum(c0, 1)
    t = language_model.Totals(cs.sum(1).astype(float), ts.sum(1).astype(float), float(ts.sum()), float(t0.sum()), v, 0.6, 0.4)
    parent = t.parent(c0, t0)
    assert abs(parent.sum() + t.parent(0, 0) - 1) < 1e-9
    for k in range(u):
        assert abs(t.predict(np.full(v, k), cs[k], ts[k], parent).sum() + t.back_off(k) * t.parent(0, 0) - 1) < 1e-9


def test_table_counts_follow_their_distribution():
    rng = np.random.default_rng(5)
    low = language_model.log_stirling(0.5)
    n, c = 40_000, 5
    got = language_model.sample_tables(np.full(n, c), np.full(n, 3.0), np.full(n, 0.3), 1.0, 0.5, low, rng)
    weight = np.array([np.exp(low[c, t]) * np.prod([(1 + 0.5 * (3 + j)) * 0.3 for j in range(t)]) for t in range(1, c + 1)])
    assert np.abs(np.bincount(got, minlength=c + 1)[1:] / n - weight / weight.sum()).max() < 0.01
    large = language_model.sample_tables(np.full(50, 5000), np.full(50, 3.0), np.full(50, 0.3), 1.0, 0.5, low, rng)
    assert (large >= 1).all() and (large < 5000).all()


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_encoding_equals_the_library(spark, docs, rows, vocabulary, no_docs):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary)
    rng = random.Random(6)
    odd = ["Hello  <|endoftext|>wörld's 'll", "ΟΔΟΣ Σ İstanbul é ﬁ", "日本語 한국어 1234567", "!!!???...", "<|startoftext|><|endoftext|>",
           "x" * 9000, "".join(rng.choice("aeioust") for _ in range(7000)), "a\x0bb\x0cc　d e", "'s't're"]
    every = rows + [(500 + i, t, "o") for i, t in enumerate(odd)]
    out = Counter(map(tuple, bpe.encode_documents(make_docs(spark, every), vocabulary).collect()))
    want = Counter()
    for i, t, _ in every:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert out == want
    assert bpe.encode_documents(no_docs, vocabulary).count() == 0


def test_transducer_memory_and_stability(vocabulary):
    enc = bpe.encoder(vocabulary)
    m = enc.m
    rng = random.Random(7)
    symbols = [rng.choice("thinganere") for _ in range(4000)]
    whole = list(bpe.Transducer(m, m.lookahead()).run(iter(symbols)))
    short = bpe.Transducer(m, 4 * m.width)
    assert list(short.run(iter(symbols))) == whole and "".join(whole) == "".join(symbols)
    assert m.lookahead() >= m.width


def test_bytes_come_back(vocabulary):
    enc = bpe.encoder(vocabulary)
    decoder = bpe.Decoder(enc, joined=False)
    ids = [i for run in enc.encode("naïve café 日本 ok") for i in run]
    text = "".join(map(decoder.feed, ids)) + decoder.close()
    assert text.split() == "naïve café 日本 ok".split()
