"""Jaccard join, substring dedup and embeddings against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stavelake.llm import components, embeddings, jaccard, substrings

from .conftest import make_docs, sentence


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def brute(rows, k, num, den):
    sets = []
    for _, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    root = roots(len(rows), links)
    least = defaultdict(lambda: None)
    for r, (i, _, _) in zip(root, rows):
        if i is not None:
            least[r] = i if least[r] is None else min(least[r], i)
    return Counter((i, len(s), least[r]) for (i, _, _), s, r in zip(rows, sets, root))


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100)])
def test_join_matches_brute_force(spark, rows, k, num, den):
    rng = random.Random(k)
    words = rows[80][1].split()
    near = []
    for i in range(60):  # a family whose members differ in several places, so links are not transitive
        w = list(words)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(50)}"
        near.append((300 + i, " ".join(w).upper() if i % 2 else " ".join(w), "f"))
    every = rows + near
    out = jaccard.near_duplicates(make_docs(spark, every), k, num, den)
    assert Counter(map(tuple, out.collect())) == brute(every, k, num, den)


def test_join_keeps_one_of_each_group(docs, rows, no_docs):
    kept = [r.doc_id for r in jaccard.first_of_groups(docs).collect()]
    want = {i for (i, _, c) in brute(rows, 5, 80, 100) if i is None or i == c}
    assert set(kept) == want and len(kept) == len(want)
    assert jaccard.near_duplicates(no_docs, 3, 90, 100).count() == 0


def test_copies_are_dealt_to_all_parts(spark, monkeypatch):
    rows = [(i, "one and the same text", "s") for i in range(9000)] + [(None, None, "s")] * 9000
    df = make_docs(spark, rows).repartition(8)
    made, plain = [], type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, f, schema: made.append(plain(self, f, schema)) or made[-1])
    heads, _ = jaccard.held_by_others(df, 3)
    per_part = [r.n for r in made[0].filter("kind = 0").groupBy("part").agg(F.sum(F.length("b") / 4).cast("long").alias("n")).collect()]
    assert sum(per_part) == heads.count() == len(rows) and max(per_part) < len(rows) / 4
    assert heads.filter("doc_id IS NULL AND n = 0").count() == 9000


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    got = {(r.node, r.root) for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 160)}


def test_cuts_do_not_move_with_insertions():
    rng = random.Random(2)
    text = " ".join(f"wörd{rng.randrange(999)}" for _ in range(400))
    pieces = lambda t: [d for d in substrings.chunk_digests(t)[2]]
    moved = pieces("An insertion, " + text[:900] + " and another one " + text[900:])
    assert len(set(pieces(text)) - set(moved)) <= 8 < len(pieces(text)) / 4
    raw, ends, _ = substrings.chunk_digests(text)
    assert ends[-1] == len(raw) and all(raw[a:b].decode() for a, b in zip([0, *ends], ends))


def test_chunks_cover_odd_texts():
    for t in (None, "", "a", "é" * 5000, "x" * 10_000, " \n" * 900):
        raw, ends, digests = substrings.chunk_digests(t)
        assert len(digests) == len(ends) and (not len(raw) or ends[-1] == len(raw))
        assert all(b - a <= substrings.LONGEST for a, b in zip([0, *ends], ends))


def test_passages_stay_once(docs, rows, no_docs):
    out = substrings.dedup_substrings(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    got = defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert got[140][0].text is None and got[141][0].text == ""
    assert got[60][0].text == dict((i, t) for i, t, _ in rows)[60]
    assert all(got[i][0].text == "" for i in range(61, 100))
    long = dict((i, t) for i, t, _ in rows)[130].split()[30:90]
    text = " ".join(got[130][0].text.split())
    assert " ".join(long) in text  # the first keeps it
    for i in range(131, 135):
        left = got[i][0].text.split()
        assert max((n for n in range(61) if any(left[a : a + n] == long[b : b + n] for a in range(len(left) - n + 1) for b in range(61 - n))), default=0) < 30
    for i in range(5, 60):  # nothing is shared, nothing goes
        assert got[i][0].text == dict((j, t) for j, t, _ in rows)[i]
    assert substrings.dedup_substrings(no_docs).count() == 0


def test_passages_of_rows_with_one_id(spark):
    rng = random.Random(7)
    fresh = lambda n: sentence(rng, n, 9000)
    shared, inner, none = fresh(60), fresh(60), fresh(60)
    first, other = f"{fresh(50)} {shared}", fresh(140)
    rows = [(1, first, "s"), (2, f"{shared} {fresh(30)}", "s"), (2, other, "s"),  # only one text of id 2 repeats id 1
            (3, f"{fresh(30)} {inner}", "s"), (3, f"{fresh(40)} {inner}", "s"),
            (None, f"{fresh(30)} {none}", "s"), (None, f"{fresh(40)} {none}", "s"),
            *[(None, first, "copy")] * 3, *[(4, other[:400], "s")] * 2]
    out = substrings.dedup_substrings(make_docs(spark, rows)).collect()
    texts = [(r.doc_id, r.text) for r in out]
    assert len(out) == len(rows)

    def holders(passage):
        middle = " ".join(passage.split()[20:40])
        return sorted((i is not None, i or 0) for i, t in texts if middle in t)

    assert (2, other) in texts  # nothing of it stands earlier
    assert holders(shared) == [(False, 0)] and holders(inner) == [(True, 3)] and holders(none) == [(False, 0)]
    assert holders(first) == [(False, 0)] and sum(t == "" for i, t in texts if i is None) == 2
    assert sum(len(t) for i, t in texts if i == 4) < 150  # id 2 holds all of it but the cut chunk


def vectors():
    rng = np.random.default_rng(4)
    rows = []
    for i in range(500):
        label = int(i % 3)
        v = rng.normal(size=24)
        if i % 5 == 0 and i > 60:
            v = np.array(rows[int(rng.integers(0, 60))][1]) + rng.normal(size=24) * float(rng.choice([0.02, 0.1, 0.2]))
        rows.append((i, [float(x) for x in v], label))
    rows += [(600 + i, rows[7][1], 1) for i in range(30)]
    rows += [(700, None, 1), (701, [], 1), (702, [0.0] * 24, 1), (703, [float("nan")] * 24, 1), (704, [None] * 24, 1),
             (705, rows[7][1], None), (706, [2.0] * 5, 1), (707, [1.0] * 5, 1), (None, rows[7][1], 1), (7, rows[7][1], 1)]
    return rows


@pytest.mark.parametrize("shard_rows, asked_by", [(4096, 16), (60, 1)])
def test_embeddings_match_brute_force(spark, shard_rows, asked_by):
    rows = vectors()
    df = spark.createDataFrame([(i, v, y, "e") for i, v, y in rows], "vec_id long, embedding array<double>, label int, n string")
    out = embeddings.near_vectors(df, 0.98, shard_rows, asked_by).collect()

    def usable(v, y):
        return y is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    ok = [usable(v, y) for _, v, y in rows]
    unit = [np.array(v) / np.linalg.norm(v) if o else None for (_, v, _), o in zip(rows, ok)]
    links = [(a, b) for a in range(len(rows)) for b in range(a)
             if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    n = Counter(x for pair in links for x in pair)
    root, least = roots(len(rows), links), {}
    for r, (i, _, _) in zip(root, rows):
        least[r] = i if least.get(r) is None else min(least[r], i if i is not None else least[r])
    want = Counter((i, n[k], least[root[k]]) for k, (i, _, _) in enumerate(rows))
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in out)
    found = sum(r.n_links for r in out)
    assert found >= 0.99 * sum(n.values()) and len(out) == len(rows)
    assert sum((got - want).values()) <= 0.02 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out if r.vec_id is not None)


def test_graph_recall():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:200] + rng.normal(size=(200, 32)).astype(np.float32) * 0.05
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    who, what = embeddings.audited_search(x, q, 0.9)
    truth = {(a, b) for a, b in zip(*np.nonzero(q @ x.T >= 0.9))}
    assert len(truth & set(zip(who, what))) >= 0.97 * len(truth)


def test_self_hits_do_not_pass_the_audit(monkeypatch):
    class Lazy(embeddings.Graph):
        """Narrow searches of one query in six find only the query itself."""

        def __init__(self, x):
            self.built = False
            super().__init__(x)
            self.built = True

        def _walk(self, l, q, start, beam, limit):
            ids, sim = super()._walk(l, q, start, beam, limit)
            if self.built and l == 0 and beam < 64:
                lost = (np.abs(q[:, 0]) * 1e5).astype(int) % 6 == 0
                ids[lost, 1:], sim[lost, 1:] = -1, -2
            return ids, sim

    monkeypatch.setattr(embeddings, "Graph", Lazy)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 32)).astype(np.float32)
    x[1480:] = x[:20] + rng.normal(size=(20, 32)).astype(np.float32) * 0.1
    x = x[rng.permutation(1500)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.98
    np.fill_diagonal(near, False)
    truth = set(zip(*np.nonzero(near)))
    assert len(truth) == 40 and truth <= set(zip(*embeddings.audited_search(x, x, 0.98, own=np.arange(1500))))


@pytest.mark.parametrize("same", [True, False])
def test_stars_span_the_links(same):
    rng = np.random.default_rng(4)
    linked = rng.random((40, 40 if same else 25)) < 0.03
    if same:
        linked |= linked.T
        np.fill_diagonal(linked, False)
    base = 0 if same else 40
    at, node, is_vector = embeddings.stars(linked, same)
    star = [(int(a), int(n) + base * bool(v)) for a, n, v in zip(at, node, is_vector)]
    size = base + linked.shape[1]
    links = [(int(a), int(b) + base) for a, b in zip(*np.nonzero(linked))]
    want, got = roots(size, links), roots(size, star)
    assert len(star) == size - len(set(want))
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_vectors(df).count() == 0


def test_rows_not_ids_are_kept(spark):
    rng = random.Random(8)
    a, b = sentence(rng, 200, 5000), sentence(rng, 200, 5000)
    near = a.rsplit(" ", 1)[0] + " other"
    rows = [(1, a, "s"), (3, b, "s"), (3, near, "s"), (None, "copies without an id stand here", "s"), (None, "copies without an id stand here", "s"), (9, None, "s"), (9, None, "s")]
    named = make_docs(spark, rows).withColumns({"_gone": F.lit(1), "_again": F.lit(2), "_row_0": F.lit(3)})
    kept = jaccard.first_of_groups(named)
    assert kept.columns == named.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(1, a), (3, b), (None, "copies without an id stand here"), (9, None), (9, None)], key=str)
