"""Embedding near-dedup: small-world graphs per shard, audited searches, exact cosines, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, materialize
from .components import components


class Graph:
    """A hierarchical navigable small-world graph over unit vectors.

    Vectors are inserted in batches: each batch searches the graph so far and its own
    members, links both ways, and lists that grow beyond the degree are pruned to their
    most diverse neighbours. Level l holds about every ``degree``-th vector of the level below.
    """

    def __init__(self, x: np.ndarray, degree: int = 16, beam: int = 48, seed: int = 0):
        self.x, self.degree = x, degree
        n = len(x)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(rng.random(n)) / np.log(degree)).astype(int), 4) if n else np.zeros(0, int)
        self.order = np.argsort(-level, kind="stable")  # high levels first, so that entry points exist
        level = level[self.order]
        self.levels = [int((level >= l).sum()) for l in range(int(level.max()) + 1)] if n else []
        self.v = np.ascontiguousarray(x[self.order])
        # a list is pruned to two thirds when it is full, so most links are only written down
        self.near = [np.full((m, 3 * (degree if l == 0 else degree // 2)), -1, np.int32) for l, m in enumerate(self.levels)]
        for l in range(len(self.levels)):
            self._build(l, beam)

    def _build(self, l: int, beam: int) -> None:
        m, near = self.levels[l], self.near[l]
        done = min(m, 64)
        self._link(near, np.arange(done), self.v[:done] @ self.v[:done].T, np.arange(done))
        while done < m:
            batch = np.arange(done, min(m, 2 * done, done + 512))
            ids, _ = self._walk(l, self.v[batch], self._enter(self.v[batch], l), beam, done)
            own = self.v[batch] @ self.v[batch].T
            cand = np.concatenate([ids, np.broadcast_to(batch, (len(batch), len(batch)))], 1)
            sim = np.einsum("qd,qkd->qk", self.v[batch], self.v[ids])
            sim[ids < 0] = -2
            self._link(near, batch, np.concatenate([sim, own], 1), cand)
            done = batch[-1] + 1

    def _link(self, near: np.ndarray, rows: np.ndarray, sim: np.ndarray, cand: np.ndarray) -> None:
        """Give rows their best candidates, and the candidates links back."""
        if cand.ndim == 1:
            cand = np.broadcast_to(cand, sim.shape)
        sim = np.where(cand == rows[:, None], -2, sim)
        k = min(near.shape[1] // 3, sim.shape[1])
        few = min(3 * k, sim.shape[1])
        best = np.argpartition(-sim, few - 1, axis=1)[:, :few]
        for r, c, s in zip(rows, np.take_along_axis(cand, best, 1), np.take_along_axis(sim, best, 1)):
            ok = self._diverse(r, c[s > -2], k)
            near[r, : len(ok)] = ok
            for o in ok:
                row = near[o]
                if r in row:
                    continue
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = r
                else:
                    best_of = self._diverse(o, np.append(row, r), 2 * near.shape[1] // 3)
                    near[o] = -1
                    near[o, : len(best_of)] = best_of

    def _diverse(self, o: int, cand: np.ndarray, width: int) -> np.ndarray:
        """Prefer neighbours that are nearer to ``o`` than to a neighbour already taken; fill up with the nearest."""
        s = self.v[cand] @ self.v[o]
        cand = cand[np.argsort(-s, kind="stable")]
        s = np.sort(s)[::-1]
        among = self.v[cand] @ self.v[cand].T
        own, beside = s.tolist(), np.full(len(cand), -2.0, np.float32)  # nearest neighbour already taken
        taken = np.zeros(len(cand), bool)
        for k in range(len(cand)):
            if beside[k] < own[k]:
                taken[k] = True
                np.maximum(beside, among[k], out=beside)
        return cand[np.argsort(~taken, kind="stable")[:width]]

    def _enter(self, q: np.ndarray, above: int) -> np.ndarray:
        """The nearest node found on the levels above, for each query."""
        at = np.zeros(len(q), np.int32)
        for l in range(len(self.levels) - 1, above, -1):
            at = self._walk(l, q, at, 4, self.levels[l])[0][:, 0]
        return at

    def _walk(self, l: int, q: np.ndarray, start: np.ndarray, beam: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search for all queries in step; (ids, similarities), best first, -1 where there are fewer."""
        v, near, n = self.v, self.near[l], len(q)
        ids = np.full((n, beam), -1, np.int32)
        sim = np.full((n, beam), -2.0, np.float32)
        open_ = np.zeros((n, beam), bool)
        ids[:, 0], sim[:, 0], open_[:, 0] = start, np.einsum("qd,qd->q", q, v[start]), True
        seen = np.zeros((n, limit), bool)
        seen[np.arange(n), start] = True
        live = np.arange(n)
        while len(live):
            # expand the best open nodes of each query that still has some; lists come best first, so open ones keep that order
            pick = np.argsort(~open_[live], axis=1, kind="stable")[:, : max(4, beam // 8)]
            is_open = np.take_along_axis(open_[live], pick, 1)
            live, pick, is_open = live[is_open.any(1)], pick[is_open.any(1)], is_open[is_open.any(1)]
            if not len(live):
                break
            open_[live[:, None], pick] = False
            nxt = np.where(is_open[:, :, None], near[np.maximum(ids[live[:, None], pick], 0)], -1).reshape(len(live), -1)
            nxt = np.sort(np.where(nxt < limit, nxt, -1), axis=1)
            nxt[:, 1:][nxt[:, 1:] == nxt[:, :-1]] = -1
            fresh = (nxt >= 0) & ~seen[live[:, None], np.maximum(nxt, 0)]
            rows, cols = np.nonzero(fresh)
            seen[live[rows], nxt[rows, cols]] = True
            s = np.full(nxt.shape, -2.0, np.float32)
            s[rows, cols] = np.einsum("kd,kd->k", q[live[rows]], v[nxt[rows, cols]])
            all_s = np.concatenate([sim[live], s], 1)
            all_i = np.concatenate([ids[live], np.where(fresh, nxt, -1)], 1)
            all_o = np.concatenate([open_[live], fresh], 1)
            top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(all_s, top, 1), axis=1), 1)
            sim[live], ids[live], open_[live] = (np.take_along_axis(a, top, 1) for a in (all_s, all_i, all_o))
        return ids, sim

    def within(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) of pairs of similarity ``least`` or more; a full beam is doubled until it holds others too."""
        todo, out = np.arange(len(q)), []
        while len(todo) and self.levels:
            full = beam >= len(self.v)
            again = []
            for k in range(0, len(todo), 256):
                part = todo[k : k + 256]
                if full:
                    s = q[part] @ self.v.T
                    r, c = np.nonzero(s >= least)
                    out.append((part[r], self.order[c]))
                    continue
                ids, sim = self._walk(0, q[part], self._enter(q[part], 0), beam, len(self.v))
                hit = (sim >= least) & (ids >= 0)
                more = hit[:, -1]
                r, c = np.nonzero(hit & ~more[:, None])
                out.append((part[r], self.order[ids[r, c]]))
                again.append(part[more])
            todo = np.concatenate(again) if again else np.zeros(0, int)
            beam *= 2
        if not out:
            return np.zeros(0, int), np.zeros(0, int)
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def passing_beam(graph: Graph, index: np.ndarray, queries: np.ndarray, least: float, own: np.ndarray | None = None,
                 audit: int = 256, beam: int = 16, recall: float = 0.99) -> int:
    """The first doubling of ``beam`` that passes the audit; the size of the index (brute force) passes always.

    Audit queries are spread over all and answered by brute force as well. The search must find
    ``recall`` of their pairs within ``least``, and as much of their eight nearest vectors, as
    these are harder to find and there are always some. ``own`` is each query's place in the
    index, -1 where it has none: what a query finds of itself counts nowhere in the audit.
    """
    at = np.unique(np.linspace(0, len(queries) - 1, min(audit, len(queries))).astype(int))
    some = queries[at]
    mine = np.full(len(at), -1) if own is None else own[at]
    similar = some @ index.T
    similar[np.flatnonzero(mine >= 0), mine[mine >= 0]] = -2
    truth = int((similar >= least).sum())
    k = min(8, len(index))
    kth = np.sort(similar, axis=1)[:, -k]
    while beam < len(index):
        ids, sim = graph._walk(0, some, graph._enter(some, 0), beam, len(index))
        other = (ids >= 0) & (graph.order[ids] != mine[:, None])
        near = np.minimum(k, (other & (sim >= kth[:, None] - 1e-6)).sum(1)).sum()
        if near >= recall * k * len(some):
            who, what = graph.within(some, least, beam)
            if (what != mine[who]).sum() >= recall * truth:
                break
        beam *= 2
    return beam


def audited_search(index: np.ndarray, queries: np.ndarray, least: float, own: np.ndarray | None = None) -> tuple:
    """Pairs within ``least`` from a graph of ``index``, at the beam that passes the audit."""
    graph = Graph(index)
    return graph.within(queries, least, passing_beam(graph, index, queries, least, own))


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """Vectors of one length as rows of norm 1, in double precision."""
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def stars(linked: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spanning set of a link matrix (query, vector): (query, node, whether the node is a vector).

    Each component of the matrix is a star around one of its queries. ``same`` says that
    queries and vectors are the same nodes.
    """
    todo, out = linked.any(1), []
    while todo.any():
        start = int(np.argmax(todo))
        rows, cols = np.zeros(len(linked), bool), np.zeros(linked.shape[1], bool)
        new = np.array([start])
        while len(new):
            rows[new] = True
            fresh = np.flatnonzero(linked[new].any(0) & ~cols)
            cols[fresh] = True
            new = fresh[~rows[fresh]] if same else np.flatnonzero(linked[:, fresh].any(1) & ~rows)
        todo &= ~rows
        if not same:
            rows[start] = False
            out.append((start, np.flatnonzero(rows), False))
        else:
            cols[start] = False
        out.append((start, np.flatnonzero(cols), True))
    sizes = [len(n) for _, n, _ in out]
    return (np.repeat(np.array([q for q, _, _ in out], np.int64), sizes), np.concatenate([n for _, n, _ in out] or [np.zeros(0, np.int64)]),
            np.repeat(np.array([v for _, _, v in out], bool), sizes))


def consecutive(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Rows that follow each other with equal ``keys`` as one frame, however the batches cut them."""
    held: list[pd.DataFrame] = []
    name = None
    for b in batches:
        if not len(b):
            continue
        k = b[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1), len(b)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            if held and tuple(k[i]) != name:
                yield name, pd.concat(held, ignore_index=True)
                held = []
            name = tuple(k[i])
            held.append(b.iloc[i:j])
    if held:
        yield name, pd.concat(held, ignore_index=True)


def near_vectors(rows: DataFrame, least: float = 0.98, shard_rows: int = 4_096, asked_by: int = 16) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors of one label are compared by cosine in double precision; the label must not be
    null. Null, empty, zero or non-finite vectors, and those with null components, link with
    nothing; vectors of other length link with none of another. Equal vectors are one class
    with a count. The classes of a label are dealt to shards of about ``shard_rows``. A graph
    is built once for up to ``asked_by`` shards that ask it, which stream past it one after the other, so no
    task holds more than two shards; of each two shards of a label one asks the other. A meeting of shards hands on counts for
    each class and a spanning set of its links, so a dense group never becomes all its pairs. Repeated ids are separate rows with one
    id; a null id is never the smallest. An empty table gives an empty result; other columns are ignored.
    """
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.coalesce(bad, F.lit(True))
    wide = F.transform("embedding", lambda v: v.cast("double") + 0.0)  # -0.0 and 0.0 are equal
    scale = F.array_max(F.transform(wide, F.abs))
    usable = usable & (scale > 0)
    vec = F.when(usable, wide)
    base = materialize(rows.select("vec_id", "label", vec.alias("v")).withColumn(
        "cid", F.when(F.col("v").isNotNull(), F.unhex(F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.array_join(F.col("v").cast("array<string>"), ",")).cast("binary"), 256)))), "vectors")

    classes = base.filter("cid IS NOT NULL").groupBy("cid").agg(
        F.first("label").alias("label"), F.first("v").alias("v"), F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("n"))
    classes = classes.withColumn("dim", F.size("v"))
    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("of"))
    classes = classes.join(sizes, ["label", "dim"]).withColumn("shards", F.ceil(F.col("of") / shard_rows).cast("int"))
    classes = materialize(classes.withColumn("shard", F.pmod(F.xxhash64("cid"), F.col("shards")).cast("int")), "vector-classes")

    # shard i is asked by itself and the half of the ring before it, so each two shards meet once and all are
    # asked about equally often; `turn` 0 is the shard itself, and comes again as the graph to build (-1)
    half = F.floor(F.col("shards") / 2)
    last = F.when((F.col("shards") % 2 == 0) & (F.col("shard") >= half), half - 1).otherwise(half).cast("int")
    asks = classes.withColumn("turn", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), last))))
    asks = asks.select("label", "dim", F.pmod(F.col("shard") + F.col("turn"), F.col("shards")).cast("int").alias("shard"),
                       (F.col("turn") / asked_by).cast("int").alias("part"), "turn", "cid", "v", "n")
    parts = F.explode(F.sequence(F.lit(0), (half / asked_by).cast("int")))
    index = classes.select("label", "dim", "shard", parts.alias("part"), F.lit(-1).alias("turn"), "cid", "v", "n")
    travel = sizes.agg(F.sum(F.col("of") * (2 + F.col("of") / (2 * shard_rows)))).first()[0] or 0
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, blocks(int(travel), 2 * shard_rows))
    key = ["label", "dim", "shard", "part"]
    meetings = index.unionByName(asks).repartition(tasks, *key).sortWithinPartitions(*key, "turn", "cid").select(*key, "turn", "cid", "v", "n")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, beam = None, 16
        for (*_, turn), right in consecutive(batches, [*key, "turn"]):
            q = unit_rows(right["v"])
            if turn < 0:
                x, names, many = q, right["cid"].to_numpy(), right["n"].to_numpy(np.int64)
                x32 = x.astype(np.float32)
                graph, beam = Graph(x32), 16
                continue
            q32, asking, same = q.astype(np.float32), right["cid"].to_numpy(), turn == 0
            beam = passing_beam(graph, x32, q32, least - 1e-4, np.arange(len(q)) if same else None, beam=beam)
            who, what = graph.within(q32, least - 1e-4, beam)
            linked = np.zeros((len(q), len(x)), bool)
            for k in range(0, len(who), 1 << 15):
                a, b = who[k : k + (1 << 15)], what[k : k + (1 << 15)]
                linked[a, b] = np.einsum("kd,kd->k", q[a], x[b]) >= least
            if same:
                linked |= linked.T
                np.fill_diagonal(linked, False)
            seen_q, seen_x = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0) & (not same))
            # sums of whole numbers, exact in double precision
            others = np.concatenate([linked[seen_q] @ many.astype(float), right["n"].to_numpy(float) @ linked[:, seen_x]])
            yield pd.DataFrame({"a": np.concatenate([asking[seen_q], names[seen_x]]), "b": None, "others": others.astype(np.int64)})
            at, node, is_vector = stars(linked, same)
            ends = np.empty(len(node), object)
            ends[is_vector], ends[~is_vector] = names[node[is_vector]], asking[node[~is_vector]]
            yield pd.DataFrame({"a": asking[at], "b": ends, "others": np.zeros(len(at), np.int64)})

    met = materialize(meetings.mapInPandas(search, "a binary, b binary, others long"), "vector-links")
    degree = met.filter("b IS NULL").groupBy("a").agg(F.sum("others").alias("others"))
    pairs = met.filter("b IS NOT NULL").select("a", "b")
    roots = components(pairs)
    named = roots.join(classes.select(F.col("cid").alias("node"), "least_id"), "node")
    named = named.join(named.groupBy("root").agg(F.min("least_id").alias("component_id")), "root")
    per_class = (
        classes.select("cid", "n", "least_id").join(degree.withColumnRenamed("a", "cid"), "cid", "left")
        .join(named.select(F.col("node").alias("cid"), "component_id"), "cid", "left")
        .select("cid", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id"))
    )
    out = base.select("vec_id", "cid").join(per_class, "cid", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
