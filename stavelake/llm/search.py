"""Ranked lexical search by Block-Max MaxScore over shards of documents.

1. The items' terms, in blocks of bounded size, are known to every task. Each task reads its
   documents once and packs shards: documents in order of length, and for every term a list of
   postings in blocks of 64, as gaps and counts, with the largest count and the shortest document
   of each block.
2. Numbers of documents, their lengths and the terms' frequencies are summed over all shards.
3. Each shard answers every item. Lists in order of their global bounds: those whose bounds
   together stay below the 50th best score are not essential, and only documents of the others
   are candidates. A range of documents whose block maxima cannot reach the score is never
   unpacked, and a candidate is dropped by the block maxima of the other lists before those
   blocks are unpacked.
4. The shards' best documents are merged by rank; a shard sends 50 rows an item at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Characters of a term; A to Z are lower-cased before.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes to the same effect: what is no part of a term becomes a space.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BLOCK = 64
#: Documents of a shard are numbered in two bytes.
DOCS_PER_SHARD = 1 << 16
POSTINGS_PER_SHARD = 2_000_000
RANGE = 8192
#: Pairs of an item and a term that one pass over the documents answers.
PAIRS_AT_ONCE = 400_000

SHARD = ("n_docs long, length long, ids binary, no_id binary, lengths binary, terms array<int>, dfs array<int>, "
         "firsts array<binary>, most array<binary>, shortest array<binary>, gaps array<binary>, counts array<binary>")


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TERM_BYTES).split()


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers in one, two or four bytes each, as the largest needs."""
    top = int(x.max(initial=0))
    return x.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4").tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64)


def pack_shard(ids: pd.Series, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> dict:
    """One shard: documents by (length, id), and the postings (doc, term, tf) as lists of blocks."""
    missing = ids.isna().to_numpy()
    number = ids.fillna(0).to_numpy(np.int64)
    order = np.lexsort((number, missing, lengths))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    doc = place[doc]
    by = np.lexsort((doc, term))
    doc, term, tf = doc[by], term[by], tf[by]
    lengths = lengths[order]
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]][: len(term)])
    ends = np.append(starts[1:], len(term))
    out = {"n_docs": len(ids), "length": int(lengths.sum()), "ids": number[order].tobytes(), "no_id": missing[order].tobytes(),
           "lengths": lengths.astype("<i8").tobytes(), "terms": term[starts].astype(np.int32), "dfs": (ends - starts).astype(np.int32)}
    lists: dict[str, list[bytes]] = {k: [] for k in ("firsts", "most", "shortest", "gaps", "counts")}
    for s, e in zip(starts, ends):
        n_blocks = -(-(e - s) // BLOCK)
        pad = n_blocks * BLOCK - (e - s)
        d = np.append(doc[s:e], np.full(pad, doc[e - 1])).reshape(n_blocks, BLOCK)
        c = np.append(tf[s:e], np.zeros(pad, np.int64)).reshape(n_blocks, BLOCK)
        lists["firsts"].append(d[:, 0].astype("<u2").tobytes())
        lists["most"].append(_narrow(c.max(axis=1)))
        lists["shortest"].append(_narrow(lengths[d[:, 0]]))
        lists["gaps"].append(_narrow(np.diff(d, axis=1, prepend=d[:, :1])))
        lists["counts"].append(_narrow(c))
    return out | lists


def build_shards(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Shards of all documents with the postings of the given terms, packed where the documents are read."""
    code = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(vocabulary)})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get, held = code.value.get, []

        def shard() -> pd.DataFrame:
            at, doc = 0, []
            for ids, _, d, _, _ in held:
                doc.append(d + at)
                at += len(ids)
            parts = [np.concatenate([h[k] for h in held]) for k in (1, 3, 4)]
            row = pack_shard(pd.concat([h[0] for h in held]), parts[0], np.concatenate(doc), *parts[1:])
            held.clear()
            return pd.DataFrame([row])

        for b in batches:
            for k in range(0, len(b), 1024):
                own = b.iloc[k : k + 1024]
                lengths, doc, term, tf = [], [], [], []
                for j, text in enumerate(own["text"]):
                    words = terms_of(text) if isinstance(text, str) else []
                    lengths.append(len(words))
                    c = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                    t, f = np.unique(c[c >= 0], return_counts=True)
                    doc.append(np.full(len(t), j))
                    term.append(t)
                    tf.append(f)
                n = np.array(lengths, np.int64)
                used = n > 0
                place = np.cumsum(used) - 1
                held.append((own["doc_id"].astype("Int64")[used], n[used], place[np.concatenate(doc).astype(np.int64)],
                             np.concatenate(term), np.concatenate(tf)))
                if sum(len(h[0]) for h in held) > DOCS_PER_SHARD - 1024 or sum(len(h[2]) for h in held) > POSTINGS_PER_SHARD:
                    yield shard()
        if held:
            yield shard()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(pack, SHARD)


class Postings:
    """One list of a shard; ``impact`` gives what a document of some count and length adds."""

    def __init__(self, df: int, firsts: bytes, most: bytes, shortest: bytes, gaps: bytes, counts: bytes):
        self.first = np.frombuffer(firsts, "<u2").astype(np.int64)
        self.most, self.shortest = _wide(most, len(self.first)), _wide(shortest, len(self.first))
        self.gaps, self.counts = gaps, counts

    def ready(self, weight: int, share_of: tuple[int, int]) -> None:
        self.weight = weight
        self.bounds = impact(weight, self.most, norm(self.shortest, *share_of))
        self.bound = int(self.bounds.max())

    def blocks(self, lo: int, hi: int) -> slice:
        """Blocks that may hold documents from ``lo`` up to ``hi``."""
        return slice(max(0, int(np.searchsorted(self.first, lo, "right")) - 1), int(np.searchsorted(self.first, hi)))

    def unpack(self, which: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.first)
        size = n * BLOCK
        gaps = np.frombuffer(self.gaps, f"<u{len(self.gaps) // size}").reshape(n, BLOCK)[which]
        counts = np.frombuffer(self.counts, f"<u{len(self.counts) // size}").reshape(n, BLOCK)[which]
        doc = np.cumsum(gaps, axis=1, dtype=np.int64) + self.first[which][:, None]
        real = counts > 0
        return doc[real], counts[real].astype(np.int64)


def norm(n: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    return 100 - 50 + (50 * n * n_docs) // length


def impact(weight: int, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def best_of_shard(lists: list[Postings], m: np.ndarray, ids: np.ndarray, no_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the ``k`` best documents of a shard, equal scores by id."""
    lists = sorted(lists, key=lambda p: p.bound)
    upto = np.cumsum([p.bound for p in lists])
    place, score, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    for lo in range(0, len(m), RANGE):
        hi = min(lo + RANGE, len(m))
        split = int(np.searchsorted(upto, least))  # lists before it cannot reach the score together
        if split == len(lists):
            break
        below = int(upto[split - 1]) if split else 0
        ranges = [(p, p.blocks(lo, hi)) for p in lists[split:]]
        if below + sum(int(p.bounds[r].max(initial=0)) for p, r in ranges) < least:
            continue
        total = np.zeros(hi - lo, np.int64)
        for p, r in ranges:
            doc, tf = p.unpack(r)
            inside = (doc >= lo) & (doc < hi)
            doc, tf = doc[inside], tf[inside]
            total[doc - lo] += impact(p.weight, tf, m[doc])
        cand = np.flatnonzero(total)
        have = total[cand]
        cand += lo
        for j in range(split - 1, -1, -1):
            p, rest = lists[j], int(upto[j - 1]) if j else 0
            block = np.searchsorted(p.first, cand, "right") - 1
            most = np.where(block >= 0, p.bounds[np.maximum(block, 0)], 0)
            alive = have + most + rest >= least
            cand, have, block = cand[alive], have[alive], block[alive]
            if not len(cand):
                break
            doc, tf = p.unpack(np.unique(block[block >= 0]))
            if len(doc):
                at = np.minimum(np.searchsorted(doc, cand), len(doc) - 1)
                hit = doc[at] == cand
                have[hit] += impact(p.weight, tf[at[hit]], m[cand[hit]])
        good = have >= least
        place, score = np.append(place, cand[good]), np.append(score, have[good])
        if len(place) > k:
            order = np.lexsort((ids[place], no_id[place], -score))[:k]
            place, score = place[order], score[order]
            least = max(1, int(score[-1]))
    return place, score


def _ranked(docs: DataFrame, pairs: pd.DataFrame, k: int) -> DataFrame:
    """(item_id, doc_id, score): each shard's ``k`` best documents for the items of one block."""
    spark = docs.sparkSession
    vocabulary = sorted({t.encode() for t in pairs["term"]})
    shards = materialize(build_shards(docs, vocabulary), "search-shards")
    n_docs, length = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
    counts = shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs").alias("df"))
    df = {r["terms"]: r["df"] for r in counts.toLocalIterator()}  # one number for each of the block's terms
    weight = {t: int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * n + 1)))) for t, n in df.items()}
    code = {t: j for j, t in enumerate(vocabulary)}
    items = [(i, sorted({code[t.encode()] for t in own["term"]})) for i, own in pairs.groupby("item_id", dropna=False)]
    asked = spark.sparkContext.broadcast((weight, items))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, items = asked.value
        for b in batches:
            for row in b.itertuples():
                ids, no_id = np.frombuffer(row.ids, np.int64), np.frombuffer(row.no_id, bool)
                m = norm(np.frombuffer(row.lengths, "<i8"), n_docs, length)
                lists = {t: Postings(*x) for t, *x in zip(row.terms, row.dfs, row.firsts, row.most, row.shortest, row.gaps, row.counts)}
                for t, p in lists.items():
                    p.ready(weight[t], (n_docs, length))
                for item, terms in items:
                    place, score = best_of_shard([lists[t] for t in terms if t in lists and lists[t].bound > 0], m, ids, no_id, k)
                    if len(place):
                        doc = pd.array(ids[place], "Int64")
                        doc[no_id[place]] = pd.NA
                        yield pd.DataFrame({"item_id": pd.array([item] * len(place), "Int64"), "doc_id": doc, "score": score})

    return shards.mapInPandas(search, "item_id long, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, scores above 0.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored. Rows
    count, not ids: a document row repeated is ranked twice. Rows of one item id (or without
    an id) are one item with the terms of all of them; items without terms give no rows.
    Equal scores are ranked by id, those without an id last. Null and empty texts hold no term.
    """
    spark = docs.sparkSession
    term = F.explode(F.array_distinct(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), 0))).alias("term")
    pairs = items.select(F.col("item_id").cast("long").alias("item_id"), term).distinct()
    pairs = materialize(pairs, "search-items")
    passes = max(1, -(-pairs.count() // PAIRS_AT_ONCE))
    found = [_ranked(docs, pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == j).toPandas().astype({"item_id": "Int64"}), k)
             for j in range(passes)]
    every = found[0] if found else spark.createDataFrame([], "item_id long, doc_id long, score long")
    for more in found[1:]:
        every = every.unionAll(more)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_LETTERS = f"translate(text, '{UPPER}', '{LOWER}')"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, unnest(regexp_extract_all({_LETTERS}, '{TERM}')) AS term FROM documents),
 n AS (SELECT k, count(*) AS n FROM d GROUP BY k),
 size AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS length FROM n),
 m AS (SELECT k, 100 - 50 + ((50 * n * n_docs) // length) AS m FROM n, size),
 tf AS (SELECT k, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM d GROUP BY k, term),
 w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, size GROUP BY term),
 q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LETTERS}, '{TERM}')) AS term FROM benchmark),
 s AS (SELECT item_id, k, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
       FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (k) GROUP BY item_id, k),
 r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50
"""
