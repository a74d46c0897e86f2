"""N-gram Jaccard join with adaptive multi-match prefixes, reduced to components.

1. Every text becomes a set of word shingles; equal sets are one class.
2. Batches of sets, packed by token range, tell for each class how many of its tokens any other
   class holds. That bounds its overlap with all others, and only classes that can still reach
   the threshold go on.
3. Prefixes: tokens in a global order, rare ones first. A class takes ``missing + l`` of them,
   where two linked sets must share ``l`` prefix tokens (the smaller ``l`` of the two). Each class
   picks the ``l`` that makes its estimated candidates cheapest.
4. In a few rounds one candidate of each class in another component is verified. Pairs whose classes
   are connected by then need no verification; only tokens that several components hold are joined
   for the rest. Parity bits of the sets bound the tokens that differ, so pairs that cannot link are
   never made. Two components hand on one link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release
from .components import components

#: Tokens of at least this share of all candidate tokens have their count known everywhere: 65536 at most.
COMMON_SHARE = 2.0**-16
MOST_MATCHES = 8
#: Rounds in which each class meets one head, before the rest is joined.
MEETINGS = 4


def _finish(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit sums."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts on end, and how many each text has.

    Words are lower-cased in A-Z; a text of fewer than ``k`` words is one shingle, one
    without words, or a null, has none.
    """
    lists = [(t if isinstance(t, str) else "").encode("utf-8", "replace").lower().split() for t in texts]
    codes, distinct = pd.factorize(np.array([w for ws in lists for w in ws], dtype=object))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))[codes]
    n = np.array([len(ws) for ws in lists], np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    weights = _finish(np.arange(1, k + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    size = max(0, len(h) - k + 1)
    s = np.zeros(size, np.uint64)
    for j in range(k):
        s += h[j : j + size] * weights[j]
    whole = doc[: size] == doc[k - 1 :] if size else np.zeros(0, bool)
    s, doc_s = s[whole], doc[:size][whole]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        start = np.cumsum(n) - n
        own = [sum((int(h[start[d] + j]) * int(weights[j]) for j in range(n[d])), int(n[d]) * int(weights[k])) % (1 << 64) for d in short]
        s, doc_s = np.concatenate([s, np.array(own, np.uint64)]), np.concatenate([doc_s, short])
    s = _finish(s)
    order = np.lexsort((s, doc_s))
    s, doc_s = s[order], doc_s[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc_s[1:] != doc_s[:-1])
    return s[new], np.bincount(doc_s[new], minlength=len(n))


def _digests(s: np.ndarray, n: np.ndarray) -> list[bytes]:
    ends = np.cumsum(n)
    return [xxhash.xxh3_128_digest(s[e - m : e].tobytes()) if m else b"" for e, m in zip(ends, n)]


PARITY_WORDS = 16


def parities(s: np.ndarray) -> np.ndarray:
    """How many hashes fall on each of 1024 places, odd or even, as bits.

    A token that only one of two sets has flips one bit, so the bits that differ are at most
    the tokens that differ.
    """
    odd = np.bincount((s % np.uint64(64 * PARITY_WORDS)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def held_by_others(docs: DataFrame, k: int, tokens_at_once: int = 6_000_000, heads_at_once: int = 500_000, scratch: list[DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, digest) of all documents, and (c, held) of all classes.

    ``held`` counts a class's tokens that another class has too; hash collisions can only make
    it larger. A token costs about five bytes of shuffle and is sent once by each batch that
    has it, however many of its documents do. Rows of documents need no group of their own and
    are dealt to the parts in turn, whatever their texts are.
    """
    chars, rows = docs.agg(F.sum(F.length("text")), F.count(F.lit(1))).first()
    parts = max(8, -(-(chars or 0) // (6 * tokens_at_once)), -(-rows // heads_at_once))
    schema = "part int, kind int, a binary, b binary, c binary"

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = TaskContext.get().partitionId()
        for whole in batches:
            for k0 in range(0, len(whole), 4096):
                b = whole.iloc[k0 : k0 + 4096]
                s, n = shingle_sets(b["text"], k)
                digests = _digests(s, n)
                out = []
                heads = pd.DataFrame({"doc_id": b["doc_id"].astype("string").fillna("").to_numpy(object), "n": n, "d": digests})
                for h0 in range(0, len(heads), 512):
                    own = heads.iloc[h0 : h0 + 512]
                    out.append((turn % parts, 0, "\n".join(own["doc_id"]).encode(), own["n"].to_numpy(np.int32).tobytes(), b"".join(d.ljust(16, b"\0") for d in own["d"])))
                    turn += 1
                # classes of this batch, by their first documents
                code, names = pd.factorize(np.array(digests, dtype=object))
                first = np.zeros(len(n), bool)
                first[np.unique(code, return_index=True)[1]] = True
                first &= n > 0
                owner = np.repeat(code, n)
                take = np.repeat(first, n)
                s, owner = s[take], owner[take]
                c = np.array([int.from_bytes(d[:8].ljust(8, b"\0"), "little") for d in names], np.uint64)
                order = np.argsort(s, kind="stable")
                s, owner = s[order], owner[order]
                start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]][: len(s)])
                many = np.diff(np.append(start, len(s))) > 1
                inner = np.bincount(owner[np.repeat(many, np.diff(np.append(start, len(s))))], minlength=len(names))
                used = np.unique(owner)
                for q in np.unique(c[used] % np.uint64(parts)):
                    own = used[c[used] % np.uint64(parts) == q]
                    out.append((int(q), 1, c[own].tobytes(), inner[own].astype(np.int32).tobytes(), b""))
                token, who = s[start], np.where(many, -1, owner[start])
                part = token % np.uint64(parts)
                order = np.lexsort((who, part))
                token, who, part = token[order], who[order], part[order]
                edge = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
                for q in np.flatnonzero(np.diff(edge)):
                    t, w = (token[edge[q] : edge[q + 1]] >> np.uint64(32)).astype(np.uint32), who[edge[q] : edge[q + 1]]
                    names_here, count = np.unique(w, return_counts=True)
                    shared = int(count[0]) if len(names_here) and names_here[0] < 0 else 0
                    names_here, count = (names_here[1:], count[1:]) if shared else (names_here, count)
                    out.append((int(q), 2, t.tobytes(), np.append(shared, count).astype(np.int32).tobytes(), c[names_here].tobytes()))
                yield pd.DataFrame(out, columns=["part", "kind", "a", "b", "c"])

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in frame[frame["kind"] == 0].itertuples():
            n = np.frombuffer(r.b, np.int32)
            ids = r.a.decode().split("\n")
            out.append(pd.DataFrame({"doc_id": ids, "n": n, "digest": [r.c[16 * j : 16 * j + 16] for j in range(len(n))], "c": 0, "held": 0, "batches": 0}))
        cs, held, batches = [], [], []
        for r in frame[frame["kind"] == 1].itertuples():
            cs.append(np.frombuffer(r.a, np.uint64))
            held.append(np.frombuffer(r.b, np.int32).astype(np.int64))
            batches.append(np.ones(len(cs[-1]), np.int64))
        rows = list(frame[frame["kind"] == 2].itertuples())
        if rows:
            t = np.concatenate([np.frombuffer(r.a, np.uint32) for r in rows])
            # a token that several classes of one batch have is no class's own; it only marks the token
            owner = np.concatenate([np.repeat(np.append(np.zeros(1, np.uint64), np.frombuffer(r.c, np.uint64)), np.frombuffer(r.b, np.int32)) for r in rows])
            order = np.argsort(t, kind="stable")
            t, owner = t[order], owner[order]
            start = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            several = np.minimum.reduceat(owner, start) != np.maximum.reduceat(owner, start)
            hit = owner[np.repeat(several, np.diff(np.append(start, len(t))))]
            c, m = np.unique(hit[hit != 0], return_counts=True)
            cs.append(c)
            held.append(m)
            batches.append(np.zeros(len(c), np.int64))
        if cs:
            out.append(pd.DataFrame({"doc_id": "", "n": -1, "digest": None, "c": np.concatenate(cs).view(np.int64), "held": np.concatenate(held), "batches": np.concatenate(batches)}))
        return pd.concat(out) if out else pd.DataFrame(columns=["doc_id", "n", "digest", "c", "held", "batches"])

    packed = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(pack, schema)
    found = materialize(packed.groupBy("part").applyInPandas(count, "doc_id string, n int, digest binary, c long, held long, batches long"), "sets-found")
    if scratch is not None:
        scratch.append(found)
    heads = found.filter("n >= 0").select(F.nullif("doc_id", F.lit("")).cast("long").alias("doc_id"), F.col("n").cast("long").alias("n"), "digest")
    # a class that several batches have is counted once by each of them
    held = found.filter("n < 0").groupBy("c").agg((F.sum("held") / F.greatest(F.lit(1), F.sum("batches"))).alias("held"))
    return heads, held


def _class_key() -> F.Column:
    """The number that stands for a class in the counts: its digest's first eight bytes, low byte first."""
    key = F.lit(0).cast("long")
    for i in range(8):
        byte = F.conv(F.hex(F.substring("digest", i + 1, 1)), 16, 10).cast("long")
        key = key.bitwiseOR(F.shiftleft(byte, 8 * i))
    return key


def near_duplicates(docs: DataFrame, k: int, num: int, den: int, scratch: list[DataFrame] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Two rows link when num / den or more of the shingles of both are in each: den * shared >=
    num * union, on sets of ``k``-word shingles. Sets are compared by 64-bit hashes, equal
    sets by 128 bits. ``component_id`` is the least id that links reach; a null id is never
    the least. Texts without words link with nothing. Rows count, not ids: repeated rows link
    with each other. An empty table gives an empty result; other columns are ignored.
    ``scratch`` gets the tables that the result reads, for a caller who has written it.
    """
    scratch = [] if scratch is None else scratch
    heads, held = held_by_others(docs, k, scratch=scratch)
    classes = heads.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.first("n").alias("n"))
    classes = classes.withColumn("c", _class_key())
    may = (F.col("held") * den >= F.col("n") * num)
    # the digest keeps classes apart whose short keys collide
    cand = materialize(classes.join(held, "c").filter(may).select("digest", "least_id", "n", F.col("held").cast("long").alias("held")), "jaccard-classes")

    missing_id = F.lit(-(1 << 63))
    wanted = cand.select(F.coalesce("least_id", missing_id).alias("_id")).distinct()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), missing_id).alias("_id"), "text").join(wanted, "_id", "left_semi")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s, n = shingle_sets(b["text"], k)
            own = [s[e - m : e] for e, m in zip(np.cumsum(n), n)]
            yield pd.DataFrame({"digest": _digests(s, n), "s": [x.tobytes() for x in own], "sign": [parities(x) for x in own]})

    made = rows.mapInPandas(sets, "digest binary, s binary, sign array<long>").groupBy("digest").agg(F.first("s").alias("s"), F.first("sign").alias("sign"))
    made = materialize(made.join(cand, "digest").select("digest", "n", "held", "s", "sign"), "jaccard-sets")

    pairs = materialize(_linked(made, num, den, scratch), "jaccard-links")
    roots = components(pairs)
    release(made, pairs, *scratch[1:])  # what comes reads the sets found, the classes and the roots
    del scratch[1:]
    scratch += [cand, roots]
    named = roots.join(cand.select(F.col("digest").alias("node"), "least_id"), "node")
    named = named.join(named.groupBy("root").agg(F.min("least_id").alias("component_id")), "root")
    named = named.select(F.col("node").alias("digest"), "component_id")
    ids = classes.select("digest", "least_id").join(named, "digest", "left").select("digest", F.coalesce("component_id", "least_id").alias("component_id"))
    return heads.join(ids, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def first_of_groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each group of rows of ``docs`` that links connect, the one of least id.

    Rows count, not ids: equal rows, rows of one id and rows without an id are told apart by a
    key of the row. Of one id the row with the least hash of its text stays; a row without an
    id stays only where no row of its group has one. Rows whose text is null or has no words
    link with nothing and stay. An empty table gives an empty result; columns of any name
    are kept.
    """
    taken = {c.lower() for c in docs.columns}
    key = next(c for c in map("_row_{}".format, range(len(taken) + 1)) if c not in taken)
    rows = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    scratch: list[DataFrame] = []
    found = materialize(near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), k, num, den, scratch), "near-duplicates")
    release(*scratch)
    order = F.struct(F.col("i").isNull(), "i", "h", "r")
    names = rows.select(F.col(key).alias("r"), F.col("doc_id").alias("i"), F.xxhash64("text").alias("h"))
    several = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = found.join(several, "component_id").select("component_id", F.col("doc_id").alias("r")).join(names, "r")
    heads = members.groupBy("component_id").agg(F.min_by("r", order).alias("head"))
    gone = members.join(heads, "component_id").filter("r <> head").select(F.col("r").alias(key))
    return rows.join(gone, key, "left_anti").drop(key)


def prefixes(made: DataFrame, num: int, den: int) -> DataFrame:
    """(t, digest, n, held, l): the prefix tokens of each set, with the matches that it asks for."""

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = np.frombuffer(b"".join(b["s"]), np.int64)
            t, f = np.unique(raw, return_counts=True)
            yield pd.DataFrame({"t": t, "f": f})

    counts = materialize(made.select("s").mapInPandas(tokens, "t long, f long").groupBy("t").agg(F.sum("f").alias("f")).filter("f > 1"), "token-counts")
    total = made.agg(F.sum("n")).first()[0] or 0
    rows = counts.filter(F.col("f") >= max(3.0, total * COMMON_SHARE)).toPandas().sort_values("t")
    common = made.sparkSession.sparkContext.broadcast((rows["t"].to_numpy(np.int64), rows["f"].to_numpy(np.int64)))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, freq = common.value
        for b in batches:
            out = []
            for digest, n, held, s in zip(b["digest"], b["n"], b["held"], b["s"]):
                t = np.frombuffer(s, np.int64)
                at = np.minimum(np.searchsorted(names, t), max(0, len(names) - 1))
                known = names[at] == t if len(names) else np.zeros(len(t), bool)
                f = np.where(known, freq[at], 1) if len(names) else np.ones(len(t), np.int64)
                order = np.lexsort((t, f))
                need = -(-num * int(n) // den)
                most = min(MOST_MATCHES, need)
                cost = np.cumsum(f[order].astype(float))
                ls = np.arange(1, most + 1)
                # postings to read, and candidates to verify, which fall with the matches asked for
                l = int(ls[np.argmin(cost[int(n) - need + ls - 1] * (1 + 8 / ls))])
                own = t[order[: int(n) - need + l]]
                out.append(pd.DataFrame({"t": own, "digest": digest, "n": n, "held": held, "l": l}))
            yield pd.concat(out) if out else pd.DataFrame({"t": [], "digest": [], "n": [], "held": [], "l": []})

    found = made.mapInPandas(choose, "t long, digest binary, n long, held long, l int")
    # a token of one set matches nothing
    return materialize(found.join(counts.select("t"), "t", "left_semi"), "prefixes")


def _linked(made: DataFrame, num: int, den: int, scratch: list[DataFrame]) -> DataFrame:
    """Links (a, b) between different classes, enough of them to connect all that are linked."""
    prefix = prefixes(made, num, den)
    least_both = F.least("held_a", "held_b")
    bound = (least_both * den >= (F.col("n_a") + F.col("n_b") - least_both) * num) & (
        F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)

    # first rounds: each class meets the head of one of its tokens' lists in another component,
    # the one it shares most tokens with; a head is the class with the fewest tokens of its own
    links, comp, most_found = None, None, 0
    for _ in range(MEETINGS):
        named = prefix.withColumn("root", F.col("digest")) if comp is None else prefix.join(comp, "digest", "left").withColumn(
            "root", F.coalesce("root", "digest"))
        head = F.min(F.struct((F.col("n") - F.col("held")).alias("own"), "n", "digest", "held", "root"))
        heads = named.groupBy("t").agg(head.alias("h1"))
        other = named.join(heads.select("t", F.col("h1.root").alias("r1")), "t").filter("root <> r1").groupBy("t").agg(head.alias("h2"))
        heads = heads.join(other, "t").select("t", "h1", "h2")
        meets = named.select("t", F.col("digest").alias("a"), F.col("n").alias("n_a"), F.col("held").alias("held_a"), "root").join(heads, "t")
        b = F.when(F.col("h1.root") == F.col("root"), F.col("h2")).otherwise(F.col("h1"))
        meets = meets.withColumn("h", b).select(
            "a", "n_a", "held_a", F.col("h.digest").alias("b"), F.col("h.n").alias("n_b"), F.col("h.held").alias("held_b"))
        meets = meets.filter(bound).groupBy("a", "b").agg(F.count(F.lit(1)).alias("m"))
        one = meets.groupBy("a").agg(F.max(F.struct("m", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
        found = materialize(verify(one, made, num, den), "jaccard-links")
        more = found.count()
        links = found if links is None else materialize(links.unionAll(found), "jaccard-links")
        reached = components(links)
        comp = materialize(reached.select(F.col("node").alias("digest"), "root").distinct(), "jaccard-roots")
        release(reached)
        scratch += [found, links, comp]
        # a round that finds little leaves the rest to the join, which is exact
        most_found = max(most_found, more)
        if 10 * more <= most_found:
            break

    # what these have connected needs no more verification
    prefix2 = materialize(prefix.join(comp, "digest", "left").withColumn("root", F.coalesce("root", "digest")), "prefixes")
    scratch.append(prefix2)
    release(prefix)
    several = prefix2.groupBy("t").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 <> r2").select("t")
    active = prefix2.join(several, "t", "left_semi")
    lists = active.groupBy("digest").agg(F.collect_list("t").alias("ts")).join(made.select("digest", "sign"), "digest")
    side = materialize(active.join(lists, "digest"), "prefixes")
    scratch.append(side)
    x = side.select("t", F.col("digest").alias("a"), F.col("n").alias("n_a"), F.col("held").alias("held_a"), F.col("l").alias("l_a"), F.col("ts").alias("ts_a"), F.col("sign").alias("sign_a"), F.col("root").alias("root_a"))
    y = side.select("t", F.col("digest").alias("b"), F.col("n").alias("n_b"), F.col("held").alias("held_b"), F.col("l").alias("l_b"), F.col("ts").alias("ts_b"), F.col("sign").alias("sign_b"), F.col("root").alias("root_b"))
    shared = F.array_intersect("ts_a", "ts_b")
    differ = F.lit(0)
    for i in range(PARITY_WORDS):
        differ = differ + F.bit_count(F.get("sign_a", F.lit(i)).bitwiseXOR(F.get("sign_b", F.lit(i))))
    # tokens that differ are at least ``differ``: 2 * shared <= n_a + n_b - differ
    most = (F.col("n_a") + F.col("n_b") - differ) * (den + num) >= (F.col("n_a") + F.col("n_b")) * (2 * num)
    # each pair once, at its least shared token
    ask = (x["t"] == y["t"]) & (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & bound & most & (
        F.size(shared) >= F.least("l_a", "l_b")) & (F.array_min(shared) == x["t"])
    rest = x.join(y, ask).select("a", "b")
    rest = materialize(rest, "jaccard-rest")
    scratch.append(rest)
    rest = verify(rest, made, num, den)
    # one link is enough between two components
    root = lambda c: comp.select(F.col("digest").alias(c), F.col("root").alias(f"root_{c}"))
    rest = rest.join(root("a"), "a", "left").join(root("b"), "b", "left").groupBy(
        F.coalesce("root_a", "a").alias("ra"), F.coalesce("root_b", "b").alias("rb")).agg(F.min(F.struct("a", "b")).alias("x")).select("x.a", "x.b")
    return links.unionAll(rest)


def verify(pairs: DataFrame, made: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose whole sets reach the threshold."""
    sets = made.select("digest", "s")
    both = pairs.join(sets.select(F.col("digest").alias("a"), F.col("s").alias("s_a")), "a").join(
        sets.select(F.col("digest").alias("b"), F.col("s").alias("s_b")), "b")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = []
            for x, y in zip(b["s_a"], b["s_b"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(common * den >= (len(x) + len(y) - common) * num)
            yield b.loc[np.array(ok, bool), ["a", "b"]]

    return both.mapInPandas(check, "a binary, b binary")
