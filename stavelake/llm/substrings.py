"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A cut stands at least NEAR bytes from the next; the hash sees 16 bytes; no chunk is longer than LONGEST.
NEAR, LONGEST = 28, 1024
GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], np.uint32)
_NO_CUT = np.uint64(1 << 34)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[raw[i-k]] * 4**k over the last 16 bytes, in 32 bits, by doubling."""
    h = GEAR[raw]
    for k in (1, 2, 4, 8):
        if len(h) > k:
            h[k:] = h[k:] + (h[:-k] << np.uint32(2 * k))  # the right side is computed before it is stored
    return h


def cuts(raw: np.ndarray) -> np.ndarray:
    """Chunk ends. A chunk begins where the hash of the 16 bytes before is the least within NEAR bytes.

    Word starts come before other character starts, so words stay whole where there are any;
    bytes inside a character never begin a chunk. Whether a place is a cut depends only on
    the bytes around it: an insertion moves no cut that is further away.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64)
    value = np.full(n + 2 * NEAR + 16, _NO_CUT, np.uint64)
    own = value[NEAR : NEAR + n]
    own[1:] = gear_hashes(raw)[:-1]
    own[1:][~_SPACE[raw[:-1]] | _SPACE[raw[1:]]] += np.uint64(1 << 32)
    own[(raw & 0xC0) == 0x80] = _NO_CUT
    own[0] = _NO_CUT
    least = value
    for k in (1, 2, 4, 8):
        least = np.minimum(least[:-k], least[k:])  # of 16 on end
    before = np.minimum(least[:n], least[NEAR - 16 : NEAR - 16 + n])
    after = np.minimum(least[NEAR + 1 : NEAR + 1 + n], least[2 * NEAR - 15 : 2 * NEAR - 15 + n])
    found = np.flatnonzero((own < before) & (own <= after) & (own < _NO_CUT))
    ends = np.append(found, n)
    gaps = np.diff(ends, prepend=0)
    if gaps.max() <= LONGEST:
        return ends
    out = []
    for start, end in zip(np.append(0, ends[:-1]), ends):
        while end - start > LONGEST:
            start += LONGEST
            while (raw[start] & 0xC0) == 0x80:
                start -= 1
            out.append(start)
        out.append(end)
    return np.array(out)


def chunk_digests(text: str | None) -> tuple[bytes, np.ndarray, list[bytes]]:
    """UTF-8 bytes, chunk ends, and a 96-bit digest of each chunk; a null text has no chunks."""
    raw = (text or "").encode("utf-8", "replace")
    ends = cuts(np.frombuffer(raw, np.uint8))
    at, out = 0, []
    for e in ends.tolist():
        out.append(xxhash.xxh3_128_digest(raw[at:e])[:12])
        at = e
    return raw, ends, out


def removable(ends: np.ndarray, repeated: np.ndarray, least_run: int) -> np.ndarray:
    """Repeated chunks that stand in a run of at least ``least_run`` bytes."""
    if not repeated.any():
        return repeated
    start = np.append(0, ends[:-1])
    edge = np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]]))
    out = np.zeros(len(ends), bool)
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        if ends[b - 1] - start[a] >= least_run:
            out[a:b] = True
    return out


def dedup_substrings(docs: DataFrame, least_run: int = 64) -> DataFrame:
    """``docs`` with ``text`` freed of repeated passages, and n_chunks, n_removed, n_bytes, removed_bytes.

    A chunk stays where it stands first: in the document of smallest id, there at its first
    place. Elsewhere it goes, if the run of repeated chunks it is in has ``least_run`` bytes
    or more, so short common phrases stay. A null id comes before all others; different texts
    of one id, or without one, come in the order of their hashes, and of equal ones the first
    row counts. A null text stays null; an empty or wholly repeated text becomes empty and
    keeps its row. Other columns are kept as they are, whatever their names.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))

    def chunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, hashes, digests, places = [], [], [], []
            for k, h, t in zip(b["k"], b["h"], b["t"]):
                seen = set()
                for place, d in enumerate(chunk_digests(t if isinstance(t, str) else "")[2]):
                    if d not in seen:
                        seen.add(d)
                        digests.append(d)
                        places.append(place)
                keys.append(np.full(len(seen), k, np.int64))
                hashes.append(np.full(len(seen), h, np.int64))
            raw = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 12)
            yield pd.DataFrame({
                "k": np.concatenate(keys) if keys else np.zeros(0, np.int64), "h": np.concatenate(hashes) if hashes else np.zeros(0, np.int64), "place": np.array(places, np.int32),
                "d1": np.ascontiguousarray(raw[:, :8]).view("<i8").ravel(), "d2": np.ascontiguousarray(raw[:, 8:]).view("<i4").ravel()})

    # written once, as the numbers that tell equal rows apart must stay the same
    whole = materialize(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("k"), F.xxhash64("text").alias("h"),
        F.monotonically_increasing_id().alias("nth")), "passages")
    text = F.col("row").getField("text").alias("t")
    chunks = whole.select("k", "h", text).mapInPandas(chunk, "k long, h long, place int, d1 long, d2 int")
    own = F.struct("k", "h")
    # a chunk that only equal rows have counts as shared here, but has nothing before it
    shared = chunks.groupBy("d1", "d2").agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    shared = shared.select("d1", "d2", F.col("first.k").alias("k0"), F.col("first.h").alias("h0"))
    # a hot chunk meets one row, so its documents can be split over tasks; places are those of one text
    gone = chunks.join(shared, ["d1", "d2"]).filter("k > k0 OR k = k0 AND h > h0").groupBy("k", "h").agg(F.collect_set("place").alias("places"))
    copies = whole.groupBy("k", "h").agg(F.min("nth").alias("nth0"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows")
    joined = whole.join(gone, ["k", "h"], "left").join(copies, ["k", "h"], "left").select(
        "row", text, "places", F.coalesce(F.col("nth") > F.col("nth0"), F.lit(False)).alias("copy"))

    def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t, places, copy in zip(b["t"], b["places"], b["copy"]):
                raw, ends, digests = chunk_digests(t if isinstance(t, str) else "")
                repeated = np.full(len(ends), copy, bool)
                if places is not None:
                    repeated[np.asarray(places, np.int64)] = True
                seen: dict[bytes, bool] = {}
                for place, d in enumerate(digests):
                    if d in seen:
                        repeated[place] = True
                    seen[d] = True
                out = removable(ends, repeated, least_run)
                start = np.append(0, ends[:-1]) if len(ends) else ends
                kept = raw if not out.any() else b"".join(raw[a:e] for a, e, o in zip(start, ends, out) if not o)
                rows.append((kept.decode("utf-8", "replace") if isinstance(t, str) else None, len(ends), int(out.sum()), len(raw), len(raw) - len(kept)))
            yield pd.concat([b[["row"]].reset_index(drop=True), pd.DataFrame(rows, columns=["text", *COUNTS])], axis=1)

    row = whole.schema["row"].dataType.simpleString()
    done = joined.mapInPandas(rebuild, f"row {row}, text string, n_chunks long, n_removed long, n_bytes long, removed_bytes long")
    kept = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return done.select(*kept, *[c for c in COUNTS if c not in docs.columns])


COUNTS = ("n_chunks", "n_removed", "n_bytes", "removed_bytes")
