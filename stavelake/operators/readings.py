"""What the OCR tokens of a crop read: its best number and its printed "1"s, in one pass over sorted tokens.

The left-to-right merge is a fold, which SQL has no linear form of.  Here the k-th tokens of all runs of
a batch are folded at once, so a batch takes as many steps as its longest run has tokens.  A crop leaves
as one row; its tokens are never written, nor dealt again.
"""

from __future__ import annotations

import re
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from ..functions.text import LABEL_PATTERN

ONE_BAR_CONFIDENCE = 0.80
_BOX = ("x1", "y1", "x2", "y2")
_LABEL = re.compile(LABEL_PATTERN, re.ASCII)
_LOOKALIKE = re.compile(r"[\dIl|!i\]\[]", re.ASCII)
_DIGITS = re.compile(r"\d*", re.ASCII)
_NUMBER = re.compile(r"\d+", re.ASCII)
_FREE_NUMBER = re.compile(r"(?<![A-Za-z])\d+(?![A-Za-z])", re.ASCII)


def as_int(digits: str) -> float:
    """Value of a digit run; NaN beyond 32 bits."""
    d = digits.lstrip("0") or "0"
    return float(d) if len(d) <= 10 and int(d) < 1 << 31 else np.nan


def read_text(text: str) -> tuple[bool, bool, int, tuple[tuple[float, bool], ...]]:
    """Only digits (or nothing); one look-alike glyph; length; numbers and whether they stand behind an equals sign."""
    cleaned = re.sub(r"[.,;]", "", re.sub(r"^[EP](\d)", r"\1", text, flags=re.ASCII))
    found = (_FREE_NUMBER if _LABEL.search(text) else _NUMBER).findall(cleaned)
    behind = text.split("=")[1] if "=" in text else None
    return (_DIGITS.fullmatch(text) is not None, _LOOKALIKE.fullmatch(text.strip(" ")) is not None, len(text),
            tuple((as_int(d), behind is not None and d in behind) for d in found))


def changes(columns: Sequence[pa.Array]) -> np.ndarray:
    """True where a row differs from the one before; nulls are equal."""
    out = np.ones(len(columns[0]), bool)
    same = np.ones(len(out) - 1, bool)
    for c in columns:
        code = c.dictionary_encode(null_encoding="encode").indices.to_numpy()
        same &= code[1:] == code[:-1]
    out[1:] = ~same
    return out


def by_crop(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Batches cut where a crop ends; the tokens of an open crop are held until it does."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(j) for j in range(n_keys)]
        new = changes(keys)
        new[0] = last is None or [c[0].as_py() for c in keys] != last
        last = [c[-1].as_py() for c in keys]
        starts = np.flatnonzero(new)
        if len(starts):
            cut = int(starts[-1])
            if cut:
                held.append(b.slice(0, cut))
            if held:
                yield pa.concat_batches(held)
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield pa.concat_batches(held)


def merge_runs(crop: np.ndarray, box: np.ndarray, conf: np.ndarray, text: np.ndarray, digits: np.ndarray, look: np.ndarray,
               length: np.ndarray) -> list[np.ndarray]:
    """Fold the runs of digit tokens; of every merged result: its first token, box, text and confidence.

    ``box`` has the rows x1, y1, x2, y2.  A token joins the one under construction when they are level,
    of similar height and close, and a text of digits results.
    """
    start = np.flatnonzero(np.r_[True, (crop[1:] != crop[:-1]) | ~(digits[1:] & digits[:-1])])
    size = np.diff(np.append(start, len(crop)))
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    start = start[: np.searchsorted(-size, -1)]  # runs of one token stay as they are
    size = size[: len(start)]
    first, n = start.copy(), np.ones(len(start), np.int64)
    at, txt, cf, lk, ln = box[:, start], text[start], conf[start], look[start], length[start]
    out = []

    def flush(done):
        out.append((first[done], at[:, done], txt[done], cf[done]))

    for k in range(1, int(size[0]) if len(size) else 1):
        m = np.searchsorted(-size, -k)  # runs of more than k tokens come first
        i = start[:m] + k
        c, new = at[:, :m], box[:, i]
        ch, nh = c[3] - c[1], new[3] - new[1]
        low = np.minimum(ch, nh)
        off = np.abs((c[1] + c[3]) / 2.0 - (new[1] + new[3]) / 2.0)
        loose, split = off < low * 0.5, lk[:m] & look[i]
        limit = np.where(split & (off < low * 0.2), low * 1.5, np.where(split & loose, low * 0.8, low * 0.3))
        both = ln[:m] + length[i]
        joins = (loose & (new[0] - c[2] < limit) & (np.abs(ch - nh) / np.maximum(ch, nh) < np.where(split, 0.4, 0.25))
                 & (both > 0))
        flush(np.flatnonzero(~joins & (n[:m] > 1)))
        grown = np.stack([np.fmin(c[0], new[0]), np.fmin(c[1], new[1]), np.fmax(c[2], new[2]), np.fmax(c[3], new[3])])
        at[:, :m] = np.where(joins, grown, new)
        txt[:m] = np.where(joins, txt[:m] + text[i], text[i])
        cf[:m] = np.where(joins, (cf[:m] + conf[i]) / 2.0, conf[i])
        # a joined text of one glyph is a digit beside an empty text
        lk[:m] = np.where(joins, both == 1, look[i])
        ln[:m] = np.where(joins, both, length[i])
        first[:m] = np.where(joins, first[:m], i)
        n[:m] = np.where(joins, n[:m] + 1, 1)
    flush(np.flatnonzero(n > 1))
    return [np.concatenate(x, axis=-1) for x in zip(*out)]


def scores(value: np.ndarray, behind: np.ndarray, box: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """``text.number_score`` of an array; NaN for values below 2 and where a part is missing."""
    x1, y1, x2, y2 = box
    high = (y2 - y1) / h
    out = (
        100.0
        - np.abs((x1 + x2) / 2.0 - w / 2.0) / w * 200.0
        - np.abs((y1 + y2) / 2.0 - h / 2.0) / h * 100.0
        + np.where((high >= 0.4) & (high <= 0.95), 20.0, np.where(high < 0.3, -30.0, 0.0))
        - np.where(behind, 80.0, 0.0)
        - np.where(value > 100, 50.0, 0.0)
        - np.where((value > 20) & (w < 100), 200.0, 0.0)
    )
    return np.where(value >= 2, out, np.nan)


def inside(crop: np.ndarray, box: np.ndarray, o_crop: np.ndarray, o_box: np.ndarray, hold: int = 2_000_000) -> np.ndarray:
    """Which boxes lie within one of ``o_box`` of their crop, whose crops ascend; ``hold`` pairs at a time."""
    out = np.zeros(len(crop), bool)
    a, z = np.searchsorted(o_crop, crop, "left"), np.searchsorted(o_crop, crop, "right")
    ends = np.cumsum(z - a)
    i = 0
    while i < len(crop):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + hold, "right")))
        n = z[i:j] - a[i:j]
        row = np.repeat(np.arange(i, j), n)
        o = np.repeat(a[i:j], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        hit = ((o_box[0, o] <= box[0, row]) & (o_box[1, o] <= box[1, row])
               & (box[2, row] <= o_box[2, o]) & (box[3, row] <= o_box[3, o]))
        out[row[hit]] = True
        i = j
    return out


def distinct(crop: np.ndarray, box: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct boxes of each crop by crop, and how many stand for each."""
    if not len(crop):
        return crop, box, crop
    order = np.lexsort((*box[::-1], crop))
    crop, box = crop[order], box[:, order]
    new = np.flatnonzero(np.r_[True, (crop[1:] != crop[:-1]) | (box[:, 1:] != box[:, :-1]).any(0)])
    return crop[new], box[:, new], np.diff(np.append(new, len(crop)))


def crop_readings(tokens: DataFrame, keys: Sequence[str], img_w: Column, img_h: Column) -> DataFrame:
    """Per crop the best-scored number of its raw and merged tokens (``value``, ``score``) and ``ones``.

    Ties go to raw before merged, then to reading order.  ``ones`` counts the confident printed "1"s; a raw
    one inside a merged token that reads two or more is part of that number.  The image of a crop has one
    size, so ``img_w`` and ``img_h`` are functions of the keys.  Crops with neither are left out; ``tokens``
    carry ``ord``, a box, ``text`` and ``confidence``.  A task holds the tokens of one crop.
    """
    cols = [*keys, "ord", *_BOX, "confidence", "text"]
    t = tokens.select(*cols).repartition(*keys).sortWithinPartitions(*keys, "x1", "ord")
    t = t.select(*cols, img_w.cast("double").alias("_w"), img_h.cast("double").alias("_h"))
    out = T.StructType([*t.select(*keys).schema.fields, *T.StructType.fromDDL("value int, score double, ones bigint").fields])
    n_keys = len(keys)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for b in by_crop(batches, n_keys):
            with np.errstate(divide="ignore", invalid="ignore"):
                yield read_batch(b, known)
            if len(known) > 100_000:
                known.clear()

    def read_batch(b: pa.RecordBatch, known: dict[str, tuple]) -> pa.RecordBatch:
        real = lambda n: b.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False)
        new = changes([b.column(j) for j in range(n_keys)])
        head, crop = np.flatnonzero(new), np.cumsum(new) - 1
        box, conf, w, h = np.stack([real(n) for n in _BOX]), real("confidence"), real("_w"), real("_h")
        # as in Spark, a NaN that is stored is above any number; a missing confidence is not
        conf = np.where(np.isnan(conf) & b.column("confidence").is_valid().to_numpy(zero_copy_only=False), np.inf, conf)
        order = pc.fill_null(b.column("ord").cast(pa.int64()), np.iinfo(np.int64).min).to_numpy()
        codes = b.column("text").dictionary_encode()
        code = pc.fill_null(codes.indices, len(codes.dictionary)).to_numpy()
        texts = codes.dictionary.to_pylist()
        for x in texts:
            if x not in known:
                known[x] = read_text(x)
        facts = [known[x] for x in texts] + [read_text("")]  # a missing text joins as an empty one
        words = np.array([*texts, ""], dtype=object)
        # numbers of raw tokens: those of their texts
        count = np.array([len(f[3]) for f in facts])
        flat = [x for f in facts for x in f[3]]
        values, behinds = np.array([v for v, _ in flat], float), np.array([q for _, q in flat], bool)
        n = count[code]
        row = np.repeat(np.arange(len(code)), n)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        which = (np.cumsum(count) - count)[code[row]] + pos
        digits, look, length = (np.array([f[k] for f in facts])[code] for k in (0, 1, 2))
        m_first, m_box, m_text, m_conf = merge_runs(crop, box, conf, words[code], digits, look, length)
        m_crop, m_value = crop[m_first], np.array([as_int(x) for x in m_text], float)
        # all candidates, raw before merged
        at = np.concatenate([row, m_first])
        c_box, c_conf = np.concatenate([box[:, row], m_box], 1), np.concatenate([conf[row], m_conf])
        value = np.concatenate([values[which], m_value])
        source = np.repeat([0, 1], [len(row), len(m_first)])
        behind = np.concatenate([behinds[which], np.zeros(len(m_first), bool)])
        score = scores(value, behind, c_box, w[at], h[at])
        best = np.flatnonzero(~np.isnan(score))
        best = best[np.lexsort((np.concatenate([pos, np.zeros(len(m_first), int)])[best], order[at[best]], source[best], -score[best], crop[at[best]]))]
        best = best[np.r_[True, np.diff(crop[at[best]]) > 0]] if len(best) else best
        # printed ones
        one = (value == 1) & (c_conf >= ONE_BAR_CONFIDENCE)
        ones = np.bincount(crop[at[one & (source == 1)]], minlength=len(head))
        raw = np.flatnonzero(one & (source == 0))
        r_crop, r_box, r_n = distinct(crop[at[raw]], c_box[:, raw])
        some = np.ones(len(head), bool)  # a crop without a key meets no other row
        for j in range(n_keys):
            some &= b.column(j).is_valid().to_numpy(zero_copy_only=False)[head]
        big = (m_value >= 2) & some[m_crop]
        o_crop, o_box, _ = distinct(m_crop[big], m_box[:, big])
        free = ~inside(r_crop, r_box, o_crop, o_box)
        ones = ones + np.bincount(r_crop[free], r_n[free], len(head)).astype(np.int64)
        got = np.full(len(head), np.nan)
        sc = got.copy()
        got[crop[at[best]]], sc[crop[at[best]]] = value[best], score[best]
        give = np.flatnonzero(~np.isnan(sc) | (ones > 0))
        first = pa.array(head[give])
        return pa.RecordBatch.from_arrays([
            *(b.column(j).take(first) for j in range(n_keys)),
            pa.array(got[give], pa.float64(), from_pandas=True).cast(pa.int32()), pa.array(sc[give], pa.float64(), from_pandas=True),
            pa.array(ones[give], pa.int64())], names=out.names)

    return t.mapInArrow(read, out)
