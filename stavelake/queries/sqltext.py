"""Small DuckDB expression builders shared by the oracle texts."""

from __future__ import annotations


def rint(x: str) -> str:
    return f"CAST(round_even(CAST({x} AS DOUBLE),0) AS INT)"


def trunc(x: str) -> str:
    return f"CAST(trunc({x}) AS INT)"


def expand(p: str = "", s: str = "") -> tuple[str, str, str, str]:
    """Padded box of columns {p}x1{s} … as four expressions (ordered input)."""
    x1, y1, x2, y2 = (f"{p}{c}{s}" for c in ("x1", "y1", "x2", "y2"))
    half = f"greatest(greatest(1,{x2}-{x1})/2e0,6e0)"
    a = f"greatest(0,{rint(f'({x1}+{x2})/2e0-{half}')}-3)"
    c = f"({rint(f'({x1}+{x2})/2e0+{half}')}+3)"
    b = f"greatest(0,{y1}-3)"
    d = f"({y2}+3)"
    return a, b, f"greatest({c},{a}+1)", f"greatest({d},{b}+1)"


def expand_cols(prefix: str, p: str = "", s: str = "") -> str:
    return ", ".join(f"{e} {prefix}{n}" for e, n in zip(expand(p, s), ("x1", "y1", "x2", "y2")))


def iou(a: str, b: str) -> str:
    """IoU of already padded boxes with column prefixes ``a`` and ``b``."""
    iw = f"greatest(least({a}x2,{b}x2)-greatest({a}x1,{b}x1),0)"
    ih = f"greatest(least({a}y2,{b}y2)-greatest({a}y1,{b}y1),0)"
    area = lambda q: f"greatest({q}x2-{q}x1,0)*greatest({q}y2-{q}y1,0)"
    return f"(({iw}*{ih})/CAST(({area(a)}+{area(b)}-{iw}*{ih}) AS DOUBLE))"


def overlap_max(ay1: str, ay2: str, by1: str, by2: str) -> str:
    o = f"(least({ay2},{by2})-greatest({ay1},{by1}))"
    return (f"CASE WHEN {o}<=0 THEN 0e0 ELSE {o}/CAST(greatest({ay2}-{ay1},{by2}-{by1},1) AS DOUBLE) END")
