"""Column expressions over identifiers, OCR text and loosely typed payload fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark a text as an instruction or instrument label.
LABEL_WORDS = (
    "Viol", "Vc", "Cb", "Fl", "Ob", "Cl", "Fag", "Cor", "Tr", "Timp", "Pizz", "Arco",
    "Div", "Legni", "Solo", "Tutti", "con", "senza", "Allegro", "Adagio", "Andante",
    "Lento", "Presto", "Moderato",
)
LABEL_PATTERN = "(?i)(" + "|".join(LABEL_WORDS) + ")"


def split_composite_id(c: Column) -> Column:
    """``Score_page_001`` → struct(score, page); NULL for plain ids. Last marker wins."""
    hit = c.contains("_page_")
    # greedy first group = split at the last marker; (?s) keeps line breaks inside ids
    pat = "(?s)^(.*)_page_(.*)$"
    return F.when(
        hit,
        F.struct(
            F.regexp_extract(c, pat, 1).alias("score"),
            F.concat(F.lit("page_"), F.regexp_extract(c, pat, 2)).alias("page"),
        ),
    )


def staff_pair(c: Column) -> Column:
    """``(0,1)``, ``"[0,1]"`` or ``"0-1"`` → struct(upper, lower); NULL when malformed."""
    body = F.trim(F.regexp_replace(F.trim(c), r"^[\[\]()]+|[\[\]()]+$", ""))
    sep = F.when(body.contains(","), F.lit(",")).when(body.contains("-"), F.lit("-"))
    parts = F.split(body, sep)
    a = F.get(parts, 0).try_cast("int")
    b = F.get(parts, 1).try_cast("int")
    return F.when((F.size(parts) == 2) & a.isNotNull() & b.isNotNull(),
                  F.struct(a.alias("upper"), b.alias("lower")))


def connector_present(
    as_bool: Column, as_number: Column, left: Column, brace: Column, *densities: Column,
    threshold: float = 0.05,
) -> Column:
    """Evidence precedence: boolean, number, explicit key, brace key, any dense mask.

    All-NULL evidence with no density keys is "present = false": the caller keeps
    a missing row distinct from an absent connector.
    """
    dense = F.lit(False)
    for d in densities:
        dense = dense | F.coalesce(d >= threshold, F.lit(False))
    return F.coalesce(as_bool, as_number > 0, left, brace, dense)


def clean_ocr(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^[EP](\d)", "$1"), "[.,;]", "")


def has_label_word(c: Column) -> Column:
    return c.rlike(LABEL_PATTERN)


def numbers_in(text: Column) -> Column:
    """Digit runs of an OCR text; next to label words only runs not touching letters."""
    cleaned = clean_ocr(text)
    free = F.regexp_extract_all(cleaned, F.lit(r"(?<![A-Za-z])\d+(?![A-Za-z])"), F.lit(0))
    every = F.regexp_extract_all(cleaned, F.lit(r"\d+"), F.lit(0))
    return F.when(has_label_word(text), free).otherwise(every)


def number_score(value: Column, digits: Column, text: Column, b, img_w, img_h) -> Column:
    """Spatial plausibility of one number; NULL for values below 2."""
    cx = (b.x1 + b.x2) / F.lit(2.0)
    cy = (b.y1 + b.y2) / F.lit(2.0)
    dx = F.abs(cx - img_w / F.lit(2.0)) / img_w
    dy = F.abs(cy - img_h / F.lit(2.0)) / img_h
    h = (b.y2 - b.y1) / img_h
    after_equals = text.contains("=") & F.get(F.split(text, "="), 1).contains(digits)
    score = (
        F.lit(100.0)
        - dx * 200.0
        - dy * 100.0
        + F.when((h >= 0.4) & (h <= 0.95), 20.0).when(h < 0.3, -30.0).otherwise(0.0)
        - F.when(after_equals, 80.0).otherwise(0.0)
        - F.when(value > 100, 50.0).otherwise(0.0)
        - F.when((value > 20) & (img_w < 100), 200.0).otherwise(0.0)
    )
    return F.when(value >= 2, score)


def safe_name(c: Column) -> Column:
    """True for a file-name stem: non-blank, no separators or controls, ≤ 200 bytes."""
    return (
        c.isNotNull()
        & (F.trim(c) != "")
        & ~c.isin(".", "..")
        & ~c.rlike(r"[/\\\x00-\x1f\x7f]")
        & (F.octet_length(c) <= 200)
    )


def lenient_int(c: Column) -> Column:
    """Truncating integer coercion of a JSON scalar's text; NULL when impossible."""
    t = F.trim(c)
    whole = F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("int"))
    return F.coalesce(whole, F.when(t == "true", 1), F.when(t == "false", 0),
                      F.when(t.rlike(r"^[+-]?\d+\.\d*([eE][+-]?\d+)?$"),
                             t.try_cast("double").try_cast("int")))


def boundary_int(v: Column) -> Column:
    """Integer of a VARIANT: booleans rejected, ``3.0`` accepted, digit strings accepted."""
    kind = F.schema_of_variant(v)
    d = F.try_variant_get(v, "$", "double")
    s = F.trim(F.try_variant_get(v, "$", "string"))
    return (
        F.when(kind == "BOOLEAN", F.lit(None))
        .when(kind == "STRING", F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("bigint")))
        .when(d == F.floor(d), d.cast("bigint"))
    )


def contract_int(v: Column, minimum: int = 0) -> Column:
    """Integer of a VARIANT: only true integers at or above ``minimum``."""
    kind = F.schema_of_variant(v)
    n = F.try_variant_get(v, "$", "bigint")
    return F.when((kind == "BIGINT") & (n >= minimum), n)


def span_to_skip(span: Column) -> Column:
    """Multi-measure rest: one printed measure for ``span`` → ``span - 1`` skipped."""
    return F.when(span >= 1, span - 1)
