"""Line-first cleaning: rules for each line, then documents that lose too much text are rejected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES

#: Phrases of page furniture; a line that holds one is boilerplate. Fixed values.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "log in to",
    "lorem ipsum", "privacy policy", "sign up for", "subscribe to", "terms of service", "terms of use",
)
WINDOW = 8


def line_fails(line: str) -> str:
    """SQL for the verdict on one line (a SQL name); lines are judged by their own words alone."""
    words = f"array_remove(split({line}, r'{SPACES}'), '')"
    bare = f"regexp_replace({line}, r'[^#*$%&|<>]+', '')"
    phrases = "|".join(BOILERPLATE)
    return f"""(
        (size({words}) >= 3 AND length({bare}) * 4 >= size({words}) AND length({bare}) >= 2)
        OR {line} rlike '\\\\|[^|]*\\\\|'
        OR length(regexp_replace({line}, '[^!?]+', '')) * 2 > size({words}) + 2
        OR (length(regexp_replace({line}, r'[^\\p{{Lu}}]+', '')) * 2 > length(regexp_replace({line}, r'[^\\p{{L}}]+', ''))
            AND size({words}) >= 5)
        OR (size({words}) >= 8 AND size(array_distinct({words})) * 3 < size({words}))
        OR lower({line}) rlike '{phrases}'
    )"""


def clean_lines(docs: DataFrame, max_lost: float = 0.3, min_words: int = 20, max_repeat: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, text statistics, base_failed, kept, lost_chars, clean_text.

    Statistics: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. A line with a
    word fails for many symbols, menu bars, exclamation runs, capitals, few different words
    or page furniture. ``clean_text`` joins the lines that pass; a document is kept unless
    its base rules fail or more than ``max_lost`` of its characters were on failed lines.
    A null or empty text has no words and so fails; repeated rows are judged alike; an
    empty table gives an empty result; other columns are ignored. Windows are compared by
    a 64-bit hash of their words within one document.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    d = d.withColumn("w", F.expr(f"array_remove(split(t, r'{SPACES}'), '')"))
    d = d.withColumn("n", F.size("w"))
    d = d.withColumn("lines", F.expr(r"filter(split(t, '\n'), x -> x rlike r'[^\x20\x09-\x0D]')"))
    d = d.withColumn("h", F.expr(
        f"if(n >= {WINDOW}, transform(sequence(1, greatest(1, n - {WINDOW - 1})), i -> xxhash64(slice(w, i, {WINDOW}))), array())"))
    d = d.withColumn("again", F.expr("size(array_distinct(h)) < size(h)"))
    # windows found twice stand next to each other once sorted; only documents that have some are sorted
    d = d.withColumn("s", F.expr("if(again, sort_array(transform(h, (x, i) -> struct(x AS x, i AS i))), NULL)"))
    d = d.withColumn("at", F.expr(
        "sort_array(transform(filter(transform(s, (e, j) -> struct(e.i AS i, "
        "coalesce(e.x = get(s, j - 1).x, false) OR coalesce(e.x = get(s, j + 1).x, false) AS twice)), e -> e.twice), e -> e.i))"))
    covered = F.expr(
        f"coalesce(aggregate(at, struct(-{WINDOW} AS last, 0L AS c), "
        f"(a, p) -> struct(p AS last, a.c + least({WINDOW}, p - a.last) AS c), a -> a.c), 0L)")
    d = d.withColumn("good", F.expr(f"filter(lines, x -> NOT {line_fails('x')})"))
    chars = lambda c: F.length(F.array_join(c, ""))
    d = d.select(
        "doc_id", F.col("n").cast("long").alias("n_words"), chars("w").cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        chars("lines").cast("long").alias("line_chars"), (chars("lines") - chars("good")).cast("long").alias("lost_chars"),
        F.array_join("good", "\n").alias("clean_text"))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    d = d.withColumn("base_failed", failed)
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= max_lost * F.col("line_chars")))
