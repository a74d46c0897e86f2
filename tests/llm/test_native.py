"""Sharding, line rules and mixing against plain Python on every row."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stavelake.llm import lines, mixing, sharding

from .conftest import make_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_shards_are_even_and_gapless_and_keep_groups(docs, rows):
    out = sharding.balanced_shards(docs, 6).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    sizes = [len(by[s]) for s in range(6)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    assert len({r.shard for r in out if r.doc_id in (143, 144)}) == 1  # equal texts stay together
    hot = Counter(r.shard for r in out if r.doc_id is not None and 60 <= r.doc_id < 100)
    assert len(hot) <= 3  # forty copies fill a shard of 21 and what remains


def test_shards_agree_on_reruns_and_take_empty_tables(docs, no_docs):
    key = lambda df: sorted(map(str, sharding.balanced_shards(df, 5).collect()))
    assert key(docs) == key(docs)
    assert key(no_docs) == []


@pytest.mark.parametrize("n_shards", [1, 24, 300])
def test_any_number_of_shards(docs, rows, n_shards):
    sizes = Counter(r.shard for r in sharding.balanced_shards(docs, n_shards).collect())
    assert sum(sizes.values()) == len(rows) and max(sizes.values()) - (min(sizes.values()) if len(sizes) == n_shards else 0) <= 1


def counts(text):
    text = text or ""
    w, at = WORD.findall(text), defaultdict(list)
    for k in range(len(w) - 7):
        at[tuple(w[k : k + 8])].append(k)
    covered = {p + j for places in at.values() if len(places) > 1 for p in places for j in range(8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(covered), failed


def test_line_statistics(spark, rows, no_docs):
    extra = [(200, "a b c d e f g h " * 9, "x"), (201, "one line here\n" * 30, "x"), (202, "é ö ü # $%\x0bx\x0cy", "x"),
             (203, "\n".join(f"Home {i} | About | Contact | Jobs" for i in range(12)) + "\nA good last line of words.", "x"),
             (204, "Plain words stand in this text, and nothing is wrong with them; they go on for a while, until they end here.", "x")]
    df = make_docs(spark, rows + extra)
    out = defaultdict(list)
    for r in lines.clean_lines(df).collect():
        out[r.doc_id].append(r)
    for i, t, _ in rows + extra:
        want = counts(t)
        assert any((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want for r in out[i])
    assert not out[203][0].base_failed and not out[203][0].kept and out[204][0].kept
    assert out[203][0].clean_text == "A good last line of words."
    assert lines.clean_lines(no_docs).count() == 0


def fill(sizes, total):
    """Targets by giving out the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while True:
        left = total - sum(3 * sizes[s] for s in names if s not in open_)
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not above:
            return {s: share.get(s, 3 * sizes[s]) for s in names}
        open_ -= above


def test_mix_meets_targets(docs, rows, no_docs):
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    target = fill(dict(sizes), sum(sizes.values()))
    taken, largest = Counter(), Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(no_docs).count() == 0


def test_copies_are_rows(docs):
    mixed = mixing.mix(docs)
    want = Counter()
    for r in mixed.collect():
        if r.doc_id is not None and r.doc_id != 3:
            want[r.doc_id] += r.copies
    got = Counter(r.doc_id for r in mixing.take_copies(docs, mixed).select("doc_id").collect() if r.doc_id is not None and r.doc_id != 3)
    assert got == +want


def test_sources_without_words(spark):
    df = make_docs(spark, [(1, "", "a"), (2, None, "a"), (3, "x y z", "b")])
    assert sorted((r.doc_id, r.target, r.taken) for r in mixing.mix(df).collect()) == [(1, 0.0, 0), (2, 0.0, 0), (3, 3.0, 3)]


def test_copies_keep_columns_of_any_name(spark):
    df = make_docs(spark, [(1, "a b c", "a"), (None, "d e", None), (2, "f", "b")]).withColumns(
        {c: F.lit(7) for c in ("_n", "_k", "_id", "_size", "_source", "row", "n", "d", "z")})
    out = mixing.take_copies(df, mixing.mix(df))
    assert out.columns == df.columns
    assert all(r["_k"] == 7 and r["n"] == 7 for r in out.collect())


def test_rows_without_an_id_draw_for_themselves(spark):
    rows = [(None, "same words here", "a")] * 400 + [(None, None, "a")] * 200 + [(k, "x " * 9, "b") for k in range(90)]
    df = make_docs(spark, rows).repartition(3)
    out = mixing.mix(df).collect()
    taken = sum(r.taken for r in out if r.source == "a")
    target = next(r.target for r in out if r.source == "a")
    assert len(out) == len(rows) and abs(taken - target) <= 3
    shards = sharding.balanced_shards(df, 24).groupBy("shard").count().collect()
    assert max(r["count"] for r in shards) - min(r["count"] for r in shards) <= 1
