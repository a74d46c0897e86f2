"""Search, license scans and conversation repair against brute force."""

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from stavelake.llm import conversations, licenses, search

from .conftest import make_docs, sentence

# ---- ranked search


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_search(docs, items, k):
    bags = [(i, Counter(re.findall(search.TERM, lower(t)))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, length = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(re.findall(search.TERM, lower(t)))
    out = []
    for item, terms in asked.items():
        rows = []
        for i, b, n in bags:
            m = 100 - 50 + (50 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m)) for t in terms if b[t])
            if s > 0:
                rows.append((-s, i is None, i))
        for r, (s, no_id, i) in enumerate(heapq.nsmallest(k, rows, key=lambda x: (x[0], x[1], x[2] or 0)), 1):
            out.append((item, r, i, -s))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def library():
    rng = random.Random(11)
    docs = [(i, sentence(rng, rng.randrange(1, 200), 300) + " Été-ß" * (i % 3)) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(80)]  # ties beyond the limit
    docs += [(2000, None), (2001, ""), (2002, " ,;"), (3, docs[3][1]), (None, docs[3][1]), (None, "w1 w2"), (2003, sentence(rng, 20_000, 4000)), (-5, docs[3][1])]
    items = [(j, sentence(rng, 12, 320)) for j in range(30)] + [(50, docs[3][1]), (51, None), (52, ""), (53, "nowhere else"), (None, "w1 W5"), (7, "W9 w10 été"), (54, "w1 w1 w1")]
    return docs, items


@pytest.mark.parametrize("k,pairs,docs_a_shard", [(50, 400_000, 1 << 16), (5, 150, 1100)])
def test_search_matches_brute_force(spark, library, monkeypatch, k, pairs, docs_a_shard):
    docs, items = library
    monkeypatch.setattr(search, "PAIRS_AT_ONCE", pairs)
    monkeypatch.setattr(search, "RANGE", 64)
    made = make_docs(spark, [(i, t, "s") for i, t in docs])
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id int, term int")
    found = search.rank_documents(made, asked, k)
    assert [f for f in found.dtypes] == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, found.collect()), key=str) == brute_search(docs, items, k)


def test_search_of_nothing(spark, no_docs):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.rank_documents(no_docs, items).collect() == []
    assert search.rank_documents(make_docs(spark, [(1, "a b", "s")]), items.filter("false")).collect() == []


def test_blocks_are_skipped_without_unpacking(monkeypatch):
    """Long documents behind many short ones cannot reach the score, and stay packed."""
    rng = np.random.default_rng(1)
    n = 20_000
    lengths = np.sort(rng.integers(5, 3000, n))
    doc = np.concatenate([np.arange(n), np.sort(rng.choice(n, 3000, False))])
    term = np.repeat([0, 1], [n, 3000])
    row = search.pack_shard(pd.Series(np.arange(n), dtype="Int64"), lengths, doc, term, np.ones(len(doc), np.int64))
    lists = [search.Postings(*x) for x in zip(row["dfs"], row["firsts"], row["most"], row["shortest"], row["gaps"], row["counts"])]
    share = (n, int(lengths.sum()))
    for p, w in zip(lists, (20, 1900)):
        p.ready(w, share)
    seen = []
    unpack = search.Postings.unpack
    monkeypatch.setattr(search.Postings, "unpack", lambda self, which: seen.append(len(self.first[which])) or unpack(self, which))
    m = search.norm(np.frombuffer(row["lengths"], "<i8"), *share)
    place, score = search.best_of_shard(lists, m, np.arange(n), np.zeros(n, bool), 50)
    whole = search.impact(20, np.ones(n, np.int64), m)
    whole[doc[n:]] += search.impact(1900, np.ones(3000, np.int64), m[doc[n:]])
    assert sorted(score)[::-1] == sorted(whole)[::-1][:50] and (whole[place] == score).all()
    assert sum(seen) < 0.5 * sum(len(p.first) for p in lists)


# ---- license scans


def brute_labels(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    base = [(i, x) for i in range(len(words)) for x, t in licenses.BASE if words[i : i + len(t.split())] == t.split()]
    joined = "".join(f" {w} " for w in words)
    m, labels = 0, set()
    for x, t in [*licenses.BASE, *licenses.WORDING]:
        if re.search(licenses.pattern(t), joined):
            labels.add(x)
            m = max(m, licenses.mandatory(t))
    at = [i for i, _ in base]
    return (len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), m / (m + 2))


def test_labels_match_brute_force(spark):
    rng = random.Random(3)
    parts = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "under the the mit license", "UNDER THE MIT", "licensed under CC-BY-NC-SA 4.0",
             "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0 (the \"License\")",
             "Copyright (c) 2020 A. Person. All rights reserved", "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1", "été license"]
    for _, t in licenses.WORDING:
        plain = re.sub(r"\{(\d+)-(\d+)\}", lambda x: " ".join(rng.choice(["x", "license", "the"]) for _ in range(rng.randrange(int(x[1]), int(x[2]) + 2))), t)
        parts += [re.sub(r"\[[^\]]*\]", "", plain), plain.replace("[", "").replace("]", "").upper(), plain.rsplit(" ", 1)[0]]
    rows = [(i, " ".join([sentence(rng, rng.randrange(4)), *(rng.choice(parts) for _ in range(rng.randrange(1, 5)))]), "s") for i in range(500)]
    rows += [(900, None, "s"), (901, "", "s"), (902, "...", "s"), (None, parts[0], "s"), (5, rows[5][1], "s"), (903, "under the mit license " * 3000, "s")]
    out = licenses.license_labels(make_docs(spark, rows))
    want = Counter((i, *brute_labels(t)) for i, t, _ in rows)
    assert Counter(map(tuple, out.collect())) == want
    assert licenses.license_labels(make_docs(spark, rows).filter("false")).collect() == []


def test_templates_are_checked():
    for bad in ("a [b", "a b]", "[a]", "{1-2} a", "a {3-1}", "a {x}"):
        with pytest.raises(ValueError):
            licenses.Automaton([bad])
    found = licenses.Automaton(["a [b [c]] {1-2} d"]).find("a b c x d a x d a b y y d a d".encode().split())
    assert found == [(0, 0, 4), (0, 5, 7), (0, 8, 12)]


# ---- conversation repair


def brute_conversation(rows):
    """Rows (turn, role, text) in order: faults, least cost and audit by going through all edit strings in order of cost."""
    seen, marks = set(), []
    for turn, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        marks.append("b" if not body else "d" if (role, text) in seen else "k" if body[-1] in ".!?" else "t")
        seen.add((role, text))
    illegal = sum((x[1][:1] + y[1][:1]) not in ("su", "ua", "au") for x, y in zip(rows, rows[1:]))
    fine = re.compile(r"(s?(ua)+)?\Z")
    heap, best = [(0, "", 0, "", ())], None
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if i == len(rows) and fine.match(roles):
            best = cost, audit, out
            break
        if len(roles) > 2 * len(rows) + 3 or not re.match(r"s?(ua)*u?\Z", roles):
            continue
        for r in "ua":
            heapq.heappush(heap, (cost + 2, audit + "I", i, roles + r, (*out, {"u": "user:", "a": "assistant:"}[r])))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, roles, out))
            if marks[i] in "kt":
                extra = marks[i] == "t"
                heapq.heappush(heap, (cost + extra, audit + "K", i + 1, roles + (role[:1] if role[:1] in tuple("sua") else "x"), (*out, f"{role}:{text}")))
                for r in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, roles + r[0], (*out, f"{r}:{text}")))
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(marks.count(x) for x in "bdt"), illegal, best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest())


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        word = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = word(role), word(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


TURNS = "conv_id long, turn long, role string, text string, key int, n int, part string, fault int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], TURNS)


def repaired(spark, rows):
    made = turns(spark, rows)
    return conversations.repair_conversations(conversations.damage(made), made)


def test_repair_matches_brute_force(spark):
    rng = random.Random(13)
    texts = ["One.", "Two!", "Three", "Four\n ", "", "  \n", "Five?", "Six. ", None, "Ünï。"]
    rows = []
    for c in range(350):
        role = rng.choice(["system", "user", "assistant"])
        for t in range(rng.randrange(1, 8)):
            if rng.random() < 0.8:
                role = {"system": "user", "user": "assistant", "assistant": "user"}.get(role, "user")
            else:
                role = rng.choice(["system", "user", "assistant", "tool", "", None, "unknown"])
            rows.append((c, t if rng.random() < 0.9 else None, role, rng.choice(texts) if rng.random() < 0.4 else f"Text {c} {t}" + rng.choice([".", ".", ""])))
    rows += rows[:40] + [(None, t, "user" if t % 2 == 0 else "assistant", f"no id {t}.") for t in range(5)]
    out = {r.conv_id: tuple(r)[1:] for r in repaired(spark, rows).collect()}
    want = {c: brute_conversation(own) for c, own in damaged(rows).items()}
    assert out == want
    assert any(w[6] == "" for w in want.values())


def test_a_conversation_that_holds_most_rows(spark):
    """Long runs and a long alternation, over several tasks; checked against the program row by row."""
    rows = [(1, t, "user" if t % 2 == 0 or 4000 <= t < 9000 else "assistant", f"text {t % 7000}" + "." * (t % 3 > 0)) for t in range(20_000)]
    rows += [(1, 50, "user", "the same.")] * 3000 + [(2, 0, "user", "Hm."), (3, 0, "user", None)]
    out = {r.conv_id: tuple(r)[1:] for r in repaired(spark, rows).collect()}
    own = damaged(rows)[1]
    seen, symbols = set(), []
    for _, role, text in own:
        symbols.append(role[0] + ("b" if not text.strip() else "d" if (role, text) in seen else "k" if text.rstrip()[-1] == "." else "t"))
        seen.add((role, text))
    left = [conversations.ENDS]
    for s in reversed(symbols):
        now = []
        for state in range(4):
            best = conversations.INF
            for mid in range(4):
                best = min([best, *(conversations.INSERTS[state][mid] + c + left[-1][t] for _, c, t in conversations.edits(s, mid))])
            now.append(best)
        left.append(tuple(now))
    left.reverse()
    state, audit, lines = 0, [], []
    for i in range(len(own) + 1):
        while True:
            options = [(e, t) for e, c, t in conversations.edits(symbols[i], state) if c + left[i + 1][t] == left[i][state]] if i < len(own) else []
            insert = conversations.INSERT + left[i][conversations.NEXT[state]] == left[i][state]
            if (options and options[0][0] == "D") or not insert:
                break
            audit.append("I")
            state = conversations.NEXT[state]
            lines.append(conversations.ROLE[state] + ":")
        if i < len(own):
            e, state = options[0]
            audit.append(e)
            if e != "D":
                lines.append((own[i][1] if e == "K" else conversations.ROLE[state]) + ":" + own[i][2])
    assert out[1][5] == left[0][0] and out[1][6] == "".join(audit)
    assert out[1][7] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert out[1][1:4] == tuple(sum(s[1] == f for s in symbols) for f in "bdt")


def test_powers_of_runs():
    for symbol in map("".join, itertools.product("suax", "btdk")):
        v = conversations.ENDS
        for n in range(1, 20):
            v = conversations.onto(conversations.power(symbol, 0), v)
            assert conversations.advance(symbol, n, conversations.ENDS) == v


def test_no_conversations(spark):
    assert repaired(spark, []).collect() == []
