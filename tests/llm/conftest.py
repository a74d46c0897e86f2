import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, target double, n long, k int, t string, row string, size long, shard int"


def make_docs(spark, rows):
    """(doc_id, text, source) rows with columns whose names the operators use themselves."""
    full = [(i, t, "en", s, len(t or ""), 1.5, 7, 1, "x", "y", 3, 9) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Copies, near copies, shared passages, nulls, empties, a long text, repeated rows and a null id."""
    rng = random.Random(5)
    out = [(i, sentence(rng, rng.randrange(5, 120), 3000), f"s{i % 4}") for i in range(60)]
    base = sentence(rng, 150, 3000)
    out += [(60 + i, base, "hot") for i in range(40)]
    for i in range(12):
        words = base.split()
        words[rng.randrange(len(words))] = f"new{i}"
        out.append((110 + i, " ".join(words), "hot"))
    passage = sentence(rng, 60, 3000)
    out += [(130 + i, f"{sentence(rng, 30, 3000)} {passage} {sentence(rng, 30, 3000)}", None) for i in range(5)]
    out += [(140, None, "s1"), (141, "", None), (142, "   \n\t ", "s1"), (143, "two words", "s2"), (144, "two words", "s2"),
            (145, sentence(rng, 30_000, 9000), "s3"), (3, out[3][1], "s3"), (None, "no id here at all", "s2")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return make_docs(spark, rows)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
