import random

import pytest

LONG = "lorem " * 3 + "x" * 5000 + " " + " ".join(f"w{i % 977}" for i in range(60_000))


def rows():
    """(doc_id, text, lang, source, n_chars, score, bucket): nulls, empties, a long text, ties, repeated rows and
    extra columns with names that operators use themselves."""
    rng = random.Random(5)
    vocab = [f"{a}{b}" for a in "bcdfgklm" for b in ("ab", "ere", "ion", "ost")]
    base = [" ".join(rng.choices(vocab, k=rng.randint(5, 120))) for _ in range(25)]
    out = []
    for i in range(120):
        t = base[i % 25].split()
        for _ in range(rng.choice((0, 0, 1, 2, 5))):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        if i % 7 == 0:
            t += base[3].split() + base[4].split()
        out.append((i, " ".join(t), "en", "a" if i % 3 else "b"))
    out += [(200, None, None, None), (201, "", "en", "c"), (202, " \t\n ", "en", None), (203, LONG, "en", "a"), (204, LONG, "en", "a"), (205, "One", "en", "a"), (206, "one", "en", "b"), (207, "Héllo wörld ẞtraße 😀 end", "de", "é")]
    out += [(208, base[0] + "\n" + base[0], "en", "b"), (209, base[1].upper(), "en", "b")]
    return [(*r, len(r[1] or ""), 0.5, i % 3) for i, r in enumerate(out)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size double, bucket int"


@pytest.fixture(scope="session")
def odd_rows():
    return rows()


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def repeated_docs(spark, odd_rows):
    """The same with repeated rows and null ids."""
    more = [odd_rows[3], odd_rows[3], odd_rows[121], (None, *odd_rows[5][1:]), (None, None, None, None, None, None, None), (None, "alone here", "en", "z", 1, 0.1, 1)]
    return spark.createDataFrame(odd_rows + more, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small_docs(spark, sf_small):
    return spark.read.parquet(f"{sf_small}/documents.parquet")
