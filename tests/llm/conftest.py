"""Small tables for the text-corpus operators."""

import random

import pytest


@pytest.fixture(scope="session")
def vocabulary():
    rng = random.Random(7)
    parts = "ba ce di fo gu ha je ki lo mu na pe ri so tu va".split()
    return ["".join(rng.choice(parts) for _ in range(rng.choice((2, 2, 3)))) for _ in range(600)]


@pytest.fixture(scope="session")
def texts(vocabulary):
    """Texts with exact and near copies, a common passage, odd white space, nulls, blanks and a long one."""
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    common = prose(30)
    out = [prose(rng.randint(60, 160)) for _ in range(40)]
    out += [out[0], out[1], out[1].upper(), "  " + out[2].replace(" ", "\n\t") + "\n"]
    for i in range(12):  # near copies of one text
        w = out[3].split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(" ".join(w))
    out += [f"{prose(rng.randint(5, 40))} {common} {prose(rng.randint(5, 40))}" for _ in range(15)]
    out += [None, None, "", "   \n", "one", "one two", "one two", "Größe señor été " * 12, prose(5000), "x" * 49, "y" * 200, "y" * 120, "é" * 60]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Rows with an id that is null, two equal rows, and columns whose names an operator may use itself."""
    rows = [(i * 3 % 101, t, "en", f"src{i % 3}", len(t or ""), i, "x") for i, t in enumerate(texts)]
    rows += [rows[5], (None, texts[4], None, None, None, None, None)]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, kind string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
