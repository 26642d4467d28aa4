import random

import pytest

WORDS = "ba be bi bo bu da de di do du fa fe fi fo fu ga ge gi go gu".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices(WORDS, k=r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with each hard case: null, empty, blank, one word, copies, near copies, a shared passage, a long one."""
    base, passage = prose(120, 1), prose(60, 2)
    edited = base.split()
    edited[60] = "changed"
    out = [None, "", "  \n ", "One", base, base, base.upper(), " ".join(edited), prose(80, 3) + " " + passage + " " + prose(70, 4), passage + ". " + prose(50, 5)]
    out += [prose(40, s) for s in range(10, 22)] + ["x y " * 3_000, prose(4_000, 30), "É é ß İ " * 10, "a b c d e f g h i j"]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """documents with clashing extra columns, a repeated row and a null id."""
    rows = [(i, t, "en" if i % 2 else None, None, -1, 7, "x") for i, t in enumerate(texts)]
    rows += [rows[8], (None, "no id here", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score long, spans string").repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
