import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, range_id string, _at string"


def texts() -> list:
    """Whole texts with nulls, blanks, repeats, shared lines and one long text."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 7)))
    line = lambda n=12: " ".join(word() for _ in range(n))
    shared = [line(), line().upper(), "  " + line() + "\t"]
    out = [None, "", " \n\t ", "one", "a b c", "same text here and there", "same text here and there", "x\n\n\nx\nx"]
    for k in range(40):
        lines = [line(r.randint(3, 14)) for _ in range(r.randint(1, 9))]
        if k % 3 == 0:
            lines.insert(r.randint(0, len(lines)), shared[0])
        if k % 4 == 0:
            lines += [shared[1], shared[1].lower(), shared[2].strip() if k % 8 else shared[2]]
        if k % 5 == 0:
            lines += lines[:2]
        out.append("\n".join(lines))
    out.append(" ".join(word() for _ in range(6000)))
    out += [out[12]] * 3 + [out[13] + " tail", "### *** <b> | 100 % $", "don't we've they'll I'm <|endoftext|> 中文字 ١٢"]
    return out


@pytest.fixture(scope="session")
def texts_list():
    return texts()


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en", [None, "b", "a", "é"][i % 4], None if t is None else len(t), "x", "y") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
