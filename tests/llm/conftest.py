import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: With names that the operators use inside.
WIDE = SCHEMA + ", row long, r string, h long, _id long, text_hash long, n_words long, found string, chunk int"


def corpus(n=80, seed=5):
    """(doc_id, text, lang, source, n_chars) rows: prose, copies, repeats, nulls, empty and long texts."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeéñ", k=rng.randint(2, 7))) for _ in range(120)]
    line = lambda k: " ".join(rng.choice(words) for _ in range(k)).capitalize() + "."
    shared = [line(9) for _ in range(4)]
    texts = []
    for i in range(n):
        lines = [line(rng.randint(3, 14)) for _ in range(rng.randint(1, 8))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), shared[i // 7 % 4])
        texts.append("\n".join(lines))
    texts[5] = texts[6] = texts[7]
    texts[8] = texts[9] + " tail"
    texts[10] = "one two three four five " * 30
    texts[11:18] = [None, "", "   \n\t ", "word", "a\n\na\na \x0b b", "### $$$ %%% " * 20, " ".join(rng.choice(words) for _ in range(20000))]
    rows = [(i, t, "en", f"src{i % 12}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], rows[21], (None, texts[22], "fr", "src1", 0), (None, texts[22], "fr", "src1", 0), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def wide(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4, 5, "y", 6) for r in rows], WIDE)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
