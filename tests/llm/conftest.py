import random

import pytest

SCHEMA = "doc_id long, text string, row string, n_words string, bucket string, id string, word int"


def clashing(spark, rows):
    """Documents with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "r", "w", "b", "i", 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def docs_rows():
    """Nulls, empty and long texts, exact and near copies, shared lines, repeated rows and ids."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    words = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = "A shared line that Several documents hold, all of it"
    passage = words(50)
    rows = [(0, None), (1, ""), (2, " \t\n \r"), (3, "a"), (4, "a b"), (None, "no id " + words(60)), (None, None)]
    near = words(300).split()
    for i in range(10, 20):
        own = list(near)
        own[(i * 7) % 300] = f"changed{i}"
        rows.append((i, " ".join(own)))
    rows += [(i, words(80) + "\n" + (shared if i % 2 else f"  {shared.upper()}\t") + "\n" + words(20)) for i in range(20, 26)]
    rows += [(i, words(40) + " " + passage + " " + words(40)) for i in range(26, 32)]
    rows += [(40, "same text again"), (41, "same text again"), (42, words(20000)), (43, "x " * 90), (43, "x " * 90)]
    rows += [(44, "one\n\n\ntwo"), (45, "emoji 😀 \x1c odd\xa0space İstanbul ﬁ <|endoftext|> don't 12345")]
    rows += [(46, "!!! ### $$$ " * 30), (47, "A line of its own, twice in here\n" * 2)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    from fraudstream.llm.common import ARROW_CONF

    for key, value in ARROW_CONF.items():
        spark.conf.set(key, value)
    return clashing(spark, docs_rows).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return clashing(spark, [])
