import random

import pytest
from pyspark.sql import types as T

WORDS = ["the", "of", "and", "thing", "ouren", "lower", "Ente", "erst", "haor", "tion", "blend", "naïve", "ñandú"]
DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    # Names that the operators use inside.
    T.StructField("size", T.StringType()), T.StructField("kid", T.StringType()),
    T.StructField("node", T.StringType()), T.StructField("score", T.StringType()),
])


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "er", "ing", "s"]) + str(rng.randrange(40)) for _ in range(n))


def edge_rows():
    """Nulls, empty and long texts, copies, near copies, shared passages, ties and repeated rows."""
    rng = random.Random(5)
    base, passage = prose(rng, 300), prose(rng, 60)
    rows = [(None, base), (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One"), (6, prose(rng, 34)),
            (7, base), (8, base.replace(" ", "\n\n")), (9, base), (9, base), (9, "other text of id nine"),
            (10, prose(rng, 20000)), (11, "\u0085wide space stays\u001c"), (12, None), (None, None)]
    words = base.split()
    for i in range(20, 60):  # near copies of growing distance
        copy = list(words)
        for place in rng.sample(range(len(copy)), i - 20):
            copy[place] = f"x{i}y{place}"
        rows.append((i, " ".join(copy)))
    for i in range(60, 90):
        rows.append((i, prose(rng, rng.randrange(1, 80)) + " " + passage + "\n" + prose(rng, rng.randrange(1, 80))))
    rows += [(i, prose(rng, rng.randrange(1, 120))) for i in range(90, 140)]
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["b", "a", "ä", None]), "z", "k", "n", "s") for i, t in rows]


@pytest.fixture(scope="session")
def rows():
    return edge_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCUMENT).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENT)
