import pytest
from pyspark.sql import functions as F

LONG = "It rains in spring and the river runs over its banks, so the town moves its market to the hill above it. " * 3000


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text) with nulls, empty and very long texts, ties, repeated rows and near copies."""
    words = [f"w{i}" for i in range(60)]
    base = " ".join(words)
    near = " ".join([*words[:57], "changed", *words[58:]])
    out = [(1, base), (2, near), (3, "A short one."), (4, "a SHORT one."), (5, None), (6, ""), (7, " \n\t "), (8, LONG), (9, LONG + " end"),
           (10, base), (11, base), (11, base), (None, "No id, mail me at jo.doe@mail.example.org or +1 (212) 555-0187."), (None, None),
           (12, "Écoute: «naïve» 東京 😀 <|endoftext|> it's 3.14 ½ Σ ς"), (13, "x"), (2**60 + 1, "a large id"), (14, "same same " * 40), (15, "\x1c odd\x1d space　here\x85")]
    return out + [(20 + i, f"{base} tail {i} " + " ".join(f"u{i}x{k}" for k in range(i))) for i in range(12)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with further columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in "lang source kept row node n size block ids key digest bucket n_tokens group_size keep_id _found _entities label word".split():
        df = df.withColumn(name, F.lit(f"own {name}"))
    return df.repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
