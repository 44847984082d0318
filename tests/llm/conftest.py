import random

import pytest
from pyspark.sql import functions as F

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"


def corpus(seed: int = 0, n: int = 60):
    """(doc_id, text) with copies, near copies, shared lines and passages, nulls, empties, long texts and repeated rows."""
    r = random.Random(seed)
    vocabulary = ["the", "of", "Äpfel", "naïve", "x", "data", "rows", "hot", "日本", "b", "merge", "Sort", "quick", "lazy", "🙂", "dog", "it's", "a-b", "ran", "42"]
    text = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    shared = [text(30), LONG, "A line that many of the documents share, word for word"]
    docs = []
    for i in range(n):
        parts = [text(r.randint(1, 60)) for _ in range(r.randint(1, 4))]
        if r.random() < 0.5:
            parts.insert(r.randrange(len(parts) + 1), r.choice(shared))
        docs.append((i, "\n".join(parts)))
    base = text(80)
    docs += [(n, base), (n + 1, base), (n + 2, base + " tail"), (n + 3, "\t" + base.replace("the", "THE"))]
    docs += [(n + 4, None), (n + 5, ""), (n + 6, "   \n\t "), (n + 7, "one"), (n + 8, "ONE"), (n + 9, "two words"), (None, LONG + " " + LONG), (None, None)]
    docs += [(n + 10, " ".join([LONG] * 60)), (n + 11, ("ab" * 40 + " ") * 30), (n + 12, "z" * 3000), (n + 13, shared[2].upper()), (n + 13, shared[2].upper()), (3, docs[3][1]), (5, docs[7][1])]
    r.shuffle(docs)
    return docs


@pytest.fixture(scope="session")
def docs_list():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, docs_list):
    """The corpus with columns whose names operators use for their results."""
    rows = [(d, t, "en", 0.5, 7, "keep", [1]) for d, t in docs_list]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, n_lines long, kept string, ids array<int>").repartition(3)
    return df.withColumn("Nested", F.struct(F.lit(1).alias("a"), F.array(F.lit(2)).alias("b")))  # values that can't be null


@pytest.fixture(scope="session")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)
