import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                     # extra columns whose names the operators use themselves
                     T.StructField("k1", T.StringType()), T.StructField("size", T.StringType()), T.StructField("row", T.StringType())])


@pytest.fixture
def make(spark):
    """A documents table from (doc_id, text[, lang, source]) rows, with clashing extra columns."""
    def of(rows):
        full = [(*r, *([None] * (4 - len(r)))) for r in rows]
        return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, "x", "y", "z") for r in full], DOCS)

    return of


@pytest.fixture
def prose():
    """Deterministic invented words."""
    import random

    r = random.Random(5)
    syllables = ["the", "an", "tion", "er", "wh", "re", "and", "ou", "ing", "st", "é", "sh"]

    def words(n, seed=None):
        q = random.Random(seed) if seed is not None else r
        return [" ".join([]) + "".join(q.choice(syllables) for _ in range(q.randint(1, 4))) for _ in range(n)]

    return words
