import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
# Names that operators use inside, to be carried or ignored without harm.
CLASHING = ("_x", "_key", "_id", "n", "score", "spans", "base", "tokens", "epoch", "kept", "bucket", "words", "_c", "doc", "place", "p")


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts (ids from 0) or (id, text) pairs."""
    def build(texts, clash=False):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame([(i, t, "en", "s1", len(t or "")) for i, t in rows], DOCS)
        if clash:
            from pyspark.sql import functions as F

            for c in CLASHING:
                df = df.withColumn(c, F.lit("other"))
        return df

    return build


PROSE = ("The river runs past the old mill and the children watch it from the bridge. Nobody knows how deep the water is below the wheel. "
         "In summer the miller sells bread to travellers who rest under the trees, and in winter he mends his nets by the fire. "
         "Once a year a fair is held on the meadow with music, dancing and long tables full of food for everyone who comes. ")


@pytest.fixture(scope="session")
def prose():
    return PROSE


@pytest.fixture(scope="session")
def odd(prose):
    """Null, empty and blank texts, ties, repeated rows and a very long text."""
    return [(0, None), (1, ""), (2, " \n\t "), (3, prose), (4, prose), (4, prose), (5, "x"), (6, prose * 400), (7, "é" * 500 + "\U0001F600"), (None, prose)]


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.01"
