import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = "the of and was then over under light water stone river cold winter summer morning evening road house garden letter number twelve".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", ".\n"])[:2] for _ in range(n))


def odd_rows(seed=5):
    """Copies, near copies, shared passages, nulls, blanks, very long and repeated rows."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(25, 120)) for _ in range(12)]
    passage = prose(rng, 60)
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None])) for i, t in enumerate(base)]
    rows += [(20, base[0], "en", "a"), (21, base[0], "en", "a"), (22, base[1] + " tail", "en", "a")]
    words = base[2].split(" ")
    rows += [(23, " ".join(words[:-2] + ["other"] + words[-1:]), "en", "b"), (24, prose(rng, 30) + " " + passage + " " + prose(rng, 30), "de", "b"), (25, passage + " end", "de", "b")]
    rows += [(30, None, "en", "a"), (31, "", "en", "a"), (32, " \n\t ", None, None), (33, "one", "en", "a"), (34, "one two", "en", "a"), (36, "an <|endoftext|> within", "en", "a"), (35, "é ñ ü 漢字 \U0001f600 ", "fr", "c")]
    rows += [(40, "a" * 30_000, "en", "a"), (41, prose(rng, 9000), "en", "a"), (42, "x " * 5000, "en", "a")]
    rows += [(50, base[3], "en", "a"), (50, base[3], "en", "a"), (50, base[4], "en", "a"), (None, base[5], "en", "a"), (None, None, None, None), (-1, base[6], "en", "a")]
    return rows


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])


@pytest.fixture(scope="session")
def odd(spark):
    return odd_rows()


@pytest.fixture(scope="session")
def docs(spark, odd):
    """The odd rows with further columns whose names the operators use themselves."""
    plain = spark.createDataFrame(odd, SCHEMA).repartition(3)
    return plain.withColumns({c: F.lit("x") for c in ("n_words", "kept", "score", "batch", "data", "bucket", "keys", "extra", "class", "component_id", "h", "d2", "cut", "piece")})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
