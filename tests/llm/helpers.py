"""Fixture rows that hit the awkward cases of every text operator."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split())
                    + str(rng.randrange(40)) for _ in range(n))


def awkward_rows():
    """Null text, empty text, null id, repeated rows, repeated id, odd white space, one very long text."""
    rng = random.Random(4)
    base = words(rng, 120)
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, base), (4, base), (4, base), (5, base.upper()), (5, "other text"),
            (6, base.replace("alpha", "omega", 1)), (7, "one"), (8, "one"), (9, "two words"), (None, base), (None, None),
            (10, "tabs\tand  double   spaces \n\n lines\r\n end "), (11, words(rng, 60_000)), (12, "x" * 200_000),
            (13, "naïve café über ñandú éclair 漢字かな \U0001f600 end"), (14, "don't we'll I'm they've"), (15, "a" * 7)]
    rows += [(100 + i, words(rng, rng.randrange(1, 90))) for i in range(40)]
    return [(i, t, "en" if k % 2 else None, f"src{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
