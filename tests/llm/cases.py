"""Small inputs that every operator must take: nulls, empty and long texts, repeats, clashing columns."""

import random

from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
ROWS = [
    (1, "alpha beta  gamma delta epsilon zeta eta theta iota kappa", "en", "s0", 5),
    (2, "alpha beta gamma\tdelta epsilon zeta eta theta iota kappa", "en", None, None),
    (3, None, "en", "s0", 1),
    (4, "", None, "s0", 0),
    (None, "lonely text without an id", "fr", "s1", 3),
    (None, None, None, None, None),
    (5, "été à la plage 日本語 😀 İ ﬁ ½ ￿ \u0000 end", "fr", "s1", 3),
    (6, "12 34 !!! ...", "de", "s1", 3),
    (7, LONG, "en", "s2", 9),
    (8, LONG + " tail", "en", "s2", 9),
    (9, " \n\t ", "en", "s2", 9),
    (1, "alpha beta  gamma delta epsilon zeta eta theta iota kappa", "en", "s0", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASHES = ["keep_id", "_digest", "_text", "score", "Score", "ids", "n_words", "hit_words", "item_ids", "_hash", "key", "unit", "rep", "where", "_n", "_id", "y", "part", "start"]


def odd_docs(spark, clashes=False):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHES) if c != "Score")) if clashes else df


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def random_texts(n, words=30, vocabulary=40, seed=0):
    """Texts over a small vocabulary, with copies and near copies among them."""
    r, out = random.Random(seed), []
    for _ in range(n):
        kind = r.random()
        if out and kind < 0.2:
            out.append(r.choice(out))
        elif out and kind < 0.6:
            t = r.choice(out).split(" ")
            for _ in range(r.randrange(1, 4)):
                t[r.randrange(len(t))] = f"v{r.randrange(vocabulary)}"
            out.append(" ".join(t))
        else:
            out.append(" ".join(f"v{r.randrange(vocabulary)}" for _ in range(r.randrange(1, words))))
    return out


def table(spark, texts, parts=5):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)


def same_rows(left, right):
    return sorted(map(repr, left)) == sorted(map(repr, right))
