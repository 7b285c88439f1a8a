"""Fixtures of the corpus operators' tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def documents(spark, texts, start=0, extra=False):
    rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts, start)]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:  # names that an operator might use itself
        from pyspark.sql import functions as F

        for c in ("n", "fp", "u", "v", "root", "norm", "group_size", "keep_id", "kept", "score", "prefix", "keep_row", "n_rows", "key", "shared", "text_sha256"):
            df = df.withColumn(c, F.lit("x"))
    return df


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def odd_texts():
    """Null, empty, blank, repeated, tied and very long texts."""
    long = prose(1, 60_000)
    return [None, "", " \t\n", "one", "one", "One two", "a  b\tc", "a b c", long, long + " end", "é ñ 漢字 \U0001f600 x", "\U0001f600" * 50, prose(2, 200), prose(2, 200), prose(2, 200) + " more", "<|endoftext|>"]
