"""Small documents with all the awkward cases."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("size", T.LongType()), T.StructField("key", T.StringType()), T.StructField("kept", T.BooleanType()), T.StructField("component_id", T.LongType())])

WORDS = [a + b for a in "ka to ri mu se lo pe na".split() for b in "ban dor fil gus hem jin kop lat".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=0):
    """(doc_id, text, lang, source) with copies, near copies, shared passages, nulls, odd and long texts."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(1, 120)) for _ in range(40)]
    base, passage = prose(rng, 80), prose(rng, 30)
    near = base.split()
    for i in range(8):
        near[i * 9] = "changed"
        texts.append(" ".join(near))
    texts += [base] * 6 + [f"{prose(rng, 20)} {passage} {prose(rng, 25)}" for _ in range(8)]
    texts += [None, "", " \t\n", "one", "one", "Two words", "two  WORDS", "a b c d", "a b c d e", "aaaa" * 60, "aaaa" * 60, "日本語の文章です。" * 30, "x" * 49, "x" * 50, "x" * 51, prose(rng, 4000), "123 456 %%% !!!", "é" * 60, "𝔘𝔫𝔦 " * 30, "mixed\x0bspace\x0cand\rtabs\tand\nlines here"]
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None, "hot", "hot", "hot"][i % 6]) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    """The rows as documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, lang, s, None if t is None else len(t), 7, "k", True, -1) for d, t, lang, s in rows], DOCS)
