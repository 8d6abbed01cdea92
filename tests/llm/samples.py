"""Small tables with the awkward cases that every operator has to bear."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use for themselves.
EXTRA = ("row", "words", "block", "key", "anchor", "n", "fold", "group", "size", "spans", "score", "license", "bucket")


def passages(seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randint(2, 9))) for _ in range(400)]
    return rng, lambda n: " ".join(rng.choice(words) for _ in range(n))


def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, near copies, shared passages and clashing columns."""
    rng, say = passages()
    shared, long = say(60), say(6000)
    texts = [None, "", " \n\t ", "12 34 !!", "word", "two words", "a b c d", "A B C D", "Größe ИМЯ 名前 été " + say(9)]
    texts += [shared + " " + say(30), say(25) + "\n" + shared + "\n" + say(10), shared, long, long + " end", long.upper()]
    for _ in range(6):
        base = say(80).split()
        for edits in (0, 0, 1, 2, 4, 12):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = "edit%d" % rng.randrange(99)
            texts.append(" ".join(copy))
    line = say(12)
    texts += ["\n".join([line] * 6), "\n".join(say(12) for _ in range(5)), "x " * 300, "no blank " * 2 + "y" * 3000]
    rows = [(i * 3 + 1, t, ("en", "de", None)[i % 3], ("a", None)[i % 2], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, say(40), "en", "a", 0), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in EXTRA:
        df = df.withColumn(name, F.lit(7))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(df, *columns):
    """Sorted rows of some columns, nulls first."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
