"""Small tables for the operators' tests."""

import random

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

SYLLABLES = ("the", "on", "ing", "re", "ate", "ly", "con", "is", "un", "ver")


def docs(spark, rows, partitions=3):
    full = [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(partitions)


def prose(rng, n, vocabulary=400):
    word = lambda k: "".join(SYLLABLES[int(c)] for c in str(k))
    return " ".join(word(rng.randrange(vocabulary)) + rng.choice(["", "", ".", ","]) for _ in range(n))


def varied(rng, n, vocabulary=4000):
    """Like `prose`, of hundreds of syllables: its tokens are as many and as mixed as a language's."""
    onsets, vowels, codas = "b c d f g h j l m n p r s t v st pl tr".split(), "a e i o u ea ou".split(), ["", "n", "r", "s", "t", "l"]

    def word(k):
        own = random.Random(k)
        return "".join(own.choice(onsets) + own.choice(vowels) + own.choice(codas) for _ in range(own.randrange(1, 4)))

    return " ".join(word(int(vocabulary * rng.random() ** 2)) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def corpus(seed=1, n=60, words_of=prose):
    """(id, text) with copies, near copies, shared passages, white space of all kinds, empty, null and long texts."""
    rng = random.Random(seed)
    passage = words_of(rng, 35)
    rows = []
    for i in range(n):
        kind = rng.randrange(9)
        text = words_of(rng, rng.randrange(1, 160))
        if kind == 0 and rows:
            text = rng.choice(rows)[1] or ""
        elif kind == 1 and rows:
            words = (rng.choice(rows)[1] or "a b").split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif kind == 2:
            text = text + "\n" + passage + "\t" + text[:50]
        elif kind == 3:
            text = text.replace(" ", rng.choice(["  ", "\t", "\r\n", "\x0b", "\x0c "]))
        elif kind == 4:
            text = rng.choice(["", " ", "\n\n", "one", "two words", "É è 漢字 \u00a0 \U0001f600", "no\u2003break \x1c here", "\x00 nul"])
        elif kind == 5:
            text = text + " " + text
        rows.append((i * 3 + 1, text))
    rows.append((n * 3 + 1, None))
    rows.append((n * 3 + 2, words_of(rng, 6000)))
    rows.append((n * 3 + 3, "x" * 30_000))
    rows.append((n * 3 + 4, "a " * 3000))
    return rows


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}
