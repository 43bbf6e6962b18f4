import random

import pytest

WORDS = "ba co du fe gi lo mu na pe ri so tu va we xi yo the of and to in is der die und le la de el que".split()


def prose(rng, n):
    return " ".join("".join(rng.choices(WORDS, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with every awkward case: null and empty texts, null ids, repeated rows, a very long text, near copies."""
    rng = random.Random(3)
    out = []
    for i in range(60):
        text = prose(rng, rng.randint(20, 300))
        out.append((i, text, rng.choice(("en", "de")), f"s{i % 3}"))
    base = out[5][1]
    out += [(100 + k, base, "en", "s0") for k in range(8)]
    out += [(120 + k, base + f" extra{k}", "en", "s0") for k in range(4)]
    out += [(200, None, "en", None), (201, "", None, "s1"), (202, " \n\t ", "de", "s1"), (203, "one", "en", "s1"), (204, "one two", "en", "s1"), (None, "a null id " * 30, "en", "s1"), (None, None, None, None)]
    out += [(205, prose(rng, 60_000), "en", "s2"), (206, "x" * 200_000, "en", "s2"), (7, out[7][1], "en", "s1"), (7, out[7][1], "en", "s1")]
    out += [(207, "Über ÉCOLE don't <|endoftext|> ﬁ ½ 日本 🙂 \x00 \x85 \x1c z", "de", "s2"), (208, "line one\nline one\nLINE two\n\nline one", "en", "s2")]
    return out


#: Columns whose names the operators use inside.
CLASHES = "mark tile chunk theirs tokens rate p copies score predicted toxicity kept quality words lines part text_hash text_key bin_group start length sequence_id rows tox label in_0 domain doc".split()


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, 1 - i % 4 // 3, int(i % 5 == 0)) for i in range(60)] + [(None, 1, 1), (3, None, None), (5, 1, 1), (9999, 1, 1)], "doc_id long, quality int, toxic int")
