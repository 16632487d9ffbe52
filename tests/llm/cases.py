"""Small tables with everything that may go wrong in one."""

import random

WORDS = ["alba", "berin", "cosu", "delm", "erta", "fonia", "gral", "hesto", "ilva", "jorm", "kelta", "lumo",
         "marn", "nesti", "orvo", "pral", "questa", "rilm", "sorna", "telvi"]


def prose(n: int, seed: int) -> list[str]:
    """``n`` invented words; the last sign is from the seed, so texts share few runs of words."""
    rng = random.Random(seed)
    return [rng.choice(WORDS) + rng.choice("abcdefghijklmnop") for _ in range(n)]


def changed(words: list[str], every: int) -> list[str]:
    return [w if (n + 1) % every else f"x{n}" for n, w in enumerate(words)]


def odd_documents(spark):
    """Nulls in any column, empty and long texts, repeated rows, columns with clashing names."""
    long = " ".join(prose(30_000, 1))
    rows = [
        (1, " ".join(prose(120, 2)), "en", "a", 700), (2, " ".join(prose(120, 2)), "en", "a", 700),
        (3, None, None, None, None), (4, "", "en", "a", 0), (5, " \t\n ", "en", None, 3),
        (6, "one two", "en", "a", 7), (7, "one two", "fr", "a", 7), (8, long, "de", "a", len(long)),
        (None, " ".join(prose(120, 2)), "en", "a", 700), (9, " ".join(prose(60, 3)), None, "b", None),
        (9, " ".join(prose(60, 3)), None, "b", None), (10, "ÄÖ ß 中文 !!! 123 👩‍👩‍👧", "de", "b", 20),
        (11, "Released under the MIT License.", "en", "b", 31),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("score", "label", "row", "gone", "word", "rep", "band", "words", "h", "at", "component"):
        docs = docs.selectExpr("*", f"'z' as {name}")
    return docs


def empty_documents(spark):
    return odd_documents(spark).limit(0)


def labels(spark, n: int = 40):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(1, n)] + [(None, 1, 1), (3, None, None), (5, 7, 7)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def benchmark(spark):
    rows = [(1, " ".join(prose(40, 50))), (2, "too short here"), (3, None), (None, " ".join(prose(20, 51))),
            (4, "")]
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "1 as h", "'z' as doc_id")


def embeddings(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [2.0, 0.0, 0.0]), (4, [0.0, 1.0, 0.5]), (5, None),
            (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 0.0]), (8, [float("nan"), 1.0, 0.0]), (9, []),
            (None, [1.0, 1.0, 1.0]), (10, [0.5, 0.5, 0.1]), (10, [0.5, 0.5, 0.1]), (11, [float("inf"), 1.0, 0.0]),
            (12, [-0.0, 1.0, 0.5]), (13, [1.0, 1.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "2 as ids")
