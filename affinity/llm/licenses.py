"""License scan by a positional index of rare words. DataFrame and SQL functions only.

The index holds each template's ``INDEX_WORDS`` words of highest inverse document frequency over all
scanned texts, with their positions. Words of a text that the index knows are joined with its postings
and meet where text position minus template position agrees; a template with enough words at one
such offset is accepted if one of its mandatory key phrases stands at that offset, give or take
``DRIFT`` words.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.session import written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
INDEX_WORDS = 6
DRIFT = 2

# Phrases that label a text wherever their words stand in a row.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Label, words of a usual notice, phrases of which one must be there.
TEMPLATES = [
    ("agpl", "licensed under the gnu affero general public license version 3", ["affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     ["redistribution and use in source and binary forms"]),
    ("bsd", "released under the bsd license", ["bsd license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license",
     ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license",
     ["creative commons attribution sharealike"]),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ["cc0 1 0"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee "
     "is hereby granted", ["with or without fee is hereby granted"]),
    ("lgpl", "licensed under the gnu lesser general public license version 3", ["lesser general public license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
     ["permission is hereby granted free of charge"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ["free and unencumbered software"]),
]


def _starts(words: Column, phrase: str) -> Column:
    """Positions, from 0, where the phrase's words stand in a row."""
    wanted = phrase.split()

    def hit(word, at):
        return F.when(reduce(
            lambda a, b: a & b, [word == wanted[0]] + [F.get(words, at + n) == w for n, w in enumerate(wanted) if n]), at)

    found = F.filter(F.transform(words, hit), lambda x: x.isNotNull())
    return F.when(F.array_contains(words, max(wanted, key=len)), found).otherwise(
        F.array().cast("array<int>"))


def _literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def rare_word_index(words: DataFrame) -> list[tuple[str, int, int, int]]:
    """(word, template, position, index words of the template) over all rows of (words).

    Only counts of template words, fewer than two hundred, come to the driver."""
    vocabulary = sorted({w for _, notice, _ in TEMPLATES for w in notice.split()})
    seen = words.select(F.explode(F.array_intersect("words", _literals(vocabulary))).alias("word"))
    counts = {r["word"]: r["n"] for r in seen.groupBy("word").agg(F.count("*").alias("n")).collect()}
    postings = []
    for t, (_, notice, _) in enumerate(TEMPLATES):
        rare = sorted(set(notice.split()), key=lambda w: (counts.get(w, 0), w))[:INDEX_WORDS]
        places = [(w, t, n, len(rare)) for n, w in enumerate(notice.split()) if w in rare]
        postings += places
    return postings


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row for each row of documents (doc_id, text): doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score.

    ``n_base`` counts all places of the base phrases, ``first_word`` and ``last_word`` are the smallest and
    largest word number where one starts. ``labels`` adds the templates found by the index. ``score`` is 1
    with a base phrase, else the largest share of a template's index words found at one offset, else 0.
    Null and empty texts have no words and no labels. Repeated rows and null ids each give their row;
    other columns are ignored; an empty table gives no rows.
    """
    # A-Z of the pattern's words; signs outside ASCII meet no phrase or template in either case.
    words = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.regexp_extract_all(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))
        .alias("words"))
    postings = rare_word_index(words)
    index_words = sorted({p[0] for p in postings})
    spark = docs.sparkSession

    keys = sorted({(t, k) for t, (_, _, phrases) in enumerate(TEMPLATES) for k in phrases})
    base = F.struct(*[_starts(F.col("words"), p).alias(f"p{n}") for n, p in enumerate(PHRASES)])
    places = F.filter(
        F.transform("words", lambda w, at: F.struct(w.alias("word"), at.alias("at"))),
        lambda x: x["word"].isin(index_words))
    key_places = F.concat(*[_key_places(F.col("words"), t, phrase) for t, phrase in keys])
    none = "array<struct<template:int,offset:int>>"
    known = F.arrays_overlap("words", _literals(index_words))
    marked = written(
        words.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("bigint").alias("n_words"),
            base.alias("base"),
            F.when(known, places).otherwise(F.array().cast("array<struct<word:string,at:int>>")).alias("places"),
            F.when(known, key_places.cast(none)).otherwise(F.array().cast(none)).alias("keys")),
        "license-words")

    index = F.broadcast(spark.createDataFrame(postings, "word string, template int, position int, wanted int"))
    hits = marked.select("row", F.explode("places").alias("p")).select("row", "p.word", "p.at").join(index, "word")
    agreed = (
        hits.groupBy("row", "template", (F.col("at") - F.col("position")).alias("offset"))
        .agg(F.count_distinct("word").alias("n"), F.first("wanted").alias("wanted"))
        .filter("n >= least(wanted, 3)"))
    phrases = marked.select("row", F.explode("keys").alias("k")).select(
        "row", "k.template", F.col("k.offset").alias("at")).distinct()
    proved = agreed.join(phrases, ["row", "template"]).filter(f"abs(offset - at) <= {DRIFT}")
    names = F.broadcast(spark.createDataFrame(
        [(t, label) for t, (label, _, _) in enumerate(TEMPLATES)], "template int, label string"))
    found = proved.join(names, "template").groupBy("row").agg(
        F.collect_set("label").alias("found"), F.max(F.col("n") / F.col("wanted")).alias("share"))

    starts = F.concat(*[F.col(f"base.p{n}") for n in range(len(PHRASES))])
    labels = F.filter(F.array(*[
        F.when(F.size(f"base.p{n}") > 0, label) for n, label in enumerate(PHRASES.values())]), lambda x: x.isNotNull())
    all_labels = F.array_union(labels, F.coalesce("found", F.array().cast("array<string>")))
    return marked.join(found, "row", "left").select(
        "doc_id", "n_words", F.size(starts).cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"),
        F.array_max(starts).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(all_labels), ",").alias("labels"),
        F.when(F.size(starts) > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))


def _offset(template: int, phrase: str) -> int:
    """Where the phrase starts in its template's notice."""
    text, wanted = TEMPLATES[template][1].split(), phrase.split()
    return next(n for n in range(len(text)) if text[n:n + len(wanted)] == wanted)


def _key_places(words: Column, template: int, phrase: str) -> Column:
    """Where the notice would begin, for each place of the template's key phrase."""
    inside = _offset(template, phrase)
    return F.transform(_starts(words, phrase), lambda at: F.struct(
        F.lit(template).alias("template"), (at - inside).alias("offset")))


def base_sql() -> str:
    """DuckDB SQL of the base columns."""
    hits = []
    for phrase in PHRASES:
        wanted = phrase.split()
        test = " and ".join(f"words[i + {n + 1}] = '{w}'" for n, w in enumerate(wanted))
        hits.append(f"list_filter(range(len(words)), lambda i: {test})")
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = ", ".join(
        f"case when len(p{n}) > 0 then '{label}' end" for n, label in enumerate(PHRASES.values()))
    return f"""
        with w as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{letters.upper()}', '{letters}'),
                '{WORD}') as words from documents),
        p as (select doc_id, words, {', '.join(f'{h} as p{n}' for n, h in enumerate(hits))} from w),
        s as (select *, list_concat({', '.join(f'p{n}' for n in range(len(hits)))}) as starts from p)
        select doc_id, cast(len(words) as bigint) as n_words, cast(len(starts) as bigint) as n_base,
            cast(list_min(starts) as bigint) as first_word, cast(list_max(starts) as bigint) as last_word,
            array_to_string(list_sort(list_distinct(list_filter([{names}], lambda x: x is not null))), ',') as base_labels
        from s"""
