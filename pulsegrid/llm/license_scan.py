"""License scans by a positional index of rare words.

How rare a licence word is, its inverse document frequency, is counted over all files. Every key phrase of a template
is posted under its two rarest words with their places in it. A file is looked up by those of its licence words that
are the rarest of some phrase: a word's place in the file less its place in the phrase is where the phrase would
begin; the beginnings that both words give are intersected and compared with the phrase word by word. A phrase that occurs has
both words at their places, so the look-up loses nothing. All of it happens inside the file's row: no shuffle but that of the counts
of at most a few hundred licence words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import ascii_lower

#: What stands between words, after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words within which the key phrases of a template follow its first.
SPAN = 400

# Phrases whose places are counted, and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Labels and the mandatory key phrases of public licences, in the order of their texts.
TEMPLATES = [
    ("mit", ["permission is hereby granted free of charge to any person obtaining a copy", "shall be included in all copies or substantial portions of the software"]),
    ("apache", ["licensed under the apache license version 2 0"]),
    ("apache", ["spdx license identifier apache 2 0"]),
    ("gpl", ["this program is free software you can redistribute it and or modify it", "under the terms of the gnu general public license"]),
    ("gpl", ["licensed under the gnu general public license"]),
    ("lgpl", ["gnu lesser general public license"]),
    ("agpl", ["gnu affero general public license"]),
    ("bsd", ["redistribution and use in source and binary forms with or without modification are permitted", "redistributions of source code must retain the above copyright notice"]),
    ("isc", ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"]),
    ("mpl", ["subject to the terms of the mozilla public license"]),
    ("cc-by", ["licensed under cc by 4 0"]),
    ("cc-by", ["creative commons attribution 4 0 international"]),
    ("cc-by-sa", ["licensed under cc by sa 4 0"]),
    ("cc-by-nc", ["licensed under cc by nc 4 0"]),
    ("cc-by-nc", ["creative commons attribution noncommercial 4 0 international"]),
    ("cc0", ["cc0 1 0 universal"]),
    ("unlicense", ["this is free and unencumbered software released into the public domain"]),
    ("zlib", ["in no event will the authors be held liable for any damages", "the origin of this software must not be misrepresented"]),
    ("boost", ["boost software license version 1 0"]),
    ("epl", ["eclipse public license"]),
]

PHRASES = list(dict.fromkeys([p for p, _ in BASE] + [p for _, ps in TEMPLATES for p in ps]))
VOCABULARY = sorted({w for p in PHRASES for w in p.split()})


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def _literal(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def document_frequencies(files: DataFrame, text_col: str = "text") -> dict[str, int]:
    """In how many files each licence word stands; a number for each word of the templates reaches the driver."""
    held = files.select(F.explode(F.array_intersect(words(F.col(text_col)), _literal(VOCABULARY))).alias("word"))
    return {r.word: r["count"] for r in held.groupBy("word").count().collect()}


def rarest(phrase: str, frequency: dict[str, int]) -> list[tuple[str, int]]:
    """The two rarest words of a phrase (of equally rare ones the lesser) and where each first stands in it."""
    parts = phrase.split()
    return [(w, parts.index(w)) for w in sorted(set(parts), key=lambda w: (frequency.get(w, 0), w))[:2]]


def _begins(all_words: Column, word: str, offset: int) -> Column:
    """Where a phrase would begin that has ``word`` at ``offset``, by the word's places."""
    return F.filter(F.transform(all_words, lambda x, i: F.when(x == word, i - offset)), lambda s: s >= 0)


def occurrences(all_words: Column, mine: Column, phrase: str, frequency: dict[str, int]) -> Column:
    """Where a phrase begins, in order: the look-up by its rarest words, then the comparison."""
    parts, anchors = phrase.split(), rarest(phrase, frequency)
    met = reduce(F.array_intersect, [_begins(all_words, w, o) for w, o in anchors])
    found = F.array_sort(F.filter(met, lambda s: F.slice(all_words, s + 1, len(parts)) == _literal(parts)))
    looked_up = reduce(lambda a, b: a & b, [F.array_contains(mine, w) for w, _ in anchors])
    return F.when(looked_up, found).otherwise(F.array().cast("array<int>"))


def _marked(places: Column, k: int) -> Column:
    return F.transform(places, lambda s: F.struct(s.alias("s"), F.lit(k).alias("k")))


def _in_order(places: list[Column]) -> Column:
    """Whether the phrases follow each other, all within SPAN words of the first, by one pass over their places in order."""
    if len(places) == 1:
        return F.size(places[0]) > 0
    marks = F.array_sort(F.concat(*[_marked(p, k) for k, p in enumerate(places)]))
    none = F.array(*[F.lit(None).cast("int") for _ in places])

    def step(first: Column, mark: Column) -> Column:
        # first[k]: the last beginning of phrase 0 after which phrases 1 to k have come
        return F.transform(first, lambda old, k: F.when(k != mark["k"], old).when(k == 0, mark["s"]).when(mark["s"] - F.get(first, k - 1) <= SPAN, F.get(first, k - 1)).otherwise(old))

    return F.aggregate(marks, none, step, lambda first: F.get(first, F.lit(len(places) - 1)).isNotNull())


def _joined(labels: list[tuple[Column, str]]) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(found, F.lit(label)) for found, label in labels]), lambda x: x.isNotNull()))), ",")


def scan(files: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_base, first_word, last_word, base_labels, labels, score)``, a row for each row of ``files``.

    Places of the base phrases are counted, and their smallest and largest beginning given (null without one). ``labels`` adds the templates all
    of whose key phrases stand in their order within SPAN words of the first. The score is 1 with a base phrase, else the greatest share of
    a template's key words whose phrases occur. Null texts are empty, rows are judged one by one whatever their ids, an empty table gives no
    rows, other columns are not looked at, and whole texts are read.
    """
    frequency = document_frequencies(files, text_col)
    rows = files.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    rows = rows.select("id", "w", F.array_intersect("w", _literal(VOCABULARY)).alias("mine"))
    names = {p: f"at{i}" for i, p in enumerate(PHRASES)}
    rows = rows.select("id", F.size("w").cast("long").alias("n_words"), *[occurrences(F.col("w"), F.col("mine"), p, frequency).alias(c) for p, c in names.items()])
    at = lambda p: F.col(names[p])
    base = F.concat(*[at(p) for p, _ in BASE])
    base_found = [(F.size(at(p)) > 0, label) for p, label in BASE]
    found = [(_in_order([at(p) for p in phrases]), label) for label, phrases in TEMPLATES]
    share = [sum((F.when(F.size(at(p)) > 0, len(p.split())).otherwise(0) for p in phrases), F.lit(0)) / sum(len(p.split()) for p in phrases) for _, phrases in TEMPLATES]
    return rows.select(
        F.col("id").alias(id_col), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base).cast("long").alias("first_word"), F.array_max(base).cast("long").alias("last_word"),
        _joined(base_found).alias("base_labels"), _joined(base_found + found).alias("labels"), F.when(F.size(base) > 0, 1.0).otherwise(F.greatest(*share)).cast("double").alias("score"),
    )


def _sql() -> str:
    names = {p: f"at{i}" for i, p in enumerate(PHRASES)}
    place = lambda p: f"CASE WHEN contains(s, ' {p} ') THEN [i FOR i IN range(0, len(w)) IF w[i + 1:i + {len(p.split())}] = {p.split()}] ELSE [] END AS {names[p]}"
    some = lambda p: f"len({names[p]}) > 0"

    def in_order(phrases: list[str]) -> str:
        if len(phrases) == 1:
            return some(phrases[0])
        first, second = (names[p] for p in phrases)
        return f"len([x FOR x IN {first} IF len([y FOR y IN {second} IF y > x AND y <= x + {SPAN}]) > 0]) > 0"

    joined = lambda found: "array_to_string(list_sort(list_distinct([x FOR x IN [" + ", ".join(f"CASE WHEN {f} THEN '{label}' END" for f, label in found) + "] IF x IS NOT NULL])), ',')"
    base_found, found = [(some(p), label) for p, label in BASE], [(in_order(ps), label) for label, ps in TEMPLATES]
    shares = ["(" + " + ".join(f"CASE WHEN {some(p)} THEN {len(p.split())} ELSE 0 END" for p in ps) + f") / {sum(len(p.split()) for p in ps)}.0::DOUBLE" for _, ps in TEMPLATES]
    return rf"""WITH l AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
j AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s FROM l), p AS (SELECT doc_id, len(w) AS n_words, {", ".join(map(place, PHRASES))} FROM j),
b AS (SELECT *, {" || ".join(names[p] for p, _ in BASE)} AS base FROM p)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(base) AS BIGINT) AS n_base, CAST(list_min(base) AS BIGINT) AS first_word, CAST(list_max(base) AS BIGINT) AS last_word, {joined(base_found)} AS base_labels, {joined(base_found + found)} AS labels,
CASE WHEN len(base) > 0 THEN 1.0::DOUBLE ELSE greatest({", ".join(shares)}) END AS score FROM b"""


#: A rendering of the same rules for DuckDB, which looks every phrase up without an index.
SQL = _sql()
