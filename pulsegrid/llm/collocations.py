"""Phrase collocations by PrefixSpan-style growth of contiguous patterns.

The occurrences of a frequent word are projected: each is a pointer to the at most three words that follow it in its
piece, cut where a pair of neighbours is too rare to be in any frequent phrase. The pointers of one prefix go to one
task, which reads them in order and grows the prefix to the right depth-first: the pointers of a longer prefix are an
interval of those of the shorter. A prefix with more occurrences than a limit is dealt to several tasks by its next
word, so all counts are still made in one place; the pointers of a pair that passes the limit itself are dealt by all that
follows, and give parts of counts, which are added.

Words are told apart by 64-bit hashes of language and word; the table of all words shows that no two share one (else
the next seed is taken), so counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import BROADCAST_ROWS, written

#: A phrase's most words.
LONGEST = 4
#: Bytes of text that a task splits into words at a time.
CHUNK = 4 << 20
#: Rows of a batch of texts, and of a batch of results.
ROWS, OUT = 500, 16384
#: Occurrences of a prefix above which its pointers are dealt to several tasks; with more than 10^11 words it grows with them, so hot prefixes are at most 500,000.
HOT, MOST_HOT = 200_000, 500_000
#: First steps of the ranking of a language.
RANK_PARTS = 64

#: The score of a cut in decimals, as products may pass 64 bits.
SCORE = "cast(f as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))"

_TABLE = bytes(ord(".") if chr(b) in ".,;:!?\n\v\f\r" else ord(" ") if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
PHRASE = ["p", "a", "b", "c"]


def _parts(text: bytes) -> Iterator[bytes]:
    """A text, separators as dots, cut at dots into parts of some CHUNK bytes; a longer piece stays whole."""
    at = 0
    while len(text) - at > CHUNK:
        end = text.rfind(b".", at, at + CHUNK)
        end = end if end > at else text.find(b".", at + CHUNK)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def _tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(lang, words, places): indexes of the words of some pieces of a language, in order, -1 between pieces."""

    def indexed(lang: str, parts: list[bytes]) -> tuple[str, list[bytes], np.ndarray]:
        found = b".".join(parts).replace(b".", b" . ").split()
        index = dict.fromkeys(found)
        index.pop(b".", None)
        words = list(index)
        index = dict(zip(words, range(len(words)))) | {b".": -1}
        return lang, words, np.fromiter(map(index.__getitem__, found), np.int64, len(found))

    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
            lang = lang.as_py()
            for part in _parts((text.as_py() or b"").translate(_TABLE)):
                held.setdefault(lang, []).append(part)
                sizes[lang] = sizes.get(lang, 0) + len(part)
                if sizes[lang] >= CHUNK:
                    yield indexed(lang, held.pop(lang))
                    sizes[lang] = 0
    for lang, parts in held.items():
        yield indexed(lang, parts)


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    """The hashes that ``F.xxhash64("lang", "word")`` gives."""
    own = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.fromiter((xxhash.xxh64_intdigest(w, own) for w in words), np.uint64, len(words)).view(np.int64)


def _slices(arrays: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    """A batch in parts of OUT rows, so that executors keep small buffers only."""
    batch = pa.RecordBatch.from_arrays(arrays, names=names)
    for at in range(0, batch.num_rows, OUT):
        yield batch.slice(at, OUT)


def _among(values: np.ndarray, ordered: np.ndarray | None) -> np.ndarray:
    """Which values are in an ordered array; all if there is none."""
    if ordered is None:
        return np.ones(len(values), bool)
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two: keys of pairs, where collisions only let more pointers through."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)
    x ^= x >> np.uint64(29)
    return (x * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


@contextmanager
def _short_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark hands texts to Python in batches of ROWS rows, so that two workers and their JVM share an executor's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def word_counts(docs: DataFrame) -> DataFrame:
    """``(lang, word, n)`` of ``docs(lang, text)``."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, ids in _tokens(batches):
            n = np.bincount(ids[ids >= 0], minlength=len(words))
            yield from _slices([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])

    return docs.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _hashed(counts: DataFrame) -> tuple[DataFrame, str]:
    """The words with hashes that no two share and none of which is 0, and what is put before the language for them."""
    for salt in ["", *map(str, range(32))]:
        out = counts.withColumn("h", F.xxhash64(F.concat(F.lit(salt), "lang"), "word"))
        if not out.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1 or h = 0").limit(1).collect():
            return out, salt
    raise RuntimeError("hashes of the words collide under every salt")


def _broadcast(df: DataFrame) -> tuple | None:
    """The long columns of a table as arrays for all tasks, or None where it has more rows than may be broadcast."""
    if df.count() > BROADCAST_ROWS:
        return None
    held = df.orderBy(df.columns[0]).toArrow()
    return df.sparkSession.sparkContext.broadcast([held.column(c).to_numpy() for c in df.columns])


def _frequent_pairs(docs: DataFrame, salt: str, words, least: int) -> DataFrame:
    """``(key, n)`` of the pairs of neighbours that may be seen ``least`` times: their counts by a hash of the pair."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, names, ids in _tokens(batches):
            hashes = _hashes(salt + lang, names)
            held = np.append(_among(hashes, words and words.value[0]), False)
            some = held[ids[:-1]] & held[ids[1:]]
            pairs, n = np.unique(ids[:-1][some] * len(names) + ids[1:][some], return_counts=True)
            first, second = np.divmod(pairs, max(len(names), 1))
            yield from _slices([pa.array(_mixed(hashes[first], hashes[second])), pa.array(n, pa.int64())], ["key", "n"])

    return docs.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _projected(docs: DataFrame, salt: str, words, pairs, hot, hot_pairs) -> DataFrame:
    """``(p, deal, a, b, c, n)``: the pointers of each prefix word, with what follows it (0: nothing frequent) and how often a part of a task's text has it.

    ``deal`` is 0 for a usual prefix, above 0 where it is dealt by its next word, below 0 where the pair of both is dealt further.
    """

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, names, ids in _tokens(batches):
            hashes = np.append(_hashes(salt + lang, names), 0)
            held = np.append(_among(hashes[:-1], words and words.value[0]), False)
            go = held[ids[:-1]] & held[ids[1:]]
            if pairs:
                at = np.flatnonzero(go)
                go[at] = _among(_mixed(hashes[ids[at]], hashes[ids[at + 1]]), pairs.value[0])
            starts = np.flatnonzero(go)
            go = np.append(go, [False] * LONGEST)
            code, rest = ids[starts], [ids[starts + 1]]
            alive = np.ones(len(starts), bool)
            for k in range(1, LONGEST - 1):
                alive = alive & go[starts + k]
                rest.append(np.where(alive, ids[np.minimum(starts + k + 1, len(ids) - 1)], -1))
            for column in rest:  # one number for each distinct context
                code = np.unique(code * (len(names) + 1) + column + 1, return_inverse=True)[1]
            n = np.bincount(code) if len(code) else np.zeros(0, np.int64)
            one = np.zeros(len(n), np.int64)
            one[code] = np.arange(len(code))
            p, *more = [hashes[c[one]] for c in (ids[starts], *rest)]
            parts = np.ones(len(p), np.int64)
            if len(hot.value[0]):
                busy = _among(p, hot.value[0])
                parts[busy] = hot.value[1][np.searchsorted(hot.value[0], p[busy])]
            by_pair, by_all = (1 + (h.view(np.uint64) % parts.astype(np.uint64)).astype(np.int64) for h in (more[0], _mixed(_mixed(more[0], more[1]), more[2])))
            deal = np.where(parts > 1, np.where(_among(_mixed(p, more[0]), hot_pairs and hot_pairs.value[0]), -by_all, by_pair), 0)
            yield from _slices([pa.array(c, pa.int64()) for c in (p, deal, *more, n)], ["p", "deal", "a", "b", "c", "n"])

    return docs.mapInArrow(project, "p long, deal long, a long, b long, c long, n long")


def _grow(columns: list[np.ndarray], n: np.ndarray, least: int) -> Iterator[tuple]:
    """All phrases of one prefix with at least ``least`` occurrences, depth-first: an interval of the ordered pointers each."""

    def extend(lo: int, hi: int, depth: int, phrase: tuple) -> Iterator[tuple]:
        column = columns[depth][lo:hi]
        cuts = lo + np.append(0, np.append(np.flatnonzero(column[1:] != column[:-1]) + 1, len(column)))
        totals = np.add.reduceat(n[lo:hi], cuts[:-1] - lo)
        for k in np.flatnonzero((totals >= least) & (columns[depth][cuts[:-1]] != 0)):
            longer = *phrase, int(columns[depth][cuts[k]])
            yield longer, int(totals[k])
            if depth + 1 < len(columns):
                yield from extend(int(cuts[k]), int(cuts[k + 1]), depth + 1, longer)

    return extend(0, len(n), 1, (int(columns[0][0]),))


def _phrases(pointers: DataFrame, least: int) -> DataFrame:
    """``(p, a, b, c, n)`` of the phrases of two and more words that occur ``least`` times; a word that is not there is 0."""

    def grown(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # batches of the prefix that has not ended, and of some before it

        def taken(last: bool) -> pa.RecordBatch:
            """The phrases of the prefixes that have ended; the rows of the last one stay."""
            p, deal, *more, n = (np.concatenate(c) for c in zip(*held))
            cuts = np.append(0, np.flatnonzero((p[1:] != p[:-1]) | (deal[1:] != deal[:-1])) + 1)
            ends = np.append(cuts[1:], len(p))
            found = []
            for lo, hi in zip(cuts[: None if last else -1], ends):
                found += _grow([c[lo:hi] for c in (p, *more)], n[lo:hi], 1 if deal[lo] < 0 else least)
            held[:] = [[c[cuts[-1] :].copy() for c in (p, deal, *more, n)]]
            padded = np.array([(*w, *[0] * (LONGEST - len(w)), k) for w, k in found], np.int64).reshape(-1, LONGEST + 1)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in padded.T.copy()], names=[*PHRASE, "n"])

        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy() for c in batch.columns])
                first, last = held[0], held[-1]
                if len(held) >= 16 and (first[0][0] != last[0][-1] or first[1][0] != last[1][-1]):
                    yield taken(False)
        if held:
            yield taken(True)

    dealt = pointers.repartition("p", "deal").sortWithinPartitions("p", "deal", "a", "b", "c")
    parts = dealt.mapInArrow(grown, "p long, a long, b long, c long, n long")
    return parts.groupBy(*PHRASE).agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _structs(*phrases: tuple[str, ...]):
    return F.array(*[F.struct(*[(F.col(w[i]) if i < len(w) else F.lit(0).cast("long")).alias(PHRASE[i]) for i in range(LONGEST)]) for w in phrases])


def _cut(k: int):
    """A phrase cut after ``k`` words. The fields are plain columns: an array indexed by a column is generated anew for each of them,
    and the compiler of the JVM took 3.8 GB for that code."""
    zero = F.lit(0).cast("long")
    first = [(F.col(PHRASE[i]) if i < k else zero).alias(f"first_{PHRASE[i]}") for i in range(LONGEST)]
    rest = [(F.col(PHRASE[k + i]) if k + i < LONGEST else zero).alias(f"rest_{PHRASE[i]}") for i in range(LONGEST)]
    return F.struct(F.lit(k).alias("k"), *first, *rest)


def collocations(docs: DataFrame, least: int = 30, best: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``best`` phrases of 2 to 4 words with at least ``least`` occurrences.

    A-Z is lower-cased; pieces end at ``. , ; : ! ?`` and line ends, words at spaces and tabs. The score of a cut is
    floor(2,000,000 a / (l + r)), where l and r count its two parts; the lowest cut counts, of equal ones the first. A phrase that lies in a longer one with at
    least 80 % of its occurrences goes. A null language is ``und``, a null text empty; repeated rows count each time, ids are not looked at;
    texts without words, or an empty table, give nothing; long texts are read in parts. All statistics are of all rows.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    with _short_batches(docs.sparkSession):
        counts, salt = _hashed(written(word_counts(rows), "words"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = written(counts.filter(F.col("n") >= least), "frequent")
    words = _broadcast(frequent.select("h"))
    n_words = frequent.agg(F.sum("n")).first()[0] or 0
    limit = max(HOT, n_words // MOST_HOT)
    hot = _broadcast(frequent.filter(F.col("n") > limit).select("h", (F.col("n") / limit).cast("long").alias("parts") + 1))
    with _short_batches(docs.sparkSession):
        counted = written(_frequent_pairs(rows, salt, words, least), "pairs")
        pairs, hot_pairs = _broadcast(counted.select("key")), _broadcast(counted.filter(F.col("n") > limit).select("key"))
        pointers = written(_projected(rows, salt, words, pairs, hot, hot_pairs), "pointers")
    phrases = written(_phrases(pointers, least), "phrases")

    zero = F.lit(0).cast("long")
    known = phrases.unionByName(frequent.select(F.col("h").alias("p"), zero.alias("a"), zero.alias("b"), zero.alias("c"), "n"))
    first = known.toDF(*[f"first_{c}" for c in PHRASE], "l")
    second = known.toDF(*[f"rest_{c}" for c in PHRASE], "r")
    three, four = F.col("b") != 0, F.col("c") != 0
    cut = phrases.select(*PHRASE, F.col("n").alias("f"), F.inline(F.array(*[_cut(k) for k in range(1, LONGEST)])))
    cut = cut.filter(F.col("k") < F.when(four, 4).when(three, 3).otherwise(2))
    cut = cut.join(first, [f"first_{c}" for c in PHRASE]).join(second, [f"rest_{c}" for c in PHRASE])
    exact = F.expr(SCORE)
    scored = cut.groupBy(*PHRASE).agg(F.first("f").alias("f"), F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("m"))

    inner = F.when(four, _structs(("p", "a"), ("a", "b"), ("b", "c"), ("p", "a", "b"), ("a", "b", "c"))).otherwise(_structs(("p", "a"), ("a", "b")))
    longest = phrases.filter(three).select("n", F.explode(inner).alias("s")).groupBy("s").agg(F.max("n").alias("longer")).select("s.*", "longer")
    kept = scored.join(longest, PHRASE, "left").filter(F.col("longer").isNull() | (5 * F.col("longer") < 4 * F.col("f")))

    # the phrases' words, by their hashes
    each = kept.select("*", F.posexplode(F.filter(F.array(*PHRASE), lambda h: h != 0)).alias("i", "h")).join(frequent.select("h", "lang", "word"), "h")
    spelled = each.groupBy(*PHRASE).agg(F.first("lang").alias("lang"), F.first("f").alias("a_"), F.first("m").alias("m"), F.sort_array(F.collect_list(F.struct("i", "word"))).alias("w"))
    spelled = spelled.select("lang", F.concat_ws(" ", F.transform("w", lambda x: x["word"])).alias("phrase"), F.col("a_").alias("a"), "m.l", "m.r", "m.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    spelled = spelled.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    some = spelled.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= best)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= best)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


SQL = r"""WITH pieces AS (SELECT lang, row_number() OVER () AS piece, piece AS text FROM (SELECT coalesce(lang, 'und') AS lang,
 unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents)),
lists AS (SELECT lang, piece, regexp_extract_all(text, '[^ 	]+') AS w FROM pieces), words AS (SELECT lang, piece, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM lists),
grams AS (SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM words WINDOW o AS (PARTITION BY piece ORDER BY i)),
f AS (SELECT lang, 1 AS k, w1 AS phrase, count(*) AS n FROM grams GROUP BY ALL UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM grams WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
 UNION ALL SELECT lang, 3, concat_ws(' ', w1, w2, w3), count(*) FROM grams WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30 UNION ALL SELECT lang, 4, concat_ws(' ', w1, w2, w3, w4), count(*) FROM grams WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1), cuts AS (SELECT c.*, unnest(range(1, k)) AS cut FROM c),
parts AS (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS first, array_to_string(w[cut + 1:], ' ') AS rest FROM cuts),
s AS (SELECT p.lang, p.phrase, p.a, cut, x.n AS l, y.n AS r, CAST(2000000::HUGEINT * p.a // (x.n + y.n) AS BIGINT) AS score FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = p.first JOIN f y ON y.lang = p.lang AND y.phrase = p.rest),
low AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS i FROM s),
kept AS (SELECT * FROM low WHERE i = 1 AND NOT EXISTS (SELECT 1 FROM c WHERE c.lang = low.lang AND 100 * c.a >= 80 * low.a AND length(c.phrase) > length(low.phrase) AND contains(' ' || c.phrase || ' ', ' ' || low.phrase || ' '))),
n AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n.n AS n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""
