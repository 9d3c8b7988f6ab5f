"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

Voters are words and word beginnings mined from labelled training text, and patterns of spelling. The label model
is a class-conditional tree over the voters: each vote depends on the hidden class (accuracy) and on the vote it is
most correlated with given the class. It is fitted by expectation maximisation on the counts of vote patterns over
all training documents, and its posterior labels train a logistic regression. Documents whose votes have the same levels are one weighted row
of the regression, so it takes all training documents, and nothing is sampled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import id_bucket, small, written

#: Levels of a voter's count: 0, 1, 2 to 3, 4 to 7 and so on, up to this one for all more.
LEVELS = 5
#: Mined terms, length of a word beginning, and voters that hold one term each or a share of the rest.
TERMS, STEM, SINGLE, SHARES = 400, 5, 6, 4
#: Least share of toxic rows that a term occurs in, and least ratio of its rates in toxic and other rows.
LEAST_SHARE, LEAST_LIFT = 0.002, 10.0
LETTERS = re.compile(r"[^\W\d_]+")
PATTERNS = (re.compile(r"!{2,}|\?{2,}"), re.compile(r"\b[^\W\d_a-z]{4,}\b"))
VOTERS = SINGLE + 2 * SHARES + len(PATTERNS)


@dataclass(frozen=True)
class Lexicon:
    """Terms with their voters: whole words end in a blank, beginnings do not."""

    terms: tuple[tuple[str, int], ...]


def mined_lexicon(labelled: DataFrame) -> Lexicon:
    """Terms of ``labelled(text, toxic)`` that are much likelier in toxic rows; only the best TERMS reach the driver."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != ""))
    stems = F.array_distinct(F.transform(F.filter("w", lambda w: F.length(w) > STEM), lambda w: F.substring(w, 1, STEM)))
    rows = labelled.select("toxic", words.alias("w")).select("toxic", F.explode(F.concat(F.transform("w", lambda w: F.concat(w, F.lit(" "))), stems)).alias("term"))
    n0, n1 = labelled.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    counts = rows.groupBy("term").agg(F.sum("toxic").alias("d1"), F.count("*").alias("n"))
    lift = F.log((F.col("d1") + 0.5) / (n1 + 1)) - F.log((F.col("n") - F.col("d1") + 0.5) / (n0 + 1))
    good = counts.filter(F.col("d1") >= max(5.0, LEAST_SHARE * n1)).withColumn("lift", lift).filter(F.col("lift") >= math.log(LEAST_LIFT))
    best = good.orderBy(F.desc(F.col("d1") * F.col("lift")), "term").limit(TERMS).select("term").collect()
    out, seen = [], [0, 0]
    for term in (r.term for r in best):
        word = term.endswith(" ")
        if word and seen[0] < SINGLE:
            voter = seen[0]
        else:
            voter = SINGLE + SHARES * (not word) + seen[not word] % SHARES
        seen[not word] += 1
        out.append((term, voter))
    return Lexicon(tuple(out))


def vote_counts(docs: DataFrame, lexicon: Lexicon, columns: list[str], text_col: str = "text") -> DataFrame:
    """``columns`` and ``counts``, how often each voter's terms or pattern occur in the whole text."""
    narrow = docs.select(F.col(text_col).alias("__text"), *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term, voter in lexicon.terms:
            automaton.add_word(f" {term}", voter)
        automaton.make_automaton()
        for batch in batches:
            counts = np.zeros((batch.num_rows, VOTERS), np.float32)
            for i, text in enumerate(batch.column(0)):
                text = text.as_py() or ""
                if lexicon.terms:
                    for _, voter in automaton.iter(f" {' '.join(LETTERS.findall(text.lower()))} "):
                        counts[i, voter] += 1
                for k, pattern in enumerate(PATTERNS):
                    counts[i, VOTERS - len(PATTERNS) + k] = len(pattern.findall(text))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, counts.size + 1, VOTERS), pa.int32()), pa.array(counts.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists], names=[*columns, "counts"])

    kinds = ", ".join(f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in columns)
    return narrow.mapInArrow(run, f"{kinds}, counts array<float>")


def _tree(votes: np.ndarray, weights: list[np.ndarray]) -> list[int]:
    """Each voter's parent in the spanning tree of greatest mutual information given the class; -1 for the root."""
    m = votes.shape[1]
    total = sum(w.sum() for w in weights)
    info = np.zeros((m, m))
    for w in weights:
        mass = max(w.sum(), 1e-9)
        on = (votes * w[:, None]).sum(0) / mass
        both = (votes.T * w) @ votes / mass
        for a, b, joint in ((1, 1, both), (1, 0, on[:, None] - both), (0, 1, on[None] - both), (0, 0, 1 - on[:, None] - on[None] + both)):
            pa_, pb = (on if a else 1 - on)[:, None], (on if b else 1 - on)[None]
            info += mass / total * np.where(joint > 1e-12, joint * np.log(np.maximum(joint, 1e-12) / np.maximum(pa_ * pb, 1e-12)), 0)
    parent, best, near = [-1] * m, info[0].copy(), np.zeros(m, int)
    left = set(range(1, m))
    while left:
        i = max(left, key=lambda j: (best[j], -j))
        parent[i] = int(near[i])
        left.discard(i)
        closer = info[i] > best
        best[closer], near[closer] = info[i][closer], i
    return parent


def posterior(votes: np.ndarray, unknown: np.ndarray, zeros: np.ndarray, ones: np.ndarray, rounds: int = 30) -> np.ndarray:
    """P(class 1) of each vote pattern, from how often it occurs without a label and with either."""
    q = np.where(zeros + ones > 0, ones / np.maximum(zeros + ones, 1), np.where(votes[:, : VOTERS - len(PATTERNS)].any(1), 0.9, 0.05))
    for _ in range(rounds):
        weights = [zeros + unknown * (1 - q), ones + unknown * q]
        parent = _tree(votes, weights)
        logs = []
        for w in weights:
            log = np.full(len(votes), math.log(max(w.sum(), 1e-9)))
            for i, up in enumerate(parent):
                state = votes[:, up] if up >= 0 else np.zeros(len(votes))
                for s in (0, 1):
                    at = state == s
                    on = ((w * votes[:, i])[at].sum() + 0.05) / (w[at].sum() + 0.1)
                    log[at] += np.log(np.where(votes[at, i] == 1, on, 1 - on))
            logs.append(log)
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))
        if np.abs(new - q).max() < 1e-7:
            break
        q = new
    return new


def _pattern(counts: Column) -> Column:
    """The votes as bits of a number below 2^VOTERS."""
    return F.aggregate(counts, F.lit(0), lambda a, c: a * 2 + (c > 0).cast("int"))


def _level(count: Column) -> Column:
    return F.least(F.ceil(F.log2(count + 1)), F.lit(LEVELS)).cast("double")


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5) -> DataFrame:
    """``(id, held_out, score, predicted)`` for every row; label, language, source and id are no input of a score.

    Rows whose crc32 of the id modulo ``folds`` is 0 are held out: neither their labels nor their votes are learnt
    from. Null and empty texts cast no vote and get the score of no vote. Labels that are null or whose id is null are
    ignored, of several labels of an id the greatest counts. Without any toxic training label all scores are 0.
    Labels choose the terms and fix the class of their rows in the label model; the classifier is fitted to the model's posterior alone.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    known = labels.select(F.col(id_col).alias("__label_id"), F.col(label_col).cast("int").alias("toxic")).filter("__label_id is not null and toxic is not null")
    known = known.filter(id_bucket("__label_id", folds) != 0).groupBy("__label_id").agg(F.max("toxic").alias("toxic"))
    known = written(known, "toxic-labels")
    base = docs.select(id_col, F.col(text_col).alias("text"), (id_bucket(id_col, folds) == 0).alias("held_out"))
    base = base.join(small(known), F.col(id_col) == F.col("__label_id"), "left").drop("__label_id")
    lexicon = mined_lexicon(base.filter(F.col("toxic").isNotNull()).select("text", "toxic"))
    votes = written(vote_counts(base, lexicon, [id_col, "held_out", "toxic"]), "votes").withColumn("pattern", _pattern(F.col("counts")))
    train = votes.filter("not held_out")
    # at most 2^VOTERS rows
    table = train.groupBy("pattern").agg(F.count_if(F.col("toxic").isNull()), F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).orderBy("pattern").collect()
    if not any(r[3] for r in table):
        return votes.select(id_col, "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    seen = np.array([list(r) for r in table], float)
    bits = np.array([[r[0] >> (VOTERS - 1 - i) & 1 for i in range(VOTERS)] for r in table], float)
    q = posterior(bits, *seen[:, 1:4].T)
    spark = docs.sparkSession
    of_pattern = F.broadcast(spark.createDataFrame([(int(r[0]), float(p)) for r, p in zip(table, q)], "pattern int, q double"))
    levels = F.transform("counts", _level)
    alike = train.groupBy("pattern", levels.alias("levels")).agg(F.count("*").alias("n")).join(of_pattern, "pattern")
    features = array_to_vector(F.concat(F.transform("levels", lambda c: (c > 0).cast("double")), "levels"))
    both = alike.select(features.alias("x"), F.explode(F.array(*[F.struct(F.lit(float(y)).alias("y"), (F.col("n") * (F.col("q") if y else 1 - F.col("q"))).alias("w")) for y in (0, 1)])).alias("t"))
    both = both.select("x", "t.y", "t.w").filter("w > 0")
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=60, regParam=1e-4).fit(written(both, "posterior"))
    weights = [float(v) for v in model.coefficients]
    raw = F.lit(float(model.intercept))
    for k in range(VOTERS):
        c = F.get("counts", F.lit(k))
        raw = raw + F.when(c > 0, weights[k] + weights[VOTERS + k] * _level(c)).otherwise(0.0)
    score = 1 / (1 + F.exp(-raw))
    return votes.withColumn("score", score).select(id_col, "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
