import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import lm_scoring, quality
from pulsegrid.llm.kneser_ney import discounts


def counts_of_counts(counter):
    of = Counter(counter.values())
    return [of[k] for k in (1, 2, 3, 4)]


class Brute:
    """Interpolated modified Kneser-Ney of any order over lists of tokens, from its definition."""

    def __init__(self, texts, order, begin):
        grams = Counter(tuple(g) for t in texts for g in self.grams(t, order, begin))
        self.levels = {order: grams}
        for k in range(order - 1, 0, -1):
            self.levels[k] = Counter(g[1:] for g in self.levels[k + 1])
        self.order, self.begin = order, begin
        self.d = {k: discounts(*counts_of_counts(c)) for k, c in self.levels.items()}
        self.contexts = {k: defaultdict(lambda: [0, 0.0]) for k in self.levels}
        for k, c in self.levels.items():
            for g, n in c.items():
                held = self.contexts[k][g[:-1]]
                held[0] += n
                held[1] += self.take(k, n)

    def take(self, k, n):
        return 0 if n == 0 else self.d[k][min(n, 3) - 1]

    @staticmethod
    def grams(tokens, order, begin):
        padded = [begin] * (order - 1) + list(tokens)
        return [padded[i : i + order] for i in range(len(tokens))]

    def p(self, gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(self.levels[1]) + 1)
        seen = self.contexts[k].get(gram[:-1])
        if not seen:
            return self.p(gram[1:]) if k > 1 else 1.0
        n = self.levels[k][gram]
        return (n - self.take(k, n) + seen[1] * self.p(gram[1:])) / seen[0]

    def score(self, tokens):
        return sum(math.log10(self.p(tuple(g))) for g in self.grams(tokens, self.order, self.begin))


def words(text):
    return (text or "").encode().lower().split() + [b" end"]


def test_bigrams_against_the_definition(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(900_001, None), (900_001, None), (900_002, ""), (None, "The Of The"), (900_004, "never-seen-word " * 3)], "doc_id long, text string")
    docs = docs.unionByName(extra)
    rows = docs.collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    training = [words(r.text) for r in rows if not held(r.doc_id)]
    brute, c = Brute(training, 2, b" begin"), Counter(w for t in training for w in t)
    n, v = sum(c.values()), len(c)
    flag = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 10 == 0
    marked = docs.withColumn("held_out", flag)
    got = lm_scoring.score(marked, lm_scoring.train(marked.filter("not held_out")), more={"held_out": F.col("held_out")}).collect()
    assert len(got) == len(rows)
    want = {(r.doc_id, words(r.text)[0]): r.text for r in rows}
    assert len(want) > 100
    by_id = {r.doc_id: words(r.text) for r in rows}
    for r in got:
        t = by_id[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel=1e-9)
        assert r.score == pytest.approx(brute.score(t), rel=1e-9)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lm_scoring.score(docs, lm_scoring.train(docs.limit(0))).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.score) for r in got) == [(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)]


def test_characters_against_the_definition(spark, monkeypatch):
    monkeypatch.setattr(quality, "CALIBRATION", 1 << 40)  # every trusted text is counted
    trusted = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "the mat and the log"] * 2
    others = ["the cat", "%%%% xyz", "", "�" * 2 + "the"]
    rows = [(i, t, "en", 1) for i, t in enumerate(trusted)] + [(100 + i, t, "en", 1) for i, t in enumerate(others)] + [(200, None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, key int")
    brute = Brute([list(t) for t in trusted], 4, "￿")
    got = quality.perplexities(docs, docs.filter("doc_id < 100")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict((x[0], x[1]) for x in rows)[r.id] or ""
        assert r.n_chars == len(text) and r.logp == pytest.approx(brute.score(list(text)), rel=1e-5, abs=1e-5)


def test_quality_tells_the_labelled_apart(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    # trusted: half of the good labels; the other half is held out
    judged = quality.classify(docs, labels.filter("quality = 1 and doc_id % 2 = 0"))
    rows = judged.join(labels, F.col("id") == F.col("doc_id")).filter("doc_id % 2 = 1").select("quality", "accepted").collect()
    good, bad = [r.accepted for r in rows if r.quality], [r.accepted for r in rows if not r.quality]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_both_error_rates_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality.classify(docs, labels.filter("quality = 1 and doc_id % 2 = 0"))
    rows = judged.join(labels, F.col("id") == F.col("doc_id")).filter("quality = 0 or doc_id % 2 = 1").select("quality", "accepted").collect()
    good, bad = [r.accepted for r in rows if r.quality], [r.accepted for r in rows if not r.quality]
    assert sum(good) >= 0.985 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", None), (None, "some text", "en"), (3, "some text", "xx")], "doc_id long, text string, lang string")
    nobody = docs.limit(0)
    assert [r.accepted for r in quality.classify(docs, nobody).collect()] == [True] * 4
    assert [r.accepted for r in quality.classify(docs, docs.filter("doc_id = 3")).collect()] == [True] * 4
    assert quality.classify(nobody, docs).count() == 0 and quality.kept_documents(docs, docs).count() == 4


def test_discounts_stay_in_range():
    assert discounts(0, 0, 0, 0) == (0.5, 0.75, 0.9)
    assert all(0 < d < k for k, d in enumerate(discounts(100, 40, 20, 10), 1))


def test_scores_do_not_depend_on_how_files_are_split(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    path, before = str(tmp_path / "docs"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    docs.coalesce(1).write.option("parquet.block.size", 20_000).option("parquet.page.size.row.check.min", 1).option("parquet.block.size.row.check.min", 1).option("parquet.block.size.row.check.max", 5).parquet(path)
    read = spark.read.parquet(path)
    found = []
    try:
        for first, second in ((1 << 27, 1 << 27), (40_000, 1 << 27), (1 << 27, 30_000), (50_000, 37_001)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", first)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            scored = quality.perplexities(read, docs.filter("doc_id < 60"))
            spark.conf.set("spark.sql.files.maxPartitionBytes", second)
            found.append(sorted((r.id, r.n_chars, round(r.logp, 6)) for r in scored.select("id", "n_chars", "logp").collect()))
        spark.conf.set("spark.sql.files.maxPartitionBytes", 40_000)
        assert read.rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert all(f == found[0] for f in found) and all(v < 0 for _, n, v in found[0] if n)


def test_a_missing_ngram_is_an_error():
    keys = np.sort(quality.ngrams(["abc"]))
    assert len(quality._looked_up(["abc"], keys, np.zeros(len(keys)))) == 3 and len(quality._looked_up([""], np.zeros(0, np.uint64), np.zeros(0))) == 0
    for texts, held in ((["abd"], keys), (["abc"], np.zeros(0, np.uint64))):
        with pytest.raises(RuntimeError):
            quality._looked_up(texts, held, np.zeros(len(held)))
