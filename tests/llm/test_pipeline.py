import hashlib
import re

import public_tokenizers
import sentencepiece

import corpus_pipeline
from pulsegrid.llm.common import written

from .test_near_copies import brute


def test_every_stage_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, tables = docs.columns, [{r.doc_id: r for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        rows = docs.collect()
        tables.append({r.doc_id: r for r in rows})
        assert len(tables[-1]) == len(rows)
    start, good, single, clean, private = tables
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = [i in good for i in start if labels.get(i) == 1]
    junk = [i in good for i in start if labels.get(i) == 0]
    assert sum(kept) >= 0.97 * len(kept) and sum(junk) < 0.5 * len(junk) and all(good[i] == start[i] for i in good)
    _, groups = brute([(i, r.text) for i, r in good.items()])  # links of five words and 0.8
    assert single == {i: good[i] for i in set(groups.values())}
    words = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    items = [shingles(words(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaks = lambda t: any(len(s & shingles(words(t))) >= 0.8 * len(s) for s in items)
    assert clean == {i: r for i, r in single.items() if not leaks(r.text)} and len(clean) < len(single)
    assert private.keys() == clean.keys() and all(r.n_chars == len(r.text) for r in private.values())
    assert 0 < sum(private[i].text != clean[i].text for i in clean) < len(clean) / 2
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    last = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()}
    assert last.keys() == private.keys()
    for i, r in last.items():
        ids = library.encode(private[i].text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_odd_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b", "en", "s", 3), (4, "x y z " * 20, "en", "s", 120), (4, "x y z " * 20, "en", "s", 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), name)
    got = [r.doc_id for r in docs.collect()]
    assert sorted(got, key=str) in ([1, 4, None], [1, None])
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_leaks_without_an_id_and_clashing_names(spark):
    sf = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    names = "gone rejected row row_key n_entities component_id kept lang2 id h block key".split()
    rows = [(None, f"before {item} after", "en", "s", 1), (7, f"x {item}", "en", "s", 1), (7, "write to a.b@mail.example.org", "en", "s", 1), (None, "clean words", "en", "s", 1)]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf), name)
        assert docs.columns == before.columns
        if name == "benchmark_leaks":
            assert sorted((r.text for r in docs.collect())) == ["clean words", "write to a.b@mail.example.org"]
    got = docs.collect()
    assert all([r[n] for n in names] == list(range(len(names))) for r in got)
    assert len(got) == 2 and not any("a.b@" in r.text for r in got)
