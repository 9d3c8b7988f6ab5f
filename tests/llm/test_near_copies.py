import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from pulsegrid.llm import near_copies, simhash

from .test_simhash import brute_components


def brute(docs):
    """Links of 0.8 or more by sets of five words, and the groups."""
    sets = {}
    for i, text in docs:
        words = (text or "").encode().lower().split()
        sets[i] = {b" ".join(words[k : k + 5]) for k in range(max(len(words) - 4, 1))}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return links, brute_components(links, sets)


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.random()}"
    return out


def family(seed, groups, size, edits):
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        words = [rng.choice("abcdefghijklmnop") + str(rng.randrange(500)) for _ in range(200)]
        texts += [" ".join(edited(rng, words, rng.randrange(edits))) for _ in range(size)]
    return list(enumerate(texts))


def test_the_stage_against_brute_force(spark):
    docs = family(1, 40, 4, 9) + [(1000, None), (1001, ""), (1002, "one two"), (1003, "One  two"), (1004, "one three")]
    links, groups = brute(docs)
    far = [(a, b) for a, b in links if (simhash.fingerprint(dict(docs)[a]) ^ simhash.fingerprint(dict(docs)[b])).bit_count() > 4]
    assert far  # 4 differing bits are too few for these
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_copies(spark, frame, None)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(groups.values()))


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 30)
    docs = family(2, 3, 80, 12)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(frame).collect()} == brute(docs)[1]


@pytest.mark.parametrize("block", [1024, 40])
def test_a_large_group_of_nearly_similar_texts_makes_few_pairs(spark, monkeypatch, block):
    # most copies have 14 edits, far from each other: they are at 0.76, where sketches let pairs through and none is a link; one in nine is a copy of one of them
    rng = random.Random(7)

    def apart(words):
        places = set(rng.sample(range(0, 990, 6), 14))
        return [f"new{rng.random()}" if i in places else w for i, w in enumerate(words)]

    words = [rng.choice("abcdefghijklmnop") + str(rng.randrange(500)) for _ in range(1000)]
    one = apart(words)
    docs = [(i, " ".join(edited(rng, one, 1) if i % 9 == 0 else apart(words))) for i in range(160)]
    made, written = [], near_copies.written
    monkeypatch.setattr(near_copies, "SETS_BLOCK", block)

    def counted(df, name):
        out = written(df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(near_copies, "written", counted)
    links, groups = brute(docs)
    got = near_copies.near_copies(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == groups and len(set(groups.values())) > 100 and len(links) > 100
    assert any(n for name, n in made if name == "dense-lists")
    assert max(n for name, n in made if name == "copy-pairs") < 24 * 160


def test_shared_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, n)) for n in (0, 1, 40, 700, 3000, 3000)]
    got = near_copies._shared(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(6) for j in range(6) if i != j)


def test_a_forest_connects_what_can_be_connected():
    rng = np.random.default_rng(3)
    for n in (2, 5, 30):
        groups = rng.integers(0, n, n)
        a, b = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
        some = (a < b) & (groups[a] != groups[b]) & (rng.random(len(a)) < 0.3)
        a, b = a[some], b[some]
        keep = near_copies.spanning_forest(groups, a, b, rng.integers(60, 97, len(a)).astype(np.uint8))
        every, few = (brute_components([(groups[i], groups[j]) for i, j in zip(x, y)], set(groups)) for x, y in ((a, b), (a[keep], b[keep])))
        assert every == few and len(keep) == len(set(groups)) - len(set(every.values()))


def test_rows_that_share_an_id(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(3, "y y"), (5, "x x"), (5, "y y"), (None, "only here"), (None, long), (9, long), (9, long), (9, "z z"), (9, "z z"), (None, "only here")]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, gone int, row_key int")
    got = near_copies.single_documents(frame)
    assert got.columns == frame.columns
    assert sorted(((r.doc_id, r.text[:8]) for r in got.collect()), key=str) == sorted([(3, "y y"), (5, "x x"), (None, "only her"), (9, long[:8]), (9, "z z")], key=str)


def test_nothing(spark):
    frame = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert near_copies.single_documents(frame.limit(0)).count() == 0 and near_copies.single_documents(frame).count() == 1


def test_exploded_band_keys_are_not_broadcast(spark, monkeypatch):
    plans, written = {}, near_copies.written

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().sparkPlan().toString()
        return written(df, name)

    monkeypatch.setattr(near_copies, "written", seen)
    df = spark.createDataFrame([(i, "a b c d e f g h i j" + " k" * (i % 3)) for i in range(9)], "doc_id long, text string")
    assert near_copies.near_copies(df).count() == 9
    assert "BroadcastHashJoin" not in plans["copy-lists"] and "SortMergeJoin" in plans["copy-lists"]
