import itertools

import pytest
import xxhash

from pulsegrid.llm import simhash
from pulsegrid.llm.components import components


def brute_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def brute(docs):
    fps = {i: brute_fingerprint(t) for i, t in docs}
    near = [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 4]
    return fps, brute_components(near, fps)


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fps, groups = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{fps[i]:016x}", groups[i]) for i in fps}


@pytest.mark.parametrize("bits, segments", [(4, 2), (4, 3), (2, 2), (6, 2), (1, 2)])
def test_every_link_within_the_bits_is_found(spark, bits, segments):
    import random

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = set(base)
    for f in base:
        for _ in range(15):
            x = f
            for b in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << b
            fps.add(x)
    fps = list(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    got = {frozenset((r.a, r.b)) for r in simhash.similar_fingerprints(spark.createDataFrame(signed, "fp long"), bits, segments).collect()}
    want = {frozenset((a, b)) for (a,), (b,) in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= bits}
    assert got == want and len(want) > 15 * bits


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, " \t\n", None), (None, "A b", "z"), (5, "a B", "z"), (5, "a B", "z"), (7, "word " * 60_000, "q"), (9, "a b c d", "s"), (8, "a b c d e", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(simhash.near_duplicates(df).collect(), key=str)
    by = {r.doc_id: r for r in got}
    assert len(got) == 9 and {by[i].component_id for i in (1, 2, 3)} == {1} and by[1].fingerprint == "0" * 16
    assert by[None].component_id == 5 and by[7].component_id == 7
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(80)}
    assert got == want


def test_keys_grow_with_the_table():
    assert simhash.chain_length(250_000, 4) == 2 and simhash.chain_length(10**9, 4) == 3


def test_exploded_keys_of_a_small_table_are_not_broadcast(spark):
    fps = spark.range(100).withColumnRenamed("id", "fp")
    plan = simhash.similar_fingerprints(fps)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
