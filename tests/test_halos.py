"""Windows, filters and peaks over seams against plain numpy on the joined recording, and bases against numpy's SVD."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import halos

RNG = np.random.default_rng(11)
TRACES = {"a": RNG.normal(size=97).round(2), "b": RNG.normal(size=16).round(2), "c": RNG.normal(size=3).round(2), "d": np.round(np.sin(np.arange(60) / 3), 1)}


def blocks(spark, size, traces=TRACES, skip=()):
    rows = [(k, at, [float(v) for v in x[at : at + size]]) for k, x in traces.items() for at in range(0, len(x), size) if (k, at) not in skip]
    return spark.createDataFrame(rows + [("a", 1000 * size, None), ("e", 0, [])], "k string, t0 long, x array<double>").repartition(4)


@pytest.mark.parametrize("size,before,after", [(8, 3, 2), (8, 20, 11), (5, 0, 7), (200, 4, 4)])
def test_halos_are_the_neighbours_samples(spark, size, before, after):
    got = halos.with_halo(blocks(spark, size), ["k"], "t0", "x", size, before, after).collect()
    assert len(got) == sum(-(-len(x) // size) for x in TRACES.values())
    for r in got:
        x = TRACES[r.k]
        lo = max(r.t0 - before, 0)
        assert r.lead == r.t0 - lo and r.n == min(size, len(x) - r.t0) and r.wide == list(x[lo : min(r.t0 + size + after, len(x)) if r.n == size else len(x)])


def test_halos_end_at_gaps(spark):
    got = {r.t0: r for r in halos.with_halo(blocks(spark, 8, {"a": TRACES["a"]}, {("a", 16)}), ["k"], "t0", "x", 8, 10, 10).collect()}
    assert 16 not in got and got[8].wide == list(TRACES["a"][:16]) and got[24].wide == list(TRACES["a"][24:42]) and got[24].lead == 0


@pytest.mark.parametrize("size", [4, 8, 30, 128])
def test_windows_over_seams(spark, size):
    events = [(k, t) for k, x in TRACES.items() for t in range(-1, len(x) + 2)] + [("none", 3), (None, 3), ("a", None)]
    df = spark.createDataFrame(events, "k string, t long")
    got = {(r.k, r.t): r.window for r in halos.cut_windows(blocks(spark, size), df, ["k"], "t0", "x", "t", size, 5, 7, base=3).collect()}
    assert len(got) == len(events)
    for k, t in events:
        x = TRACES.get(k)
        if x is None or t is None or t < 5 or t + 7 > len(x):
            assert got[k, t] is None
        else:
            w = x[t - 5 : t + 7]
            assert np.allclose(got[k, t], w - w[:3].mean())


def test_window_features(spark):
    cuts = spark.createDataFrame([(1, [1.0, -3.0, 0.0, 5.0, 2.0]), (2, [4.0, 2.0]), (3, None)], "i int, window array<double>")
    got = {r.i: tuple(r)[2:] for r in halos.window_features(cuts).collect()}
    assert got == {1: (-3.0, 8.0, 39.0, 2), 2: (2.0, 0.0, 20.0, 0), 3: (None, None, None, None)}


def own_peaks(s):
    return [i for i in range(1, len(s) - 1) if s[i - 1] < s[i] >= s[i + 1]]


def own_separated(peaks, distance):
    kept = []
    for pos, score in sorted(peaks, key=lambda p: (-p[1], p[0])):
        if all(abs(pos - q) >= distance for q, _ in kept):
            kept.append((pos, score))
    return sorted(kept)


@pytest.mark.parametrize("size", [4, 16, 128])
def test_filter_and_peaks_over_seams(spark, size):
    template = np.array([-1.0, 2.0, -0.5, 0.25])
    scores = halos.filter_scores(blocks(spark, size), ["k"], "t0", "x", size, template)
    unit = template / (np.linalg.norm(template) + 1e-9)
    want = {k: np.correlate(x, unit, "valid") for k, x in TRACES.items() if len(x) >= 4}
    got: dict[str, dict[int, float]] = {}
    for r in scores.collect():
        got.setdefault(r.k, {}).update({r.t0 + i: v for i, v in enumerate(r.scores)})
    assert got.keys() == want.keys()
    for k, s in want.items():
        assert sorted(got[k]) == list(range(len(s))) and np.allclose([got[k][i] for i in range(len(s))], s)
    peaks = halos.local_peaks(scores, ["k"], size)
    assert sorted((r.k, r.pos) for r in peaks.collect()) == sorted((k, p) for k, s in want.items() for p in own_peaks([got[k][i] for i in range(len(s))]))


def test_filter_adds_channels(spark):
    x = RNG.normal(size=(2, 50))
    rows = [("a", c, at, [float(v) for v in x[c, at : at + 8]]) for c in (0, 1) for at in range(0, 50, 8)] + [("a", 5, 0, [1.0] * 8)]
    template = RNG.normal(size=(2, 6))
    df = spark.createDataFrame(rows, "k string, c int, t0 long, x array<double>")
    got = np.concatenate([r.scores for r in halos.filter_scores(df, ["k"], "t0", "x", 8, template, "c").orderBy("t0").collect()])
    unit = template / (np.linalg.norm(template) + 1e-9)
    assert np.allclose(got, sum(np.correlate(x[c], unit[c], "valid") for c in (0, 1)))


@pytest.mark.parametrize("distance,stretch", [(1, 1 << 20), (5, 1 << 20), (9, 32), (40, 64)])
def test_highest_first(spark, distance, stretch):
    rng = np.random.default_rng(distance)
    traces = {"noise": [(i, float(rng.integers(0, 9))) for i in sorted(rng.choice(600, 250, replace=False).tolist())], "ramp": [(2 * i, float(i)) for i in range(80)], "fall": [(3 * i, -float(i)) for i in range(80)], "flat": [(i, 1.0) for i in range(50)]}
    df = spark.createDataFrame([(k, p, s) for k, v in traces.items() for p, s in v], "k string, pos long, score double").repartition(5)
    got = halos.separated(df, ["k"], distance, stretch).collect()
    assert sorted(map(tuple, got)) == sorted((k, p, s) for k, v in traces.items() for p, s in own_separated(v, distance))


def test_no_group_of_rows_is_sent_to_python(spark):
    scores = halos.filter_scores(blocks(spark, 8), ["k"], "t0", "x", 8, np.array([-1.0, 2.0, -0.5]))
    found = halos.separated(halos.local_peaks(scores, ["k"], 8), ["k"], 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan and "take" in plan and "score" in plan


def test_filter_needs_every_channel_whole(spark):
    # of a only channel 0 has a block at 8, so the lengths differ at 0; of b the ends differ; c is too short; a null key is a key
    rows = [(k, c, at, [1.0 * c + i for i in range(n)]) for k, c, at, n in (("a", 0, 0, 8), ("a", 1, 0, 8), ("a", 0, 8, 8), ("b", 0, 16, 5), ("b", 1, 16, 4), ("c", 0, 0, 3), ("c", 1, 0, 3), (None, 0, 0, 8), (None, 1, 0, 8))]
    got = halos.filter_scores(spark.createDataFrame(rows, "k string, c int, t0 long, x array<double>"), ["k"], "t0", "x", 8, np.ones((2, 4)), "c").collect()
    assert [(r.k, r.t0) for r in got] == [(None, 0)]
    assert np.allclose(got[0].scores, [sum(2 * (i + j) + 1 for j in range(4)) / np.sqrt(8) for i in range(5)])


def test_accepted_and_candidates(spark):
    s = RNG.normal(size=200).round(3)
    scores = spark.createDataFrame([("a", at, [float(v) for v in s[at : at + 16]]) for at in range(0, 200, 16)], "k string, t0 long, scores array<double>")
    onsets = [0, 3, 40, 77, 130, 131, 199, 500]
    accepted, free = halos.matched_candidates(scores, spark.createDataFrame([("a", t) for t in onsets], "k string, t long"), ["k"], "t", 16, near=4, distance=9, share=0.5)
    places = {}
    for t in onsets[:-1]:
        lo, hi = max(t - 4, 0), min(t + 5, 200)
        places[t] = lo + int(np.argmax(s[lo:hi]))
    assert sorted((r.t, r["at"], r.score) for r in accepted.collect()) == sorted((t, p, s[p]) for t, p in places.items())
    floor = 0.5 * np.mean([s[p] for p in places.values()])
    want = [(p, v) for p, v in own_separated([(p, s[p]) for p in own_peaks(s)], 9) if all(abs(p - q) > 4 for q in places.values()) and v >= floor]
    assert sorted((r.pos, r.score) for r in free.collect()) == want


def test_scan_windows_are_cut_and_repeatable(spark):
    bursts = spark.createDataFrame([("a", 5, 9), ("a", 95, 99)], "k string, t0 long, t1 long")
    lengths = spark.createDataFrame([("a", 100), ("b", 7)], "k string, total long")
    run = lambda seed: sorted(map(tuple, halos.scan_windows(bursts, "k", 10, lengths, 5, 20, seed).collect()))
    got = run(1)
    assert got == run(1) != run(2) and [r for r in got if r[3] == "burst"] == [("a", 0, 19, "burst"), ("a", 85, 100, "burst")]
    drawn = [r for r in got if r[3] == "drawn"]
    assert len(drawn) == 10 and all(0 <= t0 and t1 - t0 == 20 <= 100 if k == "a" else (t0, t1) == (0, 7) for k, t0, t1, _ in drawn)


def test_basis_is_that_of_the_svd(spark):
    x = RNG.normal(size=(80, 5)) * [5, 1, 3, 0.5, 0.1] + [3, -2, 0, 1, 1]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(99, None), (98, [float("nan")] * 5)], "i int, w array<double>").repartition(6)
    mean, found = halos.basis(df, "w", 3)
    want = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:3]
    want = np.array([-v if v[1] > 0 else v for v in want])
    assert np.allclose(mean, x.mean(0)) and np.allclose(found, want, atol=1e-8)
    got = np.array([[r.pc1, r.pc2, r.pc3] for r in halos.project(df.filter("i < 80"), "w", mean, found).orderBy("i").collect()])
    assert np.allclose(got, (x - x.mean(0)) @ want.T, atol=1e-8)
    with pytest.raises(ValueError):
        halos.basis(df.limit(0), "w")
