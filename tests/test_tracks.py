"""Tracks, matching across sessions, equal acceptance and matched draws against plain loops."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import statistics, tracks

RNG = np.random.default_rng(21)


def own_links(nodes, least, gaps):
    r = lambda a, b: float(np.corrcoef(a, b)[0, 1])
    links = {}
    for step in range(1, gaps + 2):
        taken_a, taken_b = set(links), {v[0] for v in links.values()}
        score = {}
        for w, a, va in nodes:
            for x, b, vb in nodes:
                if x == w + step and a not in taken_a and b not in taken_b and np.std(va) > 0 and np.std(vb) > 0:
                    score[a, b] = round(r(va, vb), 9)
        best_a, best_b = {}, {}
        for (a, b), s in sorted(score.items(), key=lambda x: (-x[1], x[0])):
            best_a.setdefault(a, b), best_b.setdefault(b, a)
        links |= {a: (b, step) for a, b in best_a.items() if best_b[b] == a and score[a, b] >= least}
    return links


@pytest.mark.parametrize("gaps", [0, 2])
def test_tracks_with_splits_and_gaps(spark, gaps):
    shapes = RNG.normal(size=(4, 12))
    nodes = []
    for w in range(9):
        for s in range(4):
            if (w, s) in {(3, 0), (5, 1), (6, 1), (4, 2), (5, 2), (6, 2), (7, 2)}:
                continue
            nodes.append((w, 10 * w + s, [float(v) for v in shapes[s] + RNG.normal(scale=0.15, size=12)]))
            if s == 3 and w > 5:  # a split: two alike in one window
                nodes.append((w, 10 * w + 7, [float(v) for v in shapes[s] + RNG.normal(scale=0.15, size=12)]))
    nodes.append((4, 49, [1.0] * 12))
    df = spark.createDataFrame(nodes, "w int, n long, v array<double>").withColumn("size", F.lit(2))
    links = tracks.window_links(df, "w", "n", "v", 0.8, gaps)
    want = own_links([(w, n, np.array(v)) for w, n, v in nodes], 0.8, gaps)
    assert {r.a: (r.b, r.step) for r in links.collect()} == want
    back = {b: a for a, (b, _) in want.items()}

    def root(n):
        return n if n not in back else root(back[n])

    tracked = tracks.tracks(df, links, "n")
    got = {r.n: r.track for r in tracked.collect()}
    assert got == {n: root(n) for _, n, _ in nodes}
    lives = {r.track: r for r in tracks.lifetimes(tracked, "w", 9, "size").collect()}
    for t, r in lives.items():
        ws = [w for w, n, _ in nodes if root(n) == t]
        assert len(ws) == len(set(ws)) == r.n_windows and (r.first, r.last, r.n_missing, r.total) == (min(ws), max(ws), max(ws) - min(ws) + 1 - len(ws), 2 * len(ws)) and r.long_lived == (len(ws) >= 6.3)
    assert lives[0].n_windows == (8 if gaps else 3)


def test_calibration_counts_orphans(spark):
    n = 40
    score = RNG.normal(size=(n, n)) * 0.3 + np.eye(n) * RNG.uniform(0, 2, n)
    pairs = spark.createDataFrame([(i, j, float(score[i, j])) for i in range(n) for j in range(n) if abs(i - j) < 6], "a long, b long, score double")
    got = {r.threshold: r for r in tracks.calibration(pairs, spark.range(n).toDF("unit"), [-5.0, 0.5, 1.0, 9.0]).collect()}
    lost = {i for i in range(n) if int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % 2 == 0}
    near = np.where(np.abs(np.subtract.outer(range(n), range(n))) < 6, score, -np.inf)

    def best(s):
        return {i: int(s[i].argmax()) for i in range(n) if np.isfinite(s[i].max()) and int(s[:, s[i].argmax()].argmax()) == i}

    without = near.copy()
    without[:, list(lost)] = -np.inf
    for t, r in got.items():
        m = {i: j for i, j in best(near).items() if near[i, j] >= t}
        o = {i for i, j in best(without).items() if i in lost and without[i, j] >= t}
        right = sum(i == j for i, j in m.items())
        assert (r.n_units, r.n_matched, r.n_right, r.n_orphans, r.n_orphans_matched) == (n, len(m), right, len(lost), len(o))
        assert r.recall == right / n and r.orphan_rate == len(o) / len(lost) and (r.precision == right / len(m) if m else r.precision is None)
    rates = {t: r.orphan_rate for t, r in got.items()}
    assert tracks.least_threshold(tracks.calibration(pairs, spark.range(n).toDF("unit"), [-5.0, 0.5, 1.0, 9.0]), 0.2).first().threshold == min(t for t in rates if all(rates[u] <= 0.2 for u in rates if u >= t))


def test_fisher_score_tells_pairs_apart(spark):
    x = np.concatenate([RNG.normal([1, 0, 0], 0.5, (60, 3)), RNG.normal([0, 0, 1], 0.5, (90, 3))])
    df = spark.createDataFrame([(*map(float, r), i < 60) for i, r in enumerate(x)], "f double, g double, h double, same boolean")
    scored, w = tracks.pair_score(df, ["f", "g", "h"], "same")
    pooled = (59 * np.cov(x[:60].T) + 89 * np.cov(x[60:].T)) / 148
    want = np.linalg.solve(pooled, x[:60].mean(0) - x[60:].mean(0))
    assert np.allclose(w, want / np.linalg.norm(want), atol=1e-6)
    assert np.allclose(sorted(r.score for r in scored.collect()), sorted(x @ w))


def test_chains(spark):
    ab, bc, ac = (spark.createDataFrame(v, s) for v, s in (([(1, 10), (2, 20), (3, 30), (4, 40)], "a long, b long"), ([(10, 100), (20, 200), (30, 300)], "b long, c long"), ([(1, 100), (2, 999), (5, 500)], "a long, c long")))
    checked = tracks.chain_check(ab, bc, ac)
    assert sorted(map(tuple, checked.collect())) == [(1, 10, 100, 100, True), (2, 20, 200, 999, False), (3, 30, 300, None, None)]
    assert tuple(tracks.chain_summary(checked).first()) == (3, 2, 1, 0.5)


def test_equal_acceptance_with_ties(spark):
    rows = [(g, i, float(RNG.integers(0, 5)), None if i % 9 == 0 else float(RNG.normal()), bool(RNG.integers(0, 2)), bool(RNG.random() < (0.3 if g != "none" else 0))) for g in ("a", "none", None) for i in range(80)]
    df = spark.createDataFrame(rows, "g string, i long, p double, q double, ok boolean, gate boolean").repartition(5)
    got = {(r.g, r.scorer): (r.n_accepted, r.n_true, r.precision) for r in tracks.accepted_equally(df, ["g"], ["p", "q"], "gate", "ok", "i").collect()}
    for g in ("a", None):
        own = [r for r in rows if r[0] == g]
        k = sum(r[5] for r in own)
        assert got[g, "gate"][:2] == (k, sum(r[4] for r in own if r[5]))
        for c, at in (("p", 2), ("q", 3)):
            top = sorted(own, key=lambda r: (-(r[at] if r[at] is not None else -math.inf), r[1]))[:k]
            assert got[g, c] == (k, sum(r[4] for r in top), sum(r[4] for r in top) / k)
    assert got["none", "gate"] == (0, 0, None) and ("none", "p") not in got


def test_equal_acceptance_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(statistics, "WHOLE", 20)
    monkeypatch.setattr(statistics, "PIECES", 5)
    windows = []
    numbered = tracks.numbered
    monkeypatch.setattr(tracks, "numbered", lambda *a: windows.append(a) or numbered(*a))
    test_equal_acceptance_with_ties(spark)
    assert windows[0][1:3] == (["__key", "scorer"], ["__tie"])


def test_matched_draws(spark):
    rows = [("s", "deep", i) for i in range(400)] + [("s", "high", i) for i in range(1000, 1007)] + [("t", "deep", i) for i in range(5)] + [("u", "deep", 1), ("u", "high", 2), ("u", "high", 3)]
    df = spark.createDataFrame(rows, "g string, half string, k long").repartition(4)
    got = sorted(map(tuple, tracks.matched_draws(df, ["g"], "half", "k", 3, seed=5, least=1).collect()))
    want = []
    for g, k in (("s", 7), ("u", 1)):
        for d in (1, 2, 3):
            for half in ("deep", "high"):
                own = sorted((hashlib.md5(f"5|{d}|{i}".encode()).hexdigest(), i) for a, h, i in rows if a == g and h == half)[:k]
                want += [(g, d, half, i) for _, i in own]
    assert got == sorted(want)


def test_person_periods(spark):
    df = spark.createDataFrame([(1, 0, 35, 100), (2, 0, None, 25), (3, 0, 90, 30), (4, 5, 9, 50), (5, None, 1, 1)], "trial long, t0 long, ev long, stop long")
    got = sorted(map(tuple, tracks.person_periods(df, ["trial"], "t0", "ev", "stop", 10, 10).collect()))
    assert got == [(1, 0, 10, False), (1, 1, 20, False), (1, 2, 30, True), (2, 0, 10, False), (2, 1, 20, False), (3, 0, 10, False), (3, 1, 20, False), (3, 2, 30, False)]
