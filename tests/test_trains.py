"""Small cases of the event-train operators with known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import bands, event_windows, matching, sequence


def trains(spark, *times):
    return spark.createDataFrame([(k, 1000 * k + i, t) for k, ts in enumerate(times) for i, t in enumerate(ts)], "unit int, event_id long, t long")


def test_short_trains(spark):
    rows = {r.unit: r for r in sequence.interval_statistics(trains(spark, [5], [5, 6], [0, 10, 30]), "unit", "t", 2, 1.0).collect()}
    assert (rows[0].n_events, rows[0].refractory_rate, rows[0].cv) == (1, 0.0, None)
    assert (rows[1].refractory_rate, rows[1].lv) == (1.0, None)
    assert rows[2].cv == pytest.approx(5 / 15) and rows[2].lv == pytest.approx(3 * (10 / 30) ** 2)


def test_empty_windows_count(spark):
    r = sequence.window_rates(trains(spark, [0, 1, 2, 95]), "unit", "t", 10, 100, 1.0).first()
    counts = [3, 0, 0, 0, 0, 0, 0, 0, 0, 1]
    mean = sum(counts) / 10
    assert r.mean_rate == 0.04 and r.rate_cv == pytest.approx(math.sqrt(sum((c - mean) ** 2 for c in counts) / 10) / mean, rel=1e-6)


@pytest.mark.parametrize("times, depths, kept", [([50, 250], [-20, -15], [50, 250]), ([50, 55], [-20, -30], [55]), ([50, 55], [-30, -20], [50])])
def test_dead_time(spark, times, depths, kept):
    df = spark.createDataFrame([(0, t, d) for t, d in zip(times, depths)], "unit int, t long, depth int")
    assert sorted(r.t for r in sequence.thin(df, "unit", "t", 200, "depth").collect()) == kept


def test_thinning_over_many_islands(spark, monkeypatch):
    monkeypatch.setattr(sequence, "ISLANDS", 2)
    rng = random.Random(1)
    times = sorted(rng.sample(range(3000), 300))
    want, last = [], -(10**9)
    for t in times:
        if t - last >= 15:
            want.append(t)
            last = t
    assert sorted(r.t for r in sequence.thin(trains(spark, times).drop("event_id"), "unit", "t", 15).collect()) == want


@pytest.mark.parametrize("depth", [None, "depth"])
def test_thinning_of_a_train_without_gaps_over_many_batches(spark, depth):
    rng = random.Random(2)
    rows = [(k, 10 * i + rng.randrange(10), rng.choice([None, *range(50)]), i) for k in ("a", None) for i in range(700)]
    df = spark.createDataFrame(rows + [("a", None, 1, 9)], "unit string, t long, depth int, tag int")
    want = []
    for k in ("a", None):
        kept = []
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            if not kept or r[1] - kept[-1][1] >= 25:
                kept.append(r)
            elif depth and r[2] is not None and (kept[-1][2] is None or r[2] < kept[-1][2]):
                kept[-1] = r
        want += kept
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sequence.thin(df, "unit", "t", 25, depth).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_poisson_tail():
    for k, mean in [(1, 0.1), (3, 0.5), (10, 2.0), (2, 30.0), (50, 60.0), (80, 60.0)]:
        exact = 1 - sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(k))
        if exact > 1e-9:
            assert 10 ** -sequence.surprise(k, 1.0, mean) == pytest.approx(exact, rel=1e-5)
    assert sequence.surprise(200, 1e-3, 1.0) == 300 and sequence.surprise(3, 1.0, 0) == 0


def test_bursts_are_found(spark):
    quiet = list(range(0, 100_000, 1000))
    burst = [50_100 + 5 * i for i in range(8)]
    found = sequence.bursts(trains(spark, sorted(quiet + burst), [1, 2]), "unit", "t", 15, 1000.0).collect()
    assert [(r.unit, r.t0, r.t1, r.n_events) for r in found] == [(0, 50_100, 50_135, 8)] and found[0].surprise > 5


def brute_bursts(times, seed, ticks, least=3, least_surprise=2.0, reach=200):
    """Runs by their definition, one event at a time."""
    rate = len(times) * ticks / (times[-1] - times[0])
    value = lambda a, b: sequence.surprise(b - a + 1, rate, (times[b] - times[a]) / ticks)
    out, at = [], 0
    while at < len(times) - 1:
        if times[at + 1] - times[at] >= seed:
            at += 1
            continue
        ends = []
        for b in range(at + 1, min(at + reach + 1, len(times))):
            if ends and value(at, b) <= max(v for v, _ in ends) and times[b] - times[b - 1] > 3 * seed:
                break
            ends.append((value(at, b), -b))
        best, last = max(ends)[0], -max(ends)[1]
        first = at
        while last - first >= least and value(first + 1, last) >= best:
            first += 1
        if last - first + 1 >= least and best >= least_surprise:
            out.append((times[first], times[last], last - first + 1))
        at = last + 1
    return out


def test_bursts_against_their_definition(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for unit in range(4):
        t, times = 0, []
        for _ in range(700):
            t += rng.choice([rng.randint(1, 12), rng.randint(1, 12), rng.randint(20, 900)]) if rng.random() < 0.6 else rng.randint(200, 3000)
            times.append(t)
        want[unit] = brute_bursts(times, 15, 1000.0)
        rows += [(unit, x) for x in times]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "90")  # trains over several batches
    try:
        found = sequence.bursts(spark.createDataFrame(rows, "unit long, t long"), "unit", "t", 15, 1000.0).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {u: sorted((r.t0, r.t1, r.n_events) for r in found if r.unit == u) for u in want} == want and sum(map(len, want.values())) > 40


def test_band_join_equals_the_plain_join(spark):
    rng = random.Random(2)
    a = spark.createDataFrame([(rng.randint(0, 2), rng.randint(-500, 500)) for _ in range(150)], "k int, ta long")
    b = spark.createDataFrame([(rng.randint(0, 2), rng.randint(-500, 500)) for _ in range(150)], "k int, tb long")
    left, right = a.collect(), b.collect()
    for lo, hi in [(-7, 7), (0, 20), (-30, -10), (5, 5)]:
        got = sorted(map(tuple, bands.band_join(a, b, "ta", "tb", lo, hi, ["k"]).select("k", "ta", "tb").collect()))
        want = sorted((x.k, x.ta, y.tb) for x in left for y in right if x.k == y.k and lo <= y.tb - x.ta <= hi)
        assert got == want


def test_correlogram_is_symmetric_and_its_last_bin_closed(spark):
    rows = {r.bin: r.n for r in bands.autocorrelogram(trains(spark, [0, 10, 40]), "unit", "t", "event_id", 40, 10).collect()}
    assert rows == {1: 1, 3: 2, -1: 1, -3: 1, -4: 1}
    none = bands.violation_ratio(bands.autocorrelogram(trains(spark, [0, 1]), "unit", "t", "event_id", 40, 10), "unit", 10, 10, (20, 40)).first()
    assert (none.n_refractory, none.ratio) == (2, math.inf)


@pytest.mark.parametrize("test, ref, hits", [([100, 101, 102, 500], [100, 500], 2), ([100], [100, 500], 1), ([], [1], 0), ([95, 105], [100], 1)])
def test_one_to_one(spark, test, ref, hits):
    r, t = trains(spark, ref), trains(spark, test)
    pairs = matching.one_to_one(r, t, "unit", "t", 5)
    assert pairs.count() == hits
    s = matching.match_scores(r, t, pairs, "unit").first()
    assert s.recall == hits / len(ref) and (s.precision == hits / len(test) if test else s.precision is None)


def test_one_to_one_against_a_plain_scan(spark):
    rng = random.Random(3)
    ref, test = sorted(rng.choices(range(400), k=80)), sorted(rng.choices(range(400), k=80))
    free, want = list(test), []
    for r in ref:
        near = [x for x in free if abs(x - r) <= 4]
        if near:
            x = min(near, key=lambda v: (abs(v - r), v))
            free.remove(x)
            want.append((r, x))
    got = matching.one_to_one(trains(spark, ref), trains(spark, test), "unit", "t", 4).collect()
    assert sorted((r.t_ref, r.t_test) for r in got) == sorted(want)


def nearest_unused(refs, tests, tolerance):
    """Each ref event in order takes the first of the nearest unused test events, whatever its distance, and leaves it beyond the tolerance."""
    free, pairs = sorted(tests), []
    for r in sorted(refs):
        if free and abs((x := min(free, key=lambda v: (abs(v - r), v))) - r) <= tolerance:
            free.remove(x)
            pairs.append((r, x))
    return pairs


@pytest.mark.parametrize("step", [1, 3])
def test_one_to_one_of_trains_without_gaps_over_many_batches(spark, step):
    rng = random.Random(step)
    draw = lambda: [sorted(rng.choices(range(0, 900, step), k=600)) for _ in range(2)]
    ref, test = draw(), draw()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        got = matching.one_to_one(trains(spark, *ref), trains(spark, *test), "unit", "t", 6).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = [(k, *pair) for k in range(2) for pair in nearest_unused(ref[k], test[k], 6)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_self_comparison(spark):
    e = trains(spark, [1, 5, 9, 13])
    s = matching.match_scores(e, e, matching.one_to_one(e, e, "unit", "t", 0), "unit").first()
    assert (s.recall, s.precision) == (1.0, 1.0)


def test_as_of_at_equal_times(spark):
    m, e = trains(spark, [10, 20]), trains(spark, [10, 15])
    after = {r.t: r.found for r in event_windows.first_after(m, e, "unit", "t", "t").collect()}
    before = {r.t: r.found for r in event_windows.last_before(m, e, "unit", "t", "t").collect()}
    assert after == {10: 10, 20: None} and before == {10: None, 20: 15}


def test_windows_are_half_open_and_keep_zeros(spark):
    m = spark.createDataFrame([(0, 1, 100), (1, 2, 100)], "unit int, marker int, tm long")
    e = spark.createDataFrame([(0, 90), (0, 100), (0, 110)], "unit int, te long")
    rows = {r.marker: (r.base, r.resp) for r in event_windows.window_counts(m, e, ["unit"], "marker", "tm", "te", {"base": (-10, 0), "resp": (0, 10)}).collect()}
    assert rows == {1: (1, 1), 2: (0, 0)}


def test_smoothing_keeps_the_sum_inside(spark):
    h = spark.createDataFrame([(0, 10, 5)], "unit int, bin long, n long")
    rows = event_windows.gaussian_smoothed(h, ["unit"], 21, 1.0).agg(F.sum("smooth"), F.max("smooth")).first()
    assert rows[0] == pytest.approx(5) and rows[1] < 5
