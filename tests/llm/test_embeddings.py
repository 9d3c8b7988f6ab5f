import numpy as np
import pytest

from pulsegrid.llm import embedding_dedup as ed

from .test_simhash import brute_components


def brute(rows, least=0.9):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: v / np.linalg.norm(v) for i, v in good}
    ids = list(unit)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least]
    n = {i: 0 for i, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return n, brute_components(links, n)


def vectors(seed, groups, size, noise, dim=16, alone=150):
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=dim) for _ in range(alone)]
    for _ in range(groups):
        c = rng.normal(size=dim)
        out += [c + noise * rng.normal(size=dim) for _ in range(size)]
    return [(int(i), [float(x) for x in v]) for i, v in enumerate(out)]


@pytest.mark.parametrize("seed, groups, size, noise", [(1, 6, 12, 0.05), (2, 1, 60, 0.1), (3, 20, 3, 0.3)])
def test_against_brute_force(spark, monkeypatch, seed, groups, size, noise):
    monkeypatch.setattr(ed, "BLOCK", 25)
    rows = vectors(seed, groups, size, noise)
    rows += [(500 + i, v) for i, v in enumerate([rows[0][1], rows[0][1], None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1e308] * 16, [1e-300] * 16, [1.0, 2.0], [2.0, 4.0]])]
    n, groups_of = brute([(i, None if v is None else v if i not in (507, 508) else [1.0] * 16) for i, v in rows])
    got = {r.vec_id: r for r in ed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == len(rows)
    found, true = sum(r.n_links for r in got.values()), sum(n.values())
    assert all(got[i].n_links <= n[i] for i in n) and found >= 0.95 * true
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    if found == true:
        assert {i: r.component_id for i, r in got.items()} == groups_of


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(800, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    z = rng.normal(size=a.shape)
    z -= (z * a).sum(1)[:, None] * a
    z /= np.linalg.norm(z, axis=1)[:, None]
    b = 0.905 * a + np.sqrt(1 - 0.905**2) * z
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(np.vstack([a, b]))]
    got = ed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.selectExpr("sum(n_links)").first()[0] >= 0.9 * 1600


def test_no_rows_and_no_good_rows(spark):
    df = spark.createDataFrame([(1, None), (None, [1.0]), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, ed.near_duplicates(df).collect()), key=str) == [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, None)]
    assert ed.near_duplicates(df.limit(0)).count() == 0
    one = spark.createDataFrame([(7, [1.0, 2.0], 3)], "vec_id long, embedding array<float>, n int")
    assert [tuple(r) for r in ed.near_duplicates(one).collect()] == [(7, 0, 7, True)]


def test_a_narrow_cone(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 25)
    rng = np.random.default_rng(6)
    axis = rng.normal(size=16)
    rows = [(i, [float(x) for x in axis + 0.4 * rng.normal(size=16)]) for i in range(80)]
    rows += [(100, [1.0, 2.0]), (101, [1.0, 2.1]), (102, [2.0, 4.0])]
    n, groups = brute(rows)
    assert sum(n.values()) > 100 and all(n[i] == 2 for i in (100, 101, 102))
    got = {r.vec_id: r for r in ed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert {i: r.n_links for i, r in got.items()} == n and {i: r.component_id for i, r in got.items()} == groups


def test_a_dense_group_and_two_rows(spark):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=32)
    rows = [(i, [float(x) for x in centre + 0.05 * rng.normal(size=32)]) for i in range(40)]
    got = ed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [r.n_links for r in got] == [39] * 40 and {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1
    two = spark.createDataFrame(rows[:2], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, ed.near_duplicates(two).collect())) == [(0, 1, 0, True), (1, 1, 0, False)]


@pytest.mark.parametrize("offset", [0.5, 1.0, 1.5])
def test_recall_of_anisotropic_vectors(spark, offset):
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    a = unit(unit(rng.normal(size=(500, 48)) / np.sqrt(np.arange(1, 49))) + offset * unit(rng.normal(size=(1, 48))))
    z = rng.normal(size=a.shape)
    z = unit(z - (z * a).sum(1)[:, None] * a)
    x = np.vstack([a, 0.91 * a + np.sqrt(1 - 0.91**2) * z])
    true = int(((x @ x.T) >= 0.9).sum()) - len(x)
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    assert 0.95 * true <= ed.near_duplicates(frame).selectExpr("sum(n_links)").first()[0] <= true


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_registered_table(spark, sf):
    frame = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = frame.select("vec_id", "embedding").collect()
    n, groups = brute_matrix([r.vec_id for r in rows], np.array([r.embedding for r in rows], float))
    got = {r.vec_id: r for r in ed.near_duplicates(frame).collect()}
    assert len(got) == len(rows) and all(got[i].n_links <= n[i] for i in n)
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(n.values())
    if sum(r.n_links for r in got.values()) == sum(n.values()):
        assert {i: r.component_id for i, r in got.items()} == groups


def brute_matrix(ids, x):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    a, b = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    n = np.bincount(a, minlength=len(x)) + np.bincount(b, minlength=len(x))
    return dict(zip(ids, n.tolist())), brute_components([(ids[i], ids[j]) for i, j in zip(a, b)], ids)


def test_no_pair_at_the_threshold_is_rounded(spark):
    # cosines within 1e-9 of 0.9 on either side, far within the error of the 16-bit copies
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for i in range(30):
        a = rng.normal(size=24)
        a /= np.linalg.norm(a)
        z = rng.normal(size=24)
        z -= (z @ a) * a
        z /= np.linalg.norm(z)
        t = 0.9 + (1e-9 if i % 2 else -1e-9)
        rows += [(2 * i, [float(v) for v in a]), (2 * i + 1, [float(v) for v in t * a + np.sqrt(1 - t * t) * z])]
        want[2 * i] = i % 2
    got = {r.vec_id: r.n_links for r in ed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert {i: got[i] for i in want} == want
