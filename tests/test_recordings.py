"""Recording folders: census, labels with the parent's as fallback, children of clusters, sharded folders."""

import json

import pytest

from pulsegrid.operators import waveforms
from pulsegrid.sources import recordings


def test_census_of_sizes(spark, tmp_path):
    a, b = "20260101_101500", "20260102_090000"
    for sid, probe in ((a, 2 * 4 * 30), (b, None)):
        folder = tmp_path / f"{sid}.rec"
        (folder / f"{sid}.kilosort").mkdir(parents=True)
        (folder / f"{sid}.rec").write_bytes(b"x" * 11)
        if probe:
            (folder / f"{sid}.kilosort" / f"{sid}.probe1.dat").write_bytes(b"\0" * probe)
    (tmp_path / f"{a}.rec" / "notes.txt").write_text("no recording")
    got = {r.session: r for r in recordings.census(spark, str(tmp_path), n_chan=4, rate=10.0).collect()}
    assert set(got) == {a, b}
    starts = recordings.census(spark, str(tmp_path)).selectExpr("session", "date_format(start, 'yyyy-MM-dd HH:mm:ss') AS s").collect()
    assert {r.session: r.s for r in starts} == {a: "2026-01-01 10:15:00", b: "2026-01-02 09:00:00"}
    assert (got[a].rec_bytes, got[a].probe_bytes, got[a].samples, got[a].seconds, got[a].exact) == (11, 240, 30, 3.0, True)
    assert (got[b].rec_bytes, got[b].probe_bytes, got[b].samples, got[b].seconds, got[b].exact) == (11, None, None, None, False)
    with (tmp_path / f"{a}.rec" / f"{a}.kilosort" / f"{a}.probe1.dat").open("ab") as f:
        f.write(b"\0")
    assert [r.exact for r in recordings.census(spark, str(tmp_path), n_chan=4).filter(f"session = '{a}'").collect()] == [False]


def test_labels_fall_back_to_the_parent(spark, tmp_path):
    child = tmp_path / "original"
    child.mkdir()
    assert recordings.nearest_labels(spark, str(child), "KSLabel").count() == 0
    (tmp_path / "cluster_KSLabel.tsv").write_text("cluster_id\tKSLabel\n1\tgood \nx\tmua\n")
    got = lambda: sorted(map(tuple, recordings.nearest_labels(spark, f"{child}/", "KSLabel").collect()))
    assert got() == [(1, "good")]
    (child / "cluster_KSLabel.tsv").write_text("cluster_id\tKSLabel\n")
    assert got() == [(1, "good")]
    (child / "cluster_KSLabel.tsv").write_text("cluster_id\tKSLabel\n7\tmua\n")
    assert got() == [(7, "mua")]


def test_children_keep_their_parents(spark):
    events = spark.createDataFrame([(15, 1.0), (16, 2.0)], "unit int, t double")
    found = spark.createDataFrame([(15, 1.5, "x"), (None, 1.7, "y")], "unit int, t double, note string")
    got = recordings.with_children(events, found, "unit")
    assert got.schema == events.schema
    assert sorted(map(tuple, got.collect())) == [(15, 1.0), (16, 2.0), (1015, 1.5)]


def test_shards_hold_ids_in_a_row(spark, tmp_path):
    rows = spark.range(60).selectExpr("id AS unit", "concat('é', id) AS doc", "CAST(id AS STRING) AS shard")
    sizes = {r.shard: (r.n, r.bytes) for r in recordings.write_shards(rows, "unit", str(tmp_path / "out"), per_file=4).collect()}
    assert {k: n for k, (n, _) in sizes.items()} == {0: 25, 1: 25, 2: 10}
    for k, (n, size) in sizes.items():
        files = list((tmp_path / "out" / f"shard={k}").glob("*.txt"))
        lines = [x for f in files for x in f.read_text().splitlines()]
        assert sorted(json.loads(x)["unit"] for x in lines) == list(range(25 * k, 25 * k + n))
        assert sum(f.stat().st_size for f in files) == size and all(len(f.read_text().splitlines()) <= 4 for f in files)
    with pytest.raises(ValueError):
        recordings.write_shards(rows, "unit", str(tmp_path / "over"), ceiling=100)
    assert not (tmp_path / "over").exists()


def test_consistency_with_few_waves_and_nulls(spark):
    waves = spark.createDataFrame([("a", [1.0, 0.0])] * 3 + [("a", [0.0, 1.0])] * 3 + [("a", None), ("b", [1.0, 2.0]), ("c", None)], "g string, w array<double>")
    got = {r.g: (r.n, r.score) for r in waveforms.consistency(waves, ["g"], "w").collect()}
    assert got.keys() == {"a", "b"} and got["b"] == (1, None)
    assert got["a"][0] == 6 and got["a"][1] == pytest.approx(0.5**0.5)
