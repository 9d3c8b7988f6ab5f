"""Record files written by the test are read back over several ranges, pruned, checked and refused."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.sources import documents, record_files


def settings(path, data, fields, more="Clock rate: 30000\n"):
    path.write_bytes(f"<Start settings>\nDescription: a test\n{more}Fields: {fields}\n<End settings>\n".encode() + data.tobytes())
    return str(path)


@pytest.fixture
def packets(tmp_path):
    kind = np.dtype([("time", "<u4"), ("state", "u1"), ("pos", "<f4", (2,))])
    data = np.zeros(1000, kind)
    data["time"] = np.arange(1000) + (np.arange(1000) >= 300) * 50 + (np.arange(1000) >= 700) * 3_000_000_000
    data["state"], data["pos"] = np.arange(1000) % 256, np.arange(2000).reshape(-1, 2) / 4
    return data, settings(tmp_path / "a.dat", data[:600], "<time uint32><state uint8><pos 2*single>"), settings(tmp_path / "b.dat", data[600:], "<time uint32><state uint8><pos 2*single>", "Clock rate: 30000\nDirection: in\n")


@pytest.mark.parametrize("size", [7, 250, 10_000])
def test_records_of_two_files(spark, packets, size):
    data, a, b = packets
    df = record_files.records(spark, [a, b], records=size, expect=1000)
    assert df.schema.simpleString() == "struct<part:int,row:bigint,time:bigint,state:smallint,pos:array<float>>" and df.rdd.getNumPartitions() == -(-600 // size) + -(-400 // size)
    got = df.orderBy("row").collect()
    assert [(r.part, r.row, r.time, r.state, r.pos) for r in got] == [(int(i >= 600), i, int(d["time"]), int(d["state"]), d["pos"].tolist()) for i, d in enumerate(data)]
    assert record_files.records(spark, [a], columns="state").columns == ["part", "row", "state"]


def test_files_that_are_not_whole_are_refused(spark, packets, tmp_path):
    data, a, _ = packets
    (tmp_path / "cut.dat").write_bytes(open(a, "rb").read()[:-3])
    (tmp_path / "no.dat").write_bytes(b"x" * 100_000)
    other = settings(tmp_path / "other.dat", data["time"], "<time uint32>")
    for paths, options in (([str(tmp_path / "cut.dat")], {}), ([str(tmp_path / "no.dat")], {}), ([a, other], {}), ([a], {"expect": 1001}), ([a], {"columns": "nothing"})):
        with pytest.raises(Exception):
            record_files.records(spark, paths, **options).collect()
    empty = settings(tmp_path / "empty.dat", data[:0], "<time uint32><state uint8><pos 2*single>")
    assert record_files.records(spark, [empty]).count() == 0 and record_files.layout(a)[2]["Clock rate"] == "30000"


def test_clock_from_the_counter(spark, packets):
    data, a, b = packets
    clock = record_files.records(spark, [a, b], columns="time", records=100)
    segments = record_files.clock_segments(clock)
    assert sorted(map(tuple, segments.select("row0", "row1", "time0", "whole").collect())) == [(0, 299, 0, True), (300, 699, 350, True), (700, 999, 3_000_000_750, True)]
    assert sorted(map(tuple, record_files.recording_gaps(segments).collect())) == [(300, 300, 350, 50), (700, 750, 3_000_000_750, 3_000_000_000)]
    events = spark.createDataFrame([(s,) for s in (0, 299, 300, 699, 700, 999, 1000, None)], "s long")
    want = {s: None if s is None or s > 999 else int(data["time"][s]) for s in (0, 299, 300, 699, 700, 999, 1000, None)}
    assert {r.s: r.clock for r in record_files.on_clock(events, segments, "s").collect()} == want
    back = spark.createDataFrame([(0, 5), (1, 6), (2, 5), (3, 8)], "row long, time long")
    assert not all(r.whole for r in record_files.clock_segments(back.union(spark.createDataFrame([(4, 6), (6, 11)], "row long, time long"))).collect())


def test_many_stretches_meet_in_buckets(spark, packets, monkeypatch):
    monkeypatch.setattr(record_files, "MOST_PARTS", 0)
    test_clock_from_the_counter(spark, packets)


def test_spike_arrays(spark, tmp_path):
    t, u = np.sort(np.random.default_rng(0).integers(0, 10**10, 500)), np.random.default_rng(1).integers(0, 9, 500).astype(np.int32)
    np.save(tmp_path / "spike_times.npy", t.reshape(-1, 1)), np.save(tmp_path / "spike_clusters.npy", u)
    got = record_files.spike_arrays(spark, str(tmp_path), records=64).orderBy("row").collect()
    assert [(r.t, r.unit) for r in got] == list(zip(t.tolist(), u.tolist()))
    np.save(tmp_path / "spike_clusters.npy", u[:-1])
    with pytest.raises(ValueError):
        record_files.spike_arrays(spark, str(tmp_path))
    np.save(tmp_path / "two.npy", np.zeros((3, 2)))
    with pytest.raises(ValueError):
        record_files.layout(str(tmp_path / "two.npy"))


def test_documents_geometry_verdicts_and_label_columns(spark, tmp_path):
    (tmp_path / "probe.json").write_text('{"chanMap": [1, 0], "xc": [0.5, 1.5], "yc": [10, 20], "kcoords": [0, 1]}')
    assert sorted(map(tuple, documents.geometry(spark, str(tmp_path / "probe.json")).collect())) == [(0, 1.5, 20.0, 1), (1, 0.5, 10.0, 0)]
    folder = tmp_path / "verdicts"
    folder.mkdir()
    for i, v in ((7, "merge"), (12, "keep")):
        (folder / f"{i}.json").write_text(f'{{"ts": {i * 100},\n "verdict": "{v}"}}')
    assert sorted(map(tuple, documents.verdict_files(spark, str(folder)).collect())) == [("12", "keep", 1200), ("7", "merge", 700)]
    scores = spark.createDataFrame([(3, 0.5, "good"), (1, None, "mua")], "unit int, amp double, grp string")
    documents.write_label_columns(scores, "unit", str(tmp_path / "out"))
    assert sorted(map(tuple, documents.labels_tsv(spark, str(tmp_path / "out" / "cluster_grp"), "grp").collect())) == [(1, "mua"), (3, "good")]
    assert sorted(map(tuple, documents.labels_tsv(spark, str(tmp_path / "out" / "cluster_amp"), "amp").collect())) == [(1, None), (3, "0.5")]
