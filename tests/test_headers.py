"""Headers written by the test, documents of decisions in all their shapes, and states by plain rules."""

import itertools

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import tiers
from pulsegrid.operators import lineage
from pulsegrid.sources import documents, headers


def header(gains, channels, more=""):
    tags = "".join(f'<SpikeNTrode id="{i}" {g}><SpikeChannel hwChan="{h}" {c}/></SpikeNTrode>' for i, (g, (h, c)) in enumerate(zip(gains, channels)))
    return f"<?xml?><Configuration {more}>{tags}</Configuration>"


ONE, TWO = 'spikeScalingToUv="0.195"', 'spikeScalingToUv="0.25"'
MAP = [(3, 'coord_ml="10" coord_dv="-20"'), (1, 'coord_ml="0"')]


def test_gain_and_map(spark, tmp_path):
    files = {"a": header([ONE, ONE], MAP), "b": header([ONE, ONE], MAP, 'date="later"'), "c": header([ONE, ONE], MAP[::-1]), "d": "no end"}
    for name, text in files.items():
        (tmp_path / f"{name}.rec").write_bytes(text.encode() + b"\x00\xff" * 5000)
    got = {r.path[-5]: r.header for r in headers.texts(spark, [str(tmp_path / f"{n}.rec") for n in files]).collect()}
    assert got == {**files, "d": None}
    df = spark.createDataFrame([(n, t) for n, t in got.items()], "name string, header string")
    assert [r.gain for r in headers.gains(df.filter("name < 'd'")).collect()] == [0.195] * 3
    for bad in (header([ONE, TWO], MAP), header(["", ""], MAP), None):
        with pytest.raises(Exception, match="one gain is needed"):
            headers.gains(spark.createDataFrame([(bad,)], "header string")).collect()
    maps = {r.name: r for r in headers.channel_maps(df).collect()}
    assert maps["a"].electrodes == ["0", "1"] and [tuple(c) for c in maps["a"].channels] == [("3", "10", None, "-20"), ("1", "0", None, None)]
    assert maps["a"].fingerprint == maps["b"].fingerprint != maps["c"].fingerprint and maps["d"].fingerprint is None
    history = sorted((r["first"], r["last"], r.n) for r in headers.map_history(headers.channel_maps(df), "name").collect())
    assert history == [("a", "b", 2), ("c", "c", 1)]


def values(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_merges_in_each_shape(spark):
    texts = ['{"merges": [{"parents": [9, 2], "merged_id": 40, "note": "n", "quality_label": "good", "more": {"x": 1}}, [7, 3, 5]]}', "[[2, 1]]", ' [{"parents": [4]}]', '{"merges": []}', None]
    got = sorted((tuple(r.parents), r.merged_id, r.note, r.decided, r.quality_label) for r in documents.merge_entries(values(spark, *texts)).collect())
    assert got == [((1, 2), None, None, None, None), ((2, 9), 40, "n", None, "good"), ((3, 5, 7), None, None, None, None), ((4,), None, None, None, None)]
    for bad in ('[{"parents": [1], "quality_label": "fine"}]', '[{"note": "x"}]', "[[]]"):
        with pytest.raises(Exception):
            documents.merge_entries(values(spark, bad)).collect()


def test_selections_in_each_shape(spark):
    texts = ['{"selections": {"7": {"ranges": [{"t0": 1, "t1": 2.5}, {"t0": 4, "t1": 5}]}, "_note": "x", "8": {"ranges": []}, "9": {}}}', '{"3": [{"t0": 0, "t1": 1}], "_made": "by hand", "4": []}', "{}", None]
    assert sorted(map(tuple, documents.selection_ranges(values(spark, *texts)).collect())) == [(3, 0, 0.0, 1.0), (7, 0, 1.0, 2.5), (7, 1, 4.0, 5.0)]
    with pytest.raises(Exception):
        documents.selection_ranges(values(spark, '{"3": [{"t0": 0}]}')).collect()


def plain_state(joined, superseded, saved, live, units, finished):
    if joined:
        return tiers.STATES[0]
    if saved == 0 and not live:
        return tiers.STATES[1 if superseded else 2]
    if live is None or live != saved:
        return tiers.STATES[3 if live is None else 4 if live > saved else 5]
    return tiers.STATES[8 if units and live >= units else 6 if finished else 7]


def test_states_and_clocks(spark):
    rows = list(itertools.product([None, True], [False, True], [0, 2, 5], [None, 0, 2, 5], [None, 0, 2, 4, 9], [None, True]))
    df = spark.createDataFrame(rows, "j boolean, s boolean, saved int, live int, units int, f boolean")
    got = df.withColumn("state", tiers.review_state(*map(F.col, df.columns))).collect()
    assert len(got) == len(rows) and {r.state for r in got} == set(tiers.STATES)
    assert all(r.state == plain_state(*r[:6]) for r in got)
    cases = [(1.0, 10.0, 5, 5, "pass"), (1.0, 10.0, None, 5, "pass"), (1.0, 50.0, 5, 5, "check"), (1.0, None, 5, 5, "check"), (1.0, 0.0, 5, 5, "check"), (1.0, 1.0, 4, 5, "check"), (0.99, 1.0, 5, 5, "check"), (0.98, 1.0, 5, 5, "FAIL"), (None, 1.0, 5, 5, "unknown")]
    clocks = spark.createDataFrame(cases, "matched double, worst double, valid int, trials int, want string")
    assert all(r.got == r.want for r in clocks.withColumn("got", tiers.sync_verdict(*map(F.col, clocks.columns[:4]))).collect())


def test_precedence(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (None, "c")], "id int, label string")
    high = spark.createDataFrame([(1, "x"), (1, "y"), (2, None), (None, "z")], "id int, label string")
    low = spark.createDataFrame([(1, "l"), (2, "m"), (9, "n")], "id int, label string")
    got = sorted(map(tuple, lineage.by_precedence(rows, "id", "label", [("phy", high), ("manual", low)]).collect()), key=str)
    assert got == sorted([(1, "y", "phy"), (2, "m", "manual"), (3, None, "auto"), (None, "c", "auto")], key=str)
