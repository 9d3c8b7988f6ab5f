"""Exact rank tests against full enumeration, with and without ties."""

import itertools
import math

import duckdb
import numpy as np

from pulsegrid.operators import statistics
from pulsegrid.plans.registry import ORACLES, QUERIES


def midranks(v):
    v = np.asarray(v)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def groups():
    rng = np.random.default_rng(31)
    out = []
    for g in range(14):
        n = int(rng.integers(2, 13))
        v = rng.normal(size=n).round(3) if g % 2 else rng.integers(-3, 4, n).astype(float)
        out += [(None if g == 3 else g, float(x), bool(p)) for x, p in zip(v, rng.integers(0, 2, n))]
    return out + [(99, float(i), i % 2 == 0) for i in range(30)] + [(5, None, True), (6, 1.0, None)]


def test_rank_sums(spark):
    rows = groups()
    got = {r.g: r for r in statistics.exact_mann_whitney(spark.createDataFrame(rows, "g int, v double, pos boolean").repartition(3), ["g"], "v", "pos", 12).collect()}
    seen = 0
    for g in {r[0] for r in rows}:
        own = [(v, p) for a, v, p in rows if a == g and v is not None and p is not None]
        n1 = sum(p for _, p in own)
        if len(own) > 12 or n1 in (0, len(own)):
            assert g not in got
            continue
        r = midranks([v for v, _ in own])
        obs, mid = sum(x for x, (_, p) in zip(r, own) if p), n1 * (len(own) + 1) / 2
        far = [abs(sum(c) - mid) >= abs(obs - mid) - 1e-9 for c in itertools.combinations(r, n1)]
        assert (got[g].n1, got[g].n0) == (n1, len(own) - n1) and got[g].u == obs - n1 * (n1 + 1) / 2 and math.isclose(got[g].p, np.mean(far))
        seen += 1
    assert seen > 8


def test_signed_ranks(spark):
    rows = groups()
    got = {r.g: r for r in statistics.exact_wilcoxon(spark.createDataFrame(rows, "g int, v double, pos boolean").repartition(3), ["g"], "v", 12).collect()}
    for g in {r[0] for r in rows}:
        own = [v for a, v, _ in rows if a == g and v]
        if not own or len(own) > 12:
            assert g not in got
            continue
        r = midranks(np.abs(own))
        obs, mid = sum(x for x, v in zip(r, own) if v > 0), len(own) * (len(own) + 1) / 4
        far = [abs(sum(x for x, s in zip(r, signs) if s) - mid) >= abs(obs - mid) - 1e-9 for signs in itertools.product((0, 1), repeat=len(own))]
        assert got[g].n == len(own) and got[g].w == obs and math.isclose(got[g].p, np.mean(far))


def test_halves_are_rounded_as_the_sql_rounds_them(spark, tmp_path):
    # 150000.5 is no difference, 149998.5 and 150001.5 are both 2 from the middle
    prices = [(1, 150000.5), (1, 149990.0), (1, 150020.0), (2, 149998.5), (2, 150001.5), (2, 150002.25), (2, 149990.0), (3, 150000.5)]
    spark.createDataFrame(prices, "o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    want = con.sql(ORACLES["wilcoxon_exact"]).fetchall()
    got = QUERIES["wilcoxon_exact"](spark, str(tmp_path)).select("o_custkey", "n", "w", "p").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 2
