"""Vector codes, license scans and collocations against DuckDB and plain Python, and their edge cases."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import collocations, license_scan, vector_codes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(None if pd.isna(v) else float(v) if isinstance(v, (float, np.floating)) else str(v) for v in r) for r in df.itertuples(index=False)), key=str)


def in_duckdb(sql: str, **tables: pd.DataFrame) -> pd.DataFrame:
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df)
    return con.sql(sql).df()


def norm(df: pd.DataFrame) -> list[tuple]:
    return [tuple(str(int(v)) if isinstance(v, float) and v == int(v) and not isinstance(v, bool) else v for v in r) for r in plain(df)]


@pytest.mark.parametrize("name,sql,run", [("embeddings", vector_codes.SQL, vector_codes.compress), ("documents", license_scan.SQL, license_scan.scan), ("documents", collocations.SQL, collocations.collocations)])
def test_whole_table_against_sql(spark, sf_dir, name, sql, run):
    got = run(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    con = duckdb.connect()
    con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    want = con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got.toPandas()) == norm(want)


# vector codes


def own_codes(rows, parts, entries, rounds):
    x = np.array([[int(np.floor(256 * float(v))) for v in r[1]] for r in rows], np.int64)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, list(x[i])))
    books = x[order[:entries]].reshape(-1, parts, x.shape[1] // parts).transpose(1, 0, 2)
    cut = x.reshape(len(x), parts, -1)

    def assign():
        d = ((cut[:, :, None, :] - books[None]) ** 2).sum(-1)
        return d.argmin(-1), d.min(-1)

    for _ in range(rounds):
        codes = assign()[0]
        books = np.array([[cut[codes[:, p] == e, p].sum(0) // max((codes[:, p] == e).sum(), 1) if (codes[:, p] == e).any() else books[p, e] for e in range(books.shape[1])] for p in range(parts)])
    codes, errors = assign()
    return ["".join(f"{c:02x}" for c in r) for r in codes], errors.sum(1), books


def test_codes_with_ties_nulls_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=8).astype(np.float32)], int(i % 3) if i % 7 else None) for i in range(90)]
    rows += [(3, rows[3][1], 1), (3, rows[5][1], 1), (None, rows[8][1], None)]
    bad = [(200, None, 1), (201, [None] * 8, 1), (202, [float("nan")] + [0.0] * 7, 1), (203, [float("-inf")] * 8, 2)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + bad], "vec_id long, embedding array<float>, label int, code string, error int").repartition(5)
    got = vector_codes.compress(df, parts=4, entries=6)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    codes, errors, books = own_codes(rows, 4, 6, 2)
    by_label = Counter()
    for r, e in zip(rows, errors):
        by_label[r[2]] += int(e)
    want = sorted(((r[0], c, int(e), by_label[r[2]]) for r, c, e in zip(rows, codes, errors)), key=str)
    found = got.collect()
    assert sorted((tuple(r)[:4] for r in found), key=str) == want and len({r.codebooks_sha256 for r in found}) == 1
    trained = vector_codes.train(df, parts=4, entries=6)[1]
    assert (trained == books).all()
    near = vector_codes.decode(got, trained).filter("vec_id = 10").first().vector
    assert len(near) == 8 and np.abs(np.floor(np.array(near) * 256) - books[range(4), [int(codes[10][2 * p : 2 * p + 2], 16) for p in range(4)]].ravel()).max() == 0


def test_codes_of_little(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compress(spark.createDataFrame([], kind)).count() == 0
    one = vector_codes.compress(spark.createDataFrame([(9, [0.5] * 16, None), (10, [0.5] * 16, None)], kind)).collect()
    assert sorted(tuple(r)[:4] for r in one) == [(9, "00" * 16, 0, 0), (10, "00" * 16, 0, 0)]
    for rows in ([(1, [0.5] * 15, 1)], [(1, [0.5] * 16, 1), (2, [0.5] * 32, 1)], [(1, [1e30] * 16, 1)]):
        with pytest.raises(Exception):
            vector_codes.compress(spark.createDataFrame(rows, kind)).collect()


# license scans

MIT = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this... The above notice shall be included in all copies or\n substantial portions of the Software."


def test_licenses(spark):
    texts = {
        1: "Released under the MIT License. See the mit-license, MIT  LICENSE!",
        2: MIT,
        3: MIT.split("The above")[0],
        4: "shall be included in all copies or substantial portions of the software, " + MIT.split("The above")[0],
        5: MIT.split("The above")[0] + " word" * 500 + " shall be included in all copies or substantial portions of the software",
        6: "licensed under the GNU General Public License, version 3; general public; license general",
        7: None,
        8: "",
        9: " -- \n ",
        10: "lizenz " * 30_000 + "apache license " * 500,
        11: "Licensed under CC BY-NC 4.0.",
        12: "mitlicense mit élicense ÉMIT license mit license",
        13: "permission " * 2000 + MIT + " charge" * 2000,
        14: "K mit K license",
    }
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in texts.items()] + [(1, texts[1], None, None), (None, texts[1], None, None)], "doc_id long, text string, w string, at0 int")
    got = license_scan.scan(df)
    assert norm(got.toPandas()) == norm(in_duckdb(license_scan.SQL, documents=df.toPandas()))
    by = {r.doc_id: r for r in got.collect()}
    assert (by[1].n_base, by[1].first_word, by[1].last_word, by[1].labels, by[1].score) == (3, 3, 9, "mit", 1.0)
    assert [by[i].labels for i in (2, 3, 4, 5, 6, 11, 13)] == ["mit", "", "", "", "gpl", "cc-by-nc", "mit"] and by[2].base_labels == "" and by[2].score == 1.0 and 0 < by[3].score < 1
    assert (by[7].n_words, by[7].n_base, by[7].first_word, by[7].labels, by[7].score) == (0, 0, None, "", 0.0) and by[10].n_base == 500 and by[12].n_base == 1
    assert got.count() == len(texts) + 2 and license_scan.scan(df.limit(0)).count() == 0


def test_every_template_is_found_whatever_the_frequencies(spark):
    texts = [" x y ".join(phrases) for _, phrases in license_scan.TEMPLATES]
    noise = [" ".join(random.Random(i).choices(license_scan.VOCABULARY, k=400)) for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts + noise)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    for i, (label, _) in enumerate(license_scan.TEMPLATES):
        assert label in got[i].labels.split(",") and got[i].score == 1.0


def test_license_scan_needs_no_python_worker(spark, sf_dir):
    plan = license_scan.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Exchange" not in plan


# collocations


def own_collocations(rows, least, best):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.setdefault(lang, Counter()).update(zip(*[w[i:] for i in range(k)]))
    out = []
    for lang, counts in f.items():
        c = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in c.items():
            cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if not any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in c.items()):
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:best], 1)]
    return sorted(out)


def corpus():
    rng = random.Random(7)
    words = ["the", "of", "New", "york", "é", "É", "日本", "a b", "x-y", "\x00"] + [f"w{i}" for i in range(40)]
    rows = []
    for i in range(150):
        text = "".join(rng.choice(words[:6] if rng.random() < 0.6 else words) + rng.choice([" "] * 12 + ["\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randint(0, 80)))
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), text))
    return rows + [("en", None), (None, None), ("fr", ""), ("en", "the the the the the the " * 40)] + [("de", "immer das gleiche lied hier")] * 40


@pytest.mark.parametrize("small", [False, True])
def test_collocations_against_brute_force(spark, monkeypatch, small):
    if small:  # several parts of a text, hot prefixes in several tasks
        monkeypatch.setattr(collocations, "CHUNK", 64)
        monkeypatch.setattr(collocations, "HOT", 40)
    rows = corpus()
    df = spark.createDataFrame([(i, t, la, 1, "x") for i, (la, t) in enumerate(rows)], "doc_id long, text string, lang string, n int, phrase string").repartition(7)
    got = collocations.collocations(df, least=8, best=50)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = own_collocations(rows, 8, 50)
    assert len(want) > 20 and sorted(map(tuple, got.collect())) == want


def test_collocations_where_nothing_may_be_broadcast(spark, monkeypatch):
    held = collocations._broadcast
    monkeypatch.setattr(collocations, "_broadcast", lambda df: None if len(df.columns) == 1 else held(df))
    rows = corpus()
    df = spark.createDataFrame([(la, t) for la, t in rows], "lang string, text string")
    assert sorted(map(tuple, collocations.collocations(df, least=8, best=50).collect())) == own_collocations(rows, 8, 50)


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([("en", None), (None, "  "), ("en", "a b")], "lang string, text string")
    assert collocations.collocations(df).count() == 0 and collocations.collocations(df.limit(0)).count() == 0


def test_large_counts_are_exact(spark):
    df = spark.createDataFrame([(4_700_000_000_123, 9_000_000_000_000_001, 5)], "f long, l long, r long")
    assert df.select(F.expr(collocations.SCORE)).first()[0] == 2_000_000 * 4_700_000_000_123 // 9_000_000_000_000_006


def test_parts_of_a_text_end_between_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 10)
    for text in (b"", b"abc", b"a.b.c.d.e.f.g.h.i.j.k", b"aaaaaaaaaaaaaaaaaaaaaaaa.b", b".........................", b"aaaaaaaaaaaaaaaaaaaa"):
        parts = list(collocations._parts(text))
        assert b"".join(parts) == text and all(p.startswith(b".") for p in parts[1:])
