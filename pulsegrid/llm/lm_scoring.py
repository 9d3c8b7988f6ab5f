"""Word bigram language model with interpolated modified Kneser-Ney smoothing.

Spark counts the model; its counts are sorted arrays of 64-bit hashes in the shared folder, and the workers that
score memory-map them. Pairs are dealt to a grid of shards, by the hash of the first word in one direction and of
the second in the other, so a word that begins or ends a large share of all pairs is spread over a row or a column
of the grid, and sums per word meet from few shards.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import local_path, work_dir, written
from pulsegrid.llm.kneser_ney import discounts

SEED = 42
#: Characters handled at once, tokens of a counting block, bytes of text per shard, least side of the grid.
CHUNK, BLOCK_TOKENS, SHARD_BYTES, LEAST_SIDE = 1 << 21, 1_000_000, 1 << 24, 8
MEMO = 300_000
BLOBS = "shard int, blob binary"
FIELDS = ("c", "n1", "n2", "n3", "pred")


class _Hashes(dict):
    """Hash of each word; begun anew when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMO:
            self.clear()
        self[word] = got = xxhash.xxh64_intdigest(word, SEED)
        return got


#: Hashes of texts that hold a blank, which no word does.
BEGIN, END = (np.uint64(_Hashes()[x]) for x in (b"begin of text", b"end of text"))


def _tokens(text: str, hashes: _Hashes) -> np.ndarray:
    """Hashes of the words and the end."""
    words = text.encode().lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    out[-1] = END
    return out


def _before(tokens: np.ndarray) -> np.ndarray:
    return np.concatenate([[BEGIN], tokens[:-1]]).astype(np.uint64)


def _mixed(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One hash of a pair."""
    with np.errstate(over="ignore"):
        x = (v ^ (v >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + w
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))


def _grid(v: np.ndarray, w: np.ndarray, side: int) -> np.ndarray:
    return ((v % np.uint64(side)) * np.uint64(side) + w % np.uint64(side)).astype(np.int64)


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of equal length, the first sorted: its steps and the others in their least width, compressed."""
    import zstandard

    first = columns[0].copy()
    first[1:] -= columns[0][:-1]
    out = [np.int64(len(first)).tobytes(), np.int64(len(columns)).tobytes()]
    for c in (first, *columns[1:]):
        kind = np.min_scalar_type(c.max()) if len(c) else np.dtype(np.uint8)
        out += [bytes([kind.itemsize]), c.astype(kind).tobytes()]
    return zstandard.compress(b"".join(out), 1)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.decompress(blob)
    n, k = np.frombuffer(raw, np.int64, 2).tolist()
    at, out = 16, []
    for _ in range(k):
        kind = np.dtype(f"u{raw[at]}")
        out.append(np.frombuffer(raw, kind, n, at + 1).astype(np.uint64))
        at += 1 + n * kind.itemsize
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def _summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct keys in order, with the sums of the values."""
    if not len(keys[0]):
        return keys, values
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    return [k[first] for k in keys], [np.add.reduceat(v[order], first) for v in values]


def _dealt(shard: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    cuts = np.flatnonzero(np.diff(shard)) + 1
    for rows in np.split(order, cuts) if len(order) else []:
        yield rows, [c[rows] for c in columns]


def _blob_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "blob"])


def _counter(side: int):
    """Counts the pairs of training texts block by block."""

    def blobs(v: list[np.ndarray], w: list[np.ndarray]) -> pa.RecordBatch:
        keys = [np.concatenate(v), np.concatenate(w)]
        (a, b), (c,) = _summed(keys, [np.ones(len(keys[0]), np.uint64)])
        shard = _grid(a, b, side)
        return _blob_batch([(int(shard[rows[0]]), _packed(*columns)) for rows, columns in _dealt(shard, [a, b, c])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, v, w, held = _Hashes(), [], [], 0
        for batch in batches:
            for text in batch.column(0):
                tokens = _tokens(text.as_py() or "", hashes)
                v.append(_before(tokens))
                w.append(tokens)
                held += len(tokens)
                if held >= BLOCK_TOKENS:
                    yield blobs(v, w)
                    v, w, held = [], [], 0
        if held:
            yield blobs(v, w)

    return run


def _save(path: str, array: np.ndarray) -> None:
    """Written beside and moved: a task that runs twice leaves one whole file."""
    draft = f"{path}.{uuid.uuid4().hex}"
    with open(draft, "wb") as f:
        np.save(f, array)
    os.replace(draft, path)


def _pair_shard(folder: str, side: int):
    """Sums a shard's pairs, writes their arrays, and gives what each word contributes to its row of the word table."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        v, w, c = map(np.concatenate, zip(*(_unpacked(b.as_py()) for b in table.column("blob"))))
        (v, w), (c,) = _summed([v, w], [c])
        key = _mixed(v, w)
        order = np.argsort(key)
        key, n = key[order], c[order]
        os.makedirs(folder, exist_ok=True)
        _save(f"{folder}/one-{shard}.npy", key[n == 1])
        _save(f"{folder}/more-{shard}.npy", key[n > 1])
        _save(f"{folder}/count-{shard}.npy", n[n > 1].astype(np.uint32 if n.max() < 1 << 32 else np.uint64))
        one = np.ones(len(c), np.uint64)
        by_first = _summed([v], [c, *((c == k).astype(np.uint64) for k in (1, 2)), (c > 2).astype(np.uint64)])
        by_second = _summed([w], [one])
        (first,), (second,) = by_first[0], by_second[0]
        columns = [np.concatenate([f, np.zeros(len(second), np.uint64)]) for f in by_first[1]] + [np.concatenate([np.zeros(len(first), np.uint64), by_second[1][0]])]
        (words,), columns = _summed([np.concatenate([first, second])], columns)
        rows = []
        dealt = (words % np.uint64(side * side)).astype(np.int64)
        for at, part in _dealt(dealt, [words, *columns]):
            rows.append((int(dealt[at[0]]), _packed(*part)))
        seen = [[int((c == k).sum())] + [0] * (len(rows) - 1) for k in (1, 2, 3, 4)]
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary())} | {f"k{k}": pa.array(s, pa.int64()) for k, s in enumerate(seen, 1)})

    return run


def _word_shard(folder: str):
    """Sums a shard's words, writes their arrays, and gives its totals."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        x, *columns = map(np.concatenate, zip(*(_unpacked(b.as_py()) for b in table.column("blob"))))
        (x,), columns = _summed([x], columns)
        _save(f"{folder}/word-{shard}.npy", x)
        for name, column in zip(FIELDS, columns):
            _save(f"{folder}/{name}-{shard}.npy", column.astype(np.uint32 if not len(column) or column.max() < 1 << 32 else np.uint64))
        c, pred, begin = columns[0], columns[-1], x == BEGIN
        totals = {"n_texts": int(c[begin].sum()), "words": int(c[~begin].sum()), "kinds": int((c[~begin] > 0).sum()), "pairs": int(pred.sum())}
        totals |= {f"t{k}": int((pred == k).sum()) for k in (1, 2, 3, 4)} | {"t5": int((pred > 4).sum())}
        return pa.table({k: pa.array([v], pa.int64()) for k, v in totals.items()})

    return run


@dataclass(frozen=True)
class BigramModel:
    """Where the arrays are, and the constants of the smoothing."""

    folder: str
    side: int
    n_texts: int
    train_tokens: int
    kinds: int
    pairs: int
    high: tuple[float, float, float]
    low: tuple[float, float, float]
    low_mass: float


TOTALS = ("n_texts", "words", "kinds", "pairs", "t1", "t2", "t3", "t4", "t5")


def train(docs: DataFrame, text_col: str = "text") -> BigramModel:
    """Counts all texts of ``docs`` (nulls as empty ones); only sums of counts reach the driver."""
    spark = docs.sparkSession
    path = work_dir(spark, "bigrams")
    folder = local_path(path)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    side = max(LEAST_SIDE, math.ceil(math.sqrt(size / SHARD_BYTES)))
    blobs = docs.select(text_col).mapInArrow(_counter(side), BLOBS)
    parts = written(blobs.groupBy("shard").applyInArrow(_pair_shard(folder, side), BLOBS + ", k1 long, k2 long, k3 long, k4 long"), "words")
    k = [x or 0 for x in parts.agg(*[F.sum(f"k{i}") for i in (1, 2, 3, 4)]).first()]
    per_shard = parts.select("shard", "blob").groupBy("shard").applyInArrow(_word_shard(folder), ", ".join(f"{t} long" for t in TOTALS))
    total = {t: v or 0 for t, v in zip(TOTALS, per_shard.agg(*[F.sum(t) for t in TOTALS]).first())}
    low = discounts(total["t1"], total["t2"], total["t3"], total["t4"])
    mass = low[0] * total["t1"] + low[1] * total["t2"] + low[2] * sum(total[t] for t in ("t3", "t4", "t5"))
    return BigramModel(folder, side, total["n_texts"], total["words"] + total["n_texts"], total["kinds"] + (total["n_texts"] > 0), total["pairs"], discounts(*k), low, mass)


def _discount(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(c == 0, 0.0, np.where(c == 1, d[0], np.where(c == 2, d[1], d[2])))


class Scorer:
    """Looks up counts in the memory-mapped arrays of a model."""

    def __init__(self, model: BigramModel):
        self.m, self.open = model, {}

    def array(self, name: str, shard: int) -> np.ndarray | None:
        key = (name, shard)
        if key not in self.open:
            path = f"{self.m.folder}/{name}-{shard}.npy"
            self.open[key] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
        return self.open[key]

    def found(self, keys: np.ndarray, name: str, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """Which sorted keys are in a sorted array, and where."""
        held = self.array(name, shard)
        if held is None or not len(held):
            return np.zeros(len(keys), bool), np.zeros(0, np.int64)
        at = np.searchsorted(held, keys)
        there = at < len(held)
        there[there] = held[at[there]] == keys[there]
        return there, at[there]

    def words(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """The fields of distinct sorted words; the end's count is that of the texts."""
        out = {f: np.zeros(len(x), np.int64) for f in FIELDS}
        for rows, (part,) in _dealt((x % np.uint64(self.m.side**2)).astype(np.int64), [x]):
            shard = int(part[0] % np.uint64(self.m.side**2))
            there, at = self.found(part, "word", shard)
            for f in FIELDS if there.any() else ():
                out[f][rows[there]] = self.array(f, shard)[at]
        return out

    def pairs(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        out, key, shards = np.zeros(len(v), np.int64), _mixed(v, w), _grid(v, w, self.m.side)
        for rows, (part, shard) in _dealt(shards, [key, shards]):
            order = np.argsort(part)
            rows, part, shard = rows[order], part[order], int(shard[0])
            there, _ = self.found(part, "one", shard)
            out[rows[there]] = 1
            there, at = self.found(part, "more", shard)
            if there.any():
                out[rows[there]] = self.array("count", shard)[at]
        return out

    def score(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, base score and model score of each text, a text being the hashes of its tokens."""
        m = self.m
        w, v = np.concatenate(texts), np.concatenate([_before(t) for t in texts])
        starts = np.cumsum([0] + [len(t) for t in texts[:-1]])
        kinds, back = np.unique(np.concatenate([w, v]), return_inverse=True)
        at_w, at_v = back[: len(w)], back[len(w) :]
        f = self.words(kinds)
        c = np.where(kinds == END, m.n_texts, np.where(kinds == BEGIN, 0, f["c"]))
        base = np.log10((c + 0.1) / (m.train_tokens + 0.1 * (m.kinds + 1)))
        if m.pairs:
            uni = (f["pred"] - _discount(f["pred"], m.low) + m.low_mass / (m.kinds + 1)) / m.pairs
        else:
            uni = np.ones(len(kinds))
        pair_at, pair_back = np.unique(_mixed(v, w), return_index=True, return_inverse=True)[1:]
        pair = self.pairs(v[pair_at], w[pair_at])[pair_back]
        seen = f["c"]
        left = (m.high[0] * f["n1"] + m.high[1] * f["n2"] + m.high[2] * f["n3"]) / np.maximum(seen, 1)
        left = np.where(seen > 0, left, 1.0)
        p = (pair - _discount(pair, m.high)) / np.maximum(seen[at_v], 1) + left[at_v] * uni[at_w]
        return np.add.reduceat((c > 0)[at_w].astype(np.int64), starts), np.add.reduceat(base[at_w], starts), np.add.reduceat(np.log10(p), starts)


def score(docs: DataFrame, model: BigramModel, id_col: str = "doc_id", text_col: str = "text", more: dict[str, Column] | None = None) -> DataFrame:
    """``(id, more..., n_tokens, n_known, train_tokens, base_score, score, perplexity)`` for every row.

    Texts are lower-cased (A-Z) and cut at white space; an end token closes each, so null and empty texts score
    their end. Unknown words share one unknown type. Narrow: no shuffle.
    """
    more = more or {}
    narrow = docs.select(F.col(text_col).alias("__text"), F.col(id_col), *[c.alias(k) for k, c in more.items()])
    names = narrow.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, hashes = Scorer(model), _Hashes()

        def done(part: pa.RecordBatch, texts: list[np.ndarray]) -> pa.RecordBatch:
            known, base, own = scorer.score(texts)
            n = np.array([len(t) for t in texts])
            values = [pa.array(n), pa.array(known), pa.array(np.full(len(n), model.train_tokens)), pa.array(base), pa.array(own), pa.array(10 ** (-own / n))]
            return pa.RecordBatch.from_arrays([*part.columns[1:], *values], names=[*names, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

        for batch in batches:
            texts, held, first = [], 0, 0
            for i, text in enumerate(batch.column(0)):
                text = text.as_py() or ""
                texts.append(_tokens(text, hashes))
                held += len(text)
                if held >= CHUNK:
                    yield done(batch.slice(first, i + 1 - first), texts)
                    texts, held, first = [], 0, i + 1
            if texts:
                yield done(batch.slice(first), texts)

    kinds = ", ".join(f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in names)
    return narrow.mapInArrow(run, f"{kinds}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
