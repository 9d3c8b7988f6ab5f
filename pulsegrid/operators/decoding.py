"""Linear decoding from sums: penalties chosen inside folds, and nulls of permuted and of circularly shifted targets.

One scan adds up the products of features and targets in each fold of a group. Training without a fold is the total
less the fold, and squared errors of a held-out fold follow from its sums, so every penalty, every fold and every
inner fold is a small solve. Nulls are further target columns of the same sums: no copy of the table for each seed.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.statistics import _group, numbered

#: Consecutive rows of a group that a task holds; runs of a group are longer where there would be more than RUNS, as each run may send values to each.
RUN, RUNS = 16_384, 8192
#: Rounds of a permutation of a group of several runs.
ROUNDS = 8


class _Sums:
    """Sums of one or several folds: of products of (1, features), of these with the targets, and of squared targets."""

    def __init__(self, flat: np.ndarray, d: int, t: int):
        self.flat, self.d, self.t = flat, d, t
        a, b = (d + 1) ** 2, (d + 1) * t
        self.xx, self.xy, self.yy = flat[:a].reshape(d + 1, d + 1), flat[a : a + b].reshape(d + 1, t), flat[a + b :]

    def __sub__(self, other: _Sums) -> _Sums:
        return _Sums(self.flat - other.flat, self.d, self.t)

    @property
    def n(self) -> float:
        return self.xx[0, 0]

    def ridge(self, alpha: float) -> np.ndarray:
        """``(1 + d, t)``: intercept and weights; the penalty is on features scaled to unit deviation, as the sums give it."""
        mean, target = self.xx[0, 1:] / self.n, self.xy[0] / self.n
        scale = np.sqrt(np.maximum(np.diag(self.xx)[1:] / self.n - mean**2, 0)) + 1e-9
        xx = (self.xx[1:, 1:] - self.n * np.outer(mean, mean)) / np.outer(scale, scale)
        xy = (self.xy[1:] - self.n * np.outer(mean, target)) / scale[:, None]
        w = np.linalg.lstsq(xx + alpha * np.eye(self.d), xy, rcond=None)[0] / scale[:, None]
        return np.vstack([target - mean @ w, w])

    def errors(self, w: np.ndarray) -> np.ndarray:
        """Sums of the squared errors of each target, never below 0."""
        return np.maximum(self.yy - 2 * (w * self.xy).sum(axis=0) + (w * (self.xx @ w)).sum(axis=0), 0)


def _flat(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = np.column_stack([np.ones(len(x)), x])
    return np.concatenate([(z.T @ z).ravel(), (z.T @ y).ravel(), (y * y).sum(axis=0)])


def _columns(y: np.ndarray, groups: str, permutations: int, shifts: int, seed: int) -> np.ndarray:
    """The targets of a group of one run, permuted ones and circularly shifted ones, as columns; the draws follow from the group's and run's name."""
    rng = np.random.default_rng([seed, *groups.encode()])
    mixed = [rng.permutation(y) for _ in range(permutations)]
    turned = [np.roll(y, int(s)) for s in (rng.integers(1, len(y), shifts) if len(y) > 1 else np.zeros(shifts, int))]
    return np.column_stack([y, *mixed, *turned])


def _mixed(places: np.ndarray, n: int, rng: np.random.Generator, back: bool) -> np.ndarray:
    """Where a permutation of 0 to n - 1, which is drawn as random functions of some sqrt(n) values, has what comes to ``places``; ``back``: where it brings what is there.

    A place is a row and a column of a rectangle of n places or some more; each round moves all rows by a random function of the column or the other way round.
    Steps that leave the n places are gone on with, so each of these is taken once.
    """
    sides = (isqrt(n - 1) + 1, -(-n // (isqrt(n - 1) + 1)))
    rounds = [(r % 2, rng.integers(0, sides[r % 2], sides[1 - r % 2])) for r in range(ROUNDS)]

    def step(x: np.ndarray) -> np.ndarray:
        at = list(divmod(x, sides[1]))
        for moved, by in reversed(rounds) if back else rounds:
            at[moved] = (at[moved] - by[at[1 - moved]] if back else at[moved] + by[at[1 - moved]]) % sides[moved]
        return at[0] * sides[1] + at[1]

    out = step(places)
    while len(over := np.flatnonzero(out >= n)):
        out[over] = step(out[over])
    return out


def _moved(places: np.ndarray, n: int, name: str, permutations: int, shifts: int, seed: int, back: bool = False) -> np.ndarray:
    """``(nulls, places)``: from where in a group of n rows each null target takes the value at these places; ``back``: where it takes theirs to."""
    mixed = [_mixed(places, n, np.random.default_rng([seed, k, *name.encode()]), back) for k in range(permutations)]
    by = np.random.default_rng([seed, *name.encode()]).integers(1, n, shifts)
    return np.stack([*mixed, *[(places + s if back else places - s) % n for s in by]])


def _packed(x: np.ndarray) -> bytes:
    """Doubles compressed, after their number: targets repeat values more often than not."""
    return x.size.to_bytes(8, "little") + pa.compress(x.tobytes(), "zstd", asbytes=True)


def _unpacked(held: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(held[8:], 8 * int.from_bytes(held[:8], "little"), "zstd"))


def _sent(to: np.ndarray, y: np.ndarray, run: int) -> list[tuple[int, np.ndarray]]:
    """``(run, values)`` for each run that gets values: in the order of null targets, then of the places they come from."""
    runs = (to // run).astype(np.int16).ravel()
    order = np.argsort(runs, kind="stable")
    found, first = np.unique(runs[order], return_index=True)
    return list(zip(found.tolist(), np.split(y[order % len(y)], first[1:])))


def _received(source: np.ndarray, values: np.ndarray, run: int) -> np.ndarray:
    """The null targets as columns, from what the runs sent, in their order."""
    inner = (np.argsort(source, axis=1) + np.arange(len(source))[:, None] * source.shape[1]).ravel()
    order = inner[np.argsort((source // run).astype(np.int16).ravel()[inner], kind="stable")]
    out = np.empty(source.size)
    out[order] = values
    return out.reshape(source.shape).T


def fold_sums(
    rows: DataFrame, by: list[str], order: list[str], features: list[str], target: str, fold: Column, permutations: int = 0, shifts: int = 0, seed: int = 0, run: int = RUN
) -> DataFrame:
    """``(by..., fold, sums)``: the packed sums of each group's folds, those of null targets included.

    Without nulls they are one aggregation in the JVM. Null targets are permuted and shifted over the whole group in ``order``. A large group is numbered in pieces
    and cut into runs of ``run`` consecutive rows or more, each of which sends its targets, packed, to the runs that need them: one value for each row and null target, so
    no task holds or sorts a group. Rows with a null or NaN in a feature or the target are left out.
    """
    number = [F.col(c).cast("double") for c in [*features, target]]
    whole = rows.select(*by, *order, F.array(*number).alias("__v"), fold.cast("int").alias("fold")).filter(F.forall("__v", lambda x: x.isNotNull() & ~F.isnan(x)))
    if not permutations and not shifts:
        z = [F.lit(1.0), *[F.get("__v", F.lit(i)) for i in range(len(features))]]
        y = F.get("__v", F.lit(len(features)))
        products = [a * b for a in z for b in z] + [a * y for a in z] + [y * y]
        return whole.groupBy(*by, "fold").agg(F.array(*[F.sum(p) for p in products]).alias("sums"))
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in by)

    def send(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__place")
        v, places, length, n, at = np.stack(part["__v"].to_list()), part["__place"].to_numpy(), *(int(part[c].iloc[0]) for c in ("__length", "__n", "__run"))
        keys = {c: part[c].iloc[0] for c in by} | {"__length": length, "__n": n}
        name = str(list(map(str, list(keys.values())[: len(by)])))
        own = keys | {"__run": at, "__from": -1, "__name": name, "__values": _packed(v), "__folds": part["fold"].to_numpy(np.int32).tobytes()}
        out = _sent(_moved(places, n, name, permutations, shifts, seed, back=True), v[:, -1], length) if n else []
        return pd.DataFrame([own, *[keys | {"__run": to, "__from": at, "__name": name, "__values": _packed(x), "__folds": None} for to, x in out]])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__from")
        own, length, n = part.iloc[0], int(part["__length"].iloc[0]), int(part["__n"].iloc[0])
        v, folds = _unpacked(own["__values"]).reshape(-1, len(features) + 1), np.frombuffer(own["__folds"], np.int32)
        if n:
            places = int(own["__run"]) * length + np.arange(len(v))
            nulls = _received(_moved(places, n, own["__name"], permutations, shifts, seed), np.concatenate([_unpacked(x) for x in part["__values"].iloc[1:]]), length)
            y = np.column_stack([v[:, -1], nulls])
        else:
            y = _columns(v[:, -1], f"{own['__name']}0", permutations, shifts, seed)
        keys = {c: own[c] for c in by}
        return pd.DataFrame([keys | {"fold": int(f), "sums": _flat(v[folds == f, :-1], y[folds == f])} for f in np.unique(folds)])

    # groups of several runs, which are few for the rows
    large = whole.groupBy(_group(by)).agg(F.count("*").alias("__n")).filter(F.col("__n") > run)
    placed = numbered(whole, by, order, "__place").withColumn("__g", _group(by)).join(F.broadcast(large), "__g", "left")
    length = F.greatest(F.lit(run), F.ceil(F.coalesce("__n", F.lit(0)) / RUNS)).cast("long")
    placed = placed.select(*by, "__v", "fold", "__place", F.coalesce("__n", F.lit(0)).alias("__n"), length.alias("__length")).withColumn("__run", F.expr("cast(__place div __length as int)"))
    packed = placed.groupBy(*by, "__run").applyInPandas(send, f"{kinds}__length long, __n long, __run int, __from int, __name string, __values binary, __folds binary")
    parts = packed.groupBy(*by, "__run").applyInPandas(add, f"{kinds}fold int, sums array<double>")
    each = parts.select(*by, "fold", F.posexplode("sums").alias("__i", "__x")).groupBy(*by, "fold", "__i").agg(F.sum("__x").alias("__x"))
    return each.groupBy(*by, "fold").agg(F.transform(F.sort_array(F.collect_list(F.struct("__i", "__x"))), lambda x: x["__x"]).alias("sums"))


def _scored(folds: list[_Sums], alphas: list[float], nested: bool) -> tuple[np.ndarray, np.ndarray]:
    """``(alphas or 1, targets)`` shares of variance explained out of fold, and the penalty that each outer fold takes of the true target."""
    total = folds[0]
    for f in folds[1:]:
        total = _Sums(total.flat + f.flat, f.d, f.t)
    spread = np.maximum(total.yy - total.xy[0] ** 2 / total.n, 0)
    chosen = []
    rest = np.zeros((1 if nested else len(alphas), total.t))
    for f in folds:
        train = total - f
        if not nested:
            rest += np.stack([f.errors(train.ridge(a)) for a in alphas])
            continue
        # the penalty with the least error over the other folds, for each target its own; of equal ones the first
        inner = np.stack([sum(g.errors((train - g).ridge(a)) for g in folds if g is not f) for a in alphas])
        best = inner.argmin(axis=0)
        errors = np.stack([f.errors(train.ridge(a)) for a in alphas])
        rest[0] += errors[best, np.arange(total.t)]
        chosen.append(alphas[best[0]])
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(spread > 0, 1 - rest / spread, np.nan), np.array(chosen)


def _solved(sums: DataFrame, by: list[str], solve, columns: str) -> DataFrame:
    """``solve(keys, folds in order)`` for each group; a group's folds are as many rows as there are folds."""
    kinds = "".join(f"`{c}` {sums.schema[c].dataType.simpleString()}, " for c in by)

    def each(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("fold")
        return solve({c: part[c].iloc[0] for c in by}, [np.asarray(s, float) for s in part["sums"]], part["fold"].tolist())

    return sums.groupBy(*by).applyInPandas(each, kinds + columns)


def ridge_scores(rows: DataFrame, by: list[str], features: list[str], target: str, alphas: list[float], fold: Column) -> DataFrame:
    """``(by..., alpha, n, r2)``: the share of the target's variance that ridge regression explains out of fold, for each penalty.

    Null for a target without variance or a group with one fold. One scan; see ``fold_sums``.
    """
    d = len(features)

    def solve(keys: dict, sums: list[np.ndarray], _: list[int]) -> pd.DataFrame:
        folds = [_Sums(s, d, 1) for s in sums]
        r2 = _scored(folds, alphas, False)[0][:, 0] if len(folds) > 1 else [np.nan] * len(alphas)
        return pd.DataFrame([keys | {"alpha": a, "n": int(sum(f.n for f in folds)), "r2": None if np.isnan(r) else float(r)} for a, r in zip(alphas, r2)])

    return _solved(fold_sums(rows, by, [], features, target, fold), by, solve, "alpha double, n long, r2 double")


def decode(
    rows: DataFrame, by: list[str], order: list[str], features: list[str], target: str, alphas: list[float], fold: Column, permutations: int = 100, shifts: int = 100, seed: int = 0, least: int = 20
) -> DataFrame:
    """``(by..., n, r2, alpha, mixed_median, p_mixed, shifted_median, p_shifted)``: decoding with nested penalties against two nulls.

    The penalty of a fold is chosen among the others, for null targets too. ``p`` is (1 + nulls at least as good) / (1 + nulls): permuted targets ask for better than
    nothing, circularly shifted ones, which keep the target's own slow course, for better than drift. ``alpha`` is the median of the folds' penalties. Groups
    of fewer than ``least`` rows, of fewer than three folds or without variance get nulls. The draws follow from seed and group, so a lost task repeats them.
    """
    t, d = 1 + permutations + shifts, len(features)

    def solve(keys: dict, sums: list[np.ndarray], _: list[int]) -> pd.DataFrame:
        folds = [_Sums(s, d, t) for s in sums]
        n = int(round(sum(f.n for f in folds)))
        out = keys | {"n": n, "r2": None, "alpha": None, "mixed_median": None, "p_mixed": None, "shifted_median": None, "p_shifted": None}
        if n >= least and len(folds) > 2:
            r2, chosen = _scored(folds, alphas, True)
            r2 = r2[0]
            if np.isfinite(r2[0]):
                out |= {"r2": float(r2[0]), "alpha": float(np.median(chosen))}
                for name, null in (("mixed", r2[1 : 1 + permutations]), ("shifted", r2[1 + permutations :])):
                    if len(null):
                        out |= {f"{name}_median": float(np.median(null)), f"p_{name}": float((1 + (null >= r2[0]).sum()) / (1 + len(null)))}
        return pd.DataFrame([out])

    sums = fold_sums(rows, by, order, features, target, fold, permutations, shifts, seed)
    return _solved(sums, by, solve, "n long, r2 double, alpha double, mixed_median double, p_mixed double, shifted_median double, p_shifted double")


def predictions(rows: DataFrame, by: list[str], features: list[str], target: str, alpha: float, fold: Column, name: str = "predicted") -> DataFrame:
    """``rows`` with out-of-fold predictions: a row's weights are those of the folds but its own. Null where a feature is null or there is one fold."""
    d = len(features)

    def solve(keys: dict, sums: list[np.ndarray], numbers: list[int]) -> pd.DataFrame:
        folds = [_Sums(s, d, 1) for s in sums]
        total = _Sums(sum(sums), d, 1)
        return pd.DataFrame([keys | {"fold": k, "w": (total - f).ridge(alpha)[:, 0]} for k, f in zip(numbers, folds) if total.n > f.n], columns=[*by, "fold", "w"])

    weights = _solved(fold_sums(rows, by, [], features, target, fold), by, solve, "fold int, w array<double>").toDF(*[f"__by{i}" for i in range(len(by))], "__fold", "__w")
    same = fold.cast("int") == F.col("__fold")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__by{i}"))
    value = sum((F.get("__w", F.lit(i + 1)) * F.col(c) for i, c in enumerate(features)), F.get("__w", F.lit(0)))
    return rows.join(weights, same, "left").withColumn(name, value).select(*rows.columns, name)


def permutation_p(rows: DataFrame, key: str, group: str, value: str, n: int, seed: int = 0) -> DataFrame:
    """Difference of the group means (true less false) and its share of permutations at least as far from 0: ``(difference, p)``.

    Permutation i gives the true label to the rows with the least seeded hashes of their key, as many as had it. The hash that ends them is found from
    counts of 1,024 bins, then inside one bin, so rows are neither sorted nor sent once for each permutation: what is shuffled are counts, and a 1,024th of the rows.
    Keys must differ; rows with a null are left out; nulls without two groups.
    """
    plain = rows.select(F.col(key).alias("__k"), F.col(group).cast("int").alias("g"), F.col(value).cast("double").alias("v")).filter("__k is not null and g is not null and v is not null")
    true = plain.agg(F.count("*").alias("rows"), F.sum("g").alias("ones"), F.sum("v").alias("total"), F.sum(F.when(F.col("g") == 1, F.col("v"))).alias("sum1"))
    place = F.pmod(F.xxhash64(F.lit(seed), "i", "__k"), F.lit(1 << 40))
    drawn = plain.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("__h", place).withColumn("__bin", F.expr("__h div 1073741824"))
    counts = drawn.groupBy("i", "__bin").agg(F.count("*").alias("c"), F.sum("v").alias("s"))
    # one row, and n rows of a bin each
    one = F.broadcast(true)
    w = Window.partitionBy("i").orderBy("__bin")
    before = lambda c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = counts.select("i", "__bin", "c", before("c").alias("c0"), before("s").alias("s0")).join(one).filter("c0 < ones and c0 + c >= ones").select("i", F.col("__bin").alias("__cut"), (F.col("ones") - F.col("c0")).alias("left"), "s0")
    inside = drawn.join(F.broadcast(cut.select(F.col("i").alias("j"), "__cut", "left")), (F.col("i") == F.col("j")) & (F.col("__bin") == F.col("__cut")))
    last = inside.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("__h", "__k"))).filter(F.col("r") <= F.col("left")).groupBy("i").agg(F.sum("v").alias("s1"))
    null = cut.join(last, "i").join(one).select((F.col("s0") + F.col("s1")).alias("s"), "rows", "ones", "total")
    gap = lambda s: F.when((F.col("ones") > 0) & (F.col("ones") < F.col("rows")), s / F.col("ones") - (F.col("total") - s) / (F.col("rows") - F.col("ones")))
    least = true.select(gap(F.col("sum1")).alias("difference"), "total", "ones")
    # sums in another order differ in their last digits
    far = F.abs("d") >= F.abs("difference") - 1e-9 * (F.abs("difference") + F.abs(F.col("total") / F.col("ones")))
    return null.select(gap(F.col("s")).alias("d")).join(F.broadcast(least)).groupBy("difference").agg(((F.count_if(far) + 1) / (F.count("*") + 1)).alias("p"))
