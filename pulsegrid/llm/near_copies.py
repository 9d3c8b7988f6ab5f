"""SimHash near-duplicates whose links are verified by exact Jaccard similarity of word shingles.

Texts with the same set of shingles are one class. Classes with equal or close fingerprints (the pigeonring join of the SimHash operator)
are compared first, which settles most copies. A similarity of 0.8 lets some 10 of 64 bits differ, more than any pigeonring
key can hold, so classes that share a band of MinHash values meet as well. In each list of such classes a
sketch of the values tells which pairs can be similar enough; of these only a spanning forest is compared in full at
first, and the pairs that this leaves in different groups afterwards. Where these are many times the rows of a list, as in a large group of texts that are nearly similar
enough, the list's sets of shingles are compared where the list is, and only a forest of its links comes out. A long list is cut
into blocks and every pair of blocks is a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import row_key, small, without, written
from pulsegrid.llm.components import components
from pulsegrid.llm.simhash import SEED, majority, shingle_hashes, similar_fingerprints

#: Words of a shingle; least similarity, in fifths.
WIDTH, FIFTHS = 5, 4
#: Bands and values of a band: a pair at 0.8 shares none with probability (1 - 0.8**4)**24 < 4e-6.
BANDS, ROWS = 24, 4
#: Equal values of the 96 in a sketch from which a pair is compared: a pair at 0.8 has fewer with probability 2e-4.
LEAST_EQUAL = 62
#: Shingles that are permuted at once; rows of a list's block, and of the slices in which a block's sketches are compared.
SHINGLES, BLOCK, SLICE = 4096, 4096, 256
#: Possible pairs for a row of a list from which its sets are compared in place; rows of a block of such a list; shingles whose sharing is counted at once.
DENSE, SETS_BLOCK, COLUMNS = 4, 1024, 2048
#: Lists of up to so many rows are compared together, all their possible pairs, without a forest.
FEW = 6
#: Differing bits of fingerprints that are compared.
BITS = 4

_random = np.random.default_rng(SEED)
_FACTORS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = _random.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The MinHash values of a set of hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), SHINGLES):
        least = np.minimum(least, (hashes[at : at + SHINGLES, None] * _FACTORS + _SHIFTS).min(axis=0))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One key for each band of MinHash values."""
    mixed = (least.reshape(BANDS, ROWS) ^ (least.reshape(BANDS, ROWS) >> np.uint64(31))) * _MIX
    return (mixed ^ (mixed >> np.uint64(29))).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)


def sketch(least: np.ndarray) -> bytes:
    """The top byte of each MinHash value, mixed: the minima themselves all begin with zeros."""
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def _digest(hashes: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(2):
            every = np.array(shingle_hashes(text.as_py() or "", WIDTH), dtype="<u8")
            hashes = np.unique(every)
            least = minima(hashes)
            rows.append((_digest(hashes), len(hashes), majority(every), band_keys(least).view(np.int64).tolist() if len(hashes) else [], sketch(least)))
        kinds = {"rep": pa.int64(), "n": pa.int64(), "fp": pa.int64(), "keys": pa.list_(pa.int64()), "sketch": pa.binary()}
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(v, t) for v, t in zip(zip(*rows), kinds.values())]] if rows else [*batch.columns[:2], *[pa.array([], t) for t in kinds.values()]], names=["id", "row", *kinds])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.unique(np.array(shingle_hashes(text or "", WIDTH), dtype="<u8")) for text in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.int64()), pa.array([s.view(np.int64).tolist() for s in sets], pa.list_(pa.int64()))], names=["rep", "hashes"])


def _allowed(n: np.ndarray, comp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows are of different groups and of sizes that allow the similarity."""
    return (comp[a] != comp[b]) & (5 * np.minimum(n[a], n[b]) >= FIFTHS * np.maximum(n[a], n[b]))


def _possible(sketches: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, equal): pairs of rows of different groups that are similar enough by sketch and size."""
    out = []
    columns = np.ascontiguousarray(sketches.T)
    for at in range(0, len(sketches), SLICE):
        equal = np.zeros((min(SLICE, len(sketches) - at), len(sketches) - at), np.uint8)
        for c in columns:
            equal += c[at : at + SLICE, None] == c[None, at:]
        a, b = np.nonzero(equal >= LEAST_EQUAL)
        value = equal[a, b]
        a, b = a + at, b + at
        good = (a < b) & _allowed(n, comp, a, b)
        if side is not None:
            good &= side[a] != side[b]
        out.append((a[good], b[good], value[good]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _of_few(starts: np.ndarray, length: np.ndarray, sketches: np.ndarray, n: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The possible pairs of rows of many short lists."""
    a, b = [], []
    for size in np.unique(length):
        at = starts[length == size]
        for i, j in combinations(range(size), 2):
            a.append(at + i)
            b.append(at + j)
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    good = _allowed(n, comp, a, b)
    a, b = a[good], b[good]
    similar = np.concatenate([(sketches[a[k : k + BLOCK]] == sketches[b[k : k + BLOCK]]).sum(axis=1) >= LEAST_EQUAL for k in range(0, len(a), BLOCK)] or [np.zeros(0, bool)])
    return a[similar], b[similar]


def spanning_forest(groups: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of pairs (a, b) that connect the groups of all rows as far as the pairs can, the heaviest first."""
    label = np.unique(groups, return_inverse=True)[1]
    order = np.argsort(-weight.astype(np.int64), kind="stable")
    chosen = []
    for level in np.unique(weight)[::-1]:
        left = order[weight[order] == level]
        while len(left):
            x, y = label[a[left]], label[b[left]]
            across = x != y
            left, x, y = left[across], x[across], y[across]
            if not len(left):
                break
            # each group takes its first pair; the order of pairs is the same for all, so these close no circle
            first = np.unique(np.concatenate([np.unique(x, return_index=True)[1], np.unique(y, return_index=True)[1]]))
            ends = np.stack([x[first], y[first]])
            place = np.full(label.max() + 1, len(left), np.int64)
            np.minimum.at(place, ends[0], first)
            np.minimum.at(place, ends[1], first)
            first = np.unique(place[place < len(left)])
            chosen.append(left[first])
            root = np.arange(label.max() + 1)
            while True:
                new = root.copy()
                np.minimum.at(new, x[first], root[y[first]])
                np.minimum.at(new, y[first], root[x[first]])
                new = new[new]
                if (new == root).all():
                    break
                root = new
            label = root[label]
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def _starts(table: pa.Table) -> np.ndarray:
    """Where runs of equal (key, bi, bj) begin."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in ("key", "bi", "bj"):
        v = table.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _meet(forest: bool):
    """Pairs (a, b) of each list that are to be compared: of all that are possible, or of a spanning forest of them. Without forest a list with too many gives its key alone."""

    def done(table: pa.Table, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        rep, n, comp, own, bi, bj = (table.column(c).to_numpy() for c in ("rep", "n", "comp", "own", "bi", "bj"))
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
        length = ends - starts
        few = (length <= FEW) & (bi[starts] == bj[starts])
        found, dense = [_of_few(starts[few], length[few], sketches, n, comp)], []
        for s, e in zip(starts[~few], ends[~few]):
            a, b, equal = _possible(sketches[s:e], n[s:e], comp[s:e], own[s:e] if bi[s] != bj[s] else None)
            if forest and len(a) > 1:
                keep = spanning_forest(comp[s:e], a, b, equal)
                a, b = a[keep], b[keep]
            elif len(a) > DENSE * (e - s):
                dense.append(table.column("key")[s].as_py())
                continue
            found.append((a + s, b + s))
        a, b = (np.concatenate(x) for x in zip(*found))
        pairs = np.unique(np.stack([np.minimum(rep[a], rep[b]), np.maximum(rep[a], rep[b])]), axis=1)
        none = [None] * len(dense)
        return pa.RecordBatch.from_arrays([pa.array([*x.tolist(), *none], pa.int64()) for x in pairs] + [pa.array([None] * pairs.shape[1] + dense, pa.int64())], names=["a", "b", "key"])

    return _by_list(done, BLOCK)


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles every two sets share: products of a few columns at a time, of shingles that more than one set holds."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    held = count[column] > 1
    row, column = row[held], np.unique(column[held], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        x = np.zeros((len(sets), COLUMNS), np.float32)
        x[row[lo:hi], column[lo:hi] - at] = 1
        out += x @ x.T
    return out


def _linked(table: pa.Table, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """A spanning forest of the links of each list, by its sets."""
    rep, n, comp, own, bi, bj = (table.column(c).to_numpy() for c in ("rep", "n", "comp", "own", "bi", "bj"))
    found = []
    for s, e in zip(starts, ends):
        sets = [np.array(x, np.int64) for x in table.column("hashes")[int(s) : int(e)].to_pylist()]
        shared, size = _shared(sets), n[s:e].astype(np.int64)
        similar = (5 + FIFTHS) * shared.astype(np.int64) >= FIFTHS * (size[:, None] + size[None, :])
        similar &= comp[s:e, None] != comp[None, s:e]
        if bi[s] != bj[s]:
            similar &= own[s:e, None] != own[None, s:e]
        a, b = np.nonzero(np.triu(similar, 1))
        keep = spanning_forest(comp[s:e], a, b, shared[a, b])
        found.append(np.stack([rep[s:e][a[keep]], rep[s:e][b[keep]]]))
    pairs = np.concatenate(found, axis=1)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (pairs.min(axis=0), pairs.max(axis=0))], names=["a", "b"])


def _by_list(done, rows: int):
    """What ``done`` makes of whole lists, so many that they have about ``rows`` rows together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
                if sum(x.num_rows for x in held) >= rows:
                    table = pa.Table.from_batches(held)
                    starts = _starts(table)
                    if len(starts) > 1:
                        yield done(table, starts[:-1], starts[1:])
                    held = table.slice(starts[-1]).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            starts = _starts(table)
            yield done(table, starts, np.append(starts[1:], table.num_rows))

    return run


def _long(lists: DataFrame, block: int = BLOCK) -> DataFrame:
    return written(lists.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > block), "long-lists")


def _met(lists: DataFrame, long_lists: DataFrame, across: bool, run, kinds: str, block: int = BLOCK, sets: DataFrame | None = None) -> DataFrame:
    """What ``run`` makes of ``lists(key, rep, n, sketch, comp)``, with their ``sets`` if given; ``across`` also compares the blocks of a long list with each other."""
    blocks = F.ceil(F.coalesce("size", F.lit(1)) / block).cast("int")
    placed = lists.join(small(long_lists), "key", "left").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1) if across else F.array("own")
    pair = F.explode(F.transform(every, lambda b: F.struct(F.least(b, F.col("own")).alias("bi"), F.greatest(b, F.col("own")).alias("bj"))))
    grouped = placed.select("key", "rep", "n", "sketch", "comp", "own", pair.alias("pair")).select("key", "pair.bi", "pair.bj", "own", "rep", "n", "comp", "sketch")
    if sets is not None:
        grouped = grouped.drop("sketch").join(sets, "rep").select("key", "bi", "bj", "own", "rep", "n", "comp", "hashes")
    parts = max(int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return grouped.repartition(parts, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj").mapInArrow(run, kinds).distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose similarity is high enough."""
    side = lambda c: sets.select(F.col("rep").alias(c), F.col("hashes").alias(f"set_{c}"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter((5 + FIFTHS) * shared >= FIFTHS * (F.size("set_a") + F.size("set_b"))).select("a", "b")


def _open(lists: DataFrame, links: DataFrame) -> DataFrame:
    """The lists that hold more than one group still, ``comp`` being the group."""
    named = lists.drop("comp").join(components(links).withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    open_keys = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("key")
    return named.join(open_keys, "key", "left_semi")


def links_of(classes: DataFrame, texts: DataFrame, bits: int = BITS) -> DataFrame:
    """``(a, b)`` of ``classes(rep, n, fp, keys, sketch, row)`` that are similar enough, as far as they are needed for the groups; ``texts`` are ``(row, text)``."""
    heads = written(classes.groupBy("fp").agg(F.min("rep").alias("head")), "copy-fingerprints")
    equal = classes.select("rep", "fp").join(heads, "fp").filter("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b"))
    of = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}"))
    close = similar_fingerprints(heads.select("fp"), bits).join(of("a"), "a").join(of("b"), "b")
    close = close.select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b"))
    first = written(equal.unionByName(close), "copy-pairs")
    posted = classes.select("rep", "n", "sketch", F.explode("keys").alias("key"))
    shared = classes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key")
    # exploded keys are many more than Spark takes them to be, so they are not to be broadcast
    lists = written(posted.join(shared.hint("merge"), "key", "left_semi").withColumn("comp", F.col("rep")), "copy-lists")
    wanted = first.select(F.explode(F.array("a", "b")).alias("rep")).unionByName(lists.select("rep")).distinct()
    wanted = small(written(classes.join(wanted, "rep", "left_semi").select("row"), "copy-texts"))
    sets = texts.join(wanted, "row", "left_semi").select("text").mapInArrow(_sets, "rep long, hashes array<long>")
    sets = written(sets.groupBy("rep").agg(F.first("hashes").alias("hashes")), "copy-sets")
    links = written(_verified(first, sets), "copy-links")
    for forest, across in ((True, False), (True, True), (False, True)):
        if not (forest and across) or not long_lists.isEmpty():
            lists = written(_open(lists, links), "copy-groups")
            long_lists = _long(lists)
        # without a long list the first forest has seen all that the second would
        if not (forest and across and long_lists.isEmpty()):
            found = written(_met(lists, long_lists, across, _meet(forest), "a long, b long, key long"), "copy-pairs")
            links = links.unionByName(written(_verified(found.filter("a is not null").select("a", "b"), sets), "copy-links"))
    dense = written(found.filter("key is not null").select("key").distinct(), "dense-lists")
    if not dense.isEmpty():
        lists = written(lists.join(small(dense), "key", "left_semi"), "dense-groups")
        met = _met(lists, _long(lists, SETS_BLOCK), True, _by_list(_linked, SETS_BLOCK), "a long, b long", SETS_BLOCK, sets)
        links = links.unionByName(written(met, "copy-links"))
    return links


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """``(id, component_id, row, kept)`` for every row: the least id that links of 0.8 or more reach, and whether the row stays.

    The similarity is the Jaccard similarity of the sets of five-word shingles (ASCII lower case, cut at ASCII white space).
    Null texts and those without words are copies of each other. ``row`` is the ``row_key`` of id and text. One row of a group is kept, that
    with the least id (of these, with the least key); rows that repeat it in id and text have its key and are kept like it. A null id comes
    after all others; a group of such rows alone has a null component. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    described = texts.mapInArrow(_described, f"id {kind}, row long, rep long, n long, fp long, keys array<long>, sketch binary")
    described = written(described, "copy-sketches")
    head = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "row")).alias("head")
    classes = described.groupBy("rep").agg(head, *[F.first(c).alias(c) for c in ("n", "fp", "keys", "sketch")])
    classes = written(classes.withColumn("row", F.col("head.row")), "copy-classes")
    groups = components(links_of(classes.filter("n > 0"), texts.select("row", "text"), bits)).withColumnRenamed("node", "rep")
    named = classes.select("rep", "head").join(groups, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    heads = named.groupBy("component").agg(F.min("head").alias("first"))
    named = written(named.join(heads, "component").select("rep", "first"), "copy-names")
    return described.select("id", "row", "rep").join(named, "rep").select(F.col("id").alias(id_col), F.col("first.id").alias("component_id"), "row", (F.col("row") == F.col("first.row")).alias("kept"))


def single_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, with all columns of ``docs``."""
    groups = written(near_copies(docs, id_col, text_col), "groups")
    rest = without(docs, groups.filter("not kept").select("row"), id_col, text_col)
    repeated = written(groups.filter("kept").groupBy("row").count().filter("count > 1").select("row"), "repeated")
    if repeated.isEmpty():
        return rest
    once = without(rest, repeated, id_col, text_col, only=True).dropDuplicates([id_col, text_col])
    return without(rest, repeated, id_col, text_col).unionByName(once)
