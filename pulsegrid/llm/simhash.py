"""SimHash near-duplicates with pigeonring filtering.

A fingerprint is cut into consecutive segments on a ring. If two fingerprints differ in at most ``bits``
places, then from some segment on every run of consecutive segments keeps within its proportional share of
the differences: after l segments at most floor(l * bits / m). With more segments than bits the first segment
is equal and the second differs in at most floor(2 * bits / m) places and so on, so such a chain is one join key, whose few changes are divided among the two sides; as the table
grows, so does the chain. Longer runs prune the joined pairs before the whole fingerprints are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import written
from pulsegrid.llm.components import components

SEED = 42
#: Shingles whose bits are counted at once.
BLOCK = 1 << 17
#: Unrelated fingerprints that one may meet on average before keys take another segment.
MEETINGS = 16


def shingle_hashes(text: str, width: int) -> list[int]:
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.encode().lower().split()
    if len(words) <= width:
        return [digest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [digest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]


def fingerprint(text: str | None, width: int = 4) -> int:
    """The signed 64-bit SimHash of a text; 0 where it has no word."""
    return majority(np.array(shingle_hashes(text or "", width), dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The signed number whose bits are those that are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int = 4) -> DataFrame:
    """``(id, fp)``: the signed fingerprint of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, fp long")


def _cuts(m: int) -> list[tuple[int, int]]:
    """(shift, width) of each of m segments of 64 bits."""
    edges = [round(64 * k / m) for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _flips(cuts: list[tuple[int, int]], chain: list[int], budget: list[int], most: int) -> list[int]:
    """Masks of up to ``most`` changed bits of a chain of segments, within the budget of each of its beginnings."""
    places = [(at, cuts[k][0] + b) for at, k in enumerate(chain) for b in range(cuts[k][1])]
    out = []
    for n in range(most + 1):
        for pick in combinations(places, n):
            if all(sum(at <= end for at, _ in pick) <= budget[end] for end in range(len(chain))):
                out.append(sum(1 << b for _, b in pick))
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def chain_length(n: int, bits: int) -> int:
    """Segments of a key for ``n`` fingerprints: the fewest (two at least) with which unrelated ones seldom meet, at most three."""
    m = bits + 1
    cuts, budget = _cuts(m), [length * bits // m for length in range(1, m + 1)]
    for length in range(2, min(3, m) + 1):
        width = min(sum(cuts[(k + i) % m][1] for i in range(length)) for k in range(m))
        variants = [len(_flips(cuts, list(range(length)), budget, half)) for half in (budget[length - 1] // 2, -(-budget[length - 1] // 2))]
        if m * variants[0] * variants[1] * n / 2**width <= MEETINGS:
            break
    return length


def similar_fingerprints(fps: DataFrame, bits: int = 4, segments: int | None = None) -> DataFrame:
    """``(a, b)`` with a < b for all distinct values of ``fps.fp`` that differ in 1 to ``bits`` places (bits >= 1).

    A key is a chain of ``segments`` segments from some place of the ring on (by default as many as the table's size asks for). Its
    allowed changes are divided: each side gives the chain with every change of up to half of them.
    """
    m = bits + 1
    cuts = _cuts(m)
    budget = [length * bits // m for length in range(1, m + 1)]
    segments = segments or chain_length(fps.count(), bits)
    probes, targets = [], []
    bits_of = lambda chain: F.lit(_signed(sum((1 << cuts[c][1]) - 1 << cuts[c][0] for c in chain))).cast("long")
    for k in range(m):
        chain = [(k + i) % m for i in range(segments)]
        half = budget[segments - 1] // 2
        for out, most in ((probes, half), (targets, budget[segments - 1] - half)):
            out += [F.struct(F.lit(k).alias("k"), bits_of(chain).alias("own"), F.lit(_signed(x)).cast("long").alias("flip")) for x in _flips(cuts, chain, budget, most)]

    def keyed(name: str, keys: list[Column]) -> DataFrame:
        # the keys are constants, so little code is generated for them
        each = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
        return each.select(F.col("fp").alias(name), "key.k", F.col("fp").bitwiseAND(F.col("key.own")).bitwiseXOR(F.col("key.flip")).alias("v"))

    probe, target = keyed("p", probes), keyed("q", targets)
    differs = F.col("p").bitwiseXOR(F.col("q"))
    ring = F.lit(True)
    for length in range(1, m):
        run = F.coalesce(*(F.when(F.col("k") == k, bits_of([(k + i) % m for i in range(length)])) for k in range(m)))
        ring = ring & (F.bit_count(differs.bitwiseAND(run)) <= budget[length - 1])
    # either side of a pair finds the other, so one order is enough
    # Spark takes the exploded sides to be no larger than the table, so it would broadcast up to 70 rows for each row of a small one
    met = probe.join(target.hint("merge"), ["k", "v"]).filter((F.col("p") < F.col("q")) & ring & (F.bit_count(differs) <= bits))
    return met.select(F.col("p").alias("a"), F.col("q").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, bits: int = 4) -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row; ids are numbers.

    Rows with the same fingerprint are one class and are linked without pairs, so a group of copies of any size
    is one key of a partial aggregation. Null and empty texts have fingerprint 0 and are linked like any other. A
    row with a null id belongs to its component but never names it; a component of such rows alone has a null id.
    """
    fps = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    groups = components(similar_fingerprints(classes, bits))
    joined = groups.join(classes, groups.node == classes.fp).select("fp", "component", "least")
    heads = joined.groupBy("component").agg(F.min("least").alias("head"))
    named = joined.join(heads, "component").select("fp", "head")
    named = classes.join(named, "fp", "left").select("fp", F.coalesce("head", "least").alias("component_id"))
    named = written(named, "named")
    return fps.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
