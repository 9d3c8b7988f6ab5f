"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingles.

Items are partitioned by the size of their shingle set. The sketch of an item is its bottom-k MinHash, k
growing with the partition's size so that an item contained to the threshold has at least one sketched shingle
in the document whatever shingles are missing. So candidates lose nothing, and short items are found inside
long documents whose similarity to them is tiny.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import union_all, written


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _at(array: Column, first: Column, n: int, hashed: bool) -> Column:
    parts = [F.get(array, first + k) for k in range(n)]
    return F.xxhash64(*parts) if hashed else F.concat_ws(" ", *parts)


def _shingles(array: Column, n: int, hashed: bool) -> Column:
    """All runs of n words, as texts or as hashes of the words' hashes."""
    count = F.size(array) - n
    return F.when(count >= 0, F.transform(F.sequence(F.lit(0), count), lambda i: _at(array, i, n, hashed))).otherwise(F.array().cast("array<bigint>" if hashed else "array<string>"))


def _hashes(array: Column) -> Column:
    return F.transform(array, lambda w: F.xxhash64(w))


def _sketch(hashes: Column, threshold: float) -> Column:
    n = F.size(hashes)
    bound = F.pow(F.lit(2.0), F.ceil(F.log2(n)))
    k = bound - F.ceil(bound * threshold - 1e-9) + 1
    return F.slice(F.array_sort(hashes), 1, F.least(k.cast("int"), n))


def contained_items(
    docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """``(id, item, n_item, n_shared, containment)`` for each document and item contained to ``threshold``.

    Containment is the share of the item's distinct shingles of ``width`` words found in the document; an item with
    fewer words is one shingle of all its words. Items and documents without words, and null texts, match nothing;
    rows with a null id are matched under that id, items like documents; of rows that share an id, of documents or of items,
    the best containment is given once, of equal ones that of the larger item.
    The sketches meet the documents' shingles in a join that Spark broadcasts only where the written sketches are
    below its size threshold and shuffles otherwise.
    """
    bench = items.select(F.col(item_col).alias("item"), words(F.col(item_text_col)).alias("w")).filter(F.size("w") > 0)
    # a number of its own for each item row, fixed by being written: ids may repeat or be null
    bench = written(bench.select("*", F.least(F.size("w"), F.lit(width)).alias("n"), F.monotonically_increasing_id().alias("i")), "items")
    lengths = [r.n for r in bench.select("n").distinct().collect()]  # at most `width` numbers
    if not lengths:
        return docs.select(F.col(id_col), F.lit(None).cast(items.schema[item_col].dataType).alias(item_col), *[F.lit(0).cast(t).alias(c) for c, t in (("n_item", "int"), ("n_shared", "int"), ("containment", "double"))]).limit(0)
    of_length = lambda n: bench.filter(F.col("n") == n)
    exact = written(union_all([of_length(n).select("i", "item", "n", F.array_distinct(_shingles(F.col("w"), n, False)).alias("wanted")) for n in lengths]), "item-shingles")
    hashed = union_all([of_length(n).select("i", F.array_distinct(_shingles(_hashes(F.col("w")), n, True)).alias("h")) for n in lengths])
    sketch = written(hashed.select("i", F.explode(_sketch(F.col("h"), threshold)).alias("h")), "sketches")
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hashes = _hashes(words(F.col("text")))
    probes = text.select("id", hashes.alias("w")).select("id", F.explode(F.concat(*[_shingles(F.col("w"), n, True) for n in lengths])).alias("h"))
    found = written(probes.join(sketch, "h").select("id", "i").distinct(), "candidates")
    pairs = found.select(F.col("id").alias("cid"), "i").join(text, F.col("cid").eqNullSafe(F.col("id"))).select("id", "i", words(F.col("text")).alias("w")).join(exact, "i")
    # the words are a column of their own: a lambda evaluates what it names for every element
    shingles = F.coalesce(*[F.when(F.col("n") == n, _shingles(F.col("w"), n, False)) for n in lengths])
    pairs = pairs.select("id", "item", F.size("wanted").alias("n_item"), F.size(F.array_intersect("wanted", shingles)).alias("n_shared"))
    best = pairs.groupBy("id", "item").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("c"), "n_item", "n_shared")).alias("m")).select("id", "item", "m.n_item", "m.n_shared")
    kept = best.filter(F.col("n_shared") >= F.col("n_item") * F.lit(threshold) - 1e-9)
    return kept.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def sketch_size(n: int, threshold: float = 0.8) -> int:
    """Sketched shingles of an item with ``n`` distinct shingles."""
    bound = 2 ** math.ceil(math.log2(n))
    return min(n, bound - math.ceil(bound * threshold - 1e-9) + 1)


SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS d, doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT row_number() OVER () AS i, item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
items AS (SELECT i, w, least(5, len(w)) AS n FROM iw WHERE len(w) > 0),
ish AS (SELECT DISTINCT i, n, s FROM (SELECT i, n, unnest(list_transform(generate_series(1, len(w) - n + 1), lambda k: array_to_string(w[k : k + n - 1], ' '))) AS s FROM items)),
sizes AS (SELECT i, count(*) AS n_item FROM ish GROUP BY i),
dsh AS (SELECT DISTINCT d, n, s FROM (SELECT d, n, unnest(list_transform(generate_series(1, len(w) - n + 1), lambda k: array_to_string(w[k : k + n - 1], ' '))) AS s
        FROM dw, (SELECT DISTINCT n FROM items) AS lengths WHERE len(w) >= n)),
hits AS (SELECT d, i, count(*) AS n_shared FROM dsh JOIN ish USING (n, s) GROUP BY d, i),
ranked AS (SELECT doc_id, item_id, n_item, n_shared, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_shared / n_item DESC, n_item DESC) AS k FROM hits JOIN sizes USING (i) JOIN dw USING (d) JOIN iw USING (i))
SELECT doc_id, item_id, CAST(n_item AS INTEGER) AS n_item, CAST(n_shared AS INTEGER) AS n_shared, n_shared / n_item AS containment
FROM ranked WHERE k = 1 AND n_shared >= n_item * 0.8 - 1e-9
"""
