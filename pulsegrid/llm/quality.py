"""Quality by perplexity under an interpolated modified Kneser-Ney model of four characters, trained on trusted text.

The n-grams that occur in a block of documents (a split of an input file) are deduplicated in one pass; Spark sums
their counts in trusted text and smooths them with joins of hash-partitioned count tables. The log probabilities of a block's own n-grams are
one file in the shared folder, which the task that reads the block's documents fetches to add them up. So what is
shuffled is the distinct n-grams of each block, neither texts nor every n-gram occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import row_key, small, without, work_dir, written
from pulsegrid.llm.kneser_ney import discounts

ORDER = 4
#: Stands before a text; U+FFFF is no character.
PAD = "\uffff" * (ORDER - 1)
#: Characters whose n-grams are deduplicated at once.
CHUNK = 2_000_000
#: Characters of median text that a document's mean is pulled towards its language's by, so that short ones have wider thresholds.
PULL = 40.0
#: Bytes of text of a block, for rows that come from no file.
BLOCK_BYTES = 1 << 26
#: One trusted document in so many is not counted but sets the thresholds, and languages with fewer such documents
#: than LEAST_CALIBRATION take the thresholds of all languages together.
CALIBRATION, LEAST_CALIBRATION = 4, 30
#: The quantile of a language's calibration documents that is its threshold: so many of unseen trusted text pass.
QUANTILE = 0.995
#: Calibration documents from which a quantile is read off; of fewer, a hundredth of unseen text lies beyond the largest.
RESOLVED = 100


#: What names a block: the file's hash and the range of its bytes.
BLOCK = ["file", "start", "length"]


def ngrams(texts: list[str]) -> np.ndarray:
    """The n-grams of some texts as 64-bit keys, 16 bits a character (planes share them), in reading order."""
    codes = np.frombuffer((PAD + PAD.join(texts)).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) & np.uint64(0xFFFF)
    key = codes[ORDER - 1 :].copy()
    for back in range(1, ORDER):
        key |= codes[ORDER - 1 - back : len(codes) - back] << np.uint64(16 * back)
    return key[codes[ORDER - 1 :] != 0xFFFF]


def _merged(old: tuple[np.ndarray, np.ndarray], keys: np.ndarray, trusted: bool) -> tuple[np.ndarray, np.ndarray]:
    new, n = np.unique(keys, return_counts=True)
    both, back = np.unique(np.concatenate([old[0], new]), return_inverse=True)
    counts = np.zeros(len(both), np.int64)
    counts[back[: len(old[0])]] = old[1]
    counts[back[len(old[0]) :]] += n * trusted
    return both, counts


def _block_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, length, key, n): the distinct n-grams of each block, and how often they occur in its trusted texts."""
    held: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}
    waiting: dict[tuple[tuple[int, int, int], bool], list[str]] = {}
    size: dict[tuple[tuple[int, int, int], bool], int] = {}

    def flush(at: tuple[tuple[int, int, int], bool]) -> None:
        old = held.get(at[0], (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        held[at[0]] = _merged(old, ngrams(waiting.pop(at)), at[1])
        size.pop(at)

    for batch in batches:
        for *block, trusted, text in zip(*(c.to_pylist() for c in batch.columns)):
            if text:
                at = (tuple(block), bool(trusted))
                waiting.setdefault(at, []).append(text)
                size[at] = size.get(at, 0) + len(text)
                if size[at] >= CHUNK:
                    flush(at)
    for at in list(waiting):
        flush(at)
    for block, (keys, counts) in held.items():
        yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(keys), b)) for b in block), pa.array(keys.view(np.int64)), pa.array(counts)], names=[*BLOCK, "key", "n"])


def _looked_up(texts: list[str], keys: np.ndarray, lp: np.ndarray) -> np.ndarray:
    """The log probability of each n-gram of some texts; an n-gram that was not counted is an error, never another's value."""
    wanted = ngrams(texts)
    if not len(wanted):
        return np.zeros(0)
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    if not len(keys) or (keys[at] != wanted).any():
        raise RuntimeError("a block's n-grams are incomplete: its texts have changed since they were counted")
    return lp[at]


def _sums(texts: list[str], keys: np.ndarray, lp: np.ndarray) -> np.ndarray:
    """The summed log probability of each text."""
    each = _looked_up(texts, keys, lp)
    lengths = np.array([len(t) for t in texts])
    # U+FFFF inside a text is no n-gram: such texts are rare and summed alone
    if len(each) != lengths.sum():
        return np.array([_looked_up([t], keys, lp).sum() for t in texts])
    sums = np.concatenate([[0.0], np.cumsum(each)])
    ends = np.cumsum(lengths)
    return sums[ends] - sums[ends - lengths]


def _fetched(folder: str, file: int, start: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted n-grams of all counted blocks of a file that overlap a range, and their log probabilities; none where all their texts are empty.

    A row belongs to the split its place falls into, so a row of a range was counted in a block that overlaps it, however the file was split then.
    """
    system, path = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pyarrow.fs.LocalFileSystem(), folder)
    tables = []
    for block in system.get_file_info(pyarrow.fs.FileSelector(f"{path}/file={file}", allow_not_found=True)):
        first, size = map(int, block.base_name.removeprefix("range=").split("_"))
        if first < start + length and start < first + size:
            found = system.get_file_info(pyarrow.fs.FileSelector(block.path))
            tables += [pyarrow.parquet.read_table(f.path, columns=["key", "lp"], filesystem=system, partitioning=None) for f in found if f.path.endswith(".parquet")]
    if not tables:
        return np.zeros(0, np.uint64), np.zeros(0)
    table = pa.concat_tables(tables)
    keys, first = np.unique(table.column("key").to_numpy().view(np.uint64), return_index=True)
    return keys, table.column("lp").to_numpy().astype(np.float64)[first]


def _scorer(folder: str):
    """Adds n_chars and logp to rows (file, start, length, text, others...), of which those of a block come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, lp = None, np.zeros(0, np.uint64), np.zeros(0)
        for batch in batches:
            blocks = np.column_stack([batch.column(i).to_numpy() for i in range(len(BLOCK))])
            cuts = np.flatnonzero((np.diff(blocks, axis=0) != 0).any(axis=1)) + 1
            for s, e in zip([0, *cuts], [*cuts, batch.num_rows]):
                if e > s and tuple(blocks[s]) != held:
                    held = tuple(blocks[s])
                    keys, lp = _fetched(folder, *map(int, held))
                part, total = batch.slice(s, e - s), []
                texts = [t or "" for t in part.column(len(BLOCK)).to_pylist()]
                at, size = 0, 0
                for i, text in enumerate(texts):
                    size += len(text)
                    if size >= CHUNK or i + 1 == len(texts):
                        total.append(_sums(texts[at : i + 1], keys, lp))
                        at, size = i + 1, 0
                logp = np.concatenate(total) if total else np.zeros(0)
                values = [pa.array([len(t) for t in texts], pa.int64()), pa.array(logp, pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns[len(BLOCK) + 1 :], *values], names=[*part.schema.names[len(BLOCK) + 1 :], "n_chars", "logp"])

    return run


def _low(key: Column, order: int) -> Column:
    return key if order == ORDER else key.bitwiseAND(F.lit((1 << 16 * order) - 1).cast("long"))


def _discount(c: Column, d: tuple[float, float, float]) -> Column:
    return F.when(c == 1, d[0]).when(c == 2, d[1]).when(c >= 3, d[2]).otherwise(0.0)


def log_probabilities(grams: DataFrame) -> DataFrame:
    """``(key, lp)`` for every n-gram of ``grams(key, c)``, c being its count in trusted text, perhaps 0."""
    counts = {ORDER: grams.filter("c > 0").select("key", "c")}
    for k in range(ORDER - 1, 0, -1):
        counts[k] = written(counts[k + 1].select(_low(F.col("key"), k).alias("key")).groupBy("key").agg(F.count("*").alias("c")), f"counts{k}")
    lower = None
    for k in range(1, ORDER + 1):
        table = counts[k]
        n = table.agg(*[F.count_if(F.col("c") == i) for i in (1, 2, 3, 4)], F.sum("c"), F.count("*")).first()
        d, total, kinds = discounts(*n[:4]), n[4] or 0, n[5]
        wanted = grams.select(_low(F.col("key"), k).alias("key")).distinct().join(table, "key", "left").withColumn("c", F.coalesce("c", F.lit(0)))
        if k == 1:
            mass = table.agg(F.sum(_discount(F.col("c"), d))).first()[0] or 0.0
            p = (F.col("c") - _discount(F.col("c"), d) + mass / (kinds + 1)) / total if total else F.lit(1.0)
            lower = written(wanted.select("key", p.alias("p")), "p1")
            continue
        context = F.shiftrightunsigned("key", 16)
        left = table.groupBy(context.alias("context")).agg(F.sum("c").alias("total"), F.sum(_discount(F.col("c"), d)).alias("mass"))
        joined = wanted.withColumn("context", context).withColumn("shorter", _low(F.col("key"), k - 1)).join(left, "context", "left")
        joined = joined.join(lower.select(F.col("key").alias("shorter"), F.col("p").alias("q")), "shorter")
        p = F.when(F.col("total").isNull(), F.col("q")).otherwise((F.col("c") - _discount(F.col("c"), d) + F.col("mass") * F.col("q")) / F.col("total"))
        lower = written(joined.select("key", p.alias("p")), f"p{k}")
    return lower.select("key", F.log10("p").cast("float").alias("lp"))


def perplexities(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(row, id, lang, trusted, calibration, n_chars, logp)`` for every row; row is a hash of id and text.

    ``trusted`` holds, under ``id_col``, the ids of trusted documents (nulls are ignored). Those marked for calibration are
    not counted, so their perplexities are those of unseen text.
    """
    # a split of a file is a block, by its range; when texts are read again the file may be split in another way (executors come and go), then all
    # blocks that overlap are looked up. Rows from elsewhere are dealt to blocks by a hash
    elsewhere = F.input_file_name() == ""
    from_files = docs.select(elsewhere.alias("loose")).filter("loose").isEmpty()
    size = 0 if from_files else docs.filter(elsewhere).agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    row = row_key(id_col, text_col)
    dealt = F.pmod(row, F.lit(1 + size // BLOCK_BYTES))
    block = [
        F.when(elsewhere, F.lit(0)).otherwise(F.xxhash64(F.input_file_name())).alias("file"), F.when(elsewhere, dealt).otherwise(F.input_file_block_start()).alias("start"),
        F.when(elsewhere, F.lit(1)).otherwise(F.input_file_block_length()).cast("long").alias("length"),
    ]
    base = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), row.alias("row"), *block
    )
    ids = small(written(trusted.select(F.col(id_col).alias("t")).filter("t is not null").distinct(), "trusted"))
    base = base.join(ids, F.col("id") == F.col("t"), "left").withColumn("trusted", F.col("t").isNotNull()).drop("t")
    fold = F.pmod(F.xxhash64(F.lit("calibration"), "id"), F.lit(CALIBRATION))
    base = base.withColumn("calibration", F.col("trusted") & (fold == 0))
    keys = written(base.select(*BLOCK, F.expr("trusted and not calibration").alias("trusted"), "text").mapInArrow(_block_ngrams, "file long, start long, length long, key long, n long"), "block-ngrams")
    grams = written(keys.groupBy("key").agg(F.sum("n").alias("c")), "ngrams")
    table = keys.select("file", F.concat_ws("_", "start", "length").alias("range"), "key").distinct().join(log_probabilities(grams), "key").select("file", "range", "key", "lp")
    folder = work_dir(docs.sparkSession, "block-probabilities")
    table.repartition("file", "range").write.partitionBy("file", "range").parquet(folder)
    narrow = base.select(*BLOCK, "text", "row", "id", "lang", "trusted", "calibration")
    if not from_files:
        narrow = narrow.repartition(*BLOCK).sortWithinPartitions(*BLOCK)
    kinds = f"row long, id {docs.schema[id_col].dataType.simpleString()}, lang string, trusted boolean, calibration boolean, n_chars long, logp double"
    return narrow.mapInArrow(_scorer(folder), kinds)


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(row, id, lang, trusted, n_chars, perplexity, threshold, accepted)`` for every row.

    The perplexity is per character. A language's threshold is a quantile of its calibration documents; as a short text's mean scatters
    more, the quantile is taken, and the threshold of a document set, with the logarithm of the perplexity pulled towards the median of the
    language by PULL characters: the threshold of a long text is the quantile itself. A language with fewer than RESOLVED
    calibration documents takes the quantile of the distances from the median in all languages, and where all have fewer together that lies
    twice as far out; one with fewer than LEAST_CALIBRATION takes the threshold of all. Null and empty texts have the median's
    perplexity; without any trusted document everything is accepted. Ids may repeat or be null; other columns are ignored.
    """
    scored = written(perplexities(docs, trusted, id_col, text_col, lang_col), "perplexities")
    mean = -F.col("logp") / F.greatest("n_chars", F.lit(1))
    known = scored.filter("calibration and n_chars > 0")
    middle = [F.percentile_approx(mean, 0.5, 10_000).alias("mid"), F.count("*").alias("n")]
    mids = written(known.groupBy("lang").agg(*middle).filter(F.col("n") >= LEAST_CALIBRATION).drop("n"), "medians")
    mid = known.agg(*middle).first()[0]
    pulled = (-F.col("logp") + PULL * F.col("mid")) / (F.col("n_chars") + PULL)
    with_mid = scored.join(mids, "lang", "left").withColumn("own", F.col("mid").isNotNull()).withColumn("mid", F.coalesce("mid", F.lit(mid)))
    with_mid = with_mid.withColumn("x", F.when(F.col("n_chars") > 0, pulled).otherwise(F.col("mid")))
    calibration = with_mid.filter("calibration and n_chars > 0")
    at = lambda c: F.percentile_approx(c, quantile, 10_000)
    n, overall, beyond = calibration.agg(F.count("*"), at("x"), at(F.col("x") - F.col("mid"))).first()
    if 0 < n < RESOLVED:
        overall, beyond = 2 * overall - mid, 2 * beyond
    per_lang = written(calibration.filter("own").groupBy("lang").agg(at("x").alias("fence"), F.count("*").alias("n")).filter(F.col("n") >= RESOLVED).drop("n"), "fences")
    otherwise = F.when(F.col("own"), F.col("mid") + F.lit(beyond)).otherwise(F.lit(overall))
    judged = with_mid.join(per_lang, "lang", "left").withColumn("fence", F.coalesce("fence", otherwise))
    own = F.when(F.col("n_chars") > 0, mean).otherwise(F.col("mid"))
    wider = F.col("fence") + F.lit(PULL) * (F.col("fence") - F.col("mid")) / F.greatest("n_chars", F.lit(1))
    return judged.select(
        "row", "id", "lang", "trusted", "n_chars", F.pow(F.lit(10.0), own).alias("perplexity"), F.pow(F.lit(10.0), wider).alias("threshold"),
        F.coalesce(F.col("x") <= F.col("fence"), F.lit(True)).alias("accepted"),
    )


def kept_documents(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of ``docs`` that are accepted, unchanged."""
    rejected = classify(docs, trusted, id_col=id_col, text_col=text_col, **more).filter("not accepted").select("row")
    return without(docs, rejected, id_col, text_col)
