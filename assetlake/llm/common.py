"""What the operators share: shared storage, text blocks, word hashing, sampling."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles at once (a longer text is a block of its own); what a worker keeps
#: for the next block has the next power of two.
BLOCK_BYTES = (1 << 20) - 16


# ---------------------------------------------------------------- shared storage
#: Folders that materialize() wrote, by application and thread, the latest last.
_tables: dict[tuple[str, int], list[str]] = {}


def _own(spark: SparkSession) -> list[str]:
    return _tables.setdefault((spark.sparkContext.applicationId, threading.get_ident()), [])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session on a single machine may go without the
    setting, and gets a folder of its own; a cluster that names none is refused."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master or ""
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file:///tmp/assetlake-checkpoint"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends, lost executors cost nothing.

    Columns are written by their place, so that names may clash. The table goes with the application
    at the latest (see release)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    plain.write.option("compression", "zstd").parquet(path)
    _own(spark).append(path)
    files, place = _file_system(spark, path)
    files.deleteOnExit(place)
    return spark.read.schema(plain.schema).parquet(path).toDF(*df.columns)


def written(spark: SparkSession) -> int:
    """How many tables of this thread there are now."""
    return len(_own(spark))


def release(spark: SparkSession, first: int = 0, last: int | None = None) -> None:
    """Delete the tables that materialize() wrote in this thread, from the `first` to before the `last`; their
    frames can't be read any more."""
    tables = _own(spark)
    for path in tables[first:last]:
        files, place = _file_system(spark, path)
        files.delete(place, True)
    del tables[first:last]


def join_small(left: DataFrame, right: DataFrame, on, how: str, rows: int, most: int = 200_000) -> DataFrame:
    """Join with a narrow right side of a known row count: broadcast up to `most` rows, else build per shuffled partition."""
    return left.join(F.broadcast(right) if rows <= most else right.hint("shuffle_hash"), on, how)


# ---------------------------------------------------------------- columns
def _place(docs: DataFrame, name: str) -> int:
    """The column of exactly this name, else of this name in another case."""
    if name in docs.columns:
        return docs.columns.index(name)
    same = [i for i, c in enumerate(docs.columns) if c.lower() == name.lower()]
    if len(same) != 1:
        raise ValueError(f"no column {name} among {docs.columns}")
    return same[0]


#: Rows and bytes that go to a Python worker at once, where the session doesn't say otherwise: texts may be long.
ROWS, BYTES = 1000, 4 << 20


def _bounded_batches(docs: DataFrame) -> None:
    """Leave what the application was started with; Spark's defaults suit numbers, not texts."""
    spark = docs.sparkSession
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    rows, bytes_ = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.sparkContext.getConf()
    if not given.contains(rows) and int(spark.conf.get(rows)) > ROWS:
        spark.conf.set(rows, str(ROWS))
    if not given.contains(bytes_) and size(spark.conf.get(bytes_)) > BYTES:
        spark.conf.set(bytes_, str(BYTES))


def pick(docs: DataFrame, **wanted: str) -> DataFrame:
    """The named columns under new names. They are told apart by their place, so names that differ in case
    alone, that repeat or that hold dots do no harm."""
    _bounded_batches(docs)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.select(*[F.col(f"c{_place(docs, name)}").alias(alias) for alias, name in wanted.items()])


def pack(docs: DataFrame, **wanted: str) -> DataFrame:
    """Whole rows as the struct _row, its fields named by place, beside the named columns under new names."""
    _bounded_batches(docs)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.select(F.struct(*plain.columns).alias("_row"), *[F.col(f"c{_place(docs, name)}").alias(alias) for alias, name in wanted.items()])


def unpack(packed: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows that pack() packed, with their own names."""
    return packed.select("_row.*").toDF(*docs.columns)


def text_of(column: Column | str) -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(by))


def unit(column: Column, seed: int) -> Column:
    """A value in [0, 1) that depends on the column and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(column, F.lit(seed)), 11) / F.lit(float(1 << 53))


def bounded_sample(df: DataFrame, stratum: str, key: str, bound: int, seed: int = 7) -> DataFrame:
    """Rows whose key falls under their stratum's rate: about `bound` distinct keys at most, dealt evenly over the strata.

    One aggregate counts the strata; their rates are joined back, however many they are. Rows that
    share a key are drawn together, so a caller that collects must first reduce them to one a key.
    """
    counts = materialize(df.groupBy(F.col(stratum).alias("_stratum")).agg(F.count(F.lit(1)).alias("_rows")))
    strata = counts.count()
    rates = counts.select("_stratum", (F.lit(bound / max(1, strata)) / F.col("_rows")).alias("_rate"))
    kept = join_small(df, rates, F.col(stratum).eqNullSafe(F.col("_stratum")), "inner", strata)
    return kept.filter((F.col("_rate") >= 1) | (unit(F.col(key), seed) < F.col("_rate"))).drop("_stratum", "_rate")


# ---------------------------------------------------------------- text blocks
def table(*ranges: tuple[int, int]) -> np.ndarray:
    """A lookup table of bytes: true within the ranges, both ends included."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Bytes that separate words at white space are 0x09-0x0D and 0x20.
NOT_SPACE = ~table((0x09, 0x0D), (0x20, 0x20))
#: ASCII digits, lower-case letters and every byte of a longer UTF-8 sequence.
ALNUM = table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64; kept for the next block."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            values = np.full(size, base, np.uint64)
            values[0] = 1
            _powers[name] = np.cumprod(values)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (in place)."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Block:
    """Some whole texts, lower-cased in A-Z, as one byte array with its words.

    wordly: which bytes are in words, or the class of each byte, where words end with their class
    and class 0 is in none. data: bytes; first/last: bounds of each word; bounds[i]:bounds[i+1] are the words of text i.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, wordly: np.ndarray):
        self.data, self.offsets = LOWER[data], offsets
        inside = wordly[self.data]
        n = len(data)
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = offsets[:-1][offsets[:-1] < n]
        before[cuts] = 0
        after[cuts[cuts > 0] - 1] = 0
        self.first = np.flatnonzero((inside > 0) & (before != inside))
        self.last = np.flatnonzero((inside > 0) & (after != inside)) + 1
        self.bounds = np.searchsorted(self.first, offsets)

    def owners(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.bounds))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.data)
        up, down = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        sums = total[1:]  # in place: a block's sums are eight times its bytes
        sums[:] = self.data
        sums += np.uint64(1)
        sums *= up[:n]
        np.cumsum(sums, out=sums)
        return mix((total[self.last] - total[self.first]) * down[self.first])

    def word(self, i: int) -> bytes:
        return self.data[self.first[i] : self.last[i]].tobytes()


def grams(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words that start at each word, and whether all k lie in one text."""
    n = len(h)
    out, ends = h.copy(), np.repeat(bounds[1:], np.diff(bounds))
    for j in range(1, min(k, n)):
        out[: n - j] = out[: n - j] * np.uint64(0x2545F4914F6CDD1D) + h[j:]
    return mix(out), np.arange(n) + k <= ends


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array without copies; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(texts: pa.Array, wordly: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """Cut the array into blocks of whole texts: (first text, text after the last, block)."""
    if not len(texts):
        return
    data, offsets = raw(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, len(texts))
        yield at, to, Block(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], wordly)
        at = to


# ---------------------------------------------------------------- counts
#: Numbers in a slice of a table of counts.
SLICE = 1 << 12


def _add_slices(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b, np.int64) for b in table["counts"].to_pylist())
    return pa.table({"slice": table["slice"][:1], "counts": pa.array([total.tobytes()], pa.binary())})


def summed_cells(df: DataFrame, count, cells: int) -> np.ndarray:
    """The sum of the tables of `cells` counts that count() makes of each partition's record batches. A
    partition sends it in slices; the driver gets one table, whatever the size of df."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = count(batches)
        parts = [total[a : a + SLICE] for a in range(0, cells, SLICE)]
        used = [i for i, x in enumerate(parts) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([parts[i].tobytes() for i in used], pa.binary())], ["slice", "counts"])

    out = np.zeros(cells, np.int64)
    for r in df.mapInArrow(sliced, "slice long, counts binary").groupBy("slice").applyInArrow(_add_slices, "slice long, counts binary").collect():
        part = np.frombuffer(r["counts"], np.int64)
        out[r["slice"] * SLICE : r["slice"] * SLICE + len(part)] = part
    return out
