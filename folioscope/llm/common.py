"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

#: Keys of at least this share of all rows are joined by broadcast; there are at most its inverse of them.
HOT = 1 / 2000
#: Texts are handed to the Python workers' inner loops in slices of about this many bytes.
SLICE_BYTES = 4 << 20
#: A table of marks has so many bits at most, as powers of two, and is put together from pieces of so many.
MARK_BITS, PIECE_BITS = 26, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="folioscope-")
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(at)
    return at


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder name below the shared folder, as a URI."""
    at = shared_dir(spark).rstrip("/")
    if "://" not in at:
        at = ("file://" if at.startswith("/") else "file:///") + at.removeprefix("file:")
    return f"{at}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: What a Python worker keeps from one task to the next, by name.
HELD: dict = {}


def let_go(keeps: str = "") -> None:
    """Drop what earlier tasks of other stages have left in this worker: Spark gives it to any stage of the session."""
    if gone := [k for k in HELD if k != keeps]:
        for k in gone:
            del HELD[k]
        gc.collect()
        give_back()


def give_back() -> None:
    """Hand memory that is free inside this worker back to the system; both allocators keep it else."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, in a worker that holds nothing of other stages before, but what is kept by that name, and no free memory after."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(keeps)
        yield from run(batches)
        give_back()

    return own


def kept_on_disk(df: DataFrame) -> DataFrame:
    """Hold a table that is read twice. Lost blocks are recomputed from the lineage, which stays."""
    return df.persist(StorageLevel.DISK_ONLY)


def hot_join(rows: DataFrame, values: DataFrame, key: str, value: str, salt: str) -> DataFrame:
    """rows with `value` of their key, from values (key, value, many), `many` the rows of each key.

    Keys of a share HOT of all rows or more are few and joined by broadcast; their rows are dealt by `salt` in the other join.
    """
    values = kept_on_disk(values)
    total = values.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]
    least = max(2.0, total * HOT)
    hot = values.where(F.col("many") >= least).select(F.col(key).alias("hot key"), F.col(value).alias("hot value"))  # 1 / HOT rows at most
    rest = values.where(F.col("many") < least).select(F.col(key).alias("rest key"), F.col(value).alias("rest value"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("hot key"), "left")
    dealt = marked.withColumn("dealt key", F.when(F.col("hot key").isNull(), F.col(key)).otherwise(F.xxhash64(F.lit("dealt"), salt)))
    found = dealt.join(rest, (F.col("dealt key") == F.col("rest key")) & F.col("hot key").isNull(), "left")
    return found.select(*rows.columns, F.coalesce("hot value", "rest value").alias(value))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def scaled(count: int, per: int, least: int) -> int:
    """Number of pieces that hold about `per` rows each, `least` at least."""
    return max(least, -(-int(count) // per))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns the text operators read, under fixed names, whatever else the table holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def small_batches(spark: SparkSession) -> None:
    """Have texts go to the Python workers in batches of SLICE_BYTES at most, from now on in this session: a batch is held by the executor and by its worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= SLICE_BYTES:
        spark.conf.set(name, str(SLICE_BYTES))


class Marks:
    """Places of 64-bit hashes in a table of bounded size: whatever was marked is found, others now and then as well."""

    def __init__(self, count: int) -> None:
        self.bits = int(np.clip(int(16 * max(1, count)).bit_length(), PIECE_BITS, MARK_BITS))
        self.table = np.zeros((1 << (self.bits - PIECE_BITS), (1 << PIECE_BITS) // 8), np.uint8)

    def gather(self, pieces: DataFrame) -> Marks:
        """From rows (piece int, bits binary), one for each piece at most."""
        for piece, bits in pieces.collect():
            self.table[piece] = np.frombuffer(bytes(bits), np.uint8)
        return self

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes.view(np.uint64) >> np.uint64(64 - self.bits)
        return (self.table.ravel()[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0

    def of(self, column: Column) -> Column:
        """Whether a column of hashes (long, never null) is marked."""

        @F.arrow_udf("boolean")
        def found(hashes: pa.Array) -> pa.Array:
            return pa.array(self.has(hashes.to_numpy(zero_copy_only=False)))

        return found(column)


def marked_keys(keys: DataFrame, key: str) -> Marks:
    """The marks of the XXH64 of a column's values; `keys` is computed twice."""
    marks = Marks(keys.count())
    place = F.shiftrightunsigned(F.xxhash64(key), 64 - marks.bits)
    rows = keys.select(F.shiftright(place, PIECE_BITS).cast("int").alias("piece"), place.bitwiseAND(F.lit((1 << PIECE_BITS) - 1)).cast("int").alias("place"))

    @frugal
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for batch in batches:
            piece, place = (batch.column(c).to_numpy() for c in ("piece", "place"))
            for k in np.unique(piece).tolist():
                pieces.setdefault(k, np.zeros(1 << PIECE_BITS, bool))[place[piece == k]] = True
        if pieces:
            packed = [np.packbits(x, bitorder="little").tobytes() for x in pieces.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.int32()), pa.array(packed, pa.binary())], names=["piece", "bits"])

    return marks.gather(rows.repartition(partitions(keys.sparkSession), "piece").mapInArrow(pack, "piece int, bits binary"))


def binary_column(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    """A binary column of values of these lengths in bytes, one behind the other in `data`."""
    ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into consecutive slices of about `limit` text bytes, one row at least."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start)


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; FOLIOSCOPE_TOKENIZERS overrides the installed folder."""
    folder = os.environ.get("FOLIOSCOPE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
