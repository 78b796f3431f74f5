"""Helpers that the operators share: scratch tables, text batches, word hashes, labelled samples."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where it is unset, a folder of this machine in local mode, and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="synodic-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def written(frame: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder: cuts lineage, survives lost executors.

    The write runs in a copy of the session, in which shuffle files go once the table stands and
    Arrow batches are bounded by bytes; the session itself keeps its settings.
    """
    spark = frame.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    own = spark._jsparkSession.cloneSession()
    own.conf().set(CLEANUP, "true")
    own.conf().set(BATCH_BYTES, str(4 << 20))
    jvm = spark.sparkContext._jvm
    jvm.org.apache.spark.sql.classic.Dataset.ofRows(own, frame._jdf.logicalPlan()).write().parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out.written_at = path
    return out


def bounded(frame: DataFrame) -> DataFrame:
    """The frame, in a copy of the session in which Arrow batches are bounded by bytes: for what is written by others."""
    spark = frame.sparkSession
    own = spark._jsparkSession.cloneSession()
    own.conf().set(BATCH_BYTES, str(4 << 20))
    return DataFrame(spark.sparkContext._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own, frame._jdf.logicalPlan()), spark)


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for frame in frames:
        where = jvm.org.apache.hadoop.fs.Path(frame.written_at)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def released() -> None:
    """Give freed memory of this worker back to the system, at the end of a task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class Shared:
    """A broadcast of a thing of this package, read once by each Python worker; executors need no copy of the package."""

    def __init__(self, spark: SparkSession, thing):
        self.held = spark.sparkContext.broadcast(cloudpickle.dumps(thing))

    @property
    def value(self):
        if not hasattr(self.held, "thing"):
            self.held.thing = cloudpickle.loads(self.held.value)
        return self.held.thing


def bucket_of(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def byte_slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes of text each, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    bins = np.cumsum(lengths) // max(limit, 1)
    cuts = np.flatnonzero(np.diff(bins)) + 1 if len(bins) else np.array([], dtype=int)
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(int(a), int(b - a))


def over_texts(frame: DataFrame, text: str, fn: Callable, schema: str, limit: int = 1 << 18) -> DataFrame:
    """fn(part, texts) -> RecordBatch over byte-bounded parts of Arrow batches; null texts come as ''."""

    def run(batches):
        for batch in batches:
            for part in byte_slices(batch, text, limit):
                out = fn(part, ["" if t is None else t for t in part.column(text).to_pylist()])
                if out is not None and out.num_rows:
                    yield out
        released()

    return frame.mapInArrow(run, schema)


def record(**columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array | pa.ChunkedArray) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays], names=list(columns))


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, allowed: Column, cap: int, more: list[str] | tuple = ()) -> DataFrame:
    """(doc_id, label, text) of at most ``cap`` labelled documents, taken by hash order of the id.

    The cap bounds what a classifier is fitted on; the ids of the sample are at most ``cap`` rows,
    so that they may be broadcast. Repeated label rows of a document count once, the largest label.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & allowed)
    ids = known.groupBy(doc_id).agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64(doc_id), doc_id).limit(cap)
    return docs.select(doc_id, text, *more).join(F.broadcast(ids), doc_id)


def splitmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
RADIX = np.uint64(0xD6E8FEB86659FD93)


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), RADIX, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def words_of(texts: list[str], lower: bool = True, between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and the number of words of each text.

    Words are the runs without space, tab, line breaks, vertical tab and form feed; with ``lower``
    A-Z count as a-z; ``between`` names other separating bytes. The hash is a 64-bit polynomial of the bytes, mixed.
    """
    raw = "\n".join(texts).encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, dtype=np.uint8)
    if lower:
        data = ASCII_LOWER[data]
    outside = between[data]
    edge = np.diff(np.concatenate(([True], outside, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    lengths = ends - starts
    inside = ~outside
    place = np.arange(len(data))[inside] - np.repeat(starts, lengths)
    value = BYTE_VALUES[data[inside]] * powers(int(lengths.max()))[place]
    firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    hashes = splitmix(np.add.reduceat(value, firsts))
    sizes = np.array([len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts])
    ends_of_docs = np.cumsum(sizes + 1)
    return hashes, np.diff(np.searchsorted(starts, ends_of_docs), prepend=0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
