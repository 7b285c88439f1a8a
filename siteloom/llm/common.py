"""Helpers that several corpus operators share."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def by_value(name: str) -> None:
    """Ship this module's functions to workers inside the job, so executors need no installed copy."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


by_value(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured and all run on one machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        base = getattr(spark, "_siteloom_work", None)
        if not base:
            import shutil

            base = tempfile.mkdtemp(prefix="siteloom-")
            spark._siteloom_work = base
            atexit.register(shutil.rmtree, base, True)
    return f"{base.rstrip('/')}/siteloom"


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of a batch that goes to a worker: a fifth of Spark's own number, since rows here are whole texts.
BATCH_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    """Keep the batches that workers get small, unless the session has its own size for them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def trimmed(rows):
    """rows, after which the worker, which lives on for other tasks, gives back the memory that it no longer needs."""

    def run(batches):
        yield from rows(batches)
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # no glibc
            pass

    return run


_open: dict[str, SparkSession] = {}


def release(*operators: str) -> None:
    """Delete the intermediate tables of all calls so far, or of those of some operators, whose results nobody reads any more."""
    for root in [r for r in _open if not operators or r.rpartition("/")[2].rpartition("-")[0] in operators]:
        spark = _open.pop(root)
        try:
            _remove(spark, root)
        except Exception:  # the session has ended before: what is left is the shared folder's to clear
            pass


class Stage:
    """Intermediate tables of one operator call, written as Parquet in the shared folder.

    Writing cuts the lineage: a lost executor costs a re-read of the table, not a re-run of what made it. Results are read
    from these tables, so they stay until release() or the end of the driver.
    """

    def __init__(self, spark: SparkSession, operator: str):
        small_batches(spark)
        self.spark, self.root = spark, f"{work_dir(spark)}/{operator}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self.paths: dict[int, str] = {}
        if not _open:
            atexit.register(release)
        _open[self.root] = spark

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def put(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in frames:
            if path := self.paths.pop(id(df), None):
                _remove(self.spark, path)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What tells rows apart: a hash of id and text. Rows alike in both are one document stored more than once."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


#: Keys up to which what goes is sent to every executor: 16 MB of longs. Beyond, rows and keys are dealt out.
SEND_KEYS = 2_000_000


def drop_rows(docs: DataFrame, gone: DataFrame, stage: Stage, id_col: str = "doc_id", text_col: str = "text", send: int = SEND_KEYS) -> DataFrame:
    """docs without the rows whose row_key is in the one column of gone. Texts stay where they are as long as gone is small."""
    own = fresh_name(docs, "row_key")
    keys = stage.put(gone.toDF(own).distinct(), "gone")
    small = keys.limit(send + 1).count() <= send
    return docs.withColumn(own, row_key(id_col, text_col)).join(F.broadcast(keys) if small else keys, own, "left_anti").drop(own)


def keep_first(docs: DataFrame, groups: DataFrame, stage: Stage, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group one row of docs: that of the smallest id, null last. groups: key (row_key), doc_id, grp; rows not in it stay.

    A row that is stored more than once stays once: those few keys alone are dealt out with their rows.
    """
    groups = stage.put(groups.select("key", "doc_id", "grp"), "groups")
    first = stage.put(groups.groupBy("grp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least")).select("least.key"), "first")
    counts = groups.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    out = drop_rows(docs, counts.join(first, "key", "left_anti").select("key"), stage, id_col, text_col)
    again = stage.put(counts.filter("n > 1").join(first, "key", "left_semi").select("key"), "again")
    if again.head() is None:
        return out
    own = fresh_name(docs, "row_key")
    several = out.withColumn(own, row_key(id_col, text_col)).join(again.toDF(own), own, "left_semi").dropDuplicates([own]).drop(own)
    return drop_rows(out, again, stage, id_col, text_col).unionByName(several)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def binary_text(array, i: int) -> bytes:
    """UTF-8 bytes of row i of an Arrow string array, null as empty."""
    v = array[i]
    return v.as_buffer().to_pybytes() if v.is_valid else b""


def splitmix(x: np.ndarray) -> np.ndarray:
    """A mixing bijection on unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string column and the n + 1 offsets of its rows; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.string())
    if array.null_count:
        array = pc.fill_null(array, "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offs, data = array.buffers()
    at = np.frombuffer(offs, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64) if len(array) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most_bytes: int = 1 << 20):
    """Ranges of rows (from, to) that hold about so many bytes at most, a longer row by itself."""
    cut, n = 0, len(offsets) - 1
    while cut < n:
        to = max(cut + 1, int(np.searchsorted(offsets, offsets[cut] + most_bytes, "right")) - 1)
        yield cut, to
        cut = to


#: Powers of an odd base modulo 2^64 and of its inverse, made as long as needed.
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.empty(size, np.uint64)
        out[0] = 1
        k = 1
        while k < size:  # doubling
            m = min(k, size - k)
            out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
            k += m
        _powers[base] = have = out
    return have[:n]


def _byte_codes() -> np.ndarray:
    return splitmix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, without a loop over the spans."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(raw)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_byte_codes()[raw] * _power(_BASE, n), out=total[1:])
    h = (total[ends] - total[starts]) * _power(_INVERSE, n + 1)[starts]
    return splitmix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def token_spans(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes, cut at row borders, and the row of each. is_word: a flag for each byte value."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = is_word[raw]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    first = first[:n]
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:]
    starts = np.flatnonzero(start)
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def space_table() -> np.ndarray:
    """Flags of the bytes that are not white space."""
    t = np.ones(256, bool)
    t[[32, *range(9, 14)]] = False
    return t
