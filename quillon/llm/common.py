"""What the operators of this subpackage share: shared storage, words and stable hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the ASCII white space that bytes.split() splits at.
WORD = r"[^\x20\x09-\x0D]+"

_local_shared: list[str] = []
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset a local session (tests) gets a folder of its own; a cluster's executors could not
    see it, so there this raises.
    """
    if set_dir := spark.conf.get("spark.checkpoint.dir", None):
        return set_dir.rstrip("/")
    if not (master := spark.sparkContext.master).startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _local_shared:
        _local_shared.append(tempfile.mkdtemp(prefix="quillon-"))
    return _local_shared[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


#: Bytes of a row group of a stored table, which a task holds until it is full.
ROW_GROUP = 16 << 20


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage, and a lost executor loses nothing.

    The table goes by dropped(), or when the driver's JVM ends: a result may read it until then.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    place, system = _place(spark, path)
    system.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Delete stored tables that no later step and no result reads."""
    for table in tables:
        if table is not None and (path := _paths.pop(table, None)):
            place, system = _place(table.sparkSession, path)
            system.delete(place, True)


#: Rows of a table that keys are looked up in are sent to all executors up to this number of them.
BROADCAST_ROWS = 50_000
SALTS = 16


def looked_up(rows: DataFrame, small: DataFrame, keys: list[str], limit: int = BROADCAST_ROWS, n: int | None = None) -> DataFrame:
    """rows joined to a table with one row per key; keys must not be null.

    The table is counted (or its count is given): up to `limit` rows it is broadcast. Beyond that it is dealt out with each key
    SALTS times and rows by a hash of all they hold, so that a key with a third of all rows is many tasks.
    """
    if (small.count() if n is None else n) <= limit:
        return rows.join(F.broadcast(small), keys)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, [*keys, "__salt"]).drop("__salt")


#: Spark's defaults, and what small_batches() sets instead of them.
SMALL = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.files.maxPartitionBytes": ("134217728b", "16m")}


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows and tasks of 16 MB of a file where the session has Spark's defaults of 10,000 and 128 MB:
    texts may be long, a batch is held by the JVM and by a worker at once, and what a task reads it may write, which is
    held until a row group is full."""
    for key, (default, small) in SMALL.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, small)


def give_back() -> None:
    """Return freed memory to the system. A worker lives on after its task, and what it once held would count
    against the tasks of later steps."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every system has it
        ctypes.CDLL(None).malloc_trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def n_words(column: str = "text"):
    """Words of a text column as a long; null counts as empty."""
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def batches_of(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most so many rows, which bounds what a vectorised step allocates."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Fixed odd multipliers and byte values of the hashes below, from a fixed seed.
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64)
POWER_BASE = np.uint64(int(_rng.integers(1, 2**62)) * 2 + 1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """POWER_BASE to 0 .. n-1 and its inverses, modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(POWER_BASE), -1, 1 << 64))
        for k, base in enumerate((POWER_BASE, inverse)):
            grown = np.full(size, base, np.uint64)
            grown[0] = 1
            _powers[k] = np.multiply.accumulate(grown)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_is_space = np.zeros(256, bool)
_is_space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def word_hashes(data: bytes, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the words of UTF-8 data, in order, without a Python step per word.

    A word's hash is a polynomial over random byte values, got as a difference of prefix sums.
    """
    raw = np.frombuffer(data, np.uint8)
    space = _is_space[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    power, inverse = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[_lower[raw] if lower else raw] * power[: len(raw)], out=total[1:])
    return mixed((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` word hashes; with fewer words, of the whole sequence as one; of none, nothing."""
    n = len(words)
    if not n:
        return words
    take = min(width, n)
    out = np.zeros(n - take + 1, np.uint64)
    for k in range(take):
        out = (out ^ words[k : n - take + 1 + k]) * POWER_BASE + np.uint64(k + 1)
        out ^= out >> np.uint64(29)
    return mixed(out + np.uint64(take))
