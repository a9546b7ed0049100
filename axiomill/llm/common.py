"""What the operators of this subpackage share: reading, shared storage, sizing, byte-level text kernels."""

from __future__ import annotations

import atexit
import hashlib
import math
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import checkpoint_dir

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Where the session names none, a folder of our own is set on one machine; on a cluster that is an error.
    """
    return checkpoint_dir(spark).rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stash(df: DataFrame, name: str, free: bool = False, small: bool = False) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage and survives lost executors.

    ``free``: what the step shuffled is large and no longer needed, so Spark's cleaner is given the time to drop those files.
    ``small``: many tasks leave a few rows each. These are gathered first, so few tasks write a file; on local disks each costs its
    executor three chmod processes.
    """
    spark = df.sparkSession
    if small:
        df = df.hint("rebalance", df.columns[0])
    path = f"{shared_dir(spark)}/axiomill-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_forget, spark, path)
    schema = df.schema
    del df
    # the driver's heap holds little between steps but grows to its bound if nothing collects it; what no plan needs any more goes from the executors' disks too
    spark.sparkContext._jvm.System.gc()
    if free:
        time.sleep(0.5)
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
    return spark.read.schema(schema).parquet(path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # the session has ended; the cluster's owner cleans its checkpoint folder
        pass


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size of a frame, from file sizes: cheap, no job. 0 where it has none (frames that are not read from files)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 52 else 0


def partitions_for(df: DataFrame, mb: int = 16) -> int:
    """Partitions so that each holds about ``mb`` MB of the (compressed) input, never under the session's own."""
    spark = df.sparkSession
    return int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(200_000, math.ceil(input_bytes(df) / (mb << 20)))))


def arrow_rows(spark: SparkSession, rows: int) -> None:
    """At most so many rows in an Arrow batch between JVM and Python: bounds a worker's memory when rows are long. Only ever lowered, since
    plans run later than they are built."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def crc_mod(col, m: int):
    """crc32 of the id as text, modulo m; null ids give 0."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % m, F.lit(0))


# ---------------------------------------------------------------- byte-level kernels

_rng = np.random.default_rng(20240601)
#: a random 64-bit value for each byte, and the odd base of the polynomial prefix hash
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_pow = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_pow["up"]) < n:
        m = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            for k, b in (("up", BASE), ("down", BASE_INV)):
                x = np.full(m, b, np.uint64)
                x[0] = 1
                _pow[k] = np.multiply.accumulate(x)
    return _pow["up"][:n], _pow["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer: spreads every bit over the word."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Prefix:
    """Polynomial prefix hash of a byte buffer; the hash of any slice in constant time."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        up, self.down = powers(n + 1)
        self.s = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(BYTE[buf] * up[:n], out=self.s[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.s[end] - self.s[start]) * self.down[start] + (end - start).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


#: words beyond this many bytes are hashed one by one: sums of powers modulo 2**64 have long strings that collide whatever the base
LONG_WORD = 255


def word_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words [s, e) of a buffer."""
    h = Prefix(buf).of(s, e)
    for i in np.flatnonzero(e - s > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[s[i] : e[i]].tobytes(), digest_size=8).digest(), "little")
    return h


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def joined(texts: list[bytes], sep: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Texts in one buffer, each followed by ``sep``; the start of each text (one more: the end)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + len(sep) for t in texts], out=starts[1:])
    return np.frombuffer(sep.join(texts) + sep if texts else b"", np.uint8), starts


def words_of(buf: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], is_word[buf], [False])).astype(np.int8)))
    return edge[0::2], edge[1::2]


def chunks(items: list, sizes, most: int):
    """Consecutive slices of items whose sizes sum to at most ``most`` (or a single larger item)."""
    at, total = 0, 0
    for i, s in enumerate(sizes):
        if i > at and total + s > most:
            yield at, items[at:i]
            at, total = i, 0
        total += s
    if at < len(items):
        yield at, items[at:]


def encoded(text) -> bytes:
    """UTF-8 of a text; null is empty, lone surrogates cannot occur in Spark strings."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


_codec: dict = {}


def codec(kind: str):
    """One compressor and one decompressor for a worker: their buffers are large."""
    if kind not in _codec:
        import zstandard

        _codec[kind] = zstandard.ZstdCompressor(level=1) if kind == "c" else zstandard.ZstdDecompressor()
    return _codec[kind]


def packed(rec: np.ndarray) -> bytes:
    """Records column by column, compressed: what repeats in a column costs little in a shuffle."""
    return codec("c").compress(b"".join(np.ascontiguousarray(rec[k]).tobytes() for k in rec.dtype.names))


def unpacked(payloads: list[bytes], kind: np.dtype) -> np.ndarray:
    parts = []
    for p in payloads:
        b = codec("d").decompress(p)
        n, at = len(b) // kind.itemsize, 0
        out = np.empty(n, kind)
        for k in kind.names:
            size = kind[k].itemsize * n
            out[k] = np.frombuffer(b, kind[k], n, at)
            at += size
        parts.append(out)
    return np.concatenate(parts) if parts else np.zeros(0, kind)


class Interner(dict):
    """Numbers strings in order of first sight; ``fresh`` lists those not yet taken up. One look-up a word."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n

    def take(self) -> list[str]:
        out, self.fresh = self.fresh, []
        return out


def trim() -> None:
    """Give a worker's freed memory back: workers live on from stage to stage."""
    import ctypes

    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own counsel
        pass


_kept: list = []


def kept(maker):
    """Mark a cached maker whose product a worker keeps between tasks; ``release`` drops it."""
    _kept.append(maker)
    return maker


def release() -> None:
    """Called where another operator's tasks begin: workers live on from stage to stage, what they kept need not."""
    if any(m.cache_info().currsize for m in _kept):
        for m in _kept:
            m.cache_clear()
        trim()
