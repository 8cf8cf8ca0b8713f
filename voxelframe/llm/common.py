"""Shared pieces: the shared folder, cut lineage, column picking, word hashing."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

M64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in
    its absence (tests, one machine) a temporary folder that is then set."""
    set_dir = spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="voxelframe-")
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str = "step", level: int = 3) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again, which
    cuts lineage and survives the loss of executors. level: of zstandard."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._voxelframe_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table made by materialize() that nothing reads any more."""
    path = getattr(df, "_voxelframe_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


class Tables:
    """Tables written on the way to a result, deleted together once it is written."""

    def __init__(self) -> None:
        self.made: list[DataFrame] = []

    def keep(self, df: DataFrame, what: str) -> DataFrame:
        self.made.append(materialize(df, what))
        return self.made[-1]

    def done(self, result: DataFrame, what: str) -> DataFrame:
        """``result`` as a table of its own; all others go."""
        out = materialize(result, what)
        for t in self.made:
            discard(t)
        self.made = []
        return out


def free(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs: it does so once the
    driver has collected the objects that stand for them."""
    gc.collect()
    spark._jvm.System.gc()


def give_back() -> None:
    """Return memory that was freed to the system. Python workers live on after a
    task, and what malloc and Arrow keep for later counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with ``give_back`` at its end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(doc_id, text[, more]): the columns an operator needs, by whatever other
    columns there are. A null text counts as empty; a row without an id takes
    no part."""
    return df.where(df[id_col].isNotNull()).select(
        df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"), *(df[c] for c in more)
    )


def salt(n: Column | int, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n) if isinstance(n, int) else n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers (in place)."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x


def words_of(text: str) -> list[bytes]:
    """Maximal runs of anything but the ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


#: Longer words are hashed one by one.
LONG_WORD = 64
#: Masks of the first bytes of eight.
LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def hash_spans(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the non-empty spans of ``data``, eight bytes at a step.
    ``data`` ends with seven bytes that belong to no span."""
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    size = ends - starts
    out = size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    left, at, which = size, starts, np.arange(len(starts))
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    for j in range(0, LONG_WORD, 8):
        go = (left > 0) & (left <= LONG_WORD) if j == 0 else left > 0
        if not go.all():
            left, at, which = left[go], at[go], which[go]
        if not len(left):
            break
        h = out[which] ^ (eights[at] & LOW[np.minimum(left, 8)])
        out[which] = mix64(h)
        left, at = left - 8, at + 8
    return out


def word_hashes(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    return hash_spans(b"".join(words) + bytes(7), np.append(0, ends[:-1]) if words else ends, ends)


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of each ``width`` consecutive words, of the words' hashes."""
    n = len(h) - width + 1
    out = np.full(n, 0x9E3779B97F4A7C15 * (width + 1) & M64, np.uint64)
    for j in range(width):
        out ^= h[j : n + j]
        mix64(out)
    return out


def shingle_set(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole
    sequence where it is shorter; empty for no words."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(shingles(word_hashes(words), min(len(words), k)))


#: Texts are joined to chunks of about so many characters.
CHUNK = 1_000_000
_BLANK = bytes(0x20 if 0x09 <= c <= 0x0D else c for c in range(256))


def chunks(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Consecutive texts of about CHUNK characters together; null is empty."""
    chunk, size = [], 0
    for t in texts:
        t = t or ""
        if chunk and size + len(t) > CHUNK:
            yield chunk
            chunk, size = [], 0
        chunk.append(t)
        size += len(t) + 1
    if chunk:
        yield chunk


def shingle_sets(texts: Iterable[str | None], k: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """(128-bit digest of the words, ``shingle_set`` of the words) of each text.
    Words are found and hashed in joined texts by array operations."""
    for chunk in chunks(texts):
        raws = [t.encode("utf-8", "surrogatepass") for t in chunk]
        data = b" ".join(raws).lower().translate(_BLANK) + b" " * 8
        word = np.frombuffer(data, np.uint8) != 0x20
        edges = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[0]:
            edges = np.append(0, edges)
        starts, stops = edges[::2], edges[1::2]
        ends = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1) - 1
        at = np.append(0, np.searchsorted(starts, ends))
        first, last = np.append(starts, 0)[at[:-1]].tolist(), np.append(stops, 0)[at[1:] - 1].tolist()
        h = hash_spans(data, starts, stops)
        every = shingles(h, k) if len(h) >= k else None  # those across texts are left out below
        for x, y, start, stop in zip(at[:-1].tolist(), at[1:].tolist(), first, last, strict=True):
            n = y - x
            seq = data[start:stop] if n else b""
            if b"  " in seq:
                seq = b" ".join(seq.split())
            s = every[x : y - k + 1].copy() if n >= k else shingles(h[x:y], n) if n else np.empty(0, np.uint64)
            s.sort()
            new = s[1:] != s[:-1]
            yield hashlib.blake2b(seq, digest_size=16).digest(), s if new.all() else s[np.append(True, new)]
