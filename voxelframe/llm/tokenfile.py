"""Token-id files with a shared zstandard dictionary.

Format: a table of blocks. Each row holds a run of documents in ascending id
order: part and block (its place), dict_hash, width (bytes of an id), ids and
counts of its documents, offsets (n + 1) into data, where each document's id
array is one zstandard frame made with the shared dictionary. A document is
read by its offsets alone. The dictionary lies beside the blocks as a table
(hash, bytes) and is trained on the whole arrays of at most ``sample`` documents.

Scale. Texts are encoded once, where they are read; only compressed frames are
range-partitioned by id. Starts are sums within a part's blocks plus the totals
of the parts before, of which there are as many as partitions.

Cases. Null and empty texts consist of the end id. Rows without an id take no
part. Rows with one id lie side by side, shorter first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import discard, documents, free, materialize
from .wordbpe import encode_many, load_tokenizer

BLOCKS = "part int, block int, dict_hash string, width int, ids array<long>, counts array<int>, offsets array<int>, data binary"
#: A block ends after so many documents or bytes.
BLOCK_DOCS, BLOCK_BYTES = 512, 4_000_000


def _pack_ids(ids: np.ndarray, width: int) -> bytes:
    return ids.astype(f"<u{width}").tobytes()


def train_dictionary(docs: DataFrame, path: str, width: int, sample: int, size: int = 64_000, piece: int = 16_384) -> bytes:
    """A dictionary from the id arrays of at most ``sample`` documents, those of
    smallest hashed id. Whole arrays serve, cut into pieces of ``piece`` bytes."""
    every = max(1, docs.count() // (2 * sample))
    h = F.xxhash64("doc_id")
    some = docs.where(F.pmod(h, F.lit(every)) == 0).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", F.xxhash64("text")).limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arrays = [_pack_ids(x, width) for x in encode_many(path, b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([x[k : k + piece] for x in arrays for k in range(0, max(1, len(x)), piece)], pa.binary())], ["s"])

    samples = sorted(bytes(r["s"]) for r in some.mapInArrow(run, "s binary").collect())
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples
        return b"".join(samples)[:size]


def _hash(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest()[:32]


def _frames(path: str, end: int, width: int, dictionary: bytes, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)
        last = _pack_ids(np.array([end]), width)
        for b in batches:
            n, frames = [], []
            for x in encode_many(path, b.column(1).to_pylist()):
                n.append(len(x) + 1)
                frames.append(c.compress(_pack_ids(x, width) + last))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(frames, pa.binary())], ["doc_id", "n", "frame"])

    return run


def _blocks(dict_hash: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        ids, counts, frames, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            ends = np.cumsum([0] + [len(f) for f in frames]).tolist()
            row = {"part": part, "block": block, "dict_hash": dict_hash, "width": width, "ids": ids, "counts": counts, "offsets": ends, "data": b"".join(frames)}
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

        for b in batches:
            for i, n, f in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids.append(i)
                counts.append(n)
                frames.append(f)
                size += len(f)
                if len(ids) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield out()
                    ids, counts, frames, size, block = [], [], [], 0, block + 1
        if ids:
            yield out()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, out: str, end: int = 2, sample: int = 2000, level: int = 3, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the blocks to ``out``/blocks and the dictionary to ``out``/dictionary.
    Ids take two bytes, or four if the tokenizer's or ``end`` needs them."""
    spark = docs.sparkSession
    texts = documents(docs, id_col, text_col)
    width = 2 if max(end, *load_tokenizer(tokenizer).get_vocab().values()) < 65_536 else 4
    dictionary = train_dictionary(texts, tokenizer, width, sample)
    spark.createDataFrame([(_hash(dictionary), bytearray(dictionary))], "hash string, bytes binary").coalesce(1).write.parquet(f"{out}/dictionary")
    frames = materialize(texts.mapInArrow(_frames(tokenizer, end, width, dictionary, level), "doc_id long, n int, frame binary"), "frames")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = frames.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "n", "frame")
    dealt.mapInArrow(_blocks(_hash(dictionary), width), BLOCKS).write.option("compression", "none").parquet(f"{out}/blocks")
    discard(frames)
    free(spark)


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, ids: binary) of every document in the files."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{out}/blocks")
    row = spark.read.parquet(f"{out}/dictionary").first()
    dictionary, expected = bytes(row["bytes"]), row["hash"]
    sums = blocks.select("part", "block", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts = sums.groupBy("part").agg(F.sum("n").alias("n"))  # as many rows as partitions
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("above"))
    inner = sums.select("part", "block", (F.sum("n").over(Window.partitionBy("part").orderBy("block")) - F.col("n")).alias("within"))
    at = inner.join(before, "part").select("part", "block", (F.col("above") + F.col("within")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _hash(dictionary) != expected:
            raise ValueError("the dictionary doesn't match its hash")
        d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for b in batches:
            for r in b.to_pylist():
                if r["dict_hash"] != expected:
                    raise ValueError("a block was made with another dictionary")
                ids = [np.frombuffer(d.decompress(r["data"][x:y]), f"<u{r['width']}").astype("<u4").tobytes() for x, y in zip(r["offsets"][:-1], r["offsets"][1:], strict=True)]
                starts = r["start"] + np.cumsum([0, *r["counts"]])[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])

    return blocks.join(at, ["part", "block"]).select("dict_hash", "width", "ids", "counts", "offsets", "data", "start").mapInArrow(run, "doc_id long, start long, ids binary")

