"""Near duplicates by circulant MinHash, banding and exact Jaccard confirmation.

Method. Shingle hashes x live in the universe of 32-bit integers. One
permutation sigma scatters them; a second one, pi, applied to sigma(x) shifted
circularly by k, gives coordinate k of the signature: min over x of
pi(sigma(x) + k). Two permutations thus serve all coordinates. Coordinates are
banded (``bands`` of ``rows``); documents that share a band are candidates and
are linked only if their full shingle sets pass the Jaccard test.

Scale. Equal word sequences are first folded to their smallest id by a
pre-aggregated minimum. In a bucket, members are compared with one leader, not
with each other; components are then found, and only buckets whose members
still lie in different components go on, with another leader. What remains
after ``leaders`` rounds is compared in full, but only across components and
never inside the largest component of the bucket; large groups of such
left-overs are compared block against block, by products of incidence
matrices. No bucket is capped.
With 5 rows and 32 bands a link of similarity 0.8 is missed with
probability 3e-6.

Cases. Null or empty texts and texts without words have an empty set and are
linked with nothing. Rows without an id take no part. A repeated row is
answered once for each time it occurs. Rows with one id and different texts
are one document with several texts: it is linked by any of them. Shingle sets are compared by 64-bit
hashes of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, documents, free, lean, mix64, shingle_sets
from .graph import connected_components

#: A group of left-over members with more pairs than this is compared in blocks.
DENSE = 20_000
BLOCK_SHINGLES = 20_000
#: Bands of the round that comes first.
FIRST_BANDS = 4
SKETCH = "doc_id long, dig binary, n_shingles long, bands array<long>"


def circulant_signature(x: np.ndarray, coords: int) -> np.ndarray:
    """The ``coords`` coordinates of a non-empty array of distinct hashes."""
    s = (x >> np.uint64(32)).astype(np.uint32)  # sigma: hashes are scattered by mix64
    # pi: bijective steps on 32-bit integers; the first, a product, is taken before the circular shift, a sum that wraps
    s *= np.uint32(0x7FEB352D)
    shifts = np.arange(coords, dtype=np.uint32)[:, None] * np.uint32(0x7FEB352D)
    out = np.full(coords, 0xFFFFFFFF, np.uint32)
    step = max(1, 80_000 // coords)
    for at in range(0, len(s), step):
        y = s[at : at + step] + shifts
        z = y >> np.uint32(15) if at == 0 or y.shape != z.shape else np.right_shift(y, np.uint32(15), out=z)
        y ^= z
        y *= np.uint32(0x846CA68B)
        np.minimum(out, y.min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """The keys of the bands of a signature, or of each of several."""
    m = sig.reshape(*sig.shape[:-1], bands, rows).astype(np.uint64)
    key = np.empty(m.shape[:-1], np.uint64)
    key[...] = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
    for j in range(rows):
        key ^= m[..., j] + np.uint64(j << 40)
        mix64(key)
    return key.view(np.int64)


def _sketches(words: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dig, n, sigs = [], [], []
            for d, x in shingle_sets((t.as_py() for t in b.column(1)), words):
                dig.append(d)
                n.append(len(x))
                if len(x):
                    sigs.append(circulant_signature(x, rows * bands))
            ends = np.cumsum([0] + [bands if k else 0 for k in n]).astype(np.int32)
            flat = band_keys(np.array(sigs), rows, bands).ravel() if sigs else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dig, pa.binary()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "dig", "n_shingles", "bands"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dig, sets = [], []
            for d, x in shingle_sets((t.as_py() for t in b.column(1)), words):
                dig.append(d)
                sets.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary()), pa.array(dig, pa.binary())], ["id", "s", "dig"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, last, x = [], None, None
            for i, (s, t) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                s, t = s.as_buffer(), t.as_buffer()
                if last is None or s.address != last:
                    x, last = np.frombuffer(s, np.uint64), s.address
                y = np.frombuffer(t, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                inter = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * inter >= percent * (len(both) - inter):
                    keep.append(i)
            yield b.select([0, 1]).take(pa.array(keep, pa.int32()))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the (a, b) whose sets pass."""
    sa, sb = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    return pairs.join(sb, "b").join(sa, "a").select("a", "b", "sa", "sb").mapInArrow(lean(_confirm(percent)), "a long, b long")


def _dense(members: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame | None]:
    """Members are grouped by chains of shared buckets. Groups that would give
    over DENSE pairs are taken out: (the other members, (g, id, n, c) of those
    or None)."""
    lowest = members.groupBy("bucket").agg(F.min("id").alias("lo"))
    groups = tables.keep(connected_components(members.join(lowest, "bucket").select(F.col("id").alias("a"), F.col("lo").alias("b")), tables), "groups").select(F.col("node").alias("id"), F.col("component").alias("g"))
    members = tables.keep(members.join(groups, "id"), "members")
    sized = members.groupBy("g", "bucket", "c").agg(F.count("*").alias("k")).groupBy("g", "bucket").agg(F.sum("k").alias("t"), F.sum(F.col("k") * F.col("k")).alias("q"))
    big = tables.keep(sized.groupBy("g").agg((F.sum(F.col("t") * F.col("t") - F.col("q")) / 2).alias("w")).where(F.col("w") > DENSE).select("g"), "dense")
    if big.isEmpty():
        return members.drop("g"), None
    return members.join(big, "g", "left_anti").drop("g"), tables.keep(members.join(big, "g").select("g", "id", "n", "c").distinct(), "dense")


BLOCKED = "g long, k int, ids binary, comps binary, ends binary, hashes binary"


def _blockwise(dense: DataFrame, sets: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """Links (a, b) across components within each group, one for each two
    components and two blocks. Documents are dealt to blocks of about
    BLOCK_SHINGLES shingles; two blocks are compared by one product of
    incidence matrices, so that rows are made for blocks, not for pairs."""
    count = dense.groupBy("g").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    dealt = dense.join(count, "g").withColumn("k", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        blobs = [x.as_py() for x in t.column("s")]
        ends = np.cumsum([0] + [len(x) // 8 for x in blobs])
        return pa.table({"g": t.column("g")[:1].combine_chunks(), "k": t.column("k")[:1].combine_chunks(), "ids": pa.array([t.column("id").to_numpy().tobytes()], pa.binary()), "comps": pa.array([t.column("c").to_numpy().tobytes()], pa.binary()), "ends": pa.array([ends.astype(np.int64).tobytes()], pa.binary()), "hashes": pa.array([b"".join(blobs)], pa.binary())})

    blocks = tables.keep(dealt.join(sets, "id").select("g", "k", "id", "c", "s").groupBy("g", "k").applyInArrow(pack, BLOCKED), "blocks")
    two = count.select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"), "blocks").select("g", "k", F.explode(F.sequence("k", F.col("blocks") - 1)).alias("l"))
    other = blocks.select("g", F.col("k").alias("l"), *(F.col(c).alias(f"{c}2") for c in ("ids", "comps", "ends", "hashes")))
    n = int(dense.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = two.repartition(n, "g", "k", "l").join(blocks, ["g", "k"]).join(other, ["g", "l"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*b.columns, strict=True):
                ids, comps, ends, ids2, comps2, ends2 = (np.frombuffer(row[k].as_py(), np.int64) for k in (0, 1, 2, 4, 5, 6))
                x, y = np.frombuffer(row[3].as_py(), np.uint64), np.frombuffer(row[7].as_py(), np.uint64)
                shared = np.intersect1d(x, y)
                count, count2 = np.diff(ends), np.diff(ends2)
                a, c = _incidence(x, ends, shared), _incidence(y, ends2, shared)
                inter = np.rint(a @ c.T).astype(np.int64)
                hit = (100 * inter >= percent * (count[:, None] + count2[None, :] - inter)) & (comps[:, None] != comps2[None, :])
                i, j = np.nonzero(hit)
                pair = np.stack([np.minimum(comps[i], comps2[j]), np.maximum(comps[i], comps2[j])], axis=1)
                keep = np.unique(pair, axis=0, return_index=True)[1] if len(pair) else np.empty(0, int)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids2[j])[keep]), pa.array(np.maximum(ids[i], ids2[j])[keep])], ["a", "b"])

    return rows.select("ids", "comps", "ends", "hashes", "ids2", "comps2", "ends2", "hashes2").mapInArrow(lean(compare), "a long, b long")


def _incidence(hashes: np.ndarray, ends: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """(documents, shared hashes) of 0 and 1."""
    out = np.zeros((len(ends) - 1, len(shared)), np.float32)
    if len(shared):
        at = np.minimum(np.searchsorted(shared, hashes), len(shared) - 1)
        found = shared[at] == hashes
        out[np.repeat(np.arange(len(ends) - 1), np.diff(ends))[found], at[found]] = 1
    return out


def _pair(x: str, y: str):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, rows: int = 5, bands: int = 32, leaders: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of
    ``docs``. component_id is the smallest id that links reach."""
    percent, tables = round(threshold * 100), Tables()
    texts = documents(docs, id_col, text_col)
    sketch = tables.keep(texts.mapInArrow(lean(_sketches(words, rows, bands)), SKETCH), "sketch")
    one = sketch.where("n_shingles > 0").groupBy("dig").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("m"))
    reps = tables.keep(one.select("dig", F.col("m.doc_id").alias("id"), F.col("m.n_shingles").alias("n"), F.col("m.bands").alias("bands")), "reps")

    banded = reps.select("id", "n", F.posexplode("bands").alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("bucket")
    members = tables.keep(banded.join(shared, "bucket").select("bucket", "band", "id", "n", F.col("id").alias("c")), "members")
    sets = tables.keep(texts.join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(lean(_sets(words)), "id long, s binary, dig binary").dropDuplicates(["id", "dig"]).select("id", "s"), "sets")

    free(docs.sparkSession)
    near = F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m)")
    tried: list[DataFrame] = []
    comp = None
    for k in range(-1, leaders + 1):  # -1: a few bands, to fold large groups with few links
        if members.isEmpty():
            break
        left = members.where(F.col("band") < FIRST_BANDS) if k < 0 else members
        if k < leaders:
            order = F.struct("id", "n", "c") if k <= 0 else F.struct(F.xxhash64("id", F.lit(k)).alias("h"), "id", "n", "c")
            lead = left.groupBy("bucket").agg(F.min(order).alias("l")).select("bucket", F.col("l.id").alias("y"), F.col("l.n").alias("m"), F.col("l.c").alias("d"))
        else:
            members, dense = _dense(members, tables)
            if dense is not None:
                comp = _joined(comp, _blockwise(dense, sets, percent, tables), tables)
                free(docs.sparkSession)
            sized = members.groupBy("bucket", "c").agg(F.count("*").alias("k"))
            largest = sized.groupBy("bucket").agg(F.max(F.struct("k", "c")).alias("g")).select("bucket", F.col("g.c").alias("top"))
            left = members.join(largest, "bucket").where("c <> top").drop("top")
            lead = members.select("bucket", F.col("id").alias("y"), F.col("n").alias("m"), F.col("c").alias("d"))
        pairs = left.join(lead, "bucket").where(F.expr("id <> y and c <> d") & near).select(*_pair("id", "y")).distinct()
        for t in tried:
            pairs = pairs.join(t, ["a", "b"], "left_anti")
        pairs = tables.keep(pairs, "pairs")
        tried.append(pairs)
        if pairs.isEmpty():
            continue
        comp = _joined(comp, _verified(pairs, sets, percent), tables)
        free(docs.sparkSession)
        if k == leaders:
            break
        placed = members.select("bucket", "band", "id", "n").join(comp.select(F.col("node").alias("id"), F.col("component").alias("x")), "id", "left").select("bucket", "band", "id", "n", F.coalesce("x", "id").alias("c"))
        still = placed.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("bucket")
        members = tables.keep(placed.join(still, "bucket"), "members")
    of = reps.select("dig", F.col("id"))
    if comp is not None:
        of = of.join(comp.select(F.col("node").alias("id"), "component"), "id", "left").select("dig", F.coalesce("component", "id").alias("component"))
    else:
        of = of.select("dig", F.col("id").alias("component"))
    out = sketch.select("doc_id", "n_shingles", "dig").join(of, "dig", "left")
    cid = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return tables.done(out.select("doc_id", "n_shingles", cid.alias("component_id"), (F.col("doc_id") == cid).alias("kept")), "near")


def _joined(comp: DataFrame | None, links: DataFrame, tables: Tables) -> DataFrame:
    """(node, component) after ``links`` (a, b), which are first contracted to
    the components so far: only these are put together."""
    if comp is None:
        return tables.keep(connected_components(links, tables), "components")
    ends = links
    for x in ("a", "b"):
        c = comp.select(F.col("node").alias(x), F.col("component").alias(f"{x}_"))
        ends = ends.join(c, x, "left").withColumn(f"{x}_", F.coalesce(f"{x}_", x))
    ends = tables.keep(ends.select("a", "b", "a_", "b_"), "ends")
    over = tables.keep(connected_components(ends.select(F.col("a_").alias("a"), F.col("b_").alias("b")), tables), "components")
    moved = comp.join(over.select(F.col("node").alias("component"), F.col("component").alias("c")), "component", "left").select("node", F.coalesce("c", "component").alias("component"))
    return tables.keep(moved.union(over.join(comp.select("node"), "node", "left_anti").select("node", "component")), "components")
