"""Nearest neighbours by vantage-point trees, one for each shard.

The largest inner product is made a distance: a vector x of a shard whose
longest has norm M becomes (x, sqrt(M^2 - |x|^2)) and a query q becomes (q, 0);
then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x. A node holds a vantage point and the
median distance mu of its vectors to it; a query with distance d and k-th best
distance t leaves out the inner side if d - mu > t / factor and the outer side
if mu - d > t / factor. At factor 1 the triangle inequality makes this exact;
a larger factor prunes more and may miss some.

A leaf is screened by one matrix product: pairs whose product, with a bound on
its rounding, can't reach the k best so far are left out. The others get their
score: the inner product of the original vectors in double precision, summed
over the components in order, so that equal vectors have equal scores.

Scale. Shards of about ``shard_rows`` rows are dealt by hashed id and vector;
a tree is one row of a table in the shared folder. Queries are packed into
blocks and dealt to groups of about ``group`` queries; each (shard, group) is a
task of its own, which reads its tree once. Only each query's k best of a
shard go on; the merge keeps k for each query, with a partial merge in each
task.

Cases. Vectors null, empty, zero, or with null or non-finite components take no
part. A query is compared with the vectors of its own length, as others have no
inner product with it. Repeated ids stay apart as candidates; a query's own id
is no candidate; of query rows with one id the smallest (length, vector) asks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialize

FOUND = "query_id long, vec_id long, score double"


def scores_of(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows in pairs, in double precision, component after component."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * x[:, j]
    return out


class VPTree:
    """nodes: (point, mu, least outer distance, inner, outer) or (None, first, last): a leaf of rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = 256, seed: int = 1) -> None:
        norm = np.einsum("ij,ij->i", x, x)
        self.top = float(norm.max()) if len(x) else 0.0
        lifted = np.concatenate([x, np.sqrt(np.maximum(self.top - norm, 0))[:, None]], axis=1)
        self.nodes: list[tuple] = []
        order: list[np.ndarray] = []
        rng = np.random.default_rng(seed)
        self.size = 0

        def build(rows: np.ndarray) -> int:
            at = len(self.nodes)
            self.nodes.append(())
            if len(rows) <= leaf:
                self.nodes[at] = (None, self.size, self.size + len(rows))
                order.append(rows)
                self.size += len(rows)
                return at
            point = lifted[rows[rng.integers(len(rows))]]
            d = np.sqrt(((lifted[rows] - point) ** 2).sum(axis=1))
            by = np.argsort(d, kind="stable")
            half = len(rows) // 2
            mu = float(d[by[half - 1]])
            outer_least = float(d[by[half]])
            inner = build(rows[by[:half]])
            outer = build(rows[by[half:]])
            self.nodes[at] = (point, mu, outer_least, inner, outer)
            return at

        if len(x):
            build(np.arange(len(x)))
        keep = np.concatenate(order) if order else np.empty(0, int)
        self.ids, x = ids[keep], x[keep]
        small = x.astype(np.float32)
        self.x = small if np.array_equal(small, x) else x  # lossless

    def search(self, qids: np.ndarray, q: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best of each query; -1 and -inf fill up."""
        n = len(q)
        best = np.full((n, k), -np.inf)
        who = np.full((n, k), -1, np.int64)
        lifted = np.concatenate([q, np.zeros((n, 1))], axis=1)
        length = np.einsum("ij,ij->i", q, q)
        base = length + self.top
        slack = 1e-9 * (1 + base)
        # rounding of a product of d terms, in whatever order they are summed, twice
        rounding = 4 * (q.shape[1] + 2) * np.finfo(float).eps * np.sqrt(length * self.top)

        def reach(a: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(base[a] - 2 * best[a, k - 1] + slack[a], 0)) / factor

        def leaf(a: np.ndarray, first: int, last: int) -> None:
            ids, x = self.ids[first:last], self.x[first:last].astype(float)
            s = q[a] @ x.T
            s[qids[a][:, None] == ids[None, :]] = -np.inf
            least = best[a, k - 1]
            if len(ids) > k:
                least = np.maximum(least, np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k])
            keep = (s >= (least - rounding[a])[:, None]) & (s > -np.inf)
            row, col = np.nonzero(keep)
            if not len(row):
                return
            some, count = np.unique(row, return_counts=True)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            line = np.repeat(np.arange(len(some)), count)
            width = int(count.max())
            b = a[some]
            score = np.full((len(some), k + width), -np.inf)
            name = np.full((len(some), k + width), np.iinfo(np.int64).max)
            score[:, :k] = best[b]
            name[:, :k] = np.where(np.isneginf(best[b]), np.iinfo(np.int64).max, who[b])
            score[line, k + inner] = scores_of(q[a[row]], x[col])
            name[line, k + inner] = ids[col]
            by = np.lexsort((name, -score), axis=1)[:, :k]
            best[b] = np.take_along_axis(score, by, 1)
            who[b] = np.take_along_axis(name, by, 1)

        def visit(at: int, a: np.ndarray) -> None:
            if not len(a):
                return
            node = self.nodes[at]
            if node[0] is None:
                leaf(a, node[1], node[2])
                return
            point, mu, far, inner, outer = node
            d = np.sqrt(np.maximum(length[a] + point @ point - 2 * (lifted[a] @ point), 0))
            near = d <= (mu + far) / 2
            visit(inner, a[near])
            rest = np.ones(len(a), bool)
            rest[near] = ~(far - d[near] > reach(a[near]))
            visit(outer, a[rest])
            back = ~near
            back[back] = ~(d[back] - mu > reach(a[back]))
            visit(inner, a[back])

        if self.nodes:
            visit(0, np.arange(n))
        who[np.isneginf(best)] = -1
        return who, best


def _valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v, dims) of the rows that take part."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return rows.where("size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)").withColumn("dims", F.size("v"))


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def build_index(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = 4096, leaf: int = 256) -> tuple[DataFrame, int]:
    """((dims, shard, tree) written to the shared folder, number of shards).
    Every valid row is indexed."""
    rows = _valid(df, id_col, vec_col)
    shards = max(1, -(-df.count() // shard_rows))

    def run(t: pa.Table) -> pa.Table:
        dims, shard = t.column("dims")[0].as_py(), t.column("shard")[0].as_py()
        order = np.argsort(t.column("vec_id").to_numpy(), kind="stable")
        x = _vectors(t.column("v").combine_chunks(), dims)[order]
        tree = VPTree(t.column("vec_id").to_numpy()[order], x, leaf)
        return pa.table({"dims": pa.array([dims], pa.int32()), "shard": pa.array([shard], pa.int32()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int"))
    return materialize(dealt.groupBy("dims", "shard").applyInArrow(run, "dims int, shard int, tree binary"), "trees"), shards


def search(index: tuple[DataFrame, int], queries: DataFrame, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 512, group: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query."""
    trees, shards = index
    rows = _valid(queries, id_col, vec_col).groupBy("vec_id").agg(F.min(F.struct("dims", "v")).alias("m")).select("vec_id", "m.v", "m.dims")
    groups = max(1, -(-queries.count() // group))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column(2).to_numpy()
            for dims in np.unique(size).tolist():
                some = b.filter(pa.array(size == dims))
                for at in range(0, some.num_rows, block):
                    c = some.slice(at, block)
                    yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([c.column(0).to_numpy().tobytes()], pa.binary()), pa.array([_vectors(c.column(1), dims).tobytes()], pa.binary())], ["dims", "qids", "q"])

    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    blocks = rows.mapInArrow(packed, "dims int, qids binary, q binary").select("dims", F.pmod(F.xxhash64("qids"), F.lit(groups)).cast("int").alias("part"), "qids", "q", every(shards).alias("shard"))
    held = trees.select("dims", every(groups).alias("part"), "shard", "tree")
    key = ["dims", "shard", "part"]

    def run(b: pa.Table, t: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        if b.num_rows and t.num_rows:
            tree = pickle.loads(t.column("tree")[0].as_py())
            for dims, qids, q in zip(b.column("dims").to_pylist(), b.column("qids").to_pylist(), b.column("q").to_pylist(), strict=True):
                ids = np.frombuffer(qids, np.int64)
                who, best = tree.search(ids, np.frombuffer(q).reshape(-1, dims), k, factor)
                keep = ~np.isneginf(best.ravel())
                for col, v in zip(out, (np.repeat(ids, k), who.ravel(), best.ravel()), strict=True):
                    col.append(v[keep])
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, out), strict=True)))

    found = blocks.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(run, FOUND)
    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.repartition(n, "query_id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
