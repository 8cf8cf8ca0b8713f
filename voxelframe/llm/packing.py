"""Conflict-constrained best-fit packing.

Documents are put into bins of ``capacity`` tokens, longest first. Open bins
are kept in order of their free room; each carries a bitmap of the sources and
one of the duplicate clusters that it holds. A piece takes the tightest bin
that has room and shares neither source nor cluster with it: from the first bin
with room, the search goes on to successors until one is compatible; if none
is, a new bin opens. A document longer than the capacity fills bins of its own
and its rest is packed like any piece.

``pack_tokens`` counts the tokens of a tokenizer file, and its clusters are the
components of near copies (five-word shingles, similarity 0.8).

Scale. Rows (no texts) are dealt to shards of about ``shard_rows`` by hashed
id, whatever their source, so that a hot source is spread evenly; a shard is
packed by one task and bins don't cross shards.

Cases. Length null or under 1: bin null, chunk 0. A row without an id is packed
like any other, under a null doc_id; it belongs to no cluster of near copies. Null source or cluster: no
conflict on it. A repeated row is a further piece (of the same source, hence of
another bin). An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize
from .minhash import near_duplicates
from .wordbpe import count_many

PLACED = "doc_id long, chunk int, n_tokens long, bin long, offset long"


def best_fit(pieces: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """(length, source bits, cluster bits) in order -> (bin, offset)."""
    order: list[tuple[int, int]] = []
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for length, source, cluster in pieces:
        at = bisect_left(order, (length, -1))
        while at < len(order):
            b = order[at][1]
            if not (sources[b] & source or clusters[b] & cluster):
                break
            at += 1
        if at < len(order):
            room, b = order.pop(at)
        else:
            room, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        out.append((b, capacity - room))
        sources[b] |= source
        clusters[b] |= cluster
        if room > length:
            insort(order, (room - length, b))
    return out


def _bits(values: pd.Series) -> list[int]:
    seen: dict = {}
    return [0 if v is None or v != v else 1 << seen.setdefault(v, len(seen)) for v in values]


def _pack(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["no_id", "doc_id", "n_tokens", "source", "cluster"], kind="stable", na_position="first").reset_index(drop=True)
        repeated = pdf["cluster"].where(pdf["cluster"].duplicated(keep=False))
        source, cluster = _bits(pdf["source"].astype(object).where(pdf["source"].notna(), None)), _bits(repeated.astype(object).where(repeated.notna(), None))
        shard = int(pdf["shard"].iloc[0]) << 32
        rows, pieces, full = [], [], 0
        for i, null, n in zip(pdf["doc_id"], pdf["no_id"], pdf["n_tokens"].fillna(0).astype(int), strict=True):
            k = len(rows)
            i = None if null else int(i)
            if n < 1:
                rows.append([i, 0, 0, None, 0])
                continue
            whole, rest = divmod(n, capacity)
            for c in range(whole):
                rows.append([i, c, capacity, -1 - full, 0])
                full += 1
            if rest:
                pieces.append((rest, len(rows)))
                rows.append([i, whole, rest, (k, 0), 0])
        index = {}
        at = -1
        last = object()
        for place, r in enumerate(rows):  # row of pdf for each output row
            if r[1] == 0:
                at += 1
            index[place] = at
        pieces.sort(key=lambda p: (-p[0], p[1]))
        placed = best_fit([(n, source[index[k]], cluster[index[k]]) for n, k in pieces], capacity)
        for (_, k), (b, offset) in zip(pieces, placed, strict=True):
            rows[k][3], rows[k][4] = full + b, offset
        for r in rows:
            if r[3] is not None:
                r[3] = shard | (-1 - r[3] if r[3] < 0 else r[3])
        out = pd.DataFrame(rows, columns=["doc_id", "chunk", "n_tokens", "bin", "offset"])
        out["doc_id"] = pd.array([r[0] for r in rows], dtype="Int64")
        out["bin"] = out["bin"].astype("Int64")
        return out

    return run


def pack(docs: DataFrame, length: Column, source: Column, cluster: Column, capacity: int = 2048, shard_rows: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, chunk, n_tokens, bin, offset): where each piece of each document lies."""
    i = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(i, F.lit(0)).alias("doc_id"), i.isNull().alias("no_id"), length.cast("long").alias("n_tokens"), source.cast("string").alias("source"), cluster.cast("long").alias("cluster"))
    shards = max(1, -(-docs.count() // shard_rows))
    dealt = F.when(F.col("no_id"), F.xxhash64("n_tokens", "source", "cluster")).otherwise(F.xxhash64("doc_id"))
    rows = rows.withColumn("shard", F.pmod(dealt, F.lit(shards)))
    return rows.groupBy("shard").applyInPandas(_pack(capacity), PLACED)


def pack_tokens(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """``pack`` by tokens of the tokenizer file ``path`` and clusters of near copies."""
    lengths = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", token_count(F.col("text"), path).alias("n")), "lengths")
    near = near_duplicates(docs, words=5, threshold=0.8).groupBy("doc_id").agg(F.min("component_id").alias("c"))
    rows = lengths.where("doc_id is not null").join(near, "doc_id", "left").union(lengths.where("doc_id is null").withColumn("c", F.lit(None).cast("long")))
    return pack(materialize(rows, "clustered"), F.col("n"), F.col("source"), F.col("c"), capacity)


def _counts(path: str):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for texts in batches:
                yield pd.Series(count_many(path, [t or None for t in texts]))
        finally:
            give_back()

    return run


def token_count(text: Column, path: str) -> Column:
    """Tokens of a text by the tokenizer file ``path``; 0 of a null."""
    return F.pandas_udf(_counts(path), "long")(text)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))
