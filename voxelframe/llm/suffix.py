"""Removal of repeated passages by longest-previous-factor arrays.

A byte goes if a string of ``length`` bytes that covers it also starts earlier:
in a document of smaller id, or before in the same one. The first occurrence
stays. Strings are judged on the input and never cross documents.

Method. Suffixes are sorted to a depth of ``length`` bytes by prefix doubling,
equals in no particular order, and the common prefixes of neighbours in suffix
order are read off the ranks of the doubling. For each position the previous
and the next smaller position in suffix order are found, with the least common
prefix on the way to each: the longer of the two is the longest previous
factor. Where it reaches ``length``, the string that starts there has come
before, and a run of such positions is a span to remove.

Scale. One suffix array over a corpus does not fit one task, so strings are
dealt out by content: every string of ``length`` bytes has a representative
gram, the leftmost smallest hash of its ``gram``-byte substrings, and equal
strings have equal ones. Consecutive strings of one representative make a run.
Runs whose gram occurs nowhere else are done. Runs of equal bytes (128 bits of
fingerprint) are folded to the first of them, in each map task already; the
later ones go as a whole, so that a passage that stands in many documents
comes to a suffix array once. What is left, the different runs of one gram, is
joined with its text and sorted in blocks of grams of bounded size. A gram of
over ``hot`` different runs is dealt anew by a wider gram, at last by the whole
string, so that no group is sorted by one task and the rows stay in proportion
to the text. The grams that hold more than a hundred-thousandth of all rows
are at most 100 000; they are broadcast.

Cases. Null and empty texts have nothing to remove. Rows without an id take no
part. Rows with equal id and text are one document to each other (none removes
the other); of rows with one id and different texts, that of smaller xxHash64
comes first. Within these, one output row for each input row. Columns of any
name are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, documents, free, lean, materialize, mix64

RNG = np.random.default_rng(20240229)
_BYTE = RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x5851F42D4C957F2D)
#: Bytes of text in one suffix array; runs that a map task folds at once.
BLOCK, FOLD = 400_000, 400_000
#: A gram with more than 1/SHARE of all rows is hot in joins: there are at most SHARE of them.
SHARE = 100_000
RUNS = "doc_id long, d long, lo int, hi int, g long, rh long, n int, own boolean"
PIECES = "doc_id long, d long, g long, lo int, bytes binary"
FOUND = "doc_id long, d long, lo int, hi int"


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


class Rolling:
    """Hashes of all substrings of one width: sums over T[byte] * B**(n - i)
    in 64-bit arithmetic, made independent of the place by B**i, then mixed."""

    def __init__(self) -> None:
        self.up, self.down = _powers(_BASE, 1), None

    def __call__(self, x: np.ndarray, width: int) -> np.ndarray:
        n = len(x)
        if n < width:
            return np.empty(0, np.uint64)
        if len(self.up) < n + 1:
            self.up = _powers(_BASE, max(n + 1, 2 * len(self.up), 1 << 16))
            inv = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.down = _powers(inv, len(self.up))
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[x] * self.up[:n], out=total[1:])
        return mix64((total[width:] - total[:-width]) * self.down[: n - width + 1])


def leftmost_minimum(h: np.ndarray, w: int) -> np.ndarray:
    """For each window h[p : p + w], the place of its leftmost smallest value."""
    pos, val, have = np.arange(len(h), dtype=np.int32), h, 1
    while have < w:
        step = min(have, w - have)
        a, b = val[: len(val) - step], val[step:]
        right = b < a
        pos = np.where(right, pos[step:], pos[: len(pos) - step])
        val = np.where(right, b, a)
        have += step
    return pos


def runs_of(x: np.ndarray, roll: Rolling, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(hash of the representative gram, first start, last start, whether the
    gram stands in the run at several places) of the runs of consecutive
    strings with one representative; neighbours whose grams are equal (periodic
    text) are one run, but for grams of the whole length."""
    h = roll(x, gram)
    w = length - gram + 1
    if len(h) < w:
        e = np.empty(0, np.int64)
        return e.view(np.uint64), e, e, e.astype(bool)
    if w == 1:
        at = np.arange(len(h))
        return h, at, at, np.zeros(len(h), bool)
    place = leftmost_minimum(h, w)
    g = h[place]
    cut = np.flatnonzero(g[1:] != g[:-1]) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(g) - 1]])
    return g[lo], lo, hi, place[lo] != place[hi]


def suffix_order(x: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of bytes ``x`` that begin at ``starts`` (each with
    ``length`` bytes to follow) in the order of their first ``length`` bytes,
    and the common prefix of each with the one before it, ``length`` at most.
    Prefix doubling: 8 bytes as big-endian integers, then 16, 32, ... by pairs
    of ranks."""
    width = depth = min(8, length)
    n = len(x)
    padded = np.concatenate([x, np.zeros(8, np.uint8)])
    head = np.zeros(n, np.uint64)
    for j in range(depth):
        head <<= np.uint64(8)
        head |= padded[j : j + n]
    key, ranks = head, []
    while depth < length:
        order = np.argsort(key)
        s = key[order]
        rank = np.empty(n, np.uint32)
        rank[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
        ranks.append((depth, rank))
        step = min(depth, length - depth)
        key = rank.astype(np.uint64) << np.uint64(32)
        key[: n - step] |= rank[step:]
        depth += step
    order = np.argsort(key[starts])
    a, b = starts[order[:-1]], starts[order[1:]]
    common = np.zeros(len(a), np.int64)
    for depth, rank in reversed(ranks):
        common += depth * (rank[np.minimum(a + common, n - 1)] == rank[np.minimum(b + common, n - 1)])
    differ = head[np.minimum(a + common, n - 1)] ^ head[np.minimum(b + common, n - 1)]
    for j in range(1, width + 1):
        common += (differ >> np.uint64(8 * (width - j))) == 0
    return order, np.concatenate([[0], np.minimum(common, length)])[: len(order)]


def _previous_smaller(v: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a permutation the nearest place to its left with a
    smaller value (-1: none), and the least of ``common`` on the way. Pointers
    are advanced for all places at once until none moves."""
    prev, least = np.arange(-1, len(v) - 1), common.copy()
    todo = np.arange(len(v))
    while len(todo):
        p = prev[todo]
        on = (p >= 0) & (v[p] > v[todo])
        todo, p = todo[on], p[on]
        least[todo] = np.minimum(least[todo], least[p])
        prev[todo] = prev[p]
    least[prev < 0] = 0
    return prev, least


def longest_previous_factors(x: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each of ``starts`` (ascending) the length of the longest string
    that begins there and also at an earlier start, ``length`` at most."""
    order, common = suffix_order(x, starts, length)
    _, left = _previous_smaller(order, common)
    _, right = _previous_smaller(order[::-1], np.concatenate([common[1:], [0]])[::-1] if len(common) else common)
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(left, right[::-1])
    return out


def earlier(x: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of the strings of ``length`` bytes at ``starts`` also begin at an earlier one of them."""
    return longest_previous_factors(x, starts, length) >= length


def _folded(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Runs (doc_id, d, lo, hi, g, rh, own): of those with one (g, rh) the first
    with their number; the others as spans (n = 0), joined where they touch."""
    ids, d, lo, hi, g, rh, own = c
    n, keep = np.ones(len(ids), np.int64), np.ones(len(ids), bool)
    key = mix64(g.view(np.uint64).copy()) ^ rh.view(np.uint64)
    by = np.argsort(key)
    s = key[by]
    same = s[1:] == s[:-1]
    more = by[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    spans = np.empty(0, np.int64)
    if len(more):
        more = more[np.lexsort((lo[more], d[more], ids[more], rh[more], g[more]))]
        new = np.concatenate([[True], (g[more[1:]] != g[more[:-1]]) | (rh[more[1:]] != rh[more[:-1]])])
        at = np.flatnonzero(new)
        n[more[at]] = np.diff(np.concatenate([at, [len(more)]]))
        keep[more[~new]] = False
        first = more[at][np.cumsum(new) - 1]
        again = (ids[more] == ids[first]) & (d[more] == d[first]) & (lo[more] == lo[first])  # a repeated row
        spans = more[~new & ~again]
    names = ["doc_id", "d", "lo", "hi", "g", "rh", "n", "own"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
    cols = [ids[keep], d[keep], lo[keep], hi[keep], g[keep], rh[keep], n[keep], own[keep]]
    yield pa.RecordBatch.from_arrays([pa.array(v).cast(t) for v, t in zip(cols, kinds, strict=True)], names)
    if len(spans):
        spans = spans[np.lexsort((lo[spans], d[spans], ids[spans]))]
        i, e, a, b = ids[spans], d[spans], lo[spans], hi[spans]
        new = np.concatenate([[True], (i[1:] != i[:-1]) | (e[1:] != e[:-1]) | (a[1:] > b[:-1] + 1)])
        ends = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(new) - 1]])
        zero = np.zeros(int(new.sum()), np.int64)
        cols = [i[new], e[new], a[new], b[ends], zero, zero, zero, zero.astype(bool)]
        yield pa.RecordBatch.from_arrays([pa.array(v).cast(t) for v, t in zip(cols, kinds, strict=True)], names)


def _runs(raw: bytes, roll: Rolling, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """runs_of with a fingerprint of each run's bytes: (lo, hi, g, rh, own)."""
    g, lo, hi, own = runs_of(np.frombuffer(raw, np.uint8), roll, length, gram)
    digest = xxhash.xxh3_64_intdigest
    rh = np.array([digest(raw[a:b]) for a, b in zip(lo.tolist(), (hi + length).tolist(), strict=True)], np.uint64)
    return lo, hi, g.view(np.int64), rh.view(np.int64), own


def _grams(length: int, gram: int):
    """From (doc_id, d, text) the runs, folded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, parts, size = Rolling(), [], 0
        for b in batches:
            for i, d, t in zip(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2), strict=True):
                raw = t.as_buffer().to_pybytes()
                if len(raw) < length:
                    continue
                r = _runs(raw, roll, length, gram)
                parts.append((np.full(len(r[0]), i), np.full(len(r[0]), d), *r))
                size += len(r[0])
                if size >= FOLD:
                    yield from _folded([np.concatenate(x) for x in zip(*parts, strict=True)])
                    parts, size = [], 0
        if parts:
            yield from _folded([np.concatenate(x) for x in zip(*parts, strict=True)])

    return run


def _pieces(length: int):
    """From (doc_id, d, text, runs) the bytes of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = lists.flatten()
            lo, hi, g = (flat.field(k).to_numpy() for k in range(3))
            ids, ds = b.column(0).to_numpy(), b.column(1).to_numpy()
            rows, out, size = [], [], 0
            for k, t in enumerate(b.column(2)):
                raw = t.as_buffer().to_pybytes()
                for r in range(ends[k], ends[k + 1]):
                    rows.append((k, r))
                    out.append(raw[lo[r] : hi[r] + length])
                    size += len(out[-1])
                    if size > 8_000_000:
                        yield _piece_batch(ids, ds, g, lo, rows, out)
                        rows, out, size = [], [], 0
            if out:
                yield _piece_batch(ids, ds, g, lo, rows, out)

    return run


def _piece_batch(ids: np.ndarray, ds: np.ndarray, g: np.ndarray, lo: np.ndarray, rows: list[tuple[int, int]], out: list[bytes]) -> pa.RecordBatch:
    doc, run = np.array(rows).T
    return pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(ds[doc]), pa.array(g[run]), pa.array(lo[run], pa.int32()), pa.array(out, pa.binary())], ["doc_id", "d", "g", "lo", "bytes"])


def _narrow(length: int, gram: int):
    """From pieces their runs by another gram, with bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Rolling()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                out: list[list] = [[], [], [], [], [], [], [], []]
                for i, d, _, first, raw in zip(*(c.to_pylist() for c in b.slice(at, 512).columns), strict=True):
                    lo, hi, g, rh, own = _runs(raw, roll, length, gram)
                    for x, y, *rest in zip(lo.tolist(), hi.tolist(), g.tolist(), rh.tolist(), own.tolist(), strict=True):
                        for col, v in zip(out, (i, d, first + x, first + y, *rest, raw[x : y + length]), strict=True):
                            col.append(v)
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], ["doc_id", "d", "lo", "hi", "g", "rh", "own", "bytes"])

    return run


def _judged(length: int):
    """Rows of pieces sorted by g: the spans of starts that have come before."""

    def judge(rows: dict[str, np.ndarray], raw: np.ndarray) -> pa.RecordBatch | None:
        order = np.lexsort((rows["lo"], rows["d"], rows["doc_id"]))
        ids, ds, lo, n, begin = (rows[k][order] for k in ("doc_id", "d", "lo", "size", "begin"))
        once = np.concatenate([[True], (ids[1:] != ids[:-1]) | (ds[1:] != ds[:-1]) | (lo[1:] != lo[:-1])])
        ids, ds, lo, n, begin = (v[once] for v in (ids, ds, lo, n, begin))  # a repeated row counts once
        at = np.concatenate([[0], np.cumsum(n)[:-1]])
        x = raw[np.arange(n.sum()) + np.repeat(begin - at, n)]
        own = n - length + 1
        row = np.repeat(np.arange(len(n)), own)
        inner = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(own)[:-1]]), own)
        flagged = np.flatnonzero(earlier(x, at[row] + inner, length))
        if not len(flagged):
            return None
        where = lo[row] + inner
        new = np.concatenate([[True], (np.diff(flagged) != 1) | (np.diff(row[flagged]) != 0)])
        first = flagged[new]
        last = flagged[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(flagged) - 1]])]
        return pa.RecordBatch.from_arrays([pa.array(ids[row[first]]), pa.array(ds[row[first]]), pa.array(where[first], pa.int32()), pa.array(where[last], pa.int32())], ["doc_id", "d", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b] if kept is None else [*kept.to_batches(), b]).combine_chunks()
            *whole, kept = _blocks(t)
            for rows, raw in (_columns(x) for x in whole):
                if (out := judge(rows, raw)) is not None:
                    yield out
        if kept is not None and kept.num_rows and (out := judge(*_columns(kept))) is not None:
            yield out

    return run


def _columns(t: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The columns as arrays, and the bytes of all rows; begin: of each row's."""
    c = t.column("bytes").combine_chunks()
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    kind = np.int64 if pa.types.is_large_binary(c.type) else np.int32
    ends = np.frombuffer(c.buffers()[1], kind)[c.offset : c.offset + len(c) + 1].astype(np.int64)
    raw = np.frombuffer(c.buffers()[2], np.uint8)
    out = {k: t.column(k).to_numpy() for k in ("doc_id", "d", "lo")}
    return out | {"size": np.diff(ends), "begin": ends[:-1]}, raw


def _blocks(t: pa.Table) -> list[pa.Table]:
    """Cut where g changes, into blocks of about BLOCK bytes; the last may go on."""
    g = t.column("g").to_numpy()
    new = np.concatenate([[True], g[1:] != g[:-1]])
    rows, _ = _columns(t)
    before = np.cumsum(rows["size"]) - rows["size"]
    first = np.flatnonzero(new)
    block = before[first] // BLOCK
    cuts = [0, *first[1:][block[1:] != block[:-1]].tolist(), t.num_rows]
    return [t.slice(x, y - x) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("d"), "text")


def _joined(rows: DataFrame, small: DataFrame, share: int) -> DataFrame:
    """rows with those of ``small`` (g, k, ...; k rows of each g) by g. Grams
    with over k = (all rows) / share rows are sent to every task instead."""
    sums = small.agg(F.sum("k").alias("n"), F.max("k").alias("most")).first()
    least = max(512, (sums["n"] or 0) // share)
    if (sums["most"] or 0) <= least:
        return rows.join(small, "g")
    hot = F.broadcast(small.where(F.col("k") > least))
    return rows.join(hot, "g").unionByName(rows.join(hot.select("g"), "g", "left_anti").join(small.where(F.col("k") <= least), "g"))


def _firsts(rows: DataFrame, *more: str) -> DataFrame:
    """Of the runs of one (g, rh) the first; more: columns that go with it."""
    m = F.min(F.struct("doc_id", "d", "lo", "hi", *more)).alias("m")
    return rows.groupBy("g", "rh").agg(m, F.max("own").alias("own")).select("g", "own", "m.*")


def _events(rows: DataFrame, level: int, cancel: bool) -> DataFrame:
    return rows.select("doc_id", "d", "lo", "hi", F.lit(level).alias("level"), F.lit(cancel).alias("cancel"))


def removed_spans(docs: DataFrame, length: int = 100, gram: int = 24, hot: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, d, spans): of each document with any the spans of starts whose
    string has come before, as first << 32 | last. d: hash of the text."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = _texts(docs, id_col, text_col)
    runs = materialize(texts.mapInArrow(lean(_grams(length, gram)), RUNS), "runs")
    again = runs.where("n > 0").groupBy("g").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.min("rh").alias("a"), F.max("rh").alias("b"), F.max("own").alias("own")).where("n > 1 or own")
    again = materialize(again.select("g", "k", (F.expr("a <> b") | F.col("own")).alias("many")), "again")
    free(spark)
    repeated = materialize(_joined(runs.where("n > 0"), again, SHARE).select("doc_id", "d", "lo", "hi", "g", "rh", F.col("many").alias("own")), "repeated")
    whole = materialize(_events(runs.where("n = 0"), 0, False), "whole")
    discard(runs)
    discard(again)
    free(spark)
    first = materialize(_firsts(repeated), "firsts")
    free(spark)
    events = [whole, _events(repeated, 1, False), _events(first, 1, True)]
    many = first.where("own")
    by_doc = many.groupBy("doc_id", "d").agg(F.collect_list(F.struct("lo", "hi", "g")).alias("runs"))
    pieces = texts.join(by_doc, ["doc_id", "d"]).select("doc_id", "d", "text", "runs").mapInArrow(lean(_pieces(length)), PIECES)
    tables = [whole, repeated, first]
    crowded = materialize(many.groupBy("g").agg(F.count("*").alias("k")).where(F.col("k") > hot), "crowded")
    tables.append(crowded)
    if crowded.isEmpty():
        found = materialize(pieces.repartition(n, "g").sortWithinPartitions("g").mapInArrow(lean(_judged(length)), FOUND), "spans")
        events.append(_events(found, 0, False))
        tables.append(found)
    else:
        pieces = materialize(pieces, "pieces")
        tables.append(pieces)
        _deal(pieces, crowded, [(gram + length) // 2, length], length, hot, n, events, tables)
    all_ = events[0]
    for e in events[1:]:
        all_ = all_.union(e)
    lasting = all_.repartition(n, "doc_id", "d").groupBy("doc_id", "d", "level", "lo").agg(F.max("hi").alias("hi"), F.max("cancel").alias("cancel")).where("not cancel")
    packed = F.shiftleft(F.col("lo").cast("long"), 32).bitwiseOR(F.col("hi").cast("long"))
    out = materialize(lasting.groupBy("doc_id", "d").agg(F.collect_list(packed).alias("spans")), "spans")
    for t in tables:
        discard(t)
    free(spark)
    return out


def _deal(pieces: DataFrame, crowded: DataFrame, grams: list[int], length: int, hot: int, n: int, events: list[DataFrame], tables: list[DataFrame]) -> None:
    """Judge pieces; those of crowded grams by the next of ``grams``."""
    for level, gram in enumerate(grams, 2):
        keys = crowded.select("g")
        calm = pieces.join(keys, "g", "left_anti").repartition(n, "g").sortWithinPartitions("g")
        found = materialize(calm.mapInArrow(lean(_judged(length)), FOUND), "spans")
        events.append(_events(found, 0, False))
        rows = materialize(pieces.join(keys, "g", "left_semi").select("doc_id", "d", "g", "lo", "bytes").mapInArrow(lean(_narrow(length, gram)), "doc_id long, d long, lo int, hi int, g long, rh long, own boolean, bytes binary"), "narrow")
        first = materialize(_firsts(rows, "bytes"), "firsts")
        events += [_events(rows, level, False), _events(first, level, True)]
        sized = first.groupBy("g").agg(F.count("*").alias("k"), F.max("own").alias("own")).where("k > 1 or own")
        sized = materialize(sized, "sized")
        pieces = materialize(_joined(first.select("doc_id", "d", "g", "lo", "bytes"), sized.select("g", "k"), SHARE).select("doc_id", "d", "g", "lo", "bytes"), "pieces")
        crowded = materialize(sized.where(F.col("k") > hot).select("g", "k"), "crowded")
        tables += [found, rows, first, sized, pieces, crowded]
        free(pieces.sparkSession)
        if gram < length and crowded.isEmpty():
            break
    if gram < length:
        found = materialize(pieces.repartition(n, "g").sortWithinPartitions("g").mapInArrow(lean(_judged(length)), FOUND), "spans")
        events.append(_events(found, 0, False))
        tables.append(found)


def _ranges(raw: bytes, spans: np.ndarray | None, length: int) -> list[tuple[int, int]]:
    """The byte ranges to remove, disjoint and in order."""
    if spans is None or not len(spans):
        return []
    s = np.sort(spans)
    lo, end = s >> 32, np.maximum.accumulate((s & 0xFFFFFFFF) + length)
    new = np.concatenate([[True], lo[1:] > end[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])
    return list(zip(lo[new].tolist(), end[last].tolist(), strict=True))


def _without(raw: bytes, ranges: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for lo, hi in ranges:
        kept.append(raw[at:lo])
        at = max(at, hi)
    kept.append(raw[at:])
    return b"".join(kept)


def _whole_characters(raw: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Shrunk so that no UTF-8 character is cut."""
    out = []
    for lo, hi in ranges:
        while lo < hi and raw[lo] & 0xC0 == 0x80:
            lo += 1
        while hi > lo and hi < len(raw) and raw[hi] & 0xC0 == 0x80:
            hi -= 1
        if lo < hi:
            out.append((lo, hi))
    return out


def _lists(column: pa.Array) -> Iterator[np.ndarray | None]:
    for v in column:
        yield v.values.to_numpy() if v.is_valid else None


def _strip(length: int):
    """From (doc_id, text, spans): what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for t, spans in zip(b.column(1), _lists(b.column(2)), strict=True):
                raw = t.as_buffer().to_pybytes()
                ranges = _ranges(raw, spans, length)
                for col, v in zip(out, (len(raw), sum(hi - lo for lo, hi in ranges), len(ranges), _without(raw, ranges)), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _cut(length: int, names: list[str], text: int, chars: int | None):
    """From (columns, spans): the columns with the text cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.columns[: len(names)])
            texts = []
            for t, spans in zip(cols[text], _lists(b.column(len(names))), strict=True):
                t = t.as_py()
                if t is not None and spans is not None:
                    raw = t.encode("utf-8", "surrogatepass")
                    t = _without(raw, _whole_characters(raw, _ranges(raw, spans, length))).decode("utf-8", "surrogatepass")
                texts.append(t)
            cols[text] = pa.array(texts, pa.string())
            if chars is not None:
                cols[chars] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(b.column(chars).type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def drop_repeats(docs: DataFrame, length: int = 100, gram: int = 24, hot: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept: binary), one row for each row of ``docs``."""
    spans = removed_spans(docs, length, gram, hot, id_col, text_col)
    all_ = _texts(docs, id_col, text_col).join(spans, ["doc_id", "d"], "left")
    return all_.select("doc_id", "text", "spans").mapInArrow(lean(_strip(length)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def cut_repeats(docs: DataFrame, length: int = 100, gram: int = 24, hot: int = 4096, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with the repeats cut out of ``text_col`` (whole characters only)
    and ``chars_col``, if there, counted anew. Rows without an id stay as they
    are. Inside, columns go by their place, so that no name clashes."""
    spans = removed_spans(docs, length, gram, hot, id_col, text_col)
    text = docs.columns.index(text_col)
    chars = docs.columns.index(chars_col) if chars_col in docs.columns else None
    names = [f"c{k}" for k in range(len(docs.columns))]
    keyed = docs.toDF(*names).withColumn("d", F.xxhash64(F.coalesce(F.col(names[text]).cast("string"), F.lit(""))))
    keyed = keyed.withColumn("doc_id", F.col(names[docs.columns.index(id_col)]).cast("long"))
    all_ = keyed.join(spans, ["doc_id", "d"], "left").select(*names, "spans")
    return all_.mapInArrow(lean(_cut(length, docs.columns, text, chars)), docs.schema)
