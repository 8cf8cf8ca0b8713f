"""A cube: traces (i, x, samples) by their place on a regular grid, with what
the headers say about lines, coordinates and time."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import segy

SEGY = ("sgy", "segy", "seg", "qsgy")


@dataclass(frozen=True)
class Meta:
    """Lines: value = shift + step * ordinal. Time: ms = delay + interval * sample."""

    i_shift: int = 0
    i_step: int = 1
    i_length: int = 0
    x_shift: int = 0
    x_step: int = 1
    x_length: int = 0
    depth: int = 0
    delay: float = 0.0
    interval: float = 1.0
    regular: bool = True


def index_attributes(headers: DataFrame, columns: tuple[str, ...] = ("inline", "crossline")) -> DataFrame:
    """(header, shift, last, uniques, step, regular): of each index header the
    least and largest value, how many there are, the least difference of
    neighbouring ones, and whether all differences are that."""
    out = None
    for c in columns:
        u = headers.select(F.col(c).cast("long").alias("v")).distinct()
        e = u.agg(F.min("v").alias("shift"), F.max("v").alias("last"), F.count("*").alias("uniques"), F.sort_array(F.collect_list("v")).alias("a"))
        gaps = F.transform(F.sequence(F.lit(1), F.size("a") - 1), lambda k: F.get("a", k) - F.get("a", k - 1))
        gaps = F.when(F.size("a") > 1, gaps).otherwise(F.array(F.lit(1).cast("long")))
        e = e.withColumn("g", gaps).select(F.lit(c).alias("header"), "shift", "last", "uniques", F.array_min("g").alias("step"), (F.array_min("g") == F.array_max("g")).alias("regular"))
        out = e if out is None else out.union(e)
    return out


def ordinal(value, shift: int, step: int) -> Column:
    """Line value to ordinal."""
    return F.floor((F.col(value) if isinstance(value, str) else value) - shift) if step == 1 else F.floor(((F.col(value) if isinstance(value, str) else value) - shift) / step)


def line(place, shift: int, step: int) -> Column:
    """Ordinal to line value."""
    return (F.col(place) if isinstance(place, str) else place) * step + shift


def time_to_sample(ms, delay: float, interval: float) -> Column:
    return (F.col(ms) - delay) / interval


def sample_to_time(d, delay: float, interval: float) -> Column:
    return F.col(d) * interval + delay


def affine_fit(traces: DataFrame, from_: tuple[str, str] = ("inline", "crossline"), to: tuple[str, str] = ("cdp_x", "cdp_y")) -> DataFrame:
    """One row a0, a1, a2, b0, b1, b2: to[0] = a0 u + a1 v + a2, to[1] = b0 u +
    b1 v + b2, of least squares over all traces, from one row of moments. Null
    where the lines don't span a plane."""
    u, v = from_
    m = traces.agg(F.var_pop(u).alias("uu"), F.var_pop(v).alias("vv"), F.covar_pop(u, v).alias("uv"), F.avg(u).alias("u"), F.avg(v).alias("v"), *(F.covar_pop(s, t).alias(f"{n}{k}") for k, t in enumerate(to) for n, s in (("u", u), ("v", v))), *(F.avg(t).alias(f"t{k}") for k, t in enumerate(to)))
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    out = []
    for k, name in enumerate("ab"):
        first = F.when(det > 1e-9, (F.col(f"u{k}") * F.col("vv") - F.col(f"v{k}") * F.col("uv")) / det)
        second = F.when(det > 1e-9, (F.col(f"v{k}") * F.col("uu") - F.col(f"u{k}") * F.col("uv")) / det)
        out += [first.alias(f"{name}0"), second.alias(f"{name}1"), (F.col(f"t{k}") - first * F.col("u") - second * F.col("v")).alias(f"{name}2")]
    return m.select(*out)


def lines_to_cdp(points: DataFrame, fit: DataFrame, u: str = "inline", v: str = "crossline") -> DataFrame:
    """``points`` with cdp_x and cdp_y. ``fit`` is one row of ``affine_fit``."""
    p = points.join(F.broadcast(fit))
    at = lambda k: F.col(f"{k}0") * F.col(u) + F.col(f"{k}1") * F.col(v) + F.col(f"{k}2")
    return p.select(*points.columns, at("a").alias("cdp_x"), at("b").alias("cdp_y"))


def cdp_to_lines(points: DataFrame, fit: DataFrame) -> DataFrame:
    """``points`` with inline and crossline: the inverse, rounded."""
    p = points.join(F.broadcast(fit))
    det = F.col("a0") * F.col("b1") - F.col("a1") * F.col("b0")
    dx, dy = F.col("cdp_x") - F.col("a2"), F.col("cdp_y") - F.col("b2")
    return p.select(*points.columns, F.rint((F.col("b1") * dx - F.col("a1") * dy) / det).cast("long").alias("inline"), F.rint((F.col("a0") * dy - F.col("b0") * dx) / det).cast("long").alias("crossline"))


def area(traces: DataFrame, shift: int = 50) -> DataFrame:
    """One row: km2 of the alive traces, each with the bin that ``shift`` lines
    along both axes span from the least place."""
    low = traces.agg(F.min("i").alias("i0"), F.min("x").alias("x0"))
    at = traces.join(F.broadcast(low))
    pick = lambda di, dx, c: F.max(F.when((F.col("i") == F.col("i0") + di) & (F.col("x") == F.col("x0") + dx), F.col(c)))
    p = at.agg(*(pick(di, dx, c).alias(f"{c}{k}") for k, (di, dx) in enumerate(((0, 0), (shift, 0), (0, shift))) for c in ("cdp_x", "cdp_y")), F.count(F.when(alive(F.col("samples")), 1)).alias("n"))
    side = lambda k: F.sqrt(F.pow(F.col(f"cdp_x{k}") - F.col("cdp_x0"), 2) + F.pow(F.col(f"cdp_y{k}") - F.col("cdp_y0"), 2)) / shift
    return p.select(F.round(side(1) * side(2) * F.col("n") / 1e6, 2).alias("km2"), F.col("n").alias("alive"))


def alive(samples) -> Column:
    """Not constant."""
    return F.array_min(samples) < F.array_max(samples)


def dead_traces(traces: DataFrame, frequency: int = 1) -> DataFrame:
    """(i, x) of constant traces, by every ``frequency``-th sample."""
    some = F.filter("samples", lambda v, k: k % frequency == 0) if frequency > 1 else F.col("samples")
    return traces.where(~alive(some)).select("i", "x")


@dataclass(frozen=True)
class Cube:
    """traces: (i, x, samples[, headers])."""

    traces: DataFrame
    meta: Meta

    @staticmethod
    def new(spark: SparkSession, path: str, **options) -> Cube:
        """By the path's ending: SEG-Y, or a folder that ``convert`` wrote (.cube)."""
        end = path.rstrip("/").rsplit(".", 1)[-1].lower()
        if end in SEGY or segy.file_system(path)[0].get_file_info(segy.file_system(path)[1]).is_file:
            if end not in SEGY:
                raise TypeError(f"{path}: not a cube")
            return Cube.from_segy(spark, path, **options)
        if end == "cube":
            return Cube.open(spark, path)
        return Cube.from_segy(spark, path, **options)

    @staticmethod
    def from_segy(spark: SparkSession, path: str, headers: tuple[str, ...] = segy.HEADERS) -> Cube:
        heads = segy.read_segy(spark, path, ("inline", "crossline", "delay"), samples=False)
        i, x = index_attributes(heads).collect()
        head, _ = segy.file_head(segy.files_of(path)[0][0])
        delay = heads.agg(F.min("delay")).first()[0] or 0
        meta = Meta(i["shift"] or 0, i["step"], ((i["last"] or 0) - (i["shift"] or 0)) // i["step"] + 1, x["shift"] or 0, x["step"], ((x["last"] or 0) - (x["shift"] or 0)) // x["step"] + 1, head.n, float(delay), head.interval / 1000, bool(i["regular"] and x["regular"]))
        t = segy.read_segy(spark, path, headers)
        return Cube(t.select(ordinal("inline", meta.i_shift, meta.i_step).alias("i"), ordinal("crossline", meta.x_shift, meta.x_step).alias("x"), *(c for c in t.columns)), meta)

    @staticmethod
    def of(traces: DataFrame, **meta) -> Cube:
        """Of rows (i, x, samples); lengths from the data."""
        n = traces.agg(F.max("i") + 1, F.max("x") + 1, F.max(F.size("samples"))).first()
        return Cube(traces, Meta(i_length=n[0] or 0, x_length=n[1] or 0, depth=n[2] or 0, **meta))

    @staticmethod
    def open(spark: SparkSession, path: str, projection: str = "i") -> Cube:
        """Of ``convert``: the copy sorted for sections along ``projection``."""
        meta = Meta(**json.loads(spark.read.text(f"{path}/meta").first()[0]))
        return Cube(spark.read.parquet(f"{path}/{projection}"), meta)

    def convert(self, path: str, projections: str = "ix", code: dict[str, float] | None = None) -> None:
        """Write Parquet copies sorted for sections along i, x or d, quantised to
        bytes if ``code`` is given (parameters of ``quantization``), and the metadata."""
        t = self.traces.select("i", "x", "samples")
        if code:
            q = lambda v: F.rint(F.least(F.greatest(v - code["center"], F.lit(-code["range"])), F.lit(code["range"])) / code["range"] * 127).cast("byte")
            t = t.withColumn("samples", F.transform("samples", q))
        for p in projections:
            if p == "d":
                v = t.select("i", "x", F.posexplode("samples").alias("d", "amp"))
                v.repartitionByRange("d").sortWithinPartitions("d", "i", "x").write.mode("overwrite").parquet(f"{path}/d")
            else:
                other = "x" if p == "i" else "i"
                t.repartitionByRange(p, other).sortWithinPartitions(p, other).write.mode("overwrite").parquet(f"{path}/{p}")
        self.dump_meta(f"{path}/meta")

    def dump_meta(self, path: str) -> None:
        spark = self.traces.sparkSession
        spark.createDataFrame([(json.dumps(asdict(self.meta)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    def optimal_axis(self, box: tuple[tuple[int, int], ...]) -> int:
        """The axis of the box's shortest side: its sections are the fewest."""
        return int(np.argmin([b - a for a, b in box]))

    def export_segy(self, path: str, code: int = 5, origin: tuple[int, int, int] = (0, 0, 0), **cdp) -> None:
        """Write as SEG-Y: lines by the metadata, the origin added to them and
        (times the interval) to the delay; CDPs of 25 m bins if there are none."""
        m, t = self.meta, self.traces
        i, x = F.col("i") + origin[0], F.col("x") + origin[1]
        have = {"cdp_x", "cdp_y"} <= set(t.columns)
        out = t.select(line(i, m.i_shift, m.i_step).alias("inline"), line(x, m.x_shift, m.x_step).alias("crossline"), (F.col("cdp_x") if have else i * 25 + 100_000).alias("cdp_x"), (F.col("cdp_y") if have else x * 25 + 300_000).alias("cdp_y"), F.lit(int(m.delay + m.interval * origin[2])).alias("delay"), "samples")
        segy.write_segy(out, path, interval=int(m.interval * 1000), code=code, **cdp)

    def repack(self, path: str, code: dict[str, float]) -> None:
        """Write as SEG-Y of bytes (format 8), quantised."""
        q = lambda v: F.rint(F.least(F.greatest(v - code["center"], F.lit(-code["range"])), F.lit(code["range"])) / code["range"] * 127)
        replace(self, traces=self.traces.withColumn("samples", F.transform("samples", q))).export_segy(path, code=8)

    def resample(self, factor: float) -> Cube:
        """Depth times ``factor``, linearly interpolated between samples (ends held)."""
        n = int(self.meta.depth * factor)
        at = lambda k: F.least(F.greatest((k + 0.5) / factor - 0.5, F.lit(0.0)), F.size("samples") - 1.0)

        def value(k: Column) -> Column:
            lo = F.floor(at(k)).cast("int")
            a, b = F.get("samples", lo), F.get("samples", F.least(lo + 1, F.size("samples") - 1))
            return a + (b - a) * (at(k) - lo)

        t = self.traces.withColumn("samples", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), value))
        return Cube(t, replace(self.meta, depth=n, interval=self.meta.interval / factor))

    def grid(self) -> DataFrame:
        """(i, x) of all crossings of lines, with or without a trace."""
        n = self.meta.i_length * self.meta.x_length
        return self.traces.sparkSession.range(n).select(F.expr(f"id div {max(self.meta.x_length, 1)}").alias("i"), (F.col("id") % max(self.meta.x_length, 1)).alias("x"))

    # --- access ---------------------------------------------------------------
    def _ends(self, s, n: int) -> tuple[int, int]:
        a, b, step = (s if isinstance(s, slice) else slice(s, s + 1 if s != -1 else None)).indices(n)
        if step != 1:
            raise ValueError("cubes are cut without a step")
        return a, max(a, b)

    def __getitem__(self, key) -> DataFrame:
        """NumPy-like: cube[i, x, d] of whole numbers and slices, clipped to the cube; (i, x, samples)."""
        key = key if isinstance(key, tuple) else (key,)
        key = key + (slice(None),) * (3 - len(key))
        ends = [self._ends(s, n) for s, n in zip(key, (self.meta.i_length, self.meta.x_length, self.meta.depth), strict=True)]
        return self.load_crop(ends)

    def load_crop(self, box) -> DataFrame:
        """(i, x, samples) of a half-open box ((i0, i1), (x0, x1), (d0, d1))."""
        (i0, i1), (x0, x1), (d0, d1) = box
        t = self.traces.where((F.col("i") >= i0) & (F.col("i") < i1) & (F.col("x") >= x0) & (F.col("x") < x1))
        return t.select("i", "x", F.slice("samples", F.lit(d0 + 1), F.lit(max(0, d1 - d0))).alias("samples"))

    def load_slide(self, index: int | str, axis: int = 0, limits: tuple[int, int] | None = None) -> DataFrame:
        """A section: (i, x, samples) along axis 0 or 1, (i, x, amp) along 2. A text '#244' is a line value."""
        k = self.slide_index(index, axis)
        if axis == 2:
            if limits:
                raise ValueError("a depth slice has no depth limits")
            return self.traces.select("i", "x", F.get("samples", F.lit(k)).alias("amp"))
        t = self.traces.where(F.col("ix"[axis]) == k)
        lo, hi = limits or (0, self.meta.depth)
        return t.select("i", "x", F.slice("samples", F.lit(lo + 1), F.lit(hi - lo)).alias("samples"))

    def slide_index(self, index: int | str, axis: int = 0) -> int:
        if isinstance(index, str):
            if not index.startswith("#"):
                raise ValueError("a line value begins with #")
            shift, step = ((self.meta.i_shift, self.meta.i_step), (self.meta.x_shift, self.meta.x_step), (0, 1))[axis]
            index = (int(index[1:]) - shift) // step
        n = (self.meta.i_length, self.meta.x_length, self.meta.depth)[axis]
        if not -n <= index < n:
            raise IndexError(f"no section {index} along axis {axis}")
        return index % n

    def load_depth_slices(self, depths: list[int], fill: float = 0.0) -> DataFrame:
        """(i, x, d, amp) on the whole grid of lines, ``fill`` where there is no trace."""
        grid = self.grid()
        want = F.array(*(F.struct(F.lit(d).cast("long").alias("d"), F.get("samples", F.lit(d)).cast("double").alias("amp")) for d in depths))
        rows = grid.join(self.traces.select("i", "x", "samples"), ["i", "x"], "left").select("i", "x", F.inline(want))
        return rows.select("i", "x", "d", F.coalesce("amp", F.lit(fill)).alias("amp"))

    def load_by_places(self, places: DataFrame, limits: tuple[int, int] | None = None, fill: float = 0.0) -> DataFrame:
        """(i, x, samples) for each row (i, x) of ``places``; ``fill`` where there is no trace."""
        lo, hi = limits or (0, self.meta.depth)
        cut = F.slice("samples", F.lit(lo + 1), F.lit(hi - lo))
        return places.join(self.traces.select("i", "x", "samples"), ["i", "x"], "left").select("i", "x", F.coalesce(cut, F.array_repeat(F.lit(fill), hi - lo)).alias("samples"))

    def load_traces(self, ids: DataFrame, limits: tuple[int, int] | None = None) -> DataFrame:
        """Traces of the numbers trace_id in ``ids`` (of a file), cut in depth."""
        lo, hi = limits or (0, self.meta.depth)
        t = self.traces.join(ids.select("file", "trace_id").distinct(), ["file", "trace_id"], "left_semi")
        return t.select("file", "trace_id", "i", "x", F.slice("samples", F.lit(lo + 1), F.lit(hi - lo)).alias("samples"))

    def load_subset(self, n: int = 100_000, seed: int = 42) -> DataFrame:
        """``n`` alive traces of smallest hash: the same in every run, whatever the partitioning."""
        return self.traces.where(alive(F.col("samples"))).orderBy(F.md5(F.concat_ws(",", F.lit(seed), "i", "x")), "i", "x").limit(n)

    def header_matrix(self, header: str) -> DataFrame:
        """(i, x, value) on the whole grid of lines, -1 where there is no trace."""
        grid = self.grid()
        return grid.join(self.traces.select("i", "x", F.col(header).cast("long").alias("value")), ["i", "x"], "left").select("i", "x", F.coalesce("value", F.lit(-1).cast("long")).alias("value"))

    def chunks(self, size: int) -> DataFrame:
        """Traces with the chunk of ``size`` trace numbers that each is in."""
        return self.traces.withColumn("chunk", F.floor((F.col("trace_id") - 1) / size))

    def section(self, nodes: list[tuple[float, float]]) -> DataFrame:
        """(k, i, x, d, amp): points about a trace apart along a polyline, each
        from the traces around it by inverse distance; at a trace, that trace."""
        points = line_points(nodes)
        p = self.traces.sparkSession.createDataFrame([(k, float(i), float(x)) for k, (i, x) in enumerate(points)], "k long, pi double, px double")
        corners = [F.struct(a("pi").cast("long").alias("i"), b("px").cast("long").alias("x")) for a in (F.floor, F.ceil) for b in (F.floor, F.ceil)]
        c = p.select("k", "pi", "px", F.explode(F.array_distinct(F.array(*corners))).alias("c")).select("k", "pi", "px", "c.i", "c.x")
        far = F.sqrt(F.pow(F.col("i") - F.col("pi"), 2) + F.pow(F.col("x") - F.col("px"), 2))
        j = c.withColumn("w", 1 / F.greatest(far, F.lit(1e-9))).join(self.traces.select("i", "x", "samples"), ["i", "x"])
        v = j.select("k", "pi", "px", "w", F.posexplode("samples").alias("d", "amp"))
        return v.groupBy("k", "pi", "px", "d").agg((F.sum(F.col("w") * F.col("amp")) / F.sum("w")).alias("amp")).select("k", F.col("pi").alias("i"), F.col("px").alias("x"), F.col("d").cast("long").alias("d"), "amp")

    def slide_bounds(self, axis: int = 0) -> DataFrame:
        """(line, first, last): the first and last alive trace of each section along ``axis``."""
        a, b = "ix"[axis], "xi"[axis]
        return self.traces.where(alive(F.col("samples"))).groupBy(F.col(a).alias("line")).agg(F.min(b).alias("first"), F.max(b).alias("last"))

    def equal(self, other: Cube, digits: int = 6) -> DataFrame:
        """One row: traces of each that the other lacks or has other samples of."""
        key = lambda t: t.select("i", "x", F.transform("samples", lambda v: F.round(v.cast("double"), digits)).alias("s"))
        j = key(self.traces).join(key(other.traces).withColumnRenamed("s", "o"), ["i", "x"], "full")
        return j.agg(F.count(F.when(F.col("o").isNull(), 1)).alias("only_here"), F.count(F.when(F.col("s").isNull(), 1)).alias("only_there"), F.count(F.when(F.col("s") != F.col("o"), 1)).alias("differ"))


def line_points(nodes: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Points along the legs, evenly and about 1 apart, each node once."""
    out = []
    for (a, b), (c, d) in zip(nodes[:-1], nodes[1:], strict=True):
        n = max(1, int(np.ceil(np.hypot(c - a, d - b))))
        out += [(a + (c - a) * k / n, b + (d - b) * k / n) for k in range(n)]
    return [*out, nodes[-1]]


def histogram(voxels: DataFrame, bins: int = 50) -> DataFrame:
    """(bin, lo, n) over the whole range; the largest value is in the last bin."""
    e = voxels.agg(F.min("amp").alias("a"), F.max("amp").alias("b"))
    k = F.least(F.floor((F.col("amp") - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1)).cast("long")
    return voxels.join(F.broadcast(e)).groupBy(k.alias("bin"), "a", "b").agg(F.count("*").alias("n")).select("bin", F.round(F.col("a") + (F.col("b") - F.col("a")) * F.col("bin") / bins, 6).alias("lo"), "n")


def mean_spectrum(traces: DataFrame) -> DataFrame:
    """(k, amplitude): mean amplitude spectrum."""
    from ..functions.signal import amplitude_spectrum

    return traces.select(F.posexplode(amplitude_spectrum("samples")).alias("k", "a")).groupBy(F.col("k").cast("long").alias("k")).agg(F.avg("a").alias("amplitude"))


def estimate_impulse(traces: DataFrame, length: int = 40) -> DataFrame:
    """(t, value): symmetric wavelet of the mean amplitude spectrum (zero phase), of unit peak."""
    spectrum = np.array([r["amplitude"] for r in mean_spectrum(traces).orderBy("k").collect()])
    if not len(spectrum):
        return traces.sparkSession.createDataFrame([], "t long, value double")
    w = np.fft.fftshift(np.fft.irfft(spectrum))
    mid = len(w) // 2
    half = min(length // 2, mid - 1)
    w = w[mid - half : mid + half + 1] / w[mid]
    return traces.sparkSession.createDataFrame([(k - half, float(v)) for k, v in enumerate(w)], "t long, value double")
