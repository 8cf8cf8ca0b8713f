"""Crops as rows (loc_id, ci, cx, cd, amp): augmentations, masks, samplers and
location generators. Random numbers are hashes of a seed and the row's keys, so
that a lost task that is run again gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACE = ["ci", "cx", "cd"]


def uniform(seed: int, *keys: str) -> Column:
    """In [0, 1), by the first 32 bits of an MD5 of seed and keys."""
    h = F.md5(F.concat_ws(",", F.lit(seed), *keys))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / 4294967296.0


def normal(seed: int, *keys: str) -> Column:
    """Standard normal, by two uniforms."""
    u, v = 1 - uniform(seed, *keys), uniform(seed + 1, *keys)
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * 3.141592653589793 * v)


# --- element-wise ---------------------------------------------------------------
def invert(c: DataFrame) -> DataFrame:
    return c.withColumn("amp", -F.col("amp"))


def sign(c: DataFrame) -> DataFrame:
    return c.withColumn("amp", F.signum("amp"))


def binarize(c: DataFrame, threshold: float = 0.5) -> DataFrame:
    return c.withColumn("amp", (F.col("amp") > threshold).cast("double"))


def smooth_labels(c: DataFrame, eps: float = 0.05) -> DataFrame:
    """1 becomes 1 - eps, all else eps."""
    return c.withColumn("amp", F.when(F.col("amp") == 1, 1 - eps).otherwise(eps))


def translate(c: DataFrame, shift: float = 5, scale: float = 0.0, seed: int = 0) -> DataFrame:
    """(x + a) * b for each crop: a within +-shift, b within 1 +- scale."""
    a = (uniform(seed, "loc_id") * 2 - 1) * shift
    b = 1 + (uniform(seed + 1, "loc_id") * 2 - 1) * scale
    return c.withColumn("amp", (F.col("amp") + a) * b)


def additive_noise(c: DataFrame, scale: float, seed: int = 0) -> DataFrame:
    return c.withColumn("amp", F.col("amp") + scale * normal(seed, "loc_id", *PLACE))


def multiplicative_noise(c: DataFrame, scale: float, seed: int = 0) -> DataFrame:
    return c.withColumn("amp", F.col("amp") * (1 + scale * normal(seed, "loc_id", *PLACE)))


# --- layout -----------------------------------------------------------------------
def flip(c: DataFrame, axis: int, length: int) -> DataFrame:
    return c.withColumn(PLACE[axis], length - 1 - F.col(PLACE[axis]))


def transpose(c: DataFrame, order: tuple[int, int, int]) -> DataFrame:
    """Axis k of the result is axis order[k]."""
    return c.select(*(x for x in c.columns if x not in PLACE), *(F.col(PLACE[o]).alias(PLACE[k]) for k, o in enumerate(order)))


def center_crop(c: DataFrame, shape: tuple[int, int, int], to: tuple[int, int, int]) -> DataFrame:
    """The middle window of shape ``to``, counted from its own corner."""
    out = c
    for p, n, m in zip(PLACE, shape, to, strict=True):
        lo = (n - m) // 2
        out = out.where((F.col(p) >= lo) & (F.col(p) < lo + m)).withColumn(p, F.col(p) - lo)
    return out


def fill_bounds(c: DataFrame, shape: tuple[int, int, int], margin: float = 0.05, fill: float = 0) -> DataFrame:
    """Cells within ``margin`` (a share of each axis, at least none) of a side become ``fill``."""
    inside = F.lit(True)
    for p, n in zip(PLACE, shape, strict=True):
        k = int(margin * n)
        inside = inside & (F.col(p) >= k) & (F.col(p) < n - k)
    return c.withColumn("amp", F.when(inside, F.col("amp")).otherwise(F.lit(fill).cast("double")))


def filter_side(c: DataFrame, length: int, ratio: float, side: str = "right", axis: int = 0) -> DataFrame:
    """The share ``ratio`` of one side along ``axis`` becomes 0."""
    k = int(length * ratio)
    p = F.col(PLACE[axis])
    return c.withColumn("amp", F.when(p >= length - k if side == "right" else p < k, 0.0).otherwise(F.col("amp")))


def cutout(c: DataFrame, shape: tuple[int, int, int], patch: tuple[int, int], n: int = 1, fill: float = 0, seed: int = 0) -> DataFrame:
    """``n`` patches of crossline and depth, placed at random in each crop, become ``fill``."""
    hit = F.lit(False)
    for k in range(n):
        x0 = F.floor(uniform(seed + 2 * k, "loc_id") * (shape[1] - patch[0] + 1))
        d0 = F.floor(uniform(seed + 2 * k + 1, "loc_id") * (shape[2] - patch[1] + 1))
        hit = hit | ((F.col("cx") >= x0) & (F.col("cx") < x0 + patch[0]) & (F.col("cd") >= d0) & (F.col("cd") < d0 + patch[1]))
    return c.withColumn("amp", F.when(hit, F.lit(fill).cast("double")).otherwise(F.col("amp")))


def concat(parts: list[DataFrame], lengths: list[int], axis: int = 2) -> DataFrame:
    """Components side by side along ``axis``."""
    out, at = None, 0
    for p, n in zip(parts, lengths, strict=True):
        p = p.withColumn(PLACE[axis], F.col(PLACE[axis]) + at)
        out, at = p if out is None else out.unionByName(p), at + n
    return out


def to_integer(amp, kind: str = "int8") -> Column:
    """Probabilities to whole numbers over the type's range, cut off."""
    low, span = {"int8": (-128, 255), "uint8": (0, 255), "int16": (-32768, 65535), "uint16": (0, 65535)}[kind]
    return (F.col(amp) * span + low).cast("long")


def from_integer(code, kind: str = "int8") -> Column:
    low, span = {"int8": (-128, 255), "uint8": (0, 255), "int16": (-32768, 65535), "uint16": (0, 65535)}[kind]
    return (F.col(code) - low) / span


# --- conditions -------------------------------------------------------------------
def label_area(c: DataFrame) -> DataFrame:
    """(loc_id, area): share of the crop's traces with a label (amp > 0)."""
    t = c.groupBy("loc_id", "ci", "cx").agg(F.max((F.col("amp") > 0).cast("int")).alias("on"))
    return t.groupBy("loc_id").agg(F.round(F.avg("on"), 6).alias("area"))


def discontinuity(c: DataFrame) -> DataFrame:
    """(loc_id, size): the largest gap in depth between labels of neighbouring traces along x."""
    t = c.where("amp > 0").groupBy("loc_id", "ci", "cx").agg(F.min("cd").alias("lo"), F.max("cd").alias("hi"))
    w = Window.partitionBy("loc_id", "ci").orderBy("cx")
    gap = F.when(F.col("cx") - F.lag("cx").over(w) == 1, F.greatest("lo", F.lag("lo").over(w)) - F.least("hi", F.lag("hi").over(w)))
    return t.withColumn("_g", gap).groupBy("loc_id").agg(F.coalesce(F.max("_g"), F.lit(0)).cast("long").alias("size"))


def rebatch(c: DataFrame, condition: DataFrame, column: str, threshold: float) -> DataFrame:
    """Crops whose condition (loc_id, column) is over the threshold."""
    return c.join(condition.where(F.col(column) > threshold).select("loc_id"), "loc_id", "left_semi")


def alive_crops(locations: DataFrame, alive: DataFrame, crop: tuple[int, int], threshold: int) -> DataFrame:
    """(loc_id, n): locations (loc_id, i0, x0) whose crop holds over ``threshold``
    alive traces; an equi-join by tiles of the crop's size."""
    near = lambda c, n: F.sequence(F.floor(F.col(c) / n), F.floor((F.col(c) + n - 1) / n))
    a, b = crop
    loc = locations.select("loc_id", "i0", "x0", F.explode(near("i0", a)).alias("ti")).select("*", F.explode(near("x0", b)).alias("tx"))
    t = alive.select("i", "x", F.floor(F.col("i") / a).alias("ti"), F.floor(F.col("x") / b).alias("tx"))
    j = loc.join(t, ["ti", "tx"]).where((F.col("i") >= F.col("i0")) & (F.col("i") < F.col("i0") + a) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x0") + b))
    return j.groupBy("loc_id").agg(F.count("*").alias("n")).where(F.col("n") > threshold)


# --- masks -------------------------------------------------------------------------
def label_mask(labels: DataFrame, width: int = 3) -> DataFrame:
    """(i, x, d, value) of labels (ordinal, i, x, d) drawn with a thickness; a
    later ordinal lies over an earlier one; the value is ordinal + 1."""
    e = labels.select("ordinal", "i", "x", F.explode(F.sequence(F.col("d") - width // 2, F.col("d") - width // 2 + width - 1)).alias("d"))
    return e.groupBy("i", "x", "d").agg((F.max("ordinal") + 1).alias("value"))


def regression_masks(locations: DataFrame, surface: DataFrame, crop: tuple[int, int, int]) -> DataFrame:
    """(loc_id, ci, cx, depth) for each trace of each crop (loc_id, i0, x0, d0):
    the surface's depth in the crop, -1 where it is absent or outside."""
    a, b, c = crop
    t = locations.select("loc_id", "i0", "x0", "d0", F.explode(F.sequence(F.lit(0), F.lit(a - 1))).alias("ci")).select("*", F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("cx"))
    j = t.withColumns({"i": F.col("i0") + F.col("ci"), "x": F.col("x0") + F.col("cx")}).join(surface, ["i", "x"], "left")
    z = F.col("d") - F.col("d0")
    return j.select("loc_id", F.col("ci").cast("long").alias("ci"), F.col("cx").cast("long").alias("cx"), F.when((z >= 0) & (z < c), z).otherwise(-1).alias("depth"))


def fault_mask(points: DataFrame, axis: str = "x", width: int = 1, sparse_lines: DataFrame | None = None) -> DataFrame:
    """(i, x, d, value): points drawn with a thickness across the strike; with
    ``sparse_lines`` (i) other lines of the traces' range hold -1 at the points' places."""
    k = width // 2
    e = points.select("i", "x", "d", F.explode(F.sequence(F.lit(-k), F.lit(width - 1 - k))).alias("_k")).withColumn(axis, F.col(axis) + F.col("_k")).select("i", "x", "d").distinct()
    if sparse_lines is None:
        return e.withColumn("value", F.lit(1))
    return e.join(sparse_lines.select("i", F.lit(1).alias("_on")), "i", "left").select("i", "x", "d", F.when(F.col("_on").isNull(), -1).otherwise(1).alias("value"))


# --- locations ---------------------------------------------------------------------
def batches(locations: DataFrame, size: int) -> DataFrame:
    """Adds batch: locations in order of loc_id by ``size``. loc_id is dense from 0, as grids number it."""
    return locations.withColumn("batch", F.floor(F.col("loc_id") / size))


def sample_rows(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` draws with replacement, the same in every run: draw k takes the row
    whose number is a hash of k. Adds draw. Rows are numbered in order of their
    hash, by 4096 ranges of it, so that no task orders all of them."""
    h = F.md5(F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns)))
    hashed = rows.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 3))
    sizes = hashed.groupBy("_b").agg(F.count("*").alias("_n"))  # 4096 rows at most
    total = sizes.agg(F.sum("_n")).first()[0]
    if not total:
        return rows.withColumn("draw", F.lit(0).cast("long"))
    before = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_h", *rows.columns)) - 1
    numbered = hashed.withColumn("_k", place).join(F.broadcast(before), "_b").withColumn("_n", F.col("_before") + F.col("_k")).drop("_h", "_b", "_k", "_before")
    draws = rows.sparkSession.range(n).select(F.col("id").alias("draw")).withColumn("_n", F.floor(uniform(seed, "draw") * total))
    return numbered.join(draws, "_n").drop("_n")


def candidate_starts(points: DataFrame, shape: tuple[int, int, int], crop: tuple[int, int, int]) -> DataFrame:
    """(orientation, i0, x0, d0): starts at points (i, x, d) where a crop fits,
    upright (0) or with its first two sides swapped (1); d is in its middle."""
    a, b, c = crop
    e = points.select("i", "x", "d", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.lit(a).alias("p"), F.lit(b).alias("q")), F.struct(F.lit(1).alias("o"), F.lit(b).alias("p"), F.lit(a).alias("q")))).alias("s"))
    d0 = F.least(F.greatest(F.col("d") - c // 2, F.lit(0)), F.lit(shape[2] - c))
    ok = (F.col("i") + F.col("s.p") <= shape[0]) & (F.col("x") + F.col("s.q") <= shape[1])
    return e.where(ok).select(F.col("s.o").cast("long").alias("orientation"), F.col("i").alias("i0"), F.col("x").alias("x0"), d0.alias("d0")).distinct()


def mixture(sources: DataFrame, n: int, seed: int = 0, by_size: bool = False) -> DataFrame:
    """Rows (source, ...) in turn from the sources, each row of smallest hash
    first: an equal share of ``n`` each, or by the sources' sizes."""
    sizes = sources.groupBy("source").agg(F.count("*").alias("_n"))
    all_ = sizes.agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
    share = F.floor(n * F.col("_n") / F.col("_t")) if by_size else F.floor(n / F.col("_k"))
    quota = sizes.join(F.broadcast(all_)).select("source", share.alias("_q"))
    keys = [c for c in sources.columns]
    h = F.md5(F.concat_ws(",", F.lit(seed), *keys))
    w = Window.partitionBy("source").orderBy("_h", *keys)
    return sources.withColumn("_h", h).withColumn("_r", F.row_number().over(w)).join(quota, "source").where("_r <= _q").drop("_h", "_r", "_q")


def random_locations(n: int, shape: tuple[int, int, int], low: int, high: int, spark, seed: int = 42) -> DataFrame:
    """(k, i0, i1, x0, x1, d0, d1): ``n`` boxes inside a cube with sides low..high."""
    t = spark.range(n).select(F.col("id").alias("k"))
    for j, (a, m) in enumerate(zip("ixd", shape, strict=True)):
        size = F.lit(low) + F.floor(uniform(seed + 2 * j, "k") * (min(high, m) - low + 1))
        start = F.floor(uniform(seed + 2 * j + 1, "k") * (m - F.col(f"_{a}") + 1))
        t = t.withColumn(f"_{a}", size).withColumn(f"{a}0", start).withColumn(f"{a}1", F.col(f"{a}0") + F.col(f"_{a}")).drop(f"_{a}")
    return t


def extension_grid(surface: DataFrame, shape: tuple[int, int], crop: tuple[int, int], stride: int, top: int = 1) -> DataFrame:
    """(i, x, i0, x0, gain): for each boundary point of a surface the ``top`` of
    its four shifted crops that hold the most traces without the surface,
    counted for each crop by itself (ties: smaller start)."""
    from .surface import boundary

    b = boundary(surface.withColumn("_s", F.lit(0)), "_s")
    a, c = crop
    moves = F.array(*(F.struct(F.lit(di).alias("di"), F.lit(dx).alias("dx")) for di, dx in ((-a + stride, 0), (-stride, 0), (0, -c + stride), (0, -stride))))
    e = b.select("i", "x", F.explode(moves).alias("m"))
    e = e.select("i", "x", F.least(F.greatest(F.col("i") + F.col("m.di"), F.lit(0)), F.lit(shape[0] - a)).alias("i0"), F.least(F.greatest(F.col("x") + F.col("m.dx"), F.lit(0)), F.lit(shape[1] - c)).alias("x0")).distinct()
    loc = e.select("i0", "x0").distinct().withColumn("loc_id", F.col("i0") * shape[1] + F.col("x0"))
    n = alive_crops(loc, surface.select("i", "x"), crop, 0)
    gain = loc.join(n, "loc_id", "left").select("i0", "x0", (F.lit(a * c) - F.coalesce("n", F.lit(0))).alias("gain"))
    w = Window.partitionBy("i", "x").orderBy(F.desc("gain"), "i0", "x0")
    return e.join(gain, ["i0", "x0"]).where("gain > 0").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).select("i", "x", "i0", "x0", "gain")


def named(rows: DataFrame, names: DataFrame, key: str, name: str = "name") -> DataFrame:
    """``rows`` with the name of ``key`` from a table (key, name)."""
    return rows.join(names.select(key, name), key, "left")


def crop_components(mask: DataFrame) -> DataFrame:
    """(loc_id, c, ci, cx, d): surfaces in each crop by itself: components of the
    mask's cells (loc_id, ci, cx, cd), with their mean depth by trace. Crops are
    spread apart so that they don't touch."""
    from .components import grid_components

    v = mask.select((F.col("loc_id") * 2).alias("l"), *PLACE)
    c = grid_components(v, ["l", *PLACE], "((l * 4096L + ci) * 4096L + cx) * 4096L + cd", 16)
    return c.groupBy((F.col("l") / 2).cast("long").alias("loc_id"), "c", "ci", "cx").agg(F.rint(F.avg("cd")).cast("long").alias("d"))


def resized(c: DataFrame, shape: tuple[int, int, int], to: tuple[int, int, int]) -> DataFrame:
    """Crops resampled linearly along each axis (cell centres, ends held): each
    cell takes the cells around its place with weights that sum to 1."""
    out = c
    for p, n, m in zip(PLACE, shape, to, strict=True):
        if n == m:
            continue
        grid = c.sparkSession.range(m).select(F.col("id").alias("_t"), F.least(F.greatest((F.col("id") + 0.5) * n / m - 0.5, F.lit(0.0)), F.lit(n - 1.0)).alias("_p"))
        near = F.array_distinct(F.array(F.floor("_p"), F.least(F.floor("_p") + 1, F.lit(n - 1))))
        w = grid.select("_t", "_p", F.explode(near).alias(p)).select("_t", p, F.greatest(1 - F.abs(F.col(p) - F.col("_p")), F.lit(0.0)).alias("_w")).where("_w > 0")
        rest = [k for k in ("loc_id", *PLACE) if k != p]
        out = out.join(F.broadcast(w), p).groupBy(*rest, "_t").agg(F.sum(F.col("amp") * F.col("_w")).alias("amp")).withColumnRenamed("_t", p)  # two rows of weights for each place
    return out.select("loc_id", *PLACE, "amp")
