"""Text formats: surface picks, fault sticks, checkshots, LAS logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("t")).where(F.col("t")[0] != "")


def read_picks(spark: SparkSession, path: str) -> DataFrame:
    """(inline, crossline, depth): three columns, or nine of which the third,
    sixth and ninth count; lines of other widths are left out."""
    t = _tokens(spark, path)
    wide = F.size("t") >= 9
    at = lambda a, b: F.when(wide, F.get("t", F.lit(b))).otherwise(F.get("t", F.lit(a))).try_cast("double")
    return t.where((F.size("t") == 3) | wide).select(at(0, 2).alias("inline"), at(1, 5).alias("crossline"), at(2, 8).alias("depth")).where("inline is not null and crossline is not null and depth is not null")


def is_picks(path: str, least: int = 100, bad: tuple[str, ...] = ("sgy", "segy", "hdf5", "py", "ipynb", "json", "las", "parquet")) -> bool:
    """Whether a local file looks like picks: not of another kind by its ending,
    ``least`` kB or more, and three or nine columns in its first line."""
    from pathlib import Path

    p = Path(path)
    if p.suffix.lower().lstrip(".") in bad or not p.is_file() or p.stat().st_size < least * 1024:
        return False
    with p.open(errors="replace") as f:
        n = len(f.readline().split())
    return n == 3 or n >= 9


def load_picks(spark: SparkSession, path: str, inlines: tuple[int, int] = (0, 1), crosslines: tuple[int, int] = (0, 1), shape: tuple[int, int, int] | None = None, time: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """(i, x, d) of picks: lines (shift, step) to ordinals, depth by (delay,
    interval) to whole samples, points outside ``shape`` left out."""
    p = read_picks(spark, path)
    at = lambda c, line: F.floor((F.col(c) - line[0]) / line[1])
    p = p.select(at("inline", inlines).alias("i"), at("crossline", crosslines).alias("x"), F.rint((F.col("depth") - time[0]) / time[1]).cast("long").alias("d"))
    for c, n in zip("ixd", shape or (), strict=False):
        p = p.where((F.col(c) >= 0) & (F.col(c) < n))
    return p


def recover_lines(picks: DataFrame, fit: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """Picks (inline, crossline, cdp_x, cdp_y, ...) whose lines lie outside
    0 ... shape take those of their coordinates. ``fit``: a row of cube.affine_fit."""
    from ..operators.cube import cdp_to_lines

    p = picks.withColumnsRenamed({"inline": "_i", "crossline": "_x"})
    p = cdp_to_lines(p, fit)
    lost = (F.col("_i") < 0) | (F.col("_i") >= shape[0]) | (F.col("_x") < 0) | (F.col("_x") >= shape[1])
    return p.withColumn("inline", F.when(lost, F.col("inline")).otherwise(F.col("_i"))).withColumn("crossline", F.when(lost, F.col("crossline")).otherwise(F.col("_x"))).select(*picks.columns)


def write_picks(surface: DataFrame, path: str, inlines: tuple[int, int] = (0, 1), crosslines: tuple[int, int] = (0, 1), time: tuple[float, float] | None = None) -> None:
    """Points (i, x, d) as sorted, space-separated lines: values of inline and
    crossline by (shift, step), depth in samples or, by (delay, interval), in ms."""
    depth = F.col("d") * time[1] + time[0] if time else F.col("d")
    v = [(F.col("i") * inlines[1] + inlines[0]), (F.col("x") * crosslines[1] + crosslines[0]), depth]
    surface.repartitionByRange("i", "x").sortWithinPartitions("i", "x").select(F.concat_ws(" ", *(c.cast("string") for c in v))).write.text(path)


def read_sticks(spark: SparkSession, path: str) -> DataFrame:
    """(fault, stick, i, x, d): three or five columns (name, number last), or
    eight and more (marker, i, x, cdp_x, cdp_y, d, name, number)."""
    t = _tokens(spark, path)
    n = F.size("t")
    num = lambda k: F.get("t", F.lit(k)).try_cast("double")
    wide = n >= 8
    return t.where(n.isin(3, 5) | wide).select(
        F.when(wide, F.get("t", F.lit(6))).when(n == 5, F.get("t", F.lit(3))).alias("fault"), F.when(wide, num(7)).when(n == 5, num(4)).cast("long").alias("stick"),
        F.when(wide, num(1)).otherwise(num(0)).alias("i"), F.when(wide, num(2)).otherwise(num(1)).alias("x"), F.when(wide, num(5)).otherwise(num(2)).alias("d"))


def write_sticks(nodes: DataFrame, path: str) -> None:
    nodes.repartitionByRange("fault", "stick").sortWithinPartitions("fault", "stick", "d").select(F.concat_ws(" ", *(F.col(c).cast("string") for c in ("i", "x", "d", "fault", "stick")))).write.text(path)


def read_checkshot(spark: SparkSession, path: str) -> DataFrame:
    """(well, x, y, z, twt, md): eight columns after a head; time and z change sign."""
    t = _tokens(spark, path).where(F.size("t") == 8)
    num = lambda k: F.get("t", F.lit(k)).try_cast("double")
    return t.select(F.get("t", F.lit(5)).alias("well"), num(0).alias("x"), num(1).alias("y"), (-num(2)).alias("z"), (-num(3)).alias("twt"), num(4).alias("md")).where("x is not null")


def read_las(spark: SparkSession, path: str) -> DataFrame:
    """(well, md, mnemonic, value) of LAS 2 files under ``path``, one file a row
    at first: a log file is a few MB. The null value of the file becomes null."""
    import pandas as pd

    def parse(text: str, name: str) -> list[tuple]:
        part, names, null, rows = "", [], None, []
        for line in text.splitlines():
            line = line.strip()
            if not line or line[0] == "#":
                continue
            if line[0] == "~":
                part = line[1:2].upper()
            elif part == "W" and line.upper().startswith("NULL"):
                null = float(line.split(".", 1)[1].split(":")[0].split()[0])
            elif part == "C":
                names.append(line.split(".")[0].strip())
            elif part == "A":
                v = [float(x) for x in line.split()]
                rows += [(name, v[0], m, None if null is not None and x == null else x) for m, x in zip(names[1:], v[1:], strict=False)]
        return rows

    def run(batches):
        for b in batches:
            rows = [r for p, t in zip(b["path"], b["text"], strict=True) for r in parse(t, p.rsplit("/", 1)[-1].rsplit(".", 1)[0])]
            yield pd.DataFrame(rows, columns=["well", "md", "mnemonic", "value"])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return files.mapInPandas(run, "well string, md double, mnemonic string, value double")
