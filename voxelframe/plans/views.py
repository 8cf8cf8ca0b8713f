"""The driver's tables as gridded data: points, surfaces, traces, voxels, logs.

Each view has a Spark form (a function of spark and folder) and a SQL form (a
common table expression), defined alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(col: str):
    """Microseconds since 1970 of a time without a zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({col} as timestamp_ntz))")


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.col("l_suppkey").alias("i"), (F.col("l_partkey") % 50).alias("x"), F.rint("l_quantity").cast("long").alias("d"), (1 - F.col("l_discount")).alias("p"), F.col("l_returnflag").alias("s"))


def srf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.surface import trace_surface

    return trace_surface(pts(spark, sf_dir), "mean", ["s"])


def trc(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "embeddings")
    return t.select(F.floor(F.col("vec_id") / 25).alias("i"), (F.col("vec_id") % 25).alias("x"), F.transform("embedding", lambda v: v.cast("double")).alias("samples"), "label")


def vox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trc(spark, sf_dir).select("i", "x", F.posexplode("samples").alias("d", "amp")).withColumn("d", F.col("d").cast("long"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("well"), micros("ts").alias("t"), F.col("event_type").alias("kind"), F.col("value").alias("v"))


def fac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("quality").alias("t"), F.col("toxic").alias("p"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines (nations) and the differences measured where two of them meet."""
    li, o, c, s = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "supplier"))
    j = li.select("l_orderkey", "l_suppkey", (F.col("l_discount") - F.col("l_tax")).alias("m")).join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.where("c_nationkey < s_nationkey").groupBy(F.col("c_nationkey").cast("long").alias("a"), F.col("s_nationkey").cast("long").alias("b")).agg(F.round(F.avg("m"), 9).alias("m"))


SQL = {
    "pts": "pts AS (SELECT l_suppkey AS i, l_partkey % 50 AS x, CAST(round_even(l_quantity, 0) AS BIGINT) AS d, 1 - l_discount AS p, l_returnflag AS s FROM lineitem)",
    "srf": "srf AS (SELECT s, i, x, CAST(round_even(avg(d), 0) AS BIGINT) AS d FROM pts GROUP BY s, i, x)",
    "trc": "trc AS (SELECT CAST(floor(vec_id / 25) AS BIGINT) AS i, vec_id % 25 AS x, CAST(embedding AS DOUBLE[]) AS samples, label FROM embeddings)",
    "vox": "vox AS (SELECT i, x, CAST(unnest(range(len(samples))) AS BIGINT) AS d, unnest(samples) AS amp FROM trc)",
    "logs": "logs AS (SELECT user_id AS well, epoch_us(ts) AS t, event_type AS kind, value AS v FROM events)",
    "fac": "fac AS (SELECT quality AS t, toxic AS p FROM labels)",
    "edges": "edges AS (SELECT CAST(c_nationkey AS BIGINT) AS a, CAST(s_nationkey AS BIGINT) AS b, round(avg(l_discount - l_tax), 9) AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey < s_nationkey GROUP BY 1, 2)",
}
NEEDS = {"srf": ["pts"], "vox": ["trc"]}


def with_views(names: list[str], body: str, recursive: bool = False) -> str:
    """SQL text with the views it needs in front; ``body`` may begin with further ones."""
    order: list[str] = []
    for n in names:
        order += [x for x in [*NEEDS.get(n, []), n] if x not in order]
    rest = body.strip()
    head = ", ".join(SQL[n] for n in order)
    joint = f", {rest[5:]}" if rest.upper().startswith("WITH ") else f" {rest}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{joint}"
