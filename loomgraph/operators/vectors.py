"""Algebra of sparse score vectors (node, val), and the popularity adjuster."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 0.9999


def paired(a: DataFrame, b: DataFrame, how: str = "full") -> DataFrame:
    """node, a, b with 0 where one has no value, and whether it has."""
    x, y = a.select("node", F.col("val").alias("a")), b.select("node", F.col("val").alias("b"))
    return x.join(y, "node", how).select("node", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"), F.col("b").isNotNull().alias("in_b"))


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    return paired(a, b, "inner").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0.0)).alias("val"))


def norm(a: DataFrame) -> DataFrame:
    return a.agg(F.sqrt(F.coalesce(F.sum(F.col("val") * F.col("val")), F.lit(0.0))).alias("val"))


def scale(a: DataFrame, k: float) -> DataFrame:
    return a.select("node", (F.col("val") * k).alias("val"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """a - b; what becomes 0 at a place of b goes."""
    d = paired(a, b)
    return d.select("node", (F.col("a") - F.col("b")).alias("val"), "in_b").where(~(F.col("in_b") & (F.col("val") == 0))).drop("in_b")


def normalise(a: DataFrame) -> DataFrame:
    """a / |a|; a zero vector is an error."""
    n = norm(a).withColumnRenamed("val", "n")
    share = F.when(F.col("n") == 0, F.raise_error(F.lit("a zero vector has no direction"))).otherwise(F.col("val") / F.col("n"))
    return a.join(F.broadcast(n)).select("node", share.alias("val"))  # n is one row


def orthogonal(a: DataFrame, b: DataFrame) -> DataFrame:
    """The part of a that is orthogonal to b."""
    unit = normalise(b)
    along = dot(a, unit).withColumnRenamed("val", "k")
    return subtract(a, unit.join(F.broadcast(along)).select("node", (F.col("val") * F.col("k")).alias("val")))


def cosine(a: DataFrame, b: DataFrame) -> DataFrame:
    s = paired(a, b).agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    return s.select(F.try_divide("ab", F.sqrt("aa") * F.sqrt("bb")).alias("val"))


def projection(u: DataFrame, direction: DataFrame) -> DataFrame:
    """One row: the length of unit u along unit direction (0 for an empty u)."""
    return cosine(u, direction).select(F.coalesce("val", F.lit(0.0)).alias("val"))


def adjust(u: DataFrame, popularity: DataFrame, s: float) -> DataFrame:
    """Unit u moved along unit popularity so that its cosine with it becomes s: node, val for every node of popularity.

    s is held within +-LIMIT. An empty or zero u gives zeros."""
    s = max(-LIMIT, min(LIMIT, s))
    j = paired(popularity, u.where("val <> 0"), "left")  # a: popularity, b: u
    k = j.agg(F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("na"), F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("nb"), F.sum(F.col("a") * F.col("b")).alias("ab"))
    k = k.select("na", "nb", F.coalesce(F.try_divide("ab", F.col("na") * F.col("nb")), F.lit(0.0)).alias("p"))
    c = F.col("p") - s * F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("p") * F.col("p")) / (1 - s * s))
    k = k.withColumn("c", F.when(F.col("nb") > 0, c).otherwise(0.0))
    out = F.coalesce(F.try_divide("b", "nb"), F.lit(0.0)) - F.col("c") * F.col("a") / F.col("na")
    return j.join(F.broadcast(k)).select("node", out.alias("val"))  # k is one row
