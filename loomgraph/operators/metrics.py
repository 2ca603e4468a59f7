"""Agreement of rankings: gains, rank correlation, top-weighted correlation.

Inputs are score vectors (node, val); -1 is left out. Windows over a ranking are cut to its first k rows before, where
the measure has a k.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import SINK
from loomgraph.operators.ranking import ranks


def places(scores: DataFrame, k: int | None = None) -> DataFrame:
    """node, val, rk: the first k of the ranking, or all of it."""
    clean = scores.where(F.col("node") != SINK)
    if not k:
        return ranks(clean)
    order = [F.col("val").desc(), F.col("node").asc()]
    return clean.orderBy(*order).limit(k).withColumn("rk", F.row_number().over(Window.orderBy(*order)))


def gain(ranking: DataFrame, relevance: DataFrame) -> DataFrame:
    """One row: sum of (2^rel - 1) / log2(rk + 1) over ranking (node, rk); nodes without relevance have 0."""
    rel = relevance.select("node", F.col("val").alias("rel"))
    j = ranking.select("node", "rk").join(rel, "node", "left")
    return j.agg(F.coalesce(F.sum((F.pow(F.lit(2.0), F.coalesce("rel", F.lit(0.0))) - 1) / F.log2(F.col("rk") + 1)), F.lit(0.0)).alias("val"))


def ndcg(approx: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    best = exact.where(F.col("node") != SINK)
    got, most = gain(places(approx, k), best).withColumnRenamed("val", "got"), gain(places(best, k), best).withColumnRenamed("val", "most")
    return got.join(F.broadcast(most)).select(F.try_divide("got", "most").alias("val"))  # one row each


def spearman(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Correlation of ranks of the first k of a that b has too, each rank taken in its whole list."""
    j = places(a, k).select("node", F.col("rk").alias("ra")).join(places(b).select("node", F.col("rk").alias("rb")), "node")
    return j.agg(F.corr(F.col("ra").cast("double"), F.col("rb").cast("double")).alias("val"))


def ap_correlation(a: DataFrame, b: DataFrame, k: int, compat: bool = False) -> DataFrame:
    """Top-weighted rank correlation (Yilmaz et al. 2008) of the first k of a with b, over nodes of both: for each node
    but the first, the share of those above it that are above it in b too.

    compat: the nodes held against one are those from the second place down to itself, and the mean divides by one
    less; null where nothing is left to divide by."""
    shared = places(a, k).select("node", F.col("rk").alias("ra")).join(places(b).select("node", F.col("rk").alias("rb")), "node")
    one, above = shared.select(F.col("ra").alias("i"), F.col("rb").alias("bi")), shared.select(F.col("ra").alias("j"), F.col("rb").alias("bj"))
    held = (F.col("j") > 1) & (F.col("j") <= F.col("i")) if compat else F.col("j") < F.col("i")
    per = one.join(above, held).groupBy("i").agg(F.avg(F.when(F.col("bj") < F.col("bi"), 1.0).otherwise(0.0)).alias("share"))
    return per.agg(F.sum("share").alias("s"), F.count("*").alias("n")).select((F.try_divide(2 * F.col("s"), F.col("n") - (1 if compat else 0)) - 1).alias("val"))


def ap_symmetric(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    x, y = ap_correlation(a, b, k).withColumnRenamed("val", "x"), ap_correlation(b, a, k).withColumnRenamed("val", "y")
    return x.join(F.broadcast(y)).select(((F.col("x") + F.col("y")) / 2).alias("val"))  # one row each


def stamp(ts):
    """YYYY/MM/DD hh:mm:ss."""
    return F.date_format(ts, "yyyy/MM/dd HH:mm:ss")


def elapsed(start, end):
    """Seconds between two timestamps."""
    return F.unix_micros(end.cast("timestamp")) / 1e6 - F.unix_micros(start.cast("timestamp")) / 1e6
