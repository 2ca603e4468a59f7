"""Orderings, typed top-k, exclusions, title joins."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import SINK, is_item


def ranked(scores: DataFrame) -> DataFrame:
    """scores (node, val) in order: value falling, node rising."""
    return scores.orderBy(F.col("val").desc(), F.col("node").asc())


def exclude(scores: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """scores without -1 and without ids (node)."""
    out = scores.where(F.col("node") != SINK)
    return out if ids is None else out.join(ids.select("node").distinct(), "node", "left_anti")


def top_items(scores: DataFrame, item_count: int, k: int = 100) -> DataFrame:
    """rk, node, val of the k best items; the limit runs before the numbering, so the window has k rows."""
    best = ranked(scores.where(is_item(F.col("node"), item_count))).limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.col("val").desc(), F.col("node"))).alias("rk"), "node", "val")


def ranks(scores: DataFrame) -> DataFrame:
    """scores with rk, from 1 over all rows. Rows are counted by magnitude first (some ten thousand at most), so that a
    task ranks those of one magnitude alone."""
    size = F.floor(F.log2(F.abs("val")) * 8).cast("long") + 100_000
    part = F.when(F.col("val") > 0, size).when(F.col("val") < 0, -size).otherwise(F.lit(0).cast("long"))
    spread = scores.withColumn("part_", part)
    above = spread.groupBy("part_").agg(F.count("*").alias("n"))
    above = above.select("part_", F.coalesce(F.sum("n").over(Window.orderBy(F.col("part_").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    w = Window.partitionBy("part_").orderBy(F.col("val").desc(), F.col("node"))
    return spread.join(above, "part_").withColumn("rk", (F.row_number().over(w) + F.col("before_")).cast("long")).drop("part_", "before_")


def rank_of_items(scores: DataFrame, item_count: int) -> DataFrame:
    """node, rk (from 1) over all items."""
    return ranks(scores.where(is_item(F.col("node"), item_count))).select("node", "rk")


def with_titles(ranking: DataFrame, titles: DataFrame, ranks: DataFrame) -> DataFrame:
    """ranking (rk, node, val) with title ('' if missing) and degree_rank."""
    out = ranking.join(titles.select(F.col("id").alias("node"), "title"), "node", "left").join(ranks.select("node", F.col("rk").alias("degree_rank")), "node", "left")
    return out.select("rk", "node", F.coalesce("title", F.lit("")).alias("title"), "val", "degree_rank")


def printed(ranking: DataFrame, titles: DataFrame, ranks: DataFrame, k: int) -> DataFrame:
    """with_titles, which must have k rows."""
    out = with_titles(ranking.where(F.col("rk") <= k), titles, ranks)
    if out.count() < k:
        raise ValueError(f"fewer than {k} items")
    return out


def visible(ranking: DataFrame, excluded_ids: DataFrame, chosen_names: DataFrame, k: int = 10) -> DataFrame:
    """The first k of ranking (rk, node, name, ...) that are neither excluded nor chosen by name; null names stay."""
    left = ranking.join(excluded_ids.select("node").distinct(), "node", "left_anti")
    left = left.join(chosen_names.select("name").distinct(), "name", "left_anti")
    return left.orderBy("rk").limit(k)
