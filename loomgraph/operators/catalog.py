"""Names: suggestion, lookup, exclusion lists, metadata."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.scalars import LAST, year_label

SHOWN = 10


def display_name(locale: str) -> Column:
    return F.coalesce("title_ja", "name") if locale.startswith("ja") else F.col("name")


def suggest(nodes: DataFrame, text: str | None, locale: str = "en", k: int = SHOWN) -> DataFrame:
    """rk, title, year: the k best-ranked names that start with text; if no more than k do, those that contain it."""
    if text is None or len(text) < 2:
        return nodes.sparkSession.createDataFrame([], "rk int, title string, year int")
    names = nodes.select("id", display_name(locale).alias("title"), "ranking", "year")
    order = [F.coalesce("ranking", F.lit(LAST)).asc(), F.col("id").asc()]
    literal = text.replace("\\", "\\\\")
    at_start = names.where(F.col("title").ilike(literal + "%")).withColumn("starts", F.lit(True))
    inside = names.where(F.col("title").ilike("%" + literal + "%")).withColumn("starts", F.lit(False))
    best = at_start.orderBy(*order).limit(k + 1).unionByName(inside.orderBy(*order).limit(k))  # at most 2k + 1 rows from here
    best = best.withColumn("many", F.sum(F.col("starts").cast("int")).over(Window.partitionBy()) > k)
    best = best.where(F.col("starts") == F.col("many"))
    return best.select(F.row_number().over(Window.orderBy(*order)).alias("rk"), "title", "year").where(F.col("rk") <= k)


def lookup(nodes: DataFrame, items: DataFrame, locale: str = "en") -> DataFrame:
    """node, w, seq of items (name, weight, seq) by exact name; of equal names the largest id; unknown ones go. The
    first row of a name counts, a missing weight is 1."""
    one = items.groupBy("name").agg(F.min("seq").alias("seq"), F.min_by(F.coalesce("weight", F.lit(1.0)), "seq").alias("w"))
    ids = nodes.groupBy(display_name(locale).alias("name")).agg(F.max("id").alias("node"))
    return one.join(ids, "name").select("node", "w", "seq")


def with_exclusions(chosen: DataFrame, excluded: DataFrame) -> DataFrame:
    """chosen (node, w) with excluded ids (text or numbers; others go) at weight 0, which replaces a chosen weight."""
    ids = excluded.select(F.expr("try_cast(id AS double)").alias("x")).where("x IS NOT NULL AND x = floor(x)").select(F.col("x").cast("long").alias("node")).distinct()
    return chosen.join(ids, "node", "left_anti").select("node", "w").unionByName(ids.withColumn("w", F.lit(0.0)))


def add_excluded(excluded: DataFrame, new: DataFrame) -> DataFrame:
    return excluded.unionByName(new.join(excluded, "node", "left_anti").dropDuplicates(["node"]))


def drop_excluded(excluded: DataFrame, gone: DataFrame) -> DataFrame:
    return excluded.join(gone, "node", "left_anti")


def known_names(names: DataFrame, nodes: DataFrame, locale: str = "en") -> DataFrame:
    """names (name) that are some node's exact display name."""
    return names.join(nodes.select(display_name(locale).alias("name")), "name", "left_semi")


def with_metadata(ranking: DataFrame, nodes: DataFrame) -> DataFrame:
    """rk, node, val, name (the id as text if unknown), title_ja, ranking, year, label, in ranking's order."""
    meta = nodes.select(F.col("id").alias("node"), "name", "title_ja", "ranking", "year")
    out = ranking.join(meta, "node", "left").withColumn("name", F.coalesce("name", F.col("node").cast("string")))
    return out.select("rk", "node", "val", "name", "title_ja", "ranking", "year", year_label(F.col("name"), F.col("year")).alias("label")).orderBy("rk")
