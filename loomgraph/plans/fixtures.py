"""Graphs and catalogs made of the relational test tables."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import Graph, GraphSpec
from loomgraph.operators.ranking import rank_of_items

SOURCES, EXCLUDED = ((3, 1.0), (17, 2.0), (42, 1.0)), (17,)


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sizes(spark: SparkSession, d: str) -> tuple[int, int, int]:
    """Parts, customers, suppliers; counts come from the files' footers."""
    return tuple(read(spark, d, t).count() for t in ("part", "customer", "supplier"))


def shop_rows(spark: SparkSession, d: str, parts: int) -> DataFrame:
    """An edge list with repeats: src (part), dst (parts + customer), w, and the columns that order it."""
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    j = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.col("l_partkey").alias("src"), (F.col("o_custkey") + parts).alias("dst"), F.col("l_quantity").alias("w"), "l_orderkey", "l_linenumber")


def shop(spark: SparkSession, d: str, on_duplicate: str = "first") -> Graph:
    """Items (parts) and users (customers), undirected, weighted."""
    parts, customers, _ = sizes(spark, d)
    return Graph.build(shop_rows(spark, d, parts), GraphSpec(n=parts + customers, bipartite=True, item_count=parts), on_duplicate, ("l_orderkey", "l_linenumber", "w"))


def supply(spark: SparkSession, d: str) -> Graph:
    """customer -> part -> supplier, directed; suppliers are dangling."""
    parts, customers, suppliers = sizes(spark, d)
    bought = shop_rows(spark, d, parts).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    made = read(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + parts + customers).alias("dst"), F.col("l_quantity").alias("w"))
    return Graph.build(bought.unionByName(made), GraphSpec(n=parts + customers + suppliers, directed=True, item_count=parts), "sum")


def transition_rows(spark: SparkSession, d: str) -> DataFrame:
    """src, dst: each event's key and the user's next event's key, self-loops too."""
    key = F.get_json_object("props", "$.k").cast("long")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, d, "events").select(key.alias("src"), F.lead(key).over(w).alias("dst")).where("dst IS NOT NULL")


def moves(spark: SparkSession, d: str) -> Graph:
    """Directed transitions between event keys, weighted by how often they occur."""
    rows = transition_rows(spark, d).withColumn("w", F.lit(1.0))
    n = rows.agg(F.max(F.greatest("src", "dst"))).first()[0] + 1
    return Graph.build(rows, GraphSpec(n=n, directed=True), "sum")


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, w, i) for i, (n, w) in enumerate(SOURCES)], "node long, w double, seq int")


def nodes(spark: SparkSession, d: str, graph: Graph) -> DataFrame:
    """id, name, title_ja, ranking, year of the parts."""
    ranks = rank_of_items(graph.degrees().select("node", F.col("weighted_degree").alias("val")), graph.spec.item_count)
    name = F.concat("p_name", F.lit(" #"), F.col("p_partkey").cast("string"))
    p = read(spark, d, "part").join(ranks, F.col("p_partkey") == F.col("node"), "left")
    return p.select(
        F.col("p_partkey").alias("id"), name.alias("name"), F.when(F.col("p_partkey") % 3 == 0, F.concat("p_brand", F.lit(" "), name)).alias("title_ja"),
        F.when(F.col("p_partkey") % 10 != 9, F.col("rk")).alias("ranking"), (F.col("p_size") + 1970).alias("year"),
    )
