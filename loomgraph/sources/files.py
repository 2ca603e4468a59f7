"""Text files, snapshots and JSON lines in and out."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import Graph, GraphSpec

FLAGS = {"is_directed": "directed", "is_dynamic": "dynamic", "is_weighted": "weighted", "is_bipartite": "bipartite"}
NUMBERS = {"n": "n", "initial_edge_count": "initial_edge_count"}
REQUEST = "type string, userKey string, queries array<struct<id: bigint, w: double>>, c double"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and seq, which rises by file name and then by place in the file, however files are split."""
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line")]
    return spark.read.text(path).select("value", F.struct(*where).alias("seq"))


def header(spark: SparkSession, path: str, keys: set[str]) -> dict[str, str]:
    """key value lines; a key that isn't in keys is an error. Headers are a few lines, so they come to the driver."""
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.split("value", " ", 2).alias("kv")).collect()
    found = {r["kv"][0]: r["kv"][1] if len(r["kv"]) > 1 else "" for r in rows}
    if unknown := set(found) - keys:
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    return found


def read_spec(spark: SparkSession, path: str, bipartite_path: str | None = None) -> GraphSpec:
    found, known = header(spark, path, set(FLAGS) | set(NUMBERS)), {}
    for key, value in found.items():
        if key in FLAGS:
            if value not in ("true", "false"):
                raise ValueError(f"{key}: {value!r} is neither true nor false")
            known[FLAGS[key]] = value == "true"
        else:
            known[NUMBERS[key]] = int(value)
    if bipartite_path:
        known["item_count"] = read_bipartite(spark, bipartite_path)["type1_count"]
    return GraphSpec(**known)


def read_bipartite(spark: SparkSession, path: str) -> dict:
    found = header(spark, path, {"type1", "type2", "type1_count"})
    return found | {"type1_count": int(found["type1_count"])}


def read_edges(spark: SparkSession, path: str, weighted: bool = True) -> DataFrame:
    """src, dst, [w], seq of an edge list with single spaces; self-loops are left to the graph's builder but dropped here too."""
    parts = F.split("value", " ")
    columns = [parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst")] + [parts[2].cast("double").alias("w")] * weighted
    return numbered_lines(spark, path).where("trim(value) <> ''").select(*columns, "seq").where("src <> dst")


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """id, title: the first space ends the id; the first line of an id counts."""
    parts = F.split("value", " ", 2)
    rows = numbered_lines(spark, path).where("trim(value) <> ''").select(parts[0].cast("long").alias("id"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("title"), "seq")
    return rows.groupBy("id").agg(F.min_by("title", "seq").alias("title"))


def read_sources(spark: SparkSession, path: str, k: int = 1000) -> DataFrame:
    """seq, id of the first k (at most 1000) lines, one id each."""
    rows = numbered_lines(spark, path).where("trim(value) <> ''").orderBy("seq").limit(min(k, 1000))
    return rows.select((F.row_number().over(Window.orderBy("seq")) - 1).alias("seq"), F.trim("value").cast("long").alias("id"))


def read_exact(spark: SparkSession, path: str, sources: DataFrame, prefix: bool = True) -> DataFrame:
    """src, dst, ppr of the sources (id); the first of a pair counts. prefix: only up to the first other source."""
    parts = F.split("value", " ")
    rows = numbered_lines(spark, path).where("trim(value) <> ''").select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst"), parts[2].cast("double").alias("ppr"), "seq")
    wanted = sources.select(F.col("id").alias("src")).distinct()
    if prefix:
        stop = rows.join(wanted, "src", "left_anti").agg(F.min("seq").alias("stop"))
        rows = rows.join(F.broadcast(stop)).where(F.col("stop").isNull() | (F.col("seq") < F.col("stop"))).drop("stop")  # one row
    rows = rows.join(wanted, "src", "left_semi")
    return rows.groupBy("src", "dst").agg(F.min_by("ppr", "seq").alias("ppr"))


def write_snapshot(graph: Graph, path: str) -> None:
    """Edges with their weights, sorted by source within files."""
    graph.edges.repartition("src").sortWithinPartitions("src", "dst").write.mode("overwrite").parquet(path)


def read_snapshot(spark: SparkSession, path: str, spec: GraphSpec) -> Graph:
    return Graph(spec, spark.read.schema("src long, dst long, w double").parquet(path))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """id, name, title_ja, ranking, year from a Parquet table or, where the path is a JDBC address, its table `nodes`."""
    if path.startswith("jdbc:"):
        return spark.read.format("jdbc").options(url=path, dbtable="nodes").load()
    return spark.read.parquet(path)


def parse_requests(lines: DataFrame) -> DataFrame:
    """value (JSON lines) to the request's fields, ok and value; blank lines go."""
    rows = lines.where("trim(value) <> ''").withColumn("r", F.from_json("value", REQUEST))
    return rows.select(*[c for c in lines.columns], "r.*", F.coalesce(F.col("r.type").isin("analyze", "adjust"), F.lit(False)).alias("ok"))


def as_json(ranking: DataFrame) -> DataFrame:
    """One row: the array of {id, score} of ranking (rk, node, val), which has at most a hundred rows."""
    item = F.struct("rk", F.struct(F.col("node").alias("id"), F.col("val").alias("score")).alias("x"))
    return ranking.agg(F.to_json(F.transform(F.sort_array(F.collect_list(item)), lambda i: i["x"])).alias("value"))


def edge_lines(graph: Graph) -> DataFrame:
    """value: 'src dst w' for each edge row, for consoles and text files."""
    return graph.edges.select(F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string"), F.col("w").cast("string")).alias("value"))


def score_lines(scores: DataFrame) -> DataFrame:
    """value: 'node val' for each score."""
    return scores.select(F.concat_ws(" ", F.col("node").cast("string"), F.col("val").cast("string")).alias("value"))
