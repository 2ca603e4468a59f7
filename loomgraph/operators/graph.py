"""Graphs as vertex and edge DataFrames: building, topology, mutation, transition probabilities.

Edges are directed rows (src, dst, w); an undirected graph has both directions. Vertices are 0 to n - 1, so isolated
ones exist. -1 stands for where walks from dangling vertices end.
"""

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SINK = -1
EDGE = "src long, dst long, w double"


@dataclass(frozen=True)
class GraphSpec:
    """What a graph's header says."""

    n: int
    directed: bool = False
    weighted: bool = True
    dynamic: bool = False
    bipartite: bool = False
    initial_edge_count: int | None = None
    item_count: int | None = None
    data_dir: str | None = None


@dataclass(frozen=True)
class Graph:
    spec: GraphSpec
    edges: DataFrame

    # ---- building

    @staticmethod
    def empty(spark: SparkSession, spec: GraphSpec) -> "Graph":
        return Graph(spec, spark.createDataFrame([], EDGE))

    @staticmethod
    def build(rows: DataFrame, spec: GraphSpec, on_duplicate: str | None = None, order: tuple[str, ...] = ("seq",)) -> "Graph":
        """From rows src, dst, [w], [order columns]. Self-loops go. on_duplicate: 'first' (by order), 'sum' or 'error';
        by default the first counts in weighted graphs and others must have none."""
        how = on_duplicate or ("first" if spec.weighted else "error")
        if "w" not in rows.columns:
            rows = rows.withColumn("w", F.lit(1.0))
        rows = rows.where("src <> dst")
        if not spec.directed:
            rows = rows.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")})
        else:
            rows = rows.withColumns({"a": F.col("src"), "b": F.col("dst")})
        if how == "first":
            first = F.min_by("w", F.struct(*order))
            one = rows.groupBy("a", "b").agg(first.alias("w"))
        else:
            one = rows.groupBy("a", "b").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
            if how == "error" and not one.where("n > 1").isEmpty():
                raise ValueError("the edge list repeats an edge")
        one = one.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")
        return Graph(spec, one if spec.directed else symmetric(one))

    def with_edges(self, edges: DataFrame) -> "Graph":
        return replace(self, edges=edges)

    def persist(self) -> "Graph":
        """Edges dealt out by source and kept, for iterative operators."""
        return self.with_edges(self.edges.repartition("src").persist())

    def validate(self) -> None:
        """Raises if an edge leaves 0 to n - 1."""
        if not self.edges.where((F.least("src", "dst") < 0) | (F.greatest("src", "dst") >= self.spec.n)).isEmpty():
            raise ValueError("an edge has an id outside the graph")

    # ---- topology

    @property
    def vertices(self) -> DataFrame:
        return self.edges.sparkSession.range(self.spec.n).select(F.col("id").alias("node"))

    def node_count(self) -> int:
        return self.spec.n

    def edge_count(self) -> DataFrame:
        """One row: directed rows, halved (downwards) in an undirected graph."""
        return self.edges.agg(F.count("*").alias("n")).select((F.col("n") if self.spec.directed else F.floor(F.col("n") / 2)).cast("long").alias("edges"))

    def degrees(self) -> DataFrame:
        """node, degree, weighted_degree for every vertex."""
        sums = self.edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.sum("w").alias("weighted_degree"))
        return self.vertices.join(sums, "node", "left").fillna({"degree": 0, "weighted_degree": 0.0})

    def neighbours(self, node: int) -> DataFrame:
        return self.edges.where(F.col("src") == node).select("dst")

    def has_edges(self, pairs: DataFrame) -> DataFrame:
        """pairs (src, dst) with `present`."""
        asked = pairs.select("src", "dst").distinct()  # the small side first
        have = self.edges.select("src", "dst").join(asked, ["src", "dst"], "left_semi").distinct().withColumn("present", F.lit(True))
        return pairs.join(have, ["src", "dst"], "left").withColumn("present", F.coalesce("present", F.lit(False)))

    def transitions(self) -> DataFrame:
        """src, dst, w, p: weight over the sum of the source's weights."""
        total = self.edges.groupBy("src").agg(F.sum("w").alias("total"))
        return self.edges.join(total, "src").select("src", "dst", "w", F.try_divide("w", "total").alias("p"))

    def transition(self, src: int, dst: int) -> float:
        row = self.transitions().where((F.col("src") == src) & (F.col("dst") == dst)).first()
        if row is None:
            raise KeyError((src, dst))
        return row["p"]

    def memory_kb(self) -> DataFrame:
        """One row: bytes / 1000 of adjacency rows (24 each) and a set of pairs (16 each)."""
        return self.edges.agg((F.count("*") * (24 + 16) / 1000).alias("kb"))

    # ---- mutation

    def both_ways(self, pairs: DataFrame) -> DataFrame:
        return pairs if self.spec.directed else symmetric(pairs)

    def firsts(self, pairs: DataFrame) -> DataFrame:
        """pairs (src, dst, [w], [seq]) with `present` and `first`: of an edge that is told several times (in an undirected
        graph either way round) the first by seq, or by src, dst and w; self-loops never."""
        ends = [F.least("src", "dst"), F.greatest("src", "dst")] if not self.spec.directed else ["src", "dst"]
        order = ["seq"] if "seq" in pairs.columns else ["src", "dst"] + ["w"] * ("w" in pairs.columns)
        rank = F.row_number().over(Window.partitionBy(*ends).orderBy(*order))
        return self.has_edges(pairs).withColumn("first", (rank == 1) & (F.col("src") != F.col("dst")))

    def insert(self, pairs: DataFrame) -> tuple["Graph", DataFrame]:
        """The graph with new edges (src, dst, [w], [seq]), and per pair how many rows came: 0 if it was there or told
        before, else 1 or 2."""
        if "w" not in pairs.columns:
            pairs = pairs.withColumn("w", F.lit(1.0))
        rows = self.firsts(pairs).withColumn("new", F.col("first") & ~F.col("present"))
        told = rows.withColumn("inserted", F.when(F.col("new"), 1 if self.spec.directed else 2).otherwise(0)).drop("w", "present", "first", "new")
        return self.with_edges(self.edges.unionByName(self.both_ways(rows.where("new").select("src", "dst", "w")))), told

    def remove(self, pairs: DataFrame) -> tuple["Graph", DataFrame]:
        """The graph without edges (src, dst, [seq]), and per pair how many rows went: 0 if it wasn't there or was told
        before, else 1 or 2."""
        rows = self.firsts(pairs.drop("w"))
        told = rows.withColumn("removed", F.when(F.col("first") & F.col("present"), 1 if self.spec.directed else 2).otherwise(0)).drop("present", "first")
        gone = self.both_ways(pairs.select("src", "dst").withColumn("w", F.lit(0.0))).select("src", "dst").distinct()
        return self.with_edges(self.edges.join(gone, ["src", "dst"], "left_anti")), told


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of each edge."""
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def is_item(node, item_count: int):
    return (node >= 0) & (node < item_count)


#: Datasets known by name, and whether their graphs are directed.
DIRECTED = {"dblp": False, "flickr-growth": True, "livejournal": False, "orkut": False, "web-berkstan": True, "youtube-u-growth": False, "test": True, "test_undirected": False}


def directed_by_name(names: DataFrame) -> DataFrame:
    """names (name) with directed, false for unknown ones."""
    known = F.create_map(*[F.lit(x) for kv in DIRECTED.items() for x in kv])
    return names.withColumn("directed", F.coalesce(F.try_element_at(known, "name"), F.lit(False)))


def cumulative(transitions: DataFrame) -> DataFrame:
    """src, dst, lo, hi, total: slices of the source's total weight, in order of dst, for weighted sampling."""
    w = Window.partitionBy("src")
    up = F.sum("w").over(w.orderBy("dst").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return transitions.select("src", "dst", (up - F.col("w")).alias("lo"), up.alias("hi"), F.sum("w").over(w).alias("total"))


def slots(edges: DataFrame) -> DataFrame:
    """src, dst, slot, degree: neighbours numbered from 0 in order of dst, for uniform sampling."""
    w = Window.partitionBy("src")
    return edges.select("src", "dst", (F.row_number().over(w.orderBy("dst")) - 1).cast("long").alias("slot"), F.count("*").over(w).alias("degree"))
