"""PageRank and its limit without teleport, degree shares, shortest paths."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import SINK, Graph
from loomgraph.operators.iterate import cut
from loomgraph.operators.ppr import out_steps

UNREACHABLE = 1.7976931348623157e308


@dataclass(frozen=True)
class Ranked:
    values: DataFrame
    rounds: int
    converged: bool


def pagerank(graph: Graph, alpha: float = 0.2, weighted: bool = True, max_rounds: int = 100, tolerance: float = 0.0) -> Ranked:
    """node, val from a uniform start: a share alpha teleports, dangling vertices teleport all; until the sum of
    changes is at most tolerance (0: all rounds). alpha 0 is the stationary share of the walk, which need not converge."""
    n = graph.spec.n
    steps = cut(out_steps(graph, weighted))
    now, converged, k = cut(graph.vertices.withColumn("val", F.lit(1.0 / n))), False, 0
    own = F.col("dst").isNull()
    loose = steps.where(F.col("dst") == SINK).select("node")
    has_loose = not loose.isEmpty()
    for k in range(1, max_rounds + 1):
        lost = now.join(loose, "node").agg(F.sum("val")).first()[0] or 0.0 if has_loose else 0.0
        everywhere = (alpha * (1.0 - lost) + lost) / n
        j = now.join(steps, "node").where(own | (F.col("dst") != SINK))
        part = j.select(F.coalesce("dst", "node").alias("node"), F.when(own, 0.0).otherwise((1 - alpha) * F.col("val") * F.col("p")).alias("x"), F.when(own, F.col("val")).otherwise(0.0).alias("old"))
        new = part.groupBy("node").agg((F.sum("x") + everywhere).alias("val"), F.sum("old").alias("old"))
        new = cut(new) if tolerance or has_loose or k % 5 == 0 else new
        if tolerance and new.agg(F.sum(F.abs(F.col("val") - F.col("old")))).first()[0] <= tolerance:
            return Ranked(new.select("node", "val"), k, True)
        now = new.select("node", "val")
    return Ranked(now, k, converged)


def degree_share(graph: Graph, weighted: bool = True) -> DataFrame:
    """node, val: degree (or sum of weights) over the sum of all."""
    d = graph.degrees().select("node", F.col("weighted_degree" if weighted else "degree").cast("double").alias("x"))
    total = d.agg(F.sum("x").alias("total"))
    return d.join(F.broadcast(total)).select("node", F.try_divide("x", "total").alias("val"))  # total is one row


def shortest(graph: Graph, source: int, by_weight: bool = False, max_rounds: int = 1 << 20, unreachable: float = UNREACHABLE) -> DataFrame:
    """node, dist from source: hops, or the sum of 1 / w over edges with w > 0; unreachable vertices get that figure."""
    edges = graph.edges.where("w > 0").select("src", "dst", (1.0 / F.col("w")).alias("cost")) if by_weight else graph.edges.select("src", "dst", F.lit(1.0).alias("cost"))
    known = cut(graph.edges.sparkSession.createDataFrame([(source, 0.0)], "node long, dist double"))
    front = known
    for _ in range(max_rounds):  # only vertices that came nearer go on
        reached = front.join(edges, front["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("dist") + F.col("cost")).alias("near"))
        nearer = reached.join(known, "node", "left").where(F.col("dist").isNull() | (F.col("near") < F.col("dist"))).select("node", F.col("near").alias("dist"))
        front = cut(nearer)
        if front.isEmpty():
            break
        known = cut(known.join(front.select("node"), "node", "left_anti").unionByName(front))
    return graph.vertices.join(known, "node", "left").select("node", F.coalesce("dist", F.lit(unreachable)).alias("dist"))
