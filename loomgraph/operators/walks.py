"""Random walks in bulk-synchronous steps, with counter-based random numbers: any step of any walk can be made again.

Paths are rows (walk_id, start, weight, step, node). A step of all walks is one join with the edges.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import SINK, Graph, cumulative, slots
from loomgraph.operators.iterate import cut

ALPHA, MAX_STEPS = 0.2, 40


def uniform(seed: int, walk, step, purpose: str):
    """In [0, 1), from 32 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), walk.cast("string"), step.cast("string"), F.lit(purpose))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def walkers(sources: DataFrame, count: int) -> DataFrame:
    """walk_id, start, weight: count walkers at each source (node)."""
    n = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    return sources.select("node", n.alias("i")).select(F.concat_ws("_", "node", "i").alias("walk_id"), F.col("node").alias("start"), F.lit(1.0 / count).alias("weight"))


def step_table(graph: Graph, weighted: bool) -> DataFrame:
    """src, dst, lo, hi in [0, 1): the neighbour of a draw is the one in whose slice it falls."""
    if weighted:
        return cumulative(graph.edges).select("src", "dst", (F.col("lo") / F.col("total")).alias("lo"), (F.col("hi") / F.col("total")).alias("hi"))
    return slots(graph.edges).select("src", "dst", (F.col("slot") / F.col("degree")).alias("lo"), ((F.col("slot") + 1) / F.col("degree")).alias("hi"))


def paths(graph: Graph, start: DataFrame, alpha: float = ALPHA, seed: int = 1, weighted: bool = True, stop_first: bool = True, max_steps: int = MAX_STEPS, every: int = 8) -> DataFrame:
    """walk_id, start, weight, step, node: every place of every walk. Before each step a walk stops with probability
    alpha (not before the first unless stop_first); a walk that goes on from a dangling vertex ends at -1. Walks that
    are alive after max_steps end there.

    A walk is one row with its places in an array, which max_steps bounds, so steps add to the plan by one join; walks
    that have ended leave it whenever the state is cut."""
    table = cut(step_table(graph, weighted))
    now = start.select("walk_id", "start", "weight", F.array("start").alias("path"), F.lit(True).alias("going"))
    over = []
    for k in range(1, max_steps + 1):
        goes = F.col("going") & (F.element_at("path", -1) != SINK)
        if k > 1 or stop_first:
            goes = goes & (uniform(seed, F.col("walk_id"), F.lit(k), "stop") >= alpha)
        draw = now.withColumn("going", goes).withColumns({"at": F.when(F.col("going"), F.element_at("path", -1)), "u": uniform(seed, F.col("walk_id"), F.lit(k), "move")})
        fits = (draw["at"] == table["src"]) & (draw["u"] >= table["lo"]) & (draw["u"] < table["hi"])
        moved = F.concat("path", F.array(F.coalesce("dst", F.lit(SINK).cast("long"))))
        now = draw.join(table, fits, "left").select("walk_id", "start", "weight", F.when(F.col("going"), moved).otherwise(F.col("path")).alias("path"), "going")
        if k % every == 0 or k == max_steps:
            now = cut(now)
            over.append(now.where("NOT going"))
            now = now.where("going")
            if now.isEmpty():
                break
    out = now
    for x in over:
        out = out.unionByName(x)
    return out.select("walk_id", "start", "weight", F.posexplode("path").alias("step", "node"))


def ends(path: DataFrame) -> DataFrame:
    """walk_id, start, weight, node: where each walk ends."""
    return path.groupBy("walk_id").agg(F.max_by(F.struct("start", "weight", "node"), "step").alias("x")).select("walk_id", "x.*")


def monte_carlo(graph: Graph, sources: DataFrame, count: int, **how) -> DataFrame:
    """node, val: share of walks that end there."""
    return ends(paths(graph, walkers(sources, count), **how)).groupBy("node").agg(F.sum("weight").alias("val"))
