"""Personalised PageRank: exact rounds, forward push in synchronous rounds, push with walks, full-path variants.

A round is one join of the state with the out-steps of each vertex and one sum by vertex. The out-steps have a row
that keeps the vertex's own estimate, one for each edge, and one to -1 for a dangling vertex, so the state is used
once a round and plans grow by a constant.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import SINK, Graph
from loomgraph.operators.iterate import cut, rounds
from loomgraph.operators.walks import ends, paths

#: The chance to stop at a vertex, and the walks of a sampled query.
ALPHA, WALKS = 0.2, 1_000_000


def normalised(sources: DataFrame) -> DataFrame:
    """sources (node, w; the last w of a node counts if there is an order column seq) to node, val that sum to 1."""
    if "seq" in sources.columns:
        sources = sources.groupBy("node").agg(F.max_by("w", "seq").alias("w"))
    total = sources.agg(F.sum("w").alias("total"))
    share = F.when(F.col("total") == 0, F.raise_error(F.lit("source weights sum to zero"))).otherwise(F.col("w") / F.col("total"))
    return sources.join(F.broadcast(total)).select("node", share.alias("val"))  # total is one row


def out_steps(graph: Graph, weighted: bool = True) -> DataFrame:
    """node, dst, p, degree: dst is null in the row that stands for the vertex itself; -1 and vertices without edges
    have that row too, and the latter a row to -1."""
    moves = graph.transitions() if weighted else graph.edges
    degree = graph.edges.groupBy("src").agg(F.count("*").alias("degree"))
    moves = moves.join(degree, "src").select(F.col("src").alias("node"), "dst", (F.col("p") if weighted else 1.0 / F.col("degree")).alias("p"), "degree")
    own = graph.vertices.join(degree, F.col("node") == F.col("src"), "left").select("node", F.lit(None).cast("long").alias("dst"), F.lit(0.0).alias("p"), F.coalesce("degree", F.lit(0)).alias("degree"))
    dangling = own.where("degree = 0").withColumns({"dst": F.lit(SINK).cast("long"), "p": F.lit(1.0)})
    sink = graph.edges.sparkSession.range(1).select(F.lit(SINK).cast("long").alias("node"), F.lit(None).cast("long").alias("dst"), F.lit(0.0).alias("p"), F.lit(0).cast("long").alias("degree"))
    return moves.unionByName(own).unionByName(dangling).unionByName(sink)


def kept_steps(graph: Graph, weighted: bool = True) -> DataFrame:
    """out_steps, dealt out by vertex once and kept: rounds move the state alone. spark.catalog.clearCache() lets go of it."""
    return out_steps(graph, weighted).repartition("node").persist()


def initial(sources: DataFrame) -> DataFrame:
    return sources.select("node", F.lit(0.0).alias("pi"), F.col("val").alias("r"))


def pushed(state: DataFrame, steps: DataFrame, alpha: float, active, kept_share) -> DataFrame:
    """One synchronous round: active vertices keep kept_share * r as estimate and hand (1 - alpha) * r on."""
    j = state.join(steps, "node")
    gives, stays = F.when(active, F.col("r")).otherwise(0.0), F.when(active, 0.0).otherwise(F.col("r"))
    own, to_sink = F.col("dst").isNull(), F.col("dst") == SINK
    sink = F.col("node") == SINK
    moved = gives * (1 - alpha) * F.col("p")
    return j.select(
        F.when(own, F.col("node")).otherwise(F.col("dst")).alias("node"),
        F.when(own, F.col("pi") + F.when(sink, 0.0).otherwise(gives * kept_share)).when(to_sink, moved).otherwise(0.0).alias("pi"),
        F.when(own, stays).when(to_sink, 0.0).otherwise(moved).alias("r"),
    ).groupBy("node").agg(F.sum("pi").alias("pi"), F.sum("r").alias("r"))


def exact(graph: Graph, sources: DataFrame, count: int, alpha: float = ALPHA, weighted: bool = True, flush: bool = True, steps: DataFrame | None = None) -> DataFrame:
    """node, val after count rounds of the fixpoint; what is still on its way is added where it is if flush."""
    steps = kept_steps(graph, weighted) if steps is None else steps
    state, _, _ = rounds(initial(sources), lambda s: pushed(s, steps, alpha, F.lit(True), F.lit(alpha)), count)
    return state.select("node", (F.col("pi") + F.col("r") if flush else F.col("pi")).alias("val")).where("val <> 0")


def forward_push(graph: Graph, sources: DataFrame, threshold: float, max_rounds: int, alpha: float = ALPHA, weighted: bool = True, until_done: bool = True) -> DataFrame:
    """node, pi, r: vertices with r > degree * threshold push, dangling ones whenever r > 0, until none does."""
    steps = kept_steps(graph, weighted)
    active = F.col("r") > F.col("degree") * F.lit(threshold)
    degree = steps.where("dst IS NULL").select("node", "degree")
    idle = lambda old, new: new.join(degree, "node").where(active & (F.col("node") != SINK)).isEmpty()
    state, _, _ = rounds(initial(sources), lambda s: pushed(s, steps, alpha, active & (F.col("node") != SINK), F.lit(alpha)), max_rounds, done=idle if until_done else None)
    return state


def residue_walkers(state: DataFrame, walks: int) -> DataFrame:
    """ceil(r * walks) walkers at each vertex with residue, sharing it."""
    n = F.ceil(F.col("r") * walks).cast("long")
    left = state.where((F.col("r") > 0) & (F.col("node") != SINK)).select("node", "r", n.alias("n"))
    return left.select("node", "r", "n", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i")).select(F.concat_ws("_", "node", "i").alias("walk_id"), F.col("node").alias("start"), (F.col("r") / F.col("n")).alias("weight"))


def fora(graph: Graph, sources: DataFrame, walks: int = WALKS, alpha: float = ALPHA, weighted: bool = True, seed: int = 1, max_rounds: int = 100, max_steps: int = 60) -> DataFrame:
    """node, val: push down to degree / (alpha * walks), then walks from the residues."""
    require_positive(sources)
    state = cut(forward_push(graph, sources, 1.0 / (alpha * walks), max_rounds, alpha, weighted))
    ended = ends(paths(graph, residue_walkers(state, walks), alpha, seed, weighted, max_steps=max_steps))
    both = state.select("node", F.col("pi").alias("val")).unionByName(ended.select("node", F.col("weight").alias("val")))
    return both.groupBy("node").agg(F.sum("val").alias("val")).where("val <> 0")


def full_path(graph: Graph, sources: DataFrame, walks: int = WALKS, alpha: float = ALPHA, weighted: bool = True, seed: int = 1, max_rounds: int = 100, max_steps: int = 60, compat: bool = False) -> DataFrame:
    """node, val: every visit of a walk counts, by push and then walks. The shares sum to 1; with compat the walks'
    starts enter the divisor once more."""
    require_positive(sources)
    steps = kept_steps(graph, weighted)
    # a vertex hands on when more than degree / alpha of `walks` walkers stand there
    active = (F.col("r") > F.col("degree") * F.lit(1.0 / (alpha * walks))) & (F.col("node") != SINK)
    degree = steps.where("dst IS NULL").select("node", "degree")
    idle = lambda old, new: new.join(degree, "node").where(active).isEmpty()
    state, _, _ = rounds(initial(sources), lambda s: pushed(s, steps, alpha, active, F.lit(1.0)), max_rounds, done=idle)
    state = cut(state)
    seen = paths(graph, residue_walkers(state, walks), alpha, seed, weighted, max_steps=max_steps)
    visits = state.select("node", F.col("pi").alias("val")).unionByName(seen.select("node", F.col("weight").alias("val"))).groupBy("node").agg(F.sum("val").alias("val"))
    if compat:
        again = state.where(F.col("node") != SINK).agg(F.sum("r").alias("again"))
        sums = visits.agg(F.sum("val").alias("total")).join(F.broadcast(again))  # one row
    else:
        sums = visits.agg(F.sum("val").alias("total")).withColumn("again", F.lit(0.0))
    return visits.where("val > 0").join(F.broadcast(sums)).select("node", (F.col("val") / (F.col("total") + F.coalesce("again", F.lit(0.0)))).alias("val"))


def require_positive(sources: DataFrame) -> None:
    if not sources.where("val < 0").isEmpty():
        raise ValueError("sampling needs sources of weight zero or more")
