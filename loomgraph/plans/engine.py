"""The engine: analyze and adjust for each user, over one graph."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import catalog, ppr, ranking, vectors
from loomgraph.operators.centrality import degree_share
from loomgraph.operators.graph import Graph
from loomgraph.operators.iterate import cut

TOP, ROUNDS = 100, 20


class Engine:
    """Sessions are written tables by user key; they last as long as this object and can be forgotten."""

    def __init__(self, graph: Graph, nodes: DataFrame | None = None, rounds: int = ROUNDS, alpha: float = ppr.ALPHA, mode: str = "exact", walks: int = ppr.WALKS):
        if not graph.spec.weighted or graph.spec.item_count is None:
            raise ValueError("the engine needs a weighted graph with items")
        self.graph, self.nodes, self.rounds, self.alpha, self.mode, self.walks = graph, nodes, rounds, alpha, mode, walks
        self.steps = ppr.kept_steps(graph)
        self.popularity = vectors.normalise(degree_share(graph))
        self.ready = False
        self.sessions: dict[str, tuple[DataFrame, DataFrame]] = {}

    def prepare(self) -> "Engine":
        """Makes what every request uses; ready afterwards."""
        self.popularity, self.ready = cut(self.popularity), self.steps.count() > 0
        return self

    def scores(self, sources: DataFrame) -> DataFrame:
        if self.mode == "exact":
            return ppr.exact(self.graph, sources, self.rounds, self.alpha, steps=self.steps)
        return ppr.fora(self.graph, sources, self.walks, self.alpha)

    def analyze(self, user: str, sources: DataFrame, keep: bool = True) -> DataFrame:
        """rk, node, val: the best items for sources (node, w, [seq]), at cosine 0 with popularity."""
        given = ppr.normalised(sources)
        found = ranking.exclude(self.scores(given), given)
        if keep:
            found, given = cut(found), cut(given)
            self.sessions[user] = (found, given)
        return self.steered(found, given, 0.0)

    def adjust(self, user: str, c: float) -> DataFrame:
        """The same with cosine c, from the user's last analyze."""
        if user not in self.sessions:
            raise LookupError(f"no analyze by {user!r} before")
        found, given = self.sessions[user]
        if found.isEmpty():
            raise LookupError(f"{user!r} has no scores to adjust")
        return self.steered(found, given, c if isinstance(c, (int, float)) and math.isfinite(c) else 0.0)

    def steered(self, found: DataFrame, given: DataFrame, c: float) -> DataFrame:
        moved = ranking.exclude(vectors.adjust(found, self.popularity, c), given)
        return ranking.top_items(canonical(moved), self.graph.spec.item_count, TOP)

    def forget(self, user: str) -> None:
        self.sessions.pop(user, None)

    def handle(self, request: dict) -> DataFrame:
        """A request as a mapping: type analyze (userKey, queries of {id, w}) or adjust (userKey, c)."""
        kind = request.get("type")
        if kind == "analyze":
            rows = [(int(q["id"]), float(q["w"]), i) for i, q in enumerate(request.get("queries") or [])]
            if not rows:
                raise ValueError("no node is known")
            if any(not math.isfinite(w) for _, w, _ in rows):
                raise ValueError("a weight isn't a finite number")
            return self.analyze(request["userKey"], self.graph.edges.sparkSession.createDataFrame(rows, "node long, w double, seq int"))
        if kind == "adjust":
            return self.adjust(request["userKey"], request["c"])
        raise ValueError(f"unknown type {kind!r}")

    def respond(self, request: dict) -> dict:
        """handle, as a reply: {'status': 'ok', 'items': [...]} or {'status': 'error', 'message': ...}."""
        try:
            return {"status": "ok", "items": [{"id": r["node"], "score": r["val"]} for r in self.handle(request).orderBy("rk").collect()]}  # at most TOP rows
        except Exception as e:  # every failure becomes a reply
            return {"status": "error", "message": str(e)}

    def request(self, body: dict, user: str) -> DataFrame:
        """A body with a numeric c, or with items of {name, weight}, blacklistIds and locale: ranking with metadata."""
        if isinstance(body.get("c"), (int, float)) and not isinstance(body.get("c"), bool):
            return catalog.with_metadata(self.adjust(user, body["c"]), self.nodes)
        if not body.get("items"):
            raise ValueError("neither c nor items")
        spark = self.graph.edges.sparkSession
        items = spark.createDataFrame([(i["name"], None if i.get("weight") is None else float(i["weight"]), k) for k, i in enumerate(body["items"])], "name string, weight double, seq int")
        excluded = spark.createDataFrame([(str(x),) for x in body.get("blacklistIds") or []], "id string")
        sources = catalog.with_exclusions(catalog.lookup(self.nodes, items, body.get("locale", "en")), excluded)
        if sources.isEmpty():
            raise LookupError("no node is known")
        return catalog.with_metadata(self.analyze(user, sources), self.nodes)


def canonical(scores: DataFrame, places: int = 12) -> DataFrame:
    """Scores without the noise of summation order, so that ties are ties."""
    s = 10.0**places
    return scores.withColumn("val", F.floor(F.col("val") * s + 0.5) / s)
