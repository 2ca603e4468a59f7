"""Hand graphs, properties and files."""

import json
import math

import pytest

from loomgraph.functions import scalars
from loomgraph.operators import catalog, centrality, metrics, ppr, ranking, vectors, walks
from loomgraph.operators.graph import Graph, GraphSpec
from loomgraph.plans.engine import Engine
from loomgraph.sources import files
from loomgraph.streaming.requests import serve


def graph(spark, edges, n, directed=False, item_count=None, how="first"):
    rows = spark.createDataFrame([(s, d, float(w), i) for i, (s, d, w) in enumerate(edges)], "src long, dst long, w double, seq long")
    return Graph.build(rows, GraphSpec(n=n, directed=directed, item_count=item_count), how)


def vec(spark, values):
    return spark.createDataFrame([(k, float(v)) for k, v in values.items()], "node long, val double")


def read(df):
    return {r["node"]: r["val"] for r in df.collect()}


PATH = [(0, 1, 1), (1, 2, 1), (2, 3, 1)]
BIPARTITE = [(0, 2, 5), (0, 3, 3), (1, 3, 4), (1, 4, 1)]


def test_first_edge_wins_and_loops_go(spark):
    g = graph(spark, [(0, 1, 5), (1, 0, 7), (2, 2, 1), (0, 1, 9), (1, 2, 1)], 3)
    assert {tuple(r) for r in g.edges.collect()} == {(0, 1, 5.0), (1, 0, 5.0), (1, 2, 1.0), (2, 1, 1.0)}
    assert g.edge_count().first()[0] == 2
    with pytest.raises(ValueError):
        graph(spark, [(0, 1, 1), (0, 1, 2)], 2, how="error")
    with pytest.raises(ValueError):
        graph(spark, [(0, 9, 1)], 2).validate()


def test_empty_and_isolated(spark):
    g = Graph.empty(spark, GraphSpec(n=3))
    assert [tuple(r) for r in g.degrees().orderBy("node").collect()] == [(0, 0, 0.0), (1, 0, 0.0), (2, 0, 0.0)]
    assert read(ppr.exact(g, vec(spark, {1: 1}), 5)) == pytest.approx({1: 0.2, -1: 0.8})
    dist = {r["node"]: r["dist"] for r in centrality.shortest(graph(spark, PATH, 5), 0).collect()}
    assert dist == {0: 0, 1: 1, 2: 2, 3: 3, 4: centrality.UNREACHABLE}


def test_mutation(spark):
    g = graph(spark, PATH, 4)
    new = spark.createDataFrame([(0, 3, 2.0), (1, 0, 9.0)], "src long, dst long, w double")
    bigger, told = g.insert(new)
    assert {(r["src"], r["dst"]): r["inserted"] for r in told.collect()} == {(0, 3): 2, (1, 0): 0}
    assert bigger.edge_count().first()[0] == 4 and bigger.transition(0, 1) == pytest.approx(1 / 3)
    smaller, told = bigger.remove(new)
    assert sorted(r["removed"] for r in told.collect()) == [2, 2] and smaller.edge_count().first()[0] == 2
    with pytest.raises(KeyError):
        smaller.transition(0, 3)


def test_dangling_mass(spark):
    g = graph(spark, [(0, 1, 1), (0, 2, 3)], 3, directed=True)
    got = read(ppr.exact(g, vec(spark, {0: 1}), 10))
    assert got == pytest.approx({0: 0.2, 1: 0.04, 2: 0.12, -1: 0.64})
    assert sum(read(ppr.full_path(g, vec(spark, {0: 1}), 1000)).values()) == pytest.approx(1)
    assert sum(read(ppr.full_path(g, vec(spark, {0: 1}), 3, compat=True)).values()) < 1


def test_push_keeps_mass_and_ends_below_threshold(spark):
    g = graph(spark, BIPARTITE, 5)
    state = ppr.forward_push(g, vec(spark, {0: 0.5, 1: 0.5}), 1e-3, 100).join(g.degrees(), "node")
    rows = state.collect()
    assert sum(r["pi"] + r["r"] for r in rows) == pytest.approx(1)
    assert all(r["r"] <= r["degree"] * 1e-3 for r in rows)


def test_sampling_is_near_exact(spark):
    g = graph(spark, BIPARTITE, 5).persist()
    exact = read(ppr.exact(g, vec(spark, {0: 1}), 60))
    near = read(ppr.fora(g, vec(spark, {0: 1}), 2000))
    assert sum(abs(exact.get(k, 0) - near.get(k, 0)) for k in exact) < 0.02
    drawn = read(walks.monte_carlo(g, spark.createDataFrame([(0,)], "node long"), 2000))
    assert sum(abs(exact.get(k, 0) - drawn.get(k, 0)) for k in exact) < 0.1
    with pytest.raises(ValueError):
        ppr.fora(g, vec(spark, {0: -1}), 10)


def test_walks_take_a_first_step(spark):
    g = graph(spark, PATH, 4)
    start = walks.walkers(spark.createDataFrame([(0,)], "node long"), 50)
    forced = walks.paths(g, start, stop_first=False)
    assert forced.where("step = 1 AND node = 1").count() == 50
    assert walks.paths(g, start).where("step = 1").count() < 50


def test_stationary_share_of_a_path_does_not_converge(spark):
    r = centrality.pagerank(graph(spark, PATH, 4), 0.0, max_rounds=4, tolerance=1e-9)
    assert not r.converged and r.rounds == 4
    assert centrality.pagerank(graph(spark, PATH, 4), 0.2, tolerance=1e-3).converged


def test_costs_skip_bad_weights(spark):
    g = graph(spark, [(0, 1, 0), (1, 2, -1), (0, 2, 4)], 3, directed=True)
    assert {r["node"]: r["dist"] for r in centrality.shortest(g, 0, by_weight=True).collect()} == {0: 0, 1: centrality.UNREACHABLE, 2: 0.25}


@pytest.mark.parametrize("s", [-0.9, -0.3, 0.0, 0.5, 5.0])
def test_adjuster_sets_the_cosine(spark, s):
    u, d = vec(spark, {0: 0.5, 1: 0.2, 2: 0.1}), vec(spark, {0: 0.1, 1: 0.6, 2: 0.2, 3: 0.1})
    out = vectors.adjust(u, d, s)
    held = max(-vectors.LIMIT, min(vectors.LIMIT, s))
    assert vectors.cosine(out, d).first()[0] == pytest.approx(held, abs=1e-9)
    p = vectors.projection(u, d).first()[0]
    assert vectors.norm(out).first()[0] ** 2 == pytest.approx((1 - p * p) / (1 - held * held))


def test_vector_algebra(spark):
    a, b = vec(spark, {1: 3, 2: 4}), vec(spark, {2: 4, 3: 0})
    assert read(vectors.subtract(a, b)) == {1: 3.0}
    assert vectors.norm(a).first()[0] == 5 and vectors.dot(a, b).first()[0] == 16
    assert vectors.dot(vectors.orthogonal(a, vec(spark, {1: 1, 2: 1})), vec(spark, {1: 1, 2: 1})).first()[0] == pytest.approx(0)
    with pytest.raises(Exception, match="zero vector"):
        vectors.normalise(vec(spark, {1: 0})).collect()
    mixed = {1: 3.0, 2: -1.0, 3: 0.0, 4: 3.0, 5: -1e-9, 6: 1e-9}
    assert [r["node"] for r in ranking.ranks(vec(spark, mixed)).orderBy("rk").collect()] == [1, 4, 6, 3, 5, 2]
    assert [r["node"] for r in ranking.ranked(vec(spark, {5: 1.0, 3: 1.0, 9: 0.5})).collect()] == [3, 5, 9]


def test_measures_of_equal_rankings(spark):
    x = vec(spark, {k: 1 / (k + 1) for k in range(5)} | {-1: 9})
    assert metrics.ndcg(x, x, 5).first()[0] == pytest.approx(1)
    assert metrics.spearman(x, x, 5).first()[0] == pytest.approx(1)
    assert metrics.ap_correlation(x, x, 5).first()[0] == pytest.approx(1)
    assert metrics.ap_correlation(x, x, 5, compat=True).first()[0] == pytest.approx(0.278, abs=1e-3)
    assert metrics.ap_correlation(x, x, 2, compat=True).first()[0] is None


NODES = [(0, "Red Moon", "赤い月", 2, 1999), (1, "red sun", None, 1, None), (2, "Old Red", None, None, 0)]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(NODES, "id long, name string, title_ja string, ranking int, year int")


def test_names(spark, nodes):
    assert [r["title"] for r in catalog.suggest(nodes, "RED").collect()] == ["red sun", "Red Moon", "Old Red"]
    assert [r["title"] for r in catalog.suggest(nodes, "赤い", "ja").collect()] == ["赤い月"]
    assert catalog.suggest(nodes, "r").count() == 0
    many = spark.range(30).selectExpr("id", "concat('ab', id) name", "cast(null AS string) title_ja", "cast(id AS int) ranking", "cast(null AS int) year")
    assert [r["title"] for r in catalog.suggest(many, "AB").collect()] == [f"ab{i}" for i in range(10)]
    chosen = catalog.with_exclusions(spark.createDataFrame([(1, 2.0), (2, 1.0)], "node long, w double"), spark.createDataFrame([("1",), ("x",), ("2.5",)], "id string"))
    assert {r["node"]: r["w"] for r in chosen.collect()} == {1: 0.0, 2: 1.0}
    with pytest.raises(Exception, match="sum to zero"):
        ppr.normalised(spark.createDataFrame([(1, 0.0)], "node long, w double")).collect()


def test_engine(spark, nodes):
    e = Engine(graph(spark, BIPARTITE, 5, item_count=2), nodes).prepare()
    with pytest.raises(LookupError):
        e.adjust("a", 0.0)
    first = [tuple(r) for r in e.handle({"type": "analyze", "userKey": "a", "queries": [{"id": 2, "w": 1}]}).collect()]
    assert [tuple(r) for r in e.adjust("a", 0.0).collect()] == first and {r[1] for r in first} == {0, 1}
    body = {"items": [{"name": "Red Moon", "weight": 1}], "blacklistIds": ["1", "zz"], "locale": "en"}
    assert e.request(body, "b").count() == 0  # both items are sources
    assert [r["name"] for r in e.request({"items": [{"name": "Red Moon"}]}, "b").collect()] == ["red sun"]
    assert [tuple(r) for r in e.adjust("a", 0.0).collect()] == first
    for bad, kind in (({"items": []}, ValueError), ({"items": [{"name": "?"}]}, LookupError)):
        with pytest.raises(kind):
            e.request(bad, "c")
    assert e.respond({"type": "?"})["status"] == "error"
    assert e.respond({"type": "analyze", "userKey": "n", "queries": [{"id": 1, "w": math.nan}]})["status"] == "error"


def test_request_stream(spark, nodes, tmp_path):
    e = Engine(graph(spark, BIPARTITE, 5, item_count=2), nodes, rounds=3)
    (tmp_path / "in").mkdir()
    lines = [{"type": "analyze", "userKey": "a", "queries": [{"id": 2, "w": 1.0}]}, {"type": "adjust", "userKey": "a", "c": 0.1}, {"type": "adjust", "userKey": "a", "c": 0.2}]
    (tmp_path / "in/x.txt").write_text("\n".join([json.dumps(x) for x in lines] + ["", "{bad"]))
    q = serve(spark, e, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    replies = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert [r["status"] for r in replies].count("ok") == 2 and [r["status"] for r in replies].count("error") == 1


def test_files(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text) and f"file://{tmp_path}/{name}"
    spec = files.read_spec(spark, put("a", "n 5\nis_directed false\nis_weighted true\nis_bipartite true\nis_dynamic false\n"), put("b", "type1 item\ntype2 user\ntype1_count 2\n"))
    assert (spec.n, spec.item_count, spec.directed, spec.bipartite) == (5, 2, False, True)
    with pytest.raises(ValueError):
        files.read_spec(spark, put("c", "n 5\nodd 1\n"))
    with pytest.raises(ValueError):
        files.read_spec(spark, put("d", "is_directed yes\n"))
    g = Graph.build(files.read_edges(spark, put("e", "0 1 5\n1 0 7\n2 2 1\n0 1 9\n1 2 1\n")), spec)
    files.write_snapshot(g, f"file://{tmp_path}/s")
    back = files.read_snapshot(spark, f"file://{tmp_path}/s", spec)
    assert {tuple(r) for r in back.edges.collect()} == {(0, 1, 5.0), (1, 0, 5.0), (1, 2, 1.0), (2, 1, 1.0)}
    plain = files.read_edges(spark, put("f", "0 1\n1 1\n1 2\n"), weighted=False)
    assert Graph.build(plain, GraphSpec(n=3, directed=True, weighted=False)).edge_count().first()[0] == 2
    titles = files.read_titles(spark, put("t", "1 A b c\n2 \n1 other\n"))
    assert {r["id"]: r["title"] for r in titles.collect()} == {1: "A b c", 2: ""}
    ids = files.read_sources(spark, put("i", "7\n8\n9\n"), 2)
    assert [tuple(r) for r in ids.orderBy("seq").collect()] == [(0, 7), (1, 8)]
    path = put("x", "7 1 0.5\n7 1 0.9\n8 2 0.1\n3 1 0.2\n7 5 0.3\n")
    assert {(r["src"], r["dst"]): r["ppr"] for r in files.read_exact(spark, path, ids).collect()} == {(7, 1): 0.5, (8, 2): 0.1}
    assert files.read_exact(spark, path, ids, prefix=False).count() == 3


def test_scalars(spark):
    row = spark.range(1).select(scalars.four_places(F_lit(-0.00001)).alias("a"), scalars.four_places(F_lit(-1.23456)).alias("b"), scalars.escape_markdown(F_lit("a*b")).alias("c")).first()
    assert tuple(row) == ("0.0000", "-1.2346", "a\\*b")


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)
