"""The registered queries over the test tables; each takes (spark, directory)."""

import uuid

from pyspark.sql import functions as F

from loomgraph.functions import explain, scalars
from loomgraph.operators import catalog, centrality, metrics, ppr, ranking, vectors, walks
from loomgraph.operators.graph import Graph, GraphSpec, cumulative, directed_by_name, slots
from loomgraph.operators.iterate import cut, scratch
from loomgraph.plans import fixtures as fx
from loomgraph.plans.engine import Engine, canonical
from loomgraph.sources import files
from loomgraph.sources.files import as_json, edge_lines, parse_requests, score_lines
from loomgraph.streaming.requests import latest_wins

K, SEED = 10, 1


def c(x, name="val", s=1e12):
    y = F.col(x) * s + 0.5
    return (F.when(F.abs(y) < 2.0**53, F.floor(y)).otherwise(y) / s).alias(name)  # floor gives longs; larger doubles are whole, and infinity stays


def pairs(spark, d):
    """Edges to look up, insert and remove: (part, customer) of equal numbers."""
    p, n, _ = fx.sizes(spark, d)
    return spark.range(min(p, n)).select(F.col("id").alias("src"), (F.col("id") + p).alias("dst"), F.lit(7.0).alias("w"))


def engine(spark, d, rounds=K):
    g = fx.shop(spark, d).persist()
    return Engine(g, fx.nodes(spark, d, g), rounds=rounds)


def ppr_vector(spark, d, rounds=K):
    return canonical(ppr.exact(fx.shop(spark, d).persist(), ppr.normalised(fx.sources(spark)), rounds))


def item_scores(spark, d):
    """Two vectors over parts, for the algebra: quantity sold, and price where a part is cheap."""
    a = fx.read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("node")).agg(F.sum("l_quantity").alias("val"))
    b = fx.read(spark, d, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("node"), F.col("p_size").cast("double").alias("val"))
    return a.where("node % 5 <> 0"), b


# ---- graphs


def edge_build_first_wins(spark, d):  # S3 S5 D2
    return fx.shop(spark, d).edges


def edge_build_sum(spark, d):  # S5
    return fx.shop(spark, d, "sum").edges


def edge_symmetrize(spark, d):  # G13
    g = fx.shop(spark, d)
    back = g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("back"))
    return g.edges.join(back, ["src", "dst"], "left").agg(F.count("*").alias("n"), F.sum((F.col("w") == F.col("back")).cast("int")).cast("long").alias("symmetric"))


def edge_count(spark, d):  # G1 G2 G14
    g = fx.shop(spark, d)
    return g.edge_count().join(F.broadcast(g.memory_kb())).withColumn("nodes", F.lit(g.node_count()).cast("long"))  # one row each


def self_loop_drop_transitions(spark, d):  # S2
    return fx.moves(spark, d).edges


def degree(spark, d):  # G3
    return fx.supply(spark, d).degrees().select("node", "degree")


def weighted_degree(spark, d):  # G11
    return fx.shop(spark, d).degrees().select("node", "weighted_degree")


def transition_prob(spark, d):  # G10 G12
    return fx.moves(spark, d).transitions().select("src", "dst", c("p", "p"))


def sampling_slices(spark, d):  # G15 G16 G17
    g = fx.moves(spark, d)
    return cumulative(g.edges).join(slots(g.edges), ["src", "dst"]).select("src", "dst", "lo", "hi", "total", "slot", "degree")


def degree_centrality(spark, d):  # P14
    return centrality.degree_share(fx.supply(spark, d), weighted=False).select("node", c("val"))


def weighted_degree_centrality(spark, d):  # P15
    return centrality.degree_share(fx.shop(spark, d)).select("node", c("val"))


def neighbors(spark, d):  # G4
    return fx.shop(spark, d).neighbours(3)


def has_edge(spark, d):  # G5
    return fx.shop(spark, d).has_edges(pairs(spark, d).select("src", "dst"))


def insert_edges(spark, d):  # G6 G7
    g, told = fx.shop(spark, d).insert(pairs(spark, d))
    return g.transitions().select("src", "dst", "w", c("p", "p")).join(told, ["src", "dst"], "left").withColumn("inserted", F.coalesce("inserted", F.lit(-1)))


def remove_edges(spark, d):  # G8 G9
    g, _ = fx.shop(spark, d).remove(pairs(spark, d))
    return g.transitions().select("src", "dst", "w", c("p", "p"))


def dataset_direction(spark, d):  # G18
    return directed_by_name(fx.read(spark, d, "region").select(F.lower("r_name").alias("name")).unionByName(spark.createDataFrame([("orkut",), ("web-berkstan",)], "name string")))


def item_degree_rank(spark, d):  # K6 K2
    g = fx.shop(spark, d)
    return ranking.rank_of_items(centrality.degree_share(g), g.spec.item_count)


def print_ranking(spark, d):  # K7 K8 K1 S9
    g = fx.shop(spark, d).persist()
    top = ranking.top_items(ppr_vector(spark, d), g.spec.item_count, 50)
    titles = fx.nodes(spark, d, g).where("id % 4 <> 0").select("id", F.col("name").alias("title"))
    ranks = ranking.rank_of_items(centrality.degree_share(g), g.spec.item_count)
    return ranking.with_titles(top, titles, ranks)


# ---- personalised PageRank and walks


def ppr_exact_single(spark, d):  # P4
    one = spark.createDataFrame([(3, 1.0)], "node long, val double")
    return ppr.exact(fx.shop(spark, d).persist(), one, K).select("node", c("val"))


def ppr_exact_multi(spark, d):  # P1 P5
    return ppr_vector(spark, d)


def ppr_exact_unweighted(spark, d):  # P2 P5
    return ppr.exact(fx.shop(spark, d).persist(), ppr.normalised(fx.sources(spark)), K, weighted=False).select("node", c("val"))


def ppr_blacklist(spark, d):  # A6 K4
    excluded = spark.createDataFrame([(str(x),) for x in (*fx.EXCLUDED, "x", "2.5", 17)], "id string")
    given = ppr.normalised(catalog.with_exclusions(fx.sources(spark).select("node", "w"), excluded))
    found = ppr.exact(fx.shop(spark, d).persist(), given, K)
    return ranking.exclude(found, given).select("node", c("val"))


def ppr_dangling(spark, d):  # D5 P5 on dangling vertices
    return ppr.exact(fx.supply(spark, d).persist(), ppr.normalised(fx.sources(spark)), K).select("node", c("val"))


def forward_push_rounds(spark, d):  # P2 P3
    state = ppr.forward_push(fx.shop(spark, d).persist(), ppr.normalised(fx.sources(spark)), 1e-5, 6, until_done=False)
    return state.select("node", c("pi", "pi"), c("r", "r"))


def forward_push_unweighted(spark, d):  # P2
    state = ppr.forward_push(fx.supply(spark, d).persist(), ppr.normalised(fx.sources(spark)), 1e-5, 6, weighted=False, until_done=False)
    return state.select("node", c("pi", "pi"), c("r", "r"))


def some_walkers(spark, n=100):
    return walks.walkers(fx.sources(spark).select("node"), n)


def walk_paths(spark, d):  # W1 W6
    return walks.paths(fx.supply(spark, d), some_walkers(spark), seed=SEED).select("walk_id", "step", "node")


def walk_paths_min1(spark, d):  # W2
    return walks.paths(fx.supply(spark, d), some_walkers(spark), seed=SEED, stop_first=False, weighted=False).select("walk_id", "step", "node")


def walk_end_nodes(spark, d):  # W3 W4
    return walks.ends(walks.paths(fx.shop(spark, d), some_walkers(spark), seed=SEED)).select("walk_id", "node")


def ppr_monte_carlo(spark, d):  # W5
    return walks.monte_carlo(fx.shop(spark, d), fx.sources(spark).select("node"), 200, seed=SEED).select("node", c("val"))


def fora(spark, d):  # P5
    return ppr.fora(fx.shop(spark, d).persist(), ppr.normalised(fx.sources(spark)), 2000, max_rounds=40, max_steps=40).select("node", c("val", s=1e9))


def fora_full_path(spark, d):  # P6 P7 P8 P9
    return ppr.full_path(fx.shop(spark, d).persist(), ppr.normalised(fx.sources(spark)), 2000, max_rounds=40, max_steps=40).select("node", c("val", s=1e9))


# ---- centrality and paths


def pagerank(spark, d):  # P10
    return centrality.pagerank(fx.shop(spark, d).persist(), 0.2, False, K).values.select("node", c("val"))


def pagerank_weighted(spark, d):  # P11
    return centrality.pagerank(fx.shop(spark, d).persist(), 0.2, True, K).values.select("node", c("val"))


def pagerank_dangling(spark, d):  # P10 P11
    return centrality.pagerank(fx.supply(spark, d).persist(), 0.2, True, K).values.select("node", c("val"))


def stationary_alpha0(spark, d):  # P12 P13
    return centrality.pagerank(fx.moves(spark, d).persist(), 0.0, True, K).values.select("node", c("val"))


def bfs_hops(spark, d):  # P16
    return centrality.shortest(fx.supply(spark, d).persist(), fx.sizes(spark, d)[0] + 5)


def shortest_inverse_weight(spark, d):  # P17
    return centrality.shortest(fx.shop(spark, d).persist(), 3, by_weight=True).select("node", c("dist", "dist", 1e9))


# ---- vectors


def dot(spark, d):  # V1
    return vectors.dot(*item_scores(spark, d))


def l2(spark, d):  # V2
    return vectors.norm(item_scores(spark, d)[0]).select(c("val", s=1e6))


def scale(spark, d):  # V3
    return vectors.scale(item_scores(spark, d)[1], 2.5)


def vec_subtract(spark, d):  # V4
    a, b = item_scores(spark, d)
    return vectors.subtract(a, b.unionByName(a.where("node % 15 = 3").join(b, "node", "left_anti")))


def vec_normalise(spark, d):  # V5
    return vectors.normalise(item_scores(spark, d)[0]).select("node", c("val", s=1e9))


def orthogonal_component(spark, d):  # V6
    return vectors.orthogonal(*item_scores(spark, d)).select("node", c("val", s=1e6))


def cosine(spark, d):  # V7 V9
    return vectors.cosine(*item_scores(spark, d)).select(c("val", s=1e9))


def adjusted(s):
    def query(spark, d):
        g = fx.shop(spark, d).persist()
        found = cut(ranking.exclude(ppr_vector(spark, d), fx.sources(spark)))
        return vectors.adjust(found, centrality.degree_share(g), s).select("node", c("val", s=1e9))

    return query


# ---- the engine


def analyze_top100(spark, d):  # E1 E2 K3 A7 K10 Q1
    e = engine(spark, d)
    return catalog.with_metadata(e.analyze("u", fx.sources(spark)), e.nodes).withColumn("val", c("val", s=1e9))


def adjust_top100(spark, d):  # E3 D11
    e = engine(spark, d)
    e.analyze("u", fx.sources(spark))
    return e.adjust("u", 0.4).select("rk", "node", c("val", s=1e9))


def visible_top10(spark, d):  # K9 A6b
    e = engine(spark, d)
    full = catalog.with_metadata(e.analyze("u", fx.sources(spark)), e.nodes).where("rk <= 60")
    gone = catalog.drop_excluded(catalog.add_excluded(full.where("rk % 5 = 0").select("node"), full.where("rk IN (1, 5)").select("node")), full.where("rk = 10").select("node"))
    return ranking.visible(full.select("rk", "node", "name"), gone, full.where("rk IN (2, 3)").select("name"))


def response_json(spark, d):  # S15 D12
    e = engine(spark, d)
    top = e.analyze("u", fx.sources(spark)).where("rk <= 20").select("rk", "node", F.lit(0.5).alias("val"))
    return as_json(top)


# ---- measures


def console_lines(spark, d):  # S16
    scores = fx.read(spark, d, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") / 2).alias("val"))
    return edge_lines(fx.moves(spark, d)).unionByName(score_lines(scores))


def two_rankings(spark, d):
    g = fx.shop(spark, d).persist()
    given = ppr.normalised(fx.sources(spark))
    steps = ppr.kept_steps(g)
    return cut(canonical(ppr.exact(g, given, 3, steps=steps))), cut(canonical(ppr.exact(g, given, 20, steps=steps)))


def dcg(spark, d):  # M1 M2
    a, b = two_rankings(spark, d)
    return metrics.gain(metrics.places(a, 100), b).select(c("val", s=1e9))


def ndcg(spark, d):  # M3
    return metrics.ndcg(*two_rankings(spark, d), 100).select(c("val", s=1e9))


def spearman_topk(spark, d):  # M4
    return metrics.spearman(*two_rankings(spark, d), 100).select(c("val", s=1e9))


def ap_corr(spark, d):  # M5
    return metrics.ap_correlation(*two_rankings(spark, d), 100).select(c("val", s=1e9))


def ap_corr_compat(spark, d):  # M5
    return metrics.ap_correlation(*two_rankings(spark, d), 100, compat=True).select(c("val", s=1e9))


def ap_symmetric(spark, d):  # M6
    return metrics.ap_symmetric(*two_rankings(spark, d), 100).select(c("val", s=1e9))


def time_stamps(spark, d):  # M7
    return fx.read(spark, d, "orders").select("o_orderkey", metrics.stamp(F.col("o_orderdate")).alias("stamp"), F.floor(metrics.elapsed(F.lit("1992-01-01").cast("timestamp_ntz"), F.col("o_orderdate"))).alias("elapsed"))


# ---- names


def suggest_prefix(spark, d):  # A1 A4
    return catalog.suggest(fx.nodes(spark, d, fx.shop(spark, d)), "RE")


def suggest_substring(spark, d):  # A2
    return catalog.suggest(fx.nodes(spark, d, fx.shop(spark, d)), "g #1")


def suggest_ja(spark, d):  # A3
    return catalog.suggest(fx.nodes(spark, d, fx.shop(spark, d)), "brand#1", "ja")


def wanted_items(spark, d):
    p = fx.read(spark, d, "part").select(F.concat("p_name", F.lit(" #"), F.col("p_partkey").cast("string")).alias("name"), F.when(F.col("p_partkey") % 2 == 0, 3.0).alias("weight"), F.col("p_partkey").cast("int").alias("seq"))
    return p.unionByName(p.where("seq % 2 = 0").withColumns({"seq": F.col("seq") + 100000, "weight": F.lit(9.0)})).unionByName(spark.createDataFrame([("no such name", 1.0, 5)], "name string, weight double, seq int"))


def name_lookup(spark, d):  # A5 A16
    return catalog.lookup(fx.nodes(spark, d, fx.shop(spark, d)), wanted_items(spark, d)).select("node", "w")


def known_names(spark, d):  # A15
    return catalog.known_names(wanted_items(spark, d).select("name"), fx.nodes(spark, d, fx.shop(spark, d)))


def metadata_join(spark, d):  # A7 A19 S13
    g = fx.shop(spark, d)
    ids = spark.range(g.spec.n).select((F.col("id") + 1).cast("int").alias("rk"), F.col("id").alias("node"), F.lit(0.5).alias("val"))
    return catalog.with_metadata(ids, fx.nodes(spark, d, g))


def display_label(spark, d):  # A19
    p = fx.read(spark, d, "part")
    return p.select("p_partkey", scalars.year_label(F.col("p_name"), F.when(F.col("p_partkey") % 4 == 0, None).when(F.col("p_partkey") % 4 == 1, 0).otherwise(F.col("p_size"))).alias("label"))


# ---- words and requests


def ranked_rows(spark, d):
    return fx.read(spark, d, "part").select((F.col("p_partkey") + 1).alias("rk"), F.concat(F.col("p_name"), F.lit(" *#"), F.col("p_partkey").cast("string")).alias("name"), (F.col("p_size") / 64.0 - 0.25).alias("val"))


def explain_offline(spark, d):  # A12
    return explain.offline(ranked_rows(spark, d))


def prompt_text(spark, d):  # A13
    return explain.prompt(ranked_rows(spark, d).where("rk <= 3").select(F.col("rk").alias("seq"), "name"), ranked_rows(spark, d).where("rk BETWEEN 4 AND 9"), "ja")


def request_lines(spark, d):
    """JSON lines of events: clicks analyze, views adjust, others are of no known type."""
    e = fx.read(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "analyze").when(F.col("event_type") == "view", "adjust").otherwise("other")
    value = F.to_json(F.struct(kind.alias("type"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("userKey"), F.array(F.struct(F.col("event_id").alias("id"), F.lit(1.0).alias("w"))).alias("queries"), F.col("value").alias("c")))
    return e.select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 17 == 0, F.lit("  ")).when(F.col("event_id") % 19 == 0, F.lit("{oops")).otherwise(value).alias("value"))


def json_requests(spark, d):  # S14 D12 E4 E5
    r = parse_requests(request_lines(spark, d))
    return r.select("seq", "type", "userKey", F.get("queries", F.lit(0))["id"].alias("first_id"), "c", "ok")


def latest_adjust(spark, d):  # A17
    return latest_wins(parse_requests(request_lines(spark, d)).where("ok")).select("seq", "userKey", "type")


def session_key(spark, d):  # A9
    cust = fx.read(spark, d, "customer")
    f, h = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).when(F.col("c_custkey") % 3 == 1, F.lit("  ")), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), "c_mktsegment"))
    return cust.select("c_custkey", scalars.session_key(f, h).alias("key"))


def slider_clamp(spark, d):  # A8
    cust = fx.read(spark, d, "customer")
    x = F.when(F.col("c_custkey") % 5 == 0, F.lit(float("nan"))).when(F.col("c_custkey") % 5 == 1, F.lit(float("inf"))).when(F.col("c_custkey") % 5 == 2, None).otherwise(F.col("c_acctbal") / 4096)
    return cust.select("c_custkey", scalars.clamp_slider(x).alias("c"))


# ---- files: what a query writes it reads back


def written(lines):
    """The path of a new folder of text files with these lines (value)."""
    path = f"{scratch(lines.sparkSession)}/lines-{uuid.uuid4().hex}"
    lines.write.text(path)
    return path


def edge_text_scan(spark, d):  # S2 S3
    looped = fx.moves(spark, d).edges.select(F.concat_ws(" ", F.col("src").cast("string"), F.col("src").cast("string"), F.lit("1.0")).alias("value"))
    return files.read_edges(spark, written(edge_lines(fx.moves(spark, d)).unionByName(looped))).select("src", "dst", "w")


def header_scan(spark, d):  # S1 S10 G20
    p, n, _ = fx.sizes(spark, d)
    lines = lambda *x: written(spark.createDataFrame([(v,) for v in x], "value string"))
    spec = files.read_spec(spark, lines(f"n {p + n}", "is_directed false", "is_dynamic true", "is_weighted true", "is_bipartite true"), lines("type1 item", "type2 user", f"type1_count {p}"))
    return spark.createDataFrame([(spec.n, spec.directed, spec.dynamic, spec.weighted, spec.bipartite, spec.item_count)], "n long, directed boolean, dynamic boolean, weighted boolean, bipartite boolean, item_count long")


def title_scan(spark, d):  # S9
    lines = fx.read(spark, d, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(" "), "p_name", F.lit(" #"), F.col("p_partkey").cast("string")).alias("value"))
    return files.read_titles(spark, written(lines))


def source_list(spark, d):  # S11
    ids = fx.read(spark, d, "part").orderBy(F.col("p_partkey").desc()).select(F.col("p_partkey").cast("string").alias("value"))
    return files.read_sources(spark, written(ids)).select(F.col("seq").cast("long").alias("seq"), "id")


def exact_scan(spark, d):  # S12
    rows = fx.read(spark, d, "part").select(F.concat_ws(" ", (F.col("p_partkey") % 3).cast("string"), F.col("p_partkey").cast("string"), (F.col("p_size") / 4).cast("string")).alias("value"))
    return files.read_exact(spark, written(rows), spark.createDataFrame([(0,), (2,)], "id long"), prefix=False)


def snapshot_round_trip(spark, d):  # S7 S8
    g = fx.shop(spark, d)
    path = f"{scratch(spark)}/snapshot-{uuid.uuid4().hex}"
    files.write_snapshot(g, path)
    return files.read_snapshot(spark, path, g.spec).edges


def node_table(spark, d):  # S13
    path = f"{scratch(spark)}/nodes-{uuid.uuid4().hex}"
    fx.nodes(spark, d, fx.shop(spark, d)).write.parquet(path)
    return files.read_nodes(spark, path).select("id", "name", "title_ja", "ranking", "year")


def strict_build(spark, d):  # S4
    rows = fx.moves(spark, d).edges.select("src", "dst")
    return Graph.build(rows, GraphSpec(n=1 << 20, directed=True, weighted=False)).edges


def empty_graph(spark, d):  # S6
    g = Graph.empty(spark, GraphSpec(n=fx.sizes(spark, d)[0]))
    return g.degrees().select("node", F.col("degree").cast("long").alias("degree"))


# ---- repeated pairs, single sources, unweighted variants


def told_pairs(spark, d):
    """pairs, then the same the other way round, then self-loops."""
    p = pairs(spark, d)
    n = F.lit(1 << 40)
    again = p.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(9.0).alias("w"), (F.col("src") + n).alias("seq"))
    loops = p.select("src", F.col("src").alias("dst"), "w", (F.col("src") + 2 * n).alias("seq"))
    return p.withColumn("seq", F.col("src")).unionByName(again).unionByName(loops)


def insert_repeated(spark, d):  # G6 G7
    g, told = fx.shop(spark, d).insert(told_pairs(spark, d))
    rows = g.edges.groupBy("src", "dst").agg(F.count("*").alias("rows"))  # 1 each
    return told.select("seq", "src", "dst", "inserted").join(rows, ["src", "dst"], "left")


def remove_repeated(spark, d):  # G8 G9
    return fx.shop(spark, d).remove(told_pairs(spark, d))[1].select("seq", "src", "dst", "removed")


def fora_single(spark, d):  # P4
    one = spark.createDataFrame([(3, 1.0)], "node long, val double")
    return ppr.fora(fx.shop(spark, d).persist(), one, 2000, max_rounds=40, max_steps=40).select("node", c("val", s=1e9))


def fora_full_path_single(spark, d):  # P9
    one = spark.createDataFrame([(3, 1.0)], "node long, val double")
    return ppr.full_path(fx.shop(spark, d).persist(), one, 2000, max_rounds=40, max_steps=40).select("node", c("val", s=1e9))


def fora_full_path_unweighted(spark, d):  # P6
    return ppr.full_path(fx.shop(spark, d).persist(), ppr.normalised(fx.sources(spark)), 2000, weighted=False, max_rounds=40, max_steps=40).select("node", c("val", s=1e9))


def stationary_unweighted(spark, d):  # P12
    return centrality.pagerank(fx.moves(spark, d).persist(), 0.0, False, K).values.select("node", c("val"))


def suggest_short(spark, d):  # A4
    return catalog.suggest(fx.nodes(spark, d, fx.shop(spark, d)), "R")


QUERIES = {
    f.__name__: f
    for f in (
        edge_build_first_wins, edge_build_sum, edge_symmetrize, edge_count, self_loop_drop_transitions, degree, weighted_degree, transition_prob, sampling_slices,
        degree_centrality, weighted_degree_centrality, neighbors, has_edge, insert_edges, remove_edges, dataset_direction, item_degree_rank, print_ranking,
        ppr_exact_single, ppr_exact_multi, ppr_exact_unweighted, ppr_blacklist, ppr_dangling, forward_push_rounds, forward_push_unweighted,
        walk_paths, walk_paths_min1, walk_end_nodes, ppr_monte_carlo, fora, fora_full_path,
        pagerank, pagerank_weighted, pagerank_dangling, stationary_alpha0, bfs_hops, shortest_inverse_weight,
        dot, l2, scale, vec_subtract, vec_normalise, orthogonal_component, cosine, analyze_top100, adjust_top100, visible_top10, response_json, console_lines,
        dcg, ndcg, spearman_topk, ap_corr, ap_corr_compat, ap_symmetric, time_stamps,
        suggest_prefix, suggest_substring, suggest_ja, name_lookup, known_names, metadata_join, display_label,
        explain_offline, prompt_text, json_requests, latest_adjust, session_key, slider_clamp,
        edge_text_scan, header_scan, title_scan, source_list, exact_scan, snapshot_round_trip, node_table, strict_build, empty_graph,
        insert_repeated, remove_repeated, fora_single, fora_full_path_single, fora_full_path_unweighted, stationary_unweighted, suggest_short,
    )
} | {"adjust_minus": adjusted(-0.5), "adjust_zero": adjusted(0.0), "adjust_plus": adjusted(0.5)}  # fmt: skip  # V8
