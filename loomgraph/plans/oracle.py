"""The registered queries as SQL over the same tables."""

K, SEED = 10, 1

P = "p AS (SELECT count(*) AS np FROM part), c AS (SELECT count(*) AS nc FROM customer), "
RAW = P + "raw AS (SELECT l_partkey AS item, np + o_custkey AS usr, l_quantity AS w, l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey, p), "
BOTH = "e AS (SELECT item AS src, usr AS dst, w FROM und UNION ALL SELECT usr, item, w FROM und), "
SHOP = RAW + "und AS (SELECT item, usr, w FROM (SELECT *, row_number() OVER (PARTITION BY item, usr ORDER BY l_orderkey, l_linenumber, w) AS rn FROM raw) WHERE rn = 1), " + BOTH
SUMMED = RAW + "und AS (SELECT item, usr, sum(w) AS w FROM raw GROUP BY ALL), " + BOTH
NODES = "v AS (SELECT range AS node FROM range((SELECT np FROM p) + (SELECT nc FROM c))), "
STEPS = "t AS (SELECT src, dst, w, w / sum(w) OVER (PARTITION BY src) AS p FROM e), "
UNIFORM = "t AS (SELECT src, dst, w, 1.0 / count(*) OVER (PARTITION BY src) AS p FROM e), "
SUPPLY = RAW + "e AS (SELECT usr AS src, item AS dst, sum(w) AS w FROM raw GROUP BY ALL UNION ALL SELECT l_partkey, (SELECT np FROM p) + (SELECT nc FROM c) + l_suppkey, sum(l_quantity) FROM lineitem GROUP BY ALL), "
SUPPLY_NODES = "v AS (SELECT range AS node FROM range((SELECT np FROM p) + (SELECT nc FROM c) + (SELECT count(*) FROM supplier))), "
STEPPED = "(SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS src, lead(CAST(json_extract_string(props, '$.k') AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events)"
MOVES = f"raw AS (SELECT * FROM {STEPPED} WHERE dst IS NOT NULL), e AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM raw WHERE src <> dst GROUP BY ALL), v AS (SELECT range AS node FROM range((SELECT max(greatest(src, dst)) + 1 FROM raw))), "
GIVEN = "g AS (SELECT * FROM (VALUES (3, 0.25::DOUBLE), (17, 0.5::DOUBLE), (42, 0.25::DOUBLE)) AS x(node, val)), "
ITEMS = "a AS (SELECT l_partkey AS node, sum(l_quantity) AS val FROM lineitem GROUP BY ALL HAVING l_partkey % 5 <> 0), b AS (SELECT p_partkey AS node, CAST(p_size AS DOUBLE) AS val FROM part WHERE p_partkey % 3 <> 0), "
SHARE = "deg AS (SELECT src AS node, sum(w) AS x FROM e GROUP BY src), dc AS (SELECT v.node, coalesce(x, 0) / sum(coalesce(x, 0)) OVER () AS val FROM v LEFT JOIN deg USING (node)), "
RANKS = "rk AS (SELECT node, row_number() OVER (ORDER BY val DESC, node) AS rk FROM dc, p WHERE node < np), "
CATALOG = RANKS + """names AS (SELECT p_partkey AS id, p_name || ' #' || p_partkey AS name, CASE WHEN p_partkey % 3 = 0 THEN p_brand || ' ' || p_name || ' #' || p_partkey END AS title_ja,
  CASE WHEN p_partkey % 10 <> 9 THEN rk END AS ranking, p_size + 1970 AS year FROM part LEFT JOIN rk ON node = p_partkey), """


def num(x: str, s: str = "1e12") -> str:
    return f"floor({x} * {s} + 0.5) / {s}"


def ppr(name: str, k: int, given: str = "g", alpha: float = 0.2) -> str:
    """CTEs <name>_r and <name>(node, val)."""
    return (
        f"{name}_r(i, node, x) AS (SELECT 0, node, val FROM {given} UNION ALL SELECT i + 1, dst, sum({1 - alpha} * x * p) FROM {name}_r JOIN t ON node = src WHERE i < {k} GROUP BY i, dst), "
        f"{name}_a AS (SELECT node, CASE WHEN i < {k} THEN {alpha} * x ELSE x END AS x FROM {name}_r UNION ALL SELECT -1, {1 - alpha} * x FROM {name}_r WHERE i < {k} AND node NOT IN (SELECT src FROM t)), "
        f"{name} AS (SELECT node, {num('sum(x)')} AS val FROM {name}_a GROUP BY node HAVING sum(x) <> 0), "
    )


def push(rounds: int, active: str) -> str:
    """CTE st(i, node, pi, r): states of synchronous push rounds. active: which vertices push; of degree deg."""
    return f"""
ex AS (SELECT t.src AS node, dst, t.p, n AS deg FROM t JOIN (SELECT src, count(*) AS n FROM e GROUP BY src) d ON t.src = d.src
  UNION ALL SELECT node, NULL, 0, coalesce(n, 0) FROM v LEFT JOIN (SELECT src, count(*) AS n FROM e GROUP BY src) d ON src = node
  UNION ALL SELECT node, -1, 1, 0 FROM v WHERE node NOT IN (SELECT src FROM e) UNION ALL SELECT -1, NULL, 0, 0),
st(i, node, pi, r) AS (SELECT 0, node, 0::DOUBLE, val FROM g UNION ALL SELECT i + 1, to_, sum(pi), sum(r) FROM (
  SELECT i, CASE WHEN dst IS NULL THEN node ELSE dst END AS to_,
    CASE WHEN dst IS NULL THEN pi + CASE WHEN act THEN KEEP * r ELSE 0 END WHEN dst = -1 THEN CASE WHEN act THEN r ELSE 0 END * 0.8 * p ELSE 0 END AS pi,
    CASE WHEN dst IS NULL THEN CASE WHEN act THEN 0 ELSE r END WHEN dst = -1 THEN 0 ELSE CASE WHEN act THEN r ELSE 0 END * 0.8 * p END AS r
  FROM (SELECT st.i, st.node, st.pi, st.r, ex.dst, ex.p, {active} AND st.node <> -1 AS act FROM st JOIN ex ON st.node = ex.node WHERE st.i < {rounds})) GROUP BY i, to_), """


def draw(k: str, purpose: str) -> str:
    return f"CAST('0x' || substr(md5('{SEED}:' || walk_id || ':' || {k} || ':{purpose}'), 1, 8) AS BIGINT) / 4294967296.0"


SLICES = """sl AS (SELECT src, dst, (hi - w) / total AS lo, hi / total AS hi FROM (SELECT src, dst, w, sum(w) OVER (PARTITION BY src ORDER BY dst ROWS UNBOUNDED PRECEDING) AS hi, sum(w) OVER (PARTITION BY src) AS total FROM e)), """
SLOTS = """sl AS (SELECT src, dst, (rn - 1) / n AS lo, rn / n AS hi FROM (SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY dst) AS DOUBLE) AS rn, count(*) OVER (PARTITION BY src) AS n FROM e)), """


def walks(start: str, stop_first: bool = True, steps: int = 40) -> str:
    """CTE wk(walk_id, start, weight, step, node)."""
    stop = f"{draw('(k + 1)', 'stop')} >= 0.2" + ("" if stop_first else " OR k = 0")
    return f"""wk(walk_id, start, weight, k, node) AS (SELECT walk_id, start, weight, 0, start FROM ({start}) UNION ALL SELECT walk_id, start, weight, k + 1, coalesce(sl.dst, -1) FROM
  (SELECT *, {draw('(k + 1)', 'move')} AS u FROM wk WHERE node <> -1 AND k < {steps} AND ({stop})) x LEFT JOIN sl ON x.node = sl.src AND x.u >= sl.lo AND x.u < sl.hi), """


def some(n: int) -> str:
    return f"SELECT node || '_' || i AS walk_id, node AS start, 1.0::DOUBLE / {n} AS weight FROM g, (SELECT range AS i FROM range({n}))"


ENDS = "en AS (SELECT walk_id, any_value(weight) AS weight, max_by(node, k) AS node FROM wk GROUP BY walk_id) "
R = "WITH RECURSIVE "


def closed(ctes: str) -> str:
    return ctes.rstrip().rstrip(",") + " "


def pagerank(graph: str, nodes: str, steps: str, alpha: float, k: int = K) -> str:
    return R + closed(graph + nodes + steps + f"""n AS (SELECT count(*) AS n FROM v), lo AS (SELECT node FROM v WHERE node NOT IN (SELECT src FROM e)),
x(i, node, val) AS (SELECT 0, node, 1.0::DOUBLE / n FROM v, n UNION ALL SELECT i + 1, node, sum(y) + any_value(z) FROM (
  SELECT x.i, t.dst AS node, {1 - alpha} * x.val * t.p AS y, NULL AS z FROM x JOIN t ON x.node = t.src WHERE x.i < {k}
  UNION ALL SELECT x.i, x.node, 0, ({alpha} * (1 - l.lost) + l.lost) / n.n FROM x, n, (SELECT coalesce(sum(CASE WHEN node IN (SELECT node FROM lo) THEN val ELSE 0 END), 0) AS lost FROM x) l WHERE x.i < {k}) GROUP BY i, node)""") + f"SELECT node, {num('val')} AS val FROM x WHERE i = {k}"


def steered(s: float) -> str:
    """CTE z(node, val): the adjuster at cosine s over ppr vector `pv`, before exclusions."""
    return f"""u AS (SELECT dc.node, dc.val AS d, coalesce(f.val, 0) AS x FROM dc LEFT JOIN (SELECT * FROM pv WHERE node <> -1 AND node NOT IN (SELECT node FROM g)) f ON dc.node = f.node),
k AS (SELECT sqrt(sum(d * d)) AS nd, sqrt(sum(x * x)) AS nx, sum(x * d) AS xd FROM u), q AS (SELECT *, xd / (nx * nd) AS pr FROM k),
z AS (SELECT node, x / nx - (pr - {s} * sqrt((1 - pr * pr) / (1 - {s} * {s}))) * d / nd AS val FROM u, q), """


def engine(s: float, k: int = K) -> str:
    """CTE top(rk, node, val)."""
    return SHOP + NODES + STEPS + SHARE + GIVEN + ppr("pv0", k).replace(num("sum(x)"), "sum(x)") + "pv AS (SELECT * FROM pv0), " + steered(s) + f"top AS (SELECT row_number() OVER (ORDER BY val DESC, node) AS rk, node, val FROM (SELECT node, {num('val')} AS val FROM z, p WHERE node < np AND node NOT IN (SELECT node FROM g)) ORDER BY val DESC, node LIMIT 100), "


TWO = SHOP + NODES + STEPS + GIVEN + ppr("aa", 3) + ppr("bb", 20) + "ra AS (SELECT node, val, row_number() OVER (ORDER BY val DESC, node) AS rk FROM aa WHERE node <> -1), rb AS (SELECT node, val, row_number() OVER (ORDER BY val DESC, node) AS rk FROM bb WHERE node <> -1), "
GAIN = "sum((pow(2.0, coalesce({r}.val, 0)) - 1) / log2({k}.rk + 1))"


def ap(a: str, b: str, compat: bool = False) -> str:
    held = "y.j > 1 AND y.j <= x.j" if compat else "y.j < x.j"
    return f"""(SELECT 2 * sum(s) / nullif(count(*) - {int(compat)}, 0) - 1 FROM (SELECT x.j, avg(CASE WHEN y.r < x.r THEN 1.0 ELSE 0.0 END) AS s FROM
  (SELECT {a}.rk AS j, {b}.rk AS r FROM {a} JOIN {b} USING (node) WHERE {a}.rk <= 100) x JOIN (SELECT {a}.rk AS j, {b}.rk AS r FROM {a} JOIN {b} USING (node) WHERE {a}.rk <= 100) y ON {held} GROUP BY x.j))"""


def suggest(text: str, title: str) -> str:
    return "WITH " + closed(SHOP + NODES + SHARE + CATALOG + f"""s AS (SELECT id, {title} AS title, coalesce(ranking, 2147483647) AS r, year FROM names),
a AS (SELECT * FROM s WHERE title ILIKE '{text}%' ORDER BY r, id LIMIT 11), b AS (SELECT * FROM s WHERE title ILIKE '%{text}%' ORDER BY r, id LIMIT 10),
o AS (SELECT * FROM a WHERE (SELECT count(*) FROM a) > 10 UNION ALL SELECT * FROM b WHERE (SELECT count(*) FROM a) <= 10),""") + "SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY r, id) AS INTEGER) AS rk, title, year FROM o) WHERE rk <= 10"


PAIRS = "pr AS (SELECT range AS src, range + (SELECT np FROM p) AS dst, 7.0::DOUBLE AS w FROM range((SELECT least(np, nc) FROM p, c))), "
TRANS = f"SELECT src, dst, w, {num('w / sum(w) OVER (PARTITION BY src)')} AS p FROM"
WANTED = """wi AS (SELECT p_name || ' #' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM part), """
LINES = """ln AS (SELECT event_id AS seq, CASE WHEN event_type = 'click' THEN 'analyze' WHEN event_type = 'view' THEN 'adjust' ELSE 'other' END AS type, 'u' || user_id AS userKey, event_id AS first_id, value AS c,
  event_id % 17 = 0 AS blank, event_id % 19 = 0 AS bad FROM events), """
ROWS = "rr AS (SELECT p_partkey + 1 AS rk, p_name || ' *#' || p_partkey AS name, p_size / 64.0 - 0.25 AS val FROM part), "
FOUR = "CASE WHEN {x} < 0 AND floor(abs({x}) * 10000 + 0.5) > 0 THEN '-' ELSE '' END || CAST(CAST(floor(floor(abs({x}) * 10000 + 0.5) / 10000) AS BIGINT) AS VARCHAR) || '.' || lpad(CAST(CAST(floor(abs({x}) * 10000 + 0.5) AS BIGINT) % 10000 AS VARCHAR), 4, '0')"
ESCAPED = r"regexp_replace(name, '([\\`*_{}\[\]()#+\-.!|>])', '\\\1', 'g')"
PUSHED = "r > deg * "

ORACLE = {
    "edge_build_first_wins": "WITH " + closed(SHOP) + "SELECT * FROM e",
    "edge_build_sum": "WITH " + closed(SUMMED) + "SELECT * FROM e",
    "edge_symmetrize": "WITH " + closed(SHOP) + "SELECT count(*) AS n, count(*) AS symmetric FROM e",
    "edge_count": "WITH " + closed(SHOP) + "SELECT count(*) // 2 AS edges, count(*) * 40 / 1000 AS kb, (SELECT np + nc FROM p, c) AS nodes FROM e",
    "self_loop_drop_transitions": "WITH " + closed(MOVES) + "SELECT * FROM e",
    "degree": "WITH " + closed(SUPPLY + SUPPLY_NODES) + "SELECT node, count(src) AS degree FROM v LEFT JOIN e ON src = node GROUP BY node",
    "weighted_degree": "WITH " + closed(SHOP + NODES) + "SELECT node, coalesce(sum(w), 0) AS weighted_degree FROM v LEFT JOIN e ON src = node GROUP BY node",
    "transition_prob": "WITH " + closed(MOVES) + f"SELECT src, dst, {num('w / sum(w) OVER (PARTITION BY src)')} AS p FROM e",
    "sampling_slices": "WITH " + closed(MOVES) + "SELECT src, dst, sum(w) OVER o - w AS lo, sum(w) OVER o AS hi, sum(w) OVER (PARTITION BY src) AS total, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS slot, count(*) OVER (PARTITION BY src) AS degree FROM e WINDOW o AS (PARTITION BY src ORDER BY dst ROWS UNBOUNDED PRECEDING)",
    "degree_centrality": "WITH " + closed(SUPPLY + SUPPLY_NODES) + f"SELECT node, {num('count(src) / CAST((SELECT count(*) FROM e) AS DOUBLE)')} AS val FROM v LEFT JOIN e ON src = node GROUP BY node",
    "weighted_degree_centrality": "WITH " + closed(SHOP + NODES + SHARE) + f"SELECT node, {num('val')} AS val FROM dc",
    "neighbors": "WITH " + closed(SHOP) + "SELECT dst FROM e WHERE src = 3",
    "has_edge": "WITH " + closed(SHOP + PAIRS) + "SELECT src, dst, (src, dst) IN (SELECT (src, dst) FROM e) AS present FROM pr",
    "insert_edges": "WITH " + closed(SHOP + PAIRS + "nw AS (SELECT * FROM pr WHERE (src, dst) NOT IN (SELECT (src, dst) FROM e)), f AS (SELECT * FROM e UNION ALL SELECT src, dst, w FROM nw UNION ALL SELECT dst, src, w FROM nw),") + f"SELECT src, dst, f.w, {num('f.w / sum(f.w) OVER (PARTITION BY src)')} AS p, CASE WHEN (src, dst) IN (SELECT (src, dst) FROM nw) THEN 2 WHEN (src, dst) IN (SELECT (src, dst) FROM pr) THEN 0 ELSE -1 END AS inserted FROM f",
    "remove_edges": "WITH " + closed(SHOP + PAIRS) + TRANS + " (SELECT * FROM e WHERE (src, dst) NOT IN (SELECT (src, dst) FROM pr) AND (dst, src) NOT IN (SELECT (src, dst) FROM pr))",
    "dataset_direction": "SELECT lower(r_name) AS name, false AS directed FROM region UNION ALL VALUES ('orkut', false), ('web-berkstan', true)",
    "item_degree_rank": "WITH " + closed(SHOP + NODES + SHARE + RANKS) + "SELECT node, rk FROM rk",
    "print_ranking": R + closed(SHOP + NODES + STEPS + SHARE + CATALOG + GIVEN + ppr("pv", K) + "top AS (SELECT row_number() OVER (ORDER BY val DESC, node) AS rk, node, val FROM pv, p WHERE node >= 0 AND node < np ORDER BY val DESC, node LIMIT 50),") + "SELECT top.rk, top.node, CASE WHEN id % 4 <> 0 THEN name ELSE '' END AS title, val, rk.rk AS degree_rank FROM top LEFT JOIN names ON id = top.node LEFT JOIN rk ON rk.node = top.node",
    "ppr_exact_single": R + closed(SHOP + STEPS + "g AS (SELECT 3 AS node, 1.0::DOUBLE AS val), " + ppr("pv", K)) + "SELECT * FROM pv",
    "ppr_exact_multi": R + closed(SHOP + STEPS + GIVEN + ppr("pv", K)) + "SELECT * FROM pv",
    "ppr_exact_unweighted": R + closed(SHOP + UNIFORM + GIVEN + ppr("pv", K)) + "SELECT * FROM pv",
    "ppr_blacklist": R + closed(SHOP + STEPS + "g AS (SELECT * FROM (VALUES (3, 0.5::DOUBLE), (17, 0.0::DOUBLE), (42, 0.5::DOUBLE)) AS x(node, val)), " + ppr("pv", K)) + "SELECT * FROM pv WHERE node <> -1 AND node NOT IN (SELECT node FROM g)",
    "ppr_dangling": R + closed(SUPPLY + STEPS + GIVEN + ppr("pv", K)) + "SELECT * FROM pv",
    "forward_push_rounds": R + closed(SHOP + NODES + STEPS + GIVEN + push(6, PUSHED + "1e-5").replace("KEEP", "0.2")) + f"SELECT node, {num('pi')} AS pi, {num('r')} AS r FROM st WHERE i = 6",
    "forward_push_unweighted": R + closed(SUPPLY + SUPPLY_NODES + UNIFORM + GIVEN + push(6, PUSHED + "1e-5").replace("KEEP", "0.2")) + f"SELECT node, {num('pi')} AS pi, {num('r')} AS r FROM st WHERE i = 6",
    "walk_paths": R + closed(SUPPLY + GIVEN + SLICES + walks(some(100))) + "SELECT walk_id, k AS step, node FROM wk",
    "walk_paths_min1": R + closed(SUPPLY + GIVEN + SLOTS + walks(some(100), False)) + "SELECT walk_id, k AS step, node FROM wk",
    "walk_end_nodes": R + closed(SHOP + GIVEN + SLICES + walks(some(100)) + ENDS) + "SELECT walk_id, node FROM en",
    "ppr_monte_carlo": R + closed(SHOP + GIVEN + SLICES + walks(some(200)) + ENDS) + f"SELECT node, {num('sum(weight)')} AS val FROM en GROUP BY node",
    "fora": R + closed(SHOP + NODES + STEPS + GIVEN + SLICES + push(40, PUSHED + "0.0025").replace("KEEP", "0.2") + "fi AS (SELECT * FROM st WHERE i = 40), " + walks("SELECT node || '_' || i AS walk_id, node AS start, r / n AS weight FROM (SELECT node, r, n, unnest(range(1, n + 1)) AS i FROM (SELECT node, r, CAST(ceil(r * 2000) AS BIGINT) AS n FROM fi WHERE r > 0 AND node <> -1))") + ENDS) + f"SELECT node, {num('sum(val)', '1e9')} AS val FROM (SELECT node, pi AS val FROM fi UNION ALL SELECT node, weight FROM en) GROUP BY node HAVING sum(val) <> 0",
    "fora_full_path": R + closed(SHOP + NODES + STEPS + GIVEN + SLICES + push(40, PUSHED + "0.0025").replace("KEEP", "1") + "fi AS (SELECT * FROM st WHERE i = 40), " + walks("SELECT node || '_' || i AS walk_id, node AS start, r / n AS weight FROM (SELECT node, r, n, unnest(range(1, n + 1)) AS i FROM (SELECT node, r, CAST(ceil(r * 2000) AS BIGINT) AS n FROM fi WHERE r > 0 AND node <> -1))") + "vi AS (SELECT node, sum(val) AS val FROM (SELECT node, pi AS val FROM fi UNION ALL SELECT node, weight FROM wk) GROUP BY node),") + f"SELECT node, {num('val / (SELECT sum(val) FROM vi)', '1e9')} AS val FROM vi WHERE val > 0",
    "pagerank": pagerank(SHOP, NODES, UNIFORM, 0.2),
    "pagerank_weighted": pagerank(SHOP, NODES, STEPS, 0.2),
    "pagerank_dangling": pagerank(SUPPLY, SUPPLY_NODES, STEPS, 0.2),
    "stationary_alpha0": pagerank(MOVES, "", STEPS, 0.0),
    "bfs_hops": R + closed(SUPPLY + SUPPLY_NODES + "h(i, node) AS (SELECT 0, np + 5 FROM p UNION SELECT i + 1, dst FROM h JOIN e ON node = src WHERE i < 6),") + "SELECT v.node, coalesce(min(i), 1.7976931348623157e308) AS dist FROM v LEFT JOIN h USING (node) GROUP BY v.node",
    "shortest_inverse_weight": R + closed(SHOP + NODES + "h(i, node, d) AS (SELECT 0, 3, 0::DOUBLE UNION ALL SELECT i + 1, dst, min(d + 1.0::DOUBLE / w) FROM h JOIN e ON node = src WHERE i < 16 AND w > 0 GROUP BY i, dst),") + f"SELECT v.node, {num('coalesce(min(d), 1.7976931348623157e308)', '1e9')} AS dist FROM v LEFT JOIN h USING (node) GROUP BY v.node",
    "dot": "WITH " + closed(ITEMS) + "SELECT sum(a.val * b.val) AS val FROM a JOIN b USING (node)",
    "l2": "WITH " + closed(ITEMS) + f"SELECT {num('sqrt(sum(val * val))', '1e6')} AS val FROM a",
    "scale": "WITH " + closed(ITEMS) + "SELECT node, val * 2.5::DOUBLE AS val FROM b",
    "vec_subtract": "WITH " + closed(ITEMS + "f AS (SELECT * FROM b UNION ALL SELECT * FROM a WHERE node % 15 = 3 AND node NOT IN (SELECT node FROM b)),") + "SELECT coalesce(a.node, f.node) AS node, coalesce(a.val, 0) - coalesce(f.val, 0) AS val FROM a FULL JOIN f ON a.node = f.node WHERE NOT (f.node IS NOT NULL AND coalesce(a.val, 0) - coalesce(f.val, 0) = 0)",
    "vec_normalise": "WITH " + closed(ITEMS) + f"SELECT node, {num('val / sqrt(sum(val * val) OVER ())', '1e9')} AS val FROM a",
    "orthogonal_component": "WITH " + closed(ITEMS + "k AS (SELECT (SELECT sum(a.val * b.val) FROM a JOIN b USING (node)) / (SELECT sum(val * val) FROM b) AS k),") + f"SELECT coalesce(a.node, b.node) AS node, {num('(coalesce(a.val, 0) - coalesce(b.val, 0) * k)', '1e6')} AS val FROM a FULL JOIN b ON a.node = b.node, k WHERE NOT (b.node IS NOT NULL AND coalesce(a.val, 0) - coalesce(b.val, 0) * k = 0)",
    "cosine": "WITH " + closed(ITEMS) + f"SELECT {num('(SELECT sum(a.val * b.val) FROM a JOIN b USING (node)) / (sqrt((SELECT sum(val * val) FROM a)) * sqrt((SELECT sum(val * val) FROM b)))', '1e9')} AS val",
    "analyze_top100": R + closed(engine(0.0) + CATALOG) + f"SELECT top.rk, top.node, {num('top.val', '1e9')} AS val, coalesce(name, CAST(top.node AS VARCHAR)) AS name, title_ja, ranking, year, name || CASE WHEN coalesce(year, 0) <> 0 THEN ' (' || year || ')' ELSE '' END AS label FROM top LEFT JOIN names ON id = top.node",
    "adjust_top100": R + closed(engine(0.4)) + f"SELECT rk, node, {num('val', '1e9')} AS val FROM top",
    "visible_top10": R + closed(engine(0.0) + CATALOG) + "SELECT rk, node, name FROM (SELECT top.rk, top.node, name FROM top LEFT JOIN names ON id = top.node WHERE top.rk <= 60) WHERE NOT (rk IN (1, 5) OR rk % 5 = 0 AND rk <> 10) AND rk NOT IN (2, 3) ORDER BY rk LIMIT 10",
    "response_json": R + closed(engine(0.0)) + "SELECT '[' || string_agg('{\"id\":' || node || ',\"score\":0.5}', ',' ORDER BY rk) || ']' AS value FROM top WHERE rk <= 20",
    "console_lines": "WITH " + closed(MOVES) + "SELECT src || ' ' || dst || ' ' || w AS value FROM e UNION ALL SELECT p_partkey || ' ' || (p_size / 2.0::DOUBLE) FROM part",
    "dcg": R + closed(TWO) + f"SELECT {num(GAIN.format(r='bb', k='ra'), '1e9')} AS val FROM ra LEFT JOIN bb ON ra.node = bb.node WHERE ra.rk <= 100",
    "ndcg": R + closed(TWO) + f"SELECT {num('(SELECT ' + GAIN.format(r='bb', k='ra') + ' FROM ra LEFT JOIN bb ON ra.node = bb.node WHERE ra.rk <= 100) / (SELECT ' + GAIN.format(r='bb', k='rb') + ' FROM rb JOIN bb ON rb.node = bb.node WHERE rb.rk <= 100)', '1e9')} AS val",
    "spearman_topk": R + closed(TWO) + f"SELECT {num('corr(CAST(ra.rk AS DOUBLE), CAST(rb.rk AS DOUBLE))', '1e9')} AS val FROM ra JOIN rb USING (node) WHERE ra.rk <= 100",
    "ap_corr": R + closed(TWO) + f"SELECT {num(ap('ra', 'rb'), '1e9')} AS val",
    "ap_corr_compat": R + closed(TWO) + f"SELECT {num(ap('ra', 'rb', True), '1e9')} AS val",
    "ap_symmetric": R + closed(TWO) + f"SELECT {num('(' + ap('ra', 'rb') + ' + ' + ap('rb', 'ra') + ') / 2', '1e9')} AS val",
    "time_stamps": "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') AS stamp, CAST(floor(epoch(o_orderdate) - epoch(TIMESTAMP '1992-01-01')) AS BIGINT) AS elapsed FROM orders",
    "suggest_prefix": suggest("RE", "name"),
    "suggest_substring": suggest("g #1", "name"),
    "suggest_ja": suggest("brand#1", "coalesce(title_ja, name)"),
    "name_lookup": "WITH " + closed(SHOP + NODES + SHARE + CATALOG + WANTED) + "SELECT max(id) AS node, any_value(w) AS w FROM wi JOIN names ON names.name = wi.name GROUP BY wi.name",
    "known_names": "WITH " + closed(WANTED) + "SELECT name FROM wi UNION ALL SELECT p_name || ' #' || p_partkey FROM part WHERE p_partkey % 2 = 0",
    "metadata_join": "WITH " + closed(SHOP + NODES + SHARE + CATALOG) + "SELECT CAST(node + 1 AS INTEGER) AS rk, node, 0.5::DOUBLE AS val, coalesce(name, CAST(node AS VARCHAR)) AS name, title_ja, ranking, year, coalesce(name, CAST(node AS VARCHAR)) || CASE WHEN coalesce(year, 0) <> 0 THEN ' (' || year || ')' ELSE '' END AS label FROM v LEFT JOIN names ON id = node",
    "display_label": "SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 1) OR p_size = 0 THEN p_name ELSE p_name || ' (' || p_size || ')' END AS label FROM part",
    "explain_offline": "WITH " + closed(ROWS) + f"SELECT '## Best matches' || chr(10) || (SELECT string_agg(rk || '. ' || {ESCAPED} || ': ' || {FOUR.format(x='val')}, chr(10) ORDER BY rk) FROM rr WHERE rk <= 5) || chr(10) || chr(10) || 'Mean score: ' || {FOUR.format(x='(SELECT avg(val) FROM rr)')} || chr(10) || 'Strongest: ' || (SELECT min_by({ESCAPED}, rk) FROM rr) AS text",
    "prompt_text": "WITH " + closed(ROWS) + f"SELECT '好みの作品と提案された作品の共通点を日本語で説明してください。' || chr(10) || '好み: ' || (SELECT string_agg(name, ', ' ORDER BY rk) FROM rr WHERE rk <= 3) || chr(10) || '提案:' || chr(10) || (SELECT string_agg(name || ': ' || {FOUR.format(x='val')}, chr(10) ORDER BY rk) FROM rr WHERE rk BETWEEN 4 AND 9) AS text",
    "json_requests": "WITH " + closed(LINES) + "SELECT seq, CASE WHEN NOT bad THEN type END AS type, CASE WHEN NOT bad THEN userKey END AS userKey, CASE WHEN NOT bad THEN first_id END AS first_id, CASE WHEN NOT bad THEN c END AS c, NOT bad AND type <> 'other' AS ok FROM ln WHERE NOT blank",
    "latest_adjust": "WITH " + closed(LINES) + "SELECT seq, userKey, type FROM (SELECT *, lead(type) OVER (PARTITION BY userKey ORDER BY seq) AS nx FROM ln WHERE NOT blank AND NOT bad AND type <> 'other') WHERE NOT (type = 'adjust' AND coalesce(nx = 'adjust', false))",
    "session_key": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN lower(c_name) WHEN c_custkey % 2 = 0 THEN lower(' ' || c_mktsegment) ELSE 'default' END AS key FROM customer",
    "slider_clamp": "SELECT c_custkey, CASE WHEN c_custkey % 5 < 3 THEN 0.0 ELSE greatest(-0.9999::DOUBLE, least(0.9999::DOUBLE, c_acctbal / 4096)) END AS c FROM customer",
} | {
    f"adjust_{name}": R + closed(SHOP + NODES + STEPS + SHARE + GIVEN + ppr("pv", K) + steered(s)) + f"SELECT node, {num('val', '1e9')} AS val FROM z"
    for name, s in (("minus", "(-0.5)"), ("zero", "0.0"), ("plus", "0.5"))
}

ONE = "g AS (SELECT 3 AS node, 1.0::DOUBLE AS val), "
TOLD = PAIRS + """told AS (SELECT src AS seq, src, dst, w FROM pr UNION ALL SELECT src + 1099511627776, dst, src, 9.0 FROM pr UNION ALL SELECT src + 2199023255552, src, src, w FROM pr), """
IN_E = "(src, dst) IN (SELECT (src, dst) FROM e)"
ORACLE |= {
    "edge_text_scan": ORACLE["self_loop_drop_transitions"],
    "header_scan": "SELECT (SELECT count(*) FROM part) + (SELECT count(*) FROM customer) AS n, false AS directed, true AS dynamic, true AS weighted, true AS bipartite, (SELECT count(*) FROM part) AS item_count",
    "title_scan": "SELECT p_partkey AS id, p_name || ' #' || p_partkey AS title FROM part",
    "source_list": "SELECT row_number() OVER (ORDER BY p_partkey DESC) - 1 AS seq, p_partkey AS id FROM part QUALIFY row_number() OVER (ORDER BY p_partkey DESC) <= 1000",
    "exact_scan": "SELECT p_partkey % 3 AS src, p_partkey AS dst, p_size / 4.0::DOUBLE AS ppr FROM part WHERE p_partkey % 3 <> 1",
    "snapshot_round_trip": ORACLE["edge_build_first_wins"],
    "node_table": "WITH " + closed(SHOP + NODES + SHARE + CATALOG) + "SELECT id, name, title_ja, ranking, year FROM names",
    "strict_build": "WITH " + closed(MOVES) + "SELECT src, dst, 1.0::DOUBLE AS w FROM e",
    "empty_graph": "SELECT p_partkey AS node, CAST(0 AS BIGINT) AS degree FROM part",
    "insert_repeated": "WITH " + closed(SHOP + TOLD) + f"SELECT seq, src, dst, CASE WHEN seq < 1099511627776 AND NOT {IN_E} THEN 2 ELSE 0 END AS inserted, CASE WHEN src <> dst THEN 1 END AS rows FROM told",
    "remove_repeated": "WITH " + closed(SHOP + TOLD) + f"SELECT seq, src, dst, CASE WHEN seq < 1099511627776 AND {IN_E} THEN 2 ELSE 0 END AS removed FROM told",
    "fora_single": ORACLE["fora"].replace(GIVEN, ONE),
    "fora_full_path_single": ORACLE["fora_full_path"].replace(GIVEN, ONE),
    "fora_full_path_unweighted": ORACLE["fora_full_path"].replace(STEPS, UNIFORM).replace(SLICES, SLOTS),
    "stationary_unweighted": pagerank(MOVES, "", UNIFORM, 0.0),
    "suggest_short": "SELECT CAST(1 AS INTEGER) AS rk, p_name AS title, p_size AS year FROM part WHERE false",
}
