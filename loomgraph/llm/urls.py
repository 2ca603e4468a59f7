"""URL filters with link-graph propagation, in DataFrame functions alone.

Rules (host, path prefix, block or allow) judge the urls that they fit. For the rest, trust spreads from hosts whose
pages are allowed by rules along links, and distrust from hosts with blocked pages against links (personalised
PageRank on host edges, and on the reversed ones); a host is blocked where distrust exceeds trust by a threshold.

Scale: pages are cut down to (host, linked host, count) with partial sums before any shuffle, self-links go, and the
rounds work on hosts alone; a round is two joins and a sum by host, its result a written table every few rounds.
Verdicts reach the pages by a join on the host that adaptive execution broadcasts or splits.

Defined results: null urls and urls without '://' have an empty host and path, no rule, and are allowed; null html has
no links; html of any length is searched whole; of rules that fit equally long the later by host counts; an empty table
gives no rows; repeated pages count as often as they stand there; dangling hosts give nothing on; other columns are ignored.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import ascii_lower, durable, table

#: host, path, verdict
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: After ROUNDS rounds DAMPING ** (ROUNDS + 1), 5e-5 of the seeds' shares, hasn't been handed on: far under THRESHOLD.
DAMPING, ROUNDS, CUT_EVERY = 0.85, 60, 5
#: A host is blocked if its distrust exceeds its trust by so much; a seed host's own share is at most 1 - DAMPING.
THRESHOLD = 0.075
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages(url) with host, path, rule (the longest that fits, else null) and rule_verdict. Rules are a short parameter list."""
    out = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return out.withColumns({"rule": rule, "rule_verdict": verdict})


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts."""
    found = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("to"))
    edges = found.select("src", ascii_lower(F.regexp_extract("to", "//(.*)$", 1)).alias("dst"))
    return edges.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """host, score: (1 - damping) * seed + damping * what the in-neighbours pass on, by share of their links."""
    total = edges.groupBy("src").agg(F.sum("n").alias("all"))
    share = durable(edges.join(total, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("p")), "shares")
    base = seeds.select("host", (F.col("seed") * (1 - damping)).alias("score"))
    now = base
    for k in range(rounds if not share.isEmpty() else 0):
        passed = share.join(now, share["src"] == now["host"]).select(F.col("dst").alias("host"), (F.col("p") * F.col("score") * damping).alias("score"))
        now = base.unionByName(passed).groupBy("host").agg(F.sum("score").alias("score"))
        now = durable(now, "rank") if (k + 1) % CUT_EVERY == 0 else now
    return now


def host_verdicts(pages: DataFrame, rules=RULES) -> DataFrame:
    """host, trust, distrust, host_verdict for every host of pages."""
    sums = ruled(pages.select("url"), rules).where("host <> ''").groupBy("host")
    hosts = durable(sums.agg(F.avg(F.when(F.col("rule_verdict") == "allow", 1.0).otherwise(0.0)).alias("good"), F.avg(F.when(F.col("rule_verdict") == "block", 1.0).otherwise(0.0)).alias("bad")), "hosts")
    edges = durable(host_edges(pages), "edges")
    trust = propagate(edges, hosts.select("host", F.col("good").alias("seed")).where("seed > 0"))
    distrust = propagate(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), hosts.select("host", F.col("bad").alias("seed")).where("seed > 0"))
    out = hosts.join(trust.withColumnRenamed("score", "trust"), "host", "left").join(distrust.withColumnRenamed("score", "distrust"), "host", "left").fillna(0.0, ["trust", "distrust"])
    return out.select("host", "trust", "distrust", F.when(F.floor((F.col("distrust") - F.col("trust")) * 1e9 + 0.5) / 1e9 > THRESHOLD, F.lit("block")).otherwise(F.lit("allow")).alias("host_verdict"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages' page_id with host, path, rule and verdict."""
    hosts = host_verdicts(pages, rules).select("host", "host_verdict")
    out = ruled(pages.select("page_id", "url"), rules).join(hosts, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "host_verdict", F.lit("allow")).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages."""
    return judge(table(spark, sf_dir, "pages"))


SQL = r"""
WITH RECURSIVE p AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS t(h, s, v)),
j AS (SELECT page_id, max_by(h || s, len(h || s)) AS rule, max_by(v, len(h || s)) AS v FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id),
a AS (SELECT p.*, j.rule, j.v FROM p LEFT JOIN j USING (page_id)),
s AS (SELECT host, avg(CASE WHEN v = 'allow' THEN 1.0 ELSE 0.0 END) AS good, avg(CASE WHEN v = 'block' THEN 1.0 ELSE 0.0 END) AS bad FROM a WHERE host <> '' GROUP BY host),
l AS (SELECT host AS src, translate(regexp_extract(x, '//(.*)$', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<a\s[^>]*?href\s*=\s*["'']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^/?#"''\s<>]+)', 1)) AS x FROM p)),
e AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
f AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS p FROM e),
b AS (SELECT dst AS src, src AS dst, n / sum(n) OVER (PARTITION BY dst) AS p FROM e),
t(k, host, x) AS (SELECT 0, host, 0.15 * good FROM s WHERE good > 0 UNION ALL SELECT k + 1, dst, sum(0.85 * p * x) FROM t JOIN f ON t.host = f.src WHERE k < 60 GROUP BY k, dst),
d(k, host, x) AS (SELECT 0, host, 0.15 * bad FROM s WHERE bad > 0 UNION ALL SELECT k + 1, dst, sum(0.85 * p * x) FROM d JOIN b ON d.host = b.src WHERE k < 60 GROUP BY k, dst),
z AS (SELECT host, coalesce((SELECT sum(x) FROM d WHERE d.host = s.host), 0) - coalesce((SELECT sum(x) FROM t WHERE t.host = s.host), 0) AS x FROM s)
SELECT page_id, a.host, path, rule, coalesce(v, CASE WHEN floor(x * 1e9 + 0.5) / 1e9 > 0.075 THEN 'block' END, 'allow') AS verdict FROM a LEFT JOIN z ON a.host = z.host
"""
