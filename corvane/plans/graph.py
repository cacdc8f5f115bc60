"""Graph queries: users that follow each other in the event log, and customers chained by balance inside a nation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import relational as R
from .registry import Tables, query

_USERS = "SELECT DISTINCT user_id AS src, n AS dst FROM (SELECT user_id, lead(user_id) OVER (ORDER BY event_id) AS n FROM events WHERE event_type IN ('purchase', 'signup')) WHERE n IS NOT NULL AND n <> user_id"
_CHAIN = "SELECT c AS src, d AS dst FROM (SELECT c_custkey AS c, lead(c_custkey) OVER w AS d FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)) WHERE d IS NOT NULL UNION SELECT c, d FROM (SELECT c_custkey AS c, lag(c_custkey, 3) OVER w AS d, row_number() OVER w AS k FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)) WHERE d IS NOT NULL AND k % 10 = 0"


def users(t: Tables) -> DataFrame:
    """user -> the user of the next purchase or sign-up. The order is one of the whole log."""
    e = t.events.where("event_type IN ('purchase', 'signup')").select("event_id", "user_id")
    rows = G.following(e, "event_id", "user_id")
    return rows.select(F.col("user_id").alias("src"), F.col("next").alias("dst")).where("dst IS NOT NULL AND dst <> src").distinct()


def chain(t: Tables) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    c = t.customer.select(F.col("c_custkey").alias("src"), F.lead("c_custkey").over(w).alias("next"), F.when(F.row_number().over(w) % 10 == 0, F.lag("c_custkey", 3).over(w)).alias("back"))
    return c.select("src", F.explode(F.array_compact(F.array("next", "back"))).alias("dst")).distinct()


@query("G1_adjacency", f"SELECT * FROM ({_USERS}) UNION SELECT * FROM ({_CHAIN})")
def g1(t: Tables) -> DataFrame:
    return G.adjacency(users(t), chain(t))


@query("G2_fan_in", f"SELECT dst AS id, count(DISTINCT src) AS fan_in FROM ({_USERS}) GROUP BY 1")
def g2(t: Tables) -> DataFrame:
    return G.fan_in(users(t))


@query("G3_blast_radius_d3", f"WITH RECURSIVE e AS ({_CHAIN}), r AS (SELECT src, dst, 1 AS d FROM e UNION SELECT r.src, e.dst, d + 1 FROM r JOIN e ON r.dst = e.src WHERE d < 3) SELECT dst AS id, count(DISTINCT src) AS blast_radius FROM r WHERE src <> dst GROUP BY 1")
def g3(t: Tables) -> DataFrame:
    return G.blast_radius(chain(t))


_CLOSURE = f"WITH RECURSIVE e AS ({_CHAIN}), tc AS (SELECT src, dst FROM e UNION SELECT tc.src, e.dst FROM tc JOIN e ON tc.dst = e.src)"


@query("G4_reach_count", _CLOSURE + "SELECT dst AS id, count(*) AS reach_count FROM tc WHERE src <> dst GROUP BY 1")
def g4(t: Tables) -> DataFrame:
    return G.reached_by(chain(t))


@query("G5_cycle_nodes", _CLOSURE + "SELECT src AS id FROM tc WHERE src = dst")
def g5(t: Tables) -> DataFrame:
    return G.strong_components(chain(t)).select("id")


@query("G6_strong_components", _CLOSURE + "SELECT a.src AS id, min(a.dst) AS scc FROM tc a JOIN tc b ON a.src = b.dst AND a.dst = b.src GROUP BY 1")
def g6(t: Tables) -> DataFrame:
    return G.strong_components(chain(t))


def _rank_sql(rounds: int, damping: float, share: str, *, start: str = "share", tolerance: float | None = None, every: int = 4) -> str:
    """Rounds as one query each; with a tolerance the result is that of the first of every so many rounds that moved no rank by as much."""
    parts = [f"e AS MATERIALIZED ({_USERS}), v AS MATERIALIZED (SELECT DISTINCT user_id AS id FROM events), n AS (SELECT count(*) AS n FROM v)"]
    parts.append(f"s AS MATERIALIZED (SELECT id, {share} AS share FROM v, n), d AS MATERIALIZED (SELECT src, count(*) AS d FROM e GROUP BY 1)")
    parts.append(f"r0 AS MATERIALIZED (SELECT id, {start} AS rank FROM s)")
    for k in range(rounds):
        got = f"SELECT dst, sum(rank / d.d) AS got FROM e JOIN d USING (src) JOIN r{k} ON id = src GROUP BY 1"
        loose = f"SELECT sum(rank) AS loose FROM r{k} WHERE id NOT IN (SELECT src FROM d)"
        parts.append(f"r{k + 1} AS MATERIALIZED (SELECT s.id, {1 - damping!r} * share + {damping!r} * (coalesce(got, 0) + coalesce(loose, 0) * share) AS rank FROM s LEFT JOIN ({got}) ON dst = s.id, ({loose}))")
    if tolerance is None:
        return "WITH " + ", ".join(parts) + f" SELECT id, round(rank, 6) AS rank FROM r{rounds}"
    stops = [k for k in range(1, rounds + 1) if k % every == 0 or k == rounds]
    moved = " UNION ALL ".join(f"SELECT {k} AS k, (SELECT max(abs(a.rank - b.rank)) FROM r{k} a JOIN r{k - 1} b USING (id)) AS moved" for k in stops)
    whole = " UNION ALL ".join(f"SELECT {k} AS k, id, rank FROM r{k}" for k in stops)
    parts.append(f"m AS ({moved}), o AS (SELECT coalesce(min(k) FILTER (moved < {tolerance!r}), {rounds}) AS k FROM m)")
    return "WITH " + ", ".join(parts) + f" SELECT id, round(rank, 6) AS rank FROM ({whole}) JOIN o USING (k)"


def _nodes(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("id")).distinct()


@query("G7_pagerank", _rank_sql(100, 0.85, "1.0 / n", tolerance=1e-6))
def g7(t: Tables) -> DataFrame:
    return G.pagerank(users(t), _nodes(t)).select("id", F.round("rank", 6).alias("rank"))


@query("G7_pagerank_warm", _rank_sql(100, 0.85, "1.0 / n", start="(1 + id % 5) / sum(1 + id % 5) OVER ()", tolerance=1e-6))
def g7_warm(t: Tables) -> DataFrame:
    """From stored ranks, which need not sum to 1."""
    stored = _nodes(t).select("id", (1 + F.col("id") % 5).cast("double").alias("rank"))
    return G.pagerank(users(t), _nodes(t), start=stored).select("id", F.round("rank", 6).alias("rank"))


@query("G8_rank_by_parts", "WITH r AS (SELECT n_nationkey AS id, CAST(n_nationkey + 1 AS DOUBLE) / 325 AS rank FROM nation), p AS (SELECT c_nationkey AS id, c_custkey AS part, count(o_orderkey) AS refs FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY ALL) SELECT id, part, round(rank * CASE WHEN sum(refs) OVER (PARTITION BY id) > 0 THEN refs / sum(refs) OVER (PARTITION BY id) ELSE 1 / count(*) OVER (PARTITION BY id) END, 9) AS rank FROM p JOIN r USING (id)")
def g8(t: Tables) -> DataFrame:
    ranks = t.nation.select(F.col("n_nationkey").alias("id"), ((F.col("n_nationkey") + 1).cast("double") / 325).alias("rank"))
    refs = t.orders.where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"))
    parts = t.customer.join(refs, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_nationkey").alias("id"), F.col("c_custkey").alias("part"), F.coalesce("k", F.lit(0)).alias("refs"))
    return G.split_rank(ranks, parts).withColumn("rank", F.round("rank", 9))


@query("G9_wiring_graph", "SELECT DISTINCT a AS src, b AS dst FROM (SELECT o_custkey AS a, l_suppkey AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey <> l_suppkey UNION SELECT l_suppkey, o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey <> l_suppkey)")
def g9(t: Tables) -> DataFrame:
    return G.undirected(t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("a"), F.col("l_suppkey").alias("b")))


@query("G10_personalized_pagerank", _rank_sql(25, 0.75, "CASE id WHEN 3 THEN 0.5 WHEN 7 THEN 0.25 WHEN 11 THEN 0.25 ELSE 0 END").replace("round(rank, 6) AS rank", "round(rank / max(rank) OVER (), 6) AS rank"))
def g10(t: Tables) -> DataFrame:
    seeds = t.spark.createDataFrame([(3, 0.5), (7, 0.25), (11, 0.25)], "id long, share double")
    ranks = G.pagerank(users(t), _nodes(t), damping=0.75, rounds=25, tolerance=None, seeds=seeds)
    top = ranks.agg(F.max("rank").alias("top"))  # one row
    return ranks.join(F.broadcast(top)).select("id", F.round(F.col("rank") / F.col("top"), 6).alias("rank"))


_BFS = "WITH RECURSIVE e AS ({e}), r AS (SELECT 7 AS id, 0 AS d UNION SELECT {to}, d + 1 FROM r JOIN e ON r.id = {at} WHERE d < {depth}) SELECT CAST(id AS BIGINT) AS id, min(d) AS level FROM r GROUP BY 1"


@query("G11_callers", _BFS.format(e=_CHAIN, to="e.src", at="e.dst", depth=3))
def g11(t: Tables) -> DataFrame:
    return G.levels(chain(t), t.spark.createDataFrame([(7,)], "id long"), 3, backward=True).select("id", "level")


@query("G12_impact", f"""
WITH RECURSIVE e AS ({_USERS}),
r AS (SELECT DISTINCT user_id AS root, user_id AS id, 0 AS d FROM events UNION SELECT root, e.src, d + 1 FROM r JOIN e ON r.id = e.dst WHERE d < 3),
n AS (
  SELECT root, count(DISTINCT id) AS visited, count(DISTINCT id) FILTER (d = 1 AND id <> root) AS refs,
    count(DISTINCT id) FILTER (d = 1 AND id <> root AND id % 2 = 0) AS callers, count(DISTINCT id // 10) AS files FROM r GROUP BY 1)
SELECT root AS id, callers, refs, visited, files,
  CASE WHEN callers >= 15 OR files >= 20 THEN 'high' WHEN callers >= 5 OR files >= 8 THEN 'medium' ELSE 'low' END AS risk FROM n""")
def g12(t: Tables) -> DataFrame:
    """Users of even number call, others refer; ten users are a file."""
    e = users(t)
    files = sum((F.expr(f"CAST(shiftright(mask, {k}) & 1023 <> 0 AS LONG)") for k in range(0, 60, 10)), F.lit(0))  # six files in a word
    reached = G.within(e, _nodes(t), 3, backward=True, width=60)
    seen = reached.groupBy(F.col("root").alias("id")).agg(F.sum(F.bit_count("mask").cast("long")).alias("visited"), F.sum(files).alias("files"))
    direct = e.groupBy(F.col("dst").alias("id")).agg(F.count_if(F.col("src") % 2 == 0).alias("callers"), F.count(F.lit(1)).alias("refs"))
    n = _nodes(t).join(seen, "id", "left").join(direct, "id", "left").select("id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("callers", "refs", "visited", "files")))
    high, medium = (F.col("callers") >= 15) | (F.col("files") >= 20), (F.col("callers") >= 5) | (F.col("files") >= 8)
    return n.withColumn("risk", F.when(high, "high").when(medium, "medium").otherwise("low"))


@query("G13_imports_within_2", _BFS.format(e=_CHAIN, to="e.dst", at="e.src", depth=2))
def g13(t: Tables) -> DataFrame:
    return G.levels(chain(t), t.spark.createDataFrame([(7,)], "id long"), 2).select("id", "level")


_WEIGHTS = "SELECT least(a, b) AS a, greatest(a, b) AS b, sum(w) AS weight FROM (SELECT user_id AS a, lead(user_id) OVER (PARTITION BY event_type ORDER BY event_id) AS b, CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.8 WHEN 'signup' THEN 0.5 WHEN 'purchase' THEN 0.3 ELSE 0.2 END::DOUBLE AS w FROM events) WHERE b IS NOT NULL AND a <> b GROUP BY ALL"


def _weighted(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    w = F.when(kind == "click", 1.0).when(kind == "view", 0.8).when(kind == "signup", 0.5).when(kind == "purchase", 0.3).otherwise(0.2)
    e = t.events.select("event_id", F.col("user_id").alias("a"), "event_type", w.alias("weight"))
    rows = G.following(e, "event_id", "a", by="event_type").select("a", F.col("next").alias("b"), "weight")
    return G.weighted(rows.where("b IS NOT NULL"))


@query("G14_weighted_graph", f"SELECT a, b, round(weight, 6) AS weight FROM ({_WEIGHTS})")
def g14(t: Tables) -> DataFrame:
    return _weighted(t).withColumn("weight", F.round("weight", 6))


@query("G15_communities")
def g15(t: Tables) -> DataFrame:
    return G.communities(chain(t).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1.0).alias("weight")))


@query("G16_split_large", "SELECT c_custkey AS id, c_nationkey AS community, CAST((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 12 AS BIGINT) AS part FROM customer")
def g16(t: Tables) -> DataFrame:
    return G.split_large(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("community")))


@query("G17_common_directory", "WITH p AS (SELECT page_id % 20 AS g, '/' || regexp_extract(url, '^[a-z]+://[^/]*/([a-z]*)', 1) || '/x/' || (page_id % 20) || '/' || page_id AS p FROM pages), e AS (SELECT g, min(p) AS lo, max(p) AS hi FROM p GROUP BY 1), s AS (SELECT g, string_split(regexp_replace(lo, '/[^/]*$', ''), '/') AS a, string_split(regexp_replace(hi, '/[^/]*$', ''), '/') AS b FROM e) SELECT g, array_to_string(list_slice(a, 1, coalesce(list_position(list_transform(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] IS DISTINCT FROM b[i]), true) - 1, len(a))), '/') AS name FROM s")
def g17(t: Tables) -> DataFrame:
    g = F.col("page_id") % 20
    path = F.concat(F.lit("/"), F.regexp_extract("url", "^[a-z]+://[^/]*/([a-z]*)", 1), F.lit("/x/"), g.cast("string"), F.lit("/"), F.col("page_id").cast("string"))
    return G.common_directory(t.pages.select(g.alias("g"), path.alias("p")), "g", "p")


@query("G18_community_events", "WITH c AS (SELECT c_nationkey AS o, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey // 2 ELSE c_nationkey END AS n, count(*) AS k FROM customer GROUP BY ALL), s AS (SELECT o, count(*) AS others, 1 - max(k) / sum(k) AS moved FROM c GROUP BY 1) SELECT 'merge' AS event, n AS community, count(*) AS others FROM c GROUP BY n HAVING count(*) > 1 UNION ALL SELECT 'split', o, others FROM s WHERE others > 1 UNION ALL SELECT 'drift', o, others FROM s WHERE moved > 0.3")
def g18(t: Tables) -> DataFrame:
    c = t.customer
    new = F.when(F.col("c_custkey") % 3 == 0, F.floor(F.col("c_nationkey") / 2).cast("int")).otherwise(F.col("c_nationkey"))
    return G.community_events(c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("community")), c.select(F.col("c_custkey").alias("id"), new.alias("community")))


@query("G19_staleness", """
SELECT abs(a - b) / b > 0.10 AS edges_moved, n <> 10000 AS files_moved, newest > TIMESTAMP '1998-01-01' AS newer_commit, config <> 'unknown' AS config_moved
FROM (SELECT count(*) AS a, count(*) FILTER (l_shipdate < TIMESTAMP '2000-01-01') AS b FROM lineitem), (SELECT count(*) AS n FROM events),
  (SELECT max(o_orderdate) AS newest FROM orders), (SELECT md5(string_agg(n_name, ',' ORDER BY n_nationkey)) AS config FROM nation)""")
def g19(t: Tables) -> DataFrame:
    """What has moved since a clustering that knew 10000 files, the lines up to 2000, commits up to 1998 and no configuration."""
    e = t.lineitem.agg(F.count(F.lit(1)).alias("a"), F.count_if(F.expr("l_shipdate < TIMESTAMP_NTZ '2000-01-01'")).alias("b"))
    newest = t.orders.agg(F.max("o_orderdate").alias("newest"))
    config = t.nation.agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), ",").cast("binary")).alias("config"))
    row = e.join(F.broadcast(t.events.agg(F.count(F.lit(1)).alias("n")))).join(F.broadcast(newest)).join(F.broadcast(config))  # one row each
    moved = F.abs(F.col("a") - F.col("b")) / F.col("b") > 0.10
    return row.select(moved.alias("edges_moved"), (F.col("n") != 10000).alias("files_moved"), F.expr("newest > TIMESTAMP_NTZ '1998-01-01'").alias("newer_commit"), (F.col("config") != "unknown").alias("config_moved"))


@query("G20_uncoupled_cochange", "WITH b AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS i FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) <= 30)), n AS (SELECT i, count(*) AS n FROM b GROUP BY i), p AS (SELECT x.i AS a, y.i AS b, count(*) AS shared FROM b x JOIN b y ON x.k = y.k AND x.i < y.i GROUP BY ALL) SELECT a AS item_a, b AS item_b, shared, round(shared / (na.n + nb.n - shared), 6) AS jaccard FROM p JOIN n na ON a = na.i JOIN n nb ON b = nb.i JOIN supplier x ON x.s_suppkey = a JOIN supplier y ON y.s_suppkey = b WHERE shared >= 2 AND x.s_nationkey <> y.s_nationkey")
def g20(t: Tables) -> DataFrame:
    pairs = R.cochange(t.lineitem, "l_orderkey", "l_suppkey").where("shared >= 2")
    s = t.supplier.select("s_nationkey", "s_suppkey")
    static = s.toDF("n", "item_a").join(s.toDF("n", "item_b"), "n").where("item_a < item_b").select("item_a", "item_b")
    return pairs.join(static, ["item_a", "item_b"], "left_anti").withColumn("jaccard", F.round("jaccard", 6))
