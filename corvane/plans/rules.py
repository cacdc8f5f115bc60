"""Resolution, rules, diffs, lessons, dates and paths over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import relational as R
from ..operators import rules as U
from ..operators import text as T
from .graph import chain
from .registry import ORACLE_SQL, QUERIES, Tables, micros, query


@query("R1_reference_ladder", "WITH r AS (SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'error'), c AS (SELECT event_id, 0 AS rung, n_nationkey AS target, 0 AS o FROM r JOIN nation ON n_nationkey = user_id UNION ALL SELECT event_id, 1, s_suppkey, abs(s_nationkey - 5) FROM r JOIN supplier ON s_nationkey = user_id % 30 WHERE event_type = 'click' UNION ALL SELECT event_id, 2, c_custkey, length(c_mktsegment) FROM r JOIN customer ON c_custkey = user_id AND event_type = 'view') SELECT r.event_id, arg_min(target, (rung, o, target)) AS target, CAST(min(rung) AS INTEGER) AS rung FROM r LEFT JOIN c USING (event_id) GROUP BY 1")
def r1(t: Tables) -> DataFrame:
    r = t.events.where("event_type <> 'error'").select("event_id", "user_id", "event_type")
    here = r.join(t.nation, F.col("n_nationkey") == F.col("user_id")).select("event_id", F.col("n_nationkey").cast("long").alias("target"), F.lit(0).cast("long").alias("o"))
    nearest = U.best_of_key(t.supplier.select("s_nationkey", F.col("s_suppkey").alias("target"), F.abs(F.col("s_nationkey") - 5).cast("long").alias("o")), "s_nationkey")
    near = r.where("event_type = 'click'").join(nearest, F.col("s_nationkey") == F.col("user_id") % 30).select("event_id", "target", "o")
    far = r.where("event_type = 'view'").join(t.customer, F.col("c_custkey") == F.col("user_id")).select("event_id", F.col("c_custkey").alias("target"), F.length("c_mktsegment").cast("long").alias("o"))
    return U.resolve(r, [here, near, far], "event_id")


@query("R2_import_resolution", "WITH i AS (SELECT page_id, ['http://' || h || '/index', 'http://' || h || '/' || lang || '/' || (page_id % 900), 'https://' || h || '/' || lang || '/' || (page_id % 900)] AS c FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS h, regexp_extract(url, '^[a-z]+://[^/]*/([a-z]*)', 1) AS lang FROM pages)), f AS (SELECT DISTINCT regexp_extract(url, '^[^?.]*(?:[.][^?.]*)*', 0) AS p FROM (SELECT regexp_replace(url, '[?].*$', '') AS url FROM pages)), x AS (SELECT page_id, j, c[j] AS p FROM i, unnest([1, 2, 3]) AS t(j)) SELECT page_id, arg_min(p, j) AS p FROM x JOIN f USING (p) GROUP BY 1")
def r2(t: Tables) -> DataFrame:
    h, lang = F.regexp_extract("url", "^[a-z]+://([^/]*)", 1), F.regexp_extract("url", "^[a-z]+://[^/]*/([a-z]*)", 1)
    tail = F.concat(h, F.lit("/"), lang, F.lit("/"), (F.col("page_id") % 900).cast("string"))
    paths = F.array(F.concat(F.lit("http://"), h, F.lit("/index")), F.concat(F.lit("http://"), tail), F.concat(F.lit("https://"), tail))
    return U.first_candidate(t.pages, "page_id", paths, t.pages.select(F.regexp_replace("url", "[?].*$", "").alias("p")), "p")


RULES = U.parse_rules([{"kind": "forbidden_dep", "from": "src/src1*/**", "to": "lang/en", "name": "no-en"}, {"kind": "forbidden_dep", "from": "src/*/?", "to": "lang/**", "severity": "blocking"}, {"kind": "forbidden_dep", "from": "src/src1*/**", "to": "lang/en"}, {"kind": "forbidden_dep", "from": "none/**", "to": "lang/xx", "name": "dead"}])
_EDGES = "SELECT doc_id, 'src/' || source || '/' || (doc_id % 40) AS f, 'lang/' || lang AS g FROM documents"


def _edges(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.concat(F.lit("src/"), "source", F.lit("/"), (F.col("doc_id") % 40).cast("string")).alias("f"), F.concat(F.lit("lang/"), "lang").alias("g"))


def _rid(source: str, target: str) -> str:
    """A rule's id in SQL: the first eight digits of the SHA-256 of its kind and patterns, parted by zero bytes."""
    return f"substr(sha256('forbidden_dep' || chr(0) || '{source}' || chr(0) || '{target}'), 1, 8)"


_FIRST, _SECOND, _DEAD = _rid("src/src1*/**", "lang/en"), _rid("src/*/?", "lang/**"), _rid("none/**", "lang/xx")


@query("R3_rule_ids", f"SELECT unnest([{_FIRST}, {_SECOND}, {_DEAD}]) AS rule, unnest([1, 2, 1]) AS level")
def r3(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(r.id, U.SEVERITIES[r.severity]) for r in RULES], "rule string, level int")


@query("R4_forbidden_dependencies", f"SELECT doc_id, f, g, CASE WHEN regexp_matches(f, '^src/src1[^/]*/.*$') AND g = 'lang/en' THEN {_FIRST} ELSE {_SECOND} END AS rule, CASE WHEN regexp_matches(f, '^src/src1[^/]*/.*$') AND g = 'lang/en' THEN 'advisory' ELSE 'blocking' END AS severity FROM ({_EDGES}) WHERE regexp_matches(f, '^src/src1[^/]*/.*$') AND g = 'lang/en' OR regexp_matches(f, '^src/[^/]*/[^/]$')")
def r4(t: Tables) -> DataFrame:
    return U.first_rule(_edges(t), RULES, "f", "g")


@query("R5_production_edges", "SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag <> 'R' AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 500)")
def r5(t: Tables) -> DataFrame:
    return R.without(t.lineitem.where("l_returnflag <> 'R'"), t.supplier.where("s_acctbal < 500").select(F.col("s_suppkey").alias("l_suppkey")), ["l_suppkey"]).select("l_suppkey", "l_partkey").distinct()


@query("R6_cycles", "WITH RECURSIVE e AS (SELECT c AS src, d AS dst FROM (SELECT c_custkey AS c, lead(c_custkey) OVER w AS d FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)) WHERE d IS NOT NULL UNION SELECT c, d FROM (SELECT c_custkey AS c, lag(c_custkey, 3) OVER w AS d, row_number() OVER w AS k FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)) WHERE d IS NOT NULL AND k % 10 = 0), tc AS (SELECT src, dst FROM e UNION SELECT tc.src, e.dst FROM tc JOIN e ON tc.dst = e.src), s AS (SELECT a.src AS id, min(a.dst) AS scc FROM tc a JOIN tc b ON a.src = b.dst AND a.dst = b.src GROUP BY 1) SELECT scc, string_agg(CAST(id AS VARCHAR), ' -> ' ORDER BY id) AS fingerprint, count(*) AS size FROM s GROUP BY 1")
def r6(t: Tables) -> DataFrame:
    s = G.strong_components(chain(t))
    return s.groupBy("scc").agg(F.array_join(F.transform(F.sort_array(F.collect_set("id")), lambda x: x.cast("string")), " -> ").alias("fingerprint"), F.count(F.lit(1)).alias("size"))


@query("R7_max_fan_in", "WITH n AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS fan_in, count(DISTINCT CASE WHEN l_shipdate < TIMESTAMP '1999-01-01' THEN l_suppkey END) AS before FROM lineitem GROUP BY 1) SELECT l_partkey, fan_in, CASE WHEN fan_in > before THEN 'blocking' ELSE 'info' END AS severity FROM n WHERE fan_in > 30")
def r7(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("fan_in"), F.countDistinct(F.when(F.expr("l_shipdate < TIMESTAMP_NTZ '1999-01-01'"), F.col("l_suppkey"))).alias("before"))
    return n.where("fan_in > 30").select("l_partkey", "fan_in", F.when(F.col("fan_in") > F.col("before"), "blocking").otherwise("info").alias("severity"))


@query("R8_external_crates", "SELECT c_mktsegment AS crate, c_nationkey AS file, min(c_custkey) AS first FROM customer WHERE regexp_matches(lower(c_mktsegment), '^(build|auto)[^/]*$') AND c_nationkey NOT IN (3, 7) GROUP BY ALL")
def r8(t: Tables) -> DataFrame:
    name = F.lower("c_mktsegment")
    hit = R.path_matches(name, "build*") | R.path_matches(name, "auto*")
    return t.customer.where(hit & ~F.col("c_nationkey").isin(3, 7)).groupBy(F.col("c_mktsegment").alias("crate"), F.col("c_nationkey").alias("file")).agg(F.min("c_custkey").alias("first"))


@query("R9_forbidden_pattern", r"SELECT doc_id, CAST(line AS BIGINT) AS line, substr(txt, 1, 80) AS snippet FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS txt, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) WHERE regexp_matches(txt, '(token|key|password) *= *.')")
def r9(t: Tables) -> DataFrame:
    lines = t.documents.where(F.col("text").rlike("(token|key|password) *= *.")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "txt"))
    return lines.where(F.col("txt").rlike("(token|key|password) *= *.")).select("doc_id", (F.col("i") + 1).cast("long").alias("line"), F.substring("txt", 1, 80).alias("snippet"))


@query("R10_rule_coverage", f"WITH p AS (SELECT f AS p FROM ({_EDGES}) UNION SELECT g FROM ({_EDGES})) SELECT {_FIRST} AS rule, count(*) FILTER (regexp_matches(p, '^src/src1[^/]*/.*$')) AS sources, count(*) FILTER (p = 'lang/en' OR starts_with(p, 'lang/en/')) AS targets FROM p UNION ALL SELECT {_SECOND}, count(*) FILTER (regexp_matches(p, '^src/[^/]*/[^/]$')), count(*) FILTER (starts_with(p, 'lang/')) FROM p UNION ALL SELECT {_DEAD}, count(*) FILTER (starts_with(p, 'none/')), count(*) FILTER (p = 'lang/xx') FROM p")
def r10(t: Tables) -> DataFrame:
    e = _edges(t)
    return U.rule_coverage(e.select(F.col("f").alias("p")).union(e.select("g")).distinct(), "p", RULES)


@query("R11_waivers_and_acks", "WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) AS waived FROM lineitem WHERE l_quantity > 40) SELECT l_orderkey, l_linenumber, l_partkey, waived FROM f WHERE waived UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, false FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey) AS k FROM f WHERE NOT waived) WHERE k > l_suppkey % 3")
def r11(t: Tables) -> DataFrame:
    found = U.partition_by_waiver(t.lineitem.where("l_quantity > 40"), t.supplier.where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey")), ["l_suppkey"])
    acks = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_suppkey") % 3).alias("accepted"))
    left = R.surplus(found.where("NOT waived").withColumn("flag", F.col("l_returnflag")), acks.join(t.lineitem.select("l_suppkey", F.col("l_returnflag").alias("flag")).distinct(), "l_suppkey"), ["l_suppkey", "flag"], ["l_orderkey", "l_linenumber", "l_partkey"])
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "waived"]
    return found.where("waived").select(cols).union(left.select(cols))


@query("R11b_acceptance_names", "WITH k AS (SELECT p_name, count(*) AS n FROM part WHERE p_partkey < 300 GROUP BY 1), a AS (SELECT DISTINCT p_name FROM part) SELECT p_name, CASE WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status FROM a LEFT JOIN k USING (p_name)")
def r11b(t: Tables) -> DataFrame:
    k = t.part.where("p_partkey < 300").groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))  # the rules that are declared
    return t.part.select("p_name").distinct().join(k, "p_name", "left").select("p_name", F.when(F.col("n").isNull(), "unknown").when(F.col("n") > 1, "ambiguous").otherwise("ok").alias("status"))


@query("R11c_baseline", "SELECT l_suppkey, l_returnflag, count(*) AS accepted FROM lineitem WHERE l_quantity > 45 GROUP BY ALL")
def r11c(t: Tables) -> DataFrame:
    return t.lineitem.where("l_quantity > 45").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("accepted"))


@query("R11d_ratchet_drift", "SELECT n_nationkey AS id, CASE WHEN level IS NULL THEN 'removed' ELSE 'below_floor' END AS drift FROM nation LEFT JOIN (SELECT s_nationkey AS id, CAST(max(s_suppkey % 3) AS INTEGER) AS level FROM supplier WHERE s_acctbal > 6000 GROUP BY 1) ON id = n_nationkey WHERE level IS NULL OR level < n_regionkey % 3")
def r11d(t: Tables) -> DataFrame:
    levels = t.supplier.where("s_acctbal > 6000").groupBy(F.col("s_nationkey").alias("id")).agg(F.max(F.col("s_suppkey") % 3).alias("level"))
    return U.ratchet_drift(t.nation.select(F.col("n_nationkey").alias("id"), (F.col("n_regionkey") % 3).alias("floor")), levels)


_OLD = "SELECT conv_id AS k, turn // 2 AS p, role AS sig, md5(replace(text, ' ', '')) AS body, text FROM conversations WHERE turn % 2 = 0"
_NEW = "SELECT conv_id AS k, turn // 2 AS p, CASE WHEN conv_id % 5 = 0 THEN 'x' ELSE role END AS sig, md5(replace(text2, ' ', '')) AS body, text2 AS text FROM (SELECT *, CASE conv_id % 5 WHEN 1 THEN text || '!' WHEN 2 THEN text || ' ' ELSE text END AS text2 FROM conversations WHERE turn % 2 = 0 AND conv_id % 7 <> 0)"


@query("R13_symbol_diff", f"SELECT k, p, CASE WHEN o.sig IS NULL THEN 'added' WHEN n.sig IS NULL THEN 'deleted' WHEN o.sig <> n.sig THEN 'signature' WHEN o.body <> n.body THEN 'body' ELSE 'cosmetic' END AS change FROM ({_OLD}) o FULL JOIN ({_NEW}) n USING (k, p) WHERE o.sig IS NULL OR n.sig IS NULL OR o.sig <> n.sig OR o.text <> n.text")
def r13(t: Tables) -> DataFrame:
    c = t.conversations.where("turn % 2 = 0").select(F.col("conv_id").alias("k"), F.floor(F.col("turn") / 2).alias("p"), "role", "text")
    body = lambda x: F.md5(F.replace(x, F.lit(" "), F.lit("")).cast("binary"))
    text = F.when(F.col("k") % 5 == 1, F.concat("text", F.lit("!"))).when(F.col("k") % 5 == 2, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    new = c.where("k % 7 <> 0").select("k", "p", F.when(F.col("k") % 5 == 0, "x").otherwise(F.col("role")).alias("sig"), body(text).alias("body"), text.alias("text"))
    return U.snapshot_diff(c.select("k", "p", F.col("role").alias("sig"), body(F.col("text")).alias("body"), "text"), new, ["k", "p"], "sig", "body")


@query("R14_orphans", "WITH live AS (SELECT l_partkey AS p FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-06-01' AND l_returnflag <> 'R' UNION SELECT p_partkey FROM part WHERE p_size >= 45), had AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01') SELECT p_partkey, CASE WHEN p_partkey IN (FROM had) THEN 'orphaned' ELSE 'added_unused' END AS kind FROM part WHERE p_partkey NOT IN (FROM live)")
def r14(t: Tables) -> DataFrame:
    live = t.lineitem.where("l_shipdate >= TIMESTAMP_NTZ '2000-06-01' AND l_returnflag <> 'R'").select(F.col("l_partkey").alias("p_partkey")).union(t.part.where("p_size >= 45").select("p_partkey"))
    had = t.lineitem.where("l_shipdate < TIMESTAMP_NTZ '1999-01-01'").select(F.col("l_partkey").alias("p_partkey"), F.lit("orphaned").alias("kind")).distinct()
    return R.without(t.part, live, ["p_partkey"]).join(had, "p_partkey", "left").select("p_partkey", F.coalesce("kind", F.lit("added_unused")).alias("kind"))


@query("R15_sibling_patterns", "WITH f AS (SELECT l_partkey AS feature, count(*) FILTER (l_shipdate < TIMESTAMP '1999-01-01') AS pre, count(*) FILTER (l_shipdate >= TIMESTAMP '1999-01-01') AS post, string_agg(DISTINCT CASE WHEN l_shipdate >= TIMESTAMP '1999-01-01' THEN CAST(l_suppkey % 5 AS VARCHAR) END, ',' ORDER BY CASE WHEN l_shipdate >= TIMESTAMP '1999-01-01' THEN CAST(l_suppkey % 5 AS VARCHAR) END) AS sites FROM lineitem GROUP BY 1) SELECT sites, count(*) AS features, min(feature) AS first FROM f WHERE pre > post AND post > 0 AND post <= 25 AND pre <= 40 GROUP BY 1")
def r15(t: Tables) -> DataFrame:
    after = F.expr("l_shipdate >= TIMESTAMP_NTZ '1999-01-01'")
    f = t.lineitem.groupBy(F.col("l_partkey").alias("feature")).agg(F.count_if(~after).alias("pre"), F.count_if(after).alias("post"), F.array_join(F.sort_array(F.collect_set(F.when(after, (F.col("l_suppkey") % 5).cast("string")))), ",").alias("sites"))
    return f.where("pre > post AND post BETWEEN 1 AND 25 AND pre <= 40").groupBy("sites").agg(F.count(F.lit(1)).alias("features"), F.min("feature").alias("first"))


@query("R16_firing_log", """
WITH k AS (
  SELECT user_id AS site, ts, event_id, CASE WHEN event_type = 'error' THEN 'fire' WHEN event_type = 'view' THEN 'revert' WHEN event_type = 'signup' AND value < 1 THEN 'delete' END AS kind FROM events),
s AS (SELECT *, lag(kind) OVER (PARTITION BY site ORDER BY ts, event_id) AS before FROM k WHERE kind IS NOT NULL),
f AS (SELECT site, count(*) FILTER (kind = 'revert' AND before = 'fire') AS epoch, arg_max(kind, (ts, event_id)) AS last FROM s GROUP BY 1)
SELECT DISTINCT site, coalesce(epoch, 0) AS epoch, CASE last WHEN 'fire' THEN 'present' WHEN 'revert' THEN 'changed' WHEN 'delete' THEN 'file_deleted' ELSE 'unknown' END AS status
FROM (SELECT DISTINCT site FROM k) LEFT JOIN f USING (site)""")
def r16(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "fire").when(F.col("event_type") == "view", "revert").when((F.col("event_type") == "signup") & (F.col("value") < 1), "delete")
    return U.fold_sites(t.events.select(F.col("user_id").alias("site"), F.col("ts").alias("at"), F.col("event_id").alias("id"), kind.alias("kind")), "site")


@query("R17_check_gate", f"SELECT severity, count(*) AS findings, severity = 'blocking' AS fails FROM (SELECT CASE WHEN regexp_matches(f, '^src/src1[^/]*/.*$') AND g = 'lang/en' THEN 'advisory' ELSE 'blocking' END AS severity FROM ({_EDGES}) WHERE regexp_matches(f, '^src/src1[^/]*/.*$') AND g = 'lang/en' OR regexp_matches(f, '^src/[^/]*/[^/]$')) GROUP BY 1")
def r17(t: Tables) -> DataFrame:
    return U.first_rule(_edges(t), RULES, "f", "g").groupBy("severity").agg(F.count(F.lit(1)).alias("findings")).withColumn("fails", F.col("severity") == "blocking")


@query("R18_hot_files", "WITH n AS (SELECT l_suppkey AS id, count(*) / (SELECT count(*) FROM lineitem) AS rank, count(DISTINCT l_orderkey) AS blast FROM lineitem GROUP BY 1) SELECT id, rank >= 0.0101 AS by_rank, blast >= 600 AS by_blast FROM n WHERE rank >= 0.0101 OR blast >= 600")
def r18(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy(F.col("l_suppkey").alias("id")).agg(F.count(F.lit(1)).alias("k"), F.countDistinct("l_orderkey").alias("blast")).join(F.broadcast(t.lineitem.agg(F.count(F.lit(1)).alias("all"))))
    return n.select("id", (F.col("k") / F.col("all") >= 0.0101).alias("by_rank"), (F.col("blast") >= 600).alias("by_blast")).where("by_rank OR by_blast")


@query("R19_vocabulary", "WITH q AS (SELECT unnest(['red bolt', 'gear', 'PROMO', 'nothing']) AS term), c AS (SELECT term, 0 AS tier, p_name AS target FROM q JOIN part ON p_name = term UNION SELECT term, 1, p_type FROM q JOIN part ON p_type = term UNION SELECT term, 2, p_name FROM q JOIN part ON contains(p_name, term)) SELECT term, CAST(tier AS INTEGER) AS tier, target FROM c QUALIFY tier = min(tier) OVER (PARTITION BY term)")
def r19(t: Tables) -> DataFrame:
    q = t.spark.createDataFrame([("red bolt",), ("gear",), ("PROMO",), ("nothing",)], "term string")
    names, kinds = t.part.select(F.col("p_name").alias("target")).distinct(), t.part.select(F.col("p_type").alias("target")).distinct()
    tiers = [(names, F.col("target") == F.col("term")), (kinds, F.col("target") == F.col("term")), (names, F.contains("target", "term"))]
    c = None
    for i, (side, on) in enumerate(tiers):
        hit = side.join(F.broadcast(q), on).select("term", F.lit(i).alias("tier"), "target")
        c = hit if c is None else c.union(hit)
    return c.withColumn("least", F.min("tier").over(Window.partitionBy("term"))).where("tier = least").drop("least").distinct()


@query("R20_lesson_context", "WITH l AS (SELECT p_partkey AS id, p_brand AS anchor, p_size >= 25 AS verified, p_size % 5 AS specificity, p_retailprice AS confidence FROM part), d AS (SELECT * FROM l WHERE verified OR anchor NOT IN (SELECT anchor FROM l WHERE verified AND specificity = 4)) SELECT anchor, id FROM d QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY verified DESC, specificity DESC, confidence DESC, id) <= 10")
def r20(t: Tables) -> DataFrame:
    lessons = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("anchor"), (F.col("p_size") >= 25).alias("verified"), (F.col("p_size") % 5).alias("specificity"), F.col("p_retailprice").alias("confidence"))
    held = R.without(lessons.where("NOT verified"), lessons.where("verified AND specificity = 4"), ["anchor"]).select(lessons.columns)
    both = lessons.where("verified").union(held)
    return R.top_per_group(both, ["anchor"], [F.desc("verified"), F.desc("specificity"), F.desc("confidence"), F.col("id")], 10).select("anchor", "id")


@query("R21_lesson_search", "WITH a AS (SELECT p_partkey AS id, 0 AS tier FROM part WHERE p_name LIKE 'hot %'), b AS (SELECT p_partkey AS id, 1 AS tier FROM part WHERE p_type = 'PROMO' AND p_name NOT LIKE 'hot %') SELECT id, tier FROM (FROM a UNION ALL FROM b) ORDER BY tier, id LIMIT 400")
def r21(t: Tables) -> DataFrame:
    hot = F.col("p_name").startswith("hot ")
    hits = t.part.where(hot | (F.col("p_type") == "PROMO")).select(F.col("p_partkey").alias("id"), F.when(hot, 0).otherwise(1).alias("tier"))
    return hits.orderBy("tier", "id").limit(400)


@query("R22_lesson_lifecycle", "WITH e AS (SELECT user_id AS lesson, ts, event_id, CASE event_type WHEN 'purchase' THEN 'cite' WHEN 'error' THEN 'anti' END AS kind, event_id % 10 AS who FROM events WHERE event_type IN ('purchase', 'error')), s AS (SELECT *, CASE WHEN kind = 'anti' THEN -1 WHEN row_number() OVER (PARTITION BY lesson, kind, who ORDER BY ts, event_id) = 1 THEN 1 ELSE 0 END AS d FROM e), r AS (SELECT *, sum(d) OVER w AS s FROM s WINDOW w AS (PARTITION BY lesson ORDER BY ts, event_id)), m AS (SELECT *, least(0, min(s) OVER (PARTITION BY lesson ORDER BY ts, event_id)) AS low FROM r) SELECT lesson, CAST(s - low AS BIGINT) AS confidence, s - low >= 2 AS verified FROM m QUALIFY row_number() OVER (PARTITION BY lesson ORDER BY ts DESC, event_id DESC) = 1")
def r22(t: Tables) -> DataFrame:
    e = t.events.where("event_type IN ('purchase', 'error')").select(F.col("user_id").alias("lesson"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.when(F.col("event_type") == "purchase", "cite").otherwise("anti").alias("kind"), (F.col("event_id") % 10).alias("by"))
    return U.fold_confidence(e, "lesson")


@query("R23_lesson_enrichment", "SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*/([a-z]*)', 1) AS directory, n <= 2 AS rare_root FROM (SELECT *, count(*) OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/]*)', 1)) AS n FROM pages)")
def r23(t: Tables) -> DataFrame:
    root = F.regexp_extract("url", "^[a-z]+://([^/]*)", 1)
    rare = t.pages.groupBy(root.alias("root")).agg((F.count(F.lit(1)) <= 2).alias("rare_root"))
    return t.pages.withColumn("root", root).join(rare, "root").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]*/([a-z]*)", 1).alias("directory"), "rare_root")


@query("R24_read_lines", "SELECT doc_id, CAST(line AS BIGINT) AS line, txt FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS txt, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) WHERE line <= 500")
def r24(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "txt")).where("i < 500").select("doc_id", (F.col("i") + 1).cast("long").alias("line"), "txt")


@query("R25_release_pack", f"""
WITH o2 AS ({ORACLE_SQL["O2_refactor_targets"]}), o4 AS ({ORACLE_SQL["O4_unreachable"]}), g6 AS ({ORACLE_SQL["G6_strong_components"]}), g20 AS ({ORACLE_SQL["G20_uncoupled_cochange"]}),
dead AS (
  SELECT p_partkey, p_size FROM (
    SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 30)
    QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) <= 8) ORDER BY p_size DESC, p_partkey LIMIT 40),
cycles AS (SELECT scc, count(*) AS n FROM g6 GROUP BY 1 ORDER BY n DESC, scc LIMIT 10)
SELECT 'target' AS part, o_custkey AS a, NULL::BIGINT AS b, score::DOUBLE AS score FROM o2
UNION ALL SELECT 'dead', p_partkey, NULL, p_size FROM dead
UNION ALL SELECT 'unreachable', p_partkey, NULL, NULL FROM (SELECT * FROM o4 ORDER BY p_partkey LIMIT 20)
UNION ALL SELECT 'cycle', scc, id, n FROM (SELECT g6.scc, id, n FROM g6 JOIN cycles USING (scc) QUALIFY row_number() OVER (PARTITION BY g6.scc ORDER BY id) <= 12)
UNION ALL SELECT 'pair', item_a, item_b, jaccard FROM (SELECT * FROM g20 ORDER BY jaccard DESC, item_a, item_b LIMIT 20)""")
def r25(t: Tables) -> DataFrame:
    """Refactor targets, dead and unreachable candidates, cycles and uncoupled pairs, each section capped as its feature."""
    of = lambda name: QUERIES[name](t.spark, t.sf_dir)
    row = lambda df, part, a, b=None, score=None: df.select(F.lit(part).alias("part"), F.col(a).cast("long").alias("a"), (F.col(b) if b else F.lit(None)).cast("long").alias("b"), (F.col(score) if score else F.lit(None)).cast("double").alias("score"))
    live = t.lineitem.where("l_returnflag = 'N' AND l_quantity > 30").select(F.col("l_partkey").alias("p_partkey"))
    dead = R.top_per_group(R.without(t.part.select("p_partkey", "p_brand", "p_size"), live, ["p_partkey"]), ["p_brand"], [F.desc("p_size"), F.col("p_partkey")], 8, 40)
    nodes = of("G6_strong_components")
    cycles = nodes.groupBy("scc").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "scc").limit(10)
    cycle = R.top_per_group(nodes.join(F.broadcast(cycles), "scc"), ["scc"], [F.col("id")], 12)
    pairs = of("G20_uncoupled_cochange").orderBy(F.desc("jaccard"), "item_a", "item_b").limit(20)
    sections = [row(of("O2_refactor_targets"), "target", "o_custkey", None, "score"), row(dead, "dead", "p_partkey", None, "p_size"), row(of("O4_unreachable").orderBy("p_partkey").limit(20), "unreachable", "p_partkey"), row(cycle, "cycle", "scc", "id", "n"), row(pairs, "pair", "item_a", "item_b", "jaccard")]
    return reduce(DataFrame.union, sections)


@query("R26_ranking_eval", "WITH r AS (SELECT user_id % 7 AS workspace, user_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS rank, event_type FROM events), h AS (SELECT workspace, user_id, min(rank) AS rank FROM r WHERE event_type = 'purchase' GROUP BY ALL) SELECT workspace, round(avg(CASE WHEN rank = 0 THEN 1.0 ELSE 0 END), 6) AS top1, round(avg(CASE WHEN rank < 3 THEN 1.0 ELSE 0 END), 6) AS top3, round(avg(1 / (rank + 1)), 6) AS mrr FROM h GROUP BY 1")
def r26(t: Tables) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")) - 1
    h = t.events.select("user_id", "event_type", rank.alias("rank")).where("event_type = 'purchase'").groupBy("user_id").agg(F.min("rank").alias("rank"))
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return h.groupBy((F.col("user_id") % 7).alias("workspace")).agg(share(F.col("rank") == 0).alias("top1"), share(F.col("rank") < 3).alias("top3"), F.round(F.avg(1 / (F.col("rank") + 1)), 6).alias("mrr"))


@query("R27_heal_duplicates", "SELECT min(doc_id) AS doc_id, md5(text) AS h FROM documents GROUP BY text")
def r27(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "h")


@query("J14_greedy_matching")
def j14(t: Tables) -> DataFrame:
    """Assistant turns to the next user turn of their conversation by word overlap, one to one."""
    c = t.conversations.select("conv_id", "turn", "role", T.name_parts(F.col("text")).alias("w"))
    a, u = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("a"), F.col("w").alias("wa")), c.where("role = 'user'").select("conv_id", F.col("turn").alias("b"), F.col("w").alias("wb"))
    pairs = a.join(u, "conv_id").select("conv_id", "a", "b", F.round(T.jaccard(F.col("wa"), F.col("wb")), 6).alias("score")).where("score >= 0.02")
    return U.greedy_matching(pairs, "a", "b", "score", "conv_id")


@query("D1_history_cutoff", "SELECT count(*) AS n FROM orders WHERE epoch(o_orderdate) >= (SELECT epoch(max(o_orderdate)) // 86400 * 86400 - 90 * 86400 FROM orders)")
def d1(t: Tables) -> DataFrame:
    at = F.floor(micros("o_orderdate") / 1_000_000)
    newest = t.orders.agg((F.floor(F.max(at) / 86400) * 86400 - 90 * 86400).alias("cutoff"))  # one row
    return t.orders.withColumn("at", at).join(F.broadcast(newest), F.col("at") >= F.col("cutoff")).agg(F.count(F.lit(1)).alias("n"))


@query("D2_decay", "SELECT user_id, greatest(max(ts), max(CASE WHEN event_type = 'purchase' THEN ts END)) < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 43200 SECONDS AS archived FROM events GROUP BY 1")
def d2(t: Tables) -> DataFrame:
    limit = F.expr("TIMESTAMP_NTZ '2024-01-30 12:00:00' - INTERVAL '43200' SECOND")  # now is a parameter, so that results repeat
    return t.events.groupBy("user_id").agg((F.greatest(F.max("ts"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts")))) < limit).alias("archived"))


@query("X1_paths", r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS p FROM pages),
s AS (SELECT page_id, p, string_split(regexp_replace(p, '[^/]*$', '') || CASE page_id % 3 WHEN 0 THEN '../x/./y' WHEN 1 THEN './/z' ELSE '../../../w' END, '/') AS parts FROM p)
SELECT page_id, regexp_replace(p, '/[^/]*$', '') AS parent, regexp_extract(p, '([^/]*?)(\.[^./]*)?$', 1) AS stem,
  array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(parts, lambda x: [x])),
    lambda done, x: CASE WHEN x[1] IN ('', '.') THEN done WHEN x[1] = '..' THEN list_slice(done, 1, len(done) - 1) ELSE list_concat(done, x) END), '/') AS resolved FROM s""")
def x1(t: Tables) -> DataFrame:
    p = t.pages.select("page_id", F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1).alias("p"))
    relative = F.when(F.col("page_id") % 3 == 0, "../x/./y").when(F.col("page_id") % 3 == 1, ".//z").otherwise("../../../w")
    stem = F.regexp_extract("p", r"([^/]*?)(\.[^./]*)?$", 1)
    return p.select("page_id", F.regexp_replace("p", "/[^/]*$", "").alias("parent"), stem.alias("stem"), U.relative_to(F.col("p"), relative).alias("resolved"))


@query("X2_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS doc FROM events")
def x2(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("doc"))


@query("X3_arrays_and_maps", "SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1")
def x3(t: Tables) -> DataFrame:
    m = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    return m.select("user_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


@query("S4_string_literals", r"""SELECT page_id, lit, count(*) AS n FROM (SELECT page_id, substr(trim(regexp_replace(lit, '[ \t\n]+', ' ', 'g')), 1, 40) AS lit FROM (SELECT page_id, unnest(regexp_extract_all(html, '"([^"]{3,})"', 1)) AS lit FROM pages)) GROUP BY ALL""")
def s4(t: Tables) -> DataFrame:
    lits = t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('"([^"]{3,})"'), F.lit(1))).alias("lit"))
    return lits.select("page_id", F.substring(F.trim(F.regexp_replace("lit", "[ \t\n]+", " ")), 1, 40).alias("lit")).groupBy("page_id", "lit").agg(F.count(F.lit(1)).alias("n"))
