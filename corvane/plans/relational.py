"""Lookups, joins, aggregations, windows and set operations over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators.iterate import shared_folder
from .registry import Tables, micros, query


@query("S10_table_scan", "SELECT p_partkey, p_name, p_type FROM part")
def s10(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_name", "p_type")


@query("F1_exact_name", "SELECT p_partkey, p_name FROM part WHERE p_name = 'red bolt' AND p_type IN (SELECT min(p_type) FROM part WHERE p_name = 'red bolt')")
def f1(t: Tables) -> DataFrame:
    kind = R.by_name(t.part, "p_name", "red bolt").agg(F.min("p_type").alias("p_type"))  # one row
    return R.by_name(t.part, "p_name", "red bolt").join(F.broadcast(kind), "p_type").select("p_partkey", "p_name")


@query("F2_tiered_search", "SELECT p_partkey, 1 AS tier, CAST(0.6 AS DOUBLE) AS confidence FROM part WHERE regexp_matches(lower(p_name), '(^|[^a-z0-9])gi') AND NOT EXISTS (SELECT 1 FROM part WHERE lower(p_name) = 'gi') UNION ALL SELECT p_partkey, 0, 1.0 FROM part WHERE lower(p_name) = 'gi'")
def f2(t: Tables) -> DataFrame:
    return R.tiered(t.part, "p_name", "gi").select("p_partkey", "tier", "confidence")


@query("F3_alternation", "SELECT p_partkey, p_name, CASE p_name WHEN 'small ring' THEN 0 WHEN 'hot gear' THEN 1 ELSE 2 END AS term_no FROM part WHERE p_name IN ('small ring', 'hot gear', 'old bolt')")
def f3(t: Tables) -> DataFrame:
    return R.alternatives(t.part, "p_name", "small ring|hot gear|old bolt", ["p_partkey"]).select("p_partkey", "p_name", "term_no")


@query("F3_tiered_alternation", """
SELECT p_partkey, p_name, CASE WHEN p_name = 'small ring' THEN 0 WHEN p_name = 'hot gear' THEN 1 ELSE 2 END AS term_no, 'prefix' AS tier
FROM part WHERE p_name IN ('small ring', 'hot gear') OR starts_with(p_name, 'old')""")
def f3_tiers(t: Tables) -> DataFrame:
    return R.tiered_alternatives(t.part.select("p_partkey", "p_name"), "p_name", "small ring|hot gear|old", ["p_partkey"])


@query("F4_prefix_like", r"SELECT c_custkey FROM customer WHERE c_name LIKE 'Customer#0000001%' AND c_name NOT LIKE '%7' AND c_mktsegment LIKE '%!_%' ESCAPE '!' OR starts_with(c_mktsegment, 'BUILD')")
def f4(t: Tables) -> DataFrame:
    return t.customer.where(F.expr("c_name LIKE 'Customer#0000001%' AND c_name NOT LIKE '%7' AND c_mktsegment LIKE '%!_%' ESCAPE '!'") | F.col("c_mktsegment").startswith("BUILD")).select("c_custkey")


@query("F5_glob_paths", r"SELECT page_id, regexp_matches(p, '^/en/[^/]*$') AS one, regexp_matches(p, '^/(?:.*/)?[0-9]*4[^/]*$') AS deep, p = '/en' OR starts_with(p, '/en/') AS under FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) AS p FROM pages)")
def f5(t: Tables) -> DataFrame:
    p = t.pages.select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/]*(/[^?#]*)", 1).alias("p"))
    return p.select("page_id", R.path_matches(F.col("p"), "/en/*").alias("one"), F.col("p").rlike("^/(?:.*/)?[0-9]*4[^/]*$").alias("deep"), R.path_matches(F.col("p"), "/en").alias("under"))


@query("F6_flag_bits", "SELECT p_partkey, (p_size & 1) = 1 AS test, (p_size & 15) = 0 AS plain FROM part")
def f6(t: Tables) -> DataFrame:
    size = F.col("p_size")
    return t.part.select("p_partkey", (size.bitwiseAND(1) == 1).alias("test"), (size.bitwiseAND(15) == 0).alias("plain"))


@query("F7_null_safe_inequality", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'P') IS DISTINCT FROM 'F'")
def f7(t: Tables) -> DataFrame:
    return t.orders.withColumn("s", F.nullif("o_orderstatus", F.lit("P"))).where(~F.col("s").eqNullSafe("F")).select("o_orderkey")


@query("F8_kind_compatibility", "SELECT event_id FROM events WHERE (event_type, CAST(event_id % 3 AS INTEGER)) IN (('click', 0), ('click', 1), ('view', 1), ('purchase', 2))")
def f8(t: Tables) -> DataFrame:
    allowed = t.spark.createDataFrame([("click", 0), ("click", 1), ("view", 1), ("purchase", 2)], "event_type string, k int")  # 4 rows
    return t.events.withColumn("k", (F.col("event_id") % 3).cast("int")).join(F.broadcast(allowed), ["event_type", "k"], "left_semi").select("event_id")


@query("F9_test_classification", r"SELECT page_id, regexp_matches(url, '(^|/)(en|de)/[0-9]*1[0-9]*(\.html)?(\?|$)') OR (page_id & 8) = 8 AS is_test FROM pages")
def f9(t: Tables) -> DataFrame:
    return t.pages.select("page_id", (F.col("url").rlike(r"(^|/)(en|de)/[0-9]*1[0-9]*(\.html)?(\?|$)") | (F.col("page_id").bitwiseAND(8) == 8)).alias("is_test"))


@query("F10_name_resolution", "WITH n AS (SELECT p_name, count(*) AS k, min(p_partkey) AS first FROM part GROUP BY p_name), q AS (SELECT unnest(['red bolt', 'no such part', 'old gear', 'PROMO']) AS term) SELECT term, CASE WHEN k IS NULL THEN 'not_found' WHEN k = 1 THEN 'unique' ELSE 'ambiguous' END AS status, CAST(coalesce(least(k, 10), 0) AS BIGINT) AS candidates FROM q LEFT JOIN n ON term = p_name")
def f10(t: Tables) -> DataFrame:
    terms = t.spark.createDataFrame([("red bolt",), ("no such part",), ("old gear",), ("PROMO",)], "term string")
    n = t.part.groupBy("p_name").agg(F.count(F.lit(1)).alias("k"))
    status = F.when(F.col("k").isNull(), "not_found").when(F.col("k") == 1, "unique").otherwise("ambiguous")
    return terms.join(n, F.col("term") == F.col("p_name"), "left").select("term", status.alias("status"), F.coalesce(F.least("k", F.lit(10)), F.lit(0)).cast("long").alias("candidates"))


@query("F11_changed_scope", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem l WHERE EXISTS (SELECT 1 FROM (SELECT l_orderkey AS k, min(l_linenumber) AS a, min(l_linenumber) + 1 AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) c WHERE c.k = l.l_orderkey AND l.l_linenumber BETWEEN a AND b)")
def f11(t: Tables) -> DataFrame:
    ranges = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_linenumber").alias("a"), (F.min("l_linenumber") + 1).alias("b"))
    hit = (F.col("k") == F.col("l_orderkey")) & F.col("l_linenumber").between(F.col("a"), F.col("b"))
    return t.lineitem.join(ranges, hit, "left_semi").select("l_orderkey", "l_linenumber").distinct()


@query("J1_inner_joins", "SELECT s_suppkey, n_name, r_name, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def j1(t: Tables) -> DataFrame:
    per = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    got = per.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return got.select("s_suppkey", "n_name", "r_name", "lines", F.round("revenue", 2).alias("revenue"))


@query("J2_dead_rows", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM customer d WHERE d.c_nationkey = c.c_nationkey AND d.c_name <> c.c_name AND d.c_acctbal = c.c_acctbal) AND NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'purchase')")
def j2(t: Tables) -> DataFrame:
    c = t.customer
    live = R.without(c, t.orders.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])
    twin = c.groupBy("c_nationkey", "c_acctbal").agg(F.countDistinct("c_name").alias("n")).where("n > 1")
    live = R.without(live, twin, ["c_nationkey", "c_acctbal"])
    return R.without(live, t.events.where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey")), ["c_custkey"]).select("c_custkey")


@query("J3_pairs_of_only_kind", "SELECT DISTINCT l_suppkey, l_partkey FROM lineitem l WHERE l_returnflag = 'N' AND NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_suppkey = l.l_suppkey AND m.l_partkey = l.l_partkey AND m.l_returnflag <> 'N')")
def j3(t: Tables) -> DataFrame:
    return R.pairs_of_only_kind(t.lineitem, ["l_suppkey", "l_partkey"], "l_returnflag", "N")


@query("J4_forbidden_pairs", "SELECT DISTINCT o_custkey % 100 AS src, l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE (o_custkey % 100, l_suppkey) IN (SELECT s_suppkey, 99 - s_suppkey FROM supplier)")
def j4(t: Tables) -> DataFrame:
    edges = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select((F.col("o_custkey") % 100).alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    return edges.join(t.supplier.select(F.col("s_suppkey").alias("src"), (99 - F.col("s_suppkey")).alias("dst")), ["src", "dst"], "left_semi")


_COCHANGE = """
WITH b AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS i FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) <= 30)),
n AS (SELECT i, count(*) AS n FROM b GROUP BY i),
p AS (SELECT x.i AS a, y.i AS b, count(*) AS shared FROM b x JOIN b y ON x.k = y.k AND x.i < y.i GROUP BY ALL)
"""


@query("J5_cochange_pairs", _COCHANGE + "SELECT a AS item_a, b AS item_b, shared, round(shared / (na.n + nb.n - shared), 6) AS jaccard FROM p JOIN n na ON a = na.i JOIN n nb ON b = nb.i WHERE shared / (na.n + nb.n - shared) >= 0.01")
def j5(t: Tables) -> DataFrame:
    return R.cochange(t.lineitem, "l_orderkey", "l_suppkey", threshold=0.01).withColumn("jaccard", F.round("jaccard", 6))


@query("J6_cochange_of_one", "WITH b AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS i FROM lineitem), m AS (SELECT k FROM b WHERE i = 7) SELECT i AS item, count(*) FILTER (k IN (FROM m)) AS shared, round(count(*) FILTER (k IN (FROM m)) / (count(*) + (SELECT count(*) FROM m) - count(*) FILTER (k IN (FROM m))), 6) AS jaccard FROM b WHERE i <> 7 GROUP BY i HAVING shared > 0")
def j6(t: Tables) -> DataFrame:
    return R.cochange_of(t.lineitem, "l_orderkey", "l_suppkey", 7).withColumn("jaccard", F.round("jaccard", 6))


_RENAMES = "SELECT o_orderkey AS k, 'e' || (l_suppkey % 40) AS name, CASE WHEN l_linenumber = 1 AND l_suppkey % 40 = 3 THEN 'e4' WHEN l_linenumber = 2 AND l_suppkey % 40 = 5 THEN 'e3' END AS old FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


@query("J7_cochange_over_renames", f"""
WITH c AS ({_RENAMES}), small AS (SELECT k FROM c GROUP BY k HAVING count(DISTINCT name) <= 50), r AS (SELECT DISTINCT k, name FROM c WHERE k IN (FROM small)),
t AS (SELECT 'e3' AS name UNION SELECT old FROM c WHERE name = 'e3' AND old IS NOT NULL UNION SELECT name FROM c WHERE old = 'e3'),
m AS (SELECT DISTINCT k FROM r WHERE name IN (FROM t)), n AS (SELECT count(*) AS n FROM m),
s AS (SELECT name, count(*) FILTER (k IN (FROM m)) AS shared, count(*) AS m FROM r WHERE name NOT IN (FROM t) GROUP BY name)
SELECT name, shared, round(shared / (n + m - shared), 6) AS jaccard, round(shared / least(n, m), 6) AS confidence FROM s, n WHERE shared >= 2""")
def j7(t: Tables) -> DataFrame:
    entity = F.col("l_suppkey") % 40
    old = F.when((F.col("l_linenumber") == 1) & (entity == 3), "e4").when((F.col("l_linenumber") == 2) & (entity == 5), "e3")
    changes = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("commit"), F.concat(F.lit("e"), entity.cast("string")).alias("name"), old.alias("old_name"))
    return R.cochange_renamed(changes, "e3").select("name", "shared", F.round("jaccard", 6).alias("jaccard"), F.round("confidence", 6).alias("confidence"))


@query("J8_rule_expansion", "SELECT DISTINCT a.n_nationkey AS src, b.n_nationkey AS dst FROM nation a JOIN region x ON a.n_regionkey = x.r_regionkey JOIN nation b ON a.n_nationkey <> b.n_nationkey JOIN region y ON b.n_regionkey = y.r_regionkey WHERE regexp_matches(x.r_name, '^A[^/]*$') AND y.r_name = 'EUROPE'")
def j8(t: Tables) -> DataFrame:
    side = lambda k, p: t.nation.join(t.region.where(R.path_matches(F.col("r_name"), p)), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias(k))
    return side("src", "A*").join(side("dst", "EUROPE"), F.col("src") != F.col("dst")).distinct()


@query("J9_narrowest_interval", """
WITH s AS (SELECT user_id, event_id AS span_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS a, CAST(epoch_us(lead(ts, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 1000000 AS BIGINT) AS b FROM events),
p AS (SELECT user_id, event_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS pt FROM events)
SELECT p.event_id, arg_min(s.span_id, (s.b - s.a, s.a, s.span_id)) AS span_id FROM p JOIN s ON p.user_id = s.user_id AND pt BETWEEN a AND b GROUP BY p.event_id""")
def j9(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_id", "ts", F.floor(micros("ts") / 1000000).cast("long").alias("at"))
    end = F.lead("at", 2).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    spans = e.select("user_id", F.col("event_id").alias("span_id"), F.col("at").alias("a"), end.alias("b")).where("b IS NOT NULL")
    return R.narrowest(e.select("user_id", "event_id", "at"), spans, "user_id", "at", "a", "b", "span_id", "event_id")


@query("J10_inside_range", "SELECT l_orderkey, l_linenumber, bool_or(k IS NOT NULL) AS inside FROM lineitem LEFT JOIN (SELECT l_orderkey AS k, min(l_linenumber) AS a, max(l_linenumber) AS b FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) ON k = l_orderkey AND l_linenumber BETWEEN a AND b GROUP BY ALL")
def j10(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey")
    only = F.when(F.col("l_linestatus") == "F", F.col("l_linenumber"))
    inside = F.coalesce(F.col("l_linenumber").between(F.min(only).over(w), F.max(only).over(w)), F.lit(False))
    return t.lineitem.select("l_orderkey", "l_linenumber", inside.alias("inside")).groupBy("l_orderkey", "l_linenumber").agg(F.bool_or("inside").alias("inside"))


@query("J11_same_line_siblings", "SELECT DISTINCT a.l_orderkey, a.l_linenumber, a.l_partkey AS part, b.l_partkey AS sibling FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_partkey <> b.l_partkey")
def j11(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    return rows.withColumnRenamed("l_partkey", "part").join(rows.withColumnRenamed("l_partkey", "sibling"), ["l_orderkey", "l_linenumber"]).where("part <> sibling")


@query("J12_concatenated_name", "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_name = concat_ws('_', 'NATION', CAST(r_regionkey * 3 AS VARCHAR))")
def j12(t: Tables) -> DataFrame:
    return t.nation.join(t.region, F.col("n_name") == F.concat_ws("_", F.lit("NATION"), (F.col("r_regionkey") * 3).cast("string"))).select("n_nationkey", "r_regionkey")


@query("J13_json_paths", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, p_name FROM events LEFT JOIN part ON p_partkey = CAST(json_extract_string(props, '$.k') AS INTEGER)")
def j13(t: Tables) -> DataFrame:
    e = t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))
    return e.join(t.part, F.col("k") == F.col("p_partkey"), "left").select("event_id", "k", "p_name")


@query("J15_multiset_match", "WITH o AS (SELECT doc_id AS old_id, md5(text) AS h, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents WHERE doc_id % 2 = 0), n AS (SELECT doc_id AS new_id, md5(text) AS h, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents WHERE doc_id % 2 = 1) SELECT h, old_id, new_id FROM o JOIN n USING (h, k)")
def j15(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))  # even ids stand for the old side, odd ones for the new
    return R.match_in_order(d.where("doc_id % 2 = 0").toDF("old_id", "h"), d.where("doc_id % 2 = 1").toDF("new_id", "h"), ["h"], "old_id", "new_id")


@query("A1_group_count", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def a1(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("A2_max_avg_without_nulls", "SELECT l_suppkey, max(nullif(l_quantity, 50)) AS most, round(avg(nullif(l_quantity, 50)), 6) AS mean FROM lineitem GROUP BY 1")
def a2(t: Tables) -> DataFrame:
    q = F.nullif("l_quantity", F.lit(50.0))
    return t.lineitem.groupBy("l_suppkey").agg(F.max(q).alias("most"), F.round(F.avg(q), 6).alias("mean"))


@query("A3_churn", "SELECT l_partkey, count(*) AS churn FROM lineitem GROUP BY 1")
def a3(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("churn"))


@query("A4_distinct_min_max_since", "SELECT o_custkey, count(DISTINCT o_orderdate) AS days, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderstatus <> 'P' GROUP BY 1")
def a4(t: Tables) -> DataFrame:
    return t.orders.where("o_orderdate >= TIMESTAMP_NTZ '1998-01-01' AND o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.countDistinct("o_orderdate").alias("days"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


@query("A5_having_coalesce", "SELECT l_orderkey, CAST(coalesce(max(CASE WHEN l_linenumber > 4 THEN l_linenumber END), count(*)) AS BIGINT) AS size FROM lineitem GROUP BY 1 HAVING coalesce(max(CASE WHEN l_linenumber > 4 THEN l_linenumber END), count(*)) <= 3")
def a5(t: Tables) -> DataFrame:
    size = F.coalesce(F.max(F.when(F.col("l_linenumber") > 4, F.col("l_linenumber").cast("long"))), F.count(F.lit(1)))
    return t.lineitem.groupBy("l_orderkey").agg(size.alias("size")).where("size <= 3")


@query("A6_distinct_per_root", "SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS root, count(DISTINCT page_id) AS pages FROM pages GROUP BY 1")
def a6(t: Tables) -> DataFrame:
    return t.pages.groupBy(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("root")).agg(F.countDistinct("page_id").alias("pages"))


@query("A7_snapshot_aggregates", "WITH c AS (SELECT l_suppkey, avg(l_quantity) AS mean, count(*) AS n FROM lineitem GROUP BY 1) SELECT CAST(sum(floor(mean)) AS BIGINT) AS total, count(*) FILTER (mean < 25) AS low, count(*) FILTER (n >= 600 AND mean >= 25.0) AS hot FROM c")
def a7(t: Tables) -> DataFrame:
    c = t.lineitem.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("mean"), F.count(F.lit(1)).alias("n"))
    return c.agg(F.sum(F.floor("mean")).cast("long").alias("total"), F.count_if(F.col("mean") < 25).alias("low"), F.count_if((F.col("n") >= 600) & (F.col("mean") >= 25.0)).alias("hot"))


@query("A8_scalar", "SELECT coalesce(max(ts), TIMESTAMP '1970-01-01') AS newest, coalesce(min(value), 0) AS least, bool_or(event_type = 'error') AS any_error FROM events")
def a8(t: Tables) -> DataFrame:
    return t.events.agg(F.coalesce(F.max("ts"), F.expr("TIMESTAMP_NTZ '1970-01-01'")).alias("newest"), F.coalesce(F.min("value"), F.lit(0.0)).alias("least"), F.bool_or(F.col("event_type") == "error").alias("any_error"))


@query("A9_partitioned_counts", "SELECT l_suppkey, count(*) FILTER (l_returnflag <> 'R') AS production, count(*) FILTER (l_returnflag = 'R') AS test FROM lineitem GROUP BY 1")
def a9(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") != "R").alias("production"), F.count_if(F.col("l_returnflag") == "R").alias("test"))


@query("A11_json_aggregate", "SELECT n_regionkey, '[' || string_agg('\"' || n_name || '\"', ',' ORDER BY n_name) || ']' AS names FROM nation GROUP BY 1")
def a11(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(F.to_json(F.sort_array(F.collect_list("n_name"))).alias("names"))


@query("W1_occurrence_ordinal", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS ordinal FROM lineitem")
def w1(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_suppkey", "l_returnflag").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (F.row_number().over(w) - 1).cast("long").alias("ordinal"))


@query("W2_average_rank", "SELECT c_custkey, round(CASE WHEN n <= 1 THEN 1.0 ELSE (r + (t - 1) / 2 - 1) / (n - 1) END, 6) AS rank FROM (SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY round(c_acctbal, -2)) AS r, count(*) OVER (PARTITION BY c_nationkey, round(c_acctbal, -2)) AS t, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)")
def w2(t: Tables) -> DataFrame:
    return R.average_rank(t.customer.withColumn("v", F.round("c_acctbal", -2)), "v", ["c_nationkey"], "rank").select("c_custkey", F.round("rank", 6).alias("rank"))


@query("W3_semantic_anchors", """
WITH o AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1),
m AS (SELECT c_custkey, c_nationkey, c_name, coalesce(n, 0) AS indegree, round(coalesce(s, 0), 2) AS weight, 1 / (1 + coalesce(n, 0)) AS stability, CAST(c_custkey % 7 AS DOUBLE) AS named FROM customer LEFT JOIN o ON c_custkey = o_custkey),
r AS (SELECT *, count(*) OVER (PARTITION BY c_nationkey) AS n,
  (rank() OVER (PARTITION BY c_nationkey ORDER BY indegree) + (count(*) OVER (PARTITION BY c_nationkey, indegree) - 1) / 2 - 1) AS r1,
  (rank() OVER (PARTITION BY c_nationkey ORDER BY weight) + (count(*) OVER (PARTITION BY c_nationkey, weight) - 1) / 2 - 1) AS r2,
  (rank() OVER (PARTITION BY c_nationkey ORDER BY stability) + (count(*) OVER (PARTITION BY c_nationkey, stability) - 1) / 2 - 1) AS r3,
  (rank() OVER (PARTITION BY c_nationkey ORDER BY named) + (count(*) OVER (PARTITION BY c_nationkey, named) - 1) / 2 - 1) AS r4 FROM m),
s AS (SELECT *, round((0.35 * r1 + 0.30 * r2 + 0.20 * r3 + 0.15 * r4) / greatest(n - 1, 1), 9) AS score FROM r)
SELECT c_nationkey, c_custkey, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY score DESC, c_custkey) <= greatest(3, least(7, n // 8))""")
def w3(t: Tables) -> DataFrame:
    o = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s"))
    n = F.coalesce("n", F.lit(0))
    m = t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_nationkey", n.alias("indegree"), F.round(F.coalesce("s", F.lit(0.0)), 2).alias("weight"), (1 / (1 + n)).alias("stability"), (F.col("c_custkey") % 7).cast("double").alias("named"))
    shares = {"indegree": 0.35, "weight": 0.30, "stability": 0.20, "named": 0.15}
    tall = m.withColumn("indegree", F.col("indegree").cast("double")).unpivot(["c_nationkey", "c_custkey"], list(shares), "kind", "value")
    ranks = R.average_rank(tall, "value", ["c_nationkey", "kind"], "rank")
    m = ranks.groupBy("c_nationkey", "c_custkey").agg(*(F.max(F.when(F.col("kind") == k, F.col("rank"))).alias(k) for k in shares))
    score = sum((x * F.col(k) for k, x in shares.items()), F.lit(0.0))
    order = [F.desc("score"), F.col("c_custkey")]
    best = R.top_per_group(m.withColumn("score", F.round(score, 9)), ["c_nationkey"], order, 7)  # kept at most, so that few rows are ordered again
    sizes = t.customer.groupBy("c_nationkey").agg(F.greatest(F.lit(3), F.least(F.lit(7), F.floor(F.count(F.lit(1)) / 8))).alias("keep"))
    return R.top_per_group(R.alike(best, sizes, ["c_nationkey"]), ["c_nationkey"], order, F.col("keep")).select("c_nationkey", "c_custkey", F.round("score", 6).alias("score"))


@query("W4_capped_top_k", "SELECT * FROM (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) <= 8) ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 40")
def w4(t: Tables) -> DataFrame:
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return R.top_per_group(t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), ["l_suppkey"], order, 8, 40)


@query("W5_nearest_definition", "SELECT e.event_id, arg_min(d.event_id, (abs(d.event_id - e.event_id), d.event_id)) AS nearest FROM events e JOIN events d ON e.user_id = d.user_id AND e.event_type = 'purchase' AND d.event_type = 'signup' GROUP BY 1")
def w5(t: Tables) -> DataFrame:
    e = t.events
    w = Window.partitionBy("user_id").orderBy("event_id")
    d = F.when(F.col("event_type") == "signup", F.col("event_id"))
    both = e.withColumn("before", F.last(d, True).over(w)).withColumn("after", F.first(d, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    near = F.when(F.col("after").isNull() | (F.col("event_id") - F.col("before") <= F.col("after") - F.col("event_id")), F.col("before")).otherwise(F.col("after"))
    return both.where("event_type = 'purchase'").select("event_id", near.alias("nearest")).where("nearest IS NOT NULL")


@query("W6_surplus", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem) WHERE k > coalesce(CASE WHEN l_returnflag = 'A' THEN l_suppkey % 5 END, 0)")
def w6(t: Tables) -> DataFrame:
    accepted = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.lit("A").alias("l_returnflag"), (F.col("s_suppkey") % 5).alias("accepted"))
    return R.surplus(t.lineitem, accepted, ["l_suppkey", "l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("W7_longest_run", "WITH p AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem), i AS (SELECT *, l_orderkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS g FROM p), r AS (SELECT l_suppkey, g, count(*) AS n FROM i GROUP BY ALL) SELECT l_suppkey, max(n) AS longest FROM r GROUP BY 1")
def w7(t: Tables) -> DataFrame:
    return R.runs(t.lineitem.select("l_suppkey", "l_orderkey").distinct(), ["l_suppkey"], "l_orderkey").groupBy("l_suppkey").agg(F.max("length").alias("longest"))


@query("W8_sessions", "SELECT user_id, count(DISTINCT s) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 3600000000 THEN 1 ELSE 0 END AS g FROM events)) GROUP BY ALL) GROUP BY 1")
def w8(t: Tables) -> DataFrame:
    s = R.sessions(t.events.withColumn("at", micros("ts")), ["user_id"], "at", 3_600_000_000, "event_id")
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


@query("O1_map_ranking", "WITH n AS (SELECT l_partkey, count(*) AS n, count(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1), a AS (SELECT sum(n) AS a FROM n) SELECT p_partkey, CAST(least(coalesce(n, 0), 50) + 2 * coalesce(s, 0) + floor(2000 * coalesce(n, 0) / a) + least(p_size, 20) AS BIGINT) AS importance FROM part LEFT JOIN n ON p_partkey = l_partkey, a ORDER BY importance DESC, p_partkey LIMIT 50")
def o1(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("s"))
    a = t.lineitem.agg(F.count(F.lit(1)).alias("a"))  # one row
    k = F.coalesce("n", F.lit(0))
    score = F.least(k, F.lit(50)) + 2 * F.coalesce("s", F.lit(0)) + F.floor(2000 * k / F.col("a")) + F.least("p_size", F.lit(20))
    return t.part.join(n, F.col("p_partkey") == F.col("l_partkey"), "left").join(F.broadcast(a)).select("p_partkey", score.cast("long").alias("importance")).orderBy(F.desc("importance"), "p_partkey").limit(50)


@query("O2_refactor_targets", "SELECT o_custkey, count(*) AS commits, CAST(sum(l) AS BIGINT) AS complexity, CAST(count(*) * sum(l) AS BIGINT) AS score FROM (SELECT o_orderkey, o_custkey, count(*) AS l FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY ALL) GROUP BY 1 ORDER BY score DESC, o_custkey LIMIT 20")
def o2(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("l"))
    o = t.orders.where("o_orderdate >= TIMESTAMP_NTZ '1997-01-01'").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    got = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("commits"), F.sum("l").alias("complexity"))
    return got.withColumn("score", F.col("commits") * F.col("complexity")).orderBy(F.desc("score"), "o_custkey").limit(20)


@query("O3_two_bands", "SELECT p_partkey, band, score FROM (SELECT p_partkey, CASE WHEN p_name LIKE 'red%' THEN 0 ELSE 1 END AS band, CAST(p_size AS BIGINT) AS score FROM part WHERE p_name LIKE 'red%' OR p_name LIKE '%gear') ORDER BY band, score DESC, p_partkey LIMIT 30")
def o3(t: Tables) -> DataFrame:
    hits = t.part.where("p_name LIKE 'red%' OR p_name LIKE '%gear'").select("p_partkey", F.when(F.col("p_name").startswith("red"), 0).otherwise(1).alias("band"), F.col("p_size").cast("long").alias("score"))
    return hits.orderBy("band", F.desc("score"), "p_partkey").limit(30)


@query("O4_unreachable", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AND NOT starts_with(p_name, 'old') AND p_type NOT LIKE '%PROMO%' AND p_name NOT LIKE '%ring' ORDER BY 1")
def o4(t: Tables) -> DataFrame:
    left = t.part.where("NOT startswith(p_name, 'old') AND p_type NOT LIKE '%PROMO%' AND p_name NOT LIKE '%ring'")
    return R.without(left, t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"]).select("p_partkey").orderBy("p_partkey")


@query("U1_union_distinct", "SELECT l_partkey AS part FROM lineitem WHERE l_suppkey = 7 UNION SELECT p_partkey FROM part WHERE p_size = 7")
def u1(t: Tables) -> DataFrame:
    return t.lineitem.where("l_suppkey = 7").select(F.col("l_partkey").alias("part")).union(t.part.where("p_size = 7").select("p_partkey")).distinct()


@query("U2_callers_of_a_name", "SELECT o_custkey AS caller FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 450000 UNION SELECT user_id FROM events WHERE event_type = 'error' AND value > 90")
def u2(t: Tables) -> DataFrame:
    return t.orders.where("o_orderpriority = '1-URGENT' AND o_totalprice > 450000").select(F.col("o_custkey").alias("caller")).union(t.events.where("event_type = 'error' AND value > 90").select("user_id")).distinct()


@query("U3_edge_difference", "WITH old AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01'), new AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01') SELECT 'introduced' AS delta, * FROM (FROM new EXCEPT FROM old) UNION ALL SELECT 'removed', * FROM (FROM old EXCEPT FROM new)")
def u3(t: Tables) -> DataFrame:
    edges = t.lineitem.groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.bool_or(F.col("l_shipdate") < F.expr("TIMESTAMP_NTZ '1999-01-01'")).alias("old"), F.bool_or(F.col("l_shipdate") >= F.expr("TIMESTAMP_NTZ '1998-01-01'")).alias("new"))
    return edges.where("old <> new").select(F.when(F.col("new"), "introduced").otherwise("removed").alias("delta"), "src", "dst")


@query("U4_intersection", "SELECT o_custkey AS id FROM orders INTERSECT SELECT user_id FROM events")
def u4(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("id")).intersect(t.events.select("user_id"))


@query("U5_drift", "WITH s AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 10 <> 0), w AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN md5(text || '!') ELSE md5(text) END AS h FROM documents WHERE doc_id % 11 <> 0) SELECT doc_id, CASE WHEN s.h IS NULL THEN 'added' WHEN w.h IS NULL THEN 'removed' ELSE 'changed' END AS state FROM s FULL JOIN w USING (doc_id) WHERE s.h IS DISTINCT FROM w.h")
def u5(t: Tables) -> DataFrame:
    d = t.documents  # two states of one table: what is stored lacks every tenth row, what is walked every eleventh, and every seventh has changed
    stored = d.where("doc_id % 10 <> 0").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return R.drift(stored, d.where("doc_id % 11 <> 0").select("doc_id", F.md5(text.cast("binary")).alias("h")), "doc_id", "h")


@query("U6_net_importers", "WITH o AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY 1), w AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) SELECT w.l_partkey, w.n - coalesce(o.n, 0) AS added FROM w LEFT JOIN o USING (l_partkey) WHERE w.n > coalesce(o.n, 0)")
def u6(t: Tables) -> DataFrame:
    old = F.when(F.col("l_shipdate") < F.expr("TIMESTAMP_NTZ '1999-01-01'"), F.col("l_suppkey"))
    return t.lineitem.groupBy("l_partkey").agg((F.countDistinct("l_suppkey") - F.countDistinct(old)).alias("added")).where("added > 0")


@query("K1_replace_by_key", "SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, upper(p_name), p_size + 1 FROM part WHERE p_partkey % 5 = 0")
def k1(t: Tables) -> DataFrame:
    p = t.part.select("p_partkey", "p_name", "p_size")
    return R.replace_by_key(p, p.where("p_partkey % 5 = 0").select("p_partkey", F.upper("p_name").alias("p_name"), (F.col("p_size") + 1).alias("p_size")), ["p_partkey"])


@query("K2_delete_cascade", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def k2(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders.where("o_orderstatus = 'P'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("K3_full_replace", "SELECT n_nationkey AS id, lower(n_name) AS name FROM nation WHERE n_regionkey <> 2")
def k3(t: Tables) -> DataFrame:
    at = f"{shared_folder(t.spark)}/replaced-{uuid.uuid4().hex}"
    R.replace_all(t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), at)
    return R.replace_all(t.nation.where("n_regionkey <> 2").select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("name")), at)


@query("K4_insert_or_ignore", "SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT DISTINCT c_custkey, c_mktsegment FROM customer WHERE c_custkey < 100 AND c_custkey NOT IN (SELECT n_nationkey FROM nation)")
def k4(t: Tables) -> DataFrame:
    old = t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return R.insert_or_ignore(old, t.customer.where("c_custkey < 100").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name")), ["id"])


@query("K6_retention", "SELECT event_id, ts FROM events ORDER BY event_id DESC LIMIT 30")
def k6(t: Tables) -> DataFrame:
    return R.newest(t.events.select("event_id", "ts"), "event_id", 30)
