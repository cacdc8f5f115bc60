"""Text and vector queries over documents, conversations, parts and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import text as T
from ..operators import vector as V
from ..operators.iterate import cut
from .registry import Tables, query

# The stop words, stated here again so that the SQL does not follow the operators.
_STOP = "'a', 'an', 'and', 'are', 'can', 'do', 'does', 'for', 'get', 'how', 'i', 'in', 'is', 'it', 'of', 'on', 'or', 'set', 'that', 'the', 'this', 'to', 'use', 'used', 'using', 'we', 'what', 'when', 'where', 'which', 'why', 'with'"


def _tok(text: str, stop: bool = True) -> str:
    no = f" AND w NOT IN ({_STOP})" if stop else ""
    return f"list_filter(regexp_split_to_array(lower(regexp_replace({text}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: length(w) >= 2{no})"


_TF = f"SELECT id, token, count(*) AS tf FROM (SELECT doc_id AS id, unnest({_tok('text')}) AS token FROM documents) GROUP BY ALL"
QUERY = ["than", "shed", "ver", "idio"]
_Q = f"(SELECT unnest({QUERY!r}) AS term)"
_HITS = f"SELECT id, term, sum(tf) AS tf FROM ({_TF}) JOIN {_Q} q ON starts_with(token, term) GROUP BY ALL"
_IDF = "SELECT term, count(*) AS df, ln(1 + (SELECT count(*) FROM documents) / (1 + count(*))) AS idf FROM h GROUP BY 1"


def _n(t: Tables) -> DataFrame:
    return t.documents.agg(F.count(F.lit(1)).alias("n"))


@query("T1_token_counts", f"SELECT token, count(*) AS n FROM (SELECT unnest({_tok('text')}) AS token FROM documents) GROUP BY 1")
def t1(t: Tables) -> DataFrame:
    return t.documents.select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("T2_field_tokens", f"SELECT p_partkey, array_to_string(list_concat({_tok('p_name')}, {_tok('p_brand')}, {_tok('p_type')}), ' ') AS tokens FROM part")
def t2(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(F.concat(*(T.tokens(F.col(c)) for c in ("p_name", "p_brand", "p_type"))), " ").alias("tokens"))


def _body(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The counts of the query's terms in each document, made once, and their statistics (one row)."""
    counts = cut(T.query_counts(t.documents, "doc_id", {"body": "text"}, QUERY))
    return counts, T.query_statistics(counts, ["body"], QUERY, "body")


@query("T3_candidates", f"""
WITH h AS ({_HITS}), i AS ({_IDF})
SELECT id, round(sum(idf), 6) AS rank FROM h JOIN i USING (term) GROUP BY 1 ORDER BY rank DESC, id LIMIT 200""")
def t3(t: Tables) -> DataFrame:
    counts, statistics = _body(t)
    rank = F.round(T.weigh(F.col("idf"), F.col("body")), 6)
    return counts.join(F.broadcast(statistics)).select("id", rank.alias("rank")).where("rank > 0").orderBy(F.desc("rank"), "id").limit(200)


@query("T4_prefix_idf", f"WITH h AS ({_HITS}), i AS ({_IDF}) SELECT term, df, round(idf, 9) AS idf FROM i")
def t4(t: Tables) -> DataFrame:
    terms = F.array(*map(F.lit, QUERY))
    rows = _body(t)[1].select(F.explode(F.arrays_zip(terms.alias("term"), F.col("df"), F.col("idf"))).alias("x"))
    return rows.select("x.term", "x.df", F.round("x.idf", 9).alias("idf")).where("df > 0")


#: A query that meets names, qualified names and paths too: those of a document are its source, language and source, and source and number.
FIELD_QUERY = [*QUERY, "src1"]
_NAME, _QUALIFIED, _PATH = "source", "lang || '::' || source", "'src/' || source || '/' || doc_id % 40"
_FIELDS = f"""
d AS (SELECT doc_id AS id, {_tok(_NAME)} AS name, {_tok(_QUALIFIED)} AS qual, {_tok(_PATH)} AS path, {_tok('text')} AS body FROM documents),
q AS (SELECT unnest({FIELD_QUERY!r}) AS term),
m AS (
  SELECT id, term, len(list_filter(name, lambda w: starts_with(w, term))) AS nk, len(list_filter(qual, lambda w: starts_with(w, term))) AS qk,
    len(list_filter(path, lambda w: starts_with(w, term))) AS pk, len(list_filter(body, lambda w: starts_with(w, term))) AS tf, len(body) AS length,
    len(list_filter(name, lambda w: len(list_filter({FIELD_QUERY!r}, lambda x: starts_with(w, x))) > 0)) / greatest(len(name), 1) AS covered
  FROM d, q),
i AS (SELECT term, ln(1 + (SELECT count(*) FROM documents) / (1 + count(*) FILTER (nk + qk + pk + tf > 0))) AS idf FROM m GROUP BY 1),
a AS (SELECT avg(len(body)) AS mean FROM d),
s AS (
  SELECT id, sum(CASE WHEN nk > 0 THEN idf ELSE 0 END) * 3.0 * (1 + any_value(covered)) + sum(CASE WHEN qk > 0 THEN idf ELSE 0 END) * 0.5
      + sum(CASE WHEN pk > 0 THEN idf ELSE 0 END) * 2.0 + sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score,
    sum(CASE WHEN nk + qk + pk + tf > 0 THEN idf ELSE 0 END) / sum(idf) AS coverage, sum(CASE WHEN nk + qk > 0 THEN idf ELSE 0 END) / sum(idf) AS strong
  FROM m JOIN i USING (term), a GROUP BY 1 HAVING sum(nk + qk + pk + tf) > 0)"""


def _scored(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.col("source").alias("name"), F.concat("lang", F.lit("::"), "source").alias("qualified"), F.concat(F.lit("src/"), "source", F.lit("/"), (F.col("doc_id") % 40).cast("string")).alias("path"), F.col("text").alias("body"))
    fields = ["name", "qualified", "path", "body"]
    counts = cut(T.query_counts(docs, "doc_id", {f: f for f in fields}, FIELD_QUERY))
    return T.field_scores(counts, T.query_statistics(counts, fields, FIELD_QUERY, "body"), FIELD_QUERY)


@query("T5_field_scores", f"WITH {_FIELDS} SELECT id, round(score, 6) AS score, round(coverage, 6) AS coverage, round(strong, 6) AS coverage_strong FROM s")
def t5(t: Tables) -> DataFrame:
    return _scored(t).select("id", *(F.round(c, 6).alias(c) for c in ("score", "coverage", "coverage_strong")))


@query("T6_boosts", "SELECT p_partkey, round(s * CASE WHEN p_name = 'red bolt' THEN 3 ELSE 1 END * CASE p_type WHEN 'PROMO' THEN 2.0 WHEN 'SMALL' THEN 1.2 ELSE 1 END * CASE WHEN p_brand = 'Brand#4' THEN 0.35 ELSE 1 END, 6) AS score FROM (SELECT *, 3.0 * (1 + k / 2) * k AS s FROM (SELECT *, CAST(p_name LIKE '%red%' AS INTEGER) + CAST(p_name LIKE '%bolt%' AS INTEGER) AS k FROM part)) WHERE k > 0")
def t6(t: Tables) -> DataFrame:
    name = F.col("p_name")
    k = F.contains(name, F.lit("red")).cast("int") + F.contains(name, F.lit("bolt")).cast("int")
    boost = F.when(name == "red bolt", 3.0).otherwise(1.0) * F.when(F.col("p_type") == "PROMO", 2.0).when(F.col("p_type") == "SMALL", 1.2).otherwise(1.0) * F.when(F.col("p_brand") == "Brand#4", 0.35).otherwise(1.0)
    return t.part.withColumn("k", k).where("k > 0").select("p_partkey", F.round(T.FIELD_WEIGHTS["name"] * (1 + F.col("k") / 2) * F.col("k") * boost, 6).alias("score"))


_BUDGET, _TEST_FACTOR = 20, 0.35


@query("T7_blend", f"""
WITH {_FIELDS},
b AS (
  SELECT doc_id, score, g / max(g) OVER () AS share, (coalesce(score / max(score) OVER (), 0) + 0.5 * g / max(g) OVER ()) * CASE WHEN doc_id % 7 = 0 THEN 0.35 ELSE 1 END AS blended
  FROM (SELECT doc_id, score, 1.0 / (1 + doc_id % 13) AS g FROM documents LEFT JOIN s ON id = doc_id)),
r AS (SELECT doc_id, 1 AS band, blended FROM b WHERE score IS NULL AND share >= 0.15 ORDER BY share DESC, doc_id LIMIT 20)
SELECT doc_id, band, round(blended, 6) AS blended FROM (SELECT doc_id, 0 AS band, blended FROM b WHERE score IS NOT NULL UNION ALL FROM r)""")
def t7(t: Tables) -> DataFrame:
    """Lexical hits by score and structural share, those in tests less; and as many rescued ones without a hit as the budget takes."""
    got = t.documents.select("doc_id", (1.0 / (1 + F.col("doc_id") % 13)).alias("g")).join(_scored(t).select(F.col("id").alias("doc_id"), "score"), "doc_id", "left")
    top = got.agg(F.max("score").alias("ms"), F.max("g").alias("mg"))  # one row
    factor = F.when(F.col("doc_id") % 7 == 0, _TEST_FACTOR).otherwise(1.0)
    share = F.col("g") / F.col("mg")
    blended = (F.coalesce(F.col("score") / F.col("ms"), F.lit(0.0)) + 0.5 * share) * factor
    rows = got.join(F.broadcast(top)).select("doc_id", "score", share.alias("share"), blended.alias("blended"))
    rescued = rows.where("score IS NULL AND share >= 0.15").orderBy(F.desc("share"), "doc_id").limit(_BUDGET)
    both = rows.where("score IS NOT NULL").select("doc_id", F.lit(0).alias("band"), "blended").union(rescued.select("doc_id", F.lit(1), "blended"))
    return both.withColumn("blended", F.round("blended", 6))


@query("T8_coverage_strategy", f"""
WITH {_FIELDS},
k AS (SELECT s.*, source, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS k FROM s JOIN documents ON doc_id = id),
c AS (SELECT max(n) AS most FROM (SELECT count(*) AS n FROM k GROUP BY source)),
z AS (
  SELECT count(*) AS n, max(score) FILTER (k = 1) AS s1, max(score) FILTER (k = 2) AS s2, max(score) FILTER (k = 3) AS s3,
    max(coverage) FILTER (k = 1) AS coverage, max(strong) FILTER (k = 1) AS strong FROM k)
SELECT n, round(coverage, 6) AS coverage, round(strong, 6) AS coverage_strong,
  CASE WHEN n = 0 THEN 'narrow' WHEN n < 3 THEN 'read_all' WHEN strong < 0.20 AND coverage < 0.35 THEN 'narrow' WHEN s1 > 2 * s2 THEN 'read_top'
    WHEN most / n >= 0.8 THEN 'component' ELSE 'read_top' END AS strategy,
  CASE WHEN n < 3 OR strong < 0.20 AND coverage < 0.35 THEN NULL WHEN s1 > 2 * s2 THEN 1 WHEN most / n >= 0.8 THEN NULL WHEN 2 * s2 < s1 THEN 1 WHEN 2 * s3 < s1 THEN 2 ELSE 3 END AS read
FROM z, c""")
def t8(t: Tables) -> DataFrame:
    """How to go on from the hits: what to read, by their number, the best one's coverage, its lead, and the share of one component."""
    scored = cut(_scored(t).join(t.documents.select(F.col("doc_id").alias("id"), "source"), "id"))
    most = scored.groupBy("source").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("most"))
    best = scored.orderBy(F.desc(F.round("score", 6)), "id").limit(3).agg(F.sort_array(F.collect_list(F.struct((-F.round("score", 6)).alias("o"), "id", "score", "coverage", "coverage_strong"))).alias("b"))
    m = scored.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(best)).join(F.broadcast(most))  # one row each
    at = lambda i, c: F.get("b", F.lit(i))[c]
    s1, s2, s3 = (at(i, "score") for i in range(3))
    weak = (at(0, "coverage_strong") < 0.20) & (at(0, "coverage") < 0.35)
    lead, one = s1 > 2 * s2, F.col("most") / F.col("n") >= 0.8
    strategy = F.when(F.col("n") == 0, "narrow").when(F.col("n") < 3, "read_all").when(weak, "narrow").when(lead, "read_top").when(one, "component").otherwise("read_top")
    read = F.when((F.col("n") < 3) | weak, None).when(lead, 1).when(one, None).when(2 * s2 < s1, 1).when(2 * s3 < s1, 2).otherwise(3)
    return m.select("n", F.round(at(0, "coverage"), 6).alias("coverage"), F.round(at(0, "coverage_strong"), 6).alias("coverage_strong"), strategy.alias("strategy"), read.alias("read"))


_VECTORS = f"tf AS ({_TF}), d AS (SELECT token, count(*) AS df FROM tf GROUP BY 1), w AS (SELECT id, token, (1 + ln(tf)) * ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) AS w FROM tf JOIN d USING (token)), v AS (SELECT id, token, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM w)"


@query("T9_tf_idf_cosine", f"""
WITH {_VECTORS}
SELECT a.id AS query, b.id, round(sum(a.weight * b.weight), 6) AS cosine FROM v a JOIN v b USING (token) WHERE a.id % 20 = 0 AND b.id <> a.id GROUP BY ALL""")
def t9(t: Tables) -> DataFrame:
    """Every document whose id is divisible by 20 against all others."""
    found = T.cosines_to(t.documents, "doc_id", "text", _n(t), F.expr("id % 20 = 0"))
    return found.where("query <> id").select("query", "id", F.round("cosine", 6).alias("cosine"))


_PAIRS = r"""
s AS (SELECT DISTINCT doc_id AS id, lang, md5(array_to_string(list_slice(ws, i, i + 11), ' ')) AS h FROM (SELECT doc_id, lang, list_filter(regexp_split_to_array(text, '[ \t\n]+'), lambda w: w <> '') AS ws FROM documents), unnest(range(1, len(ws) - 10)) AS t(i)),
f AS (SELECT h FROM s GROUP BY h HAVING count(*) BETWEEN 2 AND 4),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS block FROM (SELECT * FROM s WHERE h IN (FROM f)) x JOIN s y ON x.h = y.h AND x.id < y.id AND x.lang = y.lang GROUP BY ALL HAVING count(*) >= 6)"""


def _blocks(t: Tables) -> DataFrame:
    words = F.filter(F.split("text", "[ \t\n]+"), lambda w: w != "")
    return T.rare_shared_shingles(t.documents, "doc_id", words, same="lang")


@query("T10_rare_shingle_pairs", f"WITH {_PAIRS} SELECT a, b, block FROM p")
def t10(t: Tables) -> DataFrame:
    return _blocks(t)


@query("T11_duplicate_matches", f"WITH {_PAIRS}, {_VECTORS}, c AS (SELECT p.a, p.b, block, sum(x.weight * y.weight) AS lex FROM p JOIN v x ON x.id = p.a JOIN v y ON y.id = p.b AND y.token = x.token GROUP BY ALL) SELECT a, b, block, round(lex, 6) AS lex FROM c WHERE block >= 6 OR lex >= 0.5 QUALIFY row_number() OVER (PARTITION BY a ORDER BY block DESC, b) <= 3")
def t11(t: Tables) -> DataFrame:
    pairs = _blocks(t)
    v = T.tf_idf(T.term_frequencies(t.documents, "doc_id", "text"), _n(t))
    lex = pairs.join(v.toDF("a", "token", "wa"), "a").join(v.toDF("b", "token", "wb"), ["b", "token"]).groupBy("a", "b", "block").agg(F.sum(F.col("wa") * F.col("wb")).alias("lex"))
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("block"), "b"))
    return lex.where("block >= 6 OR lex >= 0.5").withColumn("k", best).where("k <= 3").select("a", "b", "block", F.round("lex", 6).alias("lex"))


@query("T12_suggestions", "SELECT DISTINCT p_name, round(greatest(e, p, i), 6) AS score FROM (SELECT p_name, CASE WHEN r >= 0.3 THEN 1 - levenshtein(p_name, 'redd bolts') / greatest(length(p_name), 10) ELSE 0 END AS e, len(list_intersect(string_split(p_name, ' '), ['redd', 'bolts'])) / 2 AS p, CASE WHEN (contains(p_name, 'redd bolts') OR contains('redd bolts', p_name)) AND r >= 0.5 THEN 0.8 ELSE 0 END AS i FROM (SELECT p_name, least(length(p_name), 10) / greatest(length(p_name), 10) AS r FROM part)) WHERE greatest(e, p, i) >= 0.35")
def t12(t: Tables) -> DataFrame:
    names = t.part.select("p_name").distinct()
    return names.withColumn("score", T.suggestion(F.col("p_name"), "redd bolts")).where("score >= 0.35").withColumn("score", F.round("score", 6))


_TURNS = "SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations"


@query("T13_turn_jaccard", f"SELECT conv_id, turn, round(CASE WHEN least(len(a), len(b)) / greatest(len(a), len(b)) >= 0.6 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END, 6) AS similarity FROM (SELECT conv_id, turn, list_distinct(string_split(text, ' ')) AS a, list_distinct(string_split(next, ' ')) AS b FROM ({_TURNS}) WHERE next IS NOT NULL)")
def t13(t: Tables) -> DataFrame:
    c = t.conversations.select("conv_id", "turn", F.array_distinct(F.split("text", " ")).alias("a"), F.array_distinct(F.split(F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")), " ")).alias("b")).where("b IS NOT NULL")
    ratio = F.least(F.size("a"), F.size("b")) / F.greatest(F.size("a"), F.size("b"))
    return c.select("conv_id", "turn", F.round(F.when(ratio >= 0.6, T.jaccard(F.col("a"), F.col("b"))).otherwise(0.0), 6).alias("similarity"))


@query("T14_line_delta", f"SELECT conv_id, turn, round(len(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] IS DISTINCT FROM b[i])) / greatest(len(a), len(b)), 6) AS delta FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS a, string_split(next, chr(10)) AS b FROM ({_TURNS}) WHERE next IS NOT NULL)")
def t14(t: Tables) -> DataFrame:
    c = t.conversations.withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("next IS NOT NULL")
    return c.select("conv_id", "turn", F.round(T.line_delta(F.col("text"), F.col("next")), 6).alias("delta"))


@query("T15_token_estimate", r"SELECT doc_id, greatest(1, len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) * 13 // 10, length(text) // 4) AS estimate FROM documents")
def t15(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.token_estimate(F.col("text")).alias("estimate"))


@query("T16_name_alignment", "SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS alignment FROM (SELECT p_partkey, string_split(p_name, ' ') AS a, list_distinct(list_filter(regexp_split_to_array(lower(p_type || ' ' || p_brand || ' bolt'), '[^a-z0-9]+'), lambda w: w <> '')) AS b FROM part)")
def t16(t: Tables) -> DataFrame:
    a, b = T.name_parts(F.col("p_name")), T.name_parts(F.concat("p_type", F.lit(" "), "p_brand", F.lit(" bolt")))
    return t.part.select("p_partkey", F.round(T.jaccard(a, b), 6).alias("alignment"))


@query("T17_word_boundary", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '\bidiot\b')")
def t17(t: Tables) -> DataFrame:
    return t.documents.where(F.col("text").rlike(r"\bidiot\b")).select("doc_id")


@query("J16_vector_scan", "SELECT e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.vec_id <> 0")
def j16(t: Tables) -> DataFrame:
    e = t.embeddings
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))  # one vector
    return e.where("vec_id <> 0").join(F.broadcast(q)).select(F.col("vec_id").alias("id"), F.round(V.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))


@query("V4_cosine_top_k", """
WITH p AS (
  SELECT q.vec_id AS query, e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity
  FROM embeddings e JOIN embeddings q ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0)
SELECT query, id, similarity FROM p WHERE similarity >= 0.3 QUALIFY row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) <= 10""")
def v4(t: Tables) -> DataFrame:
    """Every vector whose id is divisible by 20 against all others."""
    return V.nearest(t.embeddings, t.embeddings.where("vec_id % 20 = 0"), "vec_id", "embedding")


@query("V5_quantise", "SELECT vec_id, round(scale, 9) AS scale, round(list_aggregate(list_transform(embedding, lambda x: abs(x::DOUBLE - scale * greatest(-127, least(127, round(x::DOUBLE / scale))))), 'max'), 9) AS error, CAST(list_sum(list_transform(embedding, lambda x: abs(CAST(greatest(-127, least(127, round(x::DOUBLE / scale))) AS BIGINT)))) AS BIGINT) AS mass FROM (SELECT *, list_aggregate(list_transform(embedding, lambda x: abs(x::DOUBLE)), 'max') / 127 AS scale FROM embeddings)")
def v5(t: Tables) -> DataFrame:
    q = t.embeddings.withColumn("q", V.quantise(F.col("embedding")))
    error = F.array_max(F.zip_with("embedding", V.dequantise(F.col("q")), lambda x, y: F.abs(x.cast("double") - y)))
    mass = F.aggregate("q.codes", F.lit(0).cast("long"), lambda s, c: s + F.abs(c))
    return q.select("vec_id", F.round("q.scale", 9).alias("scale"), F.round(error, 9).alias("error"), mass.alias("mass"))


@query("V6_shape_quadrant", f"SELECT conv_id, turn, CASE WHEN d <= 0.15 AND s < 0.15 THEN 'trivial' WHEN d <= 0.15 THEN 'subtle_structural' WHEN s < 0.15 THEN 'safe_refactoring' ELSE 'major_rewrite' END AS quadrant FROM (SELECT conv_id, turn, len(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] IS DISTINCT FROM b[i])) / greatest(len(a), len(b)) AS d, abs(length(text) - length(next)) / greatest(length(text), length(next)) AS s FROM (SELECT *, string_split(text, chr(10)) AS a, string_split(next, chr(10)) AS b FROM ({_TURNS}) WHERE next IS NOT NULL))")
def v6(t: Tables) -> DataFrame:
    c = t.conversations.withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("next IS NOT NULL")
    shape = F.abs(F.length("text") - F.length("next")) / F.greatest(F.length("text"), F.length("next"))
    return c.select("conv_id", "turn", V.quadrant(T.line_delta(F.col("text"), F.col("next")), shape).alias("quadrant"))


@query("V1_hrr_encode")
def v1(t: Tables) -> DataFrame:
    """Encoded turns, by the similarity of each to the next of its conversation (V1 to V3)."""
    words = F.filter(F.split("text", "[ \n]+"), lambda w: w != "")
    c = t.conversations.withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    v = V.hrr_encode(c.withColumn("w", words), "id", F.col("w"), 256)
    w = Window.partitionBy(F.floor(F.col("id") / 1000)).orderBy("id")
    return v.withColumn("next", F.lead("vector").over(w)).where("next IS NOT NULL").select("id", F.round(V.cosine(F.col("vector"), F.col("next")), 6).alias("similarity"))


@query("A10_bundle", "WITH x AS (SELECT label, i, sum(embedding[i]::DOUBLE) AS x FROM embeddings, unnest(range(1, 65)) AS t(i) GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM x GROUP BY 1) SELECT label, CAST(i - 1 AS INTEGER) AS i, round(x / n, 6) AS x FROM x JOIN n USING (label)")
def a10(t: Tables) -> DataFrame:
    return V.bundle_by(t.embeddings, "label", "embedding").select("label", F.posexplode("vector").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("J17_dot_products", f"WITH {_VECTORS}, b AS (SELECT item_id AS id, unnest({_tok('text')}) AS token FROM benchmark), bf AS (SELECT id, token, count(*) AS tf FROM b GROUP BY ALL) SELECT bf.id AS a, v.id AS b, round(sum(bf.tf * v.weight), 6) AS score FROM bf JOIN v USING (token) GROUP BY ALL")
def j17(t: Tables) -> DataFrame:
    v = T.tf_idf(T.term_frequencies(t.documents, "doc_id", "text"), _n(t))
    b = T.term_frequencies(t.benchmark, "item_id", "text").select("id", "token", F.col("tf").cast("double"))
    return T.sparse_cosines(b, v).select("a", "b", F.round("cosine", 6).alias("score"))


@query("H1_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def h1(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))


@query("H2_structural_hash", "SELECT md5(regexp_replace(regexp_replace(text, '[^\\x20-\\x7E]+', '', 'g'), '[a-z]+', 'w', 'g')) AS h, count(*) AS n FROM documents GROUP BY 1")
def h2(t: Tables) -> DataFrame:
    shape = F.regexp_replace(F.regexp_replace("text", "[^\\x20-\\x7E]+", ""), "[a-z]+", "w")
    return t.documents.groupBy(F.md5(shape.cast("binary")).alias("h")).agg(F.count(F.lit(1)).alias("n"))
