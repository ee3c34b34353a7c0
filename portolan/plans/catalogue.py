"""The library's operators as queries over the driver's tables, and the SQL that says the same.

The tables stand in for shipments: market segments are consignees, brands
codes, part types chapters, suppliers suppliers, customers' nations origins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from portolan.functions import money, text, vector
from portolan.operators import relational as rel
from portolan.operators.components import connected_components
from portolan.operators.similarity import cosine_sums, cosine_top_k
from portolan.plans import entities, gold, probes, profile, scenario  # noqa: F401  (probes register their own queries)
from portolan.plans.queries import oracle_sql, queries, query, table  # noqa: F401
from portolan.plans.semantic import Dimension, Metric, Model, Relationship
from portolan.plans.world import product_sql
from portolan.streaming import incremental

def r6(c: str, name: str | None = None):
    return F.round(F.col(c), 6).alias(name or c)


# Shipments from the driver's tables

_SHIP_SQL = """ship AS (
  SELECT l.l_orderkey, l.l_linenumber, c.c_mktsegment AS consignee, p.p_brand AS code, p.p_type AS chapter, l.l_suppkey AS supplier, n.n_name AS origin, r.r_name AS region,
    l.l_extendedprice AS value, l.l_quantity AS weight, l.l_tax * 100 AS general, o.o_orderdate AS day
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN part p ON l.l_partkey = p.p_partkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"""


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star join. Sides are left to adaptive execution; only nations and regions are fixed lists."""
    t = lambda n: table(spark, sf_dir, n)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("origin"), F.col("r_name").alias("region"))
    cust = t("customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_mktsegment").alias("consignee"), "origin", "region")
    orders = t("orders").join(cust, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("o_orderdate").alias("day"), "consignee", "origin", "region")
    parts = t("part").select("p_partkey", F.col("p_brand").alias("code"), F.col("p_type").alias("chapter"))
    li = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("supplier"), F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("weight"), (F.col("l_tax") * 100).alias("general"))
    return li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey")).drop("o_orderkey", "p_partkey", "l_partkey")


_DUTY = f"(general + CASE WHEN region <> (SELECT min(r_name) FROM region) THEN 25.0 ELSE 0 END + CASE WHEN region = (SELECT max(r_name) FROM region) THEN 7.5 ELSE 0 END)"


def dutied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments with effective duty and landed cost; all regions but the first pay one additional duty, the last another."""
    ends = table(spark, sf_dir, "region").agg(F.min("r_name").alias("lo"), F.max("r_name").alias("hi"))
    s = shipments(spark, sf_dir).crossJoin(F.broadcast(ends))
    duty = money.effective_duty_pct(F.col("general"), F.lit(25.0), F.lit(7.5), F.col("region") != F.col("lo"), F.col("region") == F.col("hi"))
    return s.withColumn("duty", duty).withColumn("landed", money.landed_cost(F.col("value"), F.col("duty"))).drop("lo", "hi")


# E: latest, mode, representative, shortest

_LI = "l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus".split()


@query(f"SELECT l_orderkey, l_linenumber, l_shipdate, {', '.join(_LI)} FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC NULLS FIRST, {', '.join(c + ' NULLS LAST' for c in _LI)}) = 1")
def q_dedup_latest(spark, sf_dir):
    return rel.latest_by(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "l_shipdate")


@query("""SELECT l_suppkey, p_brand, n FROM (SELECT l_suppkey, p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, p_brand) = 1""")
def q_mode_by(spark, sf_dir):
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return rel.mode_by(li.join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_brand"), ["l_suppkey"], ["p_brand"])


@query("""WITH m AS (SELECT c_mktsegment, c_nationkey, c_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
  v AS (SELECT c_mktsegment, c_nationkey, sum(n)::BIGINT AS votes FROM m GROUP BY c_mktsegment, c_nationkey QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY sum(n) DESC, c_nationkey) = 1),
  h AS (SELECT c_mktsegment, c_name FROM m QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, c_name) = 1)
  SELECT c_mktsegment, c_nationkey, votes, c_name AS representative, md5(c_name || '|' || c_nationkey::VARCHAR) AS golden_id FROM v JOIN h USING (c_mktsegment)""")
def q_rep_majority(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders").select("o_custkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_name")
    m = o.groupBy("o_custkey").count().join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "c_nationkey", "c_name").agg(F.sum("count").alias("n"))
    votes = rel.top_by(m.groupBy("c_mktsegment", "c_nationkey").agg(F.sum("n").alias("votes")), ["c_mktsegment"], [F.desc("votes"), F.asc("c_nationkey")])
    head = rel.top_by(m, ["c_mktsegment"], [F.desc("n"), F.asc("c_name")]).select("c_mktsegment", F.col("c_name").alias("representative"))
    return votes.join(head, "c_mktsegment").withColumn("golden_id", F.md5(F.concat("representative", F.lit("|"), F.col("c_nationkey").cast("string"))))


@query("SELECT p_brand, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name), p_partkey, p_name) = 1")
def q_shortest_desc(spark, sf_dir):
    return rel.shortest_by(table(spark, sf_dir, "part"), "p_brand", "p_name", "p_partkey")


# D, J32, P2: concentration


@query(f"""WITH {_SHIP_SQL}, b AS (SELECT consignee, code, supplier, origin, count(*) AS n, sum(weight) AS w, sum(value) AS c FROM ship GROUP BY ALL),
  t AS (SELECT consignee, code, sum(n) AS total, sum(w) AS w, sum(c) AS c, count(DISTINCT supplier) AS supplier_count, count(DISTINCT origin) AS country_count FROM b GROUP BY ALL),
  s AS (SELECT consignee, code, sum(pow(n::DOUBLE / total, 2)) AS hhi, max(n::DOUBLE / total) AS top FROM b JOIN t USING (consignee, code) GROUP BY ALL),
  k AS (SELECT consignee, code, sum(pow(sh, 2)) AS hhi, max(sh) AS top FROM (SELECT consignee, code, origin, sum(n)::DOUBLE / max(total) AS sh FROM b JOIN t USING (consignee, code) GROUP BY ALL) GROUP BY ALL)
  SELECT consignee, code, supplier_count, country_count, total::BIGINT AS total_shipment_count, round(t.w, 2) AS total_weight_kg, round(t.c, 2) AS total_landed_cost_usd,
    round(s.hhi, 12) AS supplier_hhi, round(s.top, 12) AS top_supplier_share, round(k.hhi, 12) AS country_hhi, round(k.top, 12) AS top_country_share, s.top > 0.7 AS is_single_source, k.top > 0.7 AS is_single_country
  FROM t JOIN s USING (consignee, code) JOIN k USING (consignee, code)""")
def q_concentration_mart(spark, sf_dir):
    m = gold.mart_concentration_metrics(shipments(spark, sf_dir), "consignee", "code", "supplier", "origin", "weight", "value")
    rounded = {c: F.round(c, 12) for c in ("supplier_hhi", "top_supplier_share", "country_hhi", "top_country_share")}
    return m.withColumns(rounded | {c: F.round(c, 2) for c in ("total_weight_kg", "total_landed_cost_usd")})


_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


@query(f"""WITH {_SHIP_SQL}, b AS (SELECT consignee, chapter, supplier, count(*)::DOUBLE AS n FROM ship GROUP BY ALL),
  s AS (SELECT consignee, chapter, n / sum(n) OVER (PARTITION BY consignee, chapter) AS share FROM b), h AS (SELECT consignee, chapter, round(sum(share * share), 12) AS hhi FROM s GROUP BY ALL)
  SELECT consignee, {", ".join(f"max(CASE WHEN chapter = '{t}' THEN hhi END) AS {t.lower()}" for t in _TYPES)} FROM h GROUP BY consignee""")
def q_heatmap_pivot(spark, sf_dir):
    cells = rel.hhi(shipments(spark, sf_dir), ["consignee", "chapter"], ["supplier"]).withColumn("hhi", F.round("hhi", 12))
    return rel.pivot_matrix(cells, "consignee", "chapter", "hhi", _TYPES).select("consignee", *[F.col(t).alias(t.lower()) for t in _TYPES])


# I13, M: duty and scenarios


@query(f"WITH {_SHIP_SQL} SELECT consignee, origin, count(*) AS n, round(sum({_DUTY}), 4) AS duty, round(sum(value * (1 + {_DUTY} / 100.0)), 6) AS landed FROM ship GROUP BY ALL")
def q_landed_cost(spark, sf_dir):
    return dutied(spark, sf_dir).groupBy("consignee", "origin").agg(F.count("*").alias("n"), F.round(F.sum("duty"), 4).alias("duty"), F.round(F.sum("landed"), 6).alias("landed"))


_SCENARIOS = (scenario.Scenario("promo everywhere", 25.0, ("PROMO",)), scenario.Scenario("two origins", 10.0, (), ("NATION_1", "NATION_2")), scenario.Scenario("both", 15.0, ("LARGE", "SMALL"), ("NATION_3",)), scenario.Scenario("all", 5.0))
_SCENARIO_SQL = f"""WITH {_SHIP_SQL}, g AS (SELECT consignee, chapter, origin, count(*) AS total_shipments, avg({_DUTY}) AS rate, sum(value) AS value, sum(value * (1 + {_DUTY} / 100.0)) AS landed FROM ship GROUP BY ALL),
  s(scenario_name, pp, chapters, origins) AS (VALUES ('promo everywhere', 25.0::DOUBLE, ['PROMO'], []::VARCHAR[]), ('two origins', 10.0, [], ['NATION_1', 'NATION_2']), ('both', 15.0, ['LARGE', 'SMALL'], ['NATION_3']), ('all', 5.0, [], [])),
  x AS (SELECT *, CASE WHEN (len(chapters) = 0 OR list_contains(chapters, chapter)) AND (len(origins) = 0 OR list_contains(origins, origin)) THEN pp ELSE 0 END AS inc FROM g CROSS JOIN s)
  SELECT consignee, scenario_name, chapter AS hs_chapter, origin AS origin_country, total_shipments, round(rate, 6) AS baseline_duty_rate_pct, round(rate + inc, 6) AS scenario_duty_rate_pct, round(value, 6) AS baseline_value_usd,
    round(landed, 6) AS baseline_landed_cost_usd, round(landed + value * inc / 100.0, 6) AS scenario_landed_cost_usd, round(value * inc / 100.0, 6) AS delta_usd, round(value * inc / 100.0 / landed * 100.0, 6) AS delta_pct FROM x"""


def _scenarios(spark: SparkSession, sf_dir: str, which=_SCENARIOS) -> DataFrame:
    fact = dutied(spark, sf_dir)
    groups = fact.groupBy("consignee", F.col("chapter").alias("hs_chapter"), F.col("origin").alias("origin_country")).agg(
        F.count("*").alias("total_shipments"), F.avg("duty").alias("baseline_duty_rate_pct"), F.sum("value").alias("baseline_value_usd"), F.sum("landed").alias("baseline_landed_cost_usd")
    )
    out = scenario.simulate(groups, scenario.scenario_frame(spark, which)).drop("additional_rate_pp")
    cents = {c: F.round(c, 6) for c in ("baseline_value_usd", "baseline_landed_cost_usd", "scenario_landed_cost_usd", "delta_usd")}
    return out.withColumns(cents | {c: F.round(c, 6) for c in ("baseline_duty_rate_pct", "scenario_duty_rate_pct", "delta_pct")})


@query(_SCENARIO_SQL + " WHERE scenario_name = 'both'")
def q_scenario_delta(spark, sf_dir):
    return _scenarios(spark, sf_dir, [s for s in _SCENARIOS if s.name == "both"])


@query(_SCENARIO_SQL + " WHERE inc > 0")
def q_scenario_batch(spark, sf_dir):
    return _scenarios(spark, sf_dir).filter("delta_usd > 0")


# C2, H11, H20, N1, N2: entity resolution


@query("""WITH n AS (SELECT DISTINCT p_name FROM part) SELECT a.p_name AS name_a, b.p_name AS name_b, left(a.p_name, 3) AS block, abs(length(a.p_name) - length(b.p_name))::BIGINT AS length_diff,
  round(1 - levenshtein(a.p_name, b.p_name)::DOUBLE / greatest(length(a.p_name), length(b.p_name)), 6) AS char_sim
  FROM n a JOIN n b ON left(a.p_name, 3) = left(b.p_name, 3) AND a.p_name < b.p_name AND abs(length(a.p_name) - length(b.p_name)) < 20""")
def q_blocking_pairs(spark, sf_dir):
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().withColumn("block", F.left("name", F.lit(3)))
    pairs = rel.blocking_pairs(n, "block", "name")
    char = F.lit(1.0) - F.levenshtein("name_a", "name_b") / F.greatest(F.length("name_a"), F.length("name_b"))
    return pairs.withColumn("length_diff", F.col("length_diff").cast("long")).withColumn("char_sim", F.round(char, 6))


@query("""SELECT vec_id, ref_id, sim, rank FROM (SELECT q.vec_id, r.vec_id AS ref_id, round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 5) AS sim,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 5) DESC, r.vec_id)::INT AS rank
  FROM (SELECT * FROM embeddings WHERE vec_id % 10 <> 0) q CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 10 = 0) r) WHERE rank = 1""")
def q_cosine_top1(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    refs = e.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("v"))
    out = cosine_top_k(e.filter("vec_id % 10 != 0").select("vec_id", "embedding"), refs, "embedding", "v", "ref_id", 1)
    return out.withColumn("sim", F.round("sim", 5))


_SIM = "list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[])"


@query(f"""SELECT q.vec_id, round(sum({_SIM}), 4) AS sim_sum, count(*) AS n FROM embeddings q JOIN embeddings r ON q.label = r.label AND q.vec_id <> r.vec_id GROUP BY q.vec_id""")
def q_cosine_pairs(spark, sf_dir):
    return cosine_sums(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding").withColumn("sim_sum", F.round("sim_sum", 4))


@query("""SELECT vec_id, count(*)::BIGINT AS n, round(sum(sim), 6) AS sim_sum FROM (SELECT q.vec_id, r.vec_id AS ref_id, list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS sim,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) DESC, r.vec_id) AS rank FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id) WHERE rank <= 5 GROUP BY vec_id""")
def q_cosine_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = cosine_top_k(e, e.select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("v")), "embedding", "v", "ref_id", 5, exclude_equal="vec_id")
    return out.groupBy("vec_id").agg(F.count("*").alias("n"), F.round(F.sum("sim"), 6).alias("sim_sum"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 1000000000 AS b FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.09),
  u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a AS node, a AS label FROM u UNION SELECT u.b, r.label FROM reach r JOIN u ON u.a = r.node)
  SELECT node, min(label) AS component FROM reach GROUP BY node""")
def q_components(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter("l_quantity >= 50 AND l_discount >= 0.09")
    return connected_components(li.select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000000).alias("b")), "a", "b")


@query("""WITH e AS (SELECT vec_id, label AS truth, vec_id % 7 + CASE WHEN label < 5 THEN 0 ELSE 100 END AS ours FROM embeddings),
  p AS (SELECT a.truth = b.truth AS t, a.ours = b.ours AS o FROM e a JOIN e b ON a.vec_id < b.vec_id AND (a.truth = b.truth OR a.ours = b.ours)),
  m AS (SELECT count(*) FILTER (t AND o) AS true_positive, count(*) FILTER (o AND NOT t) AS false_positive, count(*) FILTER (t AND NOT o) AS false_negative, 0::BIGINT AS true_negative, count(*) AS total_pairs FROM p)
  SELECT *, round(true_positive / (true_positive + false_positive), 6) AS precision, round(true_positive / (true_positive + false_negative), 6) AS recall,
    round(2.0 * true_positive / (2 * true_positive + false_positive + false_negative), 6) AS f1 FROM m""")
def q_er_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("truth"), (F.col("vec_id") % 7 + F.when(F.col("label") < 5, 0).otherwise(100)).alias("ours"))
    return entities.pair_metrics(e, "vec_id", "ours", "truth").withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("""WITH e AS (SELECT o_orderkey AS id, o_custkey AS k1, left(o_orderpriority, 1) || (o_orderkey % 500)::VARCHAR AS k2 FROM orders WHERE o_orderkey % 4 = 0)
  SELECT count(*) AS n_pairs, count(*) FILTER (a.k1 = b.k1) AS first_key, count(*) FILTER (a.k2 = b.k2) AS second_key FROM e a JOIN e b ON a.id < b.id AND (a.k1 = b.k1 OR a.k2 = b.k2)""")
def q_disjunctive_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 4 = 0")
    e = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k1"), F.concat(F.left("o_orderpriority", F.lit(1)), (F.col("o_orderkey") % 500).cast("string")).alias("k2"))
    p = rel.disjunctive_pairs(e, "id", "k1", "k2")
    return p.agg(F.count("*").alias("n_pairs"), F.count_if(F.col("k1_a") == F.col("k1_b")).alias("first_key"), F.count_if(F.col("k2_a") == F.col("k2_b")).alias("second_key"))


# J31, L, O10, A10: texts


@query("""WITH d AS (SELECT doc_id, text, length(text) AS total FROM documents WHERE length(text) >= 5000), k AS (SELECT *, unnest(range(0, ceil(total / 1500.0)::BIGINT)) * 1500 + 1 AS chunk_start FROM d)
  SELECT md5(doc_id::VARCHAR || '|' || chunk_start::VARCHAR) AS chunk_id, doc_id, chunk_start, least(chunk_start + 1699, total)::BIGINT AS chunk_end, length(substr(text, chunk_start, 1700))::BIGINT AS chunk_length, md5(substr(text, chunk_start, 1700)) AS chunk_md5
  FROM k WHERE chunk_start <= total AND length(substr(text, chunk_start, 1700)) >= 200""")
def q_chunks(spark, sf_dir):
    c = rel.text_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return c.select(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.col("chunk_start").cast("string"))).alias("chunk_id"), "doc_id", "chunk_start", "chunk_end", "chunk_length", F.md5("chunk_text").alias("chunk_md5"))


_WORDS = ("licensed", "token", "the and", "sch")


@query("SELECT doc_id, length(text)::BIGINT AS n_chars, " + ", ".join(f"len(regexp_extract_all(text, '(?i){w}'))::BIGINT AS {w.replace(' ', '_')}" for w in _WORDS) + ", (" + " + ".join(f"len(regexp_extract_all(text, '(?i){w}'))" for w in _WORDS)
       + ")::BIGINT AS total, round((" + " + ".join(f"len(regexp_extract_all(text, '(?i){w}'))" for w in _WORDS) + ") * 10000.0 / length(text), 6) AS per_10k FROM documents")
def q_keyword_density(spark, sf_dir):
    return profile.risk_density(table(spark, sf_dir, "documents"), "text", "doc_id", _WORDS).withColumn("per_10k", F.round("per_10k", 6))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g') AS h FROM pages), b AS (SELECT page_id, regexp_replace(h, '(?is)<style\b.*?</style\s*>', ' ', 'g') AS h FROM a),
  c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '(?s)<[^>]*>', ' ', 'g'), '(?i)&nbsp;|&#160;|&#xa0;', ' ', 'g'), '(?i)&amp;', '&', 'g') AS h FROM b)
  SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(h, '&#8217;|&rsquo;', '''', 'g'), '[ \t\x{a0}]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g')) AS plain FROM c""")
def q_strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("plain"))


# H, I: column functions


@query("SELECT c_custkey, trim(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, ',\\s+', ' ', 'g'), '(?i)\\b(incorporated|corporation|company|limited|corp|gmbh|sarl|inc|llc|llp|ltd|plc|pty|spa|srl|ab|ag|as|bv|co|kk|nv|oy|sa)\\b', '', 'g'), '(?i)[^a-z0-9 ]', '', 'g'), '\\s+', ' ', 'g'), '(?i)^\\s+|\\s+$|^the ', '', 'g'))) AS norm FROM (SELECT c_custkey, 'The ' || c_name || ' & Co., Ltd.' AS x FROM customer)".replace("\\\\", "\\"))
def q_normalize_name(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", text.normalize_company_name(F.concat(F.lit("The "), "c_name", F.lit(" & Co., Ltd."))).alias("norm"))


@query(f"SELECT p_partkey, {product_sql('x')} AS norm FROM (SELECT p_partkey, p_name || ' PO# ' || p_partkey::VARCHAR || ' STYLE: AB-12 HS CODE: 392690 ' || p_size::VARCHAR || ' KGS, 7654321 MSCU1234567 un 1234' AS x FROM part)")
def q_normalize_text(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    x = F.concat("p_name", F.lit(" PO# "), F.col("p_partkey").cast("string"), F.lit(" STYLE: AB-12 HS CODE: 392690 "), F.col("p_size").cast("string"), F.lit(" KGS, 7654321 MSCU1234567 un 1234"))
    return p.select("p_partkey", text.normalize_product_text(x).alias("norm"))


# B8, C9, G1, H15, D11, H19


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01') AND o_orderdate >= TIMESTAMP '1998-01-01'")
def q_incremental_anti(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return rel.anti_by(o.filter("o_orderdate >= TIMESTAMP '1998-01-01'").select("o_orderkey", "o_custkey"), o.filter("o_orderdate < TIMESTAMP '1998-01-01'"), ["o_custkey"])


@query("""SELECT r_name, n_name, match FROM (SELECT r_name, n_name, CASE WHEN n_name IS NULL THEN 'none' ELSE 'partial' END AS match,
  row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey DESC NULLS LAST) AS rn FROM region LEFT JOIN nation ON n_name LIKE '%' || r_regionkey::VARCHAR || '%') WHERE rn = 1""")
def q_like_match(spark, sf_dir):
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    pairs = n.join(F.broadcast(r), F.col("n_name").contains(F.col("r_regionkey").cast("string")), "right")
    best = rel.top_by(pairs, ["r_name"], [F.col("n_nationkey").desc_nulls_last()])
    return best.select("r_name", "n_name", F.when(F.col("n_name").isNull(), "none").otherwise("partial").alias("match"))


_SUMMARY = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, strftime(min({d}), '%Y-%m-%d') AS first_value, strftime(max({d}), '%Y-%m-%d') AS last_value FROM {t}" for t, d in _SUMMARY.items()))
def q_union_summary(spark, sf_dir):
    from portolan.sources.tables import load_summary

    return load_summary({t: (table(spark, sf_dir, t).select(F.date_format(d, "yyyy-MM-dd").alias(d)), d) for t, d in _SUMMARY.items()})


@query("""SELECT d AS date_key, d AS date_day, year(d) AS year, quarter(d) AS quarter, month(d) AS month, day(d) AS day, strftime(d, '%a') AS day_name, dayofweek(d) IN (0, 6) AS is_weekend, 'Q' || quarter(d)::VARCHAR || ' ' || year(d)::VARCHAR AS fiscal_quarter_label
  FROM (SELECT unnest(range(DATE '2013-01-01', DATE '2027-01-01', INTERVAL 1 DAY))::DATE AS d)""")
def q_date_dim(spark, sf_dir):
    return gold.dim_date(spark)


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY event_type")
def q_percentiles(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    q = lambda p: F.round(F.expr(f"percentile(value, {p})"), 6)
    return e.groupBy("event_type").agg(q(0.5).alias("p50"), q(0.95).alias("p95"), F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


@query("SELECT (props->>'$.k')::BIGINT AS k, count(*) AS n_calls FROM events GROUP BY ALL")
def q_json_breakdown(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.try_variant_get(F.parse_json("props"), "$.k", "long").alias("k"))
    return e.groupBy("k").agg(F.count("*").alias("n_calls"))


# O, P


@query("SELECT 'c_name' AS column_name, count(*) AS n_rows, count(*) - count(c_name) AS n_null, 0.0::DOUBLE AS null_share FROM customer UNION ALL SELECT 'o_custkey', count(*), count(*) FILTER (o_custkey IS NULL), round(count(*) FILTER (o_custkey IS NULL) / count(*), 6) FROM (SELECT o_custkey FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON o_custkey = c_custkey)")
def q_null_profile(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    wide = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return profile.null_profile(wide, ["c_name", "o_custkey"]).withColumn("null_share", F.round("null_share", 6))


@query("""WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT row_number() OVER (ORDER BY n DESC, o_custkey) AS rank, sum(n) OVER (ORDER BY n DESC, o_custkey ROWS UNBOUNDED PRECEDING) / (SELECT sum(n) FROM c) AS row_share FROM c),
  k AS (SELECT s::DOUBLE AS top_share, greatest(1, floor(count(*) * s))::BIGINT AS n_keys FROM c, (VALUES (0.01), (0.1), (0.5)) t(s) GROUP BY s) SELECT top_share, n_keys, round(row_share, 6) AS row_share FROM k JOIN r ON rank = n_keys""")
def q_pareto(spark, sf_dir):
    return profile.pareto(table(spark, sf_dir, "orders"), "o_custkey").withColumn("row_share", F.round("row_share", 6))


@query(f"""WITH {_SHIP_SQL} SELECT count(*) AS total_shipments, count(DISTINCT consignee) AS unique_consignees, count(DISTINCT supplier) AS unique_suppliers, round(sum(value), 2) AS total_value,
  (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey) = 1)) AS single_source_orders FROM ship""")
def q_kpis(spark, sf_dir):
    s = shipments(spark, sf_dir).agg(F.count("*").alias("total_shipments"), F.countDistinct("consignee").alias("unique_consignees"), F.countDistinct("supplier").alias("unique_suppliers"), F.round(F.sum("value"), 2).alias("total_value"))
    one = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("a"), F.max("l_suppkey").alias("b")).filter("a = b").agg(F.count("*").alias("single_source_orders"))
    return s.crossJoin(one)


@query("SELECT c_name, total FROM (SELECT c_name, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name) ORDER BY total DESC NULLS LAST, c_name LIMIT 10")
def q_top_consignees(spark, sf_dir):
    cost = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t"))
    named = cost.join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_name").agg(F.round(F.sum("t"), 2).alias("total"))
    return named.orderBy(F.col("total").desc_nulls_last(), "c_name").limit(10)


@query("SELECT l_orderkey, l_suppkey, n FROM (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey) = 1)")
def q_distinct_window(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))
    return rel.count_distinct_over(pairs, ["l_orderkey"], "l_suppkey", "k").filter("k = 1").drop("k")


@query("SELECT p_brand, round(avg(CASE WHEN p_size > 25 THEN p_retailprice END), 6) AS avg_rate, round(avg(CASE WHEN p_size <= 25 THEN 1.0 ELSE 0.0 END), 6) AS free_share FROM part GROUP BY p_brand")
def q_outer_profile(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    mean = p.filter("p_size > 25").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 6).alias("avg_rate"))
    share = p.groupBy("p_brand").agg(F.round(F.avg(F.when(F.col("p_size") <= 25, 1.0).otherwise(0.0)), 6).alias("free_share"))
    return mean.join(share, "p_brand", "outer")


@query("SELECT r_name, n_failed FROM (SELECT 'unique' AS r_name, count(*) AS n_failed FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'accepted', count(*) FROM (SELECT l_returnflag FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') GROUP BY 1) UNION ALL SELECT 'related', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT 'not_null', 0)")
def q_quality_checks(spark, sf_dir):
    from portolan.plans import checks

    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    found = {"unique": checks.unique(li.withColumn("k", F.struct("l_orderkey", "l_linenumber")), "k"), "accepted": checks.accepted_values(li, "l_returnflag", ["A", "N"]), "related": checks.relationships(li, "l_orderkey", o, "o_orderkey"), "not_null": checks.not_null(li, "l_orderkey")}
    parts = [df.agg(F.lit(n).alias("r_name"), F.count("*").alias("n_failed")) for n, df in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL")
def q_windowed_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    w = incremental.windowed_counts(e, "ts", ["event_type"])
    return w.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("""SELECT l_suppkey, string_agg('  Candidate ' || rank::VARCHAR || '. ' || p_brand || ' (' || n::VARCHAR || ')', chr(10) ORDER BY rank) AS block FROM (SELECT l_suppkey, p_brand, n, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, p_brand) AS rank
  FROM (SELECT l_suppkey, p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)) WHERE rank <= 5 GROUP BY l_suppkey""")
def q_ordered_listagg(spark, sf_dir):
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    n = li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_brand").agg(F.count("*").alias("n"))
    best = rel.top_by(n, ["l_suppkey"], [F.desc("n"), F.asc("p_brand")], 5).withColumn("rank", F.row_number().over(W.partitionBy("l_suppkey").orderBy(F.desc("n"), "p_brand")))
    line = F.concat(F.lit("  Candidate "), "rank", F.lit(". "), "p_brand", F.lit(" ("), "n", F.lit(")"))
    return best.groupBy("l_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("s")))), lambda x: x["s"]), "\n").alias("block"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_custkey, round(o_totalprice * 2, 2) FROM orders WHERE o_orderkey % 3 = 0")
def q_upsert(spark, sf_dir):
    from portolan.session import new_table_path
    from portolan.sources.tables import upsert

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    path = new_table_path(spark, "upsert")
    upsert(o.filter("o_orderkey % 2 = 0"), path, ["o_orderkey"])
    return upsert(o.filter("o_orderkey % 3 = 0").withColumn("o_totalprice", F.round(F.col("o_totalprice") * 2, 2)), path, ["o_orderkey"])


_FLAGS = ("F", "O", "P")


@query(f"SELECT o_orderpriority, {', '.join(f'count(*) FILTER (o_orderstatus = {chr(39)}{s}{chr(39)}) AS {s.lower()}' for s in _FLAGS)} FROM orders GROUP BY ALL")
def q_contingency(spark, sf_dir):
    t = profile.contingency(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", _FLAGS)
    return t.select("o_orderpriority", *[F.col(s).alias(s.lower()) for s in _FLAGS])


@query("SELECT count(*) AS total_queries, round(quantile_cont(value, 0.5), 6) AS p50_latency_ms, round(quantile_cont(value, 0.95), 6) AS p95_latency_ms, round(avg(user_id), 6) AS avg_cost_credits_estimate, round(avg(user_id) * 2.0, 6) AS avg_cost_usd_estimate FROM events")
def q_trace_stats(spark, sf_dir):
    from portolan.plans import serving

    traces = table(spark, sf_dir, "events").select(F.col("value").alias("total_latency_ms"), F.col("user_id").alias("cost_credits_estimate"))
    s = serving.agent_trace_stats(traces)
    return s.select("total_queries", *[F.round(c, 6).alias(c) for c in s.columns[1:]])


@query(f"""WITH {_SHIP_SQL}, m AS (SELECT chapter, avg(CASE WHEN general > 0 THEN general / 100 END) AS rate FROM ship GROUP BY ALL)
  SELECT consignee, count(*) AS n, round(sum(value), 2) AS value, round(sum(value * coalesce(rate, 0)), 2) AS exposure FROM ship LEFT JOIN m USING (chapter) GROUP BY ALL""")
def q_naive_exposure(spark, sf_dir):
    s = shipments(spark, sf_dir)
    mean = s.groupBy("chapter").agg(F.avg(F.when(F.col("general") > 0, F.col("general") / 100)).alias("rate"))
    out = s.join(mean, "chapter", "left").groupBy("consignee").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"), F.round(F.sum(F.col("value") * F.coalesce("rate", F.lit(0.0))), 2).alias("exposure"))
    return out


@query("SELECT doc_id, len(regexp_extract_all(text, '(?is).{0,40}licensed.{0,40}'))::BIGINT AS n, md5(array_to_string(regexp_extract_all(text, '(?is).{0,40}licensed.{0,40}'), '|')) AS passages FROM documents WHERE regexp_matches(text, '(?i)licensed')")
def q_passages(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.keyword_snippets(F.col("text"), "licensed", 40).alias("s"))
    return d.filter(F.size("s") > 0).select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("passages"))


# K: the semantic layer over the driver's tables


def tpch_model() -> Model:
    m = Model({"lineitem": ("l_orderkey", "l_linenumber"), "orders": ("o_orderkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "nation": ("n_nationkey",), "region": ("r_regionkey",)})
    for s, k, t, tk in (("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey")):
        m.relationships.append(Relationship(s, k, t, tk))
    for t, cols in {"customer": "c_name c_mktsegment", "nation": "n_name", "region": "r_name", "part": "p_brand p_type", "supplier": "s_name", "orders": "o_orderpriority o_orderstatus", "lineitem": "l_returnflag"}.items():
        m.dimensions += [Dimension(t, c, c, (c[2:],)) for c in cols.split()]
    m.dimensions += [Dimension("orders", "year", "o_year"), Dimension("orders", "month", "o_month")]
    m.metrics += [Metric("lineitem", "total_shipments", "count", "*", ("shipment count",)), Metric("lineitem", "total_value", "sum", "l_extendedprice", ("landed cost",)), Metric("lineitem", "avg_tax", "avg", "l_tax")]
    m.metrics += [Metric("orders", "total_orders", "count", "*"), Metric("orders", "max_price", "max", "o_totalprice")]
    return m


def _semantic(spark, sf_dir, metrics, dims, where=()):
    t = {n: table(spark, sf_dir, n) for n in ("lineitem", "customer", "supplier", "part", "nation", "region")}
    t["orders"] = table(spark, sf_dir, "orders").withColumn("o_year", F.year("o_orderdate").cast("long")).withColumn("o_month", F.month("o_orderdate").cast("long"))
    return tpch_model().query(t, metrics.split(), dims.split(), where)


_STAR = "lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"
_ONE = "count(*) AS total_shipments, round(sum(l_extendedprice), 2) AS total_value"


def _top(df: DataFrame, by: str, *ties: str, n: int = 10) -> DataFrame:
    return df.orderBy(F.col(by).desc_nulls_last(), *ties).limit(n)


@query(f"SELECT c_name, {_ONE} FROM {_STAR} GROUP BY c_name ORDER BY total_value DESC NULLS LAST, c_name LIMIT 10")
def q_semantic_1(spark, sf_dir):
    return _top(_semantic(spark, sf_dir, "total_shipments total_value", "c_name").withColumn("total_value", F.round("total_value", 2)), "total_value", "c_name")


@query("SELECT c_mktsegment, o_orderpriority, max(o_totalprice) AS max_price FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY ALL")
def q_semantic_2(spark, sf_dir):
    return _semantic(spark, sf_dir, "max_price", "c_mktsegment o_orderpriority", [("o_orderstatus", "=", "F")])


@query(f"SELECT p_type, p_brand, {_ONE} FROM {_STAR} WHERE l_returnflag = 'R' GROUP BY ALL")
def q_semantic_3(spark, sf_dir):
    return _semantic(spark, sf_dir, "total_shipments total_value", "p_type p_brand", [("l_returnflag", "=", "R")]).withColumn("total_value", F.round("total_value", 2))


@query(f"SELECT s_name, p_brand, {_ONE} FROM {_STAR} WHERE n_name = 'NATION_3' AND p_type = 'PROMO' GROUP BY ALL")
def q_semantic_4(spark, sf_dir):
    return _semantic(spark, sf_dir, "total_shipments total_value", "s_name p_brand", [("n_name", "=", "NATION_3"), ("p_type", "=", "PROMO")]).withColumn("total_value", F.round("total_value", 2))


@query(f"SELECT p_type, {_ONE}, round(avg(l_tax), 6) AS avg_tax FROM {_STAR} WHERE r_name <> 'ASIA' AND p_type IN ('PROMO', 'LARGE') GROUP BY ALL")
def q_semantic_5(spark, sf_dir):
    out = _semantic(spark, sf_dir, "total_shipments total_value avg_tax", "p_type", [("r_name", "!=", "ASIA"), ("p_type", "in", ["PROMO", "LARGE"])])
    return out.withColumn("total_value", F.round("total_value", 2)).withColumn("avg_tax", F.round("avg_tax", 6))


@query(f"SELECT c_name, count(*) AS total_shipments FROM {_STAR} WHERE c_mktsegment = 'BUILDING' GROUP BY ALL ORDER BY total_shipments DESC, c_name LIMIT 20")
def q_semantic_6(spark, sf_dir):
    return _top(_semantic(spark, sf_dir, "total_shipments", "c_name", [("c_mktsegment", "=", "BUILDING")]), "total_shipments", "c_name", n=20)


@query("SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS total_orders FROM orders WHERE year(o_orderdate) = 1996 GROUP BY ALL")
def q_semantic_7(spark, sf_dir):
    return _semantic(spark, sf_dir, "total_orders", "year month", [("year", "=", 1996)])


@query(f"""WITH a AS (SELECT c_name, o_orderpriority, max(o_totalprice) AS max_price FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY ALL), b AS (SELECT c_name, o_orderpriority, count(*) AS total_shipments FROM {_STAR} GROUP BY ALL)
  SELECT coalesce(a.c_name, b.c_name) AS c_name, coalesce(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority, max_price, total_shipments FROM a FULL JOIN b ON a.c_name IS NOT DISTINCT FROM b.c_name AND a.o_orderpriority IS NOT DISTINCT FROM b.o_orderpriority WHERE total_shipments >= 5""")
def q_semantic_8(spark, sf_dir):
    return _semantic(spark, sf_dir, "max_price total_shipments", "c_name o_orderpriority").filter("total_shipments >= 5")


@query(f"SELECT n_name, count(*) AS total_shipments FROM {_STAR} WHERE r_name <> 'ASIA' GROUP BY ALL")
def q_semantic_9(spark, sf_dir):
    return _semantic(spark, sf_dir, "total_shipments", "n_name", [("r_name", "!=", "ASIA")])


@query(f"""WITH g AS (SELECT c_name, p_brand, s_name, count(*) AS total_shipments FROM {_STAR} WHERE p_type = 'PROMO' GROUP BY ALL)
  SELECT c_name, p_brand, s_name, total_shipments FROM g WHERE (c_name, p_brand) IN (SELECT (c_name, p_brand) FROM g GROUP BY ALL HAVING count(DISTINCT s_name) = 1)""")
def q_semantic_10(spark, sf_dir):
    g = _semantic(spark, sf_dir, "total_shipments", "c_name p_brand s_name", [("p_type", "=", "PROMO")])
    return rel.count_distinct_over(g, ["c_name", "p_brand"], "s_name", "k").filter("k = 1").drop("k")
