"""Queries that put one part of the library at a time to the test: column rules, sources, sinks, streams, search and checks, each with SQL that computes the same."""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portolan.functions import country, hs, text
from portolan.functions.vector import LetterCounts
from portolan.operators.relational import exact_sample
from portolan.plans import agent, checks, classify, search, semantic
from portolan.plans.queries import query, table
from portolan.plans.scenario import CANONICAL, simulate_as_json
from portolan.plans.world import _RATE, _cases, _country_sql, _has, _port_sql, _q, sql, world
from portolan.schemas import BOL
from portolan.session import new_table_path, ship_code
from portolan.sources import bol, filings, hts, tables
from portolan.streaming import incremental


def _made(spark: SparkSession, sf_dir: str, source: str, select: str) -> DataFrame:
    """Rows made from one of the driver's tables by a SELECT that Spark and DuckDB read alike; ``{t}`` is the table."""
    df = table(spark, sf_dir, source)
    view = f"probe_{source}"
    df.createOrReplaceTempView(view)
    return spark.sql(select.format(t=view))


def _probe(name: str, source: str, made: str, theirs: str, mine) -> None:
    """``mine`` of the rows of ``made`` against ``theirs``, which selects from them as x."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return mine(_made(spark, sf_dir, source, made))

    run.__name__ = name
    query(f"WITH x AS ({made.format(t=source)}) {theirs}")(run)


# Column rules

_NAMED = [n[1][0] for n in country.NAMES]
_ADDRESS = f"""SELECT DISTINCT {_cases("c_custkey % 5", ["1 Main St, ", "MADE IN CHINA ", "Colonia Roma ", "Atlanta, GA ", ""])} || coalesce({_cases("c_custkey % 67", _NAMED)}, 'Somewhere')
  || {_cases("c_custkey % 13", ["", ", DE 19801", " MX 12345", " SC 29651", " NJ 07102-1234 USA", " USA", " 12345", ", U.S.A.", " US ", ", VN ", " United States", " M 12345", ", S.A. DE C.V. 06700"])} AS address FROM {{t}}"""
_probe("q_country_case", "customer", _ADDRESS, f"SELECT address, {_country_sql('address')} AS country FROM x", lambda x: x.withColumn("country", country.extract_country_from_text(F.col("address"))))
_PORT = f"SELECT DISTINCT 'Port ' || CAST(c_custkey % 10 AS STRING) || CASE WHEN c_custkey % 3 = 0 THEN ' of Spain' ELSE '' END || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE ',' END || coalesce({_cases('c_custkey % 53', _NAMED)}, 'Trinidad') AS port FROM {{t}}"
_probe("q_port_origin", "customer", _PORT, f"SELECT port, {_port_sql('port')} AS origin, nullif(trim(regexp_extract(port, ',([^,]+)$', 1)), '') AS suffix FROM x", lambda x: x.withColumn("origin", country.port_origin_country(F.col("port"))).withColumn("suffix", country.port_suffix(F.col("port"))))
_PARTY = f"SELECT DISTINCT coalesce({_cases('c_custkey % 91', [*text.FORWARDERS, *text.PLACEHOLDERS, 'na', 'N/A', 'ab', '   ', 'acme', 'Marco Polo', 'molson'])}, c_mktsegment) || CASE c_custkey % 4 WHEN 0 THEN ' lines' WHEN 1 THEN 'x' ELSE '' END AS name FROM {{t}}"
_probe("q_forwarder_placeholder", "customer", _PARTY, f"SELECT name, {_has('upper(name)', text.FORWARDERS)} AS forwarder, ({_has('upper(name)', text.PLACEHOLDERS)} OR upper(name) IN ('NA', 'N/A') OR length(trim(name)) < 3) AS placeholder FROM x", lambda x: x.withColumn("forwarder", text.is_freight_forwarder(F.col("name"))).withColumn("placeholder", text.is_placeholder_name(F.col("name"))))
_SIZE = "CAST(p_size AS STRING)"
_RATES = f"SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'Free' WHEN 1 THEN {_SIZE} || '%' WHEN 2 THEN ' ' || {_SIZE} || '.' || CAST(p_partkey % 10 AS STRING) || '% ' WHEN 3 THEN 'free' WHEN 4 THEN '  ' WHEN 5 THEN {_SIZE} || 'c/kg' WHEN 6 THEN {_SIZE} || '% + 3c' WHEN 7 THEN {_SIZE} || '.%' END AS general_rate_text FROM {{t}}"
_probe("q_rate_parse", "part", _RATES, f"SELECT p_partkey, round({_RATE}, 6) AS ad_valorem, CASE WHEN trim(general_rate_text) NOT IN ('', 'Free') AND NOT regexp_full_match(trim(general_rate_text), '[0-9]+(\\.[0-9]+)?%') THEN general_rate_text END AS specific FROM x",
       lambda x: x.select("p_partkey", F.round(hs.ad_valorem_rate(F.col("general_rate_text")), 6).alias("ad_valorem"), hs.specific_rate(F.col("general_rate_text")).alias("specific")))
_SIX = "lpad(CAST(p_partkey * 7919 % 1000000 AS STRING), 6, '0')"
_ANSWERS = f"SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN {_SIX} WHEN 1 THEN substr({_SIX}, 1, 4) || '.' || substr({_SIX}, 5, 2) WHEN 2 THEN substr({_SIX}, 1, 4) WHEN 3 THEN '999999' WHEN 4 THEN {_SIX} || '1234' WHEN 5 THEN substr({_SIX}, 1, 5) WHEN 6 THEN 'no idea' WHEN 7 THEN 'The code is ' || {_SIX} || '.' WHEN 8 THEN 'heading ' || substr({_SIX}, 1, 4) || ' of 12345' END AS response FROM {{t}}"
_probe("q_response_parse", "part", _ANSWERS, r"""SELECT p_partkey, coalesce(six, replace(dotted, '.', ''), four || '00') AS code, CASE WHEN six = '999999' THEN 'unclassifiable' WHEN six IS NOT NULL THEN 'classified_hs6' WHEN dotted IS NOT NULL THEN 'classified_hs6_dotted' WHEN four IS NOT NULL THEN 'classified_hs4_only' ELSE 'parse_failed' END AS status
  FROM (SELECT p_partkey, nullif(regexp_extract(response, '\d{6}'), '') AS six, nullif(regexp_extract(response, '\d{4}\.\d{2}'), '') AS dotted, nullif(regexp_extract(response, '\b\d{4}\b'), '') AS four FROM x)""", lambda x: x.select("p_partkey", *[c.alias(n) for c, n in zip(hs.parse_response(F.col("response")), ("code", "status"))]))  # fmt: skip
_IDS = "SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN o_orderkey * 1000000 WHEN 1 THEN o_orderkey * 100000 WHEN 2 THEN 0 WHEN 3 THEN NULL WHEN 4 THEN 2018000000000 + o_orderkey ELSE o_orderkey END AS identifier FROM {t}"
_probe("q_sentinel_ids", "orders", _IDS, r"SELECT o_orderkey, identifier IS NULL OR identifier = 0 OR regexp_full_match(identifier::VARCHAR, '[1-9]\d{0,5}0{6,}') AS sentinel FROM x", lambda x: x.select("o_orderkey", hs.is_sentinel_identifier(F.col("identifier")).alias("sentinel")))
_BODIES = f"SELECT p_partkey, p_name || CASE p_partkey % 6 WHEN 0 THEN ' HS CODE: ' || {_SIX} WHEN 1 THEN ' PO 17049065 hs-code ' || {_SIX} WHEN 2 THEN ' HTS ' || {_SIX} WHEN 3 THEN ' HS CODE(S) 34022020' WHEN 4 THEN ' HSCODE ' || substr({_SIX}, 1, 4) || '.' || substr({_SIX}, 5, 2) ELSE '' END AS body FROM {{t}}"
_probe("q_hs_from_text", "part", _BODIES, r"SELECT p_partkey, CASE WHEN regexp_full_match(body, '(?i).*HS[ -]?CODE:?\s*\d{4}\.?\d{2}.*') THEN nullif(regexp_extract(body, '\d{4}\.?\d{2}'), '') END AS code FROM x", lambda x: x.select("p_partkey", hs.hs_from_text(F.col("body")).alias("code")))

# Sources: files are written into the shared folder and read back

_CSV = """SELECT l_orderkey AS identifier, CAST(l_shipdate AS DATE) AS trade_update_date, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 'MSCU' || CAST(l_partkey AS STRING) END AS container_number, 'ACME, "the" ' || CAST(l_suppkey AS STRING) AS shipper_party_name,
  CASE WHEN l_orderkey % 11 = 0 THEN 'two' || chr(10) || 'lines, "quoted"' WHEN l_orderkey % 13 = 0 THEN '' ELSE 'plain' END AS text, CAST(l_linenumber AS BIGINT) AS piece_count FROM {t}"""


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _made(spark, sf_dir, "lineitem", _CSV)
    have = set(made.columns)
    path = new_table_path(spark, "probe-csv")
    made.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in BOL.fields]).write.csv(path, header=True, quote='"', escape='"', nullValue="NULL", emptyValue="", compression="gzip", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    df, report = bol.load_bol(spark, path, 8)
    assert report.multi_line and not report.rows_rejected
    return df


@query(f"WITH x AS ({_CSV.format(t='lineitem')}) SELECT * REPLACE (nullif(text, '') AS text) FROM x")
def p_bol_csv(spark, sf_dir):
    return _csv(spark, sf_dir).select("identifier", "trade_update_date", "container_number", "shipper_party_name", "text", "piece_count")


@query(f"""WITH x AS ({_CSV.format(t="lineitem")}) SELECT count(*) AS n_rows, 1.0::DOUBLE AS identifier_share, 1.0::DOUBLE AS shipper_party_name_share, 0.0::DOUBLE AS consignee_name_share, round(count(nullif(text, '')) / count(*), 7) AS text_share, 0.0::DOUBLE AS harmonized_number_share, 0.0::DOUBLE AS harmonized_value_share,
  min(trade_update_date) AS first_date, max(trade_update_date) AS last_date FROM x""")
def p_bol_profile(spark, sf_dir):
    out = bol.load_profile(_csv(spark, sf_dir))
    return out.withColumns({c: F.round(c, 7) for c, kind in out.dtypes if kind == "double"})


_HTS = "SELECT p_partkey, '87' || lpad(CAST(p_partkey % 100 AS STRING), 2, '0') || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '.99' WHEN 2 THEN '.99.10' ELSE '.99.10.25' END AS htsno, p_name AS description, CAST(p_size % 5 AS STRING) AS indent, CASE WHEN p_size % 2 = 0 THEN '3.4%' ELSE '' END AS general FROM {t}"


def _as_list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The texts of a JSON list, of which the batches have the entries."""
    mark = "["
    for b in batches:
        values = b["value"].tolist()
        if values:
            yield pd.DataFrame({"value": [mark + values[0], *["," + v for v in values[1:]]]})
            mark = ","
    yield pd.DataFrame({"value": ["]"] if mark == "," else ["[]"]})


@query(f"""WITH x AS ({_HTS.format(t="part")}), d AS (SELECT *, replace(htsno, '.', '') AS digits FROM x) SELECT htsno AS hts_number, description, indent::BIGINT AS indent, 'kg,no' AS units, nullif(general, '') AS general_rate_text, 'See ' || p_partkey::VARCHAR || '; plain' AS footnotes,
  left(digits, 2) AS hs2, left(digits, 4) AS hs4, left(digits, 6) AS hs6, left(digits, 8) AS hs8, left(digits, 10) AS hs10 FROM d""")
def p_hts_json(spark, sf_dir):
    ship_code(spark)
    x = _made(spark, sf_dir, "part", _HTS)
    note = F.to_json(F.struct(F.concat(F.lit("See "), F.col("p_partkey").cast("string")).alias("value")))
    one = F.concat(F.lit("{"), F.array_join(F.array(*[F.concat(F.lit(f'"{c}": "'), F.col(c), F.lit('"')) for c in ("htsno", "description", "indent", "general")], F.lit('"units": ["kg", "no"]'), F.concat(F.lit('"footnotes": ['), note, F.lit(', "plain", ""]'))), ", "), F.lit("}"))
    path = new_table_path(spark, "probe-json")
    x.select(one.alias("value")).repartition(1).mapInPandas(_as_list, "value string").write.text(path, lineSep=" ")  # the schedule is one file of a list
    out = hts.load_hts(spark, [path + "-missing", path])
    return out.select("hts_number", "description", "indent", "units", "general_rate_text", "footnotes", *[f"hs{n}" for n in (2, 4, 6, 8, 10)])


_BODY = "repeat('Risk ' || md5(CAST(doc_id AS STRING)) || ' is here. ', CAST(100 + doc_id % 60 AS INT))"
_SUBMISSION = f"""SELECT doc_id, 'edgar/0000' || lpad(CAST(doc_id AS STRING), 6, '0') || '-16-000001/full.txt' AS path, 'NKE' AS ticker, CASE WHEN doc_id % 5 = 0 THEN '20-F' ELSE '10-K' END AS filing_type,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'CENTRAL INDEX KEY:   000' || CAST(7000 + doc_id AS STRING) END || chr(10) || 'FILED AS OF DATE: 201603' || lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0') || chr(10)
  || '<DOCUMENT>' || chr(10) || '<TYPE>EX-99' || chr(10) || '<TEXT>no</TEXT></DOCUMENT><DOCUMENT>' || chr(10) || '<TYPE>' || CASE WHEN doc_id % 5 = 0 THEN '20-F' ELSE '10-K/A' END || chr(10) || '<TEXT><html><style>p {{{{}}}}</style>'
  || CASE WHEN doc_id % 5 = 0 THEN '<p>Item 3.D. Risk Factors</p><p>' || {_BODY} || '</p><p>Item 4. Information on the Company</p>'
     ELSE '<p>Item 1A. Risk&nbsp;Factors 5</p><p>Item 1B. Unresolved Staff Comments 9</p><p>Item 1A. Risk Factors</p><p>' || {_BODY} || '</p><p>Item 1B. Unresolved Staff Comments</p><p>Item 7. Management&rsquo;s Discussion and Analysis</p><p>money</p><p>Item 8. Financial Statements</p>' END || '</html></TEXT></DOCUMENT>' AS submission FROM {{t}}"""


@query(f"""WITH x AS (SELECT doc_id, trim({_BODY}) AS body FROM documents) SELECT CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE 7000 + doc_id END::VARCHAR AS cik, make_date(2016, 3, (1 + doc_id % 28)::INT) AS filing_date, CASE WHEN doc_id % 5 = 0 THEN '20-F' ELSE '10-K' END AS filing_type,
  md5(body) AS item_1a_md5, length(body) AS item_1a_length, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'money' END AS item_7_text FROM x WHERE length(body) >= 5000 AND doc_id % 10 = 0""")
def p_filings(spark, sf_dir):
    """A file for each submission, in a folder called after its accession."""
    x = _made(spark, sf_dir, "documents", _SUBMISSION.replace("{{{{}}}}", "{{}}")).filter("doc_id % 10 = 0")
    path = new_table_path(spark, "probe-filings")
    x.select(F.regexp_extract("path", "[0-9]{10}-16-[0-9]{6}", 0).alias("accession"), "submission").repartition(4 * spark.sparkContext.defaultParallelism, "accession").write.partitionBy("accession").text(path)
    read = filings.read_submissions(spark, path).withColumn("ticker", F.lit("NKE")).withColumn("filing_type", F.when(F.col("submission").contains("<TYPE>20-F"), "20-F").otherwise("10-K"))
    out = filings.long_enough(filings.parse_filings(read))
    return out.select("cik", "filing_date", "filing_type", F.md5("item_1a_text").alias("item_1a_md5"), "item_1a_length", "item_7_text")


# Sinks and streams

_KEYED = "SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS k, CAST(max(o_orderkey) AS BIGINT) AS v FROM {t} GROUP BY 1"


@query(f"WITH x AS ({_KEYED.format(t='orders')}) SELECT k::VARCHAR AS k, v, v * 2 AS twice FROM x")
def p_append_new(spark, sf_dir):
    x, path = _made(spark, sf_dir, "orders", _KEYED), new_table_path(spark, "probe-append")
    twice = lambda df: df.withColumn("twice", F.col("v") * 2)
    for part in (x.filter("k % 2 = 0 OR k IS NULL"), x, x):
        tables.append_new(part, path, ["k"], twice)
    return spark.read.parquet(path).withColumn("k", F.col("k").cast("string"))


@query("SELECT lpad(n_nationkey::VARCHAR, 4, '0') AS code, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name END AS name, n_regionkey / 2.0 AS rate, DATE '2018-03-01' AS day FROM nation")
def p_seed(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 4, "0").alias("code"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("name"), (F.col("n_regionkey") / 2.0).alias("rate"), F.lit("2018-03-01").alias("day"))
    path = new_table_path(spark, "probe-seed")
    rows.write.csv(path, header=True)
    return tables.read_seed(spark, path, T.StructType([T.StructField("code", T.StringType()), T.StructField("name", T.StringType()), T.StructField("rate", T.DoubleType()), T.StructField("day", T.DateType())]))


def _events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """Events in four files, the later ones first, and a folder for a stream's results."""
    path = new_table_path(spark, "probe-events")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    rows.repartitionByRange(4, F.desc("event_id")).write.parquet(path)
    return incremental.read_files(spark, path, rows.schema, per_trigger=1), path


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def p_upsert_stream(spark, sf_dir):
    stream, path = _events(spark, sf_dir)
    incremental.upsert_stream(stream, f"{path}-table", ["user_id"], f"{path}-checkpoint", "event_id").awaitTermination()
    return spark.read.parquet(f"{path}-table").select("user_id", "event_id", "event_type", "value")


@query("SELECT event_id, upper(event_type) AS kind FROM events")
def p_append_stream(spark, sf_dir):
    stream, path = _events(spark, sf_dir)
    kind = lambda df: df.select("event_id", F.upper("event_type").alias("kind"))
    for _ in range(2):  # the second finds nothing new
        incremental.append_stream(stream.select("event_id", "event_type"), f"{path}-table", ["event_id"], f"{path}-checkpoint", kind).awaitTermination()
    return spark.read.parquet(f"{path}-table")


@query("SELECT least(100, count(*)) AS n, least(100, count(*)) AS n_distinct FROM orders")
def p_exact_sample(spark, sf_dir):
    return exact_sample(table(spark, sf_dir, "orders").select("o_orderkey"), 100, 3).agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("n_distinct"))


# Search: the ten questions of the corpus, seven of them about one company

_ASKED = [("the licensed token", "AAPL"), ("and the ing tion", "NKE"), ("de la que", "DE"), ("der zu und", "CAT"), ("thing that is", "WDC"), ("erthat of in", "TTM"), ("license version", "WMT"), ("the and of thing", None), ("la que de os", None), ("no such words xyzzy", None)]
_UNIT = lambda x: f"(SELECT list_transform(v, lambda c: (c / greatest(sqrt(list_sum(list_transform(v, lambda d: d * d))), 1e-300))::FLOAT::DOUBLE) FROM (SELECT [{', '.join(f'''(length({x}) - length(replace({x}, '{c}', '')))::DOUBLE''' for c in LetterCounts.SIGNS)}] AS v))"


def _search_sql() -> str:
    parts = []
    for k, (question, ticker) in enumerate(_ASKED):
        words = sorted({w for w in question.split() if len(w) > 1})
        qv = [float(x) for x in LetterCounts(True)([question])[0]]
        parts.append(f"""SELECT {k} AS question, d.doc_id, round(0.5 * coalesce(b.s, 0) / (coalesce(b.s, 0) + 5.0) + 0.5 * list_dot_product(d.v, {qv}::DOUBLE[]), 6) AS score FROM docs d
          LEFT JOIN (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_words / mean))) AS s FROM tf JOIN df USING (word) CROSS JOIN size WHERE word IN ({", ".join(map(_q, words))}) GROUP BY doc_id) b ON b.doc_id = d.doc_id
          WHERE {f"ticker = {_q(ticker)}" if ticker else "true"} QUALIFY row_number() OVER (ORDER BY score DESC, d.doc_id) <= 3""")
    tickers = _cases("doc_id % 7", [t for _, t in _ASKED[:7]])
    return f"""WITH w AS (SELECT doc_id, text, {tickers} AS ticker, list_filter(string_split(lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda x: length(x) > 1) AS words FROM documents WHERE doc_id % 3 = 0),
      docs AS MATERIALIZED (SELECT doc_id, ticker, len(words) AS n_words, {_UNIT("lower(text)")} AS v FROM w), size AS (SELECT count(*) AS n, avg(n_words) AS mean FROM docs),
      tf AS MATERIALIZED (SELECT doc_id, word, count(*) AS tf, any_value(n_words) AS n_words FROM (SELECT doc_id, len(words) AS n_words, unnest(words) AS word FROM w) GROUP BY doc_id, word), df AS MATERIALIZED (SELECT word, count(*) AS df FROM tf GROUP BY word)
      {" UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)}"""


@query(_search_sql())
def q_search_eq(spark, sf_dir):
    ship_code(spark)
    docs = table(spark, sf_dir, "documents").filter("doc_id % 3 = 0").select("doc_id", "text", F.expr(_cases("doc_id % 7", [t for _, t in _ASKED[:7]])).alias("ticker"))
    index = search.build_index(docs, "doc_id", "text", new_table_path(spark, "probe-index"), LetterCounts(True))
    found = None
    for k, (question, ticker) in enumerate(_ASKED):
        one = index.search(question, 3, ["doc_id"], {"ticker": ticker} if ticker else None).select(F.lit(k).alias("question"), "doc_id", F.round("score", 6).alias("score"))
        found = one if found is None else found.unionByName(one)
    return found


# Scenario as JSON, semantic queries without a metric, checks


@query(sql("SELECT hs_chapter, origin_country, total_shipments, round(scenario_landed_cost_usd, 4) AS scenario_landed_cost_usd, round(delta_usd, 4) AS delta_usd FROM (SELECT left(hs_6, 2) AS hs_chapter, origin_country_code AS origin_country, count(*) AS total_shipments, sum(estimated_landed_cost_usd + shipment_value_usd * CASE WHEN left(hs_6, 2) IN ('84', '85') AND origin_country_code = 'CN' THEN 0.25 ELSE 0 END) AS scenario_landed_cost_usd, sum(shipment_value_usd * CASE WHEN left(hs_6, 2) IN ('84', '85') AND origin_country_code = 'CN' THEN 0.25 ELSE 0 END)::DOUBLE AS delta_usd FROM fact WHERE shipment_value_usd IS NOT NULL AND consignee_key = (SELECT min(consignee_key) FROM dim_consignee WHERE consignee_name = 'NIKE, INC.') GROUP BY ALL)", "fact dim_consignee"))
def p_scenario_json(spark, sf_dir):
    t = world(spark, sf_dir)
    key = t["dim_consignee"].filter("consignee_name = 'NIKE, INC.'").agg(F.min("consignee_key")).first()[0]
    said = simulate_as_json(t["fact_shipments"], key or "", 25.0, "84, 85", " CN", "S301")
    rows = spark.createDataFrame([(said,)], "j string").select(F.explode(F.from_json("j", "struct<rows: array<struct<hs_chapter: string, origin_country: string, total_shipments: bigint, scenario_landed_cost_usd: double, delta_usd: double>>>").getField("rows")).alias("r"))
    return rows.select("r.hs_chapter", "r.origin_country", "r.total_shipments", F.round("r.scenario_landed_cost_usd", 4).alias("scenario_landed_cost_usd"), F.round("r.delta_usd", 4).alias("delta_usd"))


@query(sql("SELECT DISTINCT supplier_country_code, region FROM fact f LEFT JOIN dim_supplier s ON s.supplier_key = f.supplier_key LEFT JOIN dim_country o ON o.country_code = f.origin_country_code WHERE hs_6 LIKE '84%'", "fact dim_supplier dim_country"))
def p_semantic_dimensions(spark, sf_dir):
    w = world(spark, sf_dir)
    t = ChainMap({"fact_shipments": w["fact_shipments"].filter("hs_6 LIKE '84%'")}, w)
    return semantic.shipment_model().query(t, (), ["supplier country", "region"])


@query(" UNION ALL ".join(f"SELECT {_q(s.name)} AS scenario_name, {s.additional_rate_pp}::DOUBLE AS additional_rate_pp, {_q(','.join(s.hs_chapters))} AS chapters, {_q(','.join(s.origin_countries))} AS origins" for s in CANONICAL))
def p_scenarios(spark, sf_dir):
    from portolan.plans.scenario import scenario_frame

    return scenario_frame(spark).select("scenario_name", "additional_rate_pp", F.array_join("hs_chapters", ",").alias("chapters"), F.array_join("origin_countries", ",").alias("origins"))


_TOLD = ["top 5 consignees by landed cost", "Show Nike shipments from China", "Which suppliers are German and ship chapter 84?", "How concentrated are Walmart's suppliers?", "single-sourced consignees in chapter 87"]
_WHAT_IF = "What would happen if tariffs on China rise 10 points for Nike?"
_ANSWERED = f"""SELECT 0 AS question, consignee_name AS label, round(x, 2) AS value FROM (SELECT consignee_name, sum(estimated_landed_cost_usd) AS x FROM fact f LEFT JOIN dim_consignee c USING (consignee_key) GROUP BY ALL ORDER BY x DESC NULLS LAST, consignee_name LIMIT 5)
  UNION ALL SELECT 1, consignee_name, round(sum(estimated_landed_cost_usd), 2) FROM fact JOIN dim_consignee USING (consignee_key) WHERE contains(upper(consignee_name), 'NIKE') AND origin_country_code = 'CN' GROUP BY consignee_name
  UNION ALL SELECT * FROM (SELECT 2, supplier_name || '|' || supplier_country_code, count(*)::DOUBLE FROM fact JOIN dim_supplier USING (supplier_key) JOIN dim_hs_code USING (hs_6) WHERE hs_2 = '84' AND supplier_country_code = 'DE' GROUP BY supplier_name, supplier_country_code ORDER BY count(*) DESC, supplier_name LIMIT 10)
  UNION ALL SELECT * FROM (SELECT 3, consignee_name || '|' || hs_2, round(max(supplier_hhi), 2) FROM mart JOIN dim_consignee USING (consignee_key) LEFT JOIN dim_hs_code USING (hs_6) WHERE contains(upper(consignee_name), 'WALMART') GROUP BY consignee_name, hs_2 ORDER BY max(supplier_hhi) DESC NULLS LAST, consignee_name, hs_2 LIMIT 10)
  UNION ALL SELECT * FROM (SELECT 4, consignee_name || '|' || hs_6, round(max(supplier_hhi), 2) FROM mart JOIN dim_consignee USING (consignee_key) JOIN dim_hs_code USING (hs_6) WHERE hs_2 = '87' AND is_single_source GROUP BY consignee_name, hs_6 ORDER BY max(supplier_hhi) DESC NULLS LAST, consignee_name, hs_6 LIMIT 10)
  UNION ALL SELECT 5, 'scenario', round(sum(CASE WHEN origin_country_code = 'CN' THEN shipment_value_usd * 0.1 ELSE 0 END), 2) FROM fact WHERE consignee_key = (SELECT consignee_key FROM dim_consignee WHERE contains(upper(consignee_name), 'NIKE') ORDER BY total_shipments DESC NULLS LAST, consignee_key LIMIT 1)"""


def _labelled(k: int, asked: dict, answer: list[dict]) -> list[tuple[int, str | None, float | None]]:
    """(question, label, first figure) of an answer's rows; as with SQL's ||, a label of which one part is missing is null."""
    names = [d.rpartition(".")[2] for d in asked["dimensions"]]
    figures = [r[asked["metrics"][0]] for r in answer]
    labels = [None if any(r[n] is None for n in names) else "|".join(str(r[n]) for n in names) for r in answer]
    return [(k, label, None if x is None else float(x)) for label, x in zip(labels, figures)]


@query(sql(_ANSWERED, "fact mart dim_consignee dim_supplier dim_hs_code"))
def p_agent_answers(spark, sf_dir):
    """What the agent's tools give for six questions: the first figure of each row, and what the scenario adds up to."""
    a = agent.Agent(world(spark, sf_dir))
    rows = []
    for k, question in enumerate(_TOLD):
        (call,) = agent.plan_question(question)
        rows += _labelled(k, call["arguments"], a.call(call["tool_name"], call["arguments"]))
    said = [a.call(c["tool_name"], c["arguments"]) for c in agent.plan_question(_WHAT_IF)][-1]
    rows.append((len(_TOLD), "scenario", sum(r["delta_usd"] or 0.0 for r in said["rows"]) if said["rows"] else None))
    return spark.createDataFrame(rows, "question int, label string, value double").withColumn("value", F.round("value", 2))


#: The suite's tables in the world's SQL, with the columns that have other names there.
_TABLES: dict[str, tuple[str, dict[str, str]]] = {"silver_bol_shipments": ("silver", {}), "silver_bol_shipments_classified": ("coded", {}), "silver_bol_shipments_scoped": ("scoped", {}), "fact_shipments": ("fact", {}), "mart_concentration_metrics": ("mart", {}), "mart_scenario_examples": ("scenarios", {})}
_TABLES |= {t: (t, {}) for t in ("dim_supplier", "dim_consignee", "dim_hs_code", "dim_country", "dim_date", "tariff_events")}
for _n, _x in (("supplier", "shipper"), ("consignee", "consignee")):
    _TABLES |= {f"silver_{_n}_golden": (f"golden_{_n}", {f"golden_{_n}_id": "golden_id"}), f"int_{_n}_pair_scored": (f"scored_{_n}", {}), f"int_{_n}_name_normalized": (f"names_{_n}", {f"{_x}_name_norm": "norm"})}
_CHECKED = [c for c in checks.suite() if c.table in _TABLES and c.kind in ("unique", "not_null", "accepted", "related")]


def _check_sql(c: checks.Check) -> str:
    cte, names = _TABLES[c.table]
    col = names.get(c.column, c.column)
    if c.kind == "unique":
        body = f"SELECT {col} FROM {cte} WHERE {col} IS NOT NULL GROUP BY {col} HAVING count(*) > 1"
    elif c.kind == "not_null":
        body = f"SELECT 1 FROM {cte} WHERE {col} IS NULL"
    elif c.kind == "accepted":
        body = f"SELECT {col} FROM {cte} WHERE {col} IS NOT NULL AND {col} NOT IN ({', '.join(_q(v) if isinstance(v, str) else str(v).lower() for v in c.values)}) GROUP BY {col}"
    else:
        other, theirs = _TABLES[c.parent[0]]
        body = f"SELECT {col} FROM {cte} WHERE {col} IS NOT NULL AND {col} NOT IN (SELECT {theirs.get(c.parent[1], c.parent[1])} FROM {other})"
    return f"SELECT {_q(c.name)} AS check_name, {_q(c.severity)} AS severity, count(*) AS n_failed FROM ({body})"


@query(sql(" UNION ALL ".join(map(_check_sql, _CHECKED)), " ".join(dict.fromkeys([*[_TABLES[c.table][0] for c in _CHECKED], *[_TABLES[c.parent[0]][0] for c in _CHECKED if c.parent]]))))
def p_check_suite(spark, sf_dir):
    return checks.run_suite(world(spark, sf_dir), _CHECKED)


@query(sql("SELECT count(*) AS total_seed_rows, count(p6) AS matched_seed_rows, count(*) FILTER (c6 = p6) AS exact_hs6_matches, count(*) FILTER (left(c6, 4) = left(p6, 4)) AS hs4_matches, count(*) FILTER (left(c6, 2) = left(p6, 2)) AS hs2_matches FROM (SELECT DISTINCT x, c6, p6 FROM (SELECT DISTINCT text AS x, CASE WHEN identifier % 3 = 0 THEN '999999' ELSE '870899' END AS c6 FROM coded WHERE harmonized_number_final IS NULL AND text IS NOT NULL AND identifier % 5 = 0) s LEFT JOIN (SELECT DISTINCT text AS y, left(replace(hs_code_unified, '.', ''), 6) AS p6 FROM coded) k ON x = y)", "coded"))
def p_classifier_accuracy(spark, sf_dir):
    ships = world(spark, sf_dir)["silver_bol_shipments_classified"]
    seed = ships.filter("harmonized_number_final IS NULL AND text IS NOT NULL AND identifier % 5 = 0").select(F.col("text").alias("product_text"), F.when(F.col("identifier") % 3 == 0, "999999").otherwise("870899").alias("correct_hs_6")).distinct()
    return classify.classifier_accuracy(seed, ships).select("total_seed_rows", "matched_seed_rows", "exact_hs6_matches", "hs4_matches", "hs2_matches")
