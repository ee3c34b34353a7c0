"""The full pipeline over shipments made from the driver's tables, and SQL that says each of its stages.

``RAW`` is written in what Spark and DuckDB have in common and only prepares
the input. From there on Spark runs the library's stages, and DuckDB the SQL
in ``CTES``, which owes nothing to them but the rules' word lists.
"""

from __future__ import annotations

import re
from collections import ChainMap
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.functions import country, hs, text
from portolan.functions.vector import LetterCounts
from portolan.plans import classify, entities, gold, profile, scenario, semantic, serving
from portolan.plans.queries import query, table
from portolan.plans.registry import full_registry
from portolan.session import new_table_path, ship_code
from portolan.sources.tables import exists, load_summary

SOURCES = ("lineitem", "orders", "customer", "supplier", "part", "nation", "documents", "events")


def _cases(x: str, values: list[str | None]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None) + " END"


_PORTS = ["Hamburg,Germany", "Antwerp,Belgium", "Haiphong,Vietnam", "Valencia,Spain", "Felixstowe,England", "Le Havre,France", "Veracruz,Mexico", "Ningbo,China", "Busan,South Korea", "Port of Spain,Trinidad", None]
_PLACES = ["HAMBURG, GERMANY", "NO 5, SHENZHEN, CHINA", "1 MAIN ST, ATLANTA GA 30301", "12 HIGH ST, LONDON, ENGLAND", "NOWHERE", "MADE IN CHINA", "COLONIA ROMA 06700", "BOSTON US", None]
_CODE = "(" + _cases("p_partkey % 9", ["39", "61", "62", "73", "84", "87", "72", "98", "85"]) + " || lpad(CAST(p_partkey % 23 AS STRING), 4, '0'))"
_GROUP = lambda k: f"CAST(floor({k} / 3) AS BIGINT)"
_NAME = lambda k: f"upper(substr(md5(CAST({_GROUP(k)} AS STRING)), 1, 6))"

RAW = {
    "bol_shipments": f"""SELECT CASE WHEN l_orderkey % 97 = 0 THEN 1000000 WHEN l_orderkey % 101 = 0 THEN NULL ELSE 2018000000001 + l_orderkey * 10 END AS identifier,
      make_date(CAST(year(l_shipdate) + 20 AS INT), CAST(month(l_shipdate) AS INT), CAST(day(l_shipdate) AS INT)) AS trade_update_date, CASE WHEN l_orderkey % 89 = 0 THEN ' ' ELSE 'MSCU' || lpad(CAST(l_orderkey * 7 % 1000000 * 10 + l_linenumber % 3 AS STRING), 7, '0') END AS container_number,
      {_cases("c_nationkey % 11", _PORTS)} AS foreign_port_of_lading,
      CASE WHEN l_orderkey % 103 = 0 THEN NULL WHEN c_custkey % 50 = 0 THEN 'TO ORDER' WHEN c_custkey % 41 = 0 THEN 'DHL GLOBAL FORWARDING' WHEN c_custkey % 111 = 5 THEN 'NIKE, INC.' WHEN c_custkey % 111 = 43 THEN 'APPLE INC' WHEN c_custkey % 111 = 79 THEN 'WALMART CANADA CORP'
        ELSE {_NAME("c_custkey")} || CASE c_custkey % 3 WHEN 0 THEN ' TRADING GMBH' WHEN 1 THEN ' TRADINGS, INC.' ELSE ' TRADE CO' END || CASE WHEN o_orderkey % 4 = 0 THEN ' LTD' ELSE '' END END AS consignee_name,
      CASE WHEN o_orderkey % 7 = 0 THEN 'PARIS, FRANCE' ELSE {_cases(f"{_GROUP('c_custkey')} % 9", _PLACES)} END AS consignee_address,
      CASE WHEN s_suppkey % 29 = 0 THEN 'K LINE' ELSE {_NAME("(s_suppkey + 7002)")} || CASE s_suppkey % 3 WHEN 0 THEN ' WORKS AG' WHEN 1 THEN ' WORKS S.A.' ELSE ' WORKERS' END END AS shipper_party_name,
      {_cases(f"{_GROUP('s_suppkey')} % 9", _PLACES)} AS shipper_address, CAST(l_linenumber AS BIGINT) AS description_sequence_number, CAST(floor(l_quantity) AS BIGINT) AS piece_count,
      CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN p_name || ' HS CODE: ' || {_CODE} WHEN 2 THEN p_name || ' PO# 12345' ELSE p_name || ' STYLE: AB-12 ' || p_type || ' 40 KGS' END AS text,
      CASE l_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE {_CODE} END AS harmonized_number, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(floor(l_extendedprice) AS BIGINT) END AS harmonized_value,
      CAST(floor(l_quantity) AS BIGINT) AS harmonized_weight, {_cases("l_linenumber % 3", ["Pounds", "Kilograms", None])} AS harmonized_weight_unit, CAST(NULL AS STRING) AS identified_orgs, l_orderkey AS ingested_at
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""",
    "hts_tariff_schedule": f"""SELECT substr({_CODE}, 1, 4) || '.' || substr({_CODE}, 5, 2) || CASE WHEN p_partkey % 3 = 0 THEN '.00' ELSE '' END AS hts_number, CASE WHEN p_partkey % 13 = 0 THEN '  ' ELSE p_name END AS description,
      CAST(p_size % 4 AS BIGINT) AS indent, {_cases("p_size % 6", ["Free", "3.4%", " 12% ", "1.5c/kg", "", "2.5% + 3c"])} AS general_rate_text, CASE WHEN p_size % 9 = 0 THEN 'See 9903.88.15' END AS footnotes,
      substr({_CODE}, 1, 2) AS hs2, substr({_CODE}, 1, 4) AS hs4, CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE {_CODE} END AS hs6, p_partkey AS ingested_at FROM part""",
    "sec_10k_filings": f"""SELECT lpad(CAST(doc_id % 500 AS STRING), 10, '0') AS cik, {_cases("doc_id % 25", [t for t, _ in gold.company_rows()])} AS ticker,
      make_date(CAST(2015 + doc_id % 8 AS INT), CAST(1 + doc_id % 12 AS INT), CAST(1 + doc_id % 28 AS INT)) AS filing_date, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE text END AS item_1a_text, CAST(n_chars AS BIGINT) AS item_1a_length,
      CASE doc_id % 3 WHEN 0 THEN '20-F' WHEN 1 THEN '10-K' END AS filing_type, doc_id AS ingested_at FROM documents""",
    "tariff_events": """SELECT make_date(2018, CAST(1 + n_nationkey % 12 AS INT), 1) AS event_date, CASE n_nationkey % 3 WHEN 0 THEN 'section_232' WHEN 1 THEN 'section_301' ELSE 'other' END AS event_type, 'chapter ' || CAST(70 + n_nationkey % 5 AS STRING) AS hs_scope,
      n_name AS country_scope, CAST(n_nationkey % 4 * 2.5 AS DOUBLE) AS rate_change_pp, 'event' AS description, CAST(NULL AS STRING) AS source_url FROM nation""",
    "agent_traces": """SELECT CAST(event_id AS STRING) AS trace_id, event_id AS timestamp, event_type AS question, CAST(floor(value * 100) AS BIGINT) AS total_latency_ms, CAST(user_id AS DOUBLE) AS cost_credits_estimate,
      CASE event_id % 4 WHEN 0 THEN '[{"tool_name": "a", "arguments": {}}, {"tool_name": "b"}]' WHEN 1 THEN '[{"tool_name": "' || event_type || '"}]' WHEN 2 THEN '[]' END AS tool_calls FROM events""",
}

_WORLDS: dict[tuple[str, str], tuple[str, Mapping[str, DataFrame]]] = {}


def _made_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)


def world(spark: SparkSession, sf_dir: str) -> Mapping[str, DataFrame]:
    """Raw tables and the tables of all stages, each built when a query first asks for it, once for each session and folder of tables, and again should their own folder be gone."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WORLDS or not exists(spark, _WORLDS[key][0]):
        ship_code(spark)
        for name in SOURCES:
            table(spark, sf_dir, name).createOrReplaceTempView(f"world_{name}")
        named = lambda s: re.sub(rf"\b(FROM|JOIN) ({'|'.join(SOURCES)})\b", r"\1 world_\2", s)
        raw = {name: spark.sql(named(s)) for name, s in RAW.items()}
        root = new_table_path(spark, "world")
        _made_folder(spark, root)
        _WORLDS[key] = root, full_registry(embedder=LetterCounts()).on_demand(raw, root)
    return _WORLDS[key][1]


# The stages in SQL: {name: (what it needs, SELECT)}

CTES: dict[str, tuple[str, str]] = {name: ("", s) for name, s in RAW.items()}


def sql(target: str, needs: str) -> str:
    """``target`` after the stages that it needs."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for n in CTES[name][0].split():
                visit(n)
            order.append(name)

    for n in needs.split():
        visit(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {'' if n in ('reach_supplier', 'reach_consignee') else 'MATERIALIZED '}({CTES[n][1]})" for n in order) + f"\nSELECT * FROM ({target})"


_q = lambda s: "'" + s.replace("'", "''") + "'"


def _has(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {_q(w)})" for w in words) + ")"


def _norm_sql(x: str) -> str:
    forms = "|".join(text.LEGAL_FORMS)
    for p, to in ((r",\s+", " "), (rf"(?i)\b(?:{forms})\b", ""), (r"(?i)[^a-z0-9 ]", ""), (r"\s+", " "), (r"(?i)^\s+|\s+$|^the ", "")):
        x = f"regexp_replace({x}, {_q(p)}, '{to}', 'g')"
    return f"trim(lower({x}))"


def product_sql(x: str) -> str:
    out = f"upper({x})"
    for p in text.PRODUCT_NOISE:
        out = f"regexp_replace({out}, '(?i){p}', '', 'g')"
    return f"trim(regexp_replace(regexp_replace({out}, '(?i)[^A-Z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _country_sql(x: str) -> str:
    u = f"upper({x})"
    named = " ".join(f"WHEN {_has(u, have)}{f' AND NOT {_has(u, lack)}' if lack else ''} THEN '{code}'" for code, have, lack in country.NAMES)
    coded = " ".join(f"WHEN regexp_full_match({u}, {_q(rf'.*[\s,]{code}[\s,][-0-9 ]{{0,15}}')}) THEN '{code}'" for code in country.END_CODES)
    full = lambda p: f"regexp_full_match({u}, {_q(p)})"
    zip_code = r".*[\s,][0-9]{5}(?:-[0-9]{4})?\s*"
    us = f"{full(r'(?:.*[\s,.])?USA?\s*')} OR {full(r'.*UNITED\s+STATES\s*')} OR {_has(u, (' US ', ' US,', ' USA ', ' USA,', 'U.S.A', 'UNITED STATES '))} OR {full(country.STATE_ZIP)} OR ({full(zip_code)} AND NOT {_has(u, country.FOREIGN)})"
    return f"coalesce(CASE {named} END, CASE {coded} END, CASE WHEN {us} THEN 'US' END)"


def _port_sql(x: str) -> str:
    u, words = f"upper({x})", {c: have for c, have, _ in country.NAMES}
    return "CASE " + " ".join(f"WHEN {_has(u, words[c])}{' AND NOT ' + _has(u, ('PORT OF SPAIN', 'TRINIDAD')) if c == 'ES' else ''} THEN '{c}'" for c in ("DE", "BE", "VN", "ES", "GB", "FR", "MX", "CN")) + " END"


_NAMES_CODE = r"(?i).*HS[ -]?CODE:?\s*\d{4}\.?\d{2}.*"
_BOL = "trade_update_date container_number foreign_port_of_lading consignee_name consignee_address shipper_party_name shipper_address description_sequence_number piece_count text harmonized_number harmonized_value harmonized_weight harmonized_weight_unit identified_orgs ingested_at".split()
_LATEST = lambda by, rest: f"{by} DESC NULLS FIRST, " + ", ".join(f"{c} NULLS LAST" for c in rest)
_RATE = r"CASE WHEN trim(general_rate_text) = 'Free' THEN 0.0::DOUBLE WHEN regexp_full_match(trim(general_rate_text), '[0-9]+(\.[0-9]+)?%') THEN replace(trim(general_rate_text), '%', '')::DOUBLE / 100.0 END"
CTES |= {
    "bronze_bol": ("bol_shipments", f"""SELECT *, CASE WHEN harmonized_number <> '' THEN harmonized_number WHEN regexp_full_match(text, {_q(_NAMES_CODE)}) THEN nullif(regexp_extract(text, '\\d{{4}}\\.?\\d{{2}}'), '') END AS harmonized_number_final,
      CASE WHEN harmonized_number <> '' THEN 'source_field' WHEN regexp_full_match(text, {_q(_NAMES_CODE)}) THEN 'regex_from_text' END AS hs_source
      FROM bol_shipments WHERE identifier IS NOT NULL AND identifier <> 0 AND NOT regexp_full_match(identifier::VARCHAR, '[1-9]\\d{{0,5}}0{{6,}}') AND trim(container_number) <> ''
      QUALIFY row_number() OVER (PARTITION BY identifier, container_number ORDER BY {_LATEST("trade_update_date", [c for c in _BOL if c not in ("trade_update_date", "container_number")])}) = 1"""),
    "bronze_hts": ("hts_tariff_schedule", f"""SELECT *, {_RATE} AS ad_valorem_rate, CASE WHEN trim(general_rate_text) NOT IN ('', 'Free') AND NOT regexp_full_match(trim(general_rate_text), '[0-9]+(\\.[0-9]+)?%') THEN general_rate_text END AS specific_rate_raw
      FROM hts_tariff_schedule QUALIFY row_number() OVER (PARTITION BY hts_number ORDER BY ingested_at DESC NULLS FIRST) = 1"""),
    "bronze_10k": ("sec_10k_filings", """SELECT * REPLACE (coalesce(filing_type, '10-K') AS filing_type), item_1a_length >= 5000 AS is_supply_chain_relevant FROM sec_10k_filings QUALIFY row_number() OVER (PARTITION BY cik, filing_date ORDER BY ingested_at DESC NULLS FIRST) = 1"""),
}
_COUNTS = lambda x: "[" + ", ".join(f"(length({x}) - length(replace({x}, '{c}', '')))::DOUBLE" for c in LetterCounts.SIGNS) + "]"
for _p in entities.PARTIES.values():
    _n, _x = _p.name, _p.prefix
    _combo = ["address", "port"] if _p.with_port else ["address"]
    CTES |= {
        f"names_{_n}": ("bronze_bol", f"""WITH r AS (SELECT {_p.raw_name} AS raw, {_p.raw_address} AS address, foreign_port_of_lading AS port FROM bronze_bol WHERE {_p.raw_name} IS NOT NULL), c AS (SELECT raw, {", ".join(_combo)}, count(*) AS n FROM r GROUP BY ALL),
          t AS (SELECT raw, count(*) AS shipment_count FROM r GROUP BY raw), b AS (SELECT raw, address FROM c QUALIFY row_number() OVER (PARTITION BY raw ORDER BY n DESC, {", ".join(k + " NULLS LAST" for k in _combo)}) = 1),
          n AS (SELECT raw, {_norm_sql("raw")} AS norm, address, {_country_sql("address")} AS country, shipment_count FROM t JOIN b USING (raw))
          SELECT *, {_has("upper(raw)", text.FORWARDERS)} AS is_forwarder, ({_has("upper(norm)", text.PLACEHOLDERS)} OR upper(norm) IN ('NA', 'N/A') OR length(trim(norm)) < 3) AS is_placeholder, left(norm, 8) || '|' || coalesce(country, 'UNK') AS blocking_key FROM n"""),
        f"scored_{_n}": (f"names_{_n}", f"""WITH d AS (SELECT DISTINCT blocking_key, norm, country FROM names_{_n}), p AS (SELECT a.norm AS name_a, b.norm AS name_b, a.country AS country_a, b.country AS country_b, a.blocking_key, abs(length(a.norm) - length(b.norm)) AS length_diff
          FROM d a JOIN d b ON a.blocking_key = b.blocking_key AND a.norm < b.norm AND abs(length(a.norm) - length(b.norm)) < 20 WHERE length(a.norm) >= 3 AND length(b.norm) >= 3),
          s AS (SELECT *, list_cosine_similarity({_COUNTS("name_a")}, {_COUNTS("name_b")}) AS embed_sim, 1 - levenshtein(name_a, name_b)::DOUBLE / greatest(length(name_a), length(name_b)) AS char_sim FROM p)
          SELECT *, 0.7 * embed_sim + 0.3 * char_sim AS match_score, CASE WHEN 0.7 * embed_sim + 0.3 * char_sim >= 0.92 THEN 'match' WHEN 0.7 * embed_sim + 0.3 * char_sim >= 0.80 THEN 'review' ELSE 'no_match' END AS match_label FROM s"""),
        f"links_{_n}": (f"scored_{_n}", f"SELECT name_a AS a, name_b AS b FROM scored_{_n} WHERE match_label = 'match' UNION SELECT name_b, name_a FROM scored_{_n} WHERE match_label = 'match'"),
        f"reach_{_n}": (f"links_{_n}", f"SELECT a AS node, a AS label FROM links_{_n} UNION SELECT l.b, r.label FROM reach_{_n} r JOIN links_{_n} l ON l.a = r.node"),
        f"map_{_n}": (f"names_{_n} reach_{_n}", f"""WITH c AS (SELECT node, min(label) AS component FROM reach_{_n} GROUP BY node), m AS (SELECT *, coalesce(component, norm) AS cluster_key FROM names_{_n} LEFT JOIN c ON node = norm),
          v AS (SELECT cluster_key, country FROM (SELECT cluster_key, country, sum(shipment_count) AS n FROM m GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY cluster_key ORDER BY n DESC, country NULLS LAST) = 1),
          h AS (SELECT cluster_key, raw AS canonical_name, address AS sample_address FROM m QUALIFY row_number() OVER (PARTITION BY cluster_key ORDER BY shipment_count DESC, raw) = 1)
          SELECT raw, norm, cluster_key, md5(canonical_name || '|' || coalesce(v.country, 'UNK')) AS golden_id, canonical_name, v.country AS country, sample_address, is_forwarder, is_placeholder, shipment_count FROM m JOIN v USING (cluster_key) JOIN h USING (cluster_key)"""),
        f"golden_{_n}": (f"map_{_n}", f"SELECT golden_id, canonical_name, country, count(DISTINCT raw) AS raw_name_variants_count, sum(shipment_count)::BIGINT AS total_shipments, min(sample_address) AS sample_address FROM map_{_n} GROUP BY golden_id, canonical_name, country"),
        f"dim_{_n}": (f"golden_{_n}", f"SELECT golden_id AS {_n}_key, canonical_name AS {_n}_name, country AS {_n}_country_code, raw_name_variants_count, total_shipments, {_has('upper(canonical_name)', text.FORWARDERS)} AS is_forwarder, sample_address FROM golden_{_n}"),
    }
_CHAPTERS = ", ".join(_q(c) for c in classify.CHAPTERS)
_add = lambda rates, x: "CASE " + " ".join(f"WHEN {x} = '{k}' THEN {v}::DOUBLE" for k, v in rates.items()) + " ELSE 0.0 END"
_SHORTEST = lambda k: f"(SELECT {k} AS k, description AS d FROM bronze_hts WHERE {k} IS NOT NULL AND trim(description) <> '' QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY length(description), hts_number NULLS LAST, description) = 1)"
CTES |= {
    "silver": ("bronze_bol map_supplier map_consignee", f"""SELECT b.*, left(harmonized_number_final, 2) AS hs_chapter, {_port_sql("foreign_port_of_lading")} AS shipment_origin_country, s.golden_id AS golden_supplier_id, s.canonical_name AS supplier_canonical_name, s.country AS supplier_registered_country,
      c.golden_id AS golden_consignee_id, c.canonical_name AS consignee_canonical_name, c.country AS consignee_registered_country, CASE WHEN c.is_forwarder THEN 'freight_forwarder' ELSE 'importer' END AS consignee_party_type
      FROM bronze_bol b JOIN map_supplier s ON s.raw = b.shipper_party_name JOIN map_consignee c ON c.raw = b.consignee_name WHERE {_port_sql("foreign_port_of_lading")} IS NOT NULL"""),
    "texts": ("silver", f"WITH t AS (SELECT {product_sql('text')} AS f FROM silver WHERE harmonized_number_final IS NULL AND text IS NOT NULL) SELECT left(f, 200) AS product_text, min(f) AS normalized_text_full FROM t WHERE length(f) >= 5 GROUP BY ALL"),
    "codes": ("bronze_hts", "SELECT hs6, min(hs4) AS hs4, min(hs2) AS hs2, min(description) AS description FROM bronze_hts WHERE hs6 IS NOT NULL AND description IS NOT NULL AND hs2 NOT IN ('98', '99') GROUP BY hs6"),
    "candidates": ("texts codes", f"""WITH t AS (SELECT product_text, {_COUNTS("lower(product_text)")} AS v FROM texts), c AS (SELECT *, {_COUNTS("lower(description)")} AS w FROM codes),
      s AS (SELECT product_text, hs6, hs4, hs2, description, coalesce(list_cosine_similarity(v, w), 0) AS sim FROM t CROSS JOIN c WHERE true)
      SELECT *, row_number() OVER (PARTITION BY product_text ORDER BY round(CASE WHEN isnan(sim) THEN 0 ELSE sim END, 9) DESC, hs6) AS rank FROM s QUALIFY rank <= 5"""),
    "answers": ("candidates", r"""WITH a AS (SELECT product_text, coalesce(nullif(replace(regexp_extract(product_text, '\bHS[ :]*(\d{4}\.?\d{2})\b', 1), '.', ''), ''), CASE WHEN round(sim, 2) >= 0.45 THEN hs6 ELSE '999999' END) AS raw_response FROM candidates WHERE rank = 1)
      SELECT product_text, raw_response, raw_response AS predicted_hs_6, CASE WHEN raw_response = '999999' THEN 'unclassifiable' ELSE 'classified_hs6' END AS classification_status FROM a"""),
    "coded": ("silver answers", f"""WITH j AS (SELECT s.*, raw_response, predicted_hs_6, classification_status, coalesce(harmonized_number_final, predicted_hs_6) AS hs_code_unified FROM silver s LEFT JOIN answers ON product_text = left({product_sql("text")}, 200))
      SELECT *, CASE WHEN harmonized_number_final IS NOT NULL THEN hs_source WHEN classification_status = 'unclassifiable' THEN 'llm_unclassifiable' WHEN classification_status IS NOT NULL THEN 'llm_classified_hs6' ELSE 'unresolved' END AS hs_source_final, left(hs_code_unified, 4) AS hs_4_final, left(hs_code_unified, 2) AS hs_2_final FROM j"""),
    "scoped": ("coded", f"SELECT * FROM coded WHERE hs_2_final IN ({_CHAPTERS}) AND hs_code_unified IS NOT NULL AND hs_source_final <> 'llm_unclassifiable'"),
    "dim_hs_code": ("bronze_hts", f"""WITH r AS (SELECT hs6, hs4, hs2, avg(ad_valorem_rate) * 100 AS general_duty_rate_pct FROM bronze_hts WHERE hs6 IS NOT NULL GROUP BY ALL)
      SELECT hs6 AS hs_6, a.d AS hs_6_description, hs4 AS hs_4, b.d AS hs_4_description, hs2 AS hs_2, c.d AS hs_2_description, general_duty_rate_pct, {_add(hs.SECTION_232, "hs2")} AS section_232_rate_pct, {_add(hs.SECTION_301, "hs2")} AS section_301_rate_pct
      FROM r LEFT JOIN {_SHORTEST("hs6")} a ON a.k = hs6 LEFT JOIN {_SHORTEST("hs4")} b ON b.k = hs4 LEFT JOIN {_SHORTEST("hs2")} c ON c.k = hs2"""),
    "dim_country": ("", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(_q(v) if isinstance(v, str) else "NULL" if v is None else str(v).lower() for v in r) + ")" for r in gold.country_rows()) + ") t(country_code, country_name, region, is_section_232_target, is_section_301_target, notes)"),
    "dim_date": ("", "SELECT d AS date_key, d AS date_day, year(d) AS year, month(d) AS month FROM (SELECT unnest(range(DATE '2013-01-01', DATE '2027-01-01', INTERVAL 1 DAY))::DATE AS d)"),
    "fact": ("scoped dim_hs_code dim_country", """WITH j AS (SELECT s.*, left(replace(hs_code_unified, '.', ''), 6) AS hs_6 FROM scoped s), d AS (SELECT j.*, general_duty_rate_pct, section_232_rate_pct, section_301_rate_pct,
        coalesce(general_duty_rate_pct, 0) + CASE WHEN is_section_232_target THEN coalesce(section_232_rate_pct, 0) ELSE 0 END + CASE WHEN is_section_301_target THEN coalesce(section_301_rate_pct, 0) ELSE 0 END AS duty FROM j LEFT JOIN dim_hs_code h ON h.hs_6 = j.hs_6 LEFT JOIN dim_country c ON c.country_code = shipment_origin_country)
      SELECT md5(identifier::VARCHAR || '|' || container_number) AS shipment_key, identifier AS bol_identifier, container_number, trade_update_date AS date_key, golden_supplier_id AS supplier_key, golden_consignee_id AS consignee_key, hs_6, shipment_origin_country AS origin_country_code,
        CASE WHEN upper(harmonized_weight_unit) = 'POUNDS' THEN harmonized_weight * 0.453592 ELSE harmonized_weight::DOUBLE END AS weight_kg, harmonized_value AS shipment_value_usd, piece_count, hs_source_final, consignee_party_type, general_duty_rate_pct, section_232_rate_pct, section_301_rate_pct,
        duty AS effective_duty_rate_pct, harmonized_value * (1 + duty / 100.0) AS estimated_landed_cost_usd FROM d"""),
    "mart": ("fact", """WITH b AS (SELECT consignee_key, hs_6, supplier_key, origin_country_code, count(*) AS n, sum(weight_kg) AS w, sum(estimated_landed_cost_usd) AS c FROM fact GROUP BY ALL),
      t AS (SELECT consignee_key, hs_6, sum(n) AS total, sum(w) AS w, sum(c) AS c, count(DISTINCT supplier_key) AS sc, count(DISTINCT origin_country_code) AS cc FROM b GROUP BY ALL),
      s AS (SELECT consignee_key, hs_6, sum(pow(n::DOUBLE / total, 2)) AS hhi, max(n::DOUBLE / total) AS top FROM b JOIN t USING (consignee_key, hs_6) GROUP BY ALL),
      k AS (SELECT consignee_key, hs_6, sum(pow(sh, 2)) AS hhi, max(sh) AS top FROM (SELECT consignee_key, hs_6, origin_country_code, sum(n)::DOUBLE / max(total) AS sh FROM b JOIN t USING (consignee_key, hs_6) GROUP BY ALL) GROUP BY ALL)
      SELECT consignee_key, hs_6, sc AS supplier_count, cc AS country_count, total::BIGINT AS total_shipment_count, t.w AS total_weight_kg, t.c AS total_landed_cost_usd, s.hhi AS supplier_hhi, s.top AS top_supplier_share, k.hhi AS country_hhi, k.top AS top_country_share, s.top > 0.7 AS is_single_source, k.top > 0.7 AS is_single_country
      FROM t JOIN s USING (consignee_key, hs_6) JOIN k USING (consignee_key, hs_6)"""),
    "scenarios": ("fact dim_consignee", """WITH top AS (SELECT consignee_key, consignee_name FROM dim_consignee ORDER BY total_shipments DESC NULLS LAST, consignee_key LIMIT 20),
      g AS (SELECT consignee_key, consignee_name, left(hs_6, 2) AS hs_chapter, origin_country_code AS origin_country, count(*) AS total_shipments, avg(effective_duty_rate_pct) AS rate, sum(shipment_value_usd)::DOUBLE AS value, sum(estimated_landed_cost_usd) AS landed FROM fact JOIN top USING (consignee_key) WHERE shipment_value_usd IS NOT NULL GROUP BY ALL),
      s(scenario_name, pp, chapters, origins) AS (VALUES """ + ", ".join(f"({_q(s.name)}, {s.additional_rate_pp}::DOUBLE, {list(s.hs_chapters)}::VARCHAR[], {list(s.origin_countries)}::VARCHAR[])" for s in scenario.CANONICAL) + """),
      x AS (SELECT *, CASE WHEN (len(chapters) = 0 OR list_contains(chapters, hs_chapter)) AND (len(origins) = 0 OR list_contains(origins, origin_country)) THEN pp ELSE 0 END AS inc FROM g CROSS JOIN s)
      SELECT consignee_key, consignee_name, scenario_name, hs_chapter, origin_country, total_shipments, rate AS baseline_duty_rate_pct, rate + inc AS scenario_duty_rate_pct, value AS baseline_value_usd, landed AS baseline_landed_cost_usd, landed + value * inc / 100.0 AS scenario_landed_cost_usd,
        value * inc / 100.0 AS delta_usd, value * inc / 100.0 / landed * 100.0 AS delta_pct FROM x WHERE value * inc / 100.0 > 0"""),
}


def _rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Figures that are sums or quotients of doubles, cut to what doesn't depend on the order of addition."""
    return df.withColumns({c: F.round(c, places) for c, kind in df.dtypes if kind == "double"})


def _rounded_sql(select: str, columns: str, places: int = 4) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c}, {places}) AS {c}' for c in columns.split())}) FROM ({select})"


def _stage(name: str, select: str, needs: str, columns: str, doubles: str = "", rename: dict[str, str] | None = None, places: int = 4) -> None:
    """A query for the table of one stage: ``columns`` of it, against ``select``, where ``rename`` maps the SQL's names to the library's."""
    names = rename or {}
    inner = f"SELECT {', '.join(f'{names[c]} AS {c}' if c in names else c for c in columns.split())} FROM {select}".replace("shipment_value_usd", "shipment_value_usd::DOUBLE AS shipment_value_usd")
    text_sql = sql(_rounded_sql(inner, doubles, places) if doubles else inner, needs)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(world(spark, sf_dir)[name].select(*[F.col(c).cast("double") if c == "shipment_value_usd" else c for c in columns.split()]), places)

    run.__name__ = f"w_{name}"
    query(text_sql)(run)


_stage("bronze_bol", "bronze_bol", "bronze_bol", "identifier container_number trade_update_date text harmonized_number_final hs_source ingested_at")
_stage("bronze_hts", "bronze_hts", "bronze_hts", "hts_number description hs6 general_rate_text ad_valorem_rate specific_rate_raw ingested_at", "ad_valorem_rate")
_stage("bronze_10k", "bronze_10k", "bronze_10k", "cik ticker filing_date filing_type item_1a_length is_supply_chain_relevant ingested_at")
for _p in entities.PARTIES.values():
    _n, _x = _p.name, _p.prefix
    _raw = {f"{_x}_name_raw": "raw", f"{_x}_name_norm": "norm", f"{_x}_address": "address", f"{_x}_registered_country": "country", f"golden_{_n}_id": "golden_id"}
    _stage(f"int_{_n}_name_normalized", f"names_{_n}", f"names_{_n}", f"{_x}_name_raw {_x}_name_norm {_x}_address {_x}_registered_country is_forwarder is_placeholder blocking_key shipment_count", rename=_raw)
    _stage(f"int_{_n}_pair_scored", f"scored_{_n}", f"scored_{_n}", "name_a name_b country_a country_b blocking_key embed_sim char_sim match_score match_label", "embed_sim char_sim match_score", places=6)
    _stage(f"int_{_n}_golden_map", f"map_{_n}", f"map_{_n}", f"{_x}_name_raw {_x}_name_norm cluster_key golden_{_n}_id canonical_name country sample_address is_forwarder is_placeholder shipment_count", rename=_raw)
    _stage(f"silver_{_n}_golden", f"golden_{_n}", f"golden_{_n}", f"golden_{_n}_id canonical_name country raw_name_variants_count total_shipments sample_address", rename=_raw)
    _stage(f"dim_{_n}", f"dim_{_n}", f"dim_{_n}", f"{_n}_key {_n}_name {_n}_country_code raw_name_variants_count total_shipments is_forwarder sample_address")
_stage("silver_bol_shipments", "silver", "silver", "identifier container_number shipment_origin_country harmonized_number_final hs_chapter golden_supplier_id supplier_canonical_name supplier_registered_country golden_consignee_id consignee_canonical_name consignee_registered_country consignee_party_type")
_stage("int_product_text_universe", "texts", "texts", "product_text normalized_text_full")
_stage("int_hts_embedded", "codes", "codes", "hs6 hs4 hs2 description")
_stage("int_hs_candidates", "candidates", "candidates", "product_text hs6 hs4 hs2 hts_description sim rank", "sim", {"hts_description": "description", "rank": "rank::INT"}, 6)
_stage("int_hs_classified", "answers", "answers", "product_text raw_response predicted_hs_6 classification_status")
_stage("silver_bol_shipments_classified", "coded", "coded", "identifier container_number hs_code_unified hs_source_final hs_4_final hs_2_final llm_raw_response classification_status", rename={"llm_raw_response": "raw_response"})
_stage("silver_bol_shipments_scoped", "scoped", "scoped", "identifier container_number hs_code_unified hs_source_final hs_2_final golden_supplier_id golden_consignee_id")
_stage("dim_country", "dim_country", "dim_country", "country_code country_name region is_section_232_target is_section_301_target notes")
_stage("dim_hs_code", "dim_hs_code", "dim_hs_code", "hs_6 hs_6_description hs_4 hs_4_description hs_2 hs_2_description general_duty_rate_pct section_232_rate_pct section_301_rate_pct", "general_duty_rate_pct section_232_rate_pct section_301_rate_pct")
_FACT = "weight_kg general_duty_rate_pct section_232_rate_pct section_301_rate_pct effective_duty_rate_pct estimated_landed_cost_usd"
_stage("fact_shipments", "fact", "fact", f"shipment_key bol_identifier container_number date_key supplier_key consignee_key hs_6 origin_country_code shipment_value_usd piece_count hs_source_final consignee_party_type {_FACT}", _FACT)
_MART = "total_weight_kg total_landed_cost_usd supplier_hhi top_supplier_share country_hhi top_country_share"
_stage("mart_concentration_metrics", "mart", "mart", f"consignee_key hs_6 supplier_count country_count total_shipment_count is_single_source is_single_country {_MART}", _MART)
_SCEN = "baseline_duty_rate_pct scenario_duty_rate_pct baseline_value_usd baseline_landed_cost_usd scenario_landed_cost_usd delta_usd delta_pct"
_stage("mart_scenario_examples", "scenarios", "scenarios", f"consignee_key consignee_name scenario_name hs_chapter origin_country total_shipments {_SCEN}", _SCEN)


def _ask(name: str, select: str, needs: str, run, places: int = 4) -> None:
    """A query of the library's function ``run`` over the world's tables, against ``select``."""

    def ask(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(run(world(spark, sf_dir)), places)

    ask.__name__ = f"w_{name}"
    query(sql(select, needs))(ask)


_ask("tariff_events", "SELECT row_number() OVER (ORDER BY event_date, event_type, hs_scope, country_scope, description) AS event_key, event_date AS date_key, event_type, hs_scope, country_scope, rate_change_pp FROM tariff_events", "tariff_events", lambda t: t["fact_tariff_events"].select("event_key", "date_key", "event_type", "hs_scope", "country_scope", "rate_change_pp"))
_COMPANY = "(VALUES " + ", ".join(f"({_q(t)}, {_q(n)})" for t, n in gold.company_rows()) + ") company(ticker, company_name)"
_ask("dim_ticker", f"""SELECT l.ticker, company.company_name, l.cik, l.filing_type AS filing_type_latest, l.filing_date AS filing_date_latest, l.item_1a_length AS item_1a_length_latest, l.item_1a_length >= 5000 AS is_supply_chain_relevant, m.golden_id AS matched_consignee_key, coalesce(m.kind, 'none') AS match_confidence
  FROM (SELECT * FROM bronze_10k WHERE item_1a_text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY filing_date DESC NULLS LAST, cik NULLS LAST) = 1) l JOIN {_COMPANY} ON company.ticker = l.ticker
  LEFT JOIN (SELECT company.ticker, golden_id, CASE WHEN upper(canonical_name) = upper(company_name) THEN 'exact' ELSE 'partial' END AS kind FROM {_COMPANY} JOIN golden_consignee ON contains(upper(canonical_name), upper(regexp_replace(split_part(company_name, ' ', 1), '[^A-Za-z0-9]', '', 'g')))
    QUALIFY row_number() OVER (PARTITION BY company.ticker ORDER BY CASE WHEN upper(canonical_name) = upper(company_name) THEN 0 ELSE 1 END, total_shipments DESC NULLS LAST, golden_id) = 1) m ON m.ticker = l.ticker""", "bronze_10k golden_consignee", lambda t: t["dim_ticker"])  # fmt: skip
_ask("risk_chunks", """WITH d AS (SELECT ticker, cik, filing_date, item_1a_text AS x, length(item_1a_text) AS total FROM bronze_10k WHERE length(item_1a_text) >= 5000), k AS (SELECT *, unnest(range(0, ceil(total / 1500.0)::BIGINT)) * 1500 + 1 AS s FROM d)
  SELECT md5(ticker || '|' || filing_date::VARCHAR || '|' || s::VARCHAR) AS chunk_id, ticker, year(filing_date) AS filing_year, s AS chunk_start, least(s + 1699, total)::BIGINT AS chunk_end, length(substr(x, s, 1700))::BIGINT AS chunk_length, md5(substr(x, s, 1700)) AS chunk_md5 FROM k WHERE length(substr(x, s, 1700)) >= 200""", "bronze_10k",
  lambda t: t["fact_10k_risk_chunks"].select("chunk_id", "ticker", "filing_year", "chunk_start", "chunk_end", "chunk_length", F.md5("chunk_text").alias("chunk_md5")))
_ask("prompts", f"""SELECT product_text, md5({_q(chr(10).join([classify._GUIDE[0], "", *classify._GUIDE[1:], ""]) + chr(10) + "Product description: ")} || product_text || {_q(chr(10) * 2 + "Candidate HS codes:" + chr(10))} || string_agg('  Candidate ' || rank::VARCHAR || '. HS ' || hs6 || ' (' || round(sim, 2)::VARCHAR || '): ' || description, chr(10) ORDER BY rank)
  || {_q(chr(10) * 2 + f"Answer with six digits alone, without dots or words; {classify.REFUSAL} refuses.")}) AS prompt FROM candidates GROUP BY product_text""", "candidates", lambda t: t["int_hs_classified_raw"].select("product_text", F.md5("prompt").alias("prompt")))  # fmt: skip

# K, S1 to S10: the semantic layer's own model

_STARRED = "fact f LEFT JOIN dim_consignee c ON c.consignee_key = f.consignee_key LEFT JOIN dim_supplier s ON s.supplier_key = f.supplier_key LEFT JOIN dim_hs_code h ON h.hs_6 = f.hs_6 LEFT JOIN dim_country o ON o.country_code = f.origin_country_code LEFT JOIN dim_date d ON d.date_key = f.date_key"
_MARTED = "mart m LEFT JOIN dim_consignee c ON c.consignee_key = m.consignee_key LEFT JOIN dim_hs_code h ON h.hs_6 = m.hs_6"
_BOTH = "count(*) AS total_shipments, round(sum(estimated_landed_cost_usd), 4) AS total_landed_cost_usd"
_FULL = "fact mart dim_consignee dim_supplier dim_hs_code dim_country dim_date"
_LAST = "DESC NULLS LAST"
_QUESTIONS = {
    "s1": f"SELECT consignee_name, {_BOTH} FROM {_STARRED} GROUP BY ALL ORDER BY total_landed_cost_usd {_LAST}, consignee_name LIMIT 10",
    "s2": f"SELECT consignee_name, h.hs_6, is_single_source, round(max(supplier_hhi), 4) AS max_supplier_hhi FROM {_MARTED} WHERE hs_2 = '87' AND is_single_source GROUP BY ALL ORDER BY max(supplier_hhi) {_LAST}, consignee_name, h.hs_6 LIMIT 10",
    "s3": f"SELECT hs_2, hs_2_description, {_BOTH} FROM {_STARRED} WHERE origin_country_code = 'CN' GROUP BY ALL ORDER BY total_landed_cost_usd {_LAST}, hs_2 LIMIT 10",
    "s4": f"SELECT supplier_name, supplier_country_code, hs_4, {_BOTH} FROM {_STARRED} WHERE supplier_country_code = 'DE' AND hs_4 = '8708' GROUP BY ALL ORDER BY total_shipments {_LAST}, supplier_name LIMIT 10",
    "s5": f"SELECT hs_2, hs_2_description, {_BOTH}, round(avg(effective_duty_rate_pct), 4) AS avg_effective_duty_rate FROM {_STARRED} WHERE is_section_232_target AND hs_2 IN ('72', '73', '76') GROUP BY ALL",
    "s6": f"SELECT consignee_name, count(*) AS total_shipments FROM {_STARRED} WHERE c.is_forwarder GROUP BY ALL ORDER BY total_shipments {_LAST}, consignee_name LIMIT 20",
    "s7": f"SELECT year, month, count(*) AS total_shipments FROM {_STARRED} WHERE year = 2018 GROUP BY ALL",
    "s8": f"""SELECT consignee_name, hs_6_description, round(a.x, 4) AS max_supplier_hhi, b.total_shipments FROM (SELECT consignee_name, hs_6_description, max(supplier_hhi) AS x FROM {_MARTED} GROUP BY ALL) a JOIN (SELECT consignee_name AS n, hs_6_description AS e, count(*) AS total_shipments FROM {_STARRED} GROUP BY ALL) b
      ON n IS NOT DISTINCT FROM consignee_name AND e IS NOT DISTINCT FROM hs_6_description WHERE b.total_shipments >= 5 ORDER BY a.x {_LAST}, consignee_name, hs_6_description LIMIT 10""",
    "s9": f"SELECT country_name, count(*) AS total_shipments FROM {_STARRED} WHERE is_section_232_target GROUP BY ALL",
    "s10": f"""WITH g AS (SELECT consignee_name, h.hs_6, supplier_name, count(*) AS total_shipments FROM {_STARRED} WHERE hs_4 = '8400' GROUP BY ALL) SELECT * FROM g WHERE (consignee_name, hs_6) IN (SELECT (consignee_name, hs_6) FROM g GROUP BY ALL HAVING count(DISTINCT supplier_name) = 1) ORDER BY total_shipments {_LAST}, consignee_name, hs_6 LIMIT 10""",
}
_QUESTIONS["s4"] = _QUESTIONS["s4"].replace("8708", "8400")


def _questions(t: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables have no heading 8708 but 8400: rewritten in the codes, so that the questions have answers."""
    codes = t["dim_hs_code"].withColumn("hs_4", F.when(F.col("hs_4") == "8400", F.lit("8708")).otherwise(F.col("hs_4")))
    return semantic.sample_questions(ChainMap({"dim_hs_code": codes}, t))


for _k, _s in _QUESTIONS.items():
    _ask(f"semantic_{_k}", _s, _FULL, lambda t, k=_k: _questions(t)[k].withColumns({"hs_4": F.lit("8400")} if k == "s4" else {}))

# P: what the dashboards ask

_IN = f"left(hs_6, 2) IN ({_CHAPTERS})"
_CELLS = f"""WITH top AS (SELECT consignee_key, consignee_name FROM dim_consignee ORDER BY total_shipments {_LAST}, consignee_key LIMIT 30), n AS (SELECT consignee_name, left(hs_6, 2) AS hs_2, supplier_key, count(*)::DOUBLE AS n FROM fact JOIN top USING (consignee_key) WHERE {_IN} GROUP BY ALL),
  s AS (SELECT consignee_name, hs_2, n / sum(n) OVER (PARTITION BY consignee_name, hs_2) AS share FROM n)"""
_ask("top_consignees", f"SELECT consignee_name, round(sum(estimated_landed_cost_usd), 4) AS total_landed_cost FROM fact JOIN dim_consignee USING (consignee_key) GROUP BY consignee_name ORDER BY total_landed_cost {_LAST}, consignee_name LIMIT 10", "fact dim_consignee", lambda t: serving.top_consignees_by_landed_cost(t["fact_shipments"], t["dim_consignee"]))
_ask("concentration_cells", f"{_CELLS} SELECT consignee_name, hs_2, round(sum(share * share), 4) AS supplier_hhi FROM s GROUP BY ALL", "fact dim_consignee", lambda t: serving.concentration_cells(t["fact_shipments"], t["dim_consignee"]))
_ask("concentration_heatmap", f"{_CELLS}, h AS (SELECT consignee_name, hs_2, round(sum(share * share), 4) AS x FROM s GROUP BY ALL) SELECT consignee_name, {', '.join(f'max(CASE WHEN hs_2 = {_q(c)} THEN x END) AS h{c}' for c in sorted(classify.CHAPTERS))} FROM h GROUP BY consignee_name", "fact dim_consignee",
     lambda t: serving.concentration_heatmap(t["fact_shipments"], t["dim_consignee"]).select("consignee_name", *[F.col(c).alias(f"h{c}") for c in sorted(classify.CHAPTERS)]))
_ask("supplier_breakdown", "SELECT hs_6, hs_6_description, total_shipment_count AS shipment_count, supplier_count, round(supplier_hhi, 3) AS supplier_hhi_hs6, is_single_source FROM mart JOIN dim_consignee USING (consignee_key) JOIN dim_hs_code USING (hs_6) WHERE consignee_name = 'NIKE, INC.' AND left(hs_6, 2) = '84'", "mart dim_consignee dim_hs_code",
     lambda t: serving.supplier_breakdown_for_cell(t["mart_concentration_metrics"], t["dim_hs_code"], t["dim_consignee"], "NIKE, INC.", "84"))
_ask("shipment_summary", "SELECT count(*) AS total_shipments, count(DISTINCT consignee_key) AS unique_consignees, count(DISTINCT supplier_key) AS unique_suppliers, round(sum(estimated_landed_cost_usd), 2) AS total_landed_cost, (SELECT count(*) FROM mart WHERE is_single_source) AS single_source_pairs FROM fact", "fact mart", lambda t: serving.shipment_summary(t["fact_shipments"], t["mart_concentration_metrics"]), 2)
_ask("origin_breakdown", "SELECT origin_country_code, count(*) AS shipment_count FROM fact GROUP BY ALL", "fact", lambda t: serving.origin_country_breakdown(t["fact_shipments"]))
_ask("chapter_breakdown", f"SELECT left(hs_6, 2) AS hs_2, count(*) AS shipment_count FROM fact WHERE {_IN} GROUP BY ALL", "fact", lambda t: serving.hs_chapter_breakdown(t["fact_shipments"]))
_ask("scenario_list", "SELECT consignee_key, scenario_name, hs_chapter, origin_country, round(delta_usd, 4) AS delta_usd FROM scenarios ORDER BY scenarios.delta_usd DESC, consignee_key, scenario_name, hs_chapter, origin_country LIMIT 20", "scenarios", lambda t: serving.scenario_examples(t["mart_scenario_examples"]).select("consignee_key", "scenario_name", "hs_chapter", "origin_country", "delta_usd"))
_ask("consignee_options", f"SELECT consignee_key, consignee_name FROM dim_consignee ORDER BY total_shipments {_LAST}, consignee_key LIMIT 50", "dim_consignee", lambda t: serving.consignee_options(t["dim_consignee"]))
_ask("scenario_totals", "SELECT round(sum(baseline_landed_cost_usd), 2) AS baseline, round(sum(scenario_landed_cost_usd), 2) AS scenario, round(sum(delta_usd), 2) AS delta, round(sum(delta_usd) / sum(baseline_landed_cost_usd) * 100, 2) AS delta_pct FROM scenarios", "scenarios", lambda t: serving.scenario_totals(t["mart_scenario_examples"]), 2)
_ask("trace_stats", "SELECT count(*) AS total_queries, round(quantile_cont(total_latency_ms, 0.5), 4) AS p50_latency_ms, round(quantile_cont(total_latency_ms, 0.95), 4) AS p95_latency_ms, round(avg(cost_credits_estimate), 4) AS avg_cost_credits_estimate, round(avg(cost_credits_estimate) * 2, 4) AS avg_cost_usd_estimate FROM agent_traces", "agent_traces", lambda t: serving.agent_trace_stats(t["agent_traces"]))
_ask("recent_traces", "SELECT timestamp, question, total_latency_ms, cost_credits_estimate, tool_calls FROM agent_traces ORDER BY timestamp DESC, trace_id LIMIT 20", "agent_traces", lambda t: serving.recent_traces(t["agent_traces"]))
_ask("latencies", "SELECT total_latency_ms, count(*) AS n FROM agent_traces GROUP BY ALL", "agent_traces", lambda t: serving.latency_distribution(t["agent_traces"]).groupBy("total_latency_ms").agg(F.count("*").alias("n")))
_ask("tool_usage", "SELECT c->>'$.tool_name' AS tool_name, count(*) AS n_calls FROM (SELECT unnest(json_extract(tool_calls, '$[*]')) AS c FROM agent_traces) GROUP BY ALL", "agent_traces", lambda t: serving.tool_usage_breakdown(t["agent_traces"]))
_ask("trace_view", "SELECT trace_id, round(total_latency_ms / 1000.0, 1) AS latency_s, array_to_string(list_sort(list_distinct(json_extract_string(tool_calls, '$[*].tool_name'))), ', ') AS tools FROM agent_traces", "agent_traces", lambda t: serving.trace_view(t["agent_traces"]).select("trace_id", "latency_s", "tools"), 1)
_ask("ticker_matches", "SELECT consignee_key, CASE WHEN supplier_hhi < 0.15 THEN 'low' WHEN supplier_hhi < 0.25 THEN 'moderate' ELSE 'high' END AS band, CASE left(hs_6, 2) " + " ".join(f"WHEN '{k}' THEN '{k} {v}'" for k, v in serving.CHAPTER_NAMES.items()) + " ELSE left(hs_6, 2) END AS chapter, hs_6 FROM mart", "mart",
     lambda t: t["mart_concentration_metrics"].select("consignee_key", serving.hhi_band(F.col("supplier_hhi")).alias("band"), serving.chapter_label(F.left("hs_6", F.lit(2))).alias("chapter"), "hs_6"))

# O: looking at the raw tables

_ask("overview", "SELECT count(*) AS n_rows, min(trade_update_date) AS first, max(trade_update_date) AS last FROM bol_shipments", "bol_shipments", lambda t: profile.overview(t["bol_shipments"], "trade_update_date"))
_ask("hs_gap", rf"""WITH b AS (SELECT trim(coalesce(harmonized_number, '')) = '' AS none, coalesce(text, '') AS x, regexp_full_match(coalesce(text, ''), {_q(_NAMES_CODE)}) AS named FROM bol_shipments)
  SELECT count(*) AS n_rows, count(*) FILTER (NOT none) AS declared, count(*) FILTER (none) AS missing, count(*) FILTER (none AND named) AS recoverable, count(*) FILTER (none AND NOT named AND length(trim(x)) >= 5) AS has_text, count(*) FILTER (none AND trim(x) = '') AS no_text FROM b""", "bol_shipments", lambda t: profile.hs_gap(t["bol_shipments"]))  # fmt: skip
_CANON = "left(trim(regexp_replace(regexp_replace(lower(consignee_name), '[^a-z0-9 ]', '', 'g'), '\\s+', ' ', 'g')), 15)"
_ask("name_variation", f"SELECT count(*) AS raw_names, count(DISTINCT c) AS canonical_names, round(count(*) / count(DISTINCT c), 4) AS ratio FROM (SELECT DISTINCT consignee_name, {_CANON} AS c FROM bol_shipments WHERE consignee_name IS NOT NULL)", "bol_shipments", lambda t: profile.name_variation(t["bol_shipments"], "consignee_name"))
_ask("name_variants", f"SELECT canon, count(*) AS n_variants, string_agg(consignee_name, '; ' ORDER BY consignee_name) AS variants FROM (SELECT DISTINCT consignee_name, {_CANON} AS canon FROM bol_shipments WHERE consignee_name IS NOT NULL) GROUP BY canon ORDER BY n_variants DESC, canon LIMIT 20", "bol_shipments",
     lambda t: profile.name_variants(t["bol_shipments"], "consignee_name").withColumn("variants", F.array_join("variants", "; ")))
_ask("top_values", "SELECT harmonized_number AS value, count(*) AS n FROM bol_shipments GROUP BY ALL ORDER BY n DESC, value NULLS LAST LIMIT 15", "bol_shipments", lambda t: profile.top_values(t["bol_shipments"], F.col("harmonized_number")))
_ask("duplicate_ids", "SELECT identifier::VARCHAR AS identifier, count(*) AS n FROM bol_shipments GROUP BY ALL HAVING count(*) > 1 ORDER BY n DESC, min(bol_shipments.identifier) NULLS FIRST LIMIT 20", "bol_shipments", lambda t: profile.duplicate_ids(t["bol_shipments"], "identifier").withColumn("identifier", F.col("identifier").cast("string")))
_ask("sentinel_rows", "SELECT identifier, count(*) AS n FROM bol_shipments WHERE identifier % 1000000 = 0 GROUP BY ALL", "bol_shipments", lambda t: profile.sentinel_ids(t["bol_shipments"], "identifier"))
_ask("coverage", "SELECT count(*) AS n_rows, count(harmonized_value) AS n_known, round(count(harmonized_value) / count(*), 7) AS share FROM bol_shipments", "bol_shipments", lambda t: profile.coverage(t["bol_shipments"], "harmonized_value"), 7)
_ask("indents", "SELECT indent, count(*) AS n FROM hts_tariff_schedule GROUP BY ALL", "hts_tariff_schedule", lambda t: profile.indent_histogram(t["hts_tariff_schedule"]))
_ask("rate_coverage", f"""SELECT count(*) AS n_rows, count(*) FILTER (t = 'Free') AS free, count(*) FILTER (r > 0) AS ad_valorem, count(*) FILTER (t <> '' AND r IS NULL) AS specific, count(*) FILTER (t = '') AS missing FROM (SELECT trim(coalesce(general_rate_text, '')) AS t, {_RATE} AS r FROM hts_tariff_schedule)""", "hts_tariff_schedule", lambda t: profile.rate_coverage(t["hts_tariff_schedule"]))
_ask("footnotes", r"SELECT regexp_extract(footnotes, '9903\.\d{2}') AS heading, count(*) AS n FROM hts_tariff_schedule WHERE footnotes ILIKE '%9903.%' GROUP BY ALL", "hts_tariff_schedule", lambda t: profile.footnote_flags(t["hts_tariff_schedule"]))
_ask("rate_quantiles", f"SELECT count(*) AS n, round(avg(r), 4) AS mean, round(max(r), 4) AS max, {', '.join(f'round(quantile_cont(r, {p}), 4) AS p{int(p * 100)}' for p in (0.25, 0.5, 0.75, 0.9, 0.99))} FROM (SELECT {_RATE} AS r FROM hts_tariff_schedule) WHERE r IS NOT NULL", "hts_tariff_schedule", lambda t: profile.rate_quantiles(t["hts_tariff_schedule"]))
_ask("chapter_rates", f"SELECT hs2, round(avg(CASE WHEN r > 0 THEN r END), 4) AS avg_rate, round(avg(CASE WHEN r = 0 THEN 1.0 ELSE 0.0 END), 4) AS free_share FROM (SELECT hs2, {_RATE} AS r FROM hts_tariff_schedule WHERE hs2 IS NOT NULL) GROUP BY hs2", "hts_tariff_schedule", lambda t: profile.chapter_rates(t["hts_tariff_schedule"]))
_ask("naive_exposure", f"""WITH m AS (SELECT hs2, avg({_RATE}) AS r FROM hts_tariff_schedule WHERE hs2 IS NOT NULL GROUP BY hs2) SELECT consignee_name, count(*) AS n, sum(harmonized_value)::DOUBLE AS value, round(sum(harmonized_value * coalesce(r, 0)), 2) AS exposure
  FROM bol_shipments LEFT JOIN m ON hs2 = left(harmonized_number, 2) WHERE harmonized_value IS NOT NULL AND harmonized_number IS NOT NULL GROUP BY ALL""", "bol_shipments hts_tariff_schedule", lambda t: profile.naive_exposure(t["bol_shipments"], t["hts_tariff_schedule"], "consignee_name"), 2)  # fmt: skip
_ask("ports", "SELECT nullif(trim(regexp_extract(foreign_port_of_lading, ',([^,]+)$', 1)), '') AS country, count(*) AS n FROM bol_shipments GROUP BY ALL", "bol_shipments", lambda t: profile.ports_by_country(t["bol_shipments"]))
_ask("port_origins", f"SELECT foreign_port_of_lading AS port, {_port_sql('foreign_port_of_lading')} AS origin, {_country_sql('consignee_address')} AS registered, consignee_address AS address, count(*) AS n FROM bol_shipments GROUP BY ALL", "bol_shipments",
     lambda t: profile.port_origins(t["bol_shipments"]))
_ask("in_scope", f"SELECT count(*) AS n_rows, count(*) FILTER (left(harmonized_number, 2) IN ({_CHAPTERS}) AND {_port_sql('foreign_port_of_lading')} IS NOT NULL) AS in_scope FROM bol_shipments", "bol_shipments", lambda t: profile.in_scope(t["bol_shipments"], classify.CHAPTERS, country.port_origin_country(F.col("foreign_port_of_lading")).isNotNull()))
_ask("load_summary", "SELECT 'bol_shipments' AS table_name, count(*) AS n_rows, min(trade_update_date)::VARCHAR AS first_value, max(trade_update_date)::VARCHAR AS last_value FROM bol_shipments UNION ALL SELECT 'hts_tariff_schedule', count(*), NULL, NULL FROM hts_tariff_schedule", "bol_shipments hts_tariff_schedule",
     lambda t: load_summary({"bol_shipments": (t["bol_shipments"], "trade_update_date"), "hts_tariff_schedule": (t["hts_tariff_schedule"], None)}))
_ask("classified_rates", f"SELECT hts_number, {_RATE} AS ad_valorem, CASE WHEN trim(general_rate_text) NOT IN ('', 'Free') AND NOT regexp_full_match(trim(general_rate_text), '[0-9]+(\\.[0-9]+)?%') THEN general_rate_text END AS specific, left(replace(hts_number, '.', ''), 6) AS code FROM hts_tariff_schedule", "hts_tariff_schedule",
     lambda t: t["hts_tariff_schedule"].select("hts_number", hs.ad_valorem_rate(F.col("general_rate_text")).alias("ad_valorem"), hs.specific_rate(F.col("general_rate_text")).alias("specific"), hs.hs6(F.col("hts_number")).alias("code")))
