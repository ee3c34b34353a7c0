import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from portolan.functions import country, hs, money, text, vector


def apply(spark, f, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r["y"] for r in df.withColumn("y", f(F.col("x"))).orderBy("i").collect()]


def table(spark, f, cases, kind="string"):
    assert dict(zip(cases, apply(spark, f, list(cases), kind))) == cases


def test_company_names(spark):
    table(spark, text.normalize_company_name, {
        "MERCEDES-BENZ U.S., L.L.C.": "mercedesbenz us llc", "The Gap, Inc.": "gap", "KUEHNE + NAGEL AG & CO. KG": "kuehne nagel kg", "Acme S.A. de C.V.": "acme sa de cv", "AS PER ORDER": "per order",
        "  THE BOSCH GmbH": "the bosch", "": "", None: None, "mercedesbenz us llc": "mercedesbenz us",
    })


def test_product_texts(spark):
    table(spark, text.normalize_product_text, {
        "Plastic parts PO# 12345 STYLE: AB-12 HS CODE: 392690 1200.5 KGS": "PLASTIC PARTS S", "REFRIGERATOR COMPRESSORS INV-778 MSCU1234567": "COMPRESSORS", "200 CTNS COTTON T-SHIRTS UN1234 ORDER 55A": "S COTTON T SHIRTS", "WINE": "WINE", None: None,
    })


def test_countries_of_addresses(spark):
    cases = {
        "BERLIN GERMANY": "DE", "PORT OF SPAIN": None, "MADRID, SPAIN": "ES", "MADE IN CHINA": None, "BEIJING CHINA": "CN", "ATLANTA, GEORGIA": None, "TBILISI GEORGIA": "GE", "HAMBURG, DE 20457": "DE", "HAMBURG DE": None,
        "GREER SC 29651": "US", "WILMINGTON, DE 19801": "DE", "NEWARK NJ 07102-1234 USA": "US", "A\nB US": None, "U.S.A.": "US", "SOMEWHERE US": "US", "US": "US", "BUS": None, "X UNITED STATES": "US", "PLACE M 12345": "US",
        "LYON FRANCE 69001": "FR", "C.P. 12345": None, "STREET 12345": "US", "DUBAI": "AE", "SEOUL, KR 123": "KR", None: None, "": None,
    }
    table(spark, country.extract_country_from_text, cases)


def test_every_country_name_is_found(spark):
    rows = [f"1 X ST, {have[0]}" for _, have, _ in country.NAMES]
    assert apply(spark, country.extract_country_from_text, rows) == [c for c, _, _ in country.NAMES]


def test_ports(spark):
    table(spark, country.port_origin_country, {"Hamburg,Germany": "DE", "Port of Spain,Trinidad": None, "Cardiff,Wales": "GB", "Shanghai,China": "CN", "Rotterdam,Netherlands": None, None: None})
    table(spark, country.port_suffix, {"Hamburg,Germany": "Germany", "A,B, C ": "C", "Nowhere": None, None: None})


def test_parties(spark):
    table(spark, text.is_placeholder_name, {"to order of bank": True, "unknown notify": True, "na": True, "ab": True, "   ": True, "": True, "acme": False, None: None})
    table(spark, text.is_freight_forwarder, {"DHL GLOBAL": True, "k line": True, "MARCO": True, "MOLLY": True, "ACME": False, None: None})
    assert len(text.FORWARDERS) == 39


def test_identifiers(spark):
    cases = {2018020000000: True, 1000000: True, 123456000000: True, 0: True, None: True, 2018010397391: False, 2018040647536: False, 100000: False, 1234567000000: False}
    table(spark, hs.is_sentinel_identifier, cases, "long")


def test_codes(spark):
    table(spark, hs.hs_from_text, {"CHAIN HS CODE: 8432.90": "8432.90", "PO 17049065 HS CODE 200980": "170490", "HTS 843120": None, "HS CODE(S) 34022020": None, "first line\nHS CODE 843120": None, None: None})
    table(spark, hs.hs6, {"8432.90.1234": "843290", "8708": "8708", None: None})
    table(spark, hs.ad_valorem_rate, {"Free": 0.0, " 3.4% ": pytest.approx(0.034), "1.5c/kg": None, "free": None, " ": None, None: None, "100%": 1.0})
    table(spark, hs.specific_rate, {"Free": None, " 3.4% ": None, "1.5c/kg": "1.5c/kg", "free": "free", " ": None, None: None})
    answers = {"870899": ("870899", "classified_hs6"), "8701.21": ("870121", "classified_hs6_dotted"), "8708": ("870800", "classified_hs4_only"), "999999": ("999999", "unclassifiable"), "8708991234": ("870899", "classified_hs6"), "87089": (None, "parse_failed"), None: (None, "parse_failed")}
    for k in (0, 1):
        table(spark, lambda c, k=k: hs.parse_response(c)[k], {a: v[k] for a, v in answers.items()})


def test_provenance(spark):
    rows = [("1", "source_field", None, "source_field"), ("1", "regex_from_text", "parse_failed", "regex_from_text"), (None, None, "classified_hs6_dotted", "llm_classified_hs6"), (None, None, "unclassifiable", "llm_unclassifiable"), (None, None, None, "unresolved"), ("1", None, None, "unresolved")]
    df = spark.createDataFrame(rows, "f string, s string, t string, want string")
    assert not df.filter(hs.hs_provenance(F.col("f"), F.col("s"), F.col("t")) != F.col("want")).count()


def test_money(spark):
    df = spark.createDataFrame([(100, "Pounds"), (100, None), (None, "Pounds")], "w long, u string")
    assert [r[0] for r in df.select(money.weight_kg(F.col("w"), F.col("u"))).collect()] == [pytest.approx(45.3592), 100.0, None]
    duty = money.effective_duty_pct(*[F.col(c) for c in "abcde"])
    df = spark.createDataFrame([(2.0, 25.0, 25.0, True, True), (2.0, 25.0, 25.0, False, False), (None, None, None, True, None), (1.0, 25.0, 7.5, None, True)], "a double, b double, c double, d boolean, e boolean")
    assert [r[0] for r in df.select(duty).collect()] == [52.0, 2.0, 0.0, 8.5]
    assert apply(spark, lambda v: money.landed_cost(v, F.lit(10.0)), [100, None], "long") == [pytest.approx(110.0), None]


def test_text_tools(spark):
    assert apply(spark, lambda c: text.keyword_count(c, "tariff"), ["Tariff tariffs no", "", None], "string") == [2, 0, 0]
    assert apply(spark, lambda c: text.keyword_count(c, "a.b"), ["a.b axb"], "string") == [1]
    hits = apply(spark, lambda c: text.keyword_snippets(c, "tariff", 10, need=("china",), refuse=("wine",)), ["the tariff on china is " + "x" * 40 + " tariff wine china"])[0]
    assert hits == ["the tariff on china "[: len(hits[0])]]
    html = "<html><script>var t='</p>';</script><style>p{}</style><ix:header>h</ix:header><p>A &amp; B&nbsp;C</p>\n\n<br>D&#8217;s</html>"
    assert apply(spark, text.strip_html, [html]) == ["A & B C\nD's"]
    assert apply(spark, text.eda_canon, ["The Acme, Inc. & Co"]) == ["the acme inc co"[:15]]
    pairs = [("Nike Inc", "INC NIKE", 100.0), ("fuzzy was a bear", "fuzzy fuzzy was a bear", 100.0), ("abc", "xyz", 0.0), ("", "a", 0.0), (None, "a", None)]
    df = spark.createDataFrame(pairs, "a string, b string, w double")
    assert [r[0] for r in df.select(text.token_set_ratio(F.col("a"), F.col("b"), fold=True)).collect()] == [w for *_, w in pairs]
    assert df.select(text.token_set_ratio(F.col("a"), F.col("b"))).first()[0] < 40  # case counts


def test_token_set_ratio_by_definition():
    """Twice the longest common subsequence over both lengths, by the table of all prefixes."""

    def lcs(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    ratio = lambda a, b: 200.0 * lcs(a, b) / (len(a) + len(b))
    r = random.Random(4)
    for _ in range(300):
        a, b = (" ".join(r.choice(["acme", "acne", "corp", "co", "of", "the", "toys", "inc."]) for _ in range(r.randint(1, 5))) for _ in range(2))
        both, one, two = sorted(set(a.split()) & set(b.split())), sorted(set(a.split()) - set(b.split())), sorted(set(b.split()) - set(a.split()))
        common, left, right = " ".join(both), " ".join(both + one), " ".join(both + two)
        # The wholes begin alike, so what they have in common is that and the rest's.
        want = max([100.0] if both and (not one or not two) else [ratio(left, right), *([ratio(common, left), ratio(common, right)] if both else [])])
        assert abs(text._set_ratio(a, b) - want) < 1e-9, (a, b)


def test_full_match_is_whole(spark):
    assert apply(spark, lambda c: text.full_match(c, ".*US$"), ["a US", "a\nb US", "USA"]) == [True, False, False]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(vector.cosine(F.col("a"), F.col("b"))).collect()] == [pytest.approx(0.5**0.5), None, None]
    e = vector.HashedNgrams()
    a, b, c = e(["nike shoes", "nike shoe", "granite slabs"])
    assert a @ b > 0.7 > a @ c and abs(a @ a - 1) < 1e-5 and (e(["nike shoes"]) == a).all()


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=40))
def test_embedder_takes_any_text(s):
    v = vector.HashedNgrams()([s])
    assert v.shape == (1, 256) and v.dtype.name == "float32"
