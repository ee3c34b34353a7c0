"""Plans that must stay as they are at scale."""

import pytest
from pyspark.sql import functions as F

from portolan.operators import relational as rel
from portolan.plans import catalogue, gold, scenario


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_what_is_asked_and_filter_early(spark, sf):
    p = plan(catalogue.q_semantic_3(spark, sf))
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)" in p and "l_comment" not in p
    scan = next(x for x in p.splitlines() if "lineitem.parquet" in x)
    assert "l_discount" not in scan and "l_quantity" not in scan


def test_top_by_limits_before_the_shuffle(spark, sf):
    p = plan(catalogue.q_dedup_latest(spark, sf))
    assert p.count("WindowGroupLimit") == 2 and p.count("Exchange hashpartitioning") == 1


def test_mart_shuffles_the_fact_once(spark, sf):
    fact = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_returnflag").alias("consignee_key"), F.col("l_linestatus").alias("hs_6"), F.col("l_suppkey").alias("supplier_key"), F.col("l_partkey").alias("origin_country_code"), F.col("l_tax").alias("weight_kg"), F.col("l_discount").alias("estimated_landed_cost_usd"))
    p = plan(gold.mart_concentration_metrics(fact))
    assert p.count("Exchange") == 2 and "Expand" not in p  # once for the partial sums, once for their groups


@pytest.mark.parametrize("name", ["q_blocking_pairs", "q_disjunctive_join", "q_er_metrics", "q_cosine_pairs", "q_concentration_mart", "q_semantic_8"])
def test_no_products(spark, sf, name):
    p = plan(catalogue.queries()[name](spark, sf))
    assert "CartesianProduct" not in p
    if name not in ("q_er_metrics",):  # that one joins rows of one row each
        assert "NestedLoop" not in p


def test_scenarios_need_no_second_shuffle(spark, sf):
    p = plan(catalogue.q_scenario_batch(spark, sf))
    tail = p[: p.index("HashAggregate")]
    assert "Exchange" not in tail.replace("BroadcastExchange", "") and scenario.CANONICAL


def test_chunks_and_html_stay_in_the_jvm(spark, sf):
    for name in ("q_chunks", "q_strip_html", "q_keyword_density", "q_normalize_text"):
        p = plan(catalogue.queries()[name](spark, sf))
        assert "Python" not in p and "Arrow" not in p
    assert "Exchange" not in plan(rel.text_chunks(spark.read.parquet(f"{sf}/documents.parquet"), "text"))


def test_mart_holds_no_group_in_one_task(spark, sf):
    """Windows over a group kept all its holders in one task."""
    p = plan(catalogue.q_concentration_mart(spark, sf))
    assert "Window" not in p and "ObjectHash" not in p and "sum(" in p


def test_stored_keys_are_not_broadcast(spark):
    """A table of keys that looked small by its file was held as a whole in each task."""
    a, b = spark.range(10).withColumnRenamed("id", "k"), spark.range(5).withColumnRenamed("id", "k")
    for safe in (True, False):
        df = rel.anti_by(a, b, ["k"], null_safe=safe)
        assert df.count() == 5 and "SortMergeJoin" in plan(df) and "Broadcast" not in plan(df)


def test_postings_are_not_added_up_by_tasks(spark):
    """Texts were taken apart and added up again in tables as large as all words of a task."""
    from portolan.plans import search

    docs = spark.createDataFrame([(1, "b a B, aa aa. AA x2"), (2, ""), (3, None), (4, "été aa")], "k long, t string").withColumn("n_words", F.size(search.words(F.col("t"))).cast("long"))
    got = search._postings_of_unique(docs, "k", "t")
    assert "Aggregate" not in plan(got)
    rows = lambda df: sorted(map(tuple, df.select("k", "n_words", "word", "tf", "bucket").collect()))
    assert rows(got) == rows(search._postings(docs, "k", "t")) and len(rows(got)) == 4
