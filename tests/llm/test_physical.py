"""What the operators' plans must not have."""

from portolan.llm import bitpack, pii, quality


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_wise_operators_don_t_shuffle(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert "Exchange" not in plan(quality.clean_lines(docs)) and "Python" not in plan(quality.clean_lines(docs)) and "MapIn" not in plan(quality.clean_lines(docs))
    assert "Exchange" not in plan(pii.mask_pii(docs)) and "Exchange" not in plan(bitpack.pack_documents(docs))


def test_the_filter_evaluates_rules_once(spark, sf):
    p = plan(quality.clean_lines(spark.read.parquet(f"{sf}/documents.parquet")))
    assert p.count("lambda x_") >= 1 and p.count("licensed under") <= 2
