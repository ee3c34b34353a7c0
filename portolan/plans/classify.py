"""Tariff codes for shipments: declared, read from the text, or retrieved and classified."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.functions.hs import hs_provenance, parse_response
from portolan.functions.text import normalize_product_text
from portolan.functions.vector import embed
from portolan.operators.similarity import cosine_top_k
from portolan.session import ship_code
from portolan.sources.tables import append_new

CHAPTERS = ("39", "61", "62", "73", "84", "87")
REFUSAL = "999999"
#: Anything from prompts to answers can stand in for the completer.
Completer = Callable[[list[str]], list[str]]


def product_text_universe(shipments: DataFrame, embedder=None) -> DataFrame:
    """Distinct normalized texts of shipments without a code, five characters or more, with the 200-character key and its embedding.

    One row per key: of full texts that share one, the least.
    """
    ship_code(shipments.sparkSession)
    texts = shipments.filter(F.col("harmonized_number_final").isNull() & F.col("text").isNotNull()).select(normalize_product_text(F.col("text")).alias("full")).filter(F.length("full") >= 5)
    keyed = texts.groupBy(F.left("full", F.lit(200)).alias("product_text")).agg(F.min("full").alias("normalized_text_full"))
    return keyed.select("normalized_text_full", F.col("product_text").alias("normalized_text"), "product_text").withColumn("embedding", embed(embedder)(F.col("product_text")))


def hts_embedded(hts: DataFrame, embedder=None) -> DataFrame:
    """One row per six-digit code with the least description, without chapters 98 and 99."""
    ship_code(hts.sparkSession)
    rows = hts.filter(F.col("hs6").isNotNull() & F.col("description").isNotNull() & ~F.col("hs2").isin("98", "99"))
    one = rows.groupBy("hs6").agg(*[F.min(c).alias(c) for c in ("hs4", "hs2", "description")])
    return one.withColumn("embedding", embed(embedder)(F.col("description")))


def hs_candidates(texts: DataFrame, hts: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most similar codes of each text; ties by code."""
    refs = hts.select("hs6", "hs4", "hs2", F.col("description").alias("hts_description"), F.col("embedding").alias("v"))
    return cosine_top_k(texts.select("product_text", "embedding"), refs, "embedding", "v", "hs6", k, carry=("hs4", "hs2", "hts_description"))


_GUIDE = (
    "Act as an expert in customs classification. Choose the one HS-6 code that fits the shipped product best; the candidates below come from a similarity search.",
    "Rules:",
    "1. Don't trust the candidates blindly. A similarity of about 0.55 to 0.70 often means that the search found nothing fitting, and one above 0.80 proves nothing either. Read what each code covers.",
    f"2. A product text that is too vague to be classified, such as general cargo, household goods, supplies or spare parts with no material named, is answered by {REFUSAL}. Rather refuse than be wrong.",
    "3. A specific product that none of the candidates covers may get the right six-digit code from outside the list.",
    "4. In all other cases take the best candidate.",
)


def prompts(candidates: DataFrame) -> DataFrame:
    """(product_text, candidate_block, prompt): candidates in order of rank, one line each."""
    line = F.concat(F.lit("  Candidate "), F.col("rank"), F.lit(". HS "), F.col("hs6"), F.lit(" ("), F.round("sim", 2), F.lit("): "), F.coalesce("hts_description", F.lit("")))
    block = candidates.groupBy("product_text").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "hs6", line.alias("s")))), lambda x: x["s"]), "\n").alias("candidate_block"))
    head = F.lit("\n".join([_GUIDE[0], "", *_GUIDE[1:], ""]) + "\nProduct description: ")
    tail = F.lit(f"\n\nAnswer with six digits alone, without dots or words; {REFUSAL} refuses.")
    return block.withColumn("prompt", F.concat(head, "product_text", F.lit("\n\nCandidate HS codes:\n"), "candidate_block", tail))


class RuleCompleter:
    """Answers a prompt without a model: a code that the product text itself has, else the first candidate if it's similar enough, else a refusal."""

    def __init__(self, least: float = 0.45):
        self.least = least

    def __call__(self, batch: list[str]) -> list[str]:
        out = []
        for p in batch:
            product = p.partition("Product description: ")[2].partition("\n\nCandidate HS codes:")[0]
            own = re.search(r"\bHS[ :]*(\d{4}\.?\d{2})\b", product)
            first = re.search(r"Candidate 1\. HS (\S+) \((-?[\d.]+)\)", p)
            if own:
                out.append(own[1].replace(".", ""))
            elif first and float(first[2]) >= self.least:
                out.append(first[1])
            else:
                out.append(REFUSAL)
        return out


def _complete(df: DataFrame, completer: Completer | None) -> DataFrame:
    ship_code(df.sparkSession)
    use = completer or RuleCompleter()

    @F.pandas_udf("string")
    def answer(p: pd.Series) -> pd.Series:
        return pd.Series(use(p.tolist()), index=p.index, dtype=object)

    return df.withColumn("raw_response", F.trim(answer(F.col("prompt"))))


def classified_raw(candidates: DataFrame, completer: Completer | None = None, path: str | None = None) -> DataFrame:
    """Prompts with their answers. With ``path``, texts that the table there has are never asked again."""
    asked = prompts(candidates)
    if path is None:
        return _complete(asked, completer)
    return append_new(asked, path, ["product_text"], lambda new: _complete(new, completer))


def classified(raw: DataFrame) -> DataFrame:
    code, status = parse_response(F.col("raw_response"))
    return raw.select("product_text", "raw_response", code.alias("predicted_hs_6"), status.alias("classification_status"))


def shipments_classified(shipments: DataFrame, answers: DataFrame) -> DataFrame:
    """Every shipment with its unified code and where that is from; as many rows as there were."""
    one = answers.dropDuplicates(["product_text"]).select("product_text", "predicted_hs_6", "classification_status", F.col("raw_response").alias("llm_raw_response"))
    keyed = shipments.withColumn("__key", F.left(normalize_product_text(F.col("text")), F.lit(200)))
    joined = keyed.join(one, keyed["__key"] == one["product_text"], "left").drop("__key", "product_text")
    unified = F.coalesce("harmonized_number_final", "predicted_hs_6")
    return joined.withColumns({
        "hs_code_unified": unified, "hs_source_final": hs_provenance(F.col("harmonized_number_final"), F.col("hs_source"), F.col("classification_status")),
        "hs_4_final": F.left(unified, F.lit(4)), "hs_2_final": F.left(unified, F.lit(2)),
    })


def shipments_scoped(df: DataFrame) -> DataFrame:
    """The six chapters in focus, after classification; refusals fall away."""
    return df.filter(F.col("hs_2_final").isin(*CHAPTERS) & F.col("hs_code_unified").isNotNull() & (F.col("hs_source_final") != "llm_unclassifiable"))


def classifier_accuracy(seed: DataFrame, shipments: DataFrame) -> DataFrame:
    """One row: agreement with labelled texts on six, four and two digits, and refusals."""
    from portolan.functions.hs import hs6

    left = lambda c, n: F.left(c, F.lit(n))
    known = shipments.select(F.col("text").alias("product_text"), hs6(F.col("hs_code_unified")).alias("p6")).distinct()
    rows = seed.select("product_text", F.col("correct_hs_6").alias("c6")).join(known, "product_text", "left").distinct()
    hit = {n: left(F.col("c6"), n) == left(F.col("p6"), n) for n in (6, 4, 2)}
    clean = F.col("c6") != REFUSAL
    pct = lambda n: F.round(100.0 * F.count_if(hit[n]) / F.nullif(F.count("*"), F.lit(0)), 1).alias(f"overall_hs{n}_pct")
    return rows.agg(
        F.count("*").alias("total_seed_rows"), F.count("p6").alias("matched_seed_rows"), F.count_if(hit[6]).alias("exact_hs6_matches"), F.count_if(hit[4]).alias("hs4_matches"), F.count_if(hit[2]).alias("hs2_matches"),
        F.count_if(clean & hit[6]).alias("clean_hs6_matches"), F.count_if(clean).alias("clean_total"), F.count_if(~clean & (F.col("p6") == REFUSAL)).alias("correct_refusals"), F.count_if(~clean).alias("total_ambiguous_seed_rows"),
        pct(6), pct(4), pct(2),
    )
