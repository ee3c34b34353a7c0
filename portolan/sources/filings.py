"""Annual reports from full-submission text files."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.functions.text import strip_html
from portolan.session import ship_code


def _heading(*words: str, gap: str = r"\s*", flags: int = re.I) -> re.Pattern[str]:
    return re.compile(gap.join(words), flags)


def _item(number: str, *title: str) -> re.Pattern[str]:
    """A heading like ``Item 1A. Risk Factors``, with any blanks between."""
    return _heading("item", number + r"\.?", *title)


_MDA = _heading("item", r"7\.?", r"management.{0,10}s", "discussion", "and", "analysis")
_FINANCIALS = _item("8", "financial", "statements")
#: Per form and section: where it begins, and headings that end it.
SECTIONS: dict[str, dict[str, tuple[re.Pattern[str], list[re.Pattern[str]]]]] = {
    "10-K": {
        "item_1a": (_item("1a", "risk", "factors"), [_item("1b", "unresolved"), _heading("unresolved", "staff", "comments"), _heading("^", "item", r"2\b", flags=re.I | re.M), _item("2", "properties"), _MDA]),
        "item_7": (_MDA, [_item("7a", "quantitative"), _FINANCIALS]),
    },
    "20-F": {
        "item_1a": (_heading("item", r"3\.?", r"d\.?", "risk", "factors"), [_item("4", "information", "on", "the", "company")]),
        "item_7": (_item("5", "operating", "and", "financial", "review"), [_item("6", "directors")]),
    },
}
_AUDITORS = re.compile(r"deloitte|kpmg|pricewaterhousecoopers|\bpwc\b|ernst\s*&\s*young", re.I)
RUNAWAY = 50_000


def primary_document(submission: str, form: str) -> str:
    """The <TEXT> of the first <DOCUMENT> whose <TYPE> begins with the form; without one, all of the file."""
    for block in re.split("<document>", submission, flags=re.I)[1:]:
        kind = re.search(r"<type>([^<\r\n]+)", block, re.I)
        body = re.search(r"<text>(.*?)</text>", block, re.I | re.S)
        if kind and body and kind[1].strip().upper().startswith(form):
            return body[1]
    return submission


def extract_section(text: str, begin: re.Pattern[str], finish: list[re.Pattern[str]]) -> str:
    """The longest span from an occurrence of ``begin`` to the nearest later heading of ``finish``, or to the end; a table of contents makes short ones."""
    stops = sorted({m.start() for p in finish for m in p.finditer(text)})
    spans = []
    for m in begin.finditer(text):
        later = next((s for s in stops if s > m.end()), len(text))
        spans.append((m.end(), later))
    if not spans:
        return ""
    a, b = max(spans, key=lambda s: s[1] - s[0])
    return text[a:b].strip()


def guard_runaway(text: str) -> str:
    """A section above 50,000 characters that names an audit firm ran into the auditor's report: cut there or at Item 8."""
    firm = _AUDITORS.search(text) if len(text) > RUNAWAY else None
    if not firm:
        return text
    item8 = _FINANCIALS.search(text)
    return text[: min(firm.start(), item8.start() if item8 else firm.start())].strip()


def merge_tickers(groups: dict[str, list[str | dict[str, Any]]]) -> dict[str, dict[str, str | None]]:
    """{ticker: {cik, filing_type}}; an entry with a CIK beats a plain one, whichever comes first."""
    plain = {e: dict(cik=None, filing_type="10-K") for g in groups.values() for e in g if isinstance(e, str)}
    given = {e["ticker"]: {"cik": str(e["cik"]), "filing_type": e.get("filing_type", "10-K")} for g in groups.values() for e in g if not isinstance(e, str)}
    return plain | given


def load_ticker_config(path: str) -> dict[str, dict[str, str | None]]:
    """``merge_tickers`` of a YAML file, or of a JSON file where PyYAML isn't installed."""
    with open(path) as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        return merge_tickers(json.loads(text))
    return merge_tickers(yaml.safe_load(text))


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """(path, submission): whole files; bytes that are no UTF-8 become replacement characters."""
    texts = spark.read.text(path, wholetext=True)
    plan = texts._jdf.queryExecution()
    # Spark gives a task some thirty files, however small; a task that starts Python for these takes longer over that than over them.
    pieces = max(4 * spark.sparkContext.defaultParallelism, int(str(plan.optimizedPlan().stats().sizeInBytes())) >> 26)
    if plan.toRdd().getNumPartitions() > pieces:
        texts = texts.select("value", F.col("_metadata.file_path").alias("path")).coalesce(pieces)
        return texts.select("path", F.col("value").alias("submission"))
    return texts.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("submission"))


def parse_filings(submissions: DataFrame, ticker: str = "ticker", form: str = "filing_type") -> DataFrame:
    """Filings from (path, submission, ticker, filing_type): header fields, and the risk and discussion sections with their lengths.

    A file without a CIK in its header takes it from the accession number in
    its path. Sections missing in a filing are empty texts.
    """
    ship_code(submissions.sparkSession)

    @F.pandas_udf("string")
    def main_document(s: pd.Series, f: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else primary_document(t, k or "10-K") for t, k in zip(s, f)])

    @F.pandas_udf("struct<item_1a: string, item_7: string>")
    def sections(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, forms in parts:
            rows = []
            for t, k in zip(texts, forms):
                marks = SECTIONS.get(k or "10-K", SECTIONS["10-K"])
                got = {name: extract_section(t or "", *m) for name, m in marks.items()}
                rows.append((guard_runaway(got["item_1a"]), got["item_7"]))
            yield pd.DataFrame(rows, columns=["item_1a", "item_7"])

    header = F.regexp_extract("submission", r"CENTRAL\s+INDEX\s+KEY:\s*([0-9]+)", 1)
    folder = F.regexp_extract("path", r"(\d{10})-\d{2}-\d{6}", 1)
    cik = F.coalesce(F.nullif(header, F.lit("")), F.nullif(folder, F.lit(""))).cast("long").cast("string")
    filed = F.try_to_date(F.nullif(F.regexp_extract("submission", r"FILED\s+AS\s+OF\s+DATE:\s*([0-9]{8})", 1), F.lit("")), "yyyyMMdd")
    plain = strip_html(main_document(F.col("submission"), F.col(form)))
    out = submissions.select(cik.alias("cik"), F.col(ticker).alias("ticker"), filed.alias("filing_date"), F.col("path").alias("filing_url"), F.coalesce(F.col(form), F.lit("10-K")).alias("filing_type"), plain.alias("plain"))
    out = out.withColumn("s", sections("plain", "filing_type"))
    return out.select(
        "cik", "ticker", "filing_date", "filing_url", F.col("s.item_1a").alias("item_1a_text"), F.col("s.item_7").alias("item_7_text"),
        F.length("s.item_1a").cast("long").alias("item_1a_length"), F.length("s.item_7").cast("long").alias("item_7_length"), F.localtimestamp().alias("ingested_at"), "filing_type",
    )


def long_enough(filings: DataFrame, least: int = 5000) -> DataFrame:
    """Filings whose risk section is long enough to be one; for form 20-F, either section will do."""
    return filings.filter(F.when(F.col("filing_type") == "20-F", F.greatest("item_1a_length", "item_7_length") >= least).otherwise(F.col("item_1a_length") >= least))
