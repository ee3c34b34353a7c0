"""Harmonized System codes and duty rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from portolan.functions.text import full_match

SIX = r"\d{4}\.?\d{2}"


def is_sentinel_identifier(identifier: Column) -> Column:
    """Null, zero, or a short number filled up with six zeros or more: no real bill of lading. Never null itself."""
    s = identifier.cast("string")
    return identifier.isNull() | F.coalesce((identifier == 0) | full_match(s, r"[1-9]\d{0,5}0{6,}"), F.lit(False))


def _names_code(text: Column) -> Column:
    return full_match(text, rf".*HS[ -]?CODE:?\s*{SIX}.*", ignore_case=True)


def hs_from_text(text: Column) -> Column:
    """If a one-line text names an HS code, its first six-digit figure; that may be another number, as it always was."""
    return F.when(_names_code(text), F.regexp_substr(text, F.lit(SIX)))


def declared_or_text(declared: Column, text: Column) -> tuple[Column, Column]:
    """(code, source) by the waterfall: the declared field, else the text."""
    have = declared.isNotNull() & (declared != "")
    code = F.when(have, declared).otherwise(hs_from_text(text))
    source = F.when(have, F.lit("source_field")).when(_names_code(text), F.lit("regex_from_text"))
    return code, source


_PERCENT = r"[0-9]+(?:\.[0-9]+)?%"


def ad_valorem_rate(rate: Column) -> Column:
    """A duty's share of the value, 0 to 1: ``Free`` is 0 and ``3.4%`` is 0.034; anything else is null."""
    t = F.trim(rate)
    return F.when(t == "Free", F.lit(0.0)).when(full_match(t, _PERCENT), F.try_to_number(F.replace(t, F.lit("%"), F.lit("")), F.lit("999999.999999")).cast("double") / 100.0)


def specific_rate(rate: Column) -> Column:
    """The rate's text where it is no share of the value; blank texts are null."""
    t = F.trim(rate)
    return F.when((t != "") & (t != "Free") & ~full_match(t, _PERCENT), rate)


def hs6(code: Column) -> Column:
    """The first six digits of a code that may have dots and four to ten digits."""
    return F.left(F.replace(code, F.lit("."), F.lit("")), F.lit(6))


STATUSES = ("unclassifiable", "classified_hs6", "classified_hs6_dotted", "classified_hs4_only", "parse_failed")


def parse_response(response: Column) -> tuple[Column, Column]:
    """(code, status) from a classifier's answer: six digits, else 1234.56, else a lone four-digit heading with 00."""
    six, dotted, four = (F.regexp_substr(response, F.lit(p)) for p in (r"\d{6}", r"\d{4}\.\d{2}", r"\b\d{4}\b"))
    code = F.coalesce(six, F.replace(dotted, F.lit("."), F.lit("")), F.concat(four, F.lit("00")))
    status = (
        F.when(six == "999999", F.lit(STATUSES[0]))
        .when(six.isNotNull(), F.lit(STATUSES[1]))
        .when(dotted.isNotNull(), F.lit(STATUSES[2]))
        .when(four.isNotNull(), F.lit(STATUSES[3]))
        .otherwise(F.lit(STATUSES[4]))
    )
    return code, status


SOURCES = ("source_field", "regex_from_text", "llm_classified_hs6", "llm_classified_hs4", "llm_unclassifiable", "llm_parse_failed", "unresolved")


def hs_provenance(final: Column, source: Column, status: Column) -> Column:
    """Where a shipment's code comes from; never null."""
    by_status = {STATUSES[1]: SOURCES[2], STATUSES[2]: SOURCES[2], STATUSES[3]: SOURCES[3], STATUSES[0]: SOURCES[4], STATUSES[4]: SOURCES[5]}
    out = F.lit(SOURCES[6])
    for s, label in by_status.items():
        out = F.when(status == s, F.lit(label)).otherwise(out)
    for s in reversed(SOURCES[:2]):
        out = F.when(final.isNotNull() & (source == s), F.lit(s)).otherwise(out)
    return out


#: Additional duties by chapter, in percent.
SECTION_232 = {"72": 25.0, "73": 25.0, "76": 25.0}
SECTION_301 = {"39": 25.0, "61": 7.5, "62": 7.5, "73": 25.0, "84": 25.0, "85": 25.0, "87": 25.0}


def chapter_rate(chapter: Column, rates: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for k, v in rates.items():
        out = F.when(chapter == k, F.lit(v)).otherwise(out)
    return out
