"""Names and free text."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def full_match(col: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Whether all of the text matches; ``rlike`` alone would be content with a part. A dot doesn't match a line feed."""
    return col.rlike(("(?i)" if ignore_case else "") + rf"\A(?:{pattern})\z")


def contains_any(col: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [col.contains(w) for w in words])


def _chain(col: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, col)


#: Legal forms that a company name loses, where they are words of their own and before punctuation goes.
LEGAL_FORMS = tuple(sorted("ab ag as bv co company corp corporation gmbh inc incorporated kk limited llc llp ltd nv oy plc pty sa sarl spa srl".split(), key=lambda w: (-len(w), w)))


def normalize_company_name(col: Column) -> Column:
    """Lower case without legal forms and punctuation.

    Legal forms go first, so dotted ones (S.A.) become words that stay; a
    second application may strip more. One pass removes a leading "the " or
    leading blanks, not both.
    """
    forms = "|".join(LEGAL_FORMS)
    steps = [(r",\s+", " "), (rf"(?i)\b(?:{forms})\b", ""), (r"(?i)[^a-z0-9 ]", ""), (r"\s+", " "), (r"(?i)^\s+|\s+$|^the ", "")]
    return F.trim(F.lower(_chain(col, steps)))


#: Freight forwarders and carriers, by what their names contain. The short ones also match within words; that is wanted.
FORWARDERS = tuple(
    s.replace("_", " ")
    for s in (
        "APL ARC CEVA CMA_CGM COSCO DAMCO DHL DSV EVERGREEN_LINE EXPEDITORS GEODIS HAPAG HELLMANN HMM HYUNDAI_GLOVIS KING_OCEAN KLINE KUEHNE K_LINE MAERSK "
        "MITSUI_LINES MITSUI_OSK MOL MSC NAGEL NIPPON_EXPRESS NIPPON_YUSEN NYK OCEAN_NETWORK_EXPRESS OOCL PANALPINA PIL SCHENKER UWL WAN_HAI WWL YANG_MING YUSEN ZIM"
    ).split()
)


def is_freight_forwarder(name: Column) -> Column:
    return contains_any(F.upper(name), FORWARDERS)


PLACEHOLDERS = ("NOT AVAILABLE", "NOTIFY PARTY", "NULL", "OF ORDER", "OF THE ORDER", "PENDING", "TBD", "TO ORDER", "TO THE ORDER", "UNKNOWN")


def is_placeholder_name(name: Column) -> Column:
    """Whether a (normalized) name only stands in for one: a stock phrase, n/a, or under three characters."""
    up = F.upper(name)
    return contains_any(up, PLACEHOLDERS) | up.isin("NA", "N/A") | (F.length(F.trim(name)) < 3)


_AFTER = r"[#: ]*"
#: What is taken out of product texts, one after the other; each step sees what the one before left.
PRODUCT_NOISE = (
    rf"PO{_AFTER}\d+",
    rf"STYLE{_AFTER}[-A-Z0-9]+",
    rf"(?:REF|INVOICE|INV|ORDER){_AFTER}[-A-Z0-9]+",
    r"HS[ -]?CODE[ :]*\d{4,10}",
    r"[A-Z]{4}\d{7}",
    r"[0-9]+[,.]?[0-9]* ?(?:" + "|".join("KG KGS LBS MT CBM CTN PLT PKG PCS CTNS".split()) + ")",
    r"\b\d{5,}\b",
    r"UN ?\d{4}",
)


def normalize_product_text(col: Column) -> Column:
    """Upper case without order, style, reference and container numbers, weights, quantities and punctuation. The steps' order matters."""
    bare = _chain(F.upper(col), [("(?i)" + p, "") for p in PRODUCT_NOISE])
    return F.trim(_chain(bare, [(r"(?i)[^A-Z0-9 ]", " "), (r"\s+", " ")]))


def eda_canon(col: Column) -> Column:
    """The first 15 letters and digits of a name, for a quick look at its variants."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.lower(col), "[^a-z0-9 ]", ""), r"\s+", " ")), 1, 15)


def keyword_count(col: Column, word: str) -> Column:
    """How often a literal occurs, case ignored: by what its removal takes away, which is far cheaper than a pattern; the text is put in lower case once for all words."""
    low = F.lower(col)
    gone = F.length(low) - F.length(F.replace(low, F.lit(word.lower()), F.lit("")))
    return F.coalesce((gone / len(word)).cast("long"), F.lit(0).cast("long"))


def keyword_snippets(col: Column, word: str, around: int = 150, need: tuple[str, ...] = (), refuse: tuple[str, ...] = ()) -> Column:
    """Array of the passages about a word, up to ``around`` characters on either side, that hold one of ``need`` and none of ``refuse``."""
    quoted = "".join(c if c.isalnum() or c == " " else "\\" + c for c in word)
    found = F.regexp_extract_all(col, F.lit(rf"(?is).{{0,{around}}}{quoted}.{{0,{around}}}"), F.lit(0))
    low = lambda x: F.lower(x)
    if need:
        found = F.filter(found, lambda x: contains_any(low(x), tuple(w.lower() for w in need)))
    if refuse:
        found = F.filter(found, lambda x: ~contains_any(low(x), tuple(w.lower() for w in refuse)))
    return found


def strip_html(html: Column) -> Column:
    """Text of a page: no scripts, styles, inline-XBRL headers, tags or comments; common entities read; blanks collapsed."""
    steps = [
        (r"(?is)<(script|style)\b.*?</\1\s*>", " "),
        (r"(?is)<ix:header\b.*?</ix:header\s*>", " "),
        (r"(?s)<[^>]*>", " "),
        (r"(?i)&nbsp;|&#160;|&#xa0;", " "),
        (r"(?i)&amp;", "&"),
        (r"&#8217;|&rsquo;", "'"),
        (r"[ \t\x{a0}]+", " "),
        (r"\s*\n\s*", "\n"),
    ]
    return F.trim(_chain(html, steps))


def _set_ratio(a: str, b: str) -> float:
    """2 * LCS / (a + b) in per cent, the best of the common words against either whole and of both wholes."""
    wa, wb = set(a.split()), set(b.split())
    if not wa or not wb:
        return 0.0
    both, one, two = sorted(wa & wb), " ".join(sorted(wa - wb)), " ".join(sorted(wb - wa))
    if both and (not one or not two):
        return 100.0
    common = len(" ".join(both))
    gap = 1 if both else 0
    la, lb = common + gap + len(one), common + gap + len(two)
    apart = len(one) + len(two) - 2 * _common_length(one, two)
    best = 100.0 - 100.0 * apart / (la + lb)
    if not both:
        return best
    return max(best, 100.0 - 100.0 * (gap + len(one)) / (common + la), 100.0 - 100.0 * (gap + len(two)) / (common + lb))


def _common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; one bit for each character of ``a`` (Hyyro, 2004)."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for c in b:
        hit = free & at.get(c, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def token_set_ratio(a: Column, b: Column, fold: bool = False) -> Column:
    """0 to 100: how alike two names are by their sets of words. Letters' case and punctuation count, but for ``fold``; a null name gives null, one without words 0."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else _set_ratio(p, q) for p, q in zip(x, y)], index=x.index, dtype="float64")

    plain = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")) if fold else c
    return run(plain(a), plain(b))
