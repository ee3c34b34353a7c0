"""Line-first document cleaning.

Every line is held against punctuation, navigation and boilerplate rules; the
lines that fail go, and a document that loses too large a part of its text to
them goes as a whole. One narrow projection: no shuffle and no Python.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Written so that Java's and RE2's regular expressions read them alike.
TERMINAL = r"""[.!?…:;]["'”’»)\]]*$"""
SENTENCE = r"""[.!?…]["'”’»)\]]* """
SYMBOLS = r"[#$%&*|<>{}\[\]\\^~_=+@]"
NAVIGATION = r"(?i)( \| .* \| | » .* » | > .* > | · .* · )|^(home|menu|next|previous|prev|back|login|log in|sign in|sign up|share|search|contact us|about us|skip to content|read more|back to top)$"
BOILERPLATE = (
    r"(?i)(all rights reserved|copyright (\(c\)|©|[0-9])|licensed under|released under the|privacy policy|terms of (use|service)|cookie (policy|settings)"
    r"|accept (all )?cookies|we use cookies|subscribe to our|click here|enable javascript|javascript is disabled|powered by|lorem ipsum)"
)
LETTERS = r"[^\p{L}]"


def line_passes(line: Column, max_symbols: float, max_repeats: float, repeat_from: int) -> Column:
    """Whether a trimmed line that isn't blank stays.

    Punctuation: it ends a sentence, or has one ended inside; symbols are at
    most ``max_symbols`` of its characters; it isn't written in capitals with
    an exclamation mark or throughout five words or more. Navigation: no row
    of links or bare menu word. Boilerplate: no stock phrase; of
    ``repeat_from`` words or more, at most ``max_repeats`` equal the word
    before.
    """
    # Cheap tests that settle most lines come first, patterns only where these leave it open: And and Or stop at what decides them.
    n_words = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    ended = _any(line.endswith(x) for x in ".!?…:;") | line.rlike(TERMINAL) | line.rlike(SENTENCE)
    shouted = (F.upper(line) == line) & (F.lower(line) != line) & ((n_words >= 5) | line.contains("!!")) & (F.length(F.regexp_replace(line, LETTERS, "")) >= 4)
    navigation = ((F.length(line) <= _MENU_CHARS) | _any(line.contains(x) for x in _RULERS)) & line.rlike(NAVIGATION)
    boilerplate = _with(F.lower(line), lambda low: _any(low.contains(x) for x in _STOCK)) & line.rlike(BOILERPLATE)
    return (
        ended
        & (F.length(F.regexp_replace(line, SYMBOLS, "")) >= F.length(line) * F.lit(1.0 - max_symbols))
        & ~shouted
        & ~navigation
        & ~boilerplate
        & ((n_words < repeat_from) | _with(F.split(line, " ", -1), lambda words: _few_repeats(words, max_repeats)))
    )


#: Without one of these, or of so few characters (those of the longest menu word, and line ends), nothing is navigation.
_RULERS, _MENU_CHARS = (" | ", " » ", " > ", " · "), 20
#: Each stock phrase of BOILERPLATE has one of these in it.
_STOCK = ("reserved", "copyright", "ed under", "privacy policy", "terms of ", "cookie", "subscribe to our", "click here", "javascript", "powered by", "lorem ipsum")


def _any(tests: Iterable[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, tests)


def _with(value: Column, test: Callable[[Column], Column]) -> Column:
    """``test`` of a value that is computed once, however often the test uses it."""
    return F.exists(F.array(value), test)


def _few_repeats(words: Column, most: float) -> Column:
    """At most that part of the words equals the word before. There are no more such words than there are words less different ones."""
    repeats = F.filter(F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: a == b), lambda x: x)
    return (F.size(words) - F.size(F.array_distinct(words)) <= F.size(words) * F.lit(most)) | (F.size(repeats) <= F.size(words) * F.lit(most))


def clean_lines(
    docs: DataFrame, text: str = "text", n_chars: str = "n_chars", max_lost: float = 0.5, max_symbols: float = 0.1, max_repeats: float = 0.5, repeat_from: int = 10
) -> DataFrame:
    """The documents that keep enough text, with the failing lines taken out.

    ``max_lost``: the part of a document's characters (of lines that aren't
    blank, trimmed) that may go before the document does. The columns are those
    of ``docs``, with ``text`` replaced and, if there is one, ``n_chars``
    recounted.

    Lines end at a line feed and are trimmed of spaces, carriage returns and
    tabs; blank lines go without counting as lost. A null, empty or blank text
    has nothing to keep and is rejected. A text of any length is judged whole.
    Repeated rows are each judged alike and all stay; other columns, null or
    not, are passed on; an empty table gives an empty table.
    """
    names = list(docs.columns)
    # The lines are computed once: without the array of both sums, Spark would evaluate the rules for each use.
    trimmed = F.filter(F.transform(F.split(F.col(text), "\n", -1), lambda x: F.trim(x, F.lit(" \t\r"))), lambda x: F.length(x) > 0)
    kept = F.filter(trimmed, lambda x: line_passes(x, max_symbols, max_repeats, repeat_from))
    total = F.aggregate(trimmed, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    left = F.aggregate(F.col("v.kept"), F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    staged = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.struct(kept.alias("kept"), total.alias("total")).alias("v"))
    # explode of a one-element array is a barrier: later uses of v read its value instead of computing it again.
    staged = staged.select("row", F.explode(F.array("v")).alias("v"))
    passed = staged.filter((F.col("v.total") > 0) & (left > 0) & (left >= F.col("v.total") * F.lit(1.0 - max_lost)))
    out = passed.select("row", F.array_join("v.kept", "\n").alias("new"))
    cols = []
    for c in names:
        if c == text:
            cols.append(F.col("new").alias(c))
        elif c == n_chars:
            cols.append(F.length("new").cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col("row").getField(c).alias(c))
    return out.select(*cols)


def clean_lines_sql(table: str = "documents", max_lost: float = 0.5, max_symbols: float = 0.1, max_repeats: float = 0.5, repeat_from: int = 10) -> str:
    """The same for DuckDB over a table like ``documents``."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    return f"""
    WITH lines AS (
      SELECT doc_id, lang, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: length(x) > 0) AS ls FROM {table}
    ), judged AS (
      SELECT *, list_filter(ls, lambda x:
          (regexp_matches(x, {q(TERMINAL)}) OR regexp_matches(x, {q(SENTENCE)}))
          AND length(regexp_replace(x, {q(SYMBOLS)}, '', 'g')) >= length(x) * {1.0 - max_symbols}::DOUBLE
          AND NOT (length(regexp_replace(x, {q(LETTERS)}, '', 'g')) >= 4 AND upper(x) = x AND lower(x) <> x AND (len(string_split(x, ' ')) >= 5 OR contains(x, '!!')))
          AND NOT regexp_matches(x, {q(NAVIGATION)})
          AND NOT regexp_matches(x, {q(BOILERPLATE)})
          AND (len(string_split(x, ' ')) < {repeat_from} OR len(list_filter(list_zip(string_split(x, ' '), string_split(x, ' ')[2:], true), lambda p: p[1] = p[2])) <= len(string_split(x, ' ')) * {max_repeats}::DOUBLE)) AS kept
      FROM lines
    ), counted AS (
      SELECT *, coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0) AS total, coalesce(list_sum(list_transform(kept, lambda x: length(x))), 0) AS remain FROM judged
    )
    SELECT doc_id, array_to_string(kept, chr(10)) AS text, lang, source, length(array_to_string(kept, chr(10)))::BIGINT AS n_chars
    FROM counted WHERE total > 0 AND remain > 0 AND remain >= total * {1.0 - max_lost}::DOUBLE"""
