"""The tariff schedule from a JSON list."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portolan.session import materialize, ship_code

_RAW = T.StructType([T.StructField(c, T.StringType()) for c in ("htsno", "description", "indent", "units", "general", "special", "other", "footnotes")])
_DEEP = 1 << 40
#: What may stand before the first object of a list, between two, and after the last.
_FIRST, _NEXT, _LAST = (re.compile(rf"[ \t\r\n]*{x}[ \t\r\n]*") for x in (r"\[", ",", r"\]"))


def _scan(piece: str, inside: bool) -> tuple[bool, int]:
    """Whether a string is open after ``piece``, and by how many brackets outside of strings it goes deeper; ``inside``: a string is open before it."""
    parts = (re.sub(r"\\.", "", piece, flags=re.S) if "\\" in piece else piece).split('"')
    code = "".join(parts[inside::2])
    return bool(inside ^ (len(parts) % 2 == 0)), code.count("{") + code.count("[") - code.count("]") - code.count("}")


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, str, bool]]:
    """(file, block, piece, whether it is its block's last) of rows that lie block by block."""
    held = None
    for b in batches:
        for row in zip(b["file"], b["start"], b["value"]):
            if held:
                yield *held, held[:2] != row[:2]
            held = row
    if held:
        yield *held, True


def _depths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each block, and for either state of strings before it: the state after it, how much deeper it goes, and its least depth after a closing bracket. The one that may follow its last piece isn't counted."""
    rows, now = [], None
    for file, start, piece, last in _blocks(batches):
        now = now or [[False, 0, _DEEP], [True, 0, _DEEP]]
        for state in now:
            state[0], more = _scan(piece, state[0])
            state[1] += more
            if not last and not state[0]:
                state[1] -= 1
                state[2] = min(state[2], state[1])
        if last:
            rows.append((file, start, *now[0], *now[1]))
            now = None
    yield pd.DataFrame(rows, columns=["file", "start", "s0", "d0", "m0", "s1", "d1", "m1"])


def _list_records(spark: SparkSession, path: str) -> DataFrame | None:
    """(text) of the objects of files that are lists of objects; none, if they are something else.

    A list is one value, so a plain reader keeps one task busy with it. Here
    tasks read blocks of the file, cut after closing brackets. A block doesn't
    know how deep it begins; so a first job tells by how much each goes deeper,
    from which the driver adds up where each begins. What lies across the
    border of blocks is put together again by the block where it began.
    """
    pieces = spark.read.text(path, lineSep="}").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    begin, file, depth = {}, None, 0
    found = sorted(pieces.mapInPandas(_depths, "file string, start long, s0 boolean, d0 long, m0 long, s1 boolean, d1 long, m1 long").collect(), key=lambda r: (r["file"], r["start"]))
    for i, r in enumerate(found):  # a row for each block
        if r["file"] != file:
            if depth:
                return None
            file, inside, depth, owner = r["file"], False, 0, r["start"]
        final = i + 1 == len(found) or found[i + 1]["file"] != file
        begin[(file, r["start"])] = inside, depth, owner, final
        after, more, least = (r["s1"], r["d1"], r["m1"]) if inside else (r["s0"], r["d0"], r["m0"])
        if not final and not after:
            more -= 1
            least = min(least, more)
        if (depth <= 1 and not inside) or depth + least <= 1:  # what is open at its end began in this block
            owner = r["start"]
        inside, depth = after, depth + more
    if depth or not found:
        return None

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held, now = [], [], None
        for name, start, piece, last in _blocks(batches):
            if now is None:
                inside, depth, owner, final = begin[(name, start)]
                crossing, now = depth > 1 or inside, (name, start)
            ends, text = final and last, piece
            if depth <= 1 and not inside:
                at = len(piece) if ends else piece.find("{")
                if not (_LAST if ends else _FIRST if depth == 0 else _NEXT).fullmatch(piece[:at] if at >= 0 else "?"):
                    rows.append((name, -1, start, None))  # no list of objects
                text = piece[at:]
            inside, more = _scan(piece, inside)
            depth += more
            if not ends:
                held.append(text)
                held.append("}")
                depth -= not inside
                if depth <= 1 and not inside:
                    rows.append((name, owner if crossing else None, start, "".join(held)))
                    held, crossing = [], False
            if last:
                if held:
                    rows.append((name, owner if crossing else start, start, "".join(held)))
                held, now = [], None
            if len(rows) >= 2000:
                yield pd.DataFrame(rows, columns=["file", "owner", "start", "text"]).astype({"owner": "Int64"})
                rows = []
        yield pd.DataFrame(rows, columns=["file", "owner", "start", "text"]).astype({"owner": "Int64"})

    rows = materialize(pieces.mapInPandas(cut, "file string, owner long, start long, text string"), "json-records")
    if rows.filter("owner = -1").limit(1).count():
        return None
    across = rows.filter("owner IS NOT NULL").groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("p"))
    return rows.filter("owner IS NULL").select("text").unionByName(across.select(F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text")))


def _read(spark: SparkSession, path: str) -> DataFrame:
    texts = _list_records(spark, path)
    if texts is not None:
        kind = T.StructType([*_RAW.fields, T.StructField("__bad", T.StringType())])
        read = F.from_json("text", kind, {"columnNameOfCorruptRecord": "__bad"})
        df = materialize(texts.select(read.alias("r")).select("r.*"), "json-list")
        if not df.filter("__bad IS NOT NULL").limit(1).count():
            return df.drop("__bad")
    df = spark.read.schema(_RAW).json(path, multiLine=True)  # one value, or broken
    df.take(1)
    return df


def read_hts_json(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The records of the first of ``paths`` that can be read; the others are fallbacks. Lists stay JSON text for ``flatten_hts``."""
    ship_code(spark)
    failed = []
    for path in paths:
        try:
            return _read(spark, path)
        except Exception as e:  # any failure leads to the next path; the last one is raised with all
            failed.append(f"{path}: {str(e)[:200]}")
    raise OSError("no schedule could be read; " + "; ".join(failed))


def flatten_hts(raw: DataFrame) -> DataFrame:
    """One flat row per record: lists joined, prefixes of the number's digits, empty texts null.

    Prefixes of short numbers are as short as these. A footnote is a text or an
    object with a ``value``.
    """
    empty = lambda c: F.nullif(F.trim(c), F.lit(""))
    digits = F.replace(F.trim(F.coalesce("htsno", F.lit(""))), F.lit("."), F.lit(""))
    units = F.array_join(F.from_json("units", "array<string>"), ",")
    notes = F.transform(F.from_json("footnotes", "array<string>"), lambda x: F.coalesce(F.get_json_object(x, "$.value"), F.when(x.startswith("{"), F.lit("")).otherwise(x)))
    prefix = lambda n: F.nullif(F.left(digits, F.lit(n)), F.lit("")).alias(f"hs{n}")
    return raw.select(
        empty(F.col("htsno")).alias("hts_number"), empty(F.col("description")).alias("description"), F.col("indent").try_cast("long").alias("indent"),
        F.nullif(F.coalesce(units, F.col("units")), F.lit("")).alias("units"),
        *[F.nullif(F.col(a), F.lit("")).alias(b) for a, b in (("general", "general_rate_text"), ("special", "special_rate_text"), ("other", "column2_rate_text"))],
        F.nullif(F.array_join(F.filter(notes, lambda x: x != ""), "; "), F.lit("")).alias("footnotes"), *[prefix(n) for n in (2, 4, 6, 8, 10)], F.localtimestamp().alias("ingested_at"),
    )


def load_hts(spark: SparkSession, paths: list[str]) -> DataFrame:
    return flatten_hts(read_hts_json(spark, paths))
