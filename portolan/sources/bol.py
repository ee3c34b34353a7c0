"""Bills of lading from (gzipped) CSV."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portolan.schemas import BOL
from portolan.session import materialize

CORRUPT = "_corrupt"


@dataclass
class LoadReport:
    rows_loaded: int
    rows_rejected: int
    first_rejected: str | None
    multi_line: bool
    warnings: list[str] = field(default_factory=list)


def _read(spark: SparkSession, path: str | list[str], multi_line: bool) -> DataFrame:
    schema = T.StructType([*BOL.fields, T.StructField(CORRUPT, T.StringType())])
    raw = spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', nullValue="NULL", emptyValue="", mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, multiLine=multi_line, dateFormat="yyyy-MM-dd", enforceSchema=True)
    cols = [F.when(F.col(f.name).isin("", "NULL"), None).otherwise(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in BOL.fields]
    return raw.select(*cols, CORRUPT)


HEAD = 100_000


def _breaks_early(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether one of the first lines is half a quoted record, on which a reader of lines would fail."""
    lines = spark.read.text(path).limit(HEAD).filter(F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*BOL.fields, T.StructField(CORRUPT, T.StringType())])
    one = F.from_csv("value", kind, {"quote": '"', "escape": '"', "nullValue": "NULL", "emptyValue": "", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "dateFormat": "yyyy-MM-dd"})
    return bool(lines.filter(F.col("value") != ",".join(BOL.names)).select(one.alias("r")).filter(F.col(f"r.{CORRUPT}").isNotNull()).take(1))


def load_bol(spark: SparkSession, path: str | list[str], partitions: int | None = None, warn_above: float = 0.01) -> tuple[DataFrame, LoadReport]:
    """The records of the files, with ``ingested_at``, and a report of what was rejected.

    A gzip file is read by one task, so rows that come in fewer pieces are
    spread over ``partitions`` right after. Records that don't fit are counted and left out. Where they
    are more than ``warn_above`` of all and look like broken-up quoted lines,
    the files are read again with multi-line records, and the better of both
    readings is kept. Where such lines are among the first, multi-line records
    are read first, and if none of them is rejected no other reading is better.
    """

    def attempt(multi_line: bool) -> tuple[DataFrame, LoadReport]:
        raw = _read(spark, path, multi_line)
        few = partitions and raw._jdf.queryExecution().toRdd().getNumPartitions() < partitions
        raw = materialize(raw.repartition(partitions) if few else raw, "bol-load")
        bad = F.col(CORRUPT).isNotNull()
        r = raw.agg(F.count_if(~bad), F.count_if(bad), F.min(F.when(bad, F.col(CORRUPT))), F.count_if(bad & (F.length(F.regexp_replace(F.col(CORRUPT), '[^"]', "")) % 2 == 1))).first()
        report = LoadReport(r[0], r[1], r[2], multi_line)
        report.broken_quotes = r[3]
        return raw.filter(~bad).drop(CORRUPT), report

    first = attempt(True) if _breaks_early(spark, path) else None
    if first and not first[1].rows_rejected:
        return first[0].withColumn("ingested_at", F.localtimestamp()), first[1]
    df, report = attempt(False)
    if report.broken_quotes or report.rows_rejected > warn_above * max(1, report.rows_loaded + report.rows_rejected):
        again, second = first or attempt(True)
        if second.rows_rejected < report.rows_rejected:
            df, report = again, second
    share = report.rows_rejected / max(1, report.rows_loaded + report.rows_rejected)
    if share > warn_above:
        report.warnings.append(f"{report.rows_rejected} rows rejected ({share:.1%})")
    return df.withColumn("ingested_at", F.localtimestamp()), report


def load_profile(df: DataFrame) -> DataFrame:
    """One row: row count, shares of non-null key columns, first and last date."""
    share = lambda c: (F.count(c) / F.nullif(F.count("*"), F.lit(0))).alias(f"{c}_share")
    return df.agg(F.count("*").alias("n_rows"), *[share(c) for c in ("identifier", "shipper_party_name", "consignee_name", "text", "harmonized_number", "harmonized_value")], F.min("trade_update_date").alias("first_date"), F.max("trade_update_date").alias("last_date"))
