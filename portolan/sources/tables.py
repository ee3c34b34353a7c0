"""Writing tables: rebuild, upsert, append; and seeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from portolan.operators.relational import anti_by, latest_by
from portolan.session import new_table_path

LAYERS = ("raw", "bronze", "silver", "gold", "semantic")


def create_layers(spark: SparkSession) -> None:
    for name in LAYERS:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    _recover(spark, fs, path)
    if not fs.exists(p):
        return None
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # a folder without files yet
        return None


def _recover(spark: SparkSession, fs, path: str) -> None:
    """Put back the old table where a writer ended between the two moves of ``replace_table``."""
    at, aside = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path.rstrip('/')}.before"))
    if fs.exists(aside) and not fs.exists(at):
        fs.rename(aside, at)


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write to a new folder, move the old one aside, and put the new in its place; the old may be an input.

    Between the two moves there is no table for a moment. A writer that ends
    just then leaves the old one aside, and the next ``read_if_exists`` or
    ``replace_table`` puts it back; one that ends before leaves the old table
    as it was. Two writers at once aren't supported.
    """
    spark = df.sparkSession
    staging = f"{path.rstrip('/')}.{new_table_path(spark, 'x').rpartition('-')[2]}"
    df.write.partitionBy(*partition_by).parquet(staging)
    jvm = spark._jvm.org.apache.hadoop.fs
    at, new = jvm.Path(path), jvm.Path(staging)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    _recover(spark, fs, path)
    aside = jvm.Path(f"{path.rstrip('/')}.before")
    fs.delete(aside, True)  # left by a writer that ended after both moves
    if fs.exists(at) and not fs.rename(at, aside):
        raise OSError(f"{path} couldn't be moved aside")
    if not fs.rename(new, at):
        fs.rename(aside, at)
        raise OSError(f"{staging} couldn't be moved to {path}")
    fs.delete(aside, True)
    spark.catalog.refreshByPath(path)
    return spark.read.parquet(path)


def upsert(new: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace those of the same key, or are added; null is a key like others. ``new`` has one row per key."""
    old = read_if_exists(new.sparkSession, path)
    if old is not None:
        new = anti_by(old, new, keys, null_safe=True).unionByName(new, allowMissingColumns=True)
    return replace_table(new, path)


def upsert_latest(new: DataFrame, path: str, keys: Sequence[str], latest: str) -> DataFrame:
    """The latest row of each key among the stored ones and ``new``: what comes late but is older replaces nothing."""
    old = read_if_exists(new.sparkSession, path)
    if old is not None:
        new = old.unionByName(new, allowMissingColumns=True)
    return replace_table(latest_by(new, keys, latest), path)


def append_new(new: DataFrame, path: str, keys: Sequence[str], compute=None, partition_by: Sequence[str] = (), unique: bool = False) -> DataFrame:
    """Append what isn't there yet by key; ``compute`` is applied to those rows alone, so costly columns are made once per key.

    Null is a key like others, so a batch that comes twice adds nothing. ``unique``: new rows are known to have different keys. A table whose columns no longer are those of the new rows is refused, not
    silently widened.
    """
    spark = new.sparkSession
    old = read_if_exists(spark, path)
    fresh = new if unique else new.dropDuplicates(list(keys))
    if old is not None:
        fresh = anti_by(fresh, old, keys, null_safe=True)
    if compute:
        fresh = compute(fresh)
    if old is not None and sorted(old.columns) != sorted(fresh.columns):
        raise ValueError(f"{path} has columns {sorted(old.columns)}, new rows have {sorted(fresh.columns)}")
    fresh.write.mode("append").partitionBy(*partition_by).parquet(path)
    spark.catalog.refreshByPath(path)
    return spark.read.parquet(path)


def read_seed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV with a header and given types; codes keep their leading zeros. Empty fields are null."""
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', mode="FAILFAST", dateFormat="yyyy-MM-dd")


def load_summary(tables: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """One row per table: name, rows, first and last value of its date column."""
    parts = []
    for name, (df, date) in tables.items():
        d = F.col(date).cast("string") if date else F.lit(None).cast("string")
        parts.append(df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), F.min(d).alias("first_value"), F.max(d).alias("last_value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
