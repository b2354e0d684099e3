"""CSV and Parquet readers and the offline bundle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alphaloom.sources import conform

# Fixed file names of the offline bundle; ``names`` in load_bundle overrides them.
REQUIRED = {
    "constituents": "constituents.csv",
    "valuation": "daily_valuation.csv",
    "financials": "quarterly_financials.csv",
}
OPTIONAL = {"bars": "daily_kline.csv"}


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Header CSV (UTF-8, BOM allowed). Without ``schema`` every column stays text: codes keep
    their leading zeros. Many paths are one scan."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", False).csv(path)
    return df.select(*columns) if columns else df


def read_table(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan of the named columns only."""
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.parquet(*paths)
    return df.select(*columns) if columns else df


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def load_bundle(spark: SparkSession, folder: str, names: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """Conformed tables of an offline bundle: three required files and optional bars.

    Raises ``FileNotFoundError`` naming every required file that is missing.
    """
    files = {**REQUIRED, **OPTIONAL, **(names or {})}
    found = {k: f"{folder}/{v}" for k, v in files.items() if _exists(spark, f"{folder}/{v}")}
    missing = [files[k] for k in REQUIRED if k not in found]
    if missing:
        raise FileNotFoundError(f"missing required files {missing} in {folder}")
    shape = {
        "constituents": conform.constituents,
        "valuation": conform.valuation,
        "financials": conform.financials,
        "bars": conform.daily_bars,
    }
    return {k: shape[k](read_csv(spark, p)) for k, p in found.items()}


def concat_tables(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate per-entity tables by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def slice_rows(df: DataFrame, codes: DataFrame | Sequence[str] | None = None, start: str | None = None, end: str | None = None, date: str = "trade_date") -> DataFrame:
    """Inclusive date range and code list; plain predicates, so they reach the Parquet scan."""
    if start is not None:
        df = df.where(F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(date) <= F.lit(end).cast("date"))
    if isinstance(codes, DataFrame):
        return df.join(codes.select("ts_code"), "ts_code", "left_semi")
    return df.where(F.col("ts_code").isin(list(codes))) if codes is not None else df


def research_universe(components: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct member codes in order, optionally only the first ``limit``."""
    codes = components.select(F.col("con_code").alias("ts_code")).where("ts_code IS NOT NULL").distinct()
    return codes.orderBy("ts_code").limit(limit) if limit and limit > 0 else codes
