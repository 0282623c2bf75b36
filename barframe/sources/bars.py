"""Bar tables: symbol, time, open, high, low, close, volume; ticks are aggregated, files are read as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barframe.na import clean

PRICES = ("open", "high", "low", "close", "volume")
BAR = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("time", T.TimestampNTZType()), *[T.StructField(c, T.DoubleType()) for c in PRICES]])


def read(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Bars from Parquet, ORC, CSV or JSON files with the columns of a bar; NaN becomes NULL."""
    reader = spark.read.format(fmt).options(**options)
    rows = (reader if fmt in ("parquet", "orc") else reader.schema(BAR)).load(path)
    return rows.select("symbol", F.col("time").cast("timestamp_ntz").alias("time"), *[clean(c).alias(c) for c in PRICES])


def from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Bars given as (symbol, datetime, open, high, low, close, volume)."""
    return spark.createDataFrame(rows, BAR)


def write(bars: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    bars.write.format(fmt).mode(mode).save(path)


def from_ticks(ticks: DataFrame, symbol: Column, time: Column, price: Column, tie: Column, width: str, volume: Column | None = None, start: str | None = None) -> DataFrame:
    """Ticks to bars of a fixed width; ``tie`` orders ticks of one instant. Partial aggregation, one exchange."""
    w = F.window(time, width, startTime=start) if start else F.window(time, width)
    key = F.struct(time, tie)
    return (
        ticks.groupBy(symbol.alias("symbol"), w.alias("w"))
        .agg(
            F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"),
            (F.count(F.lit(1)) if volume is None else F.sum(volume)).cast("double").alias("volume"),
        )
        .select("symbol", F.col("w.start").alias("time"), *PRICES)
    )


def event_bars(spark: SparkSession, sf_dir: str, width: str = "1 hour") -> DataFrame:
    """Hourly bars of event values by type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return from_ticks(e, F.col("event_type"), F.col("ts"), F.col("value"), F.col("event_id"), width)


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order prices by priority."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return from_ticks(o, F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"), "1 day")


def tick_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a bar of its own, by user: many symbols."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    v = F.col("value")
    return e.select(F.col("user_id").cast("string").alias("symbol"), F.col("ts").alias("time"), v.alias("open"), v.alias("high"), v.alias("low"), v.alias("close"), F.lit(1.0).alias("volume"))
