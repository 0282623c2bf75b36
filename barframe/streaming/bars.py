"""The live path: ticks to bars and incremental indicators on Structured Streaming.

Confirmed bars leave in append mode once the watermark closes their window. The indicators of a closed bar come from per-symbol state
that holds each indicator's last output, so a stream gives what the batch gives. Bars that repaint with every tick are in ``live``.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barframe.operators import recursive as R


def tick_stream(spark, folder: str, names: str = "*.parquet", **options) -> DataFrame:
    """The Parquet files of a folder that match ``names``, as a stream with the files' own schema."""
    kind = spark.read.option("pathGlobFilter", names).parquet(folder).schema
    return spark.readStream.schema(kind).options(pathGlobFilter=names, **options).parquet(folder)


def stream_bars(ticks: DataFrame, symbol: Column, time: Column, price: Column, tie: Column, width: str, late: str = "10 minutes") -> DataFrame:
    """OHLCV windows over a watermarked stream; late ticks within ``late`` still count."""
    staged = ticks.select(symbol.alias("symbol"), time.cast("timestamp").alias("ts"), price.alias("price"), tie.alias("tie")).withWatermark("ts", late)
    key = F.struct("ts", "tie")
    return (
        staged.groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
        .select("symbol", F.col("w.start").alias("time"), "open", "high", "low", "close", "volume")
    )


def sessions(ticks: DataFrame, symbol: Column, time: Column, price: Column, gap: str, late: str = "10 minutes") -> DataFrame:
    """Activity sessions that end after a gap."""
    staged = ticks.select(symbol.alias("symbol"), time.cast("timestamp").alias("ts"), price.alias("price")).withWatermark("ts", late)
    return staged.groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("ticks"), F.sum("price").alias("total")).select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "ticks", "total")


def with_state(bars: DataFrame, ema: tuple[int, ...] = (), rma: tuple[int, ...] = ()) -> DataFrame:
    """A stream of closed bars (such as ``stream_bars`` wrote) with ema and rma of the close, continued from each symbol's state."""
    names = [f"ema{n}" for n in ema] + [f"rma{n}" for n in rma]
    schema = "symbol string, time timestamp_ntz, close double" + "".join(f", {n} double" for n in names)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else None
        lines = [R.Ema(n) for n in ema] + [R.Rma(n) for n in rma]
        for x, old in zip(lines, kept or []):
            x.__dict__.update({k: R.NAN if v is None else v for k, v in old.items()})
        rows = pd.concat(list(frames)).sort_values("time", kind="stable")
        out = pd.DataFrame({"symbol": key[0], "time": rows["time"].to_numpy(), "close": rows["close"].to_numpy()})
        for n, x in zip(names, lines):
            out[n] = [None if (y := x(float(v))) != y else y for v in rows["close"]]
        state.update((json.dumps([{k: None if v != v else v for k, v in x.__dict__.items()} for x in lines]),))
        yield out

    return bars.groupBy("symbol").applyInPandasWithState(step, schema, "state string", "append", "NoTimeout")


def shared_folder(spark) -> str:
    """A fresh folder below the one that driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared or tempfile.gettempdir() + '/checkpoints'}/stream-{uuid.uuid4().hex}"


def replay(stream: DataFrame) -> DataFrame:
    """Runs a bounded append stream to its end through a file sink and gives what it wrote."""
    spark = stream.sparkSession
    at = shared_folder(spark)
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
