"""Shared helpers: tables, Arrow row-local maps, checkpoints, bounded training samples."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_text(docs: DataFrame) -> DataFrame:
    """Only what a scan needs; every other column, whatever its name, stays out of the plan."""
    return docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))


def wrapped(docs: DataFrame) -> DataFrame:
    """``text`` as it goes to Python, once, and all other columns, whatever their names, in ``row``."""
    others = [F.col(f"`{n}`") for n in docs.columns if n != "text"]
    return docs.select((F.struct(*others) if others else F.lit(0)).alias("row"), F.col("text").cast("string").alias("text"))


def unwrapped(rows: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` from what ``wrapped`` made of it."""
    kind = like.schema["text"].dataType
    return rows.select(*[F.col("text").cast(kind).alias(n) if n == "text" else F.col("row").getField(n).alias(n) for n in like.columns])


def crc_mod(doc_id: Column, m: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(m))


def append_columns(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]], fields: list[T.StructField]) -> DataFrame:
    """Adds columns computed from whole Arrow batches; no row moves.

    ``make`` runs once per task and returns the batch function. A new field replaces an input column of its name.
    """
    names = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType(kept + fields)
    order = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        each = make()
        for batch in batches:
            new = each(batch)
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in order] + list(new), names=order + [f.name for f in fields])
            del batch, new
        del each
        release()

    return df.mapInArrow(run, schema)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; one is set only where none is, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or f"{tempfile.gettempdir()}/checkpoints")  # one machine: its own folder is shared
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage: the rows are written to and read from the shared checkpoint folder."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/t{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.parquet(path)
    out.written_to = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote and nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_KEPT: dict = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What tasks of one operator share in a Python worker, until a task of another operator calls ``release``."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Drops what other operators kept and gives freed memory back to the system: Python workers live on for later tasks."""
    _KEPT.clear()
    trim()


def trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries keep their own counsel
        ctypes.CDLL(None).malloc_trim(0)


def sample_ids(labelled: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` of the rows by a hash of doc_id: a bounded sample without a global sort."""
    n = labelled.count()
    share = min(1.0, rows / max(n, 1))
    return labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))


def bounded_texts(found: DataFrame, rows: int, chars: int) -> list:
    """[(text, label)] of at most ``rows`` of the rows (text, label) and at most ``chars`` characters (one text at least), in order.

    Equal rows count once. The rows come in the order of a hash, so long texts are as likely as short ones: they only leave room for fewer rows.
    """
    found = found.withColumn("place", F.xxhash64("text", "label"))
    first = found.select("place", F.length("text").alias("size")).distinct().orderBy("place", "size").limit(rows).collect()
    last, held = None, 0
    for r in first:
        held += r["size"]
        if last is not None and held > chars:
            break
        last = r["place"]
    if last is None:
        return []
    return sorted((r["text"], r["label"]) for r in found.where(F.col("place") <= last).select("text", "label").distinct().collect())


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, rows: int, keep: Column, chars: int) -> list:
    """A bounded labelled sample as [(text, label)]: at most ``rows`` texts of ``chars`` characters in all.

    Only labels whose doc_id satisfies ``keep`` are read; a doc_id labelled twice counts once, with its larger label.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & keep)
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    chosen = sample_ids(ids, rows)
    texts = doc_text(docs).where(F.col("text").isNotNull() & keep)
    return bounded_texts(texts.join(F.broadcast(chosen), "doc_id").select("text", "label"), rows, chars)
