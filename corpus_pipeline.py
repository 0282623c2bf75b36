"""A corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir), where docs is what its predecessor kept, and returns the columns of documents;
the last returns the packed pieces. ``run`` writes every stage as Parquet to the shared checkpoint folder and rereads it.

In every stage rows with a null or empty text stay (they hold nothing that a stage looks for), very long texts are read whole, rows without
a doc_id stay as their own, and further columns, whatever their names, are kept as they are. Repeated rows get one decision each, but for near copies:
of rows that are linked or equal the one with the smallest doc_id stays, of equal rows of that id one. Two different texts under one id are judged
each by itself. Of ties in a score all rows share the decision. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barframe.llm import common, decontaminate, jaccard, packing, pii, queries, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the threshold go."""
    labels = common.table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, F.lit(True))
    return toxicity.reject(docs, model)


#: Near copies, as stages on word shingles take them; op9_jaccard has its own contract.
COPY_WORDS, COPY_SIMILARITY = 5, 80


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links of 5-word shingles and similarity 0.8 connect, the one with the smallest id stays."""
    return jaccard.keep_one(docs, words=COPY_WORDS, similarity=COPY_SIMILARITY)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def sanitise_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that give it away are replaced in the texts."""
    return pii.sanitise(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of nearly equal length."""
    return packing.pack(docs, *queries.tokenizer_files())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("personal_data", sanitise_personal_data),
    ("packing", pack_windows),
]

#: Training, tokenising and differencing are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))
    return common.cut(STAGES[-1][1](spark, docs, sf_dir))
