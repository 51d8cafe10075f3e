"""Documents to training ids: five stages, each on all that the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's docs. Null values in any
column, repeated rows and further columns are allowed; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionrank.llm import common, mixing, pii, setjoin, toxicity
from sessionrank.llm import piece as pieces
from sessionrank.llm.queries import PIECES, tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out what scores as toxic; without labels of both classes nothing goes. Null and empty texts are scored as empty."""
    common.tuned(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _documents(toxicity.keep_clean(docs, toxicity.fit(docs, labels)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near duplicates; rows without an id or without words all stay."""
    common.tuned(spark)
    return _documents(setjoin.first_of_groups(docs))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and what reveals it; n_chars follows the new text. Null and empty texts hold nothing to replace."""
    common.tuned(spark)
    return _documents(pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("bigint")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws sources to their targets; a document drawn twice stands twice, all in order of shard and draw. Null sources are one source; null and empty texts have size 0."""
    common.tuned(spark)
    drawn = mixing.mix(docs)
    return _documents(drawn.repartition("__shard", F.pmod("__order", F.lit(64))).sortWithinPartitions("__shard", "__order"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with their number and checksum; null and empty texts have no ids."""
    common.tuned(spark)
    made = pieces.encode(docs, tokenizer(PIECES))
    return made.select(
        "doc_id", "lang", "source", "ids",
        F.size(F.coalesce("ids", F.array().cast("array<int>"))).cast("bigint").alias("n_tokens"),
        F.crc32(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary")).alias("ids_crc32"),
    )


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("personal_data", private), ("mixing", mixed), ("pieces", encoded)]

# Compression distances, hashes and tokens are beyond SQL; the stages are tested against plain versions in tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
