"""The corpus pipeline: its stages in order, each one operator of callweave.llm."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import dedup, packing, pii, quality, simhash
from callweave.llm.common import free_name, passing, row_key, ship, without, written


#: Bytes of words that a worker remembers while packing; fewer than elsewhere, as executors still hold what the stages before needed.
TABLE_BYTES = 48 << 20


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, with its hosts' and paths' posteriors, keeps; all columns stay.

    Null texts count as empty; null sources and languages are a host and a path like others. Rows that repeat are judged alike, rows
    that repeat an id each by their own text. No rows give no rows.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    key, name = row_key(more=("source", "lang")), free_name(docs, "key")
    judged = quality.judge(docs.select("text", "source", "lang", key.alias(name)), model, F.col("source"), F.col("lang"), carry=[name])
    return without(docs, judged.where("not kept").select(f"row.{name}"), key)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: the one with the smallest doc_id, and of rows that repeat id and text the least by its other columns.

    Null texts count as empty; null ids come after all others. All columns stay; no rows give no rows.
    """
    return dedup.one_of_each(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group of near copies (five-word shingles, similarity 0.8); all columns stay.

    Null and wordless texts are alike. Rows without an id come after all others; of different texts with one id the
    least by their hash stays, rows that repeat id and text stay or go together. No rows give no rows.
    """
    with passing(spark):
        groups = simhash.similar_groups(docs, size=5, similarity=0.8, tag=row_key())
        return without(docs, groups.where("not kept").select("tag"), row_key())


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind, and n_chars, where there is such a column, as it is then.

    Null texts stay null, with n_chars null; null and repeated ids are rows like others. No rows give no rows.
    """
    found = pii.redact(docs)
    kind = dict(docs.dtypes).get("n_chars")
    return found.withColumn("n_chars", F.length("text").cast(kind)) if kind else found


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences of at most 2048.

    Null texts count as empty and have the end id alone; null and repeated ids are rows like others. No rows give no rows.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1, table_bytes=TABLE_BYTES)


STAGES = [("quality", good_quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("personal_data", personal_data), ("packing", packed)]
#: Models and tokenizers can't be written as SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each to what the one before has written."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
