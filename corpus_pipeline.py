"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Toxic documents go, then those without a language; boilerplate lines are taken out; one document of each group of near-duplicates stays; what is left is
packed into training sequences. The models of the first two stages are fitted on the labelled rows of the stage's own input that aren't held out.

Every stage takes a table of the columns of documents, whatever its rows: none, repeated ones, nulls in any column and extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeleaf.llm import language, line_dedup, packing, similar_texts, toxicity
from lakeleaf.llm.runtime import scratch, small_batches, table_path, unused, vocabulary, written

#: Documents whose language is at least as sure as this stay. A winner of all its duels scores 0.25 or more, so in effect the stage rejects only texts without
#: letters: those of a language that was not learned, and gibberish with a letter, stay.
LEAST_LANGUAGE_SCORE = 0.05
WORD_VOCABULARY = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't predicted toxic. A null or empty text is not."""
    labels = small_batches(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose text has a language that could be learned; those without a letter go, null and empty texts too."""
    small_batches(spark)
    return language.keep_identified(docs, language.fit(docs), LEAST_LANGUAGE_SCORE)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source; n_chars counts what is left."""
    clean = line_dedup.drop_boilerplate(docs, counts=False)
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that share four in five of their five-word shingles, whatever its doc_id: the row of the smallest doc_id (nulls last), and of those the first one.

    The operator's fingerprints and trie join propose pairs, an exact filter those that are more bits apart, and all are compared in full: no pair is missed."""
    small_batches(spark)
    (row,) = unused(docs, "row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows", compression="zstd")
    groups = similar_texts.near_duplicates(rows.select(row, "text"), id_col=row)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    heads = rows.select(row, "doc_id").join(groups, row).groupBy("component_id").agg(F.min(order).alias("head")).select(F.col("head.row").alias(row))
    return rows.join(similar_texts.few(heads), row, "left_semi").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences, as packing.pack returns them."""
    small_batches(spark)
    return packing.pack(docs, vocabulary(WORD_VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("line_dedup", drop_lines),
    ("simhash", drop_near_duplicates),
    ("packing", pack),
]

#: The trained stages and the token ids can't be expressed in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = table_path(spark, f"stage-{name}")
        with scratch(spark):  # what the stage wrote for itself goes
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
