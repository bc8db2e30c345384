"""A corpus pipeline: toxic documents go, then near copies, benchmark passages and personal data; the rest is encoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewright.llm.decontaminate import decontaminated
from gaugewright.llm.ngram_join import BROADCAST_IDS, jaccard_components
from gaugewright.llm.pieces import round_trip
from gaugewright.llm.pii import sanitised
from gaugewright.llm.shared import removed, written, written_at
from gaugewright.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below their language's threshold, by a classifier that learns from the labels table.

    A null or empty text has the score of no words; repeated rows stay or go each, alike; without labels of both
    classes all stay unless all labels are toxic; an empty table stays empty; other columns pass through.
    """
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))


def _identified(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that tells rows apart, and its name, which no other column has: doc_id, or for rows without one or with one that others have too, a number below all ids."""
    row, again_ = "row", "again"
    while {row, again_} & {c.lower() for c in docs.columns}:
        row, again_ = f"{row}_", f"{again_}_"
    ids = docs.groupBy("doc_id").count()
    if not ids.where("doc_id is null or count > 1").limit(1).count():
        return docs.withColumn(row, F.col("doc_id")), row
    low = min(0, docs.agg(F.min("doc_id")).first()[0] or 0)
    again = ids.where("doc_id is not null and count > 1").select("doc_id", F.lit(True).alias(again_))
    own = F.when(F.col("doc_id").isNull() | F.col(again_), F.lit(low - 1) - F.monotonically_increasing_id()).otherwise(F.col("doc_id"))
    return written(docs.join(again, "doc_id", "left").withColumn(row, own).drop(again_), "identified"), row


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that 5-word shingles link at a similarity of 0.8, the one with the smallest doc_id.

    Repeated rows are documents of a group, of which one stays, even where they share an id or have none. A null,
    empty or blank text links with nothing, so it stays; an empty table stays empty; other columns, of any
    names, pass through.
    """
    named, row = _identified(docs)
    found = written(jaccard_components(named.select(F.col(row).alias("doc_id"), "text"), n=5, percent=80), "components")
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias(row))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return named.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no run of ten words, and no shorter item, with the benchmark table.

    A null or empty text has no words, so it stays; repeated rows stay or go each, alike; without benchmark
    items all stay; an empty table stays empty; other columns pass through.
    """
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and terms that disclose it, replaced; all stay.

    A null text stays null, an empty one empty; repeated rows are cleaned alike; an empty table stays empty;
    n_chars is counted anew, other columns pass through.
    """
    return sanitised(docs)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and text_sha256, that of the decoded text, for each row.

    A null or empty text has no ids and the hash of the empty text; repeated rows come each, rows without doc_id
    with a null; an empty table gives an empty result; other columns are left out.
    """
    return round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", toxicity), ("ngram_jaccard_join", near_duplicates), ("decontamination", decontamination), ("pii", personal_data), ("sentencepiece", sentence_pieces)]

#: A trained classifier and a Viterbi search are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's are written as Parquet and read again by the next, which then removes them."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = written_at(stage(spark, docs, sf_dir), name)
        if before:
            removed(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
