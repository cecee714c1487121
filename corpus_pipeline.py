"""The training-corpus pipeline: toxicity, language, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the shared folder
and reads it back as the next stage's docs.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelframe.llm import langid, mixing, nearcopies, packing, toxicity
from reelframe.llm.common import fresh, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score stays below the threshold, by a classifier learned on this stage's labelled input.

    Null and empty texts get the score of no evidence, the base rate; repeated rows share one fate.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score, flag = fresh(docs.columns, "score"), fresh(docs.columns, "predicted")
    scored = toxicity.score(docs, model, docs.columns, score_col=score, predicted_col=flag)
    return scored.filter(F.col(flag) == 0).select(*docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a letter and a score for its likeliest language not below the model's floor.

    The floor is validated within the training rows, none of which would go.  Null and empty texts have no language; if no
    row has one to learn from, no row stays.  Repeated rows share one fate.
    """
    lang, score = fresh(docs.columns, "lang_pred"), fresh(docs.columns, "lang_score")
    model = langid.fit(docs, with_floor=True)
    found = langid.predict(docs, model, docs.columns, lang_col=lang, score_col=score)
    return found.filter((F.col(lang) != "und") & (F.col(score) >= model.floor)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component: that of its smallest doc_id, of the smallest text hash if several have it.

    Rows are told apart by id and text, so rows with null or repeated ids stay if they are alone in their component.  Equal
    rows are reduced to one before texts are shuffled; texts are shuffled once.
    """
    keys = [fresh(docs.columns, "id_"), fresh(docs.columns, "no_id_"), fresh(docs.columns, "text_hash_")]
    by = lambda text: [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(keys[0]), F.col("doc_id").isNull().alias(keys[1]), text.alias(keys[2])]
    keep = materialize(nearcopies.first_rows(docs).select(*by(F.col("t"))), "keep")
    place = fresh(docs.columns, "place_")
    first = F.row_number().over(W.partitionBy(*keys).orderBy(keys[2]))
    rows = docs.select("*", *by(nearcopies.text_hash())).withColumn(place, first).filter(F.col(place) == 1)
    return rows.join(keep, keys, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mixture takes them; null and empty texts are not taken, equal rows share their copies."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and offset; a null or empty text is one piece, repeated rows repeat."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned models, hashes and a tokenizer decide, which SQL cannot express; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
