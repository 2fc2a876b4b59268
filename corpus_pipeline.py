"""From raw documents to packed training sequences, a stage at a time.

Each stage reads what its predecessor kept, decides by its operator and hands
on the columns of ``documents``; the last returns the packed pieces.

Defined results: a document without letters, with a null or empty text, or in no
learned language goes in the first stage; with no labelled language to learn
from, all go. A text whose lines all go stays, empty; rows that repeat a text
are near-duplicates, whatever their ids, and of rows that tie on doc_id the
first stays; a null doc_id stays only where a group has no other. Texts of any
length are read whole; further columns of ``documents`` are ignored, whatever
their names; an empty table passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.llm import language_id, line_dedup, mixing, packing, simhash
from querent.llm.shared import pick, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document is rejected if less than this share of its words' n-grams occurs in the training text of any language.
#: Held-out documents have 0.85 or more, other languages up to 0.73, random letters up to 0.44 (README).
LEAST_FAMILIAR = 0.75

#: Posterior below which a document counts as clean, and the rate from which such a document stays.
CLEAN, STAYS = 0.5, 0.5

#: Language identification, near-duplicates, mixing and packing have no SQL form.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are in one of the learned languages."""
    model = language_id.learn(language_id.training_sample(docs, language_id.bucket(F.col("doc_id")) != 1))
    found = language_id.identify(docs, model, COLUMNS)
    return found.where((F.col("_lang_pred") != language_id.UNKNOWN) & (F.col("_familiar") >= LEAST_FAMILIAR)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops each source's boilerplate lines; every document stays."""
    found = line_dedup.drop_boilerplate(pick(docs, *COLUMNS), F.col("source"), F.col("text"))
    return found.select("doc_id", F.col("_text").alias("text"), "lang", "source", F.length("_text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of each group linked by five-word Jaccard similarity of 0.8 or more."""
    return simhash.representatives(docs, COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents at their fitted rates.

    A clean document whose rate is half a copy or more stays at least once, so
    none of those is lost to rounding; the rates decide on all others.
    """
    mixed = mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=COLUMNS)
    stays = (F.col("p_toxic") < CLEAN) & (F.col("_rate") >= STAYS)
    copies = F.when(stays, F.greatest("_copies", F.lit(1))).otherwise(F.col("_copies"))
    return mixed.select(*COLUMNS, F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of power-of-two lengths."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("mixing", mixture),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
