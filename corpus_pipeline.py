"""Documents to packed training sequences: languages, quality, near-duplicates, repeated passages, packing.

Each stage works on all that the one before it kept and returns the columns of documents, the last one the packed pieces with
their token ids. Rows with a null text are kept until language identification, which rejects them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import langid, ngramjoin, packing, quality, suffixdedup
from colloquy.llm.tables import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter go, and texts with more phrases per symbol than the learnt texts of their length parsed by one another."""
    learnt = langid.sample(docs.where(~langid.held_out("doc_id", 4)))
    found = langid.identify(docs, learnt, carry=COLUMNS, limits=langid.bounds(learnt))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("is_foreign")).select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the quality classifier predicts as label 0 go."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, carry=COLUMNS).where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays."""
    groups = ngramjoin.join(docs)
    others = groups.where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document holds are cut out."""
    kept = suffixdedup.dedup(docs, carry=("lang", "source"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), remember=packing.BEHIND_OTHERS, text_bytes=packing.TEXT_BYTES_BEHIND)


STAGES = [
    ("language ID", language),
    ("quality classifier", clean),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", passages),
    ("best-fit packing", pack),
]

#: Models, automata and packing are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
