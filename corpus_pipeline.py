"""The corpus pipeline: each stage takes what the one before kept.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``. All but the last return the
columns of ``documents``; the last returns the packed pieces. Every stage takes
nulls in any column, empty and very long texts, repeated rows, an empty table
(which gives an empty one) and further columns of any name, which stay with
their rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconloom.llm import jaccard_join, language_id, mixing, packing, substring_dedup
from reconloom.llm.common import fold
from reconloom.sources.durable import release, scratch
from reconloom.sources.tables import table

#: A document without letters, or with a mean log-likelihood a gram more spreads than this below the usual, is rejected.
MOST_STRANGE = 10.0


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text is in the learned languages, one or several; not foreign text or noise.

    Null and empty texts and texts without letters go; rows with a null id or lang are judged as others are, and equal
    texts alike. With no labelled row there are no languages, and nothing is kept. The usual comes from the rows of fold 2, which the model has not seen; without such rows only letters are asked for."""
    model = language_id.fit(docs.where(fold() != 2))
    usual = language_id.usual(docs.where(fold() == 2), model)
    found = language_id.predict(docs, model, prefix="_lid_", against=usual)
    known = F.col("_lid_lang_pred") != language_id.UNDETERMINED
    return found.where(known if usual is None else known & (F.col("_lid_strange") <= MOST_STRANGE)).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each group of near copies.

    Documents without a word and rows with a null id have no copies and stay; of rows with one id and text one stays."""
    return jaccard_join.keep_one(docs, percent=75, width=5)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 20 words and more that an earlier document, or an earlier place of the same one, has.

    No row goes: a text that loses all its words becomes empty. Null texts stay null, rows with a null id stay as they
    are, and ``n_chars`` is set to the new length (0 for a null text)."""
    return substring_dedup.deduplicated(docs, window=20)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as the source weights ask; a document taken twice is two rows.

    A null source is a source of its own; null and empty texts have size 0 and are taken once for each full epoch."""
    return mixing.mix(docs, weights=(5, 2, 1), most=3.0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences of 4096 tokens; a null or empty text is its end token, a repeated row is packed again."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), limit=4096, end_id=1)


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_near_copies),
    ("substring_dedup", without_repeats),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: SQL can express neither the language model nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        with scratch() as made:
            docs = made.keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            release(before)
        before = docs
    return docs
