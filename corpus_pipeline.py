"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the
last return the columns of documents; the last returns the packed pieces with their token ids.

Rows without an id or a text stay in every stage that drops rows. Of rows equal in id and text one stays. Tables without
documents, labels or items are met; without labels no learned word counts, only the grammar's own. Columns of documents
beside doc_id, text and n_chars pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import fold_of, read, stored
from palimpsest.llm.decontaminate import decontaminate
from palimpsest.llm.near_dups import drop_near_duplicates
from palimpsest.llm.packing import pack
from palimpsest.llm.secrets import redact
from palimpsest.llm.toxicity import score, train

#: Jaccard similarity from which the pipeline takes documents as near-duplicates; op2 has its own bound of 85.
NEAR_PERCENT = 80


CORE = ("doc_id", "text", "n_chars")


def beside(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of docs after an operator; those beside CORE pass under names that clash with no result of it."""
    quoted = [f"`{c.replace('`', '``')}`" for c in docs.columns]
    held = [c if c in CORE else f"__column_{i}" for i, c in enumerate(docs.columns)]
    out = operator(docs.select([F.col(q).alias(h) for q, h in zip(quoted, held)]))
    return out.select([F.col(h).alias(c) for h, c in zip(held, docs.columns)])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the clause grammar scores as toxic."""
    model = train(docs, read(spark, sf_dir, "labels"), fold_of(F.col("doc_id"), 5) != 0)
    return beside(docs, lambda d: score(d, model).filter("score < 0.5"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, of 80 % of five-word shingles at least."""
    return beside(docs, lambda d: drop_near_duplicates(d, NEAR_PERCENT))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark phrase."""
    items = read(spark, sf_dir, "benchmark")
    return beside(docs, lambda d: decontaminate(d, items).filter(F.size("spans") == 0))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts; every document stays."""
    clean = beside(docs, redact)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))
    return clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts documents into power-of-two sequences of token ids."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: Toxicity is a trained classifier and packing a tokenizer: no SQL gives their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
