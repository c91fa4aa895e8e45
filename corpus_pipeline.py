"""The corpus pipeline: language ID, quality rules, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept;
what it returns is written as Parquet and read again.  All but the last return the
columns of documents, and whole rows of them; the last returns the packed pieces.

Defined results, of every stage but the last: a null or empty text has no letter and goes
with language ID; null languages and sources are values of their own; rows of null or
repeated ids are judged each by itself, but of equal or near-equal texts one row stays,
that with the smallest id (a null id comes last); of ties in language shares the first
name wins; a table without rows gives none; columns of any name are passed on as they
are.  A text of any length is read whole.  packing_stage: see ``linkweave.llm.packing``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave import ship
from linkweave.llm import jaccard, langid, packing, quality, storage
from linkweave.llm.queries import table

#: A document goes if no language has this share of it: it is in none of the known ones for the most part.
LEAST_SHARE = 0.4
#: Words that a text must have.  Short texts are no worse than others here: the count is op6's rule, for its query alone.
LEAST_WORDS = 1
#: Words of a shingle.
WORDS = 5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose main language has a share of LEAST_SHARE or more."""
    ship(spark)
    found = langid.predicted(docs, langid.fit(docs), docs.columns)
    return storage.columns(found.filter((F.col("__lw_lang") != langid.UNKNOWN) & (F.col("__lw_score") >= LEAST_SHARE)), docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule of repeats and the adaptive limits of their language and source keep."""
    ship(spark)
    return quality.good(docs, LEAST_WORDS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates."""
    ship(spark)
    return jaccard.without_near_duplicates(docs, WORDS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their bins."""
    ship(spark)
    return packing.packed(packing.by_text(docs))


STAGES = [("language_id", language_stage), ("quality_rules", quality_stage), ("simhash_dedup", dedup_stage), ("best_fit_packing", packing_stage)]

#: SQL has no byte-exact form of the language model or of best fit.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = storage.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
