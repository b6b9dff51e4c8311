"""A training-corpus pipeline over ``documents``, as a chain of stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver or
``run`` writes it as Parquet and reads it again as the next stage's ``docs``.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import decontam, langid, minhash, packing, quality
from siltstone.llm.common import Scratch, read, where_of

#: A document goes if its score is under this: it is likelier of quality 0 than 1.
QUALITY_FLOOR = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those that no learnt language explains.

    Null and empty texts go, as texts without letters. Rows with a null ``lang``
    teach nothing and are judged like others; null ids are judged and kept.
    Texts count whole, whatever their length. A tie between languages goes to
    the first by name and rejects nothing. Rows that repeat are judged alike. An
    empty table gives no rows. Extra columns are kept, whatever their names.
    """
    models = langid.train(docs, langid.learnable())
    return where_of(docs, langid.NEW, lambda d: langid.identify(d, models), "not rejected")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the factorisation machine holds for low quality.

    Null and empty texts are scored like any other, from their statistics; a
    null ``n_chars`` is the text's length. A score of exactly the floor stays, so
    without usable labels nothing goes. Null ids are scored and teach nothing;
    rows that repeat an id are scored each. Long texts count whole. Extra
    columns are kept, whatever their names. An empty table gives no rows.
    """
    model = quality.train(docs, read(spark, sf_dir, "labels"), quality.remainder("doc_id", 3) != 1)
    return where_of(docs, ["score"], lambda d: quality.score_documents(d, model), f"score >= {QUALITY_FLOOR}")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near duplicates.

    Null and empty texts and rows without an id are in no group and stay. Rows
    with one id and different texts are judged by their texts; of rows that
    repeat both, one stays. Long texts count whole; extra columns are kept,
    whatever their names. An empty table gives no rows.
    """
    return minhash.without_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item's question and answer.

    Null and empty texts hold none and stay; null ids are judged by their text,
    rows that repeat each. Long texts are searched whole. Null, empty and
    repeated items change nothing; without items all stay. Extra columns are
    kept, whatever their names. An empty table gives no rows.
    """
    return where_of(docs, decontam.NEW, lambda d: decontam.find_leaks(d, read(spark, sf_dir, "benchmark")), "not leaked")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, in windows of 2048 ids.

    Null and empty texts are the end id alone; null ids come first, rows that
    repeat an id follow each other by text. Long texts are cut, none is dropped.
    Of cuts that cost the same the first found holds. Other columns are ignored.
    An empty table gives no rows.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language", language),
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Models and tokenizers are outside SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
