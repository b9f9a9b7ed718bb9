"""Corpus pipeline: quality, line dedup, near-dedup, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``.  All
stages but the last return the columns of ``documents``; the last returns
the packed pieces.  ``run`` applies them to ``documents``; its tables lie
in the folder that ``spark.checkpoint.dir`` names.

Defined cases: a null or empty text is scored like any other and, where
the classifier accepts it, packed as the empty document; a null id takes
part in every stage and is no one's near-duplicate by its id; repeated rows
are near-duplicates of one another, and rows of one id go or stay together;
columns other than those of ``documents`` are dropped by the first stage;
empty tables give no pieces.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tavolo.llm import lines, minhash, packing, pii, quality
from tavolo.plans import ensure_checkpoint_dir
from tavolo.sources import Tables

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _recounted(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, with the length of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of ``sf_dir``, does not reject."""
    chain = quality.train(docs, Tables(spark, sf_dir).labels)
    return quality.keep_good(docs.select(*COLUMNS), chain)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sites share (the first copy of a line stays)."""
    return _recounted(lines.cut_lines(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    verdict = minhash.near_duplicates(docs).where("not kept").select("doc_id")
    return docs.select(*COLUMNS).join(verdict, "doc_id", "left_anti").select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return _recounted(pii.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", without_boilerplate),
    ("near dedup", one_of_each_group),
    ("personal data", without_personal_data),
    ("packing", packed),
]

# The classifier is trained, so SQL cannot say what run() returns; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = Tables(spark, sf_dir).documents
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
