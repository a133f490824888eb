"""The corpus pipeline: documents in, packed training sequences out.

Each stage is one corpus operator; what it returns is written and read again
as the next stage's documents. In every stage a null text counts as an empty
one, null ids, languages and sources are allowed, rows that repeat are judged
each, further columns stay whatever their names (the last stage's rows are
pieces), a text is judged whole however long it is, and an empty table gives an
empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlake.llm import decontaminate, ngram_join, packing, quality, toxicity
from learnlake.llm.common import read, shared_dir
from learnlake.llm.queries import tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; an empty text is measured as empty. Without labels nothing is known against any."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.accepted_documents(docs, model, F.col("source"), F.col("lang"))


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; a text without words has the score of none. Without labels all stay."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more.

    It is the one with the smallest doc_id, those without one coming last. Rows
    are told apart by doc_id and text; texts without words are no copies.
    """
    return ngram_join.without_near_copies(docs, size=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; a document of which no word is left goes, one that had no hit is returned as it was."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 tokens; an empty text is its end token alone."""
    return packing.pack_documents(docs, tokenizer_path(), literal=False)


STAGES = [
    ("quality classifier", good_quality),
    ("toxicity", harmless),
    ("n-gram Jaccard join", deduplicated),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]

#: The first stages are trained models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's rows are written to the shared folder once."""
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
