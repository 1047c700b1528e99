"""From raw documents to token ids: five stages, each on all its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import _util as U
from quillon.llm import jaccard_join, pfair_mix, pii, piece_bpe
from quillon.llm import toxicity as tox


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the model scores at 0.5 or more; null and empty texts get the score of an empty text."""
    labels = U.table(spark, sf_dir, "labels").select("doc_id", "toxic").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    model = tox.fit(docs, labels)
    name = U.fresh(docs, "score")
    return tox.score(docs, model, score_col=name).where(F.col(name) < 0.5).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, with the smallest id, of every group linked by Jaccard 0.8 on five-word shingles; null and empty texts stay."""
    return jaccard_join.first_of_each(docs, n=5, num=80, den=100)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in every text by the name of its kind; n_chars follows.  Null texts stay null."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put all rows into the sequence that meets the sources' target weights; a null source is a source, rows that share an id stay together."""
    return pfair_mix.in_mixed_order(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with proof that they decode to it, and its position in the mixed sequence; null texts have no ids."""
    return piece_bpe.encode_texts(pfair_mix.with_position(docs), public_tokenizers.path("piece_bpe_32k.model"), keep=["position"])


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("pieces", pieces),
]

#: The classifier, the exact similarity join's closure and the tokenizer are not expressible in SQL;
#: tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written as Parquet and read again."""
    docs = U.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = U.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
