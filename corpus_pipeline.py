"""The text pipeline: documents are filtered, deduplicated twice, mixed and encoded, each stage over what the last one kept.

Null texts count as empty in every stage. Null identifiers are kept as they are. Rows with one identifier are rows of
their own until their texts make them copies. Empty tables pass through; other columns stay, but names that begin with
``__`` are taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.llm import exact_dedup, lexicon, mixing, near_dedup, quality
from oddsloom.llm.tables import read, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the classifier's threshold.

    Empty texts score by the model's bias; without any label all scores are 1/2 and all documents stay. Repeated rows
    score alike, so all or none of them stay.
    """
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model, "__quality").filter(F.col("__quality") >= quality.THRESHOLD).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest identifier; one without comes last. Null and empty texts are equal; of repeated rows one stays."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class, the document with the smallest identifier; one without comes first. Texts without a word are one class."""
    return near_dedup.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order; those of sources with more weight than words come twice.

    A null source is one of its own. Empty texts weigh nothing and come as often as their place on the token line says.
    """
    return mixing.mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document; an empty text has none, and repeated rows are encoded each."""
    coded = lexicon.encode(docs.select("doc_id", "lang", "source", "text"), lexicon.fit(docs))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: A fitted classifier has no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
