"""A corpus from raw documents to packed sequences, in five stages of flowrhythm.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrhythm.llm import near_dedup, packing, pii, quality, substrings
from flowrhythm.llm.common import shared_dir
from flowrhythm.llm.tokens import read_source


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts; it learns from the labels that are not held out.

    Null and empty texts are scored by the curve's offset alone. Without labels of both kinds nothing is rejected. Long
    texts count whole, repeated rows each, other columns stay, and an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.reject_low_quality(docs, quality.fit(docs, quality.training_labels(labels)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one of the least id.

    Equal texts are one class, null and empty ones too, and so are texts of fewer than five words that are equal; a null
    id is the least one. Rows that agree in id and text are one document, and all stay with it. Long texts count whole,
    and an empty table stays empty.
    """
    return near_dedup.keep_one(docs)


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the runs of sentences that an earlier one has; n_chars follows the text.

    Earlier is the lesser id, a null one being the least. A null text stays null, one that is repeated altogether becomes
    empty, and short ones stay as they are. Rows that agree in id and text are treated alike; an empty table stays empty.
    """
    return _recount(substrings.remove_repeats(docs))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text.

    Null and empty texts stay. Spans that overlap become one. Without any example the fixed patterns alone are used;
    long texts are read whole, repeated rows each, and an empty table stays empty.
    """
    return _recount(pii.mask_documents(docs, pii.fit(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of 4096 tokens.

    A null or empty text is its end token. Longer documents are cut into pieces of 4096; repeated rows are packed each,
    and an empty table gives no rows.
    """
    import public_tokenizers

    return packing.pack_documents(docs, read_source(public_tokenizers.path("word_bpe_49k.json")))


def _recount(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_spans),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: Training, hashing of sketches and the search for fillings have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
