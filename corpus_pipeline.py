"""The corpus pipeline: five stages over documents, each of which takes what its predecessor kept.

Language ID drops documents without a language (null, empty or letterless texts); texts that mix languages stay. Near-dedup keeps
one document of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more; decontamination drops documents with a benchmark passage; personal data is redacted in place; encoding
adds token ids and what they decode to. Every stage but the last returns the columns of documents.

Defined results: a null, empty or letterless text has no language and goes in the first stage; given to a later stage, it is an empty text.
Rows of equal doc_id and text are one document after near-dedup; of rows of equal doc_id with other texts each stays, unless they are near
copies. Null doc_ids are documents like any other. An empty table gives an empty result in every stage, and extra columns pass through. run()
leaves its intermediate tables in the shared folder, as its result still reads them; tallyloom.session.discard() deletes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import byte_bpe, decontaminate, language, pii, shingles
from tallyloom.llm.tables import table
from tallyloom.session import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, by a field fitted on a bounded sample of docs."""
    found = language.identify(docs, language.fit(docs))
    return found.where(F.col("lang_pred") != language.UND).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that of the smallest doc_id."""
    return shingles.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("spans") == 0).select(*docs.columns)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind in brackets; n_chars is the new text's."""
    found = pii.find(docs, "text", pii.fit(docs))
    clean = found.withColumn("text", pii.redact("text", "base", "added"))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and digests of these and of the bytes that they decode to."""
    coded = byte_bpe.round_trip(docs.select("doc_id", "text"), keep=["doc_id"])
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminated), ("pii", redacted), ("byte_bpe", encoded)]

#: SQL has no fitted field and no boosted trees; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
