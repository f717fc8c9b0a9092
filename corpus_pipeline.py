"""The corpus pipeline: documents to token ids in five stages, each of which works on all that its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir). All but the last return the columns of `documents`, whatever other
columns there are. Every stage judges rows, not ids: of rows that repeat a doc_id each is judged by its own text, and rows without one
take part. Null and empty texts are documents without words. An empty table gives an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import shared_table, table
from gridloom.llm.decontamination import decontaminate
from gridloom.llm.minhash import near_duplicates, text_digest
from gridloom.llm.quality_gam import score_quality, train_quality
from gridloom.llm.sentencepiece_unigram import UnigramTokenizer, encode_documents
from gridloom.llm.suffix_dedup import remove_repeats

#: From this similarity on, in percent, the pipeline takes documents for near duplicates; op4 has a threshold of its own.
STAGE_SIMILAR = 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on `labels`, doesn't reject. Texts without words are scored as such; without labels all stay."""
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    whole = docs.select(F.struct(*docs.columns).alias("document"))
    return score_quality(whole, model, ["document"], "document.text").where("predicted = 1").select("document.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id.

    Rows with the same doc_id and text are one document, of which one row stays (the others are equal to it but for other columns). Of
    different texts with that smallest doc_id the one with the smallest digest stays. Rows without a doc_id are in no group: one of each
    text stays. So do documents without words, which are linked with nothing.
    """
    keyed = docs.select(F.struct(*docs.columns).alias("document"), F.col("doc_id").cast("long").alias("id"), text_digest(docs["text"]).alias("row"))
    verdicts = near_duplicates(docs, STAGE_SIMILAR).select("doc_id", "row", "kept", "n_shingles")
    copies = verdicts.where("NOT kept").select(F.col("doc_id").alias("id"), "row")
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return keyed.join(copies, ["id", "row"], "left_anti").select("document.*")
    first = verdicts.where("kept AND n_shingles > 0 AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.min("row").alias("first"), F.max("row").alias("last")).where("first < last")
    others = verdicts.where("kept AND n_shingles > 0").select(F.col("doc_id").alias("id"), "row").join(first, "id").where(F.col("row") > F.col("first")).select("id", "row")
    left = keyed.join(copies.union(others).distinct(), ["id", "row"], "left_anti")
    one = left.groupBy("id", "row").agg(F.min_by("document", F.to_json(F.struct("document"))).alias("document"))
    return one.select("document.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that repeat an earlier 100-byte string; n_chars follows the text. Documents left without a text stay."""
    cut = remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text doesn't overlap an item of `benchmark`; without items all stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source of every document left, with the ids of its text and their number (0 for null and empty texts)."""
    out = encode_documents(docs, UnigramTokenizer.load(), ["doc_id", "lang", "source"])
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("suffix_repeats", cut_repeats),
    ("decontamination", keep_uncontaminated),
    ("sentencepiece", encode),
]

#: The classifier, the removal of bytes and the tokeniser are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; between them the documents are written to the shared folder and read again.

    drop_shared_tables() of gridloom.llm.common deletes these tables once the result has been used.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
