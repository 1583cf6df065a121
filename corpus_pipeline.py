"""Cleaning a corpus: quality rules, near-duplicates, decontamination, personal data, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; its result is written to the shared folder and read again. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.decontaminate import decontaminate
from loomspan.llm.jaccard import text_hash
from loomspan.llm.pii import anonymize
from loomspan.llm.quality import quality_rules
from loomspan.llm.sentencepiece_scan import encode_summary
from loomspan.llm.simhash import near_copies
from loomspan.session import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base test and the learned rules keep, each row by its own text.

    A row with a null doc_id is judged like any other, and rows of one doc_id
    each by their own text; equal rows go or stay together. Null, empty and
    blank texts fail the base test. Without usable labels the base test stands
    alone; an empty table gives an empty one. Other columns than those of
    documents go.
    """
    hashed = docs.withColumn("text_hash", text_hash(F.col("text")))
    verdict = quality_rules(hashed, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=("text_hash",))
    good = written(verdict.where("kept").select("doc_id", "text_hash").distinct(), "pipeline-good")
    same = hashed.doc_id.eqNullSafe(good.doc_id) & (hashed.text_hash == good.text_hash)
    return hashed.join(good, same, "left_semi").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a similarity of 0.8 or more of their five-word shingles the document with the smallest doc_id.

    A document without a doc_id stays, and so do rows that repeat both doc_id and
    text of one that stays: they are one document. Texts without a word are
    copies of each other; an empty table gives an empty one.
    """
    goes = near_copies(docs).where("doc_id <> component_id").select("doc_id", "text_hash").distinct()
    return docs.withColumn("text_hash", text_hash(F.col("text"))).join(written(goes, "pipeline-goes"), ["doc_id", "text_hash"], "left_anti").select(*COLUMNS)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Null and empty texts stay, as do rows with a null doc_id that hold none; without a benchmark all stay."""
    checked = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return checked.where("not contaminated").select(*COLUMNS)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; n_chars follows the new text, null for a null text. No row goes or is added."""
    clean = anonymize(docs, "a key of the deployment")
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids, n_chars, text_crc32) of what is left, a row for each; null and empty texts have no pieces."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return encode_summary(docs, path, byte_pair_as_unigram=True)


STAGES = [
    ("quality_rules", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_leaked),
    ("personal_data", replace_private),
    ("sentencepiece", to_pieces),
]

#: Fingerprints, learned rules and pieces are beyond SQL; tests compare with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
