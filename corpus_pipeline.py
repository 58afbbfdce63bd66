"""The corpus pipeline: quality rules, near-duplicate join, substring dedup, secret redaction, packing.

Cases, of every stage but the last, which returns pieces: the columns of documents stay as they are, whatever other columns
there are. Null texts count as empty; the first stage rejects them, as all texts under 50 words, and later ones keep what
they are given (a null stays null). Repeated rows are one group, of which the second stage keeps one; of a tie (one doc_id,
several texts of a group) the text with the smaller hash. Very long texts are handled whole. An empty table goes through as
an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackmesh.llm import jaccard_join, line_rules, packing, secrets, substring_dedup
from trackmesh.llm.common import materialize, read_documents
from trackmesh.llm.queries import TOKENIZER, vocabulary
from trackmesh.session import ship
from trackmesh.shared import drop, written

#: No SQL expresses the tokenizer or the near-duplicate join; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and with them the documents that lose too much; null, empty and short texts are such."""
    ship(spark)
    return line_rules.clean(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest doc_id, a null last."""
    ship(spark)
    return jaccard_join.keep_first(docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand earlier elsewhere are cut out; a document of which nothing is left stays, empty."""
    ship(spark)
    return substring_dedup.drop_repeats(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked, overlapping ones as one; all else stays."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of token sequences; an empty text is its end id alone."""
    ship(spark)
    return packing.pack(docs, *vocabulary(TOKENIZER))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup_stage),
    ("secret scans", secret_scans),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again; what it was made from is then deleted."""
    docs, before = read_documents(spark, sf_dir), set(written())
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop(spark, [path for path in written()[:-1] if path not in before])
    return docs
