"""The queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackmesh.llm import avi, bpe_transducer, factorisation, jaccard_join, language_spans, line_rules, packing, secrets, substring_dedup, token_attribution
from trackmesh.llm import sql as oracles
from trackmesh.llm.common import read_documents
from trackmesh.session import ship

#: Where the public vocabularies lie unless a caller says otherwise.
RANKS, TOKENIZER = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"


def vocabulary(name: str) -> tuple[str, str]:
    """A public vocabulary's path, and the splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def _query(apply: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return apply(read_documents(spark, sf_dir))

    return run


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return factorisation.quality_scores(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_media_columns": _query(avi.media_digest),
        "op2_secret_scans": _query(secrets.secret_digest),
        "op3_substring_dedup": _query(substring_dedup.dedup_digest),
        "op4_ngram_jaccard_join": _query(jaccard_join.near_duplicates),
        "op5_byte_bpe": _query(lambda docs: bpe_transducer.encode_and_decode(docs, *vocabulary(RANKS))),
        "op6_quality_rules": _query(line_rules.quality_report),
        "op7_packing": _query(lambda docs: packing.pack(docs, *vocabulary(TOKENIZER))),
        "op8_quality_classifier": _op8,
        "op9_language_id": _query(language_spans.language_report),
        "op10_token_counts": _query(lambda docs: token_attribution.section_tokens(docs, *vocabulary(RANKS))),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_scans": secrets.oracle_sql(), "op3_substring_dedup": oracles.SUBSTRING_DEDUP, "op6_quality_rules": oracles.QUALITY_RULES}
