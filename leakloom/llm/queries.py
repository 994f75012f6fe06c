"""One query for each corpus operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .collocations import ORACLE as COLLOCATION_SQL
from .conversations import ORACLE as CONVERSATION_SQL
from .decontaminate import ORACLE as DECONTAMINATION_SQL

TOKENIZERS = "/opt/tokenizers"


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; nothing of it is kept in this repository."""
    try:
        import public_tokenizers
    except ImportError:
        return f"{TOKENIZERS}/{name}"
    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_digest

    return toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_digest

    return license_digest(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_lm import score_digest

    return score_digest(table(spark, sf_dir, "documents"))


def op7_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .syncmers import fingerprint_digest

    return fingerprint_digest(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_digest

    return language_digest(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_file_digest

    return token_file_digest(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_digest

    return mix_digest(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import conversation_digest

    return conversation_digest(table(spark, sf_dir, "conversations"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_decontamination": op3_decontamination,
    "op4_license_scan": op4_license_scan,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_lm_scores": op6_lm_scores,
    "op7_syncmer_fingerprints": op7_syncmer_fingerprints,
    "op8_language_id": op8_language_id,
    "op9_token_files": op9_token_files,
    "op10_mixing": op10_mixing,
    "op11_collocations": op11_collocations,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_url_filter": op13_url_filter,
}

ORACLES: dict[str, str] = {
    "op3_decontamination": DECONTAMINATION_SQL,
    "op11_collocations": COLLOCATION_SQL,
    "op12_conversation_repair": CONVERSATION_SQL,
}
