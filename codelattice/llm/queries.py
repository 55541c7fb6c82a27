"""The queries opN_<name> of this package, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codelattice.llm import op1_urls, op2_audio, op3_shard, op4_jaccard, op5_mix, op6_html, op7_decontaminate, op8_langid, op9_repeats, op10_tokens
from codelattice.llm.common import table


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_urls.filtered(table(spark, sf_dir, "pages"), op1_urls.default_rules(spark))


def op2_audio_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media column is a WAV recording that plays each embedding."""
    prints = op2_audio.fingerprints(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", op2_audio.rendered_wav)
    return op2_audio.matches(prints)


def op3_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_shard.assignments(table(spark, sf_dir, "documents"))


def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_mix.sampling(table(spark, sf_dir, "documents"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_repeats.repeated_passages(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_tokens.token_counts(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    gold = op6_html.gold_of(pages, table(spark, sf_dir, "documents"))
    return op6_html.extracted(pages, op6_html.train(pages, gold))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_langid.identify(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_audio_matches, op3_reshard, op4_ngram_jaccard_join, op5_mixture, op6_html_extraction, op7_decontamination, op8_language_id, op9_repeated_passages, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": op1_urls.sql(), "op5_mixture": op5_mix.sql()}
